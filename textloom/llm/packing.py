"""Filling containers of fixed capacity: dominance reduction, then best fit, on size counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from textloom.plans.session import cut

#: Slices that the items of one size are numbered in, so that a hot size spreads over tasks.
SLICES = 128

#: ``(sizes in one container, number of such containers)``
Pattern = tuple[tuple[int, ...], int]


def _largest(count: list[int], at_most: int) -> int:
    """The largest size up to ``at_most`` of which an item is left, or 0."""
    while at_most > 0 and not count[at_most]:
        at_most -= 1
    return max(at_most, 0)


def _smallest(count: list[int], how_many: int) -> list[int]:
    """Sizes of the smallest items left."""
    found: list[int] = []
    for size in range(1, len(count)):
        found += [size] * min(count[size], how_many - len(found))
        if len(found) == how_many:
            break
    return found


def _pairs(count: list[int], room: int) -> tuple[int, int]:
    """Of all pairs of items left that fit ``room``: the largest sum, and the largest smaller item."""
    sizes = [s for s in range(1, min(room, len(count) - 1) + 1) if count[s]]
    most, second, high = 0, 0, len(sizes) - 1
    for low, s in enumerate(sizes):
        while high >= 0 and sizes[high] + s > room:
            high -= 1
        if high < low or high == low and count[s] < 2:
            break
        most = max(most, s + sizes[high])
        if count[s] > 1 and 2 * s <= room or low + 1 < len(sizes) and s + sizes[low + 1] <= room:
            second = s
    return most, second


def reduce_dominated(count: list[int], capacity: int) -> list[Pattern]:
    """Fix containers whose items dominate every other choice for their largest item, after
    Martello and Toth; takes them out of ``count`` (items by size) and returns them.

    For each item, from the largest on, and its room ``r``: alone if nothing fits; with an item that fills
    ``r`` exactly; with the largest item that fits if no two items fit together; and, if no three
    fit, with that item if it is at least as large as any pair, or with it and the largest item
    that fits beside it if that is at least as large as the smaller item of any pair. Taking
    items away keeps each of these conditions, so equal cases are fixed as often as the counts
    allow at once and the work depends on the number of sizes only.
    """
    fixed: list[Pattern] = []
    for size in range(capacity, 0, -1):
        while count[size]:
            count[size] -= 1
            room = capacity - size
            one = _largest(count, room)
            chosen: tuple[int, ...] | None = None
            if not one:
                chosen = ()
            elif one == room:
                chosen = (one,)
            else:
                small = _smallest(count, 3)
                if len(small) < 2 or small[0] + small[1] > room:
                    chosen = (one,)
                elif len(small) < 3 or sum(small) > room:
                    most, second = _pairs(count, room)
                    count[one] -= 1
                    beside = _largest(count, room - one)
                    count[one] += 1
                    if one >= most:
                        chosen = (one,)
                    elif beside and beside >= second:
                        chosen = (one, beside)
            count[size] += 1
            if chosen is None:
                break
            uses = {s: (size, *chosen).count(s) for s in (size, *chosen)}
            times = min(count[s] // k for s, k in uses.items())
            for s, k in uses.items():
                count[s] -= k * times
            fixed.append(((size, *chosen), times))
    return fixed


def best_fit(count: list[int], capacity: int) -> list[Pattern]:
    """Fill containers with what is left, largest items first, each with the subset of the
    other sizes that leaves the least room (found over all sums at once as bits of a number);
    equal containers are made as often as the counts allow."""
    made: list[Pattern] = []
    while top := _largest(count, capacity):
        count[top] -= 1
        room = capacity - top
        reach, steps = 1, []
        mask = (1 << (room + 1)) - 1
        for size in range(min(room, len(count) - 1), 0, -1):
            left, k = min(count[size], room // size), 1
            while left:  # powers of two of one size reach every number of it
                k_now = min(k, left)
                steps.append((size, k_now, reach))
                reach |= (reach << (size * k_now)) & mask
                left, k = left - k_now, k * 2
            if reach >> room:
                break
        goal = reach.bit_length() - 1
        chosen: list[int] = []
        for size, k, before in reversed(steps):
            if not before >> goal & 1:
                chosen += [size] * k
                goal -= size * k
        count[top] += 1
        pattern = (top, *sorted(chosen, reverse=True))
        uses = {s: pattern.count(s) for s in pattern}
        times = min(count[s] // k for s, k in uses.items())
        for s, k in uses.items():
            count[s] -= k * times
        made.append((pattern, times))
    return made


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold every item of a histogram of sizes from 1 to ``capacity``."""
    count = [0] * (capacity + 1)
    for size, n in histogram.items():
        count[size] = n
    return [*reduce_dominated(count, capacity), *best_fit(count, capacity)]


def _placer(patterns: list[Pattern], first: int):
    """Arrow function from ``(size, rank)`` to the container's number; ranks are from 0."""
    by_size: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    base = first
    for sizes, times in patterns:
        for s in dict.fromkeys(sizes):
            k, start = sizes.count(s), seen.get(s, 0)
            by_size.setdefault(s, []).append((start, base, k))
            seen[s] = start + k * times
        base += times
    packed = {s: np.array(x, dtype=np.int64).T for s, x in by_size.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            out = np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                starts, bases, uses = packed[int(s)]
                k = np.searchsorted(starts, rank[at], side="right") - 1
                out[at] = bases[k] + (rank[at] - starts[k]) // uses[k]
            names = ["doc_id", "piece", "n_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(out)], [*names, "container_id"])

    return run


def pack(sizes: DataFrame, capacity: int = 2048, slices: int = SLICES) -> DataFrame:
    """``doc_id, piece, n_tokens, container_id`` for items ``doc_id, n_tokens``.

    An item above ``capacity`` is cut into pieces from 0 on, all but the last of them full;
    every other item is one piece 0. Full pieces have a container each. Items of size 0 or
    null need no room and have a null container. ``doc_id`` may repeat: each row is an item.

    Only the histogram of sizes (at most ``capacity`` numbers, however many items) reaches the
    driver, where the patterns are made. Items are numbered within their size in ``slices``
    parts, and find their container from that number; the broadcast offsets have at most
    ``capacity * slices`` rows and the plan some patterns per size.
    """
    items = cut(
        sizes.select(
            "doc_id",
            F.coalesce(F.col("n_tokens").cast("int"), F.lit(0)).alias("_size"),
            F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(slices)).cast("int").alias("_slice"),
        )
    )
    rest = F.col("_size") % capacity
    loose = items.where("_size <= 0").select(
        "doc_id", F.lit(0).alias("piece"), F.lit(0).alias("n_tokens"), F.lit(None).cast("long").alias("container_id")
    )
    part = items.where((F.col("_size") > 0) & (rest > 0)).select(
        "doc_id", F.floor(F.col("_size") / capacity).cast("int").alias("piece"), rest.alias("n_tokens"), "_slice"
    )
    part = part.unionByName(
        items.where((F.col("_size") == capacity)).select(
            "doc_id", F.lit(0).alias("piece"), F.lit(capacity).alias("n_tokens"), "_slice"
        )
    )
    counts = part.groupBy("n_tokens", "_slice").count()
    held = counts.collect()  # at most capacity * slices rows
    histogram: dict[int, int] = {}
    for row in held:
        histogram[row["n_tokens"]] = histogram.get(row["n_tokens"], 0) + row["count"]
    patterns = plan(histogram, capacity)
    used = sum(times for _, times in patterns)
    offsets: list[tuple[int, int, int]] = []
    running: dict[int, int] = {}
    for row in sorted(held, key=lambda r: (r["n_tokens"], r["_slice"])):
        offsets.append((row["n_tokens"], row["_slice"], running.get(row["n_tokens"], 0)))
        running[row["n_tokens"]] = offsets[-1][2] + row["count"]
    spark = sizes.sparkSession
    known = spark.createDataFrame(offsets, "n_tokens int, _slice int, _before long")
    in_slice = Window.partitionBy("n_tokens", "_slice").orderBy("doc_id", "piece")
    ranked = (
        part.withColumn("_row", F.row_number().over(in_slice))
        .join(F.broadcast(known), ["n_tokens", "_slice"])
        .select("doc_id", "piece", "n_tokens", (F.col("_before") + F.col("_row") - 1).alias("_rank"))
    )
    kind = sizes.schema["doc_id"].dataType.simpleString()
    placed = ranked.mapInArrow(
        _placer(patterns, 0), f"doc_id {kind}, piece int, n_tokens int, container_id long"
    )
    full = (
        items.where(F.col("_size") > capacity)
        .withColumn("_pieces", F.floor(F.col("_size") / capacity).cast("int"))
        .select("doc_id", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("piece"), "_slice")
        .withColumn("_id", F.monotonically_increasing_id())
        .select("doc_id", "piece", F.lit(capacity).alias("n_tokens"), (F.lit(used) + F.col("_id")).alias("container_id"))
    )
    return placed.unionByName(full).unionByName(loose)


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row ``items, tokens, containers, lower_bound, mean_fill, over``: containers used against
    the least number that could hold so many tokens, and containers above the capacity (0)."""
    held = packed.where("container_id is not null").groupBy("container_id").agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("items")
    )
    return held.agg(
        F.coalesce(F.sum("items"), F.lit(0)).cast("long").alias("items"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"),
        F.count("*").alias("containers"), F.coalesce(F.ceil(F.sum("tokens") / capacity), F.lit(0)).cast("long").alias("lower_bound"),
        F.round(F.coalesce(F.avg(F.col("tokens") / capacity), F.lit(0.0)), 6).alias("mean_fill"),
        F.count_if(F.col("tokens") > capacity).alias("over"),
    )
