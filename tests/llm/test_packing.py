import random
from collections import Counter

from textloom.llm.packing import plan


def check(histogram, capacity):
    patterns = plan(dict(histogram), capacity)
    placed = Counter()
    for sizes, times in patterns:
        assert times > 0 and sum(sizes) <= capacity
        for s in sizes:
            placed[s] += times
    assert placed == Counter({s: n for s, n in histogram.items() if n})
    return sum(t for _, t in patterns)


def test_every_item_is_placed_once_within_capacity():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.randint(1, 60)
        check(Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 200))), capacity)


def test_fill_is_close_to_the_bound():
    rng = random.Random(2)
    histogram = Counter(min(2048, int(rng.lognormvariate(5.3, 0.9)) + 1) for _ in range(5000))
    used = check(histogram, 2048)
    least = -(-sum(s * n for s, n in histogram.items()) // 2048)
    assert used <= least * 1.01 + 1


def exact(sizes, capacity):
    best = len(sizes)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= sizes[k]:
                go(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, capacity - sizes[k]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    from textloom.llm.packing import reduce_dominated

    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.randint(5, 30)
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True)
        count = [0] * (capacity + 1)
        for s in sizes:
            count[s] += 1
        fixed = sum(t for _, t in reduce_dominated(count, capacity))
        left = [s for s in range(capacity, 0, -1) for _ in range(count[s])]
        assert fixed + (exact(left, capacity) if left else 0) == exact(sizes, capacity), sizes


def test_rows(spark):
    from textloom.llm.packing import pack

    rows = [(1, 5), (2, 10), (3, 21), (4, 20), (5, 0), (6, None), (7, 3), (7, 3), (8, 4)]
    out = pack(spark.createDataFrame(rows, "doc_id long, n_tokens int"), capacity=10).collect()
    total = Counter()
    for r in out:
        total[r.container_id] += r.n_tokens
        assert (r.container_id is None) == (r.n_tokens == 0)
    assert max(total.values()) <= 10
    by_doc = Counter()
    for r in out:
        by_doc[r.doc_id] += r.n_tokens
    assert by_doc == Counter({1: 5, 2: 10, 3: 21, 4: 20, 5: 0, 6: 0, 7: 6, 8: 4})
    assert sorted((r.piece, r.n_tokens) for r in out if r.doc_id == 3) == [(0, 10), (1, 10), (2, 1)]


def test_empty_table(spark):
    from textloom.llm.packing import pack

    assert pack(spark.createDataFrame([], "doc_id long, n_tokens int")).count() == 0


def test_fill(spark):
    from textloom.llm.packing import fill, pack

    sizes = spark.createDataFrame([(k, n) for k, n in enumerate([5, 5, 6, 4, 3, 7, 0, None, 23])], "doc_id long, n_tokens int")
    row = fill(pack(sizes, 10), 10).first().asDict()
    assert row == {"items": 9, "tokens": 53, "containers": 6, "lower_bound": 6, "mean_fill": 0.883333, "over": 0}
    assert fill(pack(sizes.limit(0), 10), 10).first().containers == 0
