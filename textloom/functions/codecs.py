"""Integer sequence codecs as Columns: variable-length bytes and differences."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators.numbering import running_sum, with_previous

_UINT32 = 0xFFFFFFFF


def varint_size(n: Column) -> Column:
    """Bytes of one number as LEB128 of its 32 low bits."""
    n = n.cast("long").bitwiseAND(_UINT32)
    return sum((F.when(n >= 1 << 7 * k, 1).otherwise(0) for k in range(1, 5)), F.lit(1))


def _varint_hex(n: Column) -> Column:
    u = n.cast("long").bitwiseAND(_UINT32)
    last = varint_size(n) - 1
    digits = F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.lpad(
            F.hex(
                F.call_function("shiftright", u, (k * 7).cast("int")).bitwiseAND(127)
                + F.when(k < last, 128).otherwise(0)
            ), 2, "0",
        ),
    )
    return F.array_join(digits, "")


def encode_varint(n: Column) -> Column:
    """Bytes of one number as LEB128 of its 32 low bits; null gives null."""
    return F.when(n.isNotNull(), F.unhex(_varint_hex(n)))


def encode_varints(numbers: Column) -> Column:
    """Bytes of an array of numbers; the empty array gives no bytes, null gives null."""
    return F.unhex(F.array_join(F.transform(numbers, _varint_hex), ""))


def _group_value(group: Column) -> Column:
    """Number of the hex digits of one group of up to five bytes, low bits first."""
    count = F.length(group) / 2
    parts = F.transform(
        F.sequence(F.lit(0), (count - 1).cast("int")),
        lambda k: F.call_function(
            "shiftleft", F.conv(F.substring(group, k * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseAND(127), (k * 7).cast("int")
        ),
    )
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x).bitwiseAND(_UINT32)
    return F.when(count > 5, F.raise_error(F.lit("varint is longer than five bytes")).cast("long")).otherwise(value)


def decode_varints(data: Column) -> Column:
    """Numbers of a run of varints. Fails where the bytes end inside a number, and at numbers
    of more than five bytes."""
    digits = F.hex(data)
    groups = F.regexp_extract_all(digits, F.lit("((?:[89A-F][0-9A-F])*[0-7][0-9A-F])"), F.lit(1))
    whole = F.length(F.array_join(groups, "")) == F.length(digits)
    # an array of its own, as the lambda refers to it
    values = F.transform(groups, _group_value)
    return F.when(whole, values).otherwise(F.raise_error(F.lit("varint underflow: bytes end inside a number")).cast("array<bigint>"))


def encode_deltas(numbers: Column) -> Column:
    """The first number, then differences; fails where the sequence falls. ``numbers`` should be
    a plain column, as the lambda refers to it."""
    fall = F.raise_error(F.lit("sequence isn't sorted: negative difference")).cast("long")

    def step(x: Column, k: Column) -> Column:
        d = x.cast("long") - F.element_at(numbers, F.greatest(k, F.lit(1))).cast("long")
        return F.when(k == 0, x.cast("long")).when(d < 0, fall).otherwise(d)

    return F.transform(numbers, step)


def decode_deltas(deltas: Column) -> Column:
    """Running sums."""
    empty = F.array().cast("array<bigint>")
    return F.aggregate(
        deltas, empty,
        lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x.cast("long")),
    )


def encode_deltas_rows(df: DataFrame, key: str, value: str) -> DataFrame:
    """Row form for long lists: ``delta`` of each value from the one before it of its key."""
    paired = with_previous(df, [key], value, "_previous")
    return paired.withColumn("delta", F.col(value) - F.coalesce("_previous", F.lit(0))).drop("_previous")


def decode_deltas_rows(df: DataFrame, key: str, order: str, delta: str = "delta") -> DataFrame:
    return running_sum(df, [key], [order], F.col(delta), "value")


def encoded_postings(postings: DataFrame) -> DataFrame:
    """``term, data_bytes``: bytes that each term's documents (as differences), frequencies and
    positions (as differences) take as varints."""
    gaps = encode_deltas_rows(postings.select("term", "doc_id", "tf", "positions"), "term", "doc_id").withColumnRenamed("delta", "gap")
    steps = F.transform("positions", lambda x, k: x - F.when(k > 0, F.element_at("positions", F.greatest(k, F.lit(1)))).otherwise(0))
    size = F.aggregate(F.transform(steps, varint_size), F.lit(0), lambda a, x: a + x)
    return gaps.groupBy("term").agg(F.sum(varint_size(F.col("gap")) + varint_size(F.col("tf")) + size).cast("long").alias("data_bytes"))


# One value at a time, for tools that read or write single buffers -----------------------


class Buffer:
    """Little-endian values in a byte buffer; reads beyond its end raise IndexError."""

    def __init__(self, data: bytes = b"") -> None:
        self.data, self.at = bytearray(data), 0

    def _write(self, kind: str, value) -> None:
        self.data += struct.pack("<" + kind, value)

    def _read(self, kind: str):
        size = struct.calcsize("<" + kind)
        if self.at + size > len(self.data):
            raise IndexError("read beyond the end of the buffer")
        (value,) = struct.unpack_from("<" + kind, self.data, self.at)
        self.at += size
        return value

    def write_u8(self, v: int) -> None:
        self._write("B", v & 0xFF)

    def write_u16(self, v: int) -> None:
        self._write("H", v & 0xFFFF)

    def write_u32(self, v: int) -> None:
        self._write("I", v & _UINT32)

    def write_f32(self, v: float) -> None:
        self._write("f", v)

    def write_varint(self, v: int) -> None:
        v &= _UINT32
        while v > 127:
            self.write_u8(v & 127 | 128)
            v >>= 7
        self.write_u8(v)

    def write_string(self, s: str) -> None:
        raw = s.encode("utf-8")
        self.write_u16(len(raw))
        self.data += raw

    def read_u8(self) -> int:
        return self._read("B")

    def read_u16(self) -> int:
        return self._read("H")

    def read_u32(self) -> int:
        return self._read("I")

    def read_f32(self) -> float:
        return self._read("f")

    def read_varint(self) -> int:
        value = 0
        for k in range(5):
            byte = self.read_u8()
            value |= (byte & 127) << 7 * k
            if byte < 128:
                return value & _UINT32
        raise ValueError("varint is longer than five bytes")

    def read_string(self) -> str:
        size = self.read_u16()
        if self.at + size > len(self.data):
            raise IndexError("read beyond the end of the buffer")
        self.at += size
        return self.data[self.at - size : self.at].decode("utf-8")
