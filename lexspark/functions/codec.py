"""Variable-byte integers and the hash that routes documents."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = (1 << 32) - 1


class CodecError(ValueError):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def encode(value: int) -> bytes:
    """Seven bits a byte, low ones first; the top bit marks the last byte."""
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F)
        value >>= 7
    out.append(value | 0x80)
    return bytes(out)


def decode(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, place after it)."""
    value = 0
    for k in range(5):
        if at == len(data):
            raise CodecError("truncated")
        payload, last = data[at] & 0x7F, data[at] & 0x80
        at += 1
        if k == 4 and payload > 15:
            raise CodecError("overflow")
        value |= payload << 7 * k
        if last:
            if k and not payload:
                raise CodecError("non_canonical")
            return value, at
    raise CodecError("overflow")


def encode_deltas(values: Iterable[int]) -> bytes:
    """Of strictly rising positive numbers."""
    out, previous = b"", 0
    for value in values:
        if value <= previous:
            raise CodecError("invalid_order")
        out += encode(value - previous)
        previous = value
    return out


def decode_deltas(data: bytes, count: int, most: int = MOST) -> list[int]:
    if count > most:
        raise CodecError("resource_limit")
    out, at, previous = [], 0, 0
    for _ in range(count):
        delta, at = decode(data, at)
        if delta == 0 or delta > MOST - previous:
            raise CodecError("invalid_order")
        previous += delta
        out.append(previous)
    if at != len(data):
        raise CodecError("non_canonical")
    return out


def encoded_positions(positions: Column) -> Column:
    """Positions (from 0) of a posting as variable-byte deltas, for reports of size."""

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else encode_deltas(x + 1 for x in v) for v in values.to_pylist()], pa.binary())

    return run(positions)


def decoded_positions(data: Column, count: Column) -> Column:
    """The positions of ``encoded_positions``; a CodecError fails the query."""

    @F.arrow_udf("array<int>")
    def run(values: pa.Array, counts: pa.Array) -> pa.Array:
        rows = zip(values.to_pylist(), counts.to_pylist())
        return pa.array([None if v is None else [x - 1 for x in decode_deltas(v, n)] for v, n in rows], pa.list_(pa.int32()))

    return run(data, count)


def fnv1a64(data: bytes) -> int:
    value = 0xCBF29CE484222325
    for byte in data:
        value = (value ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return value


def shard_of(doc_id: Column | str, shards: int) -> Column:
    """The stable shard of an id, from 0: ``fnv1a64`` of its bytes, in two halves of 32 bits so that no product overflows."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    low32 = F.lit(0xFFFFFFFF)
    digits = F.hex(F.encode(doc_id, "UTF-8"))
    codes = F.transform(F.filter(F.split(F.regexp_replace(digits, "(..)", "$1 "), " "), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))

    def step(h: Column, byte: Column) -> Column:
        low = h["low"].bitwiseXOR(byte)
        product = low * 0x1B3  # the prime is 2^40 + 0x1B3
        high = h["high"] * 0x1B3 + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(low32).alias("high"), product.bitwiseAND(low32).alias("low"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))
    return F.aggregate(codes, start, step, lambda h: (h["high"] % shards * (2**32 % shards) + h["low"]) % shards)
