"""Joins that first look at the bytes of a side, and filters of bounded size that sift rows before they move."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast up to this many bytes.
MAX_BROADCAST_BYTES = 16_000_000
#: Bits that a filter has for every key, and at most: 32 MB.
BITS_PER_KEY, MAX_BITS = 32, 1 << 28
_CHUNK = 1 << 15


def few_bytes(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether the rows take ``max_bytes`` at most: 16 bytes for every column, and what strings, binaries and arrays hold."""
    size = F.lit(16 * len(df.columns)).cast("long")
    for f in df.schema:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            size = size + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            size = size + 8 * F.greatest(F.size(f"`{f.name}`"), F.lit(0))
        elif not isinstance(f.dataType, T.NumericType | T.BooleanType | T.DateType | T.TimestampType):
            raise TypeError(f"{f.name} has no size")
    return (df.agg(F.sum(size)).first()[0] or 0) <= max_bytes


def sifted(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` may occur in the written table ``keys``, and all that do, before they are shuffled; nothing moves but a bitmap.

    Hashes of the keys are bits of a bitmap that grows with their number up to ``MAX_BITS`` and is broadcast.
    """
    bits = min(MAX_BITS, max(_CHUNK, 1 << math.ceil(math.log2(max(keys.count(), 1) * BITS_PER_KEY))))
    place = (F.lit(1) + F.pmod(F.xxhash64(column), F.lit(bits))).cast("long")
    made = keys.select(place.alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    asked = rows.withColumn("_bucket", F.bitmap_bucket_number(place)).withColumn("_at", F.bitmap_bit_position(place))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("long")
    return asked.join(F.broadcast(made), "_bucket").where(F.getbit(byte, F.expr("cast(_at % 8 as int)")) == 1).drop("_bucket", "_at", "_bits")


def fetched(rows: DataFrame, other: DataFrame, column: str, few: bool | None = None) -> DataFrame:
    """``rows`` joined with a written table by one column; broadcast if its bytes are few (checked here, if not before), else ``rows`` are sifted before both are shuffled."""
    if few_bytes(other) if few is None else few:
        return rows.join(F.broadcast(other), column)
    return sifted(rows, other, column).join(other.hint("shuffle_merge"), column)


def mapped_of(rows: DataFrame, keys: DataFrame, column: str, mapped: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``mapped(rows)``, which makes small rows with the key ``name``, for rows whose ``column`` occurs in the written table ``keys``.

    Large rows are never shuffled: few keys are broadcast, many sift them, and what passes wrongly goes after the mapping.
    """
    own = keys.select(F.col(column))
    if few_bytes(own):
        return mapped(rows.join(F.broadcast(own), column, "left_semi"))
    return mapped(sifted(rows, own, column)).join(own.select(F.col(column).alias(name)).hint("shuffle_merge"), name, "left_semi")


def key_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """A filter over a column of well mixed 64-bit hashes: bytes of bits, two bits a key.

    Its bits are made by aggregation and grow with the number of keys up to ``MAX_BITS``; beyond that more keys pass
    than should, none that belongs is held back. Only these bits come to the driver.
    """
    n = hashes.count()
    bits = min(MAX_BITS, max(_CHUNK, 1 << math.ceil(math.log2(max(n, 1) * BITS_PER_KEY))))
    h = F.col(column)
    both = hashes.select(F.explode(F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 29).bitwiseAND(F.lit(bits - 1)))).alias("p"))
    place = (F.col("p") + 1).cast("long")
    rows = both.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * _CHUNK // 8
        out[at : at + _CHUNK // 8] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (64 bits, unsigned) may be keys of the filter."""
    mask = np.uint64(8 * len(bits) - 1)
    out = np.ones(len(hashes), dtype=bool)
    for p in (hashes & mask, (hashes >> np.uint64(29)) & mask):
        out &= (bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out
