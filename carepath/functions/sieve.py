"""A Bloom filter with one hash, in built-in functions: rows that no wanted key can meet go before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bits of the filter: 2^25 are at most 2^19 words of 64 bits, some 20 MB when broadcast, whatever the number of keys.
# 3.6 million keys leave a tenth of the other rows in; above some 30 million it no longer cuts much, and costs little.
BITS = 25


def _place(keys: Sequence[str], kinds: Sequence[T.DataType], bits: int) -> Column:
    # both sides in the type that the rows have, then as text: equal keys have one hash
    values = [F.col(k).cast(kind).cast("string") for k, kind in zip(keys, kinds, strict=True)]
    return F.pmod(F.xxhash64(*values), F.lit(1 << bits))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))


def likely(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], bits: int = BITS) -> DataFrame:
    """``rows`` without those whose ``keys`` are surely not in ``wanted``; an exact join has to follow.

    Keys are compared by a hash of their text, so a row may stay without a wanted key and never goes with one.
    """
    return _sieved(rows, wanted, keys, bits, "left_semi")


def unlikely(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], bits: int = BITS) -> DataFrame:
    """The other rows: those that ``likely`` leaves out."""
    return _sieved(rows, wanted, keys, bits, "left_anti")


def named_filters(wanted: DataFrame, kind: str, text: str, name: str, names: Sequence[str]) -> DataFrame:
    """Filters of the texts wanted by each of ``names``, for each kind of text: (kind, _word, and the bits for every name)."""
    place = F.pmod(F.xxhash64(text), F.lit(1 << BITS))
    places = wanted.where(F.col(text).isNotNull()).select(kind, name, place.alias("_p"))
    bits = [F.bit_or(F.when(F.col(name) == n, _bit(F.col("_p")))).alias(n) for n in names]
    return places.groupBy(kind, F.floor(F.col("_p") / 64).alias("_word")).agg(*bits)


def marked(rows: DataFrame, filters: DataFrame, text: Column, names: Sequence[str], mark: str) -> DataFrame:
    """All ``rows``, with the array ``mark`` of the names that may want their ``text``: never short of one that does.

    ``filters`` is what ``named_filters`` has for one kind of text.
    """
    words = filters.select(F.col("_word").alias("_w"), *[F.col(n).alias(f"_bits_{n}") for n in names])
    met = rows.withColumn("_p", F.when(text.isNotNull(), F.pmod(F.xxhash64(text), F.lit(1 << BITS))))
    met = met.join(F.broadcast(words), F.floor(F.col("_p") / 64) == F.col("_w"), "left")
    found = [F.when(F.col(f"_bits_{n}").bitwiseAND(_bit(F.col("_p"))) != 0, F.lit(n)) for n in names]
    return met.select(*rows.columns, F.array_compact(F.array(*found)).alias(mark))


def _sieved(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], bits: int, how: str) -> DataFrame:
    kinds = [rows.schema[k].dataType for k in keys]
    words = wanted.select(_place(keys, kinds, bits).alias("_p")).groupBy(F.floor(F.col("_p") / 64).alias("_word")).agg(
        F.bit_or(_bit(F.col("_p"))).alias("_bits")
    )
    place = _place(keys, kinds, bits)
    met = rows.withColumn("_p", place).join(
        F.broadcast(words), (F.floor(F.col("_p") / 64) == F.col("_word")) & (F.col("_bits").bitwiseAND(_bit(F.col("_p"))) != 0), how
    )
    return met.drop("_p")
