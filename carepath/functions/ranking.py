"""Newest-n-per-key with a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Up to this n one partial limit per task keeps the final group small enough
# (n rows per task for a hot key); above it, hot keys are first cut in slices.
SINGLE_STAGE_N = 64
SLICES = 32
# The largest n that Spark still limits below the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
PARTIAL_LIMIT_N = 1000


def total_order(date_col: str, columns: Sequence[str]) -> list[Column]:
    """Newest first, then claim id, then every other column; NULLs last throughout.

    Ordering by every output column makes a cut at n well defined: rows that
    still tie are equal in all columns and so interchangeable.
    """
    rest = [c for c in columns if c != date_col]
    if "claim_id" in rest:
        rest.remove("claim_id")
        rest.insert(0, "claim_id")
    return [F.col(date_col).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in rest]]


def leading(schema: T.StructType, last: str) -> list[str]:
    """The date, the claim id and the columns up to ``last``, as ``total_order`` compares them.

    Rows that tie on these are equal in all of them: for what is returned out of them, the newest row by
    their order is the newest by the total order.
    """
    names = schema.fieldNames()
    return [c for c in names if c in ("date_service", "claim_id") or names.index(c) <= names.index(last)]


def newest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank_col: str | None = None,
    single_stage_n: int = SINGLE_STAGE_N,
) -> DataFrame:
    """The first ``n`` rows per key in ``order``.

    ``row_number() <= n`` lets Spark place a WindowGroupLimit below the shuffle,
    so a task sends at most n rows per key however many it read.  For a large n a
    hot key would still bring n rows from every task to one reducer, so its rows
    are first reduced in SLICES slices that run in parallel; the second stage then
    sees at most n * SLICES rows per key.  Both stages are exact.  The slices cost a
    second shuffle of all rows: a caller that can stand n rows per task of one key in
    one group raises ``single_stage_n``, to PARTIAL_LIMIT_N at most.
    """
    if n < 1:
        raise ValueError(f"n must be at least 1, got {n}")
    rank = rank_col or "_rank"
    if n > min(single_stage_n, PARTIAL_LIMIT_N):
        df = df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(SLICES)))
        sliced = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = (
            df.withColumn("_r", F.row_number().over(sliced))
            .where(F.col("_r") <= n)
            .drop("_r", "_slice")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)
    return out if rank_col else out.drop(rank)


def smallest_distinct(df: DataFrame, keys: Sequence[str], by: str, n: int) -> DataFrame:
    """The rows of each key's ``n`` smallest distinct values of ``by``, nulls left out; equal values all stay.

    ``dense_rank() <= n`` is limited below the shuffle as ``row_number()`` is.
    """
    if n < 1:
        raise ValueError(f"n must be at least 1, got {n}")
    window = Window.partitionBy(*keys).orderBy(by)
    return df.where(F.col(by).isNotNull()).withColumn("_rank", F.dense_rank().over(window)).where(F.col("_rank") <= n).drop("_rank")
