"""Running totals per key in two steps, so that no key has to fit into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carepath.session import stored


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """``df`` with, for each of ``totals``, the sum over the key's rows before the row (0 for the first).

    Rows are dealt out by ranges of key and order, so a key with a third of all rows is spread over many tasks.
    Each slice is summed by itself; the slices' sums, one row per key and slice, give every slice its offset,
    which is joined back on key and slice.  ``order`` is ascending with nulls first and should be total within a
    key: rows that tie follow each other in any order, which the written slices then fix.  The slices are read
    three times and hold all columns of ``df``, so give keys and numbers, not texts.
    """
    dealt = stored(
        df.withColumns({f"_add_{name}": value.cast("bigint") for name, value in totals.items()})
        .repartitionByRange(*keys, *order)
        .withColumn("_slice", F.spark_partition_id()),
        "slices",
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    offsets = (
        dealt.groupBy(*keys, "_slice")
        .agg(*[F.sum(f"_add_{name}").alias(f"_sum_{name}") for name in totals])
        .select(
            *[F.col(k).alias(f"_of_{k}") for k in keys],
            F.col("_slice").alias("_of_slice"),
            *[F.coalesce(F.sum(f"_sum_{name}").over(before), zero).alias(f"_off_{name}") for name in totals],
        )
    )
    local = dealt.select(
        *df.columns, "_slice", *[F.coalesce(F.sum(f"_add_{name}").over(inside), zero).alias(f"_in_{name}") for name in totals]
    )
    same = F.col("_slice") == F.col("_of_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return local.join(offsets, same).select(
        *df.columns, *[(F.col(f"_in_{name}") + F.col(f"_off_{name}")).alias(name) for name in totals]
    )

