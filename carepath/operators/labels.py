"""Human labels: assignment, validation, summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rating options, the longest fact, the two label schemas.
RATINGS = ("Poor", "Fair", "Good", "Excellent")
MAX_FACT_CHARS = 1000
LABEL_SCHEMAS = ("expected_facts", "response_quality")


def label_assign(items: DataFrame, users: Sequence[str], schemas: Sequence[str] = LABEL_SCHEMAS) -> DataFrame:
    """Every user gets every item once per label schema: two explodes of short lists, no join."""
    def listed(values: Sequence[str]):
        return F.explode(F.array(*[F.lit(v) for v in values]))

    return (
        items.select("item_id", listed(users).alias("user_name"))
        .select("item_id", "user_name", listed(schemas).alias("label_schema"))
    )


def label_check(labels: DataFrame) -> DataFrame:
    """labels (item_id, rating, expected_facts) with ``reason``: NULL where the label is valid."""
    long_fact = F.exists("expected_facts", lambda f: F.length(f) > MAX_FACT_CHARS)
    reason = (
        F.when(F.col("rating").isNotNull() & ~F.col("rating").isin(*RATINGS), "unknown rating")
        .when(F.coalesce(long_fact, F.lit(False)), "fact too long")
        .when(F.col("rating").isNull() & F.col("expected_facts").isNull(), "empty label")
    )
    return labels.withColumn("reason", reason)


def label_validate(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid labels, rejected labels with reason)."""
    checked = label_check(labels)
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def label_summary(labels: DataFrame) -> DataFrame:
    """How often each rating was given per item, and the number of ratings."""
    return labels.groupBy("item_id").agg(
        *[F.count(F.when(F.col("rating") == r, 1)).alias(r.lower()) for r in RATINGS],
        F.count("rating").alias("n_ratings"),
    )
