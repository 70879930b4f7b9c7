"""Registered scorers as an append-only log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how many scorers may watch one experiment.
MAX_SCORERS = 20


@dataclass(frozen=True)
class MonitorScorer:
    name: str
    scorer: str
    sample_rate: float
    filter_string: str | None = None
    version: int = 1


def _judged(log: DataFrame) -> DataFrame:
    """Log entries with ``problem``: an update before its name exists, or a second registration.

    The first registration of each name is found by one aggregation and joined
    back, so a name with very many entries is not gathered in one task.
    """
    at = F.struct("registered_at", "seq")
    first = log.groupBy("name").agg(F.min(F.when(F.col("action") == "register", at)).alias("first_at"))
    entry = log.join(first, "name").withColumn("_at", at)
    problem = (
        F.when(F.col("first_at").isNull() | (F.col("_at") < F.col("first_at")), "unknown_name").when(
            (F.col("action") == "register") & (F.col("_at") > F.col("first_at")), "duplicate_name"
        )
    )
    return entry.withColumn("problem", problem)


def scorer_config(log: DataFrame) -> DataFrame:
    """The newest accepted version of every registered name.

    ``log``: (name, action, scorer, sample_rate, filter_string, registered_at, seq).
    An update is a new version; older entries stay in the log as they were.  Only
    the MAX_SCORERS names registered first are active.
    """
    ok = _judged(log).where(F.col("problem").isNull())
    newest = ok.groupBy("name").agg(
        F.count(F.lit(1)).alias("version"),
        F.max(F.struct("_at", "scorer", "sample_rate", "filter_string")).alias("v"),
        F.min("first_at").alias("first_at"),
    )
    admitted = newest.orderBy("first_at", "name").limit(MAX_SCORERS).select("name", F.lit(True).alias("active"))
    return newest.join(admitted, "name", "left").select(
        "name",
        "version",
        F.col("v.scorer").alias("scorer"),
        F.col("v.sample_rate").alias("sample_rate"),
        F.col("v.filter_string").alias("filter_string"),
        F.coalesce("active", F.lit(False)).alias("active"),
    )


def scorer_config_errors(log: DataFrame) -> DataFrame:
    """Refused log entries, and registrations beyond MAX_SCORERS names: (name, action, seq, problem)."""
    judged = _judged(log)
    refused = judged.where(F.col("problem").isNotNull()).select("name", "action", "seq", "problem")
    beyond = scorer_config(log).where(~F.col("active")).select("name")
    too_many = judged.where(F.col("problem").isNull() & (F.col("action") == "register")).join(beyond, "name")
    return refused.unionByName(too_many.select("name", "action", "seq", F.lit("too_many_scorers").alias("problem")))


def active_scorers(config: DataFrame) -> list[MonitorScorer]:
    """The active configuration on the driver: at most MAX_SCORERS rows, checked."""
    rows = config.where("active").orderBy("name").limit(MAX_SCORERS + 1).collect()
    if len(rows) > MAX_SCORERS:
        raise ValueError(f"more than {MAX_SCORERS} active scorers")
    return [MonitorScorer(r.name, r.scorer, float(r.sample_rate), r.filter_string, r.version) for r in rows]


def get_scorer(scorers: list[MonitorScorer], name: str) -> MonitorScorer:
    for s in scorers:
        if s.name == name:
            return s
    raise KeyError(f"no scorer registered as {name!r}")
