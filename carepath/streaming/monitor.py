"""Scoring live traffic: sampled, filtered, deduplicated, and its trends.

Late data: rows more than WATERMARK behind the newest event seen are dropped by
the stateful operators (deduplication and append-mode trends); ``dropped_late`` counts them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from carepath.functions.filters import FilterError, check_filter, filter_column
from carepath.functions.sampling import in_sample
from carepath.operators.scorers import SCORERS, Use, evaluate
from carepath.streaming.config import MAX_SCORERS, MonitorScorer, active_scorers, scorer_config

WATERMARK = "1 hour"


def _condition(traces: DataFrame, s: MonitorScorer) -> Column:
    chosen = in_sample(s.name, F.col("trace_id"), s.sample_rate)
    return chosen & filter_column(traces, s.filter_string) if s.filter_string else chosen


def scorer_sample(traces: DataFrame, scorers: Sequence[MonitorScorer], use_filters: bool = False) -> DataFrame:
    """(trace_id, scorer) pairs to be scored.

    The short list of scorers is unfolded inside each trace's row, so there is no
    join with the configuration and nothing to broadcast.
    """
    _check(scorers)
    picks = [
        F.when(_condition(traces, s) if use_filters else in_sample(s.name, F.col("trace_id"), s.sample_rate), F.lit(s.name))
        for s in scorers
    ]
    # an array with NULLs for the scorers not picked, unfolded and then cleared of them:
    # cheaper than array_compact, and no filter that would hash every trace twice
    return (
        traces.select("trace_id", F.array(*picks).alias("p"))
        .select("trace_id", F.explode_outer("p").alias("scorer"))
        .where(F.col("scorer").isNotNull())
    )


def scorer_filter(traces: DataFrame, scorers: Sequence[MonitorScorer]) -> DataFrame:
    """(trace_id, scorer) pairs that pass each scorer's filter string, before sampling."""
    return scorer_sample(traces, [MonitorScorer(s.name, s.scorer, 1.0, s.filter_string) for s in scorers], True)


def _check(scorers: Sequence[MonitorScorer]) -> None:
    if len(scorers) > MAX_SCORERS:
        raise ValueError(f"at most {MAX_SCORERS} scorers, got {len(scorers)}")
    names = [s.name for s in scorers]
    if len(set(names)) != len(names):
        raise ValueError("scorer names must be unique")


def score_traffic(traces: DataFrame, scorers: Sequence[MonitorScorer]) -> DataFrame:
    """Sampled and filtered scores of traces, batch or stream: (trace_id, ts, state, scorer, value, rationale).

    The same row-local projection as an offline evaluation; stateless on a stream.
    """
    _check(scorers)
    return evaluate(traces, [Use(s.name, s.scorer, _condition(traces, s)) for s in scorers], keep=("ts", "state"))


def dedup_traffic(traces: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """At most one row per trace, so at most one score per trace and scorer.

    Done before scoring: the state holds one key per trace within the watermark,
    and copies are not scored.  A trace copied very often is first reduced in each
    input partition's own slice, then once more over the slices.
    """
    marked = traces.withWatermark("ts", watermark)
    sliced = marked.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(64)))
    return (
        sliced.dropDuplicatesWithinWatermark(["trace_id", "_slice"])
        .drop("_slice")
        .dropDuplicatesWithinWatermark(["trace_id"])
    )


def quality_trend(
    scores: DataFrame, window: str = "1 day", slide: str | None = None, watermark: str | None = None
) -> DataFrame:
    """Scores and their mean per scorer and window (tumbling, or sliding with ``slide``).

    With a watermark the trend can be appended: a window is given once, when no row of it can
    come any more, and its state goes.  Rows of closed windows are dropped.
    """
    scores = scores.withWatermark("ts", watermark) if watermark else scores
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    exact = F.col("value").cast("decimal(18,6)")
    return (
        scores.groupBy("scorer", span.alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n_scores"),
            F.count("value").alias("n_values"),
            F.sum(exact).cast("double").alias("_sum"),
        )
        .select(
            "scorer",
            F.col("w.start").alias("window_start"),
            "n_scores",
            F.try_divide("_sum", F.col("n_values").cast("double")).alias("mean_value"),
        )
    )


def error_rate_trend(traces: DataFrame, window: str = "1 day", watermark: str | None = None) -> DataFrame:
    """Traces, those not OK, and their share per window; with a watermark as in ``quality_trend``."""
    traces = traces.withWatermark("ts", watermark) if watermark else traces
    bad = F.count(F.when(F.col("state") != "OK", 1))
    return (
        traces.groupBy(F.window("ts", window).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_traces"), bad.alias("n_errors"))
        .select(
            F.col("w.start").alias("window_start"),
            "n_traces",
            "n_errors",
            (F.col("n_errors").cast("double") / F.col("n_traces").cast("double")).alias("error_rate"),
        )
    )


def start_append(df: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a streaming frame to parquet at ``out``; exactly once, restartable from ``checkpoint``."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


# Versions of a trend that stay readable after newer ones were published.
KEPT_VERSIONS = 8


def start_complete(df: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep a streaming aggregate's whole result: batch n is written to slot n mod KEPT_VERSIONS of ``out``.

    A version counts once it is whole: its number goes to ``out``/published after the write,
    so readers never see part of a trend.  Old slots are overwritten.  For trends, whose
    result is small; writing a version again on a retry gives the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        slot = batch_id % KEPT_VERSIONS
        batch.write.mode("overwrite").parquet(f"{out}/slots/{slot}")
        done = batch.sparkSession.createDataFrame([(batch_id, slot)], "version bigint, slot bigint")
        done.write.mode("append").parquet(f"{out}/published")

    return (
        df.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest version that ``start_complete`` has published."""
    newest = spark.read.parquet(f"{out}/published").agg(F.max(F.struct("version", "slot")).alias("v")).first()["v"]
    return spark.read.parquet(f"{out}/slots/{newest.slot}")


def dropped_late(query: StreamingQuery) -> int:
    """Rows that the stateful operators dropped as late in the recent batches of a query.

    An aggregation drops after its partial step, so there a group of late rows counts as one per task.
    """
    operators = [op for progress in query.recentProgress for op in progress["stateOperators"]]
    return sum(op["numRowsDroppedByWatermark"] for op in operators)


# The configuration a batch was scored with, scorers left out included.
BATCH_CONFIG = (
    "name string, scorer string, sample_rate double, filter_string string, config_version bigint, problem string"
)


def _problem(traces: DataFrame, s: MonitorScorer) -> str | None:
    if s.scorer not in SCORERS:
        return f"unknown scorer {s.scorer!r}"
    if not 0.0 <= s.sample_rate <= 1.0:
        return f"sample rate {s.sample_rate} is not in [0, 1]"
    try:
        if s.filter_string:
            check_filter(traces, s.filter_string)
    except FilterError as error:
        return str(error)
    return None


def score_versioned(traces: DataFrame, scorers: Sequence[MonitorScorer]) -> DataFrame:
    """``score_traffic`` with the configuration version of each score's scorer; no scorers give no rows."""
    none = [MonitorScorer("none", "safety", 0.0)]
    scores = score_traffic(traces, scorers or none)
    versions = F.create_map(*[F.lit(v) for s in scorers or none for v in (s.name, s.version)])
    return scores.withColumn("config_version", F.element_at(versions, F.col("scorer")).cast("long"))


def start_live(
    traces: DataFrame,
    read_log: Callable[[SparkSession], DataFrame],
    out: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score a stream with the scorers registered at each micro-batch, without restarts.

    ``read_log`` gives the registration log; it is read once per batch, so a registration or an update
    takes effect with the next batch.  The at most MAX_SCORERS active entries are first kept under
    ``out``/config/batch=n and then used from there: a batch run again after a failure is scored as
    the first time, and its scores are written over.  An entry with an unknown scorer, a rate out of
    range or a filter string that does not pass is left out, with its problem; the stream goes on.
    """

    def configured(batch: DataFrame, batch_id: int) -> list[MonitorScorer]:
        session = batch.sparkSession
        entries = f"{out}/config/batch={batch_id}"
        path = session._jvm.org.apache.hadoop.fs.Path(f"{entries}/_SUCCESS")
        if not path.getFileSystem(session._jsc.hadoopConfiguration()).exists(path):
            rows = [
                (s.name, s.scorer, s.sample_rate, s.filter_string, s.version, _problem(batch, s))
                for s in active_scorers(scorer_config(read_log(session)))
            ]
            session.createDataFrame(rows, BATCH_CONFIG).coalesce(1).write.mode("overwrite").parquet(entries)
        kept = session.read.schema(BATCH_CONFIG).parquet(entries).where("problem is null").orderBy("name").collect()
        return [MonitorScorer(r.name, r.scorer, r.sample_rate, r.filter_string, r.config_version) for r in kept]

    def write(batch: DataFrame, batch_id: int) -> None:
        # scoring is dear and rows are narrow: dealt out first, however few files a batch has
        dealt = batch.repartition(int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        scores = score_versioned(dealt, configured(batch, batch_id))
        scores.write.mode("overwrite").parquet(f"{out}/scores/batch={batch_id}")

    return (
        traces.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def read_live(spark: SparkSession, out: str) -> DataFrame:
    """The scores written by ``start_live``, with the batch that gave them."""
    return spark.read.parquet(f"{out}/scores")


def live_config(spark: SparkSession, out: str) -> DataFrame:
    """The configuration of every batch: BATCH_CONFIG and batch."""
    return spark.read.schema(BATCH_CONFIG + ", batch bigint").parquet(f"{out}/config")
