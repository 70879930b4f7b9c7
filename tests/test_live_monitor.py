"""Live scorer configuration and trends that close their windows."""

import datetime

from conftest import rows

from carepath.session import new_folder
from carepath.streaming import config, monitor

T0 = datetime.datetime(2024, 1, 1, 12)
LOG = "name string, action string, scorer string, sample_rate double, filter_string string, registered_at timestamp, seq long"
TRACE = "trace_id string, ts timestamp, state string, request string, response string, context array<string>"


class Feed:
    def __init__(self, spark, label):
        self.spark, self.root = spark, new_folder(spark, label)

    def arrive(self, *traces):
        data = [(i, T0 + datetime.timedelta(hours=h), s, "q", "fine", ["c"]) for i, h, s in traces]
        self.spark.createDataFrame(data, TRACE).coalesce(1).write.mode("append").parquet(f"{self.root}/in")

    def register(self, *entries):
        data = [(n, a, k, r, f, T0, seq) for seq, (n, a, k, r, f) in entries]
        self.spark.createDataFrame(data, LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def stream(self):
        return self.spark.readStream.schema(TRACE).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/in")

    def live(self):
        return monitor.start_live(
            self.stream(), lambda spark: spark.read.schema(LOG).parquet(f"{self.root}/log"), f"{self.root}/out",
            f"{self.root}/cp", {"availableNow": True},
        )


def ten(first):
    return [(str(i), i, "OK" if i % 2 else "ERROR") for i in range(first, first + 10)]


def test_a_change_takes_effect_with_the_next_batch_of_a_running_stream(spark):
    feed = Feed(spark, "live")
    feed.arrive(*ten(0))
    feed.register((1, ("a", "register", "safety", 0.5, None)))
    running = monitor.start_live(
        feed.stream(), lambda s: s.read.schema(LOG).parquet(f"{feed.root}/log"), f"{feed.root}/out", f"{feed.root}/cp",
        {"processingTime": "0 seconds"},
    )
    try:
        running.processAllAvailable()
        feed.register((2, ("a", "update", "safety", 1.0, "state = 'OK'")), (3, ("b", "register", "no_pii", 1.0, None)))
        feed.arrive(*ten(10))
        running.processAllAvailable()
    finally:
        running.stop()
    frame = lambda first: spark.createDataFrame(
        [(i, T0 + datetime.timedelta(hours=h), s, "q", "fine", ["c"]) for i, h, s in ten(first)], TRACE
    )
    want = monitor.score_versioned(frame(0), [config.MonitorScorer("a", "safety", 0.5)]).union(
        monitor.score_versioned(
            frame(10), [config.MonitorScorer("a", "safety", 1.0, "state = 'OK'", 2), config.MonitorScorer("b", "no_pii", 1.0)]
        )
    )
    columns = ["trace_id", "scorer", "config_version", "value", "rationale"]
    got = monitor.read_live(spark, f"{feed.root}/out")
    assert rows(got.select(columns)) == rows(want.select(columns))
    assert {(r.batch, r.scorer, r.config_version) for r in got.collect()} == {(0, "a", 1), (1, "a", 2), (1, "b", 1)}


def test_entries_with_faults_are_left_out_and_named(spark):
    feed = Feed(spark, "faults")
    feed.arrive(*ten(0))
    feed.register(
        (1, ("good", "register", "safety", 1.0, None)), (2, ("column", "register", "safety", 1.0, "stat = 'OK'")),
        (3, ("call", "register", "safety", 1.0, "upper(state) = 'OK'")), (4, ("kind", "register", "charm", 1.0, None)),
        (5, ("rate", "register", "safety", 2.0, None)),
    )
    feed.live().awaitTermination()
    assert {r.scorer for r in monitor.read_live(spark, f"{feed.root}/out").collect()} == {"good"}
    problems = {r.name: r.problem for r in monitor.live_config(spark, f"{feed.root}/out").collect()}
    assert problems["good"] is None and "'stat'" in problems["column"] and "'upper'" in problems["call"]
    assert "charm" in problems["kind"] and "2.0" in problems["rate"]


def test_a_batch_run_again_uses_the_configuration_it_had(spark):
    feed = Feed(spark, "again")
    feed.arrive(*ten(0))
    feed.register((1, ("a", "register", "safety", 1.0, None)))
    # the configuration of batch 0 was kept, then the job was lost and the log moved on
    kept = spark.createDataFrame([("a", "safety", 1.0, None, 1, None)], monitor.BATCH_CONFIG)
    kept.write.parquet(f"{feed.root}/out/config/batch=0")
    feed.register((2, ("a", "update", "safety", 0.0, None)))
    feed.live().awaitTermination()
    assert monitor.read_live(spark, f"{feed.root}/out").where("config_version = 1").count() == 10


def test_no_registered_scorer_gives_no_score(spark):
    feed = Feed(spark, "none")
    feed.arrive(*ten(0))
    feed.register((1, ("a", "update", "safety", 1.0, None)))
    feed.live().awaitTermination()
    assert monitor.read_live(spark, f"{feed.root}/out").count() == 0


def test_closed_trend_over_restarts_with_late_rows(spark):
    feed = Feed(spark, "closed")
    late = 0
    for traces in (
        [("1", 0, "OK"), ("2", 1, "ERROR")],  # 1 January
        [("3", 36, "OK")],  # 3 January: the first day closes
        [("4", 2, "ERROR"), ("5", 37, "ERROR"), ("6", 100, "OK")],  # trace 4 is four days late
    ):
        feed.arrive(*traces)
        trend = monitor.error_rate_trend(feed.stream(), watermark="1 hour")
        query = monitor.start_append(trend, f"{feed.root}/out", f"{feed.root}/cp", {"availableNow": True})
        query.awaitTermination()
        late += monitor.dropped_late(query)
    got = spark.read.schema(trend.schema).parquet(f"{feed.root}/out").orderBy("window_start").collect()
    assert [(r.window_start.day, r.n_traces, r.n_errors) for r in got] == [(1, 2, 1), (3, 2, 1)]
    assert late == 1


def test_a_batch_of_one_file_is_scored_in_many_tasks(spark):
    feed = Feed(spark, "dealt")
    feed.arrive(*[(str(i), 1, "OK") for i in range(400)])
    feed.register((1, ("a", "register", "safety", 1.0, None)))
    feed.live().awaitTermination()
    scores = spark.read.parquet(f"{feed.root}/out/scores")
    assert scores.count() == 400 and len(scores.inputFiles()) > 1
