import datetime

import pytest
from conftest import rows

from carepath.operators import retrieval
from carepath.session import new_folder
from carepath.sources import standins
from carepath.streaming import config, monitor

T0 = datetime.datetime(2024, 1, 1, 12)
LOG = "name string, action string, scorer string, sample_rate double, filter_string string, registered_at timestamp, seq long"
TRACE = "trace_id string, ts timestamp, state string, request string, response string, context array<string>"


def entry(name, action, seq, rate=0.5):
    return (name, action, "safety", rate, None, T0 + datetime.timedelta(minutes=seq), seq)


def test_config_versions_and_errors(spark):
    log = spark.createDataFrame(
        [
            entry("safety_check", "register", 1, 0.5), entry("safety_check", "update", 2, 0.8),
            entry("safety_monitor", "update", 3), entry("safety_check", "register", 4, 0.1),
            entry("late", "update", 5), entry("late", "register", 6, 0.3),
        ],
        LOG,
    )
    assert rows(config.scorer_config(log).select("name", "version", "sample_rate", "active")) == [
        ("late", 1, 0.3, True), ("safety_check", 2, 0.8, True),
    ]
    assert rows(config.scorer_config_errors(log).select("seq", "problem")) == [
        (3, "unknown_name"), (4, "duplicate_name"), (5, "unknown_name"),
    ]
    active = config.active_scorers(config.scorer_config(log))
    assert config.get_scorer(active, "safety_check").sample_rate == 0.8
    with pytest.raises(KeyError):
        config.get_scorer(active, "safety_monitor")


def test_at_most_twenty_active_scorers(spark):
    log = spark.createDataFrame([entry(f"s{i:02d}", "register", i) for i in range(21)], LOG)
    got = {r.name: r.active for r in config.scorer_config(log).collect()}
    assert len(got) == 21 and [n for n, on in got.items() if not on] == ["s20"]
    assert rows(config.scorer_config_errors(log)) == [("s20", "register", 20, "too_many_scorers")]
    assert len(config.active_scorers(config.scorer_config(log))) == 20
    many = [config.MonitorScorer(f"s{i}", "safety", 1.0) for i in range(21)]
    with pytest.raises(ValueError):
        monitor.scorer_sample(spark.createDataFrame([("1",)], "trace_id string"), many)


def test_raising_the_rate_keeps_the_sample(spark):
    traces = spark.range(2000).selectExpr("cast(id as string) trace_id")
    picked = {
        rate: {r.trace_id for r in monitor.scorer_sample(traces, [config.MonitorScorer("s", "safety", rate)]).collect()}
        for rate in (0.0, 0.5, 0.8, 1.0)
    }
    assert picked[0.0] == set() and picked[0.5] < picked[0.8] < picked[1.0] and len(picked[1.0]) == 2000
    assert 0.45 < len(picked[0.5]) / 2000 < 0.55
    with pytest.raises(ValueError):
        monitor.scorer_sample(traces, [config.MonitorScorer("s", "safety", 1.5)])


def test_stream_scores_equal_batch_scores(spark, sf_dir):
    t = standins.TestTables(spark, sf_dir)
    uses = [
        config.MonitorScorer("a", "safety", 0.5), config.MonitorScorer("b", "safety", 1.0, "state = 'ERROR'"),
        config.MonitorScorer("c", "groundedness", 0.7, "value > 20"),
    ]
    batch = monitor.score_traffic(standins.traces_of(t.events), uses)
    stream = monitor.score_traffic(standins.traces_of(t.stream("events", maxFilesPerTrigger="1")), uses)
    root = new_folder(spark, "stream")
    for _ in range(2):  # a second run from the same checkpoint adds nothing
        monitor.start_append(stream, f"{root}/out", f"{root}/cp", {"availableNow": True}).awaitTermination()
    assert rows(spark.read.schema(stream.schema).parquet(f"{root}/out")) == rows(batch)


def test_dedup_over_files_and_late_rows(spark):
    root = new_folder(spark, "files")

    def arrive(*traces):
        data = [(i, T0 + datetime.timedelta(minutes=m), "OK", "q", "fine", ["c"]) for i, m in traces]
        spark.createDataFrame(data, TRACE).coalesce(1).write.mode("append").parquet(f"{root}/in")

    late = ("5", 121)  # two hours late
    for traces in ([("1", 0), ("2", 1), ("1", 0)], [*[("3", 240)] * 50, ("4", 241)], [late, ("3", 242), ("6", 243)]):
        arrive(*traces)
        stream = spark.readStream.schema(TRACE).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        scores = monitor.score_traffic(monitor.dedup_traffic(stream), [config.MonitorScorer("s", "safety", 1.0)])
        monitor.start_append(scores, f"{root}/out", f"{root}/cp", {"availableNow": True}).awaitTermination()
    got = [r.trace_id for r in spark.read.schema(scores.schema).parquet(f"{root}/out").collect()]
    assert sorted(got) == ["1", "2", "3", "4", "6"]


def test_complete_trend_keeps_the_newest_version(spark):
    root = new_folder(spark, "trend")
    for i in range(3):
        data = [(str(i), T0 + datetime.timedelta(days=i), "ERROR" if i else "OK", "q", "fine", ["c"])]
        spark.createDataFrame(data, TRACE).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(TRACE).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    trend = monitor.error_rate_trend(stream)
    monitor.start_complete(trend, f"{root}/out", f"{root}/cp", {"availableNow": True}).awaitTermination()
    got = monitor.read_latest(spark, f"{root}/out").orderBy("window_start").collect()
    assert [(r.n_traces, r.error_rate) for r in got] == [(1, 0.0), (1, 1.0), (1, 1.0)]
    # a version that is not published yet is not read
    spark.createDataFrame([], got_schema(spark, root)).write.mode("overwrite").parquet(f"{root}/out/slots/7")
    assert monitor.read_latest(spark, f"{root}/out").count() == 3


def got_schema(spark, root):
    return monitor.read_latest(spark, f"{root}/out").schema


def test_vector_topk_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 8))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    corpus = corpus.union(spark.createDataFrame([(999, None)], corpus.schema)).repartition(5)
    queries = spark.createDataFrame([(q, vectors[q].tolist()) for q in (3, 7)], "query_id long, embedding array<float>")
    got = retrieval.vector_topk(corpus, queries, 4).orderBy("query_id", "rank").collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = [(q, int(i)) for q in (3, 7) for i in np.argsort(-(unit @ unit[q]))[:4]]
    assert [(r.query_id, r.vec_id) for r in got] == want
    assert retrieval.vector_topk(corpus, queries.where("query_id < 0"), 4).collect() == []
