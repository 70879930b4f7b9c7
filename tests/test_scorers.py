import pytest
from conftest import rows
from pyspark.sql import functions as F

from carepath.operators import scorers, traces

SCHEMA = (
    "trace_id string, request string, response string, expected_facts array<string>, context array<string>, "
    "expected_tools array<string>, called_tools array<string>"
)


def score(spark, scorer, **cols):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple({"trace_id": "t", **cols}.get(n) for n in names)], SCHEMA)
    (row,) = scorers.evaluate(df, [scorer]).collect()
    return row.value


def test_fact_scorers(spark):
    facts = ["2021-12-21", "Office visit", "C-77"]
    assert score(spark, "correctness", response="C 77: OFFICE, a visit", expected_facts=facts) == 2 / 3
    assert score(spark, "correctness", response=None, expected_facts=facts) == 0.0
    assert score(spark, "correctness", response="x", expected_facts=[]) is None
    assert score(spark, "correctness", response="x") is None
    assert score(spark, "guideline_accuracy", response="x") is None
    assert score(spark, "retrieval_sufficiency", context=["on 2021-12-21", "office", "visit"], expected_facts=facts) == 2 / 3
    assert score(spark, "groundedness", response="code Z1 and Z2", context=["z1"]) == 0.5
    assert score(spark, "groundedness", response="nothing stated", context=[]) == 1.0
    assert score(spark, "retrieval_relevance", request="claim c9?", context=["c9 here", "other", None]) == 1 / 3
    assert score(spark, "retrieval_relevance", request="claim c9?", context=[]) is None
    assert score(spark, "relevance", request="Which payer was it?", response="the payer") == 0.5


def test_rules(spark):
    assert score(spark, "safety", response="you IDIOT.") == 0.0
    assert score(spark, "safety", response="all well") == 1.0
    assert score(spark, "safety", response="") is None
    assert score(spark, "guideline_clarity", response="short. and clear.") == 1.0
    assert score(spark, "guideline_clarity", response="word " * 41) == 0.0
    assert score(spark, "guideline_clarity", response="two words. " * 101) == 0.0
    assert score(spark, "guideline_english", response="the claim was paid by the plan") == 1.0
    assert score(spark, "guideline_english", response="der Antrag ist nicht im Plan") == 0.0
    assert score(spark, "no_speculation", request="claim c9?", response="no data on c9", context=[]) == 1.0
    assert score(spark, "no_speculation", request="claim c9?", response="it was on 2021-01-01", context=None) == 0.0
    assert score(spark, "no_speculation", request="claim c9?", response="it was on 2021-01-01", context=["x"]) == 1.0


@pytest.mark.parametrize(
    "text, clean",
    [
        ("mail a.b@example.org now", 0.0), ("a @ b", 1.0), ("ssn 123-45-6789.", 0.0), ("123-45-67890", 1.0),
        ("call (555) 123-4567", 0.0), ("call 555.123.4567", 0.0), ("claim 12390dfb568442cb957d5b3cfefe1119", 1.0),
        ("ndc 65162027250 on 2021-12-21", 1.0),
    ],
)
def test_personal_data(spark, text, clean):
    assert score(spark, "no_pii", response=text) == clean


def test_tool_calls(spark):
    assert score(spark, "tool_precision", expected_tools=["a"], called_tools=["a", "b", "b"]) == 0.5
    assert score(spark, "tool_recall", expected_tools=["a", "c"], called_tools=["a", "b"]) == 0.5
    assert score(spark, "tool_precision", expected_tools=["a"], called_tools=[]) is None


def test_unknown_scorer_is_an_error(spark):
    df = spark.createDataFrame([("t", "x")], "trace_id string, response string")
    with pytest.raises(KeyError):
        scorers.evaluate(df, ["nothing"])


def test_conditions_names_and_kept_columns(spark):
    df = spark.createDataFrame([("1", "idiot", 5), ("2", "fine", 7)], "trace_id string, response string, n int")
    uses = [
        scorers.Use("a", "safety", F.col("n") > 6), scorers.Use("b", "safety"), scorers.Use("c", "no_pii", F.col("n") > 9),
        scorers.Use("d", "no_pii", F.lit(None).cast("boolean")),
    ]
    got = rows(scorers.evaluate(df, uses, keep=["n"]).select("trace_id", "n", "scorer", "value"))
    assert got == [("1", 5, "b", 0.0), ("2", 7, "a", 1.0), ("2", 7, "b", 1.0)]
    assert scorers.evaluate(df, uses[2:]).collect() == []


def test_record_without_response_is_still_scored(spark):
    dataset = spark.createDataFrame(
        [("1", [("user", "q")], ["fact"]), ("2", [("user", "q")], ["fact"])],
        "dataset_record_id string, messages array<struct<role:string,content:string>>, expected_facts array<string>",
    )
    responses = spark.createDataFrame([("1", "a fact", ["fact"])], "dataset_record_id string, response string, context array<string>")
    scores = scorers.evaluate_answers(dataset, responses, ["correctness", "safety"])
    assert rows(scores.select("trace_id", "scorer", "value")) == [
        ("1", "correctness", 1.0), ("1", "safety", 1.0), ("2", "correctness", 0.0), ("2", "safety", None),
    ]
    assert rows(scorers.evaluate_summary(scores)) == [("correctness", 2, 0, 0.5, 0.5), ("safety", 2, 1, 1.0, 1.0)]


def test_scores_are_computed_once(spark):
    """No generator filter below the scores, which would evaluate every list twice."""
    df = spark.range(3).selectExpr("cast(id as string) trace_id", "concat('x ', id) response")
    plan = scorers.evaluate(df, ["safety", "guideline_english"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan and plan.count("regexp_extract_all") == 1


def test_trace_assessments(spark):
    data = [
        ("none", '{"request_preview":"q"}'), ("empty", '{"info":{"assessments":[]}}'),
        ("false", '{"info":{"assessments":[{"assessment_name":"a","feedback":{"value":false},"rationale":"why"}]}}'),
        ("zero", '{"info":{"assessments":[{"assessment_name":"a","feedback":{"value":0}}]}}'),
        ("expect", '{"info":{"assessments":[{"assessment_name":"a","rationale":"","expectation":{"serialized_value":{"value":"v"}}}]}}'),
        ("broken", "{oops"), ("null", None),
    ]
    df = spark.createDataFrame([(i, "OK", t) for i, t in data], "trace_id string, state string, trace string")
    parsed = traces.trace_parse(df)
    assert rows(traces.trace_assessments(parsed).select("trace_id", "feedback", "rationale")) == [
        ("expect", None, "v"), ("false", "false", "why"), ("zero", "0", None),
    ]
    counts = {r.trace_id: r.n_assessments for r in traces.trace_summary(parsed).collect()}
    assert counts == {"none": 0, "empty": 0, "false": 1, "zero": 1, "expect": 1, "broken": 0, "null": 0}
