import pytest
from conftest import day, plan_of, rows
from pyspark.sql import functions as F

from carepath.functions.text import long_id, short_id
from carepath.operators import routing
from carepath.sources import traces as trace_sources
from test_timeline import claims_of, diag, fill

P, C = "4baf3314e4a181c5effcf2751fbe1e21", "12390dfb568442cb957d5b3cfefe1119"
DATE = day("2021-12-21")


@pytest.mark.parametrize(
    "question, action, tool",
    [
        (f"Anything under the claim id {C}?", "call", "claim_lookup"),
        (f"medical journey for patient: {P}", "call", "patient_journey"),
        (f"List claims of the patient {P}", "call", "patient_claims"),
        ("Show claims with ndc_code: 65162027250", "call", "claims_by_ndc"),
        ("Show claims with diagnosis_code: Z79899", "call", "claims_by_diagnosis"),
        (f'Information for patient_id: {P} on service_date: "2021-12-21"', "call", "journey_on_date"),
        (f"medical claims of patient {P} on 2021-12-21", "call", "get_medical_claims"),
        (f"enrollment of patient {P}", "call", "get_patient_enrollment"),
        (f"diagnosis codes of patient {P}", "call", "get_patient_diagnoses"),
        (f"latest medication of patient {P}, and its diagnosis code", "call", "latest_medication_diagnosis"),
        (f"medications prescribed to patient {P}", "call", "get_pharmacy_claims"),
        (f"procedures of patient {P}", "call", "get_patient_procedures"),
        (f"how is patient {P}?", "ask", None),
        ("what about the diagnosis?", "ask", None),
        ("which claims on 2021-99-99", "ask", None),
        ("who won the match?", "decline", None),
        (None, "decline", None),
    ],
)
def test_routes(spark, question, action, tool):
    df = spark.createDataFrame([("r", question)], "request_id string, question string")
    (row,) = routing.question_route(df).collect()
    assert (row.action, row.tool) == (action, tool)


def test_dispatch(spark):
    c = claims_of(
        spark,
        enrollment=[("a", "F", "1980", "1", "NY", DATE, None, "m", "x")],
        medical_claim=[("c1", "a", DATE, None, "er", "x"), ("c2", "a", day("2020-01-01"), None, "er", "x")],
        diagnosis=[diag(f"d{i:02d}", "a", "2021-01-01", "Z1") for i in range(60)],
        pharmacy_claim=[fill("r1", "b", "2021-01-01")],
    )
    requests = spark.createDataFrame(
        [
            ("1", "get_patient_enrollment", "a", None), ("2", "get_patient_diagnoses", "a", None),
            ("3", "get_patient_diagnoses", "a", None), ("4", "get_medical_claims", "a", DATE),
            ("5", "get_medical_claims", "a", None), ("6", "fly_to_moon", "a", None), ("7", None, "a", None),
            ("8", "get_pharmacy_claims", None, None), ("9", "get_pharmacy_claims", "nobody", None),
            ("10", "get_pharmacy_claims", "b", None),
        ],
        "request_id string, tool string, patient_id string, service_date date",
    )
    got = routing.tool_dispatch(requests, c).collect()
    by = {}
    for r in got:
        by.setdefault(r.request_id, []).append(r)
    errors = {k: v[0].result for k, v in by.items() if v[0].status == "error"}
    assert errors == {
        "5": '{"error":"missing service_date"}', "6": '{"error":"unknown tool"}',
        "7": '{"error":"unknown tool"}', "8": '{"error":"missing patient_id"}',
    }
    assert len(by["1"]) == 1 and len(by["4"]) == 1 and by["4"][0].claim_id == "c1"
    assert [(r.status, r.result) for r in by["9"]] == [("empty", None)]
    for k in ("2", "3"):
        assert sorted(r.row_no for r in by[k]) == list(range(1, 51))
    assert '"ndc":"1"' in by["10"][0].result


def test_traffic_is_numbered_from_one_and_skips_missing_keys(spark):
    keys = spark.createDataFrame(
        [(P, C, DATE, "65162027250", "Z79899"), ("b" * 32, C, DATE, None, "Z1")],
        "patient_id string, claim_id string, service_date date, ndc string, diagnosis_code string",
    )
    got = trace_sources.traffic_source(keys)
    assert [r.question_no for r in got.where(got.patient_id == P).orderBy("question_no").collect()] == list(range(1, 13))
    assert [r.question_no for r in got.where(got.patient_id != P).orderBy("question_no").collect()] == list(range(2, 13))


def test_every_route_asks_for_its_tool_and_passes_columns(spark):
    keys = spark.createDataFrame(
        [(P, C, DATE, "65162027250", "Z79899")],
        "patient_id string, claim_id string, service_date date, ndc string, diagnosis_code string",
    )
    asked = trace_sources.traffic_source(keys).selectExpr("string(question_no) request_id", "question", "question_no as mine")
    got = sorted((r.mine, r.tool) for r in routing.question_route(asked).collect())
    assert [tool for _, tool in got] == [tool for tool, _, _ in trace_sources.ROUTES] and set(routing.ARGUMENTS) == {t for _, t in got}


def test_dispatch_reads_each_claim_table_once_before_the_tools_run(spark, tmp_path):
    from carepath.sources.claims import read_claims, write_claims

    made = claims_of(
        spark,
        enrollment=[("a", "F", "1980", "1", "NY", DATE, None, "m", "x")],
        medical_claim=[("c1", "a", DATE, None, "er", "x"), ("c2", "b", DATE, None, "er", "x")],
        diagnosis=[diag("c1", "a", "2021-01-01", "Z1"), diag("c2", "b", "2021-01-01", "Z1")],
        pharmacy_claim=[fill("c1", "a", "2021-01-01")],
    )
    write_claims(made, str(tmp_path / "claims"))
    asked = [(f"{k}-{tool}", tool, "a", DATE, "c1", "1", "Z1") for k in range(2) for tool in routing.ARGUMENTS]
    requests = spark.createDataFrame(
        asked, "request_id string, tool string, patient_id string, service_date date, claim_id string, ndc string, diagnosis_code string"
    )
    stored = read_claims(spark, str(tmp_path / "claims"))
    answers = routing.tool_dispatch(requests, stored)
    assert not any(str(tmp_path) in f for f in answers.inputFiles())
    assert {r.request_id for r in answers.collect()} == {r[0] for r in asked}
    found = routing.wanted_rows(requests.selectExpr("request_id call_id", *requests.columns[1:]), stored)
    assert sorted((r.claim_id, r._tools) for r in found.diagnosis.collect())[1] == ("c2", ["claims_by_diagnosis"])
    assert len(set(found.diagnosis.where("claim_id = 'c1'").first()._tools)) == 6


def test_claim_rows_are_marked_without_a_shuffle_and_answers_move_once(spark, tmp_path, monkeypatch):
    from carepath.sources.claims import read_claims, write_claims

    made = claims_of(
        spark,
        enrollment=[("a", "F", "1980", "1", "NY", DATE, None, "m", "x")],
        medical_claim=[("c1", "a", DATE, None, "er", "x"), ("c2", "b", DATE, None, "er", "x")],
        diagnosis=[diag("c1", "a", "2021-01-01", "Z1"), diag("c2", "b", "2021-01-01", "Z1"), diag("c3", "b", "2021-01-01", "Z2")],
        pharmacy_claim=[fill("c1", "a", "2021-01-01")],
    )
    write_claims(made, str(tmp_path / "claims"))
    asked = [(f"{k}-{tool}", tool, "a", DATE, "c1", "1", "Z1") for k in range(2) for tool in routing.ARGUMENTS]
    requests = spark.createDataFrame(
        [*asked, ("none", "claims_by_diagnosis", None, None, None, None, "Z9")],
        "request_id string, tool string, patient_id string, service_date date, claim_id string, ndc string, diagnosis_code string",
    )
    plans, stored = {}, routing.stored
    monkeypatch.setattr(routing, "stored", lambda df, label: plans.update({label: plan_of(df)}) or stored(df, label))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        answers = routing.tool_dispatch(requests, read_claims(spark, str(tmp_path / "claims")))
        assert not any("SortMergeJoin" in plans[f"wanted-{t}"] for t in ("enrollment", "medical_claim", "diagnosis", "pharmacy_claim"))
        lookup = plan_of(answers.where("tool = 'get_patient_diagnoses' and status <> 'error'"))
        # the ranked rows by patient, the requests by patient, and nothing after the join
        assert lookup.count("Exchange hashpartitioning(") == 2
        got = answers.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    by_code = sorted((r.request_id, r.status, r.claim_id) for r in got if r.tool == "claims_by_diagnosis")
    assert by_code == [(f"{k}-claims_by_diagnosis", "ok", c) for k in range(2) for c in ("c1", "c2")] + [("none", "empty", None)]


@pytest.mark.parametrize("key", [P, P.upper(), P[:31], P + "0", P + "\n", "", "é" * 16, "a", "0" * 32, "c1", None])
def test_short_ids_come_back(spark, key):
    (row,) = spark.createDataFrame([(key,)], "k string").select(short_id(F.col("k")).alias("s")).select("s", long_id(F.col("s")).alias("k")).collect()
    assert row.k == key and (key is None or len(row.s) == (17 if key in (P, "0" * 32) else 1 + len(key.encode())))
