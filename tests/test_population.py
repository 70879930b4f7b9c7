import datetime

from conftest import day, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from carepath import schemas
from carepath.operators import population
from test_timeline import fill

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
BASE = datetime.date(2021, 1, 1)


def span(patient, start, end):
    return (patient, "F", "1980", "1", "NY", start, end, "m", "x")


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40), st.integers(0, 10)), max_size=25))
def test_enrollment_spans_merge_like_day_sets(spark, raw):
    data = [span(p, BASE + datetime.timedelta(s), BASE + datetime.timedelta(s + n)) for p, s, n in raw]
    got = rows(
        population.enrollment_history(spark.createDataFrame(data, schemas.ENROLLMENT)).select(
            "patient_id", "date_start", "date_end"
        )
    )
    want = []
    for p in "ab":
        days = sorted({s + i for q, s, n in raw if q == p for i in range(n + 1)})
        runs = [d for d in days if d - 1 not in days]
        for first in runs:
            last = first
            while last + 1 in days:
                last += 1
            want.append((p, BASE + datetime.timedelta(first), BASE + datetime.timedelta(last)))
    assert got == sorted(want, key=str)


def test_open_and_undated_spans(spark):
    data = [span("a", day("2021-01-01"), None), span("a", day("2022-01-01"), day("2022-02-01")), span("a", None, day("2020-01-01"))]
    (row,) = population.enrollment_history(spark.createDataFrame(data, schemas.ENROLLMENT)).collect()
    assert (row.date_start, row.date_end, row.merged_spans) == (day("2021-01-01"), None, 2)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 30), st.integers(1, 9)), min_size=1, max_size=20))
def test_adherence_counts_covered_days_once(spark, raw):
    data = [fill(f"c{i}", p, str(BASE + datetime.timedelta(s)), supply=n) for i, (p, s, n) in enumerate(raw)]
    out = population.medication_adherence(spark.createDataFrame(data, schemas.PHARMACY_CLAIM))
    got = {r.patient_id: (r.fills, r.days_covered, r.period_days) for r in out.collect()}
    for p in {q for q, _, _ in raw}:
        days = {s + i for q, s, n in raw if q == p for i in range(n)}
        assert got[p] == (sum(q == p for q, _, _ in raw), len(days), max(days) - min(days) + 1)


def test_refill_gaps(spark):
    data = [
        fill("1", "a", "2021-01-01", supply=10), fill("2", "a", "2021-01-01", supply=5), fill("3", "a", "2021-01-15", supply=10),
        fill("4", "a", "2021-01-20", supply=1), fill("5", "a", None),
    ]
    got = rows(
        population.refill_gaps(spark.createDataFrame(data, schemas.PHARMACY_CLAIM)).select("fill_date", "fills", "gap_days")
    )
    assert got == [(day("2021-01-01"), 2, 4), (day("2021-01-15"), 1, -5), (day("2021-01-20"), 1, None)]


def test_overlap_and_members(spark):
    medical = spark.createDataFrame([("a",), ("a",), ("b",)], "patient_id string")
    pharmacy = spark.createDataFrame([("b",), ("c",), ("c",)], "patient_id string")
    assert rows(population.population_overlap(medical, pharmacy)) == [("both", 1), ("medical_only", 1), ("pharmacy_only", 1)]
    for segment, patient in (("both", "b"), ("medical_only", "a"), ("pharmacy_only", "c")):
        assert rows(population.population_members(medical, pharmacy, segment)) == [(patient,)]


def test_utilization_of_claims_without_lines(spark):
    medical = spark.createDataFrame(
        [("c1", "a", day("2021-05-05"), None, "er", "x"), ("c2", "a", day("2021-05-06"), None, "er", None)],
        schemas.MEDICAL_CLAIM,
    )
    lines = spark.createDataFrame(
        [("c1", "a", str(i), day("2021-05-05"), None, "p", "q", 1.0, "r", 2.5, 1.25) for i in range(3)], schemas.PROCEDURE
    )
    fills = spark.createDataFrame([fill("r", "a", "2021-06-01")], schemas.PHARMACY_CLAIM)
    got = {(r.month, r.pay_type, r.level): r for r in population.utilization_cost(medical, lines, fills).collect()}
    total = got[(None, None, 3)]
    assert (total.claims, total.fills, total.charge, total.allowed, total.paid) == (2, 1, 8.5, 3.75, 1.0)
    assert got[(day("2021-05-01"), None, 0)].claims == 1 and got[(day("2021-05-01"), None, 1)].claims == 2


def test_money_in_equals_money_out(spark):
    from carepath import schemas

    medical = spark.createDataFrame(
        [("c1", "a", day("2021-01-05"), None, "er", "x"), ("c1", "a", day("2021-01-05"), None, "er", "x"),
         ("c2", "a", day("2021-02-01"), None, "er", "y")], schemas.MEDICAL_CLAIM)
    line = lambda claim, date, allowed: (claim, "a", "1", day(date), None, "p", "q", 1.0, "r", 2.0, allowed)
    lines = spark.createDataFrame([line("c1", "2021-01-05", 5.0), line("gone", "2021-03-01", 50.0)], schemas.PROCEDURE)
    fills = spark.createDataFrame([], schemas.PHARMACY_CLAIM)
    got = {(r.month, r.pay_type, r.level): r for r in population.utilization_cost(medical, lines, fills).collect()}
    total = next(r for r in got.values() if r.level == 3)
    assert (total.allowed, total.claims) == (55.0, 2)
    assert got[(day("2021-03-01"), None, 0)].allowed == 50.0 and got[(day("2021-03-01"), None, 0)].claims == 0
    assert got[(day("2021-02-01"), "y", 0)].claims == 1


def test_trend_ids_are_shuffled_packed_and_stay_apart(spark):
    a, raw = "0123456789abcdef" * 2, bytes.fromhex("41" * 16).decode()
    ids = [a, a, a.upper(), a + "\n", "41" * 16, raw, "", None]
    data = [(f"c{k % 3}", i, day("2021-01-02"), None, "Z1", None, None) for k, i in enumerate(ids)]
    trend = population.diagnosis_trend(spark.createDataFrame(data, schemas.DIAGNOSIS))
    assert "unhex" in trend._jdf.queryExecution().executedPlan().toString()
    (got,) = trend.collect()
    assert (got.patients, got.claims) == (6, 3)
