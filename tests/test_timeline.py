from conftest import day, rows

from carepath import schemas
from carepath.operators import timeline
from carepath.sources.claims import Claims


def claims_of(spark, **tables):
    return Claims(**{n: spark.createDataFrame(tables.get(n, []), s) for n, s in schemas.CLAIM_TABLES.items()})


def fill(claim, patient, date, ndc="1", n=1, supply=30):
    return (claim, patient, day(date), ndc, n, supply, 1.0, "x", 0.0, 1.0, 1.0)


def diag(claim, patient, date, code):
    return (claim, patient, day(date), day(date), code, "01", "Y")


def test_latest_medication_takes_the_diagnosis_as_of_the_fill(spark):
    c = claims_of(
        spark,
        pharmacy_claim=[fill("r1", "a", "2021-01-01"), fill("r2", "a", "2021-03-01", "2"), fill("r3", "b", "2020-01-01")],
        diagnosis=[
            diag("d1", "a", "2021-02-01", "Z9"), diag("d2", "a", "2021-02-01", "Z3"), diag("d3", "a", "2021-04-01", "Z1"),
            diag("d4", "b", "2020-01-02", "Z1"), diag("d5", "a", None, "Z0"),
        ],
    )
    got = {r.patient_id: r for r in timeline.latest_medication_diagnosis(c.pharmacy_claim, c.diagnosis).collect()}
    assert (got["a"].ndc, got["a"].diagnosis_date, got["a"].diagnosis_code) == ("2", day("2021-02-01"), "Z3")
    assert (got["b"].ndc, got["b"].diagnosis_date, got["b"].diagnosis_code) == ("1", None, None)
    one = timeline.latest_medication_diagnosis(c.pharmacy_claim, c.diagnosis, "a").collect()
    assert one == [got["a"]]


def test_journey_of_one_patient_and_a_day(spark):
    c = claims_of(
        spark,
        enrollment=[
            ("a", "F", "1980", "1", "NY", day("2021-01-01"), day("2021-12-31"), "med", "x"),
            ("a", "F", "1980", "1", "NY", day("2022-01-01"), None, "med", "x"),
        ],
        medical_claim=[("c1", "a", day("2021-05-05"), None, None, "x"), ("c2", "b", day("2021-05-05"), None, "er", "x")],
        diagnosis=[diag("c1", "a", "2021-05-05", None)],
    )
    assert [r.kind for r in timeline.patient_journey(c, "a").collect()] == [
        "enrollment", "diagnosis", "medical_claim", "enrollment",
    ]
    assert timeline.patient_journey(c).count() == 5
    keys = spark.createDataFrame([("a", day("2021-05-05")), ("a", day("2022-06-01"))], "patient_id string, service_date date")
    got = rows(timeline.journey_on_date(c, keys).select("service_date", "kind"))
    assert got == [
        (day("2021-05-05"), "diagnosis"), (day("2021-05-05"), "enrollment"), (day("2021-05-05"), "medical_claim"),
        (day("2022-06-01"), "enrollment"),
    ]


def test_reverse_lookups(spark):
    c = claims_of(
        spark,
        medical_claim=[("c1", "a", day("2021-05-05"), None, "er", "x")],
        diagnosis=[diag("c1", "a", "2021-05-05", "Z1"), diag("c2", "b", "2021-05-06", "Z2")],
        pharmacy_claim=[fill("r1", "a", "2021-01-01"), fill("r2", "b", "2021-01-01", "2")],
    )
    assert {r.kind for r in timeline.claim_lookup(c, "c1").collect()} == {"medical_claim", "diagnosis"}
    keys = spark.createDataFrame([("c2",), ("r2",)], "claim_id string")
    assert {r.claim_id for r in timeline.claim_lookup(c, keys).collect()} == {"c2", "r2"}
    assert [r.claim_id for r in timeline.claims_by_ndc(c.pharmacy_claim, "2").collect()] == ["r2"]
    assert [r.claim_id for r in timeline.claims_by_diagnosis(c.diagnosis, "Z1").collect()] == ["c1"]
    assert rows(timeline.patient_claims(c).select("patient_id", "claim_id")) == [
        ("a", "c1"), ("a", "r1"), ("b", "c2"), ("b", "r2"),
    ]
