import datetime

import pytest
from conftest import day, plan_of, rows
from pyspark.sql import functions as F

from carepath import schemas
from carepath.functions.text import question_id, record_id
from carepath.operators import evalset, labels
from carepath.session import new_folder
from carepath.sources import claims as claim_tables
from carepath.sources import standins

NOON = datetime.datetime(2024, 1, 1, 12)


@pytest.fixture(scope="module")
def medical(spark):
    data = [(f"c{i}", p, day(f"2021-01-{i + 1:02d}"), None, "office" if i % 2 else None, "x") for p in "ab" for i in range(6)]
    return spark.createDataFrame(data, schemas.MEDICAL_CLAIM)


def record(rid, at, question, by="t", facts=None):
    return (
        rid, at, by, at, by, ((None,), ("u", "c"), (None,)), f'{{"messages":[{{"role":"user","content":"{question}"}}]}}',
        facts, {"k": "v"},
    )


def test_null_value_drops_out_but_its_label_stays(medical):
    (doc,) = evalset.claim_documents(medical, "a", limit=1).collect()
    assert doc.content == "PATIENT_ID: a CLAIM_ID: c5 DATE_SERVICE: 2021-01-06 LOCATION_OF_CARE: office PAY_TYPE: x"
    assert doc.id == "a" and doc.doc_uri == "PATIENT_ID: a"
    texts = [r.content for r in evalset.claim_documents(medical, "a").collect()]
    assert "PATIENT_ID: a CLAIM_ID: c0 DATE_SERVICE: 2021-01-01 LOCATION_OF_CARE: PAY_TYPE: x" in texts and len(texts) == 6


def test_generated_evals_name_the_patient_and_repeat(medical):
    one = evalset.generate_evals(medical, 10)
    got = one.collect()
    assert len(got) == 20 and len({r.dataset_record_id for r in got}) == 20
    assert all(f"patient {r.patient_id}" in r.messages[0]["content"] and r.expected_facts for r in got)
    assert rows(one.select("dataset_record_id")) == rows(evalset.generate_evals(medical.repartition(5), 10).select("dataset_record_id"))
    single = evalset.generate_evals(medical, 10, patient_id="a").select("dataset_record_id")
    assert rows(single) == rows(one.where("patient_id = 'a'").select("dataset_record_id"))


def test_upsert_is_idempotent_newest_wins_and_creation_stays(spark):
    later = NOON + datetime.timedelta(days=1)
    old = spark.createDataFrame([record("1", NOON, "q1"), record("2", NOON, "q2")], schemas.EVAL_TABLE)
    new = spark.createDataFrame(
        [record("2", later, "q2", "z"), record("3", later, "q3"), record("2", NOON - datetime.timedelta(days=9), "old", "early")],
        schemas.EVAL_TABLE,
    )
    once = evalset.upsert_records(old, new)
    got = {r.dataset_record_id: r for r in once.collect()}
    assert set(got) == {"1", "2", "3"}
    assert (got["2"].last_updated_by, got["2"].last_update_time) == ("z", later)
    assert got["2"].created_by == "early" and got["2"].tags == {"k": "v"}
    assert rows(evalset.upsert_records(once, new)) == rows(once)


def test_sync_labels_takes_the_newest_label_only_where_there_is_one(spark):
    data = spark.createDataFrame([record("1", NOON, "q1", facts="{}"), record("2", NOON, "q2", facts="{}")], schemas.EVAL_TABLE)
    given = spark.createDataFrame(
        [("1", "u1", ["a"], NOON), ("1", "u2", ["b", "c"], NOON + datetime.timedelta(hours=1)), ("9", "u", ["x"], NOON)],
        "dataset_record_id string, user_name string, expected_facts array<string>, labelled_at timestamp",
    )
    got = {r.dataset_record_id: r for r in evalset.sync_labels(data, given).collect()}
    assert got["1"].expectations == '{"expected_facts":["b","c"]}' and got["1"].source.human.user_name == "u2"
    assert got["1"].last_updated_by == "u2" and got["1"].source.document.doc_uri == "u"
    assert got["2"].expectations == "{}" and got["2"].last_updated_by == "t" and len(got) == 2


def test_tables_of_records(spark, medical):
    root = new_folder(spark, "test")
    claim_tables.ensure_schema(spark, "t_eval", f"{root}/s")
    table = "t_eval.data"
    claim_tables.drop_dataset(spark, table)
    assert claim_tables.create_dataset(spark, table, f"{root}/data", schemas.EVAL_TABLE)
    assert not claim_tables.create_dataset(spark, table, f"{root}/data", schemas.EVAL_TABLE)
    frame = evalset.eval_rows(evalset.generate_evals(medical, 3), "gen", F.lit(NOON))
    assert frame.schema.simpleString() == schemas.EVAL_TABLE.simpleString()
    claim_tables.append_records(frame, table)
    claim_tables.append_records(frame, table)
    stored = claim_tables.load_dataset(spark, table)
    assert stored.count() == 12
    merged = evalset.upsert_records(stored, frame)
    for _ in range(2):  # the second time it replaces rows read from the table itself
        claim_tables.replace_records(merged, table, root, schemas.EVAL_TABLE)
        assert claim_tables.load_dataset(spark, table).count() == 6
        merged = claim_tables.load_dataset(spark, table)
    claim_tables.merge_dataset(frame, table, root)
    assert claim_tables.load_dataset(spark, table).count() == 6
    merged = claim_tables.load_dataset(spark, table)
    (preview,) = claim_tables.dataset_preview(merged, ["dataset_record_id"]).collect()
    assert preview.n_records == 6
    assert preview.dataset_record_id == min(r.dataset_record_id for r in merged.collect())
    assert claim_tables.drop_dataset(spark, table) and not claim_tables.drop_dataset(spark, table)


def test_labels(spark):
    given = spark.createDataFrame(
        [(1, "u", "Good", ["x" * 1000]), (2, "u", "Best", None), (3, "u", "Poor", ["a", "x" * 1001]), (4, "u", None, None), (1, "v", "Poor", None)],
        "item_id int, user_name string, rating string, expected_facts array<string>",
    )
    valid, rejected = labels.label_validate(given)
    assert rows(valid.select("item_id", "user_name")) == [(1, "u"), (1, "v")]
    assert rows(rejected.select("item_id", "reason")) == [(2, "unknown rating"), (3, "fact too long"), (4, "empty label")]
    assert rows(labels.label_summary(valid)) == [(1, 1, 0, 1, 0, 2)]
    assigned = labels.label_assign(given.select("item_id").distinct(), ["u", "v"])
    assert assigned.count() == 4 * 2 * 2 == assigned.distinct().count()


def test_double_claims_ask_once_and_zero_is_refused(spark, medical):
    twice = medical.unionByName(medical)
    ids = [r.dataset_record_id for r in evalset.generate_evals(twice, 100).collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {r.dataset_record_id for r in evalset.generate_evals(medical, 100).collect()}
    for patient in (None, "a"):
        with pytest.raises(ValueError):
            evalset.claim_documents(medical, patient, limit=0)


def test_a_label_never_turns_time_back(spark):
    dataset = spark.createDataFrame([record("1", NOON, "q")], schemas.EVAL_TABLE)
    early = NOON - datetime.timedelta(days=100)
    label = spark.createDataFrame([("1", "u", ["f"], early)], "dataset_record_id string, user_name string, expected_facts array<string>, labelled_at timestamp")
    (row,) = evalset.sync_labels(dataset, label).collect()
    assert row.last_update_time == NOON and row.last_updated_by == "u"


def test_every_table_asks_and_patients_without_medical_claims_do(spark, medical):
    from test_routing import claims_of, diag, fill

    claims = claims_of(
        spark,
        enrollment=[("e", "F", "1980", "1", "NY", day("2020-01-01"), None, "m", "x")],
        medical_claim=[tuple(r) for r in medical.collect()],
        diagnosis=[diag("c1", "a", "2021-01-02", "Z1"), diag("c1", "a", "2021-01-02", "Z1"), diag("q", "d", "2021-03-01", "Z2")],
        pharmacy_claim=[fill("r1", "f", "2021-01-01")],
    )
    made = evalset.generate_table_evals(claims, quota=3)
    got = made.collect()
    per = {}
    for r in got:
        per.setdefault((r.patient_id, r.source_table), []).append(r)
    assert {k: len(v) for k, v in per.items()} == {
        ("a", "medical_claim"): 3, ("b", "medical_claim"): 3, ("a", "diagnosis"): 2, ("d", "diagnosis"): 2,
        ("e", "enrollment"): 2, ("f", "pharmacy_claim"): 2,
    }
    seen = {(r.patient_id, r.question): r.expected_facts for r in got}
    assert seen[("a", "When and where was patient a seen for diagnosis Z1 of claim c1?")] == ["2021-01-02", "office"]
    assert seen[("d", "When and where was patient d seen for diagnosis Z2 of claim q?")] == ["2021-03-01"]
    assert len({r.dataset_record_id for r in got}) == len(got)
    again = evalset.generate_table_evals(claims, quota=3)
    assert rows(made) == rows(again)


def test_questions_are_cut_by_id_before_their_texts_move(spark, sf_dir):
    t = standins.TestTables(spark, sf_dir)
    claims = standins.medical_claim(t).repartition(4)
    plan = plan_of(evalset.generate_evals(claims))
    assert plan.count("Exchange hashpartitioning(patient_id") == 1 and "hashpartitioning(dataset_record_id" not in plan
    plan = plan_of(evalset.generate_table_evals(standins.claims(t)))
    assert "question" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    # every table's questions are limited below the shuffle and above it
    assert plan.count("WindowGroupLimit") == 10


def test_claims_recorded_twice_ask_once(spark):
    d = day("2021-01-02")
    twice = [("c", "a", d, None, None, "x"), ("c", "a", day("2021-01-03"), None, "office", "x"), ("c", "a", d, d, None, "x")]
    medical = spark.createDataFrame(twice, schemas.MEDICAL_CLAIM)
    got = {r.messages[0]["content"]: (r.expected_facts, r.date_service) for r in evalset.generate_evals(medical).collect()}
    # the smallest document is the one of 2021-01-02; only the other one knows the place
    assert got == {
        "On which date was claim c of patient a served?": (["2021-01-02"], d),
        "Where was care given to patient a under claim c?": (["office"], day("2021-01-03")),
        "Which payer covered claim c of patient a?": (["x"], d),
        "Summarise claim c of patient a.": (["c", "2021-01-02", "x"], d),
    }
    assert [r.dataset_record_id for r in evalset.generate_evals(medical.repartition(3), 2).orderBy("dataset_record_id").collect()] == sorted(
        r.dataset_record_id for r in evalset.generate_evals(medical).collect()
    )[:2]


def test_question_id_is_the_record_id(spark):
    df = spark.createDataFrame([("a?",), ("",), (None,)], "q string")
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("q").alias("content")))
    got = df.select("q", question_id(F.col("q")).alias("a"), record_id(message).alias("b")).collect()
    assert all(r.a == (None if r.q is None else r.b) for r in got)


def test_a_rerun_of_a_merge_writes_nothing(spark, medical):
    root = new_folder(spark, "rerun")
    claim_tables.ensure_schema(spark, "t_rerun", f"{root}/s")
    claim_tables.drop_dataset(spark, "t_rerun.data")
    claim_tables.create_dataset(spark, "t_rerun.data", f"{root}/data", schemas.EVAL_TABLE)
    frame = evalset.eval_rows(evalset.generate_evals(medical, 3), "gen", F.lit(NOON))
    files = lambda: sorted(claim_tables.load_dataset(spark, "t_rerun.data").inputFiles())
    claim_tables.merge_dataset(frame, "t_rerun.data", root)
    before = files()
    claim_tables.merge_dataset(frame, "t_rerun.data", root)
    assert before and files() == before
    later = evalset.eval_rows(evalset.generate_evals(medical, 1), "gen", F.lit(NOON + datetime.timedelta(microseconds=1)))
    want = rows(evalset.upsert_records(claim_tables.load_dataset(spark, "t_rerun.data"), later).drop("tags"))
    claim_tables.merge_dataset(later, "t_rerun.data", root)
    assert files() != before and rows(claim_tables.load_dataset(spark, "t_rerun.data").drop("tags")) == want
    claim_tables.drop_dataset(spark, "t_rerun.data")


def test_changed_ids_are_those_an_upsert_changes(spark):
    at = lambda k: NOON + datetime.timedelta(microseconds=k)
    old = [record("same", NOON, "q"), record("newer", NOON, "q"), record("twice", NOON, "q"), record("twice", NOON, "q"), record("alone", NOON, "q")]
    new = [record("same", NOON, "q"), record("same", NOON, "q"), record("newer", at(1), "q"), record("fresh", NOON, "q")]
    old.append(tuple(None if k == 1 else v for k, v in enumerate(record("unborn", NOON, "q"))))
    frames = [spark.createDataFrame(data, schemas.EVAL_TABLE) for data in (old, new)]
    assert sorted(r[0] for r in evalset.changed_ids(*frames).collect()) == ["fresh", "newer", "twice", "unborn"]
