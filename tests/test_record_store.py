import datetime
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from carepath import schemas
from carepath.operators import evalset
from carepath.sources import record_store

AT = datetime.datetime(2024, 1, 1)


def records(spark, ids, text="t", at=AT):
    data = [
        (i, at, "me", at, "me", ((None,), ("doc", "c"), None), f'{{"messages":"{text}{i}"}}', None, {"b": "1", "a": i}) for i in ids
    ]
    rows_ = [(i, c, cb, u, ub, (None, s[1], None), x, e, t) for i, c, cb, u, ub, s, x, e, t in data]
    return spark.createDataFrame(rows_, schemas.EVAL_TABLE)


def flat(df):
    return rows(df.withColumn("tags", F.array_sort(F.map_entries("tags"))))


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_only_touched_buckets_are_rewritten_and_a_rerun_changes_no_file(spark, tmp_path):
    path = str(tmp_path / "store")
    record_store.create_store(spark, path, 16)
    assert record_store.load_store(spark, path).count() == 0
    first = records(spark, [f"r{k}" for k in range(200)])
    assert len(record_store.merge_records(first, path)) == 16
    before, folders = files(path), record_store.manifest(spark, path)[2]
    assert record_store.merge_records(first, path) == [] and files(path) == before

    changes = records(spark, ["r7", "new"], "later", AT + datetime.timedelta(1))
    touched = record_store.merge_records(changes, path)
    assert 1 <= len(touched) <= 2
    after = record_store.manifest(spark, path)[2]
    assert {b for b in after if after[b] != folders[b]} == set(touched)
    assert before < files(path)  # nothing was overwritten
    assert flat(record_store.load_store(spark, path)) == flat(evalset.upsert_records(first, changes))
    assert record_store.merge_records(changes, path) == []


def test_labels_reach_their_buckets_only(spark, tmp_path):
    path = str(tmp_path / "store")
    record_store.create_store(spark, path, 8)
    first = records(spark, [f"r{k}" for k in range(60)])
    record_store.merge_records(first, path)
    labels = spark.createDataFrame(
        [("r3", "ann", ["x"], AT + datetime.timedelta(2)), ("nobody", "ann", ["y"], AT)],
        "dataset_record_id string, user_name string, expected_facts array<string>, labelled_at timestamp",
    )
    assert len(record_store.merge_labels(labels, path)) == 1
    assert flat(record_store.load_store(spark, path)) == flat(evalset.sync_labels(first, labels))
    assert record_store.merge_labels(labels, path) == []


def test_one_of_two_merges_at_a_time_fails(spark, tmp_path):
    path = str(tmp_path / "store")
    record_store.create_store(spark, path)
    with pytest.raises(Exception, match="(?i)exist"):
        record_store.create_store(spark, path)
    with pytest.raises(ValueError, match="buckets"):
        record_store.create_store(spark, f"{path}-2", 0)
    record_store.merge_records(records(spark, ["a"]), path)
    older = record_store.manifest(spark, path)
    record_store.merge_records(records(spark, ["b"]), path)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(record_store, "manifest", lambda *_: older)
        with pytest.raises(Exception, match="(?i)exist"):
            record_store.merge_records(records(spark, ["c"]), path)
    assert {r.dataset_record_id for r in record_store.load_store(spark, path).collect()} == {"a", "b"}


def test_records_that_no_change_meets_are_not_merged(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    record_store.create_store(spark, path, 2)
    first = records(spark, [f"r{k}" for k in range(200)])
    record_store.merge_records(first, path)
    merged = []

    def counted(df, label):
        out = stored(df, label)
        if label == "merged":
            merged.append(out.count())
        return out

    stored = record_store.stored
    monkeypatch.setattr(record_store, "stored", counted)
    changes = records(spark, ["r7", "r8", "new", None], "later", AT + datetime.timedelta(1))
    assert record_store.merge_records(changes, path) == [0, 1] and record_store.merge_records(changes, path) == []
    assert merged == [4, 4]
    assert flat(record_store.load_store(spark, path)) == flat(evalset.upsert_records(first, changes))
