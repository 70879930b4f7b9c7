"""Evaluation records in hash buckets, merged bucket by bucket.

A record's bucket comes from its id.  A manifest names the folder that each bucket's rows are in; a merge reads and
rewrites only the buckets that its updates fall into, leaves alone those whose rows come out as they were, and then
publishes a new manifest.  Folders are never written twice, so a reader of an older manifest is not disturbed and a
merge that fails leaves the table as it was.  The manifest has one row per bucket, at most MAX_BUCKETS.

Records that no change can meet are not merged or compared: a filter of the changes' ids tells them apart as they are
read, and they go only into the rewriting of a bucket in which another record changes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carepath.functions.sieve import likely, unlikely
from carepath.operators.evalset import sync_labels, upsert_records
from carepath.schemas import EVAL_TABLE
from carepath.session import stored

MAX_BUCKETS = 65_536
BUCKETS = 64
_MANIFEST = "version long, n_buckets int, bucket int, folder string"


def _bucket(n_buckets: int) -> Column:
    return F.pmod(F.xxhash64("dataset_record_id"), F.lit(n_buckets)).cast("int")


def create_store(spark: SparkSession, path: str, n_buckets: int = BUCKETS) -> None:
    """An empty store; an error where there is one already."""
    if not 1 <= n_buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MAX_BUCKETS}, got {n_buckets}")
    first = spark.createDataFrame([(0, n_buckets, None, None)], _MANIFEST)
    first.drop("version").write.mode("errorifexists").parquet(f"{path}/manifests/version=0")


def manifest(spark: SparkSession, path: str) -> tuple[int, int, dict[int, str]]:
    """The newest version, its number of buckets, and the folder of each bucket that has rows."""
    every = spark.read.schema(_MANIFEST).parquet(f"{path}/manifests")
    newest = every.agg(F.max("version").alias("v")).first()["v"]
    rows = every.where(F.col("version") == newest).collect()
    return newest, rows[0]["n_buckets"], {r["bucket"]: r["folder"] for r in rows if r["bucket"] is not None}


def _read(spark: SparkSession, path: str, folders: dict[int, str]) -> DataFrame:
    """The rows of the given buckets, with ``_bucket``."""
    schema = T.StructType([*EVAL_TABLE.fields, T.StructField("write", T.StringType()), T.StructField("_bucket", T.IntegerType())])
    if not folders:
        return spark.createDataFrame([], EVAL_TABLE).withColumn("_bucket", F.lit(0))
    files = [f"{path}/data/write={folder}/_bucket={b}" for b, folder in sorted(folders.items())]
    rows = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*files)
    return rows.drop("write")


def load_store(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, manifest(spark, path)[2]).drop("_bucket")


def _row_hash() -> Column:
    # maps have no hash; their entries in order of key do
    tags = F.array_sort(F.map_entries("tags"))
    return F.xxhash64(*[c for c in EVAL_TABLE.fieldNames() if c != "tags"], tags)


def _digests(rows: DataFrame) -> DataFrame:
    """_bucket, n and a sum of row hashes: equal for equal sets of rows."""
    return rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(_row_hash().cast("decimal(38,0)")).alias("h"))


def _merge(spark: SparkSession, path: str, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Apply ``changes`` to the buckets they fall into; the buckets that were rewritten."""
    version, n_buckets, folders = manifest(spark, path)
    changes = stored(changes.withColumn("_bucket", _bucket(n_buckets)), "changes")
    touched = [r["_bucket"] for r in changes.select("_bucket").distinct().collect()]  # at most MAX_BUCKETS
    filed = {b: folders[b] for b in touched if b in folders}
    before = _read(spark, path, filed)
    # the store has one record per id, and neither kind of change alters a record whose id it doesn't hold
    met = likely(before, changes, ["dataset_record_id"]) if filed else before
    after = apply(met.drop("_bucket"), changes.drop("_bucket"))
    after = stored(after.withColumn("_bucket", _bucket(n_buckets)), "merged")
    changed = {r["_bucket"] for r in after.select("_bucket").distinct().collect()} - set(filed)
    if filed:
        was, now = _digests(met), _digests(after)
        compared = now.join(was.toDF("_bucket", "n0", "h0"), "_bucket", "left")
        changed |= {r["_bucket"] for r in compared.where("n0 is null or n <> n0 or h <> h0").select("_bucket").collect()}
    if not changed:
        return []
    folder = uuid.uuid4().hex
    rewritten = after.where(F.col("_bucket").isin(sorted(changed)))
    if changed & set(filed):
        kept = unlikely(_read(spark, path, {b: filed[b] for b in changed if b in filed}), changes, ["dataset_record_id"])
        rewritten = rewritten.unionByName(kept)
    # a bucket's rows go to one file per task range, however large the bucket
    rewritten.repartitionByRange("_bucket", "dataset_record_id").write.partitionBy("_bucket").parquet(f"{path}/data/write={folder}")
    rows = [(version + 1, n_buckets, b, f) for b, f in {**folders, **dict.fromkeys(changed, folder)}.items()]
    # of two merges at a time the second finds its version taken, and fails
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).drop("version").write.mode("errorifexists").parquet(f"{path}/manifests/version={version + 1}")
    return sorted(changed)


def merge_records(updates: DataFrame, path: str) -> list[int]:
    """Upsert records; the buckets that were rewritten (none on a rerun)."""
    return _merge(updates.sparkSession, path, updates.select(*EVAL_TABLE.fieldNames()), upsert_records)


def merge_labels(labels: DataFrame, path: str) -> list[int]:
    """Human labels (dataset_record_id, user_name, expected_facts, labelled_at) into their records."""
    return _merge(labels.sparkSession, path, labels, sync_labels)
