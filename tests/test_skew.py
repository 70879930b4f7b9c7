"""One patient holds a third of all rows: results stay whole and the hot key is cut before the shuffle."""

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

from carepath.operators import lookups  # noqa: E402
from carepath.plans import catalogue, oracle  # noqa: E402
from carepath.sources import standins  # noqa: E402

HOT = "f" * 32
ORACLE_NAME = {"procedure": "procs"}
TABLES = ("enrollment", "medical_claim", "diagnosis", "pharmacy_claim", "procedure")


@pytest.fixture(scope="module")
def hot_root(spark, sf_dir, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("hot"))
    t = standins.TestTables(spark, sf_dir)
    for name in TABLES:
        df = getattr(standins, name)(t)
        third = F.pmod(F.xxhash64(*df.columns), F.lit(3)) == 0
        patient = F.when(third, HOT).otherwise(F.col("patient_id"))
        df.withColumn("patient_id", patient).select(*df.columns).repartition(6).write.parquet(f"{root}/{name}")
    return root


@pytest.fixture
def hot_tables(spark, sf_dir, hot_root, monkeypatch):
    for name in TABLES:
        monkeypatch.setattr(standins, name, lambda t, *_, name=name: spark.read.parquet(f"{hot_root}/{name}"))
    return standins.TestTables(spark, sf_dir)


def hot_sql(name, root):
    sql = oracle.oracle_sql()[name]
    for table in TABLES:
        cte = ORACLE_NAME.get(table, table)
        sql = sql.replace(oracle.BASE[cte], f"select * from read_parquet('{root}/{table}/*.parquet')")
    return sql


@pytest.mark.parametrize(
    "name",
    [
        "patient_enrollment", "patient_diagnoses", "patient_pharmacy", "patient_procedures", "patient_medications",
        "patient_claims", "latest_medication_diagnosis", "journey_on_date", "enrollment_history",
        "medication_adherence", "refill_gaps", "diagnosis_trend", "population_overlap", "utilization_cost",
        "claim_documents", "generate_evals", "evaluate_summary", "lookup_sql_functions",
    ],
)
def test_results_stay_whole(hot_tables, hot_root, name):
    df = catalogue.QUERIES[name](hot_tables)
    got = check.as_rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duckdb.connect().execute(hot_sql(name, hot_root))
    want = check.as_rows([d[0] for d in cursor.description], cursor.fetchall())
    assert got == want and got


def _written_by_shuffles(df):
    """Rows written by each shuffle of an executed plan."""
    df.write.format("noop").mode("overwrite").save()
    out = []

    def walk(node):
        if node.nodeName() in ("ShuffleQueryStage", "ResultQueryStage", "BroadcastQueryStage", "TableCacheQueryStage"):
            walk(node.plan())
            return
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
            return
        if node.nodeName() == "Exchange":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_cap_cuts_the_hot_patient_below_the_shuffle(spark, hot_root):
    raw = spark.read.parquet(f"{hot_root}/diagnosis")
    tasks, total = raw.rdd.getNumPartitions(), raw.count()
    hot = raw.where(F.col("patient_id") == HOT).count()
    assert hot > total * 0.3
    (moved,) = _written_by_shuffles(lookups.for_patients(raw, lookups.DIAGNOSES))
    assert moved <= total - hot + tasks * 50
