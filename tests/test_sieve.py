import datetime

from conftest import plan_of
from pyspark.sql import functions as F

from carepath.functions.ranking import leading, newest_per_key, total_order
from carepath.functions.sieve import likely
from carepath.operators import timeline
from carepath.plans import catalogue
from carepath.schemas import PHARMACY_CLAIM
from carepath.sources import standins


def test_the_sieve_keeps_every_wanted_row_and_few_others(spark):
    rows = spark.range(100_000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).alias("d"))
    wanted = rows.where("cast(k as long) % 50 = 0")
    kept = likely(rows, wanted.distinct(), ["k", "d"])
    assert kept.join(wanted, ["k", "d"], "left_semi").count() == 2000 and kept.count() < 2100
    # a filter as good as full lets rows through, never loses one
    assert likely(rows, wanted, ["k", "d"], bits=6).join(wanted, ["k", "d"], "left_semi").count() == 2000
    assert likely(rows, wanted.limit(0), ["k"]).count() == 0


def test_the_sieve_takes_keys_of_another_type(spark):
    rows = spark.createDataFrame([(datetime.date(2021, 1, 2),), (datetime.date(2021, 1, 3),), (None,)], "d date")
    wanted = spark.createDataFrame([("2021-1-2",), (None,)], "d string")
    assert [r.d for r in likely(rows, wanted, ["d"]).join(wanted, "d", "left_semi").collect()] == [datetime.date(2021, 1, 2)]


def test_rows_meet_the_sieve_below_the_shuffle(spark, sf_dir):
    t = standins.TestTables(spark, sf_dir)
    for name in ("claim_lookup", "journey_on_date"):
        assert plan_of(catalogue.QUERIES[name](t)).count("_bits") >= 4


def test_the_latest_fill_moves_only_what_decides_it(spark, sf_dir):
    fills = standins.pharmacy_claim(standins.TestTables(spark, sf_dir)).localCheckpoint()
    got = timeline.latest_fill(fills)
    moved = [line for line in plan_of(got).splitlines() if "copay_coinsurance" in line and "Scan" not in line]
    assert not moved and leading(PHARMACY_CLAIM, "ndc") == ["claim_id", "patient_id", "date_service", "ndc"]
    columns = PHARMACY_CLAIM.fieldNames()
    whole = newest_per_key(fills.select(*columns), ["patient_id"], total_order("date_service", columns), 1)
    assert not got.select("patient_id", "claim_id", "ndc").exceptAll(whole.select("patient_id", "claim_id", "ndc")).count()


def test_few_codes_are_broadcast_to_the_diagnoses(spark, sf_dir):
    plan = plan_of(catalogue.QUERIES["claims_by_diagnosis"](standins.TestTables(spark, sf_dir)))
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning(diagnosis_code" not in plan
