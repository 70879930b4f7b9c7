import random

from pyspark.sql import functions as F

from carepath.functions.prefix import running_totals


def test_totals_before_each_row_equal_brute_force(spark):
    rng = random.Random(5)
    data = [(rng.choice([None, 1, 1, 1, 2]), rng.choice([None, *range(9)]), k, rng.randint(-5, 5)) for k in range(3000)]
    frame = spark.createDataFrame(data, "key int, place int, tie int, x int").repartition(7)
    got = {r.tie: (r.n, r.total) for r in running_totals(frame, ["key"], ["place", "tie"], {"n": F.lit(1), "total": F.col("x")}).collect()}
    order = sorted(data, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2]))
    seen = {}
    for key, _, tie, x in order:
        n, total = seen.get(key, (0, 0))
        assert got[tie] == (n, total)
        seen[key] = (n + 1, total + x)
    assert len(got) == 3000


def test_a_key_with_all_rows_is_spread_and_an_empty_frame_stays_empty(spark):
    hot = spark.range(20_000).select(F.lit(1).alias("key"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = running_totals(hot, ["key"], ["id"], {"n": F.lit(1)})
        assert numbered.where("n <> id").count() == 0 and numbered.count() == 20_000
        # no task sees more than a few slices
        assert numbered.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 15_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert running_totals(hot.where("false"), ["key"], ["id"], {"n": F.lit(1)}).count() == 0
