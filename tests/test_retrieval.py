from carepath.operators.retrieval import vector_topk

SCHEMA = "id bigint, embedding array<double>"


def frames(spark, corpus, queries):
    c = spark.createDataFrame(corpus, SCHEMA).withColumnRenamed("id", "vec_id")
    return c, spark.createDataFrame(queries, SCHEMA).withColumnRenamed("id", "query_id")


def test_near_ties_are_ranked_on_full_values(spark):
    c, q = frames(spark, [(1, [1.0, 0.0009]), (2, [1.0, 0.0])], [(7, [1.0, 0.0]), (8, None)])
    assert [(r.query_id, r.vec_id) for r in vector_topk(c, q, 1).collect()] == [(7, 2)]


def test_any_number_of_queries(spark):
    corpus = [(k, [float(k % 17), 1.0, float(k % 5)]) for k in range(200)]
    c, q = frames(spark, corpus, [(k, [float(k % 13), 1.0, 2.0]) for k in range(3000)])
    assert vector_topk(c, q, 3).count() == 9000


def test_no_queries(spark):
    c, q = frames(spark, [(1, [1.0])], [(1, [1.0])])
    assert vector_topk(c, q.where("false"), 1).count() == 0
