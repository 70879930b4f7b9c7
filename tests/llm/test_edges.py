"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

from carepath.llm import (
    op1_pii, op2_bpe, op3_warc, op4_lines, op5_quality, op6_html, op7_minhash, op8_mixing, op9_toxicity,
    op10_fingerprint,
)
from carepath.llm.queries import vocabulary_path

CLASHING = "w string, l string, n long, n_words long, node long, kept boolean, row string, bucket long, key string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
REST = ("x", "y", 1, 2, 3, True, "r", 4, "k")
PROSE = "the of and to in is that for it with as was on are by this be from or an one two three four five six seven"
LONG = " ".join(f"w{k % 9973}" for k in range(60_000))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", len(t or ""), *REST) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(1, None), (2, ""), (3, "word"), (3, "word"), (None, PROSE), (5, LONG), (6, PROSE + " eight"), (7, PROSE), (8, " \t\n ")]
    return documents(spark, rows).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return documents(spark, [(1, "x")]).where("false")


def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (3, 1, None), (5, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")


def toxicity(docs):
    return op9_toxicity.toxicity(docs, labels(docs.sparkSession))


def tokens(docs):
    return op2_bpe.digests(op2_bpe.encode(docs, vocabulary_path(), 100))


def mixed(docs):
    return op8_mixing.select(op8_mixing.with_domain(docs), op8_mixing.Mix(("domain", "lang", "source"), budget_percent=200))


PER_ROW = [op1_pii.report, tokens, op5_quality.quality, op7_minhash.near_duplicates, toxicity, op10_fingerprint.edited_fingerprints]


@pytest.mark.parametrize("operator", PER_ROW, ids=lambda f: f"{f.__module__}.{f.__name__}")
def test_a_row_for_every_row(edges, operator):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in operator(edges).collect())
    assert got == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in edges.collect())


@pytest.mark.parametrize(
    "operator",
    [*PER_ROW, op4_lines.line_report, op4_lines.drop_lines, op5_quality.keep_good, op7_minhash.keep_one, mixed],
    ids=lambda f: f"{f.__module__}.{f.__name__}",
)
def test_an_empty_table_gives_no_rows(nothing, operator):
    assert operator(nothing).count() == 0


def test_personal_data_of_empty_texts(edges):
    got = {r["doc_id"]: r for r in op1_pii.report(edges).collect()}
    assert got[1]["spans"] == got[2]["spans"] == "" and got[1]["base_sha256"] == got[2]["base_sha256"]


def test_tokens_of_empty_texts(edges):
    got = {r["doc_id"]: r for r in tokens(edges).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == got[8]["n_tokens"] == 0 and got[3]["n_tokens"] == 1


def test_lines_pass_other_columns_through(edges):
    out = op4_lines.drop_lines(edges)
    assert out.columns == edges.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] is None and got[2]["text"] == "" and got[3]["text"] == "word" and got[3]["w"] == "x"
    assert got[6]["text"] == PROSE + " eight"  # the earlier of the two
    assert got[7]["text"] == "" and got[7]["n_chars"] == 0
    assert got[None]["text"] == PROSE and got[5]["text"] == LONG


def test_quality_of_empty_texts_and_columns_kept(edges):
    got = {r["doc_id"]: r for r in op5_quality.quality(edges).collect()}
    assert got[1]["n_words"] == got[2]["n_words"] == got[8]["n_words"] == 0 and got[1]["base_failed"]
    assert op5_quality.keep_good(edges).columns == edges.columns


def test_near_duplicates_of_edges(edges):
    got = {(r["doc_id"], r["n_shingles"]): r for r in op7_minhash.near_duplicates(edges).collect()}
    assert got[(1, 0)]["kept"] and got[(2, 0)]["component_id"] == 2 and got[(3, 1)]["kept"]
    assert got[(7, 23)]["component_id"] == 6 and not got[(7, 23)]["kept"]
    assert got[(None, 23)]["component_id"] is None and got[(None, 23)]["kept"]
    assert op7_minhash.keep_one(edges).columns == edges.columns


def test_mixing_never_selects_empty_texts(edges):
    got = mixed(edges).collect()
    assert {r["doc_id"] for r in got} <= {3, 5, 6, 7, None} and all(r["n_tokens"] > 0 for r in got)
    assert op8_mixing.only(edges, mixed(edges)).columns == edges.columns


def test_toxicity_scores_are_bounded(edges):
    got = toxicity(edges).collect()
    assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)


def test_fingerprints_of_edges(edges):
    got = {r["doc_id"]: r for r in op10_fingerprint.edited_fingerprints(edges).collect()}
    assert got[1]["fingerprint"] == "" and got[1]["near_next"] == 1.0 and got[2]["near_next"] == 0.0
    assert got[3]["fingerprint"] != "" and got[7]["n_chars"] == len(PROSE)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got.values())


PAGES = "page_id long, url string, html string, path string, bytes long, text string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", 7, "t") for i, u, h in rows], PAGES)


def test_pages_of_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "a b\r\nc", "<p>x</p>"), (3, "u", "<p>x</p>"), (None, "u", "<p>x</p>"),
            (4, "u", "plain text"), (5, "u", "<div>" * 3000 + "deep"), (6, "u", "<script>never closed"), (7, "u", "<!-- open")]
    table = pages(spark, rows)
    texts = {(r["page_id"], r["url"]): r["text"] for r in op6_html.extract(table).collect()}
    assert len(texts) == len(rows) and texts[(1, "u")] == texts[(2, None)] == texts[(6, "u")] == texts[(7, "u")] == ""
    found = op3_warc.read_archives(spark, op3_warc.archive(table)).collect()
    assert sorted(str(r["page_id"]) for r in found) == sorted(str(i) for i, _, _ in rows)
    same = [r for r in found if r["payload_bytes"] == 8]
    assert [(r["page_id"], r["record_type"]) for r in sorted(same, key=str)].count((3, "response")) == 2
    assert [r["record_type"] for r in same if r["page_id"] is None] == ["response"]
    empty = {r["page_id"]: r for r in found if r["payload_bytes"] == 0}
    assert empty[1]["record_type"] == "response" and empty[2]["refers_to"] == 1


def test_no_pages(spark):
    table = pages(spark, [(1, "u", "x")]).where("false")
    assert op6_html.extract(table).count() == 0
    assert op3_warc.read_archives(spark, op3_warc.archive(table)).count() == 0


def test_null_levels_are_leaves(spark):
    rows = spark.createDataFrame([(1, "a b", None), (2, "a b", "s"), (3, "a b", None)], "doc_id long, text string, source string")
    mix = op8_mixing.Mix(("source",), budget_percent=100)
    assert sorted((r["doc_id"], r["source"]) for r in op8_mixing.select(rows, mix).collect()) == [(1, ""), (2, "s"), (3, "")]
    assert op8_mixing.only(rows, op8_mixing.select(rows, mix)).select(F.max("doc_id")).first()[0] == 3


def test_documents_drawn_are_those_selected_and_texts_stay(spark):
    data = [(k, "w " * (k % 9 + 1) if k % 11 else " ", "en" if k % 3 else None, f"src{k % 5}", k) for k in range(300)]
    docs = spark.createDataFrame([*data, (None, "a b", "en", "src1", 0)], "doc_id long, text string, lang string, source string, n_chars int")
    for percent, epochs in ((40, 1), (90, 2), (200, 3)):
        mix = op8_mixing.Mix(("lang", "source"), budget_percent=percent, max_epochs=epochs)
        got = op8_mixing.drawn(docs, mix)
        assert got.columns == docs.columns and sorted(got.collect(), key=str) == sorted(
            op8_mixing.only(docs, op8_mixing.select(docs, mix)).collect(), key=str
        )
    plan = op8_mixing.drawn(docs, mix)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
