"""Mixing sources to target weights by hierarchical budgeting.

The levels of a tree (domain, language, source) share a token budget by weights. A node's budget goes to its
children in proportion to their weights, but no child gets more than its subtree can give; what one child leaves is
shared by its siblings before anything goes back to an ancestor's other children. All of that is whole-number
arithmetic on one row per leaf: children in order of capacity per weight, those below the water level take their
capacity and the others split the rest. Each leaf then takes its documents in seeded epochs: whole epochs first, then
the longest prefix of the next epoch's order whose tokens fit.

Prefixes are cut without sorting a leaf in one task: documents fall into 4096 slices of the order's hash, slices are
summed and only rows of one leaf and slice are ordered together, so a hot source is dealt over thousands of groups.

Defined results: a null level value is the leaf "" of its parent; a null or empty text has no tokens and is never
selected; rows that repeat a doc_id are counted row by row, and ``only`` keeps all of them if one is selected; a null
doc_id is ordered like the empty id; an empty table selects nothing; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carepath.llm.common import has_word, stored, texts, words

SLICE_DIGITS = 3  # of the hexadecimal order key: 16^3 slices


@dataclass(frozen=True)
class Mix:
    """Levels from the root down, weights by path of names (1 where none is given), budget and epochs."""

    levels: tuple[str, ...]
    weights: dict[tuple[str, ...], int] = field(default_factory=dict)
    budget_percent: int = 40
    max_epochs: int = 1
    seed: int = 7


def _weight(mix: Mix, depth: int) -> Column:
    given = [(path, w) for path, w in mix.weights.items() if len(path) == depth]
    out = F.lit(1)
    for path, w in given:
        same = F.lit(True)
        for level, name in zip(mix.levels, path, strict=False):
            # a path of one name holds under every parent, a full path only there
            same = same & (F.col(level) == name if name != "*" else F.lit(True))
        out = F.when(same, w).otherwise(out)
    return out.cast("decimal(38,0)")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """The leaves (levels, tokens) with the tokens each is to give (``budget``)."""
    levels = list(mix.levels)
    whole = "decimal(38,0)"
    tree = leaves.select(*levels, F.col("tokens"), (F.col("tokens") * mix.max_epochs).cast(whole).alias("capacity"))
    total = tree.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"))
    # a single row: the root's budget
    above = total.select(F.expr(f"cast(t as decimal(38,0)) * {mix.budget_percent} div 100").cast(whole).alias("budget"))
    for depth in range(1, len(levels) + 1):
        parent, here = levels[: depth - 1], levels[:depth]
        nodes = tree.groupBy(*here).agg(F.sum("capacity").cast(whole).alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(mix, depth))
        nodes = nodes.join(above, parent) if parent else nodes.join(F.broadcast(above), F.lit(True))
        rank = F.col("capacity").cast("double") / F.col("weight").cast("double")
        nodes = nodes.withColumn("rank", rank)
        siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        order = siblings.orderBy("rank", levels[depth - 1])
        before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("before", before.cast(whole)).withColumn("after", after.cast(whole))
        full = F.col("capacity") * F.col("after") <= (F.col("budget") - F.col("before")) * F.col("weight")
        nodes = nodes.withColumn("full", full)
        taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(siblings), F.lit(0)).cast(whole)
        sharing = F.sum(F.when(~F.col("full"), F.col("weight"))).over(siblings).cast(whole)
        nodes = nodes.withColumn("taken", taken).withColumn("sharing", sharing)
        part = F.expr("((budget - taken) * weight) div sharing").cast(whole)
        above = nodes.select(*here, F.when(F.col("full"), F.col("capacity")).otherwise(part).alias("budget"))
    return tree.join(above, levels).select(*levels, "tokens", F.col("budget").cast("long").alias("budget"))


def select(docs: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, levels, n_tokens and copies (1 or more) of every selected document."""
    return _drawn(docs, mix).select("doc_id", *mix.levels, "n_tokens", "copies")


def _drawn(docs: DataFrame, mix: Mix) -> DataFrame:
    """``select`` with the epochs of a document's leaf and the key that it is drawn by."""
    levels = list(mix.levels)
    named = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in levels]
    rows = texts(docs, "doc_id", *levels).select("doc_id", *named, F.size(words(F.col("text"))).cast("long").alias("n_tokens"))
    counted = stored(rows.where("n_tokens > 0"), "mix-tokens")
    leaves = counted.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    plan = stored(budgets(leaves, mix), "mix-budgets").select(
        *levels,
        F.expr("budget div tokens").alias("epochs"),
        F.expr("budget % tokens").alias("rest"),
    )
    # one row per leaf; the size decides how Spark joins it
    placed = counted.join(plan, levels)
    placed = placed.withColumn("key", _key(mix, "epochs")).withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    sums = placed.groupBy(*levels, "slice").agg(F.sum("n_tokens").alias("n"))
    order = Window.partitionBy(*levels).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*levels, "slice", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*levels, "slice").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    cut = placed.join(starts, [*levels, "slice"]).withColumn("end", F.col("start") + F.sum("n_tokens").over(inside))
    copies = (F.col("epochs") + F.when(F.col("end") <= F.col("rest"), 1).otherwise(0)).cast("long")
    return cut.select("doc_id", *levels, "n_tokens", "epochs", "key", copies.alias("copies")).where("copies > 0")


def _key(mix: Mix, epochs: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col(epochs).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def drawn(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of ``docs`` (with the levels as columns) that ``select`` draws, with all their columns, each once.

    A leaf draws its documents in the order of their keys, so the last one drawn says of every row whether it
    is: texts meet one row per leaf and are not shuffled. Rows that share a doc_id are each drawn by their own leaf.
    """
    levels = list(mix.levels)
    last = F.max(F.struct("key", "doc_id")).alias("_last")
    leaves = stored(_drawn(docs, mix).groupBy(*[F.col(c).alias(f"_{c}") for c in levels]).agg(F.max("epochs").alias("_epochs"), last), "mix-last")
    same = [F.coalesce(F.col(c), F.lit("")) == F.col(f"_{c}") for c in levels]
    met = docs.where(has_word(F.col("text"))).join(leaves, reduce(and_, same))
    return met.where(F.struct(_key(mix, "_epochs").alias("key"), "doc_id") <= F.col("_last")).select(*docs.columns)


def only(docs: DataFrame, selected: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is in ``selected``, with all their columns, each once."""
    chosen = stored(selected.select(F.col("doc_id").alias("chosen_id")).distinct(), "mix-chosen")
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["chosen_id"]), "left_semi")


def domain() -> Column:
    return F.when(F.col("source") == "src0", "crawl").when(F.col("source").rlike("[02468]$"), "books").otherwise("forums")


def with_domain(docs: DataFrame) -> DataFrame:
    """doc_id, text, domain, lang, source: the domain of the test tables' sources, by a fixed rule."""
    return docs.select("doc_id", "text", domain().alias("domain"), "lang", "source")


LEVELS = ("domain", "lang", "source")
# Target weights of the registered query and the pipeline: a path's "*" stands for every parent.
WEIGHTS = {("crawl",): 2, ("books",): 5, ("forums",): 3, ("*", "en"): 4, ("*", "de"): 2, ("*", "fr"): 2, ("*", "es"): 2}
PRODUCTION = Mix(LEVELS, WEIGHTS, budget_percent=90, max_epochs=2)
# The pipeline mixes as the query does; a document chosen twice is encoded once.
PIPELINE = PRODUCTION
