"""Quality rules: a threshold table compiled into one projection of counts and ratios.

Every rule compares a whole-number ratio ``100 * part / whole`` with bounds, so the verdict
is exact integer arithmetic in whole-stage code; there is no user function and no shuffle.

Defined results: a null or empty text has no words and fails the base rule; repeated rows are
judged one by one; a null doc_id is returned as it is; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import computed_once, count_of, has_word, let, lines, texts, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
WINDOW = 3
CAPITALS = "A-Z"
# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that for it with as was on are by this be from or an a "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de des et un une du en que qui dans pour par sur est au avec pas "
    "el los las del y con una se su al lo por es"
).split()
STOP_FORMS = sorted({form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())})


@dataclass(frozen=True)
class Rule:
    """Keep a document where ``least <= 100 * part / whole <= most`` (None: no bound)."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None

    def holds(self) -> Column:
        part, whole = F.col(self.part) * 100, F.col(self.whole)
        ok = F.lit(True)
        if self.least is not None:
            ok = ok & (part >= whole * self.least)
        if self.most is not None:
            ok = ok & (part <= whole * self.most)
        return ok


# Of clean prose in any of the languages, words have 3 to 12 characters, symbols and capitals are rare
# and at least one word in twelve is a function word; the bounds leave room on either side.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 2000),
    Rule("symbols", "n_symbols", "n_words", None, 50),
    Rule("capitals", "n_capitals", "word_chars", None, 40),
    Rule("stop_words", "n_stop_words", "n_words", 4, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 50),
)


def _repeated(grams: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; ``grams`` holds a hash per window start."""
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    twins = let(
        pairs,
        lambda order: F.filter(
            F.transform(
                order,
                lambda x, k: F.when(
                    (x["h"] == F.get(order, k - 1)["h"]) | (x["h"] == F.get(order, k + 1)["h"]), x["p"]
                ),
            ),
            lambda p: p.isNotNull(),
        ),
    )
    # positions ascending: each window adds what the one before it doesn't cover
    covered = F.aggregate(
        F.sort_array(twins),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), covered).otherwise(0).cast("long")


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The counts the rules read, one row per input row."""
    base = texts(docs, *keep)
    parts = base.select(
        *keep,
        "text",
        words(F.col("text")).alias("w"),
        F.filter(lines(F.col("text")), has_word).alias("l"),
    )
    grams = F.when(
        F.size("w") >= WINDOW,
        F.transform(
            F.slice("w", 1, F.size("w") - (WINDOW - 1)),
            lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = parts.select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("l", lambda x: x.endswith("...") | x.endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        count_of(F.col("text"), CAPITALS).alias("n_capitals"),
        F.size(F.filter("w", lambda x: x.isin(STOP_FORMS))).cast("long").alias("n_stop_words"),
        grams.alias("grams"),
    )
    whole = counted.select(
        *(c for c in counted.columns if c != "grams"), _repeated(F.col("grams")).alias("n_repeat_words")
    )
    return computed_once(whole, *keep)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    kept = ~base_failed()
    for rule in rules:
        kept = kept & rule.holds()
    return kept


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the counts, ``base_failed``, the names of the ``broken`` rules and ``kept``."""
    measured = measures(docs)
    broken = F.filter(
        F.array(*(F.when(~rule.holds(), F.lit(rule.name)) for rule in rules)), lambda x: x.isNotNull()
    )
    return measured.select(
        "*", base_failed().alias("base_failed"), broken.alias("broken"), verdict(rules).alias("kept")
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    packed = docs.select(F.struct("*").alias("row"), "text")
    return measures(packed, ("row",)).where(verdict(rules)).select("row.*")
