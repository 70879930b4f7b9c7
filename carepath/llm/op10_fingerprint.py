"""Document fingerprints as threshold-scaled sketches.

Of a text's word-shingle hashes (48 bits) every one below a fixed fraction of their range is kept, FRACTION unless
given. A hash is kept or not whatever text it is in, so sketches of parts merge by union, and the share of the smaller
sketch found in the larger one estimates containment, however unequal two documents are; with k hashes in the smaller
sketch the standard error is about sqrt(c (1 - c) (1 - fraction) / k) for containment c. A text of fewer words than a
shingle has one hash.

A text with words may have no hash below the fraction (at FRACTION a half one in two texts of one shingle, one in 32
of five). Its fingerprint is then a mark and one hash of all its shingles: equal texts still have equal fingerprints,
but the mark takes no part in merging, and its likeness is 1 to an equal mark and 0 to anything else.

The next document of each, by ascending doc_id, is found without sorting the table in one place: approximate
percentiles of doc_id cut it into ranges, a doc_id that fills several ranges (and the null ones) by the hash of the
text as well; each range is ordered by itself, and the last row of a range gets the first row of the next range that
has rows (the table's first after the last).

Defined results: a null or empty text is empty and has an empty fingerprint; two empty fingerprints have likeness 1,
an empty and another 0; rows that repeat a doc_id follow each other in order of a hash of their texts; null doc_ids
come first; a table of one row is its own next document; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carepath.llm.common import SHINGLE_WORDS, let, texts, words

BITS = 48
FRACTION = 0.5
RANGE_ROWS = 1000
MAX_RANGES = 10_000
MARK = "="


def shingle_hashes(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """Ascending distinct hashes of all of a text's shingles (array of long)."""
    range_mask = F.lit((1 << BITS) - 1)

    def shingles(hashes: Column) -> Column:
        many = F.transform(
            F.slice(hashes, 1, F.greatest(F.size(hashes) - (width - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *(F.get(hashes, i + k) for k in range(1, width))).bitwiseAND(range_mask),
        )
        few = F.when(
            F.size(hashes) > 0, F.array(F.xxhash64(F.concat_ws(" ", F.transform(hashes, lambda h: h.cast("string")))).bitwiseAND(range_mask))
        ).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(hashes) >= width, many).otherwise(few)

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda h: F.sort_array(F.array_distinct(shingles(h))))


def sketch(text: Column, fraction: float = FRACTION, width: int = SHINGLE_WORDS) -> Column:
    """(kept, mark): the ascending hashes below the fraction; where a text with words has none, a hash of all."""
    if not 0 < fraction <= 1:
        raise ValueError(f"a fraction is above 0 and at most 1, got {fraction}")
    below = F.lit(int(fraction * (1 << BITS)))

    def scaled(hashes: Column) -> Column:
        kept = F.filter(hashes, lambda h: h < below)
        mark = F.when((F.size(kept) == 0) & (F.size(hashes) > 0), F.xxhash64(hashes).bitwiseAND(F.lit((1 << BITS) - 1)))
        return F.struct(kept.alias("kept"), mark.alias("mark"))

    return let(shingle_hashes(text, width), scaled)


def merged(a: Column, b: Column) -> Column:
    """The kept hashes of two texts together (shingles across their border are not in it); marks take no part."""
    return F.sort_array(F.array_union(a["kept"], b["kept"]))


def likeness(a: Column, b: Column) -> Column:
    """The share of the smaller sketch that the larger one has: estimated containment."""
    x, y = F.size(a["kept"]), F.size(b["kept"])
    smaller = F.least(x, y)
    return (
        F.when(F.greatest(x, y) == 0, F.when(a["mark"].eqNullSafe(b["mark"]), 1.0).otherwise(0.0))
        .when(smaller == 0, 0.0)
        .otherwise(F.size(F.array_intersect(a["kept"], b["kept"])) / smaller)
    )


def as_string(made: Column) -> Column:
    digits = lambda h: F.lpad(F.hex(h), BITS // 4, "0")
    kept = F.array_join(F.transform(made["kept"], digits), "")
    return F.when(made["mark"].isNotNull(), F.concat(F.lit(MARK), digits(made["mark"]))).otherwise(kept)


def _cuts(bounds: list[int], n_null: int) -> list[tuple]:
    """Ascending (doc_id, tie) where ranges begin; an id that is several percentiles is cut by its ties."""
    parts = lambda n: [(k << 64) // n - (1 << 63) for k in range(1, n)]
    cuts = [(None, tie) for tie in parts(max(1, -(-n_null // RANGE_ROWS)))]
    for value in sorted(set(bounds)):
        many = bounds.count(value)
        cuts += [(value, -(1 << 63)), *((value, tie) for tie in parts(many))]
    return cuts


def _range_of(cuts: list[tuple]) -> Column:
    """How many cuts are at most (doc_id, tie), by binary search; a null doc_id is below every other."""
    if not cuts:
        return F.lit(0)
    steps, step = [], 1
    while step <= len(cuts):
        steps.insert(0, step)
        step *= 2
    lowest = -(1 << 63)
    given, ids, ties = (F.lit(list(c)) for c in zip(*((v is not None, lowest if v is None else v, t) for v, t in cuts), strict=True))
    known, tie = F.col("doc_id").isNotNull(), F.col("tie")
    value = F.coalesce(F.col("doc_id"), F.lit(lowest))

    def at_most(k: Column) -> Column:
        g, i, t = F.get(given, k), F.get(ids, k), F.get(ties, k)
        same = (g == known) & (i == value)
        return (~g & known) | ((g == known) & (i < value)) | (same & (t <= tie))

    return F.aggregate(
        F.lit(steps), F.lit(0), lambda at, s: F.when(F.coalesce(at_most(at + s - 1), F.lit(False)), at + s).otherwise(at)
    )


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text. Sketches are larger than the texts and made after the shuffle."""
    rows = texts(docs, F.col("doc_id").cast("long").alias("doc_id")).withColumn("tie", F.xxhash64("text"))
    counts = docs.agg(F.count("doc_id").alias("n"), F.count(F.lit(1)).alias("all")).first()
    parts = min(MAX_RANGES, -(-counts["n"] // RANGE_ROWS))
    bounds: list[int] = []
    if parts > 1:
        shares = [k / parts for k in range(1, parts)]
        bounds = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, 20 * MAX_RANGES)).first()[0]
    place = _range_of(_cuts(bounds, min(counts["all"] - counts["n"], MAX_RANGES * RANGE_ROWS))).cast("int")
    placed = rows.select("doc_id", "tie", "text", place.alias("place"))

    # the first row of each range, and the range before it; at most twice MAX_RANGES rows
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")
    ids = placed.groupBy("place").agg(F.min(key).alias("first"))
    ring = Window.partitionBy(F.lit(0)).orderBy("place")
    ids = ids.select(
        F.col("first.doc_id").alias("first_id"),
        F.col("first.tie").alias("first_tie"),
        F.coalesce(F.lag("place").over(ring), F.max("place").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"),
    )
    opening = (
        rows.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie")))
        .groupBy("before")
        .agg(F.min("text").alias("opening"))
        .select(F.col("before").alias("place"), "opening")
    )
    order = Window.partitionBy("place").orderBy(F.asc_nulls_first("doc_id"), "tie", "text")
    led = placed.select("doc_id", "text", "place", F.lead("text").over(order).alias("next_text"))
    end = F.col("next_text").isNull()
    joined = led.alias("l").join(opening.alias("o"), (F.col("l.place") == F.col("o.place")) & end, "left")
    return joined.select("doc_id", "text", F.coalesce("next_text", "opening").alias("next_text"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's, and how alike they and the next document's are."""
    half = F.expr("cast(floor(length(text) / 2) as int)")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)
    )
    both = with_next(docs).select("doc_id", "text", "next_text", edited.alias("edited"))
    both = both.select(
        "doc_id",
        "text",
        "edited",
        sketch(F.col("text")).alias("kept"),
        sketch(F.col("next_text")).alias("next_kept"),
        sketch(F.col("edited")).alias("edited_kept"),
    )
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("kept")).alias("fingerprint"),
        as_string(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("kept"), F.col("edited_kept")).alias("near_edited"),
        likeness(F.col("kept"), F.col("next_kept")).alias("near_next"),
    )
