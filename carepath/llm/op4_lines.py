"""Line deduplication by a deletion-neighbourhood join.

Lines are sequences of words; two lines are duplicates if they are equal or one edited word (inserted, deleted or
changed) apart. A line goes if an earlier one, by (doc_id, line number), is its duplicate; everything else stays
where it is. Every line with at least ``least`` words is judged, by default every one with a word, written with spaces
or without. Lines of fewer than ``MIN_WORDS`` words have equals only: in so short a line one edited word is another line.

1. Equal lines meet on a 128-bit hash; the earliest stands for them.
2. A line one edit from another shares its first or its last half with it. Lines that share no half with a
   different line have no neighbour and need no variants; this loses nothing.
3. Each remaining line emits its variants with one word deleted as hashed keys, computed from running sums in
   time linear in the line. Equal variants that lack the word at the same place are one substitution apart; a
   variant equal to a whole line is one insertion apart. A key's group passes on only its earliest line, so a
   template with a million fillings gives a million rows and no pairs.
4. Each line's earliest neighbour found that way is verified word by word on the texts.

Defined results: a null or empty text has one empty line, which stays; repeated rows are told apart by nothing, so
both copies of a row with the same doc_id lose or keep the same lines; a null doc_id comes after every other and its
lines never stand for others' ; an empty table gives no rows; other columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.functions.sieve import likely
from carepath.llm.common import NOT_WHITE, WHITE, computed_once, let, lines, running_sums, stored, texts, words

MIN_WORDS = 8
LEAST = 1
# A place is doc_id times LINES plus the line's number; a null doc_id counts as NO_DOC, one beyond the longs.
LINES = 2**31
NO_DOC = str(2**63)
# What a key stands for: a whole line, one without a word, one with a word masked.
WHOLE, GAP, CHANGE = 0, 1, 2
# The two largest primes below 2^31; sums and products of residues fit in a long.
PRIMES = (2147483647, 2147483629)


def is_judged(line: Column, least: int = LEAST) -> Column:
    """Whether a line has ``least`` words, by a pattern that never goes back."""
    return line.rlike(f"(?:{NOT_WHITE}++{WHITE}++){{{least - 1}}}{NOT_WHITE}" if least > 1 else NOT_WHITE)


def _numbered(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, line_no, w: the lines with enough words."""
    rows = texts(docs, "doc_id").select("doc_id", F.posexplode_outer(lines(F.col("text"))).alias("line_no", "line"))
    # judged by pattern: a filter on the words would split every line a second time
    return rows.where(is_judged(F.col("line"), least)).select("doc_id", "line_no", words(F.col("line")).alias("w"))


def _half_keys(hashes: Column) -> Column:
    """Of a line of n words, its head and tail as a line of n words, and as a neighbour of one of n - 1 has them.

    Lines of fewer than MIN_WORDS words have none.
    """
    n = F.size(hashes)

    def halves(length: Column) -> list[Column]:
        head = F.floor(length / 2).cast("int")
        tail = length - head
        return [
            F.xxhash64(F.lit("head"), length, F.slice(hashes, 1, head)),
            F.xxhash64(F.lit("tail"), length, F.slice(hashes, n - tail + 1, tail)),
        ]

    return F.when(n >= MIN_WORDS, F.array(*halves(n), *halves(n - 1))).otherwise(F.array().cast("array<bigint>"))


def _place() -> Column:
    """doc_id and line_no as one decimal of the same order; a null doc_id comes after every other."""
    doc = F.coalesce(F.col("doc_id").cast("long").cast("decimal(20,0)"), F.lit(NO_DOC).cast("decimal(20,0)"))
    return doc * F.lit(LINES).cast("decimal(10,0)") + F.col("line_no").cast("decimal(10,0)")


def _first() -> Column:
    """The struct (unknown, doc_id, line_no) back from ``place``."""
    line_no = F.pmod(F.col("place"), F.lit(LINES).cast("decimal(10,0)"))
    unknown = F.col("place") >= F.lit(NO_DOC).cast("decimal(20,0)") * F.lit(LINES).cast("decimal(10,0)")
    doc_id = F.when(~unknown, F.call_function("div", F.col("place") - line_no, F.lit(LINES).cast("decimal(10,0)")))
    return F.struct(unknown.alias("unknown"), doc_id.alias("doc_id"), line_no.cast("int").alias("line_no"))


def distinct_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """h1, h2 (a line's hash), first (struct of doc_id and line_no of its earliest occurrence) and its half keys."""
    hashed = _numbered(docs, least).select("doc_id", "line_no", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    keyed = hashed.select(
        "doc_id",
        "line_no",
        F.xxhash64("h").alias("h1"),
        F.xxhash64(F.lit("second"), F.col("h")).alias("h2"),
        _half_keys(F.col("h")).alias("halves"),
    ).select("h1", "h2", _place().alias("place"), *[F.get("halves", F.lit(k)).alias(f"half{k}") for k in range(4)])
    # numbers only, so that equal lines are found by hashing and not by sorting
    halves = [F.first(f"half{k}").alias(f"half{k}") for k in range(4)]
    found = keyed.groupBy("h1", "h2").agg(F.min("place").alias("place"), *halves)
    return found.select("h1", "h2", _first().alias("first"), F.array_compact(F.array(*[f"half{k}" for k in range(4)])).alias("halves"))


def _variants(hashes: Column) -> Column:
    """A struct of ``whole``, the line's key, and ``without``, the key without each word, in order.

    A key is two sums of word hash times a factor of the word's place, one modulo each prime; without word i the
    words behind it stand one place earlier.
    """

    def sums(prime: int, seed: str) -> Column:
        factor = lambda place: F.pmod(F.xxhash64(F.lit(seed), place), F.lit(prime))
        here = F.transform(hashes, lambda h, i: (F.pmod(h, F.lit(prime)) * factor(i)) % prime)
        moved = F.transform(hashes, lambda h, i: (F.pmod(h, F.lit(prime)) * factor(i - 1)) % prime)
        return let(
            running_sums(here, prime),
            lambda t: let(
                running_sums(moved, prime),
                lambda u: F.struct(
                    F.element_at(t, -1).alias("whole"),
                    F.transform(
                        hashes, lambda h, i: (F.get(t, i) + F.element_at(u, -1) - F.get(u, i + 1) + prime) % prime
                    ).alias("without"),
                ),
            ),
        )

    pair = lambda a, b: a * (1 << 31) + b
    return let(
        sums(PRIMES[0], "a"),
        lambda a: let(
            sums(PRIMES[1], "b"),
            lambda b: F.struct(
                pair(a["whole"], b["whole"]).alias("whole"),
                F.zip_with(a["without"], b["without"], pair).alias("without"),
            ),
        ),
    )


def one_edit_apart(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by one changed, inserted or deleted word, or by none."""
    same = F.size(a) == F.size(b)
    changed = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d))

    def inserted(long: Column, short: Column) -> Column:
        equal = F.zip_with(long, short, lambda x, y: x.eqNullSafe(y))
        # the arrays are equal up to the first difference, and behind it with one word left out
        return let(
            F.array_position(equal, False).cast("int"),
            lambda at: F.slice(long, at + 1, F.size(long)) == F.slice(short, at, F.size(short)),
        )

    return (
        F.when(same, changed <= 1)
        .when(F.size(a) == F.size(b) + 1, inserted(a, b))
        .when(F.size(b) == F.size(a) + 1, inserted(b, a))
        .otherwise(False)
    )


def duplicate_lines(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The distinct lines (h1, h2, first) that stay, and those one edit after an earlier one (with its place)."""
    unique = stored(distinct_lines(docs, least), "lines")
    # rows without a shared half, or variant key, go before the shuffle
    halves = unique.select("h1", "h2", "first", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("half")
    shared = stored(shared, "line-halves")
    near = likely(halves, shared, ["half"]).join(shared, "half", "left_semi").select("h1", "h2", "first")
    wanted = stored(near.dropDuplicates(["h1", "h2"]), "line-candidates")

    # the candidates' words, from the document of each one's earliest occurrence
    by_doc = wanted.where("first.doc_id is not null").select(F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"), "h1", "h2")
    listed = by_doc.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "h1", "h2")).alias("wanted"))
    # a text is cut into lines once, however many of them are wanted; a line into words once
    picked = lambda all_: F.transform("wanted", lambda x: F.struct(x["h1"], x["h2"], x["line_no"], F.get(all_, x["line_no"]).alias("line")))
    found = likely(texts(docs, "doc_id"), by_doc, ["doc_id"]).join(listed, "doc_id").select("doc_id", F.inline_outer(let(lines(F.col("text")), picked)))
    spelled = computed_once(found.select("doc_id", "h1", "h2", "line_no", words(F.col("line")).alias("w")), "doc_id", "h1", "h2", "line_no")
    # of rows that share a doc_id, the one meant
    spelled = spelled.where(F.xxhash64(F.transform("w", lambda x: F.xxhash64(x))) == F.col("h1"))
    # stored with the variants, which are read twice
    spelled = spelled.withColumn("place", _place()).dropDuplicates(["h1", "h2"]).withColumn("v", _variants(F.transform("w", lambda x: F.xxhash64(x))))
    spelled = stored(spelled, "line-words")
    # roles and places are numbers, so that keys meet by hashing and not by sorting
    keyed = spelled.select("h1", "h2", F.col("place").alias("at"), F.size("w").alias("n"), "v")
    roles = F.concat(
        F.array(F.struct(F.lit(WHOLE).alias("role"), F.xxhash64(F.lit("gap"), F.col("n")).alias("k1"), F.col("v.whole").alias("k2"))),
        F.transform("v.without", lambda v: F.struct(F.lit(GAP).alias("role"), F.xxhash64(F.lit("gap"), F.col("n") - 1).alias("k1"), v.alias("k2"))),
        F.transform("v.without", lambda v, i: F.struct(F.lit(CHANGE).alias("role"), F.xxhash64(F.lit("change"), F.col("n"), i).alias("k1"), v.alias("k2"))),
    )
    emitted = keyed.select("h1", "h2", "at", F.explode_outer(roles).alias("r")).select("h1", "h2", "at", "r.*")
    keys = emitted.select(F.xxhash64("k1", "k2").alias("key"), "h1")
    several = keys.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key")
    several = stored(several, "line-keys")
    emitted = stored(likely(emitted.withColumn("key", F.xxhash64("k1", "k2")), several, ["key"]).drop("key"), "line-variants")
    of = lambda role: F.min(F.when(F.col("role") == role, F.col("at")))
    groups = (
        emitted.groupBy("k1", "k2")
        .agg(of(WHOLE).alias("whole"), of(GAP).alias("gap"), of(CHANGE).alias("change"), F.min("h1").alias("lo"), F.max("h1").alias("hi"))
        .where("lo <> hi")
    )
    met = emitted.join(groups.drop("lo", "hi"), ["k1", "k2"])
    other = F.when(F.col("role") == WHOLE, F.col("gap")).when(F.col("role") == GAP, F.col("whole")).otherwise(F.col("change"))
    earliest = (
        met.select("h1", "h2", "at", other.alias("other"))
        .where("other < at")
        .groupBy("h1", "h2")
        .agg(F.min("other").alias("other"))
    )
    mine = earliest.join(spelled.select("h1", "h2", "w"), ["h1", "h2"])
    theirs = spelled.select(F.col("place").alias("other"), F.col("w").alias("w2"))
    verified = mine.join(theirs, "other").where(one_edit_apart(F.col("w"), F.col("w2")))
    gone = stored(verified.select("h1", "h2", F.col("other").alias("place")).select("h1", "h2", _first().alias("other")), "lines-gone")
    kept = unique.select("h1", "h2", "first").join(gone, ["h1", "h2"], "left_anti")
    return kept, gone


def line_report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_judged (lines with enough words) and n_removed (those that drop_lines drops), one row per doc_id."""

    def judged(text: Column) -> Column:
        return F.size(F.filter(lines(text), lambda line: is_judged(line, least)))

    text = F.col("text")
    counted = texts(docs, "doc_id").select("doc_id", "text", F.size(lines(text)).alias("n"), judged(text).alias("judged"))
    cleaned = drop_lines(counted, least).select("doc_id", "n", "judged", judged(text).alias("left"))
    totals = cleaned.groupBy("doc_id").agg(F.sum("n").alias("n_lines"), F.sum("judged").alias("n_judged"), F.sum("left").alias("n_left"))
    return totals.select("doc_id", "n_lines", "n_judged", (F.col("n_judged") - F.col("n_left")).alias("n_removed"))


def drop_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with all its columns, the texts without duplicate lines; ``n_chars`` follows where there is one.

    A text none of whose lines goes stays as it is, null included. A row left without any line has the empty text.
    """
    kept, _ = duplicate_lines(docs, least)
    stays = kept.groupBy(F.col("first.doc_id").alias("kept_id")).agg(F.collect_set("first.line_no").alias("kept_lines"))
    packed = docs.select(F.struct("*").alias("row"))
    joined = packed.join(stays, F.col("row.doc_id") == F.col("kept_id"), "left")

    def stay(line: Column, i: Column) -> Column:
        return ~is_judged(line, least) | F.coalesce(F.array_contains("kept_lines", i), F.lit(False)) | F.col("row.doc_id").isNull()

    left = F.array_join(F.filter(lines(F.col("row.text")), stay), "\n")
    cleaned = joined.select("row", left.alias("cleaned"))
    out = {c: F.col("row")[c] for c in docs.columns}
    out["text"] = F.col("cleaned")
    if "n_chars" in out:
        out["n_chars"] = F.coalesce(F.length("cleaned").cast(docs.schema["n_chars"].dataType), out["n_chars"])
    return cleaned.select(*(column.alias(name) for name, column in out.items()))
