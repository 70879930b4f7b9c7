"""Near-duplicate documents by min-max hashing of five-word shingles.

Each permutation is evaluated once per shingle and gives two values of the signature, the least and the greatest
hash: both agree between two sets with the probability of their similarity, so 192 permutations make 384 values and
64 bands of six. Two sets of similarity 0.75 share no band with probability (1 - 0.75^6)^64, about 4e-6. One bit of
every value makes a sketch of 384 bits, of which such sets differ in 48 on average (standard deviation 6.5); pairs
that differ by over seven deviations more are not compared further.

Documents with equal sets are one class from the start. Classes that share a band are compared on their full sets, in
two rounds whose work grows with the number of classes and not with the square of a group's:

1. Bands are used in three groups, few first. In each bucket a class is paired with the smallest class only, with
   one such head per component, and only while the two are still in different components.
2. The classes of buckets that still hold several components are joined exactly: shingles are ordered by how many of
   these classes have them, and two sets of similarity 0.75 share one of the rarest 1/4 of the larger set's and 1/7 of
   the smaller set's (with size and position bounds). Near misses that differ in more than a seventh of their
   shingles have only their own ones there and are never paired, however many of them share a bucket.

Nothing of all documents meets in a task or the driver: signatures, buckets and edges are rows that Spark shuffles by
band, class, shingle or document, and components are found by rounds of hooking and pointer jumping on stored tables.

Defined results: documents without a word have an empty set, are linked with nothing and kept; fewer words than
a shingle form one; rows with the same doc_id are one document for links, each row being returned; a null doc_id
takes no part, has a null component and is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import SHINGLE_WORDS, stored, texts
from carepath.llm.graph import components

PERCENT = 75
PERMUTATIONS = 192
BAND_ROWS = 6
DEVIATIONS = 7.4
SEED = 20_240_501
WORKER_WORDS = 500_000
BLOCK = 4096
# The bands of the first round's three groups end here; buckets are made of SLICE bands at a time.
BAND_GROUPS = (4, 16, 64)
SLICE = 16


class Shingler:
    """The 64-bit hashes of a text's distinct word shingles."""

    def __init__(self, width: int = SHINGLE_WORDS):
        import numpy as np
        import xxhash

        self.width = width
        rng = np.random.default_rng(SEED)
        self.factors = rng.integers(0, 2**63, width, np.uint64) * np.uint64(2) + np.uint64(1)
        digest = xxhash.xxh3_64_intdigest

        class Hashes(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) > WORKER_WORDS:
                    self.clear()
                self[word] = value = digest(word)
                return value

        self.hashes = Hashes()

    def __call__(self, text: str):
        """Ascending distinct hashes; bytes.lower and bytes.split know only ASCII letters and white space."""
        import numpy as np

        found = text.encode().lower().split()
        if not found:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))
        width = min(self.width, len(h))
        mixed = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            mixed += h[k : len(h) - width + 1 + k] * self.factors[k]
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            mixed ^= mixed >> np.uint64(shift)
            mixed *= np.uint64(factor)
        return np.unique(mixed ^ (mixed >> np.uint64(33)))


class MinMax:
    """Band keys of a set: least and greatest value under each permutation, four values to a band."""

    def __init__(self, permutations: int = PERMUTATIONS, rows: int = BAND_ROWS):
        import numpy as np

        rng = np.random.default_rng(SEED + 1)
        draw = lambda n: rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.a, self.b = (draw(permutations).astype(np.uint32) for _ in range(2))
        self.band = draw(2 * permutations)
        self.rows = rows
        # the two values of a permutation go to different bands
        self.order = rng.permutation(2 * permutations)

    def signature(self, shingles):
        """Least and greatest value of 32 bits under each permutation."""
        import numpy as np

        short = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), np.iinfo(np.uint32).max, np.uint32)
        high = np.zeros(len(self.a), np.uint32)
        for at in range(0, len(short), BLOCK):
            values = short[at : at + BLOCK, None] * self.a[None, :]
            values += self.b[None, :]
            np.minimum(low, values.min(axis=0), out=low)
            np.maximum(high, values.max(axis=0), out=high)
        return np.concatenate([low, high])

    def bands(self, shingles):
        """Band keys, and one bit of every value in words of 64."""
        import numpy as np

        values = (self.signature(shingles).astype(np.uint64) * self.band)[self.order]
        keys = values.reshape(-1, self.rows).sum(axis=1, dtype=np.uint64)
        keys += np.arange(len(keys), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bits = np.packbits((values >> np.uint64(47)).astype(np.uint8) & 1).view(np.int64)
        return (keys ^ (keys >> np.uint64(31))).view(np.int64), bits


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets, null for empty ones), the band keys and the bits."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        shingles, family = Shingler(), MinMax()
        empty = np.empty(0, np.int64)
        for batch in batches:
            sizes, keys, bands, bits = [], [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py())
                sizes.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest() if len(found) else None)
                both = family.bands(found) if len(found) else (empty, empty)
                bands.append(both[0])
                bits.append(both[1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.string()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(bits, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_key", "bands", "bits"],
            )

    return texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id").mapInArrow(
        run, "doc_id long, n_shingles long, set_key string, bands array<long>, bits array<long>"
    )


def shingle_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The full shingle sets of the documents in ``chosen`` (node)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shingles = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [shingles(t.as_py()).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"]
                )

    rows = texts(docs.select(F.col("doc_id").cast("long").alias("node"), "text"), "node")
    return rows.join(chosen, "node", "left_semi").mapInArrow(run, "node long, shingles array<long>")


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b")
    common = both.select("a", "b", F.size("left").alias("n"), F.size("right").alias("m"),
                         F.size(F.array_intersect("left", "right")).alias("c"))
    return common.where(F.col("c") * 100 >= (F.col("n") + F.col("m") - F.col("c")) * percent).select("a", "b")


def _may_be_similar(percent: int) -> Column:
    """Sets of n and m shingles and bits x and y: the sizes allow the similarity and the bits don't speak against it."""
    share = (1 - percent / 100) / 2
    bits = 2 * PERMUTATIONS
    most = int(bits * share + DEVIATIONS * (bits * share * (1 - share)) ** 0.5)
    differing = F.lit(0)
    for k in range(bits // 64):
        differing = differing + F.bit_count(F.get("x", F.lit(k)).bitwiseXOR(F.get("y", F.lit(k))))
    return (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & (differing <= most)


def _buckets(classes: DataFrame) -> DataFrame:
    """band, bucket, node, head (the bucket's smallest node) of all buckets with several classes, some bands at a time."""
    found = None
    for start in range(0, 2 * PERMUTATIONS // BAND_ROWS, SLICE):
        members = classes.select("node", F.posexplode(F.slice("bands", start + 1, SLICE)).alias("at", "bucket"))
        shared = members.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last")
        inside = members.join(shared.select("bucket", "head"), "bucket")
        inside = stored(inside.select((F.col("at") + start).alias("band"), "bucket", "node", "head"), "buckets")
        found = inside if found is None else found.unionByName(inside)
    return found


def _with_component(rows: DataFrame, found: DataFrame, node: str, component: str) -> DataFrame:
    return rows.join(found.toDF(node, component), node, "left").withColumn(component, F.coalesce(component, node))


def _rare_prefix_pairs(sets: DataFrame, components_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of two components that may be similar, by the rarest shingles of both sets.

    With the percentage p, sets x and y, y not the larger, of similarity p have at least p/100 of x and 2p/(100 + p) of y
    in common; so one of the rarest |x| - that + 1 shingles of x is among the rarest |y| - that + 1 of y.
    """
    # rows that share a doc_id may have several sets; a set is hashed once, before it is spread
    whole = sets.select("node", F.xxhash64("shingles").alias("which"), F.size("shingles").alias("n"), "shingles")
    spread = whole.select("node", "which", "n", F.explode("shingles").alias("shingle"))
    often = spread.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    ordered = spread.join(often, "shingle").groupBy("node", "which", "n").agg(
        F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("ordered")
    )
    need = lambda part, whole: F.ceil(F.col("n") * part / whole).cast("int")
    probe = F.col("n") - need(percent, 100) + 1
    index = F.col("n") - need(2 * percent, 100 + percent) + 1
    cut = ordered.select("node", "n", index.alias("index"), F.posexplode(F.slice("ordered", F.lit(1), probe)).alias("pos", "s"))
    # what no other set has meets nothing
    cut = cut.where("s.often > 1").select("node", "n", "index", "pos", F.col("s.shingle").alias("shingle"))
    cut = stored(_with_component(cut, components_, "node", "component"), "prefixes")
    large = cut.select("shingle", F.col("node").alias("a"), F.col("n").alias("n"), F.col("pos").alias("i"), F.col("component").alias("p"))
    small = cut.where(F.col("pos") < F.col("index")).select(
        "shingle", F.col("node").alias("b"), F.col("n").alias("m"), F.col("pos").alias("j"), F.col("component").alias("q")
    )
    sized = (F.col("m") * 100 >= F.col("n") * percent) & ((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("b") < F.col("a"))))
    # from their first common shingle on, both sets must have enough left
    left = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) * (100 + percent) >= (F.col("n") + F.col("m")) * percent
    met = large.join(small, (large["shingle"] == small["shingle"]) & (F.col("p") != F.col("q")) & sized & left)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept, one row per row."""
    sketched = stored(sketches(docs), "sketches")
    usable = sketched.where("set_key is not null and doc_id is not null")
    classes = stored(
        usable.groupBy("set_key").agg(
            F.min("doc_id").alias("node"),
            F.max("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
            F.first("bits").alias("bits"),
        ),
        "classes",
    )
    inside = _buckets(classes)
    sets = stored(shingle_sets(docs, inside.select("node").distinct()), "shingles")
    facts = classes.select("node", "n", "bits")
    links = found = tested = None
    for low, high in zip((0, *BAND_GROUPS), BAND_GROUPS, strict=False):
        pairs = inside.where((F.col("band") >= low) & (F.col("band") < high) & (F.col("node") > F.col("head")))
        pairs = pairs.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
        if found is not None:
            pairs = _with_component(_with_component(pairs, found, "a", "p"), found, "b", "q")
            pairs = pairs.where("p <> q").groupBy("p", "b").agg(F.min("a").alias("a")).select("a", "b")
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        known = pairs.join(facts.toDF("a", "n", "x"), "a").join(facts.toDF("b", "m", "y"), "b")
        candidates = stored(known.where(_may_be_similar(percent)).select("a", "b"), "pairs")
        tested = candidates if tested is None else tested.unionByName(candidates)
        more = stored(_confirmed(sets, candidates, percent), "links")
        links = more if links is None else links.unionByName(more)
        found = components(links)

    # what two components of a bucket may still have in common
    placed = _with_component(inside.select("bucket", "node"), found, "node", "component")
    split = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    apart = stored(placed.join(split.select("bucket"), "bucket", "left_semi").select("node").distinct(), "apart")
    rest = stored(_rare_prefix_pairs(sets.join(apart, "node", "left_semi"), found, percent), "pairs")
    more = stored(_confirmed(sets, rest, percent), "links")
    found = components(links.unionByName(more))

    # joined on the size as well, so that a hot class is dealt by both and can be split
    named = classes.select("set_key", F.col("n").alias("n_shingles"), "node").join(found, "node", "left")
    named = stored(named.select("set_key", "n_shingles", F.coalesce("component", "node").alias("component_id")), "named")
    out = sketched.select("doc_id", "n_shingles", "set_key").join(named, ["set_key", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group does, with all their columns."""
    dropped = stored(near_duplicates(docs, percent).where("not kept").select("doc_id").distinct(), "dropped")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
