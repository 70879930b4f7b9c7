"""Prefix trie of conversations by hashing blocks of a fixed number of turns.

Every turn is hashed once (SHA-256 of role and text, 128 bits kept); texts go no further. A conversation's turns are
cut into blocks of BLOCK_TURNS turns. The key of a prefix is four sums, over its turns, of hashes of place and turn,
each modulo the same prime; it is additive, so the key at every block border comes from running totals of the blocks'
sums. Conversations are first grouped by (key before the block, block): equal blocks after equal prefixes become one
row with the number of conversations and the smallest of them. Only where different blocks follow the same prefix are
the turn borders inside those blocks grouped again; a block without siblings is a plain chain of nodes, each with the
block's conversations.

A node is named by its smallest member and its depth. Nodes with the same smallest member form a chain down to that
conversation's end, which hangs on a node of a chain with a smaller one. Sums over subtrees are passed up from chain
to chain, one row per chain and step, as many steps as chains hang on each other, and then added up along each chain
from its end. The digest of the conversations that end at a node is fed from their sorted ids, one after another;
SHA-256 has an order, so the ids of one node (eight bytes each) pass through one task, as a stream and never as a list.

No conversation has to fit into a task: turns are numbered, and totals along conversations and chains are made, by
ranges of turns (functions.prefix). Prefixes that many conversations share are combined in the map tasks.

Defined results: rows with a null conv_id belong to no conversation; turns that tie go in order of their hash (equal
rows are turns of their own); a null role or text is empty; a conversation without turns after rebuilding is a
member of the root alone; a table without conversations gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.functions.prefix import running_totals
from carepath.llm.common import stored

BLOCK_TURNS = 4
FAMILY = 100
MOST_HEAD = 5
# Fixed value: the largest prime below 2^31; sums of four billion residues fit in a long.
PRIME = 2147483647
PARTS = ("p0", "p1", "p2", "p3")
TIE_SEED = 13


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, k (place from 0), d (hash of role and text), chars (code points of the text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.substring(digest, 1, 32).alias("d"),
        F.length(text).cast("long").alias("chars"),
        F.rand(TIE_SEED).alias("tie"),
    )
    return running_totals(turns, ["conv_id"], ["turn", "d", "tie"], {"k": F.lit(1)}).select("conv_id", "k", "d", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id), and their rebuilt turns (conv_id, pos, d, chars).

    A conversation starts with the first h turns of its family's first conversation, at most MOST_HEAD, and goes on
    with its own behind the first h; h comes from its id.
    """
    heads = turns.where(F.col("k") < MOST_HEAD)
    counts = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).alias("n"))
    ids = turns.select("conv_id").distinct()
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_HEAD + 1)
    convs = ids.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    convs = convs.join(counts, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("n_head"))
    convs = stored(convs, "conversations")
    taken = convs.select("conv_id", "base", "n_head").join(heads.withColumnRenamed("conv_id", "base"), "base")
    taken = taken.where(F.col("k") < F.col("n_head")).select("conv_id", F.col("k").alias("pos"), "d", "chars")
    own = turns.join(convs.select("conv_id", "h", "n_head"), "conv_id").where(F.col("k") >= F.col("h"))
    own = own.select("conv_id", (F.col("n_head") + F.col("k") - F.col("h")).alias("pos"), "d", "chars")
    return convs.select("conv_id"), taken.unionByName(own)


def _residue(seed: int, pos: Column, d: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), pos, d), F.lit(PRIME))


def _key(sums: list[Column]) -> list[Column]:
    """Two longs from four sums."""
    a, b, c, d = (s % PRIME for s in sums)
    return [a * (1 << 31) + b, c * (1 << 31) + d]


def blocks(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, b, items (the block's turns in order) and p0 to p3, the sums before the block, s0 to s3 those of it."""
    b = F.floor(F.col("pos") / block_turns)
    item = F.struct("pos", "d", "chars")
    cut = turns.groupBy("conv_id", b.alias("b")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    add = lambda s: F.aggregate("items", F.lit(0).cast("long"), lambda t, x: t + _residue(s, x["pos"], x["d"]))
    summed = cut.select("conv_id", "b", "items", *[add(k).alias(f"s{k}") for k in range(len(PARTS))])
    return running_totals(summed, ["conv_id"], ["b"], {p: F.col(f"s{k}") for k, p in enumerate(PARTS)})


def nodes(cut: DataFrame, convs: DataFrame) -> DataFrame:
    """depth, k1, k2, up1, up2 (the parent's key), chars, n_convs, conv_id (smallest member), the root included."""
    before = [(F.col(p) % PRIME).alias(p) for p in PARTS]
    edges = stored(
        cut.select("conv_id", "b", "items", *before)
        .groupBy(*PARTS, "b", "items")
        .agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")),
        "block-edges",
    )
    siblings = edges.groupBy(*PARTS, "b").agg(F.count(F.lit(1)).alias("siblings"))
    several = siblings.where("siblings > 1").select(*PARTS, "b")

    def turn(i: Column) -> Column:
        def added(n: Column, k: int) -> Column:
            return F.aggregate(F.slice("items", 1, n), F.col(PARTS[k]), lambda t, x: t + _residue(k, x["pos"], x["d"]))

        sums = lambda n: [added(n, k) for k in range(len(PARTS))]
        (k1, k2), (up1, up2) = _key(sums(i + 1)), _key(sums(i))
        last = F.get("items", i)
        return F.struct((last["pos"] + 1).alias("depth"), k1.alias("k1"), k2.alias("k2"), up1.alias("up1"), up2.alias("up2"), last["chars"].alias("chars"))

    def spelled(rows: DataFrame) -> DataFrame:
        return rows.select("n", "conv_id", F.inline(F.transform(F.sequence(F.lit(0), F.size("items") - 1), turn)))

    name = ["depth", "k1", "k2", "up1", "up2", "chars"]
    chains = spelled(edges.join(several, [*PARTS, "b"], "left_anti")).select(*name, F.col("n").alias("n_convs"), "conv_id")
    refined = (
        spelled(edges.join(several, [*PARTS, "b"], "left_semi"))
        .groupBy(*name)
        .agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in name], "n_convs", "conv_id")
    return chains.unionByName(refined).unionByName(root)


def _ends(cut: DataFrame, convs: DataFrame) -> DataFrame:
    """depth, k1, k2 and the digest of the conversations that end there."""
    sums = cut.groupBy("conv_id").agg(F.sum(F.size("items")).alias("depth"), *[F.sum(f"s{k}").alias(p) for k, p in enumerate(PARTS)])
    zero = F.lit(0).cast("long")
    k1, k2 = _key([F.coalesce(p, zero) for p in PARTS])
    last = convs.join(sums, "conv_id", "left").select(F.coalesce("depth", zero).alias("depth"), k1.alias("k1"), k2.alias("k2"), "conv_id")

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        names = ["depth", "k1", "k2", "ends_sha256"]
        now, digest = None, None
        for batch in batches:
            out = []
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names[:3]], axis=1)
            ids = batch.column("conv_id").to_pylist()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(ids)] if ids else [0]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                key = tuple(keys[start].tolist())
                if key != now:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(",".join(map(str, ids[start:stop])).encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], pa.string() if k == 3 else pa.int64()) for k in range(4)], names=names
            )
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, digest.hexdigest())], names=names)

    key = ["depth", "k1", "k2"]
    return last.repartition(*key).sortWithinPartitions(*key, "conv_id").mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def _passed_up(tree: DataFrame) -> DataFrame | None:
    """conv_id, depth, leaves, saved: what the chains hanging on a node add to it, chains on those chains included."""
    tops = stored(
        tree.where("parent_conv_id <> conv_id").select("conv_id", F.col("parent_conv_id").alias("up"), (F.col("depth") - 1).alias("at")),
        "chains",
    )
    rest, found = tree, None
    while True:
        sums = rest.groupBy("conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        rest = stored(
            tops.join(sums, "conv_id").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(
                F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
            ),
            "passed-up",
        )
        if rest.isEmpty():
            return found
        found = rest if found is None else found.unionByName(rest)


def trie(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node."""
    turns = stored(numbered_turns(conversations), "turns")
    convs, made = rebuilt(turns)
    cut = stored(blocks(made, block_turns), "blocks")
    all_nodes = stored(nodes(cut, convs), "nodes")

    parents = all_nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    of_parent = all_nodes.where("depth > 0").join(parents, ["depth", "up1", "up2"])
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "chars", "k1", "k2"]
    no_parent = F.lit(None).cast("long").alias("parent_conv_id")
    named = of_parent.select(*columns).unionByName(
        all_nodes.where("depth = 0").select(*[no_parent if c == "parent_conv_id" else c for c in columns])
    )
    named = stored(named, "named")
    children = named.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    n_children = F.coalesce("n_children", F.lit(0).cast("long"))
    tree = named.join(children, ["conv_id", "depth"], "left").select(
        *columns,
        n_children.alias("n_children"),
        F.when(n_children == 0, 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    tree = stored(tree, "tree")

    hung = _passed_up(tree)
    if hung is not None:
        added = hung.groupBy("conv_id", "depth").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        zero = F.lit(0).cast("long")
        tree = tree.join(added, ["conv_id", "depth"], "left").withColumns(
            {c: F.col(c) + F.coalesce(f"more_{c}", zero) for c in ("leaves", "saved")}
        )
    upward = tree.select(*columns, "n_children", "leaves", "saved", (-F.col("depth")).alias("height"))
    summed = running_totals(upward, ["conv_id"], ["height"], {"below": F.col("leaves"), "saved_below": F.col("saved")})
    ends = _ends(cut, convs)
    none = F.sha2(F.lit(""), 256)
    return summed.join(ends, ["depth", "k1", "k2"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("leaves") + F.col("below")).alias("n_leaves"),
        (F.col("saved") + F.col("saved_below")).alias("saved_tokens"),
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
