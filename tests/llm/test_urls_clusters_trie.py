"""URL filters, centroid clusters and the prefix trie against brute force, and their edges."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from carepath.llm import op11_urls, op12_clusters, op13_trie
from carepath.llm.common import table
from carepath.llm.queries import QUERIES

# --- URL filters ---------------------------------------------------------------


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:end], rest[end:]
    stop = min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:stop]


def judged(url, rules, default="allow"):
    host, path = split_url(url)
    fits = [
        (len(h + p), len(h), v == "block", h + p)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if not fits:
        return host, path, None, default
    best = max(fits)
    return host, path, best[3], "block" if best[2] else "allow"


def pages(spark, urls):
    rows = [(k, u, "h", "r", "v", 1, "d") for k, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, rule string, verdict string, salt int, digest string")


ODD_URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "http://COM/", "http://a.com/", "http://acom/", "http://x.net/es",
    "http://x.net/es/", "http://x.net/es/1?u=http://y.com/fr/", "http://x.net?u=http://y.net/fr/", "https://example.com/en/a",
    "https://www.example.com/en/a", "https://www.example.com/EN/a", "https://m.www.example.com/en/", "http://..com/", "http://a.com:80/",
    "http://x.net#/es/", "http://user@x.net/fr//", "mail://x.net/fr/a b\nc", "http://x.net./es/", "http://ü.com/é/", "http://com//",
    "http://" + "a." * 5000 + "com/" + "b/" * 20_000, "http://x.net/es/", "http://x.net/es/",
]


def test_urls_against_brute_force(spark):
    got = op11_urls.judge(pages(spark, ODD_URLS), op11_urls.rule_table(spark)).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == sorted(
        (k, *judged(u, op11_urls.RULES)) for k, u in enumerate(ODD_URLS)
    )


def test_random_rules_against_brute_force(spark):
    rng = random.Random(11)
    host = lambda: ".".join(rng.choice(["a", "b", "com"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/", "/", "a", "b"]) for _ in range(rng.randint(0, 6)))
    rules = tuple({(host(), path(), rng.choice(["allow", "block"])) for _ in range(60)})
    urls = [f"http://{host()}/{path()}{rng.choice(['', '?/a', '#b/'])}" for _ in range(800)]
    got = op11_urls.judge(pages(spark, urls), spark.createDataFrame(rules, "host string, path string, verdict string"), "block")
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == sorted(
        (k, *judged(u, rules, "block")) for k, u in enumerate(urls)
    )


def test_a_shuffled_join_gives_the_same(spark):
    rules, urls = op11_urls.rule_table(spark), pages(spark, ODD_URLS * 20)
    want = sorted(map(str, op11_urls.judge(urls, rules).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, op11_urls.judge(urls, rules).collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filtered_pages_keep_their_columns_and_bad_rules_are_errors(spark):
    frame = pages(spark, ODD_URLS)
    kept = op11_urls.only_allowed(frame, op11_urls.rule_table(spark))
    assert kept.columns == frame.columns
    assert sorted(r.page_id for r in kept.collect()) == [k for k, u in enumerate(ODD_URLS) if judged(u, op11_urls.RULES)[3] == "allow"]
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {(r.rule, r.verdict) for r in op11_urls.judge(frame, none).collect()} == {(None, "allow")}
    assert op11_urls.judge(frame.where("false"), op11_urls.rule_table(spark)).count() == 0
    for bad in (("", "/", "allow"), (None, "/", "allow"), ("a", None, "block"), ("a", "/", "deny")):
        with pytest.raises(Exception, match="not a rule"):
            op11_urls.judge(frame, spark.createDataFrame([bad], "host string, path string, verdict string")).collect()


# --- centroid clusters -----------------------------------------------------------


@pytest.mark.parametrize("k,dims,most,leaf", [(1, 4, 3, 4), (16, 64, 40, 4), (40, 2, 3, 4), (333, 3, 5, 2), (90, 8, 20, 7)])
def test_the_tree_finds_the_nearest_with_ties(k, dims, most, leaf):
    rng = np.random.default_rng(k)
    centroids, vectors = rng.integers(-most, most + 1, (k, dims)), rng.integers(-most, most + 1, (700, dims))
    vectors[:k] = centroids[:700]
    chosen, best, computed = op12_clusters.Tree(centroids, leaf).nearest(vectors)
    apart = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (chosen == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()
    assert (computed <= k).all() and (computed >= 1).all()


def test_the_tree_leaves_most_far_centroids_out():
    rng = np.random.default_rng(2)
    centroids = rng.integers(-10**6, 10**6, (500, 3))
    _, _, computed = op12_clusters.Tree(centroids).nearest(rng.integers(-10**6, 10**6, (500, 3)))
    assert computed.mean() < 100


def plain_clusters(rows, k, rounds, dims):
    kept = [
        (i, [math.floor(64 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(64 * x) < 2**27 for x in v)
    ]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, vs in groups.items():
            cents[n] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    per = {}
    for _, c, d in out:
        per[c] = per.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, per[c], sum(per.values()), sha[c]) for i, c, d in out), key=str)


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, v int, cluster int, distance int")


def cluster_rows(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=str)


def test_clusters_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 0.0, 1.5]) for _ in range(5)]) for i in range(400)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, [0.1] * 5), (900, None), (901, []), (902, [1.0] * 6), (903, [1e30] * 5)]
    rows += [(904, [1.0, None, 1.0, 1.0, 1.0]), (905, [math.nan] * 5), (906, [math.inf] * 5), (907, [-1e6] * 5)]
    for k, rounds in ((6, 3), (1, 1), (500, 2)):
        got = op12_clusters.clusters(vectors_frame(spark, rows).repartition(3), k, rounds, 5)
        assert cluster_rows(got) == plain_clusters(rows, k, rounds, 5)


def test_no_vectors_no_rows(spark):
    for rows in ([(1, [1.0])], [(1, None)]):
        assert op12_clusters.clusters(vectors_frame(spark, rows), 3, 2, 5).count() == 0
    assert op12_clusters.clusters(vectors_frame(spark, [(1, [1.0])]).where("false"), 3, 2, 1).count() == 0
    with pytest.raises(ValueError, match="numbers"):
        op12_clusters.clusters(vectors_frame(spark, []), 10**6, 1, 64)
    with pytest.raises(ValueError, match="leaf"):
        op12_clusters.Tree([[1]], 1)


# --- prefix trie -----------------------------------------------------------------


def plain_trie(rows):
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            talks.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for turns in talks.values():
        turns.sort(key=lambda t: t[:2])
    plain = {c: [t[2:] for t in turns] for c, turns in talks.items()}
    made = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(plain.get(c - c % 100, [])[:h] + own[h:])
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for key, cs in members.items():
        under = [k for k in members if k[: len(key)] == key]
        kids = [k for k in under if len(k) == len(key) + 1]
        leaf = lambda k: not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in members)
        ends = sorted(c for c in cs if len(made[c]) == len(key))
        out.append((
            min(cs), len(key), min(members[key[:-1]]) if key else None, len(cs), len(kids), sum(map(leaf, under)),
            sum((len(members[k]) - 1) * len(k[-1][1]) for k in under if k), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def talk_frame(spark, rows):
    schema = "conv_id long, turn long, role string, text string, k int, depth int, n_convs int, d string"
    return spark.createDataFrame([(*r, 1, 2, 3, "d") for r in rows], schema)


def trie_rows(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def random_talks(seed, n, ids, turns=12):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(ids, n):
        first = rng.choice([0, 5])
        for t in range(rng.randint(1, turns)):
            text = rng.choice(["a", "b"]) if rng.random() < 0.4 else "same"
            rows.append((c, t + first or None, rng.choice(["user", "user", None]), rng.choice([text, text, None, "é" * 3])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(1, 4), (2, 1), (3, 3), (4, 100)])
def test_the_trie_against_brute_force(spark, seed, block):
    rows = random_talks(seed, 60, list(range(0, 350)))
    assert trie_rows(op13_trie.trie(talk_frame(spark, rows), block)) == plain_trie(rows)


def test_copies_turnless_conversations_and_null_ids(spark):
    rows = [(c, t, "u", f"x{t}") for c in range(205, 230) for t in range(3)]  # no family head: some lose all turns
    rows += [(None, 0, "u", "nobody"), (1, None, None, None)]
    rows += [(c, t, "u", "y") for c in (300, 301, 302) for t in range(40)]
    got = trie_rows(op13_trie.trie(talk_frame(spark, rows)))
    assert got == plain_trie(rows)
    assert len(got[0]) == 8
    assert op13_trie.trie(talk_frame(spark, [(None, 0, "u", "x")])).count() == 0
    assert op13_trie.trie(talk_frame(spark, rows).where("false")).count() == 0


def test_equal_turns_count_and_a_long_conversation_fits(spark):
    rows = [(100, 3, "u", "z")] * 30 + [(200, t, "u", "w" * (t % 3)) for t in range(3000)]
    got = op13_trie.trie(talk_frame(spark, rows)).collect()
    assert {(r.conv_id, r.depth) for r in got} == {(100, d) for d in range(31)} | {(200, d) for d in range(1, 3001)}
    assert all(r.n_leaves == (2 if r.depth == 0 else 1) and r.saved_tokens == 0 for r in got)


def test_the_trie_query_reads_the_whole_table(spark, sf_dir):
    frame = table(spark, sf_dir, "conversations")
    want = plain_trie([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])
    assert trie_rows(QUERIES["op13_prefix_trie"](spark, sf_dir)) == want
