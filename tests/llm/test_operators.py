"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import gzip
import hashlib
import html
import io
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from carepath.llm import (
    graph, op1_pii, op2_bpe, op3_warc, op4_lines, op5_quality, op6_html, op7_minhash, op8_mixing, op9_toxicity,
    op10_fingerprint,
)
from carepath.llm.common import running_sums, table
from carepath.llm.queries import QUERIES, vocabulary_path


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").cache()


@pytest.fixture(scope="module")
def bodies(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


# --- personal data ------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def base_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                  "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found))


HARD = [
    "a@b.com_x@c.de a@b@c.de .a@b.c. x@y é@ü.com a@b-c.d..e@f.gg",
    "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3.45.6.7.8 0001.002.3.255 1.2.3.256 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 12345678901234567890 79927398713",
    "+1 (017) 555-7713 +49 30 123456. +1-2 ++123456789 +123456789012345678 +1 (2)",
    "日本 a@b.jp 🎉 10.0.0.1 é 4111111111111111",
]


def test_base_spans_are_exact(spark, docs, bodies):
    random.seed(3)
    noise = ["".join(random.choice("a1.@+- ()é_0459") for _ in range(80)) for _ in range(300)]
    hard = frame(spark, *HARD, *noise)
    want = dict(enumerate([*HARD, *noise], 1))
    for rows, texts in ((hard, want), (docs, bodies)):
        for r in op1_pii.report(rows).collect():
            spans = base_spans(texts[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest(), (texts[r["doc_id"]][:200], spans, r["spans"])


def test_spans_are_added_and_base_ones_stay(spark):
    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = frame(spark, *[f'the token = "{secret}" of a@b.com and 4111 1111 1111 111{k}' for k in range(10)], "just some clean words")
    got = {r["doc_id"]: r["spans"] for r in op1_pii.report(rows).collect()}
    assert all(x.startswith("secret:13:53,email:58:65") for i, x in got.items() if i < 11) and got[11] == ""


def test_an_account_number_is_checked(spark):
    found = spark.createDataFrame([("GB82 WEST 1234 5698 7654 32",), ("GB82 WEST 1234 5698 7654 33",)], "x string")
    assert [r[0] for r in found.select(op1_pii._iban_sound(F.col("x"))).collect()] == [True, False]


def test_reliabilities_follow_the_votes():
    def row(n, checked, spoken_for, k=4):
        return {"k": k, "size": 3, **dict.fromkeys(op1_pii.VOTERS, 0), "checked": checked, "spoken_for": spoken_for, "n": n}

    rows = [row(50, 1, 1), row(10, 1, 0), row(60, -1, 0), row(2, -1, 1)]
    model = op1_pii.estimate(rows)
    no, yes = model.chances["spoken_for"][1]
    assert yes > no and model.posterior(rows[0]) > 0.9 > 0.1 > model.posterior(rows[2])


# --- tokens ---------------------------------------------------------------------


def test_tokens_equal_the_library(spark, docs, bodies):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    odd = ["<|startoftext|>Don't STOP<|endoftext|> ΣΑΣ ﬁ İ", "a\u0085b\xa0c 12½ é é 🎉👍🏽", "'S'T 'll we'LL"]
    extra = frame(spark, *odd).select((F.col("doc_id") + 10**6).alias("doc_id"), "text")
    texts = {**bodies, **{10**6 + k: t for k, t in enumerate(odd, 1)}}
    for r in op2_bpe.encode(docs.select("doc_id", "text").union(extra), vocabulary_path(), 500).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_the_lexicon_is_minimal_and_exact(tmp_path):
    words = {w: (k, k + 1) for k, w in enumerate("tap taps top tops stop stops".split())}
    arrays = op2_bpe.compile_lexicon(words)
    assert len(arrays["finals"]) == 7  # tap, top and stop share their ends
    (tmp_path / "x.bin").write_bytes(op2_bpe.pack(arrays))
    lexicon = op2_bpe.Lexicon(str(tmp_path / "x.bin"))
    assert lexicon.look_up([*words, "ta", "tapss", ""]) == [*words.values(), None, None, None]
    assert op2_bpe.compile_lexicon({})["ids"].size == 0


# --- archives ---------------------------------------------------------------------


def test_archives_round_trip_at_any_range(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    manifest = op3_warc.archive(pages.repartition(3)).cache()
    want = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    first = {}
    for i in sorted(want):
        first.setdefault(want[i], i)
    for size in (1000, 50_000, 1 << 24):
        got = op3_warc.read_archives(spark, manifest, size).collect()
        assert sorted(r["page_id"] for r in got) == sorted(want)
        for r in got:
            kind = "response" if first[want[r["page_id"]]] == r["page_id"] else "revisit"
            assert r["record_type"] == kind and r["payload_bytes"] == len(want[r["page_id"]])
            assert r["refers_to"] == (None if kind == "response" else first[want[r["page_id"]]])
            assert kind == "revisit" or bytes(r["payload"]) == want[r["page_id"]]


def test_magic_inside_a_member_is_no_record():
    first = op3_warc._member(1, "u", "x" * 50, 50, "D", "response", None)
    inner = gzip.compress(b"WARC/1.1\r\nnested", mtime=0)
    stored = zlib.compressobj(0, wbits=31)  # kept as it is, so the nested member shows
    second = stored.compress(b"WARC/1.1\r\nouter " + inner + b" more") + stored.flush()
    whole = first + second + first
    source = io.BytesIO(whole)
    inside = len(first) + second.index(inner)
    assert op3_warc.first_record(source, len(first) + 1, len(whole), len(whole)) == len(first) + len(second)
    assert whole[inside : inside + 3] == op3_warc.MAGIC
    cuts = [0, 7, len(first), inside, inside + 1, len(whole) - 3, len(whole)]
    found = [r for a, b in zip(cuts, cuts[1:], strict=False) for r in op3_warc.records_in(source, a, b, len(whole))]
    assert len(found) == 3


# --- lines --------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_against_all_pairs(spark):
    random.seed(5)
    pool = "red blue green one two three four five six".split()
    lines = []
    for _ in range(150):
        line = [random.choice(pool) for _ in range(random.choice([8, 9, 10, 12]))]
        lines.append(line)
        for _ in range(random.choice([0, 0, 1, 2])):
            other = line[:]
            for _ in range(random.choice([0, 1, 1, 2])):
                k = random.randrange(len(other))
                other[k : k + random.choice([0, 1])] = random.choice([[], ["new"], [random.choice(pool)]])
            lines.append(other)
    random.shuffle(lines)
    texts = ["\n".join("  ".join(x) for x in lines[k : k + 4]) for k in range(0, len(lines), 4)]
    judged = [(k // 4 + 1, x) for k, x in enumerate(lines) if x]
    alike = lambda x, y: x == y or min(len(x), len(y)) >= op4_lines.MIN_WORDS and edits(x, y) <= 1
    gone = Counter(i for k, (i, x) in enumerate(judged) if any(alike(x, y) for _, y in judged[:k]))
    report = {r["doc_id"]: r["n_removed"] for r in op4_lines.line_report(frame(spark, *texts)).collect()}
    assert report == {i: gone[i] for i in range(1, len(texts) + 1)} and sum(gone.values()) > 30


def test_a_template_costs_no_pairs(spark):
    rows = frame(spark, *[f"one two three four five six seven number{k} nine ten" for k in range(500)])
    kept = op4_lines.drop_lines(rows).where("text <> ''").collect()
    assert [r["doc_id"] for r in kept] == [1]


def test_short_lines_lose_their_repeats(spark):
    planted = ["All rights reserved.", "保留所有权利。", "Released under the MIT License.", "one two three four five six seven"]
    rows = frame(
        spark,
        "\n".join([*planted, "", "All rights reserved", "one two three four five six seven eight nine"]),
        "\n".join(["only here", *planted, "", "  All   rights reserved. ", "one two three four five six seven eight ten"]),
    )
    got = {r["doc_id"]: r["text"].split("\n") for r in op4_lines.drop_lines(rows).collect()}
    assert got[1][:6] == [*planted, "", "All rights reserved"] and len(got[1]) == 7
    assert got[2] == ["only here", ""]
    report = {r["doc_id"]: (r["n_lines"], r["n_judged"], r["n_removed"]) for r in op4_lines.line_report(rows).collect()}
    assert report == {1: (7, 6, 0), 2: (8, 7, 6)}


def test_removed_lines_are_those_dropped(spark):
    line = "one two three four five six seven eight nine"
    other = "some quite different words that stand in this line"
    rows = [(1, line), (1, line), (2, line + "\n" + other), (None, other), (None, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    report = {r["doc_id"]: (r["n_judged"], r["n_removed"]) for r in op4_lines.line_report(docs).collect()}
    left = Counter(r["doc_id"] for r in op4_lines.drop_lines(docs).collect() for x in r["text"].split("\n") if x)
    assert left == {1: 2, 2: 1, None: 2}
    assert report == {1: (2, 0), 2: (2, 1), None: (2, 0)}


def test_running_sums(spark):
    values = [random.randrange(10**6) for _ in range(1000)]
    rows = spark.createDataFrame([(values,), ([],)], "v array<long>")
    got = [r[0] for r in rows.select(running_sums(F.col("v"), 997)).collect()]
    want = [0]
    for v in values:
        want.append((want[-1] + v) % 997)
    assert got == [want, [0]]


# --- quality ------------------------------------------------------------------------


def test_quality_counts(docs, bodies):
    for r in op5_quality.quality(docs).collect():
        text = bodies[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = Counter(grams)
        inside = {k + d for k, g in enumerate(grams) if often[g] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"], r["n_symbols"]) == (
            len(words), sum(map(len, words)), len(inside), len(lines) - len(set(lines)), len(re.findall(r"[#*$%&|<>]", text))
        )


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = op5_quality.quality(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").collect()
    good = [r["kept"] for r in got if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.15


# --- pages --------------------------------------------------------------------------


def article(page):
    inner = page[page.index("<article>") + 9 :]
    inner = inner[: inner.index("</article>")] if "</article>" in inner else inner[: inner.index("<footer>")]
    parts = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))
    texts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in parts)
    return "\n\n".join(x for x in texts if x)


def test_main_text_is_the_article(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in op6_html.extract(pages).collect()} == want


def test_messages_give_exact_marginals():
    model = op6_html.Model(op6_html.mixed({}))
    root = op6_html.parse("<div class=post><h1>T</h1><p>One.</p></div><div class=menu><a href=x>m</a></div>")
    nodes = op6_html._order(root)
    parents = {id(k): n for n in nodes for k in n.kids}
    weight = Counter()
    for code in range(2 ** len(nodes)):
        label = {id(n): code >> k & 1 for k, n in enumerate(nodes)}
        p = 1.0
        for n in nodes:
            if label[id(n)]:
                p *= 2.718281828459045 ** sum(model.odds.get(f, 0) for f in op6_html.features(n))
            if id(n) in parents:
                up = parents[id(n)]
                p *= model.edge[op6_html.edge_of(n, up)][2 * label[id(up)] + label[id(n)]]
        weight["all"] += p
        for k in range(len(nodes)):
            weight[k] += p * (code >> k & 1)
    for k, (_, p) in enumerate(model.marginals(root)):
        assert abs(p - weight[k] / weight["all"]) < 1e-9


# --- near duplicates and components -----------------------------------------------


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def test_near_duplicates_against_all_pairs(spark, docs, bodies):
    sets = {i: shingles(t) for i, t in bodies.items()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = op7_minhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), root(i)) for i in sets}


def test_a_chain_of_links_is_one_component(spark):
    words = [f"w{k}" for k in range(200)]
    rows = frame(spark, *[" ".join(words[k : k + 100]) for k in range(0, 100, 10)])
    assert {r["component_id"] for r in op7_minhash.near_duplicates(rows).collect()} == {1}


def compared_pairs(spark, monkeypatch, rows):
    """The classes found and how many pairs were compared on their full sets, by round."""
    counts, real = [], op7_minhash._confirmed

    def counted(sets, pairs, percent):
        counts.append(pairs.count())
        return real(sets, pairs, percent)

    monkeypatch.setattr(op7_minhash, "_confirmed", counted)
    got = {r["doc_id"]: r["component_id"] for r in op7_minhash.near_duplicates(rows).collect()}
    return got, counts


def test_a_family_of_near_misses_gives_no_square_of_pairs(spark, monkeypatch):
    """Any two of a family have similarity 0.735: pairs grow no faster than documents."""
    core = [f"c{k}" for k in range(204)]
    totals = {}
    for n in (400, 800):
        rows = frame(spark, *(" ".join([*core, *(f"u{n}x{d}x{k}" for k in range(36))]) for d in range(n)))
        got, counts = compared_pairs(spark, monkeypatch, rows)
        assert got == {d: d for d in range(1, n + 1)}
        assert counts[-1] == 0  # the exact join pairs none of them
        totals[n] = sum(counts)
    assert totals[800] <= 2.5 * totals[400] and totals[800] < 8 * 800  # all pairs would be 319,600


def test_a_family_of_near_copies_is_one_component_at_few_pairs(spark, monkeypatch):
    """400 copies of one text with a few words changed, and two groups of 100 just too far from it and each other."""
    rng = random.Random(9)
    base = [f"c{k}" for k in range(300)]
    texts_ = []
    for tail, n in ((0, 400), (58, 100), (59, 100)):
        for d in range(n):
            words = base[: 300 - tail] + [f"t{tail}x{k}" for k in range(tail)]
            words[rng.randrange(100, 110)] = f"new{tail}x{d}"
            texts_.append(" ".join(words))
    got, counts = compared_pairs(spark, monkeypatch, frame(spark, *texts_))
    sets = [shingles(t) for t in texts_]
    assert len(sets[0] & sets[450]) / len(sets[0] | sets[450]) < 0.75
    assert got == {d: 1 if d <= 400 else 401 if d <= 500 else 501 for d in range(1, 601)}
    assert sum(counts) < 20 * 600


def test_the_exact_join_finds_what_no_bucket_paired(spark):
    """Links between sets of different size at the threshold, found without the first round."""
    rng = random.Random(6)
    texts_ = []
    for f in range(40):
        words = [f"f{f}w{k}" for k in range(rng.randint(30, 120))]
        texts_.append(words)
        for _ in range(3):
            other = words[: rng.randint(int(0.7 * len(words)), len(words))] + [f"z{rng.randrange(9**9)}" for _ in range(rng.randint(0, 12))]
            texts_.append(other)
    rows = frame(spark, *map(" ".join, texts_))
    sets = op7_minhash.shingle_sets(rows, rows.select(F.col("doc_id").alias("node"))).cache()
    alone = rows.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component"))
    pairs = op7_minhash._rare_prefix_pairs(sets, alone, 75)
    got = {(r["a"], r["b"]) for r in op7_minhash._confirmed(sets, pairs, 75).collect()}
    plain = [shingles(" ".join(t)) for t in texts_]
    want = {
        (a + 1, b + 1)
        for a in range(len(plain)) for b in range(a + 1, len(plain))
        if 100 * len(plain[a] & plain[b]) >= 75 * len(plain[a] | plain[b])
    }
    assert got == want and len(want) > 20


def test_components_of_random_graphs(spark):
    random.seed(2)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)]
    up = {n: n for e in edges for n in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {n: root(n) for e in edges if e[0] != e[1] for n in e}


# --- mixing -------------------------------------------------------------------------


def test_a_shortage_goes_to_siblings_first(spark):
    rows = [("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, source string, tokens long")
    mix = op8_mixing.Mix(("domain", "source"), budget_percent=20)
    got = {r["source"]: r["budget"] for r in op8_mixing.budgets(leaves, mix).collect()}
    assert got == {"x": 10, "y": 191, "z": 201}
    short = spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("b", "z", 970)], "domain string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in op8_mixing.budgets(short, mix).collect()}
    assert got == {"x": 10, "y": 20, "z": 170}


def test_epochs_repeat_a_small_source(spark):
    rows = spark.createDataFrame([(k, "a b", "s" if k < 3 else "t") for k in range(30)], "doc_id long, text string, source string")
    mix = op8_mixing.Mix(("source",), budget_percent=50, max_epochs=2)
    got = op8_mixing.select(rows, mix).collect()
    assert {r["copies"] for r in got if r["source"] == "s"} == {2}
    assert sum(r["copies"] * r["n_tokens"] for r in got if r["source"] == "t") == 18


# --- toxicity -----------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = op9_toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    predicted = [r["toxic"] for r in got if r["predicted"]]
    assert sum(predicted) / len(predicted) > 0.9
    assert sum(predicted) / sum(r["toxic"] for r in got) > 0.7


def test_held_out_labels_are_never_read(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    turned = labels.withColumn("toxic", F.when(op9_toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (op9_toxicity.train(docs, x) for x in (labels, turned))
    assert one.weights == two.weights and one.intercept == two.intercept


# --- fingerprints ---------------------------------------------------------------------


def test_edited_texts_and_likeness(docs, bodies):
    ids = sorted(bodies)
    after = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    got = {r["doc_id"]: r for r in op10_fingerprint.edited_fingerprints(docs).collect()}
    for i in ids:
        half = len(bodies[i]) // 2
        edited = bodies[i][: len(bodies[i]) - half] + bodies[after[i]][:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(bodies[i])
        if edited == bodies[i]:
            assert got[i]["near_edited"] == 1.0
        prints = [got[i][c] for c in ("fingerprint", "edited_fingerprint")]
        a, b = (set() if p.startswith("=") else set(re.findall(".{12}", p)) for p in prints)
        assert all(int(h, 16) < 2**47 for h in a | b)
        smaller = min(len(a), len(b))
        assert got[i]["near_edited"] == (len(a & b) / smaller if smaller else float(not a and not b and prints[0] == prints[1]))
    long = [i for i in ids if len(bodies[i]) > 3000]
    assert sum(got[i]["near_edited"] > got[i]["near_next"] for i in long) > 0.95 * len(long)


def test_short_texts_are_found_whole_in_long_ones(spark):
    long = [f"w{k}" for k in range(400)]
    rows = [(" ".join(long[k : k + n]), " ".join(long), " ".join(long[: k + 4]), " ".join(long[k:])) for n in (5, 9, 14) for k in range(1, 60)]
    got = spark.createDataFrame(rows, "short string, long string, head string, tail string").select(
        op10_fingerprint.likeness(op10_fingerprint.sketch(F.col("short")), op10_fingerprint.sketch(F.col("long"))).alias("share"),
        op10_fingerprint.merged(op10_fingerprint.sketch(F.col("head")), op10_fingerprint.sketch(F.col("tail"))).alias("parts"),
        op10_fingerprint.sketch(F.col("long")).alias("whole"),
    ).collect()
    assert {r["share"] for r in got} <= {0.0, 1.0} and sum(r["share"] for r in got) > 0.7 * len(got)  # 0: a mark, one in two of one shingle
    assert all(r["parts"] == r["whole"]["kept"] for r in got)


@pytest.mark.parametrize("fraction", [0.5, 0.25])
def test_containment_of_very_unequal_texts(spark, fraction):
    """A third of a text of 60 to 1,500 words lies in one of 30,000: the estimates' error is the stated one."""
    rng = random.Random(3)
    long = [f"w{rng.randrange(9**9)}" for _ in range(30_000)]
    rows = []
    for n in (60, 300, 1500):
        for _ in range(40):
            at = rng.randrange(len(long) - n)
            rows.append((n, " ".join(long[at : at + n // 3] + [f"x{rng.randrange(9**9)}" for _ in range(n - n // 3)])))
    whole = op10_fingerprint.sketch(F.lit(" ".join(long)), fraction)
    made = op10_fingerprint.sketch(F.col("text"), fraction)
    got = spark.createDataFrame(rows, "n int, text string").select("n", op10_fingerprint.likeness(made, whole).alias("share")).collect()
    for n in (60, 300, 1500):
        exact = (n // 3 - 4) / (n - 4)
        errors = [r["share"] - exact for r in got if r["n"] == n]
        stated = (exact * (1 - exact) * (1 - fraction) / (fraction * (n - 4))) ** 0.5
        rms = (sum(e * e for e in errors) / len(errors)) ** 0.5
        assert rms < 1.6 * stated and abs(sum(errors) / len(errors)) < 4 * stated / len(errors) ** 0.5


def test_marks_match_only_themselves(spark):
    texts_ = [f"only{k} a b c d" for k in range(60)]
    rows = spark.createDataFrame([(t, t, texts_[k - 1]) for k, t in enumerate(texts_)], "a string, b string, c string")
    like = lambda x, y: op10_fingerprint.likeness(op10_fingerprint.sketch(F.col(x)), op10_fingerprint.sketch(F.col(y)))
    got = rows.select(like("a", "b").alias("same"), like("a", "c").alias("other"), op10_fingerprint.as_string(op10_fingerprint.sketch(F.col("a"))).alias("f")).collect()
    assert all(r["same"] == 1.0 and r["other"] == 0.0 for r in got) and len({r["f"] for r in got}) == 60
    assert 10 < sum(r["f"].startswith("=") for r in got) < 50


def test_hot_doc_ids_are_split_into_ranges(spark, monkeypatch):
    monkeypatch.setattr(op10_fingerprint, "RANGE_ROWS", 20)
    rows = [(None, f"n{k}") for k in range(150)] + [(5, f"t{k}") for k in range(200)] + [(k, f"u{k}") for k in range(100)]
    frame_ = spark.createDataFrame(rows, "doc_id long, text string")
    out = op10_fingerprint.with_next(frame_)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan
    got = [(r["doc_id"], r["text"], r["next_text"]) for r in out.collect()]
    assert sorted(x[1] for x in got) == sorted(x[1] for x in rows) == sorted(x[2] for x in got)
    following = {t: n for _, t, n in got}
    chain, at = [], "u99"
    for _ in range(len(rows)):
        at = following[at]
        chain.append(at)
    ids = {t: i for i, t in rows}
    order = [(-1 if ids[t] is None else ids[t]) for t in chain]
    assert order == sorted(order) and len(set(chain)) == len(rows)


def test_ranges_join_up(spark, monkeypatch):
    monkeypatch.setattr(op10_fingerprint, "RANGE_ROWS", 7)
    rows = frame(spark, *(f"text {k}" for k in range(100)))
    got = {r["doc_id"]: r["next_text"] for r in op10_fingerprint.with_next(rows).collect()}
    assert got == {k: f"text {k % 100}" for k in range(1, 101)}


# --- the queries and the pipeline ---------------------------------------------------


def test_the_pipeline_mixes_with_the_production_budget(spark, sf_dir, docs):
    import corpus_pipeline

    chosen = op8_mixing.select(op8_mixing.with_domain(docs), op8_mixing.PRODUCTION)
    got = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in chosen.collect()}


def test_every_operator_is_registered():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
    last = corpus_pipeline.run(spark, sf_dir)
    assert last.count() == docs.count() > 0


def test_the_lexicon_counts_every_text(spark, monkeypatch):
    # each word is in one text only, so counts of a part of the texts would lack some
    docs = spark.createDataFrame([(i, f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}") for i in range(100)], "doc_id long, text string")
    entries = {}
    keep = op2_bpe.compile_lexicon
    monkeypatch.setattr(op2_bpe, "compile_lexicon", lambda words: entries.update(words) or keep(words))
    op2_bpe.encode(docs, vocabulary_path(), 1000)
    assert set(entries) == {r.text for r in docs.collect()}


def test_plain_texts_are_cut_as_any_other():
    split = op2_bpe.Splitter({})
    marks = [chr(k) for k in range(128)]
    texts = [a + b + c for a in marks for b in marks for c in ("", "'", "s", "1", " ")]
    texts += ["it's WE'RE i'll 'dm 'VE''s l'l'll 12a3''t", "'re've'm'd're1'"]
    for text in texts:
        assert split.words(text) == split.find(op2_bpe._normal(text)), repr(text)


def test_lines_are_split_once_and_short_of_a_partner_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a b\n\nc d e f g h i j"), (2, "a b\nc d e f g h i k")], "doc_id long, text string")
    plan = op4_lines.distinct_lines(docs)._jdf.queryExecution().executedPlan().toString()
    # one split into lines, one of a line into words
    assert plan.count("split(") == 2
    kept, gone = op4_lines.duplicate_lines(docs)
    assert kept.count() == 2 and [tuple(r.other) for r in gone.collect()] == [(False, 1, 2)]
