"""The whole pipeline against a plain Python version of every stage, on the smallest table."""

import hashlib
import re
from collections import Counter, defaultdict

from carepath.llm import op4_lines, op5_quality, op8_mixing
from carepath.llm.common import table
from carepath.llm.queries import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def good(text):
    words = WORD.findall(text)
    often = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {k + d for k in range(len(words) - 2) if often[tuple(words[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    if len(words) < 50 or 100 * len(inside) > 50 * len(words):
        return False
    chars = sum(map(len, words))
    counts = {
        "n_words": len(words), "word_chars": chars, "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_capitals": len(re.findall("[A-Z]", text)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_stop_words": sum(w in op5_quality.STOP_FORMS for w in words),
        "n_ellipsis_lines": sum(x.endswith(("...", "…")) for x in lines),
    }
    return all(
        (r.least is None or 100 * counts[r.part] >= r.least * counts[r.whole])
        and (r.most is None or 100 * counts[r.part] <= r.most * counts[r.whole])
        for r in op5_quality.RULES
    )


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :]
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def without_lines(texts):
    earlier, out = defaultdict(list), {}
    for i in sorted(texts):
        kept = []
        for line in texts[i].split("\n"):
            words = WORD.findall(line)
            if words:
                near = (e for n in (-1, 0, 1) for e in earlier[len(words) + n])
                least = op4_lines.MIN_WORDS
                found = any(e == words or min(len(e), len(words)) >= least and one_edit(words, e) for e in near)
                earlier[len(words)].append(words)
                if found:
                    continue
            kept.append(line)
        out[i] = "\n".join(kept)
    return out


def one_of_each(texts):
    sets = {}
    for i, t in texts.items():
        words = t.encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: t for i, t in texts.items() if root(i) == i}


def weight(mix, path):
    for given, w in mix.weights.items():
        if len(given) == len(path) and all(g in ("*", p) for g, p in zip(given, path, strict=True)):
            return w
    return 1


def split(mix, budget, tokens, path=()):
    """Budgets of the leaves below ``path``: children that can't take their share are filled, the others share again."""
    depth = len(path) + 1
    children = defaultdict(int)
    for leaf, n in tokens.items():
        if leaf[: len(path)] == path:
            children[leaf[:depth]] += n * mix.max_epochs
    given, left, free = {}, budget, dict(children)
    while True:
        total = sum(weight(mix, c) for c in free)
        full = [c for c, n in free.items() if n * total <= left * weight(mix, c)]
        if not full:
            break
        child = min(full, key=lambda c: (free[c] / weight(mix, c), c))
        given[child] = free.pop(child)
        left -= given[child]
    given |= {c: left * weight(mix, c) // total for c in free}
    if depth == len(mix.levels):
        return given
    return {leaf: n for c, b in given.items() for leaf, n in split(mix, b, tokens, c).items()}


def mixed(mix, rows):
    """doc_ids whose tokens fit into their leaf's budget, in the order of the first epoch."""
    leaf_of = {}
    for i, (text, lang, source) in rows.items():
        domain = "crawl" if source == "src0" else "books" if source[-1] in "02468" else "forums"
        leaf_of[i] = (domain, lang, source)
    n = {i: len(WORD.findall(r[0])) for i, r in rows.items()}
    tokens = Counter()
    for i, leaf in leaf_of.items():
        if n[i]:
            tokens[leaf] += n[i]
    budget = split(mix, sum(tokens.values()) * mix.budget_percent // 100, tokens)
    chosen = set()
    for leaf, total in tokens.items():
        epochs, rest = divmod(budget[leaf], total)
        mine = [i for i in rows if leaf_of[i] == leaf and n[i]]
        reached = 0
        for i in sorted(mine, key=lambda i: hashlib.md5(f"{mix.seed}:{epochs}:{i}".encode()).hexdigest()):
            reached += n[i]
            if epochs or reached <= rest:
                chosen.add(i)
    return chosen


def test_pipeline_equals_a_plain_version(spark, sf_dir):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows = {r["doc_id"]: r for r in table(spark, sf_dir, "documents").collect()}
    texts = {i: r["text"] or "" for i, r in rows.items() if good(r["text"] or "")}
    texts = one_of_each(without_lines(texts))
    chosen = mixed(op8_mixing.PIPELINE, {i: (t, rows[i]["lang"], rows[i]["source"]) for i, t in texts.items()})
    library = Tokenizer.from_file(vocabulary_path())
    want = {}
    for i in chosen:
        ids = library.encode(texts[i], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want
    assert 20 < len(got) < len(rows)
