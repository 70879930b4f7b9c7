"""Toxicity by weak supervision: many voters, a label model over them, and a linear classifier on its posteriors.

Voters are word lists and patterns written down here, lists of words and word parts found in the labelled texts, and
the given label itself, as noisy as it may be. The label model is generative: the hidden label and, for every voter,
one other voter it depends on most (a maximum spanning tree of conditional mutual information), so correlated voters
don't count twice; expectation-maximisation estimates accuracies and dependencies. A logistic regression on the
presence of terms is trained on the posterior labels and scores every text by itself.

Labels are read only from rows whose crc32(doc_id) mod 3 is not 1, at most ``max_rows`` of them (a parameter), chosen
by a hash of doc_id; label, language, source and id are no inputs of a score. Training is one task on that bounded
sample; the model (a term's weight for at most ``max_terms`` terms) is broadcast, and all texts are scored whole.

Defined results: a null or empty text has no terms and gets the score of the intercept; without any usable label the
written word lists alone decide; repeated rows get equal scores; repeated labels of a doc_id count as toxic if one
does, null labels don't count; a null doc_id is passed on, held out false; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import texts

MAX_ROWS = 8_000
MAX_TERMS = 50_000
PREDICT_AT = 0.7
WORKER_WORDS = 200_000
AFFIXES = (4, 5, 6, 7)
LEAST_TEXTS = 5
LEAST_ODDS = 1.5
LEAST_Z = 3.0
WORD = re.compile(r"[^\W\d_]+")

# Common insults of four languages, and patterns of hostile address.
INSULTS = {
    "en": "idiot idiots stupid moron morons loser losers trash scum clown disgusting worthless pathetic dumb fool "
    "imbecile jerk freak filthy garbage coward ugly vermin bastard bitch asshole shit fuck".split(),
    "de": "idiot idioten dumm dummkopf trottel blöd arschloch abschaum müll versager widerlich schwein mist".split(),
    "fr": "idiot idiote crétin débile imbécile ordure salaud connard merde nul raclure dégoûtant abruti".split(),
    "es": "idiota estúpido estúpida imbécil basura escoria asqueroso tonto inútil payaso mierda cabrón".split(),
}
PATTERNS = {
    "address": re.compile(r"\b(?:you|you're|your|du bist|ihr seid|tu es|vous êtes|eres|sois)\W+(?:\w+\W+)?(?:an?\W+)?"
                          r"(?:idiot|stupid|moron|loser|dumm|cr[ée]tin|est[úu]pid|imb[ée]cil)"),
    "dismissal": re.compile(r"\b(?:shut up|go to hell|get lost|hate you|halt die klappe|ferme[- ]la|cállate)\b"),
    "shouting": re.compile(r"!{3,}|[?!]{4,}"),
}


@dataclass
class Scorer:
    """A linear model over the presence of terms."""

    intercept: float
    weights: dict[str, float]

    def __post_init__(self):
        self.memory: dict[str, tuple[str, ...]] = {}

    def score(self, text: str) -> float:
        found = set()
        for word in set(WORD.findall(text.lower())):
            known = self.memory.get(word)
            if known is None:
                if len(self.memory) > WORKER_WORDS:
                    self.memory.clear()
                known = self.memory[word] = tuple(t for t in terms_of(word) if t in self.weights)
            found.update(known)
        odds = self.intercept + math.fsum(self.weights[t] for t in found)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings and ends of 4 to 7 letters."""
    out = [f"={word}"]
    for n in AFFIXES:
        if len(word) > n:
            out += [f"{word[:n]}*", f"*{word[-n:]}"]
    return out


def kind_of(term: str) -> str:
    """Which mined voter a term belongs to."""
    if term[0] == "=":
        return "words"
    return f"begins{len(term) - 1}" if term[-1] == "*" else f"ends{len(term) - 1}"


class Corpus:
    """The training texts as arrays of term numbers; terms in too few texts to learn from are left out."""

    def __init__(self, raw: list[str]):
        import numpy as np

        self.lower = [t.lower() for t in raw]
        numbers: dict[str, int] = {}
        words = [
            np.fromiter({numbers.setdefault(w, len(numbers)) for w in WORD.findall(t)}, np.int32) for t in self.lower
        ]
        seen = np.bincount(np.concatenate(words), minlength=len(numbers)) if numbers else np.zeros(0, np.int64)
        most: Counter = Counter()
        for word, n in zip(numbers, seen.tolist(), strict=True):
            for t in terms_of(word):
                most[t] += n
        self.place = {t: k for k, t in enumerate(t for t, n in most.items() if n >= LEAST_TEXTS)}
        del most
        own = [
            np.array([self.place[t] for t in terms_of(word) if t in self.place], np.int32) for word in numbers
        ]
        none = np.zeros(0, np.int32)
        self.texts = [np.unique(np.concatenate([none, *(own[w] for w in found.tolist())])) for found in words]
        self.kinds = np.array([kind_of(t) for t in self.place])

    def counts(self, chosen):
        """In how many of the chosen texts each term occurs."""
        import numpy as np

        found = [t for t, c in zip(self.texts, chosen, strict=True) if c]
        return np.bincount(np.concatenate(found), minlength=len(self.place)) if found else np.zeros(len(self.place), np.int64)

    def any_of(self, terms, chosen=None):
        """Per text whether it has one of the marked terms (0 for texts not chosen)."""
        import numpy as np

        chosen = np.ones(len(self.texts), bool) if chosen is None else chosen
        return np.array([int(c and terms[t].any()) for t, c in zip(self.texts, chosen, strict=True)], np.int8)


def vote_table(corpus: Corpus, labels):
    """Names of the voters and a 0/1 matrix: one row per text."""
    import numpy as np

    y = np.asarray(labels, bool)
    names, columns = ["given"], [y.astype(np.int8)]
    for lang, found in INSULTS.items():
        marked = np.zeros(len(corpus.place), bool)
        marked[[corpus.place[f"={w}"] for w in found if f"={w}" in corpus.place]] = True
        names.append(f"insults {lang}")
        columns.append(corpus.any_of(marked))
    for name, pattern in PATTERNS.items():
        names.append(name)
        columns.append(np.array([pattern.search(t) is not None for t in corpus.lower], np.int8))
    # lists of terms eight times as frequent in texts labelled toxic, mined on the other half of the
    # texts, so that a voter doesn't vote on the texts it was made from
    half = np.arange(len(labels)) % 2
    lists = []
    for k in (0, 1):
        other = half != k
        toxic, clean = corpus.counts(other & y), corpus.counts(other & ~y)
        rate = (toxic + 0.5) / ((other & y).sum() + 1) / ((clean + 0.5) / ((other & ~y).sum() + 1))
        lists.append((toxic >= 4) & (rate >= 8))
    for kind in sorted(set(corpus.kinds[lists[0] | lists[1]].tolist())):
        of_kind = corpus.kinds == kind
        names.append(kind)
        columns.append(corpus.any_of(lists[0] & of_kind, half == 0) | corpus.any_of(lists[1] & of_kind, half == 1))
    return names, np.stack(columns, axis=1)


class LabelModel:
    """P(label) and P(vote | label, vote of the voter's parent), by expectation-maximisation."""

    def __init__(self, votes, rounds: int = 25):
        import numpy as np

        self.votes = votes.astype(np.float64)
        q = np.where(votes[:, 0] == 1, 0.9, 0.05)
        for k in range(rounds):
            if k in (0, 5):
                self.parents = self._tree(q)
            self._fit(q)
            q = self.posterior(self.votes)
        self.posteriors = q

    def _tree(self, q) -> list[int]:
        """Each voter's parent in the maximum spanning tree of mutual information given the label."""
        import numpy as np

        n = self.votes.shape[1]
        information = np.zeros((n, n))
        for weight in (q, 1 - q):
            total = weight.sum() + 1e-9
            p = (self.votes * weight[:, None]).sum(0) / total
            both = (self.votes * weight[:, None]).T @ self.votes / total
            for a, b, joint in (
                (p[:, None], p[None, :], both),
                (p[:, None], 1 - p[None, :], p[:, None] - both),
                (1 - p[:, None], p[None, :], p[None, :] - both),
                (1 - p[:, None], 1 - p[None, :], 1 - p[:, None] - p[None, :] + both),
            ):
                joint = np.maximum(joint, 1e-12)
                information += total * joint * np.log(joint / np.maximum(a * b, 1e-12))
        parents, best = [-1] * n, information[0].copy()
        nearest, inside = [0] * n, {0}
        while len(inside) < n:
            j = max((k for k in range(n) if k not in inside), key=lambda k: best[k])
            parents[j] = nearest[j]
            inside.add(j)
            for k in range(n):
                if k not in inside and information[j, k] > best[k]:
                    best[k], nearest[k] = information[j, k], j
        return parents

    def _fit(self, q) -> None:
        import numpy as np

        self.prior = float(np.clip(q.mean(), 1e-4, 1 - 1e-4))
        self.table = np.zeros((self.votes.shape[1], 2, 2))  # P(vote = 1 | label, parent's vote)
        for j, parent in enumerate(self.parents):
            for y, weight in ((0, 1 - q), (1, q)):
                for u in (0, 1):
                    w = weight * ((self.votes[:, parent] == u) if parent >= 0 else 1.0)
                    self.table[j, y, u] = ((w * self.votes[:, j]).sum() + 0.1) / (w.sum() + 1.0)

    def posterior(self, votes):
        import numpy as np

        odds = np.full(len(votes), math.log(self.prior / (1 - self.prior)))
        for j, parent in enumerate(self.parents):
            u = votes[:, parent].astype(int) if parent >= 0 else np.zeros(len(votes), int)
            one, nil = self.table[j, 1][u], self.table[j, 0][u]
            odds += np.where(votes[:, j] == 1, np.log(one / nil), np.log((1 - one) / (1 - nil)))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def correlations(self):
        """The correlation of every two voters among texts of the same label, averaged over the labels."""
        import numpy as np

        out = 0
        for weight in (self.posteriors, 1 - self.posteriors):
            share = weight.sum() / len(weight)
            centred = self.votes - (self.votes * weight[:, None]).sum(0) / weight.sum()
            cov = (centred * weight[:, None]).T @ centred
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            out = out + share * cov / (spread[:, None] * spread[None, :])
        return out


def fit(raw: list[str], labels: list[int], max_terms: int = MAX_TERMS, rounds: int = 500) -> Scorer:
    """Voters, label model and classifier from a bounded list of labelled texts."""
    import numpy as np

    insults = {f"={w}": 3.0 for found in INSULTS.values() for w in found}
    if not any(labels) or all(labels):
        return Scorer(-3.0, insults)
    corpus = Corpus(raw)
    _, votes = vote_table(corpus, labels)
    target = LabelModel(votes).posteriors
    share = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    likely = target >= 0.5
    # terms whose log-odds differ between the two labels by several standard errors
    h, c = corpus.counts(likely) + 0.5, corpus.counts(~likely) + 0.5
    odds = np.log(h / (likely.sum() + 1.5 - h)) - np.log(c / ((~likely).sum() + 1.5 - c))
    z = odds / np.sqrt(1 / h + 1 / c)
    strong = np.flatnonzero((odds >= LEAST_ODDS) & (z >= LEAST_Z) & (h + c >= LEAST_TEXTS))
    names = list(corpus.place)
    strong = np.array(sorted(strong.tolist(), key=lambda k: (-z[k], names[k]))[:max_terms], np.int64)
    chosen = [names[k] for k in strong.tolist()]
    column = np.full(len(names), -1, np.int64)
    column[strong] = np.arange(len(strong))
    mine = [column[t][column[t] >= 0] for t in corpus.texts]
    rows = np.repeat(np.arange(len(mine)), [len(m) for m in mine])
    columns = np.concatenate([np.zeros(0, np.int64), *mine])
    w, b = np.zeros(len(chosen)), math.log(share / (1 - share))
    square, square_b = np.full(len(chosen), 1e-6), 1e-6
    n = len(raw)
    for _ in range(rounds):
        odds = b + np.bincount(rows, w[columns], n)
        error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - target
        gradient = np.bincount(columns, error[rows], len(chosen)) / n + 1e-5 * w
        square += gradient**2
        square_b += error.mean() ** 2
        w -= 0.3 * gradient / np.sqrt(square)
        b -= 0.3 * error.mean() / math.sqrt(square_b)
    return Scorer(float(b), {t: float(v) for t, v in zip(chosen, w, strict=True) if abs(v) > 1e-3})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> Scorer:
    """The scorer learned from a bounded sample of the labelled rows outside the held-out third."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = texts(docs, "doc_id").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        got = sorted(
            (row["doc_id"], row["text"], row["toxic"]) for b in batches for row in b.select(["doc_id", "text", "toxic"]).to_pylist()
        )
        scorer = fit([t for _, t, _ in got], [int(y) for _, _, y in got], max_terms)
        terms, weights = ["", *scorer.weights], [scorer.intercept, *scorer.weights.values()]
        yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "weight": pa.array(weights, pa.float64())})

    model = rows.coalesce(1).mapInArrow(run, "term string, weight double").collect()
    weights = {r["term"]: r["weight"] for r in model}
    intercept = weights.pop("", None)
    return fit([], []) if intercept is None else Scorer(intercept, weights)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id and score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast((scorer.intercept, scorer.weights))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = Scorer(*shared.value)
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted."""
    return score(docs, train(docs, labels, max_rows)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"),
    )
