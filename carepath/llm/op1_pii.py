"""Personal data by weak supervision: labelers vote on candidate spans, a span classifier learns from the votes.

Four kinds are found by fixed patterns and checks (the base); those spans always stay. Further kinds (secrets,
bank accounts, national ids, phone numbers without a country code, persons, addresses) have candidates that a wide
pattern finds. Regex, gazetteer and context labelers vote for, against or not at all on every candidate, failed base
matches included. Expectation-maximisation on the counts of equal vote patterns estimates each labeler's reliability, with
the base's checks as anchors; a logistic regression over the span's kind, shape and votes is trained on the resulting posteriors, and candidates it
finds likelier personal than not become spans, unless they overlap a base span.

All text work is in built-in functions: texts are scanned once, only spans with their votes are stored, and the
tables that reach the driver are counts of patterns of nine discrete columns, bounded by their definition and not by
the data. There is no shuffle but that of these counts.

Defined results: a null or empty text has no spans; repeated rows are searched one by one; a null doc_id is passed
on; without any candidate the base spans are all; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import let, running_sums, stored, texts

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "account", "national_id", "local_phone", "person", "address")
KINDS = BASE + EXTRA
CONTEXT = 40

# The base patterns. Possessive repetition and the look-behinds change no match (a run that fails
# from its start fails from every place in it), they keep long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
# Gazetteers.
GIVEN_NAMES = (
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph "
    "Jessica Thomas Sarah Charles Karen Anna Peter Hans Klaus Ursula Monika Wolfgang Jürgen Stefan Petra Jean Marie "
    "Pierre Michel Nathalie Isabelle François Sophie José María Antonio Carmen Juan Ana Manuel Pilar Luis Laura"
).split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Mme Mlle Sr Sra".split()
STREETS = "Street St Avenue Ave Road Rd Lane Ln Boulevard Blvd Drive Court Square".split()
IBAN_COUNTRIES = "AT BE CH CZ DE DK ES FI FR GB GR IE IT LU NL NO PL PT SE".split()
KEY_PREFIXES = "AKIA ghp_ gho_ sk- sk_ xoxb xoxp AIza eyJ".split()
# Words before a span that speak for its kind, and against any.
SPEAKS_FOR = {
    "secret": "token|secret|api[_ -]?key|key|password|passwd|pwd|auth|bearer|credential",
    "account": "iban|account|konto|compte|cuenta",
    "national_id": "ssn|social security|national id|sozialversicherung|insee|dni",
    "local_phone": "call|phone|tel|telephone|mobile|fax|telefon|téléphone|teléfono",
    "person": "name|dear|signed|contact|regards|attn|hallo|bonjour|hola|by",
    "address": "address|lives at|live at|ship to|adresse|dirección|domicile",
    "email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "call|phone|tel|mobile|fax",
}
SPEAKS_AGAINST = "version|commit|checksum|sha1|sha256|md5|isbn|issn|doi|part no|order no|build|revision|example"
PLACEHOLDER = r"(?i)x{4,}|0{8,}|1{8,}|12345678|example|dummy|placeholder|lorem"


def _any(found: list[str]) -> str:
    return "(?:" + "|".join(found) + ")"


SHAPES = {
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{20,}+=*+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])",
    "person": rf"(?<![A-Za-z]){_any(TITLES)}\.?\x20[A-Z]\p{{Ll}}+(?:\x20[A-Z]\p{{Ll}}+)?"
    rf"|(?<![A-Za-z]){_any(GIVEN_NAMES)}\x20[A-Z]\p{{Ll}}+",
    "address": rf"(?<![0-9])[0-9]{{1,5}}\x20(?:[A-Z]\p{{Ll}}+\x20){{1,3}}{_any(STREETS)}(?![A-Za-z])",
}
VOTERS = ("checked", "listed", "spoken_for", "spoken_against", "assigned", "placeholder", "company")


def _found(text: Column, pattern: str, gate: Column) -> Column:
    """Structs of start, end, match, before and after for every match of ``pattern`` in ``text``.

    The pieces between matches give the places: a match starts where all pieces and matches before it end.
    """
    empty = F.slice(
        F.array(F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("e"), F.lit("").alias("m"),
                         F.lit("").alias("before"), F.lit("").alias("after"))), 1, 0)

    def placed(matches: Column, pieces: Column, ends: Column) -> Column:
        return F.transform(
            matches,
            lambda m, i: let(
                F.get(ends, i) + F.length(F.get(pieces, i)),
                lambda s: F.struct(
                    s.alias("s"),
                    (s + F.length(m)).alias("e"),
                    m.alias("m"),
                    F.right(F.get(pieces, i), F.lit(CONTEXT)).alias("before"),
                    F.left(F.get(pieces, i + 1), F.lit(1)).alias("after"),
                ),
            ),
        )

    whole = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda matches: let(
            F.split(text, pattern, -1),
            lambda pieces: let(
                running_sums(F.zip_with(matches, F.slice(pieces, 1, F.size(matches)), lambda m, p: (F.length(m) + F.length(p)).cast("long"))),
                lambda ends: placed(matches, pieces, ends),
            ),
        ),
    )
    return F.when(gate, whole).otherwise(empty)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a sound Luhn checksum."""

    def doubled(d: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    values = let(
        F.reverse(digits),
        lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda k: F.substring(r, k, F.lit(1)).cast("int")),
    )
    return F.aggregate(F.transform(values, doubled), F.lit(0), lambda n, x: n + x) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    """The check behind a base pattern."""
    if kind == "ip":
        part = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
        return F.forall(F.split(match, r"\."), lambda p: p.rlike(part))
    if kind == "card":
        return let(_digits(match), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _iban_sound(match: Column) -> Column:
    """The remainder of 97 over an account number's letters and digits, taken in short steps."""
    plain = F.regexp_replace(match, r"\x20", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    value = lambda c: F.when(F.ascii(c) < 58, F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda r, v: F.when(v > 9, r * 100 + v).otherwise(r * 10 + v) % 97
    codes = let(turned, lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda k: F.substring(t, k, F.lit(1))))
    return F.aggregate(codes, F.lit(0), lambda r, c: step(r, value(c))) == 1


def _checked(kind: str, match: Column) -> Column:
    if kind in BASE:
        return F.when(_passes(kind, match), 1).otherwise(-1)
    if kind == "secret":
        n = F.length(_digits(match))
        return F.when((n * 8 >= F.length(match)) & ~match.contains("//"), 1).otherwise(-1)
    if kind == "account":
        return F.when(_iban_sound(match), 1).otherwise(-1)
    if kind == "national_id":
        return F.when(match.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), 1).otherwise(-1)
    return F.lit(1) if kind in ("local_phone", "address") else F.lit(0)


def _listed(kind: str, match: Column) -> Column:
    starts = {"account": IBAN_COUNTRIES, "secret": KEY_PREFIXES}
    if kind in starts:
        return F.when(match.rlike("^" + _any(starts[kind])), 1).otherwise(0)
    if kind == "person":
        return F.when(match.rlike(_any(GIVEN_NAMES)), 1).otherwise(0)
    return F.lit(1) if kind == "address" else F.lit(0)


def _labelled(kind: str, spans: Column, companions: Column) -> Column:
    """Candidates of one kind with their votes and shape."""

    def one(x: Column) -> Column:
        before = F.lower(x["before"])
        votes = {
            "checked": _checked(kind, x["m"]),
            "listed": _listed(kind, x["m"]),
            "spoken_for": F.when(before.rlike(rf"(?:{SPEAKS_FOR[kind]})\W{{0,3}}(?:\w+\W{{1,3}})?$"), 1).otherwise(0),
            "spoken_against": F.when(before.rlike(rf"(?:{SPEAKS_AGAINST})\W{{0,4}}$"), -1).otherwise(0),
            "assigned": F.when(x["before"].rlike(r"[=:]\s*[\"']?$"), 1).otherwise(0),
            "placeholder": F.when(x["m"].rlike(PLACEHOLDER), -1).otherwise(0),
            "company": F.when(companions > 0, 1).otherwise(0),
        }
        return F.struct(
            x["s"].alias("s"),
            F.lit(KINDS.index(kind)).alias("k"),
            x["e"].alias("e"),
            F.least(F.floor(F.length(x["m"]) / 8), F.lit(5)).cast("int").alias("size"),
            *(votes[v].cast("int").alias(v) for v in VOTERS),
        )

    return F.transform(spans, one)


def _passed(kind: str) -> Column:
    return F.transform(
        F.filter(F.col(kind), lambda x: _passes(kind, x["m"])),
        lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")),
    )


def candidates(docs: DataFrame, keep: str = "doc_id") -> DataFrame:
    """doc_id, base (spans that pass) and votes (every candidate with its votes), one row per row."""
    rows = texts(docs, keep)
    text = F.col("text")
    gates = {k: text.contains(GATES[k]) if k == "email" else text.rlike(GATES[k]) for k in BASE}
    shapes = {k: text.rlike(SHAPES[k]) for k in EXTRA}
    found = rows.select(
        keep,
        *(_found(text, PATTERNS[k], gates[k]).alias(k) for k in BASE),
        *(_found(text, SHAPES[k], shapes[k]).alias(k) for k in EXTRA),
    )
    passed = [_passed(k) for k in BASE]
    based = found.select("*", F.sort_array(F.concat(*passed)).alias("base"))
    votes = F.concat(*(_labelled(k, F.col(k), F.size("base") - (1 if k in BASE else 0)) for k in KINDS))
    return based.select(keep, "base", votes.alias("votes"))


@dataclass
class Labelers:
    """P(vote | personal or not) of every voter, and the share of personal candidates."""

    share: float
    chances: dict[str, dict[int, tuple[float, float]]]

    def posterior(self, row: dict) -> float:
        odds = math.log(self.share / (1 - self.share))
        for v in VOTERS:
            no, yes = self.chances[v][row[v]]
            odds += math.log(yes / no)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def _anchored(row: dict, model: Labelers) -> float:
    """Base candidates are decided by their checks; all others by the votes."""
    return float(row["checked"] == 1) if row["k"] < len(BASE) else model.posterior(row)


def estimate(patterns: list[dict], rounds: int = 60) -> Labelers:
    """Expectation-maximisation on counted vote patterns; voters start out better than chance."""
    start = {v: {-1: (0.5, 0.1), 0: (0.35, 0.3), 1: (0.15, 0.6)} for v in VOTERS}
    model = Labelers(0.5, start)
    for _ in range(rounds if patterns else 0):
        q = [_anchored(p, model) for p in patterns]
        total = sum(p["n"] for p in patterns)
        yes = sum(p["n"] * x for p, x in zip(patterns, q, strict=True))
        chances = {}
        for v in VOTERS:
            chances[v] = {}
            for vote in (-1, 0, 1):
                mine = [(p["n"], x) for p, x in zip(patterns, q, strict=True) if p[v] == vote]
                # a few made-up candidates that vote as the start says keep every chance above zero
                chances[v][vote] = (
                    (sum(n * (1 - x) for n, x in mine) + 10 * start[v][vote][0]) / (total - yes + 10),
                    (sum(n * x for n, x in mine) + 10 * start[v][vote][1]) / (yes + 10),
                )
        model = Labelers(min(0.99, max(0.01, yes / total)), chances)
    return model


def _features(row: dict) -> list[str]:
    return [f"kind {row['k']}", f"size {row['size']}", *(f"{v} {row[v]}" for v in VOTERS if row[v])]


def train(patterns: list[dict], labelers: Labelers, rounds: int = 400) -> dict[str, float]:
    """Logistic regression on the posteriors, each pattern weighted by the root of its count; "" is the intercept."""
    target = [_anchored(p, labelers) for p in patterns]
    weight = [math.sqrt(p["n"]) for p in patterns]
    found = [["", *_features(p)] for p in patterns]
    w: dict[str, float] = {f: 0.0 for fs in found for f in fs}
    square = dict.fromkeys(w, 1e-6)
    total = sum(weight)
    for _ in range(rounds):
        gradient = {f: 1e-4 * v for f, v in w.items()}
        for fs, y, n in zip(found, target, weight, strict=True):
            odds = sum(w[f] for f in fs)
            error = n * (1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))) - y) / total
            for f in fs:
                gradient[f] += error
        for f, g in gradient.items():
            square[f] += g * g
            w[f] -= 0.5 * g / math.sqrt(square[f])
    return w


def classifier(found: DataFrame) -> dict[str, float]:
    """The span classifier learned from all candidates of ``found``."""
    counted = found.select(F.explode("votes").alias("v")).groupBy("v.k", "v.size", *(f"v.{v}" for v in VOTERS))
    patterns = [r.asDict() for r in counted.agg(F.count(F.lit(1)).alias("n")).collect()]
    patterns.sort(key=lambda p: tuple(p[c] for c in ("k", "size", *VOTERS)))
    return train(patterns, estimate(patterns))


def _odds(weights: dict[str, float], x: Column) -> Column:
    def pick(column: str) -> Column:
        given = {f.split(" ", 1)[1]: w for f, w in weights.items() if f.startswith(f"{column} ")}
        out = F.lit(0.0)
        for value, w in given.items():
            out = F.when(x[column if column != "kind" else "k"] == int(value), w).otherwise(out)
        return out

    total = F.lit(weights.get("", -1.0))
    for column in ("kind", "size", *VOTERS):
        total = total + pick(column)
    return total


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (s, k, e), start, index in KINDS and exclusive end, ascending."""
    found = stored(candidates(docs), "pii-candidates")
    weights = classifier(found)
    added = F.transform(
        F.filter(
            F.col("votes"),
            lambda x: (x["k"] >= len(BASE))
            & ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
            & (_odds(weights, x) > 0),
        ),
        lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")),
    )
    return found.select("doc_id", "base", F.sort_array(F.concat("base", added)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["k"] == KINDS.index(kind))).cast("long")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of the base spans, and all spans."""
    found = find(docs)
    counts = [_count(k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
