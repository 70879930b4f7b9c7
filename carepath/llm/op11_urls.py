"""URL filters: host-suffix and path-prefix expressions met with hashed rules.

A rule (host, path, verdict) fits the URLs of its host and all subdomains whose path starts with the rule's path.
Each URL is written as expressions: every suffix of its host that starts at a label, followed by every prefix of its
path that ends with a slash (and by the empty path). A rule has one expression, its host and its path up to the
last slash; what follows that slash is its tail. Expressions meet rules by an equi-join on the first 32 bits of their
SHA-256; the whole digest, and the tail against what follows in the URL's path, are then confirmed. Of the rules that
fit a URL the longest wins (host and path together), of equally long ones the one with the longer host; if two rules
differ in nothing but the verdict, block wins. URLs that no rule fits get the method's verdict, ``default``.

Only expressions of shapes that some rule has (so many labels, a path of at most so many slashes) are written, so a
URL of a million slashes costs no more than the deepest rule; this loses nothing.

Distinct hosts and paths are judged once, so a URL that a third of all rows share is expanded once. Hits are reduced to
one rule per URL before the verdicts go back to the rows. Rules are copied to SALTS salts and expressions dealt over
them, so where Spark shuffles the join (it broadcasts rules only under its size threshold) an expression that a third
of all URLs have is spread over SALTS tasks; the join back is one that adaptive execution can split.

Defined results: a null URL or one without "://" has the empty host and path, no rule and the default verdict; a host
without letters, with empty labels or with a port is taken as it is; repeated rows each get a row; an empty table gives
no rows, an empty rule set no rules; other columns are not read by ``judge`` and are passed through by ``only_allowed``.
Rules with a null or empty host, a null path or a verdict other than allow or block are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 16
SHORT_DIGITS = 8

# The rules of the registered query (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def rule_table(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    """A short list of rules as a table whose size Spark knows."""
    entry = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*entry)))


def host_of(url: Column) -> Column:
    """Between the first "://" and the next slash, question mark, hash or end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*+)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to a question mark, hash or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?>.*?://)[^/?#]*+(/[^?#]*+)", 1), F.lit(""))


def checked_rules(rules: DataFrame) -> DataFrame:
    """host, path, verdict, tail, n_labels, n_slashes, digest, short of every rule; faulty ones end the query."""
    sound = (
        F.coalesce(F.length("host") > 0, F.lit(False))
        & F.col("path").isNotNull()
        & F.coalesce(F.col("verdict").isin("allow", "block"), F.lit(False))
    )
    fault = F.raise_error(F.concat(F.lit("not a rule: "), F.to_json(F.struct("host", "path", "verdict")))).cast("string")
    named = rules.select(
        F.when(sound, F.translate("host", UPPER, LOWER)).otherwise(fault).alias("host"), "path", "verdict"
    )
    folder = F.regexp_extract("path", "(?s)^(.*/)", 1)
    digest = F.sha2(F.concat("host", F.lit("\n"), folder), 256)
    return named.select(
        "*",
        F.substring(F.col("path"), F.length(folder) + 1, F.length("path")).alias("tail"),
        F.size(F.split("host", "[.]")).alias("n_labels"),
        F.length(F.regexp_replace(folder, "[^/]+", "")).alias("n_slashes"),
        digest.alias("digest"),
        F.substring(digest, 1, SHORT_DIGITS).alias("short"),
    )


def shapes(rules: DataFrame) -> dict[int, int]:
    """The most slashes of a rule's path for each number of labels that a rule's host has."""
    # one short row per number of labels; names in use have at most 127
    return {r["n_labels"]: r["most"] for r in rules.groupBy("n_labels").agg(F.max("n_slashes").alias("most")).collect()}


def _suffixes(host: Column, labels: list[int]) -> Column:
    """(n_labels, text) of the suffixes of ``host`` with the given numbers of labels, as far as it has so many."""
    n = F.size(F.split(host, "[.]"))
    one = lambda k: F.when(n >= k, F.struct(F.lit(k).alias("labels"), F.substring_index(host, ".", -k).alias("text")))
    return F.array_compact(F.array(*[one(k) for k in labels]))


def _prefixes(path: Column, most: int) -> Column:
    """(n_slashes, text) of the empty prefix of ``path`` and of those that end with one of its first ``most`` slashes."""
    cut = F.split(path, "/", most + 1)
    last = F.least(F.size(cut) - 1, F.lit(most))
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.struct(k.alias("slashes"), F.array_join(F.concat(F.slice(cut, 1, k), F.array(F.lit(""))), "/").alias("text")),
    )


def expressions(urls: DataFrame, reach: dict[int, int]) -> DataFrame:
    """host, path and one row per expression of a shape in ``reach``: digest, short, the length of its path prefix."""
    deepest = F.create_map(*[F.lit(x) for pair in sorted(reach.items()) for x in pair])
    host = F.explode(_suffixes(F.col("host"), sorted(reach))).alias("h")
    out = urls.select("host", "path", host).select(
        "host", "path", "h", F.explode(_prefixes(F.col("path"), max(reach.values()))).alias("p")
    )
    digest = F.sha2(F.concat("h.text", F.lit("\n"), "p.text"), 256)
    out = out.where(F.col("p.slashes") <= deepest[F.col("h.labels")])
    return out.select(
        "host", "path", F.length("p.text").alias("at"), digest.alias("digest"), F.substring(digest, 1, SHORT_DIGITS).alias("short")
    )


def winners(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, verdict of the distinct URLs (host, path) that a rule fits."""
    checked = checked_rules(rules)
    reach = shapes(checked)
    if not reach:
        return urls.select("host", "path", F.lit("").alias("rule"), F.lit("").alias("verdict")).where("false")
    salt = F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")
    ruled = checked.select(
        F.col("short"),
        F.explode(F.array(*[F.lit(k) for k in range(SALTS)])).alias("salt"),
        F.col("digest").alias("rule_digest"),
        "tail",
        F.struct(
            F.length(F.concat("host", "path")).alias("n"),
            F.length("host").alias("n_host"),
            F.when(F.col("verdict") == "block", 1).otherwise(0).alias("blocks"),
            F.concat("host", "path").alias("rule"),
        ).alias("r"),
    )
    met = expressions(urls, reach).withColumn("salt", salt).join(ruled, ["short", "salt"])
    fits = (F.col("digest") == F.col("rule_digest")) & F.startswith(F.substring(F.col("path"), F.col("at") + 1, F.length("path")), F.col("tail"))
    best = met.where(fits).groupBy("host", "path").agg(F.max("r").alias("r"))
    return best.select(
        "host", "path", F.col("r.rule").alias("rule"), F.when(F.col("r.blocks") == 1, "block").otherwise("allow").alias("verdict")
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null where none fits) and verdict, one row per row."""
    url = F.col("url")
    split_up = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    best = winners(split_up.select("host", "path").distinct(), rules)
    return split_up.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def only_allowed(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The rows of ``pages`` whose URL is allowed, with all their columns."""
    url = F.col("row.url")
    packed = pages.select(F.struct("*").alias("row")).select("row", host_of(url).alias("host"), path_of(url).alias("path"))
    best = winners(packed.select("host", "path").distinct(), rules)
    kept = packed.join(best, ["host", "path"], "left").where(F.coalesce("verdict", F.lit(default)) == "allow")
    return kept.select("row.*")
