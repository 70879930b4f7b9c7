"""What several training-data operators share: words, lines, inputs, shared folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.session import new_folder

# The white space that separates words, as a character class.
WHITE = r"[\x20\x09-\x0D]"
NOT_WHITE = r"[^\x20\x09-\x0D]"
SHINGLE_WORDS = 5
BLOCK = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns of ``docs`` with a null text as the empty one; other columns go."""
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def words(text: Column) -> Column:
    """The maximal runs of non-white characters, in order (an empty array for none)."""
    return F.array_remove(F.split(text, f"{WHITE}+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` computed once, also where lambdas inside ``body`` use it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df: DataFrame, *keep: str) -> DataFrame:
    """``df`` whose columns but ``keep`` come out of a generator of one row.

    A later filter on them is then not pushed into their definitions, which it would compute a second time.
    """
    made = [c for c in df.columns if c not in keep]
    return df.select(*keep, F.inline_outer(F.array(F.struct(*made))))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def has_word(line: Column) -> Column:
    return line.rlike(NOT_WHITE)


def count_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are in the character class ``[characters]``."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def running_sums(values: Column, modulus: int | None = None) -> Column:
    """Sums of the values before each place and of all (one more than values; one zero for none).

    Blocks are summed by themselves first, so a million values are no quadratic work.
    """
    reduce = (lambda x: x % modulus) if modulus else (lambda x: x)
    add = lambda total, x: F.array_append(total, reduce(F.element_at(total, -1) + x))
    zero = F.array(F.lit(0).cast("long"))
    last = F.greatest(F.floor((F.size(values) - 1) / BLOCK), F.lit(0)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(values, k * BLOCK + 1, BLOCK), zero, add))

    def joined(inner: Column) -> Column:
        starts = F.aggregate(inner, zero, lambda total, b: add(total, F.element_at(b, -1)))
        shifted = F.zip_with(
            inner,
            F.slice(starts, 1, F.size(inner)),
            lambda b, s: F.transform(F.slice(b, 1, F.size(b) - 1), lambda x: reduce(x + s)),
        )
        return F.array_append(F.flatten(shifted), F.element_at(starts, -1))

    return let(blocks, joined)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written under the shared folder and read back: computed once, lineage cut."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
