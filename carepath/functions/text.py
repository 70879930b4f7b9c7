"""Text helpers as column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-case ASCII words and numbers of a text, in order, with repeats.

    Only ASCII pieces are lower-cased, so case folding cannot depend on the engine.
    Extracting them costs half of blanking the rest and splitting.
    """
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def tokens(text: Column) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(words(text))


def fact_tokens(words: Column) -> Column:
    """The tokens that hold a digit: ids, dates, codes, amounts."""
    return F.filter(words, lambda t: t.rlike("[0-9]"))


def full_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def message_text(messages: Column) -> Column:
    """Messages as plain text, one ``role:content`` line each (NULL content is empty)."""
    return F.array_join(
        F.transform(
            messages,
            lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(":"), F.coalesce(m["content"], F.lit(""))),
        ),
        "\n",
    )


def record_id(messages: Column) -> Column:
    """Stable identity of an eval record: md5 of its messages' text."""
    return F.md5(message_text(messages))


def question_id(question: Column) -> Column:
    """``record_id`` of one user message with this content, without an array per row; NULL for no question."""
    return F.md5(F.concat(F.lit("user:"), question))


def last_user_content(messages: Column) -> Column:
    """Content of the last user message that has content; NULL when there is none or it is empty."""
    users = F.filter(messages, lambda m: (m["role"] == "user") & m["content"].isNotNull())
    return F.nullif(F.try_element_at(users, F.lit(-1))["content"], F.lit(""))


def short_id(key: Column) -> Column:
    """An id as bytes, about half as many where it is 32 hexadecimal digits; equal ids only are equal."""
    half = F.concat(F.lit(bytearray([1])), F.unhex(key))
    whole = F.concat(F.lit(bytearray([0])), key.cast("binary"))
    return F.when(key.rlike(r"^[0-9a-f]{32}\z"), half).otherwise(whole)


def long_id(short: Column) -> Column:
    """The id that ``short_id`` made ``short`` of."""
    rest = F.substr(short, F.lit(2))
    return F.when(F.substr(short, F.lit(1), F.lit(1)) == F.lit(bytearray([1])), F.lower(F.hex(rest))).otherwise(rest.cast("string"))
