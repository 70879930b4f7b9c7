"""Filter strings: checked against a frame's columns before anything runs."""

from __future__ import annotations

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a filter string may be made of, by the names of Spark's expressions.
ALLOWED = {
    "And", "Or", "Not", "EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual",
    "In", "IsNull", "IsNotNull", "Like", "Literal", "UnresolvedAttribute",
}
# BETWEEN reaches Spark as a call of this function.
ALLOWED_CALLS = {"between"}
MAX_LENGTH = 10_000


class FilterError(ValueError):
    """A filter string that may not run; the message names what is wrong with it."""


def _parts(expression) -> list[str]:
    names = expression.nameParts()
    return [names.apply(i) for i in range(names.size())]


def check_filter(df: DataFrame, text: str) -> None:
    """Raise FilterError unless ``text`` only compares columns of ``df`` and literals.

    Spark's own parser reads the string; of its result, comparisons, IN with a list, BETWEEN, LIKE,
    IS NULL, AND, OR and NOT pass.  Functions, subqueries, casts, arithmetic and parameters do not, and
    an unknown column is named.  Nothing is analysed or run.
    """
    if len(text) > MAX_LENGTH:
        raise FilterError(f"filter string of {len(text)} characters, at most {MAX_LENGTH}")
    try:
        root = df.sparkSession._jsparkSession.sessionState().sqlParser().parseExpression(text)
    except ParseException as error:
        raise FilterError(f"filter string {text!r} is not a predicate: {str(error).strip().splitlines()[0]}") from None
    known = {c.lower() for c in df.columns}
    waiting, predicate = [root], root.getClass().getSimpleName()
    if predicate == "Literal":
        raise FilterError(f"filter string {text!r} is a constant, not a predicate")
    while waiting:
        here = waiting.pop()
        kind = here.getClass().getSimpleName()
        if kind == "UnresolvedAttribute":
            name = _parts(here)
            if name[0].lower() not in known:
                raise FilterError(f"unknown column {'.'.join(name)!r} in filter string {text!r}")
        elif kind == "UnresolvedFunction":
            name = ".".join(_parts(here))
            if name.lower() not in ALLOWED_CALLS:
                raise FilterError(f"function {name!r} is not allowed in filter string {text!r}")
        elif kind not in ALLOWED:
            raise FilterError(f"{kind} is not allowed in filter string {text!r}")
        children = here.children()
        waiting += [children.apply(i) for i in range(children.size())]


def filter_column(df: DataFrame, text: str) -> Column:
    """The filter string as a condition on ``df``, checked."""
    check_filter(df, text)
    return F.expr(text)
