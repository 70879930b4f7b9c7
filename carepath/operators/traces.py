"""Trace JSON to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.schemas import TRACE_JSON


def trace_parse(traces: DataFrame) -> DataFrame:
    """(trace_id, state, request_preview, response_preview, assessments); absent keys give NULL or an empty list.

    Malformed JSON is read permissively: the row stays, its fields are NULL.
    """
    assessments = TRACE_JSON["info"].dataType["assessments"].dataType
    parsed = traces.select("trace_id", "state", F.from_json("trace", TRACE_JSON).alias("j"))
    return parsed.select(
        "trace_id",
        "state",
        F.col("j.request_preview").alias("request_preview"),
        F.col("j.response_preview").alias("response_preview"),
        F.coalesce(F.col("j.info.assessments"), F.array().cast(assessments)).alias("assessments"),
    )


def _rationale(a: Column) -> Column:
    """The rationale, or the expected value where it is empty or absent."""
    return F.coalesce(
        F.nullif(a["rationale"], F.lit("")), a["expectation"]["serialized_value"]["value"]
    )


def trace_assessments(parsed: DataFrame) -> DataFrame:
    """One row per assessment; feedback false and 0 are values, not blanks.

    posexplode_outer and a filter on its result: for plain posexplode the optimizer
    would put a size(...) > 0 filter below and parse every trace twice.
    """
    return parsed.select(
        "trace_id", "state", F.posexplode_outer("assessments").alias("pos", "a")
    ).where(F.col("pos").isNotNull()).select(
        "trace_id",
        "state",
        (F.col("pos") + 1).alias("assessment_no"),
        F.col("a.assessment_name").alias("name"),
        F.col("a.feedback.value").alias("feedback"),
        _rationale(F.col("a")).alias("rationale"),
    )


def trace_summary(parsed: DataFrame) -> DataFrame:
    """One row per trace with its number of assessments."""
    return parsed.select(
        "trace_id", "state", "request_preview", "response_preview", F.size("assessments").alias("n_assessments")
    )
