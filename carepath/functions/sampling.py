"""Repeatable hash sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_sample(name: str, trace_id: Column, rate: float) -> Column:
    """True for a ``rate`` share of traces, the same ones on every run and retry.

    The first 8 hex digits of md5("name:trace") are a number in [0, 2^32); the
    trace is kept while that number is below rate * 2^32.  Fixed-width lower-case
    hex compares as text exactly like the number, so no conversion is needed.
    Raising the rate keeps every trace of the smaller sample.
    """
    if not 0.0 <= rate <= 1.0:
        raise ValueError(f"sample rate must lie in [0, 1], got {rate}")
    bound = math.ceil(rate * 2**32)
    if bound >= 2**32:
        return trace_id.isNotNull()
    head = F.substring(F.md5(F.concat(F.lit(f"{name}:"), trace_id)), 1, 8)
    return head < F.lit(f"{bound:08x}")
