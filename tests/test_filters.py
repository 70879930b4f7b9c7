"""Filter strings: what passes, what is refused, and that refusals name the fault."""

import pytest
from conftest import rows

from carepath.functions.filters import FilterError, check_filter, filter_column
from carepath.sources import traces

SCHEMA = "trace_id string, state string, value int, `my col` int, info struct<kind:string>"


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(
        [("1", "OK", 5, 1, ("a",)), ("2", "ERROR", 60, 2, ("b",)), ("3", None, None, 3, None), ("4", "OK", 70, 4, ("b",))], SCHEMA
    )


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("state = 'OK'", "14"), ("STATE = 'OK' AND value > 50", "4"), ("NOT (state = 'OK' OR value >= 60)", ""),
        ("value IN (5, 60)", "12"), ("value NOT IN (5, 60)", "4"), ("state IS NULL", "3"), ("state IS NOT NULL", "124"),
        ("value BETWEEN 5 AND 60", "12"), ("state LIKE 'E%'", "2"), ("`my col` <> 1 AND info.kind = 'b'", "24"),
        ("state <=> NULL", "3"), ("value = -5", ""), ("trace_id = 'it''s -- ; DROP'", ""),
    ],
)
def test_predicates(frame, text, ids):
    assert "".join(r[0] for r in rows(frame.where(filter_column(frame, text)).select("trace_id"))) == ids


@pytest.mark.parametrize(
    ("text", "named"),
    [
        ("status = 'OK'", "status"), ("state = nobody", "nobody"), ("upper(state) = 'OK'", "upper"), ("x.y = 1", "x.y"),
        ("java_method('java.lang.System', 'exit', 1) = 'a'", "java_method"), ("state IN (SELECT 'OK')", "InSubquery"),
        ("EXISTS (SELECT 1)", "Exists"), ("value + 1 > 2", "Add"), ("CAST(value AS string) = '5'", "Cast"),
        ("state = current_user", "current_user"), ("state RLIKE '(a+)+'", "RLike"), ("state = ", "not a predicate"), ("", "not a predicate"),
        ("true", "constant"), ("state = :name", "name"), ("state = 'OK'; DROP TABLE t", "not a predicate"),
    ],
)
def test_refusals_name_the_fault(frame, text, named):
    with pytest.raises(FilterError, match=named.replace(".", "[.]") if named != "name" else "Parameter"):
        check_filter(frame, text)


def test_a_search_is_checked_before_it_runs(frame):
    assert rows(traces.trace_search(frame, "value > 50").select("trace_id")) == [("2",), ("4",)]
    with pytest.raises(FilterError, match="'valeu'"):
        traces.trace_search(frame, "valeu > 50")
    with pytest.raises(FilterError, match="20000 characters"):
        traces.trace_search(frame, "x" * 20_000)
