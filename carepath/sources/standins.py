"""Claim-shaped stand-ins over the star-schema test tables.

The values have no medical meaning; they only give every operator real rows in
the claim schemas, with ids of the same shape as real ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.sources.claims import Claims


class TestTables:
    """Lazy access to ``<sf_dir>/<name>.parquet``."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str, **options: str) -> DataFrame:
        """The table as a file stream.  The one-letter glob lets a single file be a stream source."""
        schema = getattr(self, name).schema
        reader = self.spark.readStream.schema(schema)
        for key, value in options.items():
            reader = reader.option(key, value)
        return reader.parquet(f"{self.sf_dir}/{name}.parque[t]")


def _md5_of(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def _claim_id(order_key: str) -> Column:
    return F.md5(F.concat(F.lit("c"), F.col(order_key).cast("string")))


def _service_date() -> Column:
    return F.col("o_orderdate").cast("date")


def _service_end(day: str) -> Column:
    return F.date_add(F.col(day), (F.col("o_orderkey") % 5).cast("int"))


def enrollment(t: TestTables) -> DataFrame:
    """One span per customer and year; orders are cut to that before any join."""
    spans = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(
        F.min("o_orderdate").cast("date").alias("date_start"),
        F.date_add(F.max("o_orderdate").cast("date"), 90).alias("date_end"),
    )
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    people = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment").join(
        places, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return spans.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        _md5_of("c_custkey").alias("patient_id"),
        F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("patient_gender"),
        (F.lit(1940) + F.col("c_custkey") % 60).cast("string").alias("patient_year_of_birth"),
        F.lpad((F.col("c_nationkey") * 37).cast("string"), 3, "0").alias("patient_zip3"),
        F.col("n_name").alias("patient_state"),
        "date_start",
        "date_end",
        F.col("r_name").alias("benefit_type"),
        F.col("c_mktsegment").alias("pay_type"),
    )


def medical_claim(t: TestTables, orders: DataFrame | None = None) -> DataFrame:
    people = t.customer.select("c_custkey", "c_mktsegment")
    orders = (t.orders if orders is None else orders).withColumn("_day", _service_date())
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        _claim_id("o_orderkey").alias("claim_id"),
        _md5_of("o_custkey").alias("patient_id"),
        F.col("_day").alias("date_service"),
        _service_end("_day").alias("date_service_end"),
        F.col("o_orderpriority").alias("location_of_care"),
        F.col("c_mktsegment").alias("pay_type"),
    )


def _lines(t: TestTables, lines: DataFrame, *order_cols: str | Column) -> DataFrame:
    """``lines`` with their orders.  Days and money are cast before the join, as they take fewer bytes in its shuffle."""
    orders = t.orders.select("o_orderkey", "o_custkey", *order_cols)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def diagnosis(t: TestTables) -> DataFrame:
    code = F.lpad((F.col("l_partkey") * 37 % 500).cast("string"), 5, "0")
    return _lines(t, t.lineitem, _service_date().alias("_day")).select(
        _claim_id("o_orderkey").alias("claim_id"),
        _md5_of("o_custkey").alias("patient_id"),
        F.col("_day").alias("date_service"),
        _service_end("_day").alias("date_service_end"),
        F.concat(F.lit("Z"), code).alias("diagnosis_code"),
        F.when(F.col("l_linestatus") == "F", "02").otherwise("01").alias("diagnosis_qual"),
        F.when(F.col("l_linenumber") == 1, "Y").otherwise("N").alias("admit_diagnosis_ind"),
    )


def _price() -> Column:
    return F.col("l_extendedprice").cast("decimal(18,2)")


def _discount() -> Column:
    return F.col("l_discount").cast("decimal(3,2)")


def pharmacy_claim(t: TestTables) -> DataFrame:
    line = F.concat(
        F.lit("rx"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")
    )
    lines = t.lineitem.withColumns({"_day": F.col("l_shipdate").cast("date"), "_price": _price(), "_discount": _discount()})
    price, discount = F.col("_price"), F.col("_discount")
    return _lines(t, lines, "o_orderpriority").select(
        F.md5(line).alias("claim_id"),
        _md5_of("o_custkey").alias("patient_id"),
        F.col("_day").alias("date_service"),
        F.lpad(F.col("l_partkey").cast("string"), 11, "0").alias("ndc"),
        F.col("l_linenumber").cast("int").alias("fill_number"),
        F.col("l_quantity").cast("int").alias("days_supply"),
        F.col("l_quantity").alias("dispensed_quantity"),
        F.col("o_orderpriority").alias("pay_type"),
        (price * discount).alias("copay_coinsurance"),
        price.alias("submitted_gross_due"),
        (price * (F.lit(1) - discount)).alias("paid_gross_due"),
    )


def procedure(t: TestTables) -> DataFrame:
    """The parts are joined first, so that the lines of an order leave its join side by side."""
    code = F.concat("p_type", F.lit("-"), F.col("p_size").cast("string"))
    parts = t.part.select("p_partkey", code.alias("_code"))
    lines = t.lineitem.withColumns({"_price": _price(), "_discount": _discount()})
    lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return _lines(t, lines, _service_date().alias("_day")).select(
        _claim_id("o_orderkey").alias("claim_id"),
        _md5_of("o_custkey").alias("patient_id"),
        F.col("l_linenumber").cast("string").alias("service_line_number"),
        F.col("_day").alias("date_service"),
        _service_end("_day").alias("date_service_end"),
        F.col("_code").alias("procedure_code"),
        F.col("l_returnflag").alias("procedure_qual"),
        F.col("l_quantity").alias("procedure_units"),
        F.lpad(F.col("l_suppkey").cast("string"), 4, "0").alias("revenue_code"),
        F.col("_price").alias("line_charge"),
        (F.col("_price") * (F.lit(1) - F.col("_discount"))).alias("line_allowed"),
    )


def claims(t: TestTables) -> Claims:
    return Claims(enrollment(t), medical_claim(t), diagnosis(t), pharmacy_claim(t), procedure(t))


# --- messages, traces, answers ----------------------------------------------------


def messages(t: TestTables) -> DataFrame:
    """conversations as (conv_id, turn, role, content, tool_calls).

    Stand-in rule: an assistant turn with turn % 4 = 1 asks for one tool.
    """
    call = F.array(
        F.struct(
            F.lit("get_patient_enrollment").alias("name"),
            F.create_map(F.lit("patient_id"), F.md5(F.col("conv_id").cast("string"))).alias("args"),
        )
    )
    asks = (F.col("role") == "assistant") & (F.col("turn") % 4 == 1)
    return t.conversations.select(
        "conv_id", "turn", "role", F.col("text").alias("content"), F.when(asks, call).alias("tool_calls")
    )


def traces_of(events: DataFrame) -> DataFrame:
    """events (batch or stream) as traces with a request, a response and tool output."""
    amount = F.col("value").cast("decimal(18,2)").cast("string")
    trace = F.col("event_id").cast("string")
    run = F.col("user_id").cast("string")
    return events.select(
        trace.alias("trace_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("OK").alias("state"),
        run.alias("run_id"),
        F.col("value").cast("decimal(18,2)").alias("value"),
        F.concat(F.lit("What happened in trace "), trace, F.lit(" of run "), run, F.lit("?")).alias("request"),
        F.concat_ws(
            " ",
            F.lit("Trace"),
            trace,
            F.when(F.col("event_type") != "error", F.concat(F.lit("of run "), run)),
            F.lit("reported"),
            F.col("event_type"),
            F.lit("with value"),
            amount,
        ).alias("response"),
        F.array(F.concat(F.lit("trace "), trace, F.lit(" "), F.col("props"))).alias("context"),
    )


def trace_json(events: DataFrame) -> DataFrame:
    """events as (trace_id, state, trace) where ``trace`` is JSON text of varied shape.

    By event_id % 8: 0 no info, 1 no assessments, 2 feedback false, 3 feedback 0,
    4 text feedback with a rationale, 5 empty rationale with an expectation,
    6 malformed text, 7 two assessments.
    """
    eid = F.col("event_id").cast("string")
    head = F.concat(
        F.lit('{"request_preview":"event '),
        eid,
        F.lit('","response_preview":"'),
        F.col("event_type"),
        F.lit('"'),
    )

    def one(name: str, rest: str) -> str:
        return '{"assessment_name":"' + name + '",' + rest + "}"

    # The assessment shapes.
    false_one = one("safety", '"feedback":{"value":false},"rationale":"blocked"')
    zero_one = one("relevance", '"feedback":{"value":0}')
    text_one = one("quality", '"feedback":{"value":"Good"},"rationale":"clear"')
    expected_one = one(
        "expected_facts", '"rationale":"","expectation":{"serialized_value":{"value":"the date"}}'
    )

    def info(*items: str) -> Column:
        return F.concat(head, F.lit(',"info":{"assessments":[' + ",".join(items) + "]}}"))

    shape = F.col("event_id") % 8
    body = (
        F.when(shape == 0, F.concat(head, F.lit("}")))
        .when(shape == 1, F.concat(head, F.lit(',"info":{}}')))
        .when(shape == 2, info(false_one))
        .when(shape == 3, info(zero_one))
        .when(shape == 4, info(text_one))
        .when(shape == 5, info(expected_one))
        .when(shape == 6, F.concat(F.lit("not json "), eid))
        .otherwise(info(false_one, text_one))
    )
    return events.select(
        eid.alias("trace_id"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("OK").alias("state"),
        body.alias("trace"),
    )


def stand_in_answer() -> Column:
    """A recorded answer over a medical claim: right, short of one fact, or with an unsupported one."""
    day = F.dayofmonth("date_service")
    return F.concat_ws(
        " ",
        F.lit("Claim"),
        F.col("claim_id"),
        F.lit("on"),
        F.col("date_service").cast("string"),
        F.when(day % 2 == 0, F.col("location_of_care")),
        F.when(day % 5 == 0, F.concat(F.lit("see ref"), F.col("claim_id").substr(1, 6))),
    )


def stand_in_context(document: Column) -> Column:
    """Tool output behind an answer: the claim document, or nothing at all on each seventh day."""
    return F.when(F.dayofmonth("date_service") % 7 == 0, F.array().cast("array<string>")).otherwise(
        F.array(document, F.concat_ws(" ", F.lit("PAY_TYPE:"), F.col("pay_type")))
    )
