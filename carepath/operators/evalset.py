"""Evaluation records: built from claims, keyed by their text, merged and written."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath import schemas
from carepath.functions.ranking import PARTIAL_LIMIT_N, newest_per_key, smallest_distinct, total_order
from carepath.functions.text import long_id, question_id, record_id, short_id

if TYPE_CHECKING:
    from carepath.sources.claims import Claims

DOCUMENT_LIMIT = 1000
NUM_EVALS = 10


def document_text() -> Column:
    """A medical claim as labelled text; a NULL value drops out, its label stays."""
    # The labels and their order.
    return F.concat_ws(
        " ",
        F.lit("PATIENT_ID:"), "patient_id",
        F.lit("CLAIM_ID:"), "claim_id",
        F.lit("DATE_SERVICE:"), F.col("date_service").cast("string"),
        F.lit("LOCATION_OF_CARE:"), "location_of_care",
        F.lit("PAY_TYPE:"), "pay_type",
    )


def _newest_claims(medical_claim: DataFrame, patient_id: str | None, limit: int | None) -> DataFrame:
    if limit is not None and limit < 1:
        raise ValueError(f"limit must be at least 1 or None, got {limit}")
    columns = schemas.MEDICAL_CLAIM.fieldNames()
    rows = medical_claim.select(*columns)
    order = total_order("date_service", columns)
    if patient_id is not None:
        rows = rows.where(F.col("patient_id") == F.lit(patient_id))
        return rows if limit is None else rows.orderBy(*order).limit(limit)
    return rows if limit is None else newest_per_key(rows, ["patient_id"], order, limit, single_stage_n=PARTIAL_LIMIT_N)


def claim_documents(
    medical_claim: DataFrame, patient_id: str | None = None, limit: int | None = DOCUMENT_LIMIT
) -> DataFrame:
    """Claims as documents (id, content, doc_uri): the newest ``limit`` of one patient, or of every patient."""
    return _newest_claims(medical_claim, patient_id, limit).select(
        F.col("patient_id").alias("id"),
        document_text().alias("content"),
        F.concat_ws(" ", F.lit("PATIENT_ID:"), "patient_id").alias("doc_uri"),
    )


def _templates() -> list[tuple[Column, Column]]:
    """(question, expected facts) per claim.  Every question names the patient."""
    pid, cid, day = F.col("patient_id"), F.col("claim_id"), F.col("date_service").cast("string")
    place, payer = F.col("location_of_care"), F.col("pay_type")
    ask = F.concat
    return [
        (ask(F.lit("On which date was claim "), cid, F.lit(" of patient "), pid, F.lit(" served?")), F.array(day)),
        (ask(F.lit("Where was care given to patient "), pid, F.lit(" under claim "), cid, F.lit("?")), F.array(place)),
        (ask(F.lit("Which payer covered claim "), cid, F.lit(" of patient "), pid, F.lit("?")), F.array(payer)),
        (ask(F.lit("Summarise claim "), cid, F.lit(" of patient "), pid, F.lit(".")), F.array(cid, day, place, payer)),
    ]


def generate_evals(
    medical_claim: DataFrame,
    num_evals: int = NUM_EVALS,
    patient_id: str | None = None,
    document_limit: int | None = DOCUMENT_LIMIT,
) -> DataFrame:
    """``num_evals`` question records per patient out of its newest claims.

    Each claim meets each template by an explode inside its row.  The choice is
    the smallest record ids (md5 of the question), so it is the same on every run.
    A question names its patient, so rows are dealt out by patient once, as claims;
    their questions are told apart and cut there by id, and written out after the cut.
    """
    named = _newest_claims(medical_claim, patient_id, document_limit).select("*", _question_ids(_templates()))
    chosen = smallest_distinct(named, ["patient_id"], "dataset_record_id", num_evals)
    chosen = chosen.withColumn("content", document_text())
    # a claim recorded twice asks its questions once
    records = newest_per_key(
        chosen,
        ["patient_id", "dataset_record_id"],
        [F.col("content").asc_nulls_last(), F.col("date_service_end").asc_nulls_last()],
        1,
    )
    question, facts = _of_template(_templates())
    return records.withColumns({"question": question, "expected_facts": facts}).select(
        "dataset_record_id", "patient_id", "claim_id", "date_service", "location_of_care", "pay_type",
        F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))).alias("messages"),
        "expected_facts", "content",
        F.concat_ws(" ", F.lit("PATIENT_ID:"), "patient_id").alias("doc_uri"),
    )


def _question_ids(templates: list[tuple[Column, Column]]) -> Column:
    """A row per template: ``_no`` and the question's record id, NULL where there is no question or no fact."""
    ids = [F.when(F.size(F.array_compact(facts)) > 0, question_id(question)) for question, facts in templates]
    return F.posexplode_outer(F.array(*ids)).alias("_no", "dataset_record_id")


def _of_template(templates: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Question and facts of a row's template ``_no``."""
    pick = lambda values: F.array(*values)[F.col("_no")]
    return pick([question for question, _ in templates]), F.array_compact(pick([facts for _, facts in templates]))


def _table_questions() -> dict[str, list[tuple[Column, Column]]]:
    """(question, expected facts) per row of each claim table; a question's facts are in its own row.

    The last diagnosis question also asks for what the medical claim says, which is joined to the chosen ones.
    """
    pid, cid = F.col("patient_id"), F.col("claim_id")
    day = F.col("date_service").cast("string")
    since = F.col("date_start").cast("string")
    code = F.col("diagnosis_code")
    ask = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return {
        "enrollment": [
            (ask("In which state was patient ", pid, " enrolled from ", since, "?"), F.array("patient_state")),
            (ask("Which benefit and payer did patient ", pid, " have from ", since, "?"), F.array("benefit_type", "pay_type")),
        ],
        "medical_claim": _templates(),
        "diagnosis": [
            (ask("On which date was diagnosis ", code, " given to patient ", pid, " under claim ", cid, "?"), F.array(day)),
            (ask("When and where was patient ", pid, " seen for diagnosis ", code, " of claim ", cid, "?"), F.array(day)),
        ],
        "pharmacy_claim": [
            (ask("Which drug did patient ", pid, " get under claim ", cid, "?"), F.array("ndc")),
            (ask("How many days of supply did patient ", pid, " get under claim ", cid, "?"), F.array(F.col("days_supply").cast("string"))),
        ],
        "procedure": [
            (ask("On which date was procedure ", F.col("procedure_code"), " of claim ", cid, " done for patient ", pid, "?"), F.array(day)),
        ],
    }


QUOTA = 2


def generate_table_evals(claims: Claims, quota: int = QUOTA) -> DataFrame:
    """Questions over all five claim tables: per patient the ``quota`` smallest record ids of each table.

    Result: (dataset_record_id, source_table, patient_id, claim_id, question, expected_facts).  A sample stratified by
    table: a patient whom only one table knows gets that table's questions, and a table with many rows doesn't push
    the others out.  A question asked by several rows is one record with the smallest of their facts.  Facts that the
    medical claim holds are joined to the chosen questions only, not to all rows.
    """
    short = {"_p": short_id(F.col("patient_id")), "_c": short_id(F.col("claim_id"))}
    located = claims.medical_claim.where(F.col("location_of_care").isNotNull())
    places = located.groupBy(*[value.alias(name) for name, value in short.items()]).agg(F.min("location_of_care").alias("place"))
    parts = []
    for table, templates in _table_questions().items():
        rows = getattr(claims, table)
        if table == "enrollment":
            rows = rows.withColumn("claim_id", F.lit(None).cast("string"))
        # rows are cut by the questions' ids, all ids as bytes; the questions themselves are written out after the cut
        others = [c for c in rows.columns if c not in ("patient_id", "claim_id")]
        asked = rows.withColumns(short).select("*", _question_ids(templates)).where(F.col("dataset_record_id").isNotNull())
        packed = asked.select(*others, "_no", *short, F.unhex("dataset_record_id").alias("_id"))
        chosen = smallest_distinct(packed, ["_p"], "_id", quota)
        chosen = chosen.withColumns({"patient_id": long_id(F.col("_p")), "claim_id": long_id(F.col("_c"))})
        question, facts = _of_template(templates)
        # a row per question, whatever number of rows ask it
        once = chosen.groupBy("_p", "_id").agg(
            F.min(F.struct(facts.alias("facts"), question.alias("question"), "claim_id")).alias("r")
        )
        once = once.select("_p", "_id", "r.claim_id", "r.question", F.col("r.facts").alias("expected_facts"))
        if table == "diagnosis":
            once = once.withColumn("_c", short["_c"]).join(places, ["_p", "_c"], "left")
            both = F.col("question").startswith("When and where ") & F.col("place").isNotNull()
            facts = F.when(both, F.array_append("expected_facts", F.col("place"))).otherwise(F.col("expected_facts"))
            once = once.withColumn("expected_facts", facts)
        once = once.withColumns({"dataset_record_id": F.lower(F.hex("_id")), "patient_id": long_id(F.col("_p"))})
        parts.append(
            once.select("dataset_record_id", F.lit(table).alias("source_table"), "patient_id", "claim_id", "question", "expected_facts")
        )
    return reduce(DataFrame.unionByName, parts)


def eval_rows(evals: DataFrame, created_by: str, at: Column) -> DataFrame:
    """Eval records in the nested evaluation-table schema, from document-based evals."""
    source = F.struct(
        F.lit(None).cast("struct<user_name:string>").alias("human"),
        F.struct("doc_uri", "content").alias("document"),
        F.lit(None).cast("struct<trace_id:string>").alias("trace"),
    )
    return _table_rows(evals, created_by, at, source, F.struct("expected_facts"))


def trace_to_record(traces: DataFrame, created_by: str = "trace") -> DataFrame:
    """Traces (trace_id, ts, request, response) as records whose source names the trace."""
    messages = F.array(F.struct(F.lit("user").alias("role"), F.col("request").alias("content")))
    source = F.struct(
        F.lit(None).cast("struct<user_name:string>").alias("human"),
        F.lit(None).cast("struct<doc_uri:string,content:string>").alias("document"),
        F.struct("trace_id").alias("trace"),
    )
    rows = traces.withColumn("messages", messages).withColumn("dataset_record_id", record_id(F.col("messages")))
    nothing = F.lit(None).cast(schemas.EVAL_EXPECTATIONS)
    return _table_rows(rows, created_by, F.col("ts"), source, nothing)


def _table_rows(df: DataFrame, created_by: str, at: Column, source: Column, expectations: Column) -> DataFrame:
    values = {
        "dataset_record_id": F.col("dataset_record_id"),
        "create_time": at,
        "created_by": F.lit(created_by),
        "last_update_time": at,
        "last_updated_by": F.lit(created_by),
        "source": source,
        "inputs": F.to_json(F.struct("messages")),
        "expectations": F.to_json(expectations),
        "tags": F.create_map().cast("map<string,string>"),
    }
    return df.select(
        *[values[f.name].cast(f.dataType).alias(f.name) for f in schemas.EVAL_TABLE.fields]
    )


def upsert_records(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Records of both frames, one per id: the newest update wins, the first creation is kept.

    One aggregation over the union; many versions of one record meet in the
    map-side combine.  On equal times an update beats the existing record, then
    the larger text decides, so the result does not depend on row order.
    """
    columns = schemas.EVAL_TABLE.fieldNames()
    both = existing.select(*columns, F.lit(0).alias("_side")).unionByName(
        updates.select(*columns, F.lit(1).alias("_side"))
    )
    newest = F.struct("last_update_time", "_side", "inputs", "expectations", "last_updated_by")
    born = F.struct("create_time", "created_by")
    kept = both.groupBy("dataset_record_id").agg(
        F.max_by(F.struct(*[c for c in columns if c != "dataset_record_id"]), newest).alias("r"),
        F.min(F.when(F.col("create_time").isNotNull(), born)).alias("b"),
    )
    picked = {c: F.col(f"r.{c}") for c in columns}
    picked["dataset_record_id"] = F.col("dataset_record_id")
    picked["create_time"] = F.col("b.create_time")
    picked["created_by"] = F.col("b.created_by")
    return kept.select(*[picked[c].alias(c) for c in columns])


def _row_digest(rows: DataFrame) -> Column:
    """128 bits of a record's values; a creation without a time counts without its author, as an upsert has it."""
    values = {f.name: F.unix_micros(f.name).alias(f.name) for f in schemas.EVAL_TABLE.fields if f.dataType == schemas.TIME}
    values["created_by"] = F.when(F.col("create_time").isNotNull(), F.col("created_by")).alias("created_by")
    # maps have no order; their entries in order of key do
    values["tags"] = F.array_sort(F.map_entries("tags")).alias("tags")
    return F.unhex(F.md5(F.to_json(F.struct(*[values.get(c, F.col(c)) for c in schemas.EVAL_TABLE.fieldNames()]))))


def changed_ids(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """The ids (dataset_record_id) whose records ``upsert_records`` would leave otherwise than they are in ``existing``.

    Only ids and digests are shuffled.  An id stays as it is where it has one existing record, normal
    in its creation, and no update that differs from it.
    """
    ids = F.col("dataset_record_id")
    odd = F.col("create_time").isNull() & F.col("created_by").isNotNull()
    both = existing.select(ids, _row_digest(existing).alias("d"), odd.alias("odd"), F.lit(1).alias("old")).unionByName(
        updates.select(ids, _row_digest(updates).alias("d"), F.lit(False).alias("odd"), F.lit(0).alias("old"))
    )
    seen = both.groupBy("dataset_record_id").agg(
        F.sum("old").alias("n"), F.max("odd").alias("odd"), F.min("d").alias("lo"), F.max("d").alias("hi")
    )
    return seen.where((F.col("n") != 1) | F.col("odd") | (F.col("lo") != F.col("hi"))).select("dataset_record_id")


def sync_labels(dataset: DataFrame, labels: DataFrame) -> DataFrame:
    """Human expectations back into the dataset.

    ``labels``: (dataset_record_id, user_name, expected_facts, labelled_at).  The
    newest label of a record replaces its expectations; records without one stay.
    """
    newest = (
        labels.where(F.col("expected_facts").isNotNull())
        .groupBy("dataset_record_id")
        .agg(F.max(F.struct("labelled_at", "user_name", "expected_facts")).alias("l"))
    )
    d = dataset.join(newest, "dataset_record_id", "left")
    labelled = F.col("l").isNotNull()
    source = F.struct(
        F.when(labelled, F.struct(F.col("l.user_name").alias("user_name")))
        .otherwise(F.col("source.human"))
        .alias("human"),
        F.col("source.document").alias("document"),
        F.col("source.trace").alias("trace"),
    )
    changed = {
        "source": F.when(labelled, source).otherwise(F.col("source")),
        "expectations": F.when(
            labelled, F.to_json(F.struct(F.col("l.expected_facts").alias("expected_facts")))
        ).otherwise(F.col("expectations")),
        "last_updated_by": F.coalesce("l.user_name", "last_updated_by"),
        # a label never turns the record's time back; greatest skips NULLs
        "last_update_time": F.greatest("last_update_time", "l.labelled_at"),
    }
    return d.select(*[changed.get(c, F.col(c)).alias(c) for c in schemas.EVAL_TABLE.fieldNames()])
