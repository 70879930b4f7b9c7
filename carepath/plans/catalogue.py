"""Every operator as a named query over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath import schemas
from carepath.functions.text import full_date, record_id
from carepath.operators import (
    evalset, labels, lookups, messages, population, retrieval, routing, scorers, timeline, traces,
)
from carepath.plans import evaluation
from carepath.session import new_folder
from carepath.sources import claim_index, record_store
from carepath.sources import claims as claim_tables
from carepath.sources import standins
from carepath.sources import traces as trace_sources
from carepath.sources.standins import TestTables
from carepath.streaming import config, monitor

# The patient whose key single-patient queries use.
SAMPLE_PATIENT = "70efdf2ec9b086079795c442636b55fb"
REVIEWERS = ("reviewer_a", "reviewer_b")
# A backlog is worked off in micro-batches of this many bytes.
STREAM_BATCH = str(256 * 2**30)
SYSTEM_PROMPT = "Answer questions on patient claims only; give full dates."
# Names and rates of the three registered scorers.
MONITOR = (
    config.MonitorScorer("safety_check", "safety", 0.5),
    config.MonitorScorer("is_english", "guideline_english", 0.7),
    config.MonitorScorer("is_grounded", "groundedness", 0.8, "state = 'OK'"),
)

QUERIES: dict[str, Callable[[TestTables], DataFrame]] = {}


def query(fn: Callable[[TestTables], DataFrame]) -> Callable[[TestTables], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def as_entries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def entry(fn: Callable[[TestTables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(TestTables(spark, sf_dir))

        run.__name__ = fn.__name__
        return run

    return {name: entry(fn) for name, fn in QUERIES.items()}


# --- sources and sinks ----------------------------------------------------------


@query
def scan_claims(t):
    return claim_tables.scan_summary(standins.claims(t))


def _written_claims(t: TestTables, label: str, *names: str) -> str:
    """The named claim tables written to a fresh shared folder; the folder's path."""
    root = new_folder(t.spark, label)
    for name in names:
        getattr(standins, name)(t).write.parquet(f"{root}/{name}")
    return root


@query
def scan_identifier(t):
    root = _written_claims(t, "scan", "diagnosis")
    schema = f"carepath_scan_{uuid.uuid4().hex[:12]}"
    claim_tables.ensure_schema(t.spark, schema, f"{root}/_schema")
    t.spark.sql(f"DROP TABLE IF EXISTS {schema}.diagnosis")
    t.spark.catalog.createTable(f"{schema}.diagnosis", path=f"{root}/diagnosis", source="parquet")
    return claim_tables.read_identifier(t.spark, "spark_catalog", schema, "diagnosis")


def _evals(t: TestTables) -> DataFrame:
    return evalset.generate_evals(standins.medical_claim(t))


def _dataset_rows(t: TestTables) -> DataFrame:
    return evalset.eval_rows(_evals(t), "generator", F.to_timestamp(F.lit("2024-01-01 00:00:00")))


def _flat_records(df: DataFrame) -> DataFrame:
    """Nested evaluation records as plain columns."""
    inputs = F.from_json("inputs", schemas.EVAL_INPUTS)
    facts = F.from_json("expectations", schemas.EVAL_EXPECTATIONS)["expected_facts"]
    return df.select(
        "dataset_record_id",
        full_date(F.col("create_time")).alias("created_on"),
        "created_by",
        full_date(F.col("last_update_time")).alias("updated_on"),
        "last_updated_by",
        F.col("source.human.user_name").alias("user_name"),
        F.col("source.document.doc_uri").alias("doc_uri"),
        F.col("source.trace.trace_id").alias("trace_id"),
        inputs["messages"][0]["content"].alias("question"),
        F.array_join(facts, "|").alias("expected_facts"),
    )


@query
def sink_append(t):
    """Generated evals merged into a new table twice, as a rerun does, and read back."""
    root = new_folder(t.spark, "append")
    schema = f"carepath_append_{uuid.uuid4().hex[:12]}"
    claim_tables.ensure_schema(t.spark, schema, f"{root}/_schema")
    table = f"{schema}.eval_data"
    claim_tables.drop_dataset(t.spark, table)
    claim_tables.create_dataset(t.spark, table, f"{root}/eval_data", schemas.EVAL_TABLE)
    for _ in range(2):
        claim_tables.merge_dataset(_dataset_rows(t), table, root)
    return _flat_records(claim_tables.load_dataset(t.spark, table))


@query
def sink_replace_nested(t):
    """A table's rows replaced by the generated evals, then by those it holds itself."""
    root = new_folder(t.spark, "replace")
    schema = f"carepath_replace_{uuid.uuid4().hex[:12]}"
    claim_tables.ensure_schema(t.spark, schema, f"{root}/_schema")
    table = f"{schema}.eval_data"
    claim_tables.create_dataset(t.spark, table, f"{root}/eval_data", schemas.EVAL_TABLE)
    claim_tables.replace_records(_dataset_rows(t), table, root, schemas.EVAL_TABLE)
    claim_tables.replace_records(claim_tables.load_dataset(t.spark, table), table, root, schemas.EVAL_TABLE)
    return _flat_records(claim_tables.load_dataset(t.spark, table))


@query
def dataset_lifecycle(t):
    """Drop, create, create again, load: one row per step, with the rows of a filled table."""
    root = new_folder(t.spark, "lifecycle")
    schema = f"carepath_lifecycle_{uuid.uuid4().hex[:12]}"
    claim_tables.ensure_schema(t.spark, schema, f"{root}/_schema")
    table = f"{schema}.full_dataset"
    claim_tables.drop_dataset(t.spark, table)
    created = claim_tables.create_dataset(t.spark, table, f"{root}/full_dataset", schemas.EVAL_TABLE)
    again = claim_tables.create_dataset(t.spark, table, f"{root}/full_dataset", schemas.EVAL_TABLE)
    claim_tables.append_records(_dataset_rows(t), table)
    return claim_tables.load_dataset(t.spark, table).agg(
        F.lit(created).alias("created"),
        F.lit(again).alias("created_again"),
        F.count(F.lit(1)).alias("n_records"),
        F.count_distinct("dataset_record_id").alias("n_ids"),
    )


@query
def dataset_preview(t):
    return claim_tables.dataset_preview(_flat_records(_dataset_rows(t)), ["dataset_record_id"])


def _traces(t: TestTables) -> DataFrame:
    return standins.traces_of(t.events)


@query
def trace_search(t):
    return trace_sources.trace_search(
        _traces(t), "state = 'OK'", [F.col("ts").desc(), F.col("trace_id")], 5
    ).select("trace_id", "state", "run_id", F.col("value").cast("double").alias("value"))


@query
def trace_by_run(t):
    """Traces of the runs that had an error on their newest trace's day."""
    found = _traces(t)
    newest = found.groupBy("run_id").agg(F.max("ts").alias("ts"))
    failed = found.where("state = 'ERROR'").join(newest, ["run_id", "ts"], "left_semi")
    return trace_sources.trace_by_run(found, failed).select("trace_id", "state", "run_id")


@query
def traffic_source(t):
    keys = evaluation.traffic_keys(standins.claims(t))
    return trace_sources.traffic_source(keys)


# --- patient lookups --------------------------------------------------------------


@query
def patient_enrollment(t):
    return lookups.for_patients(standins.enrollment(t), lookups.ENROLLMENT)


@query
def patient_enrollment_raw(t):
    return lookups.patient_enrollment_raw(standins.enrollment(t))


def _claim_days(t: TestTables) -> DataFrame:
    """Each patient's newest service date."""
    return standins.medical_claim(t).groupBy("patient_id").agg(F.max("date_service").alias("date_service"))


@query
def medical_claims_on_date(t):
    return lookups.for_patients(standins.medical_claim(t), lookups.MEDICAL_CLAIMS, _claim_days(t))


@query
def patient_diagnoses(t):
    return lookups.for_patients(standins.diagnosis(t), lookups.DIAGNOSES)


@query
def patient_diagnoses_all(t):
    return lookups.patient_diagnoses_all(standins.diagnosis(t))


@query
def patient_pharmacy(t):
    return lookups.for_patients(standins.pharmacy_claim(t), lookups.PHARMACY)


@query
def patient_pharmacy_all(t):
    return lookups.patient_pharmacy_all(standins.pharmacy_claim(t))


@query
def patient_procedures(t):
    return lookups.for_patients(standins.procedure(t), lookups.PROCEDURES)


def _functions(t: TestTables, *names: str) -> None:
    for name, df in standins.claims(t).items():
        df.createOrReplaceTempView(f"carepath_{name}")
    lookups.create_lookup_functions(t.spark, {name: f"carepath_{name}" for name in schemas.CLAIM_TABLES})


def _calls(t: TestTables, function: str, args: str, columns: str) -> DataFrame:
    """A table function called once per row of the patients' newest service dates."""
    return t.spark.sql(
        f"SELECT :name AS function, {columns} FROM carepath_claim_days k, LATERAL {function}({args}) f",
        args={"name": function},
    )


@query
def lookup_sql_functions(t):
    """The three capped functions called for every patient, from SQL."""
    _functions(t)
    _claim_days(t).createOrReplaceTempView("carepath_claim_days")
    calls = [
        _calls(t, name, "k.patient_id", "f.claim_id, f.patient_id, f.date_service")
        for name in ("get_patient_diagnoses", "get_pharmacy_claims", "get_patient_procedures")
    ]
    return calls[0].unionByName(calls[1]).unionByName(calls[2])


@query
def lookup_call(t):
    """The other two for every patient; calls with one bound patient are the same functions with a filter."""
    _functions(t)
    _claim_days(t).createOrReplaceTempView("carepath_claim_days")
    days = "CAST(NULL AS STRING) AS claim_id, f.patient_id, f.date_start AS date_from, f.date_end AS date_to"
    stays = "f.claim_id, f.patient_id, f.date_service AS date_from, f.date_service_end AS date_to"
    return _calls(t, "get_patient_enrollment", "k.patient_id", days).unionByName(
        _calls(t, "get_medical_claims", "k.patient_id, k.date_service", stays)
    )


# --- questions over several tables ---------------------------------------------------


@query
def patient_journey(t):
    return timeline.patient_journey(standins.claims(t))


@query
def journey_on_date(t):
    keys = _claim_days(t).withColumnRenamed("date_service", "service_date")
    return timeline.journey_on_date(standins.claims(t), keys)


@query
def latest_medication_diagnosis(t):
    return timeline.latest_medication_diagnosis(standins.pharmacy_claim(t), standins.diagnosis(t))


@query
def patient_medications(t):
    return timeline.patient_medications(standins.pharmacy_claim(t))


@query
def patient_diagnosis_codes(t):
    return timeline.patient_diagnosis_codes(standins.diagnosis(t))


@query
def patient_claims(t):
    return timeline.patient_claims(standins.claims(t))


@query
def claim_lookup(t):
    """All records under each patient's newest medical claims."""
    newest = lookups.for_patients(standins.medical_claim(t), lookups.MEDICAL_CLAIMS, _claim_days(t))
    return timeline.claim_lookup(standins.claims(t), newest)


@query
def indexed_claim_lookup(t):
    """All records under one patient's medical claims, from written tables by way of their index."""
    root = new_folder(t.spark, "indexed")
    claim_index.write_indexed_claims(standins.claims(t), root)
    mine = standins.medical_claim(t).where(F.col("patient_id") == SAMPLE_PATIENT)
    return claim_index.claim_lookup(t.spark, root, mine)


@query
def claims_by_ndc(t):
    """Claims for every drug that is some patient's latest medication."""
    fills = standins.pharmacy_claim(t)
    return timeline.claims_by_ndc(fills, timeline.latest_fill(fills))


@query
def claims_by_diagnosis(t):
    """Claims for every code given at an admission on the code's last day."""
    d = standins.diagnosis(t)
    codes = (
        d.groupBy("diagnosis_code")
        .agg(F.max(F.struct("date_service", "admit_diagnosis_ind")).alias("l"))
        .where(F.col("l.admit_diagnosis_ind") == "Y")
    )
    return timeline.claims_by_diagnosis(d, codes)


# --- population -----------------------------------------------------------------


@query
def enrollment_history(t):
    return population.enrollment_history(standins.enrollment(t))


@query
def medication_adherence(t):
    return population.medication_adherence(standins.pharmacy_claim(t))


@query
def refill_gaps(t):
    return population.refill_gaps(standins.pharmacy_claim(t))


@query
def diagnosis_trend(t):
    return population.diagnosis_trend(standins.diagnosis(t))


def _by_month(df: DataFrame) -> DataFrame:
    return df.select("patient_id", F.trunc("date_service", "MM").alias("month"))


@query
def population_overlap(t):
    """Per month: nearly every patient is in both kinds of claims over the whole time."""
    return population.population_overlap(
        _by_month(standins.medical_claim(t)), _by_month(standins.pharmacy_claim(t)), ["month"]
    )


@query
def population_members(t):
    """Patients and months with medical claims but no fills."""
    return population.population_members(
        _by_month(standins.medical_claim(t)), _by_month(standins.pharmacy_claim(t)), "medical_only", ["month"]
    )


@query
def utilization_cost(t):
    return population.utilization_cost(
        standins.medical_claim(t), standins.procedure(t), standins.pharmacy_claim(t)
    )


@query
def procedure_cost_summary(t):
    return population.procedure_cost_summary(standins.procedure(t))


# --- evaluation dataset -----------------------------------------------------------


@query
def claim_documents(t):
    return evalset.claim_documents(standins.medical_claim(t))


@query
def generate_evals(t):
    return _evals(t).select(
        "dataset_record_id",
        "patient_id",
        "claim_id",
        F.col("messages")[0]["content"].alias("question"),
        F.array_join("expected_facts", "|").alias("expected_facts"),
    )


@query
def generate_table_evals(t):
    """Questions over all five claim tables, two of each table per patient."""
    return evalset.generate_table_evals(standins.claims(t)).withColumn("expected_facts", F.array_join("expected_facts", "|"))


@query
def eval_record_id(t):
    return messages.conversation_ids(messages.append_messages(standins.messages(t)))


def _trace_records(t: TestTables) -> DataFrame:
    return evalset.trace_to_record(_traces(t))


def _error_records(t: TestTables) -> DataFrame:
    """Error traces again, three days later and by another author."""
    later = _traces(t).where("state = 'ERROR'").withColumn("ts", F.expr("ts + interval 3 days"))
    return evalset.trace_to_record(later, "rerun")


@query
def upsert_records(t):
    """The error traces' new records merged into the records of all traces."""
    return _flat_records(evalset.upsert_records(_trace_records(t), _error_records(t)))


@query
def merged_record_store(t):
    """The same merge into a bucketed store, bucket by bucket, the second one run twice."""
    path = new_folder(t.spark, "records")
    record_store.create_store(t.spark, path)
    for updates in (_trace_records(t), _error_records(t), _error_records(t)):
        record_store.merge_records(updates, path)
    return _flat_records(record_store.load_store(t.spark, path))


@query
def trace_to_record(t):
    return _flat_records(_trace_records(t))


def _document_records(t: TestTables) -> DataFrame:
    """One record per document."""
    question = F.concat(F.lit("Summarise document "), F.col("doc_id").cast("string"))
    docs = t.documents.select(
        F.array(F.struct(F.lit("user").alias("role"), question.alias("content"))).alias("messages"),
        F.array("lang").alias("expected_facts"),
        F.col("source").alias("doc_uri"),
        F.col("text").alias("content"),
    ).withColumn("dataset_record_id", record_id(F.col("messages")))
    return evalset.eval_rows(docs, "importer", F.to_timestamp(F.lit("2024-01-01 00:00:00")))


@query
def sync_labels(t):
    doc = F.col("doc_id").cast("string")
    given = t.labels.select(
        F.md5(F.concat(F.lit("user:Summarise document "), doc)).alias("dataset_record_id"),
        F.concat(F.lit("reviewer_"), (F.col("doc_id") % 3).cast("string")).alias("user_name"),
        F.array(
            F.concat(F.lit("quality "), F.col("quality").cast("string")),
            F.concat(F.lit("toxic "), F.col("toxic").cast("string")),
        ).alias("expected_facts"),
        F.to_timestamp(F.lit("2024-02-01 00:00:00")).alias("labelled_at"),
    )
    return _flat_records(evalset.sync_labels(_document_records(t), given))


def _rated(t: TestTables) -> DataFrame:
    """Ratings by two reviewers per labelled document; each tenth one is not an option."""
    assigned = t.labels.select(
        F.col("doc_id").alias("item_id"), "quality", "toxic", F.posexplode(F.array(*map(F.lit, REVIEWERS))).alias("no", "user_name")
    )
    options = F.array(*map(F.lit, labels.RATINGS))
    pick = (F.col("quality") * 2 + F.col("toxic") + F.col("no")) % 4
    return assigned.select(
        "item_id",
        "user_name",
        F.when(F.col("item_id") % 10 == 3, "Superb").otherwise(options[pick]).alias("rating"),
    )


@query
def label_validate(t):
    rated = _rated(t).join(
        t.documents.select(F.col("doc_id").alias("item_id"), F.array("text").alias("expected_facts")),
        "item_id",
        "left",
    )
    valid, rejected = labels.label_validate(rated)
    return valid.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected).drop("expected_facts")


@query
def label_assign(t):
    return labels.label_assign(t.documents.select(F.col("doc_id").alias("item_id")), REVIEWERS)


@query
def label_summary(t):
    return labels.label_summary(_rated(t))


# --- scorers ----------------------------------------------------------------------


def _documents_as_answers(t: TestTables) -> DataFrame:
    return t.documents.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("trace_id"), F.col("text").alias("response")
    )


def _recorded_answers(medical_claim: DataFrame) -> DataFrame:
    """One recorded question and stand-in answer per medical claim, as scorer input."""
    question = F.concat(F.lit("Which claims are there for patient "), F.col("patient_id"), F.lit("?"))
    facts = F.array("claim_id", F.col("date_service").cast("string"), "location_of_care")
    return medical_claim.select(
        F.col("claim_id").alias("trace_id"),
        F.array(F.struct(F.lit("user").alias("role"), question.alias("content"))).alias("messages"),
        question.alias("request"),
        standins.stand_in_answer().alias("response"),
        F.array_compact(facts).alias("expected_facts"),
        standins.stand_in_context(evalset.document_text()).alias("context"),
    )


def _score(name: str, with_documents: bool = False) -> Callable[[TestTables], DataFrame]:
    def run(t: TestTables) -> DataFrame:
        # scoring is dear and rows are narrow: dealt out before the token lists are made, however few files there are
        claims = standins.medical_claim(t).repartition("claim_id")
        out = scorers.evaluate(_recorded_answers(claims), [name])
        if with_documents:
            out = out.unionByName(scorers.evaluate(_documents_as_answers(t), [name]))
        return out

    return run


for _name in ("correctness", "retrieval_sufficiency", "groundedness", "retrieval_relevance", "relevance",
              "guideline_accuracy", "no_speculation"):
    QUERIES[f"score_{_name}"] = _score(_name)
for _name in ("safety", "guideline_clarity", "guideline_english", "no_pii"):
    QUERIES[f"score_{_name}"] = _score(_name, with_documents=True)


@query
def score_message_relevance(t):
    """Every assistant answer against the user message before it; the list may hold none."""
    pairs = messages.request_response_pairs(standins.messages(t))
    user = F.struct(F.lit("user").alias("role"), F.col("request").alias("content"))
    system = F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content"))
    records = pairs.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("trace_id"),
        F.array(system, user).alias("messages"),
        "response",
    )
    return scorers.evaluate(records, ["message_relevance"])


def _routed(t: TestTables) -> DataFrame:
    return routing.question_route(_questions(t))


@query
def score_tool_calls(t):
    """The tool each question asks for by its number, against the tool it was routed to."""
    expected = F.array(*map(F.lit, trace_sources.USAGE_TOOLS))
    keys = evaluation.traffic_keys(standins.claims(t))
    asked = trace_sources.traffic_source(keys, trace_sources.USAGE_QUESTIONS).select(
        F.concat_ws("-", "patient_id", F.col("question_no").cast("string")).alias("request_id"),
        "question",
        F.array(expected[F.col("question_no") - 1]).alias("expected_tools"),
    )
    # a second wording of the request leaves the tool unclear now and then
    vague = F.substring(F.md5("request_id"), 1, 1).isin("0", "1", "2")
    asked = asked.withColumn(
        "question", F.when(vague, F.regexp_replace("question", "pharmacy|procedures|enrollment|medical claims", "claims"))
        .otherwise(F.col("question"))
    )
    records = routing.question_route(asked).select(
        F.col("request_id").alias("trace_id"), "expected_tools", F.array_compact(F.array("tool")).alias("called_tools")
    )
    return scorers.evaluate(records, ["tool_precision", "tool_recall"])


def _evaluation(t: TestTables) -> DataFrame:
    evals = evaluation.write_evals(standins.medical_claim(t), new_folder(t.spark, "evals"))
    responses = evals.select(
        "dataset_record_id",
        standins.stand_in_answer().alias("response"),
        standins.stand_in_context(F.col("content")).alias("context"),
    )
    return evaluation.evaluation_run(evals, responses)


@query
def evaluate(t):
    return _evaluation(t)


@query
def evaluate_summary(t):
    return scorers.evaluate_summary(_evaluation(t))


# --- traces and messages ------------------------------------------------------------


def _parsed(t: TestTables) -> DataFrame:
    return traces.trace_parse(standins.trace_json(t.events))


@query
def trace_parse(t):
    return _parsed(t).select(
        "trace_id",
        "state",
        "request_preview",
        "response_preview",
        F.array_join(F.transform("assessments", lambda a: a["assessment_name"]), ",").alias("names"),
    )


@query
def trace_assessments(t):
    return traces.trace_assessments(_parsed(t))


@query
def trace_summary(t):
    return traces.trace_summary(_parsed(t))


def _flat_conversations(df: DataFrame) -> DataFrame:
    return df.select(
        "conv_id",
        "part_no",
        "n_messages",
        F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        record_id(F.col("messages")).alias("text_md5"),
    )


@query
def prepend_system(t):
    return _flat_conversations(messages.prepend_system(messages.append_messages(standins.messages(t)), SYSTEM_PROMPT))


@query
def append_messages(t):
    return _flat_conversations(messages.append_messages(standins.messages(t)))


@query
def message_chunks(t):
    chunks = messages.message_chunks(messages.append_messages(standins.messages(t)))
    return chunks.select("conv_id", "chunk_no", "role", "delta")


@query
def tool_call_split(t):
    return messages.tool_call_split(standins.messages(t))


@query
def tool_dispatch(t):
    """Every routed question run, answered, empty or refused."""
    folder = new_folder(t.spark, "requests")
    _routed(t).where(F.col("action") == "call").write.parquet(folder)
    out = routing.tool_dispatch(t.spark.read.parquet(folder), standins.claims(t))
    return out.select("request_id", "tool", "status", "row_no", "claim_id", "row_date")


def _questions(t: TestTables) -> DataFrame:
    """Test traffic of every patient, and the user turns of the conversations."""
    keys = evaluation.traffic_keys(standins.claims(t))
    both = trace_sources.MONITOR_QUESTIONS + trace_sources.USAGE_QUESTIONS
    traffic = trace_sources.traffic_source(keys, both).select(
        F.concat_ws("-", "patient_id", F.col("question_no").cast("string")).alias("request_id"), "question"
    )
    talk = t.conversations.where(F.col("role") == "user").select(
        F.concat_ws("-", F.lit("conv"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.col("text").alias("question"),
    )
    return traffic.unionByName(talk)


@query
def question_route(t):
    return _routed(t)


@query
def full_date_format(t):
    return standins.medical_claim(t).select(
        "claim_id",
        full_date(F.col("date_service")).alias("service_date"),
        full_date(F.col("date_service_end")).alias("service_date_end"),
    )


@query
def request_response_pairs(t):
    return messages.request_response_pairs(standins.messages(t))


@query
def vector_topk(t):
    """The five nearest vectors of each label's first vector, in the whole table."""
    first = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    queries = t.embeddings.join(first, ["label", "vec_id"], "left_semi").select(
        F.col("label").cast("bigint").alias("query_id"), "embedding"
    )
    return retrieval.vector_topk(t.embeddings, queries, 5)


# --- monitoring --------------------------------------------------------------------


def _scorer_log(t: TestTables) -> DataFrame:
    """Scorer registrations and updates read off the event stream: 24 names, a good part of it invalid."""
    kinds = F.array(F.lit("safety"), F.lit("guideline_english"), F.lit("relevance"))
    return t.events.select(
        F.concat(F.lit("scorer_"), (F.col("user_id") % 24).cast("string")).alias("name"),
        F.when(F.col("event_type") == "signup", "register").otherwise("update").alias("action"),
        kinds[(F.col("user_id") % 3).cast("int")].alias("scorer"),
        ((F.col("event_id") % 11).cast("double") / F.lit(10.0)).alias("sample_rate"),
        F.when(F.col("event_id") % 3 == 0, "state = 'OK'").when(F.col("event_id") % 3 == 1, "value > 50").alias("filter_string"),
        F.col("ts").cast("timestamp").alias("registered_at"),
        F.col("event_id").alias("seq"),
    )


@query
def scorer_config(t):
    return config.scorer_config(_scorer_log(t))


@query
def scorer_config_errors(t):
    return config.scorer_config_errors(_scorer_log(t))


@query
def scorer_sample(t):
    return monitor.scorer_sample(_traces(t), MONITOR)


@query
def scorer_filter(t):
    by_value = config.MonitorScorer("large_values", "relevance", 1.0, "value > 50 AND state = 'OK'")
    return monitor.scorer_filter(_traces(t), [*MONITOR, by_value])


def _streaming(t: TestTables) -> TestTables:
    """The same tables in a session of their own, with one state partition per core."""
    session = t.spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.shuffle.partitions", str(max(2, session.sparkContext.defaultParallelism)))
    return TestTables(session, t.sf_dir)


def _run_append(t: TestTables, df: DataFrame, label: str) -> DataFrame:
    folder = new_folder(t.spark, label)
    monitor.start_append(df, f"{folder}/out", f"{folder}/checkpoint", {"availableNow": True}).awaitTermination()
    return t.spark.read.schema(df.schema).parquet(f"{folder}/out")


# The event backlog is delivered in this many parts by time, a run of the stream after each.
DELIVERIES = 3


class Inbox:
    """Events staged by delivery, then put part by part into the folder that a stream watches.

    ``arrivals(events, part)`` gives the rows with the number of their delivery as ``arrival``;
    ``part`` maps a timestamp to its part of the events' span of time.
    """

    def __init__(self, t: TestTables, label: str, arrivals: Callable[[DataFrame, Callable[[Column], Column]], DataFrame]):
        self.spark, self.folder, self.schema = t.spark, new_folder(t.spark, label), t.events.schema
        seconds = F.col("ts").cast("timestamp").cast("long")
        span = t.events.agg(F.min(seconds).alias("first"), F.max(seconds).alias("last")).first()
        first, length = span["first"] or 0, (span["last"] or 0) - (span["first"] or 0) + 1

        def part(ts: Column) -> Column:
            passed = (ts.cast("timestamp").cast("long") - first) * DELIVERIES
            return F.least(F.floor(passed / length), F.lit(DELIVERIES - 1)).cast("int")

        arrivals(t.events, part).write.partitionBy("arrival").parquet(f"{self.folder}/staged")

    def deliver(self, number: int) -> None:
        staged = self.spark.read.schema(f"{self.schema.toDDL()}, arrival int").parquet(f"{self.folder}/staged")
        staged.where(F.col("arrival") == number).drop("arrival").write.mode("append").parquet(f"{self.folder}/in")

    def stream(self, spark: SparkSession) -> DataFrame:
        return standins.traces_of(spark.readStream.schema(self.schema).parquet(f"{self.folder}/in"))


def _in_order(events: DataFrame, part: Callable[[Column], Column]) -> DataFrame:
    return events.withColumn("arrival", part(F.col("ts")))


def _some_late(events: DataFrame, part: Callable[[Column], Column]) -> DataFrame:
    """Every 97th event of the first part comes with the last one, far behind the watermark."""
    late = (part(F.col("ts")) == 0) & (F.col("event_id") % 97 == 0)
    return events.withColumn("arrival", F.when(late, DELIVERIES - 1).otherwise(part(F.col("ts"))))


def _errors_twice(events: DataFrame, part: Callable[[Column], Column]) -> DataFrame:
    """Every error once more, up to 50 minutes later and so often in the next delivery."""
    again = events.where("event_type = 'error'").withColumn("arrival", part(F.col("ts") + F.expr("interval 50 minutes")))
    return _in_order(events, part).unionByName(again)


def _run_deliveries(t: TestTables, inbox: Inbox, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each delivery worked off by a run of its own that goes on from the checkpoint; what was appended."""
    for number in range(DELIVERIES):
        inbox.deliver(number)
        df = plan(inbox.stream(t.spark))
        monitor.start_append(df, f"{inbox.folder}/out", f"{inbox.folder}/checkpoint", {"availableNow": True}).awaitTermination()
    return t.spark.read.schema(df.schema).parquet(f"{inbox.folder}/out")


def _run_complete(t: TestTables, df: DataFrame, label: str) -> DataFrame:
    folder = new_folder(t.spark, label)
    monitor.start_complete(df, f"{folder}/out", f"{folder}/checkpoint", {"availableNow": True}).awaitTermination()
    return monitor.read_latest(t.spark, f"{folder}/out")


def _stream_traces(s: TestTables) -> DataFrame:
    return standins.traces_of(s.stream("events", maxBytesPerTrigger=STREAM_BATCH))


@query
def monitor_stream(t):
    s = _streaming(t)
    scores = monitor.score_traffic(_stream_traces(s), MONITOR)
    return _run_append(t, scores, "monitor").select("trace_id", "state", "scorer", "value", "rationale")


@query
def monitor_dedup(t):
    """Traffic in which every error was sent twice, scored once: three deliveries, a restart after each.

    Files are read in the order of their arrival, so the backlog is delivered by time; within a delivery
    the order does not matter.
    """
    s = _streaming(t)
    plan = lambda traces: monitor.score_traffic(monitor.dedup_traffic(traces), MONITOR)
    once = _run_deliveries(s, Inbox(s, "dedup", _errors_twice), plan)
    return once.select("trace_id", "state", "scorer", "value", "rationale")


@query
def monitor_live(t):
    """Three deliveries scored by one running stream; before the last, a rate is raised and a scorer added."""
    s = _streaming(t)
    inbox = Inbox(s, "live", _in_order)
    log = f"{inbox.folder}/log"
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00"))

    def register(*entries: tuple) -> None:
        rows = s.spark.createDataFrame(list(entries), "name string, action string, scorer string, sample_rate double, filter_string string, seq bigint")
        rows.withColumn("registered_at", at).coalesce(1).write.mode("append").parquet(log)

    register(*[(m.name, "register", m.scorer, m.sample_rate, m.filter_string, i) for i, m in enumerate(MONITOR)])
    inbox.deliver(0)
    running = monitor.start_live(
        inbox.stream(s.spark), lambda spark: spark.read.parquet(log), f"{inbox.folder}/out", f"{inbox.folder}/checkpoint",
        {"processingTime": "0 seconds"},
    )
    try:
        for number in range(DELIVERIES):
            if number == DELIVERIES - 1:
                register(
                    ("safety_check", "update", "safety", 0.8, "state = 'ERROR'", 10),
                    ("no_contact", "register", "no_pii", 0.3, None, 11),
                    ("not_run", "register", "safety", 1.0, "upper(state) = 'OK'", 12),
                )
            if number:
                inbox.deliver(number)
            running.processAllAvailable()
    finally:
        running.stop()
    return monitor.read_live(s.spark, f"{inbox.folder}/out").select(
        "trace_id", "state", "scorer", "config_version", "value", "rationale"
    )


def _day(name: str) -> Column:
    return full_date(F.col(name)).alias(name)


@query
def quality_trend(t):
    s = _streaming(t)
    trend = monitor.quality_trend(monitor.score_traffic(_stream_traces(s), MONITOR))
    return _run_complete(t, trend, "quality").withColumn("window_start", _day("window_start"))


@query
def quality_trend_sliding(t):
    s = _streaming(t)
    trend = monitor.quality_trend(monitor.score_traffic(_stream_traces(s), MONITOR), "2 days", "1 day")
    return _run_complete(t, trend, "sliding").withColumn("window_start", _day("window_start"))


@query
def error_rate_trend(t):
    s = _streaming(t)
    trend = monitor.error_rate_trend(_stream_traces(s))
    return _run_complete(t, trend, "errors").withColumn("window_start", _day("window_start"))


@query
def quality_trend_closed(t):
    """The trend appended window by window: late rows left out, the last day still open."""
    s = _streaming(t)
    plan = lambda traces: monitor.quality_trend(monitor.score_traffic(traces, MONITOR), watermark=monitor.WATERMARK)
    return _run_deliveries(s, Inbox(s, "closed", _some_late), plan).withColumn("window_start", _day("window_start"))


@query
def error_rate_trend_closed(t):
    s = _streaming(t)
    plan = lambda traces: monitor.error_rate_trend(traces, watermark=monitor.WATERMARK)
    return _run_deliveries(s, Inbox(s, "closed", _some_late), plan).withColumn("window_start", _day("window_start"))
