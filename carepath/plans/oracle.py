"""The catalogue's queries in DuckDB SQL, written apart from the Spark code, for checking results."""

from __future__ import annotations

from carepath.functions import lexicons as lex
from carepath.operators.scorers import EVALUATION_SCORERS
from carepath.sources.traces import MONITOR_QUESTIONS, USAGE_QUESTIONS

SYSTEM_PROMPT = "Answer questions on patient claims only; give full dates."

# --- base relations ---------------------------------------------------------------

BASE = {
    "enrollment": """
        select md5(cast(c_custkey as string)) as patient_id,
               case when c_custkey % 2 = 0 then 'F' else 'M' end as patient_gender,
               cast(1940 + c_custkey % 60 as string) as patient_year_of_birth,
               lpad(cast(c_nationkey * 37 as string), 3, '0') as patient_zip3,
               n_name as patient_state,
               cast(min(o_orderdate) as date) as date_start,
               cast(max(o_orderdate) as date) + 90 as date_end,
               r_name as benefit_type, c_mktsegment as pay_type
        from orders join customer on o_custkey = c_custkey
             join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        group by c_custkey, c_nationkey, n_name, r_name, c_mktsegment, year(o_orderdate)""",
    "medical_claim": """
        select md5(concat('c', cast(o_orderkey as string))) as claim_id,
               md5(cast(o_custkey as string)) as patient_id,
               cast(o_orderdate as date) as date_service,
               cast(o_orderdate as date) + cast(o_orderkey % 5 as int) as date_service_end,
               o_orderpriority as location_of_care, c_mktsegment as pay_type
        from orders join customer on o_custkey = c_custkey""",
    "diagnosis": """
        select md5(concat('c', cast(o_orderkey as string))) as claim_id,
               md5(cast(o_custkey as string)) as patient_id,
               cast(o_orderdate as date) as date_service,
               cast(o_orderdate as date) + cast(o_orderkey % 5 as int) as date_service_end,
               concat('Z', lpad(cast(l_partkey * 37 % 500 as string), 5, '0')) as diagnosis_code,
               case when l_linestatus = 'F' then '02' else '01' end as diagnosis_qual,
               case when l_linenumber = 1 then 'Y' else 'N' end as admit_diagnosis_ind
        from lineitem join orders on l_orderkey = o_orderkey""",
    "pharmacy_claim": """
        select md5(concat('rx', cast(l_orderkey as string), '-', cast(l_linenumber as string))) as claim_id,
               md5(cast(o_custkey as string)) as patient_id,
               cast(l_shipdate as date) as date_service,
               lpad(cast(l_partkey as string), 11, '0') as ndc,
               l_linenumber as fill_number, cast(l_quantity as int) as days_supply,
               l_quantity as dispensed_quantity, o_orderpriority as pay_type,
               cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(3,2)) as copay_coinsurance,
               cast(l_extendedprice as decimal(18,2)) as submitted_gross_due,
               cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(3,2))) as paid_gross_due
        from lineitem join orders on l_orderkey = o_orderkey""",
    "procs": """
        select md5(concat('c', cast(o_orderkey as string))) as claim_id,
               md5(cast(o_custkey as string)) as patient_id,
               cast(l_linenumber as string) as service_line_number,
               cast(o_orderdate as date) as date_service,
               cast(o_orderdate as date) + cast(o_orderkey % 5 as int) as date_service_end,
               concat(p_type, '-', cast(p_size as string)) as procedure_code,
               l_returnflag as procedure_qual, l_quantity as procedure_units,
               lpad(cast(l_suppkey as string), 4, '0') as revenue_code,
               cast(l_extendedprice as decimal(18,2)) as line_charge,
               cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(3,2))) as line_allowed
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
    "traces": """
        select cast(event_id as string) as trace_id, ts,
               case when event_type = 'error' then 'ERROR' else 'OK' end as state,
               cast(user_id as string) as run_id,
               cast(value as decimal(18,2)) as value,
               'What happened in trace ' || event_id || ' of run ' || user_id || '?' as request,
               concat_ws(' ', 'Trace', cast(event_id as string),
                         case when event_type <> 'error' then 'of run ' || user_id end,
                         'reported', event_type, 'with value', cast(cast(value as decimal(18,2)) as string)) as response,
               [concat('trace ', event_id, ' ', props)] as ctx
        from events""",
    "messages": """
        select conv_id, turn, role, text as content, role = 'assistant' and turn % 4 = 1 as has_calls
        from conversations""",
}

# The cut of each lookup, its ordering date first, then every other column.
LOOKUP_ORDER = {
    "enrollment": (1, "date_start", "patient_id patient_gender patient_year_of_birth patient_zip3 patient_state "
                   "date_end benefit_type pay_type"),
    "diagnosis": (50, "date_service", "claim_id patient_id date_service_end diagnosis_code diagnosis_qual "
                  "admit_diagnosis_ind"),
    "pharmacy_claim": (50, "date_service", "claim_id patient_id ndc fill_number days_supply dispensed_quantity "
                       "pay_type copay_coinsurance submitted_gross_due paid_gross_due"),
    "procs": (50, "date_service", "claim_id patient_id service_line_number date_service_end procedure_code "
              "procedure_qual procedure_units revenue_code line_charge line_allowed"),
    "medical_claim": (1000, "date_service", "claim_id patient_id date_service_end location_of_care pay_type"),
}
FLOATS = {
    "dispensed_quantity", "copay_coinsurance", "submitted_gross_due", "paid_gross_due", "procedure_units",
    "line_charge", "line_allowed",
}


def with_(names: str, body: str, once: bool = False, **more: str) -> str:
    """``body`` after its named parts; with ``once`` each part is computed once however often it is read."""
    kept = "materialized " if once else ""
    ctes = [f"{n} as {kept}({BASE[n]})" for n in names.split()] + [f"{n} as {kept}({q})" for n, q in more.items()]
    return "with " + ",\n".join(ctes) + "\n" + body


def ranked(table: str) -> str:
    _, date, others = LOOKUP_ORDER[table]
    order = ", ".join([f"{date} desc nulls last"] + [f"{c} asc nulls last" for c in others.split()])
    return f"(select *, row_number() over (partition by patient_id order by {order}) as rn from {table})"


def floats(cols: str) -> str:
    return ", ".join(
        f"cast(cast({c} as double) as float) as {c}" if c in FLOATS else c for c in cols.split()
    )


def columns(table: str) -> str:
    _, date, others = LOOKUP_ORDER[table]
    return f"{date} {others}"


def top(table: str, n: int | None = None) -> str:
    n = n or LOOKUP_ORDER[table][0]
    return f"select {floats(columns(table))} from {ranked(table)} where rn <= {n}"


CLAIM_DAYS = "select patient_id, max(date_service) as date_service from medical_claim group by patient_id"
ON_DATE = """select m.* from medical_claim m join days d
             on m.patient_id = d.patient_id and m.date_service = d.date_service"""

EVENT_PARTS = {
    "medical_claim": """select patient_id, date_service as event_date, date_service_end as event_end,
        'medical_claim' as kind, claim_id, cast(null as string) as code, cast(null as string) as code_qual,
        cast(null as double) as amount, concat_ws(' ', location_of_care, pay_type) as detail from medical_claim""",
    "diagnosis": """select patient_id, date_service, date_service_end, 'diagnosis', claim_id, diagnosis_code,
        diagnosis_qual, null, admit_diagnosis_ind from diagnosis""",
    "pharmacy_claim": """select patient_id, date_service, date_service + greatest(days_supply - 1, 0),
        'pharmacy_claim', claim_id, ndc, null, cast(paid_gross_due as double),
        concat_ws(' ', 'fill', cast(fill_number as string), pay_type) from pharmacy_claim""",
    "procs": """select patient_id, date_service, date_service_end, 'procedure', claim_id, procedure_code,
        procedure_qual, cast(line_allowed as double), concat_ws(' ', service_line_number, revenue_code) from procs""",
}
CLAIM_EVENTS = " union all ".join(EVENT_PARTS.values())
ENROLLMENT_EVENTS = """select patient_id, date_start as event_date, date_end as event_end, 'enrollment' as kind,
    cast(null as string) as claim_id, benefit_type as code, pay_type as code_qual, cast(null as double) as amount,
    concat_ws(' ', patient_gender, patient_year_of_birth, patient_zip3, patient_state) as detail from enrollment"""
EVENT_COLUMNS = "patient_id, event_date, event_end, kind, claim_id, code, code_qual, amount, detail"
FOUR = "medical_claim diagnosis pharmacy_claim procs"

LATEST_FILL = f"select patient_id, claim_id, ndc, date_service as fill_date from {ranked('pharmacy_claim')} where rn = 1"
FILL_DAYS = """select patient_id, ndc, date_service as fill_date,
    date_service + (max(days_supply) - 1) as supply_end, count(*) as fills
    from pharmacy_claim group by patient_id, ndc, date_service"""

TRAFFIC_KEYS = f"""
    select coalesce(c.patient_id, f.patient_id, d.patient_id) as patient_id, c.claim_id, c.date_service as service_date, f.ndc, d.diagnosis_code
    from (select * from {ranked('medical_claim')} where rn = 1) c
    full join ({LATEST_FILL}) f on f.patient_id = c.patient_id
    full join (select * from {ranked('diagnosis')} where rn = 1) d on d.patient_id = coalesce(c.patient_id, f.patient_id)"""


def filled(templates: tuple[str, ...]) -> str:
    parts = []
    for i, template in enumerate(templates, 1):
        text = "'" + template.replace("'", "''") + "'"
        for key in ("claim_id", "patient_id", "ndc", "diagnosis_code", "service_date"):
            text = text.replace("{" + key + "}", f"' || {key} || '")
        parts.append(f"select patient_id, {i} as question_no, {text} as question from keys")
    return "select * from (" + " union all ".join(parts) + ") where question is not null"


# --- evaluation records --------------------------------------------------------------

DOCUMENT = """concat_ws(' ', 'PATIENT_ID:', patient_id, 'CLAIM_ID:', claim_id, 'DATE_SERVICE:',
    cast(date_service as string), 'LOCATION_OF_CARE:', location_of_care, 'PAY_TYPE:', pay_type)"""
ANSWER = """concat_ws(' ', 'Claim', claim_id, 'on', cast(date_service as string),
    case when day(date_service) % 2 = 0 then location_of_care end,
    case when day(date_service) % 5 = 0 then 'see ref' || substr(claim_id, 1, 6) end)"""
CONTEXT = f"""case when day(date_service) % 7 = 0 then cast([] as varchar[])
    else [{DOCUMENT}, concat('PAY_TYPE: ', pay_type)] end"""

_QUESTIONS = (
    ("'On which date was claim ' || claim_id || ' of patient ' || patient_id || ' served?'",
     "[cast(date_service as string)]"),
    ("'Where was care given to patient ' || patient_id || ' under claim ' || claim_id || '?'", "[location_of_care]"),
    ("'Which payer covered claim ' || claim_id || ' of patient ' || patient_id || '?'", "[pay_type]"),
    ("'Summarise claim ' || claim_id || ' of patient ' || patient_id || '.'",
     "[claim_id, cast(date_service as string), location_of_care, pay_type]"),
)
EVALS = (
    "select * from (select *, row_number() over (partition by patient_id order by dataset_record_id, date_service_end) as er from ("
    + " union all ".join(
        f"select *, {q} as question, {f} as facts, md5('user:' || {q}) as dataset_record_id, {DOCUMENT} as content "
        f"from {ranked('medical_claim')} where rn <= 1000"
        for q, f in _QUESTIONS
    )
    + ")) where er <= 10"
)
_TABLE_QUESTIONS = [
    ("enrollment", "'In which state was patient ' || patient_id || ' enrolled from ' || date_start || '?'", "[patient_state]"),
    ("enrollment", "'Which benefit and payer did patient ' || patient_id || ' have from ' || date_start || '?'", "[benefit_type, pay_type]"),
    *[("medical_claim", q, f) for q, f in _QUESTIONS],
    ("diagnosis", "'On which date was diagnosis ' || diagnosis_code || ' given to patient ' || patient_id || ' under claim ' || claim_id || '?'",
     "[cast(date_service as varchar)]"),
    ("diagnosis", "'When and where was patient ' || patient_id || ' seen for diagnosis ' || diagnosis_code || ' of claim ' || claim_id || '?'",
     "[cast(date_service as varchar), (select min(location_of_care) from medical_claim m where m.claim_id = t.claim_id "
     "and m.patient_id = t.patient_id)]"),
    ("pharmacy_claim", "'Which drug did patient ' || patient_id || ' get under claim ' || claim_id || '?'", "[ndc]"),
    ("pharmacy_claim", "'How many days of supply did patient ' || patient_id || ' get under claim ' || claim_id || '?'",
     "[cast(days_supply as varchar)]"),
    ("procedure", "'On which date was procedure ' || procedure_code || ' of claim ' || claim_id || ' done for patient ' || patient_id || '?'",
     "[cast(date_service as varchar)]"),
]
TABLE_EVALS = (
    "select dataset_record_id, source_table, patient_id, claim_id, question, facts as expected_facts from (select *, row_number() over "
    "(partition by patient_id, source_table order by dataset_record_id) as er from ("
    "select dataset_record_id, source_table, patient_id, claim_id, question, min(facts) as facts from ("
    + " union all ".join(
        f"select md5('user:' || {q}) as dataset_record_id, '{table}' as source_table, patient_id, "
        f"{'cast(null as varchar)' if table == 'enrollment' else 'claim_id'} as claim_id, {q} as question, "
        f"array_to_string(list_filter({f}, lambda x: x is not null), '|') as facts from {'procs' if table == 'procedure' else table} t"
        for table, q, f in _TABLE_QUESTIONS
    )
    + ") where question is not null and facts <> '' group by 1, 2, 3, 4, 5)) where er <= 2"
)
FLAT_EVALS = """select dataset_record_id, '2024-01-01' as created_on, 'generator' as created_by,
    '2024-01-01' as updated_on, 'generator' as last_updated_by, cast(null as string) as user_name,
    'PATIENT_ID: ' || patient_id as doc_uri, cast(null as string) as trace_id, question,
    array_to_string(facts, '|') as expected_facts from evals"""
FLAT_TRACES = """select md5('user:' || request) as dataset_record_id, strftime(ts, '%Y-%m-%d') as created_on,
    'trace' as created_by, {updated} as updated_on, {by} as last_updated_by, cast(null as string) as user_name,
    cast(null as string) as doc_uri, trace_id, request as question, cast(null as string) as expected_facts
    from traces"""

# --- scorers ---------------------------------------------------------------------------


def tok(x: str) -> str:
    return (
        f"list_filter(list_distinct(string_split(lower(regexp_replace(coalesce({x}, ''), '[^A-Za-z0-9]+', ' ', 'g')), ' ')), "
        "lambda t: t <> '')"
    )


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def has_digit(words: str) -> str:
    return f"list_filter({words}, lambda t: regexp_matches(t, '[0-9]'))"


def long_words(words: str) -> str:
    return f"list_filter({words}, lambda t: length(t) >= 4)"


def _facts(words: str) -> str:
    return f"len(list_filter(facts, lambda f: list_has_all({words}, {tok('f')})))"


def _rule(condition: str) -> str:
    return f"case when {condition} then 1 else 0 end"


def _stops(code: str) -> str:
    return count("plain", r"\b(" + "|".join(lex.STOP_WORDS[code]) + r")\b")


_PII = " or ".join(f"regexp_matches(response, '{p}')" for p in lex.PII_PATTERNS)
_UNSAFE = "list_has_any(r, [" + ", ".join(f"'{w}'" for w in lex.UNSAFE_WORDS) + "])"
_WORDS, _SENTENCES = count("response", "[^ \\t\\n\\r]+"), f"greatest({count('response', '[.!?]+')}, 1)"
_ANSWERED = "case when length(response) > 0 then 1 end"

# scorer -> (hits, total, unit, reason when there is nothing to measure, value then)
SCORE = {
    "correctness": (_facts("r"), "len(facts)", "expected facts in the response", "no expected facts", "null"),
    "retrieval_sufficiency": (_facts("c"), "len(facts)", "expected facts in the tool output", "no expected facts", "null"),
    "groundedness": (f"len(list_intersect({has_digit('r')}, c))", f"len({has_digit('r')})",
                     "stated facts in the tool output", "no stated facts", "1.0"),
    "retrieval_relevance": (f"len(list_filter(ctx, lambda k: list_has_any({tok('k')}, {has_digit('q')})))", "len(ctx)",
                            "chunks about the question", "no tool output", "null"),
    "relevance": (f"len(list_intersect({long_words('q')}, r))", f"len({long_words('q')})",
                  "question words in the response", "no question words", "null"),
    "message_relevance": (f"len(list_intersect({long_words('m')}, r))", f"len({long_words('m')})",
                          "words of the last user message in the response", "no user message with words", "null"),
    "safety": (_rule(f"not {_UNSAFE}"), _ANSWERED, "rules met", "no response", "null"),
    "guideline_clarity": (
        _rule(f"{_WORDS} <= {lex.MAX_WORDS} and {_WORDS} <= {_SENTENCES} * {lex.MAX_WORDS_PER_SENTENCE}"),
        _ANSWERED, "rules met", "no response", "null"),
    "guideline_accuracy": (_facts("r"), "len(facts)", "expected facts in the response", "no expected facts", "null"),
    "guideline_english": (
        _rule(f"{_stops('en')} >= greatest({_stops('de')}, {_stops('fr')}, {_stops('es')}) and "
              f"{_stops('en')} * 20 >= {count('plain', '[^ ]+')} * {lex.MIN_STOP_WORDS_PER_20}"),
        _ANSWERED, "rules met", "no response", "null"),
    "no_speculation": (
        _rule(f"coalesce(len(ctx), 0) > 0 or len(list_filter({has_digit('r')}, lambda t: not list_contains(q, t))) = 0"),
        _ANSWERED, "rules met", "no response", "null"),
    "no_pii": (_rule(f"not ({_PII})"), _ANSWERED, "rules met", "no response", "null"),
    "tool_precision": ("len(list_intersect(list_distinct(expected), list_distinct(called)))", "len(list_distinct(called))",
                       "called tools expected", "no tool called", "null"),
    "tool_recall": ("len(list_intersect(list_distinct(expected), list_distinct(called)))", "len(list_distinct(expected))",
                    "expected tools called", "no tool expected", "null"),
}
EMPTY_RECORD = {
    "last_user": "cast(null as string)", "request": "cast(null as string)", "response": "cast(null as string)",
    "facts": "cast(null as varchar[])", "ctx": "cast(null as varchar[])", "expected": "cast(null as varchar[])",
    "called": "cast(null as varchar[])", "ts": "cast(null as timestamp)", "state": "cast(null as string)",
}


def record(source: str, **given: str) -> str:
    cols = {"trace_id": "trace_id", **EMPTY_RECORD, **given}
    return "select " + ", ".join(f"{v} as {k}" for k, v in cols.items()) + f" from {source}"


def scored(records: str, uses: list[tuple[str, str, str]], keep: str = "") -> str:
    """Long-form scores of a relation ``records``; uses are (reported name, scorer, condition)."""
    prepared = (
        f"select *, {tok('request')} as q, {tok('response')} as r, {tok('last_user')} as m, "
        f"{tok(chr(39).join(['array_to_string(ctx, ', ' ', ')']))} as c, "
        f"lower(regexp_replace(response, '[^A-Za-z0-9]+', ' ', 'g')) as plain from {records}"
    )
    parts = []
    for name, scorer, condition in uses:
        hits, total, unit, reason, empty = SCORE[scorer]
        parts.append(
            f"select trace_id, {keep} '{name}' as scorer, "
            f"case when t > 0 then cast(h as double) / cast(t as double) else cast({empty} as double) end as value, "
            f"case when t > 0 then concat(h, ' of ', t, ' {unit}') else '{reason}' end as rationale "
            f"from (select *, {hits} as h, coalesce({total}, 0) as t from ({prepared}) where {condition})"
        )
    return " union all ".join(parts)


def simple(*names: str) -> list[tuple[str, str, str]]:
    return [(n, n, "true") for n in names]


ANSWERS = record(
    "medical_claim",
    trace_id="claim_id",
    request="'Which claims are there for patient ' || patient_id || '?'",
    last_user="'Which claims are there for patient ' || patient_id || '?'",
    response=ANSWER,
    facts="[claim_id, cast(date_service as string), location_of_care]",
    ctx=CONTEXT,
)
DOCUMENT_ANSWERS = record("documents", trace_id="'doc-' || cast(doc_id as string)", response="text")
EVAL_ANSWERS = record(
    "evals", trace_id="dataset_record_id", request="question", last_user="question", response=ANSWER,
    facts="facts", ctx=CONTEXT,
)
TRACE_RECORDS = record("traces", request="request", response="response", ctx="ctx", ts="ts", state="state")


def sampled(name: str, rate: float) -> str:
    return f"cast('0x' || substr(md5('{name}:' || trace_id), 1, 8) as bigint) / 4294967296.0 < {rate}"


MONITOR_USES = [
    ("safety_check", "safety", sampled("safety_check", 0.5)),
    ("is_english", "guideline_english", sampled("is_english", 0.7)),
    ("is_grounded", "groundedness", sampled("is_grounded", 0.8) + " and state = 'OK'"),
]
MONITORED = with_("traces", scored("rec", MONITOR_USES, "state,"), rec=TRACE_RECORDS)
MONITORED_TS = scored("rec", MONITOR_USES, "ts,")
# Traces with the third of the whole span of time they fall into.
TIME_PARTS = """
    select t.*, least(2, floor((cast(floor(epoch(ts)) as bigint) - lo) * 3 / (hi - lo + 1))) as part
    from traces t, (select min(cast(floor(epoch(ts)) as bigint)) as lo, max(cast(floor(epoch(ts)) as bigint)) as hi from traces)"""
# A rate raised, a filter set and a scorer added for the last third.
LIVE_USES = [
    ("safety_check", "safety", f"part < 2 and {sampled('safety_check', 0.5)}", 1),
    ("safety_check", "safety", f"part >= 2 and {sampled('safety_check', 0.8)} and state = 'ERROR'", 2),
    ("is_english", "guideline_english", sampled("is_english", 0.7), 1),
    ("is_grounded", "groundedness", sampled("is_grounded", 0.8) + " and state = 'OK'", 1),
    ("no_contact", "no_pii", f"part >= 2 and {sampled('no_contact', 0.3)}", 1),
]

# --- messages, routing --------------------------------------------------------------------

PAIRS = """
    select a.conv_id, a.turn, u.turn as request_turn, u.content as request, a.content as response
    from (select m.*, (select max(x.turn) from messages x
                       where x.conv_id = m.conv_id and x.role = 'user' and x.turn < m.turn) as asked
          from messages m where role = 'assistant') a
    left join messages u on u.conv_id = a.conv_id and u.turn = a.asked"""
PARTS = """
    select conv_id, turn // 1000 as part_no, count(*) as n_messages,
           string_agg(role, ',' order by turn) as roles,
           string_agg(role || ':' || content, chr(10) order by turn) as body
    from messages group by all"""

_HEX = "([0-9a-f]{32})"


def routed(asked: str) -> str:
    def found(pattern: str, text: str = "question") -> str:
        return f"nullif(regexp_extract({text}, '{pattern}', 1), '')"

    def says(*words: str) -> str:
        return "(" + " or ".join(f"contains(lower(question), '{w}')" for w in words) + ")"

    date = found("([0-9]{4}-[0-9]{2}-[0-9]{2})")
    code = found("(?:^|[^0-9A-Za-z])([A-Z][0-9][0-9A-Z](?:[.]?[0-9A-Z]{1,4})?)(?:[^0-9A-Za-z]|$)")
    keyed = f"""
        select request_id, question,
               {found('patient(?:[ _]id)?[^0-9a-z]+' + _HEX, 'lower(question)')} as patient_id,
               {found('claim(?:[ _]id)?[^0-9a-z]+' + _HEX, 'lower(question)')} as claim_id,
               {found('(?:^|[^0-9A-Za-z])([0-9]{11})(?:[^0-9A-Za-z]|$)')} as ndc,
               case when {says('diagnos')} then {code} end as diagnosis_code,
               try_cast({date} as date) as service_date
        from {asked}"""
    tool = f"""case
        when ndc is not null then 'claims_by_ndc'
        when patient_id is null and diagnosis_code is not null then 'claims_by_diagnosis'
        when patient_id is null and claim_id is not null then 'claim_lookup'
        when patient_id is null then null
        when service_date is not null and {says('claim')} then 'get_medical_claims'
        when service_date is not null then 'journey_on_date'
        when {says('enrol')} then 'get_patient_enrollment'
        when {says('latest medication')} then 'latest_medication_diagnosis'
        when {says('medication', 'pharmac', 'prescri')} then 'get_pharmacy_claims'
        when {says('diagnos')} then 'get_patient_diagnoses'
        when {says('procedure')} then 'get_patient_procedures'
        when {says('claims')} then 'patient_claims'
        when {says('journey')} then 'patient_journey' end"""
    topic = "(?i)(patient|claim|diagnos|pharmac|medication|prescri|procedure|enrol|ndc)"
    return f"""
        select request_id,
               case when tool is not null then 'call'
                    when regexp_matches(question, '{topic}') then 'ask' else 'decline' end as action,
               tool, patient_id, claim_id, ndc, diagnosis_code, service_date
        from (select *, {tool} as tool from ({keyed}))"""


QUESTIONS = f"""
    select patient_id || '-' || question_no as request_id, question
    from ({filled(MONITOR_QUESTIONS + USAGE_QUESTIONS)})
    union all
    select 'conv-' || conv_id || '-' || turn, text from conversations where role = 'user'"""
KEYED = "medical_claim diagnosis pharmacy_claim"

VAGUE = f"""
    select request_id, expected,
           case when substr(md5(request_id), 1, 1) in ('0', '1', '2')
                then regexp_replace(question, 'pharmacy|procedures|enrollment|medical claims', 'claims', 'g')
                else question end as question
    from (select patient_id || '-' || question_no as request_id, question,
                 [(['get_medical_claims', 'get_patient_enrollment', 'get_pharmacy_claims',
                    'get_patient_diagnoses', 'get_patient_procedures'])[question_no]] as expected
          from ({filled(USAGE_QUESTIONS)}))"""

# The trace shapes, by event_id % 8.
_FALSE = '{"assessment_name":"safety","feedback":{"value":false},"rationale":"blocked"}'
_ZERO = '{"assessment_name":"relevance","feedback":{"value":0}}'
_TEXT = '{"assessment_name":"quality","feedback":{"value":"Good"},"rationale":"clear"}'
_EXPECTED = (
    '{"assessment_name":"expected_facts","rationale":"","expectation":{"serialized_value":{"value":"the date"}}}'
)
TRACE_TEXT = f"""
    select cast(event_id as string) as trace_id,
           case when event_type = 'error' then 'ERROR' else 'OK' end as state,
           case when event_id % 8 = 6 then null else
             concat('{{"request_preview":"event ', event_id, '","response_preview":"', event_type, '"',
               case event_id % 8 when 0 then '}}' when 1 then ',"info":{{}}}}'
                 else ',"info":{{"assessments":[' || case event_id % 8
                   when 2 then '{_FALSE}' when 3 then '{_ZERO}' when 4 then '{_TEXT}' when 5 then '{_EXPECTED}'
                   else '{_FALSE},{_TEXT}' end || ']}}}}' end) end as trace
    from events"""
TRACE_ITEMS = """
    select trace_id, state, i as assessment_no,
           json_extract(trace, '$.info.assessments[' || (i - 1) || ']') as a
    from (select *, unnest(range(1, 1 + cast(coalesce(json_array_length(trace, '$.info.assessments'), 0) as bigint))) as i
          from texts)"""

SCORER_LOG = """
    select 'scorer_' || (user_id % 24) as name,
           case when event_type = 'signup' then 'register' else 'update' end as action,
           (['safety', 'guideline_english', 'relevance'])[user_id % 3 + 1] as scorer,
           cast(event_id % 11 as double) / 10.0 as sample_rate,
           case event_id % 3 when 0 then 'state = ''OK''' when 1 then 'value > 50' end as filter_string,
           ts, event_id as seq
    from events"""
JUDGED = """
    select *, case when f is null or (ts, seq) < (f.ts, f.seq) then 'unknown_name'
                   when action = 'register' and (ts, seq) > (f.ts, f.seq) then 'duplicate_name' end as problem
    from (select *, min(case when action = 'register' then {'ts': ts, 'seq': seq} end) over (partition by name) as f
          from log)"""

RATED = """
    select doc_id as item_id, 'reviewer_' || u.r as user_name,
           case when doc_id % 10 = 3 then 'Superb'
                else (['Poor', 'Fair', 'Good', 'Excellent'])[(quality * 2 + toxic + u.no) % 4 + 1] end as rating
    from labels, (values (0, 'a'), (1, 'b')) u(no, r)"""


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}

    # sources and sinks
    out["scan_claims"] = with_(
        "enrollment " + FOUR,
        " union all ".join(
            f"select '{label}' as table_name, count(*) as n_rows, min({d}) as first_date, max({d}) as last_date from {t}"
            for label, t, d in (
                ("enrollment", "enrollment", "date_start"), ("medical_claim", "medical_claim", "date_service"),
                ("diagnosis", "diagnosis", "date_service"), ("pharmacy_claim", "pharmacy_claim", "date_service"),
                ("procedure", "procs", "date_service"),
            )
        ),
    )
    out["scan_identifier"] = with_("diagnosis", "select * from diagnosis")
    out["sink_append"] = out["sink_replace_nested"] = with_("medical_claim", FLAT_EVALS, evals=EVALS)
    out["dataset_lifecycle"] = with_(
        "medical_claim",
        "select true as created, false as created_again, count(*) as n_records, "
        "count(distinct dataset_record_id) as n_ids from evals",
        evals=EVALS,
    )
    out["dataset_preview"] = with_(
        "medical_claim",
        "select n_records, f.* from (select count(*) as n_records from flat), "
        "(select * from flat order by dataset_record_id limit 1) f",
        evals=EVALS, flat=FLAT_EVALS,
    )
    out["trace_search"] = with_(
        "traces",
        "select trace_id, state, run_id, cast(value as double) as value from traces where state = 'OK' "
        "order by ts desc, trace_id limit 5",
    )
    out["trace_by_run"] = with_(
        "traces",
        "select trace_id, state, run_id from traces where run_id in (select t.run_id from traces t where state = 'ERROR' "
        "and ts = (select max(ts) from traces x where x.run_id = t.run_id))",
    )
    out["traffic_source"] = with_(KEYED, filled(MONITOR_QUESTIONS), keys=TRAFFIC_KEYS)

    # patient lookups
    out["patient_enrollment"] = out["patient_enrollment_raw"] = with_("enrollment", top("enrollment"))
    out["medical_claims_on_date"] = with_("medical_claim", ON_DATE, days=CLAIM_DAYS)
    out["patient_diagnoses"] = with_("diagnosis", top("diagnosis"))
    out["patient_diagnoses_all"] = with_(
        "diagnosis",
        "select patient_id, claim_id, date_service, diagnosis_code, diagnosis_qual, admit_diagnosis_ind from diagnosis",
    )
    out["patient_pharmacy"] = with_("pharmacy_claim", top("pharmacy_claim"))
    out["patient_pharmacy_all"] = with_(
        "pharmacy_claim",
        "select " + floats("claim_id patient_id date_service ndc fill_number days_supply dispensed_quantity pay_type "
                           "copay_coinsurance") + " from pharmacy_claim",
    )
    out["patient_procedures"] = with_("procs", top("procs"))
    out["lookup_call"] = with_(
        "enrollment medical_claim",
        "select 'get_patient_enrollment' as function, null as claim_id, patient_id, date_start as date_from, "
        f"date_end as date_to from {ranked('enrollment')} where rn = 1 union all "
        "select 'get_medical_claims', claim_id, patient_id, date_service, date_service_end from "
        f"({ON_DATE})",
        days=CLAIM_DAYS,
    )
    out["lookup_sql_functions"] = with_(
        FOUR,
        " union all ".join(
            f"select '{f}' as function, claim_id, patient_id, date_service from {ranked(t)} where rn <= 50 "
            "and patient_id in (select patient_id from medical_claim)"
            for f, t in (("get_patient_diagnoses", "diagnosis"), ("get_pharmacy_claims", "pharmacy_claim"),
                         ("get_patient_procedures", "procs"))
        ),
    )

    # questions over several tables
    out["patient_journey"] = with_("enrollment " + FOUR, f"{CLAIM_EVENTS} union all {ENROLLMENT_EVENTS}")
    out["journey_on_date"] = with_(
        "enrollment " + FOUR,
        f"select {EVENT_COLUMNS}, event_date as service_date from ev where exists (select 1 from days d "
        "where d.patient_id = ev.patient_id and d.date_service = ev.event_date) union all "
        f"select {', '.join('e.' + c.strip() for c in EVENT_COLUMNS.split(','))}, d.date_service from en e join days d "
        "on d.patient_id = e.patient_id and d.date_service between e.event_date and coalesce(e.event_end, d.date_service)",
        days=CLAIM_DAYS, ev=CLAIM_EVENTS, en=ENROLLMENT_EVENTS,
    )
    out["latest_medication_diagnosis"] = with_(
        "diagnosis pharmacy_claim",
        "select patient_id, claim_id, ndc, fill_date, diagnosis_date, diagnosis_code from ("
        "select f.*, d.date_service as diagnosis_date, d.diagnosis_code, row_number() over (partition by f.patient_id "
        "order by d.date_service desc nulls last, d.diagnosis_code desc nulls last) as pick from fills f left join "
        "(select patient_id, date_service, min(diagnosis_code) as diagnosis_code from diagnosis group by all) d "
        "on d.patient_id = f.patient_id and d.date_service <= f.fill_date) where pick = 1",
        fills=LATEST_FILL,
    )
    out["patient_medications"] = with_(
        "pharmacy_claim",
        "select patient_id, ndc, count(*) as fills, min(date_service) as first_fill, max(date_service) as last_fill, "
        "cast(sum(days_supply) as bigint) as total_days_supply from pharmacy_claim group by patient_id, ndc",
    )
    out["patient_diagnosis_codes"] = with_(
        "diagnosis",
        "select patient_id, diagnosis_code, count(*) as times, min(date_service) as first_date, "
        "max(date_service) as last_date from diagnosis group by patient_id, diagnosis_code",
    )
    out["patient_claims"] = with_(
        FOUR,
        "select patient_id, claim_id, min(event_date) as first_date from ev group by patient_id, claim_id",
        ev=CLAIM_EVENTS,
    )
    out["claim_lookup"] = with_(
        FOUR, f"select {EVENT_COLUMNS} from ev where claim_id in (select claim_id from ({ON_DATE}))",
        days=CLAIM_DAYS, ev=CLAIM_EVENTS,
    )
    out["indexed_claim_lookup"] = with_(
        FOUR,
        f"select {EVENT_COLUMNS} from ev where claim_id in (select claim_id from medical_claim where patient_id = "
        "'70efdf2ec9b086079795c442636b55fb')",
        ev=CLAIM_EVENTS,
    )
    out["claims_by_ndc"] = with_(
        "pharmacy_claim",
        f"select ndc, claim_id, patient_id, date_service from pharmacy_claim where ndc in (select ndc from ({LATEST_FILL}))",
    )
    out["claims_by_diagnosis"] = with_(
        "diagnosis",
        "select diagnosis_code, claim_id, patient_id, date_service from diagnosis where diagnosis_code in ("
        "select d.diagnosis_code from diagnosis d where admit_diagnosis_ind = 'Y' and date_service = "
        "(select max(x.date_service) from diagnosis x where x.diagnosis_code = d.diagnosis_code))",
    )

    # population
    out["enrollment_history"] = with_(
        "enrollment",
        "select patient_id, span_no, min(date_start) as date_start, max(date_end) as date_end, "
        "count(*) as merged_spans from (select *, cast(sum(opens) over (partition by patient_id order by date_start, date_end "
        "rows unbounded preceding) as bigint) as span_no from (select *, case when date_start <= 1 + max(date_end) over "
        "(partition by patient_id order by date_start, date_end rows between unbounded preceding and 1 preceding) "
        "then 0 else 1 end as opens from enrollment)) group by patient_id, span_no",
    )
    out["medication_adherence"] = with_(
        "pharmacy_claim",
        "select p.*, datediff('day', first_fill, last_supply_end) + 1 as period_days, days_covered, "
        "cast(days_covered as double) / cast(datediff('day', first_fill, last_supply_end) + 1 as double) as adherence "
        "from (select patient_id, ndc, count(*) as fills, min(date_service) as first_fill, "
        "max(date_service + days_supply - 1) as last_supply_end from pharmacy_claim group by patient_id, ndc) p "
        "join (select patient_id, ndc, count(distinct day) as days_covered from (select patient_id, ndc, "
        "unnest(generate_series(date_service, date_service + days_supply - 1, interval 1 day)) as day "
        "from pharmacy_claim) group by patient_id, ndc) c using (patient_id, ndc)",
    )
    out["refill_gaps"] = with_(
        "pharmacy_claim",
        "select *, datediff('day', supply_end, next_fill_date) - 1 as gap_days from (select *, lead(fill_date) over "
        "(partition by patient_id, ndc order by fill_date) as next_fill_date from days)",
        days=FILL_DAYS,
    )
    out["diagnosis_trend"] = with_(
        "diagnosis",
        "select *, patients - lag(patients) over (partition by diagnosis_code order by month) as patients_change from ("
        "select diagnosis_code, cast(date_trunc('month', date_service) as date) as month, "
        "count(distinct patient_id) as patients, count(distinct claim_id) as claims from diagnosis group by all)",
    )
    months = "(select distinct patient_id, cast(date_trunc('month', date_service) as date) as month from {})"
    m, p = months.format("medical_claim"), months.format("pharmacy_claim")
    out["population_overlap"] = with_(
        "medical_claim pharmacy_claim",
        "select coalesce(m.month, p.month) as month, case when m.patient_id is null then 'pharmacy_only' "
        "when p.patient_id is null then 'medical_only' else 'both' end as segment, count(*) as patients "
        f"from {m} m full join {p} p on m.patient_id = p.patient_id and m.month = p.month group by 1, 2",
    )
    out["population_members"] = with_("medical_claim pharmacy_claim", f"select * from {m} except select * from {p}")
    money = lambda c: f"cast({c} as decimal(18,4))"
    out["utilization_cost"] = with_(
        "medical_claim procs pharmacy_claim",
        "select month, pay_type, cast(grouping(month, pay_type) as int) as level, cast(sum(claims) as bigint) as claims, "
        "cast(sum(fills) as bigint) as fills, cast(sum(units) as double) as units, cast(sum(charge) as double) as charge, "
        "cast(sum(allowed) as double) as allowed, cast(sum(paid) as double) as paid from ("
        "select date_trunc('month', date_service)::date as month, pay_type, 1 as claims, 0 as fills, "
        "null::decimal(18,4) as units, null::decimal(18,4) as charge, null::decimal(18,4) as allowed, 0::decimal(18,4) as paid "
        "from heads union all "
        "select date_trunc('month', case when m.claim_id is null then p.date_service else m.date_service end)::date, m.pay_type, 0, 0, "
        f"{money('procedure_units')}, {money('line_charge')}, {money('line_allowed')}, 0 "
        "from procs p left join heads m on p.claim_id = m.claim_id union all "
        f"select date_trunc('month', date_service)::date, pay_type, 0, 1, {money('dispensed_quantity')}, "
        f"{money('submitted_gross_due')}, 0, {money('paid_gross_due')} from pharmacy_claim"
        ") group by rollup (month, pay_type)",
        heads="""select claim_id, date_service, pay_type from (select *, row_number() over (
            partition by claim_id order by date_service nulls first, pay_type nulls first) as place
            from medical_claim) where place = 1 or claim_id is null""",
    )
    total = lambda c: f"cast(sum({money(c)}) as double)"
    out["procedure_cost_summary"] = with_(
        "procs",
        f"select procedure_code, count(*) as lines, {total('procedure_units')} as units, {total('line_charge')} as total_charge, "
        f"{total('line_allowed')} as total_allowed, {total('line_charge')} / count(*) as avg_charge, "
        f"{total('line_allowed')} / count(*) as avg_allowed from procs group by procedure_code",
    )

    # evaluation dataset
    out["claim_documents"] = with_(
        "medical_claim",
        f"select patient_id as id, {DOCUMENT} as content, 'PATIENT_ID: ' || patient_id as doc_uri "
        f"from {ranked('medical_claim')} where rn <= 1000",
    )
    out["generate_evals"] = with_(
        "medical_claim",
        "select dataset_record_id, patient_id, claim_id, question, array_to_string(facts, '|') as expected_facts from evals",
        evals=EVALS,
    )
    out["generate_table_evals"] = with_("enrollment " + FOUR, TABLE_EVALS)
    out["eval_record_id"] = with_(
        "messages",
        "select conv_id, case when count(*) = 1 then any_value(md5(body)) else md5(string_agg(md5(body), '' order by part_no)) end "
        "as dataset_record_id from parts group by conv_id",
        parts=PARTS,
    )
    day = "strftime(ts, '%Y-%m-%d')"
    later = "strftime(ts + interval 3 days, '%Y-%m-%d')"
    out["trace_to_record"] = with_("traces", FLAT_TRACES.format(updated=day, by="'trace'"))
    out["upsert_records"] = with_(
        "traces",
        FLAT_TRACES.format(
            updated=f"case when state = 'ERROR' then {later} else {day} end",
            by="case when state = 'ERROR' then 'rerun' else 'trace' end",
        ),
    )
    out["merged_record_store"] = out["upsert_records"]
    out["sync_labels"] = """
        select md5('user:Summarise document ' || d.doc_id) as dataset_record_id, '2024-01-01' as created_on,
               'importer' as created_by, case when l.doc_id is null then '2024-01-01' else '2024-02-01' end as updated_on,
               coalesce('reviewer_' || (l.doc_id % 3), 'importer') as last_updated_by,
               'reviewer_' || (l.doc_id % 3) as user_name, source as doc_uri, cast(null as string) as trace_id,
               'Summarise document ' || d.doc_id as question,
               coalesce('quality ' || quality || '|toxic ' || toxic, lang) as expected_facts
        from documents d left join labels l on l.doc_id = d.doc_id"""
    out["label_validate"] = f"""
        select item_id, user_name, rating,
               case when rating = 'Superb' then 'unknown rating' when length(text) > 1000 then 'fact too long' end as reason
        from ({RATED}) left join documents on doc_id = item_id"""
    out["label_assign"] = """
        select doc_id as item_id, user_name, label_schema from documents,
               (values ('reviewer_a'), ('reviewer_b')) u(user_name),
               (values ('expected_facts'), ('response_quality')) s(label_schema)"""
    out["label_summary"] = f"""
        select item_id, count(*) filter (rating = 'Poor') as poor, count(*) filter (rating = 'Fair') as fair,
               count(*) filter (rating = 'Good') as good, count(*) filter (rating = 'Excellent') as excellent,
               count(*) as n_ratings from ({RATED}) group by item_id"""

    # scorers
    for name in ("correctness", "retrieval_sufficiency", "groundedness", "retrieval_relevance", "relevance",
                 "guideline_accuracy", "no_speculation"):
        out[f"score_{name}"] = with_("medical_claim", scored("rec", simple(name)), rec=ANSWERS)
    for name in ("safety", "guideline_clarity", "guideline_english", "no_pii"):
        out[f"score_{name}"] = with_(
            "medical_claim", scored("rec", simple(name)), rec=f"{ANSWERS} union all {DOCUMENT_ANSWERS}"
        )
    out["score_message_relevance"] = with_(
        "messages", scored("rec", simple("message_relevance")), pairs=PAIRS,
        rec=record("pairs", trace_id="conv_id || '-' || turn", last_user="request", response="response"),
    )
    out["score_tool_calls"] = with_(
        KEYED, scored("rec", simple("tool_precision", "tool_recall")),
        keys=TRAFFIC_KEYS, asked=VAGUE, routed=routed("asked"),
        rec=record(
            "(select a.request_id, a.expected, r.tool from asked a join routed r on r.request_id = a.request_id)",
            trace_id="request_id", expected="expected",
            called="case when tool is null then cast([] as varchar[]) else [tool] end",
        ),
    )
    run = scored("rec", simple(*EVALUATION_SCORERS))
    out["evaluate"] = with_("medical_claim", run, evals=EVALS, rec=EVAL_ANSWERS)
    out["evaluate_summary"] = with_(
        "medical_claim",
        "select scorer, count(*) as n_rows, count(*) filter (value is null) as n_null, "
        "cast(sum(cast(value as decimal(18,6))) as double) / count(value) as mean_value, "
        "cast(count(*) filter (value >= 0.8) as double) / count(value) as pass_rate from scores group by scorer",
        evals=EVALS, rec=EVAL_ANSWERS, scores=run,
    )

    # traces and messages
    out["trace_parse"] = f"""
        with texts as ({TRACE_TEXT}), items as ({TRACE_ITEMS})
        select t.trace_id, t.state, json_extract_string(trace, '$.request_preview') as request_preview,
               json_extract_string(trace, '$.response_preview') as response_preview,
               coalesce((select string_agg(json_extract_string(a, '$.assessment_name'), ',' order by assessment_no)
                         from items i where i.trace_id = t.trace_id), '') as names
        from texts t"""
    out["trace_assessments"] = f"""
        with texts as ({TRACE_TEXT}), items as ({TRACE_ITEMS})
        select trace_id, state, assessment_no, json_extract_string(a, '$.assessment_name') as name,
               json_extract_string(a, '$.feedback.value') as feedback,
               coalesce(nullif(json_extract_string(a, '$.rationale'), ''),
                        json_extract_string(a, '$.expectation.serialized_value.value')) as rationale
        from items"""
    out["trace_summary"] = f"""
        with texts as ({TRACE_TEXT})
        select trace_id, state, json_extract_string(trace, '$.request_preview') as request_preview,
               json_extract_string(trace, '$.response_preview') as response_preview,
               coalesce(json_array_length(trace, '$.info.assessments'), 0) as n_assessments
        from texts"""
    out["prepend_system"] = with_(
        "messages",
        "select conv_id, part_no, case when part_no = 0 then n_messages + 1 else n_messages end as n_messages, "
        "case when part_no = 0 then 'system,' else '' end || roles as roles, "
        f"md5(case when part_no = 0 then 'system:{SYSTEM_PROMPT}' || chr(10) else '' end || body) as text_md5 from parts",
        parts=PARTS,
    )
    out["append_messages"] = with_(
        "messages", "select conv_id, part_no, n_messages, roles, md5(body) as text_md5 from parts", parts=PARTS
    )
    out["message_chunks"] = with_(
        "messages",
        "select conv_id, row_number() over (partition by conv_id order by turn) - 1 as chunk_no, role, content as delta from messages",
    )
    out["tool_call_split"] = with_(
        "messages",
        "select conv_id, turn as last_turn, case when has_calls then 'continue' else 'end' end as next_step "
        "from messages m where turn = (select max(turn) from messages x where x.conv_id = m.conv_id)",
    )
    out["question_route"] = with_(KEYED, routed("asked"), keys=TRAFFIC_KEYS, asked=QUESTIONS)
    calls = "select * from routed where action = 'call'"
    answered = " union all ".join(
        f"select request_id, tool, 'ok' as status, r.rn as row_no, {cid} as claim_id, r.{date} as row_date "
        f"from calls c join {ranked(table)} r on r.patient_id = c.patient_id where tool = '{tool}' and rn <= {n}"
        for tool, table, date, cid, n in (
            ("get_patient_enrollment", "enrollment", "date_start", "null", 1),
            ("get_patient_diagnoses", "diagnosis", "date_service", "r.claim_id", 50),
            ("get_pharmacy_claims", "pharmacy_claim", "date_service", "r.claim_id", 50),
            ("get_patient_procedures", "procs", "date_service", "r.claim_id", 50),
        )
    )
    others = " union all ".join(
        f"select request_id, tool, 'ok', null, r.claim_id, r.{date} from calls c join {rows} r on {on} where tool = '{tool}'"
        for tool, rows, date, on in (
            ("get_medical_claims", "medical_claim", "date_service", "r.patient_id = c.patient_id and r.date_service = c.service_date"),
            ("claims_by_ndc", "pharmacy_claim", "date_service", "r.ndc = c.ndc"),
            ("claims_by_diagnosis", "diagnosis", "date_service", "r.diagnosis_code = c.diagnosis_code"),
            ("claim_lookup", f"({CLAIM_EVENTS})", "event_date", "r.claim_id = c.claim_id"),
            ("journey_on_date", f"({CLAIM_EVENTS})", "event_date", "r.patient_id = c.patient_id and r.event_date = c.service_date"),
            ("journey_on_date", f"({ENROLLMENT_EVENTS})", "event_date", "r.patient_id = c.patient_id and "
             "c.service_date between r.event_date and coalesce(r.event_end, c.service_date)"),
            ("latest_medication_diagnosis", f"({LATEST_FILL})", "fill_date", "r.patient_id = c.patient_id"),
            ("patient_claims", "(select patient_id, claim_id, min(event_date) as event_date from "
             f"({CLAIM_EVENTS}) group by 1, 2)", "event_date", "r.patient_id = c.patient_id"),
            ("patient_journey", f"({CLAIM_EVENTS} union all {ENROLLMENT_EVENTS})", "event_date", "r.patient_id = c.patient_id"),
        )
    )
    out["tool_dispatch"] = with_(
        "enrollment " + FOUR,
        "select * from answers union all "
        "select request_id, tool, 'empty', null, null, null from calls c "
        "where not exists (select 1 from answers a where a.request_id = c.request_id)",
        once=True, keys=TRAFFIC_KEYS, asked=QUESTIONS, routed=routed("asked"), calls=calls, answers=f"{answered} union all {others}",
    )
    out["full_date_format"] = with_(
        "medical_claim",
        "select claim_id, strftime(date_service, '%Y-%m-%d') as service_date, "
        "strftime(date_service_end, '%Y-%m-%d') as service_date_end from medical_claim",
    )
    out["request_response_pairs"] = with_("messages", PAIRS)
    out["vector_topk"] = """
        with q as (select label, embedding from embeddings e
                   where vec_id = (select min(vec_id) from embeddings x where x.label = e.label)),
             s as (select cast(q.label as bigint) as query_id, e.vec_id,
                          list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])) as similarity
                   from q, embeddings e)
        select * from (select query_id, row_number() over (partition by query_id order by similarity desc, vec_id) as rank,
                              vec_id, round(similarity, 6) as similarity from s) where rank <= 5"""

    # monitoring
    out["scorer_config"] = f"""
        with log as ({SCORER_LOG}), judged as ({JUDGED}),
             newest as (select *, row_number() over (partition by name order by ts desc, seq desc) as back,
                               count(*) over (partition by name) as version
                        from judged where problem is null),
             named as (select *, row_number() over (order by f, name) as place from newest where back = 1)
        select name, version, scorer, sample_rate, filter_string, place <= 20 as active from named"""
    out["scorer_config_errors"] = f"""
        with log as ({SCORER_LOG}), judged as ({JUDGED})
        select name, action, seq, problem from judged where problem is not null
        union all
        select name, action, seq, 'too_many_scorers' from judged
        where problem is null and action = 'register' and name in (
          select name from (select name, row_number() over (order by min(f), name) as place from judged
                            where problem is null group by name) where place > 20)"""
    out["scorer_sample"] = with_(
        "traces",
        " union all ".join(
            f"select trace_id, '{n}' as scorer from traces where {sampled(n, r)}"
            for n, r in (("safety_check", 0.5), ("is_english", 0.7), ("is_grounded", 0.8))
        ),
    )
    out["scorer_filter"] = with_(
        "traces",
        "select trace_id, 'safety_check' as scorer from traces union all select trace_id, 'is_english' from traces "
        "union all select trace_id, 'is_grounded' from traces where state = 'OK' "
        "union all select trace_id, 'large_values' from traces where value > 50 and state = 'OK'",
    )
    out["monitor_stream"] = out["monitor_dedup"] = MONITORED
    mean = "cast(sum(cast(value as decimal(18,6))) as double) / count(value)"
    out["quality_trend"] = with_(
        "traces",
        "select scorer, strftime(date_trunc('day', ts), '%Y-%m-%d') as window_start, count(*) as n_scores, "
        f"{mean} as mean_value from scores group by 1, 2",
        rec=TRACE_RECORDS, scores=MONITORED_TS,
    )
    out["quality_trend_sliding"] = with_(
        "traces",
        "select scorer, strftime(date_trunc('day', ts) - to_days(back), '%Y-%m-%d') as window_start, count(*) as n_scores, "
        f"{mean} as mean_value from scores, (values (0), (1)) b(back) group by 1, 2",
        rec=TRACE_RECORDS, scores=MONITORED_TS,
    )
    out["error_rate_trend"] = with_(
        "traces",
        "select strftime(date_trunc('day', ts), '%Y-%m-%d') as window_start, count(*) as n_traces, "
        "count(*) filter (state <> 'OK') as n_errors, cast(count(*) filter (state <> 'OK') as double) / count(*) as error_rate "
        "from traces group by 1",
    )
    out["monitor_live"] = with_(
        "traces",
        " union all ".join(
            f"select *, {version} as config_version from ({scored('rec', [(name, kind, where)], 'state,')})"
            for name, kind, where, version in LIVE_USES
        ),
        parts=TIME_PARTS, rec=record("parts", request="request", response="response", ctx="ctx", ts="ts", state="state", part="part"),
    )
    on_time = "select * from parts where not (part = 0 and cast(trace_id as bigint) % 97 = 0)"
    closed = "date_trunc('day', ts) + interval 1 day <= (select max(ts) from {0}) - interval 1 hour"
    out["quality_trend_closed"] = with_(
        "traces",
        "select scorer, strftime(date_trunc('day', ts), '%Y-%m-%d') as window_start, count(*) as n_scores, "
        f"{mean} as mean_value from scores where {closed.format('scores')} group by 1, 2",
        parts=TIME_PARTS, kept=on_time, rec=TRACE_RECORDS.replace("from traces", "from kept"), scores=MONITORED_TS,
    )
    out["error_rate_trend_closed"] = with_(
        "traces",
        "select strftime(date_trunc('day', ts), '%Y-%m-%d') as window_start, count(*) as n_traces, "
        "count(*) filter (state <> 'OK') as n_errors, cast(count(*) filter (state <> 'OK') as double) / count(*) as error_rate "
        f"from kept where {closed.format('kept')} group by 1",
        parts=TIME_PARTS, kept=on_time,
    )
    return out
