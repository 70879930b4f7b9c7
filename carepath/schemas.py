"""Declared schemas: the five claim tables, messages, eval records and traces."""

from __future__ import annotations

from pyspark.sql import types as T


S, D, I, FL = T.StringType(), T.DateType(), T.IntegerType(), T.FloatType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Public column names and types of the five claim tables.
ENROLLMENT = _struct(
    patient_id=S, patient_gender=S, patient_year_of_birth=S, patient_zip3=S, patient_state=S,
    date_start=D, date_end=D, benefit_type=S, pay_type=S,
)
MEDICAL_CLAIM = _struct(
    claim_id=S, patient_id=S, date_service=D, date_service_end=D, location_of_care=S, pay_type=S,
)
DIAGNOSIS = _struct(
    claim_id=S, patient_id=S, date_service=D, date_service_end=D,
    diagnosis_code=S, diagnosis_qual=S, admit_diagnosis_ind=S,
)
PHARMACY_CLAIM = _struct(
    claim_id=S, patient_id=S, date_service=D, ndc=S, fill_number=I, days_supply=I,
    dispensed_quantity=FL, pay_type=S, copay_coinsurance=FL, submitted_gross_due=FL, paid_gross_due=FL,
)
PROCEDURE = _struct(
    claim_id=S, patient_id=S, service_line_number=S, date_service=D, date_service_end=D,
    procedure_code=S, procedure_qual=S, procedure_units=FL, revenue_code=S, line_charge=FL, line_allowed=FL,
)

CLAIM_TABLES: dict[str, T.StructType] = {
    "enrollment": ENROLLMENT,
    "medical_claim": MEDICAL_CLAIM,
    "diagnosis": DIAGNOSIS,
    "pharmacy_claim": PHARMACY_CLAIM,
    "procedure": PROCEDURE,
}

TOOL_CALL = _struct(name=S, args=T.MapType(S, S))
MESSAGE = _struct(role=S, content=S, tool_calls=T.ArrayType(TOOL_CALL))

# The nested evaluation table.
TIME = T.TimestampType()
SOURCE = _struct(
    human=_struct(user_name=S), document=_struct(doc_uri=S, content=S), trace=_struct(trace_id=S)
)
EVAL_TABLE = _struct(
    dataset_record_id=S, create_time=TIME, created_by=S, last_update_time=TIME, last_updated_by=S,
    source=SOURCE, inputs=S, expectations=S, tags=T.MapType(S, S),
)

# The part of a trace's JSON that the trace operators read.  feedback.value is
# declared as text because it may hold a boolean, a number or a string.
ASSESSMENT = _struct(
    assessment_name=S,
    feedback=_struct(value=S),
    rationale=S,
    expectation=_struct(serialized_value=_struct(value=S)),
)
TRACE_JSON = _struct(
    request_preview=S, response_preview=S, info=_struct(assessments=T.ArrayType(ASSESSMENT))
)

EVAL_INPUTS = _struct(messages=T.ArrayType(_struct(role=S, content=S)))
EVAL_EXPECTATIONS = _struct(expected_facts=T.ArrayType(S))
