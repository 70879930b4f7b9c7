"""Population analytics over all patients.

Windows here run over rows already reduced to one per calendar day, so no key,
however many raw rows it has, brings more than its number of days to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carepath.functions.money import exact, exact_mean, exact_sum

OPEN_END = "9999-12-31"


def enrollment_history(enrollment: DataFrame) -> DataFrame:
    """Enrollment spans merged where they overlap or touch.

    A NULL end counts as open and comes out NULL again; spans without a start
    cannot be placed in time and take no part.
    """
    days = (
        enrollment.where(F.col("date_start").isNotNull())
        .groupBy("patient_id", "date_start")
        .agg(
            F.max(F.coalesce("date_end", F.lit(OPEN_END).cast("date"))).alias("end"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    by_start = Window.partitionBy("patient_id").orderBy("date_start")
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max("end").over(before)
    opens = F.when(reach.isNull() | (F.datediff("date_start", reach) > 1), 1).otherwise(0)
    return (
        days.withColumn("opens", opens)
        .withColumn("span_no", F.sum("opens").over(upto))
        .groupBy("patient_id", "span_no")
        .agg(
            F.min("date_start").alias("date_start"),
            F.max("end").alias("end"),
            F.sum("n").alias("merged_spans"),
        )
        .select(
            "patient_id",
            "span_no",
            "date_start",
            F.when(F.col("end") < F.lit(OPEN_END).cast("date"), F.col("end")).alias("date_end"),
            "merged_spans",
        )
    )


def _fill_days(pharmacy_claim: DataFrame) -> DataFrame:
    """Fills of a day as one row: (patient_id, ndc, fill_date, supply_end, fills)."""
    supply = F.greatest(F.coalesce(F.col("days_supply"), F.lit(0)), F.lit(0))
    return (
        pharmacy_claim.where(F.col("date_service").isNotNull())
        .groupBy("patient_id", "ndc", F.col("date_service").alias("fill_date"))
        .agg(F.max(supply).alias("supply"), F.count(F.lit(1)).alias("fills"))
        .withColumn("supply_end", F.expr("date_add(fill_date, cast(supply as int) - 1)"))
        .drop("supply")
    )


def medication_adherence(pharmacy_claim: DataFrame) -> DataFrame:
    """Days covered by supply over the days from first fill to last supply end, per patient and drug.

    Overlapping supplies count once: each fill adds only the days after the supply
    seen so far, so no day list is ever built.
    """
    before = (
        Window.partitionBy("patient_id", "ndc")
        .orderBy("fill_date")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    reach = F.max("supply_end").over(before)
    from_day = F.greatest(F.col("fill_date"), F.date_add(reach, 1))
    added = F.greatest(F.datediff("supply_end", from_day) + 1, F.lit(0))
    return (
        _fill_days(pharmacy_claim)
        .withColumn("added", added)
        .groupBy("patient_id", "ndc")
        .agg(
            F.sum("fills").alias("fills"),
            F.min("fill_date").alias("first_fill"),
            F.max("supply_end").alias("last_supply_end"),
            F.sum("added").alias("days_covered"),
        )
        .withColumn("period_days", F.datediff("last_supply_end", "first_fill") + 1)
        .withColumn(
            "adherence", F.try_divide(F.col("days_covered").cast("double"), F.col("period_days").cast("double"))
        )
    )


def refill_gaps(pharmacy_claim: DataFrame) -> DataFrame:
    """Per fill day: the next fill day of the drug and the days without supply between (negative: overlap)."""
    order = Window.partitionBy("patient_id", "ndc").orderBy("fill_date")
    return (
        _fill_days(pharmacy_claim)
        .withColumn("next_fill_date", F.lead("fill_date").over(order))
        .withColumn("gap_days", F.datediff("next_fill_date", "supply_end") - 1)
        .select("patient_id", "ndc", "fill_date", "fills", "supply_end", "next_fill_date", "gap_days")
    )


def _packed(key: Column) -> Column:
    """A key in half the bytes where it is 32 hexadecimal digits, else one longer than those; equal keys only are equal."""
    other = F.concat(F.lit(bytearray(17)), F.encode(key, "UTF-8"))
    return F.when(key.rlike(r"^[0-9a-f]{32}\z"), F.unhex(key)).otherwise(other)


def diagnosis_trend(diagnosis: DataFrame) -> DataFrame:
    """Patients and claims per code and month, and the change in patients from the code's previous month listed."""
    monthly = diagnosis.groupBy("diagnosis_code", F.trunc("date_service", "MM").alias("month")).agg(
        F.count_distinct(_packed(F.col("patient_id"))).alias("patients"),
        F.count_distinct(_packed(F.col("claim_id"))).alias("claims"),
    )
    by_month = Window.partitionBy("diagnosis_code").orderBy("month")
    return monthly.withColumn("patients_change", F.col("patients") - F.lag("patients").over(by_month))


def _membership(medical: DataFrame, pharmacy: DataFrame, keys: Sequence[str]) -> DataFrame:
    yes, no = F.lit(1), F.lit(0)
    both = medical.select(*keys, yes.alias("m"), no.alias("p")).unionByName(
        pharmacy.select(*keys, no.alias("m"), yes.alias("p"))
    )
    seen = both.groupBy(*keys).agg(F.max("m").alias("m"), F.max("p").alias("p"))
    segment = (
        F.when((F.col("m") == 1) & (F.col("p") == 1), "both")
        .when(F.col("m") == 1, "medical_only")
        .otherwise("pharmacy_only")
    )
    return seen.select(*keys, segment.alias("segment"))


def population_overlap(medical: DataFrame, pharmacy: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Patients seen in both kinds of claims, or in one only; per value of ``by`` (say, a month) if given.

    Flags over a union give the full outer join of the two distinct patient sets
    with one shuffle of already combined keys instead of three.
    """
    return (
        _membership(medical, pharmacy, ["patient_id", *by])
        .groupBy(*by, "segment")
        .agg(F.count(F.lit(1)).alias("patients"))
    )


def population_members(medical: DataFrame, pharmacy: DataFrame, segment: str, by: Sequence[str] = ()) -> DataFrame:
    """The patients of one segment: both, medical_only or pharmacy_only."""
    keys = ["patient_id", *by]
    in_medical = medical.select(*keys).distinct()
    in_pharmacy = pharmacy.select(*keys).distinct()
    if segment == "both":
        return in_medical.join(in_pharmacy, keys, "left_semi")
    if segment == "medical_only":
        return in_medical.join(in_pharmacy, keys, "left_anti")
    if segment == "pharmacy_only":
        return in_pharmacy.join(in_medical, keys, "left_anti")
    raise ValueError(f"unknown segment {segment!r}")


def utilization_cost(medical_claim: DataFrame, procedure: DataFrame, pharmacy_claim: DataFrame) -> DataFrame:
    """Claims, fills, units, charge, allowed and paid by month and pay type, with subtotals.

    ``claims`` counts distinct claims by header: of repeated headers the earliest, then the
    smallest pay type, stands for the claim.  Lines without a header count no claim; their
    money goes to the month of the line and an unknown pay type.  Lines are summed per claim
    and month before the join, both sides are one row per month and pay type before the rollup.
    """
    month = F.trunc("date_service", "MM").alias("month")
    zero = F.lit(0).cast("decimal(38,4)")

    def sums(**cols: str) -> list:
        return [F.sum(exact(c)).cast("decimal(38,4)").alias(name) for name, c in cols.items()]

    lines = procedure.groupBy("claim_id", month).agg(
        *sums(units="procedure_units", charge="line_charge", allowed="line_allowed")
    )
    first = F.min(F.struct("date_service", "pay_type")).alias("h")
    headers = medical_claim.where(F.col("claim_id").isNotNull()).groupBy("claim_id").agg(first)
    headers = headers.select(
        "claim_id", F.trunc("h.date_service", "MM").alias("head_month"), F.col("h.pay_type").alias("pay_type"),
        F.lit(True).alias("known"),
    )
    # a header without lines counts as a claim, too
    both = headers.join(lines, "claim_id", "full")
    unnamed = medical_claim.where(F.col("claim_id").isNull()).select(month, "pay_type", F.lit(1).cast("bigint").alias("claims"))
    per_claim = both.groupBy("claim_id", F.when(F.col("known"), F.col("head_month")).otherwise(F.col("month")).alias("month"), "pay_type").agg(
        F.max(F.when(F.col("known"), 1).otherwise(0)).cast("bigint").alias("claims"),
        *[F.sum(c).cast("decimal(38,4)").alias(c) for c in ("units", "charge", "allowed")],
    )
    medical = (
        per_claim.unionByName(unnamed, allowMissingColumns=True)
        .groupBy("month", "pay_type")
        .agg(
            F.sum("claims").alias("claims"),
            F.lit(0).cast("bigint").alias("fills"),
            *[F.sum(c).cast("decimal(38,4)").alias(c) for c in ("units", "charge", "allowed")],
            zero.alias("paid"),
        )
    )
    pharmacy = pharmacy_claim.groupBy(month, "pay_type").agg(
        F.lit(0).cast("bigint").alias("claims"),
        F.count(F.lit(1)).alias("fills"),
        *sums(units="dispensed_quantity", charge="submitted_gross_due"),
        zero.alias("allowed"),
        *sums(paid="paid_gross_due"),
    )
    return (
        medical.unionByName(pharmacy)
        .rollup("month", "pay_type")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.sum("claims").alias("claims"),
            F.sum("fills").alias("fills"),
            *[F.sum(c).cast("double").alias(c) for c in ("units", "charge", "allowed", "paid")],
        )
    )


def procedure_cost_summary(procedure: DataFrame) -> DataFrame:
    return procedure.groupBy("procedure_code").agg(
        F.count(F.lit(1)).alias("lines"),
        exact_sum("procedure_units").alias("units"),
        exact_sum("line_charge").alias("total_charge"),
        exact_sum("line_allowed").alias("total_allowed"),
        exact_mean("line_charge").alias("avg_charge"),
        exact_mean("line_allowed").alias("avg_allowed"),
    )
