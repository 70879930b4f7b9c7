"""Reading and writing the claim tables and evaluation tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carepath.functions.text import long_id, short_id
from carepath.operators.evalset import changed_ids, upsert_records
from carepath.schemas import CLAIM_TABLES, EVAL_TABLE
from carepath.session import side_by_side


@dataclass(frozen=True)
class Claims:
    """The five claim tables."""

    enrollment: DataFrame
    medical_claim: DataFrame
    diagnosis: DataFrame
    pharmacy_claim: DataFrame
    procedure: DataFrame

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(f.name, getattr(self, f.name)) for f in fields(self)]


def read_claims(spark: SparkSession, root: str) -> Claims:
    """The five tables from parquet folders under ``root``, keys as stored (so filters reach the files)."""
    return Claims(**{name: spark.read.parquet(f"{root}/{name}") for name in CLAIM_TABLES})


def read_identifier(spark: SparkSession, catalog: str, schema: str, table: str) -> DataFrame:
    """A table named by bound parameters, never by text pasted into the query."""
    return spark.sql(
        "SELECT * FROM IDENTIFIER(:cat || '.' || :sch || '.' || :tab)",
        args={"cat": catalog, "sch": schema, "tab": table},
    )


def claims_from_catalog(spark: SparkSession, catalog: str, schema: str) -> Claims:
    return Claims(**{name: read_identifier(spark, catalog, schema, name) for name in CLAIM_TABLES})


def write_claims(claims: Claims, root: str, partitions: int | None = None) -> None:
    """Write the tables laid out for lookups by patient.

    Rows are range-partitioned and sorted by (patient_id, date, ...), so a filter
    on a patient skips nearly every file and row group by its min/max statistics,
    while a patient with very many rows still spreads over several files.  Ids move
    as bytes and are ordered and written as the strings they are.
    """

    def write(item: tuple[str, DataFrame]) -> None:
        name, df = item
        date_col = "date_start" if name == "enrollment" else "date_service"
        order = ["patient_id", date_col] + (["claim_id"] if "claim_id" in df.columns else [])
        ids = [c for c in ("patient_id", "claim_id") if c in df.columns and df.schema[c].dataType == T.StringType()]
        whole = {c: long_id(F.col(c)) for c in ids}
        by = [whole.get(c, F.col(c)) for c in order]
        packed = df.withColumns({c: short_id(F.col(c)) for c in ids})
        spread = packed.repartitionByRange(partitions, *by) if partitions else packed.repartitionByRange(*by)
        rows = spread.withColumns(whole).sortWithinPartitions(*order)
        rows.write.mode("errorifexists").option("compression", "zstd").parquet(f"{root}/{name}")

    side_by_side(claims.enrollment.sparkSession, write, claims.items())


def register_claims(spark: SparkSession, root: str, schema: str) -> None:
    """Make written claim tables known to the session catalog as schema.table."""
    ensure_schema(spark, schema, f"{root}/_schema_{schema}")
    for name in CLAIM_TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_ident(schema)}.{_ident(name)}")
        spark.catalog.createTable(f"{schema}.{name}", path=f"{root}/{name}", source="parquet")


def scan_summary(claims: Claims) -> DataFrame:
    """Rows, patients' date range per table: one narrow scan of each table."""
    parts = []
    for name, df in claims.items():
        date_col = "date_start" if name == "enrollment" else "date_service"
        parts.append(
            df.agg(
                F.count(F.lit(1)).alias("n_rows"),
                F.min(date_col).alias("first_date"),
                F.max(date_col).alias("last_date"),
            ).select(F.lit(name).alias("table_name"), "n_rows", "first_date", "last_date")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- tables of evaluation records -------------------------------------------------


def _ident(name: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def ensure_schema(spark: SparkSession, schema: str, location: str) -> None:
    quoted = location.replace("'", "\\'")
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {_ident(schema)} LOCATION '{quoted}'")


def create_dataset(spark: SparkSession, table: str, path: str, schema: T.StructType) -> bool:
    """Create an empty table at ``path``; False (and nothing done) where it is already there."""
    if spark.catalog.tableExists(table):
        return False
    spark.createDataFrame([], schema).write.mode("errorifexists").option("path", path).saveAsTable(table)
    return True


def drop_dataset(spark: SparkSession, table: str) -> bool:
    """Drop a table if present; says whether it was."""
    present = spark.catalog.tableExists(table)
    spark.sql(f"DROP TABLE IF EXISTS {_ident(table)}")
    return present


def load_dataset(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def append_records(df: DataFrame, table: str) -> None:
    """Append to a table.  Reruns duplicate rows: see ``merge_dataset`` for the keyed form."""
    df.write.mode("append").saveAsTable(table)


def replace_records(df: DataFrame, table: str, folder: str, schema: T.StructType) -> None:
    """Replace a table's rows, in the declared (possibly nested) schema: write a new version, then switch to it.

    The old version stays readable until the switch, so ``df`` may read the table itself,
    and a failed write leaves the table as it was.
    """
    path = f"{folder}/version-{uuid.uuid4().hex}"
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).write.parquet(path)
    quoted = path.replace("'", "\\'")
    df.sparkSession.sql(f"ALTER TABLE {_ident(table)} SET LOCATION '{quoted}'")
    df.sparkSession.catalog.refreshTable(table)


def merge_dataset(updates: DataFrame, table: str, folder: str) -> None:
    """Upsert evaluation records into a table, as a new version; a rerun changes nothing, and writes nothing.

    A filled table is first compared with the updates by digests, so that whole records are shuffled
    and written only where some record changes.
    """
    existing = load_dataset(updates.sparkSession, table)
    if not existing.isEmpty() and changed_ids(existing, updates).isEmpty():
        return
    merged = upsert_records(existing, updates)
    replace_records(merged, table, folder, EVAL_TABLE)


def dataset_preview(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Row count and the first record in ``order`` as one row (``n_records`` plus its columns); one aggregation."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.agg(F.count(F.lit(1)).alias("n_records"), first.alias("first")).select("n_records", "first.*")
