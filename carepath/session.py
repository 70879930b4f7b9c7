"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_LOCAL_BASE: dict[str, str] = {}


# What a shuffle partition should hold before adaptive execution joins small ones.
PARTITION_BYTES = 128 * 2**20


def initial_partitions(input_bytes: int) -> int:
    """Shuffle partitions to start with for an input of this size."""
    return max(200, -(-input_bytes // PARTITION_BYTES))


def build_session(
    app: str = "carepath", master: str | None = None, conf: dict | None = None, input_bytes: int | None = None
) -> SparkSession:
    """A session with the settings the operators are planned for.

    Adaptive execution joins small shuffle partitions and splits skewed ones of joins.
    ``input_bytes``, the size of the tables to be read, sets the number it starts from.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if input_bytes is not None:
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(initial_partitions(input_bytes))
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_base(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` as the session names it.

    Only a local-mode session without that setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_BASE:
        _LOCAL_BASE[app] = tempfile.mkdtemp(prefix="carepath-")
    return _LOCAL_BASE[app]


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path under the shared folder (nothing is created yet)."""
    return f"{shared_base(spark)}/carepath/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written under the shared folder and read back: computed once, lineage cut."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, job: Callable, items: Iterable) -> list:
    """``job`` of every item, a few jobs at a time, so that the end of one doesn't leave the cluster idle."""
    items = list(items)
    with ThreadPoolExecutor(max_workers=max(1, min(8, len(items)))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(job), items))
