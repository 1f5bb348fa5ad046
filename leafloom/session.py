"""Session defaults, the shared scratch folder, tables written to it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only by local sessions (tests, benches) in which spark.checkpoint.dir is unset.
LOCAL_SCRATCH = "/tmp/checkpoints/leafloom"
#: What a batch between the JVM and Python may hold, where the session says nothing else: texts are long.
BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def local_session(cores: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("leafloom")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python by bytes, unless the session sets its own bounds."""
    for key, value in BATCH_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


@contextmanager
def asked_broadcasts_only(spark: SparkSession) -> Iterator[None]:
    """While it lasts, plans broadcast what is marked for it (and so has a bound), nothing else, however small the input is."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in names}
    for k in names:
        spark.conf.set(k, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; RuntimeError on a cluster that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master == "local" or master.startswith("local["):
        return LOCAL_SCRATCH
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared folder."""
    return f"{shared_folder(spark)}/leafloom/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts the lineage (a lost executor costs no recomputation of what stands
    before), fixes values that a second evaluation might change, and keeps
    column pruning for the readers.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.leafloom_path = path
    return made


def bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """``materialise``, dealt by key: joins on the key shuffle only the other side.

    df is best partitioned by key already, so that a task writes few buckets.
    """
    spark = df.sparkSession
    path, name = scratch_path(spark, label), f"leafloom_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).option("path", path).saveAsTable(name)
    made = spark.table(name)
    made.leafloom_path, made.leafloom_table = path, name
    return made


def discard(*made: DataFrame | None) -> None:
    """Empty the tables that ``materialise`` and ``bucketed`` returned; what reads them later fails, so nothing that is still to run may.

    Only the public writer is used: an overwrite without rows drops a table's files.
    """
    for df in made:
        path, name = getattr(df, "leafloom_path", None), getattr(df, "leafloom_table", None)
        if name:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path:
            df.sparkSession.range(0, 0, 1, 1).write.mode("overwrite").parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
