"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, one machine (master local) uses a temporary folder of its own; a cluster can't."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints"
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, codec: str = "snappy", **options) -> DataFrame:
    """Write df once as Parquet into the shared folder and return it read back; a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/quarry-{name}-{uuid.uuid4().hex}"
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")  # the table replaces the shuffles that made it, so their files go as it is written
    try:
        df.write.option("compression", codec).options(**options).parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._quarry_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete a table that stored() wrote and nothing will read again."""
    path = getattr(df, "_quarry_path", None)
    if path:
        removed(df.sparkSession, path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one, whatever file system it is on."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def working_name(name: str, columns) -> str:
    """A working column's name that no column of the caller's table has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, column: str = "doc_id"):
    """True for the rows that no label or count is learned from: crc32 of the id as text leaves 1. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == 1, F.lit(False))


def label_sample(labels: DataFrame, label: str, rows: int, modulus: int = 3) -> DataFrame:
    """(doc_id, label) of at most ``rows`` labelled documents outside the held-out part, those of the smallest id hash.

    Rows without an id or label are left out; of repeated ids the largest label counts.
    """
    kept = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    kept = kept.where(~held_out(modulus)).groupBy("doc_id").agg(F.max("label").alias("label"))
    return kept.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
