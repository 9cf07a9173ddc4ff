"""Tables that cut lineage: written once to the folder that all executors share, so a lost executor costs nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder, which only one machine (master local) can share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints"
    return folder.rstrip("/")


class Run:
    """The tables of one run, in one folder that close() deletes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/quarry-run-{uuid.uuid4().hex}", 0

    def settled(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        self.forget(self.folder)

    def forget(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)

    def keep(self, n: int) -> None:
        """Delete all tables but the last n."""
        for k in range(1, self.n - n + 1):
            self.forget(f"{self.folder}/{k}")
