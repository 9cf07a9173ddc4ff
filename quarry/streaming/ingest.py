"""Incremental extraction: new work arrives as files, finished keys are skipped, failures are captured as rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def called(client: Callable[[str], str], crop: str, retries: int, wait: float, timeout: float) -> tuple[str | None, str | None]:
    """(answer, error): a call that fails or takes over ``timeout`` seconds is tried again after ``wait``, twice that and so on."""
    error = None
    for attempt in range(retries + 1):
        if attempt:
            time.sleep(wait * 2 ** (attempt - 1))
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(client, crop).result(timeout), None
        except TimeoutError:
            error = f"no answer in {timeout} s"
        except Exception as e:  # noqa: BLE001  a failed call is data here
            error = str(e)
        finally:
            pool.shutdown(wait=False)
    return None, error


def extract(work: DataFrame, client: Callable[[str], str], retries: int = 2, wait: float = 1.0, timeout: float = 120.0) -> DataFrame:
    """(page, index, raw, error) for each row of work (page, index, crop); the client is called in parallel by partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [called(client, crop, retries, wait, timeout) for crop in batch["crop"]]
            raw, error = [a for a, _ in answers], [e for _, e in answers]
            yield pd.DataFrame({"page": batch["page"], "index": batch["index"], "raw": raw, "error": error})

    return work.select("page", "index", "crop").mapInPandas(run, "page int, index int, raw string, error string")


def resume(spark: SparkSession, work: str, schema: str, done: str, checkpoint: str, client: Callable[[str], str], **options):
    """A stream over new work files; each batch leaves out keys that already succeeded and appends its results."""

    def batch(rows: DataFrame, _: int) -> None:
        try:
            finished = spark.read.schema("page int, index int, raw string, error string").parquet(done).where("error is null")
        except Exception as e:  # noqa: BLE001  only a missing folder is expected, on the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            finished = None
        todo = rows if finished is None else rows.join(finished.select("page", "index").distinct(), ["page", "index"], "left_anti")
        extract(todo.dropDuplicates(["page", "index"]), client, **options).write.mode("append").parquet(done)

    source = spark.readStream.schema(schema).json(work)
    return source.withColumn("page", F.col("page").cast("int")).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
