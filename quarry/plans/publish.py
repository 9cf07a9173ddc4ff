"""Publishing: nested banks and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(questions: DataFrame, fields: list[str]) -> DataFrame:
    """(bank, chapter, question_count, questions as JSON in order): one row per chapter, counts recomputed."""
    own = F.struct("question_pos", F.struct(*fields).alias("q"))
    rows = questions.groupBy("bank", "chapter").agg(F.min("question_pos").alias("first"), F.count("*").alias("question_count"), F.array_sort(F.collect_list(own), lambda a, b: (a["question_pos"] - b["question_pos"]).cast("int")).alias("o"))
    return rows.select("bank", "chapter", "first", "question_count", F.to_json(F.transform("o", lambda x: x["q"])).alias("questions"))


def nested_parts(questions: DataFrame, fields: list[str], most: int = 10_000) -> DataFrame:
    """The same in parts of at most ``most`` questions of a chapter, numbered from 1: (bank, chapter, part, question_count, questions).

    A chapter of any length is published by many tasks; its parts joined in order are the chapter.
    """
    from ..operators import sequence

    placed = sequence.numbered(questions, "question_pos", ("bank", "chapter"), "_place").withColumn("part", F.ceil(F.col("_place") / most).cast("int"))
    own = F.struct("_place", F.struct(*fields).alias("q"))
    rows = placed.groupBy("bank", "chapter", "part").agg(F.count("*").alias("question_count"), F.array_sort(F.collect_list(own), lambda a, b: (a["_place"] - b["_place"]).cast("int")).alias("o"))
    return rows.select("bank", "chapter", "part", "question_count", F.to_json(F.transform("o", lambda x: x["q"])).alias("questions"))


def in_fixed_order(questions: DataFrame, chapters: DataFrame) -> DataFrame:
    """(ord, chapter, question_count) of the chapters (ord, chapter) that have questions; questions of other chapters go."""
    counts = questions.groupBy("chapter").agg(F.count("*").alias("question_count"))
    return chapters.select("ord", "chapter").join(counts, "chapter").select("ord", "chapter", "question_count")


def stamped_links(html: Column, stamp: Column) -> Column:
    """Links to the published data carry its stamp, so that caches take the new one."""
    return F.regexp_replace(html, F.lit(r"data\.js\?[^\"']*"), F.concat(F.lit("data.js?v="), stamp))


def statistics(questions: DataFrame) -> DataFrame:
    """Questions and chapters of each bank, and a grand total (bank null)."""
    per = questions.groupBy("bank", "chapter").agg(F.count("*").alias("n"))
    return per.rollup("bank").agg(F.sum("n").alias("questions"), F.count("*").alias("chapters"))


def write_json(rows: DataFrame, path: str) -> None:
    """Through the file committer, so readers see whole output or none; earlier versions stay under their own path."""
    rows.write.mode("errorifexists").json(path)


def write_text(rows: DataFrame, column: str, path: str) -> None:
    """One string column as lines of text, whole or not at all."""
    rows.select(column).write.mode("errorifexists").text(path)


def write_version(rows: DataFrame, path: str, version: int) -> str:
    """A new version beside the earlier ones, which stay; returns its folder."""
    folder = f"{path}/v={version}"
    write_json(rows, folder)
    return folder
