"""Files beside the banks: page images, sidecar tables, statistics, and banks under other names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: the tables that stand beside a bank
SIDECARS = {
    "boxes": "page int, index int, box array<int>, crop string",
    "results": "page int, index int, crop string, raw string, qnum string, content string, options map<string,string>, error string",
    "blocks": "page int, x0 double, y0 double, x1 double, y1 double, text string",
    "figures": "printed_page int, png_page int, rect struct<x0:double,y0:double,x1:double,y1:double>, xref int",
    "detected": "id string, page int, bbox array<int>, description string, output string, size array<int>",
}


def read_sidecar(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A JSON list of one of the known kinds; records that don't fit its schema have nulls."""
    return spark.read.schema(SIDECARS[kind]).json(path, multiLine=True)


def read_page_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(page, numbers) of a JSON object from page to list; a page may have null."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<int>>").alias("m"))
    return whole.select(F.explode("m").alias("page", "numbers")).select(F.col("page").cast("int").alias("page"), "numbers")


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size) of the files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))


def page_of_image(path: Column) -> Column:
    """The number of a page image named page_<digits>.png, else null."""
    return F.nullif(F.regexp_extract(T.base_name(path), r"^page_(\d+)\.png$", 1), F.lit("")).try_cast("int")


def page_images(files: DataFrame, first: int, last: int) -> DataFrame:
    """(path, page) of the page images inside the closed range."""
    return files.select("path", page_of_image(F.col("path")).alias("page")).where(F.col("page").between(first, last))


def bank_files(files: DataFrame) -> DataFrame:
    """(folder, path) of each folder's bank: questions.json, or the first JSON file by name that says 题目 or questions."""
    name = T.base_name(F.col("path"))
    rank = F.when(name == "questions.json", 0).when(name.endswith(".json") & (name.contains("题目") | F.lower(name).contains("questions")), 1)
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    return files.where(rank.isNotNull()).groupBy(folder.alias("folder")).agg(F.min_by("path", F.struct(rank, name)).alias("path"))


def read_statistics(spark: SparkSession, path: str, fallback: DataFrame) -> DataFrame:
    """Published statistics (name, title, total, chapters); the fallback's rows fill in banks that the file doesn't have."""
    read = spark.read.schema("name string, title string, total long, chapters long").json(path)
    return read.unionByName(fallback.join(read.select("name"), "name", "left_anti").select("name", "title", "total", "chapters"))
