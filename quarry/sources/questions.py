"""Question banks as JSON files, flat or nested, with their order kept as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = (
    "uid:string,id:string,qnum:int,type:string,content:string,options:string,sub_questions:array<string>,page:int,printed_page:int,"
    "chapter:string,section:string,has_image:boolean,image_ref:struct<page:int,cropped:string,note:string,original_page:int>,source:string"
)
NESTED = f"struct<schema_version:string,bank:string,title:string,chapters:array<struct<name:string,questions:array<struct<{QUESTION}>>>>>"


_COLUMNS = "uid id qnum type content options raw_options sub_questions page printed_page chapter section has_image image_ref source".split()


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value, bank, chapters, reason): a row for each file, with the reason why one holds no questions."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    is_list, nested = F.col("value").rlike(r"^\s*\["), F.from_json("value", NESTED)
    one = F.struct(F.lit(None).cast("string").alias("name"), F.from_json("value", f"array<struct<{QUESTION}>>").alias("questions"))
    chapters = F.when(is_list, F.array(one)).otherwise(nested["chapters"])
    parsed = F.try_parse_json("value").isNotNull()
    lost = F.exists("chapters", lambda c: c["questions"].isNull())
    reason = F.when(~parsed, "not JSON").when(F.col("chapters").isNull(), "no questions").when(lost, "questions that don't fit the schema")
    return files.select("path", "value", F.when(~is_list, nested["bank"]).alias("bank"), chapters.alias("chapters")).withColumn("reason", reason)


def _questions(files: DataFrame) -> DataFrame:
    rows = files.select("path", "bank", F.posexplode("chapters").alias("chapter_pos", "c"))
    rows = rows.select("path", "bank", "chapter_pos", F.col("c.name").alias("_name"), F.posexplode("c.questions").alias("question_pos", "q"))
    rows = rows.select("path", "bank", "chapter_pos", "question_pos", "q.*", "_name").withColumns({"chapter": F.coalesce("_name", "chapter"), "raw_options": F.col("options")})
    return rows.withColumn("options", F.from_json("raw_options", "map<string,string>")).select("path", "bank", "chapter_pos", "question_pos", *_COLUMNS)


def read_banks(spark: SparkSession, path: str) -> DataFrame:
    """(path, bank, chapter_pos, question_pos, all question fields); a file is a list of questions or {chapters: [...]}.

    options is a map, or null where the file has a list; raw_options is its JSON in either case. A file without questions
    fails the job. One file is one row at first, so a bank must fit one task.
    """
    files = _files(spark, path)
    failed = F.raise_error(F.concat_ws(" in ", "reason", "path")).cast(files.schema["chapters"].dataType)
    return _questions(files.withColumn("chapters", F.when(F.col("reason").isNotNull(), failed).otherwise(F.col("chapters"))))


def read_banks_apart(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The questions of the good files, and (path, reason, value) of the others."""
    files = _files(spark, path)
    return _questions(files.where("reason is null")), files.where("reason is not null").select("path", "reason", "value")
