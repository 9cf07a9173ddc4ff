"""From detected boxes and extraction results to numbered bank questions, each step a join, filter or projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import normalize, sequence


def truthy(value: Column) -> Column:
    """The string, or null where it says nothing: null, empty, 0 or false."""
    return F.when(~value.isin("", "0", "false", "null", "0.0"), value)


def response_fields(row: Column) -> dict[str, Column]:
    """The question fields of a parsed response row (all strings, sub_questions an array of JSON texts) with their defaults."""
    said = lambda s: F.coalesce(truthy(F.get_json_object(s, "$.content")), truthy(F.get_json_object(s, "$.text")), s)
    subs = F.transform(row["sub_questions"], lambda s: F.when(s.startswith("{"), said(s)).otherwise(s))
    return {
        "qnum": F.coalesce(truthy(row["qnum"]), truthy(row["num"]), F.lit("0")), "type": F.coalesce(truthy(row["type"]), F.lit("计算题")), "content": F.coalesce(row["content"], F.lit("")),
        "section": F.coalesce(truthy(row["section"]), F.lit("基础题")), "sub_questions": F.when(F.size(subs) > 0, subs), "has_image": F.coalesce(row["has_image"], F.lit(False)),
    }


RESPONSE = "qnum string, num string, type string, content string, section string, sub_questions array<string>, has_image boolean"


def succeeded(results: DataFrame) -> DataFrame:
    """Results without an error and with content."""
    return results.where(F.col("error").isNull() & (F.coalesce("content", F.lit("")) != ""))


def numbered_only(results: DataFrame) -> DataFrame:
    """Results whose number reads as an integer, as an int column."""
    number = F.col("qnum").try_cast("int")
    return results.where(number.isNotNull()).withColumn("qnum", number)


def with_index_as_number(results: DataFrame) -> DataFrame:
    """The first pass's number: where none was read, the box's place on its page."""
    return results.withColumn("qnum", F.coalesce(F.col("qnum").try_cast("int"), F.col("index")))


def assigned(boxes: DataFrame, results: DataFrame, numbers: DataFrame) -> DataFrame:
    """Each box (page, index, crop) with its result and the number at its place in the page's list (page, numbers); null without."""
    lists = numbers.select("page", "numbers")
    joined = boxes.join(results.drop("qnum", "crop"), ["page", "index"], "left").join(lists, "page", "left")
    return joined.withColumn("qnum", F.when(F.col("index").between(1, F.size("numbers")), F.try_element_at("numbers", F.col("index")))).drop("numbers")


def bank(joined: DataFrame, offset: int = 15) -> DataFrame:
    """Questions of the boxes that have a number and a result, numbered 1.. by page and place."""
    good = numbered_only(succeeded(joined))
    crop = normalize.portable_path(F.col("crop"))
    rows = good.select("page", "index", "qnum", "content", (F.col("page") - offset).alias("printed_page"), F.nullif(crop, F.lit("")).alias("cropped"), (F.coalesce("crop", F.lit("")) != "").alias("has_image"))
    return sequence.numbered_within(rows, "page", "index", name="id")


def outcomes(joined: DataFrame) -> DataFrame:
    """One row of counters, in one pass: boxes with a number, without one, failed, and those that become questions."""
    number, ok = F.col("qnum").isNotNull(), F.col("error").isNull() & (F.coalesce("content", F.lit("")) != "")
    return joined.agg(F.count_if(number).alias("assigned"), F.count_if(~number).alias("missing"), F.count_if(~ok).alias("failed"), F.count_if(number & ok).alias("kept"))


def guarded(rows: DataFrame, page: str, path: str, files: DataFrame) -> DataFrame:
    """Rows with ``reason``: why one can't be worked on (no page, no image, or a file that isn't listed), else null."""
    listed = files.select(F.col("path").alias("_listed")).distinct()
    out = rows.join(listed, F.col(path) == F.col("_listed"), "left")
    reason = F.when(F.col(page).isNull(), "no page").when(F.coalesce(path, F.lit("")) == "", "no image").when(F.col("_listed").isNull(), "no file")
    return out.withColumn("reason", reason).drop("_listed")


def first_of(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The first rows for display, each with the number of those that aren't shown."""
    total = rows.agg(F.count("*").alias("_n"))
    return rows.orderBy(order).limit(most).join(F.broadcast(total)).withColumn("more", F.greatest(F.col("_n") - most, F.lit(0))).drop("_n")


def in_page_order(rows: DataFrame, page: str, id_: str, order: str) -> DataFrame:
    """Rows with ``place``: by the number in the id inside each page, equal numbers as they came."""
    from pyspark.sql import Window

    return rows.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy(T.first_number(F.col(id_)), order)))


def output_names(page: Column, id_: Column) -> dict[str, Column]:
    """File names of crops and images."""
    page, id_ = page.cast("string"), id_.cast("string")
    return {"crop_name": F.concat(F.lit("p"), page, F.lit("_q"), id_, F.lit(".png")), "image_path": F.concat(F.lit("images/"), id_, F.lit(".png")), "crop_path": F.concat(F.lit("crops/p"), page, F.lit("_"), id_, F.lit(".jpg"))}


def arrows_as_commands(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("⇒"), F.lit("\\Rightarrow")), F.lit("⇔"), F.lit("\\Leftrightarrow"))


def patched(rows: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Hand patches (key, field, values): a string field takes the first value, an array field all of them; the last patch of a field by ``ord`` counts."""
    last = patches.groupBy(key, "field").agg(F.max_by("values", "ord").alias("values"))
    fields = [f.name for f in rows.schema.fields if f.name != key and f.dataType.typeName() in ("string", "array")]
    side = last.groupBy(F.col(key).alias("_key")).agg(*(F.max(F.when(F.col("field") == c, F.col("values"))).alias(f"_{c}") for c in fields))
    out = rows.join(side, F.col(key) == F.col("_key"), "left")
    for f in rows.schema.fields:
        if f.name in fields:
            new = F.col(f"_{f.name}") if f.dataType.typeName() == "array" else F.element_at(f"_{f.name}", 1)
            out = out.withColumn(f.name, F.coalesce(new, f.name))
    return out.select(*rows.columns)
