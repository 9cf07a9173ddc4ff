"""Normalisation of question records to one schema with stable keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def uid(bank: Column, qnum: Column, id_: Column, chapter: Column, page: Column) -> Column:
    """Stable key by bank. Banks that number inside chapters carry the chapter, so keys don't collide."""
    return (
        F.when(bank == "660", F.concat_ws("-", bank, qnum.cast("string")))
        .when(bank == "大学深埋", F.concat_ws("-", bank, chapter, id_, F.concat(F.lit("p"), page.cast("string"))))
        .otherwise(F.concat_ws("-", bank, chapter, id_))
    )


def image_ref(ref: Column, bank: Column) -> Column:
    """Null or (page, cropped, note, original_page); paths of one bank are lifted by one folder."""
    path = F.when((bank == "大学深埋") & ref["cropped"].startswith("cropped_images/"), F.concat(F.lit("../"), ref["cropped"])).otherwise(ref["cropped"])
    return F.when(ref.isNotNull(), F.struct(ref["page"].alias("page"), path.alias("cropped"), ref["note"].alias("note"), ref["original_page"].alias("original_page")))


def portable_path(path: Column) -> Column:
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(slashed.startswith("temp/"), F.concat(F.lit("../../"), slashed)).otherwise(slashed)


def full_options(options: Column) -> Column:
    """Exactly A to D, trimmed, missing ones empty; null if all are blank."""
    values = F.transform(F.array(*map(F.lit, "ABCD")), lambda k: F.coalesce(T.strip(F.try_element_at(options, k)), F.lit("")))
    return F.when(F.exists(values, lambda v: v != ""), F.map_from_arrays(F.array(*map(F.lit, "ABCD")), values))


def questions(raw: DataFrame) -> DataFrame:
    """The 14 fields of schema v1.0 beside the ordinals; empty collections become null, missing flags false."""
    empty = lambda c: F.when(F.size(c) > 0, F.col(c))
    number = F.coalesce("qnum", T.number_at_start(F.col("id")))
    return raw.select(
        "chapter_pos", "question_pos", uid(F.col("bank"), number, F.col("id"), F.col("chapter"), F.col("page")).alias("uid"), "bank", "id", number.alias("qnum"), "type", "content",
        empty("options").alias("options"), empty("sub_questions").alias("sub_questions"), "page", "printed_page", F.coalesce("chapter", F.lit("未分类")).alias("chapter"), "section",
        F.coalesce("has_image", F.lit(False)).alias("has_image"), image_ref(F.col("image_ref"), F.col("bank")).alias("image_ref"), "source",
    )
