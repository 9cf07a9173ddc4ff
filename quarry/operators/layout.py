"""Geometry of boxes on page images, as column expressions; pixels themselves are out of scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamped(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(value, high if isinstance(high, Column) else F.lit(high)))


def scaled(value: Column, scale) -> Column:
    """Points to pixels, cut toward zero."""
    return (value * scale).cast("int")


def plausible(x: Column, y: Column, w: Column, h: Column, height: Column, x_most: int, filled: Column | None = None) -> Column:
    """Whether a box has the size, shape and place of a question's number; ``filled`` is its share of coloured pixels."""
    ok = x.between(20, x_most) & w.between(50, 140) & h.between(30, 80) & (w / h).between(1, 3) & (y >= 40) & (y <= 0.92 * height)
    return ok if filled is None else ok & (filled >= 0.5)


def crop_bottoms(boxes: DataFrame, keys: tuple[str, ...], y: str, h: str, height: Column, above: int = 15, least: int = 200) -> DataFrame:
    """``bottom`` of each box's crop: a little above the next box or the page's end; if that is no area, a fixed height."""
    following = F.coalesce(F.lead(y).over(Window.partitionBy(*keys).orderBy(y)) - above, height)
    return boxes.withColumn("_next", following).withColumn("bottom", F.when(F.col("_next") > F.col(y), F.col("_next")).otherwise(F.least(F.col(y) + F.col(h) + least, height))).drop("_next")


def first_rects(figures: DataFrame, rects: str = "rects") -> DataFrame:
    """Figures with their first rectangle as ``rect``; those without one are left out."""
    return figures.where(F.size(rects) > 0).withColumn("rect", F.element_at(rects, 1)).drop(rects)


def found_boxes(answers: DataFrame) -> DataFrame:
    """Answers (found, bbox) that name a box of four values."""
    return answers.where(F.col("found") & (F.size("bbox") == 4))
