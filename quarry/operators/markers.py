"""Marked pages: text is cut at its section, topic and question markers, and each piece knows the section it stands in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import sequence

#: fixed values: headings of sections and topics, and those a page starts in
SECTIONS = ("基础题", "综合题", "拓展题")
TOPICS = ("选择题", "填空题", "解答题")
OPEN_SECTION = "拓展题"
MARKER = "(" + "|".join(SECTIONS + TOPICS) + r"|(?:^|\n)\s*\(?\s*0*[1-9]\d*\)\s*)"


def offsets(pages: DataFrame, keys: tuple[str, ...], page: str = "page", text: str = "text") -> DataFrame:
    """The characters before each page of its document, as ``offset``; a null text has none."""
    return sequence.running_start(pages.withColumn("_n", F.length(F.coalesce(text, F.lit("")))), page, "_n", 0, keys, "offset").drop("_n")


def pieces(pages: DataFrame, keys: tuple[str, ...], text: str = "text") -> DataFrame:
    """(keys, k, position, kind, marker, body, n_chars): a row per marker, its body ends at the next marker or the page's end.

    keys name one page. kind is section, topic or question. U+0001 and U+0002 count as spaces.
    """
    marked = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\u0001\u0002", "  "), MARKER, "\u0001$1\u0002")
    rows = pages.select(*keys, F.length(F.coalesce(text, F.lit(""))).alias("n_chars"), F.posexplode(F.split(marked, "\u0001")).alias("k", "_piece"))
    before = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.translate("_piece", "\u0002", ""))
    rows = rows.withColumn("position", F.coalesce(F.sum(size).over(before), F.lit(0)))
    marker = F.substring_index("_piece", "\u0002", 1)
    kind = F.when(marker.isin(*SECTIONS), "section").when(marker.isin(*TOPICS), "topic").otherwise("question")
    return rows.where("k > 0").select(*keys, "k", "position", kind.alias("kind"), marker.alias("marker"), F.substring_index("_piece", "\u0002", -1).alias("body"), "n_chars")


def carried(found: DataFrame, pages: DataFrame, chapter: str, page: str, text: str = "text", width: int = 1 << 12) -> DataFrame:
    """found (chapter, page, k, kind, marker, ...) with offset, section and topic that go on from page to page of a chapter.

    ``width`` page numbers of a chapter are one window's work; what they hand on, a row each, is another's, so no chapter
    is one task's. pages holds every page once.
    """
    run, upto = F.floor(F.col(page) / width), Window.partitionBy(chapter).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    section = F.when(F.col("kind") == "section", F.col("marker"))
    topic = F.when(F.col("kind") == "section", TOPICS[0]).when(F.col("kind") == "topic", F.col("marker"))
    rows = found.withColumns({"_run": run, "_section": section, "_topic": topic, "_order": F.struct(page, "k")})
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c)
    ends = rows.groupBy(F.col(chapter).alias("_c"), F.col("_run").alias("_r")).agg(known("_section"), known("_topic"))
    sizes = pages.select(chapter, page, run.alias("_run"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("_n"))
    runs = sizes.groupBy(chapter, "_run").agg(F.sum("_n").alias("_n"))
    runs = runs.join(ends, F.col(chapter).eqNullSafe(F.col("_c")) & F.col("_run").eqNullSafe(F.col("_r")), "left")
    last = lambda c: F.last(c, ignorenulls=True).over(upto)
    before = runs.select(F.col(chapter).alias("_c"), F.col("_run").alias("_r"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_chars"), last("_section").alias("_old_section"), last("_topic").alias("_old_topic"))
    own = sequence.running_start(sizes, page, "_n", 0, (chapter, "_run"), "_own").select(F.col(chapter).alias("_cc"), F.col(page).alias("_p"), "_own")
    for value in ("_section", "_topic"):
        inside = Window.partitionBy(chapter, "_run").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(value, F.last(value, ignorenulls=True).over(inside))
    rows = rows.join(own, F.col(chapter).eqNullSafe(F.col("_cc")) & (F.col(page) == F.col("_p")))
    rows = rows.join(before, F.col(chapter).eqNullSafe(F.col("_c")) & F.col("_run").eqNullSafe(F.col("_r")))
    told = {"offset": F.col("_own") + F.col("_chars"), "section": F.coalesce("_section", "_old_section", F.lit(SECTIONS[0])), "topic": F.coalesce("_topic", "_old_topic", F.lit(TOPICS[0]))}
    return rows.select(*(c for c in found.columns if c not in told), *(v.alias(c) for c, v in told.items()))


def questions(pages: DataFrame, keys: tuple[str, ...], text: str = "text", page: str | None = None) -> DataFrame:
    """(keys, position, section, topic, number, content): numbered questions, and those without number in an open section.

    keys name one page, or with ``page`` a chapter whose pages follow one another by that column: section and topic then
    carry on from page to page. A question ends with its page.

    A numbered question needs five characters and more than a heading. Without number, text under a topic heading counts
    if the page goes on for over 20 characters, no numbered question follows within 100, and over 10 characters come
    before the next marker.
    """
    chapter = keys
    keys = (*keys, page) if page else keys
    rows = pieces(pages, keys, text)
    order = F.struct(page, "k") if page else F.col("k")
    section = F.when(F.col("kind") == "section", F.col("marker"))
    topic = F.when(F.col("kind") == "section", TOPICS[0]).when(F.col("kind") == "topic", F.col("marker"))
    rows = rows.withColumns({"_section": section, "_topic": topic, "_order": order})
    rows = sequence.filled_forward(rows, "_section", "_order", chapter, SECTIONS[0], "section")
    rows = sequence.filled_forward(rows, "_topic", "_order", chapter, TOPICS[0], "topic")
    after = Window.partitionBy(*keys).orderBy("k").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("_next", F.min(F.when(F.col("kind") == "question", F.col("position"))).over(after))
    line = F.greatest(F.instr("body", "\n") - 1, F.lit(0))
    end = F.col("position") + F.length("marker") + line
    content = T.strip(F.when(F.col("kind") == "question", F.col("body")).otherwise(F.substring("body", line + 1, F.length("body"))))
    rows = rows.withColumns({"content": content, "_end": end})
    numbered = (F.col("kind") == "question") & (F.length("content") >= 5)
    free = (F.col("kind") == "topic") & (F.col("section") == OPEN_SECTION) & (F.col("n_chars") - F.col("_end") > 20) & (F.length("content") > 10)
    free = free & (F.col("_next").isNull() | (F.col("_next") - F.col("_end") > 100))
    number = F.when(F.col("kind") == "question", T.first_number(F.col("marker")))
    return rows.where((numbered | free) & ~T.is_heading(F.col("content"))).select(*keys, "position", "section", "topic", number.alias("number"), "content")
