"""Hand-derived vectors of markers, boxes, paths and publishing."""

import pytest
from pyspark.sql import functions as F
from quarry.functions import text as T
from quarry.operators import layout, markers, relate, repair
from quarry.plans import publish


@pytest.mark.parametrize(("f", "text", "want"), [
    (T.is_heading, "一、选择题", True), (T.is_heading, "选择题" + "x" * 30, False), (T.mentions_image, "如图", True), (T.mentions_image, "无", False),
    (T.marker_number, "\n(7) x", 7), (T.marker_number, "7) x", None), (T.base_name, "a/b.png", "b.png"), (T.file_stem, "a/b.c.png", "b.c"), (T.file_stem, "a/.x", ".x"),
    (T.html_escaped, "<a&b>", "&lt;a&amp;b&gt;"), (T.js_escaped, 'a\\"\r\n', 'a\\\\\\"\\n'), (T.embedded_json, 'so ```json\n{"a":1}\n``` end', '{"a":1}'), (T.embedded_json, 'so {"bbox":[1]} end', '{"bbox":[1]}'), (T.embedded_json, "x", "x"),
    (repair.full_stops_outside, "$$x。$$", "$$x$$。"), (repair.full_stops_outside, "$a=（ ）$。", r"$a=(\quad)$。"), (T.html_escaped, None, None),
])
def test_text(spark, f, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first()["y"] == want


def test_markers(spark):
    long = "设函数连续且可导，求它在零点的导数并证明它单调不减"
    pages = spark.createDataFrame([(1, f"基础题\n选择题\n(1) 设 x 大于零\n2) 短\n拓展题\n解答题\n{long}"), (2, None), (3, "无标记"), (4, f"拓展题\n解答题\n{long}\n(3) 已知 y 小于一")], "p int, text string")
    pieces = [(r["position"], r["kind"]) for r in markers.pieces(pages, ("p",)).where("p = 1").orderBy("k").collect()]
    assert pieces == [(0, "section"), (4, "topic"), (7, "question"), (19, "question"), (25, "section"), (29, "topic")]
    got = sorted((r["p"], r["section"], r["topic"], r["number"], r["content"]) for r in markers.questions(pages, ("p",)).fillna(0).collect())
    # a numbered question follows within 100 characters on page 4, so the free text before it doesn't count
    assert got == [(1, "基础题", "选择题", 1, "设 x 大于零"), (1, "拓展题", "解答题", 0, long), (4, "拓展题", "解答题", 3, "已知 y 小于一")]
    assert markers.questions(pages.limit(0), ("p",)).count() == 0
    offsets = markers.offsets(pages.withColumn("d", F.lit(1)), ("d",), "p")
    assert {r["p"]: r["offset"] for r in offsets.where("p > 1").collect()}.keys() == {2, 3, 4}


def test_boxes(spark):
    b = spark.createDataFrame([(1, 100, 40), (1, 110, 40), (1, 400, 40)], "p int, y int, h int")
    got = {r["y"]: r["bottom"] for r in layout.crop_bottoms(b, ("p",), "y", "h", F.lit(800)).collect()}
    assert got == {100: 340, 110: 385, 400: 800}
    row = spark.range(1).select(layout.clamped(F.lit(-3), 0, 10).alias("a"), layout.clamped(F.lit(30), 0, F.lit(10)).alias("b"), layout.scaled(F.lit(-1.9), 1).alias("c")).first()
    assert tuple(row) == (0, 10, -1)
    figures = spark.createDataFrame([(1, [3, 4]), (2, []), (3, None)], "f int, rects array<int>")
    assert [tuple(r) for r in layout.first_rects(figures).collect()] == [(1, 3)]
    answers = spark.createDataFrame([(1, True, [1, 2, 3, 4]), (2, True, [1]), (3, False, [1, 2, 3, 4]), (4, None, None)], "k int, found boolean, bbox array<int>")
    assert [r["k"] for r in layout.found_boxes(answers).collect()] == [1]


def test_lookups(spark):
    rows = spark.createDataFrame([(1, 1), (1, 3), (2, 1)], "page int, i int")
    lists = spark.createDataFrame([(1, [7, 8])], "page int, v array<int>")
    got = {(r["page"], r["i"]): r["n"] for r in relate.positioned(rows, lists, "page", "i", "v", "n").collect()}
    assert got == {(1, 1): 7, (1, 3): None, (2, 1): None}
    wanted = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", "b"]), (3, ["x"])], "k int, paths array<string>")
    listing = spark.createDataFrame([("a",), ("b",), ("b",)], "path string")
    assert {r["k"]: r["path"] for r in relate.first_existing(wanted, listing, "k", "paths").collect()} == {1: "a", 2: "b", 3: None}
    q = spark.createDataFrame([(1, 5, "A", "o"), (2, 5, "A", "o"), (3, 5, None, "o"), (4, 6, "A", "o")], "ord int, page int, chapter string, ref string")
    patch = spark.createDataFrame([(5, "new")], "page int, ref string")
    assert {r["ord"]: r["ref"] for r in relate.updated_first(q, patch, ["page"], "chapter", "ord", "ref").collect()} == {1: "new", 2: "o", 3: "new", 4: "o"}


def test_publishing(spark):
    q = spark.createDataFrame([("a",), ("a",), ("z",)], "chapter string")
    chapters = spark.createDataFrame([(0, "a"), (1, "b")], "ord int, chapter string")
    assert [tuple(r) for r in publish.in_fixed_order(q, chapters).collect()] == [(0, "a", 2)]
    html = spark.createDataFrame([('<script src="data.js?v=1"></script>',)], "h string").select(publish.stamped_links(F.col("h"), F.lit("ab")).alias("h")).first()["h"]
    assert html == '<script src="data.js?v=ab"></script>'
