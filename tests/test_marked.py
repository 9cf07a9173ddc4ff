"""The partitioned table function: state over a partition, its arguments, odd rows."""

import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from quarry.operators import marked, markers
from quarry.plans import page_queries

PAGES = [("a", 1, "综合题\n填空题\n(1) first of all\n(2) second one"), ("a", 2, "(3) goes on\u0001\u0002 here"), ("a", 3, None), ("a", 4, "拓展题 x (4) y"), ("b", 1, "plain"), ("b", 2, "(1) own state"), (None, 1, "解答题 (9) z"), ("c", 1, "")]


def test_state_goes_over_pages(spark):
    marked.register(spark)
    pages = spark.createDataFrame(PAGES, "chapter string, page int, text string")
    got = spark.sql("SELECT * FROM marked(TABLE({p}) PARTITION BY chapter ORDER BY (page), 'text')", p=pages)
    assert got.columns == ["chapter", "page", "k", "position", "offset", "kind", "marker", "body", "section", "topic"]
    rows = {(r["chapter"], r["page"], r["k"]): r for r in got.collect()}
    assert (rows["a", 2, 1]["section"], rows["a", 2, 1]["topic"], rows["a", 2, 1]["offset"]) == ("综合题", "填空题", len(PAGES[0][2]))
    assert (rows["a", 4, 1]["section"], rows["a", 4, 1]["topic"], rows["a", 4, 1]["offset"]) == ("拓展题", "选择题", len(PAGES[0][2]) + len(PAGES[1][2]))
    assert rows["b", 2, 1]["section"] == "基础题" and rows[None, 1, 1]["topic"] == "解答题" and not [k for k in rows if k[0] == "c"]
    assert rows["a", 2, 1]["body"] == "goes on   here"


def test_pieces_are_those_of_the_windows(spark):
    pages = spark.createDataFrame(PAGES, "chapter string, page int, text string").withColumn("key", F.concat_ws("-", "chapter", "page"))
    want = {(r["key"], r["k"], r["position"], r["kind"], r["marker"], r["body"]) for r in markers.pieces(pages, ("key",)).collect()}
    got = marked.Marked(pages.select("key", "text").asTable().partitionBy("key").orderBy("key"), F.lit("text")).collect()
    assert {(r["key"], r["k"], r["position"], r["kind"], r["marker"], r["body"]) for r in got} == want and want


@pytest.mark.parametrize("call", ["marked(TABLE({p}), 'nothing')", "marked('text', 'text')", "marked(TABLE({q}), 'text')"])
def test_arguments_are_checked(spark, call):
    marked.register(spark)
    p = spark.createDataFrame(PAGES, "chapter string, page int, text string")
    with pytest.raises(Exception, match="(?i)argument|column|table"):
        spark.sql(f"SELECT * FROM {call}", p=p, q=p.withColumn("kind", F.lit(1))).collect()


def test_chapters_over_runs_of_pages(spark):
    """What windows carry from run to run is what the table function carries over a chapter's pages, no chapter in one task."""
    r = random.Random(5)
    pieces = ["\n综合题", "拓展题", "\n填空题", "解答题 ", "\n(1) x", "\n\n \n2) y", "plain ", "\u0001\u0002", "\n03)z"]
    rows = [(r.choice(["a", "b", None]), p, r.choice([None, "".join(r.choices(pieces, k=r.randint(0, 6)))])) for p in range(300)]
    pages = spark.createDataFrame(rows, "chapter string, page int, text string")
    marked.register(spark)
    columns = "chapter, page, k, offset, section, topic"
    want = spark.sql(f"SELECT {columns} FROM marked(TABLE({{p}}) PARTITION BY chapter ORDER BY (page), 'text')", p=pages)
    found = spark.sql("SELECT chapter, page, k, kind, marker FROM marked(TABLE({p}), 'text')", p=pages.repartition(5))
    got = markers.carried(found, pages, "chapter", "page", width=7).select(*columns.split(", "))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and got.count() > 300


@pytest.mark.parametrize("text", ["", "(1) a", "\n\n(01) a\n\n\n2)b", "x\n \n(3)\n\n4) y(5) ", "基础题\n\n(1)\n(2) 解答题", "\n0) \n 00 7)", "7)\n8)\n\n"])
def test_markers_by_first_characters(text):
    assert [m.span() for m in marked._found(text)] == [m.span() for m in re.finditer(markers.MARKER, text, re.ASCII)]


def test_pages_stay_where_they_are(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": [1, 2, 3], "text": ["a", "b", "c"], "source": ["s", "s", "t"]}), f"{tmp_path}/documents.parquet")
    chapters = page_queries.marked_chapters(spark, str(tmp_path))._jdf.queryExecution().toString()
    pieces = page_queries.marked_pieces(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ord" not in pieces and "partition_by" not in chapters
