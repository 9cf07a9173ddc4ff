"""Hand-derived vectors of the text functions, rules, repairs and ordered operators."""

import json

import pytest
from pyspark.sql import functions as F
from quarry.functions import lenient, rules
from quarry.functions import text as T
from quarry.operators import normalize, relate, repair, sequence
from quarry.plans import publish
from quarry.sources.questions import read_banks
from quarry.streaming import ingest

CASES = [
    ("设$x", ["unbalanced_dollars"]), (r"$\frac{1}{2$", ["unbalanced_braces"]), (r"\sin x", ["missing_dollar"]), (r"$\frac{1}2$", ["malformed_frac"]), (r"$\frac {1} {2}$", ["malformed_frac"]),
    (r"$x_{(_{0},_{1})}$", ["malformed_subscript"]), ("$a_{ }$", ["empty_subscript"]), ("$f(xx)$", ["duplicated_var"]), ("$f_{xx}$", []), ("$yy'$", []), ("x≤1", ["unicode_math"]), ("ab", ["pua_chars"]),
    ("$令x$", ["chinese_in_math"]), ("$x，y$", ["chinese_punct_in_math"]), (r"$\text{其中，}x$", []), (r"$\frac{=1}{2}$", ["relation_at_start"]), (r"$\frac{\leq 1}{2}$", []), ("$$a$$", []), ("$a$$b$", []), ("$$a", []),
    (None, []), ("", []), (r"$\frac{\frac{1}{2}}{3}$", []), (r"$\frac{\frac{1}2}{3}$", ["malformed_frac"]),
]


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_rule_vectors(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "k int, t string")
    got = {r["k"]: [c["code"] for c in r["c"]] for r in df.select("k", rules.codes(F.col("t")).alias("c")).collect()}
    assert got == {k: c for k, (_, c) in enumerate(CASES)}


@pytest.mark.parametrize(("kind", "content", "options", "want"), [
    ("选择题", "x", None, ["missing_options"]), ("选择题", "x", {}, ["missing_options"]), ("选择题", "x", {"A": "1", "B": "2"}, ["wrong_options"]), ("选择题", "x", dict.fromkeys("ABCD", "1"), []),
    ("填空题", "求值", None, ["missing_blank"]), ("填空题", "（ ）", None, []), ("填空题", "____", None, []), ("填空题", r"a\quad", None, []), ("填空题", "□", None, []),
])
def test_type_rules(spark, kind, content, options, want):
    df = spark.createDataFrame([(1, kind, content, options)], "k int, type string, content string, options map<string,string>")
    assert [r["code"] for r in rules.issues(df, "k").collect()] == want


@pytest.mark.parametrize(("f", "text", "want"), [
    (T.clean_text, "a\n\n\n\nb  c ", "a\n\nb c"), (T.clean_text, "a\n \n \nb", "a\n\n\nb"), (T.clean_text, None, None), (T.number_at_start, "12a", 12), (T.number_at_start, "例1", None), (T.first_number, "例7", 7), (T.first_number, "x", 0),
    (T.options, "题干\nA. 1\nB. 2\nC. 3\nD. 4", {"A": "1", "B": "2", "C": "3", "D": "4"}), (T.options, "x", None), (T.stem, "题干\nA. 1\nB. 2", "题干"), (T.question_type, "…(A) x", "选择题"), (T.question_type, "证明:x", "证明题"),
    (T.question_type, "求 ____", "填空题"), (T.question_type, "求 x", "计算题"), (T.sub_questions, "a (I) b (II) c", ["b", "c"]), (T.without_think, "<think>a</think> b", "b"), (T.without_fence, "```json\n{}\n```", "{}"),
    (T.trimmed_tail, "正文 · 第3页，共9页 ·", "正文"), (T.trimmed_tail, "正文 综合题", "正文"), (T.trimmed_tail, "正文拓展题 一、x", "正文"), (T.zero_padded, "7", "007"), (T.zero_padded, "1234", "1234"),
    (repair.blank_suffix, r"$S=$\_\_\_$。", r"$S=\_\_\_$。"), (repair.blank_suffix, r"为\_\_\_\_$。", r"为$\_\_\_\_$。"), (repair.blank_suffix, "。", "。"), (repair.subscripts, r"x_{(_{0},_{1})}", "x_{(0,1)}"),
    (normalize.portable_path, "temp\\660_crops_v2\\p.png", "../../temp/660_crops_v2/p.png"),
])
def test_text_vectors(spark, f, text, want):
    assert one(spark, text, f) == want


def test_lenient_json(spark):
    read = lambda t: one(spark, t, lambda c: lenient.parsed(c, "c string"))
    assert read('{"c":"a"}')["c"] == "a"
    assert read(r'{"c":"\alpha"}')["c"] == r"\alpha"
    assert read('said: {"c":"a",} end')["c"] == "a"
    assert read("nothing") is None


def test_sequences(spark):
    assert one(spark, [10, 50, 69, 75, 130, 150], sequence.cluster_starts, "array<int>") == [10, 75, 150]
    assert [b["y"] for b in one(spark, [(100, 40), (200, 40), (300, 40)], sequence.thinned, "array<struct<y:int,h:int>>")] == [100, 300]
    gaps = lambda rows: {r["page"]: r["numbers"] for r in sequence.filled_gaps(spark.createDataFrame(rows, "page int, numbers array<int>")).collect()}
    assert gaps([(16, [1, 2, 3]), (17, None), (18, [7, 8])])[17] == [4, 5, 6]
    lost = gaps([(16, [1, 2]), (17, None), (18, None), (19, [8])])
    assert (lost[17], lost[18]) == ([3, 4], [5, 6])
    starts = sequence.running_start(spark.createDataFrame([(4, 2), (5, 3)], "page int, n int"), "page", "n", 461)
    assert {r["page"]: r["start"] for r in starts.collect()} == {4: 461, 5: 463}
    y = sequence.regions(spark.createDataFrame([(1, 100), (1, 300)], "p int, y int"), ("p",), "y", F.lit(800)).orderBy("y").collect()
    assert [(r["top"], r["bottom"]) for r in y] == [(90, 296), (290, 800)]
    rows = spark.createDataFrame([(k, k % 2) for k in range(10)] + [(11, None)], "ord long, key int")
    numbers = {r["ord"]: r["number"] for r in sequence.numbered(rows, "ord", ("key",), width=3).collect()}
    assert numbers == {k: k // 2 + 1 for k in range(10)} | {11: 1}


def test_relations(spark):
    figures = spark.createDataFrame([(8,), (12,), (13,)], "at int")
    q = spark.createDataFrame([(1, 10), (2, 30)], "q int, page int")
    assert {r["q"]: r["nearest"] for r in relate.nearest(q, figures, "q", "page", "at").collect()} == {1: 8, 2: None}
    ranges = spark.createDataFrame([(0, "a", 2, 13), (1, "b", 14, 33)], "ord int, name string, start int, end int")
    for rows in ([(2,), (13,), (34,)], [(2,), (2,), (13,), (34,), (34,)]):
        found = relate.range_lookup(spark.createDataFrame(rows, "p int"), ranges, "p", "c", "none")
        assert {r["p"]: r["c"] for r in found.collect()} == {2: "a", 13: "a", 34: "none"}
    left = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "k int, y int")
    right = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)], "k int, n int")
    paired, skipped = relate.zip_guarded(left, right, "k", "y", "n")
    assert sorted((r["y"], r["n"]) for r in paired.collect()) == [(5, 1), (6, 2)]
    assert {r["k"]: r["reason"] for r in skipped.collect()} == {2: "counts differ", 3: "no markers"}


def test_banks(spark, tmp_path):
    flat = [{"id": 3, "qnum": None, "chapter": "C", "content": "x", "page": 3, "options": {"A": 1}}]
    nested = {"bank": "880", "chapters": [{"name": "D", "questions": [{"id": "1", "content": "y"}, {"id": "2", "content": "z"}]}]}
    (tmp_path / "a.json").write_text(json.dumps(flat))
    (tmp_path / "b.json").write_text(json.dumps(nested))
    rows = read_banks(spark, str(tmp_path)).withColumn("bank", F.coalesce("bank", F.lit("1000")))
    got = normalize.questions(rows).orderBy("uid").collect()
    assert [r["uid"] for r in got] == ["1000-C-3", "880-D-1", "880-D-2"]
    assert got[0]["options"] == {"A": "1"} and got[0]["qnum"] == 3 and got[0]["has_image"] is False
    banks = publish.nested(normalize.questions(rows), ["uid", "content"]).orderBy("bank").collect()
    assert [json.loads(r["questions"])[0]["uid"] for r in banks] == ["1000-C-3", "880-D-1"]
    stats = {r["bank"]: (r["questions"], r["chapters"]) for r in publish.statistics(normalize.questions(rows)).collect()}
    assert stats == {"1000": (1, 1), "880": (2, 1), None: (3, 2)}


def test_resume(spark, tmp_path):
    def client(crop):
        if crop == "bad":
            raise ValueError("no")
        return crop.upper()

    work, done = tmp_path / "work", str(tmp_path / "done")
    work.mkdir()
    (work / "1.json").write_text('{"page":1,"index":1,"crop":"a"}\n{"page":1,"index":2,"crop":"bad"}\n')
    run = lambda: ingest.resume(spark, str(work), "page int, index int, crop string", done, str(tmp_path / "c"), client).awaitTermination()
    run()
    (work / "2.json").write_text('{"page":1,"index":1,"crop":"again"}\n{"page":1,"index":2,"crop":"good"}\n')
    run()
    got = sorted((r["index"], r["raw"], r["error"]) for r in spark.read.parquet(done).collect() if r["raw"])
    assert got == [(1, "A", None), (2, "GOOD", None)]


def test_displays_are_cut_once(spark):
    """However many displays a text has, it is cut at its double dollars once."""
    shown = spark.createDataFrame([("a$$b。$$c " * 3,)], "t string").select(repair.full_stops_outside(F.col("t")).alias("t"))
    assert shown.first()["t"] == "a$$b$$。c " * 3
    assert shown._jdf.queryExecution().analyzed().toString().count(r"\Q$$\E") == 1
