"""Readers, writers and retries: what no query over the driver's tables reaches."""

import json

from pyspark.sql import functions as F
from quarry.functions import lenient, rules
from quarry.operators import rebuild, repair, sequence
from quarry.plans import publish
from quarry.sources import files, questions
from quarry.streaming import ingest


def test_banks_are_read_and_bad_files_kept_apart(spark, tmp_path):
    flat = [{"id": "1", "content": "x", "options": {"A": "a"}}, {"id": "2", "content": "y", "options": ["a", "b"]}]
    (tmp_path / "a.json").write_text(json.dumps(flat))
    (tmp_path / "b.json").write_text(json.dumps({"bank": "660", "chapters": [{"name": "c", "questions": [{"id": "3", "content": "z"}]}]}))
    (tmp_path / "c.json").write_text('[{"id": "4", ')
    (tmp_path / "d.json").write_text('{"other": 1}')
    good, bad = questions.read_banks_apart(spark, str(tmp_path))
    rows = {r["id"]: r for r in good.collect()}
    assert set(rows) == {"1", "2", "3"} and rows["3"]["bank"] == "660" and rows["3"]["chapter"] == "c"
    assert rows["1"]["options"] == {"A": "a"} and rows["2"]["options"] is None and json.loads(rows["2"]["raw_options"]) == ["a", "b"]
    found = rules.issues(good.withColumn("type", F.lit("选择题")), "id", raw_options="raw_options")
    assert {(r["id"], r["code"]) for r in found.collect()} == {("1", "wrong_options"), ("2", "options_type"), ("3", "missing_options")}
    assert sorted(r["reason"] for r in bad.collect()) == ["no questions", "not JSON"]


def test_files_beside_banks(spark, tmp_path):
    for name in ("page_007.png", "page_12.png", "page_x.png", "cover.png"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "boxes.json").write_text(json.dumps([{"page": 1, "index": 2, "box": [1, 2, 3, 4], "crop": "p"}]))
    (tmp_path / "numbers.json").write_text(json.dumps({"3": [1, 2], "4": None}))
    assert [r["page"] for r in files.page_images(files.listing(spark, str(tmp_path), "*.png"), 1, 10).collect()] == [7]
    assert files.read_sidecar(spark, f"{tmp_path}/boxes.json", "boxes").collect()[0]["box"] == [1, 2, 3, 4]
    assert {r["page"]: r["numbers"] for r in files.read_page_numbers(spark, f"{tmp_path}/numbers.json").collect()} == {3: [1, 2], 4: None}


def test_versions_and_statistics(spark, tmp_path):
    rows = spark.createDataFrame([("660", "t", 3, 1)], "name string, title string, total long, chapters long")
    one, two = (publish.write_version(rows, f"{tmp_path}/stats", v) for v in (1, 2))
    assert spark.read.json(one).count() == spark.read.json(two).count() == 1
    fallback = spark.createDataFrame([("660", "x", 9, 9), ("880", "y", 4, 2)], rows.schema)
    assert {r["name"]: r["total"] for r in files.read_statistics(spark, two, fallback).collect()} == {"660": 3, "880": 4}
    publish.write_text(rows, "name", f"{tmp_path}/names")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/names").collect()] == ["660"]


def test_calls_are_tried_again(tmp_path):
    import time

    seen = []

    def failing(crop):
        seen.append(time.monotonic())
        if len(seen) < 3:
            raise ValueError("busy")
        return f"ok {crop}"

    assert ingest.called(failing, "a", 2, 0.05, 5) == ("ok a", None)
    assert seen[1] - seen[0] >= 0.05 and seen[2] - seen[1] >= 0.1
    assert ingest.called(lambda c: time.sleep(0.5), "a", 1, 0.01, 0.05) == (None, "no answer in 0.05 s")


def test_escapes_and_stops(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(lenient.letters_escaped(F.lit(r'\x "\frac \n é \\a \" \b" \y'))) == r'\x "\\frac \\n é \\\a \" \\b" \y'
    for text, want in (("$$a。$$", "$$a$$。"), (r"\[a。]", r"\[a]。"), ("$$a$$b。$$", "$$a$$b$$。"), ("$$a$b。$$", "$$a$b。$$"), (r"$$\begin{a}x。\end{a}。$$", r"$$\begin{a}x\end{a}。$$。"), (r"$$\begin{a}x。\end{a}$$", r"$$\begin{a}x\end{a}$$。"), (r"\[a[1]b。] c", r"\[a[1]b]。 c"), ("$$。$$", "$$。$$"), ("$$a。", "$$a。"), (r"\begin{a}x。\end{a", r"\begin{a}x。\end{a"), ("$$a。$$b。$$", "$$a$$。b$$。"), ("", ""), ("x=（ ）$。", r"x=(\quad)$。")):
        assert one(repair.full_stops_outside(F.lit(text))) == want, text


def test_boxes_of_any_index(spark):
    """The box of index 5000 on page 1 comes before page 2; pages and indices have no bound."""
    boxes = [(1, 1), (2, 1), (1, 5000), (10**7, 3), (10**7, 2**40), (-3, 7), (4096, 1), (8191, 1)]
    rows = spark.createDataFrame(boxes, "page long, index long")
    assert {(r["page"], r["index"]): r["n"] for r in sequence.numbered_within(rows, "page", "index", "n").collect()} == {b: k + 1 for k, b in enumerate(sorted(boxes))}
    joined = rows.select("page", "index", F.lit("t").alias("crop"), F.lit("1").alias("qnum"), F.lit("x").alias("content"), F.lit(None).cast("string").alias("error"))
    assert [(r["page"], r["index"]) for r in rebuild.bank(joined).orderBy("id").collect()] == sorted(boxes)
