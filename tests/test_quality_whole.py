"""The report queries of every rule, against rules told anew in Python."""

import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from quarry.functions import rules
from quarry.plans import queries

KINDS = ("选择题", "填空题", "计算题")
#: by id: what a text breaks besides its tail
TEXTS = {19: "plain", 63: "plain", 1: r"x $\frac{1}2$", 2: r"$\frac{1}{2}$ ok", 6: "题干\nA. $\\frac{1}2$\nB. 2\nC. 3\nD. 4", 9: "题干\nA. 1\nB. 2", 12: "no options", 22: "求 ____", 25: "no blank"}


def bad_frac(text):
    for segment in re.findall(r"\$([^$]*)\$", text):
        for m in re.finditer(r"\\frac\s*\{", segment):
            depth, i = 1, m.end()
            while i < len(segment) and depth:
                depth += (segment[i] == "{") - (segment[i] == "}")
                i += 1
            if depth or segment[i : i + 1] != "{":
                return True
    return False


def brute(i, text):
    options = dict(re.findall(r"\n([A-D])\. ([^\n]*)", text))
    out = [("malformed_frac", "critical")] * sum(map(bad_frac, [text, *options.values()]))
    kind = KINDS[i % 3]
    if kind == "选择题":
        out += [("missing_options", "critical")] if not options else [("wrong_options", "warning")] if set(options) != set("ABCD") else []
    if kind == "填空题" and not re.search(r"___+|\\_\\_+|（\s*）|\(\s*\)|□", text):
        out.append(("missing_blank", "warning"))
    return out


@pytest.fixture
def folder(tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "TAILS", ("",) * 19 + (r" $\frac{1}2$ ",) + ("",) * 2)
    pq.write_table(pa.table({"doc_id": list(TEXTS), "text": list(TEXTS.values()), "source": ["a"] * len(TEXTS)}), f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_whole_reports(spark, folder):
    want = {i: brute(i, t + (r" $\frac{1}2$ " if i % 22 == 19 else "")) for i, t in TEXTS.items()}
    each = Counter(x for found in want.values() for x in found)
    assert {(r["code"], r["severity"]): r["n_issues"] for r in queries.quality_summary_whole(spark, folder).collect()} == each
    assert {r["ord"]: r["codes"] for r in queries.quality_report_whole(spark, folder).collect()} == {i: ",".join(sorted(c for c, _ in found)) for i, found in want.items() if found}
    severity = lambda s: (sum(x[1] == s for f in want.values() for x in f), sum(any(x[1] == s for x in f) for f in want.values()))
    assert {r["severity"]: (r["n_issues"], r["n_questions"]) for r in queries.issues_by_severity_whole(spark, folder).collect()} == {s: severity(s) for s in rules.SEVERITIES}
    assert each["malformed_frac", "critical"] >= 4


def test_options_type(spark):
    rows = [(1, "计算题", "x", None, '["a", "b"]'), (2, "选择题", "x", None, '["a"]'), (3, "选择题", "x", None, "[]"), (4, "计算题", "x", {"A": "1"}, '{"A": "1"}'), (5, "计算题", "x", None, None)]
    df = spark.createDataFrame(rows, "k int, type string, content string, options map<string,string>, raw string")
    assert sorted((r["k"], r["code"]) for r in rules.issues(df, "k", raw_options="raw").collect()) == [(1, "options_type"), (2, "options_type"), (3, "missing_options")]


def test_questions_are_read_once(spark, folder):
    plan = queries.quality_report_whole(spark, folder)._jdf.queryExecution()
    assert plan.executedPlan().toString().count("FileScan") == 1
    assert plan.optimizedPlan().toString().count("[A-D][.．、]") <= 1 + plan.optimizedPlan().toString().count("([A-D])[.．、]") <= 2
