"""The filter audit against a count of every order by hand, on documents without an id, repeated ids, parts and labels."""

from itertools import permutations

import pytest
from conftest import SF, rows_of, write
from quarry.llm import audit


def by_hand(documents, labels):
    """documents: (doc_id, text, part); every order applied left to right to the documents themselves."""
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    rows = []
    for i, text, part in documents:
        text = text or ""
        words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in documents)
        tests = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text), copy)
        rows.append((i, part or "", {f for f, x in zip("ABCDE", tests, strict=True) if x}))
    out, total = {}, {}
    for part in {p for _, p, _ in rows}:
        own = [(i, f) for i, p, f in rows if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, x in enumerate(order):
                lost, kept = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                out[part, order, k + 1] = [len(kept), len(lost), sum(x in f for _, f in own) - len(lost), sum(f == {x} for _, f in own), sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost)]
                total[part, x] = total.get((part, x), 0) + len(lost)
                left = kept
    return {key: (*v, total[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def found(spark, folder):
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = audit.op13_audit(spark, folder).collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in rows}
    assert len(out) == len(rows)
    return out


def test_odd(spark, odd):
    want = by_hand(rows_of(odd, "doc_id", "text", "lang"), rows_of(odd, "doc_id", "quality", "toxic", name="labels"))
    assert found(spark, odd) == want and len(want) == 600


@pytest.mark.parametrize("copies", [3, 400])
def test_copies(spark, tmp_path, copies):
    """A third of all rows are one text; null ids and repeated smallest ids aren't copies."""
    prose = " ".join(f"w{k}" for k in range(120))
    documents = [(k // 2, prose, "a") for k in range(copies)] + [(None, prose, "a"), (None, None, "a"), (-1, "AB c", "b"), (5, "AB c", "b"), (5, "AB c", "a")] + [(1000 + k, f"{prose} {k} #", "c") for k in range(copies)]
    folder = write(tmp_path, documents, [(0, 1, 0), (0, 0, 1), (5, 1, 1), (None, 1, 1)], langs=[d[2] for d in documents[:-1]] + [None])
    assert found(spark, folder) == by_hand(rows_of(folder, "doc_id", "text", "lang"), rows_of(folder, "doc_id", "quality", "toxic", name="labels"))


def test_whole_texts(spark):
    want = by_hand(rows_of(SF, "doc_id", "text", "lang"), rows_of(SF, "doc_id", "quality", "toxic", name="labels"))
    assert found(spark, SF) == want and sum(v[1] for v in want.values()) > 0


def test_total_of_all_parts(spark):
    counts = audit.cells(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).cache()
    per = audit.survivors(counts).groupBy("subset").sum("kept").collect()
    assert {(r[0], r[1]) for r in per} == {(r["subset"], r["kept"]) for r in audit.survivors(counts, total=True).collect()}
