"""Small tables that hold the hard cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

CLASHING = ("score", "key", "label", "size", "taken", "target", "words", "places", "spans", "n_words", "text_", "_first", "_tie", "_id", "_h", "h", "component", "_gone_key", "_own_key", "_pii_key", "_pii_more", "quality_score", "_kept", "_size", "_source", "positions")


def write(folder, documents, labels=(), benchmark=(), langs=None):
    """documents: (doc_id, text, source); labels: (doc_id, quality, toxic); benchmark: (item_id, text); langs: of the documents, else null."""
    ids, texts, sources = zip(*documents, strict=True) if documents else ((), (), ())
    columns = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs or [None] * len(ids), pa.string()), "source": pa.array(sources, pa.string()), "n_chars": pa.nulls(len(ids), pa.int64())}
    columns |= {c: pa.array(["x"] * len(ids), pa.string()) for c in CLASHING}
    pq.write_table(pa.table(columns), f"{folder}/documents.parquet")
    a, b, c = zip(*labels, strict=True) if labels else ((), (), ())
    pq.write_table(pa.table({"doc_id": pa.array(a, pa.int64()), "quality": pa.array(b, pa.int32()), "toxic": pa.array(c, pa.int32())}), f"{folder}/labels.parquet")
    a, b = zip(*benchmark, strict=True) if benchmark else ((), ())
    pq.write_table(pa.table({"item_id": pa.array(a, pa.int64()), "text": pa.array(b, pa.string())}), f"{folder}/benchmark.parquet")
    others(folder, [], [])
    return str(folder)


def others(folder, embeddings, pages):
    """embeddings: (vec_id, vector); pages: (page_id, url, html)."""
    a, b = zip(*embeddings, strict=True) if embeddings else ((), ())
    clashing = {c: pa.array(["x"] * len(a), pa.string()) for c in ("x", "n", "w", "k", "up", "part", "deviation")}
    pq.write_table(pa.table({"vec_id": pa.array(a, pa.int64()), "embedding": pa.array(b, pa.list_(pa.float32())), "label": pa.nulls(len(a), pa.int32()), **clashing}), f"{folder}/embeddings.parquet")
    a, b, c = zip(*pages, strict=True) if pages else ((), (), ())
    clashing = {x: pa.array(["x"] * len(a), pa.string()) for x in ("digest", "first", "salt", "url_key", "captured", "run", "range", "position", "refers_to", "n_bytes")}
    pq.write_table(pa.table({"page_id": pa.array(a, pa.int64()), "url": pa.array(b, pa.string()), "html": pa.array(c, pa.string()), **clashing}), f"{folder}/pages.parquet")


def odd_tables():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared, item, near = prose(80), prose(30), prose(120).split()
    changed = [*near[:60], "other", *near[61:]]
    far = [*near[:20], *prose(40).split(), *near[60:]]
    documents = [
        (1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, "one two", "b"), (5, "One Two", "b"), (6, "one two three four five", "b"),
        (7, f"{prose(20)} {shared} {prose(5)}", "a"), (8, f"{prose(9)} {shared}\n{prose(50)}", "a"), (9, shared, None), (10, shared, None), (10, shared, None),
        (11, " ".join(near), "c"), (12, " ".join(changed), "c"), (13, " ".join(far), "c"), (None, " ".join(near), "c"), (None, None, None),
        (14, f"{prose(10)} {item} {prose(30)}", "a"), (15, f"{item.upper()}!", "d"), (16, f"{' '.join(item.split()[:13])} {prose(300)}", "d"),
        (17, "Write to a.b+c@mail.example.org, call +49 (30) 1234-5678 or see 10.0.255.1 and 300.1.1.1.", "e"),
        (18, "Card 4111 1111 1111 1111 and 4111 1111 1111 1112; @x.y a@b a@b.c. +12 +123456789", "e"),
        (19, "Released under the MIT License. The mit-license and the GNU General  Public License, Apache license", "e"),
        (20, "été ÀÉ naïve K \U0001f600 x y żółć", "é"), (21, "a" * 500, "z"), (22, "ab" * 300, "z"), (23, prose(30_000), "a"), (24, "x" * 8_000, "a"),
        (25, f"{shared} {shared}", "b"), (26, "mit license " * 40, "b"),
    ]
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"
    documents += [(110, f"Copyright (c) 2020 {prose(3)}\n\n{mit} of it {prose(20)}", "z"), (111, f"{mit[200:]} {prose(9)} permission is hereby granted free of charge", "z"), (112, " ".join([mit] * 30), "z"), (113, "wor\u212a mit licen\u017fe MIT LICENSE", "z")]
    documents += [(114, f"{prose(4)} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {prose(4)}", "z")]
    # rows that share an id but not their text, and the near copies of each
    one, two, three = prose(60), prose(70), prose(50)
    near_one, near_two = (f"{x} more" for x in (one, two))
    documents += [(100, one, "a"), (100, two, "b"), (101, near_one, "a"), (102, near_two, "a"), (103, three, "a"), (103, one, "c"), (104, three, "b"), (104, three, "b"), (105, "", "b"), (105, near_two, "b")]
    documents += [(30 + k, prose(r.randint(0, 90)), r.choice("ab")) for k in range(60)]
    labels = [(30 + k, k % 2, int(k % 5 == 0)) for k in range(60)] + [(30, 1, 1), (None, 1, 1), (31, None, None), (999, 1, 0)]
    benchmark = [(1, item), (2, "one two"), (3, None), (4, ""), (None, item), (5, prose(40)), (5, "five four"), (10, item)]
    return documents, labels, benchmark


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    write(folder, *odd_tables())
    others(folder, [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, None), (None, [0.25, -2.0]), (3, [float("nan"), 1.0]), (4, [3.0])], odd_pages())
    return str(folder)


def odd_pages():
    body = "<p>" + "same words again " * 10
    urls = ["https://www.Example.COM/a?b=1#c", "http://example.com/a?b=1", "http://example.com", "ftp://x.y.z:21/p q\tr\n", "", None, "no scheme/at all", "HTTP://ÄÖ.example.com/ü", "http://www2.b.org?x#y#z", "://odd", "a" * 5000]
    rows = [(k, urls[k % len(urls)], f"{k}" if k % 3 else body) for k in range(40)]
    rows += [(None, urls[0], body), (None, None, None), (7, None, ""), (7, "http://example.com/a?b=1", body), (0, urls[0], body), (-5, urls[1], "short"), (90, urls[0], "x" * 300_000), (91, urls[0], "a\r\n\r\nWARC/1.1\r\n" * 20), (92, urls[0], "a\r\n\r\nWARC/1.1\r\n" * 20), (93, urls[0], "é" * 50), (94, urls[1], "é" * 50), (95, urls[1], "é" * 49), (96, urls[1], "é" * 49)]
    return rows


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), [])


SF = "/root/testdata/sf0.001"


def rows_of(folder, *columns, name="documents"):
    """Tuples of these columns; ids stay integers and nulls None."""
    return [tuple(r.values()) for r in pq.read_table(f"{folder}/{name}.parquet", columns=list(columns)).to_pylist()]
