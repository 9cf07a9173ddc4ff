"""Every pipeline stage on its own input: brute force, SQL or the operator's query decides which rows stay."""

import re
from collections import Counter

import corpus_pipeline as pipeline
import pandas as pd
from pyspark.sql import functions as F
from conftest import rows_of
from oracle import differ
from quarry.llm import mixing, pii, quality
from test_rows import base_pii, contaminations, near_components

SF = "/root/testdata/sf0.001"


def as_documents(df, folder):
    folder.mkdir()
    df.toPandas().to_parquet(folder / "documents.parquet")
    for name in ("labels", "benchmark"):
        pd.read_parquet(f"{SF}/{name}.parquet").to_parquet(folder / f"{name}.parquet")
    return str(folder)


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, tmp_path):
    folder, columns = SF, spark.read.parquet(f"{SF}/documents.parquet").columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        out = stage(spark, docs, SF)
        if name == "quality":
            want = Counter(r["doc_id"] for r in quality.op3_quality(spark, SF).where("predicted = 1").collect())
        elif name == "neardup":
            want = Counter({i: n for (i, _, _, kept), n in near_components(folder, 80).items() if kept})
        elif name == "decontamination":
            want = Counter(i for i, *_, bad in contaminations(folder) if not bad)
        else:
            want = ids(docs)
        if name == "mixing":
            mixed = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.round(F.try_element_at("positions", F.lit(1)), 6).alias("position"))
            assert differ(mixed, mixing.OP4_SQL, folder) == ([], [])
            want = Counter(r["doc_id"] for r in mixed.where("taken > 0").collect())
        else:
            assert out.columns == columns
        assert ids(out) == want
        if name == "pii":
            texts = {r["doc_id"]: r["text"] for r in out.collect()}
            for i, text in rows_of(folder, "doc_id", "text"):
                for kind, a, b in base_pii(text):
                    assert text[a:b] not in texts[i] or re.search(r"^[0-9. -]+$", text[a:b]), kind
                if not base_pii(text) and not re.search(r"[0-9]{4}", text or ""):
                    assert texts[i] == text
        folder = as_documents(out, tmp_path / str(k))
    assert ids(pipeline.run(spark, SF)) == ids(spark.read.parquet(f"{folder}/documents.parquet"))


def test_odd_and_empty(spark, odd, empty):
    for folder in (odd, empty):
        out = pipeline.run(spark, folder)
        assert set(spark.read.parquet(f"{folder}/documents.parquet").columns) <= set(out.columns)
        out.collect()


def test_redaction_keeps_the_rest(spark):
    rows = [(1, "mail a@b.org now", 16), (2, None, None), (3, "", 0), (3, "", 0)]
    out = pii.redacted(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "mail [EMAIL] now", 16), (2, None, None), (3, "", 0), (3, "", 0)], key=str)
