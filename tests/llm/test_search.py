"""The search by all words of a query document."""

import numpy as np
import pytest
from conftest import SF
from quarry.llm import search


def test_repeated_query_ids_in_any_partition(spark):
    """A query's own rows are never found, wherever they stand; the others are the same for any number of shards."""
    rows = [(50, "alpha beta gamma delta"), (50, "epsilon zeta eta theta"), *((k, "alpha zeta " + " ".join(f"w{k + j}" for j in range(5))) for k in range(1, 45)), (100, "w3 w4 w5 beta"), (100, "theta w9")]
    got = []
    for n_parts in (1, 3, 8, 24):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n_parts)
        terms, n, mean = search.collection(docs)
        queries = search.more_like(docs.where("doc_id % 50 = 0"), terms).cache()
        got.append(sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in search.top_k(docs, queries, n, mean).collect()))
    assert got[0] == got[1] == got[2] == got[3]
    assert got[0] and all(q != d for q, _, d, _ in got[0])


def test_common_words_count(spark):
    """Eight rare words shared with one page don't outweigh hundreds of others shared with a second one."""
    rare, common = [f"rare{k}" for k in range(8)], [f"common{k}" for k in range(300)]
    rows = [(50, " ".join(rare + common)), (1, " ".join(rare)), (2, " ".join(common)), (3, " ".join(common)), (4, "nothing shared")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms, n, mean = search.collection(docs)
    queries = search.more_like(docs.where("doc_id = 50"), terms).cache()
    assert queries.count() == 308
    found = {r["rank"]: r["doc_id"] for r in search.top_k(docs, queries, n, mean).collect()}
    assert found == {1: 2, 2: 3, 3: 1}


def test_blocks_of_terms(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    terms, n, mean = search.collection(docs)
    queries = search.more_like(docs.where("doc_id % 50 = 0"), terms).cache()
    one, many = (sorted(map(tuple, search.top_k(docs, queries, n, mean, block_terms=k).collect())) for k in (2_000_000, 200))
    assert one == many and one


def all_added_up(lists, n, k, skip, floor=-1.0):
    score = np.zeros(n)
    for docs, impacts in lists:
        score[docs] += impacts
    score[skip.start : skip.stop] = 0.0
    found = [d for d in range(n) if score[d] > max(floor, 0.0)]
    return sorted(((round(score[d], 9), d) for d in found), key=lambda x: (-x[0], x[1]))[:k]


def of_lists(lists, n):
    term = np.repeat(np.arange(len(lists)), [len(d) for d, _ in lists])
    return search.Index(term, np.concatenate([d for d, _ in lists]), np.concatenate([i for _, i in lists]), len(lists), n)


@pytest.mark.parametrize("n_terms", [1, 3, 20, 300])
@pytest.mark.parametrize("n", [1, 5, 10, 11, 64, 65, 3000])
def test_best_is_all_added_up(n_terms, n):
    """Short and long queries, ties, skipped documents and floors."""
    rng = np.random.default_rng(n_terms * n)
    lists = [(d := np.flatnonzero(rng.random(n) < rng.choice([0.02, 0.3, 0.9])), rng.integers(1, 50, len(d)) / 8) for _ in range(n_terms)]
    lists = [x for x in lists if len(x[0])]
    if not lists:
        return
    index = of_lists(lists, n)
    for skip in (range(0), range(2, 4), range(n)):
        for floor in (-1.0, 7.0, 1e9):
            got = search.best(index, np.arange(len(lists)), 10, skip, floor)
            assert [(round(s, 9), d) for s, d in got] == all_added_up(lists, n, 10, skip, floor)
            common = index.common([np.arange(len(lists))])[0]
            assert [(round(s, 9), d) for s, d in search.best(index, np.arange(len(lists)), 10, skip, floor, common)] == all_added_up(lists, n, 10, skip, floor)


def test_long_queries_skip_postings():
    """Common words with small impacts have the longest postings; most of their blocks are never read."""
    rng = np.random.default_rng(1)
    n = 20_000
    rare = [(d := np.sort(rng.choice(n, 40, replace=False)), np.full(len(d), 9.0)) for _ in range(60)]
    rare += [(np.arange(500, 512), np.full(12, 9.0))] * 60
    common = [(d := np.flatnonzero(rng.random(n) < 0.8), rng.random(len(d)) * 0.2) for _ in range(200)]
    index = of_lists(rare + common, n)
    got = search.best(index, np.arange(len(rare + common)), 10)
    assert [(round(s, 9), d) for s, d in got] == all_added_up(rare + common, n, 10, range(0))
    assert index.skipped > 0.95 * sum(len(d) for d, _ in common)


def test_a_shard_takes_few_bytes_a_posting():
    """Of one shard's postings, with a query that has no terms: the index itself is what is measured."""
    import tracemalloc

    import pyarrow as pa
    from quarry.llm import _text

    r = np.random.default_rng(7)
    words = [f"w{k}" for k in range(20_000)]
    texts = [" ".join(words[k] for k in r.integers(0, len(words), 250)) for _ in range(4000)]
    terms = np.sort(_text.hash_words(words))
    sent = type("Sent", (), {"value": (terms, np.ones(len(terms)), np.array([1]), np.array([0, 0]), np.zeros(0, np.int32), np.full(1, -1.0))})
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 500)), pa.array(texts[k : k + 500])], ["doc_id", "text"]) for k in range(0, len(texts), 500)]
    tracemalloc.start()
    for _ in search._search(sent, 250.0, 10)(iter(batches)):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 95 * sum(len(set(t.split())) for t in texts)


def test_blocks_of_queries_read_the_texts_once(spark):
    """However many blocks the queries come in, texts are cut into words once and sampled once."""
    read = []
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 97} v{(k + j) % 11}" for j in range(1, 30))) for k in range(600)], "doc_id long, text string").repartition(12).localCheckpoint()
    terms, n, mean = search.collection(docs)
    queries = search.more_like(docs.where("doc_id % 50 = 0"), terms).localCheckpoint()
    got = []
    for block_terms in (2_000_000, 40):
        passed = spark.sparkContext.accumulator(0)

        def counted(batches, passed=passed):
            for batch in batches:
                passed.add(len(batch))
                yield batch

        found = search.top_k(docs.mapInArrow(counted, "doc_id long, text string"), queries, n, mean, block_terms=block_terms)
        got.append(sorted(map(tuple, found.collect())))
        read.append(passed.value)
    assert got[0] == got[1] and len(got[0]) == 120
    assert read[0] == read[1] <= 2 * 600


def asked_of(queries):
    """A pass's queries, from lists of words."""
    from quarry.llm import _text

    words = sorted({w for q in queries.values() for w in q})
    terms = np.sort(_text.hash_words(words))
    at = [np.searchsorted(terms, _text.hash_words(sorted(set(q)))).astype(np.int32) for q in queries.values()]
    block = np.array(list(queries)), np.array([len(x) for x in at]), np.concatenate([np.sort(x) for x in at]), terms, np.full(len(terms), 3.0)
    return search._asked([block], 100)


@pytest.mark.parametrize("sizes", [{}, {"GROUP": 7, "TILE": 5, "READY": 16, "WAITING": 20, "SHORT": 1, "COMMON": 3}, {"DENSE": 0, "SHORT": 10_000, "MERGED": 40, "ROOM": 5.0}])
def test_documents_meet_queries(monkeypatch, sizes):
    """Sums over runs of merged documents, by the matrix or by lists, find what adding up all words finds; with floors and without."""
    import pyarrow as pa

    for name, value in sizes.items():
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(3)
    share = 1 / np.arange(1, 401)
    draw = lambda m: [f"w{x}" for x in rng.choice(400, m, p=share / share.sum())]
    texts = [draw(int(rng.choice([0, 1, 8, 40, 300]))) for _ in range(150)]
    texts[60:66] = [texts[59]] * 6  # ties
    queries = {k: texts[k] for k in range(0, 150, 3) if texts[k]} | {1000: draw(200), 1001: ["w399"]}
    asked = asked_of(queries)
    batch = pa.RecordBatch.from_arrays([pa.array(range(150)), pa.array(range(150)), pa.array([" ".join(t) for t in texts])], ["doc_id", "pick", "text"])
    mean, expected = np.mean([len(t) for t in texts]), {}
    for q, own in queries.items():
        scores = []
        for d, t in enumerate(texts):
            tf = {w: t.count(w) for w in set(t) & set(own)}
            s = sum(asked.idf[0] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t) / mean)) for f in tf.values())
            if s and d != q:
                scores.append((-round(s, 9), d))
        expected[q] = sorted(scores)[:10]
    none = np.full(len(asked.qids), -1.0)
    known = np.array([search._floor(-expected[q][9][0]) if len(expected[q]) == 10 else -1.0 for q in asked.qids.tolist()])
    for floors in (none, known):
        sent, told = (type("Sent", (), {"value": x}) for x in (asked, floors))
        rows = [r for b in search._meet(sent, told, mean, 10)(search._words([batch])) for r in b.to_pylist()]
        for q in queries:
            assert sorted((-round(r["score"], 9), r["doc_id"]) for r in rows if r["qid"] == q)[:10] == expected[q]


def test_weak_documents_are_merged():
    """Documents that stay far below the floors are scored in runs, whose sums bound those of their documents."""
    rng = np.random.default_rng(5)
    n, m, n_terms = 300, 400, 500
    asked = [np.sort(rng.choice(n_terms, 60, replace=False)).astype(np.int32) for _ in range(n)]
    first = np.arange(0, 60 * n + 1, 60)
    group = search.Group(first, np.concatenate(asked), n_terms)
    doc, term = np.repeat(np.arange(m), 20), np.concatenate([np.sort(rng.choice(n_terms, 20, replace=False)) for _ in range(m)])
    impact = rng.random(len(doc)) + 0.5
    alone = group.sums(doc, term, impact, m)
    usual = np.full(n_terms, 60 / n_terms / (4 * alone.mean()), np.float32)  # floors are four usual scores
    order, begin, run = group.merged(doc, term, impact, m, usual)
    assert sorted(order.tolist()) == list(range(m)) and len(begin) - 1 <= m / 2
    bound = group.sums(*run, len(begin) - 1)
    for r, (a, b) in enumerate(zip(begin[:-1], begin[1:], strict=True)):
        assert (alone[order[a:b]] <= bound[r] + 1e-3).all()
