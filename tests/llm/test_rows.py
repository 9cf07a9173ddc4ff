"""Row-wise brute force: licences, decontamination, PII, suffixes, near-duplicates and the language model's base."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF, rows_of
from pyspark.sql import functions as F
from quarry.llm import _deal, _text, decontamination, language_model, license, neardup, pii, seating, suffixes
from quarry.llm._store import held_out

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD, TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")


def words(text, pattern=WORD):
    return pattern.findall((text or "").translate(FOLD))


def some(folder):
    return rows_of(folder, "doc_id", "text")


def counted(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(params=["odd", "plain"])
def folder(request, odd):
    return odd if request.param == "odd" else SF


def test_license(spark, folder):
    want = Counter()
    for i, text in some(folder):
        w = words(text)
        found = [(k, label) for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")) for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p]
        at = [k for k, _ in found]
        want[i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))] += 1
    assert counted(license.op2_license(spark, folder), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want


def test_license_bodies_without_names(spark, odd):
    labels = {r["doc_id"]: r["labels"] for r in license.op2_license(spark, odd).where("doc_id between 110 and 114").collect()}
    assert labels == {110: "mit", 111: "", 112: "mit", 113: "mit", 114: "bsd"}


def contaminations(folder):
    items = defaultdict(set)
    for i, text in rows_of(folder, "item_id", "text", name="benchmark"):
        w = words(text)
        if i is not None and w:
            n = min(13, len(w))
            items[str(i)] |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    owners = defaultdict(set)
    for i, own in items.items():
        for x in own:
            owners[x].add(i)
    lengths = sorted({len(x) for x in owners})
    for i, text in some(folder):
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in owners:
                    hit.update(range(k, k + n))
                    found |= owners[x]
        yield i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark, folder):
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert counted(decontamination.op5_decontamination(spark, folder), *columns) == Counter(contaminations(folder))


def test_decontamination_blocks_and_proximity(spark, folder):
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    exact = lambda df: Counter((r["doc_id"], *sorted(map(tuple, r["spans"]))) for r in df.collect())
    whole = decontamination.matches(docs, bench, slop=2)
    assert exact(decontamination.matches(docs, bench, block_words=60)) == exact(whole)
    assert all({(s["item_id"], s["start"]) for s in r["spans"]} <= {(s["item_id"], s["start"]) for s in r["near"]} for r in whole.collect())


def base_pii(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(("email", "ip", "card", "phone")[k], a, b) for a, k, b in sorted(out)]


def test_pii(spark, folder):
    want = Counter()
    for i, text in some(folder):
        own = base_pii(text)
        n = Counter(k for k, _, _ in own)
        want[i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in own).encode()).hexdigest()] += 1
    found = pii.op8_pii(spark, folder)
    assert counted(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    base = {i: base_pii(text) for i, text in some(folder)}
    for r in found.where("doc_id is not null").collect():
        assert {f"{k}:{a}:{b}" for k, a, b in base[r["doc_id"]]} <= set(r["spans"].split(","))


def test_pii_discovers(spark):
    """Identifiers that no base pattern knows, in contexts that base ones have."""
    rows = [(k, f"Please send the form to user{k}@mail.example.org before noon today") for k in range(40)]
    rows += [(100 + k, f"Please send the form to agent/{7000 + k}/desk before noon today") for k in range(5)] + [(200 + k, f"In {1900 + k} the harvest of 18{k:02d}44 sacks was good") for k in range(20)]
    found = {r["doc_id"]: r for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all([m["kind"] for m in found[100 + k]["more"]] == ["email"] for k in range(5))
    assert not any(found[200 + k]["more"] for k in range(20))


def test_suffixes(spark, folder):
    texts = [(i, (t or "").encode()) for i, t in some(folder)]
    hashes = Counter(hash(b[k : k + 200]) for _, b in texts for k in range(len(b) - 199))
    want = Counter()
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if hashes[hash(b[k : k + 200])] > 1:
                gone[k : k + 200] = b"\1" * 200
        runs = len(re.findall(b"\1+", bytes(gone)))
        want[i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert counted(suffixes.op6_suffixes(spark, folder), *columns) == want


def test_suffixes_hot_anchors(spark, folder):
    """Anchors beyond ``most`` surroundings take the counting way: the same runs."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    runs = lambda df: Counter((r["doc_id"], r["kept_sha256"]) for r in df.select("doc_id", "kept_sha256").collect())
    assert runs(suffixes.without_repeats(docs, most=1)) == runs(suffixes.without_repeats(docs))


def near_components(folder, percent=85):
    sets = []
    for i, text in some(folder):
        w = words(text, TOKEN)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    at = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        for x in s if i is not None else ():
            at[x].append(k)
    for k, (i, s) in enumerate(sets):
        shared = Counter(j for x in s for j in at[x] if j < k) if i is not None else {}
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((root(i), root(sets[j][0])))
                parent[b] = a
    return Counter((i, len(s), c := root(i), i is None or i == c) for i, s in sets)


def test_neardup(spark, folder):
    assert counted(neardup.op9_neardup(spark, folder), "doc_id", "n_shingles", "component_id", "kept") == near_components(folder)


def test_neardup_split_buckets(spark, odd):
    """Buckets beyond the chunk are compared part against part: the same components."""
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    assert counted(neardup.classes(docs, 80, chunk=2)[0], "doc_id", "n_shingles", "component_id", "kept") == near_components(odd, 80)


def test_language_model(spark, folder):
    rows = [(i, [*words(t, TOKEN), None]) for i, t in some(folder)]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(x for i, t in rows if not out(i) for x in t)
    total, types = sum(counts.values()), len(counts)
    want = Counter((i, out(i), len(t), sum(counts[x] > 0 for x in t), total, round(sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (types + 1))) for x in t), 4)) for i, t in rows)
    found = language_model.op10_language_model(spark, folder).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found) == want
    assert all(r["score"] < 0 for r in found)
    if folder == SF:  # the model must foretell held-out texts better than the base
        held = [r for r in found if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def key_of(context, word):
    """The model's key of a pair of words; None is a text's start or end."""
    own = lambda w, none: none if w is None else language_model.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0]
    return int(language_model.pair_keys(np.array([own(context, language_model.START)], np.uint64), np.array([own(word, language_model.END)], np.uint64))[0])


def scores_of(model):
    """log10 p(w | u) and the training tokens of w, by pair key."""
    out = {}
    told = {r["bucket"]: r for r in model.scores.where(F.col("kind") == language_model.SCORES).collect()}
    for r in model.pairs.collect():
        keys = language_model.pair_keys(*(np.frombuffer(r[c], np.uint64) for c in "ab"))
        scores, n = np.frombuffer(told[r["bucket"]]["a"], np.float32), np.frombuffer(told[r["bucket"]]["b"], np.int64)
        out |= {int(k): (float(s), int(c)) for k, s, c in zip(keys, scores, n, strict=True)}
    return out


@pytest.mark.parametrize("rows", [1_000_000, 60])
def test_language_model_sums_to_one(spark, rows):
    """Held-out texts ask every word and an unknown one of some contexts: the averaged probabilities of each context sum to one."""
    r = random.Random(4)
    learned = [" ".join(r.choice("abcdefghijkl") + r.choice(["", "x"]) for _ in range(r.randint(0, 60))) for _ in range(60)]
    vocabulary = sorted({w for t in learned for w in t.split()})
    asked = [*vocabulary[:5], "never"]
    held = [f"{u} {w}" for u in asked for w in [*vocabulary, "unseen"]] + asked + [*vocabulary, "unseen", ""]
    docs = spark.createDataFrame([(i, t, i < len(learned)) for i, t in enumerate(learned + held)], "doc_id long, text string, learn boolean")
    found, model = language_model.scored(docs, F.col("learn"), rows=rows, frequent=30)
    assert (model.dealing.buckets > 1) == (rows == 60) and (len(model.dealing.context) > 0) == (rows == 60)
    told = scores_of(model)
    for u in [*asked, None]:
        assert abs(sum(10 ** told[key_of(u, w)][0] for w in [*vocabulary, "unseen", None]) - 1) < 1e-5
    for row in found.collect():  # a text's score is the sum over its pairs, sent to all tasks or not
        text = [None, *(learned + held)[row["doc_id"]].split(), None]
        assert abs(row["score"] - sum(told[key_of(u, w)][0] for u, w in zip(text, text[1:], strict=False))) < 1e-4


def test_language_model_averages_predictions(spark):
    """With given seats by brute force: pairs seen once have one table, so each sample's probability follows from the parent's alone."""
    p, q = 0.2, 0.3
    one, two = (language_model.predicted(3, t, o, 5, x, 0.5, 1.0) for t, o, x in ((1, 2, p), (2, 4, q)))
    assert abs((one + two) / 2 - ((3 - 0.5 + (1 + 1.0) * p) / 6 + (3 - 1 + (1 + 2.0) * q) / 6) / 2) < 1e-12
    docs = spark.createDataFrame([(0, "a b c d"), (1, "e f g")], "doc_id long, text string")
    _, model = language_model.scored(docs, F.lit(True))
    told = scores_of(model)
    # discount 0.95 (no pair is seen twice); end: two customers, each of one table; others one; parent's tables of the end are 1 or 2
    d, mean = 0.95, []
    assert model.discount == d
    a = lambda t, c, k, whole: (c - 0.5 * t + (1 + 0.5 * whole) / 9) / (1 + k)
    mean = {t: a(1, 1, 9, 7 + t) for t in (1, 2)}
    got = 10 ** told[key_of("a", "b")][0]
    low, high = sorted((1 - d + (1 + d) * mean[t]) / 2 for t in (1, 2))
    assert min(abs(got - x) for x in (low, high, (low + high) / 2)) < 1e-6


@pytest.mark.parametrize(("customers", "others", "base", "discount"), [(65, 50, 0.01, 0.7), (500, 300, 0.02, 0.8), (600, 5000, 0.3, 0.5), (2000, 300, 0.02, 0.8)])
def test_tables_follow_the_exact_law(customers, others, base, discount):
    """Mean tables against the law enumerated with the recursion's Stirling numbers, small and large dishes."""
    t = np.arange(1, customers + 1)
    law = seating.log_stirling(discount, customers)[customers, 1:] + t * np.log(base) + np.log(1 + discount * (others + t - 1)).cumsum()
    law = np.exp(law - law.max())
    law /= law.sum()
    mean, n = (law * t).sum(), 2000
    error = np.sqrt(((law * t * t).sum() - mean**2) / n)
    rng, tables = np.random.default_rng(8), np.ones(n, np.int64)
    for _ in range(3):
        tables = seating.draw(np.full(n, customers), tables, np.full(n, others), np.full(n, base), discount, 1.0, rng)
    assert abs(tables.mean() - mean) < 3 * error


def test_stirling_numbers_of_large_dishes():
    for discount in (0.3, 0.5, 0.8):
        exact, t = seating.log_stirling(discount, 900)[900, 1:], np.arange(1, 901)
        found = seating.log_stirling_at(np.full(900, 900), t, discount)
        assert abs((exact - found) - (exact - found)[0]).max() < 0.5  # of values that span hundreds


def test_deduplicated_keeps_one_text_of_each_group(spark, odd):
    """By brute force over rows: groups of texts whatever their ids, one row of each, all texts without words."""
    rows = some(odd)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in (words(t, TOKEN) for _, t in rows)]
    group = list(range(len(rows)))
    for k in range(len(rows)):
        for j in range(k):
            if sets[k] and 100 * len(sets[k] & sets[j]) >= 80 * len(sets[k] | sets[j]) and group[k] != group[j]:
                group = [group[j] if g == group[k] else g for g in group]
    kept = spark.read.parquet(f"{odd}/documents.parquet")
    kept = Counter((r["doc_id"], r["text"]) for r in neardup.deduplicated(kept, 80).collect())
    want = Counter(rows[k] for k in range(len(rows)) if not sets[k])
    for g in {g for k, g in enumerate(group) if sets[k]}:
        own = {rows[k] for k in range(len(rows)) if group[k] == g}
        staying = [x for x in own if x in kept]
        least = min(own, key=lambda x: (x[0] is None, x[0] or 0))[0]
        assert len(staying) == 1 and staying[0][0] == least
        want[staying[0]] += 1
    assert kept == want


def test_language_model_however_dealt(spark):
    """The same scores for any number of shuffle partitions and input splits: seats are drawn from seeds of their own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("4", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found, _ = language_model.scored(docs.repartition(int(n)), ~held_out(5), blocks=2, frequent=200, rows=9000)
            got.append({r["doc_id"]: r["score"] for r in found.collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0].keys() == got[1].keys() and max(abs(got[0][k] - got[1][k]) for k in got[0]) < 1e-6


def test_language_model_sweeps_deal_few_bytes(spark, monkeypatch):
    """After the pairs are counted, four sweeps and their answers deal a few bytes of a pair, not its words and counts each time."""
    dealt, met = [], language_model._deal.met

    def weighed(df, buckets):
        dealt.append(df.agg(F.sum(sum(F.coalesce(F.length(c), F.lit(0)) for c in "abcd"))).first()[0] or 0)
        return met(df, buckets)

    monkeypatch.setattr(language_model._deal, "met", weighed)
    model = language_model.fit(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), ~held_out(5), rows=20_000)
    pairs = model.pairs.agg(F.sum(F.length("a"))).first()[0] // 8
    words, counted_pairs, *sweeps = dealt
    assert model.dealing.buckets > 1 and counted_pairs >= 24 * pairs and sum(sweeps) < 160 * pairs


def test_hashes_are_sorted_and_found_as_numpy_does():
    r = np.random.default_rng(3)
    for values in (r.integers(0, 1 << 64, 5000, np.uint64), r.integers(0, 40, 5000).astype(np.uint64), r.integers(0, 1 << 64, 300, np.uint64)[r.integers(0, 300, 5000)], np.zeros(1, np.uint64), np.zeros(0, np.uint64)):
        assert (_text.order_of(values) == np.argsort(values, kind="stable")).all()
        found, at = _text.uniques(values)
        want, where = np.unique(values, return_inverse=True)
        assert (found == want).all() and (at == where).all()
        asked = np.concatenate([values, values + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
        assert (_text.Places(found).of(asked) == _text.lookup(found, asked)).all()


def test_small_counts_come_back():
    parts = [np.array(x, np.int64) for x in ([], [0, 1, 254, 255, 256, 1 << 40], [3], [255] * 9)]
    held = [(0, _deal.row(0, 0, _deal.small(v)).column("a")[0].as_buffer()) for v in parts]
    assert _deal.counts(held, 1).tolist() == np.concatenate(parts).tolist()


def test_word_codes_tell_words_apart():
    """Words of every length, wherever they stand: equal but for case, equal codes; else different ones."""
    r = random.Random(6)
    distinct = list(dict.fromkeys(["a", "a\0", "\0", "\0\0", "é", "É", *("x" * k for k in range(1, 80)), *("".join(r.choice("abc") for _ in range(r.randint(1, 90))) for _ in range(400)), "x" * 5000]))
    for words_ in (distinct, [w.upper() if w.isascii() else w for w in reversed(distinct)]):
        data = " ".join(words_).encode()
        hashes, first = language_model.tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        told = dict(zip([w.lower() if w.isascii() else w for w in words_], hashes[:-1].tolist(), strict=True))
        assert len(set(told.values())) == len(distinct)
        if words_ is distinct:
            before = told
    assert told == before


def test_saddle_points_take_few_steps(monkeypatch):
    """A large dish's weight costs a few steps, not a bisection's seventy, and is the same."""

    def bisected(c, t, d):
        low, high = -40.0, 60.0
        for _ in range(200):
            mid = (low + high) / 2
            rest = -np.logaddexp(0, mid)
            low, high = (mid, high) if np.exp(mid + d * rest) * d / -np.expm1(d * rest) < c / t else (low, mid)
        spread = c / t * (1 + (1 - d) * np.exp(mid) - c / t)
        return t * np.log(-np.expm1(d * rest)) + c * np.logaddexp(0, -mid) - 0.5 * np.log(2 * np.pi * t * spread)

    cases = [(d, c, t) for d in (0.1, 0.5, 0.83, 0.95) for c in (600, 40_000, 3_000_000) for t in np.unique(np.geomspace(max(2, (2.3 - 2 * d) * c**d), c - 1, 30).astype(int)).tolist()]
    want, steps, real = [bisected(c, t, d) for d, c, t in cases], [], np.logaddexp
    monkeypatch.setattr(seating.np, "logaddexp", lambda *a: steps.append(1) or real(*a))
    got = [seating._saddle(np.array([float(c)]), np.array([float(t)]), d)[0] for d, c, t in cases]
    assert np.allclose(got, want, rtol=1e-9, atol=1e-6) and len(steps) <= 10 * len(cases)


@pytest.mark.parametrize("customers", [(2,), (3,), (8, 9), (14, 16)])
def test_small_dishes_follow_the_exact_law(customers):
    """Shares of each number of tables against the law; dishes of nearly the same size are drawn together."""
    for c in customers:
        for discount, others, base in ((0.83, 3, 0.1), (0.5, 400, 0.004)):
            t, n = np.arange(1, c + 1), 40_000
            law = seating.log_stirling(discount, c)[c, 1:] + t * np.log(base) + np.log(1 + discount * (others + t - 1)).cumsum()
            law = np.exp(law - law.max())
            law /= law.sum()
            sizes = np.tile(customers, n)
            same = lambda x: np.full(len(sizes), x)
            drawn = seating.draw(sizes, same(1), same(others), same(base), discount, 1.0, np.random.default_rng(c))[sizes == c]
            share = np.bincount(drawn, minlength=c + 1)[1:] / n
            assert drawn.max() <= c and (abs(share - law) < 5 * np.sqrt(law * (1 - law) / n) + 1e-4).all()


def test_language_model_counts_words_without_a_row_each(spark, monkeypatch):
    """The table of words holds totals and the few words of a bucket's share, not a row for each word."""
    kept, real = {}, language_model.stored

    def counted_rows(df, name, *args, **options):
        out = real(df, name, *args, **options)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(language_model, "stored", counted_rows)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = language_model.fit(docs, ~held_out(5), rows=20_000)
    counts, every = Counter(), Counter()
    for row in docs.where(~held_out(5)).collect():
        counts.update([*words(row["text"], TOKEN), None])
    for row in docs.collect():
        every.update([*words(row["text"], TOKEN), None])
    assert (model.n_types, model.n_train) == (len(counts), sum(counts.values()))
    share = sum(every.values()) / model.dealing.buckets
    assert sorted(model.dealing.n.tolist()) == sorted(counts[w] for w in every if every[w] > share)
    assert kept["words"] <= 3 * int(spark.conf.get("spark.sql.shuffle.partitions")) < model.n_types
