"""Personal data: fixed base patterns, extended by bootstrapped contextual extraction.

The base finds e-mail addresses, IPv4 addresses, card numbers and phone numbers. They seed a bootstrap: the words around
every seed and around every other identifier-like string (it holds four digits in a row) are lexical patterns. Whatever
else stands in the slot of a pattern that survives, up to ``MOST`` words, becomes an instance too, with or without digits.
Spark scores the graph of patterns and instances iteratively: a pattern is worth the share of its instances, ordinary words
included, that are known to be of a kind, an instance the noisy-or of its patterns. Identifier-like strings that end above
``least`` are found wherever they stand, other strings where they stand in the slot of a surviving pattern.

Surviving patterns are sent to the texts in blocks of ``block_patterns``; a further block is a further pass.

Only distinct (pattern, instance) edges are joined and all joins are salted, so a pattern or instance that holds a
large share of the rows is spread over many tasks. A pattern's words are whole words, however long.

Edge cases: a null or empty text has no spans. Occurrences are keyed by a hash of id and text, so repeated rows get the
same spans and null ids work. An empty table gives an empty result. Only named columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stored, table, working_name

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match can only begin where a run of digits does
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]{4,}")
_BODY = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_./:#-")
_BUSY = re.compile(r"[0-9@]")
MOST = 6  # words that a slot may hold
_TOKEN = re.compile(r"\S+")
_GROUP = re.compile(r"[0-9]+")
_TRIM = ".,;:!?()[]{}<>\"'`*|"


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches in linear time: the local part of an @ is the run of its characters before it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
            end = found.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    if not text or not _BUSY.search(text):
        return []
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like strings outside the base spans."""
    out, end, k = [], 0, 0
    for m in _DIGITS.finditer(text or ""):
        if m.start() < end:
            continue
        a, b = m.span()
        while a > end and text[a - 1] in _BODY:
            a -= 1
        while b < len(text) and text[b] in _BODY:
            b += 1
        end = b
        while k < len(taken) and taken[k][2] <= a:
            k += 1
        if all(s >= b or e <= a for _, s, e in taken[max(k - 4, 0) : k + 8]) and len(text[a:b].strip("./:-#_")) >= 5:
            out.append((a, b))
    return out


def _words_before(text: str, a: int) -> list[str]:
    """The last two words before a, whole however long they are: the window grows until a third one begins in it."""
    reach = 64
    while True:
        found = text[max(0, a - reach) : a].split()
        if reach >= a or len(found) > 2:
            return found[-2:]
        reach *= 2


def _word_after(text: str, b: int) -> list[str]:
    reach = 64
    while True:
        found = text[b : b + reach].split()
        if b + reach >= len(text) or len(found) > 1:
            return found[:1]
        reach *= 2


def _context(text: str, a: int, b: int) -> list[str]:
    left = [w.lower() for w in _words_before(text, a)]
    right = [w.lower() for w in _word_after(text, b)]
    out = []
    if len(left) == 2:
        out.append("L:" + " ".join(left))
    if left and right:
        out.append("B:" + left[-1] + "|" + right[0])
    return out


def slots(text: str, taken: list[tuple[int, int, bool]], lefts: frozenset[str], wanted: frozenset[str]) -> list[tuple[int, int]]:
    """What stands in the slots of the wanted patterns outside the taken (start, end, may stand inside a longer slot); lefts holds the patterns' last words before the slot.

    A slot ends where its right word follows, at most ``MOST`` words on; without a wanted right word it holds one word, or
    groups of digits joined by single spaces.
    """
    lower = text.lower().split()
    heads = {i + 1 for i, w in enumerate(lower) if w in lefts} | {i for i, w in enumerate(lower) if w[0] in _TRIM and w[: len(w) - len(w.lstrip(_TRIM))] in lefts}
    heads = sorted(i for i in heads if i < len(lower))
    if not heads:
        return []
    tokens, out = [m.span() for m in _TOKEN.finditer(text)], []
    taken = sorted(taken)
    starts, reach = [x for x, _, _ in taken], list(accumulate((y for _, y, _ in taken), max))

    def free_of_taken(a: int, b: int) -> bool:
        """A taken span may only stand inside a longer slot; those from before a are passed over by how far they reach."""
        k = bisect_left(starts, b) - 1
        while k >= 0 and reach[k] > a:
            x, y, free = taken[k]
            if y > a and not (free and a <= x and y <= b and (x, y) != (a, b)):
                return False
            k -= 1
        return True

    for i in heads:
        s, e = tokens[i]
        word = text[s:e]
        lead = len(word) - len(word.lstrip(_TRIM))
        a = s + lead
        left = ([*lower[max(0, i - 1) : i], word[:lead]] if lead else lower[max(0, i - 2) : i])[-2:]
        by_left, before = len(left) == 2 and f"L:{left[0]} {left[1]}" in wanted, f"B:{left[-1]}|"
        one, best, groups = None, None, True
        for j in range(i, min(i + MOST, len(tokens))):
            s, e = tokens[j]
            if j > i and (s != tokens[j - 1][1] + 1 or text[s - 1] != " "):
                break
            b = max(a, s) + len(text[max(a, s) : e].rstrip(_TRIM))
            if b <= max(a, s):
                break
            right = text[b:e].lower() or (lower[j + 1] if j + 1 < len(lower) else "")
            between = right and before + right in wanted
            groups = groups and _GROUP.fullmatch(text, max(a, s), b) is not None
            if between:
                best = (a, b)
                break
            if by_left and (j == i or groups):
                one = (a, b)
            if b < e:
                break
        span = best or one
        if span and free_of_taken(*span):
            out.append(span)
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_PLACE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])


def _extract(batches):
    for batch in batches:
        base, places = [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            own = base_spans(text)
            base.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
            more = [(None, a, b) for a, b in candidates(text, own)] if _BUSY.search(text) else []
            places.append([{"kind": k, "start": a, "end": b, "instance": text[a:b], "patterns": _context(text, a, b)} for k, a, b in own + more])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(base, pa.list_(_SPAN)), pa.array(places, pa.list_(_PLACE))], ["doc_id", "key", "base", "places"])


def extracted(documents: DataFrame) -> DataFrame:
    """doc_id, key, base spans and all places (base and candidate) with their contexts; stored."""
    schema = "doc_id long, key long, base array<struct<kind:string,start:long,end:long>>, places array<struct<kind:string,start:long,end:long,instance:string,patterns:array<string>>>"
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), "text")
    return stored(rows.mapInArrow(_extract, schema), "pii")


_SLOT = "key long, start long, end long, instance string, patterns array<string>"


def _slots(sent):
    def run(batches):
        lefts, wanted = sent.value
        for batch in batches:
            key, start, end, instance, patterns = [], [], [], [], []
            for k, text in zip(batch.column("key"), batch.column("text"), strict=True):
                text = text.as_py() or ""
                own = base_spans(text)
                taken = [(a, b, False) for _, a, b in own] + ([(a, b, True) for a, b in candidates(text, own)] if _BUSY.search(text) else [])
                for a, b in slots(text, taken, lefts, wanted):
                    key.append(k.as_py())
                    start.append(a)
                    end.append(b)
                    instance.append(text[a:b])
                    patterns.append([p for p in _context(text, a, b) if p in wanted])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(instance, pa.string()), pa.array(patterns, pa.list_(pa.string()))], ["key", "start", "end", "instance", "patterns"])

    return run


def slot_places(documents: DataFrame, patterns: DataFrame, block_patterns: int = 200_000) -> DataFrame | None:
    """(key, start, end, instance, patterns) of what stands in the slots of these patterns, with those of them around it; stored, None without patterns."""
    n = patterns.count()
    texts, found = documents.select(row_key().alias("key"), "text"), None
    n_blocks = -(-n // block_patterns)
    for block in range(n_blocks):
        wanted = frozenset(r["pattern"] for r in patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(n_blocks)) == block).toLocalIterator())
        lefts = frozenset(p[2:].split(" ")[-1] if p[0] == "L" else p[2:].rpartition("|")[0] for p in wanted)
        lefts |= frozenset(p[2:].partition("|")[0] for p in wanted if p[0] == "B")  # a word that holds the bar itself
        part = texts.mapInArrow(_slots(documents.sparkSession.sparkContext.broadcast((lefts, wanted))), _SLOT)
        found = part if found is None else found.union(part)
    return None if found is None else stored(_merged(found), "pii-slots")


def _merged(places: DataFrame) -> DataFrame:
    """One row for each place, with all its patterns: a few, two for each pass that found it."""
    every = F.array_distinct(F.flatten(F.collect_list("patterns"))).alias("patterns")
    return places.groupBy("key", "start", "end").agg(F.first("instance").alias("instance"), every)


def row_key():
    return F.xxhash64("doc_id", "text")


def _salts(salts: int):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")


def _edges(places: DataFrame, salts: int) -> DataFrame:
    salted = F.pmod(F.xxhash64("instance"), F.lit(salts)).alias("salt")
    edges = places.select(F.explode("patterns").alias("pattern"), "instance", "kind").groupBy("pattern", "instance").agg(F.max("kind").alias("kind")).select("*", salted)
    return stored(edges, "pii-edges")


def _worth(edges: DataFrame, belief: DataFrame, support: int, salts: int) -> DataFrame:
    """(pattern, kind, worth) of the patterns that survive; stored."""
    by_pattern = F.pmod(F.xxhash64("pattern"), F.lit(salts)).alias("salt")
    held = edges.select("pattern", "instance", by_pattern).join(belief.select("*", _salts(salts)), ["instance", "salt"]).groupBy("pattern", "kind").agg(F.sum("confidence").alias("known"), F.count("*").alias("distinct_known"))
    held = held.where(F.col("distinct_known") >= support)
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("all"))
    return stored(held.join(sizes, "pattern").select("pattern", "kind", ((F.col("known") - 1) / F.col("all")).alias("worth")).where("worth > 0.5"), "pii-patterns")


def bootstrap(documents: DataFrame, flat: DataFrame, rounds: int = 3, least: float = 0.9, support: int = 3, salts: int = 16, block_patterns: int = 200_000):
    """(instance, kind, confidence) of the discovered instances, the surviving patterns, and the slots' places (None without any).

    flat: kind (null for candidates), instance, patterns. A pattern counts for a kind from ``support`` distinct known
    instances on. Its confidence is shrunk, (known - 1) / all.
    """
    flat = flat.select("kind", "instance", "patterns")
    edges = _edges(flat, salts)
    known = edges.where("kind is not null").select("instance", "kind", F.lit(1.0).alias("confidence")).distinct()
    found, asked, places = known.limit(0), None, None
    for _ in range(rounds):
        belief = known.unionByName(found)
        patterns = _worth(edges, belief, support, salts)
        fresh = patterns.select("pattern").distinct()
        fresh = fresh if asked is None else fresh.join(asked, "pattern", "left_anti")
        fresh = stored(fresh, "pii-asked")
        more = slot_places(documents, fresh, block_patterns)
        asked = fresh if asked is None else asked.union(fresh)
        if more is not None:  # what else stands in the slots counts for the patterns' worth as well
            places = more if places is None else stored(_merged(places.union(more)), "pii-slots")
            edges = _edges(flat.union(places.select(F.lit(None).cast("string").alias("kind"), "instance", "patterns")), salts)
            patterns = _worth(edges, belief, support, salts)
        votes = edges.where("kind is null").drop("kind").join(patterns.select("*", _salts(salts)), ["pattern", "salt"])
        by_kind = votes.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("worth", F.lit(0.999)))))).alias("confidence"))
        best = by_kind.groupBy("instance").agg(F.max(F.struct("confidence", "kind")).alias("best")).select("instance", "best.kind", "best.confidence")
        found = stored(best.where(F.col("confidence") >= least), "pii-found")
    return found, patterns, places


def discovered(documents: DataFrame, places: DataFrame, salts: int = 16, **options) -> DataFrame:
    """(key, more): the spans that the bootstrap adds to a text."""
    flat = places.select("key", F.explode("places").alias("p")).select("key", "p.*")
    found, patterns, slot = bootstrap(documents, flat, salts=salts, **options)
    found = found.select("instance", F.col("kind").alias("_kind"), _salts(salts))
    salt = F.pmod(F.xxhash64("key"), F.lit(salts)).alias("salt")
    span = F.struct(F.col("_kind").alias("kind"), "start", "end").alias("span")
    spans = flat.where("kind is null").select("key", "start", "end", "instance", salt).join(found, ["instance", "salt"]).select("key", span)
    if slot is not None:
        held = slot.select("key", "start", "end", "instance", salt, F.explode("patterns").alias("pattern")).join(patterns.select("pattern", F.col("kind").alias("_kind"), _salts(salts)), ["pattern", "salt"])
        spans = spans.union(held.join(found, ["instance", "_kind", "salt"]).select("key", span))
    return spans.groupBy("key").agg(F.collect_set("span").alias("more"))  # the spans of one text


def spans(documents: DataFrame, **options) -> DataFrame:
    """doc_id, base and more: arrays of (kind, start, end) in code points, end exclusive."""
    places = extracted(documents)
    more = discovered(documents, places, **options)
    out = places.drop("places").join(more, "key", "left")
    return out.select("doc_id", "key", "base", F.coalesce("more", F.array().cast("array<struct<kind:string,start:long,end:long>>")).alias("more"))


def _redact(text: str | None, more) -> str | None:
    if not text:
        return text
    todo = sorted([(a, -b, k) for k, a, b in base_spans(text)] + [(m["start"], -m["end"], m["kind"]) for m in more or ()])
    out, end = [], 0
    for a, b, kind in todo:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, -b)
    return "".join([*out, text[end:]])


def redacted(documents: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; n_chars, if there, follows the new text.

    The few texts with discovered spans are broadcast up to ``broadcast_rows`` rows and joined by a shuffle beyond.
    """
    more = stored(discovered(documents, extracted(documents)), "pii-more")
    names = documents.columns
    own, key, found = (working_name(n, names) for n in ("_own_key", "_pii_key", "_pii_more"))
    side = more.select(F.col("key").alias(key), F.col("more").alias(found))
    if more.count() <= broadcast_rows:
        side = F.broadcast(side)
    rows = documents.withColumn(own, row_key()).join(side, F.col(own) == F.col(key), "left").select(*names, found)

    def run(batches):
        for batch in batches:
            texts = pa.array([_redact(t.as_py(), m.as_py()) for t, m in zip(batch.column("text"), batch.column(found), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if n == "text" else batch.column(n) for n in names], names)

    out = rows.mapInArrow(run, documents.schema)
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in names else out


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rank = F.create_map(*(x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))))

    def joined(column):
        ordered = F.array_sort(F.transform(column, lambda s: F.struct(s["start"].alias("s"), rank[s["kind"]].alias("k"), s["end"].alias("e"), s["kind"].alias("n"))))
        return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", s["n"], s["s"].cast("string"), s["e"].cast("string"))))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"))
