"""Licence scan with a positional rare-token index, in DataFrame functions only.

Two kinds of templates: names with a short notice, and bodies, that is passages of the licences' own texts, which say
nothing of the name. A body's ``RARE`` words of the highest IDF over the whole corpus are indexed with their offsets. A
file's words are looked up in this index; each hit, shifted by its offset, proposes a place (template, start). A place
stays where the postings of at least ``AGREE`` of the template's rare words intersect at it, by relative position, and
where the template's mandatory key phrase stands at its place. A name is a template of one key phrase, indexed under its
rarest word. Each place's words are compared by relative position, weighted by IDF, for the file's score.

Edge cases: a null or empty text has no words, no places, empty labels, null first and last word and score 0. A body may
begin before the file's first word or end after its last one. Words of equal IDF are indexed by their offset. Files are
scanned row by row, so repeated rows and ids, and extra columns, don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RARE, AGREE = 12, 4  # of a body's words in the index, and of these at one place
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between words once A-Z are folded
#: label, key phrases (one of them must stand in the file), whole notice
TEMPLATES = (
    ("mit", ("mit license",), "released under the mit license"),
    ("apache", ("apache license",), "licensed under the apache license version 2 0"),
    ("gpl", ("general public license",), "this work is licensed under the gnu general public license version 3"),
    ("lgpl", ("lesser general public license",), "licensed under the gnu lesser general public license version 2 1"),
    ("agpl", ("affero general public license",), "licensed under the gnu affero general public license version 3"),
    ("mpl", ("mozilla public license",), "subject to the terms of the mozilla public license v 2 0"),
    ("epl", ("eclipse public license",), "made available under the terms of the eclipse public license 2 0"),
    ("bsd", ("redistribution and use in source and binary forms", "bsd license"), "redistribution and use in source and binary forms with or without modification are permitted provided"),
    ("isc", ("permission to use copy modify and or distribute this software", "isc license"), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", ("unencumbered software released into the public domain",), "this is free and unencumbered software released into the public domain"),
    ("cc-by", ("creative commons attribution", "cc by 4 0"), "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", ("cc by sa", "attribution sharealike"), "licensed under cc by sa 4 0"),
    ("cc-by-nc", ("cc by nc", "attribution noncommercial"), "licensed under cc by nc 4 0"),
)
#: label, mandatory key phrase, passage
BODIES = (
    ("mit", "permission is hereby granted free of charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("bsd", "redistributions of source code must retain", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "distribute this software for any purpose with or without fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness."),
    ("apache", "you may not use this file except in compliance with", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "each contributor hereby grants to you a perpetual", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("gpl", "designed to take away your freedom to share and change", "The licenses for most software and other practical works are designed to take away your freedom to share and change the works."),
    ("gpl", "we are referring to freedom not price", "When we speak of free software, we are referring to freedom, not price. Our General Public Licenses are designed to make sure that you have the freedom to distribute copies of free software (and charge for them if you wish), that you receive source code or can get it if you want it, that you can change the software or use pieces of it in new free programs, and that you know you can do these things."),
    ("mpl", "if a copy of the mpl was not distributed with this file", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "permission is granted to anyone to use this software for any purpose", "In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions."),
    ("cc-by", "copy and redistribute the material in any medium or format", "You are free to share, copy and redistribute the material in any medium or format and adapt, remix, transform, and build upon the material for any purpose, even commercially."),
)
#: phrases whose places are counted
BASE = ("mit license", "apache license", "general public license")


@dataclass(frozen=True)
class Phrase:
    label: str
    words: tuple[str, ...]
    base: bool
    notice: tuple[str, ...]
    at: int  # of the phrase in the notice, -1 if it isn't part of it


def _find(notice: list[str], words: list[str]) -> int:
    return next((i for i in range(len(notice) - len(words) + 1) if notice[i : i + len(words)] == words), -1)


def phrases(templates=TEMPLATES, base=BASE) -> list[Phrase]:
    return [Phrase(label, tuple(p.split()), p in base, tuple(notice.split()), _find(notice.split(), p.split())) for label, own, notice in templates for p in own]


def split_words(passage: str) -> list[str]:
    return re.sub(BREAK, " ", passage.translate(str.maketrans(UPPER, LOWER))).split()


def words(text: Column) -> Column:
    """Words with A-Z lower-cased; a text without words gives one empty string, which no phrase has."""
    return F.split(F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK, " ")), " ")


def idf(documents: DataFrame, vocabulary: list[str]) -> tuple[dict[str, float], set[str]]:
    """ln((1 + documents) / (1 + document frequency)) of each template word, over all documents; rounded, so engines agree. And the words that some document has."""
    own = documents.select(words(F.col("text")).alias("w"))
    own = own.select(F.explode(F.array_append(F.array_distinct(F.filter("w", lambda x: x.isin(vocabulary))), F.lit(" "))).alias("word"))
    counts = {r["word"]: r["count"] for r in own.groupBy("word").count().collect()}  # a row per template word
    return {w: round(math.log((1 + counts.get(" ", 0)) / (1 + counts.get(w, 0))), 6) for w in vocabulary}, set(counts)


_PLACE = "array<struct<label:string,phrase:string,first_word:int,base:boolean,coverage:double>>"


def _covered(place: Column, words: Column, weights: Column) -> Column:
    """The weights of the (word, offset) that stand at their offset from a place; places outside the file agree with nothing."""

    def one(x: Column, k: Column) -> Column:
        at = place + x["o"]
        stands = (at >= 0) & F.coalesce(F.try_element_at("_w", F.greatest(at + 1, F.lit(1))) == x["w"], F.lit(False))
        return F.when(stands, F.get(weights, k)).otherwise(0.0)

    return F.aggregate(F.transform(words, one), F.lit(0.0), lambda total, x: total + x)


def rarest(template: list[str], weight: dict[str, float], met: set[str]) -> list[tuple[str, int]]:
    """(word, first offset) of a body's indexed words: of those that some document has the highest IDF, then the smallest offset."""
    first = {w: template.index(w) for w in template if w in met}
    return sorted(first.items(), key=lambda x: (-weight[x[0]], x[1]))[:RARE]


def scan(documents: DataFrame, templates=TEMPLATES, bodies=BODIES, base=BASE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_words and places (label, phrase, first word of the phrase, base, coverage)."""
    indexed = phrases(templates, base)
    passages = [(label, phrase.split(), split_words(passage)) for label, phrase, passage in bodies]
    vocabulary = sorted({w for p in indexed for w in (*p.words, *p.notice)} | {w for _, _, t in passages for w in t})
    weight, met = idf(documents, vocabulary)
    # each template as one row of a table that the plan holds once: what is indexed, what must stand, what is compared
    table_, postings = [], {}
    for p in indexed:
        anchor = max(range(len(p.words)), key=lambda i, p=p: (weight[p.words[i]], -i))
        table_.append(_template(p.label, p.words, 0, p.notice if p.at >= 0 else (), -p.at, weight, p.base))
        postings.setdefault(p.words[anchor], []).append((len(table_) - 1) << 32 | anchor)
    for label, phrase, template in passages:
        own = rarest(template, weight, met)
        table_.append(_template(label, phrase, _find(template, phrase), template, 0, weight, False))
        for w, o in own:
            postings.setdefault(w, []).append((len(table_) - 1) << 32 | o)
    every = sorted(postings)
    files = documents.select(*keep, words(F.col("text")).alias("_w"))
    hits = F.array_compact(F.transform("_w", lambda w, i: F.when(w.isin(every), F.struct(w.alias("w"), i.alias("i")))))
    hits = F.when(F.arrays_overlap("_w", _constant(every, "array<string>")), hits).otherwise(F.array().cast("array<struct<w:string,i:int>>"))
    files = files.select("*", hits.alias("_hits"))
    # (template, start) that the hits propose, as one number each: start + 2**31 below the template's; sorted by both
    index = _constant(postings, "map<string,array<bigint>>")
    proposed = F.flatten(F.transform("_hits", lambda h: F.transform(F.try_element_at(index, h["w"]), lambda k: k + h["i"] - 2 * F.pmod(k, F.lit(1 << 32)) + (1 << 31))))
    files = files.select("*", F.when(F.size("_hits") > 0, F.array_sort(proposed)).otherwise(F.array().cast("array<bigint>")).alias("_each"))
    # postings intersect where a place is proposed by as many rare words as must agree; a name needs its one word
    bodies_from = len(indexed) << 32
    first = lambda c, i: (i == 0) | (F.get("_each", F.greatest(i - 1, F.lit(0))) != c)
    meets = lambda c, i: (c < bodies_from) | F.coalesce(F.get("_each", i + (AGREE - 1)) == c, F.lit(False))
    files = files.select(*keep, "_w", F.filter("_each", lambda c, i: meets(c, i) & first(c, i)).alias("_proposed"))
    templates_ = _constant(table_, f"array<{_TEMPLATE}>")
    known = F.transform("_proposed", lambda c: F.struct((F.pmod(c, F.lit(1 << 32)) - (1 << 31)).cast("int").alias("s"), F.get(templates_, F.shiftright(c, 32).cast("int")).alias("t")))

    def stands(x: Column) -> Column:
        first = x["s"] + x["t"]["at"]
        return (first >= 0) & (F.slice("_w", F.greatest(first + 1, F.lit(1)), F.size(x["t"]["phrase"])) == x["t"]["phrase"])

    def told(x: Column) -> Column:
        t = x["t"]
        matched = F.when(F.size(t["words"]) == 0, F.lit(0.5)).otherwise(_covered(x["s"] + t["from"], t["words"], t["weights"]) / t["total"])
        return F.struct(t["label"].alias("label"), F.array_join(t["phrase"], " ").alias("phrase"), (x["s"] + t["at"]).alias("first_word"), t["base"].alias("base"), matched.alias("coverage"))

    places = F.when(F.size("_proposed") > 0, F.transform(F.filter(known, stands), told)).otherwise(F.array().cast(_PLACE))
    return files.select(*keep, F.when(F.col("_w")[0] == "", F.lit(0)).otherwise(F.size("_w")).cast("long").alias("n_words"), places.alias("places"))


_TEMPLATE = "struct<label:string,phrase:array<string>,at:int,words:array<struct<w:string,o:int>>,weights:array<double>,total:double,from:int,base:boolean>"


def _template(label: str, phrase, at: int, compared, start: int, weight: dict[str, float], base: bool) -> dict:
    """phrase must stand ``at`` words from a place; ``compared`` begins ``start`` words from it."""
    weights = [weight[w] for w in compared]
    return {"label": label, "phrase": list(phrase), "at": at, "words": [{"w": w, "o": o} for o, w in enumerate(compared)], "weights": weights, "total": float(sum(weights) or 1.0), "from": start, "base": base}


def _constant(value, kind: str) -> Column:
    """A literal of any shape, folded by the optimizer from its JSON."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def op2_license(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = found.select("*", F.filter("places", lambda p: p["base"]).alias("b"))
    labels = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))))
    score = F.round(F.coalesce(F.array_max(F.transform("places", lambda p: p["coverage"])), F.lit(0.0)), 4)
    edge = lambda f: f(F.transform("b", lambda p: p["first_word"])).cast("long")
    return found.select("doc_id", "n_words", F.size("b").cast("long").alias("n_base"), edge(F.array_min).alias("first_word"), edge(F.array_max).alias("last_word"), labels("b").alias("base_labels"), labels("places").alias("labels"), score.alias("score"))


def _rows(values) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in values)


_P = phrases()
_T = [(t, label, phrase, " ".join(split_words(passage)), _find(split_words(passage), phrase.split())) for t, (label, phrase, passage) in enumerate(BODIES)]
OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
p(k, label, phrase, base, pos, notice) AS (VALUES {_rows((k, p.label, " ".join(p.words), int(p.base), p.at, " ".join(p.notice)) for k, p in enumerate(_P))}),
b(k, label, phrase, body, pos) AS (VALUES {_rows(_T)}),
v AS (SELECT DISTINCT unnest(string_split(phrase || ' ' || notice, ' ')) AS word FROM p UNION SELECT DISTINCT unnest(string_split(body, ' ')) FROM b),
f AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT r, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM v) GROUP BY word),
idf AS (SELECT word, round(ln((1.0 + (SELECT count(*) FROM d)) / (1.0 + coalesce(df, 0))), 6) AS idf, coalesce(df, 0) AS df FROM v LEFT JOIN f USING (word)),
n AS (SELECT k, pos, x.word, x.o AS o, idf FROM (SELECT k, pos, unnest(list_transform(string_split(notice, ' '), lambda y, i: {{'word': y, 'o': i - 1}})) AS x FROM p) JOIN idf ON idf.word = x.word),
total AS (SELECT k, sum(idf) AS total FROM n GROUP BY k),
bn AS (SELECT k, x.word, x.o AS o, idf, df FROM (SELECT k, unnest(list_transform(string_split(body, ' '), lambda y, i: {{'word': y, 'o': i - 1}})) AS x FROM b) JOIN idf ON idf.word = x.word),
btotal AS (SELECT k, sum(idf) AS total FROM bn GROUP BY k),
rare AS (SELECT k, word, o FROM (SELECT k, word, min(o) AS o, row_number() OVER (PARTITION BY k ORDER BY any_value(idf) DESC, min(o)) AS place FROM bn WHERE df > 0 GROUP BY k, word) WHERE place <= {RARE}),
s AS (SELECT r, w, unnest(range(0, len(w))) AS s FROM d WHERE len(w) > 0),
m AS (SELECT s.r, s.w, s.s, p.* FROM s JOIN p ON s.w[s.s + 1] = string_split(p.phrase, ' ')[1] AND list_slice(s.w, s.s + 1, s.s + len(string_split(p.phrase, ' '))) = string_split(p.phrase, ' ')),
bm AS (SELECT s.r, s.w, s.s, s.s - b.pos AS z, b.* FROM s JOIN b ON s.w[s.s + 1] = string_split(b.phrase, ' ')[1] AND list_slice(s.w, s.s + 1, s.s + len(string_split(b.phrase, ' '))) = string_split(b.phrase, ' ')),
c AS (SELECT m.r, m.s, m.label, m.base, CASE WHEN m.pos < 0 THEN 0.5 ELSE (SELECT sum(n.idf) FROM n WHERE n.k = m.k AND m.s - m.pos + n.o >= 0 AND m.w[m.s - m.pos + n.o + 1] = n.word) / (SELECT total FROM total t WHERE t.k = m.k) END AS coverage FROM m
  UNION ALL SELECT bm.r, bm.s, bm.label, 0, (SELECT sum(bn.idf) FROM bn WHERE bn.k = bm.k AND bm.z + bn.o >= 0 AND bm.w[bm.z + bn.o + 1] = bn.word) / (SELECT total FROM btotal t WHERE t.k = bm.k) FROM bm
    WHERE (SELECT count(*) FROM rare WHERE rare.k = bm.k AND bm.z + rare.o >= 0 AND bm.w[bm.z + rare.o + 1] = rare.word) >= {AGREE}),
g AS (SELECT r, count(*) FILTER (base = 1) AS n_base, min(s) FILTER (base = 1) AS first_word, max(s) FILTER (base = 1) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base = 1) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(round(coalesce(score, 0.0), 4) AS DOUBLE) AS score
FROM d LEFT JOIN g USING (r)
"""
