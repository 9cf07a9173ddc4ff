"""Registered queries of whole chains: questions cut from pages and finished, normalised and published, repaired with counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import markers, normalize, repair
from . import publish
from .page_queries import QUESTIONS_SQL, _pages
from .queries import _CLEAN, _MARKED, _OPTIONS_SQL, _STRIP, _UID, DOCS_SQL, _query, docs

_END = r"'[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$'"


def _without_tail_sql(text: str) -> str:
    out = rf"regexp_replace(regexp_replace({text}, '·\s*第\d+\s*页，共\d+\s*页\s*·\s*$', ''), {_END}, '')"
    out = rf"regexp_replace(regexp_replace({out}, '(?s)(拓展题|基础题|综合题)\s*[一二三四]、.*$', ''), {_END}, '')"
    for heading in T.HEADINGS:  # one after another
        out = f"list_transform([{out}], lambda z: CASE WHEN ends_with(z, '{heading}') THEN regexp_replace(left(z, length(z) - {len(heading)}), {_END}, '') ELSE z END)[1]"
    return out


_KIND = r"""CASE WHEN regexp_matches(content, '\n\s*A[.．、]') OR contains(content, '(A)') OR contains(content, '（A）') THEN '选择题' WHEN contains(content, '____') OR contains(lower(content), 'underline') THEN '填空题'
  WHEN starts_with(content, '证明') OR contains(content, '证明:') OR contains(content, '证明：') THEN '证明题' ELSE '计算题' END"""
_SUBS = rf"""list_filter(list_transform(string_split(regexp_replace(translate(stem, chr(1) || chr(2), '  '), '\(([IiVv]+)\)', chr(1) || '\1' || chr(2), 'g'), chr(1))[2:], lambda z: regexp_replace(split_part(z, chr(2), 2), {_STRIP}, '', 'g')), lambda z: z <> '')"""


@_query(rf"""WITH {QUESTIONS_SQL}, cl AS (SELECT ord, position, section, {_CLEAN} AS content FROM qs), ty AS (SELECT *, {_KIND} AS type, CASE WHEN {_KIND} = '选择题' THEN {_MARKED} ELSE [] END AS p FROM cl),
so AS (SELECT ord, position, section, type, {_OPTIONS_SQL} AS options, CASE WHEN type = '选择题' AND regexp_matches(content, '[A-D][.．、]') THEN regexp_replace(regexp_split_to_array(content, '[A-D][.．、]')[1], {_STRIP}, '', 'g') ELSE content END AS stem FROM ty),
su AS (SELECT *, array_to_string({_SUBS}, '|') AS subs, {_without_tail_sql("stem")} AS body FROM so)
SELECT ord, position, section, type, options, subs, contains(stem, '如图') OR contains(stem, '图所示') OR contains(stem, '图(a)') AS has_image, md5(body) AS content_md5 FROM su WHERE length(body) >= 5""")
def finished_questions(spark, sf_dir):
    """Pages to questions: cut at markers, cleaned, classified, options and sub-questions told, what the page's tail left cut off; short ones go."""
    found = markers.questions(_pages(spark, sf_dir), ("ord",)).withColumn("content", T.clean_text(F.col("content")))
    return _told(T.finished(found)).select("ord", F.col("position").cast("long").alias("position"), "section", "type", "options", "subs", "has_image", F.md5("content").alias("content_md5"))


def _told(rows):
    options = F.concat(*(F.coalesce(F.concat(F.lit(f"{k}="), F.try_element_at("options", F.lit(k)), F.lit(";")), F.lit("")) for k in "ABCD"))
    return rows.withColumns({"options": F.coalesce(options, F.lit("")), "subs": F.coalesce(F.array_join("sub_questions", "|"), F.lit(""))})


#: options by id modulo their number: none, whole, some, blank, and more than four
_OPTIONS = (None, {"A": " 1 ", "B": "2", "C": "3", "D": "x_{(_{0},_{1})}"}, {"B": "x_{(_{2},_{3})}", "C": " c"}, {"A": " ", "D": ""}, {"A": "a", "B": "x_{(_{4},_{5})}", "C": "x_{(_{4},_{5})}", "D": None, "E": "e"})
_MAPS_SQL = "CASE ord % 5 " + " ".join(f"WHEN {n} THEN MAP {{" + ", ".join("'{}': {}".format(k, "NULL" if v is None else "'" + v + "'") for k, v in o.items()) + "}" for n, o in enumerate(_OPTIONS) if o) + " END"


def _with_options(spark, sf_dir):
    pick = F.lit(None).cast("map<string,string>")
    for n, o in enumerate(_OPTIONS):
        if o:
            pick = F.when(F.col("ord") % 5 == n, F.create_map(*(F.lit(x).cast("string") for kv in o.items() for x in kv))).otherwise(pick)
    # the text's own last words stand in an option, so no two rows are alike
    own = F.right(F.col("content"), F.lit(20))
    return docs(spark, sf_dir).withColumn("options", F.transform_values(pick, lambda k, v: F.when(k == "C", F.concat(own, v)).otherwise(v)))


_OPT = "m['{}']"
_C = "CASE WHEN m['C'] IS NOT NULL THEN right(content, 20) || m['C'] END"
_VALUE = lambda k: _C if k == "C" else f"m['{k}']"


@_query(rf"""WITH {DOCS_SQL}, o AS (SELECT ord, content, {_MAPS_SQL} AS m FROM q), f AS (SELECT ord, [{", ".join(f"coalesce(regexp_replace({_VALUE(k)}, {_STRIP}, '', 'g'), '')" for k in "ABCD")}] AS v FROM o)
SELECT ord, CASE WHEN array_to_string(v, '') <> '' THEN md5(array_to_string(v, chr(1))) END AS options_md5 FROM f""")
def full_options(spark, sf_dir):
    """Exactly A to D of options that are missing, whole, partial, blank or more."""
    full = normalize.full_options(F.col("options"))
    return _with_options(spark, sf_dir).select("ord", F.when(full.isNotNull(), F.md5(F.array_join(F.map_values(full), "\u0001"))).alias("options_md5"))


_CLEANED = lambda value: _CLEAN.replace("content", value)


@_query(rf"""WITH {DOCS_SQL}, o AS (SELECT ord, content, {_MAPS_SQL} AS m, string_split(content, ' ') AS parts FROM q)
SELECT ord, md5({_CLEAN}) AS content_md5, md5(array_to_string(list_transform(parts, lambda z: {_CLEANED("z")}), '|')) AS parts_md5, {" || ".join(f"CASE WHEN {_VALUE(k)} IS NULL THEN '' ELSE '{k}=' || md5({_CLEANED('(' + _VALUE(k) + ')')}) END" for k in "ABCDE")} AS options FROM o""")
def cleaned_columns(spark, sf_dir):
    """Clean text over strings, lists and maps, nulls among them."""
    rows = repair.cleaned(_with_options(spark, sf_dir).withColumn("parts", F.split("content", " ", -1)), ("content", "parts", "options"))
    told = F.concat(*(F.coalesce(F.concat(F.lit(f"{k}="), F.md5(F.try_element_at("options", F.lit(k)))), F.lit("")) for k in "ABCDE"))
    return rows.select("ord", F.md5("content").alias("content_md5"), F.md5(F.array_join("parts", "|")).alias("parts_md5"), F.coalesce(told, F.lit("")).alias("options"))


_SUBSCRIPT = lambda v: rf"regexp_replace({v}, '_\{{\(_\{{(\d+)\}},_\{{(\d+)\}}\)\}}', '_{{(\1,\2)}}', 'g')"


@_query(rf"""WITH {DOCS_SQL}, o AS (SELECT ord, content, {_MAPS_SQL} AS m FROM q)
SELECT ord, CAST({" + ".join(f"coalesce(({v} <> {_SUBSCRIPT(v)})::INT, 0)" for v in ("content", *(f"({_VALUE(k)})" for k in "ABCDE")))} AS INT) AS changes, md5({_SUBSCRIPT("content")}) AS content_md5, md5({_SUBSCRIPT("(" + _VALUE("B") + ")")}) AS option_md5 FROM o""")
def safe_fixes(spark, sf_dir):
    """Subscripts of the content and of every option, and how many texts changed."""
    rows = repair.fixed(_with_options(spark, sf_dir), ("content", "options"))
    return rows.select("ord", F.coalesce("changes", F.lit(0)).cast("int").alias("changes"), F.md5("content").alias("content_md5"), F.md5(F.try_element_at("options", F.lit("B"))).alias("option_md5"))


@_query(rf"""WITH {DOCS_SQL}, k AS (SELECT *, CASE WHEN bank = '660' THEN ord % 50 END AS number FROM q), u AS (SELECT bank, coalesce(chapter, '未分类') AS chapter, ord, {_UID.replace("ord", "number")} AS uid, type, page FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY bank, chapter ORDER BY ord) AS place FROM u)
SELECT bank, chapter, CAST((place + 39) // 40 AS INT) AS part, count(*) AS question_count, md5('[' || string_agg('{{"uid":"' || uid || '","type":"' || type || '","page":' || page || '}}', ',' ORDER BY place) || ']') AS questions_md5 FROM n GROUP BY ALL""")
def published_chapters(spark, sf_dir):
    """Raw questions to the fields of the schema, then to nested chapters in parts of forty."""
    c = F.col
    raw = docs(spark, sf_dir).select(
        "bank", "chapter", "id", "type", "content", "page", c("ord").alias("question_pos"), c("ord").alias("chapter_pos"), F.when(c("bank") == "660", c("ord") % 50).alias("qnum"),
        F.create_map().cast("map<string,string>").alias("options"), F.array().cast("array<string>").alias("sub_questions"), (c("page") - 15).alias("printed_page"), F.lit("基础题").alias("section"),
        F.lit(None).cast("boolean").alias("has_image"), F.lit(None).cast("struct<page:int,cropped:string,note:string,original_page:int>").alias("image_ref"), F.lit("").alias("source"),
    )
    parts = publish.nested_parts(normalize.questions(raw), ["uid", "type", "page"], 40)
    return parts.select("bank", "chapter", "part", "question_count", F.md5("questions").alias("questions_md5"))


@_query(rf"""WITH {DOCS_SQL}, p AS (SELECT ord, type, len({_MARKED}) > 0 AS has_options, content AS stem FROM q), f AS (SELECT ord, type, has_options, len({_SUBS}) > 0 AS has_sub FROM p)
SELECT type, has_options, has_sub, count(*) AS n, min(ord) AS first_ord FROM f GROUP BY ALL""")
def viewer_features(spark, sf_dir):
    """Questions by type and by what a viewer filters on: options and sub-questions."""
    features = {"has_options": T.options(F.col("content")).isNotNull(), "has_sub": T.sub_questions(F.col("content")).isNotNull()}
    return docs(spark, sf_dir).withColumns(features).groupBy("type", "has_options", "has_sub").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
