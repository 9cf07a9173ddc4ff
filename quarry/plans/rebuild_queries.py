"""Registered queries of the path from extraction results to a bank, of reports and of display, beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lenient, rules
from ..functions import text as T
from ..operators import layout, markers, normalize, rebuild, repair, sequence
from ..sources import files
from .page_queries import PAGES
from .queries import _STRIP, CHAPTERS, DOCS_SQL, ISSUES_SQL, _issues, _pick, _query, _quoted, docs


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: lineitem as boxes and results: an order is a page, a line a box on it
WORK_SQL = r"""w AS (SELECT CAST(l_orderkey AS INT) AS page, CAST(l_linenumber AS INT) AS index, CASE WHEN l_partkey % 5 > 0 THEN 'temp\660_crops\p' || l_orderkey || '_' || l_linenumber || '.png' ELSE '' END AS crop,
  CASE WHEN l_suppkey % 11 = 0 THEN 'timeout' END AS error, CASE WHEN l_partkey % 7 > 0 THEN 'question ' || l_partkey ELSE '' END AS content, CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE CAST(l_partkey AS VARCHAR) END AS qnum
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)),
g AS (SELECT CAST(o_orderkey AS INT) AS page, CASE WHEN o_orderkey % 3 > 0 THEN range(o_custkey, o_custkey + o_orderkey % 6) END AS numbers FROM orders)"""


def _work(spark, sf_dir):
    """boxes (page, index, crop), results (page, index, error, content, qnum) and page numbers (page, numbers)."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    work = lines.selectExpr(
        "cast(l_orderkey AS int) AS page", "cast(l_linenumber AS int) AS index", r"CASE WHEN l_partkey % 5 > 0 THEN concat('temp\\660_crops\\p', l_orderkey, '_', l_linenumber, '.png') ELSE '' END AS crop",
        "CASE WHEN l_suppkey % 11 = 0 THEN 'timeout' END AS error", "CASE WHEN l_partkey % 7 > 0 THEN concat('question ', l_partkey) ELSE '' END AS content", "CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE cast(l_partkey AS string) END AS qnum",
    )
    numbers = "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN array() ELSE sequence(cast(o_custkey AS int), cast(o_custkey + o_orderkey % 6 - 1 AS int)) END AS numbers"
    pages = _table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey AS int) AS page", numbers)
    return work.select("page", "index", "crop"), work.drop("crop"), pages


_JOINED = "j AS (SELECT w.page, w.index, crop, error, content, CASE WHEN index BETWEEN 1 AND len(numbers) THEN numbers[index] END AS number FROM w LEFT JOIN g USING (page))"


@_query(rf"""WITH {WORK_SQL}, {_JOINED} SELECT page, index, CAST(number AS INT) AS qnum, content, page - 15 AS printed_page, CASE WHEN crop <> '' THEN '../../' || replace(crop, '\', '/') END AS cropped, crop <> '' AS has_image,
  row_number() OVER (ORDER BY page, index) AS id FROM j WHERE error IS NULL AND content <> '' AND number IS NOT NULL""")
def rebuild_bank(spark, sf_dir):
    out = rebuild.bank(rebuild.assigned(*_work(spark, sf_dir)))
    return out.withColumn("id", F.col("id").cast("long"))


@_query(f"WITH {WORK_SQL}, {_JOINED} SELECT count(number) AS assigned, count(*) - count(number) AS missing, count(*) FILTER (error IS NOT NULL OR content = '') AS failed, count(*) FILTER (number IS NOT NULL AND error IS NULL AND content <> '') AS kept FROM j")
def rebuild_counters(spark, sf_dir):
    return rebuild.outcomes(rebuild.assigned(*_work(spark, sf_dir)))


@_query(f"WITH {WORK_SQL} SELECT page, index, content FROM w WHERE error IS NULL AND content <> ''")
def succeeded_results(spark, sf_dir):
    return rebuild.succeeded(_work(spark, sf_dir)[1]).select("page", "index", "content")


@_query(f"WITH {WORK_SQL} SELECT page, index, TRY_CAST(qnum AS INT) AS qnum FROM w WHERE TRY_CAST(qnum AS INT) IS NOT NULL")
def numbered_results(spark, sf_dir):
    return rebuild.numbered_only(_work(spark, sf_dir)[1]).select("page", "index", "qnum")


@_query(f"WITH {WORK_SQL} SELECT page, index, coalesce(TRY_CAST(qnum AS INT), index) AS qnum FROM w")
def index_as_number(spark, sf_dir):
    return rebuild.with_index_as_number(_work(spark, sf_dir)[1]).select("page", "index", "qnum")


#: responses by id modulo their number
RESPONSES = (
    '{"qnum": 7, "type": "填空题", "content": "a", "section": "综合题", "sub_questions": ["x", {"content": "y"}, {"text": "z"}], "has_image": true}', '{"num": 4, "type": "", "content": "b", "sub_questions": []}', '{"qnum": 0, "num": "12", "section": null}',
    '{"qnum": "", "content": null, "sub_questions": [{"content": "", "text": "t"}]}', "{}",
)


@_query(f"""WITH r AS (SELECT doc_id, CAST({_pick(RESPONSES, "doc_id")} AS JSON) AS j FROM documents WHERE doc_id IS NOT NULL),
f AS (SELECT doc_id, j, j->>'$.qnum' AS a, j->>'$.num' AS b, j->>'$.type' AS t, j->>'$.section' AS s, CAST(j->'$.sub_questions' AS JSON[]) AS subs FROM r)
SELECT doc_id, coalesce(CASE WHEN a NOT IN ('', '0') THEN a END, CASE WHEN b NOT IN ('', '0') THEN b END, '0') AS qnum, coalesce(nullif(t, ''), '计算题') AS type, coalesce(j->>'$.content', '') AS content, coalesce(nullif(s, ''), '基础题') AS section,
  array_to_string(list_transform(subs, lambda x: CASE WHEN json_type(x) = 'OBJECT' THEN coalesce(nullif(x->>'$.content', ''), x->>'$.text') ELSE x->>'$' END), '|') AS subs, coalesce(CAST(j->>'$.has_image' AS BOOLEAN), false) AS has_image FROM f""")
def response_rows(spark, sf_dir):
    pick = F.element_at(F.array(*map(F.lit, RESPONSES)), (F.col("doc_id") % len(RESPONSES) + 1).cast("int"))
    rows = _table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.from_json(pick, rebuild.RESPONSE).alias("r"))
    f = rebuild.response_fields(F.col("r"))
    subs = F.when(f["sub_questions"].isNotNull(), F.concat_ws("|", f["sub_questions"])).when(F.col("r.sub_questions").isNotNull(), "")
    return rows.select("doc_id", *(f[k].alias(k) for k in ("qnum", "type", "content", "section", "has_image")), subs.alias("subs"))


@_query(f"WITH {ISSUES_SQL} SELECT DISTINCT ord FROM i WHERE severity = 'warning'")
def report_by_severity(spark, sf_dir):
    return rules.report(_issues(spark, sf_dir), "ord").where(F.array_contains("severities", "warning")).select("ord")


@_query(f"WITH {ISSUES_SQL} SELECT DISTINCT ord FROM i WHERE code = 'unicode_math'")
def report_by_code(spark, sf_dir):
    return rules.report(_issues(spark, sf_dir), "ord").where(F.array_contains("codes", "unicode_math")).select("ord")


@_query(f"WITH {ISSUES_SQL} SELECT (SELECT count(*) FROM q) AS n_questions, count(DISTINCT ord) AS n_with_issue FROM i")
def questions_with_issue(spark, sf_dir):
    return docs(spark, sf_dir).select(rules.codes(F.col("content")).alias("c")).agg(F.count("*").alias("n_questions"), F.count_if(F.size("c") > 0).alias("n_with_issue"))


#: raw options by id modulo their number
RAW_OPTIONS = ('["a", "b"]', "[]", '{"A": "1", "B": "2", "C": "3", "D": "4"}', '{"A": "1"}', "")


@_query(f"WITH {DOCS_SQL}, o AS (SELECT ord, {_pick(RAW_OPTIONS, 'ord')} AS raw FROM q) SELECT ord, 'options_type' AS code, 'critical' AS severity FROM o WHERE json_valid(raw) AND json_type(raw) = 'ARRAY' AND json_array_length(raw) > 0")
def options_type_issues(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, RAW_OPTIONS)), (F.col("ord") % len(RAW_OPTIONS) + 1).cast("int"))
    return docs(spark, sf_dir).select("ord", F.explode(rules.options_type(raw)).alias("i")).select("ord", "i.code", "i.severity")


_SECTIONS = ("基础题", "综合题", "拓展题")
_SECTION_SQL = f"CASE WHEN ord % 4 < 3 THEN {_pick(_SECTIONS, 'ord % 4')} END"


def _sectioned(spark, sf_dir):
    pick = F.try_element_at(F.array(*map(F.lit, _SECTIONS)), (F.col("ord") % 4 + 1).cast("int"))
    return docs(spark, sf_dir).withColumns({"section": pick, "has_image": F.col("ord") % 5 == 0})


@_query(f"WITH {DOCS_SQL}, s AS (SELECT *, {_SECTION_SQL} AS section FROM q) SELECT chapter, coalesce(section, '?') AS section, count(*) AS n, count(*) FILTER (ord % 5 = 0) AS n_images FROM s GROUP BY ROLLUP (chapter, coalesce(section, '?'))")
def section_counts(spark, sf_dir):
    """By chapter and section, with images; totals have null in their place."""
    rows = _sectioned(spark, sf_dir).withColumn("section", F.coalesce("section", F.lit("?")))
    return rows.rollup("chapter", "section").agg(F.count("*").alias("n"), F.count_if("has_image").alias("n_images"))


@_query(f"""WITH {DOCS_SQL}, c AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {a}, {b})" for n, a, b in CHAPTERS)}) v(name, lo, hi))
SELECT name AS chapter, count(*) AS question_count, (SELECT max(page) FROM q) AS total_pages FROM q JOIN c ON page BETWEEN lo AND hi GROUP BY name""")
def chapters_with_total_pages(spark, sf_dir):
    """total_pages is that of all questions, those of no chapter included."""
    from ..operators import relate

    d = docs(spark, sf_dir)
    ranges = spark.createDataFrame([(k, n, a, b) for k, (n, a, b) in enumerate(CHAPTERS)], "ord int, name string, start int, end int")
    named = relate.range_lookup(d.select("page"), ranges, "page", "in_chapter").where("in_chapter is not null")
    counts = named.groupBy(F.col("in_chapter").alias("chapter")).agg(F.count("*").alias("question_count"))
    return counts.join(F.broadcast(d.agg(F.max("page").alias("total_pages"))))


@_query(f"WITH {DOCS_SQL} SELECT chapter, row_number() OVER (ORDER BY min(ord)) AS place, count(*) AS question_count FROM q GROUP BY chapter")
def first_seen_chapters(spark, sf_dir):
    """Chapters in the order in which they come first; a window over chapters."""
    per = docs(spark, sf_dir).groupBy("chapter").agg(F.min("ord").alias("first"), F.count("*").alias("question_count"))
    return per.select("chapter", F.row_number().over(Window.orderBy("first")).cast("long").alias("place"), "question_count")


_CONV = f"conv_id, turn, coalesce(text, '') || {_pick(PAGES, '(conv_id + turn)')} AS t"


@_query(rf"""WITH pg AS (SELECT {_CONV} FROM conversations), sp AS (SELECT conv_id, turn, length(t) AS n_chars, string_split(regexp_replace(translate(t, chr(1) || chr(2), '  '), '{markers.MARKER}', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts FROM pg),
pt AS (SELECT conv_id, turn, n_chars, unnest(parts) AS part, unnest(range(len(parts))) AS k FROM sp),
ps AS (SELECT *, CAST(coalesce(sum(length(replace(part, chr(2), ''))) OVER (PARTITION BY conv_id, turn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position FROM pt),
mk AS (SELECT conv_id, turn, k, position, n_chars, split_part(part, chr(2), 1) AS marker, split_part(part, chr(2), 2) AS body,
  CASE WHEN split_part(part, chr(2), 1) IN ('基础题', '综合题', '拓展题') THEN 'section' WHEN split_part(part, chr(2), 1) IN ('选择题', '填空题', '解答题') THEN 'topic' ELSE 'question' END AS kind FROM ps WHERE k > 0),
st AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'section' THEN marker END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, k), '基础题') AS section,
  coalesce(last_value(CASE kind WHEN 'section' THEN '选择题' WHEN 'topic' THEN marker END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, k), '选择题') AS topic,
  min(CASE WHEN kind = 'question' THEN position END) OVER (PARTITION BY conv_id, turn ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_q, greatest(instr(body, chr(10)) - 1, 0) AS line FROM mk),
c AS (SELECT *, position + length(marker) + line AS stop, regexp_replace(CASE WHEN kind = 'question' THEN body ELSE substr(body, line + 1) END, {_STRIP}, '', 'g') AS content FROM st)
SELECT conv_id, turn, position, section, topic, md5(content) AS content_md5 FROM c WHERE NOT (length(content) <= 30 AND regexp_matches(content, '选择题|填空题|解答题|证明题|基础题|综合题|拓展题'))
  AND (kind = 'question' AND length(content) >= 5 OR kind = 'topic' AND section = '拓展题' AND n_chars - stop > 20 AND length(content) > 10 AND (next_q IS NULL OR next_q - stop > 100))""")
def chapter_questions(spark, sf_dir):
    """A conversation is a chapter, a turn its page: section and topic carry on from page to page."""
    pick = F.element_at(F.array(*map(F.lit, PAGES)), ((F.col("conv_id") + F.col("turn")) % len(PAGES) + 1).cast("int"))
    pages = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), pick).alias("text"))
    found = markers.questions(pages, ("conv_id",), page="turn")
    return found.select("conv_id", "turn", F.col("position").cast("long").alias("position"), "section", "topic", F.md5("content").alias("content_md5"))


@_query(rf"""WITH {DOCS_SQL}, a AS (SELECT ord, content, type, replace(content, 'the', 'the \_\_\_$。') AS t FROM q WHERE ord % 10 = 0)
SELECT ord, md5(CASE WHEN type = '填空题' AND (length(t) - length(replace(t, '$', ''))) % 2 = 1 AND regexp_matches(t, '\\_\$。$') THEN CASE WHEN regexp_matches(t, '\$(?:\\_)+\$。$') THEN regexp_replace(t, '\$((?:\\_)+)\$。$', '\1$。') ELSE regexp_replace(t, '((?:\\_)+)\$。$', '$\1$。') END ELSE t END) AS after_md5 FROM a""")
def replaced_then_repaired(spark, sf_dir):
    """A literal replacement in some questions, then the repair of blanks that it may call for: the order matters."""
    d = docs(spark, sf_dir).where("ord % 10 = 0")
    t = F.replace("content", F.lit("the"), F.lit(r"the \_\_\_$。"))
    return d.select("ord", F.md5(F.when(F.col("type") == "填空题", repair.blank_suffix(t)).otherwise(t)).alias("after_md5"))


@_query(f"WITH {DOCS_SQL}, a AS (SELECT ord, content || ' ②⇒③⇔①' AS t FROM q) SELECT ord, md5(replace(replace(t, '⇒', '\\Rightarrow'), '⇔', '\\Leftrightarrow')) AS after_md5 FROM a".replace("\\\\", "\\"))
def arrows_as_commands(spark, sf_dir):
    t = F.concat("content", F.lit(" ②⇒③⇔①"))
    return docs(spark, sf_dir).select("ord", F.md5(rebuild.arrows_as_commands(t)).alias("after_md5"))


@_query(f"""WITH {DOCS_SQL}, p AS (SELECT doc_id, max(quality) AS a, max(toxic) AS b FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id)
SELECT ord, md5(CASE WHEN a = 1 THEN 'patched ' || ord ELSE content END) AS content_md5, CASE WHEN b = 1 THEN 'x|y' ELSE 'old' END AS subs FROM q LEFT JOIN p ON ord = doc_id""")
def patched_fields(spark, sf_dir):
    """Hand patches of a text and of a list field, by key."""
    d = docs(spark, sf_dir).select("ord", "content", F.array(F.lit("old")).alias("sub_questions"))
    by = _table(spark, sf_dir, "labels").where("doc_id is not null").select(F.col("doc_id").alias("ord_"), "quality", "toxic")
    text = by.where("quality = 1").select("ord_", F.lit("content").alias("field"), F.array(F.concat(F.lit("patched "), F.col("ord_").cast("string"))).alias("values"))
    subs = by.where("toxic = 1").select("ord_", F.lit("sub_questions").alias("field"), F.array(F.lit("x"), F.lit("y")).alias("values"))
    patches = text.union(subs).withColumnRenamed("ord_", "uid").withColumn("ord", F.lit(1))
    out = rebuild.patched(d.withColumnRenamed("ord", "uid"), patches, "uid").withColumnRenamed("uid", "ord")
    return out.select("ord", F.md5("content").alias("content_md5"), F.concat_ws("|", "sub_questions").alias("subs"))


#: JSON texts with LaTeX in them, by id modulo their number
LATEX = (r'{"qnum": "3", "content": " \frac{1}{2} \u4e2d \n "}', r'say {"content": "a \"b\" \\frac \/ \1"} so', r'{"a": "\uZZ", \q "b": "\令"}', "no braces", r'{"qnum": null, "options": {"A": "\alpha"}}')
_LETTERS_SQL = r"""array_to_string(list_transform(string_split(replace(regexp_replace({t}, '\\u([0-9a-fA-F]{{4}})', chr(2) || '\1', 'g'), '\"', chr(1)), '"'), lambda p, i: CASE WHEN i % 2 = 0 THEN regexp_replace(p, '\\(\p{{L}})', '\\\\\1', 'g') ELSE p END), '"')"""
_RESTORED = r"replace(replace({x}, chr(1), '\"'), chr(2), '\u')"


def _latex(spark, sf_dir):
    pick = F.element_at(F.array(*map(F.lit, LATEX)), (F.col("doc_id") % len(LATEX) + 1).cast("int"))
    return _table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", pick.alias("t"))


@_query(f"WITH r AS (SELECT doc_id, {_pick(LATEX, 'doc_id')} AS t FROM documents WHERE doc_id IS NOT NULL) SELECT doc_id, {_RESTORED.format(x=_LETTERS_SQL.format(t='t'))} AS fixed FROM r")
def letters_escaped(spark, sf_dir):
    return _latex(spark, sf_dir).select("doc_id", lenient.letters_escaped(F.col("t")).alias("fixed"))


@_query(rf"""WITH r AS (SELECT doc_id, {_pick(LATEX, "doc_id")} AS t FROM documents WHERE doc_id IS NOT NULL), b AS (SELECT doc_id, t, nullif(regexp_extract(t, '(?s)(\{{.*\}})', 1), '') AS raw FROM r),
c AS (SELECT doc_id, t, raw, {_RESTORED.format(x=_LETTERS_SQL.format(t="raw"))} AS fixed FROM b), p AS (SELECT doc_id, t, CASE WHEN json_valid(raw) THEN raw WHEN json_valid(fixed) THEN fixed END AS j FROM c)
SELECT doc_id, j IS NOT NULL AS ok, CASE WHEN j IS NOT NULL THEN j->>'$.qnum' END AS qnum, CASE WHEN j IS NOT NULL THEN regexp_replace(coalesce(j->>'$.content', ''), {_STRIP}, '', 'g') ELSE t END AS content, CASE WHEN j IS NOT NULL THEN j->>'$.options.A' END AS a FROM p""")
def parsed_objects(spark, sf_dir):
    rows = _latex(spark, sf_dir).select("doc_id", lenient.parsed_object(F.col("t")).alias("o"))
    return rows.select("doc_id", "o.ok", "o.qnum", "o.content", F.try_element_at("o.options", F.lit("A")).alias("a"))


@_query("SELECT page_id, md5(base64(encode(html))) AS base64_md5, replace(url_encode(url), '%2F', '/') AS quoted, format('{:,}', page_id * 12345) AS grouped, left(html, 60) AS short FROM pages")
def encoded_pages(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return p.select("page_id", F.md5(T.base64_text(F.col("html"))).alias("base64_md5"), T.url_quoted(F.col("url")).alias("quoted"), T.grouped_digits(F.col("page_id") * 12345).alias("grouped"), T.shortened(F.col("html"), 60).alias("short"))


@_query(f"WITH {DOCS_SQL}, s AS (SELECT ord, page FROM q WHERE page % 2 = 0) SELECT ord, page, (SELECT greatest(count(*) - 20, 0) FROM s) AS more FROM s ORDER BY ord LIMIT 20")
def first_skipped(spark, sf_dir):
    """The first twenty for display and how many more there are; the limit is the feature."""
    return rebuild.first_of(docs(spark, sf_dir).where("page % 2 = 0").select("ord", "page"), "ord", 20)


@_query(f"WITH {DOCS_SQL} SELECT ord, row_number() OVER (PARTITION BY page ORDER BY ord % 7, ord) AS place FROM q")
def page_order(spark, sf_dir):
    rows = docs(spark, sf_dir).select("ord", "page", F.concat(F.lit("例"), (F.col("ord") % 7).cast("string")).alias("label"))
    return rebuild.in_page_order(rows, "page", "label", "ord").select("ord", F.col("place").cast("long").alias("place"))


@_query(f"WITH {WORK_SQL} SELECT page, index, row_number() OVER (ORDER BY page, index) AS place FROM w")
def sorted_boxes(spark, sf_dir):
    """Boxes in order of page and place."""
    return sequence.numbered_within(_work(spark, sf_dir)[0].select("page", "index"), "page", "index", "place").select("page", "index", F.col("place").cast("long").alias("place"))


@_query("SELECT page, index, row_number() OVER (ORDER BY page, index) AS place FROM (SELECT DISTINCT CAST(l_suppkey AS INT) AS page, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS index FROM lineitem)")
def sorted_boxes_of_long_pages(spark, sf_dir):
    """A supplier is a page here, so pages hold many boxes of any index."""
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("int").alias("page"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("index")).distinct()
    return sequence.numbered_within(rows, "page", "index", "place").select("page", "index", F.col("place").cast("long").alias("place"))


@_query(f"WITH {DOCS_SQL} SELECT chapter, count(*) AS n, row_number() OVER (ORDER BY chapter NULLS FIRST) AS place FROM q GROUP BY chapter")
def printed_by_key(spark, sf_dir):
    """Counts in the order of their keys; a window over chapters."""
    per = docs(spark, sf_dir).groupBy("chapter").agg(F.count("*").alias("n"))
    return per.withColumn("place", F.row_number().over(Window.orderBy(F.col("chapter").asc_nulls_first())).cast("long"))


@_query("SELECT l_orderkey, l_linenumber // 3 AS line, arg_min(l_partkey, (l_suppkey * 10 + l_linenumber) * 1000000 + l_partkey) AS leftmost FROM lineitem GROUP BY 1, 2")
def leftmost_of_row(spark, sf_dir):
    b = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr("l_linenumber div 3").cast("int").alias("line"), "l_partkey", ((F.col("l_suppkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("x"))
    return b.groupBy("l_orderkey", "line").agg(F.min_by("l_partkey", "x").alias("leftmost"))


@_query("SELECT l_orderkey, l_linenumber, greatest(0, least(l_partkey - 20, 800)) AS x0, greatest(0, least(l_partkey + 300, 800)) AS x1, CAST(trunc(l_quantity * 2.5) AS INT) AS px FROM lineitem")
def clamped_boxes(spark, sf_dir):
    """A crop's edges inside its image, and points in pixels."""
    b = _table(spark, sf_dir, "lineitem")
    return b.select("l_orderkey", "l_linenumber", layout.clamped(F.col("l_partkey") - 20, 0, 800).alias("x0"), layout.clamped(F.col("l_partkey") + 300, 0, 800).alias("x1"), layout.scaled(F.col("l_quantity"), F.lit(2.5)).alias("px"))


@_query("SELECT page_id, CAST(regexp_extract('page_' || page_id || '.png', '(\\d+)', 1) AS INT) AS page FROM pages WHERE page_id % 3 > 0 AND page_id BETWEEN 5 AND 200".replace("\\\\", "\\"))
def page_images(spark, sf_dir):
    """Listed files by name: those that name a page, in a range of pages."""
    name = F.concat(F.lit("imgs/"), F.when(F.col("page_id") % 3 > 0, "page_").otherwise("cover_x_"), F.col("page_id").cast("string"), F.lit(".png"))
    listed = _table(spark, sf_dir, "pages").select("page_id", name.alias("path"))
    return files.page_images(listed, 5, 200).select(F.col("page").cast("long").alias("page_id"), "page")


@_query("""WITH l AS (SELECT page_id // 10 AS k, page_id % 10 AS r, CASE page_id % 10 WHEN 3 THEN 'questions.json' WHEN 5 THEN 'B题目.json' WHEN 6 THEN 'a_Questions_old.json' WHEN 7 THEN 'questions.txt' ELSE 'other.json' END AS name FROM pages),
c AS (SELECT k, name, CASE WHEN name = 'questions.json' THEN 0 WHEN name LIKE '%.json' AND (contains(name, '题目') OR contains(lower(name), 'questions')) THEN 1 END AS rank FROM l WHERE NOT (r = 3 AND k % 2 = 0))
SELECT 'books/' || k AS folder, 'books/' || k || '/' || arg_min(name, rank || name) AS path FROM c WHERE rank IS NOT NULL GROUP BY k""")
def bank_files(spark, sf_dir):
    """Each folder's bank, under its usual or another name."""
    r = F.col("page_id") % 10
    name = F.when(r == 3, "questions.json").when(r == 5, "B题目.json").when(r == 6, "a_Questions_old.json").when(r == 7, "questions.txt").otherwise("other.json")
    p = _table(spark, sf_dir, "pages").select("page_id", F.expr("page_id div 10").alias("k"), name.alias("name")).where("NOT (page_id % 10 = 3 AND k % 2 = 0)")
    return files.bank_files(p.select(F.concat_ws("/", F.lit("books"), F.col("k").cast("string"), "name").alias("path")))


@_query(f"WITH {DOCS_SQL} SELECT ord, chapter FROM q WHERE ord % 5 = 0")
def with_images(spark, sf_dir):
    """Questions that have an image."""
    return _sectioned(spark, sf_dir).where("has_image").select("ord", "chapter")


@_query(f"WITH {DOCS_SQL} SELECT ord FROM q WHERE ord % 5 = 0 AND ord % 2 = 0")
def with_reference(spark, sf_dir):
    """Questions whose image reference names a crop."""
    path = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("cropped_images/"), F.col("ord").cast("string")))
    ref = F.when(F.col("has_image"), F.struct(F.col("page"), path.alias("cropped"), F.lit("").alias("note"), F.col("page").alias("original_page")))
    rows = _sectioned(spark, sf_dir).select("ord", normalize.image_ref(ref, F.col("bank")).alias("image_ref"))
    return rows.where("image_ref.cropped is not null").select("ord")


@_query(f"WITH {DOCS_SQL} SELECT ord, bank FROM q WHERE id = '42' OR (page = 7 AND id = '103')")
def point_lookup(spark, sf_dir):
    """By id, and by page and id; ids compare as strings."""
    c = F.col
    return docs(spark, sf_dir).where((c("id").cast("string") == F.lit(42).cast("string")) | ((c("page") == 7) & (c("id").cast("string") == "103"))).select("ord", "bank")


@_query(f"WITH {DOCS_SQL} SELECT ord FROM q WHERE chapter = (SELECT min(chapter) FROM q) AND page BETWEEN 10 AND 40")
def chapter_and_pages(spark, sf_dir):
    """The questions of one chapter in a range of pages."""
    d = docs(spark, sf_dir)
    return d.join(F.broadcast(d.agg(F.min("chapter").alias("chapter"))), "chapter", "left_semi").where(F.col("page").between(10, 40)).select("ord")


@_query(f"WITH {DOCS_SQL} SELECT ord FROM q WHERE bank = '660' AND type = '选择题' AND ord % 5 = 0 AND contains(lower(content), 'the')")
def viewer_filter(spark, sf_dir):
    """Bank, type, a feature and a search at once."""
    d = _sectioned(spark, sf_dir)
    return d.where((F.col("bank") == "660") & (F.col("type") == "选择题") & F.col("has_image") & F.lower("content").contains("the")).select("ord")


@_query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN doc_id % 97 END AS page, CASE WHEN doc_id % 5 > 0 THEN 'images/' || doc_id ELSE '' END AS path FROM documents WHERE doc_id IS NOT NULL),
f AS (SELECT DISTINCT 'images/' || doc_id AS path FROM labels WHERE doc_id IS NOT NULL)
SELECT doc_id, CASE WHEN page IS NULL THEN 'no page' WHEN r.path = '' THEN 'no image' WHEN f.path IS NULL THEN 'no file' END AS reason FROM r LEFT JOIN f ON r.path = f.path""")
def input_guards(spark, sf_dir):
    name = F.concat(F.lit("images/"), F.col("doc_id").cast("string"))
    d = _table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.when(F.col("doc_id") % 7 > 0, F.col("doc_id") % 97).alias("page"), F.when(F.col("doc_id") % 5 > 0, name).otherwise("").alias("path"))
    listed = _table(spark, sf_dir, "labels").where("doc_id is not null").select(name.alias("path"))
    return rebuild.guarded(d, "page", "path", listed).select("doc_id", "reason")


@_query(f"WITH {DOCS_SQL} SELECT page, count(*) AS n, string_agg(id, ',' ORDER BY ord) AS ids FROM q WHERE page % 9 > 0 GROUP BY page")
def questions_by_page(spark, sf_dir):
    """Questions of each page in order; those without a page are left out."""
    d = docs(spark, sf_dir).withColumn("page", F.when(F.col("page") % 9 > 0, F.col("page"))).where("page is not null")
    per = d.groupBy("page").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("o"))
    return per.select("page", "n", F.concat_ws(",", F.transform("o", lambda x: x["id"])).alias("ids"))


@_query(f"WITH {DOCS_SQL} SELECT DISTINCT page, bank FROM q")
def distinct_keys(spark, sf_dir):
    return docs(spark, sf_dir).select("page", "bank").distinct()


@_query(f"WITH {DOCS_SQL} SELECT bank, chapter, count(*) AS question_count FROM q GROUP BY ROLLUP (bank, chapter) HAVING chapter IS NOT NULL OR bank IS NULL")
def question_counts(spark, sf_dir):
    """Questions of each chapter of a bank, and their sum."""
    per = docs(spark, sf_dir).rollup("bank", "chapter").agg(F.count("*").alias("question_count"))
    return per.where("chapter is not null or bank is null")


@_query(f"""WITH {DOCS_SQL} SELECT ord, page - 15 AS printed, page + 15 AS pdf, {_quoted("题库 ")} || bank AS source, CASE WHEN ord % 3 = 0 THEN '无' ELSE 'n' END AS note, 'p' || page || '_q' || id || '.png' AS crop_name, 'images/' || id || '.png' AS image_path, 'crops/p' || page || '_' || id || '.jpg' AS crop_path FROM q""")
def derived_columns(spark, sf_dir):
    """Page arithmetic, defaults and output names; the minimal projection of a question."""
    note = F.coalesce(F.nullif(F.when(F.col("ord") % 3 == 0, "").otherwise("n"), F.lit("")), F.lit("无"))
    names = rebuild.output_names(F.col("page"), F.col("id"))
    return docs(spark, sf_dir).select("ord", (F.col("page") - 15).alias("printed"), (F.col("page") + 15).alias("pdf"), F.concat(F.lit("题库 "), "bank").alias("source"), note.alias("note"), *(c.alias(n) for n, c in names.items()))


@_query(f"WITH {DOCS_SQL} SELECT ord, coalesce(id, CAST(ord AS VARCHAR)) AS id, md5(content) AS content_md5 FROM q")
def minimal_questions(spark, sf_dir):
    return docs(spark, sf_dir).select("ord", F.coalesce("id", F.col("ord").cast("string")).alias("id"), F.md5("content").alias("content_md5"))
