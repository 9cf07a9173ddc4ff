"""Registered queries of marked pages, boxes, paths and publishing, beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import layout, marked, markers, relate, repair
from . import publish
from .queries import _STRIP, CHAPTERS, DOCS_SQL, ISSUES_SQL, _issues, _pick, _query, _spread, docs

#: what is appended to documents to make them marked pages, by id modulo their number
PAGES = (
    "", "\n基础题\n选择题\n(1) 设 x 大于零\n(2) 已知 y 小于一", "\n拓展题\n解答题\n设函数连续且可导，求它在零点的导数并证明它在整个区间上单调不减\n综合题", "\n综合题\n填空题\n3) 求极限的值\n(4) 短",
    "\n拓展题\n选择题\n如图所示\n(5) 计算定积分的值", "\n拓展题 填空题\n一、选择题\n二、填空题\n曲线的渐近线共有几条并说明理由如下",
)
_HEADING = "选择题|填空题|解答题|证明题|基础题|综合题|拓展题"


def _pages(spark, sf_dir, *more):
    pick = F.element_at(F.array(*map(F.lit, PAGES)), (F.col("ord") % len(PAGES) + 1).cast("int"))
    return docs(spark, sf_dir).select("ord", F.concat("content", pick).alias("text"), *more)


PIECES_SQL = rf"""{DOCS_SQL}, pg AS (SELECT ord, content || {_pick(PAGES, "ord")} AS t FROM q),
sp AS (SELECT ord, length(t) AS n_chars, string_split(regexp_replace(translate(t, chr(1) || chr(2), '  '), '{markers.MARKER}', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts FROM pg),
pt AS (SELECT ord, n_chars, unnest(parts) AS part, unnest(range(len(parts))) AS k FROM sp),
ps AS (SELECT *, CAST(coalesce(sum(length(replace(part, chr(2), ''))) OVER (PARTITION BY ord ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position FROM pt),
mk AS (SELECT ord, k, position, n_chars, split_part(part, chr(2), 1) AS marker, split_part(part, chr(2), 2) AS body,
  CASE WHEN split_part(part, chr(2), 1) IN ('基础题', '综合题', '拓展题') THEN 'section' WHEN split_part(part, chr(2), 1) IN ('选择题', '填空题', '解答题') THEN 'topic' ELSE 'question' END AS kind FROM ps WHERE k > 0)"""


@_query(f"WITH {PIECES_SQL} SELECT ord, position, kind, md5(marker) AS marker_md5, md5(body) AS body_md5 FROM mk")
def marker_pieces(spark, sf_dir):
    p = markers.pieces(_pages(spark, sf_dir), ("ord",))
    return p.select("ord", F.col("position").cast("long").alias("position"), "kind", F.md5("marker").alias("marker_md5"), F.md5("body").alias("body_md5"))


@_query(f"WITH {PIECES_SQL} SELECT ord, position, kind, md5(marker) AS marker_md5, md5(body) AS body_md5 FROM mk")
def marked_pieces(spark, sf_dir):
    """The same from SQL, by the table function."""
    marked.register(spark)
    return spark.sql("SELECT ord, position, kind, md5(marker) AS marker_md5, md5(body) AS body_md5 FROM marked(TABLE({pages}), 'text')", pages=_spread(_pages(spark, sf_dir)))


@_query(rf"""WITH {PIECES_SQL}, ch AS (SELECT doc_id AS ord, source AS chapter FROM documents WHERE doc_id IS NOT NULL),
of AS (SELECT ord, chapter, CAST(coalesce(sum(length(t)) OVER (PARTITION BY chapter ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM pg JOIN ch USING (ord))
SELECT ord, chapter, position, "offset", coalesce(last_value(CASE WHEN kind = 'section' THEN marker END IGNORE NULLS) OVER (PARTITION BY chapter ORDER BY ord, k), '基础题') AS section,
  coalesce(last_value(CASE kind WHEN 'section' THEN '选择题' WHEN 'topic' THEN marker END IGNORE NULLS) OVER (PARTITION BY chapter ORDER BY ord, k), '选择题') AS topic FROM mk JOIN of USING (ord)""")
def marked_chapters(spark, sf_dir):
    """Sections, topics and offsets that go on from page to page of a chapter: pages are cut by the table function, each by itself."""
    marked.register(spark)
    pages = _pages(spark, sf_dir, "chapter")
    found = spark.sql("SELECT ord, chapter, k, position, kind, marker FROM marked(TABLE({pages}), 'text')", pages=_spread(pages))
    return markers.carried(found, pages, "chapter", "ord").select("ord", "chapter", "position", "offset", "section", "topic")


QUESTIONS_SQL = rf"""{PIECES_SQL},
st AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'section' THEN marker END IGNORE NULLS) OVER (PARTITION BY ord ORDER BY k), '基础题') AS section,
  coalesce(last_value(CASE kind WHEN 'section' THEN '选择题' WHEN 'topic' THEN marker END IGNORE NULLS) OVER (PARTITION BY ord ORDER BY k), '选择题') AS topic,
  min(CASE WHEN kind = 'question' THEN position END) OVER (PARTITION BY ord ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_q, greatest(instr(body, chr(10)) - 1, 0) AS line FROM mk),
c AS (SELECT *, position + length(marker) + line AS stop, regexp_replace(CASE WHEN kind = 'question' THEN body ELSE substr(body, line + 1) END, {_STRIP}, '', 'g') AS content FROM st),
qs AS (SELECT ord, position, section, topic, CASE WHEN kind = 'question' THEN TRY_CAST(regexp_extract(marker, '\d+') AS INT) END AS number, content FROM c
WHERE NOT (length(content) <= 30 AND regexp_matches(content, '{_HEADING}')) AND (kind = 'question' AND length(content) >= 5
  OR kind = 'topic' AND section = '拓展题' AND n_chars - stop > 20 AND length(content) > 10 AND (next_q IS NULL OR next_q - stop > 100)))"""


@_query(f"WITH {QUESTIONS_SQL} SELECT ord, position, section, topic, number, md5(content) AS content_md5 FROM qs")
def marked_questions(spark, sf_dir):
    found = markers.questions(_pages(spark, sf_dir), ("ord",))
    return found.select("ord", F.col("position").cast("long").alias("position"), "section", "topic", "number", F.md5("content").alias("content_md5"))


@_query("SELECT conv_id, turn, CAST(coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_offset FROM conversations")
def page_offsets(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return markers.offsets(c, ("conv_id",), "turn").select("conv_id", "turn", F.col("offset").cast("long").alias("char_offset"))


_BOX = "l_orderkey, l_linenumber, l_partkey % 900 AS x, CAST(l_quantity * 3 AS BIGINT) AS w, l_suppkey % 90 + 20 AS h, l_partkey * 7 % 2200 AS y"


@_query(f"WITH b AS (SELECT {_BOX} FROM lineitem) SELECT l_orderkey, l_linenumber, x, y FROM b WHERE x BETWEEN 20 AND 700 AND w BETWEEN 50 AND 140 AND h BETWEEN 30 AND 80 AND w / h BETWEEN 1 AND 3 AND y >= 40 AND y <= 0.92 * 2339")
def plausible_boxes(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*_BOX.split(", "))
    c = F.col
    return b.where(layout.plausible(c("x"), c("y"), c("w"), c("h"), F.lit(2339), 700)).select("l_orderkey", "l_linenumber", "x", "y")


@_query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 90 * 8 + l_linenumber AS y, 40 AS h FROM lineitem), n AS (SELECT *, coalesce(lead(y) OVER (PARTITION BY l_orderkey ORDER BY y) - 15, 800) AS e FROM b)
SELECT l_orderkey, l_linenumber, y, CAST(CASE WHEN e > y THEN e ELSE least(y + h + 200, 800) END AS BIGINT) AS bottom FROM n""")
def crop_extents(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 90 * 8 + F.col("l_linenumber")).alias("y"), F.lit(40).alias("h"))
    return layout.crop_bottoms(b, ("l_orderkey",), "y", "h", F.lit(800)).select("l_orderkey", "l_linenumber", "y", F.col("bottom").cast("long").alias("bottom"))


@_query("""WITH n AS (SELECT l_orderkey, list_sort(list(l_partkey)) AS v FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY l_orderkey)
SELECT l.l_orderkey, l.l_linenumber, n.v[l.l_linenumber] AS number FROM lineitem l LEFT JOIN n ON l.l_orderkey = n.l_orderkey""")
def positional_numbers(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    lists = rows.where("l_linenumber % 2 = 1").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("v"))
    return relate.positioned(rows.drop("l_partkey"), lists, "l_orderkey", "l_linenumber", "v", "number")


@_query("""SELECT d.doc_id, CASE WHEN l.a THEN 'images/' || d.doc_id || '.png' WHEN l.b THEN 'crops/' || d.doc_id || '.jpg' END AS path
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS a, bool_or(toxic = 0) AS b FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id""")
def first_existing_path(spark, sf_dir):
    name = lambda kind, end: F.concat(F.lit(kind), F.col("doc_id").cast("string"), F.lit(end))
    wanted = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null").select("doc_id", F.array(name("images/", ".png"), name("crops/", ".jpg")).alias("paths"))
    files = spark.read.parquet(f"{sf_dir}/labels.parquet")
    listing = files.where("quality = 1").select(name("images/", ".png").alias("path")).union(files.where("toxic = 0").select(name("crops/", ".jpg").alias("path")))
    return relate.first_existing(wanted, listing, "doc_id", "paths")


@_query("""WITH p AS (SELECT o_orderkey % 50 AS page, 'patched-' || min(o_orderkey) AS note FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1),
r AS (SELECT o_orderkey, o_orderkey % 50 AS page, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderkey % 50, o_orderstatus ORDER BY o_orderkey) AS k FROM orders)
SELECT o_orderkey, page, o_orderstatus, coalesce(CASE WHEN k = 1 THEN p.note END, o_orderpriority) AS note FROM r LEFT JOIN p USING (page)""")
def update_first_in_group(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select("o_orderkey", (F.col("o_orderkey") % 50).alias("page"), "o_orderstatus", F.col("o_orderpriority").alias("note"))
    patches = rows.where("o_orderkey % 3 = 0").groupBy("page").agg(F.concat(F.lit("patched-"), F.min("o_orderkey").cast("string")).alias("note"))
    return relate.updated_first(rows, patches, ["page"], "o_orderstatus", "o_orderkey", "note")


@_query(f"WITH {ISSUES_SQL} SELECT code, count(*) AS n_issues, min(ord) AS first_ord, row_number() OVER (ORDER BY count(*) DESC, min(ord), code) AS place FROM i GROUP BY code")
def issue_codes_ordered(spark, sf_dir):
    """Codes by number, ties by the question that has them first; a window over a dozen codes."""
    from pyspark.sql import Window

    per = _issues(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n_issues"), F.min("ord").alias("first_ord"))
    place = F.row_number().over(Window.orderBy(F.desc("n_issues"), "first_ord", "code")).cast("long")
    return per.withColumn("place", place)


_KEYS_SQL = "CASE ord % 5 WHEN 1 THEN ['A', 'B', 'C', 'D'] WHEN 2 THEN ['A', 'B'] WHEN 3 THEN [] WHEN 4 THEN ['A', 'B', 'C', 'E'] END"


@_query(rf"""WITH {DOCS_SQL}, o AS (SELECT ord, type, content, {_KEYS_SQL} AS keys FROM q)
SELECT ord, 'missing_options' AS code FROM o WHERE type = '选择题' AND coalesce(len(keys), 0) = 0 UNION ALL SELECT ord, 'wrong_options' FROM o WHERE type = '选择题' AND len(keys) > 0 AND list_sort(keys) <> ['A', 'B', 'C', 'D']
UNION ALL SELECT ord, 'missing_blank' FROM o WHERE type = '填空题' AND NOT regexp_matches(content, '___+|\\_\\_+|\\underline\{{|\\quad|（[\s　]*）|\(\s*\)|□')""")
def type_issues(spark, sf_dir):
    letters = lambda s: F.map_from_arrays(F.array(*map(F.lit, s)), F.array(*map(F.lit, s)))
    n = F.col("ord") % 5
    options = F.when(n == 1, letters("ABCD")).when(n == 2, letters("AB")).when(n == 3, F.create_map().cast("map<string,string>")).when(n == 4, letters("ABCE"))
    d = docs(spark, sf_dir).withColumn("options", options)
    return d.select("ord", F.explode(rules.type_codes(F.col("type"), F.col("content"), F.col("options"))).alias("i")).select("ord", "i.code")


@_query("SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_images(spark, sf_dir):
    """Rows whose image file isn't in the listing."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null").select("doc_id", F.concat(F.lit("images/"), F.col("doc_id").cast("string")).alias("path"))
    listing = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.concat(F.lit("images/"), F.col("doc_id").cast("string")).alias("path"))
    return relate.remaining(d, listing, ["path"]).select("doc_id")


@_query(rf"WITH {DOCS_SQL} SELECT count(*) FILTER (regexp_matches(content, '[\x{{E000}}-\x{{F8FF}}]')) AS n_private, count(*) FILTER (regexp_matches(content, '如图|图所示|图\([a-z]\)')) AS n_image, count(*) FILTER (length(regexp_replace(content, {_STRIP}, '', 'g')) <= 30 AND regexp_matches(content, '{_HEADING}')) AS n_heading FROM q")
def text_counts(spark, sf_dir):
    t = F.col("content")
    return docs(spark, sf_dir).agg(F.count_if(t.rlike(r"[\x{E000}-\x{F8FF}]")).alias("n_private"), F.count_if(T.mentions_image(t)).alias("n_image"), F.count_if(T.is_heading(t)).alias("n_heading"))


@_query("SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS html_md5, md5(replace(replace(replace(replace(html, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), '')) AS js_md5, regexp_extract(url, '[^/]*$') AS base FROM pages")
def escaped_pages(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return p.select("page_id", F.md5(T.html_escaped(F.col("html"))).alias("html_md5"), F.md5(T.js_escaped(F.col("html"))).alias("js_md5"), T.base_name(F.col("url")).alias("base"))


@_query(f"""WITH {DOCS_SQL}, c AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{n}', {a}, {b})" for k, (n, a, b) in enumerate(CHAPTERS))}) v(o, name, lo, hi))
SELECT CAST(o AS INT) AS ord, name AS chapter, count(*) AS question_count FROM q JOIN c ON page BETWEEN lo AND hi GROUP BY o, name""")
def fixed_chapter_order(spark, sf_dir):
    """Questions of page 34 belong to no chapter and go."""
    ranges = spark.createDataFrame([(k, n, a, b) for k, (n, a, b) in enumerate(CHAPTERS)], "ord int, name string, start int, end int")
    named = relate.range_lookup(docs(spark, sf_dir).select("page"), ranges, "page", "in_chapter", "未知章节").select(F.col("in_chapter").alias("chapter"))
    return publish.in_fixed_order(named, ranges.select("ord", F.col("name").alias("chapter")))


def _behind_sql(text: str, opening: str, closing: str, end: str) -> str:
    """The rule in words: cut at the openings; the first stop before a closing, without a dollar before it, goes behind that closing."""
    at, rest = f"instr(p, '。{closing}')", f"substr(p, instr(p, '。{closing}') + 1)"
    until = f"(instr({rest}, '{end}') + {len(end) - 1})"
    known = f"i > 1 AND {at} > 1 AND NOT contains(left(p, {at} - 1), '$') AND instr({rest}, '{end}') > 0"
    return f"array_to_string(list_transform(string_split({text}, '{opening}'), lambda p, i: CASE WHEN {known} THEN left(p, {at} - 1) || left({rest}, {until}) || '。' || substr({rest}, {until} + 1) ELSE p END), '{opening}')"


def _ends_sql(i: str) -> str:
    return f"({i} > 1 AND {i} < len(d) AND length(d[{i}]) > 1 AND d[{i}][-1] = '。' AND NOT contains(d[{i}], '$'))"


@_query(rf"""WITH {DOCS_SQL}, s AS (SELECT ord, content || '$$x' || ord || '。$$ \[y。] \begin{{a}}z。\end{{a}}' AS t FROM q), e AS (SELECT ord, {_behind_sql("t", chr(92) + "begin{", chr(92) + "end{", "}")} AS t FROM s),
b AS (SELECT ord, string_split({_behind_sql("t", chr(92) + "[", "]", "]")}, '$$') AS d FROM e),
m AS (SELECT ord, array_to_string(list_transform(d, lambda p, i: CASE WHEN {_ends_sql("(i - 1)")} THEN '。' ELSE '' END || CASE WHEN {_ends_sql("i")} THEN left(p, length(p) - 1) ELSE p END), '$$') AS t FROM b)
SELECT ord, md5(array_to_string(list_transform(string_split(t, '=（'), lambda p, i: CASE WHEN i > 1 AND starts_with(ltrim(p, ' ' || chr(9) || chr(10) || chr(13)), '）$。') THEN '(' || chr(92) || 'quad)' || substr(ltrim(p, ' ' || chr(9) || chr(10) || chr(13)), 2) WHEN i > 1 THEN '（' || p ELSE p END), '=')) AS after_md5 FROM m""")
def repair_full_stops(spark, sf_dir):
    shown = docs(spark, sf_dir).select("ord", F.concat("content", F.lit("$$x"), F.col("ord").cast("string"), F.lit(r"。$$ \[y。] \begin{a}z。\end{a}")).alias("t"))
    return shown.select("ord", F.md5(repair.full_stops_outside(F.col("t"))).alias("after_md5"))
