"""The curation library's registered queries, each with the DuckDB SQL it is held against.

Question-shaped rows are derived from the driver's tables by the same rule on both sides: a defect or a question's text is
appended to each whole document by its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lenient, rules
from ..functions import text as T
from ..operators import normalize, relate, repair, sequence
from . import publish

BANKS = ("660", "880", "1000", "大学深埋")
KINDS = ("选择题", "填空题", "计算题")
#: what is appended to documents, by id modulo their number
TAILS = (
    "", " 设$x", r" $\frac{1}{2$ ", r" \sin x ", r" $x_{(_{0},_{1})}$ ", r" $a_{ }$ ", " $f(xx)$ ", " x≤1 ", " a\ue000b ", " $令x$ ", " $x，y$ ", r" $\text{其中，}x$ ", r" $\frac{=1}{2}$ ",
    "\n题干\nA. 1\nB. 2\nC. 3\nD. 4", r" 为\_\_\_\_$。", "  a\n\n\n\nb  c ", " <think>no</think>yes ", " 求 ____ ", " · 第3页，共9页 · ", r" $\frac{1}2$ ", " 证明:$a$$b$ ", " 续 综合题",
)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    i = F.col("doc_id")
    return d.where("doc_id is not null").select(
        i.alias("ord"), pick(BANKS, i).alias("bank"), F.col("source").alias("chapter"), (i % 97 + 1).cast("int").alias("page"), pick(KINDS, i).alias("type"),
        F.concat(F.coalesce("text", F.lit("")), pick(TAILS, i)).alias("content"), i.cast("string").alias("id"),
    )


def _spread(rows: DataFrame) -> DataFrame:
    """Over all cores: an input of fewer splits than cores is dealt out before the rules read its texts; others stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _pick(values, n: str) -> str:
    return f"[{', '.join(map(_quoted, values))}][CAST({n} % {len(values)} AS INT) + 1]"


DOCS_SQL = f"""q AS (SELECT doc_id AS ord, {_pick(BANKS, "doc_id")} AS bank, source AS chapter, CAST(doc_id % 97 + 1 AS INT) AS page, {_pick(KINDS, "doc_id")} AS type,
  coalesce(text, '') || {_pick(TAILS, "doc_id")} AS content, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id IS NOT NULL)"""

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_DOUBLES = "|".join(c * 2 for c in _LETTERS)
_BREAKS = r"(?s)\$\$(?:(.*?)\$\$|(.*)\z)|\\\((?:(.*?)\\\)|(.*)\z)|\\\[(?:(.*?)\\\]|(.*)\z)|\$(?:([^$]*)\$|(.*)\z)"
_BARE = r"list_transform(m, lambda s: regexp_replace(s, '\\text\{[^}]*\}', '', 'g'))"


def _any(values: str, test: str) -> str:
    return f"len(list_filter({values}, lambda s: {test})) > 0"


_REST = r"array_to_string(regexp_split_to_array(s, '\\frac\s*\{')[i:], '\frac{')"
_CLOSES = rf"list_filter(range(1, length({_REST}) + 1), lambda j: length(replace(left({_REST}, j), '{{', '')) - length(replace(left({_REST}, j), '}}', '')) = 1)[1]"
#: what each rule tests in SQL (t: text, m: math segments, p: plain text)
RULE_SQL = {
    "unbalanced_dollars": "(length(t) - length(replace(t, '$', ''))) % 2 = 1",
    "unbalanced_braces": _any("m", "len(list_filter(range(1, length(s) + 1), lambda i: length(replace(left(s, i), '{', '')) > length(replace(left(s, i), '}', '')))) > 0 OR length(replace(s, '{', '')) <> length(replace(s, '}', ''))"),
    "missing_dollar": rf"regexp_matches(p, '(?:^|[^\\])\\(?:{'|'.join(rules.COMMANDS)})(?:$|[^A-Za-z0-9_\x{{4E00}}-\x{{9FFF}}])')",
    "malformed_frac": _any("m", rf"len(list_filter(range(2, len(regexp_split_to_array(s, '\\frac\s*\{{')) + 1), lambda i: coalesce(substr({_REST}, {_CLOSES} + 1, 1), '') <> '{{')) > 0"),
    "malformed_subscript": r"regexp_matches(t, '_\{\(_\{\d+\},_\{\d+\}\)\}')",
    "empty_subscript": r"regexp_matches(t, '_\{\s*\}')",
    "duplicated_var": _any("m", rf"regexp_matches(regexp_replace(s, '_\{{?(?:{_DOUBLES})\}}?', '', 'g'), '(?:^|[^a-z])(?:{_DOUBLES})(?:$|[^a-z''])')"),
    "unicode_math": f"regexp_matches(p, '[{rules.SYMBOLS}]')",
    "pua_chars": r"regexp_matches(t, '[\x{E000}-\x{F8FF}]')",
    "chinese_in_math": _any(_BARE, r"regexp_matches(s, '[\x{4E00}-\x{9FFF}]')"),
    "chinese_punct_in_math": _any(_BARE, f"regexp_matches(s, '[{rules.PUNCTUATION}]')"),
    "relation_at_start": _any("m", r"regexp_matches(s, '\{\s*[=<>]')"),
}
_SEVERITY = {r.code: r.severity for r in rules.RULES}
ISSUES_SQL = (
    DOCS_SQL
    + f""",
s AS (SELECT ord, content AS t, list_filter(list_concat({", ".join(f"regexp_extract_all(content, '{_BREAKS}', {k})" for k in (1, 3, 5, 7))}), lambda s: s IS NOT NULL AND s <> '') AS m,
  regexp_replace(content, '{_BREAKS}', chr(1) || '\\2\\4\\6\\8', 'g') AS p FROM q),
f AS (SELECT ord, unnest([{", ".join(f"CASE WHEN {test} THEN {_quoted(code)} END" for code, test in RULE_SQL.items())}]) AS code FROM s),
i AS (SELECT ord, code, CASE WHEN code IN ({", ".join(_quoted(c) for c, s in _SEVERITY.items() if s == "warning")}) THEN 'warning' ELSE 'critical' END AS severity FROM f WHERE code IS NOT NULL)"""
)


_MARKED = r"string_split(regexp_replace(translate(content, chr(1) || chr(2), '  '), '([A-D])[.．、]', chr(1) || '\1' || chr(2), 'g'), chr(1))[2:]"
#: the same over the content and each option that it holds, and the rules of the question's type
WHOLE_SQL = (
    DOCS_SQL
    + f""",
o AS (SELECT ord, {_MARKED} AS p FROM q),
x AS (SELECT ord, content FROM q {" ".join(f"UNION ALL SELECT ord, split_part(list_filter(p, lambda z: starts_with(z, '{k}'))[-1], chr(2), 2) FROM o WHERE len(list_filter(p, lambda z: starts_with(z, '{k}'))) > 0" for k in "ABCD")}),
"""
    + ISSUES_SQL[len(DOCS_SQL) + 2 :].replace("FROM q", "FROM x").replace("\ni AS (", "\nw AS (")
    + r""",
i AS (SELECT ord, code, severity FROM w UNION ALL SELECT ord, 'missing_options', 'critical' FROM q JOIN o USING (ord) WHERE type = '选择题' AND len(p) = 0
UNION ALL SELECT ord, 'wrong_options', 'warning' FROM q JOIN o USING (ord) WHERE type = '选择题' AND len(p) > 0 AND list_sort(list_distinct(list_transform(p, lambda z: left(z, 1)))) <> ['A', 'B', 'C', 'D']
UNION ALL SELECT ord, 'missing_blank', 'warning' FROM q WHERE type = '填空题' AND NOT regexp_matches(content, '___+|\\_\\_+|\\underline\{|\\quad|（[\s　]*）|\(\s*\)|□'))"""
)


def _issues(spark, sf_dir, told=rules.RULES):
    return _spread(docs(spark, sf_dir)).select("ord", F.explode(rules.codes(F.col("content"), told)).alias("i")).select("ord", "i.code", "i.severity")


QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _by_severity(spark, issues):
    """One row per question and severity first, so counting questions needs no distinct."""
    per = issues.groupBy("severity", "ord").agg(F.count("*").alias("n")).groupBy("severity").agg(F.sum("n").alias("n"), F.count("*").alias("q"))
    known = spark.createDataFrame([(s,) for s in rules.SEVERITIES], "severity string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return known.join(F.broadcast(per), "severity", "left").select("severity", zero(F.col("n")).alias("n_issues"), zero(F.col("q")).alias("n_questions"))


@_query(f"WITH {ISSUES_SQL} SELECT code, severity, count(*) AS n_issues FROM i GROUP BY code, severity")
def quality_summary(spark, sf_dir):
    return _issues(spark, sf_dir).groupBy("code", "severity").agg(F.count("*").alias("n_issues"))


@_query(f"WITH {ISSUES_SQL} SELECT s.severity, count(i.ord) AS n_issues, count(DISTINCT i.ord) AS n_questions FROM (VALUES ('critical'), ('warning'), ('info')) s(severity) LEFT JOIN i ON i.severity = s.severity GROUP BY s.severity")
def issues_by_severity(spark, sf_dir):
    return _by_severity(spark, _issues(spark, sf_dir))


@_query(f"WITH {ISSUES_SQL} SELECT ord, string_agg(code, ',' ORDER BY code) AS codes FROM i GROUP BY ord")
def quality_report(spark, sf_dir):
    # as the row of a generator, a text's codes are found once however often they are asked for
    found = _spread(docs(spark, sf_dir)).select("ord", F.explode(F.array(rules.codes(F.col("content")))).alias("c"))
    return found.where(F.size("c") > 0).select("ord", F.concat_ws(",", F.array_sort("c.code")).alias("codes"))


def _all_issues(spark, sf_dir):
    """Every rule over content, options and type. The options are those that the content holds, or null."""
    d = _spread(docs(spark, sf_dir))
    return rules.issues(d.withColumn("options", T.options(F.col("content"))), "ord")


@_query(f"WITH {WHOLE_SQL} SELECT code, severity, count(*) AS n_issues FROM i GROUP BY code, severity")
def quality_summary_whole(spark, sf_dir):
    return _all_issues(spark, sf_dir).groupBy("code", "severity").agg(F.count("*").alias("n_issues"))


@_query(f"WITH {WHOLE_SQL} SELECT s.severity, count(i.ord) AS n_issues, count(DISTINCT i.ord) AS n_questions FROM (VALUES ('critical'), ('warning'), ('info')) s(severity) LEFT JOIN i ON i.severity = s.severity GROUP BY s.severity")
def issues_by_severity_whole(spark, sf_dir):
    return _by_severity(spark, _all_issues(spark, sf_dir))


@_query(f"WITH {WHOLE_SQL} SELECT ord, string_agg(code, ',' ORDER BY code) AS codes FROM i GROUP BY ord")
def quality_report_whole(spark, sf_dir):
    """Each question's codes, one for each field that breaks the rule."""
    return _all_issues(spark, sf_dir).groupBy("ord").agg(F.concat_ws(",", F.array_sort(F.collect_list("code"))).alias("codes"))


@_query(f"WITH {ISSUES_SQL} SELECT ord, code, severity FROM i WHERE code = 'malformed_frac'")
def malformed_frac(spark, sf_dir):
    only = tuple(r for r in rules.RULES if r.code == "malformed_frac")
    return _issues(spark, sf_dir, only)


@_query(f"WITH {ISSUES_SQL} SELECT ord, CAST(len(m) AS BIGINT) AS n_segments, CAST(coalesce(list_sum(list_transform(m, lambda s: length(s))), 0) AS BIGINT) AS n_chars FROM s")
def math_segments(spark, sf_dir):
    m = T.math_segments(F.col("content"))
    return docs(spark, sf_dir).select("ord", F.size(m).cast("long").alias("n_segments"), F.length(F.array_join(m, "")).cast("long").alias("n_chars"))


_STRIP = r"'^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$'"
_CLEAN = rf"regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(content, '[\x{{E000}}-\x{{F8FF}}]', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), lambda l: regexp_replace(l, {_STRIP}, '', 'g')), chr(10)), '  +', ' ', 'g'), {_STRIP}, '', 'g')"


@_query(f"WITH {DOCS_SQL} SELECT ord, md5({_CLEAN}) AS clean_md5 FROM q")
def clean_text(spark, sf_dir):
    return _spread(docs(spark, sf_dir)).select("ord", F.md5(T.clean_text(F.col("content"))).alias("clean_md5"))


@_query(rf"""WITH {DOCS_SQL} SELECT CASE WHEN regexp_matches(content, '\n\s*A[.．、]') OR contains(content, '(A)') OR contains(content, '（A）') THEN '选择题' WHEN contains(content, '____') OR contains(lower(content), 'underline') THEN '填空题'
  WHEN starts_with(ltrim(content), '证明') OR contains(content, '证明:') OR contains(content, '证明：') THEN '证明题' ELSE '计算题' END AS type, count(*) AS n FROM q GROUP BY 1""")
def classify_type(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(T.question_type(F.col("content")).alias("type")).agg(F.count("*").alias("n"))


_OPTION_SQL = "list_filter(p, lambda x: starts_with(x, '{}'))"
_OPTIONS_SQL = " || ".join(f"CASE WHEN len({_OPTION_SQL.format(k)}) > 0 THEN '{k}=' || regexp_replace(split_part({_OPTION_SQL.format(k)}[-1], chr(2), 2), {_STRIP}, '', 'g') || ';' ELSE '' END" for k in "ABCD")


@_query(rf"""WITH {DOCS_SQL}, o AS (SELECT ord, content, string_split(regexp_replace(translate(content, chr(1) || chr(2), '  '), '([A-D])[.．、]', chr(1) || '\1' || chr(2), 'g'), chr(1))[2:] AS p FROM q WHERE regexp_matches(content, '\n\s*A[.．、]'))
SELECT ord, {_OPTIONS_SQL} AS options, md5(regexp_replace(regexp_split_to_array(content, '[A-D][.．、]')[1], {_STRIP}, '', 'g')) AS stem_md5 FROM o""")
def extract_options(spark, sf_dir):
    """Options of the texts that have a marker on a line of its own."""
    d = docs(spark, sf_dir).where(F.col("content").rlike(r"\n\s*A[.．、]"))
    told = F.concat(*(F.coalesce(F.concat(F.lit(f"{k}="), F.try_element_at("o", F.lit(k)), F.lit(";")), F.lit("")) for k in "ABCD"))
    return d.select("ord", T.options(F.col("content")).alias("o"), F.md5(T.stem(F.col("content"))).alias("stem_md5")).select("ord", told.alias("options"), "stem_md5")


@_query(rf"WITH {DOCS_SQL} SELECT ord, md5(regexp_replace(regexp_replace(content, '(?s)<think>.*?</think>', '', 'g'), {_STRIP}, '', 'g')) AS said_md5 FROM q")
def strip_think(spark, sf_dir):
    return docs(spark, sf_dir).select("ord", F.md5(T.without_think(F.col("content"))).alias("said_md5"))


@_query(f"WITH {DOCS_SQL} SELECT ord, left(sha256(content), 8) AS stamp FROM q")
def content_stamp(spark, sf_dir):
    return docs(spark, sf_dir).select("ord", T.stamp(F.col("content")).alias("stamp"))


@_query(rf"WITH {DOCS_SQL}, r AS (SELECT ord, content, regexp_replace(content, '_\{{\(_\{{(\d+)\}},_\{{(\d+)\}}\)\}}', '_{{(\1,\2)}}', 'g') AS fixed FROM q) SELECT ord, md5(fixed) AS after_md5 FROM r WHERE fixed <> content")
def repair_subscripts(spark, sf_dir):
    return repair.dry_run(docs(spark, sf_dir), "ord", "content", repair.subscripts).select("ord", F.md5("after").alias("after_md5"))


@_query(rf"""WITH {DOCS_SQL}, r AS (SELECT ord, content, CASE WHEN (length(content) - length(replace(content, '$', ''))) % 2 = 1 AND regexp_matches(content, '\\_\$。$') THEN
  CASE WHEN regexp_matches(content, '\$(?:\\_)+\$。$') THEN regexp_replace(content, '\$((?:\\_)+)\$。$', '\1$。') ELSE regexp_replace(content, '((?:\\_)+)\$。$', '$\1$。') END ELSE content END AS fixed FROM q)
  SELECT ord, md5(fixed) AS after_md5 FROM r WHERE fixed <> content""")
def repair_blanks(spark, sf_dir):
    return repair.dry_run(docs(spark, sf_dir), "ord", "content", repair.blank_suffix).select("ord", F.md5("after").alias("after_md5"))


_UID = "CASE bank WHEN '660' THEN '660-' || ord WHEN '大学深埋' THEN concat_ws('-', bank, chapter, id, 'p' || page) ELSE concat_ws('-', bank, chapter, id) END"


@_query(f"WITH {DOCS_SQL} SELECT ord, {_UID} AS uid FROM q")
def uid_keys(spark, sf_dir):
    return docs(spark, sf_dir).select("ord", normalize.uid(F.col("bank"), F.col("ord"), F.col("id"), F.col("chapter"), F.col("page")).alias("uid"))


@_query(f"WITH {DOCS_SQL} SELECT concat_ws('-', bank, page) AS uid, count(*) AS n FROM q GROUP BY 1 HAVING count(*) > 1")
def uid_duplicates(spark, sf_dir):
    """Keys by bank and page alone repeat; each is told with its number."""
    return docs(spark, sf_dir).groupBy(F.concat_ws("-", "bank", F.col("page").cast("string")).alias("uid")).agg(F.count("*").alias("n")).where("n > 1")


@_query(f"WITH {DOCS_SQL} SELECT ord, CAST(row_number() OVER (PARTITION BY chapter ORDER BY ord) AS VARCHAR) AS number FROM q")
def renumber_in_chapter(spark, sf_dir):
    return sequence.numbered(docs(spark, sf_dir).select("ord", "chapter"), "ord", ("chapter",)).select("ord", F.col("number").cast("string").alias("number"))


@_query(f"WITH {DOCS_SQL} SELECT ord, row_number() OVER (ORDER BY ord) AS number FROM q")
def global_ids(spark, sf_dir):
    return sequence.numbered(docs(spark, sf_dir).select("ord"), "ord").select("ord", F.col("number").cast("long").alias("number"))


@_query(f"WITH {DOCS_SQL}, c AS (SELECT page, count(*) AS n FROM q GROUP BY page) SELECT page, n, CAST(461 + coalesce(sum(n) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c")
def page_running_numbers(spark, sf_dir):
    counts = docs(spark, sf_dir).groupBy("page").agg(F.count("*").alias("n"))
    return sequence.running_start(counts, "page", "n", 461).select("page", "n", F.col("start").cast("long").alias("start"))


@_query("""WITH p AS (SELECT o_custkey AS book, CAST(o_orderkey AS BIGINT) AS page, o_orderkey % 3 = 0 AS known FROM orders), n AS (SELECT book, page, known, row_number() OVER (PARTITION BY book ORDER BY page) AS k FROM p),
g AS (SELECT book, k, CASE WHEN known THEN k * 4 END AS first, CASE WHEN known THEN k * 4 + 1 END AS last FROM n),
w AS (SELECT *, max(CASE WHEN first IS NOT NULL THEN k END) OVER a AS pk, max(last) OVER a AS pl, min(CASE WHEN first IS NOT NULL THEN k END) OVER b AS nk, min(first) OVER b AS nf FROM g
  WINDOW a AS (PARTITION BY book ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY book ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
s AS (SELECT *, nf - pl - 1 AS missing, nk - pk - 1 AS gap FROM w), t AS (SELECT *, CAST(round_even(missing / gap, 0) AS BIGINT) AS share FROM s)
SELECT book, k AS page, CASE WHEN first IS NOT NULL THEN first || ',' || last WHEN gap > 0 AND missing >= gap THEN array_to_string(range(pl + 1 + (k - pk - 1) * share, least(pl + (k - pk) * share, nf - 1) + 1), ',') END AS numbers FROM t""")
def gap_fill_pages(spark, sf_dir):
    from pyspark.sql import Window

    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("key"))
    pages = o.withColumn("page", F.row_number().over(Window.partitionBy("book").orderBy("key")).cast("long"))
    known = F.array((F.col("page") * 4).cast("int"), (F.col("page") * 4 + 1).cast("int"))
    pages = pages.select("book", "page", F.when(F.col("key") % 3 == 0, known).alias("numbers"))
    filled = sequence.filled_gaps(pages, ("book",))
    return filled.select("book", "page", F.when(F.col("numbers").isNotNull(), F.concat_ws(",", F.transform("numbers", lambda n: n.cast("string")))).alias("numbers"))


@_query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS section FROM conversations")
def section_forward_fill(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("mark"))
    return sequence.filled_forward(c, "mark", "turn", ("conv_id",), -1, "section").select("conv_id", "turn", "section")


@_query("""WITH m AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 700 * 8 + l_linenumber AS BIGINT) AS y FROM lineitem) SELECT l_orderkey, l_linenumber, greatest(0, y - 10) AS top, coalesce(lead(y) OVER (PARTITION BY l_orderkey ORDER BY y) - 4, 6000) AS bottom FROM m""")
def lead_regions(spark, sf_dir):
    m = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 700 * 8 + F.col("l_linenumber")).alias("y"))
    return sequence.regions(m, ("l_orderkey",), "y", F.lit(6000)).select("l_orderkey", "l_linenumber", "top", "bottom")


@_query("""WITH RECURSIVE v AS (SELECT l_orderkey, list_sort(list(l_partkey % 400)) AS y FROM lineitem GROUP BY l_orderkey),
r AS (SELECT l_orderkey, y, 1 AS k, [y[1]] AS starts FROM v UNION ALL SELECT l_orderkey, y, k + 1, CASE WHEN y[k + 1] - starts[-1] > 60 THEN list_append(starts, y[k + 1]) ELSE starts END FROM r WHERE k < len(y))
SELECT l_orderkey, array_to_string(starts, ',') AS starts FROM r WHERE k = len(y)""")
def cluster_by_gap(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey") % 400).alias("y"))
    return v.select("l_orderkey", F.concat_ws(",", F.transform(sequence.cluster_starts(F.col("y")), lambda x: x.cast("string"))).alias("starts"))


@_query("""WITH RECURSIVE v AS (SELECT l_orderkey, list_sort(list({'y': l_partkey % 900, 'h': CAST(40 AS BIGINT)})) AS y FROM lineitem GROUP BY l_orderkey),
r AS (SELECT l_orderkey, y, 1 AS k, [y[1].y] AS kept FROM v UNION ALL SELECT l_orderkey, y, k + 1, CASE WHEN y[k + 1].y - (kept[-1] + 40) >= 150 THEN list_append(kept, y[k + 1].y) ELSE kept END FROM r WHERE k < len(y))
SELECT l_orderkey, array_to_string(kept, ',') AS kept FROM r WHERE k = len(y)""")
def thin_by_gap(spark, sf_dir):
    box = F.struct((F.col("l_partkey") % 900).alias("y"), F.lit(40).cast("long").alias("h"))
    v = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(box).alias("b"))
    return v.select("l_orderkey", F.concat_ws(",", F.transform(sequence.thinned(F.col("b")), lambda x: x["y"].cast("string"))).alias("kept"))


#: fixed values: closed page ranges of the chapters (page 34 belongs to none) and of the question types
CHAPTERS = (("第一章 函数·极限·连续", 2, 13), ("第二章 一元函数微分学", 14, 33), ("第三章 一元函数积分学", 35, 58), ("第四章 多元函数微分学", 59, 68), ("第五章 二重积分", 69, 78), ("第六章 微分方程", 79, 89))
PAGE_TYPES = (("填空题", 1, 69), ("选择题", 70, 999))


def _ranges(spark, values):
    return spark.createDataFrame([(k, n, a, b) for k, (n, a, b) in enumerate(values)], "ord int, name string, start int, end int")


def _ranges_sql(values) -> str:
    return "(VALUES " + ", ".join(f"({_quoted(n)}, {a}, {b})" for n, a, b in values) + ") r(name, lo, hi)"


@_query(f"WITH {DOCS_SQL} SELECT ord, page, coalesce(r.name, '未知章节') AS chapter_name FROM q LEFT JOIN {_ranges_sql(CHAPTERS)} ON page BETWEEN lo AND hi")
def range_join_chapter(spark, sf_dir):
    return relate.range_lookup(docs(spark, sf_dir).select("ord", "page"), _ranges(spark, CHAPTERS), "page", "chapter_name", "未知章节")


@_query(f"WITH {DOCS_SQL} SELECT ord, r.name AS page_type FROM q LEFT JOIN {_ranges_sql(PAGE_TYPES)} ON page - 15 BETWEEN lo AND hi")
def type_range(spark, sf_dir):
    d = docs(spark, sf_dir).select("ord", (F.col("page") - 15).alias("printed"))
    return relate.range_lookup(d, _ranges(spark, PAGE_TYPES), "printed", "page_type").select("ord", "page_type")


@_query(f"""WITH {DOCS_SQL}, f AS (SELECT DISTINCT CAST(page_id % 12 * 8 + 1 AS INT) AS spot FROM pages), n AS (SELECT ord, spot, abs(spot - page) AS d, row_number() OVER (PARTITION BY ord ORDER BY abs(spot - page), spot) AS k FROM q JOIN f ON abs(spot - page) <= 3)
SELECT q.ord, n.spot AS nearest, n.d AS distance FROM q LEFT JOIN n ON q.ord = n.ord AND k = 1""")
def nearest_figure(spark, sf_dir):
    figures = spark.read.parquet(f"{sf_dir}/pages.parquet").select((F.col("page_id") % 12 * 8 + 1).cast("int").alias("at"))
    return relate.nearest(docs(spark, sf_dir).select("ord", "page"), figures, "ord", "page", "at").select("ord", "nearest", "distance")


@_query("""WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'user'),
b AS (SELECT conv_id, turn AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role <> 'user')
SELECT conv_id, CAST(position AS BIGINT) AS position, turn, answer FROM a JOIN b USING (conv_id, position, n)""")
def zip_join_guarded(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    paired, _ = relate.zip_guarded(c.where("role = 'user'").select("conv_id", "turn"), c.where("role <> 'user'").select("conv_id", F.col("turn").alias("answer")), "conv_id", "turn", "answer")
    return paired.select("conv_id", F.col("position").cast("long").alias("position"), "turn", "answer")


@_query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def pending_work(spark, sf_dir):
    return relate.remaining(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id"])


@_query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_by_key(spark, sf_dir):
    return relate.latest(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@_query("SELECT d.doc_id, coalesce(CASE WHEN l.quality = 0 THEN 'patched' END, d.source) AS source FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id")
def apply_patches(spark, sf_dir):
    patches = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("q")).select("doc_id", F.when(F.col("q") == 0, "patched").otherwise("").alias("source"))
    return relate.updated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), patches, "doc_id", ("source",))


@_query("SELECT source_ord, id, row_number() OVER (ORDER BY source_ord, id) AS number FROM (SELECT 0 AS source_ord, item_id AS id FROM benchmark UNION ALL SELECT 1, page_id FROM pages)")
def union_reid(spark, sf_dir):
    left = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"))
    right = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"))
    both = relate.union_numbered([left, right], "id").withColumn("_order", F.col("source_ord").cast("long") * (1 << 40) + F.col("id"))
    return sequence.numbered(both, "_order").select("source_ord", "id", F.col("number").cast("long").alias("number"))


@_query(f"WITH {DOCS_SQL}, c AS (SELECT bank, chapter, count(*) AS n FROM q GROUP BY bank, chapter) SELECT bank, CAST(sum(n) AS BIGINT) AS questions, count(*) AS chapters FROM c GROUP BY ROLLUP (bank)")
def bank_stats(spark, sf_dir):
    return publish.statistics(docs(spark, sf_dir))


@_query(f"WITH {DOCS_SQL} SELECT chapter, count(*) FILTER (type = '选择题') AS choice, count(*) FILTER (type = '填空题') AS blank, count(*) FILTER (type = '计算题') AS compute, min(page) AS first_page, max(page) AS last_page FROM q GROUP BY chapter")
def section_histogram(spark, sf_dir):
    n = lambda kind, name: F.count_if(F.col("type") == kind).alias(name)
    return docs(spark, sf_dir).groupBy("chapter").agg(n("选择题", "choice"), n("填空题", "blank"), n("计算题", "compute"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


@_query("SELECT conv_id, count(*) AS question_count, md5(string_agg(turn || ':' || role, ',' ORDER BY turn)) AS questions_md5 FROM conversations GROUP BY conv_id")
def nest_chapters(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.count("*").alias("question_count"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("q"))
    return c.select("conv_id", "question_count", F.md5(F.concat_ws(",", F.transform("q", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"])))).alias("questions_md5"))


@_query(f"WITH {DOCS_SQL} SELECT ord FROM q WHERE contains(lower(content), 'the') AND bank = '660'")
def search_filter(spark, sf_dir):
    return docs(spark, sf_dir).where(F.lower("content").contains("the") & (F.col("bank") == "660")).select("ord")


@_query(f"WITH {DOCS_SQL} SELECT ord FROM q ORDER BY md5('7' || ord), ord LIMIT 20")
def deterministic_sample(spark, sf_dir):
    """Twenty questions drawn by hash; the limit is the feature."""
    return docs(spark, sf_dir).select("ord").orderBy(F.md5(F.concat(F.lit("7"), F.col("ord").cast("string"))), "ord").limit(20)


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events WHERE json_valid(props)")
def lenient_json(spark, sf_dir):
    """Trailing commas are put in and repaired again."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.regexp_replace("props", r"\}$", ",}").alias("props"))
    return e.select("event_id", lenient.parsed(F.col("props"), "k string")["k"].alias("k"))
