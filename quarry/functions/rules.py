"""Quality rules: each a code, a severity and a predicate over a text and its math and plain parts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: fixed values: LaTeX commands, Unicode math symbols, full-width punctuation and blank markers
COMMANDS = ("sin", "cos", "tan", "ln", "log", "arcsin", "arccos", "arctan", "frac", "sqrt", "int", "sum", "lim", "alpha", "beta", "gamma", "pi", "infty", "leq", "geq", "neq", "to", "cdot", "partial")
SYMBOLS = "∫∑∏√∞≤≥≠→←⇒⇔αβγδεθλμπσφωΩ∂∆"
PUNCTUATION = "，。；：？！“”‘’（）【】《》"
#: one of SYMBOLS; characters outside their range are told by two comparisons
SYMBOL = rf"[\x{{{ord(min(SYMBOLS)):X}}}-\x{{{ord(max(SYMBOLS)):X}}}&&[{SYMBOLS}]]"
SUBSCRIPT = r"_\{\(_\{\d+\},_\{\d+\}\)\}"
BLANKS = r"___+|\\_\\_+|\\underline\{|\\quad|（[\s　]*）|\(\s*\)|□"


@dataclass(frozen=True)
class Rule:
    code: str
    severity: str
    holds: Callable[[Column, Column, Column], Column]  # text, math segments, plain text


def _some(test):
    return lambda t, m, p: F.exists(m, test)


def _in_plain(pattern: str):
    return lambda t, m, p: p.rlike(pattern)


RULES = (
    Rule("unbalanced_dollars", "critical", lambda t, m, p: (F.length(t) - F.length(F.replace(t, F.lit("$"), F.lit("")))) % 2 == 1),
    Rule("unbalanced_braces", "critical", _some(T.braces_unbalanced)),
    Rule("missing_dollar", "critical", _in_plain(r"(?<!\\)\\(?:" + "|".join(COMMANDS) + r")(?![A-Za-z0-9_\x{4E00}-\x{9FFF}])")),
    Rule("malformed_frac", "critical", _some(T.frac_malformed)),
    Rule("malformed_subscript", "critical", lambda t, m, p: t.contains("_{") & t.rlike(SUBSCRIPT)),
    Rule("empty_subscript", "warning", lambda t, m, p: t.contains("_{") & t.rlike(r"_\{\s*\}")),
    Rule("duplicated_var", "warning", _some(lambda s: F.regexp_replace(s, r"_\{?([a-z])\1\}?", "").rlike(r"(?<![a-z])([a-z])\1(?![a-z'])"))),
    Rule("unicode_math", "warning", _in_plain(SYMBOL)),
    Rule("pua_chars", "critical", lambda t, m, p: t.rlike(r"[\x{E000}-\x{F8FF}]")),
    Rule("chinese_in_math", "critical", _some(lambda s: T.without_text_commands(s).rlike(r"[\x{4E00}-\x{9FFF}]"))),
    Rule("chinese_punct_in_math", "critical", _some(lambda s: T.without_text_commands(s).rlike(f"[{PUNCTUATION}]"))),
    Rule("relation_at_start", "critical", _some(lambda s: s.rlike(r"\{\s*[=<>]"))),
)
SEVERITIES = ("critical", "warning", "info")
TYPE_RULES = ("options_type", "missing_options", "wrong_options", "missing_blank")


def codes(text: Column, rules=RULES) -> Column:
    """Array of (code, severity) of the rules that a text breaks, in rule order; null counts as empty.

    The text's math and plain parts are bound once, as the element of a one-element array, and shared by all rules.
    """
    t = F.coalesce(text, F.lit(""))
    # math starts at a delimiter or a backslash: what comes before the first one is plain
    tail = F.regexp_extract(t, r"(?s)[$\\].*", 0)

    def parted(x: Column) -> Column:
        t, tail = x["t"], x["tail"]
        busy = tail != ""
        math = F.when(busy, T.math_segments(tail)).otherwise(F.array().cast("array<string>"))
        # plain text is asked for commands and symbols alone
        asked = busy & (tail.contains("\\") | t.rlike(SYMBOL))
        plain = F.when(asked, F.concat(F.left(t, F.length(t) - F.length(tail)), T.plain_text(tail))).when(busy, F.lit("")).otherwise(t)
        return F.struct(t.alias("t"), math.alias("m"), plain.alias("p"))

    read = F.element_at(F.transform(F.array(F.struct(t.alias("t"), tail.alias("tail"))), parted), 1)

    def found(x: Column) -> Column:
        told = [F.when(r.holds(x["t"], x["m"], x["p"]), F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"))) for r in rules]
        return F.array_compact(F.array(*told))

    return F.element_at(F.transform(F.array(read), found), 1)


def type_codes(kind: Column, content: Column, options: Column) -> Column:
    """Issues that depend on the question's type; options is a map or null."""
    keys = F.array_sort(F.map_keys(options))
    none = options.isNull() | (F.size(options) == 0)
    choice, blank = kind == "选择题", kind == "填空题"
    one = lambda test, code, severity: F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    return F.array_compact(F.array(
        one(choice & none, "missing_options", "critical"),
        one(choice & ~none & (keys != F.array(*map(F.lit, "ABCD"))), "wrong_options", "warning"),
        one(blank & ~F.coalesce(content, F.lit("")).rlike(BLANKS), "missing_blank", "warning"),
    ))


def options_type(raw: Column) -> Column:
    """Array with options_type (code, severity) if a question's raw JSON options are a list that isn't empty."""
    listed = F.size(F.from_json(raw, "array<string>")) > 0
    issue = F.struct(F.lit("options_type").alias("code"), F.lit("critical").alias("severity"))
    return F.array_compact(F.array(F.when(raw.rlike(r"^\s*\[") & listed, issue)))


def issues(questions: DataFrame, key: str, content: str = "content", kind: str | None = "type", options: str | None = "options", raw_options: str | None = None) -> DataFrame:
    """(key, field, code, severity): one row per broken rule of the content, of each option and of the type.

    raw_options names a column of the options' JSON as it was read; lists are told there, which a map can't hold.
    """
    none = F.lit(None).cast("array<struct<code:string,severity:string>>")

    def fields(given: Column) -> Column:
        """The texts to be read, and the type's own issues beside them."""
        of = lambda name, text, own: F.struct(name.alias("field"), text.alias("text"), own.alias("own"))
        found = F.array(of(F.lit("content"), F.col(content), none))
        if options:
            each = F.map_entries(F.coalesce(given, F.create_map().cast("map<string,string>")))
            found = F.concat(found, F.transform(each, lambda e: of(F.concat(F.lit("option "), e["key"]), e["value"], none)))
        if kind and options:
            own = type_codes(F.col(kind), F.col(content), given)
            if raw_options:  # a list isn't missing
                listed = options_type(F.col(raw_options))
                own = F.concat(listed, F.when(F.size(listed) > 0, F.filter(own, lambda i: i["code"] != "missing_options")).otherwise(own))
            found = F.concat(found, F.array(of(F.lit("question"), F.lit(None).cast("string"), own)))
        return found

    # questions are read once; as the element of a one-element array, the options are worked out once for all their uses
    bound = F.element_at(F.transform(F.array(F.col(options)), fields), 1) if options else fields(none)
    rows = questions.select(key, F.explode(bound).alias("f"))
    rows = rows.select(key, "f.field", F.explode(F.coalesce(F.col("f.own"), codes(F.col("f.text")))).alias("i"))
    return rows.select(key, "field", "i.code", "i.severity")


def report(found: DataFrame, key: str) -> DataFrame:
    """(key, codes, severities) of the questions with an issue, to filter by either."""
    return found.groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("codes"), F.array_sort(F.collect_set("severity")).alias("severities"))
