"""Lenient JSON: ordered fallbacks from a direct parse to repaired text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def doubled_escapes(text: Column) -> Column:
    """Backslashes that JSON doesn't know are doubled; valid escapes, pairs included, stay."""
    return F.regexp_replace(text, r'(?<!\\)((?:\\\\)*)\\(?!["\\/bfnrt]|u[0-9a-fA-F]{4})', r"$1\\\\")


def without_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(text, r",\s*([}\]])", "$1")


def parsed(text: Column, schema: str) -> Column:
    """The first of the direct, unescaped, bracketed and comma-free readings that parses; null if none does."""
    inner = F.nullif(F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1), F.lit(""))
    tries = [text, doubled_escapes(text), inner, doubled_escapes(inner), without_trailing_commas(doubled_escapes(inner))]
    return F.from_json(F.coalesce(*(F.when(F.try_parse_json(t).isNotNull(), t) for t in tries)), schema)


def letters_escaped(text: Column) -> Column:
    r"""Inside strings, a backslash before a letter is doubled unless it begins \\uXXXX; so valid escapes such as \\n are doubled too.

    A quote after a backslash neither opens nor closes a string.
    """
    pieces = F.split(text, r'(?<!\\)"')
    fixed = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, r"\\(?=\p{L})(?!u[0-9a-fA-F]{4})", r"\\\\")).otherwise(p))
    return F.array_join(fixed, '"')


def parsed_object(text: Column) -> Column:
    """(ok, qnum, content, options) of the outermost braces, as they are or with letters escaped; else the raw text as content."""
    raw = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    tries = [raw, letters_escaped(raw)]
    found = F.coalesce(*(F.when(F.try_parse_json(t).isNotNull(), t) for t in tries))
    row = F.from_json(found, "qnum string, content string, options map<string,string>")
    options = F.coalesce(row["options"], F.create_map().cast("map<string,string>"))
    none = F.create_map().cast("map<string,string>")
    said = F.struct(F.lit(True).alias("ok"), row["qnum"].alias("qnum"), T.strip(F.coalesce(row["content"], F.lit(""))).alias("content"), options.alias("options"))
    return F.when(found.isNotNull(), said).otherwise(F.struct(F.lit(False).alias("ok"), F.lit(None).cast("string").alias("qnum"), text.alias("content"), none.alias("options")))
