"""A partitioned table function: pages cut at their markers, called from SQL, with what a chapter carries from page to page.

    SELECT * FROM marked(TABLE(pages) PARTITION BY chapter ORDER BY (page), 'text')

Rows of a partition come in order and one at a time, so a chapter may be longer than a task's memory; it is one task's
work though. Without PARTITION BY, pages stay where they are and only what hangs on one page is meant to be read: number,
position, kind, marker and body. ``markers.carried`` then tells the rest, no chapter in one task.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import markers

TOLD = (("k", LongType()), ("position", LongType()), ("offset", LongType()), ("kind", StringType()), ("marker", StringType()), ("body", StringType()), ("section", StringType()), ("topic", StringType()))
#: markers.MARKER in two: what starts a page, and what every other marker starts with is one of a few characters to look for.
#: A line break behind another one starts none that the first doesn't start.
_NUMBER = r"\s*+(?:\(\s*+)?0*[1-9]\d*\)\s*"
_FIRST = re.compile(_NUMBER, re.ASCII)
_MARKER = re.compile("|".join(markers.SECTIONS + markers.TOPICS) + r"|\n(?<!\n\n)" + _NUMBER, re.ASCII)


def _found(page: str) -> list[re.Match]:
    first = _FIRST.match(page)
    return [*([first] if first else []), *_MARKER.finditer(page, first.end() if first else 0)]


class _Marked:
    """For each marker of a text: its number and position on the page, the characters of the partition's pages before, and what it opens.

    Beside these come the table's other columns. A null text has no marker. Section and topic are those the marker stands
    in, carried over the partition's pages; a section starts with the first topic.
    """

    def __init__(self):
        self.offset, self.section, self.topic = 0, markers.SECTIONS[0], markers.TOPICS[0]

    @staticmethod
    def analyze(pages: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        if not pages.isTable:
            raise ValueError("the first argument is a table, as TABLE(...)")
        if not text.isConstantExpression or text.value not in pages.dataType.names:
            raise ValueError(f"the second argument names the text column, one of {pages.dataType.names}")
        taken = {name for name, _ in TOLD} & {n.lower() for n in pages.dataType.names if n != text.value}
        if taken:
            raise ValueError(f"the table has columns that the function tells: {sorted(taken)}")
        schema = StructType([f for f in pages.dataType.fields if f.name != text.value])
        for name, kind in TOLD:
            schema.add(name, kind)
        return AnalyzeResult(schema=schema)

    def eval(self, row, text: str):
        page = (row[text] or "").replace("\u0001", " ").replace("\u0002", " ")
        own = [row[name] for name in row.__fields__ if name != text]
        found = _found(page)
        for k, m in enumerate(found, 1):
            marker = m[0]
            kind = "section" if marker in markers.SECTIONS else "topic" if marker in markers.TOPICS else "question"
            if kind == "section":
                self.section, self.topic = marker, markers.TOPICS[0]
            elif kind == "topic":
                self.topic = marker
            end = found[k].start() if k < len(found) else len(page)
            yield (*own, k, m.start(), self.offset, kind, marker, page[m.end() : end], self.section, self.topic)
        self.offset += len(page)


Marked = udtf(_Marked)


def register(spark: SparkSession, name: str = "marked") -> None:
    spark.udtf.register(name, Marked)
