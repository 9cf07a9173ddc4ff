"""Repairs, each Column to Column; ``dry_run`` gives the difference instead of the repaired rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: fixed values: a subscript pair whose digits each have braces of their own, and an empty bracket before a final dollar
DOUBLED_SUBSCRIPT = r"_\{\(_\{(\d+)\},_\{(\d+)\}\)\}"
EMPTY_BRACKET = r"=（\s*）\$。"
STOP = "。"


def subscripts(text: Column) -> Column:
    return F.regexp_replace(text, DOUBLED_SUBSCRIPT, r"_{($1,$2)}")


def blank_suffix(text: Column) -> Column:
    r"""A text that ends in \_..\_$。 with an odd number of dollars: the blank joins the math before it or gets an opener."""
    odd = (F.length(text) - F.length(F.replace(text, F.lit("$"), F.lit("")))) % 2 == 1
    fixed = F.when(text.rlike(r"\$(?:\\_)+\$。$"), F.regexp_replace(text, r"\$((?:\\_)+)\$。$", r"$1\$。")).otherwise(F.regexp_replace(text, r"((?:\\_)+)\$。$", r"\$$1\$。"))
    return F.when(odd & text.rlike(r"\\_\$。$"), fixed).otherwise(text)


def _stop_behind(text: Column, opening: str, closing: str, end: str) -> Column:
    """Behind each opening, the first stop right before a closing goes behind the end of that closing, if no dollar stands between."""
    pieces = F.split(text, "\\Q" + opening + "\\E", -1)

    def moved(piece: Column, i: Column) -> Column:
        at = F.instr(piece, STOP + closing)
        rest = F.substr(piece, at + 1)
        until = F.instr(rest, end) + (len(end) - 1)
        known = (i > 0) & (at > 1) & ~F.left(piece, at - 1).contains("$") & (F.instr(rest, end) > 0)
        return F.when(known, F.concat(F.left(piece, at - 1), F.left(rest, until), F.lit(STOP), F.substr(rest, until + 1))).otherwise(piece)

    return F.array_join(F.transform(pieces, moved), opening)


def full_stops_outside(text: Column) -> Column:
    r"""A full stop that ends a display moves behind it; an empty bracket before a final dollar becomes (\quad).

    Displays are environments, then those that \[ opens and ] closes, then what stands between two double dollars, so a
    stop in an environment between dollars may end up behind the dollars. A display that holds a dollar, or the stop
    only, stays.
    """
    inner = _stop_behind(_stop_behind(text, r"\begin{", r"\end{", "}"), r"\[", "]", "]")

    def joined(pieces: Column) -> Column:
        ends = lambda p, i: (i > 0) & (i < F.size(pieces) - 1) & (F.length(p) > 1) & p.endswith(STOP) & ~p.contains("$")
        # what follows a display takes over its stop
        taken = lambda i: F.when((i > 1) & ends(F.get(pieces, F.greatest(i - 1, F.lit(0))), i - 1), STOP).otherwise("")
        return F.array_join(F.transform(pieces, lambda p, i: F.concat(taken(i), F.when(ends(p, i), F.left(p, F.length(p) - 1)).otherwise(p))), "$$")

    # as the element of a one-element array, the pieces are cut once however often they are asked for
    whole = F.element_at(F.transform(F.array(F.split(inner, r"\Q$$\E", -1)), joined), 1)
    return F.regexp_replace(whole, EMPTY_BRACKET, r"=(\\quad)\$。")


def cleaned(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """clean_text over string, array and map columns."""
    kinds = {f.name: f.dataType.typeName() for f in rows.schema.fields}
    apply = {"string": T.clean_text, "array": lambda c: F.transform(c, T.clean_text), "map": lambda c: F.transform_values(c, lambda k, v: T.clean_text(v))}
    return rows.withColumns({c: apply[kinds[c]](F.col(c)) for c in columns})


def dry_run(rows: DataFrame, key: str, column: str, repair) -> DataFrame:
    """(key, before, after) of the rows that a repair would change."""
    return rows.select(key, F.col(column).alias("before"), repair(F.col(column)).alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))


def fixed(rows: DataFrame, columns: tuple[str, ...], repair=subscripts, count: str = "changes") -> DataFrame:
    """``repair`` over string columns and the values of map columns, with the number of texts it changed; null texts stay."""
    kinds = {f.name: f.dataType.typeName() for f in rows.schema.fields}
    new, changes = {}, F.lit(0)
    for c in columns:
        if kinds[c] == "map":
            new[c] = F.transform_values(c, lambda k, v: repair(v))
            hit = F.size(F.filter(F.map_values(c), lambda v: ~v.eqNullSafe(repair(v))))
            changes = changes + F.when(F.col(c).isNull(), 0).otherwise(hit)
        else:
            new[c] = repair(F.col(c))
            changes = changes + (~F.col(c).eqNullSafe(repair(F.col(c)))).cast("int")
    return rows.withColumn(count, changes).withColumns(new)
