"""Matrix, color and page-box arithmetic as column expressions (row vectors, [a b c d e f])."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTER = (0.0, 0.0, 612.0, 792.0)


def matrix(a, b, c, d, e, f) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else F.lit(float(x))).cast("double").alias(n) for n, x in zip("abcdef", (a, b, c, d, e, f))])


def mat_mul(m: Column, n: Column) -> Column:
    """The matrix that does ``m``, then ``n``."""
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"],
        m["a"] * n["b"] + m["b"] * n["d"],
        m["c"] * n["a"] + m["d"] * n["c"],
        m["c"] * n["b"] + m["d"] * n["d"],
        m["e"] * n["a"] + m["f"] * n["c"] + n["e"],
        m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    )


def apply_matrix(x: Column, y: Column, m: Column) -> Column:
    """The point (x, y) under ``m``, as a struct."""
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    return F.struct(*[((1 - ink) * (1 - k)).alias(n) for n, ink in zip("rgb", (c, m, y))])


def page_geometry(x0: Column, y0: Column, x1: Column, y1: Column, rotate: Column) -> Column:
    """struct(width, height, rotation, ctm) of a page as shown; an incomplete box is US letter, an odd rotation none."""
    whole = x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull()
    x0, y0, x1, y1 = (F.when(whole, v).otherwise(F.lit(d)) for v, d in zip((x0, y0, x1, y1), LETTER))
    x0, x1, y0, y1 = F.least(x0, x1), F.greatest(x0, x1), F.least(y0, y1), F.greatest(y0, y1)
    w, h = x1 - x0, y1 - y0
    turn = F.pmod(F.coalesce(rotate.cast("long"), F.lit(0)), F.lit(360))
    turn = F.when(turn.isin(90, 180, 270), turn).otherwise(F.lit(0)).cast("int")
    side = turn.isin(90, 270)
    ctm = (
        F.when(turn == 90, matrix(0, 1, -1, 0, h + y0, -x0))
        .when(turn == 180, matrix(-1, 0, 0, -1, w + x0, h + y0))
        .when(turn == 270, matrix(0, -1, 1, 0, -y0, w + x0))
        .otherwise(matrix(1, 0, 0, 1, -x0, -y0))
    )
    return F.struct(F.when(side, h).otherwise(w).alias("width"), F.when(side, w).otherwise(h).alias("height"), turn.alias("rotation"), ctm.alias("ctm"))


def page_spec(spec: Column, total: Column) -> Column:
    """Page indices (from 0) that a spec such as "1-3,5,8-" picks, in its order, each once.

    No spec is all pages; "a-", "-b" and reversed ranges are understood; what is no number or not there is left out.
    """
    total = F.coalesce(total.cast("int"), F.lit(0))
    none = F.array().cast("array<int>")
    between = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(none)

    def picked(c):
        lo, hi = F.regexp_replace(c, "-.*$", ""), F.regexp_replace(c, "^[^-]*-", "")
        a = F.when(lo == "", F.lit(1)).otherwise(lo.try_cast("int"))
        b = F.when(hi == "", total).otherwise(hi.try_cast("int"))
        ranged = F.when(c.rlike(r"^\d*-\d*$") & a.isNotNull() & b.isNotNull(), between(F.greatest(F.lit(1), F.least(a, b)), F.least(total, F.greatest(a, b)))).otherwise(none)
        n = c.try_cast("int")
        single = F.when(c.rlike(r"^\+?\d+$") & (n >= 1) & (n <= total), F.array(n)).otherwise(none)
        return F.when(c.contains("-"), ranged).otherwise(single)

    asked = F.array_distinct(F.flatten(F.transform(F.split(F.replace(spec, F.lit(" "), F.lit("")), ","), picked)))
    every = between(F.lit(1), total)
    return F.transform(F.when(spec.isNull() | (spec == ""), every).otherwise(asked), lambda p: p - 1)
