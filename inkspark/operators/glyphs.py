"""Shown strings to positioned glyphs: decoding as joins with font dimensions, positions as prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encodings import encodings_table


def decoded_codes(codes: DataFrame, fonts: DataFrame) -> DataFrame:
    """(doc_id, font_key, idx, code, text, width): ToUnicode first, then for simple fonts Differences, then the base encoding."""
    base = F.broadcast(encodings_table(codes.sparkSession))  # five encodings of at most 256 codes
    font = fonts.select("doc_id", "font_key", "is_cid", "encoding")
    plain = F.when(~F.coalesce("is_cid", F.lit(False)), F.coalesce("diff", "ch"))
    return codes.join(font, ["doc_id", "font_key"], "left").join(base, ["encoding", "code"], "left").select("doc_id", "font_key", "idx", "code", F.coalesce("uni", plain, F.lit("")).alias("text"), "width")


def font_arrays(codes: DataFrame, fonts: DataFrame) -> DataFrame:
    """A row for each font: its used codes with text and width, by index, and the bytes of a code."""
    used = decoded_codes(codes, fonts).groupBy("doc_id", "font_key").agg(F.array_sort(F.collect_list(F.struct("idx", "code", "text", "width"))).alias("used"))
    return used.join(fonts.select("doc_id", "font_key", "code_bytes"), ["doc_id", "font_key"], "left")


def advances(shows: DataFrame, fonts: DataFrame) -> DataFrame:
    """A row for each code and kerning number, in order (``seq``, ``pos``), with ``tx``, its advance in text space.

    Pages are brought together while rows are still whole strings; windows and layout above need no further exchange.
    """
    joined = shows.join(fonts, ["doc_id", "font_key"], "left").repartition("doc_id", "page_index")
    items = F.when(F.col("codes").isNull(), F.array(F.struct(F.lit(None).cast("int").alias("code"), F.lit("").alias("text"), F.lit(0.0).alias("width")))).otherwise(
        F.transform("codes", lambda c: F.struct(F.element_at("used", c + 1)["code"].alias("code"), F.element_at("used", c + 1)["text"].alias("text"), F.element_at("used", c + 1)["width"].alias("width")))
    )
    flat = joined.select(*[c for c in shows.columns if c not in ("data", "codes")], F.coalesce("code_bytes", F.lit(1)).alias("code_bytes"), F.posexplode(items).alias("pos", "item"))
    space = F.when((F.col("item.code") == 32) & (F.col("code_bytes") == 1), F.col("tw")).otherwise(0.0)
    shown = (F.col("item.width") / 1000.0 * F.col("font_size") + F.col("tc") + space) * F.col("tz")
    kerned = -F.col("kern") / 1000.0 * F.col("font_size") * F.col("tz")
    return flat.select("*", F.col("item.code").alias("code"), F.col("item.text").alias("text"), F.when(F.col("kern").isNotNull(), kerned).otherwise(shown).alias("tx")).drop("item", "kern", "code_bytes")


def positioned(flat: DataFrame, rise: bool = False, numbered: bool = True) -> DataFrame:
    """Glyphs: the base matrix of a run moved by the advances so far, under the CTM; those without text move on but are no rows.

    ``seq`` numbers a page's glyphs from 1; without ``numbered`` it only has their order, which saves a sort.
    """
    so_far = Window.partitionBy("doc_id", "page_index", "run_id").orderBy("seq", "pos").rowsBetween(Window.unboundedPreceding, -1)
    t, c = F.col("tm"), F.col("ctm")
    lift = F.col("rise") if rise else F.lit(0.0)
    moved = flat.withColumn("before", F.coalesce(F.sum("tx").over(so_far), F.lit(0.0))).where("text <> ''")
    e = F.col("before") * t["a"] + lift * t["c"] + t["e"]
    f = F.col("before") * t["b"] + lift * t["d"] + t["f"]
    ta, tb = t["a"] * c["a"] + t["b"] * c["c"], t["a"] * c["b"] + t["b"] * c["d"]
    tc, td = t["c"] * c["a"] + t["d"] * c["c"], t["c"] * c["b"] + t["d"] * c["d"]
    size = F.abs(F.col("font_size") * F.sqrt(tc * tc + td * td))
    fallback = F.when(F.col("font_size") == 0, F.lit(1.0)).otherwise(F.abs("font_size"))
    order = Window.partitionBy("doc_id", "page_index").orderBy("seq", "pos")
    return moved.select(
        "doc_id",
        "page_index",
        (F.row_number().over(order).cast("long") if numbered else F.col("seq") * (1 << 31) + F.col("pos")).alias("seq"),
        "code",
        "text",
        (e * c["a"] + f * c["c"] + c["e"]).alias("x"),
        (e * c["b"] + f * c["d"] + c["f"]).alias("y"),
        F.when(size == 0, fallback).otherwise(size).alias("size"),
        (F.col("tx") * ta).alias("adv_x"),
        (F.col("tx") * tb).alias("adv_y"),
        F.col("font_name").alias("font"),
        "r",
        "g",
        "b",
        "render_mode",
    )


def glyphs(shows: DataFrame, codes: DataFrame, fonts: DataFrame, rise: bool = False, numbered: bool = True) -> DataFrame:
    return positioned(advances(shows, font_arrays(codes, fonts)), rise, numbered)


def with_derived(g: DataFrame) -> DataFrame:
    """Glyphs with ``invisible`` (render mode 3) and ``end_x``."""
    return g.withColumn("invisible", F.col("render_mode") == 3).withColumn("end_x", F.col("x") + F.col("adv_x"))
