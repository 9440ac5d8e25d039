"""ToUnicode maps as SQL: regular expressions and exploded ranges instead of a parser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SPAN = 65536
HEX = "<([0-9A-Fa-f]+)>"


def number(hexadecimal):
    return F.conv(hexadecimal, 16, 10).cast("long")


def utf16(hexadecimal):
    """Text of UTF-16BE hex digits; an odd byte is followed by 00, lone surrogates and NUL are dropped."""
    whole = F.rpad(hexadecimal, F.ceil(F.length(hexadecimal) / 4).cast("int") * 4, F.lit("0"))
    units = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(whole) / 4 - 1).cast("int")), lambda i: F.upper(F.substring(whole, i * 4 + 1, F.lit(4))))
    high, low = lambda u: u.rlike("^D[89AB]"), lambda u: u.rlike("^D[C-F]")
    kept = F.filter(
        F.transform(units, lambda u, i: F.when(u == "0000", None).when(high(u), F.when(low(F.get(units, i + 1)), u)).when(low(u), F.when((i > 0) & high(F.get(units, i - 1)), u)).otherwise(u)),
        lambda u: u.isNotNull(),
    )
    return F.decode(F.unhex(F.array_join(kept, "")), "UTF-16BE")


def character(value):
    """Text of a code point; surrogates and what is beyond Unicode are empty."""
    good = (value >= 0) & (value <= 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")).otherwise("")



def _pairs(df, key, column):
    """(key, kind, block, at, a, b, c) of single characters (kind 0) and ranges (kind 1), in the order in which they count."""
    chars = df.select(*key, F.posexplode(F.regexp_extract_all(F.col(column), F.lit("(?s)beginbfchar(.*?)endbfchar"), F.lit(1))).alias("block", "body"))
    chars = chars.select(*key, F.lit(0).alias("kind"), "block", F.posexplode(F.regexp_extract_all("body", F.lit(rf"(?s){HEX}\s*{HEX}"), F.lit(0))).alias("at", "item"))
    ranges = df.select(*key, F.posexplode(F.regexp_extract_all(F.col(column), F.lit("(?s)beginbfrange(.*?)endbfrange"), F.lit(1))).alias("block", "body"))
    ranges = ranges.select(*key, F.lit(1).alias("kind"), "block", F.posexplode(F.regexp_extract_all("body", F.lit(rf"(?s){HEX}\s*{HEX}\s*(\[.*?\]|<[0-9A-Fa-f]+>)"), F.lit(0))).alias("at", "item"))
    return chars, ranges


def parse_tounicode(df: DataFrame, key: list[str], column: str = "cmap") -> DataFrame:
    """(key, code, text) of maps given as text; ranges count after single characters, later entries win."""
    chars, ranges = _pairs(df, key, column)
    part = lambda g, p: F.regexp_extract("item", p, g)
    two = rf"(?s)^{HEX}\s*{HEX}"
    single = chars.select(*key, "kind", "block", "at", F.lit(0).alias("i"), number(part(1, two)).alias("code"), utf16(part(2, two)).alias("text"))
    three = rf"(?s)^{HEX}\s*{HEX}\s*(.*)$"
    spans = ranges.select(*key, "kind", "block", "at", number(part(1, three)).alias("low"), number(part(2, three)).alias("high"), part(3, three).alias("to"))
    spans = spans.where((F.col("high") >= F.col("low")) & (F.col("high") - F.col("low") <= MAX_SPAN))
    listed = spans.where("to LIKE '[%'").select("*", F.posexplode(F.regexp_extract_all("to", F.lit("<([0-9A-Fa-f]*)>"), F.lit(1))).alias("i", "hex"))
    listed = listed.where((F.col("i") <= F.col("high") - F.col("low")) & (F.length("hex") % 2 == 0))
    listed = listed.select(*key, "kind", "block", "at", "i", (F.col("low") + F.col("i")).alias("code"), utf16(F.col("hex")).alias("text"))
    counted = spans.where("to LIKE '<%'").select("*", F.posexplode(F.sequence("low", "high")).alias("i", "code"))
    base = number(F.regexp_extract("to", HEX, 1))
    counted = counted.select(*key, "kind", "block", "at", "i", "code", character(base + F.col("i")).alias("text"))
    every = single.unionByName(listed).unionByName(counted).where("text <> ''")
    return every.groupBy(*key, "code").agg(F.max_by("text", F.struct("kind", "block", "at", "i")).alias("text"))


def code_width(column):
    """Bytes of a code by the code space ranges: 1 if one covers 00 to FF in one byte, else 2."""
    body = F.array_join(F.regexp_extract_all(column, F.lit("(?s)begincodespacerange(.*?)endcodespacerange"), F.lit(1)), " ")
    return F.when(body.rlike(r"(?s)^\s*<0{1,2}>\s*<[Ff]{2}>"), 1).otherwise(2)
