"""Queries over the PDF operators, each with the DuckDB SQL that gives the same rows where SQL can.

The tables hold no PDF files, so documents' texts are written as PDF files first;
what is extracted from them must then be what plain SQL makes of the texts.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codecs, geometry
from ..functions.cmap import code_width, parse_tounicode
from ..functions.encodings import character_of, encodings_table, glyph_names_table
from ..operators import glyphs as gl
from ..operators import layout, pagetree
from ..sources import datasource, writer
from ..sources.syntax import unhex
from .extract import Extraction, merged_xref, read_files
from .scratch import folder

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def files(spark, sf_dir, style="table"):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return writer.render_pdfs(docs, style=style)


def extraction(spark, sf_dir, style="table", **options):
    return Extraction(files(spark, sf_dir, style), **options)


#: the wrapped rows of each document, numbered through: 60 a page
ROWS = """
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
    chunks AS (SELECT doc_id, i, k, substr(l, k * 90 + 1, 90) AS raw FROM lines, unnest(range(CAST(ceil(length(l) / 90.0) AS BIGINT))) AS u(k)),
    rows_ AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS n, raw FROM chunks)"""

LINES_SQL = f"""WITH {ROWS}
    SELECT doc_id, CAST(n // 60 AS INT) AS page_index, CAST(n % 60 AS INT) AS line_no, rtrim(raw) AS text FROM rows_"""


def _lines(style, **options):
    def run(spark, sf_dir):
        return extraction(spark, sf_dir, style, **options).lines().select("doc_id", "page_index", "line_no", "text")

    return run


#: style of the files (see ``writer.render``) by query; all must give the texts' rows
STYLES = {
    "roundtrip_lines": "table", "line_ends_cr": "cr", "line_ends_crlf": "crlf", "xref_stream": "stream", "objstm": "packed", "hybrid_files": "hybrid", "incremental_updates": "updated",
    "repair_rebuild": "damaged", "repair_object_streams": "repacked", "inherited_tree": "tree", "content_arrays": "parts", "tiff_streams": "tiff", "png_streams": "predicted", "chained_filters": "filters",
    "direct_fonts": "direct", "font_differences": "differences", "cid_fonts": "cid", "byte_codespace": "one_byte", "saved_states": "saved", "moved_lines": "moves", "quote_operators": "quotes", "inline_images": "inline", "octal_strings": "octal",
}
for _name, _style in STYLES.items():
    query(_name, LINES_SQL)(_lines(_style))


@query("doc_stats", f"""WITH {ROWS}
    SELECT d.doc_id, '1.4' AS version, CAST(3 + 2 * greatest(1, ceil(coalesce(r.n, 0) / 60.0)) AS BIGINT) AS n_objects, CAST(greatest(1, ceil(coalesce(r.n, 0) / 60.0)) AS BIGINT) AS page_count,
           CAST(greatest(1, ceil(coalesce(r.n, 0) / 60.0)) AS BIGINT) AS processed, CAST(coalesce(r.c, 0) AS BIGINT) AS chars,
           CAST(ceil(coalesce(r.n, 0) / 60.0) AS BIGINT) AS pages_with_text, coalesce(r.n, 0) = 0 AS scanned
    FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(length(raw)) AS c FROM rows_ GROUP BY doc_id) r USING (doc_id)""")
def doc_stats(spark, sf_dir):
    return extraction(spark, sf_dir).stats()


GLYPHS_SQL = f"""WITH {ROWS}
    SELECT doc_id, CAST(n // 60 AS INT) AS page_index, CAST(n % 60 AS INT) AS line_no, CAST(length(raw) AS BIGINT) AS n_chars,
           CAST({{y}} - 12 * (n % 60) AS DOUBLE) AS y, CAST({{x}} AS DOUBLE) AS x, round(CAST({{end}} AS DOUBLE), 6) AS end_x, CAST(12 AS DOUBLE) AS size FROM rows_"""


def _boxes(style):
    """Lines with their boxes, placed where the file is: no row for a glyph, nothing stored."""

    def run(spark, sf_dir):
        out = extraction(spark, sf_dir, style).lines()
        return out.select("doc_id", "page_index", "line_no", "n_chars", F.round("y", 6).alias("y"), F.round("x", 6).alias("x"), F.round("end_x", 6).alias("end_x"), F.round("size", 6).alias("size"))

    return run


PLAIN_BOXES = GLYPHS_SQL.format(y=760, x=36, end="36 + 6 * length(raw)")
query("glyph_positions", PLAIN_BOXES)(_boxes("table"))
query("direct_font_positions", PLAIN_BOXES)(_boxes("direct"))
query("text_matrices", PLAIN_BOXES)(_boxes("matrices"))
query("saved_state_positions", PLAIN_BOXES)(_boxes("saved"))
query("moved_line_positions", PLAIN_BOXES)(_boxes("moves"))
query("quoted_line_positions", PLAIN_BOXES)(_boxes("quotes"))
query("cid_widths", PLAIN_BOXES)(_boxes("widths"))
query("form_xobject", GLYPHS_SQL.format(y=740, x=46, end="46 + 6 * length(raw)"))(_boxes("form"))
query("spacing_scaling_kerning", GLYPHS_SQL.format(y=760, x="CASE WHEN length(raw) = 1 THEN 45 ELSE 36 END", end="36 + 1.5 * (8 * length(raw) + 3 * (length(raw) - length(replace(raw, ' ', ''))) + 6)"))(_boxes("spaced"))


@query("char_histogram", """SELECT page_count, ch, count(*) AS n FROM (
        SELECT CAST(1 AS BIGINT) AS page_count, unnest(string_split(replace(text, chr(10), ''), '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ALL""")
def char_histogram(spark, sf_dir):
    """Decoded text of every shown code, by character."""
    return extraction(spark, sf_dir, keep=True).glyphs().groupBy(F.lit(1).cast("long").alias("page_count"), F.col("text").alias("ch")).agg(F.count("*").alias("n"))


@query("text_join", f"""WITH {ROWS},
    p AS (SELECT doc_id, n // 60 AS page, string_agg(rtrim(raw), chr(10) ORDER BY n) AS t FROM rows_ GROUP BY ALL)
    SELECT doc_id, md5(coalesce(string_agg(t, chr(10) || chr(12) ORDER BY page), '')) AS digest FROM documents LEFT JOIN p USING (doc_id) GROUP BY doc_id""")
def text_join(spark, sf_dir):
    return extraction(spark, sf_dir).texts().select("doc_id", F.md5("text").alias("digest"))


@query("layout_grid", f"""WITH {ROWS}
    SELECT doc_id, CAST(n // 60 AS INT) AS page_index, md5(string_agg(rtrim(raw), chr(10) ORDER BY n)) AS digest FROM rows_ GROUP BY ALL""")
def layout_grid(spark, sf_dir):
    return extraction(spark, sf_dir).page_layouts().where("layout IS NOT NULL").select("doc_id", "page_index", F.md5("layout").alias("digest"))


@query("json_output", f"""WITH {ROWS},
    l AS (SELECT doc_id, n // 60 AS p, count(*) AS k, sum(length(raw)) AS c, string_agg(rtrim(raw), chr(10) ORDER BY n) AS t,
                 string_agg('{{"y":' || CAST(760.0 - 12.0 * (n % 60) AS DOUBLE) || ',"x":36.0,"size":12.0,"text":' || CAST(to_json(rtrim(raw)) AS VARCHAR) || '}}', ',' ORDER BY n) AS lines FROM rows_ GROUP BY ALL),
    p AS (SELECT doc_id, unnest(range(CAST(greatest(1, ceil(count(n) / 60.0)) AS BIGINT))) AS p FROM documents LEFT JOIN rows_ USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, '{{"file":"' || doc_id || '","version":"1.4","repaired":false,"pages":[' || string_agg(
        '{{"page":' || (p + 1) || ',"width":612.0,"height":792.0,"rotation":0,"chars":' || coalesce(c, 0) || ',"lines":[' || coalesce(lines, '') || '],"text":' || CAST(to_json(coalesce(t, '')) AS VARCHAR) || '}}', ',' ORDER BY p) || ']}}' AS json
    FROM p LEFT JOIN l USING (doc_id, p) GROUP BY doc_id""")
def json_output(spark, sf_dir):
    return extraction(spark, sf_dir).json()


@query("error_isolation", """SELECT CASE WHEN doc_id % 10 IN (3, 7) THEN 'DocumentError' ELSE 'none' END AS error_class, count(*) AS n,
        CAST(sum(CASE WHEN doc_id % 10 = 5 THEN 1 ELSE 0 END) AS BIGINT) AS repaired FROM documents GROUP BY 1""")
def error_isolation(spark, sf_dir):
    """One file in ten is no document, one is encrypted, one has a wrong startxref: errors and repairs by class."""
    kind = F.pmod("doc_id", F.lit(10))
    style = F.when(kind == 3, "broken").when(kind == 7, "encrypted").when(kind == 5, "damaged").otherwise("table")
    docs = extraction(spark, sf_dir, style).docs()
    return docs.groupBy(F.coalesce("error_class", F.lit("none")).alias("error_class")).agg(F.count("*").alias("n"), F.count_if("repaired").alias("repaired"))


@query("page_selection", f"""WITH {ROWS}, c AS (SELECT doc_id, greatest(1, CAST(ceil(count(n) / 60.0) AS BIGINT)) AS pages FROM documents LEFT JOIN rows_ USING (doc_id) GROUP BY doc_id),
    picked AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS o FROM (
        SELECT doc_id, page, min(place) AS place FROM (
            SELECT doc_id, unnest([3, 1, 2]) AS page, unnest([0, 1, 2]) AS place, pages FROM c) WHERE page <= pages GROUP BY ALL))
    SELECT doc_id, CAST(page - 1 AS INT) AS page_index, CAST(o AS INT) AS "order", CAST(count(n) AS BIGINT) AS n_lines
    FROM picked LEFT JOIN rows_ r ON r.doc_id = picked.doc_id AND r.n // 60 = page - 1 GROUP BY ALL""".replace("SELECT doc_id, CAST(page - 1", "SELECT picked.doc_id, CAST(page - 1"))
def page_selection(spark, sf_dir):
    return extraction(spark, sf_dir, pages="3,1-2,2").page_texts().select("doc_id", "page_index", "order", "n_lines")


# ---------------------------------------------------------------- scalar operators

SPECS = "['', ' ', '1-3,5', (k % 7 + 1)::VARCHAR || '-', '-' || (k % 4 + 1)::VARCHAR, '5-2,1', '9,2,2,x,1', '-', '1-2-3,4']"


@query("page_spec_select", f"""WITH s AS (SELECT s_suppkey AS k, {SPECS}[k % 9 + 1] AS spec, k % 8 AS total FROM supplier),
    c AS (SELECT k, spec, total, unnest(string_split(replace(spec, ' ', ''), ',')) AS c, unnest(range(len(string_split(replace(spec, ' ', ''), ',')))) AS i FROM s WHERE spec <> ''),
    b AS (SELECT k, i, total, CASE WHEN regexp_matches(c, '^\\d*-\\d*$') THEN coalesce(try_cast(split_part(c, '-', 1) AS INT), 1) WHEN regexp_matches(c, '^\\d+$') THEN CAST(c AS INT) END AS lo,
                 CASE WHEN regexp_matches(c, '^\\d*-\\d*$') THEN coalesce(try_cast(split_part(c, '-', 2) AS INT), total) WHEN regexp_matches(c, '^\\d+$') THEN CAST(c AS INT) END AS hi, contains(c, '-') AS ranged FROM c),
    p AS (SELECT k, i, unnest(range(greatest(1, least(lo, hi)), least(total, greatest(lo, hi)) + 1)) AS page FROM b WHERE lo IS NOT NULL
          UNION ALL SELECT k, 0, unnest(range(1, total + 1)) FROM s WHERE spec = ''),
    f AS (SELECT k, page, min(i * 1000 + page) AS place FROM p GROUP BY ALL)
    SELECT k, CAST(page - 1 AS INT) AS page_index, CAST(row_number() OVER (PARTITION BY k ORDER BY place) - 1 AS INT) AS pos FROM f""")
def page_spec_select(spark, sf_dir):
    k = F.col("k")
    specs = F.array(F.lit(""), F.lit(" "), F.lit("1-3,5"), F.concat((k % 7 + 1).cast("string"), F.lit("-")), F.concat(F.lit("-"), (k % 4 + 1).cast("string")), F.lit("5-2,1"), F.lit("9,2,2,x,1"), F.lit("-"), F.lit("1-2-3,4"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).select("k", F.get(specs, (k % 9).cast("int")).alias("spec"), (k % 8).alias("total"))
    return s.select("k", F.posexplode(geometry.page_spec(F.col("spec"), F.col("total"))).alias("pos", "page_index"))


BOX = "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE (p_size - 20) * 10.0 END AS x0, p_size * 2.0 AS y0, (p_size % 9 - 4) * 50.0 AS x1, 700.0 + p_size AS y1, (p_partkey % 11 - 4) * 45 AS rot"


@query("page_geometry", f"""WITH b AS (SELECT p_partkey, {BOX} FROM part),
    n AS (SELECT p_partkey, CASE WHEN x0 IS NULL THEN 0 ELSE least(x0, x1) END AS x0, CASE WHEN x0 IS NULL THEN 612 ELSE greatest(x0, x1) END AS x1, CASE WHEN x0 IS NULL THEN 0 ELSE least(y0, y1) END AS y0,
                 CASE WHEN x0 IS NULL THEN 792 ELSE greatest(y0, y1) END AS y1, CASE WHEN ((rot % 360) + 360) % 360 IN (90, 180, 270) THEN ((rot % 360) + 360) % 360 ELSE 0 END AS r FROM b)
    SELECT p_partkey, CAST(CASE WHEN r IN (90, 270) THEN y1 - y0 ELSE x1 - x0 END AS DOUBLE) AS width, CAST(CASE WHEN r IN (90, 270) THEN x1 - x0 ELSE y1 - y0 END AS DOUBLE) AS height, CAST(r AS INT) AS rotation,
           CAST(CASE r WHEN 90 THEN y1 - 100 WHEN 180 THEN x1 - 50 WHEN 270 THEN 100 - y0 ELSE 50 - x0 END AS DOUBLE) AS x, CAST(CASE r WHEN 90 THEN 50 - x0 WHEN 180 THEN y1 - 100 WHEN 270 THEN x1 - 50 ELSE 100 - y0 END AS DOUBLE) AS y FROM n""")
def page_geometry(spark, sf_dir):
    """Boxes and rotations of all kinds; x and y: where the point (50, 100) is shown."""
    b = table(spark, sf_dir, "part").selectExpr("p_partkey", *BOX.split(", "))
    b = b.withColumn("g", geometry.page_geometry(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")), F.col("rot")))
    return b.withColumn("p", geometry.apply_matrix(F.lit(50.0), F.lit(100.0), F.col("g.ctm"))).select("p_partkey", "g.width", "g.height", "g.rotation", "p.x", "p.y")


@query("affine_transform", """SELECT l_orderkey, l_linenumber,
        round((l_quantity * 2 + l_tax * 3) * 5 + (l_quantity * 0.5 - l_discount) * 7 + (l_quantity + 1) * 0, 6) AS a_mixed,
        round((2 * l_quantity + l_discount * l_tax + 3) * 0.5 + (l_tax * l_quantity + 4 * l_tax + 1) * -1 + l_quantity, 6) AS x,
        round((2 * l_quantity + l_discount * l_tax + 3) * 2 + (l_tax * l_quantity + 4 * l_tax + 1) * 0.25 + 7, 6) AS y FROM lineitem""")
def affine_transform(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    q, d, t = (F.col(c) for c in ("l_quantity", "l_discount", "l_tax"))
    m, n = geometry.matrix(2, t, d, 4, 3, 1), geometry.matrix(0.5, 2, -1, 0.25, q, 7)
    both = geometry.mat_mul(m, n)
    return li.withColumn("m", both).withColumn("p", geometry.apply_matrix(q, t, F.col("m"))).select("l_orderkey", "l_linenumber", F.round((q * 2 + t * 3) * 5 + (q * 0.5 - d) * 7, 6).alias("a_mixed"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("cmyk_to_rgb", """SELECT l_orderkey, l_linenumber, round((1 - l_discount) * (1 - l_quantity / 100), 6) AS r, round((1 - l_tax) * (1 - l_quantity / 100), 6) AS g,
        round((1 - l_tax * l_discount) * (1 - l_quantity / 100), 6) AS b FROM lineitem""")
def cmyk_to_rgb(spark, sf_dir):
    d, t = F.col("l_discount"), F.col("l_tax")
    rgb = geometry.cmyk_to_rgb(d, t, t * d, F.col("l_quantity") / 100)
    return table(spark, sf_dir, "lineitem").withColumn("c", rgb).select("l_orderkey", "l_linenumber", *[F.round(f"c.{x}", 6).alias(x) for x in "rgb"])


# The characters that codes beyond ASCII are to have, written out here a second time; a blank is no character.
WIN_80 = "€ ‚ƒ„…†‡ˆ‰Š‹Œ Ž  ‘’“”•–—˜™š›œ žŸ"
MAC_80 = (
    "ÄÅÇÉÑÖÜáàâäãåçéèêëíìîïñóòôöõúùûü†°¢£§•¶ß®©™´¨≠ÆØ∞±≤≥¥µ∂∑∏π∫ªºΩæø¿¡¬√ƒ≈∆«»…\u00a0ÀÃÕŒœ–—“”‘’÷◊ÿŸ⁄€‹›ﬁﬂ"
    "‡·‚„‰ÂÊÁËÈÍÎÏÌÓÔ\uf8ffÒÚÛÙıˆ˜¯˘˙˚¸˝˛ˇ"
)
STANDARD_A0 = " ¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ –†‡· ¶•‚„”»…‰ ¿ `´ˆ˜¯˘˙¨ ˚¸ ˝˛ˇ—                Æ ª    ŁØŒº     æ   ı  łøœß    "


def _values():
    ascii_ = {c: chr(c) for c in range(128)}
    beyond = lambda first, row: {first + i: c for i, c in enumerate(row) if c != " "}
    win = ascii_ | beyond(0x80, WIN_80) | {c: chr(c) for c in range(0xA0, 0x100)}
    mac = ascii_ | beyond(0x80, MAC_80)
    standard = {c: chr(c) for c in range(32, 127)} | {0x27: "’", 0x60: "‘"} | beyond(0xA0, STANDARD_A0)
    every = {"StandardEncoding": standard, "WinAnsiEncoding": win, "PDFDocEncoding": win, "MacRomanEncoding": mac, "MacExpertEncoding": mac}
    return ", ".join(f"('{n}', {c}, chr({ord(ch)}))" for n, t in every.items() for c, ch in t.items())


@query("encoding_decode", f"""WITH e(encoding, code, ch) AS (VALUES {_values()}),
    f AS (SELECT o_orderkey, ['WinAnsiEncoding', 'MacRomanEncoding', 'StandardEncoding', 'PDFDocEncoding', NULL][CAST(o_orderkey % 5 AS INT) + 1] AS encoding, CAST(o_orderkey * 7 % 256 AS INT) AS code,
                 CASE WHEN o_orderkey % 3 = 0 THEN 'u' END AS uni, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN 'd' END AS diff, o_orderkey % 7 = 0 AS cid FROM orders)
    SELECT o_orderkey, coalesce(uni, CASE WHEN NOT cid THEN coalesce(diff, ch) END, '') AS text FROM f LEFT JOIN e USING (encoding, code)""")
def encoding_decode(spark, sf_dir):
    """Precedence of ToUnicode, Differences and base encoding over synthetic fonts, one for each order."""
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(n) for n in ("WinAnsiEncoding", "MacRomanEncoding", "StandardEncoding", "PDFDocEncoding")])
    o = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.lit("f").alias("font_key"), F.lit(0).alias("idx"), (k * 7 % 256).cast("int").alias("code"), F.when(k % 3 == 0, "u").alias("uni"), F.when(k % 4 == 0, "").when(k % 4 == 1, "d").alias("diff"), F.lit(500.0).alias("width"), F.get(names, (k % 5).cast("int")).alias("encoding"), (k % 7 == 0).alias("is_cid"))
    fonts = o.select("doc_id", "font_key", "is_cid", "encoding")
    return gl.decoded_codes(o.drop("encoding", "is_cid"), fonts).select(F.col("doc_id").alias("o_orderkey"), "text")


@query("hex_string_decode", """SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n, md5(encode(text)) AS digest FROM documents""")
def hex_string_decode(spark, sf_dir):
    """Hex strings with blanks in them; every other one has its last digit, if that is 0, left out."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.hex(F.encode("text", "UTF-8")).alias("h"))
    h = F.regexp_replace("h", "(.{32})", "$1\n")
    short = F.when((F.col("doc_id") % 2 == 1) & h.endswith("0"), F.expr("substring(h, 1, length(h) - 1)")).otherwise(h)

    def decode(batches):
        for batch in batches:
            raw = [None if x is None else unhex(x.encode()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    return d.select("doc_id", short.alias("h")).mapInArrow(decode, "doc_id long, raw binary").select("doc_id", F.octet_length("raw").cast("long").alias("n"), F.md5("raw").alias("digest"))


def _codec(encode, decode):
    def run(spark, sf_dir):
        def kernel(batches):
            for batch in batches:
                digests = [hashlib.md5(decode(encode((t or "").encode()))).hexdigest() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests)], names=["doc_id", "digest"])

        return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(kernel, "doc_id long, digest string")

    return run


def _predicted(kind):
    def decode(data):
        n = int.from_bytes(data[:8], "big")
        return codecs.unpredict(data[8:], 10 + kind, 1, 8, 50)[:n]

    return _codec(lambda d: len(d).to_bytes(8, "big") + writer.predict(d, 50, kind), decode)


MD5_SQL = "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents"
query("filter_flate", MD5_SQL)(_codec(lambda d: zlib.compress(d) + b"tail", codecs.flate))
query("filter_ascii85", MD5_SQL)(_codec(lambda d: b"<~" + base64.a85encode(d, wrapcol=72) + b"~>", codecs.ascii85))
query("filter_ascii_hex", MD5_SQL)(_codec(lambda d: d.hex().encode() + b">", codecs.hexadecimal))
query("filter_run_length", MD5_SQL)(_codec(writer.run_length_encode, codecs.run_length))
query("filter_lzw", MD5_SQL)(_codec(writer.lzw_encode, codecs.lzw))
query("filter_chain", MD5_SQL)(_codec(lambda d: base64.a85encode(zlib.compress(writer.run_length_encode(d))) + b"~>", lambda d: codecs.decode(d, ["A85", "Fl", "RunLengthDecode", "DCTDecode"], [])))
for _kind, _label in enumerate(("none", "sub", "up", "average", "paeth")):
    query(f"predictor_png_{_label}", MD5_SQL)(_predicted(_kind))


# ---------------------------------------------------------------- relational operators

CMAP = "'begincodespacerange <0000> <FFFF> endcodespacerange ' "


@query("cmap_bfchar", """SELECT n_nationkey, CAST(unnest(range(length(n_name))) + 256 * n_nationkey AS BIGINT) AS code, unnest(string_split(n_name, '')) AS text FROM nation""")
def cmap_bfchar(spark, sf_dir):
    """Maps of single characters: code 256 * key + place is the place's letter; earlier entries for the codes are overridden."""
    n = table(spark, sf_dir, "nation")
    letters = F.transform(F.split("n_name", ""), lambda c, i: F.concat(F.lit("<"), F.lpad(F.hex(i + 256 * F.col("n_nationkey")), 4, "0"), F.lit("> <"), F.lpad(F.hex(F.encode(c, "UTF-16BE")), 4, "0"), F.lit(">")))
    wrong = F.regexp_replace(F.array_join(letters, "\n"), "> <....>", "> <0021>")
    body = F.concat(F.lit("beginbfchar "), wrong, F.lit(" endbfchar beginbfchar "), F.array_join(letters, "\n"), F.lit(" endbfchar"))
    return parse_tounicode(n.select("n_nationkey", body.alias("cmap")), ["n_nationkey"])


@query("cmap_bfrange", """SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(p_partkey % 300 + i AS BIGINT) AS code, chr(CAST(19968 + p_partkey % 1000 + i AS INT)) AS text
        FROM part, unnest(range(p_size % 20 + 1)) AS u(i)""")
def cmap_bfrange(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    low, n = F.col("p_partkey") % 300, F.col("p_size") % 20
    word = lambda v: F.concat(F.lit("<"), F.lpad(F.hex(v), 4, "0"), F.lit(">"))
    body = F.concat(F.lit("beginbfrange "), word(low), word(low + n), word(F.lit(0x4E00) + F.col("p_partkey") % 1000), F.lit(" <0009> <0001> <0041> endbfrange"))
    return parse_tounicode(p.select("p_partkey", body.alias("cmap")), ["p_partkey"])


@query("cmap_bfrange_array", """SELECT r_regionkey, CAST(i AS BIGINT) AS code, substr(r_name, CAST(i + 1 AS INT), 1) || 'x' AS text FROM region, unnest(range(length(r_name) - 1)) AS u(i)""")
def cmap_bfrange_array(spark, sf_dir):
    """Listed ranges one code shorter than their list, whose last item counts for nothing."""
    r = table(spark, sf_dir, "region")
    items = F.array_join(F.transform(F.split("r_name", ""), lambda c: F.concat(F.lit("<"), F.hex(F.encode(F.concat(c, F.lit("x")), "UTF-16BE")), F.lit(">"))), " ")
    body = F.concat(F.lit("beginbfrange <00> <"), F.lpad(F.hex(F.length("r_name") - 2), 2, "0"), F.lit("> ["), items, F.lit("] endbfrange"))
    return parse_tounicode(r.select("r_regionkey", body.alias("cmap")), ["r_regionkey"])


SECTIONS = "o_custkey AS doc_id, o_orderkey % 5 AS num, 1 AS typ, o_orderkey AS a, 0 AS b, o_orderkey AS section"


@query("xref_newest_wins", "SELECT o_custkey AS doc_id, o_orderkey % 5 AS num, 1 AS typ, min(o_orderkey) AS a, 0 AS b FROM orders GROUP BY ALL")
def xref_newest_wins(spark, sf_dir):
    return merged_xref(table(spark, sf_dir, "orders").selectExpr(*SECTIONS.split(", ")))


@query("xref_last_wins", "SELECT o_custkey AS doc_id, o_orderkey % 5 AS num, 1 AS typ, max(o_orderkey) AS a, 0 AS b FROM orders GROUP BY ALL")
def xref_last_wins(spark, sf_dir):
    """As in a scan of a damaged file: the last object of a number counts."""
    return merged_xref(table(spark, sf_dir, "orders").selectExpr(*SECTIONS.split(", ")).withColumn("section", -F.col("section")))


@query("xref_tables", f"""WITH {ROWS}, c AS (SELECT doc_id, greatest(1, CAST(ceil(count(n) / 60.0) AS BIGINT)) AS pages FROM documents LEFT JOIN rows_ USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, CAST(3 + 2 * pages AS BIGINT) AS in_file, CAST(0 AS BIGINT) AS packed FROM c""")
def xref_tables(spark, sf_dir):
    x = extraction(spark, sf_dir).xref()
    return x.groupBy("doc_id").agg(F.count_if(F.col("typ") == 1).alias("in_file"), F.count_if(F.col("typ") == 2).alias("packed"))


@query("page_tree_walk", """WITH p AS (SELECT c_custkey, c_nationkey, n_regionkey, c_acctbal, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST(c_custkey AS BIGINT) AS node, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY c_nationkey, c_custkey) - 1 AS INT) AS page_index,
           CAST(NULL AS VARCHAR) AS resources, CASE WHEN c_mktsegment = 'BUILDING' THEN 'own' WHEN c_nationkey % 2 = 0 THEN 'nation' || c_nationkey ELSE 'region' || n_regionkey END AS media_box,
           CAST(NULL AS VARCHAR) AS crop_box, 'root' AS rotate FROM p""")
def page_tree_walk(spark, sf_dir):
    """Nations and customers as a tree of pages for each region, whose boxes come from the nearest that has one."""
    none = F.lit(None).cast("string")
    columns = lambda df, doc, node, parent, kid, kind, box, rotate=none: df.select(doc.cast("long").alias("doc_id"), node.cast("long").alias("node"), parent.cast("long").alias("parent"), kid.cast("int").alias("kid_no"), F.lit(kind).alias("kind"), none.alias("resources"), box.alias("media_box"), none.alias("crop_box"), rotate.alias("rotate"))
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    far, own = 10**12, F.col("n_regionkey")
    of_region = customer.join(F.broadcast(nation.select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    nodes = [
        columns(region, F.col("r_regionkey"), F.lit(-1), F.lit(None), F.lit(0), "Pages", none, F.lit("root")),
        columns(region, F.col("r_regionkey"), F.lit(-2), F.lit(-1), F.lit(0), "Pages", F.concat(F.lit("region"), F.col("r_regionkey"))),
        columns(nation, own, F.col("n_nationkey") + far, F.lit(-2), F.col("n_nationkey"), "Pages", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("nation"), F.col("n_nationkey")))),
        columns(of_region, own, F.col("c_custkey"), F.col("c_nationkey") + far, F.col("c_custkey"), "Page", F.when(F.col("c_mktsegment") == "BUILDING", "own")),
        columns(region, F.col("r_regionkey"), F.lit(-1), F.lit(-2), F.lit(99), "Pages", none),  # a kid that stands above itself
    ]
    out = nodes[0]
    for n in nodes[1:]:
        out = out.unionByName(n)
    return pagetree.walk(out)


def _row_glyphs(paints=1, at_once=30_000):
    """What ``layout.made`` takes: documents' wrapped rows as pages of glyphs, one every 6 points, painted ``paints`` times; blanks leave gaps.

    Each row is a page of its own. The number that the SQL gives it is its key; long lines may share these, but no page.
    """

    def pages(batch):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        ends = np.cumsum([len(t) for t in texts])
        for at in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends // (16 * at_once))) + 1):
            own = [texts[i] for i in at.tolist()]
            chars = np.frombuffer(("\n".join(own) + "\n").encode("utf-32-le"), "<u4")
            stop = np.flatnonzero(chars == 10)
            start = np.append(0, stop[:-1] + 1)
            lines = np.array([t.count("\n") + 1 for t in own])
            doc, line = np.repeat(at, lines), np.arange(len(stop)) - np.repeat(np.cumsum(lines) - lines, lines)
            parts = -(-(stop - start) // writer.WRAP)
            row = np.repeat(np.arange(len(stop)), parts)
            part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            begin = start[row] + writer.WRAP * part
            length = np.minimum(writer.WRAP, stop[row] - begin)
            for some in np.split(np.arange(len(row)), np.flatnonzero(np.diff(np.cumsum(length) // at_once)) + 1):
                keys = [batch.column(0).take(pa.array(doc[row[some]])), pa.array((line[row[some]] * 400 + part[some])).cast(pa.int32())]
                yield keys, glyphs(chars, begin[some], length[some])

    def glyphs(chars, begin, length):
        column = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        point = chars[np.repeat(begin, length) + column].astype(np.int64)
        seen = np.flatnonzero(point != 32)
        point, column, page = (np.repeat(v[seen], paints) for v in (point, column, np.repeat(np.arange(len(begin)), length)))
        paint = np.tile(np.arange(paints), len(seen))  # side by side; their order has one paint after the other
        same = lambda v: np.full(len(point), v)
        return {"texts": None, "point": point, "x": column * 6.0 + paint * 0.01, "y": same(100.0), "size": same(12.0), "adv": same(6.0), "order": column + 1000 * paint, "font": same(0), "names": ["F"], "page": page}

    return pages


def _row_texts(spark, sf_dir, paints=1):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = layout.made(documents, _row_glyphs(paints), f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, page_index int")
    return found.select("doc_id", "page_index", "text")


WORDS_SQL = r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
    chunks AS (SELECT doc_id, i, k, substr(l, k * 90 + 1, 90) AS raw FROM lines, unnest(range(CAST(ceil(length(l) / 90.0) AS BIGINT))) AS u(k))
    SELECT doc_id, CAST(i * 400 + k AS INT) AS page_index, regexp_replace(trim(raw), ' +', ' ', 'g') AS text FROM chunks WHERE trim(raw) <> ''"""


@query("gap_spaces", WORDS_SQL)
def gap_spaces(spark, sf_dir):
    """Blanks come back from the gaps that they leave."""
    return _row_texts(spark, sf_dir)


@query("overprint_dedupe", WORDS_SQL)
def overprint_dedupe(spark, sf_dir):
    """Glyphs painted three times, a hundredth of a point apart, count once."""
    return _row_texts(spark, sf_dir, paints=3)


CLUSTER = "CAST(l_orderkey AS BIGINT) AS doc_id, 0 AS page_index, CAST(l_linenumber AS BIGINT) AS seq, 'x' AS text, l_quantity AS x, CAST(700 - 20 * (l_partkey % 4) + 0.3 * l_linenumber AS DOUBLE) AS y, CAST(8 + l_suppkey % 3 AS DOUBLE) AS size, CAST(5 AS DOUBLE) AS adv_x, 'F' AS font"


@query("line_clustering", f"""WITH g AS (SELECT {CLUSTER} FROM lineitem)
    SELECT doc_id, CAST(round((700 - y) / 20 + 0.04) AS INT) AS band, count(*) AS n_chars, round(max(y), 6) AS y, round(min(x), 6) AS x, list_sort(list(size))[count(*) // 2 + 1] AS size FROM g GROUP BY ALL""")
def line_clustering(spark, sf_dir):
    """Items of an order as glyphs in four bands whose baselines drift by up to two points."""
    g = table(spark, sf_dir, "lineitem").selectExpr(*CLUSTER.split(", "))
    return layout.lines(g).select("doc_id", F.round((700 - F.col("y")) / 20 + 0.04).cast("int").alias("band"), "n_chars", F.round("y", 6).alias("y"), F.round("x", 6).alias("x"), "size")


@query("line_size_median", "SELECT l_orderkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS size FROM lineitem GROUP BY l_orderkey")
def line_size_median(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("sizes")).select("l_orderkey", layout.upper_median("sizes").alias("size"))


@query("encoding_dimension", f"SELECT encoding, count(*) AS n, CAST(sum(code) AS BIGINT) AS codes FROM (VALUES {_values()}) AS e(encoding, code, ch) GROUP BY encoding")
def encoding_dimension(spark, sf_dir):
    return encodings_table(spark).groupBy("encoding").agg(F.count("*").alias("n"), F.sum("code").alias("codes"))


@query("glyph_names")
def glyph_names(spark, sf_dir):
    return glyph_names_table(spark)


@query("running_position", """SELECT l_orderkey, l_linenumber, round(coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS before FROM lineitem""")
def running_position(spark, sf_dir):
    """Items of an order as codes of a run: each stands where the quantities before it end."""
    one = geometry.matrix(1, 0, 0, 1, 0, 0)
    zero = F.lit(0.0)
    flat = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.lit(1).alias("run_id"), F.col("l_linenumber").alias("seq"), F.struct("l_partkey", "l_suppkey", "l_quantity").alias("pos"),
        F.col("l_linenumber").alias("code"), F.lit("x").alias("text"), F.col("l_quantity").cast("double").alias("tx"), one.alias("tm"), one.alias("ctm"), F.lit(1.0).alias("font_size"), F.lit("F").alias("font_name"),
        zero.alias("r"), zero.alias("g"), zero.alias("b"), F.lit(0).alias("render_mode"),
    )
    return gl.positioned(flat).select(F.col("doc_id").alias("l_orderkey"), F.col("code").alias("l_linenumber"), F.round("x", 6).alias("before"))


@query("glyph_name_rules", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN chr(CAST(19968 + p_partkey % 20000 AS INT)) WHEN 1 THEN chr(CAST(128512 + p_partkey % 60 AS INT)) WHEN 2 THEN 'A'
        WHEN 3 THEN chr(CAST(1024 + p_partkey % 200 AS INT)) || chr(CAST(1025 + p_partkey % 200 AS INT)) WHEN 4 THEN '' ELSE '€' END AS text FROM part""")
def glyph_name_rules(spark, sf_dir):
    """Names by rule: uniXXXX, uXXXXX, a suffix, several characters, unknown and listed ones."""
    k = F.col("p_partkey")
    code = lambda v, digits: F.lpad(F.hex(v), digits, "0")
    name = (
        F.when(k % 6 == 0, F.concat(F.lit("uni"), code(k % 20000 + 19968, 4)))
        .when(k % 6 == 1, F.concat(F.lit("u"), code(k % 60 + 128512, 5)))
        .when(k % 6 == 2, F.concat(F.lit("A.alt"), k.cast("string")))
        .when(k % 6 == 3, F.concat(F.lit("uni"), code(k % 200 + 1024, 4), code(k % 200 + 1025, 4)))
        .when(k % 6 == 4, F.concat(F.lit("g"), k.cast("string")))
        .otherwise("Euro")
    )

    def decode(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([character_of(n) for n in batch.column(1).to_pylist()])], names=["p_partkey", "text"])

    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).mapInArrow(decode, f"p_partkey {table(spark, sf_dir, 'part').schema['p_partkey'].dataType.simpleString()}, text string")


# ---------------------------------------------------------------- files and table functions


def nation_files(spark, sf_dir):
    """Names of nations as files in the shared folder, written by the tasks; their folder."""
    target = folder(spark, "nations")

    def write(batches):
        from pyarrow import fs

        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = fs.FileSystem.from_uri(target if "://" in target else "file://" + target.removeprefix("file:"))
                store.create_dir(path, recursive=True)
                with store.open_output_stream(f"{path}/{key}.pdf") as f:
                    f.write(data)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["k"])

    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.col("n_name").alias("text"))
    writer.render_pdfs(n).mapInArrow(write, "k long").count()
    return target


def key_of(path):
    return F.regexp_extract(path, r"([0-9]+)\.pdf$", 1).cast("long")


NATION_LINES = "SELECT CAST(n_nationkey AS BIGINT) AS k, 0 AS line_no, rtrim(n_name) AS text FROM nation"


@query("file_source", NATION_LINES)
def file_source(spark, sf_dir):
    """``spark.read.format("pdf")`` over a folder."""
    datasource.register(spark)
    lines = spark.read.format("pdf").option("table", "lines").load(nation_files(spark, sf_dir))
    return lines.select(key_of("doc_id").alias("k"), "line_no", "text")


@query("file_reader", NATION_LINES)
def file_reader(spark, sf_dir):
    """Files as Spark's own reader lists them."""
    lines = Extraction(read_files(spark, nation_files(spark, sf_dir) + "/*.pdf")).lines()
    return lines.select(key_of("doc_id").alias("k"), "line_no", "text")


@query("token_function", """WITH t AS (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name FROM nation)
    SELECT k, 'array' AS kind, CAST(NULL AS VARCHAR) AS value FROM t UNION ALL SELECT k, 'string', n_name FROM t UNION ALL SELECT k, 'number', CAST(k AS VARCHAR) FROM t
    UNION ALL SELECT k, 'name', 'N ' || k FROM t UNION ALL SELECT k, 'string', 'hex' FROM t UNION ALL SELECT k, 'end', NULL FROM t UNION ALL SELECT k, 'word', 'TJ' FROM t""")
def token_function(spark, sf_dir):
    datasource.register(spark)
    table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey AS long) AS k", "cast(concat('% note\n[(', n_name, ')', n_nationkey, ' /N#20', n_nationkey, '<68 65 78>] TJ') AS binary) AS content").createOrReplaceTempView("inkspark_nation_tokens")
    return spark.sql("SELECT k, t.kind, t.value FROM inkspark_nation_tokens, LATERAL pdf_tokens(content) t")


@query("page_function", "SELECT CAST(n_nationkey AS BIGINT) AS k, 0 AS page_index, CAST(612 AS DOUBLE) AS width, CAST(792 AS DOUBLE) AS height, 0 AS rotation, CAST(1 AS BIGINT) AS n_shows FROM nation")
def page_function(spark, sf_dir):
    datasource.register(spark)
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("text"))
    writer.render_pdfs(n, "k").createOrReplaceTempView("inkspark_nation_pages")
    return spark.sql("SELECT doc_id AS k, p.page_index, p.width, p.height, p.rotation, p.n_shows FROM inkspark_nation_pages, LATERAL pdf_pages(content) p")


@query("show_function", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS text, 'F1' AS font_name, CAST(12 AS DOUBLE) AS font_size, CAST(36 AS DOUBLE) AS x, CAST(760 AS DOUBLE) AS y FROM nation")
def show_function(spark, sf_dir):
    datasource.register(spark)
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("text"))
    writer.render_pdfs(n, "k").createOrReplaceTempView("inkspark_nation_shows")
    return spark.sql("SELECT doc_id AS k, s.text, s.font_name, s.font_size, s.x, s.y FROM inkspark_nation_shows, LATERAL pdf_shows(content) s")


@query("code_widths", """SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS bytes FROM part""")
def code_widths(spark, sf_dir):
    """Bytes of a code by code space ranges."""
    p = F.col("p_partkey")
    cmap = F.when(p % 3 == 0, "1 begincodespacerange <00> <FF> endcodespacerange").when(p % 3 == 1, "1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange").otherwise("no ranges")
    return table(spark, sf_dir, "part").select(p.cast("long").alias("p_partkey"), code_width(cmap).alias("bytes"))


query("predictor_tiff", MD5_SQL)(_codec(lambda d: len(d).to_bytes(8, "big") + writer.tiff_rows(d, 40), lambda d: codecs.unpredict(d[8:], 2, 1, 8, 40)[: int.from_bytes(d[:8], "big")]))
