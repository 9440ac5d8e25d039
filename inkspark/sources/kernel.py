"""Documents to tables: one pass of the binary kernel over each file, as tagged Arrow rows.

A row holds the document's id, its kind and the struct of that kind.  A file that
cannot be read becomes a ``doc`` row with an error; a page that breaks off keeps
what was shown before.  Files are handled one at a time, so a task holds one file
and some megabytes of rows.

Kinds are made only if they are asked for.  Lines, page texts and glyphs come
from a page's strings where these are (``linework``); strings, fonts and codes are
there for plans that join them.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import linework
from .document import Content, Document
from .linework import plain

MATRIX = "struct<a: double, b: double, c: double, d: double, e: double, f: double>"
KINDS = {
    "doc": "struct<version: string, n_objects: bigint, page_count: bigint, declared_count: bigint, leaf_count: bigint, repaired: boolean, error_class: string, error_msg: string>",
    "xref": "struct<num: bigint, typ: int, a: bigint, b: bigint, section: bigint>",
    "node": "struct<path: array<int>, kind: string, leaf: boolean>",
    "page": "struct<page_index: int, x0: double, y0: double, x1: double, y1: double, rotate: bigint, error_msg: string, content: binary, page_count: bigint, text: string, n_lines: bigint, n_chars: bigint, layout: string>",
    "line": "struct<page_index: int, line_no: int, y: double, x: double, end_x: double, size: double, fonts: array<string>, n_chars: bigint, text: string>",
    "glyph": "struct<page_index: int, seq: bigint, code: int, text: string, x: double, y: double, size: double, adv_x: double, adv_y: double, font: string, r: double, g: double, b: double, render_mode: int>",
    "show": f"struct<page_index: int, seq: bigint, run_id: bigint, data: binary, codes: array<int>, kern: double, font_key: string, font_name: string, font_size: double, tc: double, tw: double, tz: double, rise: double, tm: {MATRIX}, ctm: {MATRIX}, r: double, g: double, b: double, render_mode: int>",
    "font": "struct<font_key: string, font_name: string, subtype: string, base_font: string, is_cid: boolean, code_bytes: int, default_width: double, encoding: string>",
    "code": "struct<font_key: string, idx: int, code: int, uni: string, diff: string, width: double>",
}
#: kinds whose rows come as columns of a page's rows
COLUMNS = ("line", "glyph")
#: what needs content to be run: kinds, and of page rows "text" (text and counts), "layout" and "run" (their errors)
SHOWN = frozenset(("show", "font", "code", "line", "glyph", "text", "layout", "run"))
UNDEFINED = ""


def geometry(box, rotate):
    """(width, height, rotation, matrix) of a page as it is shown: the box's corner at the origin, then turned.

    A missing box is US letter; a rotation that is no multiple of 90 is none.
    """
    x0, y0, x1, y1 = box or (0.0, 0.0, 612.0, 792.0)
    x0, x1, y0, y1 = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
    w, h, turn = x1 - x0, y1 - y0, rotate % 360
    if turn == 90:
        return h, w, 90, (0.0, 1.0, -1.0, 0.0, h + y0, -x0)
    if turn == 180:
        return w, h, 180, (-1.0, 0.0, 0.0, -1.0, w + x0, h + y0)
    if turn == 270:
        return h, w, 270, (0.0, -1.0, 1.0, 0.0, -y0, w + x0)
    return w, h, 0, (1.0, 0.0, 0.0, 1.0, -x0, -y0)


SPAN = re.compile(r"([0-9]*)-([0-9]*)")
ONE = re.compile(r"\+?([0-9]+)")


def picked(spec: str, total: int) -> frozenset:
    """Page indices that a spec picks of ``total`` pages; ``functions.geometry.page_spec`` has them in order."""
    out = set()
    for chunk in spec.replace(" ", "").split(","):
        if m := SPAN.fullmatch(chunk):
            a, b = int(m[1] or 1), int(m[2] or total)
            if max(a, b) < 1 << 31:
                out.update(range(max(1, min(a, b)) - 1, min(total, max(a, b))))
        elif (m := ONE.fullmatch(chunk)) and 1 <= int(m[1]) <= total:
            out.add(int(m[1]) - 1)
    return frozenset(out)


def rows(data: bytes, want=frozenset(("show", "page", "xref", "node")), pages=None, strict=False, limit=None, options=None):
    """(kind, tuple of the kind's fields) of one document; of lines and glyphs a tuple of columns for each page.

    pages: a page spec or page indices to run, None for all; options: line and space tolerances.  The document's own row comes last,
    when nothing can go wrong any more.
    """
    doc = Document(data, strict, **({"limit": limit} if limit else {}))
    leaves = doc.pages()
    declared = doc.declared_count()
    count = declared if declared is not None and not strict else len(leaves)
    if isinstance(pages, str):
        pages = picked(pages, max(0, count))
    if "xref" in want:
        yield from (("xref", e) for e in doc.sections)
    if "node" in want:
        yield from (("node", (list(path), str(n.get("Type", "")), leaf)) for n, path, leaf in doc.tree())
    fonts, used, known = {}, {}, {}
    shown = not SHOWN.isdisjoint(want)
    strings = not {"show", "font", "code"}.isdisjoint(want)
    placed = not {"line", "glyph", "text", "layout"}.isdisjoint(want)
    for i, page in enumerate(leaves[: max(0, count)]):
        if pages is not None and i not in pages:
            continue
        box, rotate, error, data, text, n_lines, n_chars, layout = doc.box(page), doc.rotation(page), None, b"", None, 0, 0, None
        try:
            if shown or "content" in want:
                data, error = doc.content(page)
            if shown:
                content = Content(doc, fonts, f"p{i}")
                try:
                    if data:
                        content.run(data, page.get("Resources"), geometry(box, rotate)[3])
                except RecursionError:
                    content.error = "nested too deeply"
                error = content.error or error
                if strings:
                    yield from _strings(i, content.shows, fonts, used)
                if placed:
                    glyphs = linework.place(content.shows, fonts, known, strict)
                    if "glyph" in want and len(glyphs):
                        yield "glyph", _glyphs(i, glyphs)
                    if "layout" in want:
                        layout = linework.page_layout(glyphs, options or {})
                    if "line" in want or "text" in want:
                        lines = linework.page_lines(glyphs, options or {})
                        if lines is not None:
                            n_lines, n_chars = len(lines), len(glyphs)
                            if "line" in want:
                                yield "line", (np.full(n_lines, i, np.int32), np.arange(n_lines, dtype=np.int32), lines.y, lines.x, lines.end_x, lines.size, lines.fonts, lines.n_chars, lines.text)
                        text = "\n".join(lines.text) if lines is not None else ""
        except Exception as e:  # one page's; the others go on
            error = f"{type(e).__name__}: {e}"
        yield "page", (i, *(box or (None,) * 4), rotate, plain(error), data if "content" in want else None, count, text, n_lines, n_chars, layout)
    if strings:
        for key, font in fonts.items():
            yield "font", (key, plain(font.name), plain(font.subtype), plain(font.base_font), font.is_cid, font.code_bytes, font.default_width, font.encoding)
        for key, own in used.items():
            font = fonts.get(key)
            for code, idx in own.items():
                if font is None:
                    yield "code", (key, idx, code, None, None, 0.0)
                else:
                    yield "code", (key, idx, code, plain(font.unicode.get(code)), plain(font.differences.get(code)), font.widths.get(code, font.default_width))
    yield "doc", (doc.version, len(doc.xref), count, declared, len(leaves), doc.repaired, None, None)


def _strings(i, shows, fonts, used):
    for seq, (run, text, kern, key, name, size, tc, tw, tz, rise, tm, ctm, color, mode) in enumerate(shows):
        codes = None
        if text is not None:
            font = fonts.get(key)
            own = used.setdefault(key or UNDEFINED, {})
            codes = [own.setdefault(c, len(own)) for c in (font.codes(text) if font else text)]
        yield "show", (i, seq, run, text, codes, kern, key or UNDEFINED, plain(name), size, tc, tw, tz, rise, tm, ctm, *color, mode)


def _glyphs(i, g):
    """Columns of a page's glyphs, in the order in which they are shown."""
    by = slice(None) if (g.row[1:] >= g.row[:-1]).all() else np.lexsort((g.at, g.row))
    row = g.row[by]
    texts = g.text()
    texts = texts if isinstance(by, slice) else [texts[k] for k in by.tolist()]
    names = [plain(s[4]) for s in g.shows]
    color = np.array([s[12] for s in g.shows], float).reshape(-1, 3)[row]
    mode = np.array([s[13] for s in g.shows], np.int64)[row]
    return (np.full(len(row), i, np.int32), np.arange(1, len(row) + 1), g.code[by].astype(np.int32), texts, g.x[by], g.y[by], g.size[by], g.adv_x[by], g.adv_y[by], [names[k] for k in row.tolist()], *color.T, mode.astype(np.int32))


def _column(values, kind):
    """Arrow array of one field's values; lists and matrices are built from flat ones."""
    if pa.types.is_list(kind) and pa.types.is_integer(kind.value_type):
        sizes = [0 if v is None else len(v) for v in values]
        at = np.zeros(len(values) + 1, np.int32)
        np.cumsum(sizes, out=at[1:])
        flat = np.fromiter(itertools.chain.from_iterable(v for v in values if v), np.int32, int(at[-1]))
        none = np.fromiter((v is None for v in values), bool, len(values))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, kind.value_type), mask=pa.array(none) if none.any() else None)
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in zip(*values)], fields=list(kind))
    return pa.array(values, kind)


def _joined(parts, kind):
    """Arrow array of one field of several pages' columns."""
    if isinstance(parts[0], np.ndarray):
        return pa.array(np.concatenate(parts), kind)
    return pa.array(list(itertools.chain.from_iterable(parts)), kind)


def run(df: DataFrame, content: str = "content", doc_id: str = "doc_id", want=(), pages=None, strict=False, mode="PERMISSIVE", limit=None, options=None, batch_bytes=4_000_000) -> DataFrame:
    """(doc_id, kind, one struct column for each kind) of a DataFrame of files.

    want: kinds besides ``doc`` and ``page``, and what ``SHOWN`` and "content" name.  mode FAILFAST raises on the first
    file that cannot be read, as Spark's readers do.
    """
    kinds = [k for k in KINDS if k in ("doc", "page") or k in want]
    id_type = df.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("kind", T.StringType())])
    for k in kinds:
        schema = schema.add(k, T.DataType.fromDDL(KINDS[k]))
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted, asked = frozenset(want), pages if pages is None or isinstance(pages, str) else frozenset(pages)
    arrow = to_arrow_schema(schema)

    def tables(held):
        """A batch for each kind: its struct built field by field, the other kinds' null."""
        for k, rows_ in held.items():
            if rows_:
                ids, structs = zip(*rows_)
                kind = arrow.field(k).type
                if k in COLUMNS:
                    ids = list(itertools.chain.from_iterable(itertools.repeat(i, len(s[0])) for i, s in rows_))
                    own = [_joined(v, f.type) for v, f in zip(zip(*structs), kind)]
                else:
                    own = [_column(v, f.type) for v, f in zip(zip(*structs), kind)]
                own = pa.StructArray.from_arrays(own, fields=list(kind))
                rest = [own if other == k else pa.nulls(len(ids), arrow.field(other).type) for other in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(ids, arrow.field(0).type), pa.array([k] * len(ids), pa.string()), *rest], schema=arrow)

    def weight(kind, values):
        if kind == "show":
            return 300 + 4 * len(values[4] or ())
        return 200 + 120 * len(values[0]) if kind in COLUMNS else 200 + (len(values[7] or b"") + len(values[9] or "") + len(values[12] or "") if kind == "page" else 0)

    def kernel(batches):
        held, size = {k: [] for k in kinds}, 0
        for batch in batches:
            for i in range(batch.num_rows):
                doc, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                before = {k: len(v) for k, v in held.items()}
                try:
                    for kind, values in rows(data or b"", wanted, asked, strict, limit, options):
                        if kind in held:
                            held[kind].append((doc, values))
                            size += weight(kind, values)
                            if size > 4 * batch_bytes:  # a large document's rows leave in parts
                                yield from tables(held)
                                held, size = {k: [] for k in kinds}, 0
                                before = dict.fromkeys(kinds, 0)
                except Exception as e:
                    if mode == "FAILFAST":
                        raise
                    for k, n in before.items():  # of a document that fails nothing but the error
                        del held[k][n:]
                    held["doc"].append((doc, (None,) * 6 + (type(e).__name__, plain(str(e)))))
                if size > batch_bytes:
                    yield from tables(held)
                    held, size = {k: [] for k in kinds}, 0
        yield from tables(held)

    return df.select(F.col(doc_id).alias("doc_id"), F.col(content).cast("binary").alias("content")).mapInArrow(kernel, schema)
