"""PDF writer: rows of text as pages, with the file features that readers must cope with."""

from __future__ import annotations

import base64
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WRAP, ROWS, LEADING, TOP, LEFT, SIZE = 90, 60, 12.0, 760.0, 36.0, 12.0


class File:
    """Objects by number, written with one of several kinds of cross-references."""

    def __init__(self):
        self.objects = {}

    def add(self, body, num=None):
        num = num or max(self.objects, default=0) + 1
        self.objects[num] = body if isinstance(body, bytes) else body.encode("latin-1")
        return num

    def stream(self, data, extra="", num=None, compress=False):
        if compress:
            data, extra = zlib.compress(data), extra + " /Filter /FlateDecode"
        return self.add(f"<< {extra} /Length {len(data)} >>\nstream\n".encode("latin-1") + data + b"\nendstream", num)

    def _bodies(self, out, eol, skip=()):
        at = {}
        for num, body in sorted(self.objects.items()):
            if num not in skip:
                at[num] = len(out)
                out += b"%d 0 obj" % num + eol + body + eol + b"endobj" + eol
        return at

    def table(self, root, eol=b"\n", more=""):
        """The file with a cross-reference table."""
        out = bytearray(b"%PDF-1.4" + eol)
        at = self._bodies(out, eol)
        start, size = len(out), max(self.objects) + 1
        pad = eol if len(eol) == 2 else b" " + eol
        out += b"xref" + eol + b"0 %d" % size + eol + b"0000000000 65535 f" + pad
        for num in range(1, size):
            out += (b"%010d 00000 n" % at[num] if num in at else b"0000000000 00000 f") + pad
        out += b"trailer" + eol + f"<< /Size {size} /Root {root} 0 R {more} >>".encode() + eol + b"startxref" + eol + b"%d" % start + eol + b"%%EOF" + eol
        return bytes(out)

    def cross_stream(self, root, packed=(), compress=True):
        """The file with a cross-reference stream; the objects ``packed`` go into an object stream."""
        out = bytearray(b"%PDF-1.5\n")
        places = {}
        if packed:
            head, body = [], b""
            holder = max(self.objects) + 1
            for i, num in enumerate(packed):
                head.append(f"{num} {len(body)}")
                body += self.objects[num] + b" "
                places[num] = (2, holder, i)
            first = " ".join(head).encode() + b" "
            self.stream(first + body, f"/Type /ObjStm /N {len(packed)} /First {len(first)}", holder, compress)
        for num, at in self._bodies(out, b"\n", set(packed)).items():
            places[num] = (1, at, 0)
        own = max(self.objects) + 1
        places[own] = (1, len(out), 0)
        table = b"".join(bytes([t]) + a.to_bytes(4, "big") + b.to_bytes(2, "big") for t, a, b in (places.get(n, (0, 0, 0)) for n in range(own + 1)))
        self.stream(table, f"/Type /XRef /W [1 4 2] /Size {own + 1} /Root {root} 0 R", own, compress)
        start = len(out)
        out += b"%d 0 obj\n" % own + self.objects.pop(own) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % start
        return bytes(out)


    def updated(self, root, new):
        """The file with a cross-reference table, and behind it a section that replaces the objects ``new``."""
        out = bytearray(self.table(root))
        before = int(re.findall(rb"startxref\n(\d+)", out)[-1])
        at = {}
        for num, body in sorted(new.items()):
            at[num] = len(out)
            out += b"%d 0 obj\n" % num + body + b"\nendobj\n"
        start = len(out)
        out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (num, place) for num, place in at.items())
        out += b"trailer\n<< /Size %d /Root %d 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (max(self.objects) + 1, root, before, start)
        return bytes(out)

    def hybrid(self, root, packed):
        """The file with a table that has all but the objects ``packed``; these are in an object stream that the trailer's XRefStm tells of."""
        holder, head, body = max(self.objects) + 1, [], b""
        for num in packed:
            head.append(f"{num} {len(body)}")
            body += self.objects[num] + b" "
        first = " ".join(head).encode() + b" "
        self.stream(first + body, f"/Type /ObjStm /N {len(packed)} /First {len(first)}", holder, True)
        out = bytearray(b"%PDF-1.5\n")
        at = self._bodies(out, b"\n", set(packed))
        own = holder + 1
        table = b"".join(bytes([2]) + holder.to_bytes(4, "big") + packed.index(n).to_bytes(2, "big") if n in packed else bytes(7) for n in range(own))
        self.stream(table, f"/Type /XRef /W [1 4 2] /Size {own}", own, True)
        hidden = len(out)
        out += b"%d 0 obj\n" % own + self.objects.pop(own) + b"\nendobj\n"
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % own
        for num in range(1, own):
            out += b"%010d 00000 n \n" % at[num] if num in at else b"0000000000 00000 f \n"
        out += f"trailer\n<< /Size {own} /Root {root} 0 R /XRefStm {hidden} >>\nstartxref\n{start}\n%%EOF\n".encode()
        return bytes(out)


def escape(text: bytes) -> bytes:
    return re.sub(rb"([()\\\r])", lambda m: b"\\r" if m[1] == b"\r" else b"\\" + m[1], text)


def simple_font(base="Helvetica", first=32, widths=None, encoding="/WinAnsiEncoding", more=""):
    widths = [500] * 224 if widths is None else widths
    return f"<< /Type /Font /Subtype /Type1 /BaseFont /{base} /Encoding {encoding} /FirstChar {first} /LastChar {first + len(widths) - 1} /Widths [{' '.join(map(str, widths))}] {more} >>"


def wrapped(text: str, wrap=WRAP):
    """Lines of a text, cut every ``wrap`` characters; an empty line has no rows."""
    return [line[i : i + wrap] for line in (text or "").split("\n") for i in range(0, len(line), wrap)]


def page_content(rows, leading=LEADING):
    """Content of a page with one text object for each row."""
    out = []
    for i, row in enumerate(rows):
        out.append(b"BT /F1 %g Tf %g %g Td (%s) Tj ET" % (SIZE, LEFT, TOP - i * leading, escape(row.encode("cp1252", "replace"))))
    return b"\n".join(out)


def spaced_content(rows):
    """Content whose rows have character and word spacing, scaling, and a kerning number in their middle."""
    out = []
    for i, row in enumerate(rows):
        a, b = (escape(part.encode("cp1252", "replace")) for part in (row[: len(row) // 2], row[len(row) // 2 :]))
        out.append(b"BT /F1 %g Tf 2 Tc 3 Tw 150 Tz %g %g Td [(%s) -500 (%s)] TJ ET" % (SIZE, LEFT, TOP - i * LEADING, a, b))
    return b"\n".join(out)


def cid_content(rows):
    """Content of two-byte codes, as hex strings; rows follow each other by T*."""
    out = [b"BT /F1 %g Tf %g TL %g %g Td" % (SIZE, LEADING, LEFT, TOP + LEADING)]
    out += [b"T* <%s> Tj" % row.encode("utf-16-be").hex().encode() for row in rows]
    return b"\n".join([*out, b"ET"])


def encoded(row: str) -> bytes:
    return row.encode("cp1252", "replace")


def row_at(i):
    """(x, y) of a page's row."""
    return LEFT, TOP - i * LEADING


def saved_content(rows):
    """Rows in saved and restored states: each other one in two nested translations, the next with none left of them."""
    out = []
    for i, row in enumerate(rows):
        x, y = row_at(i)
        if i % 2:
            out.append(b"BT /F1 %g Tf %g %g Td (%s) Tj ET" % (SIZE, x, y, escape(encoded(row))))
        else:
            out.append(b"q 1 0 0 1 5 7 cm q 2 0 0 2 0 0 cm BT /F1 %g Tf %g %g Td (%s) Tj ET Q Q" % (SIZE / 2, (x - 5) / 2, (y - 7) / 2, escape(encoded(row))))
    return b"\n".join(out)


def matrix_content(rows):
    """Rows placed and scaled by text matrices."""
    return b"\n".join(b"BT /F1 %g Tf 2 0 0 2 %g %g Tm (%s) Tj ET" % (SIZE / 2, *row_at(i), escape(encoded(row))) for i, row in enumerate(rows))


def moved_content(rows):
    """Rows that follow each other by TD, which sets the leading, and T*."""
    out = [b"BT /F1 %g Tf %g %g Td" % (SIZE, LEFT, TOP + LEADING)]
    out += [(b"0 %g TD (%s) Tj" % (-LEADING, escape(encoded(row)))) if i % 3 == 0 else b"T* (%s) Tj" % escape(encoded(row)) for i, row in enumerate(rows)]
    return b"\n".join([*out, b"ET"])


def quoted_content(rows):
    """Rows shown by the quote operators; the second one sets spacings, here to nothing."""
    out = [b"BT /F1 %g Tf %g TL 3 Tw 2 Tc %g %g Td 0 Tw 0 Tc" % (SIZE, LEADING, LEFT, TOP + LEADING)]
    out += [(b"(%s) '" if i % 2 else b'0 0 (%s) "') % escape(encoded(row)) for i, row in enumerate(rows)]
    return b"\n".join([*out, b"ET"])


def inline_content(rows):
    """Rows with inline images between them, whose data look like operators."""
    image = b"BI /W 2 /H 2 /BPC 8 /CS /G /F [/AHx] ID BT (no text) Tj ET >\nEI\n"
    return image.join(b"BT /F1 %g Tf %g %g Td (%s) Tj ET\n" % (SIZE, *row_at(i), escape(encoded(row))) for i, row in enumerate(rows))


def octal_content(rows):
    """Rows as strings of octal escapes, a line break in the middle of each that counts for nothing."""
    octal = lambda raw: b"".join(b"\\%03o" % c for c in raw)
    out = []
    for i, row in enumerate(rows):
        raw = encoded(row)
        out.append(b"BT /F1 %g Tf %g %g Td (%s\\\n%s) Tj ET" % (SIZE, *row_at(i), octal(raw[: len(raw) // 2]), octal(raw[len(raw) // 2 :])))
    return b"\n".join(out)


def shifted_content(rows):
    """Rows whose codes are their bytes and one more; the font's map takes it back."""
    return b"\n".join(b"BT /F1 %g Tf %g %g Td <%s> Tj ET" % (SIZE, *row_at(i), bytes((c + 1) % 256 for c in encoded(row)).hex().encode()) for i, row in enumerate(rows))


def named_fonts(rows):
    """(two fonts whose codes 1, 2, ... are the rows' characters by name, up and down; content that takes turns with them)."""
    chars = sorted({c for row in rows for c in encoded(row).decode("cp1252", "replace")}) or ["x"]
    name = lambda c: c if c.isascii() and c.isalpha() else f"uni{ord(c):04X}"
    fonts, out = [], []
    for order in (chars, chars[::-1]):
        names = " ".join(f"/{name(c)}" for c in order)
        fonts.append(simple_font(first=1, widths=[500] * len(order), encoding=f"<< /Type /Encoding /Differences [1 {names}] >>"))
    for i, row in enumerate(rows):
        codes = {c: k for k, c in enumerate(chars[::-1] if i % 2 else chars, 1)}
        out.append(b"BT /F%d %g Tf %g %g Td <%s> Tj ET" % (1 + i % 2, SIZE, *row_at(i), bytes(codes[c] for c in encoded(row).decode("cp1252", "replace")).hex().encode()))
    return fonts, b"\n".join(out)


def tiff_rows(data: bytes, columns: int) -> bytes:
    """Rows of ``columns`` bytes as differences to the byte on their left; the last row is filled up with blanks."""
    data = data.ljust(-(-len(data) // columns) * columns)
    return b"".join(bytes((b - a) & 255 for a, b in zip(b"\0" + data[i : i + columns - 1], data[i : i + columns])) for i in range(0, len(data), columns))


def to_unicode_map(chars="", ranges=(), arrays=()):
    """A ToUnicode map of (code, text) pairs, (first, last, base) ranges and (first, last, texts) ranges."""
    code = lambda n: f"<{n:04X}>"
    text = lambda t: f"<{t.encode('utf-16-be').hex().upper()}>"
    lines = ["1 begincodespacerange <0000> <FFFF> endcodespacerange"]
    lines += ["beginbfchar", *(f"{code(c)} {text(t)}" for c, t in chars), "endbfchar"] if chars else []
    every = [f"{code(a)} {code(b)} {code(base)}" for a, b, base in ranges] + [f"{code(a)} {code(b)} [{' '.join(map(text, ts))}]" for a, b, ts in arrays]
    lines += ["beginbfrange", *every, "endbfrange"] if every else []
    return "\n".join(lines).encode()


def cid_font(f, tounicode: bytes, w="", dw=500):
    """A Type0 font with its descendant and map, added to ``f``."""
    cmap = f.stream(tounicode, compress=True)
    kid = f.add(f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Wide /DW {dw} {'/W [' + w + ']' if w else ''} >>")
    return f.add(f"<< /Type /Font /Subtype /Type0 /BaseFont /Wide /Encoding /Identity-H /DescendantFonts [{kid} 0 R] /ToUnicode {cmap} 0 R >>")


def lzw_encode(data: bytes) -> bytes:
    """LZW as the decoder reads it, with early change."""
    table, width, bits, n = {bytes([i]): i for i in range(256)}, 9, 256, 9
    size, last, out = 258, b"", []

    def put(code):
        nonlocal bits, n
        bits, n = bits << width | code, n + width

    for byte in data:
        own = last + bytes([byte])
        if own in table:
            last = own
            continue
        put(table[last])
        table[own] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        last = own[-1:]
        if size == 4094:
            put(table[last])
            put(256)
            table, width, size, last = {bytes([i]): i for i in range(256)}, 9, 258, b""
        if n > 4096:
            keep = n % 8
            out.append((bits >> keep).to_bytes(n // 8, "big"))
            bits, n = bits & (1 << keep) - 1, keep
    if last:
        put(table[last])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    pad = -n % 8
    out.append((bits << pad).to_bytes((n + pad) // 8, "big"))
    return b"".join(out)


def run_length_encode(data: bytes) -> bytes:
    out = []
    for m in re.finditer(rb"([\s\S])\1{1,127}|(?:([\s\S])(?!\2)){1,128}", data):
        run = m[0]
        out.append(bytes([257 - len(run)]) + run[:1] if m[1] is not None else bytes([len(run) - 1]) + run)
    return b"".join(out) + b"\x80"


def predict(data: bytes, columns: int, kind: int) -> bytes:
    """Rows of ``columns`` bytes with the PNG row filter ``kind`` (0 to 4); the last row is filled up with zeros."""
    out, above = [], bytes(columns)
    for i in range(0, len(data), columns):
        row = data[i : i + columns].ljust(columns, b"\0")
        left, corner = b"\0" + row[:-1], b"\0" + above[:-1]
        if kind == 4:
            guess = [min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2] for a, b, c in zip(left, above, corner)]
        else:
            guess = [bytes(columns), left, above, [(a + b) // 2 for a, b in zip(left, above)]][kind]
        out.append(bytes([kind]) + bytes((x - g) & 255 for x, g in zip(row, guess)))
        above = row
    return b"".join(out)


#: how the content of a style's pages is written, if not as ``page_content``
CONTENT = {"cid": cid_content, "widths": cid_content, "spaced": spaced_content, "saved": saved_content, "matrices": matrix_content, "moves": moved_content, "quotes": quoted_content, "inline": inline_content, "octal": octal_content, "one_byte": shifted_content}
#: kids of an intermediate node, at most
FAN_OUT = 3


def style_font(f, style):
    """The font of a style as it stands in resources."""
    if style == "direct":
        return simple_font()
    if style == "cid":
        return f"{cid_font(f, to_unicode_map(ranges=[(0, 0xFFFF, 0)]))} 0 R"
    if style == "widths":
        return f"{cid_font(f, to_unicode_map(ranges=[(0, 0xFFFF, 0)]), w='0 [500 500] 2 40 500 41 [500] 42 65535 500', dw=1000)} 0 R"
    if style == "one_byte":
        back = [f"<{(c + 1) % 256:02X}> <{ord(bytes([c]).decode('cp1252', 'replace')):04X}>" for c in range(256)]
        cmap = "begincodespacerange <00> <FF> endcodespacerange beginbfchar\n" + "\n".join(back) + "\nendbfchar"
        return f"{f.add(simple_font(first=0, widths=[500] * 256, more=f'/ToUnicode {f.stream(cmap.encode(), compress=True)} 0 R'))} 0 R"
    return f"{f.add(simple_font())} 0 R"


def page_stream(f, page, style):
    """Entries of a page's dictionary for its content and, where a style has its own, its resources."""
    data = CONTENT.get(style, page_content)(page)
    if style == "form":
        return data, None
    if style == "parts":  # an array of streams, cut between two rows
        cut = data.find(b"\n", len(data) // 2) if b"\n" in data[len(data) // 2 :] else len(data)
        return f"/Contents [{f.stream(data[:cut], compress=True)} 0 R {f.stream(data[cut:])} 0 R]", None
    if style == "tiff":
        return f"/Contents {f.stream(zlib.compress(tiff_rows(data, 40)), '/Filter [/FlateDecode] /DecodeParms [<< /Predictor 2 /Colors 1 /BitsPerComponent 8 /Columns 40 >>]')} 0 R", None
    if style == "predicted":
        rows = predict(data.ljust(-(-len(data) // 50) * 50), 50, 4)
        return f"/Contents {f.stream(zlib.compress(rows), '/Filter /FlateDecode /DecodeParms << /Predictor 15 /Columns 50 >>')} 0 R", None
    if style == "filters":
        coded = base64.a85encode(lzw_encode(data)) + b"~>"
        return f"/Contents {f.stream(coded, '/Filter [/ASCII85Decode /LZWDecode]')} 0 R", None
    if style == "differences":
        fonts, data = named_fonts(page)
        return f"/Contents {f.stream(data, compress=True)} 0 R", f"<< /Font << {' '.join(f'/F{i} {f.add(x)} 0 R' for i, x in enumerate(fonts, 1))} >> >>"
    return f"/Contents {f.stream(data, compress=True)} 0 R", None


def page_tree(f, tree, kids, inherited):
    """Intermediate nodes of at most ``FAN_OUT`` kids each below the node ``tree``; what pages inherit stands at the top."""
    level = [(k, 1) for k in kids]
    while len(level) > FAN_OUT:
        above = []
        for i in range(0, len(level), FAN_OUT):
            part = level[i : i + FAN_OUT]
            n = sum(c for _, c in part)
            above.append((f.add(f"<< /Type /Pages /Count {n} /Kids [{' '.join(f'{k} 0 R' for k, _ in part)}] >>"), n))
        level = above
    f.add(f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k, _ in level)}] {inherited} >>", tree)


def render(text: str, style: str = "table") -> bytes:
    """A document of a text's wrapped lines, 60 a page.

    style, by what differs from a plain file with a cross-reference table.  The file: crlf, cr, stream (cross-reference
    stream), packed (object stream), hybrid (both kinds of cross-references), updated (every page's content is replaced
    by an appended section), damaged (wrong startxref), repacked (object stream and wrong startxref), tree (nested page
    tree with inherited entries), encrypted and broken (no document at all).  The streams: parts, tiff, predicted, filters.
    The fonts: direct (in the resources), differences (two fonts of glyph names), cid (two-byte codes), widths (/W),
    one_byte (a map of single bytes).  The content: form (the text stands in a form moved by 10, -20), spaced, saved,
    matrices, moves, quotes, inline, octal (see the functions of these names).
    """
    if style == "broken":
        return b"no document " + (text or "").encode()
    rows = wrapped(text)
    pages = [rows[i : i + ROWS] for i in range(0, len(rows), ROWS)] or [[]]
    f = File()
    catalog, tree = f.add("<< /Type /Catalog /Pages 2 0 R >>"), f.add("")
    font = style_font(f, style)
    box, resources = "/MediaBox [0 0 612 792]", f"<< /Font << /F1 {font} >> >>"
    kids, contents = [], []
    for page in pages:
        entry, own = page_stream(f, page, style)
        if style == "form":
            form = f.stream(entry, f"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 10 -20] /Resources {resources}", compress=True)
            entry, own = f"/Contents {f.stream(b'q /X1 Do Q')} 0 R", f"<< /XObject << /X1 {form} 0 R >> >>"
        contents.append(max(f.objects))
        more = "" if style == "tree" else f"{box} /Resources {own or resources}"
        kids.append(f.add(f"<< /Type /Page /Parent 2 0 R {entry} {more} >>"))
    if style == "tree":
        page_tree(f, tree, kids, f"{box} /Resources {resources}")
    else:
        f.add(f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>", tree)
    if style == "packed":
        return f.cross_stream(catalog, packed=[catalog, tree, *([int(font.split()[0])]), *kids])
    if style == "repacked":
        return re.sub(rb"startxref\n\d+", b"startxref\n999999", f.cross_stream(catalog, packed=[tree, *([int(font.split()[0])]), *kids]))
    if style == "hybrid":
        return f.hybrid(catalog, packed=[tree, int(font.split()[0]), *kids])
    if style == "stream":
        return f.cross_stream(catalog)
    if style == "updated":
        new = {n: f.objects[n] for n in contents}
        for n in contents:
            f.stream(b"BT /F1 12 Tf 36 760 Td (an older text) Tj ET", num=n)
        return f.updated(catalog, new)
    data = f.table(catalog, {"crlf": b"\r\n", "cr": b"\r"}.get(style, b"\n"), "/Encrypt << /Filter /Standard >>" if style == "encrypted" else "")
    if style == "damaged":
        data = re.sub(rb"startxref\n\d+", b"startxref\n999999", data)
    return data


def render_pdfs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", style="table") -> DataFrame:
    """(doc_id, content) of a DataFrame of texts; ``style``: a name or a column of names."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                styles = part.column(2).to_pylist()
                made = [render(t or "", s) for t, s in zip(part.column(1).to_pylist(), styles)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["doc_id", "content"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.lit(style) if isinstance(style, str) else style).alias("style")).mapInArrow(run, f"doc_id {kind}, content binary")
