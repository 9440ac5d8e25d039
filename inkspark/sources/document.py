"""One PDF file: cross-references, objects, pages, fonts and shown strings.

``Document`` finds objects; ``Pages`` is a walk of the page tree; ``Content``
runs content streams and records every shown string with the state it was shown
in.  Nothing here computes glyph positions: within a text run (from one of
BT, Td, TD, Tm, T* and the quote operators to the next) the text matrix moves
by translations along its own x axis only, so that positions are a prefix sum
over advances, which the logical plan does.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from ..functions import codecs
from ..functions.encodings import ENCODINGS, character_of
from .syntax import Name, ParseError, Ref, Scanner, Stream, indirect, numeric, whole

FREE, IN_FILE, PACKED = 0, 1, 2
STARTXREF = re.compile(rb"startxref[\0\t\n\f\r ]*([0-9]+)")
OBJECT = re.compile(rb"(?<![0-9])([0-9]{1,10})[\0\t\n\f\r ]+([0-9]{1,5})[\0\t\n\f\r ]+obj\b")
TRAILER = re.compile(rb"\btrailer\b")
LINE = re.compile(rb"[\0\t\n\f\r ]*([^\r\n]*)(?:\r\n|\r|\n|\Z)")
ENTRY = re.compile(rb"([0-9]+)[ \t\0\f]+([0-9]+)[ \t\0\f]+([a-z]\S*)")
INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")
MAX_FORMS = 12
MAX_HOPS = 32
MAX_SPAN = 65536


class DocumentError(ValueError):
    """A file that is no readable document."""


class Document:
    def __init__(self, data: bytes, strict: bool = False, limit: int = codecs.MAX_DECODED):
        self.data, self.strict, self.limit = bytes(data), strict, limit
        m = re.search(rb"%PDF-([\s\S]{0,4})", self.data[:1024])
        self.version = m[1].decode("latin-1").strip() if m else "1.4"
        self.loaded, self.busy, self.packed = {}, set(), {}
        self.scopes = {}  # by resource dictionary: the keys of its fonts, and the dictionary, which so keeps its identity
        self.repaired = False
        self.sections: list[tuple] = []  # (num, type, a, b, section): every entry as found
        try:
            self.xref, self.trailer = self._linked()
        except Exception:
            self.xref, self.trailer, self.sections = {}, {}, []
        if not self.xref or "Root" not in self.trailer:
            self._rebuild()
        if "Encrypt" in self.trailer:
            raise DocumentError("the document is encrypted")

    # ------------------------------------------------------------ cross-references

    def _linked(self):
        """Entries and trailer along the chain of sections, the newest first; the first seen wins."""
        marks = STARTXREF.findall(self.data)
        if not marks:
            raise DocumentError("no startxref")
        at, seen = int(marks[-1]), set()
        xref, trailer = {}, {}
        self.xref = xref
        while at is not None and at not in seen and 0 <= at < len(self.data):
            seen.add(at)
            section = len(seen)
            entries, own = self._section(at)
            for num, typ, a, b in entries:
                self.sections.append((num, typ, a, b, section))
                if typ != FREE or self.strict:
                    xref.setdefault(num, (typ, a, b))
            for key, value in own.items():
                if key != "Prev":
                    trailer.setdefault(key, value)
            at = own.get("Prev") if whole(own.get("Prev")) else None
        return {n: e for n, e in xref.items() if e[0] != FREE}, trailer

    def _section(self, at):
        for probe in (at, at + 1, at - 1, at + 2):
            if 0 <= probe < len(self.data):
                if self.data[probe : probe + 32].lstrip()[:4] == b"xref":
                    return self._table(self.data.index(b"xref", probe) + 4)
                try:
                    value = indirect(self.data, probe)[2]
                except ParseError:
                    continue
                if isinstance(value, Stream) and value.dict.get("Type") == "XRef":
                    return self._stream_section(value)
        raise DocumentError(f"no cross-reference section at {at}")

    def _table(self, at):
        entries = []
        while True:
            m = LINE.match(self.data, at)
            head = m[1].split()
            if m.end() <= at or m[1].startswith(b"trailer") or len(head) != 2 or not (head[0].isdigit() and head[1].isdigit()):
                break
            at = m.end()
            for i in range(int(head[1])):
                m = LINE.match(self.data, at)
                e = ENTRY.match(m[1])
                if not e:
                    break
                entries.append((int(head[0]) + i, IN_FILE if e[3][:1] == b"n" else FREE, int(e[1]), int(e[2])))
                at = m.end()
        scanner = Scanner(self.data, at)
        trailer = {}
        if scanner.next() == ("word", b"trailer"):
            trailer = scanner.object()
            trailer = trailer if isinstance(trailer, dict) else {}
            if whole(trailer.get("XRefStm")):
                try:
                    more, own = self._stream_section(indirect(self.data, trailer["XRefStm"])[2])
                    entries += more
                    trailer = {k: v for k, v in own.items() if k != "Prev"} | trailer
                except (ParseError, DocumentError, codecs.FilterError):
                    pass
        return entries, trailer

    def _stream_section(self, value):
        if not isinstance(value, Stream):
            raise DocumentError("no cross-reference stream")
        data = self.decoded(value)
        widths = value.dict.get("W")
        if not isinstance(widths, list) or len(widths) < 3 or not all(numeric(w) and w >= 0 for w in widths[:3]) or not sum(map(int, widths[:3])):
            raise DocumentError("a cross-reference stream without widths")
        a, b, c = map(int, widths[:3])
        size = a + b + c
        index = value.dict.get("Index")
        if not isinstance(index, list):
            index = [0, value.dict["Size"] if whole(value.dict.get("Size")) else len(data) // size]
        entries, at = [], 0
        for first, count in zip(index[::2], index[1::2]):
            if not (numeric(first) and numeric(count)):
                continue
            for num in range(int(first), int(first) + min(int(count), (len(data) - at) // size)):
                row = data[at : at + size]
                at += size
                number = lambda x: int.from_bytes(x, "big")
                typ = number(row[:a]) if a else IN_FILE
                if typ in (FREE, IN_FILE, PACKED):
                    entries.append((num, typ, number(row[a : a + b]), number(row[a + b :])))
        return entries, value.dict

    def _rebuild(self):
        """Entries from a scan for "N G obj", the last of a number winning; the last trailer with a root, else a catalog."""
        self.repaired = True
        self.loaded.clear()
        self.packed.clear()
        self.trailer, self.sections = {}, []
        self.xref = {}
        for m in OBJECT.finditer(self.data):
            self.xref[int(m[1])] = (IN_FILE, m.start(), int(m[2]))
            self.sections.append((int(m[1]), IN_FILE, m.start(), int(m[2]), -m.start()))
        for m in reversed(list(TRAILER.finditer(self.data))):
            try:
                found = Scanner(self.data, m.end()).object()
            except ParseError:
                continue
            if isinstance(found, dict) and "Root" in found:
                self.trailer = {k: v for k, v in found.items() if k != "Prev"}
                break
        heads = [(num, at) for num, (_, at, _) in self.xref.items()]
        if "Root" not in self.trailer:
            self._find_root()
        if "Root" not in self.trailer and self.strict:
            self._unpack_all(heads)
            for num in self.xref:
                value = self.object(num)
                if isinstance(value, dict) and value.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(num, 0)
        for _, at in heads:  # what a cross-reference stream says of encryption counts, too
            if b"/XRef" in self.data[at : at + 512]:
                try:
                    own = indirect(self.data, at)[2]
                except ParseError:
                    continue
                if isinstance(own, Stream) and own.dict.get("Type") == "XRef" and "Encrypt" in own.dict:
                    self.trailer.setdefault("Encrypt", own.dict["Encrypt"])
        if "Root" not in self.trailer:
            raise DocumentError("no document root")
        self._unpack_all(heads)

    def _find_root(self):
        for m in re.finditer(rb"/Type", self.data):
            if b"/Catalog" in self.data[m.start() : m.start() + 200]:
                before = list(OBJECT.finditer(self.data, max(0, m.start() - 2000), m.start()))
                if before:
                    self.trailer["Root"] = Ref(int(before[-1][1]), int(before[-1][2]))
                    return

    def _unpack_all(self, heads):
        """Entries of all members of object streams whose numbers are not known otherwise."""
        for num, at in heads:
            if b"/ObjStm" in self.data[at : at + 512]:
                value = self.object(num)
                if isinstance(value, Stream):
                    try:
                        members = self._members(value)[1]
                    except (ValueError, TypeError):
                        continue
                    for i, (member, _) in enumerate(members):
                        self.xref.setdefault(member, (PACKED, num, i))

    # ------------------------------------------------------------ objects

    def object(self, num):
        """An indirect object's value; None if there is none, it cannot be read, or it is being read."""
        if num in self.loaded:
            return self.loaded[num]
        if num in self.busy or num not in self.xref:
            return None
        typ, a, b = self.xref[num]
        self.busy.add(num)
        try:
            value = self._at(a) if typ == IN_FILE else self._member(a, b)
        except Exception:
            value = None
        finally:
            self.busy.discard(num)
        self.loaded[num] = value
        return value

    def _at(self, at):
        for probe in (at, at + 1, at - 1):
            if 0 <= at < len(self.data) and 0 <= probe < len(self.data):
                try:
                    return indirect(self.data, probe)[2]
                except ParseError:
                    continue
        return None

    def _members(self, value):
        n, first = value.dict.get("N"), value.dict.get("First")
        if not whole(n) or not whole(first) or first < 0:
            raise DocumentError("an object stream without its numbers")
        data = self.decoded(value)
        numbers = data[:first].split()[: 2 * n]
        out = []
        for a, b in zip(numbers[::2], numbers[1::2]):
            if not (a.isdigit() and b.isdigit()):
                break
            out.append((int(a), first + int(b)))
        return data, out

    def _member(self, num, index):
        if num not in self.packed:
            value, got = self.object(num), []
            if isinstance(value, Stream):
                try:
                    data, members = self._members(value)
                except (ValueError, TypeError):
                    data, members = b"", []
                for _, at in members:
                    try:
                        got.append(Scanner(data, at).object())
                    except ParseError:
                        got.append(None)
            self.packed[num] = got
        got = self.packed[num]
        return got[index] if 0 <= index < len(got) else None

    def resolve(self, value):
        for _ in range(MAX_HOPS):
            if not isinstance(value, Ref):
                break
            value = self.object(value.num)
        return None if isinstance(value, Ref) else value

    def resolve_deep(self, value, depth=0):
        if depth > 24:
            return value
        value = self.resolve(value)
        if isinstance(value, dict):
            return {k: self.resolve_deep(v, depth + 1) for k, v in value.items()}
        if isinstance(value, list):
            return [self.resolve_deep(v, depth + 1) for v in value]
        return value

    def decoded(self, stream):
        """A stream's bytes after its filters."""
        get = lambda k: self.resolve(stream.dict.get(k))
        filters = get("Filter") if self.strict or not isinstance(stream.dict.get("Filter"), Ref) or not isinstance(get("Filter"), list) else ["?"]
        filters = filters if isinstance(filters, list) else [] if filters is None else [filters]
        filters = [f.decode("latin-1") if isinstance(f, bytes) else str(f) for f in map(self.resolve, filters)]
        parms = get("DecodeParms") if "DecodeParms" in stream.dict else get("DP")
        parms = parms if isinstance(parms, list) else [parms]
        parms = [self.resolve_deep(p) for p in parms]
        return codecs.decode(stream.raw, filters, parms, self.strict, self.limit)

    # ------------------------------------------------------------ pages

    @property
    def root(self):
        value = self.resolve(self.trailer.get("Root"))
        return value if isinstance(value, dict) else {}

    def tree(self):
        """(node, path, level, is leaf) of the page tree in order; pages have what they inherit."""
        top = self.resolve(self.root.get("Pages"))
        if isinstance(top, dict):
            yield from self._walk(top, {}, frozenset(), ())

    def _walk(self, node, above, seen, path):
        node = self.resolve(node)
        if not isinstance(node, dict) or len(path) > 400:
            return
        current = above | {k: node[k] for k in INHERITED if k in node}
        kind, kids = str(node.get("Type", "")), self.resolve(node.get("Kids"))
        if kind == "Page" or (kind != "Pages" and kids is None):
            yield current | node, path, True
            return
        yield node, path, False
        for i, kid in enumerate(kids if isinstance(kids, list) else ()):
            if isinstance(kid, Ref):
                if kid.num in seen:
                    continue
                seen = seen | {kid.num}
            yield from self._walk(kid, current, seen, (*path, i))

    def pages(self):
        if "pages" not in self.packed:
            self.packed["pages"] = [n for n, _, leaf in self.tree() if leaf]
        return self.packed["pages"]

    def declared_count(self):
        top = self.resolve(self.root.get("Pages"))
        n = top.get("Count") if isinstance(top, dict) else None
        return n if whole(n) else None

    def content(self, page):
        """(a page's content streams, joined by line breaks; why some are left out, or None)."""
        contents = page.get("Contents")
        if self.strict:
            contents = self.resolve(contents)
        parts, error = [], None
        for c in contents if isinstance(contents, list) else [contents]:
            c = self.resolve(c)
            if isinstance(c, Stream):
                try:
                    parts.append(self.decoded(c))
                except codecs.FilterError as e:
                    error = f"a content stream is left out: {e}"
        return b"\n".join(parts), error

    def box(self, page):
        """(x0, y0, x1, y1) of the media box as given, or None."""
        box = self.resolve(page.get("MediaBox"))
        box = [self.resolve(v) for v in box[:4]] if isinstance(box, list) and len(box) >= 4 else None
        return [float(v) for v in box] if box and all(numeric(v) for v in box) else None

    def rotation(self, page):
        value = self.resolve(page.get("Rotate"))
        return int(value) if numeric(value) else 0


# ---------------------------------------------------------------- fonts


def utf16(raw: bytes) -> str:
    """UTF-16BE text; an odd byte is followed by 0, lone surrogates and NUL are dropped."""
    return (raw + b"\0" * (len(raw) % 2)).decode("utf-16-be", "ignore").replace("\0", "")


HEX = rb"<([0-9A-Fa-f]+)>"
PAIR = re.compile(HEX + rb"\s*" + HEX)
RANGE = re.compile(HEX + rb"\s*" + HEX + rb"\s*(\[[\s\S]*?\]|<[0-9A-Fa-f]+>)")
ITEM = re.compile(rb"<([0-9A-Fa-f]*)>")


def _between(data, word):
    return re.findall(rb"begin" + word + rb"([\s\S]*?)end" + word, data)


class CodeMap(Mapping):
    """Codes to values, set one by one or as ranges, later ones winning; a range takes no more room than its ends.

    A range has a function of the code; None is no entry, so that what was set before it counts.
    """

    __slots__ = ("layers",)

    def __init__(self):
        self.layers = [{}]

    def __setitem__(self, code, value):
        if not isinstance(self.layers[-1], dict):
            self.layers.append({})
        self.layers[-1][code] = value

    def span(self, low, high, value):
        if high - low < 16:
            for code in range(low, high + 1):
                if (own := value(code)) is not None:
                    self[code] = own
        else:
            self.layers.append((low, high, value))

    def get(self, code, default=None):
        for layer in reversed(self.layers):
            if isinstance(layer, dict):
                if code in layer:
                    return layer[code]
            elif layer[0] <= code <= layer[1] and (own := layer[2](code)) is not None:
                return own
        return default

    def __getitem__(self, code):
        if (own := self.get(code)) is None:
            raise KeyError(code)
        return own

    def whole(self):
        """A plain dictionary of all entries."""
        out = {}
        for layer in self.layers:
            if isinstance(layer, dict):
                out |= layer
            else:
                out |= {c: own for c in range(layer[0], layer[1] + 1) if (own := layer[2](c)) is not None}
        return out

    def __iter__(self):
        return iter(self.whole())

    def __len__(self):
        return len(self.whole())

    def __bool__(self):
        return any(layer if isinstance(layer, dict) else any(layer[2](c) is not None for c in range(layer[0], layer[1] + 1)) for layer in self.layers)


def _counted(low, base):
    """Range of a map: the characters from ``base`` on."""
    return lambda code: chr(c) if (c := base + code - low) <= 0x10FFFF and not 0xD800 <= c < 0xE000 else None


def _counted_text(low, head):
    """The same whose first text has several characters, of which the last counts."""
    return lambda code: head[:-1] + chr(min(0x10FFFF, ord(head[-1]) + code - low))


def to_unicode(data: bytes, strict: bool = False):
    """(code to text, bytes of a code) of a ToUnicode map: single characters first, then ranges, later ones winning."""
    width = 2
    for block in _between(data, b"codespacerange"):
        for low, high in PAIR.findall(block):
            n = (len(low) + 1) // 2
            if n == 1 and int(low, 16) == 0 and int(high, 16) >= 0xFF:
                width = 1
            elif n >= 2:
                width = 2
                break
    out = CodeMap()
    for block in _between(data, b"bfchar"):
        for code, text in PAIR.findall(block):
            if len(text) % 2:
                if not strict:
                    return {}, width  # an odd number of digits makes the whole map void
                text += b"0"
            if found := utf16(bytes.fromhex(text.decode())):
                out[int(code, 16)] = found
    for block in _between(data, b"bfrange"):
        for low, high, to in RANGE.findall(block):
            low, high = int(low, 16), int(high, 16)
            if not 0 <= high - low <= MAX_SPAN:
                continue
            if to[:1] == b"[":
                for code, text in zip(range(low, high + 1), ITEM.findall(to)):
                    if len(text) % 2 == 0 and (found := utf16(bytes.fromhex(text.decode()))):
                        out[code] = found
            else:
                base = int(to[1:-1], 16)
                head = utf16(bytes.fromhex(to[1:-1].decode())) if strict and len(to) > 6 and len(to) % 2 == 0 else None
                out.span(low, high, _counted_text(low, head) if head else _counted(low, base))
    return out, width


def cid_widths(items) -> Mapping:
    """A CID font's /W: "first [w ...]" and "first last w", mixed."""
    out, i = CodeMap(), 0
    items = items if isinstance(items, list) else []
    while i < len(items):
        first = items[i]
        i += 1
        if not numeric(first) or i >= len(items):
            continue
        first, second = int(first), items[i]
        if isinstance(second, list):
            for k, w in enumerate(second):
                if numeric(w):
                    out[first + k] = float(w)
            i += 1
        elif numeric(second) and i + 1 < len(items) and numeric(items[i + 1]):
            if 0 <= int(second) - first <= MAX_SPAN:
                out.span(first, int(second), lambda code, w=float(items[i + 1]): w)
            i += 2
        else:
            i += 1
    return out


class Font:
    """How one font's codes become text and widths."""

    def __init__(self, name="", subtype="?"):
        self.name, self.subtype, self.base_font = name, subtype, ""
        self.is_cid, self.code_bytes, self.unicode, self.widths = False, 1, {}, {}
        self.default_width, self.encoding, self.differences = 0.0, None, {}

    def codes(self, data):
        if self.code_bytes == 1:
            return list(data)
        return [a << 8 | b for a, b in zip(data[::2], data[1::2])]


def read_font(doc: Document, value, name: str) -> Font:
    font = Font(name)
    d = doc.resolve(value)
    if not isinstance(d, dict):
        return font
    get = lambda d, k: doc.resolve(d.get(k))
    font.subtype, font.base_font = str(d.get("Subtype", "")), str(get(d, "BaseFont") or "")
    cmap = get(d, "ToUnicode")
    if isinstance(cmap, Stream):
        try:
            font.unicode = to_unicode(doc.decoded(cmap), doc.strict)[0]
        except codecs.FilterError:
            pass
    if font.subtype == "Type0":
        font.is_cid, font.code_bytes, font.default_width = True, 2, 1000.0
        kids = get(d, "DescendantFonts")
        cid = doc.resolve(kids[0]) if isinstance(kids, list) and kids else None
        if isinstance(cid, dict):
            if numeric(cid.get("DW")):
                font.default_width = float(cid["DW"])
            items = get(cid, "W")
            font.widths = cid_widths([doc.resolve(x) if doc.strict else x for x in items] if isinstance(items, list) else None)
        return font
    first, widths = d.get("FirstChar"), get(d, "Widths")
    if isinstance(widths, list) and whole(first):
        for i, w in enumerate(widths):
            w = doc.resolve(w) if doc.strict else w
            if numeric(w):
                font.widths[first + i] = float(w)
    descriptor = get(d, "FontDescriptor")
    if isinstance(descriptor, dict) and numeric(descriptor.get("MissingWidth")):
        font.default_width = float(descriptor["MissingWidth"])
    if not font.widths and not font.default_width:
        font.default_width = 500.0
    encoding = get(d, "Encoding")
    base = encoding if isinstance(encoding, Name) else encoding.get("BaseEncoding") if isinstance(encoding, dict) else None
    if isinstance(encoding, dict):
        code, items = 0, get(encoding, "Differences")
        for item in items if isinstance(items, list) else ():
            if numeric(item):
                code = int(item)
            elif isinstance(item, Name):
                font.differences[code] = character_of(item, doc.strict)
                code += 1
    font.encoding = str(base) if isinstance(base, Name) and base in ENCODINGS else None
    if font.encoding is None and (doc.strict or not font.differences):
        font.encoding = "StandardEncoding"
    return font


# ---------------------------------------------------------------- content

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
INLINE_END = re.compile(rb"[\0\t\n\f\r ]EI")


def times(m, n):
    """The matrix that does m, then n (row vectors)."""
    return (
        m[0] * n[0] + m[1] * n[2],
        m[0] * n[1] + m[1] * n[3],
        m[2] * n[0] + m[3] * n[2],
        m[2] * n[1] + m[3] * n[3],
        m[4] * n[0] + m[5] * n[2] + n[4],
        m[4] * n[1] + m[5] * n[3] + n[5],
    )


def apply(m, x, y):
    """The point (x, y) under the matrix m."""
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def _float(x):
    return float(x) if isinstance(x, (int, float)) else float(x.decode("latin-1")) if isinstance(x, bytes) else float(str(x))


def _floats(values):
    out = []
    for v in values:
        try:
            out.append(_float(v))
        except ValueError:
            out.append(0.0)
    return tuple(out)


class State:
    __slots__ = ("ctm", "tm", "line", "run", "tc", "tw", "tz", "leading", "font", "size", "rise", "mode", "color")

    def __init__(self, ctm, run):
        self.ctm, self.tm, self.line, self.run = ctm, IDENTITY, IDENTITY, run
        self.tc = self.tw = self.leading = self.size = self.rise = 0.0
        self.tz, self.font, self.mode, self.color = 1.0, "", 0, (0.0, 0.0, 0.0)

    def copy(self):
        new = State.__new__(State)
        for k in State.__slots__:
            setattr(new, k, getattr(self, k))
        return new


class Content:
    """Runs one page's content; ``shows`` gets a row for each shown string and each kerning number in between.

    A row: (run, data or None, kern, font key, font name, size, tc, tw, tz, rise, base matrix, ctm, color, mode).
    ``place``: name of the page, by which fonts that stand directly in its resources are told apart.
    """

    def __init__(self, doc: Document, fonts: dict, place: str = ""):
        self.doc, self.fonts, self.place = doc, fonts, place
        self.shows, self.runs, self.error = [], 0, None

    def new_run(self):
        self.runs += 1
        return self.runs

    def font_keys(self, resources, place):
        """Font key of each font name of a resource dictionary; the fonts go to ``fonts`` once for each document.

        A key is the font's object number, or the place at which its dictionary is met first, so that every pass over the
        file names it alike.
        """
        scopes = self.doc.scopes
        if id(resources) not in scopes:
            found, keys = self.doc.resolve(resources.get("Font")) if isinstance(resources, dict) else None, {}
            for name, value in found.items() if isinstance(found, dict) else ():
                key = f"{value.num} {name}" if isinstance(value, Ref) else f"{place} {name}"
                if key not in self.fonts:
                    try:
                        self.fonts[key] = read_font(self.doc, value, str(name))
                    except Exception:
                        self.fonts[key] = Font(str(name))
                keys[str(name)] = key
            scopes[id(resources)] = (keys, resources)
        return scopes[id(resources)][0]

    def run(self, data, resources, ctm, depth=0, state=None, place=None):
        resources, place = self.doc.resolve(resources), self.place if place is None else place
        fonts = self.font_keys(resources, place)
        if state is None:
            state = State(ctm, self.new_run())
        else:  # a form that inherits its caller's state
            state = state.copy()
            state.ctm, state.tm, state.line, state.run = ctm, IDENTITY, IDENTITY, self.new_run()
        stack, operands, scanner = [], [], Scanner(data)
        while True:
            try:
                kind, value = scanner.next()
                if kind == "eof":
                    return
                if kind != "word":
                    if kind not in ("end", "close"):
                        operands.append(scanner.loose(kind, value))
                    continue
            except ParseError as e:
                self.error = str(e)  # what was shown before stays
                return
            if value == b"BI":
                self._inline(scanner)
            else:
                handler = OPERATORS.get(bytes(value))
                if handler:
                    try:
                        state = handler(self, state, operands, stack, fonts, resources, depth, place) or state
                    except (ValueError, TypeError, OverflowError, AttributeError, RecursionError):
                        pass
            operands = []

    def _inline(self, scanner):
        try:
            while (token := scanner.next()) != ("word", b"ID"):
                if token[0] == "eof":
                    return
        except ParseError:
            pass
        m = INLINE_END.search(scanner.buf, scanner.pos)
        scanner.pos = m.end() if m else len(scanner.buf)

    def show(self, s, fonts, data=None, kern=None):
        self.shows.append((s.run, data, kern, fonts.get(s.font), s.font, s.size, s.tc, s.tw, s.tz, s.rise, s.tm, s.ctm, s.color, s.mode))

    def move(self, s, x, y):
        try:
            x, y = _float(x), _float(y)
        except ValueError:
            return
        s.line = s.tm = times((1.0, 0.0, 0.0, 1.0, x, y), s.line)
        s.run = self.new_run()


def _q(c, s, o, stack, *_):
    stack.append(s.copy())


def _Q(c, s, o, stack, *_):
    if stack:
        saved = stack.pop()
        if c.doc.strict:  # all but the text matrices, which are no part of the graphics state
            saved.tm, saved.line, saved.run = s.tm, s.line, s.run
            return saved
        s.ctm = saved.ctm


def _cm(c, s, o, *_):
    if len(o) >= 6:
        s.ctm = times(_floats(o[-6:]), s.ctm)


def _g(c, s, o, *_):
    s.color = (_float(o[-1]),) * 3 if o else s.color


def _rg(c, s, o, *_):
    if len(o) >= 3:
        s.color = tuple(_float(x) for x in o[-3:])


def _k(c, s, o, *_):
    if len(o) >= 4:
        *inks, black = (_float(x) for x in o[-4:])
        s.color = tuple((1 - i) * (1 - black) for i in inks)


def _BT(c, s, *_):
    s.tm = s.line = IDENTITY
    s.run = c.new_run()


def _Tf(c, s, o, *_):
    if len(o) >= 2:
        s.font = str(o[-2])
        try:
            s.size = _float(o[-1])
        except ValueError:
            s.size = 0.0


def _Td(c, s, o, *_):
    if len(o) >= 2:
        c.move(s, o[-2], o[-1])


def _TD(c, s, o, *_):
    if len(o) >= 2:
        try:
            s.leading = -_float(o[-1])
        except ValueError:
            pass
        c.move(s, o[-2], o[-1])


def _Tm(c, s, o, *_):
    if len(o) >= 6:
        s.tm = s.line = _floats(o[-6:])
        s.run = c.new_run()


def _next_line(c, s, *_):
    c.move(s, 0.0, -s.leading)


def _setter(slot, make=_float):
    def handler(c, s, o, *_):
        if o:
            setattr(s, slot, make(o[-1]))

    return handler


def _Tj(c, s, o, stack, fonts, *_):
    if o and isinstance(o[-1], bytes):
        c.show(s, fonts, o[-1])


def _TJ(c, s, o, stack, fonts, *_):
    if o and isinstance(o[-1], list):
        for item in o[-1]:
            if isinstance(item, bytes):
                c.show(s, fonts, item)
            elif numeric(item):
                c.show(s, fonts, kern=float(item))


def _quote(c, s, o, stack, fonts, *_):
    _next_line(c, s)
    _Tj(c, s, o, stack, fonts)


def _quotes(c, s, o, stack, fonts, *_):
    if len(o) >= 3:
        try:
            s.tw, s.tc = _float(o[-3]), _float(o[-2])
        except ValueError:
            pass
        _quote(c, s, o, stack, fonts)


def _Do(c, s, o, stack, fonts, resources, depth, place):
    if depth >= MAX_FORMS or not o or not isinstance(resources, dict):
        return
    forms = c.doc.resolve(resources.get("XObject"))
    form = c.doc.resolve(forms.get(str(o[-1]))) if isinstance(forms, dict) else None
    if not isinstance(form, Stream) or form.dict.get("Subtype") != "Form":
        return
    matrix = c.doc.resolve(form.dict.get("Matrix"))
    matrix = tuple(map(float, matrix[:6])) if isinstance(matrix, list) and len(matrix) >= 6 and all(map(numeric, matrix[:6])) else IDENTITY
    try:
        data = c.doc.decoded(form)
    except codecs.FilterError:
        return
    own = c.doc.resolve(form.dict.get("Resources")) or resources
    c.run(data, own, times(matrix, s.ctm), depth + 1, s if c.doc.strict else None, f"{place}/{o[-1]}")


OPERATORS = {
    b"q": _q, b"Q": _Q, b"cm": _cm, b"g": _g, b"rg": _rg, b"k": _k, b"BT": _BT, b"Tf": _Tf, b"Td": _Td, b"TD": _TD, b"Tm": _Tm, b"T*": _next_line,
    b"TL": _setter("leading"), b"Tc": _setter("tc"), b"Tw": _setter("tw"), b"Tz": _setter("tz", lambda x: _float(x) / 100), b"Ts": _setter("rise"),
    b"Tr": _setter("mode", lambda x: int(_float(x))), b"Tj": _Tj, b"TJ": _TJ, b"'": _quote, b'"': _quotes, b"Do": _Do,
}
