import re
import zlib

import pytest
from pdfs import of_kind, one_page

from inkspark.sources import kernel
from inkspark.sources.document import Document, DocumentError, apply, cid_widths, read_font, times, to_unicode, utf16
from inkspark.sources.syntax import Ref
from inkspark.sources.writer import File, simple_font

HELLO = "BT /F1 12 Tf 100 700 Td (Hello) Tj ET"


def text(data, **options):
    codes = {}
    out = {}
    for kind, v in kernel.rows(data, **options):
        if kind == "code":
            codes.setdefault(v[0], {})[v[1]] = chr(v[2])
        elif kind == "show" and v[4] is not None:
            out.setdefault(v[0], []).append((v[6], v[4]))
    return {page: ["".join(codes[key][i] for i in ids) for key, ids in shows] for page, shows in out.items()}


@pytest.mark.parametrize("how", ["table", "cr", "crlf", "stream", "packed"])
def test_cross_references(how):
    data = one_page(HELLO, how=how)
    doc = Document(data)
    assert not doc.repaired and text(data) == {0: ["Hello"]}
    assert doc.version == ("1.5" if how in ("stream", "packed") else "1.4")


def test_versions():
    assert Document(b"junk\n" + one_page(HELLO).replace(b"%PDF-1.4", b"%PDF-1.7")).version == "1.7"
    assert Document(one_page(HELLO).replace(b"%PDF-1.4", b"%NOT-1.4")).version == "1.4"


@pytest.mark.parametrize("damage", [lambda d: re.sub(rb"startxref\n\d+", b"startxref\n999", d), lambda d: d.replace(b"startxref", b"startxxxx"), lambda d: d[: d.index(b"xref\n0")], lambda d: d.replace(b"/Root", b"/Ruut")])
def test_repair(damage):
    data = damage(one_page(HELLO))
    assert Document(data).repaired and text(data) == {0: ["Hello"]}


def test_repair_with_object_streams():
    data = one_page(HELLO, how="packed")
    data = data[: data.rindex(b"startxref")]
    with pytest.raises(DocumentError):
        Document(data)  # the catalog is packed, which a scan does not see
    assert text(data, strict=True) == {0: ["Hello"]}


def test_no_documents():
    for data in (b"", b"not a document", b"%PDF-1.4\n1 0 obj 5 endobj"):
        with pytest.raises(DocumentError):
            Document(data)


def test_encryption_is_refused():
    data = one_page(HELLO).replace(b"/Root", b"/Encrypt 9 0 R /Root")
    for d in (data, re.sub(rb"startxref\n\d+", b"", data)):
        with pytest.raises(DocumentError, match="encrypted"):
            Document(d)
    stream = one_page(HELLO, how="stream").replace(b"/Type /XRef", b"/Encrypt 9 0 R /Type /XRef")
    with pytest.raises(DocumentError, match="encrypted"):
        Document(re.sub(rb"startxref\n\d+", b"", stream))


def updated(data, num, body, free=False):
    """An incremental update with a new body (or none) for one object."""
    prev = int(re.findall(rb"startxref\n(\d+)", data)[-1])
    at = len(data)
    data += b"%d 0 obj\n%s\nendobj\n" % (num, body) if not free else b""
    start = len(data)
    entry = b"%010d 00000 %s \n" % (0 if free else at, b"f" if free else b"n")
    return data + b"xref\n%d 1\n%strailer\n<< /Size 99 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (num, entry, prev, start)


def test_updates_win():
    body = b"<< /Length 34 >>\nstream\nBT /F1 12 Tf 0 0 Td (Newer) Tj ET   \nendstream"
    data = updated(one_page(HELLO), 4, body)
    assert text(data) == {0: ["Newer"]}
    sections = of_kind(data, "xref")
    assert {s for n, _, _, _, s in sections if n == 4} == {1, 2}


def test_deleted_objects():
    data = updated(one_page(HELLO), 4, b"", free=True)
    assert text(data) == {0: ["Hello"]} and text(data, strict=True) == {}


def test_a_bad_previous_section_means_a_rebuild():
    data = re.sub(rb"/Prev \d+", b"/Prev 3", updated(one_page(HELLO), 9, b"null"))
    assert Document(data).repaired and text(data) == {0: ["Hello"]}


def test_hybrid_files():
    f = File()
    for body in ("<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Count 1 /Kids [5 0 R] >>", simple_font()):
        f.add(body)
    f.stream(HELLO.encode())
    page = b"<< /Type /Page /Contents 4 0 R /Resources << /Font << /F1 3 0 R >> >> >>"
    head = b"5 0 "
    f.stream(head + page, f"/Type /ObjStm /N 1 /First {len(head)}", 6)
    rows = b"\2" + (6).to_bytes(4, "big") + bytes(2)
    f.stream(rows, "/Type /XRef /W [1 4 2] /Index [5 1] /Size 8", 7)
    data = f.table(1)
    at = data.index(b"7 0 obj")
    assert text(data.replace(b"/Root 1 0 R", b"/Root 1 0 R /XRefStm %d" % at)) == {0: ["Hello"]}


def tree(*kids, count=None, more=""):
    f = File()
    f.add("<< /Type /Catalog /Pages 2 0 R >>")
    f.add(f"<< /Type /Pages /Count {len(kids) if count is None else count} /Kids [{' '.join(kids)}] {more} >>")
    return f


def test_page_trees_inherit():
    f = tree("4 0 R", "5 0 R", more="/MediaBox [0 0 100 200] /Rotate 90 /Resources << /Font << /F1 3 0 R >> >>")
    f.add(simple_font(), 3)
    f.add("<< /Type /Page /Contents 6 0 R >>", 4)
    f.add("<< /Type /Pages /Rotate 0 /Kids [7 0 R 8 0 R] >>", 5)
    f.stream(HELLO.encode(), num=6)
    f.add("<< /Contents 6 0 R /MediaBox [0 0 5 5] >>", 7)
    f.add("<< /Type /Page /Contents [6 0 R 6 0 R 99 0 R] >>", 8)
    data = f.table(1)
    doc = Document(data)
    assert [(doc.box(p)[2], doc.rotation(p)) for p in doc.pages()] == [(100, 90), (5, 0), (100, 0)]
    assert text(data, strict=True) == {0: ["Hello"], 1: ["Hello"], 2: ["Hello", "Hello"]}
    assert text(data) == {0: ["Hello"], 1: ["Hello"]}  # the declared count is 2
    assert of_kind(data, "doc")[0][2:5] == (2, 2, 3)
    assert [(path, leaf) for path, _, leaf in of_kind(data, "node")] == [([], False), ([0], True), ([1], False), ([1, 0], True), ([1, 1], True)]


def test_cycles_end():
    f = tree("2 0 R", "3 0 R")
    f.add("<< /Type /Pages /Kids [2 0 R 3 0 R] >>", 3)
    assert Document(f.table(1)).pages() == []
    f = tree("3 0 R")
    f.add("<< /Type /Page /Contents 3 0 R /Next 4 0 R >>", 3)
    f.add("5 0 R", 4)
    f.add("4 0 R", 5)
    doc = Document(f.table(1))
    assert len(doc.pages()) == 1 and doc.resolve(Ref(4, 0)) is None


def test_objects():
    doc = Document(one_page(HELLO))
    assert doc.object(77) is None and doc.resolve(Ref(2, 0))["Type"] == "Pages"
    deep = doc.resolve_deep(Ref(1, 0))
    assert deep["Pages"]["Kids"][0]["Type"] == "Page"


def test_contents():
    f = tree("3 0 R")
    f.add("<< /Type /Page /Contents 4 0 R /Resources << /Font << /F1 6 0 R >> >> >>", 3)
    f.add("[5 0 R 7 0 R 5 0 R]", 4)
    f.stream(HELLO.encode(), num=5)
    f.add(simple_font(), 6)
    f.stream(b"\xff\xffgarbage garbage garbage", "/Filter /FlateDecode", num=7)
    assert text(f.table(1)) == {} and text(f.table(1), strict=True) == {0: ["Hello", "Hello"]}


def test_only_wanted_pages_run():
    f = tree("4 0 R", "4 0 R", "5 0 R")
    f.add(simple_font(), 3)
    for n in (4, 5):
        f.add("<< /Type /Page /Contents 6 0 R /Resources << /Font << /F1 3 0 R >> >> >>", n)
    f.stream(HELLO.encode(), num=6)
    assert set(text(f.table(1), pages={1})) == {1}
    assert of_kind(f.table(1), "show", want={"page"}) == []


@pytest.mark.parametrize("rotate,size,matrix", [(0, (612, 792), (1, 0, 0, 1, 0, 0)), (90, (792, 612), (0, 1, -1, 0, 792, 0)), (180, (612, 792), (-1, 0, 0, -1, 612, 792)), (270, (792, 612), (0, -1, 1, 0, 0, 612)), (-90, (792, 612), (0, -1, 1, 0, 0, 612)), (45, (612, 792), (1, 0, 0, 1, 0, 0))])
def test_geometry(rotate, size, matrix):
    w, h, _, m = kernel.geometry(None, rotate)
    assert (w, h) == size and m == matrix
    assert kernel.geometry((100, 20, 0, 10), 0) == (100, 10, 0, (1, 0, 0, 1, 0, -10))


def test_matrices():
    m, n = (2, 0, 0, 3, 5, 7), (0, 1, -1, 0, 1, 1)
    x, y = apply(m, 4, 9)
    assert apply(times(m, n), 4, 9) == apply(n, x, y)


# ---------------------------------------------------------------- fonts


def test_utf16():
    assert utf16(b"\0A") == "A" and utf16(bytes.fromhex("4E2D6587")) == "中文" and utf16(bytes.fromhex("D83DDE00")) == "😀"
    assert utf16(bytes.fromhex("D83D0041")) == "A" and utf16(b"A") == "䄀" and utf16(b"") == "" and utf16(b"\0\0") == ""


def test_to_unicode_maps():
    assert to_unicode(b"") == ({}, 2)
    m, width = to_unicode(b"begincodespacerange <00> <FF> endcodespacerange beginbfchar <01> <0041> <02> <00660069> endbfchar beginbfrange <03> <05> <0061> <06> <09> [<0078> <0079>] <01> <01> <007A> endbfrange")
    assert width == 1 and m == {1: "z", 2: "fi", 3: "a", 4: "b", 5: "c", 6: "x", 7: "y"}
    assert to_unicode(b"beginbfrange <0000> <0001> <1F600> endbfrange")[0] == {0: "😀", 1: "😁"}
    assert to_unicode(b"beginbfchar <01> <041> endbfchar") == ({}, 2)
    assert to_unicode(b"beginbfrange <0000> <0002> <00410042> endbfrange")[0] == {}
    assert to_unicode(b"beginbfrange <0000> <0002> <00410042> endbfrange", True)[0] == {0: "AB", 1: "AC", 2: "AD"}
    assert to_unicode(b"beginbfrange <05> <01> <41> <00> <FFFFFF> <41> endbfrange junk ( >> begin")[0] == {}


def test_cid_widths():
    assert cid_widths([1, [10, 20], 5, 7, 30, 9, [1]]) == {1: 10, 2: 20, 5: 30, 6: 30, 7: 30, 9: 1}
    assert cid_widths(None) == {} and cid_widths(["x", 3]) == {} and cid_widths([0, 99999, 5]) == {}


def font_of(body, objects=(), strict=False):
    return read_font(Document(one_page(HELLO, font=body, objects=objects), strict), Ref(3, 0), "F1")


def test_simple_fonts():
    f = font_of("<< /Type /Font /Subtype /Type1 /FirstChar 65 /Widths [700 10 0 R /x] /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [66 /eacute /A /uni00E9 70 /u1F600 /a.sc /fi /g12] >> >>", ["321"])
    assert f.widths == {65: 700} and f.default_width == 0 and f.encoding == "WinAnsiEncoding"
    assert f.differences == {66: "", 67: "A", 68: "é", 70: "😀", 71: "a", 72: "ﬁ", 73: ""}
    f = font_of("<< /Subtype /Type1 /FirstChar 65 /Widths [700 10 0 R] /Encoding << /Differences [66 /eacute] >> >>", ["321"], strict=True)
    assert f.widths == {65: 700, 66: 321} and f.differences == {66: "é"} and f.encoding == "StandardEncoding"
    assert font_of("<< /Subtype /Type1 /Encoding << /Differences [66 /A] >> >>").encoding is None
    assert font_of("<< /Subtype /TrueType >>").default_width == 500 and font_of("<< /Subtype /TrueType >>").encoding == "StandardEncoding"
    assert font_of("<< /Subtype /Type1 /FontDescriptor << /MissingWidth 250 >> >>").default_width == 250
    assert font_of("[1]").subtype == "?"


def test_composite_fonts():
    cmap = (b"beginbfchar <0041> <4E2D> endbfchar", "")
    f = font_of("<< /Subtype /Type0 /DescendantFonts [10 0 R] /ToUnicode 11 0 R >>", ["<< /DW 600 /W [65 [100] 70 71 200] >>", cmap])
    assert f.is_cid and f.code_bytes == 2 and f.default_width == 600 and f.widths == {65: 100, 70: 200, 71: 200} and f.unicode == {65: "中"}
    assert f.codes(b"\0A\0Bx") == [65, 66] and font_of("<< /Subtype /Type0 >>").default_width == 1000


# ---------------------------------------------------------------- content


def shows(content, **options):
    return of_kind(one_page(content, **options), "show")


def test_state_of_shows():
    a, k, b = shows("BT /F1 9 Tf 1 Tc 2 Tw 50 Tz 3 Ts 1 Tr .5 g 1 0 0 1 5 6 Tm [(a) -100 (b)] TJ ET")
    assert a[3] == b"a" and k[5] == -100 and k[3] is None and b[3] == b"b"
    assert a[8:13] == (9, 1, 2, 0.5, 3) and a[15:19] == (0.5, 0.5, 0.5, 1) and a[2] == k[2] == b[2]


def test_colors():
    rows = shows("1 0 .5 rg (a) Tj 0 .5 1 .5 k (b) Tj .1 .2 .3 RG 0 G 0 0 0 0 K (c) Tj")
    assert [r[15:18] for r in rows] == [(1, 0, 0.5), (0.5, 0.25, 0), (0.5, 0.25, 0)]


def test_what_starts_a_run():
    rows = shows("BT (a) Tj (b) Tj 1 2 Td (c) Tj T* (d) Tj (e) ' 1 2 (f) \" 1 0 0 1 0 0 Tm (g) Tj 5 5 TD (h) Tj ET BT (i) Tj")
    runs = [r[2] for r in rows]
    assert runs[0] == runs[1] and len(set(runs)) == 8 and runs == sorted(runs)


def test_graphics_state():
    rows = shows("q 2 0 0 2 0 0 cm BT /F1 7 Tf (a) Tj Q (b) Tj ET")
    assert rows[0][14][0] == 2 and rows[1][14][0] == 1 and rows[1][8] == 7
    rows = of_kind(one_page("/F1 5 Tf q /F1 7 Tf (a) Tj Q (b) Tj Q"), "show", strict=True)
    assert [r[8] for r in rows] == [7, 5]


@pytest.mark.parametrize(
    "content,shown",
    [
        ("(outside) Tj", [b"outside"]),
        ("BT 1 2 3 unknown /x gs (a) Tj ET", [b"a"]),
        ("Tj 5 Tj [1 Td /F1 Tf (a) Tj", []),
        ("BT (a) Tj Td (b) Tj (x) (y) Td (c) Tj", [b"a", b"b", b"c"]),
        ("BI /W 1 ID \x00EI\xff EI (after) Tj", [b"after"]),
        ("BI /W 1 ID no end", []),
        ("(a) Tj > (b) Tj", [b"a"]),
        ("/F1 (x) Tf (a) Tj /F1 0 Tf (b) Tj", [b"a", b"b"]),
        ("[(a) [(n)] << /k (v) >> /n true -5 (b)] TJ", [b"a", None, b"b"]),
    ],
)
def test_robustness(content, shown):
    assert [r[3] for r in shows(content, compress=False)] == shown


def test_a_page_that_breaks_off_says_so():
    data = one_page("(a) Tj >")
    assert of_kind(data, "page")[0][6] and of_kind(data, "show")


def test_forms():
    form = (zlib.compress(b"(in) Tj /F2 9 Tf (own) Tj"), "/Type /XObject /Subtype /Form /Filter /FlateDecode /Matrix [1 0 0 1 10 20] /Resources << /Font << /F2 3 0 R >> >>")
    data = one_page("/F1 12 Tf 2 Tc q 2 0 0 2 0 0 cm /X Do Q (out) Tj", "<< /Font << /F1 3 0 R >> /XObject << /X 10 0 R >> >>", objects=[form])
    a, b, c = of_kind(data, "show")
    assert (a[7], a[8], a[9]) == ("", 0, 0) and a[14] == (2, 0, 0, 2, 20, 40) and b[7] == "F2" and c[14] == (1, 0, 0, 1, 0, 0)
    a = of_kind(data, "show", strict=True)[0]
    assert (a[7], a[8], a[9]) == ("F1", 12, 2)


def test_forms_that_call_themselves_end():
    form = (b"(x) Tj /X Do", "/Subtype /Form /Resources << /XObject << /X 10 0 R >> >>")
    image = (b"(no) Tj", "/Subtype /Image")
    data = one_page("/X Do /Y Do /Z Do", "<< /XObject << /X 10 0 R /Y 11 0 R >> >>", objects=[form, image])
    assert len(of_kind(data, "show")) == 12
    broken = (b"(x) Tj >", "/Subtype /Form")
    rows = of_kind(one_page("/X Do (y) Tj", "<< /XObject << /X 10 0 R >> >>", objects=[broken]), "show")
    assert [r[3] for r in rows] == [b"x", b"y"] and rows[1][14] == (1, 0, 0, 1, 0, 0)


def test_fonts_of_undefined_names():
    data = one_page("/Nope 12 Tf (abc) Tj")
    assert [c[0] for c in of_kind(data, "code")] == [kernel.UNDEFINED] * 3 and all(c[5] == 0 for c in of_kind(data, "code"))


def test_lone_surrogates_do_not_reach_tables():
    cmap = (b"beginbfchar <41> <D83D> endbfchar", "")
    data = one_page("/F1 5 Tf (A) Tj", font="<< /Subtype /Type1 /ToUnicode 10 0 R /Encoding << /Differences [65 /uniD83D] >> >>", objects=[cmap])
    assert [c[3:5] for c in of_kind(data, "code")] == [(None, "")]


def test_wide_ranges_of_a_font_cost_nothing_until_they_are_asked():
    m, _ = to_unicode(b"beginbfchar <0041> <0058> <D900> <0059> endbfchar beginbfrange <0000> <FFFF> <0000> <0050> <0050> <005A> endbfrange")
    assert len(m.layers) == 3 and m.get(0x41) == "A" and m.get(0x50) == "Z" and m.get(0xD900) == "Y" and m.get(0xD901) is None and m[0xFFFF] == "￿"
    assert m == {c: chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000} | {0x50: "Z", 0xD900: "Y"}
    w = cid_widths([0, [500], 2, 65535, 400, 7, [300]])
    assert len(w.layers) == 3 and w.get(0) == 500 and w.get(1) is None and w.get(7) == 300 and w.get(65535) == 400 and len(w) == 65535
