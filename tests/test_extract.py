"""Glyph positions, lines and outputs of small documents, against known facts and a plain restatement of the rules."""

import json
import random

import numpy as np
import pytest
from pdfs import one_page
from pyspark.sql import functions as F

from inkspark.operators import layout
from inkspark.plans.extract import Extraction, document_page, extract, extract_pages, extract_text
from inkspark.sources import kernel, writer
from inkspark.sources.linework import lines_of, rounded
from inkspark.sources.writer import File, cid_font, render, simple_font, to_unicode_map

POSITIONS = {
    "advance": ("BT /F1 12 Tf 100 700 Td (ABC) Tj ET", [100, 106, 112]),
    "kerning": ("BT /F1 12 Tf 100 700 Td [(A) -500 (B) 250 (C)] TJ ET", [100, 112, 115]),
    "char spacing": ("BT /F1 10 Tf 2 Tc 100 700 Td (AB) Tj ET", [100, 107]),
    "word spacing": ("BT /F1 10 Tf 5 Tw 100 700 Td (A B) Tj ET", [100, 105, 115]),
    "scaling": ("BT /F1 10 Tf 200 Tz 100 700 Td (AB) Tj ET", [100, 110]),
    "second Td": ("BT /F1 10 Tf 100 700 Td (AB) Tj 20 0 Td (C) Tj ET", [100, 105, 120]),
    "quotes": ("BT /F1 10 Tf 14 TL 100 700 Td (A) ' 1 2 (B C) \" ET", [100, 100, 107, 115]),
    "translated blocks": ("".join(f"q 1 0 0 1 0 {700 - 40 * i} cm BT /F1 10 Tf 5 0 Td (x) Tj ET Q " for i in range(8)), [5] * 8),
    "nested state": ("q 1 0 0 1 50 0 cm q 1 0 0 1 7 0 cm BT /F1 9 Tf (A) Tj ET Q BT (B) Tj ET Q BT (C) Tj ET", [57, 50, 0]),
    "scaled page": ("2 0 0 2 0 0 cm BT /F1 12 Tf 50 300 Td (AB) Tj ET", [100, 112]),
    "tiny size": ("BT /F1 0 Tf 5 5 Td (AB) Tj ET", [5, 5]),
    "parent run goes on": ("BT /F1 10 Tf 10 10 Td (A) Tj /X Do (B) Tj ET", [10, 300, 15]),
}


@pytest.fixture(scope="module")
def placed(spark):
    form = (b"BT /F1 10 Tf 300 5 Td (F) Tj ET", "/Subtype /Form")
    rows = [(name, one_page(content, "<< /Font << /F1 3 0 R >> /XObject << /X 10 0 R >> >>", objects=[form])) for name, (content, _) in POSITIONS.items()]
    rows += [
        ("rotated text", one_page("BT /F1 10 Tf 0 1 -1 0 100 200 Tm (AB) Tj ET")),
        ("rotate 90", one_page("BT /F1 10 Tf 72 700 Td (A) Tj ET", page="/Rotate 90")),
        ("offset box", one_page("BT /F1 10 Tf 72 700 Td (A) Tj ET", page="/MediaBox [10 20 622 812]")),
        ("invisible", one_page("BT /F1 10 Tf 3 Tr 1 0 0 rg (A) Tj ET")),
        ("no box", one_page("BT /F1 10 Tf (A) Tj ET", page="NOBOX")),
        ("undefined font", one_page("BT /Nope 10 Tf (ABC) Tj /F1 10 Tf (D) Tj ET")),
        ("rise", one_page("BT /F1 10 Tf 4 Ts (A) Tj ET")),
        ("leading", one_page("BT /F1 10 Tf 100 700 Td 0 -20 TD (A) Tj T* (B) Tj ET")),
    ]
    df = spark.createDataFrame(rows, "doc_id string, content binary")
    out = {}
    for r in Extraction(df, keep=True).glyphs().orderBy("doc_id", "seq").collect():
        out.setdefault(r.doc_id, []).append(r)
    return df, out


@pytest.mark.parametrize("name", POSITIONS)
def test_positions(placed, name):
    assert [round(g.x, 4) for g in placed[1][name]] == POSITIONS[name][1]


def test_vectors_sizes_and_state(placed):
    g = placed[1]
    assert [(round(c.x, 4), round(c.y, 4), round(c.adv_x, 4), round(c.adv_y, 4), c.size) for c in g["rotated text"]] == [(100, 200, 0, 5, 10), (100, 205, 0, 5, 10)]
    assert [(c.x, c.y) for c in g["rotate 90"]] == [(92, 72)] and [(c.x, c.y) for c in g["offset box"]] == [(62, 680)]
    assert g["scaled page"][0].size == 24 and g["scaled page"][0].y == 600 and g["tiny size"][0].size == 1
    assert [c.y for c in g["translated blocks"]] == [700 - 40 * i for i in range(8)]
    assert [(c.text, c.y) for c in g["leading"]] == [("A", 680), ("B", 660)]
    assert g["invisible"][0].render_mode == 3 and (g["invisible"][0].r, g["invisible"][0].g) == (1, 0)
    assert [(c.text, c.x, c.seq) for c in g["undefined font"]] == [("D", 0, 1)]
    assert g["rise"][0].y == 0


def test_strict_rise_and_pages(placed):
    df = placed[0].where("doc_id IN ('rise', 'rotate 90', 'no box')")
    assert {r.doc_id: r.y for r in Extraction(df, strict_spec=True).glyphs().collect()}["rise"] == 4
    pages = {r.doc_id: (r.width, r.height, r.rotation, r.page_no) for r in Extraction(df).pages().collect()}
    assert pages == {"rise": (612, 792, 0, 1), "rotate 90": (792, 612, 90, 1), "no box": (612, 792, 0, 1)}


def cid_page(content, tounicode, **options):
    f = File()
    f.add("<< /Type /Catalog /Pages 2 0 R >>")
    f.add("<< /Type /Pages /Count 1 /Kids [3 0 R] >>")
    f.add("<< >>")
    font = cid_font(f, tounicode, **options)
    other = cid_font(f, to_unicode_map(chars=[(1, "乙"), (2, "丁")]))
    body = f.stream(content.encode())
    f.add(f"<< /Type /Page /Contents {body} 0 R /Resources << /Font << /F1 {font} 0 R /F2 {other} 0 R /F3 {f.add(simple_font())} 0 R >> >> >>", 3)
    return f.table(1)


def texts(spark, files, **options):
    df = spark.createDataFrame(list(files.items()), "doc_id string, content binary")
    return {r.doc_id: r.text for r in Extraction(df, **options).texts().collect()}


def test_texts(spark):
    two = to_unicode_map(chars=[(1, "甲"), (2, "丙")])
    files = {
        "fonts keep their own maps": cid_page("BT /F1 10 Tf 10 10 Td <00010002> Tj /F2 10 Tf 30 0 Td <00010002> Tj ET", two),
        "listed ranges": cid_page("BT /F1 10 Tf <000300040005> Tj ET", to_unicode_map(arrays=[(3, 5, ["一", "fi", "三"])])),
        "small wide glyphs": cid_page("BT /F1 6 Tf 10 10 Td <0001000200010002> Tj ET", two, dw=1000),
        "a gap between them": cid_page("BT /F1 6 Tf 10 10 Td <0001> Tj 12 0 Td <0002> Tj ET", two, dw=1000),
        "widths": cid_page("BT /F1 10 Tf 10 10 Td <00010002> Tj ET", two, w="1 [200] 2 2 300"),
        "kerned words": one_page("BT /F1 12 Tf 72 700 Td [(He) -120 (llo) 60 ( World)] TJ ET"),
        "fake bold": one_page("BT /F1 12 Tf 72 700 Td (Bold) Tj 0.02 0 Td (Bold) Tj ET"),
        "two baselines": one_page("BT /F1 12 Tf 72 700 Td (one) Tj 0 -1 Td 40 0 Td (drift) Tj -40 -30 Td (two) Tj ET"),
        "nothing": one_page(""),
        "escapes": one_page(rb"BT /F1 12 Tf (\(a\\b\)\351) Tj ET"),
    }
    assert texts(spark, files) == {
        "fonts keep their own maps": "甲丙 乙丁",
        "listed ranges": "一fi三",
        "small wide glyphs": "甲丙甲丙",
        "a gap between them": "甲 丙",
        "widths": "甲丙",
        "kerned words": "Hello World",
        "fake bold": "Bold",
        "two baselines": "one drift\ntwo",
        "nothing": "",
        "escapes": "(a\\b)é",
    }


def test_outputs(spark):
    long = "\n".join(f"line {i}" for i in range(70))
    rows = [("two pages", render(long)), ("bad", b"nothing"), ("scan", one_page("")), ("wrong count", render("x").replace(b"/Count 1", b"/Count 3"))]
    x = Extraction(spark.createDataFrame(rows, "doc_id string, content binary"), keep=True)
    docs = {r.doc_id: r for r in x.docs().collect()}
    assert docs["bad"].error_class == "DocumentError" and docs["two pages"].error_class is None and docs["wrong count"].page_count == 3 and docs["wrong count"].leaf_count == 1
    stats = {r.doc_id: r for r in x.stats().collect()}
    assert set(stats) == {"two pages", "scan", "wrong count"}
    s = stats["two pages"]
    assert (s.n_objects, s.page_count, s.processed, s.pages_with_text, s.scanned) == (7, 2, 2, 2, False) and s.chars == len(long.replace("\n", "")) and stats["scan"].scanned
    first, second = "\n".join(f"line {i}" for i in range(60)), "\n".join(f"line {i}" for i in range(60, 70))
    got = {r.doc_id: r.text for r in x.texts().collect()}
    assert got["two pages"] == first + "\n\f" + second and got["scan"] == ""
    assert {r.doc_id: r.text for r in x.texts("\f").collect()}["two pages"] == first + "\f" + second
    payload = {r.doc_id: json.loads(r.json) for r in x.json().collect()}["two pages"]
    assert payload["file"] == "two pages" and payload["version"] == "1.4" and payload["repaired"] is False
    page = payload["pages"][1]
    assert (page["page"], page["width"], page["height"], page["rotation"], page["chars"], page["text"]) == (2, 612, 792, 0, 70, second)
    assert page["lines"][0] == {"y": 760.0, "x": 36.0, "size": 12.0, "text": "line 60"}
    x.create_views()
    assert spark.sql("SELECT count(*) AS n FROM pdf_lines JOIN pdf_docs USING (doc_id)").first().n == 71


@pytest.mark.parametrize("spec,pages", [(None, [0, 1, 2]), ("", [0, 1, 2]), ("2", [1]), ("3,1", [2, 0]), ("2-", [1, 2]), ("-2", [0, 1]), ("3-2", [1, 2]), ("1,1,1-2", [0, 1]), ("9,x,2", [1]), (" ", [])])
def test_page_specs(spark, spec, pages):
    data = render("\n".join(f"{i}" for i in range(130)))
    df = spark.createDataFrame([(1, bytearray(data))], "doc_id long, content binary")
    got = Extraction(df, pages=spec).page_texts().orderBy("order").collect()
    assert [r.page_index for r in got] == pages and all(r.text.startswith(str(60 * r.page_index)) for r in got)


def test_entry_points(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(render("one\ntwo"))
    assert extract_text(str(tmp_path / "*.pdf"), spark).first().text == "one\ntwo"
    assert extract_pages(render("x"), spark).count() == 1
    assert extract(render("x"), spark).lines().first().fonts == ["F1"]
    assert document_page(render("x"), 0, spark).count() == 1
    for i in (1, -1):
        with pytest.raises(IndexError):
            document_page(render("x"), i, spark)


def test_modes(spark):
    df = spark.createDataFrame([(1, bytearray(b"nothing")), (2, None)], "doc_id long, content binary")
    assert [r.error_class for r in Extraction(df).docs().collect()] == ["DocumentError"] * 2
    assert Extraction(df).lines().collect() == [] and Extraction(df).texts().collect() == []
    with pytest.raises(Exception, match="DocumentError"):
        Extraction(df, mode="FAILFAST").docs().collect()


def test_only_what_is_wanted_is_computed(spark):
    df = writer.render_pdfs(spark.createDataFrame([(1, "text")], "doc_id long, text string"))
    assert Extraction(df)._rows().columns == ["doc_id", "kind", "doc", "page"]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for table in ("lines", "glyphs", "page_texts", "pages", "docs"):  # one pass, nothing shuffled
        p = plan(getattr(Extraction(df), table)())
        assert p.count("MapInArrow") == 2 and "Exchange" not in p and "Join" not in p  # one writes the files
    assert plan(Extraction(df).texts()).count("Exchange hashpartitioning") == 1
    joined = plan(Extraction(df, keep=True).glyphs())
    assert "BroadcastHashJoin" in joined and "CartesianProduct" not in joined


# ---------------------------------------------------------------- layout against the rules, restated


def restated_lines(glyphs):
    lines = []
    for g in sorted(glyphs, key=lambda g: (-g["y"], g["x"], g["seq"])):
        for line in lines[-1:-12:-1]:
            first = line[0]
            if abs(first["y"] - g["y"]) <= max(1.0, 0.35 * max(first["size"], g["size"])):
                line.append(g)
                break
        else:
            lines.append([g])
    out = []
    for line in sorted(lines, key=lambda c: -c[0]["y"]):
        text, last = "", None
        for g in sorted(line, key=lambda g: (round(g["x"], 2), g["seq"])):
            if last:
                if abs(g["x"] - last["x"]) < 0.05 and g["text"] == last["text"] and g["size"] == last["size"]:
                    continue
                wide = abs(last["adv_x"]) if abs(last["adv_x"]) > 0.01 else max(0.5, last["size"] / 2)
                if g["x"] - last["x"] - wide > max(0.6, 0.28 * max(last["size"], g["size"])):
                    text += " "
            text, last = text + g["text"], g
        out.append((line[0]["y"], len(line), text.rstrip()))
    return out


def restated_layout(glyphs):
    lines = []
    for g in sorted(glyphs, key=lambda g: (-g["y"], g["x"], g["seq"])):
        for line in lines[-1:-12:-1]:
            if abs(line[0]["y"] - g["y"]) <= max(1.0, 0.35 * max(line[0]["size"], g["size"])):
                line.append(g)
                break
        else:
            lines.append([g])
    unit, left = max(1.0, sorted(g["size"] for g in glyphs)[len(glyphs) // 2] / 2), min(g["x"] for g in glyphs)
    out = []
    for line in sorted(lines, key=lambda c: -c[0]["y"]):
        text, col = "", 0
        for i, g in enumerate(line):
            cell = round((g["x"] - left) / unit)
            if i:
                cell = max(cell, col)
            text += " " * (cell - col) + g["text"]
            col = max(cell, col) + max(1, round(abs(g["adv_x"]) / unit))
        out.append(text.rstrip())
    return "\n".join(out)


@pytest.fixture(scope="module")
def random_pages(spark):
    rng = random.Random(5)
    pages = {}
    for p in range(40):
        glyphs = []
        for seq in range(1, rng.choice([1, 30, 120])):
            y = 700.0 - 9 * rng.randrange(12) + rng.choice([0, 0, 0, 0.5, 1.25, 3.5])
            glyphs.append({"doc_id": p % 3, "page_index": p, "seq": seq, "text": rng.choice(["a", "b", "中", " ", "fi"]), "x": rng.choice([rng.randrange(0, 400), rng.randrange(0, 4000) / 10, 50.0, 50.01]) * 1.0, "y": y, "size": rng.choice([6.0, 8.0, 10.0, 10.0, 14.0]), "adv_x": rng.choice([0.0, 5.0, 5.0, 9.5, -4.0]), "font": rng.choice(["F1", "F2"])})
        pages[p] = glyphs
    schema = "doc_id int, page_index int, seq long, text string, x double, y double, size double, adv_x double, font string"
    return pages, spark.createDataFrame([g for p in pages.values() for g in p], schema)


def test_lines_follow_the_rules(random_pages):
    pages, df = random_pages
    got = {}
    for r in layout.lines(df).orderBy("page_index", "line_no").collect():
        got.setdefault(r.page_index, []).append((r.y, r.n_chars, r.text))
    assert got == {p: restated_lines(g) for p, g in pages.items() if g}


@pytest.mark.parametrize("points", [False, True])
def test_lines_of_whole_pages_follow_the_rules(random_pages, points):
    pages, _ = random_pages
    for glyphs in pages.values():
        if points:  # a character a glyph, as code points
            glyphs = [g | {"text": g["text"][:1]} for g in glyphs]
        if glyphs:
            col = lambda c: np.array([g[c] for g in glyphs], float)
            text = [g["text"] for g in glyphs]
            names = sorted({g["font"] for g in glyphs})
            font = np.array([names.index(g["font"]) for g in glyphs])
            got = lines_of(None if points else text, np.array([ord(t[0]) for t in text]), col("x"), col("y"), col("size"), col("adv_x"), col("seq").astype(int), font, names)
            assert list(zip(got.y.tolist(), got.n_chars.tolist(), got.text)) == restated_lines(glyphs)


def test_rounding_is_that_of_the_language():
    values = [2.675, 1.005, 0.125, 0.135, -2.675, 1e6 + 0.005, 36.0, 0.1 + 0.2, 1.115, 1e-9]
    assert rounded(np.array(values)).tolist() == [round(v, 2) for v in values]


def direct_fonts(n):
    """Pages whose font dictionaries stand directly in their resources, two of one name and different widths."""
    f = File()
    f.add("<< /Type /Catalog /Pages 2 0 R >>")
    f.add(f"<< /Type /Pages /Count {n} /Kids [{' '.join(f'{10 + i} 0 R' for i in range(n))}] >>")
    for i in range(n):
        f.stream(f"BT /F1 10 Tf 10 {100 + i} Td (AB{i}) Tj ET /X Do".encode(), num=50 + i)
        f.stream(b"BT /F1 10 Tf 10 50 Td (in form) Tj ET", f"/Subtype /Form /Resources << /Font << /F1 {simple_font(widths=[300] * 224)} >> >>", num=90 + i)
        f.add(f"<< /Type /Page /MediaBox [0 0 612 792] /Contents {50 + i} 0 R /Resources << /Font << /F1 {simple_font(widths=[400 + 100 * i] * 224)} >> /XObject << /X {90 + i} 0 R >> >> >>", 10 + i)
    return f.table(1)


def test_both_ways_to_glyphs_and_lines_agree(placed, spark):
    styles = ("table", "form", "spaced", "cid", "direct", "saved", "matrices", "moves", "quotes", "inline", "differences", "widths", "one_byte")
    more = [("style " + s, bytearray(render("one two\n\nthree  four é\nfive", s))) for s in styles] + [("own fonts", bytearray(direct_fonts(3)))]
    files = placed[0].unionByName(spark.createDataFrame(more, "doc_id string, content binary"))
    kept, direct = Extraction(files, keep=True), Extraction(files)
    rounded = lambda df: sorted(str((r.doc_id, r.page_index, r.line_no, round(r.y, 6), round(r.x, 6), round(r.end_x, 6), r.size, r.fonts, r.n_chars, r.text)) for r in df.collect())
    lines = rounded(direct.lines())
    assert rounded(kept.lines()) == lines == rounded(layout.lines(kept.glyphs())) and sum("own fonts" in x for x in lines) == 6
    every = lambda df: sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in df.collect())
    assert every(kept.glyphs()) == every(direct.glyphs())
    assert direct.font_codes().where("doc_id = 'own fonts' AND text = ''").count() == 0
    assert every(kept.contents()) == every(direct.contents()) and direct.contents().where("length(content) > 0").count() > 30
    for table in ("texts", "stats", "json", "page_texts", "layouts"):
        assert every(getattr(kept, table)()) == every(getattr(direct, table)())


@pytest.mark.parametrize("spec", ["", " ", "2", "1-3,5", "5-2,1", "9,2,2,x,1", "-", "1-2-3,4", "3-", "-2", "+1", "99999999999", "1-99999999999", ",", "0", "a-b"])
def test_page_specs_are_one(spark, spec):
    from inkspark.functions.geometry import page_spec

    got = spark.range(1).select(page_spec(F.lit(spec), F.lit(4)).alias("p")).first().p
    assert spec == "" or kernel.picked(spec, 4) == set(got)


def test_a_page_says_what_is_left_out(spark):
    f = File()
    f.add("<< /Type /Catalog /Pages 2 0 R >>")
    f.add("<< /Type /Pages /Count 1 /Kids [3 0 R] >>")
    f.add("<< /Type /Page /Contents 4 0 R >>")
    f.stream(b"x" * 5000, compress=True, num=4)
    x = Extraction(spark.createDataFrame([(1, bytearray(f.table(1)))], "doc_id int, content binary"), max_decoded_bytes=1000)
    assert "exceeds 1000 bytes" in x.pages().first().error_msg and x.docs().first().error_class is None


def test_layout_follows_the_rules(random_pages):
    pages, df = random_pages
    got = {r.page_index: r.layout for r in layout.layout_texts(df).collect()}
    assert got == {p: restated_layout(g) for p, g in pages.items() if g}


def test_line_properties(random_pages):
    pages, df = random_pages
    for r in layout.lines(df).where("page_index = 2").collect():
        assert r.end_x >= r.x - 4 and r.size in (6, 8, 10, 14) and set(r.fonts) <= {"F1", "F2"}


def test_text_columns_keep_their_place(spark):
    rows = [(1, 0, i + 1, c, float(x + 5 * k), float(y), 10.0, 5.0, "F") for i, (y, x, word) in enumerate([(100, 50, "ab"), (100, 120, "cd"), (80, 50, "x"), (80, 120, "y")]) for k, c in enumerate(word)]
    df = spark.createDataFrame(rows, "doc_id int, page_index int, seq int, text string, x double, y double, size double, adv_x double, font string")
    assert layout.layout_texts(df).first().layout == "ab" + " " * 12 + "cd\n" + "x" + " " * 13 + "y"
    assert [r.text for r in layout.lines(df).orderBy("line_no").collect()] == ["ab cd", "x y"]


def test_trailing_white_space_of_all_kinds_goes(spark):
    rows = [(1, 0, i, c, 5.0 * i, 1.0, 10.0, 5.0, "F") for i, c in enumerate("ab  \x1f 　")]
    df = spark.createDataFrame(rows, "doc_id int, page_index int, seq int, text string, x double, y double, size double, adv_x double, font string")
    assert layout.lines(df).first().text == "ab"
