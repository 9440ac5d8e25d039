import hashlib
import html as htmllib
import re
import struct
from collections import Counter

import pytest
import zstandard

from inkspark.llm import licenses, warc, wrappers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def odd_pages(spark):
    big = "<p>" + "x é " * 400
    rows = [(1, "http://a.example/x", big), (7, "http://a.example/y", big), (3, None, big), (4, "no url", None), (5, "http://b.example", ""), (6, "http://b.example/z\r\nWARC-Type: x", "small"), (8, "u", "small"), (9, "u", "\r\n\r\n" * 300), (9, "u", "\r\n\r\n" * 300), (None, "u", big), (10, "u", "y" * 300_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


# ---------------------------------------------------------------- WARC


def brute_warc(rows):
    groups = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 1000:
            groups.setdefault(h, []).append(p)
    for p, _, h in rows:
        data = (h or "").encode()
        last = max(groups.get(h, [p]), default=p) if p is not None else None
        revisit = p is not None and last != p
        yield p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None


@pytest.mark.parametrize("which", ["pages", "odd_pages"])
def test_round_trip(request, which):
    df = request.getfixturevalue(which)
    got = Counter(tuple(r) for r in warc.round_trip(df).collect())
    assert got == Counter(brute_warc([(r.page_id, r.url, r.html) for r in df.collect()]))


def test_hot_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 3)
    monkeypatch.setattr(warc, "HOT_PAYLOADS", 2)
    rows = [(i, f"http://h/{i}", chr(97 + i % 4) * (1200 if i % 4 else 10)) for i in range(40)] + [(50 + i, "u", "q" * 1500 if i < 2 else None) for i in range(4)]
    got = {tuple(r) for r in warc.planned(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "refers_to").collect()}
    last = {}
    for i, _, h in rows:
        if h and len(h) >= 1000:
            last[h] = max(last.get(h, 0), i)
    assert got == {(i, last[h] if h in last and i < last[h] else None) for i, _, h in rows}


def test_no_pages(pages):
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_archives_begin_with_their_dictionary(pages):
    records = [warc.page_record(r.page_id, r.url, r.html.encode()) for r in pages.collect()]
    dictionary = warc.train(records)
    data = b"".join(warc.archive(records, dictionary))
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_MAGIC
    assert list(warc.frames(data)) == records
    plain = struct.pack("<II", warc.DICTIONARY_MAGIC, len(dictionary)) + dictionary
    rest = data[8 + struct.unpack_from("<I", data, 4)[0] :]
    assert list(warc.frames(plain + rest)) == records  # an uncompressed dictionary
    assert list(warc.frames(b"".join(warc.archive(records)))) == records
    assert len(data) < len(b"".join(warc.archive(records)))
    with pytest.raises(warc.WarcError):
        list(warc.frames(rest))  # without its dictionary
    for cut in (4, len(data) - 5):
        with pytest.raises(warc.WarcError):
            list(warc.frames(data[:cut]))


def test_records_are_validated():
    good = warc.page_record(5, "http://x", b"payload")
    headers, block = warc.parse(good)
    assert warc.payload_of(headers, block) == b"payload" and headers["warc-type"] == "response"
    bad = [
        good.replace(b"WARC/1.1", b"WARC/9.9"),
        good.replace(b"WARC-Type: response\r\n", b""),
        good.replace(b"WARC-Type: response", b"WARC-Type: response\r\nWARC-Type: response"),
        good.replace(b"WARC-Date:", b"WARC Date:"),
        good.replace(b"Content-Length: ", b"Content-Length: 1"),
        good.replace(b"Content-Length: ", b"Content-Length: x"),
        good[:-2],
        good + good,
        good.replace(b"payload\r\n", b"pAyload\r\n"),
        b"nothing",
    ]
    for data in bad:
        with pytest.raises(warc.WarcError):
            warc.payload_of(*warc.parse(data))
    with pytest.raises(warc.WarcError):
        list(warc.read(zstandard.compress(good) + b"garbage that is no frame"))


# ---------------------------------------------------------------- HTML


def expected(page):
    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = [re.sub(r"\s+", " ", htmllib.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in re.split(r"</?p>|</?h1>|<br>", article)]
    return "\n".join(x for x in parts if x)


def test_articles_of_pages(pages):
    html = {r.page_id: r.html for r in pages.collect()}
    rows = wrappers.main_texts(pages).collect()
    assert len(rows) == len(html)
    for r in rows:
        assert r.text == expected(html[r.page_id]) and r.n_chars == len(r.text)


def site(n, extra=""):
    return (
        "<html><head><title>T</title></head><body><div class='top-menu'><a href=/>Home</a> <a href=/n>News</a></div>"
        f"<div id=crumbs><a href=/>Home</a> &gt; <a href=/n>Part {n}</a></div>"
        f"<div class=body-text><h2>Title &amp; {n}</h2>{extra}" + "".join(f"<p>Sentence {n} {i} is\n about <i>thing</i> {i * n}." for i in range(1, n % 4 + 3)) + "</div>"
        "<div class=bottom>All rights belong to nobody in particular.</div>"
        f"<div class='reader-comments'><p>I disagree {n}</p></div><script>var x = '<p>no</p>';</script></body></html>"
    )


def main(n, extra=()):
    return "\n".join([f"Title & {n}", *extra, *(f"Sentence {n} {i} is about thing {i * n}." for i in range(1, n % 4 + 3))])


def test_a_wrapper_tells_boilerplate_without_an_article_element():
    pages = [site(n) for n in range(12)]
    known = wrappers.learn(pages)
    for n in (3, 20, 41):
        assert wrappers.extract(site(n), known) == main(n)
    assert wrappers.extract(site(5, "<blockquote>Quoted</blockquote>"), known) == main(5, ["Quoted"])


def test_wrappers_cover_their_pages():
    pages = [site(n, "<blockquote>Q</blockquote>" if n % 3 else "") for n in range(12)]
    for w in (wrappers.learn(pages), wrappers.learn(pages[::-1])):
        assert all(any(wrappers.fits(k["wrapper"], wrappers.stream(wrappers.parse(p))) for k in w) for p in pages)
    text = str(wrappers.learn(pages)[0]["wrapper"])
    assert "['?', [['t', 'blockquote'" in text and "['+', [['t', 'p'" in text and "['#', " in text


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        ("<article><p>a<p>b<nav>no</nav><div class=cookie-notice>no</div></article><p>c", "a\nb"),
        ("<main>x &eacute;&#233;&#x41;&nbsp;y<form>no</form><br>z</main>", "x ééA y\nz"),
        ("<article><p>one <b>two</b>\n\t three</p><script>if (a < b) no()</script><!-- no --></article", "one two three"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
        ("<article><p>1 < 2 & 3 > 2</p></article>", "1 < 2 & 3 > 2"),
        ("<article><section class='comments'>no</section><p hidden>no</p><p>yes</p></article>", "yes"),
        ("<article>" + "<p>word</p>" * 5000 + "</article>", "\n".join(["word"] * 5000)),
        ("<div>" * 3000 + "deep", None),
    ],
)
def test_pages(page, text):
    got = wrappers.extract(page)
    assert text is None or got == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<body class='single sidebar-right'><p>the text</p><div class=share>no</div></body>", "the text"),
        ("<article class='post share'><p>the whole text</p></article><div class=menu>no</div>", "the whole text"),
        ("<body><form action=x><div><p>the text of the page</p></div></form><form>no</form></body>", "the text of the page"),
        ("<main><p>a long text of the page's main element, which is no card</p></main><article>card</article>", "a long text of the page's main element, which is no card"),
        ("<main><div>crumbs</div><article><p>the longer text of an article</p></article></main>", "the longer text of an article"),
    ],
)
def test_what_holds_the_page_is_no_boilerplate(page, text):
    assert wrappers.extract(page) == text


def post(n, end, k=4):
    return "<body><div class=post>" + "".join(f"<p>Paragraph {i} of post {n} has text." for i in range(k)) + f"<p>{end}</div></body>"


def test_paragraphs_that_share_a_path_are_judged_one_by_one():
    own = lambda n, k=4: "\n".join(f"Paragraph {i} of post {n} has text." for i in range(k))
    known = wrappers.learn([post(n, "All rights reserved") for n in range(8)])
    assert wrappers.extract(post(3, "All rights reserved"), known) == own(3)
    assert wrappers.extract(post(1, "<a href=x>Read more of this</a>")) == own(1)


def test_all_pages_of_a_host_are_counted(spark):
    # one host of 400 pages with a notice on most, and another one on 10 of them: 12 pages need not tell
    more = "<div class=special><p>It is only on few pages</div></body>"
    rows = [(n, "http://one.example/" + str(n), post(n, "Notice of the host" if n >= 100 else f"Own end {n}").replace("</body>", more if n % 40 == 0 else "</body>")) for n in range(400)]
    # near copies of one article on another, and a page of its own
    rows += [(1000 + n, "http://two.example/" + str(n), f"<body><div class=post><p>The copied text is long.<p>It has two parts.</div><div>{n}</div></body>") for n in range(30)]
    rows += [(2000, "http://two.example/own", post(7, "end"))]
    got = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert all("Notice" not in got[n] and "only on" not in got[n] and f"Paragraph 3 of post {n} " in got[n] for n in range(400)) and got[5].endswith("Own end 5")
    assert all(got[1000 + n].startswith("The copied text is long.\nIt has two parts.") for n in range(30))
    assert got[2000].startswith("Paragraph 0 of post 7")


def card(n):
    return f"<article><div class=byline>By the same editors</div><h1>Title {n}</h1><p>Text {n} of an article.</p>" + "<p>More.</p>" * (n % 3) + ("<blockquote>Once</blockquote>" if n == 4 else "") + "</article>"


def test_each_kind_has_its_wrapper_and_it_decides_in_articles():
    pages = [card(n) if n % 2 else site(n) for n in range(12)] + [card(4)]
    known = wrappers.learn(pages)
    assert len(known) == 2
    text = lambda n, *more: "\n".join([f"Title {n}", f"Text {n} of an article.", *["More."] * (n % 3), *more])
    # its count alone decides nothing here: the wrapper does
    alone = [{**k, "skip": []} for k in known]
    assert wrappers.extract(card(5), alone) == text(5) and wrappers.extract(card(4), alone) == text(4, "Once")
    assert wrappers.extract(site(6), known) == main(6)


def plain(n):
    """No article, no telling class or id: the wrapper alone tells where the text is."""
    own = "".join(f"<p>Sentence {n} {i} tells of thing {i * n} and of what came after it." for i in range(n % 5 + 6))
    return (
        f"<body><div class=za><span>Edition {n}</span> <a href=/>Home</a></div><div class=zb><div class=ze>Buy item {n * 7} now</div><div class=zc><h1>Title {n}</h1>{own}"
        f"<div class=zf><b>Send it on</b> to friends</div></div></div><div class=zd>Seen {n * 13} times</div></body>"
    )


def plain_text(n):
    return "\n".join([f"Title {n}", *(f"Sentence {n} {i} tells of thing {i * n} and of what came after it." for i in range(n % 5 + 6))])


def test_the_wrapper_decides_where_the_text_is():
    pages = [plain(n) for n in range(20)]
    known = [{**k, "skip": []} for k in wrappers.learn(pages)]
    assert [k["main"][1] for k in known] == ["div.zc"] and known[0]["main"][2][0][:2] == ["t", "h1"]
    for n in range(20):
        assert wrappers.extract(plain(n), known) == plain_text(n)
        off = wrappers.extract(plain(n))
        assert "Buy item" in off and "Seen" in off and "Send it on" in off


def test_the_wrapper_decides_on_whole_tables(spark):
    rows = [(n, f"http://plain.example/{n}", plain(n)) for n in range(60)] + [(100 + n, f"http://cards.example/{n}", "<body>" + card(n) + f"<p>Seen {n}</body>") for n in range(30)]
    got = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert all(got[n] == plain_text(n) for n in range(60))
    assert all(got[100 + n].startswith(f"Title {n}\nText {n} of an article.") and "Seen" not in got[100 + n] and "editors" not in got[100 + n] for n in range(30))


@pytest.mark.parametrize(
    "body,name",
    [
        # text stands beside the largest container: it is not left behind
        ("<h1>Title {n}</h1><div class=x><p>{long}</div>", "body"),
        ("<div class=x><p>{long}</div><div class=y><p>{long}{n}</div>", "body"),
        # containers that are the same on all pages do not count
        ("<div class=x><p>" + "the same words " * 200 + "</div><div class=y><p>{long}</div>", "div.y"),
        # nor do links
        ("<div class=x><a href=u>{long}{long}</a></div><div class=y><p>{long}</div>", "div.y"),
        ("<main><div class=c><p>{long}{long}</div><article><p>{long}</p></article></main>", "article"),
        ("<main><p>{long}{long}{long}{long}{long}</main><article>card {n}</article>", "main"),
        ("<div class=x><div class=post><p>{long}</div><div class=post><p>{long} more</div></div>", "div.post"),
    ],
)
def test_main_fields(body, name):
    pages = ["<body>" + body.format(n=n, long=f"These are words of page {n}, " * (20 + n % 3)) + "</body>" for n in range(8)]
    (known,) = wrappers.learn(pages)
    assert known["main"][1] == name


def test_main_field_of_nothing():
    assert wrappers.main_field([]) is None and wrappers.main_field([["*", 5]]) is None and wrappers.main_field([["=", "x", 3]]) is None


def test_wrappers_of_parts_cover_all_pages():
    pages = [(card if n % 5 else site)(n) for n in range(40)]
    kinds = {}
    for part in (pages[:13], pages[13:20], pages[20:]):
        for k in wrappers.learn(part):
            kinds[k["kind"]] = wrappers.merged(kinds.get(k["kind"]), (k["wrapper"], [k["kind"]]))
    for p in pages:
        tree = wrappers.parse(p)
        assert wrappers.slot_texts(kinds[wrappers.kind_of(tree)][0], tree, set())


def test_odd_pages(odd_pages):
    rows = wrappers.main_texts(odd_pages).collect()
    assert len(rows) == 11 and all(r.n_chars == len(r.text) for r in rows)
    assert wrappers.main_texts(odd_pages.limit(0)).collect() == []


# ---------------------------------------------------------------- licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, k):
    w = WORD.findall((text or "").lower())
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def brute_licenses(text, templates):
    """Templates whose shingles some stretch as long as the template holds by the asked share."""
    out = set()
    for name, t in templates.items():
        n = len(WORD.findall(t.lower()))
        k = min(licenses.K, n)
        want = set(grams(t, k))
        own = grams(text, k)
        for i in range(max(1, len(own) - (n - k))):
            if len(want.intersection(own[i : i + n - k + 1])) >= licenses.CONTAINMENT * len(want):
                out.add(name)
                break
    return out


def test_licenses_of_documents(spark, documents, corpus):
    rows = [(1000 + i, f"intro {i} " + t + " outro words follow here") for i, t in enumerate(licenses.TEMPLATES.values())]
    text = licenses.TEMPLATES["MIT-text"].split()
    rows += [(2000, " ".join(w for i, w in enumerate(text) if i != 20)), (2001, " ".join(w if i % 6 else "zzz" for i, w in enumerate(text))), (2002, "x " * 5000 + " ".join(text))]
    df = documents.select("doc_id", "text").unionByName(corpus.select("doc_id", "text")).unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {}
    for r in licenses.scan(df).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    for r in df.collect():
        missed = brute_licenses(r.text, licenses.TEMPLATES) - got.get(r.doc_id, set())
        assert not missed, (r.doc_id, missed)
    for i, name in enumerate(licenses.TEMPLATES):
        assert name in got[1000 + i]
    assert "MIT-text" in got[2000] and "MIT-text" in got[2002] and 2001 not in got


def test_matches_are_where_they_say(spark):
    df = spark.createDataFrame([(1, "a b c " + licenses.TEMPLATES["Apache-2.0"] + " d e")], "doc_id long, text string")
    (r,) = licenses.scan(df).collect()
    assert (r.license, r.first_word, r.end_word, r.n_shared, r.n_template) == ("Apache-2.0", 3, 11, 4, 4)


def test_every_occurrence_is_found_and_none_that_is_not_there(spark):
    words = licenses.TEMPLATES["MIT-text"].split()
    twice = " ".join([*words, "and", *(w if i != 20 else "else" for i, w in enumerate(words)), "more", "text"] + ["x"] * 300 + words)
    half = " ".join(words[: len(words) // 2])
    backwards = " ".join(reversed(words))
    df = spark.createDataFrame([(1, twice), (2, half), (3, backwards), (4, "Released under the other License. MIT it is not")], "doc_id long, text string")
    rows = licenses.scan(df).orderBy("first_word").collect()
    n = len(WORD.findall(licenses.TEMPLATES["MIT-text"]))
    whole = [(r.first_word, r.end_word) for r in rows if r.license == "MIT-text"]
    assert {r.doc_id for r in rows} == {1} and [a for a, _ in whole] == [0, n + 1, 2 * n + 3 + 300] and [b - a for a, b in whole] == [n] * 3
    for r in rows:  # what is reported holds the asked share
        own = set(grams(" ".join(WORD.findall(twice.lower())[r.first_word : r.end_word]), min(licenses.K, n)))
        want = set(grams(licenses.TEMPLATES[r.license], min(licenses.K, len(WORD.findall(licenses.TEMPLATES[r.license])))))
        assert len(own & want) == r.n_shared >= licenses.CONTAINMENT * len(want) == licenses.CONTAINMENT * r.n_template


def test_whole_texts_as_a_table(spark, monkeypatch):
    texts = [(f"L{i}", " ".join(f"word{i}x{j}" for j in range(700))) for i in range(5)]
    docs = spark.createDataFrame([(i, f"before it {t} after") for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    for most in (licenses.BLOCK_BYTES, 10_000):
        monkeypatch.setattr(licenses, "BLOCK_BYTES", most)
        got = licenses.scan(docs, spark.createDataFrame(texts, "name string, text string")).collect()
        assert sorted((r.doc_id, r.license, r.first_word, r.end_word) for r in got) == [(i, f"L{i}", 2, 702) for i in range(5)]
    assert licenses.scan(docs, {}).collect() == []


def test_bands_keep_their_promise():
    for t in licenses.grouped([licenses.Template(n, x) for n, x in licenses.TEMPLATES.items()]):
        for one in t.templates:
            m = len(one.shingles)
            s = licenses.CONTAINMENT * m / (m + t.window - licenses.CONTAINMENT * m)
            assert (1 - s) ** len(t.factors) <= licenses.MISS * 1.0001


def test_nothing_to_scan(nothing):
    assert licenses.scan(nothing).collect() == []
