import pytest

from inkspark.sources.syntax import MAX_DEPTH, Name, ParseError, Ref, Scanner, Stream, indirect, tokenize


def tokens(data):
    return list(tokenize(data))


def test_numbers():
    assert tokens(b"1 -2 +7 3.5 .5 5. -.002") == [("number", x) for x in (1, -2, 7, 3.5, 0.5, 5.0, -0.002)]
    assert [type(v) for _, v in tokens(b"1 1.0")] == [int, float]


@pytest.mark.parametrize("word", [b"1.2.3", b"+", b"--5", b"5-3", b"."])
def test_odd_numbers_are_words(word):
    assert tokens(word) == [("word", word)]


def test_number_then_operator():
    assert tokens(b"12Tf 0 0Td") == [("number", 12), ("word", b"Tf"), ("number", 0), ("number", 0), ("word", b"Td")]


def test_names():
    assert tokens(b"/A /a#20b /x#zz / /A/B") == [("name", n) for n in ("A", "a b", "x#zz", "", "A", "B")]


@pytest.mark.parametrize(
    "raw,value",
    [
        (b"(plain)", b"plain"),
        (b"(a(b)c)", b"a(b)c"),
        (rb"(\n\r\t\b\f\(\)\\)", b"\n\r\t\b\f()\\"),
        (rb"(\101\7\0053\400)", b"A\x07\x053\x00"),
        (b"(a\\\nb\\\r\nc\\\rd)", b"abcd"),
        (rb"(\q\8)", b"q8"),
        (b"(open", b"open"),
        (b"(open\\", b"open"),
        (b"<48656C6C6F>", b"Hello"),
        (b"<48 65\n6C 6>", b"Hel`"),
        (b"<4x>", b""),
        (b"<41", b"A"),
    ],
)
def test_strings(raw, value):
    assert tokens(raw) == [("string", value)]


def test_delimiters_and_comments():
    assert [k for k, _ in tokens(b"<< >> [ ] % no\n{ ) x")] == ["open", "close", "array", "end", "word", "word", "word"]
    with pytest.raises(ParseError):
        tokens(b"a > b")


def test_peek_and_position():
    s = Scanner(b"1 2 3")
    assert s.peek() == s.peek() == s.next() == ("number", 1)
    at = s.pos
    s.next()
    s.pos = at
    assert s.next() == ("number", 2)


@pytest.mark.parametrize(
    "raw,value",
    [
        (b"true", True),
        (b"false", False),
        (b"null", None),
        (b"", None),
        (b"[1 2.5 /N (s) <41> null]", [1, 2.5, "N", b"s", b"A", None]),
        (b"<< /A 1 /B [2 0 R] /A 3 >>", {"A": 3, "B": [Ref(2, 0)]}),
        (b"12 0 R", Ref(12, 0)),
        (b"12 0 RG", 12),
        (b"[1 2 3]", [1, 2, 3]),
        (b"[<< /K << /D 1 >> >>]", [{"K": {"D": 1}}]),
        (b"odd", "odd"),
    ],
)
def test_objects(raw, value):
    got = Scanner(raw).object()
    assert got == value and type(got) is type(value) or isinstance(got, Name)


@pytest.mark.parametrize("raw", [b"<< /A 1", b"[1 2", b"<< 1 2 >>", b"]", b">>", b"[" * (MAX_DEPTH + 2)])
def test_errors(raw):
    with pytest.raises(ParseError):
        Scanner(raw).object()


def test_indirect_objects():
    assert indirect(b" 7 0 obj [1] endobj", 0) == (7, 0, [1])
    data = b"7 1 obj << /Length 3 >> stream\r\nabc\nendstream endobj"
    assert indirect(data, 0) == (7, 1, Stream({"Length": 3}, b"abc"))
    for wrong in (b"99", b"-4", b"5 0 R"):
        assert indirect(data.replace(b"3", wrong), 0)[2].raw == b"abc"
    for bad in (b"x 0 obj 1", b"1 0 obx 1", b"1 0 obj << >> stream no end"):
        with pytest.raises(ParseError):
            indirect(bad, 0)
