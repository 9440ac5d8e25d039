"""PDF syntax: tokens and objects out of bytes.

Tokens are found by compiled patterns rather than byte by byte.  Objects map to
plain Python values: null None, booleans, numbers, strings ``bytes``, names
``Name``, arrays ``list``, dictionaries ``dict``, references ``Ref``, streams
``Stream``.
"""

from __future__ import annotations

import re
from typing import NamedTuple

MAX_DEPTH = 64

BLANK = rb"\0\t\n\f\r "
REGULAR = rb"[^\0\t\n\f\r ()<>\[\]{}/%]"
SKIP = re.compile(rb"(?:[" + BLANK + rb"]+|%[^\r\n]*)*")
TOKEN = re.compile(
    rb"(?P<open><<)|(?P<close>>>)|(?P<array>\[)|(?P<end>\])|(?P<name>/" + REGULAR + rb"*)|(?P<string>\()|(?P<hex><[^>]*>?)"
    rb"|(?P<number>[0-9+.\-]+)|(?P<word>" + REGULAR + rb"+)|(?P<other>[^>])"
)
NUMBER = re.compile(rb"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\Z")
WORD = re.compile(REGULAR + rb"+")
NAME_ESCAPE = re.compile(rb"#([0-9A-Fa-f]{2})")
STRING_MARK = re.compile(rb"[()\\]")
STRING_ESCAPE = re.compile(rb"\\(\r\n|[0-7]{1,3}|[\s\S]|\Z)")
REFERENCE = re.compile(rb"[" + BLANK + rb"]+([+-]?[0-9]+)[" + BLANK + rb"]+R(?!" + REGULAR + rb")")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b"", b"": b""}


class ParseError(ValueError):
    """Bytes that are no PDF syntax."""


class Name(str):
    """A name, told apart from text."""

    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


class Stream(NamedTuple):
    dict: dict
    raw: bytes


class Word(bytes):
    """A keyword or operator."""

    __slots__ = ()


def unescape(raw: bytes) -> bytes:
    """A literal string's bytes from what stands between its parentheses."""
    if b"\\" not in raw:
        return raw

    def one(m):
        c = m[1]
        if c in ESCAPES:
            return ESCAPES[c]
        return bytes([int(c, 8) & 255]) if c[:1] in b"01234567" and c else c

    return STRING_ESCAPE.sub(one, raw)


def unhex(raw: bytes) -> bytes:
    """A hex string's bytes; an odd digit is followed by 0, other characters make it empty."""
    digits = raw.translate(None, b"\0\t\n\f\r ")
    try:
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))
    except ValueError:
        return b""


def unname(raw: bytes) -> str:
    return NAME_ESCAPE.sub(lambda m: bytes([int(m[1], 16)]), raw).decode("latin-1")


#: what is left of an array of nothing but whole numbers
NUMBERS = re.compile(rb"((?:[\t\n\f\r ]*[0-9]{1,15}(?=[\t\n\f\r \]]))*+)[\t\n\f\r ]*\]")


class Scanner:
    """Tokens from a position on: (kind, value) with kinds open, close, array, end, name, string, number, word and eof."""

    __slots__ = ("buf", "pos")

    def __init__(self, buf, pos=0):
        self.buf, self.pos = buf, pos

    def next(self):
        buf = self.buf
        at = SKIP.match(buf, self.pos).end()
        m = TOKEN.match(buf, at)
        if m is None:
            self.pos = at
            if at >= len(buf):
                return "eof", None
            raise ParseError(f"a lone '>' at {at}")
        kind, self.pos = m.lastgroup, m.end()
        if kind == "number":
            text = m[0]
            if NUMBER.match(text):
                return "number", float(text) if b"." in text else int(text)
            m = WORD.match(buf, at)
            self.pos = m.end()
            return "word", Word(m[0])
        if kind == "word" or kind == "other":
            return "word", Word(m[0])
        if kind == "name":
            return kind, Name(unname(m[0][1:]))
        if kind == "hex":
            return "string", unhex(m[0][1:].rstrip(b">"))
        if kind == "string":
            return kind, self._literal()
        return kind, None

    def _literal(self):
        buf, at, depth = self.buf, self.pos, 1
        while True:
            m = STRING_MARK.search(buf, at)
            if m is None:
                raw, self.pos = buf[self.pos :], len(buf)
                return unescape(raw)
            c, at = m[0], m.end()
            if c == b"\\":
                at += 1
            else:
                depth += 1 if c == b"(" else -1
                if not depth:
                    raw, self.pos = buf[self.pos : at - 1], at
                    return unescape(raw)

    def peek(self):
        at = self.pos
        try:
            return self.next()
        finally:
            self.pos = at

    def object(self, depth=0):
        """The next object; None at the end."""
        return self._value(*self.next(), depth)

    def _value(self, kind, value, depth):
        if depth > MAX_DEPTH:
            raise ParseError("objects are nested too deeply")
        if kind == "number":
            if isinstance(value, int):
                m = REFERENCE.match(self.buf, self.pos)
                if m:
                    self.pos = m.end()
                    return Ref(value, int(m[1]))
            return value
        if kind in ("name", "string"):
            return value
        if kind == "array":
            if m := NUMBERS.match(self.buf, self.pos):  # widths and the like
                self.pos = m.end()
                return list(map(int, m[1].split()))
            out = []
            while (token := self.next())[0] != "end":
                if token[0] == "eof":
                    raise ParseError("an array is not closed")
                out.append(self._value(*token, depth + 1))
            return out
        if kind == "open":
            out = {}
            while (token := self.next())[0] != "close":
                if token[0] != "name":
                    raise ParseError("a dictionary is not closed" if token[0] == "eof" else "a key is no name")
                out[str(token[1])] = self.object(depth + 1)
            return out
        if kind == "word":
            return {b"true": True, b"false": False, b"null": None}.get(bytes(value), Name(value.decode("latin-1")))
        if kind == "eof":
            return None
        raise ParseError(f"unexpected {kind} before {self.pos}")

    def loose(self, kind, value):
        """A content-stream operand: what is not closed or out of place does no harm."""
        if kind == "array":
            out = []
            while (token := self.next())[0] not in ("end", "eof"):
                if token[0] == "word":
                    if token[1] in (b"true", b"false", b"null"):
                        out.append({b"true": True, b"false": False}.get(bytes(token[1])))
                elif token[0] != "close":
                    out.append(self.loose(*token))
            return out
        if kind == "open":
            out = {}
            while (token := self.next())[0] not in ("close", "eof"):
                if token[0] == "name":
                    k, v = self.next()
                    if k in ("close", "eof"):
                        break
                    out[str(token[1])] = {b"true": True, b"false": False}.get(bytes(v)) if k == "word" else self.loose(k, v)
            return out
        return value


def tokenize(buf: bytes):
    """All tokens, as (kind, value)."""
    scanner = Scanner(buf)
    while (token := scanner.next())[0] != "eof":
        yield token


def whole(value):
    """An int that is no bool."""
    return isinstance(value, int) and not isinstance(value, bool)


def numeric(value):
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def indirect(buf: bytes, pos: int):
    """(num, gen, value) of the indirect object at ``pos``."""
    s = Scanner(buf, pos)
    (k1, num), (k2, gen), (k3, word) = s.next(), s.next(), s.next()
    if k1 != "number" or k2 != "number" or not whole(num) or not whole(gen) or k3 != "word" or word != b"obj":
        raise ParseError(f"no indirect object at {pos}")
    value = s.object()
    if isinstance(value, dict):
        after = s.pos
        try:
            kind, word = s.next()
        except ParseError:
            kind, word = "eof", None
        if kind == "word" and word == b"stream":
            return num, gen, Stream(value, _body(buf, s.pos, value.get("Length")))
        s.pos = after
    return num, gen, value


def _body(buf, at, length):
    """A stream's raw bytes: of its direct length if "endstream" follows there, else up to the next "endstream"."""
    at += buf[at : at + 1] == b"\r"
    at += buf[at : at + 1] == b"\n"
    if whole(length) and b"endstream" in buf[at + length : at + length + 20] and length >= 0:
        return buf[at : at + length]
    end = buf.find(b"endstream", at)
    if end < 0:
        raise ParseError("a stream has no end")
    raw = buf[at:end]
    for eol in (b"\r\n", b"\n", b"\r"):
        if raw.endswith(eol):
            return raw[: -len(eol)]
    return raw
