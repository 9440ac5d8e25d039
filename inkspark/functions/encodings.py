"""Character encodings of simple fonts and glyph names, as static dimensions."""

from __future__ import annotations

import string

# Characters of glyph names beyond single letters, which name themselves.
PUNCTUATION_NAMES = (
    "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash "
    "zero one two three four five six seven eight nine colon semicolon less equal greater question at"
)
BRACKET_NAMES = "bracketleft backslash bracketright asciicircum underscore grave"
BRACE_NAMES = "braceleft bar braceright asciitilde"
OTHER_NAMES = {
    "cent": "¢", "sterling": "£", "yen": "¥", "section": "§", "copyright": "©", "guillemotleft": "«",
    "logicalnot": "¬", "registered": "®", "degree": "°", "paragraph": "¶", "periodcentered": "·", "guillemotright": "»",
    "AE": "Æ", "Oslash": "Ø", "germandbls": "ß", "ae": "æ", "oslash": "ø", "dotlessi": "ı",
    "Lslash": "Ł", "lslash": "ł", "OE": "Œ", "oe": "œ", "Delta": "Δ", "Pi": "Π",
    "Sigma": "Σ", "Omega": "Ω", "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ",
    "epsilon": "ε", "theta": "θ", "lambda": "λ", "mu": "μ", "pi": "π", "sigma": "σ",
    "phi": "φ", "omega": "ω", "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’",
    "quotesinglbase": "‚", "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "dagger": "†", "daggerdbl": "‡",
    "bullet": "•", "ellipsis": "…", "perthousand": "‰", "guilsinglleft": "‹", "guilsinglright": "›", "fraction": "⁄",
    "Euro": "€", "trademark": "™", "arrowleft": "←", "arrowup": "↑", "arrowright": "→", "arrowdown": "↓",
    "arrowboth": "↔", "arrowdblleft": "⇐", "arrowdblright": "⇒", "partialdiff": "∂", "element": "∈", "product": "∏",
    "summation": "∑", "minus": "−", "radical": "√", "infinity": "∞", "integral": "∫", "approxequal": "≈",
    "notequal": "≠", "lessequal": "≤", "greaterequal": "≥", "ff": "ﬀ", "fi": "ﬁ", "fl": "ﬂ",
    "ffi": "ﬃ", "ffl": "ﬄ",
}
# The codes of StandardEncoding beyond ASCII, and the two in ASCII that differ from it.
STANDARD = {
    0x27: "’", 0x60: "‘",
    0xA1: "¡", 0xA2: "¢", 0xA3: "£", 0xA4: "⁄", 0xA5: "¥", 0xA6: "ƒ", 0xA7: "§", 0xA8: "¤",
    0xA9: "'", 0xAA: "“", 0xAB: "«", 0xAC: "‹", 0xAD: "›", 0xAE: "ﬁ", 0xAF: "ﬂ", 0xB1: "–",
    0xB2: "†", 0xB3: "‡", 0xB4: "·", 0xB6: "¶", 0xB7: "•", 0xB8: "‚", 0xB9: "„", 0xBA: "”",
    0xBB: "»", 0xBC: "…", 0xBD: "‰", 0xBF: "¿", 0xC1: "`", 0xC2: "´", 0xC3: "ˆ", 0xC4: "˜",
    0xC5: "¯", 0xC6: "˘", 0xC7: "˙", 0xC8: "¨", 0xCA: "˚", 0xCB: "¸", 0xCD: "˝", 0xCE: "˛",
    0xCF: "ˇ", 0xD0: "—", 0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xEB: "º",
    0xF1: "æ", 0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß",
}


def glyph_names() -> dict[str, str]:
    """Character of each known glyph name."""
    names = {c: c for c in string.ascii_letters}
    for first, row in ((32, PUNCTUATION_NAMES), (91, BRACKET_NAMES), (123, BRACE_NAMES)):
        names |= {n: chr(first + i) for i, n in enumerate(row.split())}
    return names | OTHER_NAMES | {"nbspace": "\u00a0", "sfthyphen": "\u00ad"}


def accented_names() -> dict[str, str]:
    """Names such as eacute, by rule: a letter and an accent that compose to one character."""
    import unicodedata

    accents = {"grave": 0x300, "acute": 0x301, "circumflex": 0x302, "tilde": 0x303, "macron": 0x304, "breve": 0x306, "dotaccent": 0x307, "dieresis": 0x308, "ring": 0x30A, "hungarumlaut": 0x30B, "caron": 0x30C, "cedilla": 0x327, "ogonek": 0x328}
    made = {c + name: unicodedata.normalize("NFC", c + chr(mark)) for c in string.ascii_letters for name, mark in accents.items()}
    return {n: x for n, x in made.items() if len(x) == 1}


GLYPHS = glyph_names()
ACCENTED = accented_names()


def character_of(name: str, extended: bool = False) -> str:
    """Text of a glyph name: listed, uniXXXX..., uXXXX to uXXXXXX, or that of the part before a dot; else empty.

    Surrogates, which no text can hold, are dropped.
    """
    while name:
        known = GLYPHS.get(name) or (ACCENTED.get(name) if extended else None)
        if known:
            return known
        digits = name[3:] if name.startswith("uni") and len(name) >= 7 and len(name) % 4 == 3 else None
        if digits and all(c in string.hexdigits for c in digits):
            return "".join(c for i in range(0, len(digits), 4) if not 0xD800 <= ord(c := chr(int(digits[i : i + 4], 16))) < 0xE000)
        if name.startswith("u") and len(name) > 4 and all(c in string.hexdigits for c in name[1:]):
            value = int(name[1:], 16)
            if 0 < value <= 0x10FFFF:
                return "" if 0xD800 <= value < 0xE000 else chr(value)
        if "." not in name:
            return ""
        name = name.partition(".")[0]
    return ""


def _codec(name: str) -> dict[int, str]:
    out = {}
    for code in range(256):
        try:
            out[code] = bytes([code]).decode(name)
        except UnicodeDecodeError:
            pass
    return out


def encodings() -> dict[str, dict[int, str]]:
    """Code to character for each base encoding."""
    standard = {c: chr(c) for c in range(32, 127)} | STANDARD
    win, mac = _codec("cp1252"), _codec("mac_roman")
    return {"StandardEncoding": standard, "WinAnsiEncoding": win, "PDFDocEncoding": win, "MacRomanEncoding": mac, "MacExpertEncoding": mac}


ENCODINGS = encodings()


def encodings_table(spark):
    """(encoding, code, ch): the static dimension of all base encodings."""
    return spark.createDataFrame([(n, c, ch) for n, table in ENCODINGS.items() for c, ch in table.items()], "encoding string, code int, ch string")


def glyph_names_table(spark):
    """(name, ch): the static dimension of glyph names."""
    return spark.createDataFrame(sorted(GLYPHS.items()), "name string, ch string")
