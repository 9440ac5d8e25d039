"""Glyphs and lines of a page straight from its shown strings, by array arithmetic.

The logical plan in ``operators`` makes the same of tables, a row for each glyph.
Here a page's strings become flat arrays of codes; widths, characters and matrices
are looked up, advances summed by run, and lines cut out of one text, so that a
page costs some dozens of numpy calls and no Python per glyph.  Pages whose codes
stand for more than one character take the same way with a list of texts.

Nothing leaves the task that has the file: no join, no shuffle, a page in memory.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from ..functions.encodings import ENCODINGS

LINE_RATIO, LINE_MIN = 0.35, 1.0
SPACE_RATIO, SPACE_MIN = 0.28, 0.6
RECENT = 11


def plain(s):
    """Text without surrogates, which neither Arrow nor Spark can hold."""
    if s is None or s.isascii():
        return s
    return "".join(c for c in s if not 0xD800 <= ord(c) < 0xE000)


def _points(texts):
    return np.array([ord(t) if len(t) == 1 else -1 if t else 0 for t in texts], np.int64)


@cache
def _plain_codes(encoding):
    """(texts, points) of the codes of fonts that have nothing but a base encoding."""
    texts = [plain(ENCODINGS.get(encoding, {}).get(c)) or "" for c in range(256)]
    return texts, _points(texts)


class Codes:
    """What the codes of one font show: ``width``, ``text`` and, for one character or none, its ``point`` (-1 for more)."""

    def __init__(self, font):
        self.two = font is not None and font.code_bytes == 2
        self.font = font
        base = ENCODINGS.get(font.encoding, {}) if font is not None and not font.is_cid else {}
        if not self.two:
            if font is not None and not font.unicode and not font.differences:
                self.text, self.point = _plain_codes(None if font.is_cid else font.encoding)
            else:
                self.text = [self._shown(c, base) for c in range(256)]
                self.point = _points(self.text)
            self.width = np.zeros(256) if font is None else np.full(256, font.default_width)
            if font is not None and font.widths:
                own = [(c, w) for c, w in font.widths.items() if 0 <= c < 256]
                self.width[[c for c, _ in own]] = [w for _, w in own]
        else:  # filled as codes are met
            self.base, self.text = base, {}
            self.point, self.width = np.full(65536, -2, np.int64), np.zeros(65536)

    def _shown(self, code, base):
        font = self.font
        if font is None:
            return ""
        found = font.unicode.get(code)
        if found is None and not font.is_cid:
            found = font.differences.get(code)
            if found is None:
                found = base.get(code)
        return plain(found) or ""

    def of(self, data):
        """Codes of a string's bytes."""
        if not self.two:
            return np.frombuffer(data, np.uint8)
        codes = np.frombuffer(data, ">u2", len(data) // 2)
        new = codes[self.point[codes] == -2]
        for c in set(new.tolist()):
            t = self._shown(c, self.base)
            self.text[c] = t
            self.point[c] = ord(t) if len(t) == 1 else -1 if t else 0
            self.width[c] = self.font.widths.get(c, self.font.default_width)
        return codes


class Glyphs:
    """Arrays over a page's glyphs that have a text: their place and size, and of which string (``row``) and code (``at``) they are."""

    __slots__ = ("x", "y", "size", "adv_x", "adv_y", "row", "at", "code", "point", "texts", "shows")

    def __len__(self):
        return len(self.x)

    def text(self):
        """A text for each glyph."""
        if self.texts is not None:
            return self.texts
        return list(self.point.astype("<u4").tobytes().decode("utf-32-le"))


def place(shows, fonts, known, rise=False):
    """Glyphs of a page's ``shows`` (see ``document.Content``); ``known`` keeps the fonts' codes for the next page."""
    out = Glyphs()
    out.shows = shows
    codes, counts, flat, of_font = [], [], [], []
    for run, data, kern, key, name, size, tc, tw, tz, lift, tm, ctm, color, mode in shows:
        if data is None:
            codes.append(_NONE)
            counts.append(1)
            of_font.append(None)
            flat.append((run, -kern / 1000.0 * size * tz, 0.0, 0.0, 0.0, 0.0, size, lift if rise else 0.0, *tm, *ctm))
        else:
            table = known.get(key)
            if table is None:
                table = known[key] = Codes(fonts.get(key))
            own = table.of(data)
            codes.append(own)
            counts.append(len(own))
            of_font.append(table)
            flat.append((run, 0.0, size / 1000.0, tc, 0.0 if table.two else tw, tz, size, lift if rise else 0.0, *tm, *ctm))
    total = sum(counts)
    if not total:
        out.x = out.y = out.size = out.adv_x = out.adv_y = np.zeros(0)
        out.row = out.at = out.code = out.point = np.zeros(0, np.int64)
        out.texts = None
        return out
    m = np.array(flat)
    counts = np.array(counts)
    code = np.concatenate(codes).astype(np.int64)
    distinct = list(dict.fromkeys(t for t in of_font if t is not None))
    row = np.repeat(np.arange(len(counts)), counts)
    if len(distinct) == 1 and None not in of_font:
        width, point = distinct[0].width[code], distinct[0].point[code]
    else:
        width, point = np.zeros(total), np.zeros(total, np.int64)
        number = {t: i for i, t in enumerate(distinct)}
        font = np.array([-1 if t is None else number[t] for t in of_font])[row]
        for t, i in number.items():
            own = font == i
            width[own], point[own] = t.width[code[own]], t.point[code[own]]
    runs, kern, scale, tc, tw, tz = (m[:, i][row] for i in range(6))
    tx = (width * scale + tc + np.where(code == 32, tw, 0.0)) * tz + kern
    # advances so far in each run; a form stands between two parts of its caller's run
    ends = np.cumsum(tx)
    before = ends - tx
    head = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
    start = np.repeat(before[head], np.diff(np.append(head, total)))
    names = runs[head]
    if len(np.unique(names)) < len(names):
        spent, lead = {}, np.zeros(len(head))
        sums = np.add.reduceat(tx, head)
        for i, name in enumerate(names.tolist()):
            lead[i] = spent.get(name, 0.0)
            spent[name] = lead[i] + sums[i]
        start = start - np.repeat(lead, np.diff(np.append(head, total)))
    before = before - start
    before[np.flatnonzero(np.abs(before) < 1e-9)] = 0.0
    first = np.cumsum(counts) - counts
    at = np.arange(total) - first[row]
    keep = point != 0
    if not keep.all():
        row, at, code, point, tx, before = row[keep], at[keep], code[keep], point[keep], tx[keep], before[keep]
    # by string: matrices and sizes
    ta, tb, tc_, td, te, tf = m[:, 8:14].T
    ca, cb, cc, cd, ce, cf = m[:, 14:20].T
    lift = m[:, 7]
    vc, vd = tc_ * ca + td * cc, tc_ * cb + td * cd
    fs = m[:, 6]
    size = np.abs(fs * np.sqrt(vc * vc + vd * vd))
    size = np.where(size == 0, np.where(fs == 0, 1.0, np.abs(fs)), size)
    if (tb == 0).all() and (cb == 0).all() and (cc == 0).all():  # upright: y is one of each string
        e = before * ta[row] + (lift * tc_ + te)[row]
        out.x = e * ca[row] + ce[row]
        out.y = ((lift * td + tf) * cd + cf)[row]
    else:
        e = before * ta[row] + (lift * tc_)[row] + te[row]
        f = before * tb[row] + (lift * td)[row] + tf[row]
        out.x = e * ca[row] + f * cc[row] + ce[row]
        out.y = e * cb[row] + f * cd[row] + cf[row]
    out.size = size[row]
    out.adv_x = tx * (ta * ca + tb * cc)[row]
    out.adv_y = tx * (ta * cb + tb * cd)[row]
    out.row, out.at, out.code, out.point = row, at, code, point
    out.texts = None
    if (point < 0).any():
        tables = [of_font[i] for i in row.tolist()]
        out.texts = [t.text[c] for t, c in zip(tables, code.tolist())]
    return out


_NONE = np.zeros(1, np.uint8)


def rounded(x):
    """``x`` to two decimals as Python rounds: numpy's way, but for values too near to a tie to trust it."""
    out = np.round(x, 2)
    scaled = np.abs(x) * 100
    odd = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)
    if len(odd):
        out[odd] = [round(v, 2) for v in x[odd].tolist()]
    return out


def buckets(x, y, size, order, ratio=LINE_RATIO, least=LINE_MIN, page=None):
    """(line of each glyph, y of each line, page of each line): greedy from the top, over heads of runs of equal (y, size).

    A glyph joins the newest of the last ``RECENT`` lines whose anchor (its first glyph) is near enough, else opens one.
    page: number of each glyph's page, ascending, if there are several.
    """
    page = np.zeros(len(y), np.int64) if page is None else page
    down, turned = y[1:] - y[:-1], page[1:] != page[:-1]
    if len(y) < 2 or (turned | (down < 0) | ((down == 0) & (x[1:] >= x[:-1]))).all():
        by, ys, sizes = None, y, size
    else:
        by = np.lexsort((order, x, -y, page))
        ys, sizes = y[by], size[by]
    head = np.concatenate([[True], turned | (ys[1:] != ys[:-1]) | (sizes[1:] != sizes[:-1])])
    lines, anchors, pages, recent, last = [], [], [], [], -1
    for hp, hy, hs in zip(page[head].tolist(), ys[head].tolist(), sizes[head].tolist()):
        if hp != last:
            last, recent = hp, []
        for i, ly, ls in recent:
            if abs(ly - hy) <= max(least, ratio * max(ls, hs)):
                lines.append(i)
                break
        else:
            lines.append(len(anchors))
            recent = [(len(anchors), hy, hs), *recent[: RECENT - 1]]
            anchors.append(hy)
            pages.append(hp)
    found = np.array(lines)[np.cumsum(head) - 1]
    if by is not None:
        out = np.empty(len(by), np.int64)
        out[by] = found
        found = out
    return found, np.array(anchors), np.array(pages)


def _numbered(bucket, anchors, pages):
    """(place of each glyph's line, the lines in order): page by page, from the top down."""
    n = len(anchors)
    down = np.lexsort((np.arange(n), -anchors, pages))
    place_of = np.empty(n, np.int64)
    place_of[down] = np.arange(n)
    return place_of[bucket], down


def _painted_over(number, x, size, point, texts):
    """(glyphs that repeat the one kept before them, lines in which that takes a look at each glyph).

    Of glyphs that each repeat their neighbour the first is kept, if all of them are near to it and what follows them is not.
    """
    over = np.concatenate([[False], (number[1:] == number[:-1]) & (np.abs(x[1:] - x[:-1]) < 0.05) & (size[1:] == size[:-1])])
    at = np.flatnonzero(over)
    if not len(at):
        return over, ()
    if texts is None:
        over[at] = point[at] == point[at - 1]
    else:
        over[at] = [texts[i] == texts[i - 1] for i in at.tolist()]
    kept = np.maximum.accumulate(np.where(over, 0, np.arange(len(x))))
    odd = over & (np.abs(x - x[kept]) >= 0.05)
    after = np.flatnonzero(over[:-1] & ~over[1:]) + 1
    first = kept[after - 1]
    near = (number[after] == number[first]) & (np.abs(x[after] - x[first]) < 0.05) & (size[after] == size[first])
    for i, k in zip(after[near].tolist(), first[near].tolist()):
        odd[i] = point[i] == point[k] if texts is None else texts[i] == texts[k]
    return over, np.unique(number[odd]).tolist()


def _exact(texts, x, size, adv, space_ratio, space_min):
    """A line in which something is painted over: each glyph against the one kept before it."""
    parts, last = [], None
    for s, gx, gs, ga in zip(texts, x, size, adv):
        if last:
            t, lx, ls, la = last
            if abs(gx - lx) < 0.05 and s == t and gs == ls:
                continue
            wide = abs(la) if abs(la) > 0.01 else max(0.5, ls / 2)
            if gx - (lx + wide) > max(space_min, space_ratio * max(ls, gs)):
                parts.append(" ")
        parts.append(s)
        last = s, gx, gs, ga
    return "".join(parts).rstrip()


class Lines:
    """Columns over lines, page by page, from the top down."""

    __slots__ = ("page", "y", "x", "end_x", "size", "fonts", "n_chars", "text")

    def __len__(self):
        return len(self.y)


def lines_of(texts, point, x, y, size, adv, order, font, names, line_ratio=LINE_RATIO, line_min=LINE_MIN, space_ratio=SPACE_RATIO, space_min=SPACE_MIN, page=None):
    """Lines of one page's glyphs, or of several pages'.

    texts: a text for each, or None where ``point`` has the code points; font: number of each glyph's name in ``names``;
    page: ascending number of each glyph's page.
    """
    out = Lines()
    bucket, anchors, pages = buckets(x, y, size, order, line_ratio, line_min, page)
    n = len(anchors)
    number, down = _numbered(bucket, anchors, pages)
    near = rounded(x)
    step = number[1:] - number[:-1]
    ahead = (step > 0) | ((step == 0) & ((near[1:] > near[:-1]) | ((near[1:] == near[:-1]) & (order[1:] > order[:-1]))))
    if not ahead.all():
        by = np.lexsort((order, near, number))
        number, x, size, adv, font = number[by], x[by], size[by], adv[by], font[by]
        if texts is None:
            point = point[by]
        else:
            texts = [texts[i] for i in by.tolist()]
    cut = np.searchsorted(number, np.arange(n + 1))
    over, odd = _painted_over(number, x, size, point, texts)
    # what is shown: without what is painted over
    own, kx, ks, ka, kpoint, ktexts, shown_cut = number, x, size, adv, point, texts, cut
    if over.any():
        keep = np.flatnonzero(~over)
        own, kx, ks, ka = number[keep], x[keep], size[keep], adv[keep]
        kpoint, ktexts = (point[keep], None) if texts is None else (None, [texts[i] for i in keep.tolist()])
        shown_cut = np.searchsorted(own, np.arange(n + 1))
    px, ps, pa = kx[:-1], ks[:-1], np.abs(ka[:-1])
    wide = np.where(pa > 0.01, pa, np.maximum(0.5, ps / 2))
    gap = (own[1:] == own[:-1]) & (kx[1:] - (px + wide) > np.maximum(space_min, space_ratio * np.maximum(ps, ks[1:])))
    gaps = np.flatnonzero(gap) + 1
    if ktexts is None:
        whole = np.insert(kpoint, gaps, 32) if len(gaps) else kpoint
        shown = whole.astype("<u4").tobytes().decode("utf-32-le")
        at = (shown_cut + np.searchsorted(gaps, shown_cut)).tolist()
        out.text = [shown[a:b].rstrip() for a, b in zip(at, at[1:])]
    else:
        shown = list(ktexts)
        for i in gaps.tolist():
            shown[i] = " " + shown[i]
        at = shown_cut.tolist()
        out.text = ["".join(shown[a:b]).rstrip() for a, b in zip(at, at[1:])]
    for k in odd:
        a, b = int(cut[k]), int(cut[k + 1])
        each = texts[a:b] if texts is not None else list(point[a:b].astype("<u4").tobytes().decode("utf-32-le"))
        out.text[k] = _exact(each, x[a:b].tolist(), size[a:b].tolist(), adv[a:b].tolist(), space_ratio, space_min)
    begin = cut[:-1]
    out.page, out.y = pages[down], anchors[down]
    out.x = np.minimum.reduceat(x, begin)
    out.end_x = np.maximum.reduceat(x + adv, begin)
    out.n_chars = np.diff(cut)
    if (size[1:] == size[:-1]).all():
        out.size = size[begin]
    else:  # the upper median
        out.size = size[np.lexsort((size, number))][begin + out.n_chars // 2]
    if len(names) == 1:
        out.fonts = [[name for name in names if name is not None]] * n
    else:
        out.fonts = [sorted({names[i] for i in np.unique(font[a:b]).tolist()} - {None}) for a, b in zip(cut.tolist(), cut[1:].tolist())]
    return out


def layouts_of(texts, point, x, y, size, adv, order, line_ratio=LINE_RATIO, line_min=LINE_MIN, page=None):
    """(numbers of the pages, their layouts): every line on a grid of character cells half as wide as the page's median size.

    Glyphs, from the top and left of each line on, are set at the cell of their x, or the next free one; a glyph takes as
    many cells as its advance covers.
    """
    page = np.zeros(len(x), np.int64) if page is None else page
    bucket, anchors, pages = buckets(x, y, size, order, line_ratio, line_min, page)
    number, _ = _numbered(bucket, anchors, pages)
    first = np.flatnonzero(np.concatenate([[True], page[1:] != page[:-1]]))
    count = np.diff(np.append(first, len(page)))
    if (size[1:] == size[:-1]).all():
        middle = size[first]
    else:
        middle = size[np.lexsort((size, page))][first + count // 2]
    unit = np.repeat(np.maximum(1.0, middle * 0.5), count)
    cell = np.rint((x - np.repeat(np.minimum.reduceat(x, first), count)) / unit).astype(np.int64)
    span = np.maximum(1, np.rint(np.abs(adv) / unit).astype(np.int64))
    step, down = number[1:] - number[:-1], y[1:] - y[:-1]
    if not ((step > 0) | ((step == 0) & ((down < 0) | ((down == 0) & ((x[1:] > x[:-1]) | ((x[1:] == x[:-1]) & (order[1:] > order[:-1]))))))).all():
        by = np.lexsort((order, x, -y, number))
        number, cell, span = number[by], cell[by], span[by]
        if texts is None:
            point = point[by]
        else:
            texts = [texts[i] for i in by.tolist()]
    n = len(anchors)
    cut = np.searchsorted(number, np.arange(n + 1))
    begin = cut[:-1]
    # each starts at its cell or where the one before ends: the largest of what lies before, less the spans up to there
    ends = np.cumsum(span)
    before = ends - span
    before -= np.repeat(before[begin], np.diff(cut))
    free = cell - before
    lift = number * (int(free.max()) - int(free.min()) + 1)
    start = np.maximum.accumulate(free + lift) - lift + before
    pad = start.copy()
    pad[1:] -= np.where(number[1:] == number[:-1], start[:-1] + span[:-1], 0)
    if texts is None:
        place = np.cumsum(pad + 1) - 1
        whole = np.full(int(place[-1]) + 1, 32, "<u4")
        whole[place] = point
        shown = whole.tobytes().decode("utf-32-le")
        at = np.append(0, place + 1)[cut].tolist()
        rows = [shown[a:b].rstrip() for a, b in zip(at, at[1:])]
    else:
        shown = [" " * k + t for k, t in zip(pad.tolist(), texts)]
        at = cut.tolist()
        rows = ["".join(shown[a:b]).rstrip() for a, b in zip(at, at[1:])]
    numbers = page[first]
    ranges = np.searchsorted(np.sort(pages), np.append(numbers, numbers[-1] + 1)).tolist()
    return numbers, ["\n".join(rows[a:b]) for a, b in zip(ranges, ranges[1:])]


def page_lines(glyphs: Glyphs, options):
    """Lines of a page's placed glyphs; None without any."""
    if not len(glyphs):
        return None
    number, of_show = {}, []
    for show in glyphs.shows:
        of_show.append(number.setdefault(plain(show[4]), len(number)))
    return lines_of(glyphs.texts, glyphs.point, glyphs.x, glyphs.y, glyphs.size, glyphs.adv_x, _order(glyphs), np.array(of_show)[glyphs.row], list(number), **options)


def page_layout(glyphs: Glyphs, options):
    """Layout of one page's placed glyphs; None without any."""
    if not len(glyphs):
        return None
    options = {k: v for k, v in options.items() if k.startswith("line_")}
    return layouts_of(glyphs.texts, glyphs.point, glyphs.x, glyphs.y, glyphs.size, glyphs.adv_x, _order(glyphs), **options)[1][0]


def _order(glyphs):
    return glyphs.row * (1 << 31) + glyphs.at
