"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is read as a stream of tokens (start tags with their class and id, end
tags, text).  A wrapper is a sequence of nodes: a tag, a text slot, and groups
of nodes that are optional or repeat.  It starts as the first page's own
expression, in which neighbouring equal runs are folded into repeated groups, and
is aligned with further pages of the host one after the other.  Where they
agree nothing changes; where two texts differ the node becomes a slot; where tags
differ the nearest place at which both go on alike is searched, and what is left
out on either side becomes an optional group, or joins a repeated group whose body
it is.  Pages of a host with other containers are another kind and get another
wrapper.  All pages of a kind are aligned: each task aligns those that it reads, and
the tasks' wrappers are aligned with each other.  Where a level has more than
``WIDEST`` nodes it becomes one slot for whatever stands there.

Every page is matched against the wrapper of its kind (if the kind has at least
``CONTENTS`` pages with different longest blocks).  What is in slots, optional and
repeated groups is data; a block element that has the same text on all pages of a
kind is template and left out, inside of articles, too.  Texts carry their share of
the page's letters outside of links, added up over all pages of the kind.  From the
body down, the container with ``MOST`` of the shares of data is followed as long as
no paragraph, heading or larger text stands beside it, and an article if there is
one: what matches the container reached, the main field, is where a page's text is.

A region, a block element down to three levels below the page body, is boilerplate
if its tag or its class and id words say so (navigation, header, footer, aside,
form, advert, notice, comments ...; never the body or main, nor a form or hinted
element that holds most of the page's text), if a region of its path has the same
text on most of the host's pages that have the path, or, outside of article and main
elements, if most of its own text is links.  The text is what is left in the main
field; on pages that no wrapper fits, or that lack the field, in the article or main
elements, if there are any.

The regions of all pages are counted, by host, path and text.  Pages with the same
longest block outside of a region, such as near copies of one article, count once
for it; a region with most of a page's text is what the page is about and does not
count.  What is found for the hosts is a table; it is broadcast if it has at most
``MAX_BROADCAST`` bytes and joined by host otherwise.

Defined results: null and empty html give an empty text; a page without host or
one that no wrapper of its host fits is extracted by the rules above on its own;
repeated rows, null ids and null urls pass through.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, trimmed

MAX_BROADCAST = 32_000_000
#: nodes beside each other in a wrapper, and contents of a kind that are told apart
WIDEST = 80
CONTENTS = 3
#: share of the data around it that the main field has, and what a page's letters are divided by
MOST = 0.75
SHARES = 1_000_000
#: levels of elements; deeper ones stand beside each other, as in browsers
DEEPEST = 200

# Names from the HTML standard and usual class names (fixed values).
CONTAINERS = ("html", "body", "main", "article", "section", "div")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe svg math canvas object select option button".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
DROPPED = frozenset("nav footer aside form head script style noscript template svg button select option textarea iframe dialog menu canvas object math label input".split())
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
CLOSES_P = BLOCK - {"br", "body", "html"}
PAGE = ("html", "body", "main")
HINTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar side menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer foot copyright comment comments reply replies disqus discussion share sharing social related recommended recommendations widget login search skip hidden".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


# ---------------------------------------------------------------- page tree


class Node:
    """An element: its tag, the key by which pages are aligned, and children (nodes and texts)."""

    __slots__ = ("tag", "key", "children", "hint", "hidden", "letters")

    def __init__(self, tag, key, hint=False, hidden=False):
        self.tag, self.key, self.hint, self.hidden = tag, key, hint, hidden
        self.children = []
        self.letters = 0  # of text that is neither in links nor in dropped elements


def parse(html):
    """The page's tree; unclosed and stray tags are put right as browsers do for paragraphs, list items and cells."""
    root = Node("#root", "#root")
    stack = [root]
    at, n = 0, len(html)
    while at < n:
        m = TOKEN.match(html, at)
        if m is None:
            break
        at = m.end()
        if m[4] is not None:
            stack[-1].children.append(m[4])
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body", "table") and tag not in BLOCK:
                    break
            continue
        if tag in CLOSES_P:  # a block ends an open paragraph, and what is open in it
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            ends = {"li": ("li",), "tr": ("tr", "td", "th"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(tag, ("td", "th"))
            stop = ("ul", "ol", "dl", "table", "tbody", "thead", "select", "#root", *(("tr",) if tag in ("td", "th") else ()))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stop:
                    break
                if stack[i].tag in ends:
                    del stack[i:]
                    break
        names, hidden = "", False
        for a in ATTRIBUTE.finditer(m[3]) if m[3] else ():
            name = a[1].lower()
            value = (a[2] or "").strip("\"'")
            if name in ("class", "id", "role"):
                names += " " + value
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
        words = {w.lower() for w in NAME_PARTS.findall(names)} if names else ()
        node = Node(tag, tag + ("." + ".".join(sorted(words)) if words else ""), bool(words) and not HINTS.isdisjoint(words), hidden)
        stack[-1].children.append(node)
        if tag in RAW:  # its content is text up to its end tag
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(html, at) if not m[0].endswith("/>") else None
            if end or not m[0].endswith("/>"):
                stop = end.start() if end else n
                node.children.append(html[at:stop])
                at = end.end() if end else n
            continue
        if tag not in VOID and len(stack) < DEEPEST:  # browsers take no notice of "/>" elsewhere
            stack.append(node)
    weigh(root)
    most(root, root.letters / 2)
    return root


def weigh(node):
    """Sets the ``letters`` of an element and of those in it; hidden and dropped ones, but for forms, count none."""
    for c in node.children:
        if isinstance(c, str):
            node.letters += len(c) - c.count(" ") - c.count("\n")
        elif c.tag not in RAW:
            weigh(c)
            if c.tag != "a" and (c.tag == "form" or c.tag in PAGE or c.tag not in DROPPED and not c.hidden):
                node.letters += c.letters


def most(node, half):
    """Takes the hints off elements that hold the page: its body and main, and what has more than ``half`` of its letters."""
    for c in node.children:
        if isinstance(c, Node):
            if c.tag in PAGE:
                c.hint = c.hidden = False
            elif c.letters > half:
                c.hint = False
                if c.tag == "form":
                    c.tag = "div"
            most(c, half)


def boilerplate(node):
    return node.tag in DROPPED or node.hint or node.hidden


def find(node, tags):
    """The outermost elements of the given tags that are not in boilerplate."""
    out = []
    for c in node.children:
        if isinstance(c, Node):
            if c.tag in tags and not (c.hint or c.hidden):
                out.append(c)
            elif not boilerplate(c):
                out += find(c, tags)
    return out


def main_elements(tree):
    """The elements whose text is the page's: its articles, or its main elements if these hold more than twice their text."""
    articles, mains = find(tree, ("article",)), find(tree, ("main",))
    return mains if sum(m.letters for m in mains) > 2 * sum(a.letters for a in articles) else articles or mains


# ---------------------------------------------------------------- wrapper inference

# Wrapper nodes, as JSON lists: ["t", key, nodes] element, ["=", text, share] constant text, ["#", share] text slot,
# ["?", nodes] optional group, ["+", nodes] repeated group, ["*", share] anything.


def stream(node, depth=40, of=None, linked=False):
    """Token stream of a tree as wrapper nodes; texts are constants to begin with, and neighbouring repeats are folded.

    A text's share is that of the page's ``of`` letters outside of links.
    """
    out = []
    of = of or max(1, node.letters)
    for c in node.children:
        if isinstance(c, str):
            text = " ".join(c.split())
            if text:
                out.append(["=", hashlib.md5(text.encode()).hexdigest()[:16], 0 if linked else (len(text) - text.count(" ")) * SHARES // of])
        elif not boilerplate(c):
            inner = stream(c, depth - 1, of, linked or c.tag == "a") if depth and c.tag not in RAW and c.tag not in VOID else []
            out.append(["t", c.key, inner])
    return wide(fold(out))


def wide(nodes):
    """Free content, with more than ``WIDEST`` nodes beside each other, becomes one slot for whatever stands there."""
    return [["*", share(nodes)]] if len(nodes) > WIDEST else nodes


def free(nodes):
    return len(nodes) == 1 and nodes[0][0] == "*"


def share(nodes):
    """What the texts in the nodes hold of their pages' letters, in all."""
    return sum(n[-1] if n[0] in "=#*" else share(n[-1]) for n in nodes)


def data(nodes):
    """The same of texts that are not the same on all pages."""
    return sum(0 if n[0] == "=" else n[1] if n[0] in "#*" else share(n[1]) if n[0] == "?" else data(n[-1]) for n in nodes)


def fold(nodes):
    """Neighbouring runs of the same tags become one repeated group, whose body is aligned over all of them."""
    out = []
    for n in nodes:
        if out and n[0] == "t":
            last = out[-1]
            if last[0] == "t" and last[1] == n[1]:
                out[-1] = ["+", [merge_tag(last, n)]]
                continue
            if last[0] == "+" and len(last[1]) == 1 and last[1][0][1] == n[1]:
                last[1][0] = merge_tag(last[1][0], n)
                continue
        out.append(n)
    return out


def merge_tag(a, b):
    return ["t", a[1], align(a[2], b[2])]


def head(n):
    """What a node begins with, by which both sides find back to each other."""
    if n[0] == "*":
        return "*"
    if n[0] in "=#":
        return "#"
    return n[1] if n[0] == "t" else head(n[1][0])


def align(w, s):
    """The wrapper ``w`` made general enough to cover the stream ``s``, too."""
    if free(w) or free(s):
        return [["*", share(w) + share(s)]]
    out, i, j = [], 0, 0
    while i < len(w) and j < len(s):
        a, b = w[i], s[j]
        if head(a) == head(b):
            out.append(together(a, b))
            i, j = i + 1, j + 1
            continue
        # a mismatch: go on where both meet again with the least left out, the rest is optional
        best = None
        places = {}
        for y in range(j, min(len(s), j + 60)):
            places.setdefault(head(s[y]), y)
        for x in range(i, min(len(w), i + 60)):
            y = places.get(head(w[x]))
            if y is not None and (best is None or x - i + y - j < best[0]):
                best = (x - i + y - j, x, y)
        x, y = (best[1], best[2]) if best else (len(w), len(s))
        out += optional(w[i:x]) + optional(s[j:y])
        i, j = x, y
    return wide(fold_groups(out + optional(w[i:]) + optional(s[j:])))


def optional(nodes):
    return [n if n[0] == "?" else ["?", [n]] for n in nodes]


def together(a, b):
    """One node that covers both; their heads are equal."""
    if a[0] in "=#" and b[0] in "=#":
        return ["=", a[1], a[2] + b[2]] if a[0] == b[0] == "=" and a[1] == b[1] else ["#", a[-1] + b[-1]]
    if "?" in (a[0], b[0]):
        x, y = (n[1][0] if n[0] == "?" else n for n in (a, b))
        return ["?", [together(x, y)]]
    if "+" in (a[0], b[0]):
        x, y = (n[1][0] if n[0] == "+" else n for n in (a, b))
        return ["+", [together(x, y)]]
    return merge_tag(a, b)


def fold_groups(nodes):
    """An optional next to a group or tag of the same head joins it as a repetition."""
    out = []
    for n in nodes:
        if out and head(out[-1]) == head(n) != "#":
            a, b = out[-1], n
            x, y = ((m[1][0] if m[0] == "?" else m) for m in (a, b))
            both = ["+", [together(x[1][0] if x[0] == "+" else x, y[1][0] if y[0] == "+" else y)]]
            out[-1] = ["?", [both]] if a[0] == b[0] == "?" else both
        elif out and head(out[-1]) == head(n) == "#":
            slot = ["#", share([out[-1], n])]
            out[-1] = ["?", [slot]] if out[-1][0] == n[0] == "?" else slot
        else:
            out.append(n)
    return out


def fits(w, s):
    """Whether the wrapper covers the stream."""
    if free(w):
        return True
    i = 0
    for n in s:
        while i < len(w) and head(w[i]) != head(n):
            if w[i][0] != "?":
                return False
            i += 1
        if i == len(w):
            return False
        a = w[i][1][0] if w[i][0] == "?" else w[i]
        b = n
        if b[0] == "+" and a[0] != "+":
            return False
        a, b = (m[1][0] if m[0] == "+" else m for m in (a, b))
        if a[0] == "=" and a[:2] != b[:2]:
            return False
        if a[0] == "t" and not fits(a[2], b[2]):
            return False
        i += 1
    return all(n[0] == "?" for n in w[i:])


def kind_of(tree):
    """The kind of a page: its containers down to two levels below the body.  Pages of other containers are not aligned."""
    out = set()

    def walk(node, path, depth):
        for c in node.children:
            if isinstance(c, Node) and c.tag in CONTAINERS and not boilerplate(c):
                own = f"{path}/{c.key}"
                out.add(own)
                if depth < 1 and c.tag != "article" or c.tag in PAGE:
                    walk(c, own, depth + (c.tag not in PAGE))

    walk(tree, "", 0)
    return digest("\n".join(sorted(out)))


def merged(a, b):
    """The wrapper of two parts of a kind's pages: (nodes, longest blocks of up to ``CONTENTS`` different pages)."""
    return (align(a[0], b[0]), sorted({*a[1], *b[1]})[:CONTENTS]) if a else b


def fixed(nodes):
    """Whether the nodes are the same text on all pages."""
    return all(n[0] == "=" or n[0] in "t+" and fixed(n[-1]) for n in nodes)


def main_field(w):
    """The wrapper's node that holds the text of its pages, None if that is all of it."""
    found, nodes = None, w
    while True:
        rooms, beside, whole = [], [], data(nodes)
        for n in nodes:
            own = n[1][0] if n[0] == "?" else n
            repeated = own[0] == "+"
            own = own[1][0] if repeated else own
            tag = own[1].split(".")[0] if own[0] == "t" else ""
            (rooms if tag in CONTAINERS else beside).append((data([n]), tag, own, repeated))
        if not rooms or not whole:
            return found
        best = max(rooms, key=lambda r: r[0])
        best = max((r for r in rooms if r[1] == "article" and 4 * r[0] >= best[0]), key=lambda r: r[0], default=best)
        n, tag, own, repeated = best
        if tag not in ("html", "body", "article") and (n < MOST * whole or any(x > (0 if t in TEXTS else 0.02 * whole) for x, t, *_ in beside)):
            return found
        found, nodes = own, own[2]
        if repeated or tag == "article":
            return found


def slot_texts(w, node, template, main=None, fields=None):
    """Matches a page with its wrapper; elements that are the same on all pages go into ``template``, the rest are slots and groups.

    Elements that match the node ``main`` go into ``fields``.  False if the page does not match.
    """
    if free(w):
        return True
    i, last = 0, None
    for c in node.children:
        if isinstance(c, str):
            text = " ".join(c.split())
            if not text:
                continue
            own = "#"
        elif boilerplate(c):
            continue
        else:
            own = c.key
        if last is None or last[0] != "+" or head(last) != own:
            while i < len(w) and head(w[i]) != own:
                if w[i][0] != "?":
                    return False
                i += 1
            if i == len(w):
                return False
            always = w[i][0] != "?"
            last = w[i] if always else w[i][1][0]
            i += 1
        a = last[1][0] if last[0] == "+" else last
        if own == "#":
            if a[0] == "=" and a[1] != hashlib.md5(text.encode()).hexdigest()[:16]:
                return False
        else:
            if a is main:
                fields.append(c)
            below = template if always else set()
            if a[2] and not slot_texts(a[2], c, below, main, fields):
                return False
            if always and c.tag in BLOCK and fixed(a[2]):
                template.add(id(c))
    return all(n[0] == "?" for n in w[i:])


# ---------------------------------------------------------------- what a host's pages say of their regions


def laid_out(tree):
    """The texts of a tree's blocks in page order, and (path, node, first, end) of its block elements: the blocks in each.

    The path is None for elements more than three levels below the body, which are not judged.
    """
    out, spans, open_ = [], [], []

    def close():
        text = " ".join(_html.unescape("".join(open_)).split())
        open_.clear()
        if text:
            out.append(text)

    def walk(node, path, depth):
        for c in node.children:
            if isinstance(c, str):
                open_.append(c)
            elif boilerplate(c):
                close()
            elif c.tag in RAW:
                continue
            elif c.tag in BLOCK:
                close()
                own = f"{path}/{c.key}" if depth < 4 else None
                at, first = len(spans), len(out)
                spans.append(None)
                walk(c, own, depth + (c.tag not in ("html", "body")))
                close()
                spans[at] = (own, c, first, len(out))
            else:
                walk(c, path if depth >= 4 else f"{path}/{c.key}", depth)

    walk(tree, "", 0)
    close()
    return out, spans


def link_share(node):
    """(letters of text, letters of text in links)."""
    total = linked = 0
    for c in node.children:
        if isinstance(c, str):
            total += len(c)
        elif c.tag not in RAW:
            n, k = link_share(c)
            total, linked = total + n, linked + (n if c.tag == "a" else k)
    return total, linked


def digest(text):
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "little", signed=True)


def region_key(path, texts):
    """Number of a region: its path and its text."""
    return digest(path + "\n" + "\n".join(texts))


def sightings(tree):
    """({(path, region, content)}, content): a page's regions, each with the page's longest block outside of it, and the longest of all.

    The longest block stands for what the page is about: pages that share it, such as near copies, count as one.
    A region with most of the page's text is what the page is about, and is not counted.
    """
    out, spans = laid_out(tree)
    if not out:
        return set(), 0
    long = sorted(range(len(out)), key=lambda i: (-len(out[i]), i))
    half = sum(map(len, out)) / 2
    found, digests = set(), {}

    def content(i):
        if i not in digests:
            digests[i] = digest(out[i])
        return digests[i]

    for path, node, first, end in spans:
        if path is not None and first < end and node.tag not in PAGE and sum(map(len, out[first:end])) <= half:
            found.add((digest(path), region_key(path, out[first:end]), content(next(i for i in long if not first <= i < end))))
    return found, content(long[0])


def is_constant(n, of):
    """Whether a text that ``n`` different pages have, of ``of`` with a region of its path, is boilerplate."""
    return (n >= 3) & (n > 0.6 * of)


def constants(trees):
    """Numbers of the regions that are the same on most of the given pages, as the host's table of all pages has them."""
    seen, pages = {}, {}
    for t in trees:
        found, page = sightings(t)
        for path, region, content in found:
            seen.setdefault((path, region), set()).add(content)
            pages.setdefault(path, set()).add(page)
    return sorted(r for (p, r), c in seen.items() if is_constant(len(c), len(pages[p])))


def learn(pages):
    """What pages of one host say: [{"kind", "wrapper", "contents", "skip"}], a wrapper for each kind of page; ``skip`` is the host's."""
    trees = [parse(p) for p in pages]
    kinds = {}
    for t in trees:
        kind = kind_of(t)
        kinds[kind] = merged(kinds.get(kind), (stream(t), [sightings(t)[1]]))
    skip = constants(trees)
    return [{"kind": k, "wrapper": w, "main": main_field(w), "contents": len(c), "skip": skip} for k, (w, c) in kinds.items()]


def extract(html, wrappers=None):
    """Main text of a page: blocks joined by line breaks."""
    if not html:
        return ""
    tree = parse(html)
    skip = frozenset(wrappers[0]["skip"]) if wrappers else ()
    template, fields = set(), []
    kind = kind_of(tree) if wrappers else None
    for w in wrappers or ():
        # what pages of fewer contents have in common may be the content
        if w["kind"] == kind and w["contents"] >= CONTENTS and not slot_texts(w["wrapper"], tree, template, w["main"], fields):
            template.clear()  # of another kind, which has no wrapper
            fields.clear()
    out, spans = laid_out(tree)
    half = sum(map(len, out)) / 2
    fields = fields or main_elements(tree)
    articles = any(f.tag in ("article", "main") for f in fields)
    fields = {id(f) for f in fields}
    stay = [not fields] * len(out)
    for _, node, first, end in spans:
        if id(node) in fields:
            stay[first:end] = [True] * (end - first)
    for path, node, first, end in spans:
        if path is None or first == end or node.tag in PAGE:
            continue
        # of elements that share a path only those are left out that are boilerplate themselves
        constant = skip and region_key(path, out[first:end]) in skip or id(node) in template and sum(map(len, out[first:end])) <= half
        if not constant and not articles:
            n, k = link_share(node)
            constant = k > 0.6 * max(1, n)
        if constant:
            stay[first:end] = [False] * (end - first)
    return "\n".join(x for x, s in zip(out, stay) if s)


# ---------------------------------------------------------------- Spark

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def read_pages(pages: DataFrame) -> DataFrame:
    """One row (host, path, region, content, page) for each of ``sightings`` of every page with a host, and rows (host, kind,
    wrapper, contents) for the wrappers of the pages that a task has read."""

    def read(batches):
        parts, contents = {}, {}

        def flush():
            rows = [(h, k, json.dumps(w), c) for (h, k), (w, c) in parts.items()]
            parts.clear()
            for i in range(0, len(rows), 200):
                h, k, w, c = zip(*rows[i : i + 200])
                none = pa.nulls(len(h), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(h), none, none, none, none, pa.array(k, pa.int64()), pa.array(w), pa.array(c, pa.list_(pa.int64()))], names=names)

        for batch in batches:
            rows = set()
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                tree = parse(html)
                found, page = sightings(tree)
                rows.update((host, *f, page) for f in found)
                key = host, kind_of(tree)
                parts[key] = merged(parts.get(key), (stream(tree), [page]))
            if rows:
                h, *numbers = zip(*rows)
                none = pa.nulls(len(h))
                yield pa.RecordBatch.from_arrays([pa.array(h), *(pa.array(x, pa.int64()) for x in numbers), none.cast(pa.int64()), none.cast(pa.string()), none.cast(pa.list_(pa.int64()))], names=names)
            if len(parts) > 2000:
                yield from flush()
        yield from flush()

    schema = "host string, path long, region long, content long, page long, kind long, wrapper string, contents array<long>"
    names = [c.split()[0] for c in schema.split(", ")]
    own = pages.select(host_of(F.col("url")).alias("host"), "html").where("host <> '' AND html <> ''")
    return own.mapInArrow(trimmed(read), schema)


def learn_wrappers(pages: DataFrame) -> DataFrame:
    """(host, skip, kinds): the regions that are the same on most of a host's pages, and the wrapper of each kind of its
    pages that has at least ``CONTENTS`` contents; both from all pages."""
    seen = stored(read_pages(pages), "regions")
    # a text counts once for each content; every step is dealt by more than the host
    regions = seen.where("kind IS NULL")
    texts = regions.select("host", "path", "region", "content").distinct().groupBy("host", "path", "region").agg(F.count("*").alias("n")).where("n >= 3")
    paths = regions.select("host", "path", "page").distinct().groupBy("host", "path").agg(F.count("*").alias("of"))
    skip = texts.join(paths, ["host", "path"]).where(is_constant(F.col("n"), F.col("of"))).groupBy("host").agg(F.array_sort(F.collect_set("region")).alias("skip"))

    def merge(key, table):
        # a task's wrappers of a kind: as many rows as tasks
        whole = None
        for w, c in sorted(zip(table.column("wrapper").to_pylist(), table.column("contents").to_pylist())):
            whole = merged(whole, (json.loads(w), c))
        few = len(whole[1]) < CONTENTS
        return pa.table({"host": pa.array([] if few else [key[0].as_py()], pa.string()), "kind": pa.array([] if few else [key[1].as_py()], pa.int64()), "wrapper": pa.array([] if few else [json.dumps(whole[0])], pa.string())})

    kinds = seen.where("kind IS NOT NULL").select("host", "kind", "wrapper", "contents").groupBy("host", "kind").applyInArrow(merge, "host string, kind long, wrapper string")
    kinds = kinds.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("kind", "wrapper"))).alias("kinds"))
    return skip.join(kinds, "host", "full")


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text``, the main text of ``html`` by the wrappers of the url's host; ``html`` is not kept."""
    wrappers = learn_wrappers(pages)
    wrappers = stored(wrappers.select("host", F.to_json(F.struct("skip", "kinds")).alias("wrappers")), "wrappers")
    size = wrappers.select(F.sum(F.length("wrappers"))).first()[0] or 0
    keep = [c for c in pages.columns if c not in ("html", "text")]
    joined = pages.select(*keep, "html", host_of(F.col("url")).alias("__host")).join(
        (F.broadcast(wrappers) if size <= MAX_BROADCAST else wrappers).withColumnsRenamed({"host": "__host", "wrappers": "__wrappers"}), "__host", "left"
    )
    schema = joined.select(*keep).schema.add("text", "string")

    def run(batches):
        known = {}
        for batch in batches:
            texts = []
            for html, raw in zip(batch.column("html"), batch.column("__wrappers")):
                raw = raw.as_py()
                if raw is not None and raw not in known:
                    if len(known) > 200:
                        known.clear()
                    known[raw] = read_wrappers(raw)
                texts.append(extract(html.as_py(), known.get(raw)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return joined.mapInArrow(trimmed(run), schema)


def read_wrappers(raw):
    """What ``learn`` gives, from a host's row of the table."""
    host = json.loads(raw)
    skip = frozenset(host.get("skip", ()))
    known = [{"kind": k["kind"], "wrapper": w, "main": main_field(w), "contents": CONTENTS, "skip": skip} for k in host.get("kinds", ()) for w in [json.loads(k["wrapper"])]]
    return known or [{"kind": None, "wrapper": [], "main": None, "contents": 0, "skip": skip}]


def main_texts(pages: DataFrame) -> DataFrame:
    """The contract's columns: page_id, url, text, n_chars."""
    out = extract_pages(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
