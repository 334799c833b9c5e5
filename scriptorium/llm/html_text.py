"""Main text of web pages by wrapper induction over pages of one host.

1. Every page is parsed once into a tree of its block elements and the text blocks in them. A node keeps
   its tag and class, a hash of the text that stands directly in it, its characters, those of them in
   links, and what its tag and names say of it. Trees and blocks go to the shared folder.
2. The pages of a host are told apart by layout, a hash of the elements down to a small depth, and each
   of a host's ``layouts`` commonest layouts gets a reference page, that with the smallest hash (pages
   without text are no reference). Every page is aligned by simple tree matching (equal roots; children
   matched in order for the most matched nodes; among equals, for equal text) with the reference of its
   own layout, or else with that of its host's which it matches best. Counts over all aligned pages are
   kept for each node of a reference: pages that have text there, pages that have the same text there,
   characters, characters in links. A page whose text is mostly that of the reference says nothing about
   what is constant and is left out of those two counts, so copies of an article don't make it template.
3. The wrapper of a reference follows from the counts. Nodes with the same text on ``constant`` of at least
   ``least`` pages are template; nodes whose text is mostly links, and lists of such, are navigation; what
   varies is slots. The main region is the smallest element that holds ``share`` of the characters of all
   slots. Elements that say they are the article or the main part are the region instead if most of the
   slots' characters are in them, or if there are fewer than ``least`` pages to learn from; in them a
   prose element is template only if it is the same on nearly all of many pages.
4. A page's text is that of its nodes that match slots in the region, and of its nodes without a match
   that lie under a matched element of the region; headings of the first rank that vary stay wherever they
   stand. What tags and names call a menu, header, footer, sidebar, notice, advert, form or comment section
   is left out (``names=False`` leaves these names aside, and everything to the wrapper).

Wrappers and references are a few per host. They are broadcast where their bytes are at most
``max_broadcast``; beyond, pages and wrappers are joined by host and salt, and a host has as many salts
(copies of its wrappers) as it has thousands of pages, so a hot host is spread evenly.

Text: character references decoded, white space inside a block (``br`` too) one space, trimmed, blocks
joined by a newline in page order. A null page is empty and has the text "". Rows that repeat an
identifier each keep their own text. Null addresses count as one host. Pages of any length and depth are
parsed in one pass; a tag that the page ends in is dropped with what follows it, as browsers do. Aligning
takes time with the product of two elements' numbers of children, less those equal at both ends. Ties in
layouts go by their hash. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, remove, ship, text_of

#: A comment, a tag, or another declaration, each up to the end of the page if nothing ends it.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|(?!["'])))*+)(?:>|\Z)|<[!/?][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template xmp svg math object canvas audio video".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split())
#: Open elements that a start tag ends, up to an element that holds such.
ENDS = {
    **dict.fromkeys(["li"], (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"]))),
    **dict.fromkeys(["dt", "dd"], (frozenset(["dt", "dd"]), frozenset(["dl"]))),
    **dict.fromkeys(["td", "th"], (frozenset(["td", "th"]), frozenset(["tr", "table"]))),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    **dict.fromkeys(["tbody", "thead", "tfoot"], (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"]))),
    **dict.fromkeys(["option", "optgroup"], (frozenset(["option"]), frozenset(["select"]))),
    "body": (frozenset(["head"]), frozenset()),
}
OUT_TAGS = frozenset("nav aside footer form head button select dialog menu fieldset".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form note".split())
MAIN_NAMES = frozenset("articlebody main".split())
#: Names in ``class`` and ``id`` that mark what is not the article.
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner billboard breadcrumb breadcrumbs carousel comment comments commentlist "
    "consent cookie cookies copyright disclaimer disqus feedback footer gdpr header login masthead menu menus modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination paywall popup promo promotion promoted recommended related replies reply "
    "respond search share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
#: Bits of a node: what its tag and names say, and whether it is a heading of the first rank or prose.
OUT, MAIN, TITLE, IS_PROSE = 1, 2, 4, 8
#: Bits of a wrapper's node: its own text stays, what is under it may stay, it is in a marked article, its text is template.
KEEP, INSIDE, MARKED, TEMPLATE = 1, 2, 4, 8
LAYOUT_DEPTH = 4
SALT_PAGES = 1000
MAX_HOT = 200_000
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """Block elements of a page, and the text blocks in them."""

    __slots__ = ("tags", "keys", "parents", "out", "main", "blocks")

    def __init__(self, source: str) -> None:
        self.tags: list[str] = ["#"]
        self.keys: list[int] = [0]
        self.parents: list[int] = [-1]
        self.out: list[bool] = [False]
        self.main: list[bool] = [False]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters of it in links
        self._parse(source)

    def _add(self, tag: str, attributes: str, parent: int) -> int:
        out, main, key = self.out[parent], self.main[parent], tag
        main = main or tag in ("article", "main")
        out = out or tag in OUT_TAGS or tag == "header" and not main
        if attributes and not attributes.isspace():
            a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            names = _CAMEL.sub("-", f"{a.get('class', '')} {a.get('id', '')}").lower()
            found = set(_NAME.findall(names))
            role = a.get("role", "").lower()
            main = main or role == "main" or a.get("itemprop", "").lower() == "articlebody"
            banned = found & OUT_NAMES
            if banned == {"header"} and main or tag in ("html", "body", "article", "main"):
                banned = set()
            out = out or bool(banned) or role in OUT_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
            key = f"{tag} {a.get('class', '')}"
        self.tags.append(tag)
        self.keys.append(zlib.crc32(key.encode("utf-8", "surrogatepass")))
        self.parents.append(parent)
        self.out.append(out)
        self.main.append(main)
        return len(self.tags) - 1

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#", 0)]
        opened: Counter = Counter()  # tags in the stack
        text: list[str] = []
        links = linked = 0  # whether a link is open; characters in links
        at, skip = 0, -1

        def close() -> None:
            nonlocal linked
            if text:
                block = " ".join(_html.unescape("".join(text)).split())
                if block:
                    self.blocks.append((stack[-1][1], block, min(linked, len(block))))
                text.clear()
                linked = 0

        def cut_off(k: int) -> None:
            for x in stack[k:]:
                opened[x[0]] -= 1
            del stack[k:]

        for m in _TOKEN.finditer(source):
            start = m.start()
            if start < skip:
                continue
            if start > max(at, skip):
                piece = source[max(at, skip) : start]
                text.append(piece)
                if links:
                    linked += len(piece)
            at = m.end()
            tag = m[2]
            if not tag:
                continue
            tag = tag.lower()
            if not m[1]:
                if tag in RAW:
                    if m[3].endswith("/") and tag in ("svg", "math"):
                        continue
                    end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                    skip = end.end() if end else len(source)
                elif tag in BLOCKS:
                    close()
                    if tag in ENDS:
                        ended, holders = ENDS[tag]
                        for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in ended) else ():
                            if stack[k][0] in ended:
                                cut_off(k)
                            elif stack[k][0] in holders:
                                break
                    if stack[-1][0] == "p":  # a block ends an open paragraph
                        cut_off(len(stack) - 1)
                    elif len(stack) > 1 and stack[-2][0] == "p":
                        cut_off(len(stack) - 2)
                    node = self._add(tag, m[3], stack[-1][1])
                    if tag not in VOID:
                        stack.append((tag, node))
                        opened[tag] += 1
                elif tag == "br":
                    text.append(" ")
                elif tag == "a":
                    links = 1
                elif tag == "button":
                    close()
                    stack.append((tag, self._add(tag, m[3], stack[-1][1])))
                    opened[tag] += 1
                elif tag in ("span", "ins", "label") and m[3] and not m[3].isspace():
                    # an inline element with a banned name is a region of its own
                    probe = self._add(tag, m[3], stack[-1][1])
                    if self.out[probe] and not self.out[stack[-1][1]]:
                        close_to = stack[-1]
                        if text:
                            block = "".join(text)
                            text.clear()
                            node = close_to[1]
                            text.append(block)
                            close()
                        stack.append((tag, probe))
                        opened[tag] += 1
                    else:
                        for part in (self.tags, self.keys, self.parents, self.out, self.main):
                            part.pop()
            elif tag == "a":
                links = 0
            elif tag in BLOCKS or tag in ("button", "span", "ins", "label"):
                if opened[tag]:
                    close()
                    cut_off(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
                elif tag in BLOCKS:
                    close()
        rest = max(at, skip)
        if rest < len(source):
            text.append(source[rest:])
        close()

    def layout(self) -> int:
        """A hash of the elements near the root, prose aside, a run of equal ones counting once."""
        depth, h, last = [0], 0, None
        for i in range(1, len(self.tags)):
            depth.append(depth[self.parents[i]] + 1)
            here = depth[i], self.keys[i]
            if depth[i] <= LAYOUT_DEPTH and self.tags[i] not in PROSE and here != last:
                h, last = zlib.crc32(b"%d %d" % here, h), here
        return h

    def skeleton(self) -> bytes:
        """Parent, key, text hash, characters, characters in links and bits of each node, as int32 columns."""
        n = len(self.tags)
        h, chars, linked = [0] * n, [0] * n, [0] * n
        for node, block, links in self.blocks:
            h[node] = zlib.crc32(block.encode("utf-8", "surrogatepass"), h[node])
            chars[node] += len(block)
            linked[node] += links
        bits = [OUT * o | MAIN * m | TITLE * (t == "h1") | IS_PROSE * (t in PROSE) for t, o, m in zip(self.tags, self.out, self.main)]
        return np.array([self.parents, np.array(self.keys, np.uint32).view(np.int32), np.array(h, np.uint32).view(np.int32), chars, linked, bits], "<i4").tobytes()


class Tree:
    """A skeleton made ready for matching. Equal subtrees, text aside, have equal shapes."""

    def __init__(self, data: bytes, shapes: dict) -> None:
        self.parent, self.key, self.hash, self.chars, self.linked, self.bits = np.frombuffer(data, "<i4").reshape(6, -1)
        kids: list[list[int]] = [[] for _ in self.parent]
        for i, p in enumerate(self.parent.tolist()):
            if p >= 0:
                kids[p].append(i)
        self.kids = kids
        shape = [0] * len(kids)
        keys = self.key.tolist()
        for i in range(len(kids) - 1, -1, -1):
            s = (keys[i], tuple([shape[k] for k in kids[i]]))
            shape[i] = shapes.setdefault(s, len(shapes))
        self.shape = shape


class Matcher:
    """Simple tree matching, remembering values of pairs of shapes."""

    def __init__(self) -> None:
        self.shapes: dict = {}
        self.parts: list = []
        self.sizes: list[float] = []
        self.values: dict[tuple[int, int], float] = {}

    def full(self) -> bool:
        return len(self.shapes) > 50_000 or len(self.values) > 500_000

    def tree(self, data: bytes) -> Tree:
        t = Tree(data, self.shapes)
        for part in list(self.shapes)[len(self.parts) :] if len(self.parts) < len(self.shapes) else ():
            self.parts.append(part)
            self.sizes.append(1.0 + sum([self.sizes[k] for k in part[1]]))
        return t

    def _known(self, a: int, b: int) -> float | None:
        """The value of two shapes where it needs no search."""
        if a == b:
            return self.sizes[a]
        (ka, ca), (kb, cb) = self.parts[a], self.parts[b]
        return 0.0 if ka != kb else 1.0 if not ca or not cb else self.values.get((a, b))

    def value(self, a: int, b: int) -> float:
        """Nodes that the best matching of two shapes has; children before parents, without recursion."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self._known(x, y) is not None:
                todo.pop()
                continue
            ca, cb = self.parts[x][1], self.parts[y][1]
            first, last = _equal_ends(ca, cb)
            same = sum([self.sizes[k] for k in ca[:first]]) + sum([self.sizes[k] for k in ca[len(ca) - last :]])
            ca, cb = ca[first : len(ca) - last], cb[first : len(cb) - last]
            missing = [(i, j) for i in set(ca) for j in set(cb) if self._known(i, j) is None]
            if missing:
                todo += missing
                continue
            best = _row(self._block(ca, cb), 0, len(ca), 0, len(cb))[-1] if ca and cb else 0.0
            self.values[x, y] = 1.0 + same + float(best)
            todo.pop()
        return self._known(a, b)

    def _block(self, ca, cb, ha: np.ndarray | None = None, hb: np.ndarray | None = None):
        """Rows and columns of the children's values, made as they are asked for; equal text (``ha``, ``hb``) settles ties."""
        ua, ub = ({x: i for i, x in enumerate(dict.fromkeys(c))} for c in (ca, cb))
        ia, ib = (np.array([u[x] for x in c]) for u, c in ((ua, ca), (ub, cb)))
        table = np.array([[self.value(x, y) if (v := self._known(x, y)) is None else v for y in ub] for x in ua])

        def block(i: slice, j: slice) -> np.ndarray:
            w = table[ia[i, None], ib[j]]
            return w if ha is None else w + 0.001 * ((w > 0) & (ha[i, None] == hb[j]))

        return block

    def match(self, a: Tree, b: Tree) -> list[int]:
        """Of each node of ``a`` the node of ``b`` matched with it, or -1."""
        out = [-1] * len(a.kids)
        todo = [(0, 0)]
        while todo:
            x, y = todo.pop()
            out[x] = y
            ca, cb = a.kids[x], b.kids[y]
            if not ca or not cb:
                continue
            sa, sb = ([(t.shape[k], t.hash[k]) for k in c] for t, c in ((a, ca), (b, cb)))
            first, last = _equal_ends(sa, sb)
            todo += zip(ca[:first], cb[:first])
            todo += zip(ca[len(ca) - last :], cb[len(cb) - last :])
            ca, cb = ca[first : len(ca) - last], cb[first : len(cb) - last]
            if ca and cb and not set(sa[first : len(sa) - last]).intersection(sb[first : len(sb) - last]):
                first, last = _equal_ends([a.shape[i] for i in ca], [b.shape[j] for j in cb])  # no equal text to settle ties by
                todo += zip(ca[:first], cb[:first])
                todo += zip(ca[len(ca) - last :], cb[len(cb) - last :])
                ca, cb = ca[first : len(ca) - last], cb[first : len(cb) - last]
            if ca and cb:
                block = self._block([a.shape[i] for i in ca], [b.shape[j] for j in cb], a.hash[ca], b.hash[cb])
                todo += [(ca[i], cb[j]) for i, j in _alignment(block, 0, len(ca), 0, len(cb)) if a.key[ca[i]] == b.key[cb[j]]]
        return out


def _equal_ends(a, b) -> tuple[int, int]:
    """How many elements are equal at the beginning, and how many of the rest at the end."""
    n = min(len(a), len(b))
    first = 0
    while first < n and a[first] == b[first]:
        first += 1
    last = 0
    while last < n - first and a[-1 - last] == b[-1 - last]:
        last += 1
    return first, last


def _row(block, i0: int, i1: int, j0: int, j1: int, cells: int = 1_000_000, back: bool = False) -> np.ndarray:
    """Best values of aligning the rows with each prefix of the columns (each suffix, if ``back``)."""
    m = np.zeros(j1 - j0 + 1)
    step = max(1, cells // (j1 - j0 + 1))
    for lo in range(i0, i1, step) if not back else range(i1 - 1, i0 - 1, -step):
        part = slice(lo, min(i1, lo + step)) if not back else slice(max(i0, lo - step + 1), lo + 1)
        w = block(part, slice(j0, j1))
        for r in w[::-1, ::-1] if back else w:
            m[1:] = np.maximum(m[1:], m[:-1] + r)
            np.maximum.accumulate(m, out=m)
    return m


def _alignment(block, i0: int, i1: int, j0: int, j1: int, cells: int = 1_000_000) -> list[tuple[int, int]]:
    """Pairs of rows and columns, in order, with the largest sum; memory is bounded by halving the rows (Hirschberg)."""
    n, k = i1 - i0, j1 - j0
    if not n or not k:
        return []
    if n > 1 and n * k > cells:
        half = i0 + n // 2
        split = j0 + int(np.argmax(_row(block, i0, half, j0, j1, cells) + _row(block, half, i1, j0, j1, cells, True)[::-1]))
        return _alignment(block, i0, half, j0, split, cells) + _alignment(block, half, i1, split, j1, cells)
    w = block(slice(i0, i1), slice(j0, j1))
    m = np.zeros((n + 1, k + 1))
    for i in range(n):
        np.maximum(m[i, 1:], m[i, :-1] + w[i], out=m[i + 1, 1:])
        np.maximum.accumulate(m[i + 1], out=m[i + 1])
    out, i, j = [], n, k
    while i and j:
        if m[i, j] == m[i - 1, j]:
            i -= 1
        elif m[i, j] == m[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i0 + i, j0 + j))
    return out[::-1]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, layout, chars, nodes, at, texts, links`` of each page; ``at`` has the node of each text block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                ids, urls, sources = (c.slice(lo, 200) for c in b.columns)
                made = [Page(x) for x in sources.to_pylist()]
                blocks = [p.blocks for p in made]
                cols = [
                    pa.array([host_of(u) for u in urls.to_pylist()], pa.string()),
                    pa.array([p.layout() for p in made], pa.int64()),
                    pa.array([sum([len(t) for _, t, _ in x]) for x in blocks], pa.int64()),
                    pa.array([p.skeleton() for p in made], pa.binary()),
                    *(pa.array([[y[i] for y in x] for x in blocks], pa.list_(t)) for i, t in enumerate((pa.int32(), pa.string(), pa.int32()))),
                ]
                yield pa.RecordBatch.from_arrays([ids, urls, *cols], names)

    names = ["page_id", "url", "host", "layout", "chars", "nodes", "at", "texts", "links"]
    return pages.mapInArrow(run, "page_id long, url string, host string, layout long, chars long, nodes binary, at array<int>, texts array<string>, links array<int>")


class _Aligner:
    """Aligns pages with the references that they are given, which it remembers for a while."""

    def __init__(self) -> None:
        self.matcher, self.made = Matcher(), {}

    def tree(self, data: bytes) -> Tree:
        if data not in self.made:
            self.made[data] = self.matcher.tree(data)
        return self.made[data]

    def best(self, nodes: bytes, refs: list[bytes]) -> tuple[Tree, int, np.ndarray]:
        """The page's tree, which of the references it matches best, and the matched nodes of that one."""
        if self.matcher.full() or len(self.made) > 2_000:
            self.__init__()
        page, found = self.matcher.tree(nodes), []
        for i, ref in enumerate(refs):
            r = self.tree(ref)
            to = np.array(self.matcher.match(page, r), np.int32)
            found.append((-2 * int((to >= 0).sum()) / (len(to) + len(r.kids)), i, to))
        _, i, to = min(found, key=lambda x: x[:2])
        return page, i, to


def _near_matched(page: Tree, to: np.ndarray) -> np.ndarray:
    """Of each node the reference's node that it, or else its nearest matched ancestor, matches."""
    out = to.tolist()
    for i, p in enumerate(page.parent.tolist()):
        if out[i] < 0:
            out[i] = out[p]
    return np.array(out, np.int32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a batch by host, layout of the reference and node, from ``host, nodes, refs``."""
    aligner = _Aligner()
    for b in batches:
        total: dict[tuple[str, int], np.ndarray] = {}
        for host, nodes, refs in zip(*(c.to_pylist() for c in b.columns)):
            page, i, to = aligner.best(nodes, [r["nodes"] for r in refs])
            ref = aligner.tree(refs[i]["nodes"])
            n = total.setdefault((host, refs[i]["layout"]), np.zeros((len(ref.kids), 5), np.int64))
            near = _near_matched(page, to)
            has = np.flatnonzero(page.chars > 0)
            own = has[to[has] >= 0]
            equal = own[page.hash[own] == ref.hash[to[own]]]
            n[0, 0] += 1
            if 2 * int(page.chars[equal].sum()) < int(page.chars.sum()):
                n[to[own], 1] += 1
                n[to[equal], 2] += 1
            np.add.at(n, (near[has], 3), page.chars[has])
            np.add.at(n, (near[has], 4), page.linked[has])
        rows = [(h, k, node, *r) for (h, k), n in total.items() for node, r in enumerate(n.tolist()) if any(r)]
        types = [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], ["host", "layout", "node", *_COUNTS])


_COUNTS = ["pages", "seen", "same", "chars", "linked"]


def wrapper_of(nodes: bytes, counts: np.ndarray, constant: float, least: int, share: float, names: bool) -> bytes:
    """Bits of each node of a reference, from its counts: ``_COUNTS`` by column, a row a node."""
    ref = Tree(nodes, {})
    n = len(ref.kids)
    pages, seen, same, chars, linked = counts.T
    bits = ref.bits if names else ref.bits & ~(OUT | MAIN)
    out, marked, prose = (bits & OUT) > 0, (bits & MAIN) > 0, (bits & IS_PROSE) > 0
    marked &= ~out
    stable = (seen + 1 >= least) & (same > 0) & (same + 1 >= constant * (seen + 1))
    links = linked > 0.6 * chars
    slots = np.where(out | stable | links, 0, chars)
    below = slots.copy()
    for i in range(n - 1, 0, -1):
        below[ref.parent[i]] += below[i]
    total = int(below[0])
    by_marks = int(slots[marked].sum())
    if marked.any() and (pages.sum() < least or 2 * by_marks >= total):
        inside = marked
        stable = stable & ~prose | (seen >= 8) & (same >= 0.95 * seen)
    else:
        marked, top = np.zeros(n, bool), 0
        while more := [k for k in ref.kids[top] if below[k] >= share * total and total and not prose[k]]:
            top = more[0]
        inside = np.zeros(n, bool)
        inside[top] = True
        for i in range(top + 1, n):
            inside[i] = inside[ref.parent[i]]
        inside &= ~out
    title = ((bits & TITLE) > 0) & ~out
    keep = (inside & (marked | ~links) | title) & ~out
    return (KEEP * keep | INSIDE * inside | MARKED * marked | TEMPLATE * stable).astype(np.uint8).tobytes()


def _text(page: Tree, to: np.ndarray, ref: Tree, wrapper: bytes, blocks: list[tuple[int, str, int]], names: bool) -> str:
    """The text of a page's blocks that its wrapper keeps."""
    wrap, near = np.frombuffer(wrapper, np.uint8), _near_matched(page, to)
    out = []
    for node, block, links in blocks:
        w, bits = int(wrap[near[node]]), int(page.bits[node])
        if names and bits & OUT:
            continue
        if to[node] >= 0:
            keep = w & KEEP and not (w & TEMPLATE and page.hash[node] == ref.hash[to[node]])
        else:
            keep = w & INSIDE or bits & TITLE
        if keep and (w & MARKED or names and bits & MAIN or links <= 0.75 * len(block)):
            out.append(block)
    return "\n".join(out)


def _joined(pages: DataFrame, table: DataFrame, hosts: DataFrame, column: str, max_broadcast: int) -> DataFrame:
    """``pages`` with ``table``'s column of their host; null where it has none. ``hosts`` has ``host, pages``."""
    size = table.agg(F.sum(F.aggregate(column, F.lit(0).cast("long"), lambda n, r: n + F.octet_length(r["nodes"]) + 64))).first()[0] or 0
    if size <= max_broadcast:
        return pages.join(F.broadcast(table), "host", "left")
    hot = hosts.where(F.col("pages") > SALT_PAGES).select("host", F.ceil(F.col("pages") / SALT_PAGES).cast("long").alias("salts"))
    small = hot.count() <= MAX_HOT
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    dealt = pages.join(F.broadcast(hot) if small else hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "nodes"), salts)).drop("salts")
    copies = table.join(F.broadcast(hot) if small else hot, "host", "left").select("host", column, F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    return dealt.join(copies, ["host", "salt"], "left").drop("salt")


def _own(column: str) -> Column:
    """The entry of a page's own layout, or else all entries."""
    own = F.filter(column, lambda r: r["layout"] == F.col("layout"))
    return F.when(F.size(own) > 0, own).otherwise(F.col(column))


def wrappers(bones: DataFrame, constant: float = 0.8, least: int = 2, layouts: int = 4, share: float = 0.7, names: bool = True, max_broadcast: int = 50_000_000) -> tuple[DataFrame, DataFrame]:
    """``host, wrappers`` (layout, nodes and bits of each reference, the commonest layout first) and ``host, pages``, from what ``parsed`` gives."""
    groups = bones.where("chars > 0").groupBy("host", "layout").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("page_id", "nodes").alias("h"), "nodes")).alias("r"))
    groups = cut(groups.select("host", "layout", "n", F.col("r.nodes").alias("nodes")), "html-groups")
    hosts = cut(groups.groupBy("host").agg(F.sum("n").alias("pages")), "html-hosts")
    ranked = groups.select("host", "layout", "n", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "layout")).alias("rank")).where(F.col("rank") <= layouts)
    chosen = cut(groups.join(ranked.select("host", "layout", "rank"), ["host", "layout"]).select("host", "layout", "rank", "nodes"), "html-references")
    refs = chosen.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rank", "layout", "nodes"))).alias("refs"))
    aligned = _joined(bones.where("chars > 0").select("page_id", "host", "layout", "nodes"), refs, hosts, "refs", max_broadcast)
    counts = aligned.where("refs IS NOT NULL").select("host", "nodes", _own("refs").alias("refs")).mapInArrow(_counted, "host string, layout long, node int, " + ", ".join(f"{c} long" for c in _COUNTS))
    counts = counts.groupBy("host", "layout", "node").agg(*(F.sum(c).alias(c) for c in _COUNTS)).groupBy("host", "layout").agg(F.collect_list(F.struct("node", *_COUNTS)).alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for nodes, counts in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                n = np.zeros((len(nodes) // 24, len(_COUNTS)), np.int64)
                for c in counts or ():
                    n[c["node"]] = [c[x] for x in _COUNTS]
                made.append(wrapper_of(nodes, n, constant, least, share, names))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(made, pa.binary())], ["host", "layout", "rank", "nodes", "bits"])

    made = chosen.join(counts, ["host", "layout"], "left").select("host", "layout", "rank", "nodes", "counts").mapInArrow(run, "host string, layout long, rank int, nodes binary, bits binary")
    made = cut(made.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rank", "layout", "nodes", "bits"))).alias("wrappers")), "html-wrappers")
    remove(groups)
    remove(chosen)
    return made, hosts


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", names: bool = True, max_broadcast: int = 50_000_000, **options) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    bones = cut(parsed(rows), "html-parsed")
    made, hosts = wrappers(bones, names=names, max_broadcast=max_broadcast, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _Aligner()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                ids, urls, *rest = (c.slice(lo, 500) for c in b.columns)
                texts = []
                for nodes, at, blocks, links, wraps in zip(*(c.to_pylist() for c in rest)):
                    if not blocks:
                        texts.append("")
                        continue
                    page, i, to = aligner.best(nodes, [w["nodes"] for w in wraps])
                    texts.append(_text(page, to, aligner.tree(wraps[i]["nodes"]), wraps[i]["bits"], list(zip(at, blocks, links)), names))
                yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    out = _joined(bones, made, hosts, "wrappers", max_broadcast)
    return out.select("page_id", "url", "nodes", "at", "texts", "links", _own("wrappers").alias("wrappers")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
