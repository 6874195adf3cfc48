"""Main text of web pages by union-free regular expressions of their hosts.

A page is a stream of tags and text.  Pages of a host come from templates, so
their streams are aligned level by level of their nesting: elements that match
are merged, runs that repeat become repeated groups, and what one side lacks
becomes optional.  The result, a regular expression without unions, is the
host's wrapper.  Each element of it that has text of its own is a slot, and
the alignment tells whether its text varies or is the same on all pages, how
long it is and how much of it is linked.

A page is matched with the wrapper of its host by the same alignment.  Its
main text is in the region that holds most varying, unlinked text of the host:
from the root, the way leads into the container that holds ``SHARE`` of it.
``<article>`` and ``<main>`` break ties.  Menus, headers, footers, sidebars,
notices, adverts, forms and comments in the region are left out, and so are
its containers with one text on all of three pages or more.

A task merges pages of equal shape before it sends them.  The expressions of a
host are merged in a tree of groups of about ``FAN``, as deep as the host is
large.  Wrappers go to the pages by a broadcast of checked size or else by a
join on the host.  Tokenizing, folding and aligning take linear memory, and
linear time but for sorting.

Defined results: a null page or one without main text gives the empty text; a
null or odd URL belongs to the host ''; text outside all tags is one slot.
Elements nested deeper than ``DEEPEST`` stand as siblings there.  Columns other
than ``kept`` are left out; ``kept`` may not name ``text`` or ``n_chars``.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize

#: Expressions that a task merges.
FAN = 256
#: Bytes of wrappers that are broadcast; more are joined by host.
BROADCAST_BYTES = 32_000_000
DEEPEST = 120
#: The longest run of elements that is looked for as a repeated group.
LONGEST = 8
#: So many optional elements of one kind in one place are a repeated group.
OPTIONALS = 4
#: The share of a region's varying text that a container must hold to be the region itself.
SHARE = 0.8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg canvas object iframe math audio video".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
APART = frozenset("nav header footer aside form menu dialog button select option textarea label fieldset head title".split())
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation sidebar side-bar aside header masthead footer cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended breadcrumb breadcrumbs pagination pager widget comment comments reply replies disqus discussion respond copyright legal disclaimer toolbar skip".split()
)
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
MAIN = frozenset(("article", "main"))
_END_OF_TAG = re.compile(r"""[^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+>""")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in SKIPPED}
_CONTAINERS = frozenset("html body div section article main center table tbody tr td ()".split()) | {""}
_DENIED = frozenset("no not has with without is".split())
_CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}


def host(url: Column) -> Column:
    """The host of a URL, lower-cased; '' if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def label(tag: str) -> str:
    """A tag's name with the class words, id and role that it carries, if they set it apart."""
    name = _NAME.match(tag)[1].lower()
    words = set()
    if name in ("html", "body", *MAIN):  # what a page says of itself is no part of it
        return name
    for kind, *value in _ATTRIBUTE.findall(tag) if "=" in tag else ():
        found = set(re.split(r"[\s_]+", "".join(value).lower()))
        if kind.lower() == "role":
            words |= {f"@{w}" for w in found & APART_ROLES}
        else:
            found |= {p for w in found if (parts := w.split("-"))[0] not in _DENIED for p in parts}
            words |= {f".{w}" for w in found & APART_WORDS}
    return name + "".join(sorted(words))


@lru_cache(maxsize=100_000)
def set_apart(label: str) -> bool:
    """Whether a label is that of a menu, a notice, a form and the like."""
    name, *words = re.split(r"(?=[.@])", label)
    return name in APART or bool(words)


def events(page: str) -> Iterator[tuple[str, str]]:
    """('open', tag), ('close', name) and ('text', raw) of a page, scripts and comments left out, in linear time."""
    at, n, last, quoted = 0, len(page), page.rfind(">"), True
    while at < n:
        tag = page.find("<", at)
        if tag < 0 or tag > last:
            yield "text", page[at:]
            return
        if tag > at:
            yield "text", page[at:tag]
        name = _NAME.match(page, tag)
        if name is None:
            if page.startswith("<!--", tag):
                end = page.find("-->", tag + 4)
                at = end + 3 if end >= 0 else n
            elif page.startswith("<![CDATA[", tag):
                end = page.find("]]>", tag)
                at = end + 3 if end >= 0 else n
            elif page[tag + 1] in "!?":
                at = page.index(">", tag) + 1
            else:
                yield "text", "<"
                at = tag + 1
            continue
        end = _END_OF_TAG.match(page, name.end()) if quoted else None
        quoted = end is not None  # once quotes stand open to the end of the page, they count no more
        at = end.end() if end else page.index(">", tag) + 1
        found = name[1].lower()
        if page[tag + 1] == "/":
            yield "close", found
        elif found in SKIPPED:
            end = _ENDS[found].search(page, at)
            at = end.end() if end else n
        else:
            yield "open", page[tag:at]


class Page:
    """The elements of a page, (label, parent) each, and its ``runs``: (element, text, linked) or None between blocks.

    Inline elements are no elements here unless a label sets them apart.
    """

    def __init__(self, page: str):
        self.labels, self.parents, self.runs = [""], [-1], []
        self.open, self.names, self.link = [0], [""], None
        for kind, value in events(page):
            if kind == "text":
                self.runs.append((self.open[-1], value, self.link is not None and len(self.open) >= self.link))
                continue
            name = value if kind == "close" else _NAME.match(value)[1].lower()
            if name == "a":
                self.link = len(self.open) if kind == "open" else None
            elif name == "br":
                self.runs.append((self.open[-1], " ", False))
            elif kind == "open":
                self._start(name, value)
            else:
                self._end(name)
            if name in BLOCKS:
                self.runs.append(None)

    def _cut(self, k: int) -> None:
        if BLOCKS.intersection(self.names[k:]):
            self.runs.append(None)
        del self.names[k:], self.open[k:]
        if self.link is not None and len(self.open) < self.link:
            self.link = None

    def _start(self, name: str, tag: str) -> None:
        for k in range(len(self.names) - 1, 0, -1):
            if name in _CLOSES.get(self.names[k], ()):
                self._cut(k)
                break
            if self.names[k] in ("table", "ul", "ol", "div", "article", "section", "body"):
                break
        own = label(tag)
        if name in VOID or not (name in BLOCKS or set_apart(own)):
            return
        if len(self.open) >= DEEPEST:
            self._cut(len(self.open) - 1)
        self.labels.append(own)
        self.parents.append(self.open[-1])
        self.open.append(len(self.labels) - 1)
        self.names.append(name)

    def _end(self, name: str) -> None:
        for k in range(len(self.names) - 1, 0, -1):
            if self.names[k] == name:
                self._cut(k)
                return


# ------------------------------------------------- union-free expressions


class Node:
    """An element of an expression, or with the label '()' a group of them.

    ``text`` is 0 without text of its own, a checksum if it is one text on all
    pages, else -1.  A ``loose`` element belongs to the repeated group of the
    loose ones beside it and has no place among the others.
    """

    __slots__ = ("label", "repeated", "optional", "loose", "pages", "chars", "linked", "text", "kids", "raw", "_shape")

    def __init__(self, label: str, repeated: bool = False, optional: bool = False, loose: bool = False, pages: int = 1, chars: int = 0, linked: int = 0, text: int = 0, kids: list | None = None, raw: list[int] | None = None):
        self.label, self.repeated, self.optional, self.loose = label, repeated, optional, loose
        self.pages, self.chars, self.linked, self.text = pages, chars, linked, text
        self.kids, self.raw, self._shape = kids or [], raw or [], None

    def shape(self) -> int:
        """A hash of the labels, the same for elements that differ in repetition only."""
        if self._shape is None:
            self._shape = hash((self.label, self.text != 0, tuple(k.shape() for k in self.kids)))
        return self._shape

    def kind(self) -> tuple:
        return self.label, self.below()

    def below(self) -> frozenset[str]:
        """The labels of the children, groups looked through."""
        return frozenset().union(*(k.below() if k.label == "()" else (k.label,) for k in self.kids))

    def dump(self) -> list:
        return [self.label, int(self.repeated) | int(self.optional) << 1 | int(self.loose) << 2, self.pages, self.chars, self.linked, self.text, [k.dump() for k in self.kids]]

    @staticmethod
    def load(x: list) -> Node:
        label, flags, pages, chars, linked, text, kids = x
        return Node(label, bool(flags & 1), bool(flags & 2), bool(flags & 4), pages, chars, linked, text, [Node.load(k) for k in kids])

    def __str__(self) -> str:
        own = " ".join(filter(None, [self.label if self.label != "()" else "", "#" * (self.text != 0)]))
        inner = " ".join([own, *map(str, self.kids)]).strip()
        mark = ("*" if self.optional else "+") if self.repeated else "?" if self.optional else ""
        return f"({inner}){mark}"


def expression(page: Page) -> Node:
    """The expression of one page: its elements, with runs that repeat folded."""
    nodes = [Node(own, raw=[k]) for k, own in enumerate(page.labels)]
    for run in page.runs:
        if run is not None and (n := len(run[1].strip())):
            node = nodes[run[0]]
            node.chars += n
            node.linked += n * run[2]
            node.text = zlib.crc32(run[1].strip().encode("utf-8", "surrogatepass"), node.text) or 1
    for k in range(1, len(nodes)):
        nodes[page.parents[k]].kids.append(nodes[k])
    for node in reversed(nodes):  # children stand after their parents
        node.kids = fold(node.kids)
    return nodes[0]


def fold(kids: list[Node]) -> list[Node]:
    """``kids`` with runs that repeat in place as repeated groups, short runs first."""
    for size in range(1, LONGEST + 1):
        if len(kids) < 2 * size:
            break
        shapes = [k.shape() for k in kids]
        out, at = [], 0
        while at < len(kids):
            run, end = shapes[at : at + size], at + size
            while len(run) == size and shapes[end : end + size] == run:
                end += size
            if end == at + size:
                out.append(kids[at])
                at += 1
                continue
            first = kids[at : at + size]
            for k in range(at + size, end, size):
                for a, b in zip(first, kids[k : k + size], strict=True):
                    merge(a, b, True)
            if size == 1:
                first[0].repeated = True
                out += first
            else:
                out.append(Node("()", True, kids=first))
            at = end
        kids = out
    return kids


def merge(a: Node, b: Node, same_page: bool = False) -> Node:
    """``a`` with ``b`` merged into it."""
    if same_page:
        a.text = zlib.crc32(b.text.to_bytes(8, "little", signed=True), a.text & 0xFFFFFFFF) or 1 if a.text and b.text else a.text or b.text
    else:
        a.pages += b.pages
        if a.text != b.text:
            a.text = -1
    a.chars, a.linked, a._shape = a.chars + b.chars, a.linked + b.linked, None
    a.repeated, a.optional, a.loose = a.repeated or b.repeated, a.optional or b.optional, a.loose or b.loose
    a.kids = align(a.kids, b.kids, same_page)
    a.raw += b.raw
    return a


def align(a: list[Node], b: list[Node], same_page: bool = False) -> list[Node]:
    """The elements of two lists merged; what one side lacks becomes optional."""
    if [x.shape() for x in a] == [x.shape() for x in b] and not any(x.loose for x in a + b):
        return [merge(x, y, same_page) for x, y in zip(a, b, strict=True)]
    a, b = _grouped(a, b), _grouped(b, a)
    loose: dict[tuple, Node] = {}
    for x in a + b:
        if x.loose:
            loose[x.kind()] = merge(loose[x.kind()], x, same_page) if x.kind() in loose else x
    held = set(map(id, loose.values()))

    def ordered(side: list[Node]) -> list[Node]:
        out = []
        for x in side:
            if x.loose:
                if id(x) in held:
                    out.append(x)
            elif x.kind() in loose:
                x.loose = True
                merge(loose[x.kind()], x, same_page)
            else:
                out.append(x)
        return out

    a, b = ordered(a), ordered(b)
    out, i, j = [], 0, 0

    def alone(nodes: list[Node]) -> None:
        for x in nodes:
            x.optional = True
        out.extend(nodes)

    for p, q in [*pairs(a, b), (len(a), len(b))]:
        alone(a[i:p])
        alone(b[j:q])
        if p < len(a):
            out.append(merge(a[p], b[q], same_page))
        i, j = p + 1, q + 1
    often = [kind for kind, n in Counter(x.kind() for x in out if x.optional and not x.loose).items() if n >= OPTIONALS]
    for kind in often:
        own = [x for x in out if x.kind() == kind]
        most = max(x.pages for x in own)
        for x in own[1:]:
            merge(own[0], x, True)
        own[0].pages, own[0].repeated, own[0].optional, own[0].loose = most, True, True, True
        gone = set(map(id, own[1:]))
        out = [x for x in out if id(x) not in gone]
    return out


def _grouped(a: list[Node], b: list[Node]) -> list[Node]:
    """``a`` with what is a repeated group in ``b`` as one, though it stands once."""
    for group in b:
        if group.label != "()":
            continue
        body, out, k = [x.label for x in group.kids], [], 0
        while k < len(a):
            if [x.label for x in a[k : k + len(body)]] == body:
                out.append(Node("()", True, pages=max(x.pages for x in a[k : k + len(body)]), kids=a[k : k + len(body)]))
                k += len(body)
            else:
                out.append(a[k])
                k += 1
        a = out
    return a


def pairs(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Places of matching elements, in the order of both lists.

    Elements whose shape stands once on both sides match first, as many as
    keep the order; between them, those of one kind, of one label and first
    child, of one label, and at last those of one label by their number.
    """
    found, todo = [], [(0, len(a), 0, len(b), 0)]
    keys = (Node.shape, Node.kind, lambda x: (x.label, x.kids[0].label if x.kids else ""), lambda x: x.label)
    while todo:
        a0, a1, b0, b1, level = todo.pop()
        if a0 == a1 or b0 == b1 or level > len(keys):
            continue
        sides = []
        for nodes, start, end in ((a, a0, a1), (b, b0, b1)):
            places: dict = {}
            if level < len(keys):
                for k in range(start, end):
                    key = keys[level](nodes[k])
                    places[key] = -1 if key in places else k
            else:
                seen: Counter = Counter()
                for k in range(start, end):
                    places[nodes[k].label, seen[nodes[k].label]] = k
                    seen[nodes[k].label] += 1
            sides.append(places)
        both = sorted((k, sides[1][key]) for key, k in sides[0].items() if k >= 0 and sides[1].get(key, -1) >= 0)
        if level > 2:
            both = [(p, q) for p, q in both if _alike(a[p], b[q])]
        i, j = a0, b0
        for p, q in [*_rising(both), (a1, b1)]:
            todo.append((i, p, j, q, level + 1))
            if p < a1:
                found.append((p, q))
            i, j = p + 1, q + 1
    return sorted(found)


def _alike(a: Node, b: Node) -> bool:
    x, y = a.below(), b.below()
    return bool(x & y) or x == y


def _rising(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of ``places``, sorted by the first number, that rises in the second one too."""
    ends, last, before = [], [], []
    for k, (_, q) in enumerate(places):
        at = bisect_left(ends, q)
        ends[at : at + 1] = [q]
        before.append(last[at - 1] if at else -1)
        last[at : at + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(places[k])
        k = before[k]
    return out[::-1]


# --------------------------------------------------------------- main region


def _varies(node: Node) -> bool:
    return node.text == -1 or any(map(_varies, node.kids))


def _settled(node: Node) -> bool:
    """Whether all text of an element is the same on all its pages."""
    return node.text != -1 and all(map(_settled, node.kids))


def region(root: Node) -> tuple[list[Node], bool]:
    """The elements of the page at hand that hold its main text, and whether the host's pages tell template text apart."""
    varied = _varies(root)
    weights: dict[int, float] = {}

    def weigh(node: Node) -> float:
        if not node.raw and node.label != "()" or set_apart(node.label):
            return 0.0
        own = 0.0 if varied and node.text > 0 and node.pages > 1 else max(0, node.chars - 2 * node.linked) / max(1, node.pages)
        weights[id(node)] = total = own + sum(map(weigh, node.kids))
        return total

    weigh(root)
    node = root
    while True:
        kids = [k for k in node.kids if id(k) in weights and (k.label.split(".")[0].split("@")[0] in _CONTAINERS)]
        if not kids or node.label in MAIN:
            return [node], varied
        best = max(kids, key=lambda k: weights[id(k)])
        marked = [k for k in kids if k.label in MAIN and weights[id(k)] > 0]
        if weights[id(best)] >= SHARE * weights[id(node)] and weights[id(best)] > 0:
            node = best
        elif marked:
            return marked, varied
        else:
            return [node], varied


def main_text(page: Page, root: Node) -> str:
    """The blocks of the page's main region, in page order; ``root`` is the wrapper with the page merged into it."""
    main: set[int] = set()
    found, varied = region(root)

    def mark(node: Node, top: bool) -> None:
        if set_apart(node.label):
            return
        if not top and varied and node.pages > 2 and node.label in _CONTAINERS and node.label != "()" and node.kids and _settled(node):
            return  # template text
        main.update(node.raw)
        for k in node.kids:
            mark(k, False)

    for node in found:
        mark(node, True)
    blocks, block = [], []
    for run in [*page.runs, None]:
        if run is not None:
            if run[0] in main:
                block.append(run[1])
        elif block:
            text = " ".join(entities.unescape("".join(block)).split())
            if text:
                blocks.append(text)
            block = []
    return "\n\n".join(blocks)


# --------------------------------------------------------------- Spark jobs


def shapes(pages: DataFrame) -> DataFrame:
    """(host, tree): the expressions of the rows (host, html), those of one shape merged by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, seen = {}, set()
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tree = expression(Page(page.as_py() or ""))
                if (copy := (name, hash(json.dumps(tree.dump())))) in seen:
                    continue  # a copy tells nothing of what varies
                seen.add(copy)
                key = name, tree.shape()
                trees[key] = merge(trees[key], tree) if key in trees else tree
                trees[key].raw = []
            columns = [pa.array([k[0] for k in trees], pa.string()), pa.array([json.dumps(t.dump()) for t in trees.values()], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "tree"])

    return pages.mapInArrow(run, "host string, tree string").distinct()


def merged(trees: list[str]) -> str:
    """The expression of several, those of most pages first."""
    nodes = sorted((json.loads(t) for t in trees), key=lambda x: (-x[2], json.dumps(x)))
    root = Node.load(nodes[0])
    for x in nodes[1:]:
        merge(root, Node.load(x))
    return json.dumps(root.dump())


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the wrapper of each host of the rows (host, html)."""
    rows, level = materialize(shapes(pages), "shapes"), 0

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "tree": [merged(list(frame["tree"]))]})

    while (most := rows.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > FAN:
        salt = F.pmod(F.xxhash64("tree", F.lit(level)), F.lit(-(-most // FAN)))
        rows = materialize(rows.groupBy("host", salt.alias("salt")).applyInPandas(run, "host string, tree string").distinct(), "shapes")
        level += 1
    return rows.groupBy("host").applyInPandas(run, "host string, tree string").withColumnRenamed("tree", "wrapper")


@lru_cache(maxsize=256)
def _parsed(wrapper: str) -> list:
    return json.loads(wrapper)


def page_text(html: str, wrapper: str | None) -> str:
    """The main text of a page by the wrapper of its host."""
    page = Page(html)
    own = expression(page)
    return main_text(page, merge(Node.load(_parsed(wrapper)), own) if wrapper else own)


def extract(pages: DataFrame, html: str = "html", url: str = "url", kept: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``kept`` of ``pages`` with text and n_chars, for every row."""
    rows = pages.select(*kept, host(F.col(url)).alias("__host"), F.col(html).cast("string").alias("__html"))
    found = materialize(wrappers(rows.select(F.col("__host").alias("host"), F.col("__html").alias("html"))), "wrappers")
    side = found.select(F.col("host").alias("__of"), F.col("wrapper").alias("__wrapper"))
    if (found.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0) <= BROADCAST_BYTES:
        side = F.broadcast(side)
    joined = rows.join(side, F.col("__host") == F.col("__of"), "left").select("__html", "__wrapper", *kept)
    schema = pages.select(*kept).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(p.as_py() or "", w.as_py()) for p, w in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)
