"""HTML extraction by wrapper induction on pages of one host.

Pages of a host come in groups of about ``GROUP``.  The page whose slots stand where most
pages have slots is the reference; simple tree matching aligns every other page's DOM tree
with it (a node matches a node of equal tag, children match in order, as many nodes as
possible, ties by equal text).  Slots that it leaves unmatched are aligned in the same way with
further references, while any place of theirs is on enough pages.  A slot whose text is the
same on all of at least ``LEAST`` distinct pages that have it is template; a slot that varies
is content.  Slots are block elements, runs of equal list items or paragraphs (one repeated
node), and runs of text between blocks; inline elements belong to the text they stand in.

What varies and yet is no content, HTML tells: elements, roles and class words for menus,
headers, footers, sidebars, notices, adverts, forms, scripts and comments go, and outside
``article`` and ``main`` also blocks that are nothing but links.  Inside ``article`` and
``main`` no text goes for being constant.  Only where a host has too few distinct pages to
tell (fewer than ``LEAST`` that can be aligned) does the page's own ``article`` or ``main``
decide alone, if it has one.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Generator, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.storage import parallelism, stored

#: Pages of a host that are aligned with one another, about.
GROUP = 200
#: Groups of a task, about.
TASK = 8
#: Distinct pages that tell whether a slot is template.
LEAST = 3
#: Cells of a table of matches that is held whole; larger ones are halved, in linear memory.
CELLS = 4096
#: Pairs of unequal shapes of two child lists that are weighed one by one and kept; more are weighed by rows, as exactly.
PAIRS = 1000
#: Weights that are kept; when there are more, pairs are weighed by rows until the next two lists.
KEPT = 300_000
#: Cells of a table of weights that is held at once.
WEIGHTS = 1 << 20

# Fixed values of HTML: elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("nav footer aside form script style noscript template iframe svg textarea title head button select dialog menu".split())
#: What a start tag closes if it is open (up to the nearest of the second kind).
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements whose runs are one repeated slot.
REPEATED = frozenset("li p tr option dd dt td".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
WORDS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent notice gdpr popup modal newsletter subscribe nav navbar navigation menu sidebar breadcrumb breadcrumbs footer masthead comment comments commentlist disqus replies social share sharing related widget login signup search pagination pager banner".split())

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    """An element; ``kids`` are nodes and texts in order."""

    __slots__ = ("tag", "dull", "kids")

    def __init__(self, tag: str, dull: bool = False):
        self.tag, self.dull, self.kids = tag, dull, []


def _dull(tag: str, attrs: str) -> bool:
    """Whether an element is template by its name, role or class words."""
    if tag in NEVER:
        return True
    for name, *values in _ATTR.findall(attrs) if attrs else ():
        value = next((v for v in values if v), "").lower()
        name = name.lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") and not WORDS.isdisjoint(_WORD.findall(value)):
            return True
    return False


def parse(source: str) -> Node:
    """The tree of a page, however broken: open elements close where HTML says or at the end."""
    root = Node("#root")
    stack, at, end = [root], 0, len(source)
    # places in the stack of the open elements by name, and of the open blocks, so that depth costs no search
    places: dict[str, list[int]] = defaultdict(list)
    open_blocks: list[int] = []

    def close_from(k: int) -> None:
        for x in reversed(stack[k:]):
            places[x.tag].pop()
        del stack[k:]
        while open_blocks and open_blocks[-1] >= k:
            open_blocks.pop()

    def nearest(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    while at < end:
        m = _PART.search(source, at)
        if not m:
            stack[-1].kids.append(source[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(source[at : m.start()])
        at = m.end()
        close, tag, attrs = m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if close:
            if places[tag]:
                close_from(places[tag][-1])
            continue
        if tag in BLOCK and open_blocks and stack[open_blocks[-1]].tag == "p":
            close_from(open_blocks[-1])
        if tag in CLOSES:
            these, until = CLOSES[tag]
            if nearest(these) > nearest(until):
                close_from(nearest(these))
        node = Node(tag, _dull(tag, attrs))
        stack[-1].kids.append(node)
        if tag in RAW and not attrs.endswith("/"):
            done = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = done.end() if done else end
        elif tag not in VOID and not attrs.endswith("/"):
            places[tag].append(len(stack))
            if tag in BLOCK:
                open_blocks.append(len(stack))
            stack.append(node)
    return root


def _nodes(kids: list) -> list[Node]:
    return [k for k in kids if isinstance(k, Node) and k.tag not in VOID and k.tag not in RAW]


class Interned:
    """Numbers for shapes, texts and places of the trees of one group, and how well shapes match."""

    def __init__(self):
        self.shapes: dict[tuple, int] = {}
        self.of: list[tuple[str, tuple[int, ...], int]] = []  # tag, children's shapes, nodes
        self.texts: dict[tuple, int] = {(): 0}
        self.places: dict[tuple, int] = {}
        self.weights: dict[tuple[int, int], int] = {}

    def shape(self, tag: str, kids: tuple[int, ...]) -> int:
        k = self.shapes.setdefault((tag, kids), len(self.of))
        if k == len(self.of):
            self.of.append((tag, kids, 1 + sum(self.of[x][2] for x in kids)))
        return k

    def text(self, parts: list) -> int:
        """One number for one sequence of texts (words) and numbers of texts; 0 for none."""
        key = tuple(x for x in (" ".join(p.split()) if isinstance(p, str) else p for p in parts) if x)
        return self.texts.setdefault(key, len(self.texts))

    def place(self, above: int, tag: str) -> int:
        return self.places.setdefault((above, tag), len(self.places) + 1)

    def weight(self, a: int, b: int) -> int:
        """Nodes that simple tree matching matches in two trees whose roots have one tag."""
        if a == b:
            return self.of[a][2]
        todo = [(a, b)]
        while todo:
            pair = todo[-1]
            if pair in self.weights:
                todo.pop()
                continue
            x, y = _trimmed(self.of[pair[0]][1], self.of[pair[1]][1])[2:]
            open_ = [q for q in self.unequal(x, y) or () if q not in self.weights] if len(self.weights) < KEPT else ()
            if open_:
                todo += open_
                continue
            ends = sum(self.of[k][2] for k in self.of[pair[0]][1]) - sum(self.of[k][2] for k in x)
            self.weights[pair] = 1 + ends + int(_best(self.rows(x, y), len(y))[-1])
            todo.pop()
        return self.weights[a, b]

    def weigh(self, x: tuple[int, ...], y: tuple[int, ...]) -> None:
        """Keeps the weights of the shapes in two child lists, if they are few."""
        if len(self.weights) >= KEPT:
            self.weights.clear()
        for p, q in self.unequal(x, y) or ():
            self.weight(p, q)

    def unequal(self, x: Iterable[int], y: Iterable[int]) -> list[tuple[int, int]] | None:
        """Pairs of unequal shapes of one tag in two child lists; None where there are too many to keep."""
        by_tag = defaultdict(set)
        for k in set(y):
            by_tag[self.of[k][0]].add(k)
        kinds = set(x)
        if sum(len(by_tag[self.of[k][0]]) for k in kinds) > PAIRS:
            return None
        return [(k, j) for k in kinds for j in by_tag[self.of[k][0]] if k != j]

    def rows(self, x: tuple[int, ...], y: tuple[int, ...]) -> Iterator[np.ndarray]:
        """Each item's weights against all of y (0 for another tag), for as many shapes at once as fit a table."""
        kinds, at = np.unique(np.array(y, np.int64), return_inverse=True)
        for some in _runs(x, max(1, WEIGHTS // max(1, len(kinds)))):
            row = {k: n for n, k in enumerate(dict.fromkeys(some))}
            table = self.table(list(row), kinds.tolist())
            for k in some:
                yield table[row[k]][at]

    def table(self, a: list[int], b: list[int]) -> np.ndarray:
        """Weights of all of a against all of b, different shapes each."""
        pairs = self.unequal(a, b)
        if pairs is None or any(p not in self.weights for p in pairs):
            return self.dense(a, b)
        row, column = ({k: n for n, k in enumerate(x)} for x in (a, b))
        out = np.zeros((len(a), len(b)), np.int64)
        for p, q in pairs:
            out[row[p], column[q]] = self.weights[p, q]
        for k in row.keys() & column.keys():
            out[row[k], column[k]] = self.of[k][2]
        return out

    def dense(self, a: list[int], b: list[int]) -> np.ndarray:
        """``table`` from tables of the children's weights; of those, one is held at a time, and a part of it where it is large."""
        todo, got = [self._dense(a, b)], None
        while todo:
            try:
                todo.append(self._dense(*todo[-1].send(got)))
                got = None
            except StopIteration as done:
                todo.pop()
                got = done.value
        return got

    def _dense(self, a: list[int], b: list[int]) -> Generator[tuple[list[int], list[int]], np.ndarray, np.ndarray]:
        """Asks for the tables of children that it needs."""
        out = np.zeros((len(a), len(b)), np.int64)
        for tag in {self.of[k][0] for k in a} & {self.of[k][0] for k in b}:
            mine = [n for n, k in enumerate(a) if self.of[k][0] == tag]
            theirs = np.array([n for n, k in enumerate(b) if self.of[k][0] == tag])
            below = sorted({c for n in theirs for c in self.of[b[n]][1]})
            out[np.ix_(mine, theirs)] = 1
            # the others by how many children they have; a place that a list does not reach points to a column of zeros
            place, like = {c: n for n, c in enumerate(below)}, defaultdict(list)
            for n in theirs.tolist():
                if self.of[b[n]][1]:
                    like[len(self.of[b[n]][1]).bit_length()].append(n)
            lists = []
            for ns in like.values():
                at = np.full((len(ns), max(len(self.of[b[n]][1]) for n in ns)), len(below))
                for r, n in enumerate(ns):
                    at[r, : len(self.of[b[n]][1])] = [place[c] for c in self.of[b[n]][1]]
                lists.append((np.array(ns), at))
            each = max(1, WEIGHTS // max(1, len(below)))
            owned = [(n, c) for n in mine for c in self.of[a[n]][1]] if below else []
            now = best = None
            for some in _runs(owned, each, lambda x: x[1]):
                row = {c: r for r, c in enumerate(dict.fromkeys(c for _, c in some))}
                weights = yield list(row), below
                weights = np.hstack([weights, np.zeros((len(row), 1), np.int64)])
                for n, c in some:
                    if n != now:
                        now, best = n, [np.zeros((len(ns), at.shape[1] + 1), np.int64) for ns, at in lists]
                    for x, (ns, at) in zip(best, lists, strict=True):
                        x[:, 1:] = np.maximum.accumulate(np.maximum(x[:, 1:], x[:, :-1] + weights[row[c]][at]), axis=1)
                        out[n, ns] = 1 + x[:, -1]
        return out


def _runs(items: Sequence, most: int, key: Callable | None = None) -> Iterator[Sequence]:
    """Cuts items into runs with at most so many different keys each."""
    began, seen = 0, set()
    for n, x in enumerate(items):
        k = key(x) if key else x
        if k not in seen and len(seen) == most:
            yield items[began:n]
            began, seen = n, set()
        seen.add(k)
    if began < len(items):
        yield items[began:]


def _trimmed(x: tuple, y: tuple) -> tuple[int, int, tuple, tuple]:
    """How many first and last items are equal, and what is between them.  To match those with each other is best."""
    n = min(len(x), len(y))
    first = next((k for k in range(n) if x[k] != y[k]), n)
    last = next((k for k in range(n - first) if x[-1 - k] != y[-1 - k]), n - first)
    return first, last, x[first : len(x) - last], y[first : len(y) - last]


def _best(rows: Iterator[np.ndarray], n: int) -> np.ndarray:
    """The best sum of weights of items matched in order with the first 0, 1, ... of n others; rows: each item's weights."""
    row = np.zeros(n + 1, np.int64)
    for w in rows:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w))
    return row


class Slot:
    """What the matching sees of a tree: a block, a run of repeated siblings, or a run of text between blocks."""

    __slots__ = ("tag", "parent", "at", "slots", "shape", "text")

    def __init__(self, tag: str, parent: Node, at: list[int]):
        self.tag, self.parent, self.at = tag, parent, at
        self.slots: list[Slot] = []
        self.shape = self.text = 0


def shape(tree: Node, names: Interned | None = None) -> list[Slot]:
    """A tree's slots with their insides.  Template elements, and blocks without blocks in them, have no inside."""
    names = names or Interned()
    order, todo = [], [tree]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += _nodes(x.kids)
    text: dict[int, int] = {}
    holds: dict[int, bool] = {}  # blocks
    slots: dict[int, list[Slot]] = {}
    for x in reversed(order):
        parts = [k if isinstance(k, str) else text.get(id(k), 0) for k in x.kids]
        text[id(x)] = names.text(parts)
        inner = any(holds.get(id(k), False) for k in x.kids if isinstance(k, Node))
        holds[id(x)] = inner or x.tag in BLOCK
        if not inner or x.dull:
            slots[id(x)] = []
            continue
        found: list[Slot] = []
        for i, k in enumerate(x.kids):
            block = isinstance(k, Node) and holds.get(id(k), False)
            tag = k.tag if block else "#text"
            if not block and not parts[i] or isinstance(k, str) and not k.strip():
                continue
            near = found and (not block and found[-1].at[-1] == i - 1 or block and tag in REPEATED)
            if near and found[-1].tag == tag:
                found[-1].at.append(i)
            else:
                found.append(Slot(tag, x, [i]))
        for s in found:
            one = x.kids[s.at[0]] if len(s.at) == 1 and s.tag != "#text" else None
            s.slots = slots.pop(id(one)) if one else []
            s.shape = names.shape(s.tag, tuple(c.shape for c in s.slots))
            s.text = names.text([parts[i] for i in s.at])
        slots[id(x)] = found
    return slots[id(tree)]


def _aligned(a: list[Slot], b: list[Slot], names: Interned) -> list[tuple[Slot, Slot]]:
    """Which slots of two child lists match: as many nodes as possible, then as many equal texts."""
    first, last, _, _ = _trimmed([(s.shape, s.text) for s in a], [(s.shape, s.text) for s in b])
    out = [*zip(a[:first], b[:first], strict=True), *zip(a[len(a) - last :], b[len(b) - last :], strict=True)]
    todo = [(a[first : len(a) - last], b[first : len(b) - last])]
    while todo:
        a, b = todo.pop()
        x, y = tuple(s.shape for s in a), tuple(s.shape for s in b)
        if x == y:
            out += zip(a, b, strict=True)
            continue
        if not a or not b:
            continue
        names.weigh(x, y)
        if len(a) > 1 and len(a) * len(b) > CELLS:
            m = len(a) // 2
            low, high = _best(_worth(a[:m], b, names), len(b)), _best((w[::-1] for w in _worth(a[m:][::-1], b, names)), len(b))
            j = int((low + high[::-1]).argmax())
            todo += [(a[:m], b[:j]), (a[m:], b[j:])]
            continue
        best = np.zeros((len(a) + 1, len(b) + 1), np.int64)
        for i, w in enumerate(_worth(a, b, names)):
            best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + w))
        i, j = len(a), len(b)
        while i and j:
            if best[i, j] == best[i - 1, j]:
                i -= 1
            elif best[i, j] == best[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((a[i], b[j]))
    return out


def _worth(a: list[Slot], b: list[Slot], names: Interned) -> Iterator[np.ndarray]:
    """Each slot's worth as a match of each of b: nodes that match below it, then equal texts."""
    said = np.array([s.text for s in b])
    for s, w in zip(a, names.rows(tuple(s.shape for s in a), tuple(s.shape for s in b)), strict=True):
        yield (w << 20) + (said == s.text) * (w > 0)


def match(a: list[Slot], b: list[Slot], names: Interned) -> tuple[int, list[tuple[Slot, Slot]]]:
    """Simple tree matching of two child lists: how many nodes match, and which."""
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs = _aligned(x, y, names)
        out += pairs
        todo += [(p.slots, q.slots) for p, q in pairs if p.slots and q.slots]
    return len(out), out


def _holders(node: Node) -> Iterator[Node]:
    """The outermost article and main elements that are not template."""
    todo = _nodes(node.kids)[::-1]
    while todo:
        k = todo.pop()
        if k.dull:
            continue
        if k.tag in ("article", "main"):
            yield k
        else:
            todo += _nodes(k.kids)[::-1]


def blocks(nodes: list[Node], gone: set[tuple[int, int]], held: set[int], menus: set[int]) -> list[str]:
    """Texts of the blocks under nodes in page order, without template.

    gone: (element, place of a child) of constant slots; held: the articles, in which nothing is
    constant and headers stay; menus: elements that are left out outside them.
    """
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if now:
            s = " ".join(_html.unescape("".join(now)).split())
            if s:
                out.append(s)
            now.clear()

    todo: list = [(n, False) for n in reversed(nodes)]
    while todo:
        x, inside = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag == "br":
            now.append(" ")
        else:
            inside = inside or id(x) in held
            if x.dull or x.tag in RAW or not inside and (x.tag == "header" or id(x) in menus):
                continue
            if x.tag in BLOCK:
                flush()
                todo.append((None, False))
            todo += [(k, inside) for i, k in reversed([*enumerate(x.kids)]) if inside or (id(x), i) not in gone]
    flush()
    return out


def _menus(tree: Node) -> set[int]:
    """The blocks that hold several links and no other text."""
    order, todo = [], [tree]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [k for k in x.kids if isinstance(k, Node)]
    links: dict[int, int] = {}  # -1 where there is other text
    for x in reversed(order):
        if x.tag == "a":
            links[id(x)] = 1
        elif x.tag in RAW or x.tag in VOID:
            links[id(x)] = 0
        else:
            each = [links[id(k)] if isinstance(k, Node) else -1 if k.strip() else 0 for k in x.kids]
            links[id(x)] = -1 if -1 in each else sum(each)
    return {id(x) for x in order if x.tag in BLOCK and links[id(x)] > 1}


def induced(trees: list[Node]) -> tuple[list[set[tuple[int, int]]], list[bool]]:
    """The wrapper of a group of pages: each page's constant slots, (element, place of a child), and whether it could be aligned."""
    names = Interned()
    slots = [shape(t, names) for t in trees]
    said = [tuple(s.text for s in x) for x in slots]
    fresh = {said.index(t) for t in set(said)}  # pages that copy one another tell nothing
    left = [_places(x, names) for x in slots]  # slots not aligned yet
    gone: list[set[tuple[int, int]]] = [set() for _ in trees]
    told = [False] * len(trees)
    while True:
        places = [set(x.values()) for x in left]
        on = Counter(p for k in fresh for p in places[k])
        worth = {k: sum(on[p] for p in places[k] if on[p] >= LEAST) for k in sorted(fresh)}
        first = max(worth, key=worth.__getitem__, default=None)
        if first is None or not worth[first]:
            return gone, told
        texts, at = defaultdict(list), defaultdict(list)
        for k, x in enumerate(slots):
            if places[k].isdisjoint(places[first]):
                continue
            for a, b in match(slots[first], x, names)[1]:
                if a in left[first] and b in left[k]:
                    at[a].append((k, b))
                    if k in fresh:
                        texts[a].append(b.text)
        for a, t in texts.items():
            if len(t) >= LEAST:
                for k, b in at[a]:
                    told[k] = True
                    if t[0] and len(set(t)) == 1:
                        gone[k].update((id(b.parent), i) for i in b.at)
        for pairs in at.values():
            for k, b in pairs:
                left[k].pop(b, None)
        left[first].clear()


def extract(pages: list[str], align: bool = True) -> list[str]:
    """Main texts of a group of pages of one host; without ``align`` each page is judged by its marks alone."""
    trees = [parse(p) for p in pages]
    gone, told = induced(trees) if align else ([set() for _ in trees], [False] * len(trees))
    out = []
    for tree, constant, sure in zip(trees, gone, told, strict=True):
        held = list(_holders(tree))
        out.append("\n".join(blocks(held if held and not sure else [tree], constant, {id(x) for x in held}, _menus(tree) if sure else set())))
    return out


def _places(slots: list[Slot], names: Interned) -> dict[Slot, int]:
    """The tags down to each slot, as a number."""
    out: dict[Slot, int] = {}
    todo = [(s, 0) for s in reversed(slots)]
    while todo:
        s, above = todo.pop()
        out[s] = names.place(above, s.tag)
        todo += [(c, out[s]) for c in reversed(s.slots)]
    return out


def extract_pages(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """The main text of every page: ``page_id, url, text, n_chars``.

    pages: has ``page_id, url, html``; other columns are not read.  A null html counts as
    empty, a page without content has the text ''.  Pages with a null url, or one
    without a host, are one host.  Null and repeated page_ids are pages like any other.
    An empty table gives no rows.

    Hosts with more pages than a group are cut into groups by a hash of the row's number, so
    a group has about ``group`` pages whatever a host's share of them, copies of one row too.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host)
    hosts = stored(pages.groupBy("host").agg(F.ceil(F.count("*") / group).alias("groups")), "hosts")
    # tasks follow the number of groups, so that a task has the same work whatever the input
    tasks = max(parallelism(pages.sparkSession), (hosts.agg(F.sum("groups")).first()[0] or 0) // TASK)
    large = stored(hosts.filter("groups > 1"), "large")
    dealt = pages.withColumn("part", F.xxhash64(F.monotonically_increasing_id())).join(large, "host", "left").withColumn("part", F.pmod("part", F.coalesce("groups", F.lit(1))))
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            texts = extract([h[2] or "" for h in held])
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names)

        for batch in batches:
            for h, p, page, url, source in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if held and (h, p) != now:
                    yield close()
                    held = []
                now = h, p
                held.append((page, url, source))
        if held:
            yield close()

    dealt = dealt.repartition(tasks, "host", "part").sortWithinPartitions("host", "part", "page_id").select("host", "part", "page_id", "url", "html")
    return dealt.mapInArrow(run, "page_id long, url string, text string, n_chars long")
