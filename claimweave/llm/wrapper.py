"""Operator 2: main text of HTML pages by wrapper induction.

Up to ``PAGES`` distinct pages of each host, chosen by a hash, are parsed into DOM trees and aligned one
after the other by simple tree matching: the heaviest matching of nodes that keeps parents and order,
siblings being told apart by what is in them (their subtrees, equal texts, texts of like length); only
paragraphs, list items and table cells in a row, and runs of more than ``RUN`` like siblings, count as one
repeated node. What is aligned becomes the host's frame, which says which nodes of its pages are the same
slot. Then every page of the host is aligned with the frame (a node that the frame lacks is a slot by
its path), and all distinct pages together decide about the slots:

* A text is template if ``SUPPORT`` pages and nine in ten of those that have its slot have that very text there.
* A slot is a menu if most of its text, over all pages, is inside links.
* The main region is found from the root down: the child that holds ``MASS`` of the text that is neither
  template nor linked is entered as long as there is one (down to, and not into, runs of paragraphs).

The content of a page is its text in the main region that is neither template nor menu, in page order,
with a headline (``h1``) before the region if the region has none. This needs no element names and no
classes. Names and classes are hints where the pages decide nothing: on hosts of fewer than ``SUPPORT``
pages, in pages that lack the region, and for marked elements inside a region (``BOILERPLATE``,
``SECTIONS``); a region that is wider than a page's ``article`` or ``main`` is narrowed to these. In
paragraphs and headings a class counts only if it is such a word, not if it merely holds one; an element
that holds the main element or headline is never dropped for its class, nor is a form that holds these or
half of the text, or a ``header`` in the main element. Templates never remove all text of a page.

Pages per host that make the frame are bounded, and the counts are added up on the map side by slot and
text, so the largest host is no large group; wrappers are broadcast only if they are counted and small,
else joined, the pages of a host being dealt to several tasks.

Cases: null or empty html gives an empty text; elements may be nested to any depth; broken or truncated markup is closed as a browser
would (unclosed elements end with their parent); a null url is a host of its own; html without
elements is text; repeated pages each get a row and count once; other columns are not read.
"""

from __future__ import annotations

import html as entities
import pickle
import re
from hashlib import blake2b
from collections import Counter
from collections.abc import Callable, Generator, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimweave.llm.common import salted, small, starts, table, written

#: Pages of a host that its frame is made from, and least pages that decide about a slot.
PAGES, SUPPORT = 8, 5
#: Like siblings in a row that are told apart; share of a node's free text that makes a child the main region.
RUN, MASS = 16, 0.8
#: Pages of a host that meet a copy of its wrapper, if wrappers are too large to broadcast.
SPREAD = 5000
#: Most bytes and rows of all wrappers together that are broadcast.
BROADCAST_BYTES = 32 << 20

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset("head script style noscript template textarea title button select input option label iframe svg canvas object".split())
SECTIONS = frozenset("nav footer aside header menu dialog form".split())
REPEATED = frozenset("p li tr td th dt dd".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th".split())
MAIN = frozenset(["article", "main"])
CLOSES_P = BLOCKS - {"body", "html", "option", "optgroup", "legend", "li", "dd", "dt", "tbody", "td", "tfoot", "th", "thead", "tr", "summary"}
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Words in a class, id or role that mark boilerplate.
BOILERPLATE = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu modal nav navbar navigation newsletter notice popup promo promoted related replies reply share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget contentinfo complementary search".split()
)

_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)(?:>|$)", re.S)
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_MARKED = re.compile(r"class|id|role", re.I)
_WORDS = re.compile(r"[a-z]+")


class Node:
    """An element with its children: nodes, and texts as they stand."""

    __slots__ = ("children", "mark", "name")

    def __init__(self, name: str, mark: str = "") -> None:
        self.name, self.mark, self.children = name, mark, []

    @property
    def key(self) -> tuple[str, str]:
        return self.name, self.mark


def parse(page: str | None) -> Node:
    """DOM tree of a page; never fails."""
    root = Node("#page")
    stack, at, page = [root], 0, page or ""
    opened = Counter()  # open elements by name: end tags of others cost nothing
    end = len(page)
    while at < end:
        tag = _TAG.search(page, at)
        if not tag:
            break
        if tag.start() > at:
            stack[-1].children.append(page[at : tag.start()])
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if tag[1]:  # end tag: up to the element it closes, if it is open
            _close(stack, opened, {name}, frozenset())
            continue
        if name in CLOSES_P:
            _close(stack, opened, {"p"}, MAIN | {"div", "section", "td", "th", "button", "object", "#page"})
        if name in SIBLINGS:
            _close(stack, opened, SIBLINGS[name], SCOPES[name] | {"#page"})
        mark = " ".join(a or b or c for a, b, c in _MARK.findall(tag[3])).lower() if tag[3] and _MARKED.search(tag[3]) else ""
        node = Node(name, mark)
        stack[-1].children.append(node)
        if name in RAW:
            stop = re.compile(f"</{re.escape(name)}[^>]*(?:>|$)", re.I).search(page, at)
            node.children.append(page[at : stop.start() if stop else end])
            at = stop.end() if stop else end
        elif name not in VOID and not tag[3].endswith("/"):
            stack.append(node)
            opened[name] += 1
    if at < end:
        stack[-1].children.append(page[at:])
    return root


def _close(stack: list[Node], opened: Counter, names: set[str], scope: frozenset[str] | set[str]) -> None:
    """End the nearest open element of one of these names within its scope, and what is open in it."""
    if not any(opened[n] for n in names):
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in names:
            opened.subtract(n.name for n in stack[i:])
            del stack[i:]
            return
        if stack[i].name in scope:
            return


def marked(node: Node) -> bool:
    """Boilerplate by class, id or role."""
    if not node.mark:
        return False
    words = node.mark.split() if node.name in FLOW else _WORDS.findall(node.mark)
    return not BOILERPLATE.isdisjoint(words)


def blocks(node: Node) -> list[list]:
    """A block element's own flow: runs of inline content (lists of texts) and the block elements between them."""
    out: list = []
    run: list[tuple[str, bool]] = []
    open_ = [(iter(node.children), node.name == "a")]
    while open_:
        children, links = open_[-1]
        child = next(children, None)
        if child is None:
            open_.pop()
        elif isinstance(child, str):
            run.append((child, links))
        elif child.name in BLOCKS or child.name in HIDDEN or child.name in SECTIONS or child.name in RAW:
            if run:
                out.append(run)
                run = []
            out.append(child)
        elif child.name == "br" or child.name == "img":
            run.append((" ", links))
        elif not marked(child):
            open_.append((iter(child.children), links or child.name == "a"))
    if run:
        out.append(run)
    return out


def clean(run: list[tuple[str, bool]]) -> str:
    text = run[0][0] if len(run) == 1 else "".join([t for t, _ in run])
    return " ".join((entities.unescape(text) if "&" in text else text).split())


class Slot:
    """A node of a frame: like elements of all aligned pages. Runs of text are slots named '#text', with the texts seen and their mean size."""

    __slots__ = ("children", "key", "size", "texts")

    def __init__(self, key: tuple[str, str], texts: Iterable[int] = (), size: float = 0.0) -> None:
        self.key, self.children, self.texts, self.size = key, [], set(texts), size


class Wrapper:
    """A host's frame, and what its pages say about slots: hashes of template texts, menus, and the main region."""

    __slots__ = ("fixed", "frame", "menus", "region")

    def __init__(self, frame: Slot | None, fixed: Iterable[int] = (), menus: Iterable[int] = (), region: int | None = None) -> None:
        self.frame, self.fixed, self.menus, self.region = frame, frozenset(fixed), frozenset(menus), region


class Tree:
    """A page's node for alignment. groups: its parts by key, several only in repeated nodes. size, linked: letters below it,
    and inside links; holds: an h1, article or main is in it; hint: boilerplate by name or class."""

    __slots__ = ("groups", "hint", "holds", "key", "linked", "run", "size", "text")

    def __init__(self, node: Node | None, run: list | None = None) -> None:
        self.run, self.groups, self.text = run, [], clean(run) if run else ""
        self.size, self.linked = len(self.text), sum(len(t) for t, link in run if link) if run else 0
        self.key = ("#text", "") if node is None else (node.name, _shape(node.mark) if node.mark else "")
        self.hint = node is not None and (node.name in SECTIONS or marked(node))
        self.holds = node is not None and (node.name == "h1" or node.name in MAIN)


def grown(top: Node) -> Tree:
    """The tree of an element and all that is in it but what is never shown."""
    trees = [(Tree(top), top)]
    for tree, node in trees:  # grows; parents come before their children
        parts = []
        for part in blocks(node):
            if isinstance(part, Node):
                if part.name not in HIDDEN and part.name not in RAW:
                    child = Tree(part)
                    trees.append((child, part))
                    parts.append(child)
            elif (child := Tree(None, part)).text:
                parts.append(child)
        at = 0
        while at < len(parts):
            upto, key = at + 1, parts[at].key
            while upto < len(parts) and parts[upto].key == key:
                upto += 1
            if key[0] in REPEATED or key[0] == "#text" or upto - at > RUN:
                tree.groups.append((key, parts[at:upto]))
            else:
                tree.groups += [(key, [part]) for part in parts[at:upto]]
            at = upto
    for tree, _ in reversed(trees):
        for _, like in tree.groups:
            for part in like:
                tree.size += part.size
                tree.linked += part.linked
                tree.holds = tree.holds or part.holds and part.key[0] not in SECTIONS
    whole = trees[0][0].size
    for tree, node in trees:
        if tree.hint and (tree.holds and node.name not in SECTIONS or node.name == "form" and (tree.holds or 2 * tree.size > whole)):
            tree.hint = False
    return trees[0][0]


def _shape(mark: str) -> str:
    """Class, id and role without digits, so that numbered elements are alike."""
    return re.sub(r"\d+", "0", mark)


def _run(call: Generator) -> object:
    """The result of a generator that yields the calls it makes: recursion to any depth."""
    calls, value = [call], None
    while calls:
        try:
            deeper = calls[-1].send(value)
        except StopIteration as done:
            calls.pop()
            value = done.value
        else:
            calls.append(deeper)
            value = None
    return value


def _alike(slot: Slot, tree: Tree) -> float:
    """What a run of text adds to a matching: more if the slot has had that text, or texts of like length."""
    return 1.0 + (_hash(tree.text) in slot.texts) + 0.5 * (0.25 <= (tree.size + 1) / (slot.size + 1) <= 4)


def _weight(slot: Slot, tree: Tree, known: dict[tuple[int, int], float]) -> Generator:
    """Weight of the simple tree matching between a frame's node and an element."""
    at = id(slot), id(tree)
    if at not in known:
        total = _alike(slot, tree) if tree.run is not None else 1.0
        for i, j in (yield _match(slot.children, tree.groups, known)):
            total += yield _weight(slot.children[i], tree.groups[j][1][0], known)
        known[at] = total
    return known[at]


def match(slots: list[Slot], groups: list[tuple], known: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """Pairs of the heaviest order-keeping matching of equal keys; ``known`` keeps weights of one page."""
    return _run(_match(slots, groups, known))


def _match(slots: list[Slot], groups: list[tuple], known: dict[tuple[int, int], float]) -> Generator:
    n, m = len(slots), len(groups)
    if n == m and len({s.key for s in slots}) == n and all(s.key == g[0] for s, g in zip(slots, groups, strict=True)):
        return [(i, i) for i in range(n)]  # nothing to choose from
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    own = {}
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1])
            if slots[i].key == groups[j][0]:
                own[i, j] = yield _weight(slots[i], groups[j][1][0], known)  # the first of a repeated node
                best[i][j] = max(best[i][j], own[i, j] + best[i + 1][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if (i, j) in own and best[i][j] == own[i, j] + best[i + 1][j + 1]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def _learn(slot: Slot, trees: list[Tree], known: dict[tuple[int, int], float]) -> Generator:
    """Align like siblings of one page with a frame's node, and widen it by what it lacks."""
    for tree in trees:
        if tree.run is not None:
            slot.size = (slot.size * len(slot.texts) + tree.size) / (len(slot.texts) + 1)
            slot.texts.add(_hash(tree.text))
        pairs = yield _match(slot.children, tree.groups, known)
        at = {j: slot.children[i] for i, j in pairs}
        where = 0
        for j, (key, like) in enumerate(tree.groups):
            if j in at:
                child = at[j]
                where = next(k for k, c in enumerate(slot.children) if c is child) + 1
            else:
                child = Slot(key)
                slot.children.insert(where, child)
                where += 1
            yield _learn(child, like, known)


def induce(pages: list[str | None]) -> Slot:
    """The frame of pages of one host."""
    root = Slot(("#page", ""))
    for page in pages:
        _run(_learn(root, [grown(parse(page))], {}))
    return root


def packed(frame: Slot) -> bytes:
    """A frame as bytes: the parent's number, key, texts and size of each node."""
    nodes, rows = [frame], [(0, frame.key, (), 0.0)]
    for at, node in enumerate(nodes):  # grows
        nodes += node.children
        rows += [(at, child.key, sorted(child.texts), child.size) for child in node.children]
    return pickle.dumps(rows)


def unpacked(data: bytes) -> Slot:
    rows = pickle.loads(data)
    nodes = [Slot(*row[1:]) for row in rows]
    for row, node in zip(rows[1:], nodes[1:], strict=True):
        nodes[row[0]].children.append(node)
    return nodes[0]


def region_of(frame: Slot, masses: dict[int, float]) -> int:
    """The slot of the main region, from the free text of the slots of runs; names only tip the scale."""
    nodes = [(frame, 0, None)]
    for node, own, _ in nodes:  # grows
        nodes += [(child, _hash(own, i), own) for i, child in enumerate(node.children)]
    total: dict[int, float] = {}
    for node, own, above in reversed(nodes):
        name, mark = node.key
        hint = 2.0 if name in MAIN else 0.25 if name in SECTIONS or mark and marked(Node(name, mark)) else 1.0
        total[own] = max(0.0, total.get(own, 0.0) + masses.get(own, 0.0)) * hint
        if above is not None:
            total[above] = total.get(above, 0.0) + total[own]
    node, own = frame, 0
    while True:
        inner = [(total[_hash(own, i)], i) for i, child in enumerate(node.children) if any(c.key[0] != "#text" for c in child.children) and child.key[0] not in REPEATED]
        most, i = max(inner, default=(0.0, -1))
        if most <= 0 or most < MASS * sum(total[_hash(own, i)] for i in range(len(node.children))):
            return own
        node, own = node.children[i], _hash(own, i)


def _hash(*parts: object) -> int:
    """A number other than 0 for these parts."""
    return int.from_bytes(blake2b(repr(parts).encode("utf-8", "backslashreplace"), digest_size=8).digest(), "little", signed=True) or 1


class Text(NamedTuple):
    """A run of text of a page: its slot, and where it lies."""

    text: str
    slot: int
    main: bool
    region: bool
    menu: bool
    hint: bool
    head: bool


class Seen(NamedTuple):
    """A slot of a page: letters, those inside links, whether it is a run of text, in the frame, and repeated."""

    size: int
    linked: int
    leaf: bool
    framed: bool
    many: bool


def placed(page: str | None, wrapper: Wrapper) -> tuple[list[Text], dict[int, Seen]]:
    """The texts and the slots of a page, aligned with a frame."""
    texts: list[Text] = []
    slots: dict[int, Seen] = {}
    known: dict[tuple[int, int], float] = {}
    todo = [(grown(parse(page)), wrapper.frame, 0, False, wrapper.region == 0, False, False, False)]
    while todo:
        tree, slot, name, main, region, menu, hint, head = todo.pop()
        if tree.run is not None:
            texts.append(Text(tree.text, name, main, region, menu, hint, head))
            continue
        main = main or tree.key[0] in MAIN and not hint
        pairs = {j: i for i, j in match(slot.children, tree.groups, known)} if slot else {}
        seen: dict[tuple[str, str], int] = {}
        below = []
        for j, (key, like) in enumerate(tree.groups):
            i = pairs.get(j)
            if i is None:  # not in the frame: a slot by its path
                seen[key] = seen.get(key, 0) + 1
                child, own = None, _hash(name, key, seen[key])
            else:
                child, own = slot.children[i], _hash(name, i)
            old = slots.get(own, Seen(0, 0, key[0] == "#text", child is not None, False))
            slots[own] = Seen(old.size + sum([t.size for t in like]), old.linked + sum([t.linked for t in like]), old.leaf, old.framed, old.many or len(like) > 1)
            inside, links = region or own == wrapper.region, menu or own in wrapper.menus
            for t in like:
                marks = t.hint and not (key[0] == "header" and (main or inside))
                below.append((t, child, own, main, inside, links, hint or marks, head or key[0] == "h1"))
        todo += reversed(below)
    return texts, slots


def extract(page: str | None, wrapper: Wrapper | None) -> str:
    """Main text of a page by its host's wrapper, or by names and classes alone: one line a block."""
    wrapper = wrapper or Wrapper(None)
    texts, _ = placed(page, wrapper)
    free = lambda t: not t.menu and (not wrapper.fixed or _hash(t.slot, t.text) not in wrapper.fixed)
    shown = [t for t in texts if not t.hint]
    pool = [t for t in shown if t.region]
    if pool:
        if any(t.main for t in pool) and not all(t.main for t in pool):
            pool = [t for t in pool if t.main]
        if not any(t.head for t in pool):
            first = next(i for i, t in enumerate(shown) if t is pool[0])
            pool = [t for t in shown[:first] if t.head and free(t)] + pool
    else:
        pool = [t for t in shown if t.main] or shown
    return "\n".join(t.text for t in [t for t in pool if free(t)] or pool)


def _inducer() -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def of_host(key: tuple, pages: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "frame": [packed(induce(pages.sort_values("place")["html"].tolist()))]})

    return of_host


def host_of(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#]*)", 1))


def frames(pages: DataFrame, per_host: int = PAGES) -> DataFrame:
    """host, frame of pages (host, place, html), from at most ``per_host`` distinct pages of each host."""
    # Only hashes of pages are shuffled to choose, and copies of a page are combined on the map side.
    rank = F.row_number().over(W.partitionBy("host").orderBy("place"))
    few = pages.select("host", "place").distinct().withColumn("rank", rank).where(F.col("rank") <= per_host).select("host", "place")
    chosen = pages.select("host", "place", "html").join(small(written(few, "places")), ["host", "place"])
    return chosen.groupBy("host", "place").agg(F.first("html").alias("html")).groupBy("host").applyInPandas(_inducer(), "host string, frame binary")


def _known(shipped: object | None, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[Wrapper]]]:
    """Batches, and the wrapper of each row."""
    known: dict[str, Wrapper] = {}
    for batch in batches:
        out = []
        for i, host in enumerate(batch["host"]):
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                frame, fixed, menus, region = shipped.value[host] if shipped is not None else [batch[c].iloc[i] for c in ("frame", "fixed", "menus", "region")]
                known[host] = Wrapper(unpacked(frame), fixed, menus, None if pd.isna(region) else int(region))
            out.append(known[host])
        yield batch, out


def _gatherer(shipped: object | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["host", "slot", "text", "place", "size", "linked", "leaf", "framed", "many"]
        for batch, wrappers in _known(shipped, batches):
            rows = []
            for host, place, page, wrapper in zip(batch["host"], batch["place"], batch["html"], wrappers, strict=True):
                texts, slots = placed(page, wrapper)
                rows.append((host, 0, 0, place, 0, 0, False, True, False))
                rows += [(host, slot, 0, place, *seen) for slot, seen in slots.items()]
                rows += [(host, slot, _hash(slot, text), place, len(text), 0, True, slots[slot].framed if slot in slots else False, False) for slot, text in {(t.slot, t.text) for t in texts}]
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return gathered


def _extractor(shipped: object | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, wrappers in _known(shipped, batches):
            out = [extract(page, wrapper) for page, wrapper in zip(batch["html"], wrappers, strict=True)]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": out, "n_chars": [len(t) for t in out]})

    return texts


def _ship(pages: DataFrame, wrappers: DataFrame) -> tuple[object | None, DataFrame]:
    """Wrappers (host, frame, fixed, menus, region) as a broadcast if they are small, else joined to the pages."""
    size = F.length("frame") + F.length("host") + 8 * (F.size("fixed") + F.size("menus"))
    if wrappers.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] > BROADCAST_BYTES:
        return None, salted(pages, wrappers, "host", "place", SPREAD)
    found = {r.host: (bytes(r.frame), list(r.fixed), list(r.menus), r.region) for r in wrappers.toLocalIterator()}
    return pages.sparkSession.sparkContext.broadcast(found), pages


def wrappers(pages: DataFrame) -> DataFrame:
    """host, frame, fixed, menus, region of pages (host, place, html): frames, and what all distinct pages have in their slots."""
    none = F.array().cast("array<long>")
    framed = written(frames(pages), "frames")
    shipped, hosted = _ship(pages, framed.select("host", "frame", none.alias("fixed"), none.alias("menus"), F.lit(None).cast("long").alias("region")))
    found = hosted.mapInPandas(_gatherer(shipped), "host string, slot long, text long, place long, size long, linked long, leaf boolean, framed boolean, many boolean")
    flags = [F.max(c).alias(c) for c in ("leaf", "framed", "many")]
    each = found.groupBy("host", "slot", "text", "place").agg(F.max("size").alias("size"), F.max("linked").alias("linked"), *flags)
    counts = each.groupBy("host", "slot", "text").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("linked").alias("linked"), *flags)
    counts = written(counts.where((F.col("text") == 0) | (F.col("n") >= SUPPORT)), "counts")
    whole = counts.where("text = 0")
    menu = whole.where((F.col("linked") > 0.6 * F.col("size")) & ~F.col("leaf") & (F.col("many") | (F.col("n") >= SUPPORT)))
    fixed = counts.where("text <> 0").join(whole.select("host", "slot", F.col("n").alias("pages")), ["host", "slot"]).where(10 * F.col("n") >= 9 * F.col("pages"))
    fixed = written(fixed.select("host", "slot", "text", "size", "framed"), "fixed")
    marks = fixed.select("host", F.col("text").alias("fixed"), F.lit(None).cast("long").alias("menu")).unionByName(
        menu.select("host", F.lit(None).cast("long").alias("fixed"), F.col("slot").alias("menu"))
    )
    marks = marks.groupBy("host").agg(F.collect_set("fixed").alias("fixed"), F.collect_set("menu").alias("menus"))
    # Free text of the frame's slots: as many as the frame has, so a host's list is bounded.
    free = whole.where("leaf and framed").select("host", "slot", (F.col("size") - F.col("linked")).alias("free")).unionByName(fixed.where("framed").select("host", "slot", (-F.col("size")).alias("free")))
    free = free.groupBy("host", "slot").agg(F.sum("free").alias("free")).groupBy("host").agg(F.collect_list("slot").alias("slots"), F.collect_list("free").alias("free"))
    decided = whole.where((F.col("slot") == 0) & (F.col("n") >= SUPPORT)).select("host")

    @F.pandas_udf("long")
    def region(frame: pd.Series, slots: pd.Series, free: pd.Series) -> pd.Series:
        return pd.Series([region_of(unpacked(f), dict(zip(s, m, strict=True))) for f, s, m in zip(frame, slots, free, strict=True)], dtype="int64")

    regions = framed.join(free, "host").join(decided, "host", "left_semi").select("host", region("frame", "slots", "free").alias("region"))
    out = framed.join(marks, "host", "left").join(regions, "host", "left")
    return out.select("host", "frame", F.coalesce("fixed", none).alias("fixed"), F.coalesce("menus", none).alias("menus"), "region")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html)."""
    starts(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of().alias("host"), F.xxhash64("html").alias("place"))
    shipped, hosted = _ship(pages, written(wrappers(pages), "wrappers"))
    return hosted.mapInPandas(_extractor(shipped), "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
