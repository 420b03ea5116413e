"""Main text of web pages by wrapper induction.

A host's wrapper is one tree: up to ``MODELS`` of its pages are aligned one after the other by simple tree matching, and
what a page has beyond the tree so far is put in where it stands. Then every page of the host is aligned with the wrapper
and votes: text slots that read the same on nearly all pages are template, and article containers that hold most of the
varying text are the host's main nodes. A page's text is what stands in its main nodes, less template slots, less what
tags, roles and names mark as menus, headers, footers, sidebars, notices, adverts, forms or comments. Names that may as well
be those of an article's sections (``DOUBTFUL_NAMES``) mark nothing inside the article: there the votes alone decide, so
that what varies from page to page stays. Only a page that the host's main nodes say nothing about goes by its own article
or main element.
"""

from __future__ import annotations

import html as entities
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import spread

from .common import table, tidied, written
from .urls import host_and_path

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Fixed values of HTML: elements whose content is no markup, without content, and within lines of text.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr br img".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Elements, roles and name parts of what is not the article.
ASIDE_TAGS = set("nav footer aside form button select dialog svg head object canvas template menu fieldset datalist audio video".split())
ASIDE_ROLES = set("navigation contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_NAMES = set(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside rail footer foot colophon copyright legal ad ads adv "
    "advert adverts advertisement advertising advertorial adsense adbox adslot sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login search searchbox form comment "
    "comments commentlist commentary respond reply replies discussion disqus feedback share sharing social related recommended recommendations trending pagination pager "
    "paging toolbar widget widgets skip disclaimer privacy teaser teasers outbrain taboola".split()
)
#: Of these the ones that name a part of the text as well; and beginnings of names that adverts are known by.
DOUBTFUL_NAMES = set(
    "discussion alert legal copyright privacy disclaimer feedback response promotion banner banners aside foot colophon".split()
)
ADVERT_NAMES = ("adsby", "adslot", "adunit", "adsense", "adchoice")
HEAD_TAGS, HEAD_ROLES, HEAD_NAMES = {"header"}, {"banner"}, set("header masthead topbar topnav top".split())
MAIN_NAMES = set("article main content post entry story".split())
#: Parts that make a name tell of the layout (``has-sidebar``) instead of the element's own role.
STATE_NAMES = {"has", "with", "no", "without", "is", "js", "wrap", "wrapper", "layout"}
#: Parts that may stand beside a role's name (``blog-sidebar``, ``comment-list``); with any other the name tells a topic.
PLACE_NAMES = set(
    "site blog page post entry article main content list section box area block container inner outer left right top bottom primary secondary "
    "global link links bar item items text body title group row col column slot unit module panel count icon button buttons zone wide small large".split()
)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Pages that a host's wrapper is built from, and the expected share of pages that read alike above which a slot is template.
MODELS, SHARE = 8, 0.9
#: What is held of a slot before its pages are seen, as pages that read alike and pages that don't: outside the main nodes
#: most that stands on several pages is template, inside hardly anything is.
PRIOR_OUTSIDE, PRIOR_INSIDE = (1.5, 0.5), (0.5, 2.0)


class Node:
    """A block element, or (tag ``#text``) a run of text and inline elements inside one."""

    __slots__ = ("tag", "name", "kids", "text", "links", "side", "main", "slot", "shape", "size", "texts")

    def __init__(self, tag: str, name: str = "", side: bool = False, main: int = 0, text: str = ""):
        self.tag, self.name, self.side, self.main = tag, name, side, main
        self.kids: list[Node] = []
        self.text, self.links, self.slot, self.shape, self.size, self.texts = text, 0, -1, 0, 1, None


def _marks(tag: str, attrs: str, inside_main: bool) -> tuple[str, bool, int]:
    """Name for matching, whether the element is beside the article, and its rank as the article's container."""
    side = tag in ASIDE_TAGS or (tag in HEAD_TAGS and not inside_main)
    main = 3 if tag == "article" else 2 if tag == "main" else 0
    name = ""
    if attrs and not attrs.isspace():
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attrs)}
        name = f"{found.get('id', '')}.{found.get('class', '')}" if "id" in found or "class" in found else ""
        role = found.get("role", "").lower()
        side = side or role in ASIDE_ROLES or (role in HEAD_ROLES and not inside_main) or "hidden" in found or found.get("aria-hidden") == "true"
        side = side or "display:none" in found.get("style", "").replace(" ", "").lower()
        if name and not side and tag not in ("html", "body", "main"):
            tokens = [{p.lower() for p in NAME_PARTS.findall(token)} for token in name.replace(".", " ").split()]
            roles = [token for token in tokens if not token & STATE_NAMES]
            asides = ASIDE_NAMES - DOUBTFUL_NAMES if inside_main else ASIDE_NAMES
            side = any(token & asides and token <= ASIDE_NAMES | PLACE_NAMES or any(p.startswith(ADVERT_NAMES) for p in token) for token in roles)
            side = side and not (tag == "article" and not set().union(*roles) & {"ad", "ads", "advert", "promo", "comment", "related", "sponsored", "teaser"})
            side = side or (not inside_main and any(token & HEAD_NAMES and token <= HEAD_NAMES | PLACE_NAMES and not token & MAIN_NAMES for token in roles))
        if role in ("main", "article"):
            main = max(main, 2)
    return name, side, main


def parse(source: str | None) -> Node:
    """The tree of block elements of a page, however broken; scripts, styles, comments and the head hold no text."""
    root = Node("#root")
    stack, mains = [root], 0
    words: list[str] = []
    links = linked = 0
    src = source or ""

    def flush() -> None:
        nonlocal links
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            if text:
                leaf = Node("#text")
                leaf.text, leaf.links = text, links
                stack[-1].kids.append(leaf)
            words.clear()
        links = 0

    def pop_to(n: int) -> None:
        nonlocal mains
        flush()
        while len(stack) > n:
            mains -= stack.pop().main > 0

    at, end = 0, len(src)
    while at < end:
        m = TAG.search(src, at)
        stop = m.start() if m else end
        if stop > at:
            words.append(src[at:stop])
            if linked:
                links += stop - at
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        closing = m[1] == "/"
        if closing:
            if tag in INLINE:
                if tag == "a":
                    linked = 0
                continue
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == tag:
                    pop_to(n)
                    break
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(src, at)
            at = close.end() if close else end
            continue
        if tag in INLINE:
            if tag == "a":
                linked = 1
            elif tag in ("br", "img", "wbr"):
                words.append(" " if tag != "wbr" else "")
            continue
        if tag in VOID:
            flush()
            continue
        flush()
        if tag not in CLOSED_BY:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == "p":
                    pop_to(n)
                    break
                if stack[n].tag not in ("#text",):
                    break
        else:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag in CLOSED_BY[tag]:
                    pop_to(n)
                    break
                if stack[n].tag in LISTS[tag]:
                    break
        name, side, main = _marks(tag, m[3], mains > 0)
        node = Node(tag, name, side, main)
        stack[-1].kids.append(node)
        if not m[3].endswith("/") or tag not in ("svg",):
            stack.append(node)
            mains += main > 0
    flush()
    _number(root)
    return root


def _order(root: Node) -> list[Node]:
    """All nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(reversed(node.kids))
    return order


def _number(root: Node) -> list[Node]:
    """Nodes in page order, numbered; sizes and shapes bottom up, shapes equal for trees of equal tags and names."""
    order = _order(root)
    for i, node in enumerate(order):
        node.slot = i
    for node in reversed(order):
        node.shape = hash((node.tag, node.name, tuple(k.shape for k in node.kids)))
        node.size = 1 + sum(k.size for k in node.kids)
    return order


class Matching:
    """The best simple tree matching of two trees: equal nodes, ancestors and order kept, as many pairs as can be.

    Exact at every size and depth: values of pairs of subtrees are kept by shape and found with a list of what is still
    to do, lists of children are aligned row by row, and pairs are read back by halving, in memory linear in the lists.
    Time grows with the product of the lists' lengths after equal ends are taken off.
    """

    def __init__(self):
        self.known: dict[tuple[int, int], int] = {}

    @staticmethod
    def trimmed(xs: list[Node], ys: list[Node]) -> tuple[int, int, int]:
        """Length of the equal start, and where the rests end. A best matching pairs equal ends."""
        lo, n, m = 0, len(xs), len(ys)
        while lo < min(n, m) and xs[lo].shape == ys[lo].shape:
            lo += 1
        while n > lo and m > lo and xs[n - 1].shape == ys[m - 1].shape:
            n, m = n - 1, m - 1
        return lo, n, m

    def value(self, x: Node, y: Node) -> int | None:
        """Pairs in the best matching of two subtrees with their roots paired, None if not known yet."""
        if x.tag != y.tag or x.name != y.name:
            return 0
        if x.shape == y.shape:
            return x.size
        if not x.kids or not y.kids:
            return 1
        return self.known.get((x.shape, y.shape))

    def table(self, xs: list[Node], ys: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values by kind of child, and the kinds of both lists; finds those that are not known first."""
        kinds = [{n.shape: n for n in side} for side in (xs, ys)]
        todo = [(x, y) for x in kinds[0].values() for y in kinds[1].values() if self.value(x, y) is None]
        while todo:
            x, y = todo[-1]
            if self.value(x, y) is not None:
                todo.pop()
                continue
            lo, n, m = self.trimmed(x.kids, y.kids)
            p, q = x.kids[lo:n], y.kids[lo:m]
            own = [{k.shape: k for k in side} for side in (p, q)]
            missing = [(a, b) for a in own[0].values() for b in own[1].values() if self.value(a, b) is None]
            if missing:
                todo += missing
                continue
            ends = sum(k.size for k in x.kids[:lo]) + sum(k.size for k in x.kids[n:])
            self.known[x.shape, y.shape] = 1 + ends + (int(_last_row(*self._values(p, q, own))[-1]) if p and q else 0)
        return self._values(xs, ys, kinds)

    def _values(self, xs: list[Node], ys: list[Node], kinds: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grid = np.array([[self.value(x, y) for y in kinds[1].values()] for x in kinds[0].values()], dtype=np.int64)
        number = [{shape: i for i, shape in enumerate(k)} for k in kinds]
        return grid, np.array([number[0][x.shape] for x in xs]), np.array([number[1][y.shape] for y in ys])

    def children(self, xs: list[Node], ys: list[Node]) -> list[tuple[int, int]]:
        """Places of the children that the best matching of two lists pairs."""
        lo, n, m = self.trimmed(xs, ys)
        pairs = [(i, i) for i in range(lo)]
        if n > lo and m > lo:
            grid, p, q = self.table(xs[lo:n], ys[lo:m])
            todo = [(0, n - lo, 0, m - lo)]
            while todo:
                a, b, c, d = todo.pop()
                if a == b or c == d:
                    continue
                if b - a == 1:
                    values = grid[p[a], q[c:d]]
                    if values.max() > 0:
                        pairs.append((lo + a, lo + c + int(values.argmax())))
                    continue
                half = (a + b) // 2
                before = _last_row(grid, p[a:half], q[c:d])
                after = _last_row(grid, p[half:b][::-1], q[c:d][::-1])[::-1]
                cut = c + int((before + after).argmax())
                todo += [(a, half, c, cut), (half, b, cut, d)]
        pairs += [(n + i, m + i) for i in range(len(xs) - n)]
        return sorted(pairs)

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """All pairs of nodes below two roots, the roots included."""
        out, todo = [], [(a, b)]
        while todo:
            x, y = todo.pop()
            out.append((x, y))
            if x.kids and y.kids:
                todo += [(x.kids[i], y.kids[j]) for i, j in self.children(x.kids, y.kids)]
        return out


def _last_row(grid: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Best value of aligning all of one list with every beginning of the other."""
    row = np.zeros(len(q) + 1, dtype=np.int64)
    for x in p:
        row[1:] = np.maximum(row[1:], row[:-1] + grid[x, q])
        row = np.maximum.accumulate(row)
    return row


def wrapper(pages: list[str | None]) -> Node:
    """One tree that the pages' trees are laid into; a text slot holds the text that most of them have there."""
    root = parse(None)
    for page in pages:
        tree, matching = parse(page), Matching()
        for x, y in matching.pairs(tree, root):
            if x.tag == "#text":
                y.texts.update([x.text])
                continue
            partner, kids, j = dict(matching.children(x.kids, y.kids)), [], 0
            for i, kid in enumerate(x.kids):
                if i in partner:
                    kids += y.kids[j : partner[i] + 1]
                    j = partner[i] + 1
                else:
                    for node in _order(kid):
                        node.texts = Counter([node.text]) if node.tag == "#text" else None
                    kids.append(kid)
            y.kids = kids + y.kids[j:]
        _number(root)
    for node in _order(root):
        if node.tag == "#text":
            node.text = max(sorted(node.texts), key=node.texts.get)
    return root


def packed(root: Node) -> bytes:
    return pickle.dumps([(n.tag, n.name, n.side, n.main, n.text, len(n.kids)) for n in _order(root)])


def unpacked(data: bytes) -> Node:
    rows = pickle.loads(data)
    nodes = [Node(*r[:5]) for r in rows]
    open_: list[list] = []
    for node, row in zip(nodes, rows, strict=True):
        while open_ and not open_[-1][1]:
            open_.pop()
        if open_:
            open_[-1][0].kids.append(node)
            open_[-1][1] -= 1
        open_.append([node, row[5]])
    _number(nodes[0])
    return nodes[0]


def _inside(root: Node, starts) -> list[Node]:
    """Unmarked text slots in page order below the unmarked nodes for which ``starts`` holds."""
    out, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        if node.side:
            continue
        inside = inside or starts(node)
        if node.tag == "#text":
            if inside:
                out.append(node)
            continue
        todo.extend((k, inside) for k in reversed(node.kids))
    return out


def content(root: Node) -> list[Node]:
    """Text slots of the article by the page alone: of the outermost article, else main, else all that is beside nothing.

    Without either container, lists that hold nothing but links are left out as menus.
    """
    rank, stack = 0, [root]
    while stack:
        node = stack.pop()
        if node.side:
            continue
        if node.main > rank and _has_text(node):
            rank = node.main
        stack.extend(node.kids)
    if rank:
        return _inside(root, lambda node: node.main == rank)
    menus = {id(x) for node in _order(root) if node.tag in ("ul", "ol", "menu") and _linked(node) for x in _order(node)}
    return [x for x in _inside(root, lambda node: True) if id(x) not in menus]


def _has_text(node: Node) -> bool:
    stack = [node]
    while stack:
        x = stack.pop()
        if x.side:
            continue
        if x.tag == "#text":
            return True
        stack.extend(x.kids)
    return False


def _linked(node: Node) -> bool:
    leaves = [x for x in _order(node) if x.text]
    return bool(leaves) and all(x.links >= len(x.text) for x in leaves)


@dataclass
class Model:
    """A host's wrapper with what its pages voted: slots that are template, and main nodes."""

    root: Node
    fixed: frozenset[int]
    mains: frozenset[int]

    def text_of(self, page: str | None) -> list[str]:
        tree = parse(page)
        pairs = Matching().pairs(tree, self.root)
        fixed = {id(x) for x, y in pairs if y.slot in self.fixed and x.text == y.text}
        mains = {id(x) for x, y in pairs if y.slot in self.mains and not x.side}
        names = {(y.tag, y.name) for y in _order(self.root) if y.slot in self.mains}
        slots = _inside(tree, lambda n: id(n) in mains or (n.tag, n.name) in names) if mains else []
        return [x.text for x in slots or content(tree) if id(x) not in fixed]


class Models:
    """The models of the hosts that a task has met of late, and trees of their wrappers."""

    def __init__(self, read, most: int = 200):
        self.read, self.most, self.held = read, most, {}

    def of(self, host: str, *data):
        if host not in self.held:
            if len(self.held) >= self.most:
                self.held.clear()
            self.held[host] = self.read(*data)
        return self.held[host]


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with html compressed row by row: half of its bytes as shuffled, and less than a shuffle's own blocks save."""
    pack = zstandard.ZstdCompressor()
    for batch in batches:
        at = batch.schema.get_field_index("html")
        rows = [pack.compress(v.as_buffer()) if v.is_valid else None for v in batch.column(at)]
        columns = [pa.array(rows, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def _page(data: bytes | None) -> str | None:
    return None if data is None else zstandard.decompress(data).decode()


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, node, seen, same, chars): pages with a wrapper's node, with its text, and unmarked characters below it."""
    models = Models(unpacked)
    for batch in batches:
        sums = [Counter(), Counter(), Counter()]
        for host, page, data in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            tree = parse(_page(page))
            pairs = Matching().pairs(tree, models.of(host, data))
            chars, order = {}, _order(tree)
            for node in reversed(order):
                chars[id(node)] = 0 if node.side else len(node.text) + sum(chars[id(k)] for k in node.kids)
            slots = {id(n) for n in content(tree)}
            # A page that says all that the wrapper says is the page it was built from, or a copy: no vote on template.
            copy = all(x.text == y.text for x, y in pairs if id(x) in slots)
            for x, y in pairs:
                sums[2][host, y.slot] += chars[id(x)]
                if x.tag == "#text" and not copy:
                    sums[0][host, y.slot] += 1
                    sums[1][host, y.slot] += x.text == y.text
        keys = list(sums[2])
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32())]
        columns += [pa.array([c[k] for k in keys], pa.int64()) for c in sums]
        yield pa.RecordBatch.from_arrays(columns, ["host", "node", "seen", "same", "chars"])


def _elected(data: bytes, votes: list[dict], share: float) -> Model:
    """The model that a wrapper's votes make: template are slots whose posterior mean share of pages that read alike is
    ``share`` or more, by a beta prior that depends on where they stand."""
    root = unpacked(data)
    chars = {v["node"]: v["chars"] for v in votes}

    def template(mains: frozenset[int]) -> frozenset[int]:
        inside = {x.slot for x in _inside(root, lambda n: n.slot in mains)} if mains else set()
        priors = {v["node"]: PRIOR_INSIDE if v["node"] in inside else PRIOR_OUTSIDE for v in votes if v["seen"]}
        return frozenset(v["node"] for v in votes if v["seen"] and v["same"] + priors[v["node"]][0] >= share * (v["seen"] + sum(priors[v["node"]])) - 1e-9)

    # Of articles, else of mains: the outermost unmarked ones, if they hold at least half of what is beside nothing.
    for rank in (3, 2):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.side:
                continue
            if node.main == rank:
                found.append(node.slot)
            else:
                todo.extend(node.kids)
        if found and 2 * sum(chars.get(n, 0) for n in found) >= chars.get(root.slot, 0) > 0:
            return Model(root, template(frozenset(found)), frozenset(found))
    return Model(root, template(frozenset()), frozenset())


def extract_text(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", share: float = SHARE
) -> DataFrame:
    """(page_id, url, text) of every page; blocks are joined by a newline, text is empty where nothing is left.

    A slot belongs to the template if by the votes of its pages, copies of the wrapper's pages left out, and a prior it is
    expected to read the same on ``share`` of them: outside the main nodes three such pages that agree suffice, inside it
    takes eighteen; a page that reads otherwise keeps its own text in either case. Pages without a host go by themselves. Null html has no text. Rows that repeat an id are pages of their own. Extra columns are left out, an
    empty table gives an empty one. Wrappers join by host: Spark sends small tables to all tasks and splits hot hosts.
    """
    src = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_and_path(F.col(url))[0].alias("host"))
    kind = src.schema["page_id"].dataType.simpleString()
    usable = src.where("host <> '' and html is not null")
    # One page of each of so many hash classes, so that no host's pages come together.
    chosen = usable.groupBy("host", F.pmod(F.xxhash64("page_id"), F.lit(MODELS)).alias("part")).agg(F.min("page_id").alias("page_id"))
    # Written first: the size of its files is known then, and where it is small Spark need not shuffle html to find it.
    chosen = written(chosen.select("host", "page_id"))
    chosen = usable.join(chosen, ["host", "page_id"]).dropDuplicates(["host", "page_id"]).select("host", "page_id", "html")

    def build(pdf):
        pdf = pdf.sort_values("page_id")
        return pdf.head(1)[["host"]].assign(wrapper=[packed(wrapper(pdf["html"].tolist()))])

    wrappers = written(chosen.groupBy("host").applyInPandas(build, "host string, wrapper binary"))
    # What travels to the wrappers and back is compressed.
    src = src.mapInArrow(tidied(_zipped), f"page_id {kind}, url string, html binary, host string")
    usable = src.where("host <> '' and html is not null")
    votes = usable.join(wrappers, "host").select("host", "html", "wrapper").mapInArrow(tidied(_votes), "host string, node int, seen long, same long, chars long")
    votes = votes.groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in ("seen", "same", "chars")])
    # A wrapper has as many nodes as the pages that it is built from.
    votes = votes.groupBy("host").agg(F.collect_list(F.struct("node", "seen", "same", "chars")).alias("votes"))
    joined = src.join(written(wrappers.join(votes, "host")), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = Models(lambda data, votes: _elected(data, votes, share))
        for batch in batches:
            names = batch.schema.names
            texts = []
            for host, page, data, votes in zip(*(batch.column(names.index(n)) for n in ("host", "html", "wrapper", "votes")), strict=True):
                host, page = host.as_py(), _page(page.as_py())
                if not data.is_valid:
                    texts.append("\n".join(x.text for x in content(parse(page))))
                    continue
                model = models.held.get(host) or models.of(host, data.as_py(), votes.as_py())
                texts.append("\n".join(model.text_of(page)))
            columns = [batch.column(names.index("page_id")), batch.column(names.index("url")), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text"])

    return joined.mapInArrow(tidied(run), f"page_id {kind}, url string, text string")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))).withColumn("n_chars", F.length("text").cast("long"))
