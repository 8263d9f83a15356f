"""Main text of web pages by wrapper induction.

Pages of a host are parsed into DOM trees and aligned with one another as
wholes, by simple tree matching, before any name is looked at. A node that is
aligned with equal text in most of the host's pages is template. Where aligned
nodes differ in their children or the length of their text, the page has a
slot: the deepest node that holds most of what differs is the host's content
region. Constant nodes and region are the host's wrapper. A page's main text is
that of the region (of its article, where the region lies in one or holds one),
less constant nodes and page furniture.

Copies of a page are aligned once. The others are dealt to small groups within
their host by a hash, so a host that holds a third of all pages is aligned by
as many tasks as any other rows, and only block outlines (names and text
hashes), not pages, are shuffled.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import python_batches, send_package, table, written
from loomgraph.llm.url_filters import with_parts

#: Elements without content of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a page doesn't show as text.
UNSHOWN = frozenset("head title script style noscript template iframe object svg canvas math".split())
#: Elements whose text is never main text.
FURNITURE = UNSHOWN | frozenset("nav footer aside form button select option textarea input dialog menu".split())
#: Elements and roles whose text is no main text outside of the content, where they belong to the page.
PAGE_FURNITURE = frozenset(["header", "banner"])
#: Roles like elements of FURNITURE.
FURNITURE_ROLES = frozenset("navigation contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class or id that name page furniture, outside of the content.
FURNITURE_NAMES = frozenset("ad ads advert advertisement adverts banner sponsor sponsored promo cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe signup social share sharing related recommended sidebar widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager header footer masthead comment comments discussion disqus respond reply replies toolbar login search".split())
#: Words that beside such a word don't change its meaning, as in `site-header` or `ad-slot`.
NEUTRAL_NAMES = frozenset("site page main top left right bottom upper lower global primary secondary first last list area box bar wrap wrapper container section slot unit block item items link links button buttons post posts form inner outer content group row col column panel region id js".split())
#: Words at the end of a class that name adverts and readers' comments, in the content too.
FOREIGN_NAMES = frozenset("ad ads advert advertisement adverts sponsored comments disqus".split())
#: Words that, before such a word, tell of the element's state instead.
STATE_NAMES = frozenset("no has with without hide show is not".split())
#: A style that hides an element.
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Elements that hold the page or its content, whatever their class says.
HOLDERS = frozenset(["html", "body", "main", "article"])
#: Elements that end a block of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Which open elements an opening tag closes.
CLOSES = {**{t: frozenset(["p"]) for t in BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}}, "li": frozenset(["p", "li"]), "dt": frozenset(["p", "dt", "dd"]), "dd": frozenset(["p", "dt", "dd"]), "tr": frozenset(["p", "tr", "td", "th"]), "td": frozenset(["p", "td", "th"]), "th": frozenset(["p", "td", "th"]), "option": frozenset(["option"])}
#: Elements beyond which an implied end tag doesn't reach.
SCOPES = frozenset("article aside blockquote body button caption details dialog div dl fieldset figure footer form header html main menu nav ol section table td th ul".split())
#: Pages of a host that are aligned in one group, on average.
GROUP_PAGES = 16
#: Share of a host's aligned pages in which a node has equal text if it is template; as many pages without it are added as PRIOR_PAGES.
TEMPLATE_SHARE = 0.6
PRIOR_PAGES = 2
#: Share of what differs between a host's pages that its content region holds.
REGION_SHARE = 0.8
#: Share of aligned characters from which two pages are copies, which say nothing of the template.
COPY_SHARE = 0.5
#: Size of the table of a matching in memory; longer lists are halved, with equally good results.
CELLS = 250_000
#: Weight of a matched node, against that of equal subtrees.
PAIR = 4
#: Hosts up to which a table of them is broadcast; beyond it the join is left to Spark.
BROADCAST_HOSTS = 50_000
#: A comment, declaration or tag; quotes matter after `=` only, and only where they are closed.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)>|<[!?][^>]*>", re.S)
NAMED = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements whose content is not markup.
RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe")}
#: Those that run to the end of the page if they aren't closed.
ENDLESS = frozenset(["script", "style"])
#: Elements in which `/>` closes.
FOREIGN = ("svg", "math")


class Node:
    """An element or, as `#text`, a run of text. Furniture is 0, 1 (outside of the content) or 2 (everywhere)."""

    __slots__ = ("children", "furniture", "name", "text")

    def __init__(self, name: str, furniture: int = 0, text: str = ""):
        self.name, self.furniture, self.text, self.children = name, furniture, text, []


def _named(value: str) -> int:
    """2 if a word of a class ends in one for adverts or comments, 1 if it consists of furniture words, and neutral ones, alone."""
    found = 0
    for word in value.split():
        parts = [p for p in re.split(r"[^a-z]+", word) if p]
        if not parts or parts[0] in STATE_NAMES:
            continue
        if parts[-1] in FOREIGN_NAMES:
            return 2
        if FURNITURE_NAMES.intersection(parts) and FURNITURE_NAMES | NEUTRAL_NAMES >= set(parts):
            found = 1
    return found


def furnished(name: str, attributes: str) -> int:
    """Whether an element is page furniture by its name, role, class, id or style: 0 (no), 1 (outside of the content) or 2 (everywhere)."""
    if name in FURNITURE:
        return 2
    found = int(name in PAGE_FURNITURE)
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return found
    for key, *values in NAMED.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in FURNITURE_ROLES or key == "style" and HIDING.search(value):
            return 2
        if key == "role" and value in PAGE_FURNITURE:
            found = 1
        elif key in ("class", "id"):
            by_name = _named(value) if key == "class" else min(_named(value), 1)
            if by_name == 2 and name not in ("html", "body", "main"):
                return 2
            found = max(found, int(by_name > 0 and name not in HOLDERS))
    return found


class _Open:
    """The open elements of a page, with the places of each name and of scopes, so that no step searches them all."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.scopes = [root], {}, []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.nodes))
        if node.name in SCOPES:
            self.scopes.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            node = self.nodes.pop()
            self.places[node.name].pop()
            if node.name in SCOPES:
                self.scopes.pop()

    def end(self, tag: str) -> None:
        found = self.places.get(tag)
        if found and (tag in BLOCKS or not self.scopes or self.scopes[-1] <= found[-1]):
            self.cut(found[-1])

    def close(self, shut: frozenset[str]) -> None:
        """Ends what an opening tag implies: the innermost of one name, or all of several, up to the next other scope."""
        k = len(self.scopes)
        while k and self.nodes[self.scopes[k - 1]].name in shut:
            k -= 1
        scope = self.scopes[k - 1] if k else 0
        found = [places[-1 if len(shut) == 1 else bisect_right(places, scope)] for t in shut if (places := self.places.get(t)) and places[-1] > scope]
        if found:
            self.cut(min(found))


def parsed(html: str | None) -> Node:
    """The page's tree: implied end tags are added, unknown end tags skipped, raw-text elements and comments left out.

    Time grows with the length of the page, however bad its markup is.
    """
    root = Node("#root")
    open_, at, html = _Open(root), 0, html or ""
    end, unclosed = html.rfind(">") + 1, set()

    def words(text: str) -> None:
        if text:
            open_.nodes[-1].children.append(Node("#text", text=unescape(text) if "&" in text else text))

    while at < end and (m := TOKEN.search(html, at, end)):
        words(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            open_.end(tag)
            continue
        if tag in RAW:
            closer = None if tag in unclosed else RAW[tag].search(html, at)
            if closer is None:
                unclosed.add(tag)
            at = closer.end() if closer else len(html) if tag in ENDLESS else at
            continue
        if shut := CLOSES.get(tag):
            open_.close(shut)
        node = Node(tag, furnished(tag, m[3]))
        open_.nodes[-1].children.append(node)
        if tag not in VOID and not (m[3].endswith("/") and (tag in FOREIGN or any(open_.places.get(f) for f in FOREIGN))):
            open_.push(node)
    words(html[at:])
    return root


@lru_cache(maxsize=4096)
def _mark(name: str) -> int:
    return zlib.crc32(name.encode(errors="replace")) + 1


def below(path: int, name: str, nth: int = 0) -> int:
    """The 63-bit hash of the path to a child; the number among the children of its name counts, if given."""
    return (path * 1_000_003 + _mark(name) + nth * 7_368_787) & 0x7FFF_FFFF_FFFF_FFFF


def content(root: Node, region: int | None = None) -> tuple[Node, int, bool]:
    """The element that holds a page's content, the hash of its path by names, and whether it is known to hold nothing else.

    It is the region, if the page has it: the article around it, else the only
    article or main element in it, else the region itself. Without region, it is
    the page's only article, else its only main element, else the root.
    """
    hit, around = None, None
    named: dict[str, list[tuple[Node, int, bool]]] = {"article": [], "main": []}
    stack = [(root, 0, 0, defaultdict(int), None, False)]
    while stack:
        node, nth_path, path, counts, article, inside = stack.pop()
        if node.name in BLOCKS:
            counts[node.name] += 1
            nth_path, path, counts = below(nth_path, node.name, counts[node.name]), below(path, node.name), defaultdict(int)
            if node.name in named and not node.furniture:
                if node.name == "main" or article is None:
                    named[node.name].append((node, path, inside))
                if node.name == "article":
                    article = article or (node, path)
            if hit is None and nth_path == region:
                hit, around, inside = (node, path), article, True
        stack += [(c, nth_path, path, counts, article, inside) for c in reversed(node.children) if c.name != "#text" and c.name not in UNSHOWN]
    if around:
        return *around, True
    for name in ("article", "main"):
        found = [(n, p) for n, p, inside in named[name] if inside or hit is None]
        if len(found) == 1:
            return *found[0], name == "article"
    return (*hit, hit[0].name not in ("html", "body")) if hit else (root, 0, False)


def walked(top: Node, path: int = 0, furniture: int = 1) -> Iterator[tuple[int, list[str], int, str]]:
    """Blocks in page order: the levels that each shares with the block before it, its further levels, the hash of its path by names, its text.

    Elements of the given degree of furniture and above are left out; runs of
    white space are one space. Time and space grow with the page, however deep
    it is.
    """
    held: list[str] = []
    trail: list[str] = []
    low = 0

    def text_of() -> str:
        text = " ".join("".join(held).split())
        held.clear()
        return text

    stack: list[tuple[Node | None, int, dict]] = [(top, path, defaultdict(int))]
    while stack:
        node, path, counts = stack.pop()
        if node is not None and node.name == "#text":
            held.append(node.text)
        elif node is not None and node.name == "br":
            held.append(" ")
        elif node is None or node is top or node.furniture < furniture and node.name not in UNSHOWN:
            if (node is None or node.name in BLOCKS) and held and (text := text_of()):
                yield low, trail[low:], path, text
                low = len(trail)
            if node is None:
                trail.pop()
                low = min(low, len(trail))
                continue
            if node.name in BLOCKS:
                stack.append((None, path if node is top else below(path, node.name), counts))
                counts[node.name] += 1
                trail.append(f"{node.name}:{counts[node.name]}")
                path, counts = path if node is top else below(path, node.name), defaultdict(int)
            stack += [(c, path, counts) for c in reversed(node.children)]
    if text := text_of():
        yield low, trail[low:], path, text


def code(path: int, text: str) -> int:
    """A 63-bit hash of a block."""
    b = text.encode(errors="replace")
    return (zlib.crc32(b) << 31) ^ zlib.crc32(b[::-1], path & 0xFFFF_FFFF) ^ len(b)


def main_blocks(html: str | None, region: int | None = None, template: Sequence[int] = (), prior: bool = True) -> list[str]:
    """The blocks of a page's main text. Without the prior, no name of an element, class or id counts, but for elements that aren't shown."""
    if prior:
        top, path, sure = content(parsed(html), region)
    else:
        top, path, sure = _plain_region(parsed(html), region)
    known = frozenset(template)
    return [t for _, _, p, t in walked(top, path, 3 if not prior else 2 if sure else 1) if not known or code(p, t) not in known]


def _plain_region(root: Node, region: int | None) -> tuple[Node, int, bool]:
    """The region where the page has it, else the root."""
    stack = [(root, 0, 0, defaultdict(int))]
    while stack:
        node, nth_path, path, counts = stack.pop()
        if node.name in BLOCKS:
            counts[node.name] += 1
            nth_path, path, counts = below(nth_path, node.name, counts[node.name]), below(path, node.name), defaultdict(int)
            if nth_path == region:
                return node, path, True
        stack += [(c, nth_path, path, counts) for c in reversed(node.children) if c.name != "#text" and c.name not in UNSHOWN]
    return root, 0, False


class Outline:
    """A tree of a page's blocks: nodes by name, with the hash and length of the text of those that have any."""

    __slots__ = ("children", "code", "depth", "height", "name", "path", "shape", "size", "total", "tree")

    def __init__(self, name: str, path: int = 0, depth: int = 0):
        self.name, self.path, self.depth, self.children, self.code, self.size, self.height = name, path, depth, [], 0, 0, 0

    @classmethod
    def of(cls, keeps: list[int], fresh: list[str], codes: list[int], sizes: list[int]) -> Outline:
        root = cls("")
        open_ = [root]
        for keep, names, c, n in zip(keeps, fresh, codes, sizes, strict=True):
            del open_[keep + 1 :]
            for name, _, nth in (x.partition(":") for x in names.split("/")):
                above = open_[-1]
                node = cls(name, below(above.path, name, int(nth or 0)), above.depth + 1)
                above.children.append(node)
                if name:
                    open_.append(node)
            node.code, node.size = c, n
        order, stack = [], [root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += node.children
        for node in reversed(order):
            node.total = node.size + sum(c.total for c in node.children)
            node.height = 1 + max((c.height for c in node.children), default=0)
            node.shape = hash((node.name, *(c.shape for c in node.children)))
            node.tree = hash((node.name, node.code, *(c.tree for c in node.children)))
        return root


def _rows(value: Callable[[int], np.ndarray], rows: Sequence[int], columns: slice) -> np.ndarray:
    """Best scores of order-keeping matchings of the rows with the columns: of the first i rows, for all numbers of columns, in row i."""
    best = np.zeros((len(rows) + 1, len(value(rows[0])[columns]) + 1), np.int64)
    for i, r in enumerate(rows):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + value(r)[columns]))
    return best


def _last_row(value: Callable[[int], np.ndarray], rows: Sequence[int], columns: slice) -> np.ndarray:
    best = np.zeros(len(value(rows[0])[columns]) + 1, np.int64)
    for r in rows:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + value(r)[columns]))
    return best


def _way(value: Callable[[int], np.ndarray], rows: range, columns: range) -> list[tuple[int, int]]:
    """A best order-keeping matching of rows with columns; long lists are halved (Hirschberg's split), so memory stays bounded."""
    if not rows or not columns:
        return []
    ahead = slice(columns.start, columns.stop)
    if len(rows) * len(columns) > CELLS and len(rows) > 1:
        mid = rows.start + len(rows) // 2
        back = slice(columns.stop - 1, columns.start - 1 if columns.start else None, -1)
        k = int(np.argmax(_last_row(value, range(rows.start, mid), ahead) + _last_row(value, range(rows.stop - 1, mid - 1, -1), back)[::-1]))
        return _way(value, range(rows.start, mid), range(columns.start, columns.start + k)) + _way(value, range(mid, rows.stop), range(columns.start + k, columns.stop))
    best, out = _rows(value, rows, ahead), []
    i, j = len(rows), len(columns)
    while i and j:
        worth = value(rows[i - 1])[columns[j - 1]]
        if worth and best[i, j] == best[i - 1, j - 1] + worth:
            i, j = i - 1, j - 1
            out.append((rows[i], columns[j]))
        elif best[i, j] == best[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


class _Sizes(dict[tuple[int, int], int]):
    """The number of nodes in a largest top-down, order-keeping matching of two nodes.

    It depends on their shapes alone, so it is found once for each two shapes,
    when it is asked for, from the lowest trees up.
    """

    def of(self, a: Outline, b: Outline) -> int:
        if a.name != b.name:
            return 0
        if not a.children or not b.children:
            return 1
        if (a.shape, b.shape) not in self:
            self._fill(a, b)
        return self[a.shape, b.shape]

    def _fill(self, a: Outline, b: Outline) -> None:
        met, queue = {(a.shape, b.shape)}, [(a, b)]
        for x, y in queue:
            for c in {c.shape: c for c in x.children if c.children}.values():
                for d in {d.shape: d for d in y.children if d.children}.values():
                    if c.name == d.name and (c.shape, d.shape) not in met and (c.shape, d.shape) not in self:
                        met.add((c.shape, d.shape))
                        queue.append((c, d))
        for x, y in sorted(queue, key=lambda xy: xy[0].height):
            self[x.shape, y.shape] = 1 + int(_last_row(_values(x.children, y.children, self, texts=False), range(len(x.children)), slice(None))[-1])


def _values(u: list[Outline], v: list[Outline], sizes: _Sizes, texts: bool) -> Callable[[int], np.ndarray]:
    """The worth of matching a node of u with each node of v: the size, or PAIR times it and one more for equal subtrees."""
    kinds = {d.shape: d for d in v}
    place = {s: k for k, s in enumerate(kinds)}
    rows = {s: np.array([sizes.of(c, d) for d in kinds.values()], np.int64) for s, c in {c.shape: c for c in u}.items()}
    at = np.array([place[d.shape] for d in v])
    if not texts:
        return lambda i: rows[u[i].shape][at]
    trees = np.array([d.tree for d in v])

    def value(i: int) -> np.ndarray:
        got = rows[u[i].shape][at]
        return np.where(got > 0, PAIR * got + (trees == u[i].tree), 0)

    return value


def _paired(u: list[Outline], v: list[Outline], sizes: _Sizes) -> list[tuple[Outline, Outline]]:
    """A best matching of two lists of siblings.

    Nodes at either end whose name occurs once in each list can only be matched
    with one another, and stand in no other's way. Of leaves of one name without
    equal texts, any are as good: the last ones are taken.
    """
    ends: list[tuple[Outline, Outline]] = []
    once = Counter(c.name for c in u)
    once.update(d.name for d in v)
    i, j, m = 0, 0, len(u)
    n = len(v)
    while i < m and j < n and u[i].name == v[j].name and once[u[i].name] == 2:
        ends.append((u[i], v[j]))
        i, j = i + 1, j + 1
    while i < m and j < n and u[m - 1].name == v[n - 1].name and once[u[m - 1].name] == 2:
        m, n = m - 1, n - 1
        ends.append((u[m], v[n]))
    u, v = u[i:m], v[j:n]
    if not u or not v:
        return ends
    alike = len({c.name for c in u} | {d.name for d in v}) == 1 and (not any(c.children for c in u) or not any(d.children for d in v))
    if alike and {c.tree for c in u}.isdisjoint(d.tree for d in v):
        k = min(len(u), len(v))
        return ends + list(zip(u[-k:], v[-k:], strict=True))
    return ends + [(u[a], v[b]) for a, b in _way(_values(u, v, sizes, texts=True), range(len(u)), range(len(v)))]


def matched(a: Outline, b: Outline) -> list[tuple[Outline, Outline, int]]:
    """Pairs of nodes of a largest top-down, order-keeping matching of two trees (simple tree matching), and the place of each pair's parents in the list (-1: none).

    Of matchings of children, those with equal subtrees are preferred: a
    matched node counts PAIR, equal subtrees one more.
    """
    sizes = _Sizes()
    out = [(a, b, -1)]
    for k, (x, y, _) in enumerate(out):
        if x.children and y.children:
            out += [(c, d, k) for c, d in _paired(x.children, y.children, sizes)]
    return out


def differing(pairs: list[tuple[Outline, Outline, int]]) -> list[int]:
    """For each pair of nodes, the characters below them that have no counterpart: of nodes that aren't matched, and by which texts are longer."""
    common = [2 * min(x.size, y.size) for x, y, _ in pairs]
    for k in range(len(pairs) - 1, 0, -1):
        common[pairs[k][2]] += common[k]
    return [x.total + y.total - n for (x, y, _), n in zip(pairs, common, strict=True)]


OUTLINE = "struct<keeps:array<int>,fresh:array<string>,codes:array<bigint>,sizes:array<int>>"
OUTLINE_TYPE = pa.struct([("keeps", pa.list_(pa.int32())), ("fresh", pa.list_(pa.string())), ("codes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])


def outlined(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Outlines of whole pages, furniture included."""
    for array in pages:
        found = [list(walked(parsed(h), 0, 3)) for h in array.to_pylist()]
        yield pa.array([{"keeps": [k for k, *_ in x], "fresh": ["/".join(f) for _, f, *_ in x], "codes": [code(p, t) for *_, p, t in x], "sizes": [len(t) for *_, t in x]} for x in found], OUTLINE_TYPE)


def aligned(group: pa.Table) -> pa.Table:
    """What a group's pages tell, each aligned with the page after it in the order of hashes.

    Rows with a code tell in how many pages that block has equal text; rows with
    a path tell how much differs at and below that node; the row with neither
    counts the pages.
    """
    host = group.column("host")[0].as_py() if group.num_rows else ""
    group = group.sort_by("order_")
    trees = [Outline.of(o["keeps"], o["fresh"], o["codes"], o["sizes"]) for o in group.column("outline").to_pylist()]
    equal, loose = Counter(), Counter()
    pages = 0
    for i, tree in enumerate(trees if len(trees) > 1 else []):
        pairs = matched(tree, trees[(i + 1) % len(trees)])
        same = [x for x, y, _ in pairs if x.size and x.code == y.code]
        if sum(x.size for x in same) <= COPY_SHARE * sum(max(x.size, y.size) for x, y, _ in pairs):
            pages += 1
            equal.update({x.code for x in same})
            for (x, _, _), n in zip(pairs, differing(pairs), strict=True):
                loose[x.path, x.depth] += n
    rows = [(None, None, None, pages)] if pages else []
    rows += [(c, None, None, n) for c, n in equal.items()] + [(None, p, d, n) for (p, d), n in loose.items() if n]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
    return pa.table([pa.array([host] * len(rows), pa.string()), *columns], ["host", "code", "path", "depth", "n"])


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The wrapper of each host whose pages tell any: host, region (hash of the path to its content, or null), template (array of block hashes)."""
    send_package(pages.sparkSession)
    keyed = with_parts(pages.select(url, html), url).where(f"host <> '' and `{html}` <> ''").select("host", F.col(html).alias("html"), F.xxhash64(html).alias("order_"))
    large = keyed.select("host", "order_").distinct().groupBy("host").count().where(F.col("count") > GROUP_PAGES).select("host", F.ceil(F.col("count") / GROUP_PAGES).alias("groups_"))
    if large.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        large = F.broadcast(large)
    outlines = keyed.select("host", "order_", F.arrow_udf(OUTLINE)(outlined)("html").alias("outline"))
    single = outlines.groupBy("host", "order_").agg(F.first("outline").alias("outline"))  # copies have equal outlines
    dealt = single.join(large, "host", "left").withColumn("group_", F.pmod("order_", F.coalesce("groups_", F.lit(1))))
    found = dealt.select("host", "group_", "order_", "outline").groupBy("host", "group_").applyInArrow(aligned, "host string, code long, path long, depth int, n long")
    counted = written(found.groupBy("host", "code", "path", "depth").agg(F.sum("n").alias("n")), "alignments")
    all_ = F.sum(F.when(F.col("code").isNull() & F.col("path").isNull(), F.col("n")))
    totals = counted.groupBy("host").agg(all_.alias("pages_"), F.sum(F.when(F.col("depth") == 0, F.col("n"))).alias("loose_"))
    told = counted.join(totals, "host")
    constant = F.col("code").isNotNull() & (F.col("n") >= TEMPLATE_SHARE * (F.col("pages_") + PRIOR_PAGES))
    region = F.col("path").isNotNull() & (F.col("depth") > 0) & (F.col("n") >= REGION_SHARE * F.col("loose_"))
    deepest = F.max(F.when(region, F.struct("depth", "n", "path")))["path"]
    return told.where(constant | region).groupBy("host").agg(deepest.alias("region"), F.sort_array(F.collect_list(F.when(constant, F.col("code")))).alias("template"))


def unwrapped(rows: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for columns in rows:
        out = ["\n\n".join(main_blocks(h, r, t or (), prior)) for h, r, t, prior in zip(*(c.to_pylist() for c in columns), strict=True)]
        yield pa.array(out, pa.string())


def extracted(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text", prior: bool = True) -> DataFrame:
    """Adds the main text of each page: its blocks in page order, joined by two line feeds; empty if there is none.

    Null html counts as empty. A page without a host, or whose host has no
    other page that isn't a copy, has no wrapper: its only article or main
    element, or all of it, is the content, less furniture. Copies of a page are
    no evidence of a template. Without `prior`, the wrapper alone decides: no
    name of an element, class or id counts. Input columns called like the
    output are replaced.
    """
    with python_batches(pages.sparkSession, 256):
        found = written(wrappers(pages, url, html), "wrappers").withColumnRenamed("host", "host_of_template_")
    if found.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        found = F.broadcast(found)
    names = [c for c in pages.columns if c != out]
    whole = with_parts(pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row_"), F.col(f"`{url}`").alias("url_")), "url_")
    text = F.arrow_udf("string")(unwrapped)(F.col("row_")[html], F.col("region"), F.col("template"), F.lit(prior))
    joined = whole.join(found, whole["host"] == found["host_of_template_"], "left").select("row_", text.alias("text_"))
    return joined.select("row_.*", F.col("text_").alias(out))


def op6_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. An empty table gives an empty result; repeated rows give equal rows."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
