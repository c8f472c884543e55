"""Main text of web pages by wrapper induction.

The block elements of a page form a tree. The pages of a host are aligned with a page of
their own layout by simple tree matching (runs of like siblings count as one node, so lists
of any length align). Nodes whose text is the same on nearly all distinct pages of the
layout are its template; nodes whose text varies are slots. The main text is what stands in
slots, outside of elements that are navigation, advertising, forms or comments by name,
and inside the article where a page marks one that is none of these. An element that
contains that article is never dropped for its class.
"""

from __future__ import annotations

import functools
import hashlib
import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.session import stage

# Element and class names of the markup language.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
RAW = frozenset("script style noscript template iframe textarea title svg select option button object head xmp".split())
CLOSED_BY_BLOCK = "p"
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
LISTS = frozenset("ul ol menu dl table tbody thead tfoot".split())
ASIDE_TAGS = frozenset("nav footer aside form dialog menu search".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header "
    "masthead footer sidebar aside widget comment comments cookie cookies consent notice popup modal newsletter subscribe share sharing "
    "social related login signup contentinfo complementary search".split()
)
TOKEN = re.compile(r"<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
#: Elements that come and go with what a page says; a frame is a tree without them.
CONTENT = frozenset("address blockquote dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup li ol p pre summary ul".split())
DEPTH = 120
#: Words that tell an aside as a part of a class name, too (``post-comments``, ``cookie_banner``), unless the name speaks of a state.
PARTED = frozenset("ads advert adverts advertisement sponsored breadcrumb breadcrumbs comment comments cookie cookies consent newsletter related".split())
STATES = frozenset("no not without with has is hide hidden open closed enabled disabled count".split())
PART = re.compile(r"[a-z]+")


@functools.lru_cache(maxsize=65_536)
def _names_aside(name: str) -> bool:
    parts = frozenset(PART.findall(name))
    return name in ASIDE_WORDS or bool(parts & PARTED and not parts & STATES)


@dataclass(frozen=True)
class Wrapper:
    """A node is template if ``least`` distinct pages match it and its text is equal on ``share`` of them.

    A layout of ``least`` distinct pages has a reference of its own.

    Wrappers of all hosts travel to every task if they take ``broadcast_bytes`` at most;
    otherwise pages are joined with them by host.
    """

    least: int = 5
    share: float = 0.9
    broadcast_bytes: int = 32 << 20


@dataclass
class Node:
    label: str
    aside: bool
    named: bool
    article: bool
    children: list["Node"] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)
    parts: list["Node"] = field(default_factory=list)


#: White space that is not one blank.
ODD_SPACE = re.compile(r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+")


def _space(text: str) -> str:
    return ODD_SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip(" ")


def parse(page: str) -> Node:
    """Tree of block elements; every block of text has its number in page order."""
    root = Node("", False, False, False)
    stack = [root]
    tags = [""]
    buffer: list[str] = []
    number = 0

    def flush() -> None:
        nonlocal number
        if buffer:
            text = _space("".join(buffer))
            if text:
                stack[-1].blocks.append((number, text))
                number += 1
            buffer.clear()

    def close(at: int) -> None:
        flush()
        del tags[at:]
        del stack[at:]

    position, low, last, extra = 0, "", page.rfind(">"), 0
    while True:
        found = TOKEN.search(page, position) if position <= last else None
        if found is None:
            buffer.append(page[position:])
            break
        buffer.append(page[position:found.start()])
        position = found.end()
        if found[0] == "<!--":
            end = page.find("-->", position)
            position = len(page) if end < 0 else end + 3
            continue
        if found[2] is None:
            continue
        tag = found[2].lower()
        if tag in RAW:
            if not found[1] and tag != "head" and not found[3].endswith("/"):
                low = low or page.lower()
                end = low.find(f"</{tag}", position)
                if end >= 0:
                    stop = page.find(">", end)
                    position = len(page) if stop < 0 else stop + 1
                elif tag in ("script", "style"):
                    position = len(page)
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag not in BLOCK:
            continue
        if extra:
            # Elements too deep for a node of their own only end blocks.
            flush()
            extra += -1 if found[1] else tag not in ("p", "hr", *SIBLINGS)
            continue
        if found[1]:
            if tag in tags:
                close(len(tags) - 1 - tags[::-1].index(tag))
            else:
                flush()
            continue
        flush()
        if CLOSED_BY_BLOCK in tags:
            close(len(tags) - 1 - tags[::-1].index(CLOSED_BY_BLOCK))
        for k in range(len(tags) - 1, 0, -1):
            if tags[k] in SIBLINGS.get(tag, ()):
                close(k)
            elif tags[k] in LISTS or tag not in SIBLINGS:
                break
        if tag == "hr":
            continue
        names = [next(x for x in m.groups() if x is not None) for m in ATTRIBUTE.finditer(found[3])] if "=" in found[3] else []
        words = set(" ".join(names).lower().split())
        inside = any(n.article for n in stack)
        node = Node(
            " ".join([tag, *sorted(words)]),
            tag in ASIDE_TAGS or (tag == "header" and not inside),
            tag not in ("body", "html", "main") and any(map(_names_aside, words)),
            tag in ("article", "main"),
        )
        if len(tags) > DEPTH:
            extra = 1
            continue
        tags.append(tag)
        stack[-1].children.append(node)
        stack.append(node)
    flush()
    return root


def fold(node: Node) -> Node:
    """The same tree with runs of siblings of one label folded into one node, blocks included."""
    folded: list[Node] = []
    for child in node.children:
        if folded and folded[-1].label == child.label:
            folded[-1].parts.append(child)
        else:
            folded.append(Node(child.label, child.aside, child.named, child.article, parts=[child]))
    for run in folded:
        merged = Node(run.label, run.aside, run.named, run.article, [c for p in run.parts for c in p.children], [b for p in run.parts for b in p.blocks])
        inner = fold(merged)
        run.children, run.blocks, run.parts = inner.children, inner.blocks, []
    return Node(node.label, node.aside, node.named, node.article, folded, node.blocks)


def listed(root: Node) -> list[Node]:
    """All nodes of a tree, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children))
    return out


class _Matcher:
    """Simple tree matching: the size of the largest order-keeping match of two trees, and its pairs.

    A match depends on the shapes of subtrees alone (labels and order), so shapes are
    numbered and each two are compared once, however often they occur. Tables of child
    lists are computed row by row; of a large one only every so many rows are held, and the
    rest are computed again on the way back, so memory grows with the lists and not with
    their product.
    """

    #: Shapes of other trees that are remembered beside the reference's own.
    REMEMBERED = 4_000

    def __init__(self, reference: Node) -> None:
        self.reference = reference
        self._begin()

    def _begin(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.labels: list[str] = []
        self.below: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.known: dict[tuple[int, int], int] = {}
        self.mine = self._shapes(self.reference)
        self.full = len(self.labels) + self.REMEMBERED

    def _shapes(self, root: Node) -> dict[int, int]:
        """Numbers of the shapes of all subtrees, by node."""
        shape: dict[int, int] = {}
        numbers = self.numbers
        for node in reversed(listed(root)):  # children first
            own = tuple([shape[id(c)] for c in node.children])
            number = numbers.setdefault((node.label, own), len(self.labels))
            if number == len(self.labels):
                self.labels.append(node.label)
                self.below.append(own)
                self.sizes.append(1 + sum([self.sizes[k] for k in own]))
            shape[id(node)] = number
        return shape

    def align(self, page: Node) -> list[tuple[Node, Node]]:
        """Pairs of matched nodes of the reference and a page."""
        if len(self.labels) > self.full or len(self.known) > self.full:
            self._begin()
        self.theirs = self._shapes(page)
        out, todo = [], [(self.reference, page)]
        while todo:
            a, b = todo.pop()
            out.append((a, b))
            if a.children and b.children:
                like = self.mine[id(a)] == self.theirs[id(b)]
                todo.extend(zip(a.children, b.children) if like else self.pairs(a, b))
        return out

    def size(self, a: int, b: int) -> int:
        """Of the largest match of two shapes whose roots are matched."""
        if a == b:
            return self.sizes[a]
        if (a, b) not in self.known:
            left, right, _ = self._untied(self.below[a], self.below[b])
            tail = sum(self.sizes[k] for k in self.below[a][len(left):])
            row = np.zeros(len(right) + 1, np.int64)
            if len(left) and len(right):
                gains, x, y = self._gains(left, right)
                for i in range(len(left)):
                    row = self._next(row, gains[x[i], y])
            self.known[a, b] = 1 + tail + int(row[-1])
        return self.known[a, b]

    @staticmethod
    def _untied(left: tuple[int, ...], right: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...], int]:
        """Two lists without their common end: like subtrees at the end match in a largest match."""
        tied = 0
        for a, b in zip(reversed(left), reversed(right)):
            if a != b:
                break
            tied += 1
        return left[:len(left) - tied], right[:len(right) - tied], tied

    def _gains(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What matching two children gives, by distinct shapes; 0 under different labels."""
        (ours, x), (theirs, y) = np.unique(left, return_inverse=True), np.unique(right, return_inverse=True)
        table = np.zeros((len(ours), len(theirs)), np.int64)
        by_label: dict[str, list[int]] = {}
        for j, b in enumerate(theirs.tolist()):
            by_label.setdefault(self.labels[b], []).append(j)
        for i, a in enumerate(ours.tolist()):
            for j in by_label.get(self.labels[a], ()):
                table[i, j] = self.size(a, int(theirs[j]))
        return table, x, y

    @staticmethod
    def _next(row: np.ndarray, gain: np.ndarray) -> np.ndarray:
        out = np.zeros_like(row)
        np.maximum.accumulate(np.maximum(row[1:], row[:-1] + gain), out=out[1:])
        return out

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """Matched children of two matched nodes."""
        left, right, tied = self._untied(self.below[self.mine[id(a)]], self.below[self.theirs[id(b)]])
        n, m = len(left), len(right)
        out = [(a.children[n + k], b.children[m + k]) for k in reversed(range(tied))]
        if not (n and m):
            return out[::-1]
        gains, x, y = self._gains(left, right)
        step = math.isqrt(n) + 1
        held, row = [np.zeros(m + 1, np.int64)], np.zeros(m + 1, np.int64)
        for i in range(n):
            row = self._next(row, gains[x[i], y])
            if (i + 1) % step == 0:
                held.append(row)
        i, j, first, rows = n, m, n + 1, []
        while i and j:
            if i - 1 < first:
                first = (i - 1) // step * step
                rows = [held[first // step]]
                for k in range(first, min(first + step, n)):
                    rows.append(self._next(rows[-1], gains[x[k], y]))
            here, above = rows[i - first], rows[i - 1 - first]
            gain = gains[x[i - 1], y[j - 1]]
            if gain and here[j] == above[j - 1] + gain:
                out.append((a.children[i - 1], b.children[j - 1]))
                i, j = i - 1, j - 1
            elif here[j] == above[j]:
                i -= 1
            else:
                j -= 1
        return out[::-1]


def align(reference: Node, page: Node) -> list[tuple[Node, Node]]:
    """Pairs of matched nodes of two folded trees."""
    return _Matcher(reference).align(page)


def _own_text(node: Node) -> str:
    return "\n".join(t for _, t in node.blocks)


def _code(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def layout(tree: Node) -> tuple[int, int, int]:
    """Digests of a folded tree's labels and of its frame's labels, and the number of its nodes."""
    nodes = 0

    def written(node: Node) -> tuple[str, str]:
        nonlocal nodes
        nodes += 1
        below = [written(c) for c in node.children]
        inner = "".join(x for _, x in below)
        whole = f"<{node.label}{''.join(x for x, _ in below)}>"
        return whole, inner if node.label.partition(" ")[0] in CONTENT else f"<{node.label}{inner}>"

    whole, frame = written(tree)
    return _code(whole), _code(frame), nodes


@functools.lru_cache(maxsize=256)
def _wrapper(reference: str) -> tuple[_Matcher, dict[int, tuple[int, str]]]:
    """The matcher of a reference page, and number and text of its nodes."""
    tree = fold(parse(reference))
    return _Matcher(tree), {id(n): (i, _own_text(n)) for i, n in enumerate(listed(tree))}


def _has(node: Node, wanted) -> bool:
    """Whether a node outside of the asides below ``node``, or itself, is wanted."""
    return wanted(node) or any(_has(c, wanted) for c in node.children if not (c.aside or c.named))


def _chosen(tree: Node) -> dict[int, Node]:
    """The articles that hold the main text, and what contains them.

    These are the articles outside asides, and every ``main`` that is in none by its tag.
    Without them, an article that has the class of an aside or is inside one is taken only
    if the page has its only first-level heading there, or has no text outside asides.
    """
    clear: list[list[Node]] = []
    doubtful: list[list[Node]] = []
    headings: list[Node] = []
    todo: list[tuple[list[Node], bool]] = [([tree], False)]
    while todo:
        path, named = todo.pop()
        node = path[-1]
        if node.label.partition(" ")[0] == "h1":
            headings.append(node)
        if node.aside:
            # Headings in there count; a form may hold a whole page.
            if node.label.partition(" ")[0] != "form":
                headings += [n for n in listed(node)[1:] if n.label.partition(" ")[0] == "h1"]
                continue
            named = True
        named = named or node.named
        if node.article and _has(node, lambda n: bool(n.blocks)):
            (doubtful if named and not node.label.startswith("main") else clear).append(path)
        todo.extend((path + [c], named) for c in node.children)
    if not clear and doubtful:
        top = {id(n) for n in headings}
        headed = [p for p in doubtful if any(id(n) in top for n in listed(p[-1]))]
        if headed and top <= {id(n) for p in headed for n in listed(p[-1])}:
            clear = headed
        elif not _has(tree, lambda n: bool(n.blocks)):
            clear = doubtful
    return {id(n): n for p in clear for n in p}


def candidates(tree: Node) -> list[tuple[int, Node, str]]:
    """Number, node and text of the blocks outside asides, inside the chosen articles if there are any."""
    kept = _chosen(tree)
    found: list[tuple[int, Node, str]] = []
    todo = [(tree, False)]
    while todo:
        node, inside = todo.pop()
        if (node.aside or node.named) and id(node) not in kept:
            continue
        inside = inside or (node.article and id(node) in kept)
        if inside or not kept:
            found += [(number, node, text) for number, text in node.blocks]
        todo.extend((c, inside) for c in node.children)
    return sorted(found, key=lambda f: f[0])


def _digest(found: list[tuple[int, Node, str]]) -> bytes:
    return hashlib.blake2b("\n".join(text for _, _, text in found).encode(), digest_size=16).digest()


def slots(page: str, reference: str | None) -> tuple[bytes, list[int], list[tuple[int, str]]]:
    """Digest of a page's candidate blocks, state of each reference node, and those blocks.

    Navigation, adverts and what else surrounds an article are not in the digest, so copies
    of an article are one page for the template whatever surrounds them.
    States: 0 no match, 1 matched with other text or none, 2 matched with equal text.
    A block is (number of the reference node or -1, text).
    """
    tree = fold(parse(page))
    known: dict[int, int] = {}
    states: list[int] = []
    if reference is not None:
        wrapper, numbers = _wrapper(reference)
        states = [0] * len(numbers)
        for a, b in wrapper.align(tree):
            number, own = numbers[id(a)]
            known[id(b)] = number
            states[number] = 2 if own and own == _own_text(b) else 1
    found = candidates(tree)
    return _digest(found), states, [(known.get(id(node), -1), text) for _, node, text in found]


def _layouts_of(pages: DataFrame, last: str) -> DataFrame:
    """Adds layout, frame, nodes and digest, null for pages without candidate blocks, to columns that end in html."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for page in batch.column(batch.num_columns - 1).to_pylist():
                tree = fold(parse(page))
                found = candidates(tree)
                made.append((*layout(tree), _digest(found)) if found else (None, None, None, None))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array([m[k] for m in made], kinds[k]) for k in range(4))],
                names=[*batch.schema.names, "layout", "frame", "nodes", "digest"],
            )

    return pages.mapInArrow(run, f"{last}, layout long, frame long, nodes int, digest binary")


def _slots_of(pages: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [slots(page, reference) for page, reference in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:4], pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.list_(pa.int32())),
                pa.array(
                    [[{"node": n, "text": t} for n, t in m[2]] for m in made], pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())])),
                ),
            ], names=["page_id", "url", "host", "ref", "digest", "states", "blocks"])

    return pages.mapInArrow(
        run, f"page_id {kind}, url string, host string, ref long, digest binary, states array<int>, blocks array<struct<node:int,text:string>>",
    )


def _beside(pages: DataFrame, table: DataFrame, keys: list[str], width, wrapper: Wrapper, how: str = "left") -> DataFrame:
    """Join by the keys; the table, of ``width`` bytes a row, travels to every task only if it was measured to be small."""
    size = table.agg(F.coalesce(F.sum(width + F.octet_length("host") + 64), F.lit(0))).first()[0]
    return pages.join(F.broadcast(table) if size <= wrapper.broadcast_bytes else table, keys, how)


def _references(rows: DataFrame, wrapper: Wrapper) -> tuple[DataFrame, DataFrame]:
    """(host, layout, ref): the layout whose reference each layout is aligned with; (host, ref, model): the references.

    A layout of ``least`` distinct pages has its own; a rarer one takes the most frequent of
    its frame, or of the host if the whole frame is rare. Pages without candidate blocks are no references.
    """
    keyed = rows.select("host", F.xxhash64("html").alias("page"), "html")
    seen = _layouts_of(keyed, "host string, page long, html string").where("layout is not null")
    layouts = stage(
        seen.groupBy("host", "frame", "layout", "digest").agg(F.min("page").alias("page"), F.max("nodes").alias("nodes"))
        .groupBy("host", "frame", "layout").agg(F.count(F.lit(1)).alias("n"), F.max("nodes").alias("nodes"), F.min("page").alias("page")),
        "layouts",
    )
    most = F.max(F.struct("n", "nodes", "layout"))
    frames = layouts.groupBy("host", "frame").agg(most.alias("of_frame"), F.sum("n").alias("total"))
    hosts = layouts.groupBy("host").agg(most.alias("of_host"))
    assigned = stage(layouts.join(frames, ["host", "frame"]).join(hosts, "host").select(
        "host", "layout", F.when(F.col("n") >= wrapper.least, F.col("layout")).when(F.col("total") >= wrapper.least, F.col("of_frame.layout"))
        .otherwise(F.col("of_host.layout")).alias("ref"),
    ), "assigned")
    wanted = stage(
        layouts.select("host", F.col("layout").alias("ref"), "page").join(assigned.select("host", "ref").distinct(), ["host", "ref"], "left_semi"), "wanted",
    )
    found = _beside(keyed, wanted, ["host", "page"], F.lit(16), wrapper, "inner")
    return assigned, stage(found.groupBy("host", "ref").agg(F.min("html").alias("model")), "models")


def main_text(
    pages: DataFrame, wrapper: Wrapper = Wrapper(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """One row per page: page_id, url, text (blocks joined by an empty line) and n_chars.

    Null and empty pages give an empty text, null urls share the empty host, repeated
    pages count once for the template and are extracted one by one, an empty table gives
    no rows. Hosts of fewer than ``least`` distinct pages have no template; their pages
    still lose what is no content by name. Markup may be cut off anywhere.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    kind = dict(rows.dtypes)["page_id"]
    assigned, models = _references(rows, wrapper)
    laid = _layouts_of(rows, f"page_id {kind}, url string, host string, html string").drop("frame", "nodes", "digest")
    joined = _beside(laid, assigned, ["host", "layout"], F.lit(16), wrapper)
    joined = _beside(joined, models, ["host", "ref"], F.octet_length("model"), wrapper).select("page_id", "url", "host", "ref", "html", "model")
    found = stage(_slots_of(joined, kind), "slots")
    distinct = found.groupBy("host", "ref", "digest").agg(F.min("states").alias("states"))
    nodes = distinct.select("host", "ref", F.posexplode("states").alias("node", "state")).groupBy("host", "ref", "node").agg(
        F.count_if(F.col("state") > 0).alias("matched"), F.count_if(F.col("state") == 2).alias("equal"),
    )
    constant = nodes.where((F.col("matched") >= wrapper.least) & (F.col("equal") >= wrapper.share * F.col("matched")))
    templates = stage(constant.groupBy("host", "ref").agg(F.collect_list("node").alias("fixed")), "templates")
    free = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("fixed", b["node"]), F.lit(False)))
    text = F.array_join(F.transform(free, lambda b: b["text"]), "\n\n")
    return _beside(found, templates, ["host", "ref"], F.size("fixed") * 4, wrapper).select("page_id", "url", text.alias("text")).withColumn(
        "n_chars", F.length("text").cast("long"),
    )
