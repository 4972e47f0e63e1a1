"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host.

A page becomes a stream of block tags and text, inline markup left out. Repetitions in the stream are folded into
repeated groups, which leaves few different structures per host. The structures of a host are aligned one after the other:
tags that match are merged, runs that repeat become repeated groups, what only some pages have becomes optional, and text
becomes a place for text. In the wrapper that results every place is inside or outside the main region, by the tags and names
around it. The texts of all pages are then compared place by place: where they differ the place is a slot, where the pages
of a host have the same text it belongs to the wrapper. Pages are read through their host's wrapper: the main region whole, and
without a main region the slots.
"""

from __future__ import annotations

import hashlib
import html
import json
from bisect import bisect_left, bisect_right
from collections.abc import Generator, Iterator
from functools import lru_cache
from itertools import count

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.scale import bounded_broadcast

from .tables import free_name, store
from .url_filter import host_of

# The elements of HTML by their part in a page.
BLOCK = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul").split())
UNREAD = frozenset("script style noscript template svg iframe object select button textarea title canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end when one of these begins in the same parent.
CLOSED_BY = {
    "p": BLOCK - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"},
    "tbody": {"tbody", "tfoot"},
}
BESIDE = frozenset("nav header footer aside form dialog menu search".split())
BESIDE_NAMES = frozenset((
    "ad ads advert adverts advertisement alert banner breadcrumb breadcrumbs comment comments cookie cookies footer form header "
    "masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted recommended related reply "
    "replies search share sharing sidebar social sponsor sponsored subscribe toolbar widget").split())
#: With these, joined by hyphens or underscores, names beside the main text stay so.
OF_BESIDE = BESIDE_NAMES | frozenset((
    "area bar block box button buttons center container disqus inner items links list outer posts section slot the thread unit "
    "wrap wrapper").split())
#: Whole names of a reader's comment, and of the blocks that hold them.
COMMENT_NAMES = frozenset("comment comments disqus reply replies".split())
MAIN_NAMES = frozenset("article content entry main post story".split())
#: With these, joined by hyphens or underscores, names of the main text stay names of it.
OF_MAIN = MAIN_NAMES | frozenset("area body container page section site text the wrap wrapper".split())

TOKEN = regex.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)"
    r"|<(script|style|textarea|title)\b[^>]*+>.*?(?:</\1\s*+>|$)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>"""
    r"|<[!?/][^>]*+>|[^<]++|<", regex.S | regex.I)
#: An attribute: quotes delimit a value only where it begins; elsewhere they are characters.
ATTRIBUTE = regex.compile(r"""([^\s/=>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
NAMING = frozenset(("class", "id", "role"))
DIGITS = regex.compile(r"[0-9]+")


class Node:
    """A block of a page: its tag with names, and its children (blocks and texts)."""

    __slots__ = ("key", "children", "tag")

    def __init__(self, tag: str, key: str):
        self.tag, self.key, self.children = tag, key, []


def block_key(tag: str, attributes: str) -> str:
    """The tag with the whole names of its class, id and role, without their digits (so that numbered names are one)."""
    if "=" not in attributes:
        return tag
    values = [m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in NAMING]
    names = {DIGITS.sub("", n).strip("-_") for v in values for n in v.lower().split()}
    return " ".join([tag, *sorted(names - {""})])


def unread_ends(tokens: list) -> dict[int, int]:
    """Where each unread element ends, by the place of its start; those that are not closed inside their parent block are left out."""
    ends: dict[int, int] = {}
    opened: list[tuple[str, int]] = []
    depth: dict[str, int] = {}
    for place, m in enumerate(tokens):
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag not in UNREAD and tag not in BLOCK or tag in VOID:
            continue
        if not m[2]:
            if tag in BLOCK or not m[4].endswith("/"):
                opened.append((tag, place))
                depth[tag] = depth.get(tag, 0) + 1
        elif depth.get(tag):
            while True:
                name, start = opened.pop()
                depth[name] -= 1
                if name == tag:
                    break
            if tag in UNREAD:
                ends[start] = place
    return ends


def page_tree(text: str) -> Node:
    """Blocks of a page; tags that are never closed end with their parent, unread elements then at the next tag of a block."""
    root = Node("html", "html")
    stack = [root]
    tokens = list(TOKEN.finditer(text))
    ends = unread_ends(tokens) if any(m[3] is not None and m[3].lower() in UNREAD for m in tokens) else {}
    until = -1  # the end of an element whose content is not text
    unclosed = False
    for place, m in enumerate(tokens):
        if place <= until:
            continue
        tag = m[3]
        if tag is None:
            piece = m[0]
            if not unclosed and (piece[0] != "<" or piece == "<"):
                stack[-1].children.append(html.unescape(piece))
            continue
        tag = tag.lower()
        if tag in UNREAD:
            if not m[2] and not m[4].endswith("/"):
                until = ends.get(place, until)
                unclosed = unclosed or place not in ends
            continue
        if tag not in BLOCK:
            if tag == "br":
                stack[-1].children.append("\n")
            continue
        unclosed = False
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1].tag, ()):
            stack.pop()
        if tag == "html":
            continue
        node = Node(tag, block_key(tag, m[4]))
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
    return root


# ---------------------------------------------------------------- wrappers

#: A slot for text; a wrapper's other entries are [key, repeated, optional, entries]; groups have the key "".
SLOT = ["#", False, False, []]
LONGEST_GROUP = 4


def structure(node: Node) -> list:
    """The entry of a page's block: texts become slots, repetitions are folded."""
    out: list = []
    todo = [(node, out)]
    made = []
    while todo:  # no recursion: pages may nest without limit
        block, into = todo.pop()
        entry = [block.key, False, False, []]
        into.append(entry)
        made.append(entry)
        for child in block.children:
            if isinstance(child, str):
                if child.strip() and (not entry[3] or entry[3][-1] is not SLOT):
                    entry[3].append(SLOT)
            else:
                place: list = []
                entry[3].append(place)
                todo.append((child, place))
    for entry in reversed(made):  # inner blocks first
        entry[3] = _run(_fold([c if c is SLOT or len(c) == 4 and isinstance(c[0], str) else c[0] for c in entry[3]]))
    return out[0]


def alike(a: list, b: list) -> bool:
    """Whether two entries can be merged."""
    return a[0] == b[0] and (a[0] != "" or [x[0] for x in a[3]] == [x[0] for x in b[3]])


def _run(call: Generator) -> list:
    """The result of a generator that yields the generators whose results it needs: calls that may nest without limit."""
    stack, value = [call], None
    while stack:
        try:
            call = stack[-1].send(value)
        except StopIteration as done:
            stack.pop()
            value = done.value
        else:
            stack.append(call)
            value = None
    return value


def _merge_all(a: list, b: list) -> Generator:
    out = []
    for x, y in zip(a, b, strict=True):
        bare = len(x[3]) == len(y[3]) == 1 and x[3][0][0] == y[3][0][0] == "#"  # so that == does not nest
        out.append(x if bare and x == y else (yield _merge(x, y)))
    return out


def _fold(entries: list) -> Generator:
    """Neighbouring runs of the same keys become one repeated entry or group."""
    out: list = []
    for entry in entries:
        out.append(entry)
        again = True
        while again:
            again = False
            for n in range(1, LONGEST_GROUP + 1):
                run = out[-n:]
                if n > 1 and len(out) > n and out[-n - 1][0] == "" and [x[0] for x in out[-n - 1][3]] == [x[0] for x in run]:
                    group = out[-n - 1]
                    out[-n - 1:] = [["", True, group[2], (yield _merge_all(group[3], run))]]
                    again = True
                elif len(out) >= 2 * n and all(alike(a, b) for a, b in zip(out[-2 * n:-n], run, strict=True)):
                    merged = yield _merge_all(out[-2 * n:-n], run)
                    out[-2 * n:] = [[merged[0][0], True, merged[0][2], merged[0][3]]] if n == 1 else [["", True, False, merged]]
                    again = n > 1 or merged[0][0] != "#"
                    if merged[0][0] == "#" and n == 1:
                        out[-1] = SLOT
                else:
                    continue
                break
            else:
                break
            if len(out) < 2:
                break
    return out


def merge(a: list, b: list) -> list:
    """The entry that matches what either matches."""
    return _run(_merge(a, b))


def _merge(a: list, b: list) -> Generator:
    return [a[0], a[1] or b[1], a[2] or b[2], (yield _align(a[3], b[3])) if a[3] or b[3] else []]


def _align(a: list, b: list) -> Generator:
    """One sequence from two: entries in a longest common subsequence are merged, all others become optional."""
    if len(a) == len(b) and all(alike(x, y) for x, y in zip(a, b, strict=True)):
        return (yield _fold((yield _merge_all(a, b))))
    reach = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            reach[i][j] = max(reach[i + 1][j], reach[i][j + 1], reach[i + 1][j + 1] + 1 if alike(a[i], b[j]) else 0)
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and alike(a[i], b[j]) and reach[i][j] == reach[i + 1][j + 1] + 1:
            out.append((yield _merge(a[i], b[j])))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and reach[i + 1][j] >= reach[i][j + 1]:
            out.append([a[i][0], a[i][1], True, a[i][3]])
            i += 1
        else:
            out.append([b[j][0], b[j][1], True, b[j][3]])
            j += 1
    return (yield _fold(out))


def packed(entry: list) -> str:
    """An entry as text: keys, flags and numbers of inner entries in page order, not nested."""
    flat: list = []
    todo = [entry]
    while todo:
        e = todo.pop()
        flat += (e[0], e[1] + 2 * e[2], len(e[3]))
        todo += reversed(e[3])
    return json.dumps(flat, separators=(",", ":"))


def unpacked(text: str) -> list:
    flat = json.loads(text)
    top: list = []
    open_: list = [[top, 1]]
    for k in range(0, len(flat), 3):
        while not open_[-1][1]:
            open_.pop()
        open_[-1][1] -= 1
        entry = [flat[k], flat[k + 1] % 2 == 1, flat[k + 1] > 1, []]
        open_[-1][0].append(entry)
        open_.append([entry[3], flat[k + 2]])
    return top[0]


def _compound(names: list[str], kind: frozenset, others: frozenset) -> bool:
    """Whether a name, cut at hyphens and underscores, has a word of ``kind`` and none that is not among ``others``."""
    words = (set(n.replace("_", "-").split("-")) for n in names)
    return any(w <= others and w & kind for w in words)


@lru_cache(4096)
def beside(key: str) -> bool:
    """Whether a block is beside the main text, by its tag or one of its names, whole or made of such words only.

    A main element never is, an article only where it is named as a reader's comment and not as main text.
    """
    tag, *names = key.split(" ")
    if tag == "article":
        return any(n in COMMENT_NAMES for n in names) and not any(n in MAIN_NAMES for n in names)
    if tag in ("html", "body", "main"):
        return False
    return tag in BESIDE or _compound(names, BESIDE_NAMES | {"disqus"}, OF_BESIDE)


@lru_cache(4096)
def main_rank(key: str) -> int:
    """3 for an article, 2 for a main element, 1 for a block named like one."""
    tag, *names = key.split(" ")
    if tag in ("article", "main"):
        return 3 if tag == "article" else 2
    return 2 if "main" in names else _compound(names, MAIN_NAMES, OF_MAIN) * 1


def best_rank(entry: list, held: bool = False) -> int:
    """The highest rank of a region in the wrapper that is not beside the main text (``held``: or inside a block that is)."""
    best, todo = 0, [entry]
    while todo:
        e = todo.pop()
        if e[0] != "#" and (held or e[0] == "" or not beside(e[0])):
            best = max(best, main_rank(e[0]) if e[0] else 0)
            todo += e[3]
    return best


class Part:
    """A wrapper's entry made ready for reading: its inner entries in sequence, groups resolved into spans that repeat."""

    __slots__ = ("key", "repeated", "number", "inner", "places", "spans")

    def __init__(self, entry: list):
        self.key, self.repeated, self.number = entry[0], entry[1], 0
        self.inner: list[Part] = []
        self.places: dict[str, list[int]] = {}
        self.spans: list[tuple[int, int]] = []

    def next(self, key: str, at: int) -> int:
        """The place of a page's next child after the one at ``at`` (-1: none yet); -1 if no entry has its key.

        The expression's order is followed: the same repeated entry, the rest of its group, the group again, what comes later. A child
        out of order takes the first entry of its key.
        """
        places = self.places.get(key)
        if not places:
            return -1
        if at >= 0:
            if self.inner[at].key == key and (key == "#" or self.inner[at].repeated):
                return at
            low, high = self.spans[at]
            later = bisect_right(places, at)
            if later < len(places) and places[later] < high:
                return places[later]
            first = bisect_left(places, low)
            if first < len(places) and places[first] < high and high - low > 1:
                return places[first]
            if later < len(places):
                return places[later]
        return places[0]


def compiled(wrapper: list) -> Part:
    top = Part(wrapper)
    todo = [(top, wrapper[3])]
    numbers = count(1)
    while todo:
        part, entries = todo.pop()
        for entry in entries:
            low = len(part.inner)
            members = [entry]
            while members:
                e = members.pop()
                if e[0] == "":
                    members += reversed(e[3])
                else:
                    inner = Part(e)
                    inner.number = next(numbers)
                    part.places.setdefault(e[0], []).append(len(part.inner))
                    part.inner.append(inner)
                    todo.append((inner, e[3]))
            part.spans += [(low, len(part.inner))] * (len(part.inner) - low)
    return top


def prepared(wrapper: list) -> tuple[int, bool, Part]:
    """A wrapper as pages are read through it: the rank of its main regions, whether only blocks beside them hold some, its parts."""
    rank = best_rank(wrapper)
    return rank or best_rank(wrapper, True), not rank and best_rank(wrapper, True) > 0, compiled(wrapper)


def read_page(root: Node, wrapper: tuple[int, bool, Part], constant: frozenset[int] = frozenset()) -> str:
    """The texts in the wrapper's main slots, one line per block, in page order.

    Where the host has main regions only inside blocks that are beside it by their tag or name (a form around the page),
    they are read together with the text outside such blocks. A page without the host's main region is read outside the
    regions that are beside it. ``constant`` holds the places whose text is the wrapper's; they are left out outside main regions.
    """
    rank, held, part = wrapper
    lines = _read(root, part, rank, held, constant)
    return "\n".join(lines if lines is not None or not rank else _read(root, part, 0, False, constant) or [])


def _hash(texts: list) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(texts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def place_texts(root: Node, wrapper: Part) -> list[tuple[int, int, int]]:
    """(place, hash of the page's texts there in order, hash of the page's texts); place 0 stands for the page. None without texts."""
    found: dict[int, list[str]] = {}
    todo: list = [(root, wrapper)]
    while todo:
        node, part = todo.pop()
        for child, its in matched(node, part):
            if not isinstance(child, str):
                todo.append((child, its))
            elif its is not None:
                found.setdefault(its.number, []).append(" ".join(child.split()))
    places = [(number, _hash(texts)) for number, texts in sorted(found.items())]
    page = _hash([str(x) for x in places])
    return [(number, text, page) for number, text in [(0, page), *places]] if places else []


def matched(node: Node, part: Part | None) -> Iterator[tuple[Node | str, Part | None]]:
    """The children of a page's block with their entries, taken in sequence; none where the wrapper has no such entry."""
    at = -1
    for child in node.children:
        if part is None or isinstance(child, str) and not child.strip():
            yield child, None
            continue
        place = part.next("#" if isinstance(child, str) else child.key, at)
        at = at if place < 0 else place
        yield child, None if place < 0 else part.inner[place]


def _read(root: Node, wrapper: Part, rank: int, held: bool, constant: frozenset[int]) -> list[str] | None:
    """Lines of the regions of this rank (0: the whole page); None if the page has none.

    ``held``: lines outside the blocks beside the main text, and of the regions of this rank inside these blocks.
    """
    lines: list[str] = []
    text: list[str] = []
    met = rank == 0 or held

    def end() -> None:
        line = " ".join("".join(text).split())
        if line:
            lines.append(line)
        text.clear()

    todo: list = [(root, wrapper, met)]
    regions: set[int] = set()  # blocks inside a region
    while todo:
        item = todo.pop()
        if item is None:
            end()
            continue
        node, part, inside = item
        if isinstance(node, str):
            if inside:
                text.append(node)
            continue
        region = id(node) in regions
        if beside(node.key):
            if region or not held:
                continue
            inside = False
        if not region and rank and main_rank(node.key) == rank:
            inside = met = region = True
        if region:
            regions.update(id(child) for child in node.children)
        end()
        todo.append(None)
        todo += reversed([
            (child, its, inside and (region or its is None or its.number not in constant)) if isinstance(child, str) else (child, its, inside)
            for child, its in matched(node, part)])
    end()
    return lines if met else None


# ---------------------------------------------------------------- Spark

def _signatures(pages: DataFrame, host: str, page: str) -> DataFrame:
    """(host, structure): the different structures of each host."""

    @F.arrow_udf("string")
    def built(texts: pa.Array) -> pa.Array:
        return pa.array([packed(structure(page_tree(t.as_py() or ""))) for t in texts], pa.string())

    return pages.select(F.col(host).alias("host"), built(F.col(page)).alias("structure")).distinct()


def _aligned(structures: DataFrame, keys: list[str]) -> DataFrame:
    """One structure per group of ``keys``, aligned from sorted rows as they stream in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, wrapper = None, None
        out: list[tuple] = []
        for batch in batches:
            for *key, s in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                entry = unpacked(s)
                if now == key:
                    wrapper = merge(wrapper, entry)
                else:
                    if now is not None:
                        out.append((*now, packed(wrapper)))
                    now, wrapper = key, entry
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=kind)
                out = []
        if now is not None:
            last = dict(zip(names, (*now, packed(wrapper)), strict=True))
            yield pa.RecordBatch.from_pylist([last], schema=kind)

    names = [*keys, "structure"]
    kind = pa.schema([(k, pa.int64() if k == "part" else pa.string()) for k in keys] + [("structure", pa.string())])
    ddl = ", ".join(f"{k} {'long' if k == 'part' else 'string'}" for k in keys) + ", structure string"
    return structures.select(*names).repartition(*keys).sortWithinPartitions(*names).mapInArrow(run, ddl)


def infer_wrappers(pages: DataFrame, host: str, page: str, parts: int = 32) -> DataFrame:
    """(host, wrapper) from all pages. A host's structures are aligned in ``parts``, then the parts."""
    structures = _signatures(pages, host, page).withColumn("part", F.pmod(F.xxhash64("structure"), F.lit(parts)))
    return _aligned(_aligned(structures, ["host", "part"]), ["host"]).withColumnRenamed("structure", "wrapper")


def constant_places(pages: DataFrame, host: str, page: str, wrapper: str) -> DataFrame:
    """(host, constant): the places whose text belongs to each host's wrapper.

    It is the same in all pages that have the place; they are at least two different pages and more than half of the host's pages.
    """
    kind = pa.list_(pa.struct([("place", pa.int32()), ("text", pa.int64()), ("page", pa.int64())]))

    @F.arrow_udf("array<struct<place:int,text:bigint,page:bigint>>")
    def placed(texts: pa.Array, wrappers: pa.Array) -> pa.Array:
        known: dict[str, Part] = {}
        out = []
        for t, w in zip(texts, wrappers, strict=True):
            w = w.as_py()
            if w not in known:
                known[w] = compiled(unpacked(w))
            out.append([{"place": n, "text": x, "page": y} for n, x, y in place_texts(page_tree(t.as_py() or ""), known[w])])
        return pa.array(out, kind)

    seen = pages.select(F.col(host).alias("host"), F.explode(placed(F.col(page), F.col(wrapper))).alias("p")).groupBy("host", "p.place").agg(
        F.count(F.lit(1)).alias("n"), (F.min("p.text") == F.max("p.text")).alias("same"), (F.min("p.page") < F.max("p.page")).alias("differ"))
    places = seen.groupBy("host").agg(
        F.max(F.when(F.col("place") == 0, F.col("n"))).alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("same") & F.col("differ"), F.struct("place", "n")))).alias("same"))
    most = F.filter("same", lambda x: x["n"] * 2 > F.col("n"))
    return places.select("host", F.transform(most, lambda x: x["place"]).alias("constant"))


def text_column(page: Column, wrapper: Column, constant: Column) -> Column:
    """Main text of each page, read through its wrapper."""

    @F.arrow_udf("string")
    def read(pages: pa.Array, wrappers: pa.Array, constants: pa.Array) -> pa.Array:
        known: dict[str, tuple] = {}
        out = []
        for p, w, c in zip(pages, wrappers, constants, strict=True):
            w = w.as_py()
            if w not in known:
                known[w] = prepared(unpacked(w))
            out.append(read_page(page_tree(p.as_py() or ""), known[w], frozenset(c.as_py() or ())))
        return pa.array(out, pa.string())

    return read(page, wrapper, constant)


def extract_text(pages: DataFrame, url: str = "url", page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each page in ``out``.

    Character references are decoded, white space inside a block is one space, blocks are lines in page order.
    Text that the pages of a host have in common is left out where a page has no main region.
    Null and empty pages give an empty text. Pages without a host (null or odd URL) form one host. Repeated
    rows are read alike; a host with one page is its own wrapper; other columns pass through. Wrappers are broadcast
    if their number is small by count, else joined.
    """
    host = free_name(pages, "host")
    wrapper = free_name(pages, "wrapper")
    named = pages.withColumn(host, host_of(F.col(url)))
    found = store(infer_wrappers(named, host, page).select(F.col("host").alias(host), F.col("wrapper").alias(wrapper)), "wrappers")
    constant = free_name(pages, "constant")
    placed = constant_places(named.join(bounded_broadcast(found, 2000), host), host, page, wrapper)
    known = store(found.join(placed.select(F.col("host").alias(host), F.col("constant").alias(constant)), host, "left"), "wrappers")
    joined = named.join(bounded_broadcast(known, 2000), host)
    return joined.withColumn(out, text_column(F.col(page), F.col(wrapper), F.col(constant))).select(*[c for c in pages.columns if c != out], out)
