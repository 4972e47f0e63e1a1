"""Near-duplicate detection with bottom-k sketches from one hash function.

A document is the set of its word shingles, its sketch the ``k`` smallest hashes of the set. Inverted lists of the
retained values propose pairs, the sketch of the union estimates their similarity, and the full sets decide.

Which lists a document enters. Values that one document alone retains link nothing. The others are ranked by how
many documents retain them, rarest first. Of two sets with similarity ``t`` or more, each lacks few of the other's retained
values, so the first value they share stands near the front of both rankings; only that front is listed, and two
members of a list are a pair only if it stands near enough to both fronts for their sizes. For sets that fit into the
sketch this is certain; beyond, a pair that is just at the similarity is missed with a probability under ``MISS``, and other
pairs with far smaller ones.

Large lists. No list is expanded into its pairs. Sets that share lists are gathered in blocks of bounded size, and where lists
propose many pairs between two blocks, all sets of the two are compared at once: what they share is a product of matrices, and only links
that join components leave a task. Pairs that lists propose between other blocks are compared one by one, if they are few. If not, rounds
come before: every member is compared with a few leaders of each list, verified links join components, and members of
one component need no comparison any more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.components import union_roots
from fieldspark.scale import BROADCAST_ROWS

from .phrases import Bits, bits_of
from .tables import discard, mix64, release, slices, store

SKETCH = 128
#: Smallest values of a sketch that are compared first; they are a sketch too, a quarter of its bytes.
HEAD = 32
MISS = 1e-6
LEADERS = 3
ROUNDS = 8
#: Pairs per list entry up to which all pairs outside of dense blocks are compared at once.
PAIRS_PER_ENTRY = 1
#: Sets and values of a block, about; values that one call compares, about.
BLOCK_ROWS = 1024
BLOCK_VALUES = 1 << 19
BUCKET_VALUES = 1 << 18
#: Pairs that lists propose between two blocks, for each of their sets, from which all their sets are compared.
DENSE = 0.5
#: Columns of a matrix; the part of all pairs of sets from which a value they share is such a column.
COLUMNS = 1024
OFTEN = 1 / 256
#: Pairs up to which whole sketches are not read before the sets that contain them.
FEW_PAIRS = 50_000


def hinted(stored: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if it has at most ``rows`` rows (counted from its footers)."""
    return F.broadcast(stored) if stored.count() <= rows else stored


# ---------------------------------------------------------------- shingle sets

def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text.

    Words are cut at ASCII white space, A-Z lower-cased. A text of fewer words is one shingle; no words, no shingle.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()] or [0], np.uint64)
    numbers = coded.indices.to_numpy(zero_copy_only=False)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    blank = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if blank >= 0:
        keep = numbers != blank
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        numbers = numbers[keep]
    flow = hashes[numbers]
    times = np.uint64(0x9E3779B97F4A7C15)
    rolled = flow.copy()
    for j in range(1, min(words, len(flow))):
        rolled[:len(flow) - j] = rolled[:len(flow) - j] * times + flow[j:]
    rolled = mix64(rolled)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= words:
            yield np.unique(rolled[a:b - words + 1])
        elif b > a:
            short = np.uint64(b - a)
            for w in flow[a:b]:
                short = np.uint64((int(short) * 0xD6E8FEB86659FD93 + int(w)) & 0xFFFFFFFFFFFFFFFF)
            yield mix64(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def sketched(docs: DataFrame, doc_id: str, text: str, words: int, k: int) -> DataFrame:
    """(doc, n, print, sketch): set size, 128-bit fingerprint of the set (null if empty), bottom-k sketch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sizes, prints, sketches = [], [], []
                for s in shingle_sets(part.column(1), words):
                    sizes.append(len(s))
                    prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sketches.append(s[:k].view(np.int64))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()),
                    pa.array(sketches, pa.list_(pa.int64())),
                ], ["doc", "n", "print", "sketch"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("t")).mapInArrow(
        rows, "doc long, n long, print binary, sketch array<long>")


def full_sets(docs: DataFrame, doc_id: str, text: str, words: int, k: int, wanted: DataFrame) -> DataFrame:
    """(node, set, sketch, head) of the documents in ``wanted`` (node).

    All sorted hashes, the upper halves of the ``k`` smallest, and those of the HEAD smallest.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = list(shingle_sets(part.column(1), words))
                halves = [(s[:k] >> np.uint64(32)).astype(np.uint32) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([s.tobytes() for s in sets], pa.binary()),
                    pa.array([h.tobytes() for h in halves], pa.binary()),
                    pa.array([h[:HEAD].tobytes() for h in halves], pa.binary()),
                ], ["node", "set", "sketch", "head"])

    picked = docs.select(F.col(doc_id).cast("bigint").alias("node"), F.col(text).alias("t")).join(
        hinted(wanted), "node", "left_semi")
    return picked.mapInArrow(rows, "node long, set binary, sketch binary, head binary")


# ---------------------------------------------------------------- how deep lists and sketches must be read

def _tail(n: int, p: float, least: int) -> float:
    """P(Binomial(n, p) >= least)."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(least, n + 1))


def _reach(k: int, part: float) -> int:
    """The number of ``k`` sampled values that a ``part`` of all exceeds with P < MISS."""
    return next((r for r in range(k) if _tail(k, part, r + 1) < MISS), k)


def least_shared(k: int, percent: int) -> int:
    """Values of a union sketch that both sets hold at least if they reach the similarity."""
    return k - _reach(k, 1 - percent / 100)


def common(small: Column, large: Column, percent: int) -> Column:
    """The fewest values that linked sets of these sizes share."""
    return F.ceil((small + large) * (percent / (100.0 + percent)) - 1e-9)


def depth(small: Column, large: Column, k: int, percent: int) -> Column:
    """The highest rank at which the first value that two linked sets share can stand in either sketch.

    The larger set has at most ``large - common`` values of its own. If it does not fit into its sketch, that is
    a sample without replacement: its mean, and with P < MISS no more than some deviations beyond.
    """
    alone = large - common(small, large, percent)
    part = alone / large
    spread = F.sqrt(k * part * (1 - part) * F.greatest(large - k, F.lit(0)) / large)
    return F.least(alone, F.floor(k * part + math.sqrt(-2 * math.log(MISS)) * spread + 1)) + 1


def reach(n: Column, k: int, percent: int) -> Column:
    """How many ranks a set of size ``n`` lists, so that no partner of any size is missed.

    All partners of a set of up to ``percent * k`` values fit into their sketches; else the largest partner needs most.
    """
    return F.when(n * 100 <= k * percent, F.floor(n * (100 - percent) / 100) + 1).otherwise(
        depth(n, F.floor(n * 100 / percent), k, percent))


def near_front(a: Column, b: Column, k: int, percent: int) -> Column:
    """Whether a shared value at ranks ``r`` can be the first that two linked sets of sizes ``n`` share.

    ``a`` and ``b`` are structs (n, r). Sizes that no linked pair has are ruled out too.
    """
    small, large = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
    both = common(small, large, percent)
    whole = (a["r"] <= a["n"] - both + 1) & (b["r"] <= b["n"] - both + 1)  # both sketches hold the whole sets
    sampled = F.greatest(a["r"], b["r"]) <= depth(small, large, k, percent)
    return (small * 100 >= large * percent) & F.when(large <= k, whole).otherwise(sampled)


# ---------------------------------------------------------------- lists

def list_entries(nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """(v, node, n, r): the lists each node enters, by the rarest of its retained values; r is the value's rank. Stored."""
    postings = nodes.select(F.explode("sketch").alias("v"))
    shared = store(postings.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "shared-values")
    release(nodes.sparkSession)
    # most values are retained once: a bit array keeps them out of the exchange, the join decides
    bits = bits_of(shared.select(F.col("v").alias("h")))
    likely = nodes.select("node", "n", F.explode(held_in(bits)("sketch")).alias("v"))
    ranked = likely.join(shared, "v").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("vs"))
    n = F.col("n")
    own = F.least(n, F.lit(k)) - F.size("vs")  # values of no other document rank first
    room = F.greatest(reach(n, k, percent) - own, F.lit(0)).cast("int")
    entries = store(ranked.select("node", "n", own.alias("own"), F.posexplode(F.slice("vs", 1, room)).alias("p", "e")).select(
        F.col("e.v").alias("v"), "node", "n", (F.col("own") + F.col("p") + 1).cast("bigint").alias("r")), "list-entries")
    discard(shared)
    release(nodes.sparkSession)
    return entries


def held_in(bits: tuple[int, list]):
    """The values of an array that the bit array may hold."""

    @F.arrow_udf("array<long>")
    def run(sketches: pa.Array) -> pa.Array:
        known = Bits(*bits)
        flat = sketches.flatten()
        sizes = pc.fill_null(pc.list_value_length(sketches), 0).to_numpy(zero_copy_only=False)
        keep = known.holds(flat.to_numpy(zero_copy_only=False).view(np.uint64))
        ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(sizes)])]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(keep)))

    return run


MEMBER = ("node", "comp", "n", "r")


def open_lists(entries: DataFrame) -> DataFrame:
    """(v, m): lists with several components and their number of members."""
    return entries.groupBy("v").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter(
        "lo < hi").select("v", "m")


def list_leaders(entries: DataFrame, lists: DataFrame, turn: int) -> DataFrame:
    """(v, leaders) of ``lists``.

    One leader is a member to which the value ranks highest: it has fewest values of its own, as the
    original of many edited copies. The others have the smallest salted hashes. Only partial aggregates are shuffled.
    """
    picks = []
    for i in range(LEADERS):
        order = F.xxhash64("node", F.lit(turn * LEADERS + i))
        if i == 0:
            order = F.shiftleft("r", 40) + F.pmod(order, F.lit(1 << 40))
        picks += [F.min_by(c, order).alias(f"{c}{i}") for c in MEMBER]
    leaders = F.array(*[F.struct(*[F.col(f"{c}{i}").alias(c) for c in MEMBER]) for i in range(LEADERS)])
    held = entries.join(hinted(lists.select("v")), "v", "left_semi")
    return held.groupBy("v").agg(*picks).select("v", F.array_distinct(leaders).alias("leaders"))


def leader_pairs(entries: DataFrame, lists: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): members of lists against leaders of another component."""
    own = F.struct("n", "r")
    near = F.filter("leaders", lambda x: (x["comp"] != F.col("comp")) & near_front(x, own, k, percent))
    met = entries.join(hinted(lists), "v").select("node", F.explode(near).alias("l"))
    return met.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()


def remaining_pairs(entries: DataFrame, meets: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): pairs across components that share a list in which their blocks meet; each comes once, from the first list that it shares.

    ``entries`` (v, node, n, r, comp, block) are those of open lists; ``meets`` has all lists (v, a, b) of two blocks that are looked at.
    """
    ends = meets.select("v", F.explode(F.array("a", "b")).alias("block")).distinct()
    nodes = store(entries.join(hinted(ends), ["v", "block"], "left_semi").select("node").distinct(), "open-nodes")
    still = entries.join(hinted(nodes), "node", "left_semi").groupBy("node", "comp", "n", "block").agg(
        F.array_sort(F.collect_list(F.struct("r", "v"))).alias("rv"))
    listed = F.transform("rv", lambda e: e["v"])
    rows = still.select("*", F.posexplode("rv").alias("p", "e")).select(
        F.col("e.v").alias("v"), F.col("block").alias("a"), F.struct("node", "comp", "n", F.col("e.r").alias("r"), "p", listed.alias("vs")).alias("x"))
    rows = store(rows, "open-entries")
    other = rows.select("v", F.col("a").alias("b"), F.col("x").alias("y"))
    both = meets.select("v", "a", "b").unionByName(meets.filter("a <> b").select("v", F.col("b").alias("a"), F.col("a").alias("b")))
    x, y = F.col("x"), F.col("y")
    first = ~F.arrays_overlap(F.slice(x["vs"], 1, x["p"]), F.slice(y["vs"], 1, y["p"]))
    # of the ranks that both list, linked sets lack no more than the depth allows: all others are in both fronts
    deep = depth(F.least(x["n"], y["n"]), F.greatest(x["n"], y["n"]), k, percent)
    need = F.least(reach(x["n"], k, percent), reach(y["n"], k, percent)) - deep + 1
    enough = F.size(F.array_intersect(x["vs"], y["vs"])) >= need
    met = (x["node"] < y["node"]) & (x["comp"] != y["comp"]) & near_front(x, y, k, percent) & first & enough
    return rows.join(hinted(both), ["v", "a"]).join(other, ["v", "b"]).filter(met).select(x["node"].alias("a"), y["node"].alias("b"))


# ---------------------------------------------------------------- blocks

def list_blocks(entries: DataFrame, lists: DataFrame) -> DataFrame:
    """(node, comp, n, block): the nodes of ``lists`` in blocks of bounded size, most of those that share lists in one. Stored.

    A node's home is the largest of its lists; then it moves to the home with most nodes among those it shares a list with. A
    home that is too large for a block is dealt out.
    """
    listed = entries.join(hinted(lists), "v")
    homes = store(listed.groupBy("node").agg(F.max(F.struct("m", "v"))["v"].alias("home")), "homes")
    sized = homes.join(homes.groupBy("home").agg(F.count(F.lit(1)).alias("s")), "home").select("node", F.struct("s", "home").alias("h"))
    largest = listed.join(sized, "node").groupBy("v").agg(F.max("h").alias("h"))
    homes = store(listed.join(largest, "v").groupBy("node", "comp").agg(F.max("n").alias("n"), F.max("h")["home"].alias("home")), "homes")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_VALUES))
    return store(homes.join(homes.groupBy("home").agg(parts.alias("parts")), "home").select(
        "node", "comp", "n", F.xxhash64("home", F.pmod(F.xxhash64("node"), "parts")).alias("block")), "blocks")


def block_meets(entries: DataFrame, lists: DataFrame, blocks: DataFrame) -> DataFrame:
    """(v, a, b, pairs): the lists in which members of two blocks meet, a <= b, and the pairs that each proposes. Stored."""
    held = entries.select("v", "node").join(hinted(lists.select("v")), "v", "left_semi").join(hinted(blocks.select("node", "block")), "node")
    per = held.groupBy("v", "block").agg(F.count(F.lit(1)).cast("double").alias("c"))
    x, y = (per.select("v", F.col("block").alias(n), F.col("c").alias(f"c{n}")) for n in ("a", "b"))
    pairs = F.when(F.col("a") == F.col("b"), F.col("ca") * (F.col("ca") - 1) / 2).otherwise(F.col("ca") * F.col("cb"))
    return store(x.join(y, "v").filter("a <= b").select("v", "a", "b", pairs.alias("pairs")).filter("pairs > 0"), "block-meets")


def block_pairs(meets: DataFrame, blocks: DataFrame) -> DataFrame:
    """(a, b, pairs, dense): blocks of several components that meet, and whether all their sets are to be compared. Stored."""
    size = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("s"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    a, b = (size.select(F.col("block").alias(n), *[F.col(c).alias(f"{c}{n}") for c in ("s", "lo", "hi")]) for n in ("a", "b"))
    sets = F.col("sa") + F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("sb"))
    several = F.least("loa", "lob") < F.greatest("hia", "hib")
    return store(meets.groupBy("a", "b").agg(F.sum("pairs").alias("pairs")).join(a, "a").join(b, "b").filter(several).select(
        "a", "b", "pairs", (F.col("pairs") >= DENSE * sets).alias("dense")), "block-pairs")


def block_links(pairs: DataFrame, blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): nodes whose components are joined by links between the sets of two blocks, no more than there are components."""
    meet = store(pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block")), "block-ends")
    values = blocks.join(hinted(meet), "block").agg(F.sum("n")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("a", "b"), F.lit(math.ceil(values / BUCKET_VALUES) or 1))
    rows = sets.select("node", "set").join(hinted(blocks.select("node", "comp", "block")), "node").join(hinted(meet), "block").select(
        bucket.alias("bucket"), "a", "b", "block", "node", "comp", "set")

    def joined(table: pa.Table) -> pa.Table:
        a, b, block, node, comp = (table[c].to_numpy() for c in ("a", "b", "block", "node", "comp"))
        values = [np.frombuffer(v.as_buffer(), np.uint64) for v in table["set"]]
        order = np.lexsort((b, a))
        ends = np.flatnonzero((np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)) + 1
        out = []
        for rows in np.split(order, ends):
            xs, ys = rows[block[rows] == a[rows]], rows[block[rows] == b[rows]]
            i, j = alike_sets([values[r] for r in xs], [values[r] for r in ys], percent)
            names, at, number = np.unique(comp[rows], return_index=True, return_inverse=True)
            place = dict(zip(rows.tolist(), number.tolist(), strict=True))
            x, y = (np.array([place[r] for r in side.tolist()], np.int64) for side in (xs, ys))
            root = union_roots(len(names), x[i], y[j])
            moved = np.flatnonzero(root != np.arange(len(root)))
            out.append(np.stack([node[rows[at[root[moved]]]], node[rows[at[moved]]]]))
        first, second = np.concatenate(out, axis=1)
        return pa.table({"a": pa.array(first, pa.int64()), "b": pa.array(second, pa.int64())})

    return rows.groupBy("bucket").applyInArrow(joined, "a long, b long")


def _runs(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions of all runs one after another, and the number of the run that each is in."""
    run = np.repeat(np.arange(len(starts)), lengths)
    return np.arange(len(run)) + (starts - np.cumsum(lengths) + lengths)[run], run


def shared_values(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``xs`` shares with each of ``ys``: a product of matrices for frequent values, pairs for the others."""
    met = np.zeros((len(xs), len(ys)), np.int64)
    sides = []
    for sets in (xs, ys):
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.argsort(flat, kind="stable")
        sides.append((flat[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]))
    (xv, xr), (yv, yr) = sides
    both = np.intersect1d(xv, yv)
    x0, y0 = np.searchsorted(xv, both), np.searchsorted(yv, both)
    xn, yn = np.searchsorted(xv, both, "right") - x0, np.searchsorted(yv, both, "right") - y0
    often = xn * yn >= OFTEN * met.size
    columns = np.flatnonzero(often)
    for part in (columns[c:c + COLUMNS] for c in range(0, len(columns), COLUMNS)):
        ones = []
        for rows, lo, n in ((xr, x0, xn), (yr, y0, yn)):
            at, column = _runs(lo[part], n[part])
            ones.append(np.zeros((len(xs) if rows is xr else len(ys), len(part)), np.float32))
            ones[-1][rows[at], column] = 1
        met += (ones[0] @ ones[1].T).astype(np.int64)
    rest = np.flatnonzero(~often)
    pieces = np.cumsum(xn[rest] * yn[rest]) // (met.size + 1)
    for part in np.split(rest, np.flatnonzero(np.diff(pieces)) + 1):
        at, value = _runs(x0[part], xn[part])
        other, pair = _runs(y0[part][value], yn[part][value])
        met += np.bincount(xr[at][pair] * len(ys) + yr[other], minlength=met.size).reshape(met.shape)
    return met


def alike_sets(xs: list[np.ndarray], ys: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (numbers in ``xs`` and in ``ys``) of sets that reach the similarity."""
    met = shared_values(xs, ys)
    size = np.array([len(s) for s in xs])[:, None] + np.array([len(s) for s in ys])
    return np.nonzero(100 * met >= percent * (size - met))


# ---------------------------------------------------------------- verification

def promising(pairs: DataFrame, sets: DataFrame, k: int, percent: int, value: str = "sketch") -> DataFrame:
    """Pairs whose sketches of ``k`` values, merged into the sketch of their union, show enough values that both hold."""
    need = least_shared(k, percent)

    @F.arrow_udf("boolean")
    def likely(xs: pa.Array, ys: pa.Array) -> pa.Array:
        both = zip(xs, ys, strict=True)
        return pa.array([hopeful(*(np.frombuffer(v.as_buffer(), np.uint32) for v in pair), k, need) for pair in both], pa.bool_())

    return _paired(pairs, sets, value).filter(likely("x", "y")).select("a", "b")


def hopeful(p: np.ndarray, q: np.ndarray, k: int, need: int) -> bool:
    """Whether enough of the union's sketch is in both sketches; sketches of whole sets always pass."""
    union, shared = np.union1d(p, q)[:k], np.intersect1d(p, q)
    return len(union) < k or np.searchsorted(shared, union[-1], "right") >= need


def linked(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity; the sketches at their heads rule pairs out first."""
    need = least_shared(k, percent)

    @F.arrow_udf("boolean")
    def alike(xs: pa.Array, ys: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(xs, ys, strict=True):
            p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(p, q, assume_unique=True)) if hopeful(p[:k], q[:k], k, need) else 0
            out.append(100 * both >= percent * (len(p) + len(q) - both))
        return pa.array(out, pa.bool_())

    return _paired(pairs, sets, "set").filter(alike("x", "y")).select("a", "b")


def _paired(pairs: DataFrame, sets: DataFrame, value: str) -> DataFrame:
    """Pairs with both values; of the sets only those that occur in pairs are shuffled, where their list can be broadcast."""
    ends = [pairs.select(F.col(c).alias("node")).distinct() for c in ("a", "b")]
    used = store(ends[0].unionByName(ends[1]).distinct(), "paired-nodes")
    if used.count() <= BROADCAST_ROWS:
        sets = sets.join(F.broadcast(used), "node", "left_semi")
    first, second = (sets.select(F.col("node").alias(n), F.col(value).alias(v)) for n, v in (("a", "x"), ("b", "y")))
    return hinted(pairs).join(first, "a").join(second, "b")


def verified(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose sets reach the similarity: by the heads of sketches, by whole sketches, then by full sets. Stored."""
    head = min(HEAD, k)
    likely = store(promising(pairs, sets, head, percent, "head"), "promising")
    if likely.count() > FEW_PAIRS:
        likely = store(promising(likely, sets, k, percent), "promising")
    return store(linked(likely, sets, k, percent), "links")


# ---------------------------------------------------------------- components

def merge_components(labels: DataFrame, links: DataFrame, steps: int | None = None) -> DataFrame:
    """``labels`` (node, comp) after joining the components of linked nodes; a component is named by its smallest node.

    The graph of components is contracted until no link is left, or for some ``steps`` only: in each, every
    component takes its smallest neighbour as parent.
    """
    named = hinted(labels)
    a, b = named.select(F.col("node").alias("a"), F.col("comp").alias("x")), named.select(F.col("node").alias("b"), F.col("comp").alias("y"))
    edges = store(links.join(a, "a").join(b, "b").filter("x <> y").select("x", "y").distinct(), "component-links")
    done = 0
    while done != steps and not edges.isEmpty():
        done += 1
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        parent = hinted(store(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("p")), "parents"))
        up = parent.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        jumped = parent
        for _ in range(3):  # parents are smaller than children: jumping shortens every chain
            jumped = jumped.join(up, "p").select("x", F.col("pp").alias("p"))
        jumped = hinted(store(jumped, "parents"))
        labels = store(labels.join(jumped, F.col("comp") == F.col("x"), "left").select(
            "node", F.coalesce("p", "comp").alias("comp")), "labels")
        if done == steps:
            break
        px, py = (jumped.select(F.col("x").alias(n), F.col("p").alias(v)) for n, v in (("x", "u"), ("y", "w")))
        edges = store(edges.join(px, "x").join(py, "y").filter("u <> w").select(
            F.col("u").alias("x"), F.col("w").alias("y")).distinct(), "component-links")
    return labels


# ---------------------------------------------------------------- the operator

def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, k: int = SKETCH,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Documents whose shingle sets have ``100 * intersection >= percent * union`` are linked; component_id is the
    smallest id reachable over links, and that document is kept.

    Texts without words have an empty set and are linked with nothing. Equal sets are one
    node from the start, so copies are never paired. Rows without an id are linked with nothing, keep a null
    component and are kept. Rows that share an id are one document: the components of its texts are joined. Other columns
    play no part.
    """
    sketches = store(sketched(docs, doc_id, text, words, k), "sketches")
    base = store(sketches.select("doc", "n", "print"), "sets-of-documents")
    reps = hinted(store(base.filter("n > 0 and doc is not null").groupBy("print").agg(
        F.min("doc").alias("node"), F.max("doc").alias("last")), "distinct-sets"))
    nodes = set_nodes(sketches, reps)
    entries = list_entries(nodes, k, percent)
    discard(sketches)
    if hasattr(nodes, "stored_path"):
        discard(nodes)
    reps = reps.drop("last")
    listed = store(entries.select("node").distinct(), "listed-nodes")
    labels = listed.withColumn("comp", F.col("node"))
    if not listed.isEmpty():
        sets = store(full_sets(docs, doc_id, text, words, k, listed), "listed-sets")
        labels = _settle(entries, labels, sets, k, percent)
    labels = _join_texts(base, reps, labels)
    named = hinted(labels)
    members = base.select("doc", "n", "print").join(reps, "print", "left")
    component = F.coalesce("comp", "node", "doc")
    return members.join(named, "node", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"),
    )


def set_nodes(sketches: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, n, sketch) of the first document of every set. Stored only if the sets with copies are too many to broadcast.

    Copies are taken out rather than first documents looked up: sets that have copies are far fewer, and sketches stay in place.
    """
    copied = reps.filter("last > node").select("print", "node")
    later = (sketches["print"] == copied["print"]) & (sketches["doc"] > copied["node"])
    few = copied.count() <= BROADCAST_ROWS
    nodes = sketches.filter("n > 0 and doc is not null").join(F.broadcast(copied) if few else copied, later, "left_anti").select(
        F.col("doc").alias("node"), "n", "sketch")
    return nodes if few else store(nodes, "set-nodes")


def _join_texts(base: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` with the components of different texts of one id joined."""
    known = base.filter("n > 0 and doc is not null")
    ends = known.groupBy("doc").agg(F.min(F.xxhash64("print")).alias("lo"), F.max(F.xxhash64("print")).alias("hi"))
    several = store(ends.filter("lo <> hi").select("doc"), "ids-of-texts")
    if several.isEmpty():
        return labels
    held = known.join(hinted(several), "doc", "left_semi").join(reps, "print").select("doc", F.col("node").alias("b"))
    first = held.groupBy("doc").agg(F.min("b").alias("a"))
    links = store(held.join(first, "doc").filter("a < b").select("a", "b").distinct(), "text-links")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    labels = store(labels.unionByName(nodes.withColumn("comp", F.col("node"))), "labels")
    return merge_components(labels, links)


def _settle(entries: DataFrame, labels: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Dense blocks and the pairs outside of them; before, rounds of leaders as long as those are many."""
    size = entries.count()
    tried, found, left = None, None, None

    def untried(pairs: DataFrame) -> DataFrame:
        return store(pairs if tried is None else pairs.join(hinted(tried), ["a", "b"], "left_anti"), "pairs")

    for turn in range(ROUNDS + 1):
        now = entries.join(hinted(labels), "node")
        lists = store(open_lists(now), "open-lists")
        if lists.isEmpty():
            return merge_components(labels, found) if found is not None else labels
        blocks = list_blocks(now, lists)
        meets = block_meets(now, lists, blocks)
        met = block_pairs(meets, blocks)
        sparse = met.filter("not dense").select("a", "b")
        still = met.filter("not dense").agg(F.sum("pairs")).first()[0] or 0
        if turn == ROUNDS or still <= PAIRS_PER_ENTRY * size or (left is not None and still > 0.8 * left):
            break
        pairs = untried(leader_pairs(now, store(list_leaders(now, lists, turn), "list-leaders"), k, percent))
        links = verified(pairs, sets, k, percent)
        found = links if found is None else found.unionByName(links)
        # between rounds a first contraction will do: it only spares comparisons
        labels = merge_components(labels, links, 1)
        tried = pairs if tried is None else tried.unionByName(pairs)
        left = still
        release(labels.sparkSession)
    links = store(block_links(met.filter("dense"), blocks, sets, percent), "block-links")
    release(labels.sparkSession)
    labels = merge_components(labels, links if found is None else found.unionByName(links))
    if still:
        now = entries.join(hinted(lists.select("v")), "v", "left_semi").join(hinted(labels), "node").join(
            hinted(blocks.select("node", "block")), "node")
        pairs = untried(remaining_pairs(now, meets.join(hinted(sparse), ["a", "b"], "left_semi"), k, percent))
        if not pairs.isEmpty():
            labels = merge_components(labels, verified(pairs, sets, k, percent))
    return labels
