"""Large JSON documents read by many tasks.

A document is cut into blocks by Spark's text source, at closing braces. What a block does to the reader's state
is known before its beginning is: whether it ends inside a string depends on the number of its quotes, and its change of depth
on whether it starts inside one. Sums over the blocks of a file then give every block the state it starts in, and each is
read on its own. Objects that reach over blocks come as fragments, which are the only rows that are shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scale import at_most, cut_lineage

ESCAPED = re.compile(rb"\\.", re.S)
QUOTE, OPEN_LIST, CLOSE_LIST, OPEN, CLOSE = b'"[]{}'
BLANK = np.frombuffer(b" \t\r\n,", np.uint8)
BLOCK = ["file", "block"]
#: Blocks whose states are broadcast; with more, blocks are moved to their states.
BLOCKS = 200_000


def _pieces(spark: SparkSession, path) -> DataFrame:
    """(file, block, value): the text between closing braces, in order within each block."""
    meta = F.col("_metadata")
    return spark.read.text(path, lineSep="}").select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """(first row, text) of each run of pieces of one block."""
    files, blocks = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
    cuts = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    values = batch.column(2).cast(pa.binary())
    for a, b in zip([0, *cuts], [*cuts, len(files)]):
        if b > a:
            yield int(a), b"}".join(values.slice(a, b - a).to_pylist()) + b"}"


def _marks(text: bytes, inside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes without escapes, whether a string is open after each, and where depth rises and falls."""
    a = np.frombuffer(ESCAPED.sub(b"__", text), np.uint8)
    within = (inside + np.cumsum(a == QUOTE)) & 1
    plain = within == 0
    return a, within, plain & ((a == OPEN) | (a == OPEN_LIST)), plain & ((a == CLOSE) | (a == CLOSE_LIST))


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: parity of quotes, change of depth if it starts outside and inside a string, first byte of the file."""
    found: dict[tuple, list] = {}
    for batch in batches:
        for row, text in _runs(batch):
            key = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
            e = found.setdefault(key, [0, 0, 0, None])
            if e[3] is None and key[1] == 0:
                e[3] = text.lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode("latin-1") or None
            for start in (0, 1):
                _, within, up, down = _marks(text, e[0] ^ start)
                e[1 + start] += int(up.sum()) - int(down.sum())
            e[0] = int(within[-1]) ^ 1  # of the second reading, which began inside a string
    yield pa.RecordBatch.from_pylist(
        [{"file": f, "block": b, "odd": e[0], "outside": e[1], "within": e[2], "root": e[3]} for (f, b), e in found.items()],
        pa.schema([("file", pa.string()), ("block", pa.int64()), ("odd", pa.int32()), ("outside", pa.int64()), ("within", pa.int64()),
                   ("root", pa.string())]))


class Reader:
    """Reads one block from the state it starts in; objects that it does not hold whole are given out as fragments."""

    def __init__(self, inside: int, depth: int, root: str | None, section: str | None, base: int, started: int):
        self.inside, self.depth, self.level = inside, depth, 1 if root == "[" else 2
        self.section, self.base, self.started = section, base, started
        self.opened: tuple | None = None  # the last list or object that began in this block
        self.parts: list[bytes] | None = [] if depth > self.level else None
        self.own = self.parts is None  # whether the object that is open began in this block
        self.rows: list[tuple] = []

    def feed(self, text: bytes) -> None:
        a, within, up, down = _marks(text, self.inside)
        depth = self.depth + np.cumsum(up.astype(np.int64) - down)
        opens = np.flatnonzero(up & (depth == 2)) if self.level == 2 else np.zeros(0, np.int64)
        starts = up & (a == OPEN) & (depth == self.level + 1)
        ends = down & (depth == self.level) & (a == CLOSE)
        other = (depth == self.level) & ~up & ~down & ~np.isin(a, BLANK) | up & (a == OPEN_LIST) & (depth == self.level + 1)
        events = np.unique(np.concatenate([opens, np.flatnonzero(starts | ends)]))
        odd = np.flatnonzero(other)
        quotes = np.flatnonzero(a == QUOTE) if len(opens) else None
        begin = 0  # where the open object's bytes begin in this text
        seen = 0
        for at in events.tolist():
            self._check(odd, seen, at)
            seen = at
            if starts[at]:
                self.parts, self.own, begin = [], True, at
                self.started += 1
            elif ends[at]:
                if self.parts is not None:
                    self._give([*self.parts, text[begin:at + 1]], self.own)
                self.parts = None
            else:
                name = None
                if a[at] == OPEN_LIST:
                    last = int(np.searchsorted(quotes, at)) - 1
                    name = json.loads(text[quotes[last - 1]:quotes[last] + 1])
                self.section, self.base = name, self.started
                self.opened = (name, self.started)
        self._check(odd, seen, len(text))
        if self.parts is not None:
            self.parts.append(text[begin:])
        self.inside, self.depth = int(within[-1]), int(depth[-1])

    def _check(self, odd: np.ndarray, low: int, high: int) -> None:
        if len(odd) and self.section is not None and np.searchsorted(odd, low) < np.searchsorted(odd, high):
            raise ValueError(f"the list {self.section!r} holds an element that is no object")

    def _give(self, parts: list[bytes], whole: bool) -> None:
        if self.section is not None:
            n = self.started - 1
            self.rows.append((self.section, n, n - self.base, whole, b"".join(parts)))

    def end(self) -> None:
        """The block is over: what is open goes out as a fragment."""
        if self.parts is not None:
            self._give(self.parts, False)
            self.parts = None


def _readers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Reader, bool]]:
    """(key, reader, whether its block is over) after every run of pieces."""
    key, reader = None, None
    for batch in batches:
        for row, text in _runs(batch):
            values = [c[row].as_py() for c in batch.columns]
            if (values[0], values[1]) != key:
                if reader is not None:
                    reader.end()
                    yield key, reader, True
                key, reader = (values[0], values[1]), Reader(*values[3:])
            reader.feed(text)
            yield key, reader, False
    if reader is not None:
        reader.end()
        yield key, reader, True


def _openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: how many objects begin, and the last list (or a null name) with the number of objects before it."""
    rows = []
    for key, reader, over in _readers(batches):
        reader.rows.clear()
        if over:
            rows.append({"file": key[0], "block": key[1], "n": reader.started,
                         "opened": reader.opened and {"section": reader.opened[0], "base": reader.opened[1]}})
    opened = pa.struct([("section", pa.string()), ("base", pa.int64())])
    yield pa.RecordBatch.from_pylist(
        rows, pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("opened", opened)]))


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, reader, _ in _readers(batches):
        if reader.rows:
            section, n, ord_, whole, text = zip(*reader.rows)
            reader.rows = []
            count = len(n)
            yield pa.RecordBatch.from_arrays([
                pa.array([key[0]] * count), pa.array([key[1]] * count, pa.int64()), pa.array(section), pa.array(n, pa.int64()),
                pa.array(ord_, pa.int64()), pa.array(whole), pa.array(text, pa.binary()).cast(pa.string()),
            ], ["file", "block", "section", "n", "ord", "whole", "value"])


def _with_state(pieces: DataFrame, states: DataFrame) -> DataFrame:
    names = ["value", "inside", "depth", "root", "section", "base", "started"]
    if at_most(states, BLOCKS):
        return pieces.join(F.broadcast(states), BLOCK).select(*BLOCK, *names)
    moved = pieces.withColumn("seq", F.monotonically_increasing_id()).join(states, BLOCK)
    return moved.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "seq").select(*BLOCK, *names)


def read_list_items(spark: SparkSession, path) -> DataFrame:
    """(file, section, ord, value): the objects in the lists of JSON documents, as JSON text with their list position.

    A document is a list (section "") or an object with lists under its keys; lists deeper inside, and keys that hold
    no list, give no rows. An element of a list that is no object is an error, and so is a document that is cut off. Empty documents and
    lists give no rows. A key that occurs twice gives the rows of both lists. Names of keys hold no braces.
    """
    pieces = _pieces(spark, path)
    effects = pieces.mapInArrow(_effects, "file string, block long, odd int, outside long, within long, root string")
    file = Window.partitionBy("file")
    before = file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = effects.withColumns({
        "inside": (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int"), "root": F.max("root").over(file),
    }).withColumn("delta", F.when(F.col("inside") == 0, F.col("outside")).otherwise(F.col("within")))
    # the last piece of a file counts one closing brace too many if none ends it
    broken = (F.sum("delta").over(file) > 0) | (F.sum("odd").over(file) % 2 == 1)
    states = states.select(
        *BLOCK, "inside", "root", F.when(broken, F.raise_error(F.lit("a JSON document is cut off")).cast("bigint")).otherwise(
            F.coalesce(F.sum("delta").over(before), F.lit(0))).alias("depth"))
    states = cut_lineage(states)  # a row per block; the text itself is read again instead of stored
    first = F.when(F.col("root") == "[", F.lit(""))
    blank = states.withColumns({"section": first, "base": F.lit(0).cast("bigint"), "started": F.lit(0).cast("bigint")})
    counts = _with_state(pieces, blank).mapInArrow(_openings, "file string, block long, n long, opened struct<section string, base long>")
    started = F.coalesce(F.sum("n").over(before), F.lit(0))
    counts = counts.withColumn("started", started).withColumn(
        "at", F.when(F.col("opened").isNotNull(), F.struct("opened.section", (F.col("opened.base") + F.col("started")).alias("base"))))
    last = F.last("at", ignorenulls=True).over(before)
    known = counts.select(*BLOCK, "started", last.alias("at"))
    states = cut_lineage(states.join(known, BLOCK).select(
        *BLOCK, "inside", "depth", "root", F.coalesce(F.col("at.section"), first).alias("section"),
        F.coalesce(F.col("at.base"), F.lit(0)).alias("base"), "started"))
    items = _with_state(pieces, states).mapInArrow(
        _items, "file string, block long, section string, n long, ord long, whole boolean, value string")
    in_order = F.array_sort(F.collect_list(F.struct("block", "value")))
    joined = items.filter("not whole").groupBy("file", "section", "n", "ord").agg(
        F.array_join(F.transform(in_order, lambda e: e["value"]), "").alias("value"))
    out = ["file", "section", "ord", "value"]
    return items.filter("whole").select(*out).unionByName(joined.select(*out))
