"""Groups of any size read in order by one task each, with bounded state.

Rows go through one exchange, as compressed Arrow batches per task, and one sort. A task sees them as Arrow batches and holds, per
group, only what later rows are tested against: survivors of a suppression, or the free ground truth of an image.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Rows tested at a time against what is held.
BLOCK_ROWS = 8192
#: Held boxes per test.
HELD_ROWS = 256
#: Rows that are packed for the exchange at a time.
PACK_ROWS = 1 << 17


def group_key(df: DataFrame, keys: list[str]) -> Column:
    """One text per group; groups with nulls in their keys differ from all others."""
    if len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, StringType):
        return F.col(keys[0])
    return F.to_json(F.struct(*[F.col(k) for k in keys]))


def in_order(df: DataFrame, order: list[str], run: Callable, schema: StructType | str) -> DataFrame:
    """``run`` over the Arrow batches of whole groups (first column: ``_k``), sorted by ``order``.

    Rows cross the exchange column by column and compressed, at about a third of the bytes of single rows.
    """
    spark = df.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = df.select("*", F.pmod(F.xxhash64("_k"), F.lit(tasks)).cast("int").alias("_task"))
    moved = numbered.mapInArrow(pack, "_task int, _rows binary").repartitionById(tasks, F.col("_task"))
    return moved.mapInArrow(unpack, df.schema).sortWithinPartitions("_k", *order).mapInArrow(run, schema)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(task, rows as a compressed Arrow stream) of batches that end with a column ``_task``."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= PACK_ROWS:
            yield _packed(held)
            held, n = [], 0
    if n:
        yield _packed(held)


def _packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches)
    rows = rows.take(pc.sort_indices(rows, [("_task", "ascending"), ("_k", "ascending")])).combine_chunks()
    task = rows.column("_task").to_numpy()
    rows = rows.drop_columns("_task")
    starts = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
    blobs = []
    for lo, hi in zip(starts, [*starts[1:], len(task)], strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(rows.slice(lo, hi - lo))
        blobs.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(task[starts], pa.int32()), pa.array(blobs, pa.binary())], ["_task", "_rows"])


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of packed batches."""
    for batch in batches:
        for blob in batch.column(1):
            yield from pa.ipc.open_stream(blob.as_buffer())


def group_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(begins a group, rows of one group) of sorted batches, at most ``BLOCK_ROWS`` rows at a time."""
    last: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0)
        cuts = np.flatnonzero(np.diff(keys.dictionary_encode(null_encoding="encode").indices.to_numpy())) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            name = (keys[lo].as_py(),)
            for at in range(lo, hi, BLOCK_ROWS):
                yield at == lo and name != last, batch.slice(at, min(BLOCK_ROWS, hi - at))
            last = name


def box_rows(part: pa.RecordBatch, first: int) -> np.ndarray:
    """Four columns of a batch as (n, 4)."""
    return np.column_stack([part.column(first + k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(4)])


def tiles(boxes: np.ndarray, rows: int = 128) -> Iterator[np.ndarray]:
    """Positions of the boxes in pieces of about ``rows`` that lie close together."""
    n = len(boxes)
    strips = max(1, round((n / rows) ** 0.5))
    for strip in np.array_split(np.argsort(boxes[:, 0] + boxes[:, 2], kind="stable"), strips):
        own = strip[np.argsort(boxes[strip, 1] + boxes[strip, 3], kind="stable")]
        yield from (piece for piece in np.array_split(own, max(1, round(len(own) / rows))) if len(piece))


class Held:
    """Boxes in the order they came, and the first of them that hits each of some others."""

    def __init__(self, mask: Callable[[np.ndarray, np.ndarray], np.ndarray], local: bool):
        self.mask, self.local = mask, local
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, boxes: np.ndarray) -> None:
        if len(boxes):
            self.parts.append(boxes)
            self.n += len(boxes)

    def boxes(self) -> np.ndarray:
        if len(self.parts) > 1:
            self.parts = [np.concatenate(self.parts)]
        return self.parts[0] if self.parts else np.empty((0, 4))

    def first_hit(self, others: np.ndarray) -> np.ndarray:
        """Number of the first held box that hits each row, or -1.

        ``local`` says that boxes apart never hit each other; then only held boxes are tested that meet the surroundings of a tile.
        """
        out, held = np.full(len(others), -1, np.int64), self.boxes()
        if not len(held) or not len(others):
            return out
        lo_x, hi_x = np.minimum(held[:, 0], held[:, 2]), np.maximum(held[:, 0], held[:, 2])
        lo_y, hi_y = np.minimum(held[:, 1], held[:, 3]), np.maximum(held[:, 1], held[:, 3])
        for rest in tiles(others):
            near = np.arange(len(held))
            if self.local:
                xs, ys = others[rest][:, [0, 2]], others[rest][:, [1, 3]]
                near = np.flatnonzero((lo_x <= xs.max()) & (hi_x >= xs.min()) & (lo_y <= ys.max()) & (hi_y >= ys.min()))
            for k in range(0, len(near), HELD_ROWS):
                some = near[k : k + HELD_ROWS]
                hits = self.mask(held[some], others[rest])
                found = hits.any(axis=0)
                out[rest[found]] = some[hits[:, found].argmax(axis=0)]
                rest = rest[~found]
                if not len(rest):
                    break
        return out


#: IoU that is looked for first, in few cells; what is not found there is looked for further away.
TIERS = (0.9, 0.75)
#: Ratio of the sizes in one class, and cells along the largest size of a class.
BASE, CELLS = 1.5, 4


class FreeBoxes:
    """The free ground truth of one image, by size class and cell, and the best partner of a box.

    Equal boxes are one entry with their list positions; a box that is used up leaves its cell. Boxes whose IoU reaches t
    differ in width and height by a factor of 1/t at most, and along each axis their middles lie within
    (1 - t) / (2 (1 + t)) of the sum of their sizes: a partner with a high IoU is found in the few cells close by.
    """

    def __init__(self, boxes: np.ndarray, ords: np.ndarray, threshold: float):
        self.tiers = [*(t for t in TIERS if t > threshold), threshold]
        solid = (boxes[:, 2] > boxes[:, 0]) & (boxes[:, 3] > boxes[:, 1]) & np.isfinite(boxes).all(axis=1)
        boxes, ords = boxes[solid], ords[solid]
        w, h = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
        kx, ky = self.size_class(w), self.size_class(h)
        cx = np.floor((boxes[:, 0] + boxes[:, 2]) / 2 / self.side(kx))
        cy = np.floor((boxes[:, 1] + boxes[:, 3]) / 2 / self.side(ky))
        order = np.lexsort((ords, *boxes.T, cy, cx, ky, kx))
        boxes, self.ords = boxes[order], ords[order]
        place = np.column_stack([kx, ky, cx, cy])[order]
        new = np.ones(len(boxes), bool)
        new[1:] = (boxes[1:] != boxes[:-1]).any(axis=1)
        starts = np.flatnonzero(new)
        self.next, self.end = starts.copy(), np.append(starts[1:], len(boxes))[: len(starts)]
        boxes, place = boxes[starts], place[starts]
        self.rows = np.column_stack([boxes, (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])])
        self.cells: dict[tuple[float, float], dict[tuple[float, float], list[int]]] = {}
        if len(place):
            begins = np.flatnonzero(np.append(True, (place[1:] != place[:-1]).any(axis=1)))
            ends = np.append(begins[1:], len(place))
            for (a, b, c, d), lo, hi in zip(place[begins].tolist(), begins.tolist(), ends.tolist(), strict=True):
                self.cells.setdefault((a, b), {})[c, d] = [lo, hi]
        self.hopeless: set[tuple] = set()

    @staticmethod
    def size_class(size: np.ndarray) -> np.ndarray:
        return np.floor(np.log(size) / np.log(BASE))

    @staticmethod
    def side(k):
        return BASE ** (k + 1) / CELLS

    def around(self, lo: float, hi: float, t: float) -> list[tuple[int, int, int]]:
        """Along one axis, size classes with their first and last cell that may hold a partner."""
        size, middle = hi - lo, (lo + hi) / 2
        first, last = (math.floor(math.log(s) / math.log(BASE) + e) for s, e in ((size * t, -1e-9), (size / t, 1e-9)))
        out = []
        for k in range(first, last + 1):
            far = (min(BASE ** (k + 1), size / t) + size) * ((1 - t) / (2 * (1 + t)) * (1 + 1e-9)) + 1e-9 * (1 + abs(middle))
            side = self.side(k)
            out.append((k, math.floor((middle - far) / side), math.floor((middle + far) / side)))
        return out

    def take(self, box: np.ndarray) -> tuple[int, float] | None:
        """(list position, IoU) of the best free box, which is free no longer; the first position on ties."""
        x1, y1, x2, y2 = key = tuple(box.tolist())
        if not (x2 > x1 and y2 > y1) or key in self.hopeless or not math.isfinite(x1 + y1 + x2 + y2):
            return None
        area = (x2 - x1) * (y2 - y1)
        for t in self.tiers:
            found = []
            across, down = self.around(x1, x2, t), self.around(y1, y2, t)
            for kx, a, b in across:
                for ky, c, d in down:
                    cells = self.cells.get((kx, ky))
                    if cells:
                        for cx in range(a, b + 1):
                            for cy in range(c, d + 1):
                                cell = cells.get((cx, cy))
                                if cell:
                                    found.append(cell)
            if not found:
                continue
            parts = [self.rows[lo:hi] for lo, hi in found]
            rows = parts[0] if len(parts) == 1 else np.concatenate(parts)
            w = np.minimum(x2, rows[:, 2]) - np.maximum(x1, rows[:, 0])
            h = np.minimum(y2, rows[:, 3]) - np.maximum(y1, rows[:, 1])
            inter = np.maximum(w, 0.0) * np.maximum(h, 0.0)
            iou = inter / (rows[:, 4] + area - inter)
            best = float(iou.max())
            if best >= t and best > 0.0:
                return self._use(found, np.flatnonzero(iou == best)), best
        self.hopeless.add(key)
        return None

    def _use(self, found: list[list[int]], at: np.ndarray) -> int:
        """Take the first list position among the entries ``at`` of the cells ``found``."""
        ends = np.cumsum([hi - lo for lo, hi in found])
        cell_of = np.searchsorted(ends, at, "right")
        entries = [found[c][1] - int(ends[c]) + int(p) for c, p in zip(cell_of.tolist(), at.tolist(), strict=True)]
        chosen = min(range(len(entries)), key=lambda i: self.ords[self.next[entries[i]]])
        entry, cell = entries[chosen], found[cell_of[chosen]]
        ord_ = self.ords[self.next[entry]]
        self.next[entry] += 1
        if self.next[entry] == self.end[entry]:
            last = cell[1] = cell[1] - 1
            for column in (self.rows, self.next, self.end):
                column[entry] = column[last]
            if cell[0] == last:
                cell.clear()
        return int(ord_)
