"""Sharding by sampled splitters.

Records are ordered by (hash of the text, id), so that equal texts are neighbours. A sample in which a record's chance
grows with its size gives quantile boundaries between groups of equal texts; they cut the records into many
more ranges than shards. Ranges that turn out overfull are subdivided by further splitters drawn inside them, between
groups of equal texts and, in groups that are too large to stay together, between single records. Sizes of ranges give every record its exact place in the byte order of the whole table, and the
place gives the shard. The law is ``bytes``: shards hold nearly equal bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import store

SHARDS = 16
#: Ranges per shard; rows per range aimed at in large tables and at least in small ones; ranges at most (the driver holds them).
RANGES_PER_SHARD = 64
RANGE_ROWS = 20_000
FEWEST_ROWS = 16
MOST_RANGES = 65_536
#: Sampled records per range, and how full a range may be.
OVERSAMPLE = 8
OVERFULL = 4
#: Groups of equal texts up to this part of a shard stay together.
WHOLE_GROUP = 64
LOWEST = -(1 << 63)


def _sortable(h: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Keys whose byte order is the order of (h, tie)."""
    flip = np.int64(LOWEST)
    pair = np.stack([(h ^ flip), (tie ^ flip)], 1).view(np.uint64).astype(">u8")
    return np.ascontiguousarray(pair).view("S16").reshape(-1)


def range_column(h: Column, tie: Column, splitters) -> Column:
    """Number of the range of each key; ``splitters`` is a Spark broadcast of sorted (h, tie) arrays.

    A splitter is the first key of a range.
    """

    @F.arrow_udf("int")
    def ranged(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        bounds = _sortable(*splitters.value)
        for hs, ties in columns:
            keys = _sortable(hs.to_numpy(zero_copy_only=False), ties.to_numpy(zero_copy_only=False))
            yield pa.array(np.searchsorted(bounds, keys, "right"), pa.int32())

    return ranged(h, tie)


def _sample(rows: DataFrame, rate: Column, salt: int) -> DataFrame:
    """Records drawn with probability min(1, size * rate), and their weight in the sample."""
    chance = F.col("size") * rate
    drawn = F.pmod(F.xxhash64("h", "tie", F.lit(salt)), F.lit(1 << 53)) / float(1 << 53)
    return rows.filter(drawn < chance).select("h", "tie", F.greatest(chance, F.lit(1.0)).alias("w"))


def _quantiles(keys: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    """Positions in the ordered sample at which a new part starts."""
    reach = np.cumsum(weights)
    wanted = reach[-1] * np.arange(1, parts) / parts
    return np.unique(np.searchsorted(reach, wanted))


def _ordered(h: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order."""
    pairs = np.unique(np.stack([h, tie], 1), axis=0)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def _first_splitters(rows: DataFrame, total: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = _sample(rows, F.lit(OVERSAMPLE * ranges / total), 0).toPandas()  # about OVERSAMPLE * ranges records
    empty = np.zeros(0, np.int64)
    if drawn.empty:
        return empty, empty
    drawn = drawn.sort_values(["h", "tie"])
    at = _quantiles(drawn["h"].to_numpy(), drawn["w"].to_numpy(), ranges)
    h = np.unique(drawn["h"].to_numpy()[at])
    return _ordered(h, np.full(len(h), LOWEST))  # a range starts with a group of equal texts


def split_ranges(rows: DataFrame, total: int, ranges: int, large: set[int]) -> tuple[DataFrame, list]:
    """``rows`` with their range, and the bytes, rows and largest record of every range.

    Only groups of equal texts whose hash is in ``large`` are cut.
    """
    spark = rows.sparkSession
    many = np.array(sorted(large), np.int64)
    h, tie = _first_splitters(rows, total, ranges)
    target = total / ranges
    for turn in range(1, 20):
        placed = rows.withColumn("range", range_column(F.col("h"), F.col("tie"), spark.sparkContext.broadcast((h, tie))))
        sizes = placed.groupBy("range").agg(
            F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.max("size").alias("largest"),
            F.min(F.struct("h", "tie")).alias("lo"), F.max(F.struct("h", "tie")).alias("hi"),
        ).collect()  # one row per range
        full = [
            r for r in sizes
            if r.bytes - r.largest > OVERFULL * target and (r.lo.h != r.hi.h or r.lo.h in large and r.lo != r.hi)]
        if not full:
            break
        overfull = spark.createDataFrame([(r.range,) for r in full], "range int")
        drawn = _sample(
            placed.join(F.broadcast(overfull), "range", "left_semi"), F.lit(OVERSAMPLE / target), turn
        ).toPandas().sort_values(["h", "tie"])
        more_h, more_tie = [h], [tie]
        at = np.searchsorted(_sortable(h, tie), _sortable(drawn["h"].to_numpy(np.int64), drawn["tie"].to_numpy(np.int64)), "right")
        for r in full:
            own = drawn[at == r.range]
            if own.empty:
                continue
            cut = _quantiles(own["h"].to_numpy(), own["w"].to_numpy(), int(r.bytes // target) + 1)
            cut_h, cut_tie = own["h"].to_numpy(np.int64)[cut], own["tie"].to_numpy(np.int64)[cut]
            later = np.append(cut_h[cut_h > r.lo.h], r.hi.h)  # the last group starts a range, so that every turn gets on
            inside = np.isin(cut_h, many)
            more_h += [cut_h[inside], later]
            more_tie += [cut_tie[inside], np.full(len(later), LOWEST)]
        h, tie = _ordered(np.concatenate(more_h), np.concatenate(more_tie))
    return placed, sizes


def assign_shards(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs``.

    Size is the UTF-8 bytes of the text plus 1; a null text has no bytes and the checksum of no bytes. Slots
    number a shard's records from 0 without gaps. Groups of equal texts stay in one shard unless they exceed 1/64 of
    a shard. Repeated rows each get a slot; a null id is ordered first in its group; an empty table gives no rows.
    grown_shard is null: under the law ``bytes`` a new shard moves boundaries.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = store(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(plain) + 1).cast("bigint").alias("size"),
        F.crc32(plain.cast("binary")).alias("text_crc32"), F.xxhash64(plain).alias("h"),
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LOWEST + 1)).alias("tie"),
    ), "sizes")
    whole = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    total = whole.bytes or 1
    ranges = min(MOST_RANGES, max(min(RANGES_PER_SHARD * shards, whole.rows // FEWEST_ROWS), -(-whole.rows // RANGE_ROWS), 1))
    # fewer than WHOLE_GROUP * shards groups can be larger than that part of all bytes
    groups = rows.groupBy("h").agg(F.sum("size").alias("bytes"))
    large = {r.h for r in groups.filter(F.col("bytes") * (WHOLE_GROUP * shards) > total).collect()}
    placed, sizes = split_ranges(rows, total, ranges, large)
    placed = store(placed, "ranges")
    before, done = [], [0, 0]
    for r in sorted(sizes, key=lambda r: r.range):
        before.append((r.range, done[0], done[1]))
        done = [done[0] + r.bytes, done[1] + r.rows]
    offsets = rows.sparkSession.createDataFrame(before, "range int, bytes_before long, rows_before long")

    order = Window.partitionBy("range").orderBy("h", "tie")
    group = Window.partitionBy("range", "h")
    reach = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ordered = placed.withColumns({"end": reach, "row": F.row_number().over(order)}).withColumns({
        "group_bytes": F.sum("size").over(group), "group_start": F.min(F.col("end") - F.col("size")).over(group)})
    together = F.col("large").isNull()  # such a group lies in one range
    # the middle of the record, or of its group, doubled to stay whole
    middle = F.when(together, 2 * F.col("group_start") + F.col("group_bytes")).otherwise(2 * F.col("end") - F.col("size"))
    known = rows.sparkSession.createDataFrame([(h, True) for h in sorted(large)], "h long, large boolean")
    at = ordered.join(F.broadcast(known), "h", "left").join(F.broadcast(offsets), "range").select(  # one row per range, at most MOST_RANGES and their splits
        "doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("row") - 1).alias("place"),
        (2 * F.col("bytes_before") + middle).alias("middle"))
    sharded = store(at.withColumn(
        "shard", F.floor(F.col("middle").cast("decimal(38,0)") * shards / (2 * total)).cast("int")).drop("middle"), "shards")
    firsts = sharded.groupBy("shard").agg(F.min("place").alias("first"))
    return sharded.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
