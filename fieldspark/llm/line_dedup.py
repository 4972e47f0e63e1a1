"""Line deduplication through a sharded minimal perfect hash.

Lines that many documents share are counted by 128-bit hash. The hashes of the frequent ones are cut into shards by
value; for each shard one task builds a minimal perfect hash: levels of bit arrays, in which a key sits at the first
level where no other key wants its bit, so that the rank of the bit is the key's place. Compact arrays hold each
place's fingerprint, document count and the largest document id. Documents probe those arrays: lines are
never joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import column_bytes, free_name, mix64, slices, store

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys per shard of the index (mean).
SHARD_KEYS = 50_000
#: Bytes of index that a task may hold; a larger index is probed in passes over groups of shards.
INDEX_BYTES = 128 << 20
#: Bytes of index per key: fingerprint, count, owner and the bit arrays with their ranks.
KEY_BYTES = 24
#: Bits of a level per key that is still without a place.
GAMMA = 2
SPACE = b" \t\n\x0b\f\r"

SHARD = "shard int, sizes array<int>, bits binary, fingerprints binary, counts binary, owners binary"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The stripped, lower-cased line, or None if it has fewer than ``min_chars`` code points."""
    if len(line) < min_chars:
        return None
    key = line.strip(SPACE).lower()
    n = len(key)
    if n < min_chars or not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return key


def hash_pair(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h & 0xFFFFFFFFFFFFFFFF, h >> 64


# ---------------------------------------------------------------- counting

def frequent_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int, min_docs: int) -> DataFrame:
    """(h, fingerprint, docs, owner): lines held by at least ``min_docs`` documents; owner is the largest id."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs, fs = [], [], []
            for d, t in zip(batch.column(0).to_pylist(), column_bytes(batch.column(1)), strict=True):
                seen = set()
                for line in (t or b"").split(b"\n"):
                    key = line_key(line, min_chars)
                    if key is not None:
                        seen.add(hash_pair(key))
                ids += [d] * len(seen)
                hs += [h for h, _ in seen]
                fs += [f for _, f in seen]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(hs, np.uint64).view(np.int64)), pa.array(np.array(fs, np.uint64).view(np.int64)),
                 pa.array(ids, pa.int64())], ["h", "fingerprint", "doc"])

    lines = docs.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("t")
    ).mapInArrow(keys, "h long, fingerprint long, doc long")
    # a repeated document counts once: its (line, id) rows meet before they are counted
    return lines.groupBy("h", "fingerprint", "doc").agg(F.lit(1)).groupBy("h", "fingerprint").agg(
        F.count(F.lit(1)).alias("docs"), F.max("doc").alias("owner")
    ).filter(F.col("docs") >= min_docs)


# ---------------------------------------------------------------- the index

def place(keys: np.ndarray, prints: np.ndarray, level: int, sizes: np.ndarray) -> np.ndarray:
    """The bit that each key wants; from the second level on, both halves of its hash decide."""
    step = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (mix64(keys + step + prints * np.uint64(level)) % sizes).astype(np.int64)


def build_shard(keys: np.ndarray, prints: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels in bits, the bit arrays as 64-bit words, and the order of ``keys`` by place."""
    left = np.arange(len(keys))
    sizes, words, order = [], [], []
    while len(left):
        m = -(-GAMMA * len(left) // 64) * 64
        at = place(keys[left], prints[left], len(sizes), np.uint64(m))
        wanted = np.bincount(at, minlength=m)
        alone = wanted[at] == 1
        bits = np.zeros(m, np.uint8)
        bits[at[alone]] = 1
        words.append(np.packbits(bits, bitorder="little").view(np.uint64))
        order.append(left[alone][np.argsort(at[alone])])
        sizes.append(m)
        left = left[~alone]
    empty = np.zeros(0, np.uint64)
    return sizes, np.concatenate([empty, *words]), np.concatenate([np.zeros(0, np.int64), *order])


def index_shards(lines: DataFrame, shards: int) -> DataFrame:
    """One row SHARD per non-empty shard."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows["h"].to_numpy(np.int64).view(np.uint64)
        sizes, bits, order = build_shard(keys, rows["fingerprint"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({
            "shard": [int(rows["shard"].iloc[0])], "sizes": [sizes], "bits": [bits.tobytes()],
            "fingerprints": [rows["fingerprint"].to_numpy(np.int64)[order].tobytes()],
            "counts": [np.minimum(rows["docs"].to_numpy(np.int64), 0xFFFFFFFF).astype(np.uint32)[order].tobytes()],
            "owners": [rows["owner"].to_numpy(np.int64)[order].tobytes()],
        })

    return lines.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, SHARD)


class LineIndex:
    """Shards side by side in flat arrays; ``probe`` finds owner and count of many lines at once."""

    def __init__(self, shards: int, rows: list):
        rows = sorted(rows, key=lambda r: r[0])
        levels = max((len(r[1]) for r in rows), default=0)
        self.shards = shards
        self.sizes = np.zeros((shards, levels), np.uint64)
        self.starts = np.zeros((shards, levels), np.int64)
        at = 0
        for shard, sizes, *_ in rows:
            for level, m in enumerate(sizes):
                self.sizes[shard, level], self.starts[shard, level] = m, at
                at += m

        def joined(k: int, kind) -> np.ndarray:
            return np.frombuffer(b"".join(bytes(r[k]) for r in rows), kind)

        self.bits, self.fingerprints = joined(2, np.uint64), joined(3, np.int64)
        self.counts, self.owners = joined(4, np.uint32), joined(5, np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])

    def probe(self, h: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
        """The place of each line, or -1: all shards and lines at once, level by level."""
        out = np.full(len(h), -1, np.int64)
        keys, prints = h.view(np.uint64), fingerprint.view(np.uint64)
        shard = np.mod(h, self.shards)
        left = np.arange(len(h))
        for level in range(self.sizes.shape[1]):
            left = left[self.sizes[shard[left], level] > 0]
            if not len(left):
                break
            at = self.starts[shard[left], level] + place(
                keys[left], prints[left], level, self.sizes[shard[left], level])
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            there = (word >> bit) & np.uint64(1) == 1
            rank = self.ranks[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[there]] = rank[there]
            left = left[~there]
        found = out >= 0
        found[found] = self.fingerprints[out[found]] == fingerprint[found]
        return np.where(found, out, -1)


# ---------------------------------------------------------------- documents

def probed_column(doc_id: Column, text: Column, index, min_chars: int) -> Column:
    """Struct LINES per document; ``index`` is a Spark broadcast of (number of shards, shard rows)."""
    held: list[LineIndex] = []

    @F.arrow_udf(LINES)
    def probed(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        if not held:
            held.append(LineIndex(*index.value))
        for ids, texts in columns:
            for part in zip(slices(ids), slices(texts), strict=True):
                yield _probed(held[0], *part, min_chars)

    return probed(doc_id.cast("bigint"), text)


LINES = "struct<n_lines:bigint,dropped:array<int>,kept:string>"


def _probed(index: LineIndex, ids: pa.Array, texts: pa.Array, min_chars: int) -> pa.Array:
    docs, row, position, pairs = [], [], [], []
    for r, t in enumerate(column_bytes(texts)):
        docs.append(t)
        for p, line in enumerate((t or b"").split(b"\n")):
            key = line_key(line, min_chars)
            if key is not None:
                row.append(r)
                position.append(p)
                pairs.append(hash_pair(key))
    drops: list[list[int]] = [[] for _ in docs]
    if pairs:
        pair = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        at = index.probe(np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1]))
        own = ids.to_pylist()
        for k in np.flatnonzero(at >= 0):
            if own[row[k]] != index.owners[at[k]]:
                drops[row[k]].append(position[k])
    return pa.StructArray.from_arrays([
        pa.array([1 if t is None else t.count(b"\n") + 1 for t in docs], pa.int64()),
        pa.array(drops, pa.list_(pa.int32())),
        pa.array(map(without, docs, drops), pa.binary()).cast(pa.string()),
    ], names=["n_lines", "dropped", "kept"])


def without(text: bytes | None, drops: list[int]) -> bytes | None:
    """``text`` without the lines at these positions."""
    if not drops:
        return text
    gone = set(drops)
    return b"\n".join(x for p, x in enumerate(text.split(b"\n")) if p not in gone)


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    index_bytes: int = INDEX_BYTES, shard_keys: int = SHARD_KEYS, out: str = "lines",
) -> DataFrame:
    """``docs`` with a struct ``out``: n_lines, dropped (positions of the lines that go), kept (the text without them).

    A line's key is the line stripped of ASCII white space and with A-Z lower-cased. Keys of ``min_chars`` code points
    in ``min_docs`` documents lose all lines but those of the largest document id. Empty texts are one
    empty line and stay; a null text stays null and drops nothing; a document without id holds no line, and loses the
    frequent ones; repeated rows of one document count once and are treated alike.

    The index is built in shards. At most ``index_bytes`` of it are broadcast at once; beyond, the documents
    are read once per group of shards, and the positions found are joined by document, not by line.
    """
    spark = docs.sparkSession
    lines = store(frequent_lines(docs, doc_id, text, min_chars, min_docs), "frequent-lines")
    n = lines.count()
    shards = max(1, -(-n // shard_keys))
    groups = min(shards, max(1, -(-n * KEY_BYTES // index_bytes)))
    built = store(index_shards(lines, shards), "line-index")

    def held(group: int):
        rows = built.filter(F.pmod("shard", F.lit(groups)) == group).collect()  # bounded by index_bytes
        return spark.sparkContext.broadcast((shards, [tuple(r) for r in rows]))

    if groups == 1:
        return docs.withColumn(out, probed_column(F.col(doc_id), F.col(text), held(0), min_chars))
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, F.sha2(F.concat_ws("|", F.col(doc_id).cast("string"), F.col(text)), 256))
    once = keyed.select(key, F.col(doc_id).alias("d"), F.col(text).alias("t")).dropDuplicates([key])
    parts = None
    for group in range(groups):
        index = held(group)
        found = store(once.select(key, probed_column(F.col("d"), F.col("t"), index, min_chars)["dropped"].alias("p"))
                      .filter(F.size("p") > 0), "line-drops")
        index.destroy()
        parts = found if parts is None else parts.unionByName(found)
    merged = parts.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("p"))).alias(f"{key}_drops"))

    @F.arrow_udf(LINES)
    def cut(texts: pa.Array, drops: pa.Array) -> pa.Array:
        docs, gone = list(column_bytes(texts)), [d or [] for d in drops.to_pylist()]
        return pa.StructArray.from_arrays([
            pa.array([1 if t is None else t.count(b"\n") + 1 for t in docs], pa.int64()),
            pa.array(gone, pa.list_(pa.int32())),
            pa.array(map(without, docs, gone), pa.binary()).cast(pa.string()),
        ], names=["n_lines", "dropped", "kept"])

    return keyed.join(merged, key, "left").withColumn(
        out, cut(F.col(text), F.col(f"{key}_drops"))
    ).drop(key, f"{key}_drops")
