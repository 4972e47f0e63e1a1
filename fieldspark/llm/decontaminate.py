"""Benchmark decontamination by Wu-Manber search over words.

Every run of 13 consecutive words of a benchmark item is a test string. Test strings of one length share a
shift table over blocks of two words: the block under the end of the search window tells how far
the window can move without skipping an occurrence. Where the shift is zero, the bucket of that suffix, divided by
the block at the window's start, gives the test strings that are then compared in full.

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import column_bytes, free_name, slices, store, utf8

WINDOW = 13
#: Test strings (window, item) held in one search structure; larger sets are searched block by block.
BLOCK_STRINGS = 200_000

#: What becomes of each byte: A-Z are lower-cased; other ASCII characters than letters and digits part words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

FOUND = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<first:int,last:int>>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class WordPatterns:
    """Wu-Manber tables for word sequences of equal length."""

    def __init__(self, length: int, patterns: Iterable[tuple[bytes, ...]]):
        self.length = length
        self.block = min(2, length)
        self.farthest = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(lambda: defaultdict(list))
        for pattern in patterns:
            for end in range(self.block, length + 1):
                key = pattern[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.farthest), length - end)
            self.buckets[pattern[-self.block:]][pattern[:self.block]].append(pattern)
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(start, pattern) of every occurrence, by start."""
        m, b, shift, farthest = self.length, self.block, self.shift, self.farthest
        end, n = m, len(words)
        while end <= n:
            step = shift.get(tuple(words[end - b:end]), farthest)
            if step:
                end += step
                continue
            start = end - m
            suffix = self.buckets[tuple(words[end - b:end])]
            for pattern in suffix.get(tuple(words[start:start + b]), ()):
                if tuple(words[start:end]) == pattern:
                    yield start, pattern
            end += 1


class Searcher:
    """All test strings of one block of the benchmark, by length."""

    def __init__(self, strings: Iterable[tuple[bytes, str | None]]):
        self.items: dict[tuple[bytes, ...], list] = defaultdict(list)
        for window, item in strings:
            self.items[tuple(window.split())].append(item)
        lengths = defaultdict(list)
        for pattern in self.items:
            lengths[len(pattern)].append(pattern)
        self.tables = [WordPatterns(n, found) for n, found in sorted(lengths.items())]

    def search(self, words: list[bytes]) -> tuple[set, list[tuple[int, int]]]:
        """Items that occur, and the hit word ranges (first, last), merged and in order."""
        items: set = set()
        found: list[tuple[int, int]] = []
        for t in self.tables:
            for start, pattern in t.find(words):
                items.update(self.items[pattern])
                found.append((start, start + t.length - 1))
        return items, merge_spans(found)


def merge_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _row(words: list[bytes], searcher: Searcher) -> dict:
    items, spans = searcher.search(words)
    return {
        "n_words": len(words), "n_hit": sum(b - a + 1 for a, b in spans),
        "items": sorted(i for i in items if i is not None), "spans": [{"first": a, "last": b} for a, b in spans],
    }


def search_column(text: Column, strings) -> Column:
    """The struct FOUND for a text column; ``strings`` is a Spark broadcast of (window, item) pairs."""
    held: list[Searcher] = []

    @F.arrow_udf(FOUND)
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not held:
            held.append(Searcher(strings.value))
        for values in (part for column in texts for part in slices(column)):
            rows = [_row(words_of(v or b""), held[0]) for v in column_bytes(values)]
            yield pa.array(rows, type=_FOUND_ARROW)

    return found(text)


_FOUND_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
])


def benchmark_strings(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (window, item): every run of ``window`` words; a shorter item is one window; null ids stay null."""

    @F.pandas_udf("array<binary>")
    def windows(texts: pd.Series) -> pd.Series:
        def cut(t):
            w = words_of(utf8(t))
            return [b" ".join(w[i:i + window]) for i in range(max(1, len(w) - window + 1))] if w else []

        return texts.map(cut)

    return benchmark.select(
        F.col(item).cast("string").alias("item"), F.explode(windows(F.col(text))).alias("window")
    ).distinct()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
    block_strings: int = BLOCK_STRINGS, out: str = "found",
) -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_hit (words inside an occurring window), items (ids of items with an
    occurring window, sorted as strings) and spans (hit word ranges).

    Null and empty texts have no words; an empty benchmark hits nothing; items with a null id hit words but are not
    listed; repeated rows each get their result; other columns pass through. A set of test strings of at most
    ``block_strings`` is broadcast and the documents are read once without a shuffle. A larger set is
    searched in blocks of that size, one reading of the documents per block, and the hits are joined by text.
    """
    spark = docs.sparkSession
    strings = store(benchmark_strings(benchmark, window=window), "test-strings")
    n = strings.count()
    blocks = max(1, -(-n // block_strings))

    def held(block: int):
        part = strings.filter(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == block) if blocks > 1 else strings
        rows = part.select("window", "item").collect()  # bounded by block_strings
        return spark.sparkContext.broadcast([(bytes(r.window), r.item) for r in rows])

    if blocks == 1:
        return docs.withColumn(out, search_column(F.col(text), held(0)))
    key = free_name(docs, "text_key")
    parts = None
    keyed = docs.select(F.sha2(F.col(text), 256).alias(key), F.col(text).alias("t")).dropDuplicates([key])
    for block in range(blocks):
        strings_b = held(block)
        hit = store(
            keyed.select(key, search_column(F.col("t"), strings_b).alias("f")).filter("f.n_hit > 0"), "block-hits"
        )
        strings_b.destroy()
        parts = hit if parts is None else parts.unionByName(hit)
    merged = parts.groupBy(key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("f.items")))).alias("i"),
        F.flatten(F.collect_list("f.spans")).alias("s"),
    )

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def united(spans: pd.Series) -> pd.Series:
        return spans.map(lambda s: [
            {"first": a, "last": b} for a, b in merge_spans((x["first"], x["last"]) for x in (s if s is not None else ()))
        ])

    none = spark.sparkContext.broadcast([])
    counted = docs.withColumn(out, search_column(F.col(text), none)).withColumn(key, F.sha2(F.col(text), 256))
    joined = counted.join(merged.select(key, "i", united("s").alias("s")).withColumnRenamed("i", f"{key}_i")
                          .withColumnRenamed("s", f"{key}_s"), key, "left")
    spans = F.coalesce(F.col(f"{key}_s"), F.col(f"{out}.spans"))
    n_hit = F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: a + (x["last"] - x["first"] + 1))
    return joined.withColumn(out, F.struct(
        F.col(f"{out}.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce(F.col(f"{key}_i"), F.col(f"{out}.items")).alias("items"), spans.alias("spans"),
    )).drop(key, f"{key}_i", f"{key}_s")


def contaminated(found: str = "found") -> Column:
    """True where at least a twentieth of a document's words are hit."""
    return (F.col(f"{found}.n_hit") > 0) & (F.col(f"{found}.n_hit") * 20 >= F.col(f"{found}.n_words"))
