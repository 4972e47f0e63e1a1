"""URL filtering with a sorted digest array.

The 64-bit xxhash of every rule (host and path) stands in one sorted array, the rules' full strings beside it. Tasks map
both files into memory. A URL's candidates are all suffixes of its host at dots, each with the beginnings of its path
of those lengths that rules have; all candidates of a batch are found by one vectorised binary search,
and equal digests are confirmed against the stored strings. The longest rule decides.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules that one digest array may hold: 8 bytes each plus their strings, on disk at each executor.
MOST_RULES = 20_000_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def digest(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text)


class DigestArray:
    """The mapped files: sorted digests, and where each rule's string and verdict lie."""

    def __init__(self, folder_of):
        self.digests = np.load(folder_of("digests"), mmap_mode="r")
        self.offsets = np.load(folder_of("offsets"), mmap_mode="r")
        self.blocks = np.load(folder_of("blocks"), mmap_mode="r")
        self.strings = np.load(folder_of("strings"), mmap_mode="r")
        self.lengths = np.load(folder_of("lengths")).tolist()

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """The place of each candidate, or -1."""
        keys = np.fromiter(map(digest, candidates), np.uint64, len(candidates))
        first = np.searchsorted(self.digests, keys, "left")
        last = np.searchsorted(self.digests, keys, "right")
        out = np.full(len(candidates), -1, np.int64)
        for c in np.flatnonzero(last > first):
            for at in range(first[c], last[c]):  # several rules may share a digest
                if bytes(self.strings[self.offsets[at]:self.offsets[at + 1]]) == candidates[c]:
                    out[c] = at
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> list[dict]:
        """Rule and verdict of the longest rule that fits, the longer host first among equals; else (None, None)."""
        owner, candidates = [], []
        for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            labels = host.split(".")
            for i in range(len(labels)):
                suffix = ".".join(labels[i:])
                for n in self.lengths:
                    if n <= len(path):
                        owner.append(k)
                        candidates.append((suffix + path[:n]).encode("utf-8", "surrogatepass"))
        best: list = [None] * len(hosts)
        at = self.find(candidates) if candidates else np.zeros(0, np.int64)
        for c in np.flatnonzero(at >= 0):
            k, length = owner[c], len(candidates[c].decode("utf-8", "surrogatepass"))
            if best[k] is None or length > best[k][0]:  # longer hosts come first
                best[k] = (length, int(at[c]), candidates[c])
        return [
            {"rule": None, "verdict": None} if b is None else
            {"rule": b[2].decode("utf-8", "surrogatepass"), "verdict": "block" if self.blocks[b[1]] else "allow"}
            for b in best
        ]


def _rule_bytes(host: str | None, path: str | None) -> bytes:
    return f"{(host or '').lower()}{path or ''}".encode("utf-8", "surrogatepass")


def build(spark: SparkSession, rules: DataFrame) -> str:
    """Write the digest array of ``rules`` (host, path, verdict) and ship it to the executors; returns its name there.

    Rules are configuration: more than MOST_RULES are refused. Of equal rules that differ, ``block`` wins.
    """
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: use filter_urls_by_join")
    found: dict[bytes, bool] = {}
    lengths = set()
    for r in rules.select("host", "path", "verdict").toLocalIterator():
        key = _rule_bytes(r.host, r.path)
        found[key] = found.get(key, False) or r.verdict == "block"
        lengths.add(len(r.path or ""))
    keys = sorted(found, key=lambda k: (digest(k), k))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="rules-"))
    name = os.path.basename(folder)
    arrays = {
        "digests": np.array([digest(k) for k in keys], np.uint64),
        "offsets": np.cumsum([0, *map(len, keys)], dtype=np.int64),
        "blocks": np.array([found[k] for k in keys], bool),
        "strings": np.frombuffer(b"".join(keys) or b"\0", np.uint8),
        "lengths": np.array(sorted(lengths), np.int64),
    }
    for part, values in arrays.items():
        path = f"{folder}/{name}-{part}.npy"
        np.save(path, values)
        spark.sparkContext.addFile(path)
    return name


def judge_column(host: Column, path: Column, name: str) -> Column:
    """Struct (rule, verdict) by the digest array ``name``."""
    held: list[DigestArray] = []

    @F.arrow_udf("struct<rule:string,verdict:string>")
    def judged(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        if not held:
            held.append(DigestArray(lambda part: SparkFiles.get(f"{name}-{part}.npy")))
        kind = pa.struct([("rule", pa.string()), ("verdict", pa.string())])
        for hosts, paths in columns:
            yield pa.array(held[0].judge(hosts.to_pylist(), paths.to_pylist()), kind)

    return judged(host, path)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (host and path of the longest that fits, or null) and verdict.

    A rule fits its host and all subdomains if the URL's path starts with the rule's. A URL that no rule fits gets
    ``default``: it is not in the array. Null URLs and those without ``://`` have an empty host and path,
    which only a rule without host fits. Repeated rows are judged alike. No shuffle.
    """
    name = build(pages.sparkSession, rules)
    split = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    judged = split.withColumn("judged", judge_column(F.col("host"), F.col("path"), name))
    return judged.withColumns({
        "rule": F.col("judged.rule"), "verdict": F.coalesce("judged.verdict", F.lit(default))}).drop("judged")
