"""Encode-once requests and running label counts as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.detect import first_config

KEYS = ["pipe_id", "image_id"]
#: Groups that share a call and a state; calls and not rows are what a stream of many keys spends its time on.
BUCKETS = 1024
OUT = "pipe_id string, image_id string, event_id bigint, ts timestamp"


def due(times: np.ndarray, last: int | None, ttl: int) -> list[int]:
    """Positions of the requests that find no live encoding; ``times`` ascending.

    One binary search per encode, however many requests lie between.
    """
    hits = []
    k = 0 if last is None else int(np.searchsorted(times, last + ttl))
    while k < len(times):
        hits.append(k)
        k = int(np.searchsorted(times, times[k] + ttl))
    return hits


def _micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy("datetime64[us]").astype(np.int64)


def encode_once(stream: DataFrame, ttl_s: int = 3600, delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Requests that need an encode: the first per key, and the first after each expiry.

    An encoding lives ``ttl_s`` seconds from its encode time; reads do not extend it.
    State is one timestamp per key, held for the keys of a bucket together, and a key is dropped once the watermark has passed its
    expiry. A request that arrives more than ``delay`` behind the newest one seen may be dropped as late, as watermarks do;
    ``encode_once_batch`` keeps every row.
    ``stream``: ``pipe_id, image_id, event_id, ts`` (TIMESTAMP).
    """
    ttl = ttl_s * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        live = dict(zip(zip(*state.get[:2]), state.get[2])) if state.exists else {}
        found = None
        if not state.hasTimedOut:
            rows = pd.concat([f[[*KEYS, "event_id", "ts"]] for f in frames], ignore_index=True)
            rows = rows.sort_values([*KEYS, "ts", "event_id"], kind="stable", ignore_index=True)
            times, picked = _micros(rows["ts"]), []
            starts = np.flatnonzero((rows[KEYS] != rows[KEYS].shift()).any(axis=1).to_numpy())
            names = list(zip(*(rows[k].to_numpy()[starts] for k in KEYS)))
            for name, lo, hi in zip(names, starts, [*starts[1:], len(rows)]):
                at = due(times[lo:hi], live.get(name), ttl)
                if at:
                    live[name] = int(times[lo + at[-1]])
                    picked.extend(lo + k for k in at)
            found = rows[["pipe_id", "image_id", "event_id", "ts"]].iloc[picked]
        # nothing that can still arrive finds the others alive
        live = {name: last for name, last in live.items() if (last + ttl) // 1000 > now}
        if live:
            state.update((*(list(part) for part in zip(*live)), list(live.values())))
            state.setTimeoutTimestamp((min(live.values()) + ttl) // 1000)
        elif state.exists:
            state.remove()
        if found is not None and len(found):
            yield found

    bucket = F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).alias("bucket")
    marked = stream.select(*KEYS, "event_id", "ts", bucket).withWatermark("ts", delay)
    return marked.groupBy("bucket").applyInPandasWithState(
        step, OUT, "pipe_ids array<string>, image_ids array<string>, last_us array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )


def encode_once_batch(requests: DataFrame, ttl_s: int = 3600) -> DataFrame:
    """The same rule over a finished table.

    Rows arrive sorted per key and stream through each task with one timestamp of
    state: no key's rows are held together.
    """
    ttl = ttl_s * 1_000_000

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for pdf in frames:
            times = _micros(pdf["ts"])
            names = list(zip(pdf["pipe_id"], pdf["image_id"]))
            fresh = (pdf[KEYS] != pdf[KEYS].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(fresh)
            picked = []
            for lo, hi in zip(starts, [*starts[1:], len(pdf)]):
                if names[lo] != key:
                    key, last = names[lo], None
                at = due(times[lo:hi], last, ttl)
                if at:
                    last = int(times[lo + at[-1]])
                    picked.extend(lo + k for k in at)
            yield pdf[["pipe_id", "image_id", "event_id", "ts"]].iloc[picked]

    # requests at one instant: only the first can need the encode
    first = requests.groupBy(*KEYS, "ts").agg(F.min("event_id").alias("event_id"))
    ordered = first.repartition(*KEYS).sortWithinPartitions(*KEYS, "ts")
    return ordered.mapInPandas(run, OUT)


def running_label_counts(stream: DataFrame, terms: DataFrame) -> DataFrame:
    """Per-class counts of incoming detections (``term``), for ``complete`` output mode."""
    named = stream.join(F.broadcast(first_config(terms)), "term")
    return named.groupBy(F.col("class_name").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def drain(result: DataFrame, path: str, mode: str = "append") -> None:
    """Run a streaming query over everything available into a Parquet table, then stop."""
    writer = result.writeStream.option("checkpointLocation", f"{path}/_progress").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", f"{path}/table").start()
    else:
        # aggregates in complete mode replace the table at every trigger
        query = writer.outputMode(mode).foreachBatch(
            lambda batch, _id: batch.write.mode("overwrite").parquet(f"{path}/table")
        ).start()
    query.awaitTermination()
