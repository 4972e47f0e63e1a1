"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = (
    "fewshot_detections", "class_similarity", "nms_per_image", "final_detections_owlv2", "evaluation_totals",
    "weed_map", "residue_map", "residue_components", "relabelled", "encode_once_batch", "mean_iou", "profile_summary",
)


def main() -> None:
    from fieldspark.catalog import load
    from fieldspark.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    queries, _ = load()
    # one untimed query starts the JVM's code caches and the Python workers
    queries["nms_per_image"](spark, sf.replace("sf0.1", "sf0.001")).count()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
