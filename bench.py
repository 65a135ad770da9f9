"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then ``BENCH_REPEAT`` times into the no-op sink; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from clipgrid.catalog import all_queries  # noqa: E402
from clipgrid.session import build_session  # noqa: E402

HEADLINE = (
    "keyframe_embeddings",
    "keyframe_events",
    "key_frame_flow",
    "frame_sampling",
    "sentence_numbers",
    "time_normalise",
    "subject_noun",
    "reply_parse",
    "stage_join_inner",
    "resume_policies",
    "mask_union",
    "mask_area_box",
    "mask_iou",
    "best_tube",
    "tube_extend",
    "chunk_merge",
    "mask_close_open",
    "attention_fuse",
    "clip_outcomes",
    "score_plugin",
    "propagation_flow",
    "sample_points",
    "threshold_runs",
    "propagation_masks",
    "chunk_waves",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    wanted = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in wanted:
        times = []
        for _ in range(1 + repeat):
            started = time.time()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.time() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
