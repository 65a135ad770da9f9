"""Canonical tables on disk.

Big tables are partitioned by a bounded hash bucket of the video, not by the video itself, and a bucket is written by
several tasks, so a hot video neither makes one huge file nor do many videos make many small folders.
"""

from clipgrid.sinks.tables import (
    key_frame_rows,
    run_summaries,
    tube_set_tables,
    write_grounding,
    write_key_frames,
    write_masks,
    write_outcomes,
    write_tube_sets,
)

__all__ = [
    "key_frame_rows",
    "run_summaries",
    "tube_set_tables",
    "write_grounding",
    "write_key_frames",
    "write_masks",
    "write_outcomes",
    "write_tube_sets",
]
