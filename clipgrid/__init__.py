"""clipgrid: Spark jobs over tables of video clips, sampled frames, boxes and binary masks."""

__version__ = "0.1.0"
