"""Structured Streaming. The original job has no streams; this holds only
the incremental form of its append: new input files appended exactly once."""

from tablewright.streaming.incremental import append_stream, read_stream, run_incremental

__all__ = ["append_stream", "read_stream", "run_incremental"]
