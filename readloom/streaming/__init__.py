"""Range queries over alignments that arrive as a stream."""

from readloom.streaming.mates import stream_mates
from readloom.streaming.progress import slice_progress, stream_range

__all__ = ["slice_progress", "stream_mates", "stream_range"]
