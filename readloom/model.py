"""Schemas, flag bits and errors of the alignment model. Coordinates are 0-based and half-open everywhere."""

from __future__ import annotations

from pyspark.sql import types as T


class AlignmentError(Exception):
    """Base of this library's errors."""


class MalformedInputError(AlignmentError):
    """A source holds something that its format does not allow."""


class ArgumentError(AlignmentError):
    """A caller asked for something that does not exist."""


class UnsupportedError(AlignmentError):
    """A format or version that this library does not read."""


#: SAM flag bits, fixed by the format.
FLAGS = {
    "is_paired": 1, "is_properly_paired": 2, "is_segment_unmapped": 4, "is_mate_unmapped": 8, "is_reverse_complemented": 16, "is_mate_reverse_complemented": 32,
    "is_read1": 64, "is_read2": 128, "is_secondary": 256, "is_failed_qc": 512, "is_duplicate": 1024, "is_supplementary": 2048,
}

#: Bits of the per-record storage flags, fixed by the format.
STORAGE_FLAGS = {"is_preserving_quality_scores": 1, "is_detached": 2, "has_mate_downstream": 4, "is_unknown_bases": 8}

#: Op codes of packed CIGARs, fixed by the format: the place in this text.
CIGAR_OPS = "MIDNSHP=X"

UNPLACED = -1

FEATURE = T.StructType([T.StructField("code", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("ref_pos", T.IntegerType()), T.StructField("num", T.IntegerType()), T.StructField("payload", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("sub", T.StringType())])

TAG_VALUE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("i", T.LongType()), T.StructField("f", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("ai", T.ArrayType(T.LongType())), T.StructField("af", T.ArrayType(T.DoubleType())), T.StructField("sub", T.StringType())])

CRAI = T.StructType([T.StructField(x, T.LongType(), False) for x in ("seq_id", "start", "span", "container_start", "slice_start", "slice_bytes")])
