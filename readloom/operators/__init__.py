"""Operators over alignment DataFrames."""

from readloom.operators.checks import checked_mates, mate_faults, slice_checksums
from readloom.operators.mates import associate_mates, chain_template_lengths, mate_chains, pair_template_lengths, propagate_names, view_as_pairs
from readloom.operators.ranges import coverage_depth, range_join, range_query, slice_statistics
from readloom.operators.region_index import IntervalIndex, region_join
from readloom.operators.reference import absolute_starts, aligned_features, check_checksums, reference_names, reference_spans, resolve_features, with_reference

__all__ = [
    "IntervalIndex", "absolute_starts", "aligned_features", "associate_mates", "chain_template_lengths", "check_checksums", "checked_mates", "coverage_depth", "mate_chains", "mate_faults", "pair_template_lengths", "propagate_names", "range_join", "range_query", "reference_names", "reference_spans", "region_join", "resolve_features", "slice_checksums", "slice_statistics",
    "view_as_pairs", "with_reference",
]
