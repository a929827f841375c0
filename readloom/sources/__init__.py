"""Readers of alignment text formats as DataFrames, and the sinks that go with them."""

from readloom.sources.crai import byte_estimate, entries_for_range, has_data, index_entries, read_crai, sequences_with_data
from readloom.sources.fasta import fasta_records, read_fasta, reference_chunks
from readloom.sources.fasta_ranges import fasta_chunks, fasta_index
from readloom.sources.sam import header_lines, read_header, read_sam, references, sam_lines, sam_rows
from readloom.sources.sam_source import SamSource, index_sam, load_sam, sam_range
from readloom.sources.slices import read_range, read_regions, slice_index, write_index, write_slices

__all__ = [
    "SamSource", "byte_estimate", "entries_for_range", "fasta_chunks", "fasta_index", "fasta_records", "has_data", "header_lines", "index_entries", "index_sam", "load_sam", "read_crai", "read_fasta", "read_header", "read_range", "read_regions", "read_sam", "reference_chunks", "references", "sam_lines", "sam_range", "sam_rows", "sequences_with_data", "slice_index", "write_index", "write_slices",
]
