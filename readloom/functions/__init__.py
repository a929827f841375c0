"""Column expressions over alignment rows."""

from readloom.functions.aligned import features_from_alignment
from readloom.functions.bases import mismatch_rows, mismatches, read_bases
from readloom.functions.cigar import cigar_from_features, cigar_length_on_ref, cigar_string, leading_clip, merge_cigar, packed_cigar, parse_cigar, trailing_clip
from readloom.functions.features import length_on_ref, place_features, substitution
from readloom.functions.flags import flag, has_next_position, storage_flag
from readloom.functions.intervals import entry_overlaps, overlaps, read_span
from readloom.functions.pairs import detached_mate, pair_orientation, template_length
from readloom.functions.tags import block_crc32, crc32_ok, get_tag, json_field, last_wins, parse_tags, quality_at, quality_bytes, quality_string, reference_md5, to_json
from readloom.functions.variants import tags_variant, variant_tag, variant_tag_type, variant_tags

__all__ = [
    "block_crc32", "cigar_from_features", "cigar_length_on_ref", "cigar_string", "crc32_ok", "detached_mate", "entry_overlaps", "features_from_alignment", "flag", "get_tag", "has_next_position", "json_field", "last_wins", "leading_clip", "length_on_ref", "merge_cigar", "mismatch_rows", "mismatches", "overlaps", "packed_cigar", "pair_orientation", "parse_cigar", "parse_tags", "place_features",
    "quality_at", "quality_bytes", "quality_string", "read_bases", "read_span", "reference_md5", "storage_flag", "substitution", "tags_variant", "template_length", "to_json", "trailing_clip", "variant_tag", "variant_tag_type", "variant_tags",
]
