"""Orientation and template length of pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions.flags import _c, flag
from readloom.model import FLAGS

#: By (flags >> 4) & 7, and then for the left read of the pair; fixed values.
ORIENTATIONS = "F1F2 F1R2 R1F2 R1R2 F2F1 F2R1 R2F1 R2R1 F2F1 R2F1 F2R1 R2R1 F1F2 R1F2 F1R2 R1R2".split()


def pair_orientation(flags: Column | str = "flags", sequence_id: Column | str = "sequence_id", start: Column | str = "start", next_sequence_id: Column | str = "next_sequence_id", next_start: Column | str = "next_start") -> Column:
    """Such as `F1R2`; null for unpaired reads. Without a known mate position read 1 counts as the left one."""
    f, seq, at, nseq, nat = _c(flags), _c(sequence_id), _c(start), _c(next_sequence_id), _c(next_start)
    read1 = flag("is_read1", f)
    left = F.when(nseq.isNull(), read1).when(seq != nseq, seq < nseq).when(at != nat, at < nat).otherwise(read1)
    place = F.shiftright(f, 4).bitwiseAND(F.lit(7)).bitwiseOR(F.when(left, 8).otherwise(0))
    return F.when(flag("is_paired", f), F.element_at(F.array(*[F.lit(x) for x in ORIENTATIONS]), place + 1))


def template_length(start: Column, read_length: Column, mate_start: Column, mate_read_length: Column) -> Column:
    """Signed template length of a read and its mate, from read lengths; positive for the left read, and for both at equal starts."""
    span = F.greatest(start + read_length, mate_start + mate_read_length) - F.least(start, mate_start)
    return F.when(start <= mate_start, span).otherwise(-span)


def detached_mate(flags: Column | str, mate_flags: Column | str, next_sequence_id: Column | str, next_start: Column | str) -> tuple[Column, Column, Column]:
    """(flags, next_sequence_id, next_start) of a read that stores its mate's fields itself: bit 1 of mate_flags says that the mate is reversed,
    bit 2 that it is unmapped; an id below 0 says that the mate's place is not known. Null mate flags say nothing."""
    bits, seq = F.coalesce(_c(mate_flags), F.lit(0)), _c(next_sequence_id)
    more = F.when(bits.bitwiseAND(F.lit(1)) != 0, FLAGS["is_mate_reverse_complemented"]).otherwise(0).bitwiseOR(F.when(bits.bitwiseAND(F.lit(2)) != 0, FLAGS["is_mate_unmapped"]).otherwise(0))
    return _c(flags).bitwiseOR(more), F.when(seq >= 0, seq), F.when(seq >= 0, _c(next_start))
