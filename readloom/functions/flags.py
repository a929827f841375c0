"""Flag predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.model import FLAGS, STORAGE_FLAGS


def flag(name: str, flags: Column | str = "flags") -> Column:
    """Whether the SAM flag of that name (see FLAGS) is set."""
    return _c(flags).bitwiseAND(F.lit(FLAGS[name])) != 0


def storage_flag(name: str, flags: Column | str = "cram_flags") -> Column:
    """Whether the storage flag of that name (see STORAGE_FLAGS) is set."""
    return _c(flags).bitwiseAND(F.lit(STORAGE_FLAGS[name])) != 0


def has_next_position(next_sequence_id: Column | str = "next_sequence_id") -> Column:
    """Whether the file says where the mate is; -1 says that it is unplaced, null that the file doesn't say."""
    return _c(next_sequence_id).isNotNull()


def _listed(c: Column, kind: str) -> Column:
    """A column of lists for a kernel to which null lists are empty ones. Spark sizes an Arrow batch anew with every row, going through all null
    lists since the last one that is none: with nothing but nulls that takes the square of a batch's rows."""
    return F.coalesce(c, F.array().cast(kind))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value) with value worked out once a row; a plain column that a lambda refers to is worked out again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
