"""Mates: reads with their partners, chains of segments, template lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions.pairs import template_length
from readloom.model import ArgumentError, MalformedInputError
from readloom.operators.ranges import range_query, slice_statistics


def view_as_pairs(reads: DataFrame, sequence_id: int, start, end, max_insert_size: int = 200_000, pair_across: bool = False, slice_width: int = 1000, strict_mates: bool = False, unique: str = "unique_id", index: DataFrame | None = None, slice_column: str | None = None) -> DataFrame:
    """The reads of a range and, after them, their mates from elsewhere, as `is_mate`.

    A name that occurs once among the reads of the range is looked up where its mate is said to start, on the same sequence unless
    `pair_across`, and closer than `max_insert_size`. The slices found there (stretches of `slice_width` starts) give all reads of
    such names that were not in the range; with `strict_mates`, only those that start where a mate is said to.

    index: stored `slice_statistics` of the reads, which spares a scan of them; slice_column: the reads' column that holds their slice,
    by which a partitioned table is pruned. A read of the range without a name fails the job. Repeated rows count as reads each.
    """
    hits = range_query(reads, sequence_id, start, end)
    named = F.coalesce("read_name", F.raise_error(F.lit(f"{ArgumentError.__name__}: pairs are found by name, and a read has none")).cast(reads.schema["read_name"].dataType))
    hits = hits.withColumn("read_name", named)
    single = hits.groupBy("read_name").agg(F.count(F.lit(1)).alias("n_")).filter("n_ = 1").select("read_name")
    wanted = hits.join(single, "read_name", "left_semi").filter(F.col("next_sequence_id").isNotNull() & (F.abs(F.col("start") - F.col("next_start")) < max_insert_size))
    if not pair_across:
        wanted = wanted.filter(F.col("next_sequence_id") == sequence_id)
    loci = wanted.select(F.col("next_sequence_id").alias("seq_"), F.col("next_start").alias("at_")).distinct()
    stats = (slice_statistics(reads, slice_width) if index is None else index).select("sequence_id", "slice", "first", "last")
    # a slice may reach beyond its own starts by its longest span: look slices up by equality on the stretches that can reach a locus
    reach = stats.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("first") / slice_width), F.floor((F.col("last") - 1) / slice_width))))
    loci = loci.withColumn("stretch_", F.floor(F.col("at_") / slice_width))
    found = reach.join(loci, (F.col("sequence_id") == F.col("seq_")) & (F.col("stretch") == F.col("stretch_")) & (F.col("first") <= F.col("at_")) & (F.col("last") > F.col("at_")))
    slices = found.select(F.col("sequence_id").alias("seq_"), F.col("slice").alias("slice_")).distinct()
    own = F.col(slice_column) if slice_column else F.floor(F.col("start") / slice_width).cast("long")
    there = reads.join(slices, (F.col("sequence_id") == F.col("seq_")) & (own == F.col("slice_")), "left_semi")
    mates = there.join(single, "read_name", "left_semi").join(hits.select(unique), unique, "left_anti")
    if strict_mates:
        mates = mates.join(wanted.select("read_name", F.col("next_sequence_id").alias("sequence_id"), F.col("next_start").alias("start")).distinct(), ["read_name", "sequence_id", "start"], "left_semi")
    return hits.withColumn("is_mate", F.lit(False)).unionByName(mates.select(*reads.columns, F.lit(True).alias("is_mate")))


def pair_template_lengths(reads: DataFrame, mate: str, key: list[str], read_length: str = "read_length") -> DataFrame:
    """Reads that point at a mate by `mate` (a row number among rows of equal `key`), with the template length of the two."""
    other = reads.select(*key, F.col("rec_no").alias("mate_no"), F.col("start").alias("mate_start"), F.col(read_length).alias("mate_length"))
    joined = reads.join(other.withColumnRenamed("mate_no", mate), [*key, mate])
    return joined.withColumn("template_length", template_length(F.col("start"), F.col(read_length), F.col("mate_start"), F.col("mate_length")))


def _heads(links: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, head) of each of n rows and the first row of the chain that it is on; links[i] is the row that i points at, or -1.

    A row that several rows point at comes once for each way to it.
    """
    source = np.flatnonzero(links >= 0)
    target = links[source]
    free = np.ones(n, bool)
    free[target] = False
    row, up = np.concatenate((np.flatnonzero(free), target)), np.concatenate((np.flatnonzero(free), source))
    order = np.argsort(row, kind="stable")
    row, up = row[order], up[order]
    while True:
        first = np.searchsorted(row, np.arange(n + 1))
        ways = np.diff(first)[up]
        nth = np.arange(ways.sum()) - np.repeat(np.cumsum(ways) - ways, ways)
        above = up[np.repeat(first[up], ways) + nth]
        row, old = np.repeat(row, ways), np.repeat(up, ways)
        if (above == old).all():
            return row, above
        up = above


def _block_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of blocks, each block's first marked, its rows in order of record numbers: with the chain that each is on.

    Blocks that are whole go on; the last one of a batch waits for the next batch, so a block at most is held beside a batch.
    """

    def chained(rows: pa.RecordBatch) -> pa.RecordBatch:
        begins = rows.column("begins_").to_numpy(zero_copy_only=False).astype(bool)
        no, block = rows.column("no_").to_numpy(), np.cumsum(begins) - 1
        known = np.flatnonzero(~np.asarray(rows.column("to_").is_null()))
        to = rows.column("to_").fill_null(-1).to_numpy()[known]
        # record numbers as distances from their block's first, below the width of a block: one order over all blocks
        base, width = no[np.flatnonzero(begins)], int((no - no[np.flatnonzero(begins)][block]).max()) + 1
        inside = (to - base[block[known]] >= 0) & (to - base[block[known]] < width)
        known, to = known[inside], to[inside]
        place = block * width + no - base[block]
        wanted = block[known] * width + to - base[block[known]]
        at = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
        links = np.full(len(no), -1)
        links[known] = np.where(place[at] == wanted, at, -1)
        row, head = _heads(links, len(no))
        kept = rows.select([c for c in rows.schema.names if c not in ("begins_", "no_", "to_")])
        if len(row) != len(no):
            kept = kept.take(pa.array(row))
        return pa.RecordBatch.from_arrays([*kept.columns, pa.array(no[head])], [*kept.schema.names, "chain"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        starts = np.flatnonzero(batch.column("begins_").to_numpy(zero_copy_only=False))
        if not len(starts):
            held.append(batch)
            continue
        whole = [*held, *([batch.slice(0, starts[-1])] if starts[-1] else [])]
        held = [batch.slice(starts[-1])]
        if whole:
            yield chained(pa.concat_batches(whole))
    if held:
        yield chained(pa.concat_batches(held))


def mate_chains(reads: DataFrame, key: list[str], max_steps: int = 64, block: int = 1 << 14) -> DataFrame:
    """Reads with `chain`, the first record number of the chain of mate pointers (rec_no -> mate_no, forward) that they are on.

    Pointers that go back raise. Where none leaves its block of `block` record numbers, which one look at the pointers tells, a task goes
    once over its blocks in order and nothing is joined. Otherwise pointers are doubled in joins, so a chain of n segments takes log2(n)
    of them, and chains that `max_steps` doublings don't end raise. Record numbers are unique within a key; a pointer to no read is the
    start of a chain there; reads with a null in their key or number are on none and don't occur.
    """
    of = lambda c: F.floor(F.col(c) / block).cast("long")
    back, far = reads.filter("mate_no is not null").agg(F.bool_or(F.col("rec_no") >= F.col("mate_no")), F.bool_or(of("rec_no") != of("mate_no"))).first()
    if back:
        raise MalformedInputError("a mate pointer does not point forward")
    if far:
        return _doubled(reads, key, max_steps)
    others = [c for c in reads.columns if c not in (*key, "rec_no")]
    rows = reads.dropna(subset=[*key, "rec_no"]).withColumn("block_", of("rec_no"))
    w = Window.partitionBy(*key, "block_").orderBy("rec_no")
    rows = rows.select(*key, "rec_no", *others, (F.row_number().over(w) == 1).alias("begins_"), F.col("rec_no").cast("long").alias("no_"), F.col("mate_no").cast("long").alias("to_"))
    number = reads.schema["rec_no"].dataType
    schema = T.StructType([*rows.schema.fields[:-3], T.StructField("chain", T.LongType())])
    return rows.mapInArrow(_block_chains, schema).withColumn("chain", F.col("chain").cast(number))


def _doubled(reads: DataFrame, key: list[str], max_steps: int) -> DataFrame:
    """The same by joins, for chains of any reach."""
    links = reads.filter("mate_no is not null").select(*key, F.col("mate_no").alias("rec_no"), F.col("rec_no").alias("up"))
    heads, last = reads.select(*key, "rec_no").join(links, [*key, "rec_no"], "left").withColumn("up", F.coalesce("up", F.col("rec_no"))), None
    for _ in range(max_steps):
        above = heads.select(*key, F.col("rec_no").alias("up"), F.col("up").alias("up2"))
        nxt = heads.join(above, [*key, "up"]).select(*key, "rec_no", F.col("up2").alias("up"), (F.col("up2") != F.col("up")).alias("moved")).persist()
        done = nxt.filter("moved").isEmpty()
        heads = nxt.drop("moved")
        if last is not None and not done:
            nxt.count()  # all of it is there before what it came from goes
            last.unpersist()
        last = nxt
        if done:
            return reads.join(heads.withColumnRenamed("up", "chain"), [*key, "rec_no"])
    raise MalformedInputError(f"a chain of mates is longer than {max_steps} doublings")


def chain_template_lengths(chained: DataFrame, key: list[str], read_length: str = "read_length") -> DataFrame:
    """Template lengths over chains of at least two segments: positive for every segment at the chain's least start."""
    w = Window.partitionBy(*key, "chain")
    first, last, n = F.min("start").over(w), F.max(F.col("start") + F.col(read_length)).over(w), F.count(F.lit(1)).over(w)
    rows = chained.withColumns({"first_": first, "span_": last - first, "n_": n})
    return rows.withColumn("template_length", F.when(F.col("n_") > 1, F.when(F.col("start") == F.col("first_"), F.col("span_")).otherwise(-F.col("span_")))).drop("first_", "span_", "n_")




def associate_mates(reads: DataFrame, key: list[str]) -> DataFrame:
    """Mate positions and flags from forward pointers `mate_no` among rows of equal `key`.

    A read with a pointer gets its mate's place as its next one, and counts as paired; the mate gets this read's place if it has
    neither a next place nor a pointer of its own, so the last of three segments points at the second. Unmapped and reverse
    flags go both ways. Needs rec_no, mate_no, flags, sequence_id, start, next_sequence_id, next_start.
    """
    bits = lambda f: F.when(f.bitwiseAND(F.lit(4)) != 0, 8).otherwise(0).bitwiseOR(F.when(f.bitwiseAND(F.lit(16)) != 0, 32).otherwise(0))
    place = lambda n, p: [*key, F.col(n).alias(f"{p}no"), F.col("flags").alias(f"{p}flags"), F.col("sequence_id").alias(f"{p}seq"), F.col("start").alias(f"{p}start")]
    ahead = reads.select(*place("rec_no", "a_")).withColumnRenamed("a_no", "mate_no")
    behind = reads.filter("mate_no is not null").select(*place("mate_no", "b_")).withColumnRenamed("b_no", "rec_no")
    rows = reads.join(ahead, [*key, "mate_no"], "left").join(behind, [*key, "rec_no"], "left")
    linked, back = F.col("a_flags").isNotNull(), F.col("b_flags").isNotNull() & F.col("mate_no").isNull() & F.col("next_sequence_id").isNull()
    flags = F.col("flags").bitwiseOR(F.when(linked, F.lit(1).bitwiseOR(bits(F.col("a_flags")))).otherwise(0)).bitwiseOR(F.when(F.col("b_flags").isNotNull(), bits(F.col("b_flags"))).otherwise(0))
    done = rows.withColumns({
        "flags": flags,
        "next_sequence_id": F.when(linked, F.col("a_seq")).when(back, F.col("b_seq")).otherwise(F.col("next_sequence_id")),
        "next_start": F.when(linked, F.col("a_start")).when(back, F.col("b_start")).otherwise(F.col("next_start")),
    })
    return done.select(*reads.columns)


def propagate_names(chained: DataFrame, key: list[str], unique: str = "unique_id") -> DataFrame:
    """Reads without a stored name get that of their chain: its first read's name, or else that read's unique id as text."""
    others = [c for c in chained.columns if c not in (*key, "chain")]
    head, w = F.col("rec_no") == F.col("chain"), Window.partitionBy(*key, "chain")
    names = chained.dropna(subset=[*key, "chain"]).withColumns({"head_": F.bool_or(head).over(w), "chain_name": F.max(F.when(head, F.coalesce("read_name", F.col(unique).cast("string")))).over(w)})
    return names.filter("head_").withColumn("read_name", F.coalesce("read_name", "chain_name")).select(*key, "chain", *others)
