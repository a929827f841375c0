"""Checks of what files claim: mate pointers as a graph, and reference checksums of slices."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.model import MalformedInputError

#: What can be wrong with a pointer. A pointer to no record is wrong only within a chain; alone it just says nothing.
DANGLING, CLAIMED, CYCLIC = "dangling", "claimed twice", "cyclic"


def mate_faults(reads: DataFrame, key: list[str]) -> DataFrame:
    """(key, rec_no, mate_no, fault): records whose pointer `mate_no` (to a rec_no of equal key, in either direction) is malformed.

    dangling: to no record, from one that is pointed at itself; claimed twice: two records point at the same one; cyclic: a walk along
    the pointers never ends. A record may have several faults. Cycles are looked for only in keys where a pointer goes back or to itself,
    as there must be one in a cycle; pointers are doubled, so a key of n records takes log2(n) joins.
    """
    links = reads.filter("mate_no is not null").select(*key, "rec_no", "mate_no")
    there = reads.select(*key, F.col("rec_no").alias("mate_no")).distinct()
    pointed = links.select(*key, F.col("mate_no").alias("rec_no")).distinct()
    fault = lambda rows, name: rows.select(*key, "rec_no", "mate_no", F.lit(name).alias("fault"))
    dangling = fault(links.join(there, [*key, "mate_no"], "left_anti").join(pointed, [*key, "rec_no"], "left_semi"), DANGLING)
    claims = links.groupBy(*key, "mate_no").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    claimed = fault(links.join(claims, [*key, "mate_no"]), CLAIMED)
    suspects = links.filter("mate_no <= rec_no").select(*key).distinct()
    some = links.join(suspects, key, "left_semi").join(there, [*key, "mate_no"], "left_semi").persist()
    most = some.groupBy(*key).count().agg(F.max("count")).first()[0]
    walk = some.select(*key, "rec_no", F.col("mate_no").alias("at"))
    for _ in range((most or 0).bit_length()):  # after as many doublings a walk has more steps than there are records
        ahead = walk.select(*key, F.col("rec_no").alias("at"), F.col("at").alias("next"))
        walk = walk.join(ahead, [*key, "at"]).select(*key, "rec_no", F.col("next").alias("at")).persist()
    cyclic = fault(some.join(walk.select(*key, "rec_no").distinct(), [*key, "rec_no"], "left_semi"), CYCLIC)
    return dangling.unionByName(claimed).unionByName(cyclic)


def checked_mates(reads: DataFrame, key: list[str]) -> DataFrame:
    """The reads, if no mate pointer among them is malformed; else MalformedInputError names the first that is."""
    bad = mate_faults(reads, key).orderBy(*key, "rec_no", "fault").first()
    if bad is not None:
        where = ", ".join(f"{k} {bad[k]}" for k in key)
        raise MalformedInputError(f"mate pointer of record {bad['rec_no']} ({where}) to {bad['mate_no']} is {bad['fault']}")
    return reads


#: What a checksum leaves out: all but `!` to `~`.
_DROPPED = bytes(b for b in range(256) if not 0x21 <= b <= 0x7E)
_UPPER = bytes(b - 32 if 97 <= b <= 122 else b for b in range(256))


def slice_checksums(slices: DataFrame, chunks: DataFrame, size: int, key: list[str]) -> DataFrame:
    """slices (key, ref_id, span_start, span_end, md5, more) with `md5_ok`: whether the reference under their span has that checksum.

    chunks: (ref_id, chunk, seq) of `size` bases each, as sources.reference_chunks makes them. Each slice's pieces come to one task in order
    and are folded into a checksum one after the other; no span is ever put together. A checksum that is null or all zeros was not
    recorded and passes, as does an empty span's; a span that the chunks do not cover gives null. Keys are unique.
    """
    recorded = F.col("md5").isNotNull() & ~F.col("md5").rlike("^0*$")
    spans = slices.filter(recorded & (F.col("span_end") > F.col("span_start"))).select(*key, "ref_id", F.col("span_start").cast("long").alias("a_"), F.col("span_end").cast("long").alias("b_"))
    touched = spans.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("a_") / size).cast("int"), F.floor((F.col("b_") - 1) / size).cast("int"))))
    at = F.col("chunk").cast("long") * size
    begin, end = F.greatest(F.lit(0).cast("long"), F.col("a_") - at), F.least(F.lit(size).cast("long"), F.col("b_") - at)
    piece = F.substring(F.col("seq"), begin.cast("int") + 1, (end - begin).cast("int"))
    pieces = touched.join(chunks.select("ref_id", "chunk", "seq"), ["ref_id", "chunk"]).select(*key, "chunk", (F.col("b_") - F.col("a_")).alias("wanted_"), piece.alias("piece_"))
    pieces = pieces.repartition(*key).sortWithinPartitions(*key, "chunk")
    n = len(key)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, got, wanted = None, None, 0, 0

        def closed(done: list) -> None:
            if at is not None:
                done.append((*at, digest.hexdigest() if got == wanted else None))

        for batch in batches:
            done: list[tuple] = []
            columns = [batch.column(k).to_pylist() for k in range(n)]
            for i, now in enumerate(zip(*columns, strict=True)):
                if now != at:
                    closed(done)
                    at, digest, got, wanted = now, hashlib.md5(usedforsecurity=False), 0, batch.column(n + 1)[i].as_py()
                text = batch.column(n + 2)[i].as_buffer()
                got += len(text)
                digest.update(bytes(text).translate(_UPPER, _DROPPED))
            yield rows(done)
        done = []
        closed(done)
        yield rows(done)

    schema = T.StructType([*(slices.schema[k] for k in key), T.StructField("found_", T.StringType())])
    kinds = pieces.select(*key).limit(0).toArrow().schema

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * (n + 1)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds.types, pa.string()], strict=True)], [*key, "found_"])

    found = pieces.mapInArrow(folded, schema)
    passes = F.when(~recorded | ~(F.col("span_end") > F.col("span_start")), True).otherwise(F.col("found_") == F.col("md5"))
    return slices.join(found, key, "left").withColumn("md5_ok", passes).drop("found_")
