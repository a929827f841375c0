"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partition, overfull ranges subdivided.

The key of a row is (hash of the text, hash of the id and of a number that rows of equal text and id get), so equal texts are neighbours
in key order while one text's copies can still be cut when they are more than a range holds, whatever their ids. Rows of equal text and
id are counted before they are shuffled, and dealt out again in parts. Only DataFrame functions run.

Cases: a null text has no bytes and a null checksum; a null id is hashed as null; repeated rows each get a slot; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import fraction, kept, table

LAW = "bytes"

#: So many rows of equal text and id stay in one part.
TOGETHER = 4096


def _range_of(key: Column, splitters: list[str]) -> Column:
    """Number of splitters at or below the key, by a coarse and a fine step."""
    if not splitters:
        return F.lit(0)
    step = max(1, round(len(splitters) ** 0.5))
    groups = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    firsts = F.array(*[F.lit(g[0]) for g in groups])
    fine = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
    below = lambda a: F.size(F.filter(a, lambda x: x <= key))
    coarse = below(firsts)
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + below(F.element_at(fine, F.greatest(coarse, F.lit(1))))).cast("int")


def split_ranges(rows: DataFrame, n_ranges: int, samples_per_range: int, max_range_bytes: int, seed: int = 11) -> tuple[DataFrame, int, int]:
    """rows (key string of 32 hex digits, size long, more) with unit columns (rng, sub, part); total bytes and rows.

    The driver sees about n_ranges * samples_per_range sampled keys, whatever the input's size.
    """
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if not n:
        return rows.withColumns({"rng": F.lit(0), "sub": F.lit(0), "part": F.lit(0)}), 0, 0
    weight = F.col("size") * float(n_ranges * samples_per_range) / float(total)
    drawn = rows.filter(fraction("key", F.lit(seed)) < weight).select("key", F.greatest(weight, F.lit(1.0)).alias("w")).orderBy("key").collect()
    cum, at = [], 0.0
    for r in drawn:
        at += r["w"]
        cum.append(at)
    picks = [drawn[min(len(drawn) - 1, bisect_left(cum, at * i / n_ranges))]["key"] for i in range(1, n_ranges)] if drawn else []
    splitters = sorted(set(picks))
    rows = rows.withColumn("rng", _range_of(F.col("key"), splitters))
    # a range over 1.25 times its share is cut evenly in hash space, what is still overfull (one text's copies) by the id's hash
    limit = float(min(max_range_bytes, max(1.0, 1.25 * total / n_ranges)))
    lo, hi = ["0" * 32, *splitters], [*splitters, "g" * 32]
    number = lambda s: 1.0 if s[0] == "g" else int(s[:12], 16) / float(1 << 48)
    one_text = [a[:16] == b[:16] for a, b in zip(lo, hi, strict=True)]
    base = [number(a[16:]) if one else number(a) for a, one in zip(lo, one_text, strict=True)]
    width = [max(1e-15, (number(b[16:]) if one else number(b)) - x) for b, x, one in zip(hi, base, one_text, strict=True)]
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("rng") + 1)
    at_key = lambda c, start: F.conv(F.substring(c, start, 12), 16, 10).cast("double") / float(1 << 48)
    place = F.when(pick(one_text), at_key(F.col("key"), 17)).otherwise(at_key(F.col("key"), 1))
    full = rows.groupBy("rng").agg(F.sum("size").alias("range_bytes")).select("rng", F.ceil(F.col("range_bytes") / limit).cast("int").alias("n_sub"))
    rows = rows.join(full, "rng").withColumn("sub", F.greatest(F.lit(0), F.least(F.col("n_sub") - 1, F.floor((place - pick(base)) / pick(width) * F.col("n_sub")).cast("int"))))
    over = rows.groupBy("rng", "sub").agg(F.sum("size").alias("sub_bytes")).select("rng", "sub", F.ceil(F.col("sub_bytes") / (2 * limit)).cast("int").alias("n_part"))
    rows = rows.join(over, ["rng", "sub"]).withColumn("part", F.least(F.col("n_part") - 1, F.floor(at_key(F.col("key"), 17) * F.col("n_part")).cast("int")))
    return kept(rows.drop("n_sub", "n_part"), "shard-units"), int(total), int(n)


def shard(docs: DataFrame, n_shards: int = 24, ranges_per_shard: int = 8, samples_per_range: int = 32, max_range_bytes: int = 256 << 20, whole_group: float = 1 / 32) -> DataFrame:
    """Rows of `docs` as (doc_id, size, text_crc32, law, shard, slot, grown_shard): shards of nearly equal bytes.

    A shard's bytes differ from the mean by at most one document, or one group of equal texts of up to `whole_group` of a shard,
    at either end. Slots count from 0 in key order within a shard.
    """
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    groups = kept(rows.groupBy("doc_id", "size", "text_crc32", "text_hash").agg(F.count(F.lit(1)).alias("n")), "shard-groups")
    parts = groups.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {TOGETHER}"))))
    if not groups.filter(F.col("n") > TOGETHER).isEmpty():
        parts = parts.repartition("text_hash", "doc_id", "at")
    first = F.col("at") * TOGETHER
    rows = parts.withColumn("nr", F.explode(F.sequence(first, F.least(F.col("n"), first + TOGETHER) - 1)))
    key = F.concat(F.lpad(F.hex("text_hash"), 16, "0"), F.lpad(F.hex(F.xxhash64("doc_id", "nr")), 16, "0"))
    rows, total, _ = split_ranges(rows.select("doc_id", "size", "text_crc32", key.alias("key")), n_shards * ranges_per_shard, samples_per_range, max_range_bytes)
    unit = ["rng", "sub", "part"]
    sizes = rows.groupBy(*unit).agg(F.sum("size").alias("unit_bytes"))
    by_range = sizes.groupBy("rng").agg(F.sum("unit_bytes").alias("range_bytes")).withColumn("range_at", F.sum("range_bytes").over(Window.orderBy("rng")) - F.col("range_bytes"))
    places = sizes.join(by_range, "rng").withColumn("unit_at", F.col("range_at") + F.sum("unit_bytes").over(Window.partitionBy("rng").orderBy("sub", "part")) - F.col("unit_bytes"))
    order = ["key", "doc_id"]
    in_unit = Window.partitionBy(*unit).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy(*unit, "text_key")
    rows = (
        rows.join(places.select(*unit, "unit_at"), unit)
        .withColumn("text_key", F.substring("key", 1, 16))
        .withColumn("row_at", F.col("unit_at") + F.sum("size").over(in_unit) - F.col("size"))
        .withColumns({"group_at": F.min("row_at").over(group), "group_bytes": F.sum("size").over(group)})
    )
    middle = F.when(F.col("group_bytes") <= total * whole_group / n_shards, F.col("group_at") + F.col("group_bytes") / 2).otherwise(F.col("row_at") + F.col("size") / 2)
    rows = rows.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / max(1, total))).cast("int"))
    before = Window.partitionBy("shard").orderBy(*unit)
    counts = rows.groupBy("shard", *unit).agg(F.count(F.lit(1)).alias("unit_rows")).withColumn("slot_at", F.sum("unit_rows").over(before) - F.col("unit_rows"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*unit, "shard").orderBy(*order)))
    return rows.join(counts.select("shard", *unit, "slot_at"), ["shard", *unit]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("slot_at") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
