"""Mixing sources to target weights: blocks of fixed length, multinomial counts per output shard, permuted block indexes.

Each source's documents form one stream of words, cut into blocks of `block_words`. Every output slot draws its source from the
target shares, which gives each shard multinomial counts; slots beyond a source's quota go to the sources left short. The j-th slot of
a source takes block perm_e(j mod n) of the source's n blocks, e = j div n, with another pseudorandom affine permutation for each pass
e; the last slot is cut, so a source gives exactly its target in whole words. Slots and blocks meet in a join by index. Only DataFrame
functions run, and any number of sources stays in DataFrames; the driver sees sums, and one row for each output shard.

Cases: a null text or one without words has size 0 and is never taken; a null source is a source of its own, last in order; a
null id is kept; repeated rows are separate documents; an empty table gives no rows; other columns are ignored, or kept by
`mixed_documents`, whatever they are called.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import ROW, carried, fraction, giving_back, kept, quoted, table

WEIGHTS = (3, 1, 2)

#: Steps of permutations: primes under 10 ** 7, so a step times an index fits a long for 10 ** 11 blocks.
STEPS = (9_999_907, 9_999_929, 9_999_931, 9_999_937, 9_999_943, 9_999_971, 9_999_973, 9_999_991)

#: Running sums go over stretches of so many numbers, and then within each.
STRETCH = 4096

#: So many sources are broadcast; more meet their documents in a join that AQE splits where a source is hot.
FEW_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows, numbered by src from 0 on, with `name`, the sum of `value` over the rows before: over stretches, and then within each."""
    rows = rows.withColumn("stretch", F.floor(F.col("src") / STRETCH))
    sums = rows.groupBy("stretch").agg(F.sum(value).alias("whole"))
    sums = sums.select("stretch", (F.sum("whole").over(Window.orderBy("stretch")) - F.col("whole")).alias("before"))
    within = Window.partitionBy("stretch").orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(sums, "stretch").withColumn(name, F.col("before") + F.sum(value).over(within) - F.col(value)).drop("stretch", "before")


def _measures(doc_id: Column, text: Column) -> tuple[Column, Column]:
    return n_words(text).alias("size"), F.xxhash64(doc_id, text).alias("text_key")


def place(docs: DataFrame, bucket_rows: int = 20_000, measured: bool = False) -> DataFrame:
    """(doc_id, source, size, text_key, bucket, nth, start): each document's first word in its source's stream.

    Starts are sums over buckets of hashed ids and texts and then within a bucket, so no task holds a whole source. `measured` docs have size and
    text_key in place of a text; their nr tells rows of equal id and text apart, and stays, as does `at`.
    """
    nr, own = ([c for c in some if measured and c in docs.columns] for some in (("nr",), ("nr", "at")))
    rows = kept(docs if measured else docs.select("doc_id", "source", *_measures(F.col("doc_id"), F.col("text"))), "mix-rows")
    n = max(1, ceil(rows.count() / bucket_rows))
    rows = rows.withColumns({"bucket": F.pmod(F.xxhash64("text_key", *nr), F.lit(n)).cast("long"), "no_source": F.col("source").isNull(), "src": F.coalesce("source", F.lit(""))})
    key = ["no_source", "src", "bucket"]
    sums = rows.groupBy(*key).agg(F.sum("size").alias("words")).withColumn("bucket_at", F.sum("words").over(Window.partitionBy("no_source", "src").orderBy("bucket")) - F.col("words")).drop("words")
    w = Window.partitionBy(*key).orderBy("doc_id", "text_key", *nr).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(sums, key)
        .withColumns({"nth": F.row_number().over(w), "start": F.col("bucket_at") + F.sum("size").over(w) - F.col("size")})
        .select("doc_id", "source", "size", "text_key", "bucket", "nth", "start", *own)
    )


def source_targets(placed: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(src, source, source_size, target): sources numbered by code point, null last.

    share * all sizes dealt by weight; what exceeds most * size is dealt again among the others until nothing does.
    """
    sums = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    # numbers in order: the place in a sorted partition, and the sizes of the partitions before
    ordered = kept(sums.orderBy(F.asc_nulls_last("source")).withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftrightunsigned("at", 33)
    sizes = sorted((r["part"], r["count"]) for r in ordered.groupBy(part.alias("part")).count().collect())
    offsets, at = [], 0
    for p, n in sizes:
        offsets += [F.lit(p), F.lit(at).cast("long")]
        at += n
    first = F.element_at(F.create_map(*offsets), part) if offsets else F.lit(0).cast("long")
    rows = ordered.select((first + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("src"), "source", "source_size")
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int")))
    limit, some = F.col("source_size") * float(most), F.col("source_size") > 0
    total, unit, n_full = rows.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while total:
        full = some & (F.col("weight") * unit > limit)
        r = rows.agg(F.count_if(full).alias("n"), F.sum(F.when(full, limit)).alias("given"), F.sum(F.when(some & ~full, F.col("weight"))).alias("open")).first()
        if r["n"] == n_full or not r["open"]:
            break
        unit, n_full = (share * total - (r["given"] or 0.0)) / r["open"], r["n"]
    target = F.when(some, F.least(limit, F.col("weight") * unit)).otherwise(0.0)
    return rows.select("src", "source", "source_size", target.alias("target"))


def _quotas(sources: DataFrame, block_words: int, seed: int) -> DataFrame:
    """sources with their blocks, the slots that they fill, and the words of the last of these."""
    size, b = F.col("source_size"), F.lit(block_words).cast("long")
    rows = sources.withColumns({"n_blocks": F.ceil(size / b), "goal": F.round("target").cast("long")})
    rows = rows.withColumns({"full": F.when(size > 0, F.expr("goal div source_size")).otherwise(0).cast("long"), "rest": F.when(size > 0, F.col("goal") % size).otherwise(0).cast("long")})
    rows = rows.withColumns({"lack": F.col("n_blocks") * b - size, "short_at": _short_at(F.col("full"), seed)})  # the last block's lack of words, and its place in the last pass
    plain = F.ceil(F.col("rest") / b)
    more = F.when(F.col("short_at") >= plain, plain).otherwise(F.ceil((F.col("rest") + F.col("lack")) / b))
    rows = rows.withColumn("more", F.when(F.col("rest") > 0, more).otherwise(0))
    before = (F.col("more") - 1) * b - F.when(F.col("short_at") < F.col("more") - 1, F.col("lack")).otherwise(0)
    return rows.withColumns({"quota": F.col("full") * F.col("n_blocks") + F.col("more"), "cut": F.when(F.col("more") > 0, F.col("rest") - before).otherwise(b)}).select("src", "source", "source_size", "target", "n_blocks", "quota", "cut")


def _short_at(pass_: Column, seed: int) -> Column:
    """The index at which a pass comes to the source's last block."""
    return F.pmod(F.xxhash64(F.col("src"), pass_.cast("long"), F.lit(seed)), F.greatest(F.lit(1).cast("long"), F.col("n_blocks")))


def _block(pass_: Column, index: Column, seed: int) -> Column:
    """An affine permutation of a source's blocks: the step is a prime that does not divide their number."""
    n = F.col("n_blocks")
    steps = F.filter(F.array(*[F.lit(p).cast("long") for p in STEPS]), lambda p: n % p != 0)
    step = F.get(steps, F.pmod(F.xxhash64(F.col("src"), pass_.cast("long"), F.lit(seed + 1)), F.size(steps)).cast("int")) % n
    first = F.pmod(n - 1 - (_short_at(pass_, seed) * step) % n, n)
    return (index * step + first) % n


def _runs(sources: DataFrame, n_slots: int, n_shards: int, seed: int) -> DataFrame:
    """(shard, src, first ordinal, n, and the source's n_blocks, quota and cut): draws beyond a quota go to the sources that were drawn too seldom."""
    ranges = running(sources.filter("quota > 0"), "quota", "from")
    width = max(1, ceil(n_slots / (STRETCH + sources.count())))
    bins = ranges.select("src", "from", (F.col("from") + F.col("quota")).alias("to")).withColumn("bin", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor((F.col("to") - 1) / width))))
    draws = sources.sparkSession.range(n_slots).select((F.col("id") * n_shards / n_slots).cast("int").alias("shard"), F.floor(fraction("id", F.lit(seed)) * n_slots).alias("x"))
    met = draws.withColumn("bin", F.floor(F.col("x") / width)).join(bins, "bin").filter((F.col("x") >= F.col("from")) & (F.col("x") < F.col("to")))
    drawn = met.groupBy("shard", "src").agg(F.count(F.lit(1)).alias("got"))
    drawn = kept(drawn.join(sources, "src").withColumn("first", F.sum("got").over(Window.partitionBy("src").orderBy("shard")) - F.col("got")), "mix-drawn")
    drawn = drawn.withColumn("n", F.greatest(F.lit(0), F.least("got", F.col("quota") - F.col("first"))))
    of = ["n_blocks", "quota", "cut"]
    own = drawn.filter("n > 0").select("shard", "src", "first", "n", *of)
    spare, at = [], 0
    for r in drawn.groupBy("shard").agg(F.sum(F.col("got") - F.col("n")).alias("spare")).orderBy("shard").collect():  # a row for each shard
        if r["spare"]:
            spare.append(F.struct(F.lit(r["shard"]).alias("shard"), F.lit(at).cast("long").alias("lo"), F.lit(at + r["spare"]).cast("long").alias("hi")))
            at += r["spare"]
    if not spare:
        return own
    used = drawn.groupBy("src").agg(F.sum("n").alias("used"))
    left = sources.join(used, "src", "left").withColumn("left", F.col("quota") - F.coalesce("used", F.lit(0))).filter("left > 0")
    left = running(left, "left", "lo").withColumn("hi", F.col("lo") + F.col("left"))
    lo, hi = F.greatest("lo", "x.lo"), F.least("hi", "x.hi")
    given = left.withColumn("x", F.explode(F.filter(F.array(*spare), lambda x: (x["hi"] > F.col("lo")) & (x["lo"] < F.col("hi")))))
    return own.unionByName(given.select("x.shard", "src", (F.col("quota") - F.col("left") + lo - F.col("lo")).alias("first"), (hi - lo).alias("n"), *of))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = 128, n_shards: int = 64, seed: int = 5, bucket_rows: int = 20_000, measured: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pieces, placed, sources).

    pieces: the mix, as (shard, slot, pass, source, doc_id, text_key, bucket, nth, word_from, word_to), words of a document counted
    from 0; placed: place(docs); sources: (source, source_size, target). A source's words are taken at most ceil(most) times.
    """
    with giving_back(docs.sparkSession) as stay:
        placed = kept(place(docs, bucket_rows, measured), "mix-placed")
        sources = kept(_quotas(source_targets(placed, weights, share, most), block_words, seed), "mix-targets")
        n_slots = sources.agg(F.sum("quota")).first()[0] or 0
        runs = _runs(sources, n_slots, n_shards, seed) if n_slots else sources.selectExpr("0 as shard", "src", "0L as first", "0L as n", "n_blocks", "quota", "cut").limit(0)
        runs = kept(runs.withColumn("slot0", F.sum("n").over(Window.partitionBy("shard").orderBy("src", "first").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")), "mix-runs")
        stay += [placed, sources, runs]
    many = STRETCH  # slots that one row stands for before the second explode
    slots = (
        runs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / many))))
        .repartition(F.col("shard"), F.col("src"), F.col("part"))
        .withColumn("i", F.explode(F.sequence(F.col("part") * many, F.least(F.col("n") - 1, F.col("part") * many + many - 1))))
        .withColumns({"ordinal": F.col("first") + F.col("i"), "slot": F.col("slot0") + F.col("i")})
        .withColumns({"pass": F.expr("ordinal div n_blocks").cast("int"), "index": F.col("ordinal") % F.col("n_blocks")})
        .withColumns({"block": _block(F.col("pass"), F.col("index"), seed), "most_words": F.when(F.col("ordinal") == F.col("quota") - 1, F.col("cut")).otherwise(block_words)})
        .select("src", "block", "shard", "slot", "pass", "most_words")
    )
    size = F.lit(block_words).cast("long")
    contents = _joined(placed.filter("size > 0"), sources.select("src", F.col("source").alias("source_")))
    contents = contents.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("size") - 1) / size)))).select(
        "src", "block", "source", "doc_id", "text_key", "bucket", "nth", "start", F.greatest(F.lit(0).cast("long"), F.col("block") * size - F.col("start")).alias("word_from"), F.least(F.col("size"), (F.col("block") + 1) * size - F.col("start")).alias("word_to")
    )
    pieces = slots.hint("merge").join(contents, ["src", "block"]).withColumn("word_to", F.least("word_to", F.col("block") * size + F.col("most_words") - F.col("start"))).filter("word_to > word_from")
    return pieces.select("shard", "slot", "pass", "source", "doc_id", "text_key", "bucket", "nth", "word_from", "word_to"), placed, sources.select("source", "source_size", "target")


def _joined(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with what sources (source_, ...) say of their source."""
    few = sources.count() <= FEW_SOURCES
    return rows.join(F.broadcast(sources) if few else sources, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")


def taken(pieces: DataFrame, placed: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words of each document in the mix, repeats counted."""
    key = ["source", "bucket", "nth", "doc_id"]
    none = placed.select(*key, "size", F.lit(0).cast("long").alias("words"))
    some = pieces.select(*key, F.lit(0).cast("long").alias("size"), (F.col("word_to") - F.col("word_from")).alias("words"))
    sums = none.unionByName(some).groupBy(*key).agg(F.sum("size").alias("size"), F.sum("words").alias("taken"))
    return _joined(sums, sources.withColumnRenamed("source", "source_")).select("doc_id", "size", "source_size", "target", "taken")


def _told_apart(rows: DataFrame) -> DataFrame:
    """rows (at, row_key, more) with nr in place of row_key: a hash of it and of how many rows like it come before.

    The numbers that equal rows get don't depend on how rows lie in partitions (only which of them gets which does). Equal rows are numbered
    within each partition of `at`, then after those of the partitions before, so none are gathered in one task.
    """
    rows, key = rows.withColumn("part", F.shiftrightunsigned("at", 33)), ["row_key", "part"]
    before = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("row_key").orderBy("part")) - F.col("n")).drop("n")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("at"))
    return rows.join(before, key).withColumn("nr", F.xxhash64("row_key", F.col("before") + nth)).drop("before", *key)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents with the columns of `docs`: for each pass that takes words of a document, those words in order.

    A document taken whole keeps its text as it is; else its text is the words taken, each with the white space after it.
    n_chars, if there is such a column, follows the text. Repeated rows are separate documents: rows are written with a place of their own,
    and copies find their row by it; where a row stands in its source's stream doesn't depend on it.
    """
    rows = kept(carried(docs).withColumn("at", F.monotonically_increasing_id()), "mix-docs")
    of = lambda c: F.col(f"{ROW}.{quoted(c)}")
    plain = [of(f.name) for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    measured = kept(rows.select("at", of("doc_id").alias("doc_id"), of("source").alias("source"), *_measures(of("doc_id"), of("text")), F.xxhash64(*plain).alias("row_key")), "mix-measured")
    pieces, placed, _ = mix(_told_apart(measured), measured=True, **how)
    copies = pieces.groupBy("source", "bucket", "nth", "pass").agg(F.array_sort(F.collect_list(F.struct("word_from", "word_to"))).alias("spans"), F.sum(F.col("word_to") - F.col("word_from")).alias("words"))
    whole = placed.select(F.col("source").alias("source_"), F.col("bucket").alias("bucket_"), F.col("nth").alias("nth_"), "size", "at")
    copies = copies.join(whole, (F.col("bucket") == F.col("bucket_")) & (F.col("nth") == F.col("nth_")) & F.col("source").eqNullSafe(F.col("source_")))
    joined = rows.join(copies.select("at", "spans", (F.col("words") == F.col("size")).alias("is_whole")), "at")
    parts = F.regexp_extract_all(F.col(f"{ROW}.text"), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    slices = F.transform(F.array(parts), lambda p: F.transform("spans", lambda s: F.slice(p, (s["word_from"] + 1).cast("int"), (s["word_to"] - s["word_from"]).cast("int"))))
    text = F.when(F.col("is_whole"), F.col(f"{ROW}.text")).otherwise(F.array_join(F.flatten(F.flatten(slices)), ""))
    joined = joined.withColumn("new_text", text).withColumn(ROW, F.col(ROW).withField("text", F.col("new_text")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn(ROW, F.col(ROW).withField("n_chars", F.length("new_text").cast(docs.schema["n_chars"].dataType)))
    return joined.select(f"{ROW}.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(*mix(table(spark, sf_dir, "documents")))
