"""N-gram Jaccard join in the metric space of shingle sets, distance 1 - Jaccard, exact at a similarity of `similar` percent.

Documents with equal sets form classes, and only one representative of a class goes on. Unrelated texts are all at distance 1 from
each other and from every pivot, so no pivot could tell their regions apart; the outermost regions are therefore cut by a condition
that is exact too: two sets that link share one of the first n - ceil(0.8 n) + 1 shingles of each in any common order. The order
puts shingles that many documents share last. The documents that hold one such shingle are a region. Then, for all regions at once:

- each region's first pivot is its member of lowest hashed rank; all members are measured against it (distinct pairs over all
  regions at once), and those within the threshold join its Voronoi cell: they are linked to the pivot, hence connected, and no
  pair within a cell is compared;
- what is left are pairs of members of different cells, and of these only those in the triangle-inequality window
  |d(x, p) - d(y, p)| <= 0.2 of a pivot p that both were measured against, which is where cells replicate their boundary;
- a region whose pairs across cells are few for its size (at most `leaf` a member, doubled with every round) compares them in a join, one
  of up to `room` members in a task that holds its members' counts; a larger one recurses with twice as many pivots as before, drawn from outside its largest cell, and the member nearest to the last pivot, which tends to the middle of
  a cluster. Pivots leave the region once measured, so the recursion ends, after a number of rounds logarithmic in the region's size.

Pairs already in one component are not compared again; `all_links=True` turns that off, and every link between representatives is
found. Before texts are fetched, pairs pass two necessary conditions: sizes within a factor of 0.8, and shingle counts in 256 hash
buckets that differ by at most (|x| + |y|) / 9 in sum.

Cases: a null or empty text, or one without words, has an empty set and links with nothing; a text of fewer words than a shingle is
one shingle; a null id keeps its row with a null component; repeated rows are in one class; rows with equal ids count as one document
with all their links; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import ROW, carried, giving_back, kept, kept_by, lean, mix64, shared, signed, table, text_chunks, word_hashes, word_spans
from readloom.llm.graph import components

BUCKETS = 256
_K = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct shingle hashes in order) for every text."""
    for first, buf, off in text_chunks(texts):
        s, e, bounds = word_spans(buf, off)
        h = word_hashes(buf, s, e)
        n = max(0, len(h) - width + 1)
        wide = np.zeros(n, np.uint64)
        for j in range(width):
            wide += h[j : j + n] * _K[j]
        wide = mix64(wide)
        for i in range(len(off) - 1):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= width:
                x = np.sort(wide[a : b - width + 1])
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
            elif b > a:
                x = mix64(np.array([(h[a:b] * _K[32 : 32 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
            else:
                x = np.zeros(0, np.uint64)
            yield first + i, x


def _describe(width: int, with_common: bool):
    """doc rows (doc_id, n, s1, s2) and, with_common, rows (hash, seen) of shingles met more than once in a stretch of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def common() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            u, c = u[c > 1], c[c > 1]
            none = lambda t: pa.nulls(len(u), t)
            return pa.RecordBatch.from_arrays([none(id_type), none(pa.int64()), none(pa.int64()), none(pa.int64()), pa.array(signed(u)), pa.array(c.astype(np.int64))], names)

        names = ["doc_id", "n", "s1", "s2", "hash", "seen"]
        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            n = np.zeros(len(batch), np.int64)
            s1, s2 = np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.uint64)
            for row, x in shingle_sets(batch.column("text"), width):
                n[row] = len(x)
                s1[row] = x.sum(dtype=np.uint64)
                s2[row] = mix64(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                if with_common:
                    held.append(x)
                    size += len(x)
                    if size > 1_500_000:
                        yield common()
                        held, size = [], 0
            z = lambda t: pa.nulls(len(batch), t)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(signed(s1)), pa.array(signed(s2)), z(pa.int64()), z(pa.int64())], names)
        if held:
            yield common()

    return run


def _counted(width: int):
    """(id, text) with `counts`, the shingles of the text by hash bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[bytes] = [b""] * len(batch)
            for row, x in shingle_sets(batch.column("text"), width):
                counts[row] = np.minimum(np.bincount((x >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS), 255).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.binary())], ["id", "text", "counts"])

    return run


def _prefixes(width: int, similar: int, common):
    """(id, n, rank, prefix): the first shingles of each set, those in `common` (hashes in order, ranks) last.

    Low ranks go to texts with few shingles of their own, which are in the middle of a large cluster; ties go by hashed id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = common.value
        for batch in batches:
            n, own = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            firsts: list[np.ndarray] = [np.zeros(0, np.int64)] * len(batch)
            for row, x in shingle_sets(batch.column("text"), width):
                n[row] = len(x)
                if not len(x):
                    continue
                k = len(x) - (similar * len(x) + 99) // 100 + 1
                own[row] = 1023
                if len(known):
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    hot = known[at] == x
                    if hot.any():
                        rare = x[~hot]
                        own[row] = 1023 * len(rare) // len(x)
                        if len(rare) < k:
                            late = x[hot][np.argsort(ranks[at[hot]], kind="stable")]
                            rare = np.concatenate((rare, late[: k - len(rare)]))
                        x = rare
                firsts[row] = signed(x[:k])
            sizes = np.array([len(x) for x in firsts])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.concatenate(firsts) if len(firsts) else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(own), lists], ["id", "n", "own", "prefix"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (h, rank): every row of a run of equal h but the first, with the first as its pivot."""
    last = None  # h, id, n and rank of the current run's first row
    for batch in batches:
        if not len(batch):
            continue
        h = batch.column("h").to_numpy(zero_copy_only=False)
        first = np.concatenate(([last is None or h[0] != last[0]], h[1:] != h[:-1]))
        start = np.maximum.accumulate(np.where(first, np.arange(len(h)), -1))
        keep = pa.array(np.flatnonzero(~first))
        pivot = [batch.column(c).take(pa.array(np.maximum(start, 0))) for c in ("id", "n", "rank")]
        if last is not None and start[0] < 0:
            inner = pa.array(start >= 0)
            pivot = [pa.compute.if_else(inner, x, pa.scalar(v, x.type)) for x, v in zip(pivot, last[1:], strict=True)]
        if len(keep):
            p, n, rank = (x.take(keep) for x in pivot)
            own = [batch.column(c).take(keep) for c in ("h", "id", "n", "rank")]
            yield pa.RecordBatch.from_arrays([own[0], p, own[1], n, own[2], rank, own[3]], ["h", "p", "x", "np", "nx", "rp", "rx"])
        i = int(start[-1])
        if i >= 0:
            last = (h[-1], *(batch.column(c)[i].as_py() for c in ("id", "n", "rank")))


def _distances(width: int):
    """(p, x, shared, n_union) from (p, x, p_text, x_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, union = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for (row, p), (_, x) in zip(shingle_sets(batch.column("p_text"), width), shingle_sets(batch.column("x_text"), width), strict=True):
                shared[row] = len(np.intersect1d(p, x, assume_unique=True))
                union[row] = len(p) + len(x) - shared[row]
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("x"), pa.array(shared), pa.array(union)], ["p", "x", "shared", "n_union"])

    return run


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs whose bucket counts differ by at most (np + nx) * (100 - similar) / (100 + similar), which `most` holds."""
    for batch in batches:
        if len(batch):
            grid = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int32) for c in ("p_counts", "x_counts")]
            ok = np.abs(grid[0] - grid[1]).sum(1) <= batch.column("most").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("x")], ["p", "x"]).filter(pa.array(ok))


def _near_in_region(similar: int):
    """(p, x) of a region's pairs across cells that pass all necessary conditions, from its members with their counts."""

    def run(region: pa.Table) -> pa.Table:
        n, main = region["n"].to_numpy(), region["main_cell"].to_numpy(zero_copy_only=False)
        d = region["d"].to_numpy(zero_copy_only=False).astype(np.float64)
        label = region["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        counts = np.frombuffer(b"".join(region["counts"].to_pylist()), np.uint8).reshape(-1, BUCKETS)
        ids = region["id"].combine_chunks()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.arange(len(n))
        for i in np.flatnonzero(~main).tolist():
            ok = (label != label[i]) & (main | (order > i)) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * similar)
            ok &= ~(np.abs(d - d[i]) > (100 - similar) / 100 + 1e-9)
            j = np.flatnonzero(ok)
            if len(j):
                apart = np.abs(counts[j].astype(np.int16) - counts[i].astype(np.int16)).sum(1, dtype=np.int64)
                j = j[apart * (100 + similar) <= (n[j] + n[i]) * (100 - similar)]
                found.append((np.full(len(j), i), j))
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        p, x = ids.take(pa.array(a)), ids.take(pa.array(b))
        swap = pa.compute.greater(p, x)
        return pa.table({"p": pa.compute.if_else(swap, x, p), "x": pa.compute.if_else(swap, p, x)})

    return run


class JaccardJoin:
    """The join over docs (doc_id, text); see the module's text. `members`, `links` and `labels` are its results."""

    def __init__(self, docs: DataFrame, width: int = 5, similar: int = 80, leaf: int = 32, room: int = 4096, common_from: int = 16, common_share: float = 1e-4, busy: int = 256, hot_rows: int = 200_000, all_links: bool = False):
        self.docs, self.width, self.similar, self.leaf, self.room, self.busy, self.hot_rows, self.all_links = docs.select("doc_id", "text"), width, similar, leaf, room, busy, hot_rows, all_links
        self.id_type = docs.schema["doc_id"].dataType.simpleString()
        with giving_back(docs.sparkSession) as stay:
            self._made(width, common_from, common_share)
            stay += [self.described, self.classes, self.links, self.labels]

    def _made(self, width: int, common_from: int, common_share: float) -> None:
        self.described = described = kept(self.docs.mapInArrow(_describe(width, True), f"doc_id {self.id_type}, n long, s1 long, s2 long, hash long, seen long"), "shingled")
        rows = described.filter("hash is null").select("doc_id", "n", "s1", "s2")
        #: (s1, s2, n, rep): classes of equal sets
        self.classes = kept(rows.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")).filter("rep is not null"), "classes")
        self.rows = rows
        self.common = self._common(described.filter("hash is not null"), max(common_from, int(common_share * rows.count())))
        links, self.labels = self._join()
        self.links = kept(links, "links")

    def _common(self, seen: DataFrame, least: int):
        """Shingles that at least `least` documents share, as far as stretches of documents show it; only the order depends on it.

        At most (words of the corpus) / least of them can exist; the bound doubles until they are under four million.
        """
        sums = seen.groupBy("hash").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= least)
        while sums.count() > 4_000_000:
            least *= 2
            sums = sums.filter(F.col("seen") >= least)
        found = sums.toPandas()
        hashes = found["hash"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        return shared(self.docs.sparkSession, (hashes[order], found["seen"].to_numpy(np.int64)[order]))

    def _measured(self, pairs: DataFrame) -> DataFrame:
        """(p, x, d) of distinct pairs (p, x, np, nx) that pass the necessary conditions; d: distance, linked: within the threshold."""
        s = self.similar
        pairs = kept(pairs.filter(f"least(np, nx) * 100 >= greatest(np, nx) * {s}").select("p", "x", ((F.col("np") + F.col("nx")) * (100 - s) / (100 + s)).alias("most")).distinct(), "pairs")
        busy = F.col("p").isin(self._busy(pairs))
        # `items` is bucketed by id: the pairs go to it, first by pivot and then, with the pivot's counts, by member, which is the even side
        of = lambda c: self.items.select(F.col("id").alias(c), F.col("counts").alias(f"{c}_counts"))
        small = lambda df: df.hint("shuffle_hash")
        few = small(pairs.filter(~busy)).join(of("p"), "p")
        many = pairs.filter(busy).join(F.broadcast(of("p").filter(busy)), "p")  # under 1000 pivots with `BUCKETS` bytes each
        both = small(few.unionByName(many)).join(of("x"), "x").select("p", "x", "most", "p_counts", "x_counts")
        return self._verified(both.mapInArrow(lean(_apart), f"p {self.id_type}, x {self.id_type}"))

    def _busy(self, pairs: DataFrame) -> list:
        """Pivots with more than `busy` of the written pairs and more than a thousandth of them, so fewer than 1000: no task gets all their pairs."""
        least = max(self.busy, pairs.count() // 1000)
        return [r["p"] for r in pairs.groupBy("p").count().filter(F.col("count") > least).select("p").collect()]

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """(p, x, d, linked) of distinct pairs (p, x), from their texts."""
        of = lambda c: self.items.select(F.col("id").alias(c), F.col("text").alias(f"{c}_text"))
        small = lambda df: df.hint("shuffle_hash")
        pairs = kept(pairs, "near")
        pivots = self._busy(pairs)
        busy = F.col("p").isin(pivots)
        few = pairs.filter(~busy)
        wanted = of("x").join(small(few.select("x").distinct()), "x", "left_semi")
        both = small(few).join(of("p"), "p").join(wanted, "x").select("p", "x", "p_text", "x_text")
        if pivots:  # their pairs are dealt by member into as many slots as there are partitions, each with its copy of the pivot
            n = int(self.items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            ours = of("p").filter(busy).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            theirs = small(pairs.filter(busy)).join(of("x"), "x").withColumn("slot", F.pmod(F.xxhash64("x"), F.lit(n)).cast("int"))
            both = both.unionByName(theirs.join(ours.hint("merge"), ["p", "slot"]).select("p", "x", "p_text", "x_text"))
        found = both.mapInArrow(lean(_distances(self.width)), f"p {self.id_type}, x {self.id_type}, shared long, n_union long")
        return kept(found.select("p", "x", (1 - F.col("shared") / F.col("n_union")).alias("d"), (F.col("shared") * 100 >= F.col("n_union") * self.similar).alias("linked")), "measured")

    def _crowded(self, live: DataFrame, leaf: int) -> DataFrame:
        """(p, x): near pairs of regions that have more pairs than a leaf but room in one task."""
        mid = live.filter((F.col("cross") > leaf * F.col("m")) & (F.col("m") <= self.room)).select("h", "id", "n", "d", "label", (F.col("label") == F.col("main")).alias("main_cell"))
        mid = mid.hint("shuffle_hash").join(self.items.select("id", "counts"), "id")
        return mid.groupBy("h").applyInArrow(_near_in_region(self.similar), f"p {self.id_type}, x {self.id_type}").distinct()

    def _merged(self, labels: DataFrame | None, links: DataFrame) -> DataFrame:
        """(id, label) after the components of `labels` that `links` connect have become one; ids without links don't occur."""
        new = links.select(F.col("p").alias("id")).unionByName(links.select(F.col("x").alias("id"))).distinct()
        if labels is None:
            labels, edges = new.withColumn("label", F.col("id")), links.select(F.col("p").alias("a"), F.col("x").alias("b"))
        else:
            of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
            edges = links.join(of("p"), "p", "left").join(of("x"), "x", "left").select(F.coalesce("lp", "p").alias("a"), F.coalesce("lx", "x").alias("b")).filter("a <> b").distinct()
            if edges.isEmpty():
                return labels
            labels = labels.unionByName(new.join(labels, "id", "left_anti").withColumn("label", F.col("id")))
        found = components(edges).select(F.col("id").alias("label"), F.col("label").alias("least"))
        return kept(labels.join(found, "label", "left").select("id", F.coalesce("least", "label").alias("label")), "labels")

    def _apart(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs (p, x, np, nx) that no links connect so far, each once."""
        if self.all_links:
            return pairs.distinct()
        of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
        pairs = pairs.distinct().join(of("p"), "p", "left").join(of("x"), "x", "left")
        return pairs.filter(F.coalesce("lp", "p") != F.coalesce("lx", "x")).select("p", "x", "np", "nx")

    def _live(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """members (h, id, n, rank, d) of regions with pairs left to compare, with label, and the region's size, pairs and largest cell."""
        if self.all_links:
            rows = members.withColumn("label", F.col("id"))
        else:
            rows = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        cells = rows.groupBy("h", "label").agg(F.count(F.lit(1)).alias("c"))
        size = cells.groupBy("h").agg(F.sum("c").alias("m"), ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("cross"), F.max_by("label", F.struct("c", "label")).alias("main"))
        return kept(rows.join(size.filter("cross > 0"), "h"), "members")

    def _leaf_pairs(self, live: DataFrame, leaf: int) -> DataFrame:
        s, eps = self.similar, (100 - self.similar) / 100 + 1e-9
        small = live.filter(F.col("cross") <= leaf * F.col("m"))
        side = lambda t: small.select("h", *[F.col(c).alias(f"{c}_{t}") for c in ("id", "n", "d", "label")], (F.col("label") == F.col("main")).alias(f"main_{t}"))
        across = (F.col("label_a") != F.col("label_b")) & (F.col("main_b") | (F.col("id_a") < F.col("id_b")))
        near = F.coalesce(F.abs(F.col("d_a") - F.col("d_b")) <= eps, F.lit(True))
        fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * s
        pairs = side("a").filter("not main_a").join(side("b"), "h").filter(across & near & fits)
        return pairs.select(F.least("id_a", "id_b").alias("p"), F.greatest("id_a", "id_b").alias("x"), F.when(F.col("id_a") < F.col("id_b"), F.col("n_a")).otherwise(F.col("n_b")).alias("np"), F.when(F.col("id_a") < F.col("id_b"), F.col("n_b")).otherwise(F.col("n_a")).alias("nx"))

    def _region_stars(self, rows: DataFrame) -> DataFrame:
        """(h, p, x, np, nx, rp, rx): every member x of a region h but the first in rank, with that one, p, as its pivot.

        A region lies in one task, in order of rank, unless `common` shows it to have over `hot_rows` members: those regions' first
        members are found by a pre-aggregated minimum and are broadcast, so their members stay where they are.
        """
        rank = lambda df: df.select("h", "id", "n", (F.shiftleft("own", 32) + F.shiftrightunsigned(F.xxhash64("id"), 32)).alias("rank"))
        schema = f"h long, p {self.id_type}, x {self.id_type}, np long, nx long, rp long, rx long"
        ordered = lambda df: rank(df.repartition("h")).sortWithinPartitions("h", "rank", "id").mapInArrow(lean(_stars), schema)
        hashes, seen = self.common.value
        hot = hashes[seen > self.hot_rows]  # at most (shingles of all sets) / hot_rows of them
        if not len(hot):
            return ordered(rows)
        spark = rows.sparkSession
        marks = spark.createDataFrame([(int(h),) for h in signed(hot)], "h long")
        rows = kept(rows, "prefixes")
        some = rank(rows.join(F.broadcast(marks), "h"))
        first = some.groupBy("h").agg(F.min(F.struct("rank", "id", "n")).alias("v")).select("h", F.col("v.id").alias("p"), F.col("v.n").alias("np"), F.col("v.rank").alias("rp"))
        stars = some.join(F.broadcast(first), "h").select("h", "p", F.col("id").alias("x"), "np", F.col("n").alias("nx"), "rp", F.col("rank").alias("rx"))
        return ordered(rows.join(F.broadcast(marks), "h", "left_anti")).unionByName(stars)

    def _join(self) -> tuple[DataFrame, DataFrame]:
        prefixes = self.docs.filter("doc_id is not null").mapInArrow(lean(_prefixes(self.width, self.similar, self.common)), f"id {self.id_type}, n long, own long, prefix array<long>")
        prefixes = prefixes.join(self.classes.select(F.col("rep").alias("id"), "n"), ["id", "n"], "left_semi")
        rows = prefixes.select("id", "n", "own", F.explode("prefix").alias("h")).select("h", "id", "n", "own")
        stars = kept(self._region_stars(rows).filter("p <> x"), "stars")
        ids = stars.select(F.col("p").alias("doc_id")).unionByName(stars.select(F.col("x").alias("doc_id"))).distinct()
        # this join deals the texts by id, which is how the table keeps them: they are shuffled once
        texts = self.docs.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text")
        self.items = kept_by(texts.mapInArrow(lean(_counted(self.width)), f"id {self.id_type}, text string, counts binary"), "id", "items", dealt=True)
        # each member first meets one pivot, the lowest in rank of all its regions' pivots, then those pivots it is not yet connected to
        best = stars.groupBy("x", "nx").agg(F.min(F.struct("rp", "p", "np")).alias("v")).select("v.p", "x", "v.np", "nx")
        first = self._measured(best)
        labels = self._merged(None, first.filter("linked"))
        more = self._measured(self._apart(stars.select("p", "x", "np", "nx"), labels).join(first, ["p", "x"], "left_anti"))
        links = first.filter("linked").unionByName(more.filter("linked"))
        labels = self._merged(labels, more.filter("linked"))
        measured = first.unionByName(more).groupBy("p", "x").agg(F.min("d").alias("d"))
        members = stars.join(measured, ["p", "x"], "left").select("h", F.col("x").alias("id"), F.col("nx").alias("n"), F.col("rx").alias("rank"), "d")
        n_pivots, leaf = 4, self.leaf
        while True:
            live = self._live(members, labels)
            found = self._measured(self._leaf_pairs(live, leaf)).unionByName(self._verified(self._crowded(live, leaf))).filter("linked")
            links = links.unionByName(found)
            labels = labels if found.isEmpty() else self._merged(labels, found)  # every round's, not only the last one's
            large = live.filter((F.col("cross") > leaf * F.col("m")) & (F.col("m") > self.room))
            if large.isEmpty():
                return links.select("p", "x", "d").distinct(), labels
            # pivots: the member nearest to the last pivot (k = -1), and by bucket of rank members outside the largest cell
            outer = large.filter("label <> main").groupBy("h", F.pmod("rank", F.lit(n_pivots)).alias("k")).agg(F.min(F.struct("rank", "id", "n", "label")).alias("v")).select("h", "k", "v.id", "v.n", "v.label")
            nearest = large.groupBy("h").agg(F.min(F.struct(F.coalesce("d", F.lit(2.0)).alias("at"), "rank", "id", "n", "label")).alias("v")).select("h", F.lit(-1).cast("long").alias("k"), "v.id", "v.n", "v.label")
            pivots = kept(nearest.unionByName(outer).groupBy("h", "id").agg(F.min("k").alias("k"), F.min("n").alias("np"), F.min("label").alias("lp")).withColumnRenamed("id", "p"), "pivots")
            rest = large.join(pivots.select("h", F.col("p").alias("id")), ["h", "id"], "left_anti").select("h", "id", "n", "rank")
            every = large.select("h", F.col("id").alias("x"), F.col("n").alias("nx"), "label").join(pivots, "h").filter((F.col("x") != F.col("p")) & (F.col("label") != F.col("lp")))
            measured = self._measured(every.select("p", "x", "np", "nx"))
            found = measured.filter("linked")
            links = links.unionByName(found)
            labels = self._merged(labels, found)
            first = pivots.filter("k = -1").select("h", "p").join(measured.select("p", F.col("x").alias("id"), "d"), "p").select("h", "id", "d")
            members = rest.join(first, ["h", "id"], "left")
            n_pivots, leaf = 2 * n_pivots, 2 * leaf

    def result(self) -> DataFrame:
        """(doc_id, n_shingles, component_id), a row for each document."""
        rows = self.rows.join(self.classes, ["s1", "s2", "n"], "left").join(self.labels.select(F.col("id").alias("rep"), "label"), "rep", "left")
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """docs without those that aren't the first of their component, by id; columns as they were."""
    found = JaccardJoin(docs, **how).result()
    extra = found.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("extra_id")).distinct()
    rows = carried(docs, F.col("doc_id").alias("own_id"))
    return rows.join(extra, F.col("own_id") == F.col("extra_id"), "left_anti").select(f"{ROW}.*")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(table(spark, sf_dir, "documents")).result()


OP8_SQL = r"""
with recursive doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), shingle as (
  select distinct doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') as s
  from doc, lateral (select unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i) where len(w) > 0
), size as (select doc_id, count(*) as n from shingle group by doc_id),
pair as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by all
), link as (
  select a, b from pair join size x on x.doc_id = a join size y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)
), edge as (select a, b from link union all select b, a from link),
reach as (
  select doc_id, doc_id as c from doc union select edge.a, reach.c from reach join edge on edge.b = reach.doc_id
)
select doc.doc_id, cast(coalesce(max(n), 0) as bigint) as n_shingles, min(c) as component_id
from doc left join size on doc.doc_id = size.doc_id left join reach on doc.doc_id = reach.doc_id group by doc.doc_id
"""
