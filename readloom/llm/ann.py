"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on an eighth of the vectors, at least about `sample` and at most about `most_sample` of them, so its depth grows with
the table up to that bound; every vector is then filed under the leaf it descends to. A query takes branches from a priority queue,
largest reach first: the inner product with the branch's centre and half of what the radius around it could add to that. How many
leaves are visited is widened until calibration queries, measured against brute force over all rows, reach `target` recall; a query
goes on beyond that until its leaves hold k vectors besides its own. What may be among the best is scored exactly, in double precision,
summed in order of the dimensions.

Neighbouring leaves of up to `block` vectors in all form a group, and a query goes to a group once, with the list of the leaves that it
visits there, whose best vectors come back. Leaves of more than `block` vectors, and groups with more than `block` queries, are cut into
blocks, so copies of one vector or one crowded leaf do not meet in one task. Repeated rows of an id count once.

Cases: null vectors, zero vectors, and those holding a null or non-finite component or of another length than most take no part; a
null id takes no part; with fewer candidates than k all are returned; ties go to the smaller id; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import fraction, kept, table


#: How much of a branch's radius counts towards the inner product that it may hold: 1 would bound it, about half finds the most first.
REACH = 0.5


class KMeansTree:
    """Inner nodes with up to `branch` children each; leaves are numbered from 0."""

    def __init__(self, x: np.ndarray, branch: int = 8, leaf: int = 64, seed: int = 1):
        self.rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = []  # of an inner node's children
        self.radii: list[np.ndarray] = []  # from each of these centres to the vector furthest from it
        self.children: list[list[int]] = []  # >= 0: inner node, < 0: leaf ~c
        self.n_leaves = 0
        self.root = self._grow(x, branch, leaf)

    def _grow(self, x: np.ndarray, branch: int, leaf: int) -> int:
        if len(x) > leaf:
            c, of = self._kmeans(x, branch)
            if len(c) > 1:
                node = len(self.centres)
                self.centres.append(c)
                self.radii.append(np.array([np.sqrt(((x[of == k] - c[k]) ** 2).sum(1).max(initial=0.0)) for k in range(len(c))]))
                self.children.append([])
                self.children[node] = [self._grow(x[of == k], branch, leaf) for k in range(len(c))]
                return node
        self.n_leaves += 1
        return ~(self.n_leaves - 1)

    def _kmeans(self, x: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
        different = np.unique(x, axis=0)
        c = different[self.rng.choice(len(different), min(k, len(different)), replace=False)].astype(np.float64)
        for _ in range(rounds):
            of = self._nearest(x, c)
            used = np.unique(of)
            c = np.stack([x[of == j].mean(0) for j in used])
        return c, self._nearest(x, c)

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((c**2).sum(1) - 2 * (x @ c.T)).argmin(1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                of = self._nearest(x[rows], self.centres[node])
                todo += [(c, rows[of == k]) for k, c in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray, n: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first n leaves that the search for q comes to, and more until they have `least` of what the leaves hold."""
        queue, out, ticket, have, far = [(0.0, 0, self.root)], [], 0, 0, REACH * float(np.linalg.norm(q))
        while queue and (len(out) < n or have < least):
            _, _, node = heapq.heappop(queue)
            if node >= 0:
                reach = (self.centres[node] @ q + far * self.radii[node]).tolist()
                for r, c in zip(reach, self.children[node], strict=True):
                    ticket += 1
                    heapq.heappush(queue, (-r, ticket, c))
            else:
                out.append(~node)
                have += held[~node] if held is not None else least
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _best(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int, asks: np.ndarray | None = None) -> pa.Table:
    """(query_id, vec_id, score): each query's k best of x but itself, ties to smaller ids; `asks` (queries x vectors) says which count.

    A matrix product finds all pairs that can be among the k best, rounding errors of any order of summation allowed for; those are
    scored in order of the dimensions.
    """
    order = np.argsort(x_ids, kind="stable")
    x_ids, x = x_ids[order], x[order]
    starts = np.flatnonzero(np.concatenate(([True], x_ids[1:] != x_ids[:-1]))) if len(x) else np.zeros(0, np.int64)
    slack = 4 * q.shape[1] * np.finfo(float).eps * (np.linalg.norm(x, axis=1).max() if len(x) else 0.0) * np.linalg.norm(q, axis=1)
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(0, len(q), 256):
        s = q[i : i + 256] @ x.T
        s[q_ids[i : i + 256, None] == x_ids[None, :]] = -np.inf
        if asks is not None:
            s[~asks[i : i + 256][:, order]] = -np.inf
        by_id = s if len(starts) == len(x) else np.maximum.reduceat(s, starts, axis=1)
        edge = -np.partition(-by_id, k - 1, 1)[:, k - 1] if by_id.shape[1] > k else np.full(len(s), -np.inf)
        who, what = np.nonzero((s >= (edge - slack[i : i + 256])[:, None]) & np.isfinite(s))
        score = np.zeros(len(who))
        for d in range(q.shape[1]):
            score += q[i + who, d] * x[what, d]
        if len(starts) < len(x):  # an id's best row counts
            best = np.lexsort((-score, x_ids[what], who))
            who, what, score = who[best], what[best], score[best]
            new = np.concatenate(([True], (who[1:] != who[:-1]) | (x_ids[what[1:]] != x_ids[what[:-1]])))[: len(who)]
            who, what, score = who[new], what[new], score[new]
        best = np.lexsort((what, -score, who))
        who, what, score = who[best], what[best], score[best]
        first = np.searchsorted(who, np.arange(len(s)))
        ok = np.arange(len(who)) - first[who] < k
        rows.append((q_ids[i + who[ok]], x_ids[what[ok]], score[ok]))
    columns = [np.concatenate([r[j] for r in rows]) if rows else np.zeros(0, t) for j, t in enumerate((np.int64, np.int64, np.float64))]
    return pa.table(columns, ["query_id", "vec_id", "score"])


def groups_of(sizes: np.ndarray, block: int) -> np.ndarray:
    """The group of each leaf: runs of leaves with at most `block` vectors in all; a larger leaf is a group of its own."""
    out, have, group = np.zeros(len(sizes), np.int64), 0, 0
    for leaf, n in enumerate(sizes.tolist()):
        if have and have + n > block:
            group, have = group + 1, 0
        out[leaf] = group
        have += n
    return out


class TreeIndex:
    """`vectors`: (vec_id long, embedding array). `search` gives (query_id, rank, vec_id, score); `recall` holds what calibration measured."""

    def __init__(self, vectors: DataFrame, sample: int = 20_000, most_sample: int = 262_144, branch: int = 8, leaf: int = 64, k: int = 20, target: float = 0.95, calibration: int = 128, block: int = 4096, seed: int = 2):
        self.k, self.block, self.recall, self.n_visits = k, block, 1.0, 1
        self.spark = vectors.sparkSession
        sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null").filter(sound)
        sizes = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
        self.dim = dim = sizes[0]["dim"] if sizes else 0
        self.rows = rows = rows.filter(F.size("embedding") == dim)
        self.n = sizes[0]["count"] if sizes else 0
        if not self.n:
            return
        wanted = min(max(sample, self.n // 8), most_sample)
        drawn = rows.filter(fraction("vec_id", F.lit(seed)) < min(1.0, wanted / self.n)).orderBy("vec_id").select("embedding").toArrow()
        self.tree = KMeansTree(_matrix(drawn["embedding"], dim) if len(drawn) else np.zeros((1, dim)), branch, leaf)
        self.shared = self.spark.sparkContext.broadcast(self.tree)
        self.filed = kept(rows.mapInArrow(self._file(), "leaf long, vec_id long, embedding array<double>"), "filed")
        self.sizes = np.zeros(self.tree.n_leaves, np.int64)  # by leaf
        for r in self.filed.groupBy("leaf").count().collect():
            self.sizes[r["leaf"]] = r["count"]
        self.ids = np.zeros(self.tree.n_leaves, np.int64)  # by leaf; an id with rows in several counts in one
        for r in self.filed.groupBy("vec_id").agg(F.min("leaf").alias("leaf")).groupBy("leaf").count().collect():
            self.ids[r["leaf"]] = r["count"]
        self._calibrate(calibration, target, seed)

    def _file(self):
        tree, dim = self.shared, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(tree.value.leaf_of(_matrix(b.column("embedding"), dim))), b.column("vec_id"), b.column("embedding")], ["leaf", "vec_id", "embedding"])

        return run

    def brute_force(self, q_ids: np.ndarray, q: np.ndarray) -> DataFrame:
        """Exact (query_id, rank, vec_id, score) of a bounded set of queries against all rows."""
        k, dim, shared = self.k, self.dim, self.spark.sparkContext.broadcast((q_ids, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from _best(*shared.value, b.column("vec_id").to_numpy(zero_copy_only=False), _matrix(b.column("embedding"), dim), k).to_batches()

        return self._ranked(self.rows.mapInArrow(run, "query_id long, vec_id long, score double"))

    def _ranked(self, found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= self.k).select("query_id", "rank", "vec_id", "score")

    def _calibrate(self, most: int, target: float, seed: int) -> None:
        """Sets the number of leaves to visit: the least with a mean recall of `target` over the calibration queries."""
        drawn = self.filed.filter(fraction("vec_id", F.lit(seed + 1)) < min(1.0, most / self.n)).dropDuplicates(["vec_id"]).orderBy("vec_id").toArrow()
        if not len(drawn):
            self.n_visits = self.tree.n_leaves
            return
        ids, q = drawn["vec_id"].to_numpy(), _matrix(drawn["embedding"], self.dim)
        true = self.brute_force(ids, q).join(self.filed.select("vec_id", "leaf"), "vec_id").select("query_id", "vec_id", "leaf").distinct().collect()
        order = {int(i): {leaf: at for at, leaf in enumerate(self.tree.visits(v, self.tree.n_leaves))} for i, v in zip(ids, q, strict=True)}
        wanted: dict[int, list[int]] = {}
        for r in true:
            wanted.setdefault(r["query_id"], []).append(order[r["query_id"]][r["leaf"]])
        recall = np.zeros(self.tree.n_leaves)
        for places in wanted.values():
            recall += np.cumsum(np.bincount(places, minlength=self.tree.n_leaves)) / len(places) / len(wanted)
        self.n_visits = 1 + int(np.argmax(recall >= target - 1e-12)) if wanted else self.tree.n_leaves
        self.recall = float(recall[self.n_visits - 1]) if wanted else 1.0

    def search(self, queries: DataFrame) -> DataFrame:
        """queries: rows of the index's `rows` (vec_id, embedding)."""
        tree, dim, k, n_visits, held, of = self.shared, self.dim, self.k, self.n_visits, self.ids, groups_of(self.sizes, self.block)

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, len(b), 512):
                    part = b.slice(i, 512)
                    lists = [np.sort(np.array(tree.value.visits(q, n_visits, held, k + 1), np.int64)) for q in _matrix(part.column("embedding"), dim)]
                    rows, leaves = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
                    groups = of[leaves]  # in order within a query
                    first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (groups[1:] != groups[:-1]))))
                    visited = pa.ListArray.from_arrays(pa.array(np.append(first, len(leaves)).astype(np.int32)), pa.array(leaves))
                    who = pa.array(rows[first])
                    yield pa.RecordBatch.from_arrays([pa.array(groups[first]), visited, part.column("vec_id").take(who), part.column("embedding").take(who)], ["grp", "leaves", "query_id", "q"])

        n_parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        asked = kept(queries.repartition(n_parts, "vec_id").groupBy("vec_id").agg(F.min("embedding").alias("embedding")).mapInArrow(visits, "grp long, leaves array<long>, query_id long, q array<double>"), "asked")
        asks = {r["grp"]: r["count"] for r in asked.groupBy("grp").count().collect()}
        # blocks of a group's vectors and of its queries; every pair of the two is one task's work
        held_by = np.bincount(of, weights=self.sizes).astype(np.int64)
        parts = [(g, int(-(-held_by[g] // self.block)), -(-n // self.block)) for g, n in asks.items() if held_by[g]]
        cut = F.broadcast(self.spark.createDataFrame(parts, "grp long, n_x int, n_q int"))  # a row for each group
        by_leaf = F.broadcast(self.spark.createDataFrame([(leaf, int(g)) for leaf, g in enumerate(of)], "leaf long, grp long"))
        x = self.filed.join(by_leaf, "leaf").join(cut, "grp").select("grp", F.pmod(F.xxhash64("vec_id"), F.col("n_x")).cast("int").alias("bx"), F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)).alias("bq"), "leaf", "vec_id", "embedding")
        q = asked.join(cut, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("n_x") - 1)).alias("bx"), F.pmod(F.xxhash64("query_id"), F.col("n_q")).cast("int").alias("bq"), "leaves", "query_id", "q")

        def scored(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return pa.table([np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], ["query_id", "vec_id", "score"])
            leaf, visited = left["leaf"].to_numpy(), right["leaves"].combine_chunks()
            low = int(min(leaf.min(), visited.flatten().to_numpy().min()))
            wide = int(max(leaf.max(), visited.flatten().to_numpy().max())) - low + 1
            goes = np.zeros((len(right), wide), bool)
            goes[np.repeat(np.arange(len(right)), visited.value_lengths().to_numpy()), visited.flatten().to_numpy() - low] = True
            return _best(right["query_id"].to_numpy(), _matrix(right["q"], dim), left["vec_id"].to_numpy(), _matrix(left["embedding"], dim), k, goes[:, leaf - low])

        key = ["grp", "bx", "bq"]
        found = x.groupBy(*key).cogroup(q.groupBy(*key)).applyInArrow(scored, "query_id long, vec_id long, score double")
        return self._ranked(found)


_NONE = "query_id long, rank int, vec_id long, score double"


def op4_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = TreeIndex(table(spark, sf_dir, "embeddings"))
    if not index.n:
        return spark.createDataFrame([], _NONE)
    return index.search(index.rows.filter(F.col("vec_id") % 20 == 0))
