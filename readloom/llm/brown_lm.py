"""Brown class-based bigram model: exchange clustering over corpus-wide counts, class transitions, word emissions, smoothed scores.

Counting. Every training document's words are counted by 64-bit hash; the table of counts is as long as the vocabulary and stays
distributed. A word's ending is its last three bytes, if that is one of the `n_endings` most frequent, else its last byte, so unseen
words have one too.

Clustering. Exchange: the `n_core` most frequent words and all endings move, most frequent first, to the class that most raises the
corpus's class-bigram likelihood. Then every other word that occurs `least` times or more gets the class that most raises it, by the
classes that stand before and after the word in the whole training corpus; those counts stay distributed. Rarer words, and unseen ones,
have their ending's class. Class transitions are counted after that. At most `head` words, the most frequent, can have a class of their
own: their hashes and counts are what each task holds.

Score of a text: sum of log10 P(class | class before) + log10 P(word | class); a word without a class of its own is emitted by its ending
and then chosen among the ending's words by (c + 0.1) / (N + 0.1 (V + 1)). The text ends in an end token, which also stands before it.

Scoring reads counts of the head's words from a broadcast table; the other words of all documents meet the distributed table of counts
in a join.

Cases: a null text is empty and scores its end token; a null id counts as empty text for the split; repeated rows are scored and
counted each; an empty table gives no rows, an empty training set scores 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import LOWER, doc_crc, giving_back, kept, lean, shared, signed, table, text_chunks, word_hashes, word_spans

END = np.array([0x6E64206F66207478], np.uint64)
ADD = 0.1


def endings(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The last three bytes of each word as a number, zeros before a shorter one."""
    code = np.zeros(len(s), np.int64)
    for k in (3, 2, 1):
        code = code << 8 | np.where(e - k >= s, LOWER[buf[np.maximum(e - k, s)]], 0)
    return code


def _words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for first, buf, off in text_chunks(texts):
        s, e, bounds = word_spans(buf, off)
        yield first, word_hashes(buf, s, e), endings(buf, s, e), bounds


def word_counts(docs: DataFrame, stretch: int = 2_000_000) -> DataFrame:
    """(w, ending, c) for every distinct word and the end token (ending -1) of docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = n_docs = 0

        def out() -> pa.RecordBatch:
            h = np.concatenate([x[0] for x in held])
            u, at, c = np.unique(h, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(np.concatenate([x[1] for x in held])[at]), pa.array(c)], ["w", "ending", "c"])

        for batch in batches:
            n_docs += len(batch)
            for _, h, ending, _ in _words(batch.column("text")):
                held.append((h, ending.astype(np.int32)))
                size += len(h)
                if size > stretch:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()
        if n_docs:
            yield pa.RecordBatch.from_arrays([pa.array(signed(END)), pa.array(np.array([-1], np.int32)), pa.array(np.array([n_docs], np.int64))], ["w", "ending", "c"])

    return docs.select("text").mapInArrow(lean(run), "w long, ending int, c long").groupBy("w", "ending").agg(F.sum("c").alias("c"))


class Head:
    """The most frequent words: hashes in order, counts, endings; items: 0 the end, then the core's words, then endings."""

    def __init__(self, w: np.ndarray, c: np.ndarray, ending: np.ndarray, n_core: int, three: np.ndarray):
        order = np.argsort(w.view(np.uint64))
        self.w, self.c, self.ending = w.view(np.uint64)[order], c[order], ending[order].astype(np.int64)
        core = np.lexsort((self.w, -self.c))[:n_core]
        self.three, self.n_core = np.sort(three).astype(np.int64), len(core)
        self.n_items = 1 + self.n_core + len(self.three) + 256
        self.core = np.full(len(w), -1, np.int64)
        self.core[core] = np.arange(1, len(core) + 1)
        self.own = np.full(len(w), -1, np.int64)  # a word's own class

    def ending_item(self, code: np.ndarray) -> np.ndarray:
        first = 1 + self.n_core
        rest = first + len(self.three) + (code & 255)
        if not len(self.three):
            return rest
        at = np.minimum(np.searchsorted(self.three, code), len(self.three) - 1)
        return np.where(self.three[at] == code, first + at, rest)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Place in the table of each word, -1: none."""
        if not len(self.w):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.w, h), len(self.w) - 1)
        return np.where(self.w[at] == h, at, -1)

    def items(self, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        core = np.append(self.core, -1)[at]
        return np.where(core >= 0, core, self.ending_item(code))

    def classes(self, at: np.ndarray, code: np.ndarray, of_item: np.ndarray) -> np.ndarray:
        own = np.append(self.own, -1)[at]
        return np.where(own >= 0, own, of_item[self.ending_item(code)])


def _around(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """x with an end (0) after each text."""
    return np.insert(x, bounds[1:], 0)


def item_bigrams(docs: DataFrame, head) -> DataFrame:
    """(before, counts): for each item before, the counts of the items after it as int64 bytes; the end token stands around each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = head.value
        n = np.zeros(h.n_items**2, np.int64)
        for batch in batches:
            for _, words, code, bounds in _words(batch.column("text")):
                items = _around(h.items(h.look_up(words), code), bounds)
                np.add(n, np.bincount(np.concatenate(([0], items[:-1])) * h.n_items + items, minlength=len(n)), out=n)
        some = np.flatnonzero(n)
        for i in range(0, len(some), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 200_000]), pa.array(n[some[i : i + 200_000]])], ["pair", "c"])

    n_items = head.value.n_items

    def row(group: pa.Table) -> pa.Table:
        pair, out = group["pair"].to_numpy(), np.zeros(n_items, np.int64)
        out[pair % n_items] = group["c"].to_numpy()
        return pa.table({"before": pa.array([int(pair[0] // n_items)], pa.int32()), "counts": pa.array([out.tobytes()], pa.binary())})

    sums = docs.select("text").mapInArrow(lean(run), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))
    return sums.withColumn("before", F.floor(F.col("pair") / n_items)).groupBy("before").applyInArrow(row, "before int, counts binary")


def exchange(m: np.ndarray, n_classes: int, passes: int = 6) -> np.ndarray:
    """Classes of items from their bigram counts m[before, after]; item 0 keeps class 0 to itself."""
    n = len(m)
    total = m.sum(0) + m.sum(1)
    order = np.argsort(-total[1:], kind="stable") + 1
    of = np.zeros(n, np.int64)
    of[order] = 1 + np.arange(n - 1) % max(1, n_classes - 1)
    one = np.zeros((n, n_classes))
    one[np.arange(n), of] = 1
    right, left = m @ one, m.T @ one  # counts of an item before each class, after each class
    g = one.T @ right
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(passes):
        moved = 0
        for i in order:
            if total[i] == 0:
                continue
            a, r, l, own = of[i], right[i].copy(), left[i].copy(), m[i, i]
            r[a] -= own
            l[a] -= own
            g[a, :] -= r
            g[:, a] -= l
            g[a, a] -= own
            rows, cols = g.sum(1), g.sum(0)
            nr, nc = r.sum() + own, l.sum() + own
            gain = (f(g + r) - f(g)).sum(1) + (f(g + l[:, None]) - f(g)).sum(0)
            d = np.diagonal(g)
            gain += f(d + r + l + own) - f(d + r) - f(d + l) + f(d)
            gain -= f(rows + nr) - f(rows) + f(cols + nc) - f(cols)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            g[b, :] += r
            g[:, b] += l
            g[b, b] += own
            if b != a:
                of[i] = b
                right[:, a] -= m[:, i]
                right[:, b] += m[:, i]
                left[:, a] -= m[i, :]
                left[:, b] += m[i, :]
                moved += 1
        if not moved:
            break
    return of


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_classes(word: np.ndarray, slot: np.ndarray, n: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and for each the class, but 0, that joining most raises the likelihood; rows (word, slot, n) in order of words.

    slot: a class that stands before the word, or the number of classes and one that stands after it; g: class bigrams.
    """
    k = len(g)
    fg, rows, cols = _plogp(g), g.sum(1), g.sum(0)
    words, first = np.unique(word, return_index=True)
    after = slot >= k
    # joined to class b, a word after class a adds to g[a, b], one before class a to g[b, a]
    base = np.where(after[:, None], g.T[slot % k], g[slot % k])
    gain = np.add.reduceat(_plogp(base + n[:, None]) - np.where(after[:, None], fg.T[slot % k], fg[slot % k]), first)
    for mine, all_ in ((after, rows), (~after, cols)):
        total = np.add.reduceat(np.where(mine, n, 0), first)[:, None]
        gain -= _plogp(all_ + total) - _plogp(all_)
    gain[:, 0] = -np.inf
    return words, gain.argmax(1)


def own_classes(docs: DataFrame, head, of_item: np.ndarray, g: np.ndarray, least: int) -> DataFrame:
    """(at, class) of the head's words with `least` or more, but the core's, by their places in the head."""
    k = len(g)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = head.value
        wanted = np.append((h.c >= least) & (h.core < 0), False)
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            u, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], ["key", "n"])

        for batch in batches:
            for _, words, code, bounds in _words(batch.column("text")):
                at = h.look_up(words)
                classes = np.concatenate(([0], _around(of_item[h.items(at, code)], bounds), [0]))
                i = np.flatnonzero(wanted[at])
                place = i + np.searchsorted(bounds[1:], i, "right") + 1  # in classes
                held += [at[i] * (2 * k) + classes[place - 1], at[i] * (2 * k) + k + classes[place + 1]]
                if sum(map(len, held)) > 2_000_000:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(upto: int) -> pa.RecordBatch:
            words, best = best_classes(key[:upto] // (2 * k), key[:upto] % (2 * k), n[:upto].astype(float), g)
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(best)], ["at", "class"])

        for b in batches:
            key, n = np.concatenate((key, b.column("key").to_numpy())), np.concatenate((n, b.column("n").to_numpy()))
            upto = int(np.searchsorted(key, key[-1] // (2 * k) * (2 * k))) if len(key) else 0  # the last word may go on
            if upto > 20_000:
                yield out(upto)
                key, n = key[upto:], n[upto:]
        if len(key):
            yield out(len(key))

    sums = docs.select("text").mapInArrow(lean(contexts), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return sums.repartition(F.expr(f"key div {2 * k}")).sortWithinPartitions("key").mapInArrow(lean(choose), "at long, class long")


def class_bigrams(docs: DataFrame, head, of_item: np.ndarray, k: int) -> np.ndarray:
    """Class transitions of the whole training corpus, with the words' own classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = head.value, np.zeros(k * k, np.int64)
        for batch in batches:
            for _, words, code, bounds in _words(batch.column("text")):
                c = _around(h.classes(h.look_up(words), code, of_item), bounds)
                n += np.bincount(np.concatenate(([0], c[:-1])) * k + c, minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["pair", "c"])

    out = np.zeros(k * k)
    for r in docs.select("text").mapInArrow(lean(run), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).collect():  # at most k * k rows
        out[r["pair"]] = r["c"]
    return out.reshape(k, k)


class ClassModel:
    """Log10 tables: `step[class before, class]`, `emit_own` of the head's words, `emit_ending` of endings' items, without log10(c + 0.1) of the word."""

    def __init__(self, head: Head, of_item: np.ndarray, g: np.ndarray, ending_words: np.ndarray, ending_tokens: np.ndarray, end_count: int):
        self.of_item, k = of_item, len(g)
        own = head.own >= 0
        mass = np.bincount(of_item, np.where(np.arange(head.n_items) > head.n_core, ending_tokens + ADD, 0.0), k)
        mass += np.bincount(head.own[own], head.c[own] + ADD, k)
        mass[0] += end_count + ADD
        self.step = np.log10((g + mass / mass.sum()) / (g.sum(1, keepdims=True) + 1))
        self.emit_own = np.zeros(len(head.w))
        self.emit_own[own] = np.log10((head.c[own] + ADD) / mass[head.own[own]])
        self.emit_ending = np.log10((ending_tokens + ADD) / mass[of_item]) - np.log10(ending_tokens + ADD * (ending_words + 1))
        self.emit_end = float(np.log10((end_count + ADD) / mass[0]))
        self.end_log, self.end_known = float(np.log10(end_count + ADD)), int(end_count > 0)


def _scored(head, model, id_type: str):
    """(doc_id, n_tokens, n_known, base, score, rare): sums over what the head table knows; rare: hashes of the other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, m = head.value, model.value
        log_c = np.log10(np.concatenate((h.c, [0])) + ADD)
        own, emit_own = np.append(h.own, -1), np.append(m.emit_own, 0.0)
        for batch in batches:
            n = len(batch)
            tokens, known, base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            rare, sizes = [], []
            for first, words, code, bounds in _words(batch.column("text")):
                at = h.look_up(words)
                logs, hit, item = log_c[at], at >= 0, h.ending_item(code)
                mine = own[at] >= 0
                seq = _around(np.where(mine, own[at], m.of_item[item]), bounds)
                emitted = np.where(mine, emit_own[at], m.emit_ending[item] + logs)
                rows = slice(first, first + len(bounds) - 1)
                sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[bounds])  # noqa: E731,B023
                per_doc = lambda x: np.add.reduceat(np.append(x, 0.0), bounds[:-1]) * (np.diff(bounds) > 0)  # noqa: E731,B023
                tokens[rows] = np.diff(bounds) + 1
                known[rows] = sums(hit.astype(np.int64)) + m.end_known
                base[rows] = per_doc(logs) + m.end_log
                steps = m.step[np.concatenate(([0], seq[:-1])), seq]
                score[rows] = np.add.reduceat(steps, bounds[:-1] + np.arange(len(bounds) - 1)) + per_doc(emitted) + m.emit_end
                rare.append(words[~hit])
                sizes.append(sums((~hit).astype(np.int64)))
            ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(n + 1)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(signed(np.concatenate(rare)) if rare else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score), lists], ["doc_id", "n_tokens", "n_known", "base", "score", "rare"])

    return run, f"doc_id {id_type}, n_tokens long, n_known long, base double, score double, rare array<long>"


class BrownModel:
    """The model of docs (text): `counts` (w, ending, c), `total` and `distinct` tokens, `head`, `tables`."""

    def __init__(self, docs: DataFrame, n_core: int = 1023, n_endings: int = 384, n_classes: int = 64, least: int = 10, head: int = 1 << 18):
        self.spark = spark = docs.sparkSession
        docs = docs.select("text")
        with giving_back(spark) as stay:
            self.counts = counts = kept(word_counts(docs), "word-counts")
            self.total, self.distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
            # the lowest count at which at most `head` words have it or more
            by_size = counts.groupBy(F.floor(F.log2("c") * 16).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.desc("k")).collect()
            self.least, seen = 1 << 62, 0
            for r in by_size:
                seen += r["n"]
                if seen > head:
                    break
                self.least = r["c"]
            words = counts.filter("ending >= 0")
            frequent = words.filter(F.col("c") >= self.least).toArrow()
            common = words.groupBy("ending").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "ending").limit(n_endings).collect()
            self.head = h = Head(*[frequent[c].to_numpy() for c in ("w", "c", "ending")], n_core, np.array([r["ending"] for r in common], np.int64))
            plain = shared(spark, h)
            m = np.zeros((h.n_items, h.n_items))
            for r in item_bigrams(docs, plain).toLocalIterator():  # at most n_items rows of n_items counts
                m[r["before"]] = np.frombuffer(r["counts"], np.int64)
            of_item = exchange(m, n_classes)
            k = int(of_item.max()) + 1
            one = np.zeros((h.n_items, k))
            one[np.arange(h.n_items), of_item] = 1
            g = one.T @ m @ one
            del m, one
            core = h.core >= 0
            own = own_classes(docs, plain, of_item, g, least).toArrow()  # at most `head` rows
            h.own[core] = of_item[h.core[core]]
            h.own[own["at"].to_numpy()] = own["class"].to_numpy()
            self.shared_head = shared(spark, h)
            g = class_bigrams(docs, self.shared_head, of_item, k)
            # words and tokens of each ending, without the words that have a class of their own
            v, n = np.zeros(h.n_items), np.zeros(h.n_items)
            for r in words.groupBy(self._ending_item()).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).collect():
                v[r["item"]], n[r["item"]] = r["v"], r["n"]
            mine = h.own >= 0
            items = h.ending_item(h.ending[mine])
            v -= np.bincount(items, minlength=h.n_items)
            n -= np.bincount(items, h.c[mine], h.n_items)
            end_count = counts.filter(F.col("ending") == -1).agg(F.sum("c")).first()[0] or 0
            self.tables = ClassModel(h, of_item, g, v, n, end_count)
            self.shared_tables = shared(spark, self.tables)
            stay += [counts, self.shared_head, self.shared_tables]

    def _ending_item(self) -> Column:
        h = self.head
        first = 1 + h.n_core
        rest = F.lit(first + len(h.three)) + F.col("ending").bitwiseAND(F.lit(255))
        place = F.array_position(F.array(*[F.lit(int(x)) for x in h.three]) if len(h.three) else F.array().cast("array<int>"), F.col("ending"))
        return F.when(place > 0, first - 1 + place).otherwise(rest).cast("int").alias("item")

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of docs (doc_id, text)."""
        run, schema = _scored(self.shared_head, self.shared_tables, docs.schema["doc_id"].dataType.simpleString())
        rows = kept(docs.select("doc_id", "text").mapInArrow(lean(run), schema).withColumn("row", F.monotonically_increasing_id()), "scored")
        rare = rows.select("row", F.explode("rare").alias("w")).join(self.counts.filter(F.col("c") < self.least).filter("ending >= 0"), "w")
        sums = rare.groupBy("row").agg(F.count(F.lit(1)).alias("more_known"), F.sum(F.log10(F.col("c") + ADD) - float(np.log10(ADD))).alias("more"))
        bottom = float(np.log10(self.total + ADD * (self.distinct + 1)))
        out = rows.join(sums, "row", "left").withColumn("more", F.coalesce("more", F.lit(0.0)))
        return out.select(
            "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(self.total)).cast("long").alias("train_tokens"),
            (F.col("base") + F.col("more") - F.col("n_tokens") * bottom).alias("base_score"), (F.col("score") + F.col("more")).alias("score"),
        ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), doc_crc() % 10 == 0
    found = BrownModel(docs.filter(~held_out)).score(docs)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
