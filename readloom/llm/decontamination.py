"""Benchmark decontamination as a prefix-filtered join with exact containment over item-sized windows.

Every benchmark item gives windows of `window` consecutive words (one shorter window if it has fewer). A window's words are ordered
by rarity in the whole corpus; as containment must be complete, the rarest word alone is the necessary prefix, so a document is
compared with a window only where it holds that word. The word's place in the window fixes where the window would begin (position
bound) and end (length bound); what passes is verified word by word.

The items are indexed in blocks of about `block_windows` words, and so windows, each broadcast (400,000 windows take some 60 MB); all documents pass every block, so a benchmark of
any size is matched whole in bounded memory.

Cases: a null text has no words and is never hit; items without words, or without an id, take no part; items with equal ids are one
item; repeated documents give repeated rows; empty tables give no rows, or rows without hits; other columns are ignored, or
kept by `decontaminated`, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import CHUNK_BYTES, ROW, carried, giving_back, lean, shared, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# bytes that are no word bytes become blanks, A-Z become a-z
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a UTF-8 text, A-Z lower-cased."""
    return text.translate(_TO_WORDS).split()


class WindowIndex:
    """The windows of a block of items, found by their rarest word; all in flat arrays."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.window = window
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        rows, owner = [np.full((0, window), -2, np.int32)], [np.zeros(0, np.int32)]
        for name, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)], np.int32)
            if len(ids) >= window:
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, window))
            elif len(ids):
                rows.append(np.concatenate((ids, np.full(window - len(ids), -2, np.int32)))[None])
            else:
                continue
            owner.append(np.full(len(rows[-1]), number[name], np.int32))
        self.words, of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.words >= 0).sum(1)
        # the items of window w are owners[first_owner[w] : first_owner[w + 1]]
        pairs = np.unique(of.reshape(-1).astype(np.int64) * max(1, len(self.names)) + np.concatenate(owner))
        self.owners = (pairs % max(1, len(self.names))).astype(np.int32)
        self.first_owner = np.searchsorted(pairs // max(1, len(self.names)), np.arange(len(self.words) + 1))

    def items(self, windows: np.ndarray) -> set[str]:
        return {self.names[i] for w in windows.tolist() for i in self.owners[self.first_owner[w] : self.first_owner[w + 1]].tolist()}

    def order_by_rarity(self, counts: np.ndarray) -> None:
        """counts: how often each word of the vocabulary occurs in the corpus."""
        n = len(self.vocabulary)
        rank = np.empty(n + 1, np.int64)
        rank[np.lexsort((np.arange(n), counts))] = np.arange(n)
        rank[n] = n  # padding
        self.places = rank[np.where(self.words < 0, n, self.words)].argmin(1) if len(self.words) else np.zeros(0, np.int64)
        prefix = self.words[np.arange(len(self.words)), self.places]
        self.by_word = np.argsort(prefix, kind="stable")
        self.first = np.searchsorted(prefix[self.by_word], np.arange(n + 2))

    def hits(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and window numbers of all occurrences; ids: words of several texts, -1 if unknown; bounds: the texts' limits."""
        counts = np.diff(self.first)
        at = np.flatnonzero(ids >= 0)
        at = at[counts[ids[at]] > 0]
        begins, which, i = [], [], 0
        sums = np.cumsum(counts[ids[at]])
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + 500_000, "right")))
            p, n = at[i:j], counts[ids[at[i:j]]]
            where = np.repeat(p, n)
            w = self.by_word[np.repeat(self.first[ids[p]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            b = where - self.places[w]
            text = np.searchsorted(bounds, where, "right") - 1
            ok = (b >= bounds[text]) & (b + self.lengths[w] <= bounds[text + 1])
            b, w = b[ok], w[ok]
            for k in (0, *range(self.window - 1, 0, -1)):
                short = self.lengths[w] <= k
                ok = short | (ids[np.where(short, b, b + k)] == self.words[w, k])
                b, w = b[ok], w[ok]
            begins.append(b)
            which.append(w)
            i = j
        z = np.zeros(0, np.int64)
        return np.concatenate(begins or [z]), np.concatenate(which or [z])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) in runs of about CHUNK_BYTES."""
    column = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
    run, first, size = [], 0, 0
    for i in range(len(column)):
        x = column[i].as_py() or b""
        run.append(x)
        size += len(x)
        if size >= CHUNK_BYTES:
            yield first, run
            run, first, size = [], i + 1, 0
    if run:
        yield first, run


def _ids(texts: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    ids: list[int] = []
    bounds = [0]
    get = vocabulary.get
    for t in texts:
        ids.extend([get(w, -1) for w in words_of(t)])
        bounds.append(len(ids))
    return np.array(ids, np.int64), np.array(bounds, np.int64)


def word_counts(docs: DataFrame, index) -> DataFrame:
    """(word, n): how often each word of the index's vocabulary occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = index.value.vocabulary
        n = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, texts in _texts(batch):
                ids, _ = _ids(texts, vocabulary)
                n += np.bincount(ids[ids >= 0], minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["word", "n"])

    return docs.select("text").mapInArrow(lean(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _merge(old: list[dict], begins: np.ndarray, ends: np.ndarray) -> list[dict]:
    spans: list[list[int]] = []
    for a, b in sorted([*((x["start"], x["end"]) for x in old), *zip(begins.tolist(), ends.tolist(), strict=True)]):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [{"start": a, "end": b} for a, b in spans]


_SPANS = "array<struct<start: long, end: long>>"


def matched(docs: DataFrame, items: DataFrame, window: int = 13, block_windows: int = 400_000) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_words, spans, items): the word spans that lie in a window, and the items found.

    items: (item_id, text). Spans count words from 0 and don't overlap; items are ids as text, in order.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item"), "text").filter("item is not null and text is not null").distinct()
    total = items.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    n_blocks = max(1, ceil(total / block_windows))
    key = docs.schema["doc_id"].dataType
    out = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    for block in range(n_blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block).collect()
        index = WindowIndex(sorted((r["item"], r["text"].encode()) for r in rows), window)
        counts = np.zeros(len(index.vocabulary), np.int64)
        if counts.size:
            with giving_back(spark):
                for r in word_counts(docs, shared(spark, index)).collect():  # one row for each word of the block
                    counts[r["word"]] = r["n"]
        index.order_by_rarity(counts)
        value, last = shared(spark, index), block == n_blocks - 1

        def find(batches: Iterator[pa.RecordBatch], value=value, last=last) -> Iterator[pa.RecordBatch]:
            index = value.value
            for batch in batches:
                n = np.zeros(len(batch), np.int64)
                spans, named = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                for first, texts in _texts(batch):
                    ids, bounds = _ids(texts, index.vocabulary)
                    n[first : first + len(texts)] = np.diff(bounds)
                    begins, which = index.hits(ids, bounds)
                    text = np.searchsorted(bounds, begins, "right") - 1
                    for t in np.unique(text).tolist():
                        own = text == t
                        b = begins[own] - bounds[t]
                        spans[first + t] = _merge(spans[first + t], b, b + index.lengths[which[own]])
                        named[first + t] = sorted(index.items(which[own]).union(named[first + t]))
                columns = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n), "spans": pa.array(spans, batch.schema.field("spans").type), "items": pa.array(named, batch.schema.field("items").type)}
                if not last:
                    columns["text"] = batch.column("text")
                yield pa.RecordBatch.from_pydict(columns)

        schema = f"doc_id {key.simpleString()}, n_words long, spans {_SPANS}, items array<string>" + ("" if last else ", text string")
        out = out.mapInArrow(lean(find), schema)
    return out


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def contaminated(n_hit: Column, n_words: Column, one_in: int = 20) -> Column:
    return (n_hit > 0) & (n_hit * one_in >= n_words)


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated; documents with one id stand and fall together, a null id stays."""
    found = matched(docs, items)
    bad = found.filter(contaminated(hit_words(F.col("spans")), F.col("n_words"))).select(F.col("doc_id").alias("bad_id")).distinct()
    rows = carried(docs, F.col("doc_id").alias("own_id"))
    return rows.join(bad, F.col("own_id") == F.col("bad_id"), "left_anti").select(f"{ROW}.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("n_hit", hit_words(F.col("spans")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")
    )


OP3_SQL = r"""
with doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), item as (
  select distinct cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null and text is not null
), win as (
  select distinct item, least(len(w), 13) as n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') as s
  from item, lateral (select unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i) where len(w) > 0
), sizes as (select distinct n from win),
place as (
  select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as s
  from doc, sizes, lateral (select unnest(range(1, len(w) - n + 2)) as i) where len(w) >= n
), hit as (
  select distinct doc_id, i, win.n, item from place join win on place.s = win.s and place.n = win.n
), words as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hit)) group by doc_id
), named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from hit) group by doc_id
)
select doc.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join words on doc.doc_id = words.doc_id left join named on doc.doc_id = named.doc_id
"""
