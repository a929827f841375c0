"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

A string's symbols stand in a linked list and its mergeable neighbours in a heap by rank, then by place. The lowest pair is popped; if
both its symbols are still there they merge, and the new neighbours go into the heap. The count is the initial symbols less the merges;
a character that no piece holds counts as its UTF-8 bytes.

Texts are cut where no piece can reach across (`pieces.Cuts`), many texts at once, and each different part between two cuts is merged
once in a Python worker, in a table that begins anew when it holds `MEMORY` parts. Rows never move: there is no shuffle, and a task
holds one batch. The tokenizer file is read on the workers from its path.

Cases: a null or empty text has no tokens and no bytes; repeated rows each get a row; a null id stays null; an empty table gives no
rows; special strings in a text are plain text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import lean, table
from readloom.llm.pieces import SPACE, code_points, cuts, ranks, runs, slices

#: Parts that a worker remembers (about 100 MB), and how long they may be.
MEMORY, LONGEST = 500_000, 48


def merges(symbols: Sequence[str], rank: Callable[[str], int | None]) -> int:
    """How often neighbours merge: the lowest rank first, of equal ranks the leftmost; rank(joined) is null if they don't.

    An entry of the heap is one number: rank, place of the left symbol, length of both (pieces have under 256 characters).
    """
    n = len(symbols)
    word = list(symbols)
    heap = [r << 48 | i << 8 | len(x) for i, x in enumerate(map(add, word, word[1:])) if (r := rank(x)) is not None]
    if not heap:
        return 0
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heapify(heap)
    done = 0
    while heap:
        entry = heappop(heap)
        i = entry >> 8 & 0xFFFFFFFFFF
        left, j = word[i], after[i]
        if not left or j >= n:
            continue
        joined = left + word[j]
        if len(joined) != entry & 0xFF:
            continue  # one of the two has merged with another
        word[i], word[j] = joined, ""
        done += 1
        j = after[i] = after[j]
        if j < n:
            before[j] = i
            x = joined + word[j]
            if (r := rank(x)) is not None:
                heappush(heap, r << 48 | i << 8 | len(x))
        h = before[i]
        if h >= 0:
            x = word[h] + joined
            if (r := rank(x)) is not None:
                heappush(heap, r << 48 | h << 8 | len(x))
    return done


class Counts(dict):
    """Tokens of a part, worked out when first asked for."""

    def __init__(self, path: str):
        self.rank, self.chars = ranks(path).get, cuts(path).chars

    def __missing__(self, part: str) -> int:
        n = len(part) - merges(part, self.rank)
        if not self.chars.issuperset(part):
            n += sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in part if c not in self.chars)
        if len(part) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[part] = n
        return n


@lru_cache(1)
def known_parts(path: str) -> Counts:
    return Counts(path)


def counted(texts: list[str | None], path: str, known: Counts) -> np.ndarray:
    """Tokens of each text, an added space before it, as the vocabulary in `path` has them."""
    out = []
    for first, last in runs([t or "" for t in texts]):
        some = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts[first:last]]
        joined = "".join(some)
        if not joined:
            out.append(np.zeros(len(some), np.int64))
            continue
        starts = np.cumsum([0, *map(len, some)])
        apart = cuts(path).apart(code_points(joined))
        apart[starts[:-1][starts[:-1] < len(joined)]] = True
        at = np.flatnonzero(apart)
        n = np.fromiter(map(known.__getitem__, slices(joined, at)), np.int64, len(at))
        out.append(np.diff(np.concatenate(([0], np.cumsum(n)))[np.searchsorted(at, starts)]))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """Rows of `docs` as (doc_id, n_bytes, n_tokens, over_limit), with the tokens of the sentence-piece BPE vocabulary in `path`."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_parts(path)
        for b in batches:
            n = pa.array(counted(b.column(2).to_pylist(), path, known))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    schema = rows.select("doc_id", "n_bytes").withColumn("n_tokens", F.lit(0).cast("long")).schema
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
