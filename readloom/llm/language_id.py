"""Language ID by a byte convolutional network: filters of several widths, max pooling over a window, softmax.

Every text is cut into windows of `WINDOW` bytes, the last filled up with blanks; a window's languages come from the network, a
text's from the mean over its windows, weighed by their bytes. The network is trained in numpy on one pseudorandomly placed window
from each of at most `per_language` different labelled texts of each language, `most` in all; whole texts are predicted.

Cases: a null text, or one without a letter, is `und` with score 0, and so is every text when there is nothing to learn from; a null
or empty label teaches nothing; a null id counts as empty text for the split; repeated rows give repeated rows; an empty table gives
none; other columns are ignored, or kept by `predict` and `accepted`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import LOWER, ROW, beside, carried, doc_crc, fraction, lean, shared, table, text_chunks

WINDOW = 256
WIDTHS = (2, 3, 4)
UNDETERMINED = "und"


def windows(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (n, WINDOW) of the texts, the text of each and its bytes; an empty text has none."""
    sizes = np.diff(off)
    n = -(-sizes // WINDOW)
    first = np.cumsum(n) - n
    out = np.full(int(n.sum()) * WINDOW, 32, np.uint8)
    if len(buf):
        out[np.arange(len(buf)) + np.repeat(first * WINDOW - off[:-1], sizes)] = LOWER[buf]
    of = np.repeat(np.arange(len(sizes)), n)
    return out.reshape(-1, WINDOW), of, np.minimum(WINDOW, sizes[of] - (np.arange(len(of)) - first[of]) * WINDOW)


class ByteCNN:
    """One-hot bytes, `filters` filters of each width, ReLU after max pooling, softmax over `n_classes`."""

    def __init__(self, n_classes: int, filters: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.tables = [rng.normal(0, 0.1, (w, 256, filters)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(filters, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (filters * len(WIDTHS), n_classes)).astype(np.float32)
        self.out_bias = np.zeros(n_classes, np.float32)

    def _params(self) -> list[np.ndarray]:
        return [*self.tables, *self.bias, self.out, self.out_bias]

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 4) -> None:
        """Adam on the cross entropy; gradients flow through the place of each filter's maximum."""
        rng = np.random.default_rng(seed)
        params = self._params()
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                b, t = x[order[i : i + batch]].astype(np.int64), y[order[i : i + batch]]
                pooled, where = [], []
                for table_, bias in zip(self.tables, self.bias, strict=True):
                    w = len(table_)
                    conv = sum(table_[j][b[:, j : WINDOW - w + 1 + j]] for j in range(w))
                    at = conv.argmax(1)
                    where.append(at)
                    pooled.append(np.take_along_axis(conv, at[:, None, :], 1)[:, 0] + bias)
                h = np.concatenate(pooled, 1)
                a = np.maximum(h, 0)
                p = self._softmax(a @ self.out + self.out_bias)
                p[np.arange(len(t)), t] -= 1
                p /= len(t)
                back = (p @ self.out.T) * (h > 0)
                grads = [np.zeros_like(q) for q in params]
                f = self.tables[0].shape[2]
                for k, at in enumerate(where):
                    g = back[:, k * f : (k + 1) * f]
                    for j in range(len(self.tables[k])):
                        np.add.at(grads[k][j], (np.take_along_axis(b, at + j, 1), np.arange(f)), g)
                    grads[len(WIDTHS) + k] = g.sum(0)
                grads[-2], grads[-1] = a.T @ p, p.sum(0)
                step += 1
                for q, g, mm, vv in zip(params, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    q -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)

    def pack(self) -> None:
        """Tables of byte pairs, so that a filter of width 4 costs two look-ups."""
        pair = lambda t: (t[0][:, None, :] + t[1][None, :, :]).reshape(65536, -1)
        self.packed = [[pair(t[j : j + 2]) if j + 1 < len(t) else t[j] for j in range(0, len(t), 2)] for t in self.tables]

    def predict(self, x: np.ndarray, step: int = 128) -> np.ndarray:
        """Probabilities of windows (n, WINDOW) of bytes."""
        out = np.zeros((len(x), len(self.out_bias)))
        for i in range(0, len(x), step):
            b = x[i : i + step].astype(np.int64)
            pairs = b[:, :-1] * 256 + b[:, 1:]
            pooled = []
            for w, parts, bias in zip(WIDTHS, self.packed, self.bias, strict=True):
                n = WINDOW - w + 1
                conv = parts[0].take(pairs[:, :n], 0)
                if len(parts) > 1:
                    conv += parts[1].take(pairs[:, 2 : 2 + n] if w % 2 == 0 else b[:, 2 : 2 + n], 0)
                pooled.append(conv.max(1) + bias)
            out[i : i + step] = self._softmax(np.maximum(np.concatenate(pooled, 1), 0) @ self.out + self.out_bias)
        return out


def learn(docs: DataFrame, per_language: int = 1500, languages: int | None = None, most: int = 150_000, seed: int = 21) -> tuple[ByteCNN | None, list[str]]:
    """The network and its languages, from docs (text, lang) with labels: all labels, or the `languages` with most different texts.

    The driver sees one window from each of about per_language different texts of each at most, however many copies a text has, and of fewer
    where there are so many labels that these would be over `most` in all; but never of under about four.
    """
    docs = docs.filter("text is not null and lang is not null and lang <> '' and text rlike '\\\\p{L}'")
    found = docs.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).orderBy(F.desc("n"), "lang")
    found = (found if languages is None else found.limit(languages)).collect()  # a row a label
    per_language = max(4, min(per_language, most // max(1, len(found))))
    counts = {r["lang"]: r["n"] for r in found}
    names = sorted(counts)
    if not names:
        return None, []
    share = F.element_at(F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, per_language / max(1, counts[k])))]), F.col("lang"))
    begin = 1 + F.floor(fraction("text", F.lit(seed + 1)) * F.greatest(F.lit(1), F.length("text") - WINDOW + 1)).cast("int")
    rows = docs.filter(fraction("text", F.lit(seed)) < share).select(F.col("text").substr(begin, F.lit(WINDOW)).alias("part"), "lang").distinct().collect()
    rows = sorted((r["part"], r["lang"]) for r in rows)
    data = [p.encode()[:WINDOW] for p, _ in rows]
    x, _, _ = windows(np.frombuffer(b"".join(d.ljust(1) for d in data), np.uint8), np.concatenate(([0], np.cumsum([max(1, len(d)) for d in data]))))
    number = {k: i for i, k in enumerate(names)}
    y = np.array([number[k] for _, k in rows])
    net = ByteCNN(len(names))
    net.train(x, y)
    net.pack()
    return net, names


MADE = ("lang_pred", "score")


def predict(docs: DataFrame, net: ByteCNN | None, names: list[str]) -> DataFrame:
    """docs with any columns -> their columns and lang_pred, score, which replace columns of these names."""
    rows, back = beside(docs, "text", MADE)
    if net is None:
        return rows.select(*back, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    value = shared(docs.sparkSession, (net, names))
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, names = value.value
        for batch in batches:
            best, score = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for first, buf, off in text_chunks(batch.column("text")):
                x, of, weight = windows(buf, off)
                total = np.zeros((len(off) - 1, len(names)))
                np.add.at(total, of, net.predict(x) * weight[:, None])
                total /= np.maximum(1e-12, total.sum(1, keepdims=True))
                best[first : first + len(total)], score[first : first + len(total)] = total.argmax(1), total.max(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names).take(pa.array(best)), pa.array(np.clip(score, 0, 1))], [*batch.schema.names, *MADE])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = [F.when(lettered, F.col("lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"), F.when(lettered, F.col("score")).otherwise(0.0).alias("score")]
    return rows.mapInArrow(lean(run), schema).select(*back, *found)


def trainable(held_out: Column, docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out).select("text", "lang")


def accepted(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """docs in a language the network knows: not `und`, and with a mean probability of at least `least`; columns as they were."""
    net, names = learn(trainable(doc_crc() % 4 == 2, docs))
    found = predict(carried(docs, "text"), net, names)  # so columns that `predict` would replace stay
    return found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select(f"{ROW}.*")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), doc_crc() % 4 == 2
    net, names = learn(trainable(held_out, docs))
    return predict(docs.select("doc_id", "text"), net, names).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
