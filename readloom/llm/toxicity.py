"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows that tell quotation from abuse.

Lexicon. `SEEDS`, and what labelled texts show: words, and word beginnings of 4 to 6 letters, that are at least `ratio` times as
frequent in toxic as in other texts, in toxic texts of at least `support` and after at least `contexts` different words (so that
copies of one toxic text don't fill the lexicon with its other words).

Automaton. The words form a trie; all their Levenshtein automata (one edit from four letters on, two from nine) run along it at
once, made deterministic into one table; a beginning in the lexicon is matched without edits, with any ending. Terms whose table would
pass `most_states` are halved, into as many tables as it takes; the best match counts. Every word of every text runs through the
tables, many words abreast.

Context. A hit counts as quoted as far as quotation marks stand before and after it in the same line within `REACH` characters, and words of
reporting stand within `REACH` characters before it; the rest of it counts as abuse. A text's abuse by kind of match (word, beginning,
edited), its density, and its quoted hits are the features of a logistic regression.

Learning takes at most about `per_class` labelled texts of each class; the regression weighs them back to their true shares.
Scores are for whole texts.

Cases: a null or empty text has no hits and gets the score of a text without any; labels with a null id or a null label teach nothing,
contradicting labels of an id count as toxic; without labels of both classes the seeds alone decide; repeated rows give repeated rows;
a null id counts as empty text for the split; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import CHUNK_BYTES, doc_crc, fraction, giving_back, kept, shared, table

REACH = 60
SEEDS = tuple("asshole bastard bitch cunt dumbass fucker idiot imbecile loser moron retard scum scumbag slut stupid trash whore arschloch idiota dummkopf connard salope imbécile estúpido gilipollas puta".split())
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes word term phrase cited sagte sagt nannte schrieb zitat wort dit appelé écrit mot terme cité dijo dice llamó escribió palabra término cita".split())
MARKS = frozenset(map(ord, "\"“”„«»‘’‹›"))
_WORD = re.compile(r"[^\W_]+")

#: Kinds of match, in order of preference.
WORD, STEM, EDITED = 1, 2, 3


def edits_for(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """Tables over (state, symbol) for words within `edits_for` edits of a term, or beginning with a stem; a table's kinds by state tell."""

    def __init__(self, words: list[str], stems: list[str], most_states: int = 60_000):
        self.words, self.stems = sorted(set(words)), sorted(set(stems))
        letters = sorted({c for t in [*self.words, *self.stems] for c in t})
        self.symbols = np.zeros(0x110000, np.int32)  # 0: no letter of the lexicon
        for k, c in enumerate(letters):
            self.symbols[ord(c)] = k + 1
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [[*((w, False) for w in self.words), *((t, True) for t in self.stems)]]
        while todo:
            terms = todo.pop()
            made = self._build([t for t, stem in terms if not stem], [t for t, stem in terms if stem], letters, most_states if len(terms) > 1 else None)
            if made:
                self.tables.append(made)
            else:
                todo += [terms[: len(terms) // 2], terms[len(terms) // 2 :]]

    @staticmethod
    def _build(words: list[str], beginnings: list[str], letters: list[str], most_states: int | None) -> tuple[np.ndarray, np.ndarray] | None:
        """The table and its kinds; None if it would have more states."""
        kids: list[dict[int, int]] = [{}]
        left: list[int] = [0]  # edits that some term below allows
        ends: dict[int, int] = {}
        for t in words:
            k = edits_for(t)
            node = 0
            left[0] = max(left[0], k)
            for c in t:
                s = letters.index(c) + 1
                if s not in kids[node]:
                    kids.append({})
                    left.append(0)
                    kids[node][s] = len(kids) - 1
                node = kids[node][s]
                left[node] = max(left[node], k)
            ends[node] = k
        stems: list[dict[int, int]] = [{}]
        stem_ends: set[int] = set()
        for t in beginnings:
            node = 0
            for c in t:
                s = letters.index(c) + 1
                if s not in stems[node]:
                    stems.append({})
                    stems[node][s] = len(stems) - 1
                node = stems[node][s]
            stem_ends.add(node)

        def closed(best: dict[int, int]) -> dict[int, int]:
            todo = list(best)
            while todo:
                n = todo.pop()
                for child in kids[n].values():  # a letter of the term is missing
                    if best[n] + 1 <= left[child] and best[n] + 1 < best.get(child, 99):
                        best[child] = best[n] + 1
                        todo.append(child)
            return best

        # a state: nodes of the trie with their edits, and the place in the stem trie (-1: none, -2: a stem was met)
        start = (frozenset(closed({0: 0}).items()), -2 if 0 in stem_ends else 0)
        number, table_, queue, kind = {(frozenset(), -1): 0, start: 1}, [], [(frozenset(), -1), start], []
        while len(table_) < len(queue):
            nodes, stem = queue[len(table_)]
            exact = any(n in ends and e == 0 for n, e in nodes)
            near = any(n in ends and e <= ends[n] for n, e in nodes)
            kind.append(WORD if exact else STEM if stem == -2 else EDITED if near else 0)
            row = np.zeros(len(letters) + 1, np.int32)
            wanted = {s for n, _ in nodes for s in kids[n]} | (set(stems[stem]) if stem >= 0 else set())
            other = None
            for s in range(len(letters) + 1):
                if s not in wanted and other is not None:
                    row[s] = other
                    continue
                best: dict[int, int] = {}
                for n, e in nodes:
                    if s in kids[n] and e < best.get(kids[n][s], 99):
                        best[kids[n][s]] = e
                    if e + 1 <= left[n] and e + 1 < best.get(n, 99):
                        best[n] = e + 1
                    for child in kids[n].values():
                        if e + 1 <= left[child] and e + 1 < best.get(child, 99):
                            best[child] = e + 1
                place = -2 if stem == -2 else stems[stem].get(s, -1) if stem >= 0 else -1
                state = (frozenset(closed(best).items()), -2 if place in stem_ends else place)
                if state not in number:
                    number[state] = len(queue)
                    queue.append(state)
                    if most_states and len(queue) > most_states:
                        return None
                row[s] = number[state]
                if s not in wanted:
                    other = row[s]
            table_.append(row)
        return np.stack(table_), np.array(kind, np.int8)

    def match(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Kind of match of each word codes[start:end], 0 for none."""
        symbols = self.symbols[codes]
        best = np.zeros(len(starts), np.int8)
        for table_, kinds in self.tables:
            state, at, live = np.ones(len(starts), np.int32), starts.copy(), np.arange(len(starts))
            while len(live):
                state[live] = table_[state[live], symbols[at[live]]]
                at[live] += 1
                live = live[(at[live] < ends[live]) & (state[live] != 0)]
            kind = kinds[state]
            best = np.where((kind != 0) & ((best == 0) | (kind < best)), kind, best)
        return best


def _word_codes() -> np.ndarray:
    """Which code points are part of words."""
    out = np.zeros(0x110000, bool)
    out[:0x3000] = [chr(c).isalnum() for c in range(0x3000)]
    out[0x3000:] = True
    out[0xD800:0xE000] = out[0xFE00:0xFF00] = False
    return out


_IN_WORD = _word_codes()


def features(texts: list[str | None], automaton: LexiconAutomaton) -> np.ndarray:
    """Per text: words, and the abuse of words, stems and edited words, and what is quoted."""
    out = np.zeros((len(texts), 5))
    i = 0
    while i < len(texts):
        j, size, parts = i, 0, []
        while j < len(texts) and (j == i or size < CHUNK_BYTES // 2):
            parts.append((texts[j] or "").lower() + "\n")
            size += len(parts[-1])
            j += 1
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        inside = _IN_WORD[codes]
        starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        ends = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
        of = np.searchsorted(bounds, starts, "right") - 1
        np.add.at(out[i:j, 0], of, 1)
        kind = automaton.match(codes, starts, ends)
        for w in np.flatnonzero(kind).tolist():
            doc = int(of[w])
            lo, hi = max(int(bounds[doc]), int(starts[w]) - REACH), min(int(bounds[doc + 1]), int(ends[w]) + REACH)
            before, after = codes[lo : starts[w]].tolist(), codes[ends[w] : hi].tolist()
            line = len(before) - before[::-1].index(10) if 10 in before else 0
            marks = any(c in MARKS for c in before[line:]) and any(c in MARKS for c in (after[: after.index(10)] if 10 in after else after))
            told = not REPORTING.isdisjoint(_WORD.findall("".join(map(chr, before))))
            quoted = 0.7 * marks + 0.3 * (told and marks)
            out[i + doc, kind[w]] += 1 - quoted
            out[i + doc, 4] += quoted
        i = j
    return out


def design(x: np.ndarray) -> np.ndarray:
    abuse = x[:, 1:4].sum(1)
    return np.column_stack([np.ones(len(x)), np.log1p(x[:, 1:5]), x[:, 1:5] > 0, np.sqrt(abuse / np.maximum(1, x[:, 0]))])


class ToxicityModel:
    """Lexicon automaton and logistic weights."""

    def __init__(self, automaton: LexiconAutomaton, x: np.ndarray | None = None, y: np.ndarray | None = None, weight: np.ndarray | None = None):
        self.automaton = automaton
        self.beta = np.array([-3.0, 1.0, 1.0, 0.5, 0.0, 3.0, 3.0, 1.0, 0.0, 2.0])
        if x is not None and len(x) and 0 < y.mean() < 1:
            d, beta = design(x), np.zeros(10)
            for _ in range(40):
                p = 1 / (1 + np.exp(-np.clip(d @ beta, -30, 30)))
                h = (d * (weight * p * (1 - p))[:, None]).T @ d + 0.5 * np.eye(10)
                step = np.linalg.solve(h, d.T @ (weight * (y - p)) - 0.5 * beta * (np.arange(10) > 0))
                beta += np.clip(step, -2, 2)
                if np.abs(step).max() < 1e-6:
                    break
            self.beta = beta

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design(features(texts, self.automaton)) @ self.beta, -30, 30)))


def _terms(text: str) -> Iterator[tuple[str, str]]:
    """(term, word before) of a text; a stem's term ends in `-`."""
    last = ""
    for w in _WORD.findall(text.lower()):
        if len(w) > 3:
            yield w, last
            for k in (4, 5, 6):
                if len(w) >= k:
                    yield w[:k] + "-", last
        last = w


def _toxic_terms(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """(term, before, n) for the different words before a term; a term's texts are counted in one of its rows."""
    docs: Counter[str] = Counter()
    befores: set[tuple[str, str]] = set()

    def rows() -> Iterator[pa.RecordBatch]:
        pairs = list(befores)
        for i in range(0, len(pairs), 50_000):
            part = pairs[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in part], pa.string()), pa.array([w for _, w in part], pa.string()), pa.array([docs.pop(t, 0) for t, _ in part], pa.int64())], ["term", "before", "n"])
        befores.clear()

    for b in batches:
        for text in b.column("text").to_pylist():
            found = set(_terms(text or ""))
            befores |= found
            docs.update({t for t, _ in found})
            if len(befores) >= most:
                yield from rows()
    yield from rows()


def _clean_terms(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, docs = terms.value, Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                docs.update({t for t, _ in _terms(text or "") if t in wanted})
        yield pa.RecordBatch.from_arrays([pa.array(list(docs), pa.string()), pa.array(list(docs.values()), pa.int64())], ["term", "n"])

    return run


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 4000, support: int = 5, contexts: int = 5, ratio: float = 20.0, seed: int = 31) -> ToxicityModel:
    """docs (doc_id, text), labels (doc_id, toxic), both already without what is held out.

    A drawn id stands for one text, however many rows it has: of different ones that of the least hash. So the driver sees a row an id.
    """
    spark = docs.sparkSession
    with giving_back(spark):
        return _learnt(spark, docs, labels, per_class, support, contexts, ratio, seed)


def _learnt(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int, support: int, contexts: int, ratio: float, seed: int) -> ToxicityModel:
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return ToxicityModel(LexiconAutomaton(list(SEEDS), []))
    share = F.when(F.col("toxic") == 1, per_class / counts[1]).otherwise(2 * per_class / counts[0])
    drawn = F.broadcast(spark.createDataFrame(known.filter(fraction("doc_id", F.lit(seed)) < share).collect(), known.schema))  # about 3 * per_class rows
    texts = kept(docs.join(drawn, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic"), "toxicity-texts")
    n_toxic, n_clean = min(per_class, counts[1]), min(2 * per_class, counts[0])
    toxic = texts.filter("toxic = 1").select("text").mapInArrow(_toxic_terms, "term string, before string, n long")
    toxic = toxic.groupBy("term", "before").agg(F.sum("n").alias("n")).groupBy("term").agg(F.sum("n").alias("n"), F.count("before").alias("contexts"))
    found = {r["term"]: r["n"] for r in toxic.filter((F.col("n") >= support) & (F.col("contexts") >= contexts) & (F.col("contexts") >= 0.1 * F.col("n"))).select("term", "n").collect()}
    clean = texts.filter("toxic = 0").select("text").mapInArrow(_clean_terms(shared(spark, set(found))), "term string, n long")
    elsewhere = {r["term"]: r["n"] for r in clean.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    telling = {t for t, n in found.items() if n / n_toxic >= ratio * (elsewhere.get(t, 0) + 0.5) / n_clean}
    stems = {t[:-1] for t in telling if t.endswith("-")}
    stems = {s for s in stems if not any(s[:k] in stems for k in (4, 5) if k < len(s))}
    words = {t for t in telling if not t.endswith("-")}
    plain = {w for w in words if not any(w[:k] in stems for k in (4, 5, 6)) or found[w] >= 0.5 * max(found.get(w[:k] + "-", 0) for k in (4, 5, 6))}
    automaton = LexiconAutomaton([*plain, *SEEDS], sorted(stems))
    value = shared(spark, automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text").to_pylist(), value.value)
            yield pa.RecordBatch.from_arrays([*[pa.array(x[:, k]) for k in range(5)], b.column("toxic")], [*"abcde", "toxic"])

    rows = np.array([list(r) for r in texts.mapInArrow(run, "a double, b double, c double, d double, e double, toxic int").collect()]).reshape(-1, 6)
    weight = np.where(rows[:, 5] == 1, max(1.0, counts[1] / per_class), max(1.0, counts[0] / (2 * per_class)))
    return ToxicityModel(automaton, rows[:, :5], rows[:, 5], weight / weight.mean())


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, score)."""
    value = shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(value.value.score(part.column("text").to_pylist()))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, held_out = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), doc_crc() % 5 == 0
    model = learn(docs.filter(~held_out), labels.filter(~held_out))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
