"""Operators on documents against brute force in plain Python, and on odd rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.llm import brown_lm, decontamination, language_id, mixing, ngram_join, sharding, toxicity
from readloom.llm.common import doc_crc, text_chunks, word_hashes, word_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash long, n int, size string"
ODD = [
    (900, None, None, None, None, 1, 2, "x"), (901, "", "en", "a", 0, 1, 2, "x"), (902, " \t\n ", "en", "a", 4, 1, 2, "x"), (903, "…!?", "fr", "b", 3, None, None, None), (904, "één wörd ça va ÀB", "fr", "b", 17, 1, 2, "x"),
    (905, "long " * 30_000, "en", "a", 150_000, 1, 2, "x"), (None, "no id here at all really", "en", "a", 24, 1, 2, "x"), (906, "same row twice in here", "en", None, 22, 1, 2, "x"), (906, "same row twice in here", "en", None, 22, 1, 2, "x"),
]


def corpus(n=120, seed=5):
    rng = random.Random(seed)
    words = {"en": "the of and thing with hand".split(), "de": "der die und nicht schön über".split()}
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        text = " ".join(rng.choice(words[lang]) + rng.choice(["", "", "", "s", "x" + str(rng.randint(0, 99))]) for _ in range(rng.randint(1, 80)))
        if i % 7 == 3 and rows:
            base = rng.choice(rows)[1].split()
            base[rng.randrange(len(base))] = "edit"
            text = " ".join(base)
        if i % 11 == 5 and rows:
            text = rng.choice(rows)[1].upper()
        rows.append((i, text, lang, f"s{i % 4}", len(text), 1, 2, "x"))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus() + ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def ws_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_low(t))


def test_word_hashes_know_words_apart():
    texts = [r[1] for r in corpus() + ODD]
    seen = {}
    for first, buf, off in text_chunks(pa.array(texts, pa.string()), 2000):
        s, e, bounds = word_spans(buf, off)
        h = word_hashes(buf, s, e)
        for i in range(len(off) - 1):
            words = ws_words(texts[first + i])
            assert bounds[i + 1] - bounds[i] == len(words)
            for w, x in zip(words, h[bounds[i] : bounds[i + 1]].tolist(), strict=True):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# ---------------------------------------------------------------- 1


def test_scores_are_brute_force(docs):
    """Base and class scores, both summed token by token from plain counts; only the classes are the model's."""
    held = doc_crc() % 10 == 0
    model = brown_lm.BrownModel(docs.filter(~held), n_core=10, n_endings=6, n_classes=6, least=4, head=60)
    got = model.score(docs.select("doc_id", "text")).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    crc = lambda d: zlib.crc32(("" if d is None else str(d)).encode())
    train = [ws_words(t) for d, t in rows if crc(d) % 10]
    c = Counter(x for w in train for x in [*w, None])
    total, v = sum(c.values()), len(c)
    base = lambda w: sum(math.log10((c[x] + 0.1) / (total + 0.1 * (v + 1))) for x in [*w, None])
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == sorted((repr(d), len(w) + 1, sum(c[x] > 0 for x in [*w, None]), round(base(w), 6)) for d, t in rows for w in [ws_words(t)])
    assert {r["train_tokens"] for r in got} == {total}

    head, tables, memo = model.head, model.tables, {}

    def look(word):  # (class, ending's item or None for a word with a class of its own)
        if word not in memo:
            raw = word.encode()
            h = word_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))
            at, item = int(head.look_up(h)[0]), int(head.ending_item(brown_lm.endings(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)])))[0])
            own = int(head.own[at]) if at >= 0 else -1
            memo[word] = (own, None) if own >= 0 else (int(tables.of_item[item]), item)
        return memo[word]

    known = [w for w in c if w is not None]
    assert sum(look(w)[1] is None for w in known) > 10 + 5  # the core and others
    assert {look(w)[1] is None for w in known if c[w] < 4} == {False}
    classes = lambda w: [0, *[look(x)[0] for x in w], 0]
    g = Counter(pair for w in train for x in [classes(w)] for pair in zip(x, x[1:], strict=False))
    k = len(tables.step)
    ending_tokens, ending_words = Counter(), Counter()
    for w in known:
        if look(w)[1] is not None:
            ending_tokens[look(w)[1]] += c[w]
            ending_words[look(w)[1]] += 1
    mass = Counter({0: c[None] + 0.1})
    for i in range(1 + head.n_core, head.n_items):
        mass[int(tables.of_item[i])] += ending_tokens[i] + 0.1
    for w in known:
        if look(w)[1] is None:
            mass[look(w)[0]] += c[w] + 0.1
    from_ = Counter()
    for (a, _), n in g.items():
        from_[a] += n

    def score(w):
        out, x = 0.0, classes(w)
        for a, b in zip(x, x[1:], strict=False):
            out += math.log10((g[(a, b)] + mass[b] / sum(mass.values())) / (from_[a] + 1))
        for word in w:
            cls, item = look(word)
            out += math.log10((c[word] + 0.1) / mass[cls]) if item is None else math.log10((ending_tokens[item] + 0.1) / mass[cls] * (c[word] + 0.1) / (ending_tokens[item] + 0.1 * (ending_words[item] + 1)))
        return out + math.log10((c[None] + 0.1) / mass[0])

    assert k == max(mass) + 1
    want = {repr(d): round(score(ws_words(t)), 5) for d, t in rows}
    assert {repr(r["doc_id"]): round(r["score"], 5) for r in got} == want
    assert all(r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"])) for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_joining_a_class_gains_likelihood():
    rng = np.random.default_rng(6)
    g = rng.integers(1, 50, (5, 5)).astype(float)

    def value(g):
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(g) - f(g.sum(0)) - f(g.sum(1))

    rows = [(w, s, int(n)) for w in (3, 4, 9) for s, n in enumerate(rng.integers(0, 9, 10)) if n]
    words, best = brown_lm.best_classes(*[np.array(x) for x in zip(*[(w, s) for w, s, _ in rows], strict=True)], np.array([n for *_, n in rows], float), g)
    assert words.tolist() == [3, 4, 9]
    for w, b in zip(words, best, strict=True):
        gains = []
        for k in range(1, 5):
            more = np.zeros((5, 5))
            for x, s, n in rows:
                if x == w:
                    more[(s, k) if s < 5 else (k, s - 5)] += n
            # rows that add to one cell from both sides count apart there, as they do for words that never follow themselves
            f = lambda x: x * np.log(np.maximum(x, 1e-300))
            gain = sum(f(g[(s, k) if s < 5 else (k, s - 5)] + n) - f(g[(s, k) if s < 5 else (k, s - 5)]) for x, s, n in rows if x == w)
            nl, nr = sum(n for x, s, n in rows if x == w and s < 5), sum(n for x, s, n in rows if x == w and s >= 5)
            gains.append(gain - (f(g.sum(1)[k] + nr) - f(g.sum(1)[k])) - (f(g.sum(0)[k] + nl) - f(g.sum(0)[k])))
        assert b == 1 + int(np.argmax(gains))


def test_exchange_does_not_lose_likelihood():
    rng = np.random.default_rng(2)
    block = np.kron(np.array([[9, 1], [1, 9]]), np.ones((6, 6)))
    m = np.zeros((13, 13))
    m[1:, 1:] = rng.poisson(block * 5)

    def value(of):
        one = np.eye(of.max() + 1)[of]
        g = one.T @ m @ one
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(g) - f(g.sum(0)) - f(g.sum(1))

    start = np.concatenate(([0], 1 + np.arange(12) % 2))
    of = brown_lm.exchange(m, 3)
    assert value(of) > value(start)
    assert len(set(of[1:7])) == 1 and len(set(of[7:])) == 1 and of[1] != of[7]


def test_scores_of_nothing(empty):
    model = brown_lm.BrownModel(empty)
    assert model.score(empty.select("doc_id", "text")).count() == 0


# ---------------------------------------------------------------- 3


def brute_contamination(text, items, window=13):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_low(t))
    w, hit, found = low(text), set(), set()
    for name, t in items:
        x = low(t)
        for i in range(max(1, len(x) - window + 1) if x else 0):
            part = x[i : i + window]
            for j in range(len(w) - len(part) + 1):
                if w[j : j + len(part)] == part:
                    hit |= set(range(j, j + len(part)))
                    found.add(name)
    return len(w), len(hit), sorted(found)


def test_decontamination_is_brute_force(spark, docs):
    texts = [r[1] for r in corpus() if len(r[1].split()) > 20]
    items = [("1", texts[0]), ("22", " ".join(texts[1].split()[3:17])), ("3", "hand THE"), ("3", "hand the"), ("4", "the the the the the the the the the the the the the the"), ("5", None), ("6", "..."), (None, texts[2])]
    bench = spark.createDataFrame([(None if a is None else int(a), t) for a, t in items], "item_id long, text string")
    real = [(a, t) for a, t in items if a and t]
    for block_windows in (1 << 20, 9):
        got = decontamination.matched(docs, bench, block_windows=block_windows).collect()
        want = [(repr(r["doc_id"]), *brute_contamination(r["text"], real)) for r in docs.collect() if r["doc_id"] != 905]
        have = [(repr(r["doc_id"]), r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in got if r["doc_id"] != 905]
        assert sorted(have) == sorted(want)
    assert next(r for r in got if r["doc_id"] == 905)["n_words"] == 30_000
    clean = decontamination.decontaminated(docs, bench)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()


def test_decontamination_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.matched(empty, none).count() == 0
    assert decontamination.decontaminated(docs, none).count() == docs.count()


# ---------------------------------------------------------------- 5


def brute_targets(sizes, weights, share, most):
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s], share * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in full or open_:
            out[i] = most * sizes[i] if full else unit * weights[i]
            left -= most * sizes[i] if full else 0
        open_ = [i for i in open_ if i not in full] if full else []
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 1000, 0], [1, 2, 4, 8, 16, 500, 3000, 0, 0, 7], list(range(1, 60))])
def test_targets_are_brute_force(spark, sizes):
    rows = [(i, f"s{i:02d}" if i else None, s) for i, s in enumerate(sizes)]
    placed = spark.createDataFrame([r for r in rows], "doc_id long, source string, size long").repartition(3)
    got = {r["source"]: r for r in mixing.source_targets(placed, (3, 1, 2), 1.5, 2.0).collect()}
    order = sorted(range(len(sizes)), key=lambda i: (rows[i][1] is None, rows[i][1] or ""))
    want = brute_targets([sizes[i] for i in order], [(3, 1, 2)[k % 3] for k in range(len(sizes))], 1.5, 2.0)
    assert [got[rows[i][1]]["src"] for i in order] == list(range(len(sizes)))
    assert [got[rows[i][1]]["target"] for i in order] == pytest.approx(want)


def test_steps_are_primes():
    assert all(p % d for p in mixing.STEPS for d in range(2, 3163))


@pytest.mark.parametrize("block_words", [1, 5, 64])
def test_blocks_are_taken_by_permutations(spark, block_words):
    """The words of a source come equally often, but for those of one cut pass, and a source of few words gives exactly its target too."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(n)), s) for i, (s, n) in enumerate([("tiny", 6), *[("b", 7 + i % 5) for i in range(30)], *[("c", 11) for _ in range(40)], ("d", 1), (None, 300)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces, placed, sources = mixing.mix(docs, block_words=block_words, n_shards=3)
    times, by = Counter(), Counter()
    for r in pieces.collect():
        for k in range(r["word_from"], r["word_to"]):
            times[(r["doc_id"], k)] += 1
            by[r["source"]] += 1
    for r in sources.collect():
        own = [times[(d, k)] for d, t, s in rows if s == r["source"] for k in range(len(t.split()))]
        assert by[r["source"]] == round(r["target"]) == sum(own)
        assert max(own) - min(own) <= 1 and max(own) <= 2
    slots = [(r["shard"], r["slot"]) for r in pieces.select("shard", "slot").distinct().collect()]
    for shard in range(3):
        own = sorted(x for s, x in slots if s == shard)
        assert own == list(range(len(own)))


def test_mix_meets_its_targets(docs):
    runs = [sorted((tuple(r) for r in mixing.taken(*mixing.mix(docs, block_words=8, n_shards=4)).collect()), key=repr) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == docs.count()
    rows = docs.collect()
    assert sorted(((repr(a), b) for a, b, *_ in runs[0])) == sorted((repr(r["doc_id"]), len(ws_words(r["text"]))) for r in rows)
    assert all(0 <= t <= 2 * s for _, s, _, _, t in runs[0])
    total = sum(x[1] for x in runs[0])
    by = Counter()
    for _, _, source_size, target, t in runs[0]:
        by[(source_size, target)] += t
    assert sum(t for _, t in by) == pytest.approx(1.5 * total)
    assert all(abs(t - goal) <= 0.5 for (_, goal), t in by.items())


def test_repeated_rows_are_documents_of_their_own(spark):
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    rows = [(7, words(7), "a", 1)] * 6 + [(None, words(8), "ab"[i % 2], i) for i in range(8)] + [(100 + i, words(100 + i), "b", 0) for i in range(10)]
    docs, how = spark.createDataFrame(rows, "doc_id long, text string, source string, mark int"), {"block_words": 8, "n_shards": 4}
    want, got = Counter(), Counter()
    for r in mixing.taken(*mixing.mix(docs, **how)).collect():
        want[r["doc_id"]] += r["taken"]
    for r in mixing.mixed_documents(docs, **how).collect():
        got[r["doc_id"]] += len(ws_words(r["text"]))
    assert got == +want and sum(got.values()) <= 1.5 * 40 * len(rows) + 16


def test_mixed_documents_hold_what_was_taken(docs, empty):
    how = {"block_words": 8, "n_shards": 4}
    want, got = Counter(), Counter()
    for r in mixing.taken(*mixing.mix(docs, **how)).collect():
        want[r["doc_id"]] += r["taken"]
    mixed = mixing.mixed_documents(docs, **how)
    assert mixed.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in mixed.collect():
        got[r["doc_id"]] += len(ws_words(r["text"]))
        assert r["n_chars"] == len(r["text"])
        assert set(ws_words(r["text"])) <= set(ws_words(texts[r["doc_id"]]))
    del want[906], got[906]  # equal rows count as one document there
    assert got == +want
    assert mixing.mixed_documents(empty).count() == 0
    assert mixing.taken(*mixing.mix(empty)).count() == 0


# ---------------------------------------------------------------- 7


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_automaton_is_edit_distance():
    words, stems = ["idiot", "clown", "pathetic", "oaf", "disgusting"], ["lowei", "chlla"]
    a = toxicity.LexiconAutomaton(words, stems)
    rng = random.Random(1)
    tried = set(words + stems + ["loweichen", "lowe", "x", "idiots", "idot", "1diot", "disgstin", "pathetik"])
    for w in [*words, *stems]:
        for _ in range(300):
            t = list(w)
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(t) + 1)
                t[k : k + rng.randint(0, 1)] = rng.choice(["", "e", "z", "é", "o"])
            tried.add("".join(t))
    tried = sorted(t for t in tried if t)
    text = " ".join(tried)
    codes = np.array([ord(c) for c in text])
    ends = np.cumsum([len(t) + 1 for t in tried]) - 1
    got = a.match(codes, ends - [len(t) for t in tried], ends)
    for t, k in zip(tried, got.tolist(), strict=True):
        near = any(distance(t, w) <= toxicity.edits_for(w) for w in words)
        want = toxicity.WORD if t in words else toxicity.STEM if any(t.startswith(s) for s in stems) else toxicity.EDITED if near else 0
        assert k == want, t


def test_toxicity_learns_and_spares_quotes(spark):
    rng = random.Random(4)
    fill = "river stone cloud garden paper winter market".split()
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(fill) + rng.choice(["", "s", "ly"]) for _ in range(30)]
        if i % 5 == 0:
            for _ in range(3):
                words[rng.randrange(30)] = rng.choice(["grobnik", "grobniks", "idiot"])
        rows.append((i, " ".join(words), None))
        labels.append((i, int(i % 5 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs.filter("doc_id % 4 <> 1"), labels.filter("doc_id % 4 <> 1"))
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    held = [i for i in range(400) if i % 4 == 1]
    assert sum((got[i] >= 0.5) == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    abuse, misspelt, quoted, none, void = model.score(["you are an idiot and a grobnik", "you are an idoit and a grobnyk", 'he said "you are an idiot" to them', None, ""])
    assert abuse > 0.5 and misspelt > none and quoted < abuse and none == void < 0.5
    assert toxicity.scored(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_automata_of_any_size_keep_their_edits():
    rng = random.Random(8)
    words, stems = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 11))) for _ in range(60)], ["gabb", "fedca"]
    one, many = toxicity.LexiconAutomaton(words, stems), toxicity.LexiconAutomaton(words, stems, most_states=400)
    tried = [*words, *(w[:k] + w[k + 1 :] for w in words for k in (1, 2)), *(w[:2] + "x" + w[3:] for w in words), *(s + "xyz" for s in stems), "abc", "gfedcba"]
    ends = np.cumsum([len(t) + 1 for t in tried]) - 1
    codes = np.array([ord(c) for c in " ".join(tried)])
    a, b = (x.match(codes, ends - [len(t) for t in tried], ends).tolist() for x in (one, many))
    assert a == b and set(a) == {0, toxicity.WORD, toxicity.STEM, toxicity.EDITED}


def test_lexicon_does_not_depend_on_partitions(spark):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} grobnik" if i < 800 else "river stone cloud") for i in range(1600)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i < 800)) for i in range(1600)], "doc_id long, toxic int")
    found = [toxicity.learn(docs.repartition(n), labels).automaton for n in (1, 16)]
    assert found[0].words == found[1].words and found[0].stems == found[1].stems
    assert "grobnik" in found[0].words or "grob" in found[0].stems


def test_toxicity_without_labels(spark, docs):
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scored(docs, model).count() == docs.count()


# ---------------------------------------------------------------- 8


def brute_components(rows, width=5):
    sets = []
    for d, t in rows:
        w = ws_words(t)
        sets.append((d, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    label = {d: d for d, _ in sets}
    links = set()
    for (a, x), (b, y) in combinations(sets, 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
            links.add((min(a, b), max(a, b)))
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(label[a], label[b])
            if (label[a], label[b]) != (m, m):
                label[a] = label[b] = m
                moved = True
    return [(d, len(s), label[d] if d is not None else None) for d, s in sets], links


@pytest.mark.parametrize(("leaf", "room", "busy", "hot_rows"), [(32, 4096, 256, 200_000), (1, 1, 2, 3), (1, 4096, 1, 200_000)])
def test_join_is_brute_force(docs, leaf, room, busy, hot_rows):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, _ = brute_components(rows)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.JaccardJoin(docs, leaf=leaf, room=room, common_from=3, busy=busy, hot_rows=hot_rows).result().collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_join_finds_clusters_without_a_middle(spark):
    """Copies with own edits, linked with few of each other, and documents that share a passage only."""
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.choice([1, 3, 4, 5])):
            words[rng.randrange(200)] = f"e{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join([*base[:60], *(f"o{i}x{k}" for k in range(rng.randint(5, 40)))])) for i in range(40)]
    want, links = brute_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in ngram_join.JaccardJoin(docs, leaf=2, room=8).result().collect()]
    assert sorted(got) == sorted(want)
    every = ngram_join.JaccardJoin(docs, leaf=4, room=16, busy=5, all_links=True)
    assert {(min(r["p"], r["x"]), max(r["p"], r["x"])) for r in every.links.collect()} == links


def test_join_keeps_small_groups_beside_a_region_of_many_rounds(spark):
    """Small groups, linked by pairs of a leaf, are done a round before a region that shares a passage and has more members than room."""
    rng = random.Random(4)
    word = lambda: f"w{rng.getrandbits(40)}"
    rows = []
    for _ in range(20):
        base = [word() for _ in range(60)]
        for _ in range(6):
            own = list(base)
            own[rng.randrange(60)] = word()
            rows.append((len(rows), " ".join(own)))
    base = [word() for _ in range(20)]
    rows += [(200 + i, " ".join([*base, *(word() for _ in range(rng.randint(2, 4)))])) for i in range(60)]
    want, _ = brute_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in ngram_join.JaccardJoin(docs, leaf=1, room=8).result().collect()]
    assert sorted(got) == sorted(want)


def test_deduplicated(docs, empty):
    kept = ngram_join.deduplicated(docs)
    assert kept.columns == docs.columns
    want, _ = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(d) for d, _, c in want if d is None or d == c)
    assert ngram_join.JaccardJoin(empty).result().count() == 0


def test_jaccard_join_shuffles_texts_once_for_its_table(spark):
    rng, docs = random.Random(3), []
    for i in range(100):
        words = [f"{rng.getrandbits(40):010x}" for _ in range(300)]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-3]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).cache()
    df.count()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where neither side is small
    try:
        before = written()
        rows = ngram_join.JaccardJoin(df).result().collect()
        moved = written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
        df.unpersist()
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in rows)
    assert moved < 3.3 * sum(len(t) for _, t in docs)  # 2.9 with one shuffle of the texts, 3.8 with two


# ---------------------------------------------------------------- 9


def test_language_id(docs, empty):
    net, names = language_id.learn(language_id.trainable(doc_crc() % 4 == 2, docs.filter("lang <> 'fr'")))
    assert names == ["de", "en"]
    got = language_id.predict(docs.select("doc_id", "text", "hash"), net, names).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert {by[i] for i in (900, 901, 902, 903)} == {"und"} and by[905] == "en"
    truth = {r[0]: r[2] for r in corpus() if len(r[1].split()) > 5 and "edit" not in r[1] and r[0] % 11 != 5}
    assert sum(by[d] == t for d, t in truth.items()) >= 0.95 * len(truth)
    assert language_id.predict(empty.select("doc_id", "text"), net, names).count() == 0
    assert language_id.learn(empty.select("text", "lang")) == (None, [])
    assert {r["lang_pred"] for r in language_id.predict(docs.select("text"), None, []).collect()} == {"und"}


def test_network_is_a_convolution():
    """Packed tables of byte pairs against a convolution of one-hot bytes, and gradients' direction against the loss."""
    rng = np.random.default_rng(3)
    net = language_id.ByteCNN(3, filters=4)
    net.bias = [rng.normal(size=4).astype(np.float32) for _ in language_id.WIDTHS]
    net.pack()
    x = rng.integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8)

    def plain(row):
        h = []
        for w, table_, bias in zip(language_id.WIDTHS, net.tables, net.bias, strict=True):
            for f in range(4):
                h.append(max(0.0, max(sum(float(table_[j][int(row[i + j])][f]) for j in range(w)) for i in range(language_id.WINDOW - w + 1)) + float(bias[f])))
        z = np.array(h) @ net.out + net.out_bias
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    assert np.allclose(net.predict(x), [plain(r) for r in x], atol=1e-5)
    y = np.array([0, 1, 2, 1, 0])
    loss = lambda: -np.log(net.predict(x)[np.arange(5), y]).sum()
    before = loss()
    net.train(x, y, epochs=20, batch=5)
    net.pack()
    assert loss() < before


def test_windows_hold_all_bytes():
    texts = [b"", b"A", b"b" * 256, b"c" * 257, b"d" * 1000]
    off = np.cumsum([0, *map(len, texts)])
    x, of, weight = language_id.windows(np.frombuffer(b"".join(texts), np.uint8), off)
    for i, t in enumerate(texts):
        assert b"".join(r.tobytes() for r in x[of == i])[: len(t)] == t.lower() and weight[of == i].sum() == len(t)


def test_a_hot_text_is_one_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id.ByteCNN, "train", lambda self, x, y: seen.append(y.tolist()))
    docs = spark.createDataFrame([("der die das und nicht",)] * 5000 + [(f"the thing {i}",) for i in range(50)], "text string").withColumn("lang", F.when(F.col("text").startswith("der"), "de").otherwise("en"))
    net, names = language_id.learn(docs, per_language=20)
    assert names == ["de", "en"] and seen[0].count(0) == 1 and 5 < seen[0].count(1) < 40
    assert language_id.learn(docs, languages=1)[1] == ["en"]
    many = spark.range(3000).select(F.concat(F.lit("text number "), "id").alias("text"), F.concat(F.lit("l"), F.col("id") % 600).alias("lang"))
    seen.clear()
    assert len(language_id.learn(many, most=1200)[1]) == 600 and len(seen[0]) < 3000  # every label stays, with fewer texts each


def test_accepted_keeps_columns(docs):
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns and {900, 901, 902, 903}.isdisjoint(r["doc_id"] for r in kept.collect())


# ---------------------------------------------------------------- 10


def test_shards(docs, empty):
    got = sharding.shard(docs, n_shards=5).collect()
    rows = docs.collect()
    text = {r["doc_id"]: r["text"] for r in rows}
    size = lambda t: 8 + len((t or "").encode())
    assert len(got) == len(rows)
    assert all(r["size"] == size(text[r["doc_id"]]) and r["text_crc32"] == (None if text[r["doc_id"]] is None else zlib.crc32(text[r["doc_id"]].encode())) for r in got)
    for k in range(5):
        own = sorted(r["slot"] for r in got if r["shard"] == k)
        assert own == list(range(len(own)))
    small = sharding.shard(docs.filter("doc_id is null or doc_id <> 905"), n_shards=4).collect()
    total = sum(r["size"] for r in small)
    sums = Counter()
    for r in small:
        sums[r["shard"]] += r["size"]
    assert max(abs(sums[k] - total / 4) for k in range(4)) <= 2 * max(r["size"] for r in small)
    assert sharding.shard(empty).count() == 0


def test_shards_are_brute_force(docs):
    """Laid out in key order, a group of equal texts goes to the shard that its middle falls in."""
    rows = [r for r in docs.collect() if r["doc_id"] != 905]
    got = sharding.shard(docs.filter("doc_id is null or doc_id <> 905"), n_shards=4, whole_group=1.0).collect()
    size = lambda t: 8 + len((t or "").encode())
    total = sum(size(r["text"]) for r in rows)
    of = {r["doc_id"]: r["text"] for r in rows}
    shards, sums = {}, Counter()
    for r in got:
        shards.setdefault(of[r["doc_id"]], set()).add(r["shard"])
        sums[r["shard"]] += r["size"]
    assert all(len(x) == 1 for x in shards.values())  # groups stay together
    # the groups in order of key, as their shards and slots tell
    order = []
    for r in sorted(got, key=lambda r: (r["shard"], r["slot"])):
        if of[r["doc_id"]] not in order:
            order.append(of[r["doc_id"]])
    at, n = 0, Counter(r["text"] for r in rows)
    for t in order:
        bytes_ = n[t] * size(t)
        assert shards[t] == {min(3, int((at + bytes_ / 2) * 4 / total))}
        at += bytes_
    assert all(abs(sums[k] - total / 4) <= max(n[t] * size(t) for t in n) for k in range(4))


def test_equal_rows_are_cut(spark):
    docs = spark.createDataFrame([(7, "one text")] * 9000 + [(None, "one text")] * 3000 + [(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    got = [sharding.shard(docs.repartition(n), n_shards=6).collect() for n in (2, 9)]
    sums = Counter()
    for r in got[0]:
        sums[r["shard"]] += r["size"]
    assert len(got[0]) == 12_100 and len(sums) == 6 and max(sums.values()) < 1.1 * min(sums.values())
    assert Counter(map(repr, got[0])) == Counter(map(repr, got[1]))


def test_shards_cut_a_hot_group(spark):
    docs = spark.createDataFrame([(i, "copy of one text" if i % 3 else f"text {i} " * (i % 9)) for i in range(3000)], "doc_id long, text string")
    got = sharding.shard(docs, n_shards=6).collect()
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) < 1.1 * min(sums.values()) and len(sums) == 6
