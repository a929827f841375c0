"""Token counts, alignment of two tokenizers and whitening, against the libraries and brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from readloom.llm import cross_tokens, token_counts, whitening
from readloom.llm.pieces import processor
from readloom.llm.trees import tree_summed


SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

ODD = [" ", "  ", "\n", "\n\n", "\t", "a", "the", "The", "é", "é", "▁", "<s>", "<unk>", "<0x41>", "日本", "😀", "\x00", " ", " ", "0", "12", "...", "==", "<|endoftext|>", "\r\n", "ing", "don't", "'ll", "'", "\x85", "\x1c", "ß", "_", "-", "$1,000", "ǅ", "Ⅷ", "²"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + odd_texts(3000, 1) + [None, "", "ab" * 30_000, " " * 5000, "x y " * 20_000]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").repartition(3)


def test_counts(spark, texts):
    got = {r["doc_id"]: r for r in token_counts.token_counts(documents(spark, texts), B).collect()}
    want = [len(x) for x in processor(B).encode([t or "" for t in texts], num_threads=1)]
    assert [got[i]["n_tokens"] for i in range(len(texts))] == want
    assert all(got[i]["n_bytes"] == len((t or "").encode()) and got[i]["over_limit"] == (want[i] > 4096) for i, t in enumerate(texts))


def test_merges_by_scanning():
    """The heap's merges are those of looking for the lowest pair over and over."""
    rng = random.Random(3)
    for _ in range(300):
        rank = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 4))): rng.randint(0, 5) for _ in range(12)}
        word = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        left, n = list(word), 0
        while pairs := [(rank[left[i] + left[i + 1]], i) for i in range(len(left) - 1) if left[i] + left[i + 1] in rank]:
            i = min(pairs)[1]
            left[i : i + 2] = [left[i] + left[i + 1]]
            n += 1
        assert token_counts.merges(word, rank.get) == n


def test_counts_forget(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY", 5)
    some = odd_texts(300, 2)
    assert token_counts.counted(some, B, token_counts.Counts(B)).tolist() == [len(x) for x in processor(B).encode(some)]


def by_hand(texts):
    """Groups and links of whole texts, with the libraries' own encodings."""
    a, byte = Tokenizer.from_file(A), cross_tokens._byte_of()
    a.encode_special_tokens = True
    p = processor(B)
    groups, links = [], []
    for text in texts:
        groups.append([])
        links.append([])
        if not text:
            continue
        whole = (" " + text).encode()
        xs = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        ys = [(i, bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()) for i in p.encode(text)]
        if b"".join(b for _, b in xs) != whole or b"".join(b for _, b in ys) != whole:
            continue
        ends_a, ends_b = (np.cumsum([len(b) for _, b in z]).tolist() for z in (xs, ys))
        at_a, at_b = dict(zip(ends_a, range(len(xs)))), dict(zip(ends_b, range(len(ys))))
        i = j = 0
        for end in sorted(set(at_a) & set(at_b)):
            k, m = at_a[end] + 1, at_b[end] + 1
            groups[-1].append(f"{','.join(str(x[0]) for x in xs[i:k])}|{','.join(str(y[0]) for y in ys[j:m])}")
            links[-1].append((xs[k - 1][0], ys[m - 1][0]))
            i, j = k, m
    return groups, links


def test_alignment(spark, texts):
    docs = documents(spark, texts)
    found = cross_tokens.link_table(docs, A, B)
    got = {r["doc_id"]: r for r in cross_tokens.aligned(docs, found, A, B).collect()}
    groups, links = by_hand(texts)
    counts = Counter(x for doc in links for x in doc)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    assert len(got) == len(texts) and len(found.counts) == len(counts)
    for i in range(len(texts)):
        r, n = got[i], [counts[x] for x in links[i]]
        assert r["groups"] == ";".join(groups[i]), texts[i]
        assert (r["n_groups"], r["n_links"], r["count_sum"]) == (len(groups[i]), len(links[i]), sum(n))
        assert r["n_best"] == sum(c == highest[b] for c, (_, b) in zip(n, links[i]))
        assert r["n_a"] == sum(len(g.split("|")[0].split(",")) for g in groups[i]) and r["n_b"] == sum(len(g.split("|")[1].split(",")) for g in groups[i])
    assert found.look_up(np.array([1 << 62, 5 << 32 | 31_999_999]))[0].tolist() == [0, 0]
    # of two linked tokens one's bytes end with the other's
    a, b = cross_tokens.byte_strings(A), cross_tokens.piece_strings(B)
    assert all(a[x].endswith(b[y]) or b[y].endswith(a[x]) for x, y in counts)


def test_alignment_forgets(spark, monkeypatch):
    monkeypatch.setattr(cross_tokens, "MEMORY", 50)
    monkeypatch.setattr(cross_tokens, "CHUNK_BYTES", 200)
    parts, some = cross_tokens.Parts(A, B), odd_texts(200, 4)
    groups, _ = by_hand(some)
    for first, bounds, numbers in parts.of(some):
        for k in range(len(bounds) - 1):
            mine = numbers[bounds[k] : bounds[k + 1]]
            if all(parts.right[x] for x in mine):
                assert ";".join(parts.groups[x] for x in mine) == ";".join(groups[first + k])
        if len(parts.groups) > 50:
            parts.forget()


def test_query_digest(spark):
    rows = cross_tokens.op12_cross_tokens(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = [r["doc_id"] for r in rows]
    groups, _ = by_hand([texts[i] for i in ids])
    for r, g in zip(rows, groups):
        assert r["groups_sha256"] == (hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")


def test_pair_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 62, n, dtype=np.int64))
        h = cross_tokens.PairHash(keys)
        assert sorted(h.index(keys).tolist()) == list(range(len(keys)))
        others = rng.integers(0, 1 << 62, 1000, dtype=np.int64)
        assert np.array_equal(h.index(others) >= 0, np.isin(others, keys))


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(docs, B).count() == 0
    assert cross_tokens.aligned(docs, cross_tokens.link_table(docs, A, B), A, B).count() == 0
    null = spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string")
    r = cross_tokens.aligned(null, cross_tokens.link_table(null, A, B), A, B).collect()
    assert len(r) == 2 and all(x["n_a"] == x["n_links"] == x["count_sum"] == 0 and x["groups"] == "" for x in r)


def test_tree_sum(spark):
    rows = [(i, i % 3, np.full(4, i, np.int64).tobytes()) for i in range(1000)]
    df = spark.createDataFrame(rows, "part int, block int, sums binary").repartition(5)
    got = {r["block"]: np.frombuffer(r["sums"], np.int64).tolist() for r in tree_summed(df, "i8").collect()}
    assert got == {k: [sum(range(k, 1000, 3))] * 4 for k in range(3)}


# ---------------------------------------------------------------- whitening


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40, 90])
def test_eigenvectors(n):
    m = np.random.default_rng(n).standard_normal((n, 2 * n))
    for a in (m @ m.T, np.eye(n), np.ones((n, n)), np.diag(np.arange(n) // 3 * 1.0), np.zeros((n, n))):
        values, x = whitening.leading_vectors(a, 32)
        want = np.linalg.eigvalsh(a)[::-1][: len(values)]
        size = max(1e-300, np.abs(want).max())
        assert len(values) == min(n, 32) and np.abs(values - want).max() < 1e-13 * max(size, 1e-200)
        assert np.abs(a @ x - x * values).max() <= 2e-14 * size and np.abs(x.T @ x - np.eye(x.shape[1])).max() < 1e-13


def by_numpy(vectors, k=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    cov = y.T @ y / n
    w, v = np.linalg.eigh(cov)
    w, v = w[::-1][:k], v[:, ::-1][:, :k]
    deviation = [sum(int(z) ** 2 for z in row) for row in (n * x - s)]
    return deviation, np.abs(y @ v / np.sqrt(w)), w / np.trace(cov)


def test_whitening(spark):
    rng = np.random.default_rng(7)
    v = (rng.standard_normal((500, 40)) * np.linspace(1, 9, 40)).astype(np.float32)
    bad = [(1001, None), (1002, [None, *[1.0] * 39]), (1003, [float("nan")] * 40), (1004, [float("inf"), *[0.0] * 39]), (1005, [1.0] * 39), (1006, []), (1007, [float("-inf")] * 40)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + bad, "vec_id long, embedding array<float>").withColumn("x", F.lit("clash")).repartition(4)
    rows = whitening.whiten(df).collect()
    deviation, size, explained = by_numpy(v)
    assert len(rows) == 500 * 32 and {r["n"] for r in rows} == {500} and len({r["identity_error"] for r in rows}) == 1
    got = np.zeros((500, 32))
    for r in rows:
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[r["vec_id"]] and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-10
    assert np.abs(np.abs(got) - size).max() < 1e-7
    assert rows[0]["identity_error"] < 1e-9 and np.abs(got.T @ got / 500 - np.eye(32)).max() < 1e-9


def test_whitening_query(spark):
    rows = whitening.op13_whitening(spark, SF).toPandas()
    v = [r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    deviation, size, explained = by_numpy(v)
    assert len(rows) == len(v) * 32 and rows["identity_error"].max() < 1e-9
    rows = rows.sort_values(["vec_id", "component"])
    assert rows["deviation"].to_numpy().reshape(-1, 32)[:, 0].tolist() == deviation
    assert np.allclose(rows["explained"].to_numpy()[:32], explained, rtol=1e-9)
    assert np.abs(np.abs(rows["whitened"].to_numpy().reshape(-1, 32)) - size).max() < 1e-5


def test_whitening_degenerate(spark):
    schema = "vec_id long, embedding array<double>"
    empty = whitening.whiten(spark.createDataFrame([], schema))
    assert empty.count() == 0 and isinstance(empty.schema["vec_id"].dataType, T.LongType)
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0
    # one direction of variance, repeated rows and a null id
    rows = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 4.0])], schema)).collect()
    assert [r["component"] for r in rows] == [1, 1, 1] and rows[0]["identity_error"] < 1e-12 and abs(rows[0]["explained"] - 1) < 1e-12
    # a deviation beyond a long's range
    huge = whitening.whiten(spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 1.0])], schema)).collect()
    assert all(r["deviation"] is None for r in huge) and rows[0]["identity_error"] < 1e-4
