"""URL filter: host and path rules first, then gradient-boosted trees on lexical features of the url.

Features: lengths of url, host and path, host labels, path depth, digit ratios, entropy of the host's name, hyphens, parameter count,
length of the query, address-like hosts, escapes, and statistics of the host's last label, of its suffix, of the path's first part, and
of suffix and part together: the smoothed share of blocked urls, each owner counted once, and whether there are any, so a key that was never
seen is told from one without a leaning. An owner is a registered domain; one with `MANY` names under it is a suffix, and these are owners.

Labels. The trees learn from labelled urls (url, label). `rule_labels` makes them from the rules, which say of the urls that they fit
what is right; the trees carry that over to all others. Statistics are counted in Spark over all labelled urls, by the keys themselves, and
joined to urls; a training url has the statistics of the other `FOLDS` of owners, so no feature holds its label, nor that of another
host of its domain, nor tells it by what is missing. Up to `BROADCAST_KEYS` keys of a kind the table is broadcast, beyond that both sides are shuffled. The trees are fitted on
the driver on about `sample` urls, as many from each owner as there are.

Cases: a null url, or one without `://`, has an empty host and path and is judged like any other; repeated rows are judged alike; a
null id is kept; an empty table gives no rows; without labels of both kinds the share of blocked labels is every url's; other columns
are kept, but those called host, path, rule, verdict or p_block are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import ascii_lower, beside, fraction, giving_back, kept, shared, table

#: (rule, verdict); a rule is a host, and the start of a path.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))

#: Keys of a kind up to which their statistics are broadcast (some 10 MB).
BROADCAST_KEYS = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    rest = F.when(F.coalesce(url, F.lit("")).contains("://"), rest).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: len(x[0])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in (text.count(c) for c in set(text))) if n else 0.0


def rule_labels(urls: DataFrame, rules=RULES) -> DataFrame:
    """(url, label) of the urls that a rule fits: 1 to block, 0 to allow."""
    _, verdict = rule_of(*host_and_path(F.col("url")), rules)
    return urls.select("url", (verdict == "block").cast("int").alias("label")).filter("label is not null")


_PARTS = re.compile(r"^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", re.S)
_ADDRESS = re.compile(r"[\d.]+(:\d+)?")


def _split(url: str | None) -> tuple[str, str, str]:
    m = _PARTS.match(url or "")
    return (m[1].lower(), m[2], m[3] or "") if m else ("", "", "")


#: Owners are dealt to so many folds; a training url's statistics are those of the other folds.
FOLDS = 5

#: So many names under a registered domain make it a suffix, as those of hosting services are.
MANY = 4

#: Kinds of keys that urls have statistics by.
KINDS = ("label", "suffix", "part", "both")


def _domain(host: Column) -> tuple[Column, Column, Column, Column]:
    """Labels of a host without its port, its suffix (the last label, or two where a country's stands behind one of at most three letters), the
    registered domain, and what stands one label before that.
    """
    labels = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")
    n = F.size(labels)
    two = (n > 2) & (F.length(F.get(labels, n - 1)) == 2) & (F.length(F.get(labels, n - 2)) <= 3)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.lit(1), n - k + 1), k), ".")
    depth = F.when(two, 2).otherwise(1)
    return last(F.lit(1)), last(depth), last(depth + 1), last(depth + 2)


def hosting(urls: DataFrame) -> DataFrame:
    """(domain): registered domains with at least MANY names under them."""
    _, _, domain, below = _domain(host_and_path(F.col("url"))[0])
    return urls.select(domain.alias("domain"), below.alias("below")).distinct().groupBy("domain").count().filter(F.col("count") >= MANY).select("domain")


def with_keys(rows: DataFrame, shared_domains: DataFrame, small: bool) -> DataFrame:
    """rows (url, more) with the url's owner and its keys, columns of KINDS; none is ever null.

    The owner is the registered domain. A domain with MANY names under it is a suffix itself, and each of these an owner.
    """
    host, path = host_and_path(F.col("url"))
    label, suffix, domain, below = _domain(host)
    part = F.get(F.split(F.regexp_replace(path, "^/", ""), "/"), F.lit(0))
    busy = shared_domains.select(F.col("domain").alias("domain_"), F.lit(True).alias("busy_"))
    rows = rows.withColumns({"domain_": domain, "below_": below, "suffix_": suffix, "label": label, "part": part}).join(F.broadcast(busy) if small else busy, "domain_", "left")
    many = F.col("busy_").isNotNull()
    rows = rows.withColumns({"owner": F.when(many, F.col("below_")).otherwise(F.col("domain_")), "suffix": F.when(many, F.col("domain_")).otherwise(F.col("suffix_"))})
    return rows.withColumn("both", F.concat_ws("/", "suffix", "part")).drop("domain_", "below_", "suffix_", "busy_")


def lexical(url: str | None) -> list[float]:
    url = url or ""
    host, path, query = _split(url)
    name = "".join(host.split(".")[:-1])
    return [
        len(url), len(host), len(path), host.count(".") + 1, sum(1 for p in path.split("/") if p), sum(c.isdigit() for c in url) / max(1, len(url)), sum(c.isdigit() for c in host) / max(1, len(host)),
        _entropy(name), host.count("-"), query.count("="), len(query), float(bool(_ADDRESS.fullmatch(host))), url.count("%") + url.count("@"),
    ]


#: Names of the features in order.
FEATURES = ("url length", "host length", "path length", "host labels", "path depth", "digit ratio", "host digit ratio", "entropy", "hyphens", "parameters", "query length", "address", "escapes", *(f"{what} of {kind}" for what in ("share", "seen") for kind in KINDS))


class Statistics:
    """Domains and the sum of their shares of blocked urls, by place; a share is smoothed by `weight` domains of the overall one."""

    def __init__(self, hosts: np.ndarray, blocked: np.ndarray, base: float, weight: float = 2.0):
        self.hosts, self.blocked, self.base, self.weight = hosts, blocked, base, weight

    def shares(self, at: np.ndarray, less: np.ndarray | None = None) -> np.ndarray:
        """Shares at the places; less: the share of each row's own domain there, which is taken out."""
        n, b = self.hosts[at], self.blocked[at]
        if less is not None:
            n, b = np.maximum(0, n - 1), np.maximum(0, b - less)
        return (b + self.weight * self.base) / (n + self.weight)


class BoostedTrees:
    """Logistic gradient boosting with trees of fixed depth over binned features, each tree over a random part of them."""

    def __init__(self, n_trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0, part: float = 2 / 3, seed: int = 4):
        self.n_trees, self.depth, self.rate, self.n_bins, self.l2, self.part, self.seed = n_trees, depth, rate, bins, l2, part, seed

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.n_bins)))[:-1] for j in range(x.shape[1])]
        b = self._binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        f = np.full(len(x), self.start)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature and bin of inner nodes, values of leaves
        rng = np.random.default_rng(self.seed)
        for _ in range(self.n_trees):
            some = np.sort(rng.permutation(x.shape[1])[: max(1, round(self.part * x.shape[1]))])
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(x), np.int64)
            n_inner = 2**self.depth - 1
            feat, cut = np.zeros(n_inner, np.int64), np.full(n_inner, self.n_bins, np.int64)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                best = np.full(n, 1e-9)
                for j in some:
                    key = (node - first) * (self.n_bins + 1) + b[:, j]
                    gs, hs = (np.bincount(key, w, n * (self.n_bins + 1)).reshape(n, -1).cumsum(1) for w in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    at = gain.argmax(1)
                    up = gain[np.arange(n), at] > best
                    best[up] = gain[np.arange(n), at][up]
                    feat[first : first + n][up], cut[first : first + n][up] = j, at[up]
                node = 2 * node + 1 + (b[np.arange(len(x)), feat[node]] > cut[node])
            leaf = node - n_inner
            values = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.l2)
            self.trees.append((feat, cut, values))
            f += values[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, f = self._binned(x), np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feat, cut, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feat[node]] > cut[node])
            f += values[node - len(feat)]
        return 1 / (1 + np.exp(-f))


def _matrix(urls: list[str | None], domains: np.ndarray, blocked: np.ndarray, base: float) -> np.ndarray:
    """Features of urls, with the owners and their blocked shares by key (n, kinds)."""
    shares = Statistics(domains.ravel(), blocked.ravel(), base).shares(np.arange(domains.size).reshape(domains.shape))
    return np.column_stack([np.array([lexical(u) for u in urls], float).reshape(len(urls), -1), shares, domains > 0.5])


class UrlModel:
    """Statistics and trees fitted on labelled (url, label); about `sample` urls reach the driver."""

    def __init__(self, labelled: DataFrame, sample: int = 20_000, seed: int = 9):
        with giving_back(labelled.sparkSession) as stay:
            labelled = labelled.filter("url is not null and label is not null").select("url", F.col("label").cast("int").alias("y"))
            self.hosting = kept(hosting(labelled), "url-hosting")
            self.few_hosting = self.hosting.count() <= BROADCAST_KEYS
            stay.append(self.hosting)
            rows = kept(with_keys(labelled, self.hosting, self.few_hosting), "url-labels")
            place = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in KINDS]))
            # an owner's share of blocked urls at each of its keys
            shares = kept(rows.select("owner", "y", place.alias("p")).groupBy("p.kind", "p.key", "owner").agg(F.avg("y").alias("share")), "url-shares")
            self.keys = kept(shares.groupBy("kind", "key").agg(F.count(F.lit(1)).cast("double").alias("domains"), F.sum("share").alias("blocked")), "url-keys")
            stay.append(self.keys)
            self.n_keys = {r["kind"]: r["count"] for r in self.keys.groupBy("kind").count().collect()}
            of_domains = rows.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("share"))
            n_domains, base = of_domains.agg(F.count(F.lit(1)), F.avg("share")).first()
            self.trees, self.share = None, base or 0.0
            if not n_domains:
                return
            per_domain = max(50.0, sample / n_domains)
            some = of_domains.filter(fraction("owner", F.lit(seed)) < sample / per_domain / n_domains).select("owner", "n")
            drawn = rows.join(some, "owner").filter(fraction("url", F.lit(seed)) < F.lit(per_domain) / F.col("n")).drop("n").distinct()
            fold = F.pmod(F.xxhash64("owner", F.lit(seed)), F.lit(FOLDS)).alias("fold")
            folds = shares.groupBy("kind", "key", fold).agg(F.count(F.lit(1)).cast("double").alias("domains"), F.sum("share").alias("blocked"))
            drawn = self.with_statistics(drawn.select("*", fold))
            for k in KINDS:
                own = folds.filter(F.col("kind") == k).select("fold", F.col("key").alias(k), F.col("domains").alias(f"own_domains_{k}"), F.col("blocked").alias(f"own_blocked_{k}"))
                drawn = drawn.join(own, ["fold", k])
            outside = [(F.col(f"{c}_{k}") - F.col(f"own_{c}_{k}")).alias(f"{c}_{k}") for c in ("domains", "blocked") for k in KINDS]
            found = drawn.select("url", "y", *outside).orderBy("url", "y").toPandas()
            y = found["y"].to_numpy(float)
            if len(found) and 0 < y.mean() < 1:
                domains, blocked = (np.round(found[[f"{c}_{k}" for k in KINDS]].to_numpy(float), 9) for c in ("domains", "blocked"))
                self.trees = BoostedTrees().fit(_matrix(found["url"].tolist(), domains, blocked, self.share), y)

    def with_statistics(self, rows: DataFrame) -> DataFrame:
        """rows that have keys with domains_k and blocked_k of each kind k; 0 for a key that was never seen."""
        for k in KINDS:
            stats = self.keys.filter(F.col("kind") == k).select(F.col("key").alias(k), F.col("domains").alias(f"domains_{k}"), F.col("blocked").alias(f"blocked_{k}"))
            rows = rows.join(F.broadcast(stats) if self.n_keys.get(k, 0) <= BROADCAST_KEYS else stats, k, "left")
        return rows.fillna(0.0, [f"{c}_{k}" for c in ("domains", "blocked") for k in KINDS])

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows (url, more; nothing called as KINDS or owner) with p_block."""
        names = rows.columns
        rows = self.with_statistics(with_keys(rows, self.hosting, self.few_hosting)).select(*names, *[f"{c}_{k}" for c in ("domains", "blocked") for k in KINDS])
        value = shared(rows.sparkSession, (self.trees, self.share))
        at, n, schema = names.index("url"), len(KINDS), T.StructType([*rows.schema.fields[: len(names)], T.StructField("p_block", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, share = value.value
            for b in batches:
                domains, blocked = (np.column_stack([b.column(len(names) + first + k).to_numpy(zero_copy_only=False) for k in range(n)]) for first in (0, n))
                p = np.full(b.num_rows, share) if trees is None else trees.predict(_matrix(b.column(at).to_pylist(), domains, blocked, share))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(p)], [*names, "p_block"])

        return rows.mapInArrow(run, schema)

    def predict(self, urls: list[str | None]) -> np.ndarray:
        """p_block of a few urls of the driver's."""
        rows = self.keys.sparkSession.createDataFrame(list(enumerate(urls)), "at long, url string")
        return np.array([r["p_block"] for r in self.scored(rows).orderBy("at").collect()], float)


MADE = ("host", "path", "rule", "verdict", "p_block")


def judged(urls: DataFrame, model: UrlModel, rules=RULES) -> DataFrame:
    """urls with any columns, url among them -> their columns, host, path, rule, verdict and the trees' p_block."""
    rows, back = beside(urls, "url", MADE)
    host, path = host_and_path(F.col("url"))
    out = model.scored(rows).withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return out.select(*back, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(urls, UrlModel(rule_labels(urls))).select("page_id", "host", "path", "rule", "verdict", "p_block")
