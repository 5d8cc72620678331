"""URL filter: rules first, then gradient-boosted trees on lexical features.

A rule is a host and the beginning of a path; it fits its host and all
subdomains, and the longest rule that fits decides. Other urls are judged by
trees over length, depth, digit ratio, entropy, parameter counts and suffix
statistics, trained from labelled urls.

Labelled urls are those that a rule decides, unless others are given. Statistics
of suffixes and first segments are counted over all of them and joined to the
urls. Training of the trees takes ``sample`` of them at most, those with the
smallest hashes, so the same urls at any partitioning. A url that trains trees
gets its statistics from the other folds of the labelled urls, never from its
own label, and one fold in ``FOLDS`` gets those of an unknown suffix, another
those of an unknown segment, so that trees also learn to judge without them.
Each tree chooses among a part of the features, in turn. Every url is scored. A
model of ``fit`` stands alone: its statistics are those of its sample.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and is scored like others. Rows may repeat. A url of any length is
scored as a whole, in small batches. Columns other than ``page_id`` and ``url``
aren't read, so they may have any names. Without labelled urls of both kinds
every url gets the verdict of the one there is, or allow.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Scratch, bounded_batches

# Rules as given, (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, _UPPER, _LOWER), path


def by_rules(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; the first among equals."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "entropy", "host_entropy", "parameters", "parameter_length", "fragment", "suffix_rate", "suffix_count", "segment_rate")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(_UPPER, _LOWER)
_DIGITS = np.arange(48, 58)


def _bytes(texts: list[str]) -> np.ndarray:
    """How often each byte stands in each text."""
    raw = [x.encode() for x in texts]
    row = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
    return np.bincount(row * 256 + np.frombuffer(b"".join(raw), dtype=np.uint8), minlength=256 * len(raw)).reshape(-1, 256)


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits a byte of each row."""
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)


def suffix(host: str) -> str:
    """The last two labels of a host."""
    return ".".join(host.rsplit(".", 2)[-2:])


def _split(url: str | None) -> tuple[str, str, str, str]:
    url = url or ""
    rest = url.partition("://")[2]
    rest, _, fragment = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    return host.translate(_TO_LOWER), slash + path, query, fragment


def segment(path: str) -> str:
    """The first segment of a path."""
    return path[1:].partition("/")[0]


def suffix_and_segment(url: Column) -> tuple[Column, Column]:
    """``suffix`` and ``segment`` of a url as expressions."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.substring_index(F.substring_index(F.coalesce(rest, F.lit("")), "#", 1), "?", 1)
    host = F.translate(F.substring_index(rest, "/", 1), _UPPER, _LOWER)
    return F.substring_index(host, ".", -2), F.substring_index(F.substr(rest, F.length(host) + 2), "/", 1)


PRIOR, SMOOTH, FOLDS = 0.5, 5.0, 5
#: Rate and count of the suffix and rate of the segment of a row.
STATISTICS = ("_suffix_rate", "_suffix_count", "_segment_rate")


@dataclass
class UrlModel:
    """Boosted trees of one depth: split feature and threshold by node, value by leaf, for each tree."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    bias: float = 0.0
    suffixes: dict[str, tuple[float, float]] = field(default_factory=dict)
    segments: dict[str, tuple[float, float]] = field(default_factory=dict)
    prior: float = PRIOR

    def features(self, urls: list[str | None], statistics: list[tuple[float, float, float]] | None = None) -> np.ndarray:
        """Features of urls, with the model's own statistics or those given for each url."""
        parts = [_split(u) for u in urls]
        if statistics is None:
            unknown = (self.prior, 0.0)
            statistics = [(*self.suffixes.get(suffix(h), unknown), self.segments.get(segment(p), unknown)[0]) for h, p, *_ in parts]
        host, path, query, fragment = ([x[i] for x in parts] for i in range(4))
        all_bytes, host_bytes, path_bytes, query_bytes = (_bytes(x) for x in ([u or "" for u in urls], host, path, query))
        length = all_bytes.sum(axis=1)
        columns = [length, host_bytes.sum(axis=1), path_bytes.sum(axis=1), path_bytes[:, 47], host_bytes[:, 46] + 1, all_bytes[:, _DIGITS].sum(axis=1) / np.maximum(length, 1), host_bytes[:, _DIGITS].sum(axis=1), host_bytes[:, 45], _entropy(all_bytes), _entropy(host_bytes), query_bytes[:, 61] + query_bytes[:, 38], query_bytes.sum(axis=1), np.array([len(x) for x in fragment])]
        given = np.array(statistics, dtype=float).reshape(-1, 3)
        return np.column_stack([*columns, *given.T]).astype(float).reshape(-1, len(FEATURES))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of block."""
        out = np.full(len(x), self.bias)
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), dtype=np.intp)
            while (inner := node < len(feature)).any() and len(feature):
                node = np.where(inner, 2 * node + 1 + (x[np.arange(len(x)), feature[np.minimum(node, len(feature) - 1)]] > threshold[np.minimum(node, len(feature) - 1)]), node)
            out += value[node - len(feature)]
        return 1 / (1 + np.exp(-out))


def fold(url: str) -> int:
    return zlib.crc32(url.encode()) % FOLDS


def rates(keys: list[str], labels: np.ndarray, weight: np.ndarray) -> dict[str, tuple[float, float]]:
    """Smoothed share of blocked urls and logarithm of the number by key."""
    sums: dict[str, list[float]] = {}
    for key, label, w in zip(keys, labels, weight):
        s = sums.setdefault(key, [0.0, 0.0])
        s[0] += label * w
        s[1] += w
    return {k: ((a + SMOOTH * PRIOR) / (n + SMOOTH), float(np.log1p(n))) for k, (a, n) in sums.items()}


def _weights(y: np.ndarray) -> np.ndarray:
    """Both kinds weigh the same."""
    return np.where(y > 0, PRIOR / y.mean(), PRIOR / (1 - y.mean()))


def masked(folds: np.ndarray, statistics: np.ndarray) -> np.ndarray:
    """Statistics for training: one fold without suffix, the next without segment."""
    out = statistics.copy()
    out[folds == 0, :2] = PRIOR, 0.0
    out[folds == 1, 2] = PRIOR
    return out


def train(urls: list[str], blocked: list[bool], trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, part: int = 3, statistics: list[tuple[float, float, float]] | None = None) -> UrlModel:
    """Newton boosting of logistic loss over binned features; ties go to the first feature and the lowest threshold.

    Tree i chooses among the features whose place is i modulo ``part`` apart from
    its own, so none is always there. Given statistics must not hold a url's own label.
    """
    y = np.array(blocked, dtype=float)
    if not len(y) or y.min() == y.max():
        return UrlModel(bias=20.0 if len(y) and y[0] else -20.0)
    weight = _weights(y)
    parts, folds = [_split(u) for u in urls], np.array([fold(u) for u in urls])
    keys = [suffix(h) for h, *_ in parts], [segment(p) for _, p, *_ in parts]
    model = UrlModel(prior=PRIOR, suffixes=rates(keys[0], y, weight), segments=rates(keys[1], y, weight))
    if statistics is None:
        given = np.zeros((len(y), 3))
        for f in range(FOLDS):
            others, own = folds != f, np.flatnonzero(folds == f)
            known = [rates([k for k, o in zip(key, others) if o], y[others], weight[others]) for key in keys]
            for i in own.tolist():
                given[i] = *known[0].get(keys[0][i], (PRIOR, 0.0)), known[1].get(keys[1][i], (PRIOR, 0.0))[0]
    else:
        given = np.array(statistics, dtype=float)
    x = model.features(urls, masked(folds, given))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]
    margin = np.full(len(y), model.bias)
    inner = 2**depth - 1
    for turn in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(len(y), dtype=np.intp)
        feature, threshold = np.zeros(inner, dtype=np.intp), np.full(inner, np.inf)
        for k in range(inner):
            here = np.flatnonzero(node == k)
            best, cut = 1e-9, None
            for j, e in enumerate(edges):
                if not len(here) or not len(e) or part > 1 and j % part == turn % part:
                    continue
                gs, hs = (np.bincount(binned[j][here], weights=v[here], minlength=len(e) + 1) for v in (g, h))
                gl, hl = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
                gt, ht = gs.sum(), hs.sum()
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                if gain.max() > best + 1e-9:
                    best, cut = gain.max(), (j, int(gain.argmax()))
            if cut:
                feature[k], threshold[k] = cut[0], edges[cut[0]][cut[1]]
            node[here] = 2 * k + 1 + (x[here, feature[k]] > threshold[k])
        leaf = node - inner
        value = -rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + 1)
        margin += value[leaf]
        model.trees.append((feature, threshold, value))
    return model


class UrlFilter:
    def __init__(self, rules: tuple[Rule, ...] = RULES, sample: int = 20_000, threshold: float = 0.5):
        self.rules, self.sample, self.threshold = rules, sample, threshold

    def _ruled(self, pages: DataFrame) -> DataFrame:
        host, path = host_and_path(F.col("url"))
        return pages.withColumn("host", host).withColumn("path", path).withColumn("_rule", by_rules(F.col("host"), F.col("path"), self.rules))

    def _labelled(self, labelled: DataFrame) -> DataFrame:
        return labelled.where("url IS NOT NULL AND blocked IS NOT NULL").groupBy("url").agg(F.max("blocked").alias("blocked"))

    def fit(self, labelled: DataFrame) -> UrlModel:
        """A model from (url, blocked) rows."""
        rows = self._labelled(labelled).orderBy(F.xxhash64("url"), "url").limit(self.sample).collect()
        return train([r.url for r in rows], [r.blocked for r in rows])

    def fit_with_statistics(self, labelled: DataFrame) -> tuple[UrlModel, Callable[[DataFrame], DataFrame]]:
        """A model from (url, blocked) rows, and what adds to rows with a url the statistics over all labelled urls."""
        scratch = Scratch(labelled.sparkSession, "urls")
        last, first = suffix_and_segment(F.col("url"))
        some = scratch.keep(self._labelled(labelled).select("url", "blocked", last.alias("_suffix"), first.alias("_segment"), F.pmod(F.crc32("url"), F.lit(FOLDS)).cast("int").alias("_fold")), "labelled")
        totals = some.agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked")).first()
        bad, good = (PRIOR * totals.n / max(1, x) for x in (totals.blocked, totals.n - totals.blocked))  # both kinds weigh the same

        blocked, count = F.count_if("blocked") * bad, F.count_if("blocked") * bad + F.count_if(~F.col("blocked")) * good

        def table(key: str) -> DataFrame:
            by_fold = some.groupBy(key, "_fold").agg(blocked.alias("b"), count.alias("n"))
            return scratch.keep(by_fold.groupBy(key).agg(F.sum("b").alias(f"{key}_b"), F.sum("n").alias(f"{key}_n"), F.map_from_entries(F.collect_list(F.struct("_fold", F.struct("b", "n")))).alias(f"{key}_own")), key.strip("_"))  # FOLDS entries

        by_suffix, by_segment = table("_suffix"), table("_segment")

        def add(rows: DataFrame, own_fold: Column | None = None) -> DataFrame:
            """Adds STATISTICS, without what the given fold counts."""
            joined = rows.withColumns({"_suffix": last, "_segment": first}).join(by_suffix, "_suffix", "left").join(by_segment, "_segment", "left")

            def less(key: str, name: str) -> Column:
                all_of = F.coalesce(F.col(f"{key}_{name}"), F.lit(0.0))
                return all_of if own_fold is None else all_of - F.coalesce(F.get(F.transform(F.array(F.element_at(f"{key}_own", own_fold)), lambda x: x[name]), F.lit(0)), F.lit(0.0))

            rate = lambda key: (less(key, "b") + SMOOTH * PRIOR) / (less(key, "n") + SMOOTH)
            return joined.select(*rows.columns, rate("_suffix").alias("_suffix_rate"), F.log1p(less("_suffix", "n")).alias("_suffix_count"), rate("_segment").alias("_segment_rate"))

        hashed = some.select("url", "blocked", "_fold", F.xxhash64("url").alias("_hash")).orderBy("_hash", "url").limit(self.sample)
        rows = sorted(add(hashed, F.col("_fold")).collect(), key=lambda r: (r._hash, r.url))  # sample rows at most
        return train([r.url for r in rows], [r.blocked for r in rows], statistics=[tuple(r[c] for c in STATISTICS) for r in rows]), add

    def judge(self, pages: DataFrame, model: UrlModel | None = None, labelled: DataFrame | None = None) -> DataFrame:
        """page_id, url, host, path, rule, verdict, score (probability of block) of each row."""
        ruled = self._ruled(pages.select("page_id", "url"))
        bounded_batches(pages.sparkSession)
        if model is None:
            by_rule = ruled.where("_rule IS NOT NULL").select("url", (F.col("_rule.verdict") == "block").alias("blocked"))
            model, add = self.fit_with_statistics(by_rule if labelled is None else labelled)
            ruled = add(ruled) if model.trees else ruled

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                statistics = list(zip(*(batch[c].to_pylist() for c in given))) if given else None
                score = model.score(model.features(batch["url"].to_pylist(), statistics))
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(score, pa.float64())], [*kept, "score"])

        flat = ruled.select("page_id", "url", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("ruled"), *(c for c in STATISTICS if c in ruled.columns))
        given = [c for c in STATISTICS if c in flat.columns]
        kept = [c for c in flat.columns if c not in given]
        kinds = dict(flat.dtypes)
        scored = flat.mapInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in kept] + ["score double"]))
        return scored.select("page_id", "url", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > self.threshold, "block").otherwise("allow")).alias("verdict"), "score")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with their verdicts; a url without host is judged by the model."""
    return UrlFilter().judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")
