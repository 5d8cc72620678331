"""Stupid-backoff language-model scores, computed relationally.

Rows are dealt into blocks of about ``block_bytes`` of text by a hash of id and
text, so a row's block doesn't depend on how a scan deals out rows. Each block's
n-grams are exploded into distinct hashes with their counts and dealt out by hash
range; each range of the count table sums the counts of all blocks, so a very
frequent n-gram is one entry a block. The totals go back to the blocks that
asked, in the order of the block's sorted hashes, and each block joins them to
its n-grams and sums the scores of each document. Blocks and ranges are counted
from the bytes of the input, so a worker holds as much at any size.

The model of a document is the rest of the corpus: its own n-grams are taken
off the totals. For words v w:

    S(w | v) = c(v w) / c(v)   if c(v w) > 0,   else   alpha S(w)
    S(w) = max(c(w), unseen) / (N - own words)

and so on for longer contexts. A word whose context is shorter than the order
uses what there is.

Defined results: a null or empty text has no words and score 0. In a corpus of
one document N - own words counts as 1. Repeated rows are documents of their
own, so each is part of the other's rest. Ties need no rule. A very long text is
in one block as a whole. Only ``doc_id`` and ``text`` are read, so other columns
may have any names. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._store import Scratch

ORDER, ALPHA, UNSEEN = 2, 0.4, 0.5
#: Bytes of text in a block, and for each hash range.
BLOCK_BYTES, RANGE_BYTES = 6 << 20, 2 << 20


class _Block:
    """N-grams of some texts: hashes by order and position, and the distinct ones of all orders, sorted."""

    def __init__(self, texts: pa.Array, order: int):
        hashes, lengths = [], []
        for chunk in W.chunks(texts, W.SPACED, True):
            hashes.append(chunk.hashes)
            lengths.append(np.diff(chunk.at))
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.grams: list[np.ndarray] = []  # of order k + 1, by position of the last word in `at`
        self.at: list[np.ndarray] = []
        for k in range(order):
            g = W.windows(self.words, k + 1)
            last = np.arange(k, len(self.words))[: len(g)]
            own = self.doc[last] == self.doc[last - k] if len(last) else np.zeros(0, bool)
            self.grams.append(g[own])
            self.at.append(last[own])
        self.keys, self.counts = np.unique(np.concatenate(self.grams), return_counts=True)

    def own_counts(self, k: int) -> np.ndarray:
        """How often each n-gram of order k + 1 is found in its own document."""
        with np.errstate(over="ignore"):
            key = W.mix(self.grams[k] ^ (self.doc[self.at[k]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
        return counts[which]

    def scores(self, totals: np.ndarray, corpus_words: int, alpha: float, unseen: float) -> np.ndarray:
        """Sum of log scores of each text, given the corpus counts of all keys."""
        rest = np.maximum(corpus_words - self.lengths, 1)[self.doc] if len(self.doc) else np.zeros(0)
        counts = []
        for k, g in enumerate(self.grams):
            c = np.zeros(len(self.words))
            c[self.at[k]] = totals[np.searchsorted(self.keys, g)] - self.own_counts(k)
            counts.append(c)
        log = np.log(np.maximum(counts[0], unseen) / rest) if len(self.words) else np.zeros(0)
        for k in range(1, len(counts)):
            context = np.concatenate(([0.0], counts[k - 1][:-1])) if len(self.words) else np.zeros(0)
            there = np.zeros(len(self.words), dtype=bool)
            there[self.at[k]] = True
            seen = there & (counts[k] > 0)
            log = np.where(seen, np.log(np.where(seen, counts[k], 1) / np.where(seen, np.maximum(context, 1), 1)), np.where(there, np.log(alpha) + log, log))
        return np.bincount(self.doc, weights=log, minlength=len(self.lengths)) if len(self.lengths) else np.zeros(0)


class LmScore:
    def __init__(self, order: int = ORDER, alpha: float = ALPHA, unseen: float = UNSEEN, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES):
        self.order, self.alpha, self.unseen = order, alpha, unseen
        self.block_bytes, self.range_bytes = block_bytes, range_bytes

    def scores(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_words, log_score (natural log), mean_log_score of each row."""
        scratch, order, alpha, unseen = Scratch(docs.sparkSession, "lm"), self.order, self.alpha, self.unseen
        kind = dict(docs.dtypes)["doc_id"]
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        blocks, ranges = (max(1, -(-size // x)) for x in (self.block_bytes, self.range_bytes))
        rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", "text")
        edges = (np.arange(1, ranges, dtype=object) * 2**64 // ranges).astype(np.uint64)

        def cut(keys: np.ndarray) -> np.ndarray:
            return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))

        def ask(texts: pa.Table) -> pa.Table:
            """Distinct n-grams of a block with their counts, a row for each range."""
            block = _Block(texts["text"], order)
            at = cut(block.keys)
            full = np.flatnonzero(np.diff(at))
            if not len(full):
                full = np.zeros(1, np.int64)
            n = np.zeros(len(full), dtype=np.int64)
            n[0] = len(block.words)
            keys = W.lists([W.signed(block.keys[at[i] : at[i + 1]]) for i in full], pa.int64())
            counts = W.lists([block.counts[at[i] : at[i + 1]].astype(np.int32) for i in full], pa.int32())
            return pa.table({"block": pa.array(np.full(len(full), texts["block"][0].as_py()), pa.int64()), "range": pa.array(full, pa.int64()), "words": pa.array(n), "keys": keys, "counts": counts})

        def total(table: pa.Table) -> pa.Table:
            """The counts of one range over all blocks, for each of the n-grams asked for."""
            lists = table["keys"].combine_chunks()
            _, which = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            counts = table["counts"].combine_chunks().flatten().to_numpy()
            sums = np.bincount(which, weights=counts).astype(np.int64)[which] if len(which) else np.zeros(0, np.int64)
            totals = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))), pa.int32()), pa.array(sums, pa.int64()))
            return pa.table({"block": table["block"], "range": table["range"], "words": table["words"], "totals": totals})

        asked = rows.select("block", "text").groupBy("block").applyInArrow(ask, "block long, range long, words long, keys array<long>, counts array<int>")
        answers = scratch.keep(asked.groupBy("range").applyInArrow(total, "block long, range long, words long, totals array<long>"), "answers")
        corpus_words = answers.agg(F.sum("words")).first()[0] or 0

        def score(texts: pa.Table, found: pa.Table) -> pa.Table:
            block = _Block(texts["text"], order)
            totals = found.sort_by("range")["totals"].combine_chunks().flatten().to_numpy()  # as the block's keys
            log, n = block.scores(totals, corpus_words, alpha, unseen), block.lengths
            return pa.table({"doc_id": texts["doc_id"], "n_words": pa.array(n, pa.int64()), "log_score": pa.array(log, pa.float64()), "mean_log_score": pa.array(log / np.maximum(n, 1), pa.float64())})

        return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {kind}, n_words long, log_score double, mean_log_score double")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; nulls and empty texts have 0."""
    scores = LmScore().scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scores.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT sum(len(w)) AS n FROM d),
p AS (SELECT doc_id, greatest((SELECT n FROM n) - len(w), 1) AS rest, unnest(w) AS x, unnest(range(len(w))) AS i FROM d WHERE len(w) > 0),
b AS (SELECT doc_id, rest, i, x, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM p),
c1 AS (SELECT x, count(*) AS c FROM b GROUP BY x),
o1 AS (SELECT doc_id, x, count(*) AS c FROM b GROUP BY doc_id, x),
c2 AS (SELECT v, x, count(*) AS c FROM b WHERE i > 0 GROUP BY v, x),
o2 AS (SELECT doc_id, v, x, count(*) AS c FROM b WHERE i > 0 GROUP BY doc_id, v, x),
f AS (SELECT b.doc_id, b.i, b.rest, c1.c - o1.c AS cx, cv.c - ov.c AS cv, c2.c - o2.c AS cvx
  FROM b JOIN c1 ON c1.x = b.x JOIN o1 ON o1.doc_id = b.doc_id AND o1.x = b.x
  LEFT JOIN c1 cv ON cv.x = b.v LEFT JOIN o1 ov ON ov.doc_id = b.doc_id AND ov.x = b.v
  LEFT JOIN c2 ON c2.v = b.v AND c2.x = b.x LEFT JOIN o2 ON o2.doc_id = b.doc_id AND o2.v = b.v AND o2.x = b.x),
s AS (SELECT doc_id, sum(CASE WHEN i > 0 AND cvx > 0 THEN ln(cvx / greatest(cv, 1)) ELSE CASE WHEN i > 0 THEN ln(0.4) ELSE 0 END + ln(greatest(cx, 0.5) / rest) END) AS s FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(coalesce(s.s, 0.0), 6) AS log_score, round(coalesce(s.s, 0.0) / greatest(len(d.w), 1), 6) AS mean_log_score
FROM d LEFT JOIN s USING (doc_id)
"""
