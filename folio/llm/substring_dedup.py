"""Substring deduplication by Rabin-Karp hashes of every fixed-length word window.

Every window of ``window`` consecutive words gets a rolling hash; the hashes are
counted in Spark, and windows that also start in a document with a smaller
``doc_id`` merge into maximal removal intervals.

Counting has two levels, so that only windows that can repeat are shuffled. A
window's anchor is the smallest hash among its half-length word windows; it
depends on the window's words alone, so a window whose anchor occurs in one
document only has itself a count of one. Anchors (about two per window length)
are counted first, then all windows whose anchor occurs in several documents.

Defined results: a null or empty text has no words. A null ``doc_id`` is neither
smaller nor larger than any other: such rows are returned unchanged and are no
source. Rows that repeat a ``doc_id`` are judged each by its own text and don't
remove one another's words. A very long text is hashed as a whole. Other columns
pass through untouched, whatever their names. Windows are told apart by two
polynomials modulo 2**31 - 1 over 64-bit hashes of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._expr import unused
from ._store import Scratch

WINDOW = 50


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def _anchored(chunk: W.Chunk, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchor of every window of a chunk; first and end window of each text."""
    half = max(1, window // 2)
    n = np.maximum(np.diff(chunk.at) - window + 1, 0)
    grams = W.windows(chunk.hashes, half)
    width = window - half + 1
    return (sliding_min(grams, width) if len(grams) >= width else grams[:0]), chunk.at[:-1], chunk.at[:-1] + n


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for chunk in W.chunks(batch["text"], W.SPACED, False):
                anchor, lo, hi = _anchored(chunk, window)
                found = []
                for a, b in zip(lo.tolist(), hi.tolist()):
                    x = np.sort(anchor[a:b])
                    found.append(W.signed(x[np.flatnonzero(np.diff(x, prepend=~x[:1]))]) if b > a else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(row, len(chunk)), batch["text_key"].slice(row, len(chunk)), W.lists(found, pa.int64())], ["doc_id", "text_key", "anchors"])
                row += len(chunk)

    return run


def _candidates(window: int):
    """Positions and hashes of the windows whose anchor is among those given for the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, wanted = 0, batch["anchors"]
            for chunk in W.chunks(batch["text"], W.SPACED, False):
                anchor, lo, hi = _anchored(chunk, window)
                hashes = W.rabin_karp(chunk.hashes, window)
                at, found = [], []
                for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist())):
                    here = wanted[row + i].values.to_numpy(zero_copy_only=False)
                    pos = np.flatnonzero(np.isin(W.signed(anchor[a:b]), here)) if b > a else np.zeros(0, np.int64)
                    at.append(pos.astype(np.int32))
                    found.append(W.signed(hashes[a:b][pos]))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(row, len(chunk)), batch["text_key"].slice(row, len(chunk)), W.lists(at, pa.int32()), W.lists(found, pa.int64())], ["doc_id", "text_key", "pos", "hash"])
                row += len(chunk)

    return run


def spans(positions: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal word intervals [first, end) that windows at these positions cover."""
    if not len(positions):
        return positions, positions
    p = np.sort(positions)
    new = np.flatnonzero(np.diff(p) > window) + 1
    return p[np.concatenate(([0], new))], p[np.concatenate((new - 1, [len(p) - 1]))] + window


class SubstringDedup:
    """Removes words of windows that also start in a document with a smaller id."""

    def __init__(self, window: int = WINDOW):
        self.window = window

    def removals(self, docs: DataFrame, scratch: Scratch) -> DataFrame:
        """(doc_id, text_key, starts): word positions of the windows to remove."""
        rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
        kind = dict(docs.dtypes)["doc_id"]
        anchors = scratch.keep(rows.mapInArrow(_anchors(self.window), f"doc_id {kind}, text_key long, anchors array<long>"), "anchors")
        each = anchors.select("doc_id", "text_key", F.explode("anchors").alias("anchor"))
        several = each.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
        wanted = scratch.keep(each.join(several, "anchor").groupBy("doc_id", "text_key").agg(F.collect_set("anchor").alias("anchors")), "wanted")
        scratch.drop("anchors")
        found = scratch.keep(rows.join(wanted, ["doc_id", "text_key"]).mapInArrow(_candidates(self.window), f"doc_id {kind}, text_key long, pos array<int>, hash array<long>"), "windows")
        scratch.drop("wanted")
        window = F.explode(F.arrays_zip("pos", "hash")).alias("w")
        every = found.select("doc_id", "text_key", window).select("doc_id", "text_key", "w.pos", "w.hash")
        # a table of its own, so that a window that very many documents have can be split in the join
        least = scratch.keep(every.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("hash", "lo"), "least")
        out = scratch.keep(every.join(least, "hash").where("lo < doc_id").groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("starts")), "removals")
        scratch.drop("windows", "least")
        return out

    def _with(self, docs: DataFrame, removals: DataFrame) -> tuple[DataFrame, str]:
        """The rows with the word positions to remove, and the name of their column."""
        name, hit = unused(docs.columns, "starts", "hit")
        right = removals.select(F.struct(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).alias(hit), F.col("starts").alias(name))
        own = F.struct(docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("key"))
        return docs.join(right, own == right[hit], "left").drop(hit), name

    def digests(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256 of each row."""
        scratch, window = Scratch(docs.sparkSession, "substring"), self.window
        kind = dict(docs.dtypes)["doc_id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, n, gone, sha = 0, [], [], []
                for chunk in W.chunks(batch["text"], W.SPACED, False):
                    for i in range(len(chunk)):
                        a, b = int(chunk.at[i]), int(chunk.at[i + 1])
                        keep = np.ones(b - a, dtype=bool)
                        starts = batch[column][row + i]
                        if starts.is_valid:
                            for lo, hi in zip(*spans(starts.values.to_numpy(zero_copy_only=False), window)):
                                keep[lo:hi] = False
                        raw = chunk.raw
                        words = [raw[s:e] for s, e in zip(chunk.starts[a:b][keep].tolist(), chunk.ends[a:b][keep].tolist())]
                        n.append(b - a)
                        gone.append(b - a - len(words))
                        sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    row += len(chunk)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

        joined, column = self._with(docs.select("doc_id", "text"), self.removals(docs, scratch))
        return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")

    def apply(self, docs: DataFrame) -> DataFrame:
        """The documents without the words to remove.

        A removed interval goes with the white space after it; a text without
        removals stays as it is. ``n_chars``, if there, is counted anew.
        """
        scratch, window = Scratch(docs.sparkSession, "substring"), self.window
        names = docs.columns
        joined, column = self._with(docs, self.removals(docs, scratch))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out, row = [], 0
                for chunk in W.chunks(batch["text"], W.SPACED, False):
                    for i in range(len(chunk)):
                        starts, first, end = batch[column][row + i], int(chunk.first[i]), int(chunk.first[i + 1]) - 1
                        if not starts.is_valid:
                            out.append(batch["text"][row + i].as_py())
                            continue
                        at = chunk.starts[chunk.at[i] : chunk.at[i + 1]]
                        parts, done = [], first
                        for lo, hi in zip(*spans(starts.values.to_numpy(zero_copy_only=False), window)):
                            parts.append(chunk.raw[done : at[lo]])
                            done = int(at[hi]) if hi < len(at) else end
                        parts.append(chunk.raw[done:end])
                        out.append(b"".join(parts).decode())
                    row += len(chunk)
                cols = [pa.array(out, pa.string()) if name == "text" else batch[name] for name in names]
                yield pa.RecordBatch.from_arrays(cols, names)

        changed = joined.mapInArrow(run, docs.schema)
        if "n_chars" in names:
            changed = changed.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(dict(docs.dtypes)["n_chars"]))
        return changed


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of windows that a smaller id has too."""
    return SubstringDedup().digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, sha256(array_to_string(w[p:p + 49], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS lo FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, q FROM (SELECT g.doc_id, unnest(range(g.p, g.p + 50)) AS q FROM g JOIN f USING (h) WHERE f.lo < g.doc_id)),
x AS (SELECT doc_id, count(*) AS n, list(q) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN x.n IS NULL THEN w ELSE k.kept END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
LEFT JOIN (SELECT doc_id, list(v ORDER BY q) FILTER (WHERE NOT out) AS kept
  FROM (SELECT u.doc_id, u.q, u.v, r.q IS NOT NULL AS out
        FROM (SELECT d.doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS q FROM d JOIN x USING (doc_id)) u
        LEFT JOIN r ON r.doc_id = u.doc_id AND r.q = u.q) GROUP BY doc_id) k USING (doc_id)
"""
