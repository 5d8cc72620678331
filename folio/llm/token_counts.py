"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates the pieces that end at
each character, longest first; dynamic programming carries only the best score
and its number of tokens. Ties go as in the tokenizer's own search, which fills
scores by increasing start and replaces a score only by a greater one: of equal
scores the longest last piece stays. A character that no piece matches costs the
lowest score less ten and counts as its bytes (byte fallback).

With ``whole`` all of a text is counted, as sentencepiece does without removing
white space: blanks are word-start signs, one more comes first, and line breaks
and tabs are characters like others. The text is cut only where no piece can lie
across, before blanks and at control characters that no piece has; a bounded
cache keeps the counts of the parts.

Without it white space only separates words; each is counted with the word-start
sign before it. Distinct words of a batch are counted once and cached too.

Defined results: a null or empty text has no tokens and score 0. Rows are
independent, so repeats need no rule. A very long text is counted part by part. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import collections
import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import _words as W
from ._store import bounded_batches

VOCABULARY = "piece_bpe_32k.model"
WORD_START = "▁"
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """Pieces with their scores from a sentencepiece model, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain]


class Counter:
    """Counts the tokens of words, with a cache of at most ``cached`` of them, of 64 characters at most each."""

    def __init__(self, pieces: list[tuple[str, float]], cached: int = 400_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.cache: dict[bytes | str, tuple[int, float]] = {}
        self.cached = cached
        signs, used = re.compile(f"[^{WORD_START}]{WORD_START}"), set().union(*(p for p, _ in pieces))
        alone = "".join(c for c in "\t\n\x0b\x0c\r" if c not in used)
        crossing = any(signs.search(p) for p, _ in pieces)
        self.parts = re.compile(r"(?s).+" if crossing else f"{WORD_START}*[^{WORD_START}{alone}]+|{WORD_START}+" + (f"|[{alone}]" if alone else ""))

    def count(self, word: str) -> tuple[int, float]:
        """Number of tokens of one word, and their score."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            ends[end].append(match)
        best, counts = [0.0] * (n + 1), [0] * (n + 1)
        for i, found in enumerate(ends):
            top, tokens = None, 0
            single = False
            for length, score in found:  # longest first, so by increasing start
                if length == 1:
                    single = True
                total = best[i + 1 - length] + score
                if top is None or total > top:
                    top, tokens = total, counts[i + 1 - length] + 1
            if not single:  # the character alone is unknown
                total = best[i] + self.unknown
                if top is None or total > top:
                    top, tokens = total, counts[i] + len(word[i].encode())
            best[i + 1], counts[i + 1] = top, tokens
        return counts[n], best[n]

    def of(self, word: bytes | str) -> tuple[int, float]:
        """Of a word as bytes, without its word-start sign, or of a part of a text."""
        got = self.cache.get(word)
        if got is None:
            got = self.count(word if isinstance(word, str) else WORD_START + word.decode())
            if len(word) <= 64:
                if len(self.cache) >= self.cached:
                    self.cache.clear()
                self.cache[word] = got
        return got

    def whole(self, text: bytes) -> tuple[int, float]:
        """Number of tokens and score of all of a text."""
        tokens, score = 0, 0.0
        if text:
            for part, times in collections.Counter(self.parts.findall(WORD_START + text.decode().replace(" ", WORD_START))).items():
                n, s = self.of(part)
                tokens, score = tokens + n * times, score + s * times
        return tokens, score

    def texts(self, chunk: W.Chunk) -> Iterator[tuple[int, float]]:
        """Number of tokens and score of each text."""
        raw = chunk.raw
        if not len(chunk.hashes):
            yield from ((0, 0.0) for _ in range(len(chunk)))
            return
        length = chunk.ends - chunk.starts
        keys = chunk.hashes ^ (length.astype(np.uint64) << np.uint64(57))
        _, one, which = np.unique(keys, return_index=True, return_inverse=True)
        found = [self.of(raw[a:b]) for a, b in zip(chunk.starts[one].tolist(), chunk.ends[one].tolist())]
        counts = np.concatenate(([0], np.cumsum(np.array([n for n, _ in found], dtype=np.int64)[which])))
        scores = np.array([s for _, s in found])[which]
        for a, b in zip(chunk.at[:-1].tolist(), chunk.at[1:].tolist()):
            yield int(counts[b] - counts[a]), float(scores[a:b].sum())


_loaded: dict[bytes, Counter] = {}


def _counter(data: bytes) -> Counter:
    key = hashlib.md5(data).digest()
    if key not in _loaded:
        _loaded[key] = Counter(pickle.loads(data))
    return _loaded[key]


class TokenCounts:
    def __init__(self, pieces: list[tuple[str, float]] | None = None, whole: bool = False):
        self.pieces, self.whole = vocabulary() if pieces is None else pieces, whole

    def counts(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_words, n_tokens, score of each row."""
        shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(self.pieces))  # of fixed size: a vocabulary
        whole = self.whole
        bounded_batches(docs.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counter = _counter(shared.value)
            for batch in batches:
                words, tokens, scores = [], [], []
                for text in W.texts(batch["text"]) if whole else ():
                    words.append(len(text.split()))
                    n, s = counter.whole(text)
                    tokens.append(n)
                    scores.append(s)
                for chunk in W.chunks(batch["text"], W.SPACED, False) if not whole else ():
                    words += np.diff(chunk.at).tolist()
                    for n, s in counter.texts(chunk):
                        tokens.append(n)
                        scores.append(s)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "n_words", "n_tokens", "score"])

        return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_tokens long, score double")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their token counts; null has none."""
    return TokenCounts(whole=True).counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
