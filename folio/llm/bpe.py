"""Byte-level BPE encoding and decoding.

Texts are split as by the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

without a regex engine. Each code point has a class; a class is a transition
function on the states of a small automaton. Functions compose associatively, so
the state before every code point comes from a scan: blocks of code points are
composed side by side, the blocks' functions are scanned by doubling, and the
blocks are then run from their entry states. State, class and the next class
tell whether a slice begins. Slices are merged pair by pair in rank order, with
a bounded cache, and their byte offsets are kept.

Defined results: null is the empty text, which has no ids. Other columns pass
through untouched. Rows are independent, so repeats and ties need no rule. A very
long text is encoded as a whole; a slice of any length merges in n log n steps.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import _words as W
from ._store import bounded_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

# classes of code points; an apostrophe that contraction letters follow has one of its own
_L, _N, _O, _SP, _WS, _Q1, _Q2 = range(7)
# states: the first five as the class last seen; letters still due of a contraction; after one; before a text
_C2, _C1, _END, _START = 5, 6, 7, 8
_STATES, _CLASSES = 9, 7
_NONE = 1 << 60


def _step(state: int, cls: int) -> int:
    if state == _C2:
        return _C1
    if state == _C1:
        return _END
    if cls in (_Q1, _Q2):
        return _O if state in (_O, _SP) else (_C1 if cls == _Q1 else _C2)
    return cls


def _begins(state: int, cls: int, solid_next: bool) -> bool:
    if state in (_START, _END):
        return True
    if state in (_C2, _C1):
        return False
    if cls in (_SP, _WS):
        return solid_next if state in (_SP, _WS) else True
    own = _O if cls in (_Q1, _Q2) else cls
    return state not in (own, _SP)


#: Row cls: its transition function. Row cls + 7: the constant function for a text's first code point.
_NEXT = np.array([[_step(s, c) for s in range(_STATES)] for c in range(_CLASSES)] + [[_step(_START, c)] * _STATES for c in range(_CLASSES)], dtype=np.uint8)
_BEGIN = np.array([[[_begins(s, c, x) for x in (False, True)] for c in range(_CLASSES)] for s in range(_STATES)])


@lru_cache(1)
def _point_classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    out = np.full(0x110000, _O, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, cls in ((r"\p{L}", _L), (r"\p{N}", _N), (r"\s", _WS)):
        out[np.array([ord(x) for x in regex.findall(pattern, every)])] = cls
    out[0x20] = _SP
    return out


def _classes(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    cls = np.take(_point_classes(), points)
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        end = np.append(firsts, len(points))[np.searchsorted(firsts, quote, "right")]
        padded = np.concatenate((points, [0, 0]))
        one, two = padded[quote + 1], padded[quote + 2]
        cls[quote[(quote + 1 < end) & np.isin(one, [ord(x) for x in "stmd"])]] = _Q1
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        cls[quote[(quote + 2 < end) & pair]] = _Q2
    return cls


def _states(symbols: np.ndarray) -> np.ndarray:
    """The state before each symbol, by a scan over transition functions."""
    n = len(symbols)
    length = max(1, int(n**0.5) // 4)
    blocks = -(-n // length)
    padded = np.zeros(blocks * length, dtype=np.intp)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(blocks, length).T) * _STATES
    flat = _NEXT.ravel()
    composed = np.tile(np.arange(_STATES, dtype=np.uint8), (blocks, 1))
    for column in columns:
        composed = np.take(flat, column[:, None] + composed)
    step = 1
    while step < blocks:  # inclusive scan: after it, row b composes blocks 0 to b
        composed[step:] = np.take_along_axis(composed[step:], composed[:-step].astype(np.intp), axis=1)
        step *= 2
    now = np.concatenate(([_START], composed[:-1, _START])).astype(np.uint8)
    out = np.empty((length, blocks), dtype=np.uint8)
    for i, column in enumerate(columns):
        out[i] = now
        now = np.take(flat, column + now)
    return out.T.ravel()[:n]


def slices(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts' bytes, the byte offsets of all slices and the end, and each text's first slice and the end."""
    joined = "".join(texts)
    raw = joined.encode()
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.intp)
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    at = np.concatenate(([0], np.cumsum(lengths)))
    if not len(points):
        return raw, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    firsts = np.unique(at[:-1][lengths > 0])
    cls = _classes(points, firsts)
    symbols = cls.astype(np.intp)
    symbols[firsts] += _CLASSES
    state = _states(symbols)
    state[firsts] = _START
    solid = np.append((cls[1:] != _SP) & (cls[1:] != _WS), False)
    solid[firsts[1:] - 1] = False
    begin = np.flatnonzero(_BEGIN[state, cls, solid.astype(np.intp)])
    byte = np.concatenate(([0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))))
    return raw, byte[np.append(begin, len(points))], np.searchsorted(begin, at)


class Bpe:
    """Ranks of one vocabulary, with a cache of slices that takes about ``cached`` bytes."""

    def __init__(self, ranks_file: bytes, cached: int = 80_000_000):
        lines = map(bytes.split, ranks_file.splitlines())
        self.ranks = ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.pieces = {b: a for a, b in ranks.items()}
        self.cached = cached
        # every pair of tokens that may merge, as left id * size + right id, with the rank of the two together
        self.size = size = max(self.pieces) + 1
        pairs = (v for x, r in ranks.items() for i in range(1, len(x)) if x[:i] in ranks and x[i:] in ranks for v in (ranks[x[:i]] * size + ranks[x[i:]], r))
        both = np.fromiter(pairs, dtype=np.int64).reshape(-1, 2)
        both = both[np.argsort(both[:, 0])] if len(both) else np.array([[-1, _NONE]])
        self.pair_keys, self.pair_ranks = both[:, 0].copy(), both[:, 1].copy()
        self.decimal = np.array([b"%d" % i for i in range(size)], dtype=object)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self._forget()

    def _forget(self) -> None:
        """Empties the cache: a place for each slice, and at that place its ids and their decimal form."""
        self.places: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.int64)
        self.ends = np.zeros(1, dtype=np.int64)
        self.said: list[bytes] = []
        self.held = 0

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def merge(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all slices, and each one's number of ids.

        In every round each slice merges its adjacent pair of lowest rank, the leftmost among equals.
        """
        ranks = self.ranks
        short = np.array([len(x) <= 64 and x not in ranks for x in slices], dtype=bool)
        whole = [(i, self._merge_long(slices[i])) for i in np.flatnonzero(~short).tolist()]
        ended = [np.concatenate([x for _, x in whole])] if whole else []
        owners = [np.repeat([i for i, _ in whole], [len(x) for _, x in whole])] if whole else []
        todo = np.flatnonzero(short)
        chosen = [slices[i] for i in todo.tolist()]
        ids = np.take(self.byte_ids, np.frombuffer(b"".join(chosen), dtype=np.uint8))
        owner = np.repeat(todo, [len(x) for x in chosen])
        rank = np.append(self._rank(ids[:-1], ids[1:]), _NONE) if len(ids) else ids  # of each token with the next
        rank[np.flatnonzero(np.diff(owner))] = _NONE
        while len(ids):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            spread = np.repeat(least, np.diff(np.append(first, len(ids))))
            done = spread == _NONE
            if done.any():
                ended.append(ids[done])
                owners.append(owner[done])
                live = ~done
                ids, owner, rank, spread = ids[live], owner[live], rank[live], spread[live]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == spread)
            hit = hit[np.flatnonzero(np.diff(owner[hit], prepend=-1))]
            ids[hit] = rank[hit]
            keep = np.ones(len(ids), dtype=bool)
            keep[hit + 1] = False
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            hit -= np.arange(len(hit))
            for at in (hit, hit[hit > 0] - 1):
                near = np.minimum(at + 1, len(ids) - 1)
                rank[at] = np.where((owner[at] == owner[near]) & (near > at), self._rank(ids[at], ids[near]), _NONE)
        if not ended:
            return np.zeros(0, np.int64), np.zeros(len(slices), np.int64)
        owner = np.concatenate(owners)
        return np.concatenate(ended)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(slices))

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """As merge for one slice, with a heap over a linked list: no quadratic time."""
        ranks, n = self.ranks, len(piece)
        if piece in ranks:
            return np.array([ranks[piece]])
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        live = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or end[j] != stop:
                continue
            end[i], live[j], after[i] = end[j], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (r := ranks.get(piece[a : end[b]])) is not None:
                    heapq.heappush(heap, (r, a, end[b]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return np.array(out)

    def _cached(self, slices: list[bytes]) -> np.ndarray:
        """Cache places of distinct slices; those not yet there are merged together."""
        places = self.places
        new = [x for x in slices if x not in places]
        if new:
            ids, counts = self.merge(new)
            used = int(self.ends[-1])
            if used + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(ids)), dtype=np.int64)))
            self.ids[used : used + len(ids)] = ids
            decimal = self.decimal[ids].tolist()
            ends = np.cumsum(counts).tolist()
            said = [b",".join(decimal[a:b]) for a, b in zip([0, *ends], ends)]
            self.said += said
            self.held += sum(map(len, new)) + sum(map(len, said)) + 8 * len(ids) + 250 * len(new)
            places.update(zip(new, range(len(self.ends) - 1, len(self.ends) - 1 + len(new))))
            self.ends = np.append(self.ends, used + np.array(ends))
        return np.array([places[x] for x in slices], dtype=np.int64)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
        """For each text its ids, the ids in decimal joined by commas, and the byte offsets of its slices."""
        raw, offsets, first = slices(texts)
        if self.held >= self.cached:
            self._forget()
        starts, ends = offsets[:-1], offsets[1:]
        _, one, which = np.unique(W.spans_hash(raw, starts, ends), return_index=True, return_inverse=True)
        places = self._cached([raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())])[which]
        n = self.ends[places + 1] - self.ends[places]
        stop = np.cumsum(n)
        ids = self.ids[np.repeat(self.ends[places] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        said = list(map(self.said.__getitem__, places.tolist()))
        cut = np.concatenate(([0], stop))[first].tolist()
        bounds, byte = first.tolist(), offsets[first].tolist()
        decoded = self.decode(ids)
        if decoded != raw:  # two slices of one hash: merge each by itself
            for lo, hi in zip(bounds, bounds[1:]):
                own, _ = self.merge([raw[a:b] for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())])
                yield own, b",".join(self.decimal[own].tolist()), offsets[lo : hi + 1] - offsets[lo]
            return
        for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            yield ids[cut[i] : cut[i + 1]], b",".join(said[lo:hi]), offsets[lo : hi + 1] - byte[i]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


_loaded: dict[bytes, Bpe] = {}


def _bpe(ranks_file: bytes) -> Bpe:
    """One Bpe for each vocabulary and Python worker, so that its cache lasts over tasks."""
    key = hashlib.md5(ranks_file).digest()
    if key not in _loaded:
        _loaded[key] = Bpe(ranks_file)
    return _loaded[key]


def _some(column: pa.Array, size: int = 1 << 19) -> Iterator[list[str]]:
    part: list[str] = []
    total = 0
    for x in column:
        text = x.as_py() or ""
        if part and total + len(text) > size:
            yield part
            part, total = [], 0
        part.append(text)
        total += len(text)
    if part:
        yield part


class ByteBpe:
    """Encodes texts by a rank file, by default one of the public ones; the file is read by the driver."""

    def __init__(self, path: str | None = None):
        with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
            self.ranks_file = f.read()

    def _map(self, docs: DataFrame, columns: list[str], added: str, each) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(self.ranks_file)  # of fixed size: a vocabulary
        bounded_batches(docs.sparkSession)
        kinds = dict(docs.dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bpe = _bpe(shared.value)
            for batch in batches:
                rows = [each(bpe, *x) for part in _some(batch["text"]) for x in bpe.encode(part)]
                new = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([batch[c] for c in columns] + [pa.array(x, t) for x, t in zip(new, types)], columns + names)

        fields = [x.rsplit(" ", 1) for x in added.split(", ")]
        arrow = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
        names, types = [a for a, _ in fields], [arrow[b] for _, b in fields]
        source = docs.select(*dict.fromkeys([*columns, "text"]))
        return source.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in columns] + [added]))

    def encode(self, docs: DataFrame) -> DataFrame:
        """Adds ids and slice_offsets (first byte of each slice, and the end), replacing columns so named."""
        keep = [c for c in docs.columns if c not in ("ids", "slice_offsets")]
        return self._map(docs, keep, "ids array<int>, slice_offsets array<int>", lambda bpe, ids, said, cuts: (ids.tolist(), cuts.tolist()))

    def digests(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""

        def each(bpe: Bpe, ids: np.ndarray, said: bytes, cuts: np.ndarray):
            return len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

        return self._map(docs, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", each)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded; null is the empty text."""
    return ByteBpe().digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
