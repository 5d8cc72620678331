"""N-gram Jaccard join: components of texts whose word shingle sets are similar.

A document's set is that of its distinct k-word shingles. Two documents link
when intersection / union >= percent / 100. The join is size-aware:

* Small sets enumerate their subsets of each size that a partner could share.
  Two sets with a common subset of i elements link for certain when
  ``100 i >= percent (a + b - i)``; if any two holders of a subset do, each of
  them does with its smallest holder too, so a star of links to that holder
  keeps all connections and needs no check.
* Large sets scan inverted lists. Elements are ordered, those that very many
  sets hold last, and a set enters the lists of its first
  ``n - ceil(percent n / 100) + 1`` elements; two linked sets meet in one list.
  Each list is checked against one leading member, the one with the fewest
  elements of its own before the list's, and links are contracted. Of the lists
  that still have members of several components, those of up to ``short``
  members compare them all. The members of longer ones enter new lists by an
  exact order: elements that only one component holds come first and have no
  list, then those with the fewest holders. These are checked and contracted in
  the same way, ``refinements`` times at most, as long as components were joined,
  which leaves fewer elements to share; what is left is compared. Nothing is capped.
  A pair is checked element by element only if the list's element can be its
  first common one, which leaves the elements from there on, and the two sets'
  parity maps allow a link.
* The boundary between small and large is the one of least cost for the sizes
  that occur.

Equal sets are one class throughout, so exact copies cost one row each. The
order of elements only affects cost: the results are exact for any order, hence
the table of frequent elements may be held to ``heavy_slots`` entries. Exact up
to collisions of 64-bit hashes, of shingles within a pair of sets and of whole sets.

Defined results: a null text, or one without words, has an empty set and links
with nothing. A text with fewer than k words has its whole sequence as one
shingle. Rows may repeat; component ids ignore null ids (null if no member has
one). Very long texts are sets like others, taken one at a time. Only ``doc_id``
and ``text`` are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _words as W
from ._expr import unused
from ._store import Scratch

K, PERCENT = 5, 80
_SALT = np.uint64(0x6A09E667F3BCC909)
_NO_SET = np.zeros(0, np.uint64)


def shingle_sets(chunk: W.Chunk, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    grams, lo, hi = chunk.windows(k)
    for i in range(len(chunk)):
        a, b = int(chunk.at[i]), int(chunk.at[i + 1])
        if b - a >= k:
            x = np.sort(grams[lo[i] : hi[i]])
            yield np.concatenate((x[:1], x[1:][x[1:] != x[:-1]]))
        else:
            yield W.windows(chunk.hashes[a:b], b - a) if b > a else _NO_SET


def class_id(s: np.ndarray) -> int | None:
    """A 64-bit id of a set; none for the empty set."""
    if not len(s):
        return None
    with np.errstate(over="ignore"):
        total = np.array([W.mix(s ^ _SALT).sum(dtype=np.uint64) + np.uint64(len(s))])
    return int(W.mix(total).view(np.int64)[0])


#: Bits of a set's parity map.
BITS = 1024
#: Bits kept in list entries: maps folded by exclusive or are parity maps too.
FOLDED = 256


def parity(s: np.ndarray) -> np.ndarray:
    """A bit map in which each element flips one bit: two maps differ in no more bits than the sets in elements."""
    bit = (W.mix(s ^ np.uint64(0xBB67AE8584CAA73B)) & np.uint64(BITS - 1)).astype(np.intp)
    return np.packbits(np.bincount(bit, minlength=BITS).astype(np.uint8) & 1).view(np.int64)


def least_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def subset_sizes(n: int, percent: int) -> range:
    """Sizes of the intersections that a set of n elements can have with a partner it links with."""
    return range(least_overlap(n, percent), n + 1)


def subsets(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and sizes of all subsets of those sizes."""
    mixed = W.mix(s ^ np.uint64(0x3C6EF372FE94F82B))
    n = len(s)
    keys, sizes = [], []
    with np.errstate(over="ignore"):
        total = mixed.sum(dtype=np.uint64)
        for i in subset_sizes(n, percent):
            gone = np.array(list(combinations(range(n), n - i)), dtype=np.intp).reshape(comb(n, i), n - i)
            keys.append(total - mixed[gone].sum(axis=1, dtype=np.uint64) + np.uint64(i))
            sizes.append(np.full(len(gone), i, dtype=np.int32))
    return W.mix(np.concatenate(keys)), np.concatenate(sizes)


def boundary(counts: dict[int, int], percent: int) -> int:
    """The largest size of a small set: the one of least cost, given the number of sets of each size up to 64.

    Subsets cost a row each; inverted lists a row for each element entered and,
    as a candidate pair is checked element by element, as many steps as the set
    has elements.
    """

    def cost(most: int) -> int:
        small = sum(c * sum(comb(n, i) for i in subset_sizes(n, percent)) for n, c in counts.items() if n <= most)
        return small + sum(c * (n - least_overlap(n, percent) + 1) * (1 + n) for n, c in counts.items() if n >= least_overlap(most + 1, percent))

    return min(range(1, 21), key=cost)


class NgramJaccard:
    def __init__(self, k: int = K, percent: int = PERCENT, heavy_slots: int = 500_000, heavy_from: int = 16, short: int = 32, refinements: int = 3, broadcast_rows: int = 200_000):
        self.k, self.percent, self.heavy_slots, self.heavy_from = k, percent, heavy_slots, heavy_from
        self.short, self.refinements, self.broadcast_rows = short, refinements, broadcast_rows

    # ---- passes over the texts -------------------------------------------------

    def _rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        for chunk in W.chunks(column, W.SPACED, True):
            yield from shingle_sets(chunk, self.k)

    def _classes(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, cid, bits) of each row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, ids, bits = [], [], []
                for s in self._rows(batch["text"]):
                    n.append(len(s))
                    ids.append(class_id(s))
                    bits.append(parity(s))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.int64()), W.lists(bits, pa.int64())], ["doc_id", "n_shingles", "cid", "bits"])

        return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, cid long, bits array<long>")

    def _once(self, batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, np.ndarray]]]:
        """Class ids and sets, some texts at a time, without most repeats of a class within a task."""
        seen: set[int] = set()
        for batch in batches:
            for chunk in W.chunks(batch["text"], W.SPACED, True):
                out = []
                for s in shingle_sets(chunk, self.k):
                    if len(s) and (cid := class_id(s)) not in seen:
                        if len(seen) >= 50_000:
                            seen.clear()
                        seen.add(cid)
                        out.append((cid, s))
                yield out

    def _heavy(self, docs: DataFrame, scratch: Scratch) -> np.ndarray:
        """The elements of most sets, sorted; at most ``heavy_slots``.

        Counts cover all documents. Elements enter lists from the smallest hash
        on, so only the lower part of the hash range needs counting.
        """
        below = np.uint64(int(0.35 * 2**64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for sets in self._once(batches):
                if sets:
                    some = np.concatenate([s[: np.searchsorted(s, below)] for _, s in sets])
                    for at in range(0, len(some), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(W.signed(some[at : at + 100_000]), pa.int64())], ["h"])

        counted = scratch.keep(docs.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= self.heavy_from), "heavy")
        left, least = self.heavy_slots, None
        for row in sorted(counted.groupBy(F.floor(F.log2("c")).cast("int").alias("e")).count().collect(), key=lambda r: -r.e):  # at most 64 rows
            if row["count"] > left:
                break
            left, least = left - row["count"], 2**row.e
        found = counted.where(F.col("c") >= least).select("h").toArrow()["h"].to_numpy() if least else np.zeros(0, np.int64)
        scratch.drop("heavy")
        return np.sort(found.astype(np.int64).view(np.uint64))

    def _lists(self, docs: DataFrame, heavy: np.ndarray, most: int) -> DataFrame:
        """(h, cid, n, pos): a large set's list entries; for a small set's subsets pos is minus the subset's size."""
        shared = docs.sparkSession.sparkContext.broadcast(heavy)  # heavy_slots * 8 bytes at most
        percent, straddling = self.percent, least_overlap(most + 1, self.percent)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            often = shared.value
            for sets in self._once(batches):
                h, cid, n, pos = [], [], [], []
                for c, s in sets:
                    if len(s) <= most:
                        keys, sizes = subsets(s, percent)
                        h.append(keys)
                        pos.append(-sizes)
                        cid.append(np.full(len(keys), c))
                        n.append(np.full(len(keys), len(s), np.int32))
                    if len(s) >= straddling:
                        first = len(s) - least_overlap(len(s), percent) + 1
                        if len(often):
                            at = np.searchsorted(often, s)
                            late = often[np.minimum(at, len(often) - 1)] == s
                            s_in = np.concatenate((s[~late], s[late]))[:first]
                        else:
                            s_in = s[:first]
                        h.append(s_in)
                        pos.append(np.arange(first, dtype=np.int32))
                        cid.append(np.full(first, c))
                        n.append(np.full(first, len(s), np.int32))
                if h:
                    whole = pa.RecordBatch.from_arrays([pa.array(W.signed(np.concatenate(h)), pa.int64()), pa.array(np.concatenate(cid), pa.int64()), pa.array(np.concatenate(n), pa.int32()), pa.array(np.concatenate(pos), pa.int32())], ["h", "cid", "n", "pos"])
                    for at in range(0, len(whole), 100_000):
                        yield whole.slice(at, 100_000)

        rows = docs.select("text").mapInArrow(run, "h long, cid long, n int, pos int")
        own = Window.partitionBy("h")
        shared_keys = rows.withColumns({"lo": F.min("cid").over(own), "hi": F.max("cid").over(own)}).where("lo <> hi").drop("lo", "hi")
        return shared_keys.dropDuplicates(["h", "cid", "pos"])

    def _sets(self, docs: DataFrame, wanted: DataFrame) -> DataFrame:
        """(cid, items) of wanted classes (doc_id, cid)."""
        ids = wanted.select(F.col("doc_id").alias("_id"), F.col("cid").alias("_cid"))  # docs gives its id and text only
        if ids.count() <= self.broadcast_rows:  # else the texts are shuffled
            ids = F.broadcast(ids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cids = batch["_cid"].to_pylist()
                for at in range(0, len(batch), 200):
                    found = [(c, s) for c, s in zip(cids[at : at + 200], self._rows(batch["text"].slice(at, 200))) if class_id(s) == c]
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), W.lists([W.signed(s) for _, s in found], pa.int64())], ["cid", "items"])

        joined = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")))
        return joined.select("text", "_cid").mapInArrow(run, "cid long, items array<long>")

    # ---- links and components --------------------------------------------------

    def _contract(self, scratch: Scratch, labels: DataFrame, edges: DataFrame, rows: int) -> DataFrame:
        """Labels after joining the components at both ends of each edge (a, b); rows bounds the number of labels."""
        while True:
            ends = edges.join(labels.select(F.col("cid").alias("a"), F.col("comp").alias("x")), "a").join(labels.select(F.col("cid").alias("b"), F.col("comp").alias("y")), "b")
            apart = scratch.keep(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges", edges.count())
            if apart.isEmpty():
                return labels
            parent = scratch.keep(apart.groupBy("b").agg(F.min("a").alias("p")), "parents", apart.count())
            while True:  # pointer jumping
                up = parent.select(F.col("b").alias("p"), F.col("p").alias("q"))
                parent = scratch.keep(parent.join(up, "p", "left").select("b", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "parents", parent.count())
                scratch.drop_before("parents")
                if parent.where("moved").isEmpty():
                    break
                parent = parent.drop("moved")
            labels = scratch.keep(labels.join(parent.select(F.col("b").alias("comp"), "p"), "comp", "left").select("cid", F.coalesce("p", "comp").alias("comp")), "labels", rows)
            scratch.drop_before("labels")
            edges = apart

    def _may(self, bound: str = "TRUE") -> Column:
        """Whether sets of sizes m and n with places at and pos of an element can link and have no common element before it."""
        p = self.percent
        return F.expr(f"{bound} AND 100L * least(m, n) >= {p}L * greatest(m, n) AND {100 + p}L * least(m - at, n - pos) >= {p}L * (m + n)")

    def _near(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs (a, b) without those whose parity maps differ too much for a link."""
        left, right = (classes.select(F.col("cid").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits")) for c in "ab")
        apart = " + ".join(f"bit_count(a_bits[{i}] ^ b_bits[{i}])" for i in range(BITS // 64))
        return pairs.join(left, "a").join(right, "b").where(F.expr(f"{100 + self.percent}L * ({apart}) <= {100 - self.percent}L * (a_n + b_n)")).select("a", "b")

    def _linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that link."""
        left, right = (sets.select(F.col("cid").alias(c), F.col("items").alias(f"{c}_items")) for c in "ab")
        both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("a_items").alias("m"), F.size("b_items").alias("n"), F.size(F.array_intersect("a_items", "b_items")).alias("i"))
        return both.where(F.expr(f"100L * i >= {self.percent}L * (m + n - i)")).select("a", "b")

    def _checked(self, docs: DataFrame, scratch: Scratch, classes: DataFrame, labels: DataFrame, met: DataFrame) -> DataFrame:
        """Labels after contracting those of the pairs met (a, b) that link; the same labels if none was to contract."""
        pairs = scratch.keep(self._near(met.distinct(), classes), "pairs")
        n = pairs.count()
        if not n:
            return labels
        wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "cid")
        sets = scratch.keep(self._sets(docs, classes.join(wanted, "cid", "left_semi").select("doc_id", "cid")), "sets")
        labels = self._contract(scratch, labels, scratch.keep(self._linked(pairs, sets), "links", n, 50_000), classes.count())
        scratch.drop("sets", "pairs", "links")
        return labels

    def _led(self, docs: DataFrame, scratch: Scratch, classes: DataFrame, labels: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Checks each list's entries (h, cid, n, pos) against its leader; new labels and the entries of lists with work left (h, cid, n, pos, comp, left)."""
        leaders = entries.groupBy("h").agg(F.min(F.struct("pos", "cid", "n")).alias("l"), F.count("*").alias("members"))
        leaders = scratch.keep(leaders.where("members > 1").select("h", F.col("l.cid").alias("a"), F.col("l.n").alias("m"), F.col("l.pos").alias("at"), "members"), "leaders")
        met = entries.join(leaders, "h").where(self._may("cid <> a")).select("a", F.col("cid").alias("b"))
        labels = self._checked(docs, scratch, classes, labels, met)
        # the leader has met everyone; a list is done if it has two members or one component besides
        rest = entries.join(leaders.where("members > 2").select("h", "a"), "h").where("cid <> a").drop("a").join(labels, "cid")
        several = rest.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("left"), F.min("n").alias("least")).where("lo <> hi").select("h", "left", "least")
        # a member stays if a set as small as the list's smallest could link with it
        rest = scratch.keep(rest.join(several, "h").where(f"{100 + self.percent}L * (n - pos) >= {self.percent}L * (n + least)").drop("least"), "open")
        scratch.drop("leaders")
        return labels, rest

    def _refined(self, docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
        """New list entries (h, cid, n, pos) of members (cid, n, comp) of several components.

        Two members of different components that link meet in one of the lists.
        An element in one component only is in no common part, so it comes first
        in the order and has no list.
        """
        items = self._sets(docs, classes.join(members, "cid", "left_semi").select("doc_id", "cid")).dropDuplicates(["cid"])
        each = items.join(members, "cid").select("cid", "n", "comp", F.explode("items").alias("h"))
        holders = each.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("holders")).where("lo <> hi").select("h", "holders")
        own = Window.partitionBy("cid")
        ranked = each.join(holders, "h").select("h", "cid", "n", F.row_number().over(own.orderBy("holders", "h")).alias("r"), F.count("*").over(own).cast("int").alias("shared"))
        return ranked.select("h", "cid", "n", (F.col("n") - F.col("shared") + F.col("r") - 1).alias("pos")).where(F.expr(f"pos <= n - cast(ceil({self.percent}L * n / 100) as int)"))

    def components(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_shingles, component_id of each row."""
        scratch, percent = Scratch(docs.sparkSession, "jaccard"), self.percent
        rows = scratch.keep(self._classes(docs), "rows")
        classes = scratch.keep(rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").cast("int").alias("n"), F.first("bits").alias("bits")), "classes")
        sizes = {r.n: r["count"] for r in classes.where("n <= 64").groupBy("n").count().collect()}
        most = boundary(sizes, percent)
        lists = scratch.keep(self._lists(docs, self._heavy(docs, scratch), most), "lists")
        n_classes = classes.count()
        labels = scratch.keep(lists.select("cid").distinct().withColumn("comp", F.col("cid")), "labels", n_classes)

        small = lists.where("pos < 0")
        least = small.groupBy("h").agg(F.min(F.struct("n", "cid")).alias("s")).select("h", F.col("s.n").alias("m"), F.col("s.cid").alias("a"))
        sure = small.join(least, "h").where(F.expr(f"cid <> a AND -100L * pos >= {percent}L * (m + n + pos)"))
        labels = self._contract(scratch, labels, scratch.keep(sure.select("a", F.col("cid").alias("b")).distinct(), "sure", n_classes), n_classes)

        entries = lists.where("pos >= 0")
        left, level = [], 0
        while True:
            before = labels
            labels, rest = self._led(docs, scratch, classes, labels, entries)
            scratch.drop("entries" if level else "lists")
            long = rest.where(F.col("left") > self.short)
            # new lists differ from those of the last turn only if components were joined
            if level == self.refinements or level and labels is before or long.isEmpty():
                left.append((level, rest))
                break
            left.append((level, rest.where(F.col("left") <= self.short)))
            members = scratch.keep(long.select("cid", "n", "comp").distinct(), "members", n_classes)
            entries = scratch.keep(self._refined(docs, classes, members), "entries")
            scratch.drop("members")
            level += 1

        folds = range(FOLDED // 64)
        folded = [F.expr(" ^ ".join(f"bits[{j}]" for j in range(i, BITS // 64, FOLDED // 64))).alias(f"f{i}") for i in folds]
        rest = left[0][1].withColumn("level", F.lit(0))
        for at, more in left[1:]:
            rest = rest.unionByName(more.withColumn("level", F.lit(at)))
        rest = scratch.keep(rest.drop("comp").join(labels, "cid").join(classes.select("cid", *folded), "cid"), "rest")
        a = rest.select("level", "h", F.col("cid").alias("a"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("comp").alias("x"), *[F.col(f"f{i}").alias(f"g{i}") for i in folds])
        differ = " + ".join(f"bit_count(f{i} ^ g{i})" for i in folds)
        may = self._may("x <> comp AND a < cid") & F.expr(f"{100 + percent}L * ({differ}) <= {100 - percent}L * (m + n)")
        labels = self._checked(docs, scratch, classes, labels, a.join(rest, ["level", "h"]).where(may).select("a", F.col("cid").alias("b")))

        scratch.only("rows", "classes", "labels")
        named = classes.join(labels, "cid", "left").select("cid", "doc_id", F.coalesce("comp", "cid").alias("comp"))
        least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        final = named.join(least, "comp").select("cid", "component_id")
        return rows.join(final, "cid", "left").select("doc_id", "n_shingles", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))

    def members(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_shingles, cid of each row: rows of one class have equal sets, so all of them link; null for an empty set."""
        return self._classes(docs).drop("bits")

    def links(self, docs: DataFrame) -> DataFrame:
        """(a, b), a < b: all pairs of classes that link, each once; ``members`` has the rows of a class.

        Nothing is skipped, so a group of near copies gives all its pairs.
        """
        scratch, percent = Scratch(docs.sparkSession, "jaccard-links"), self.percent
        rows = scratch.keep(self._classes(docs), "rows")
        classes = scratch.keep(rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").cast("int").alias("n"), F.first("bits").alias("bits")), "classes")
        most = boundary({r.n: r["count"] for r in classes.where("n <= 64").groupBy("n").count().collect()}, percent)
        lists = scratch.keep(self._lists(docs, self._heavy(docs, scratch), most), "lists")

        a = lists.select("h", F.col("cid").alias("a"), F.col("n").alias("m"), F.col("pos").alias("at"))
        met = a.join(lists.select("h", F.col("cid").alias("b"), "n", "pos"), "h").where("a < b")
        # a common subset is enough for small sets: of their intersection's size there is one
        sure = met.where(F.expr(f"at < 0 AND at = pos AND -100L * pos >= {percent}L * (m + n + pos)")).select("a", "b").distinct()
        pairs = scratch.keep(self._near(met.where(self._may("at >= 0 AND pos >= 0")).select("a", "b").distinct(), classes), "pairs")
        wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "cid")
        sets = scratch.keep(self._sets(docs, classes.join(wanted, "cid", "left_semi").select("doc_id", "cid")).dropDuplicates(["cid"]), "sets")
        return sure.union(self._linked(pairs, sets)).distinct()

    def one_of_each(self, docs: DataFrame) -> DataFrame:
        """The document with the smallest id of each component, in one row even if its id repeats.

        Rows without an id stay unless they are in a component with one.
        """
        found = Scratch(docs.sparkSession, "jaccard-kept").keep(self.components(docs), "components")
        (number,) = unused(docs.columns, "number")
        kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.struct(F.col("doc_id").alias("id")).alias("kept")).distinct()
        own = F.struct(docs["doc_id"].alias("id"))
        out = docs.join(kept, own.eqNullSafe(kept["kept"]), "left_semi")
        repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.struct(F.col("doc_id").alias("id")).alias("repeated"))
        if repeated.isEmpty():
            return out
        order = Window.partitionBy("doc_id").orderBy(*[F.xxhash64(c) for c in docs.columns])
        twice = out.join(repeated, own.eqNullSafe(repeated["repeated"]), "left_semi").withColumn(number, F.row_number().over(order)).where(F.col(number) == 1).drop(number)
        return out.join(repeated, own.eqNullSafe(repeated["repeated"]), "left_anti").unionByName(twice)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the components of their links; those without words have their own."""
    return NgramJaccard().components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
