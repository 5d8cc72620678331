"""Sharding by minimax contiguous partition, in DataFrame expressions only.

Equal texts are one group and groups are ordered by a hash of the text. The
smallest capacity is that for which greedy filling needs no more shards than
there are, found by binary search over the sizes of the groups in their order.

The driver never holds all groups. It has the sizes of runs of neighbouring
groups, at first ``2 ** cell_bits`` of them. Taken as indivisible, runs give an
upper bound of the capacity; taken as divisible at will, a lower one. Only runs
that a cut can fall into for a capacity between the two are split, by the next
bits of the hash, until the cuts are between groups and the capacity is exact.
These are some ``shards ** 2`` runs a turn, however many groups there are.

The cuts keep every shard within the smallest capacity. Filling each shard up to
it would leave the last one nearly empty, so each cut is the one nearest to an
equal share of all bytes that still lets the rest fit.

Rows are numbered within a shard by cell, then by a salt of the id and the id,
so a group with a third of all rows is numbered in ``salts`` tasks.

Defined results: a null text has size 16, checksum 0 and is one group with the
empty text. Rows may repeat; each gets a slot. Null ids are numbered like others.
A very long text is a group like others, and no shard is smaller than its largest
group. Without rows there is no shard. Only ``doc_id`` and ``text`` are read, so
other columns may have any names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import Scratch

SHARDS = 40
#: Bits of a group's hash, and of it in each further split of a run.
KEY_BITS, SPLIT_BITS = 60, 6


class Runs:
    """Sizes of runs of groups in their order; ``single`` tells runs of one group.

    Positions are sums of sizes before a place.
    """

    def __init__(self, sizes: list[int], single: list[bool]):
        self.sizes, self.single = sizes, single
        self.ends = [0, *accumulate(sizes)]
        self.total = self.ends[-1]

    def run_at(self, position: int) -> int:
        """The run that the position is in or at the start of."""
        return bisect_right(self.ends, position) - 1

    def down(self, position: int, divisible: bool) -> int:
        """The last place for a cut up to the position."""
        if position >= self.total:
            return self.total
        i = self.run_at(position)
        return position if divisible and not self.single[i] else self.ends[i]

    def up(self, position: int) -> int:
        """The first place for a cut from the position on."""
        return 0 if position <= 0 else self.ends[bisect_left(self.ends, position)]

    def fill(self, capacity: int, shards: int, divisible: bool) -> list[int]:
        """Where each of the shards ends if filled greedily."""
        out, at = [], 0
        for _ in range(shards):
            at = self.down(at + capacity, divisible)
            out.append(at)
        return out

    def capacity(self, shards: int, divisible: bool) -> int:
        """The smallest one."""
        least = max((s for s, one in zip(self.sizes, self.single) if one or not divisible), default=0)
        lo = max(-(-self.total // shards), least)
        hi = max(lo, self.total)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.fill(mid, shards, divisible)[-1] >= self.total:
                hi = mid
            else:
                lo = mid + 1
        return hi

    def between(self, low: int, high: int) -> set[int]:
        """Runs of several groups that hold a position from low to high."""
        return {i for i in range(max(0, self.run_at(low)), min(self.run_at(high), len(self.sizes) - 1) + 1) if not self.single[i] and self.ends[i] < high + 1 and self.ends[i + 1] > low}

    def open(self, shards: int) -> set[int]:
        """Runs to split before the capacity is known exactly."""
        low, high = self.capacity(shards, True), self.capacity(shards, False)
        return set().union(*(self.between(a, min(b, self.total)) for a, b in zip(self.fill(low, shards, False), self.fill(high, shards, True))))

    def cuts(self, shards: int) -> tuple[list[int], set[int]]:
        """Positions of the cuts between shards, and the runs to split before they are exact."""
        capacity, touched = self.capacity(shards, False), set()
        first = [self.total]  # the first place for each cut that lets the rest fit, from the last cut on
        for _ in range(shards - 1):
            touched |= self.between(first[-1] - capacity, first[-1] - capacity)
            first.append(self.up(first[-1] - capacity))
        out = [0]
        for s, least in zip(range(1, shards), reversed(first[1:])):
            share, most = self.total * s // shards, self.down(out[-1] + capacity, False)
            touched |= self.between(share, share) | self.between(out[-1] + capacity, out[-1] + capacity)
            near = min(self.down(share, False), self.up(share), key=lambda p: abs(p - share))
            out.append(max(min(max(near, least), most), out[-1]))
        return out[1:], touched


class Sharding:
    def __init__(self, shards: int = SHARDS, cell_bits: int = 14, salts: int = 256):
        self.shards, self.cell_bits, self.salts = shards, cell_bits, salts

    def _runs(self, sizes: DataFrame, bits: int, parent_bits: int = 0, parents: list[int] | None = None) -> list[tuple[int, int, int, bool]]:
        """(first key, bits, size, single) of the runs by so many leading bits, all or those within given runs of fewer bits."""
        some = sizes if parents is None else sizes.where(F.shiftright("key", KEY_BITS - parent_bits).isin(parents))
        found = some.groupBy(F.shiftright("key", KEY_BITS - bits).alias("run")).agg(F.sum("size").alias("size"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        return [(r.lo, bits, r["size"], r.lo == r.hi) for r in found]  # 2 ** cell_bits, or 2 ** SPLIT_BITS for each run split

    def cuts(self, sizes: DataFrame) -> tuple[int, list[int]]:
        """The smallest capacity and the first key of each shard but the first, for groups or parts of them (key, size)."""
        found = sorted(self._runs(sizes, self.cell_bits))
        steps: list[Callable[[Runs], set[int]]] = [lambda r: r.open(self.shards), lambda r: r.cuts(self.shards)[1]]
        for step in steps:
            while touched := step(Runs([x[2] for x in found], [x[3] for x in found])):
                split = [found[i] for i in touched]
                found = [x for i, x in enumerate(found) if i not in touched]
                for bits in sorted({x[1] for x in split}):
                    found += self._runs(sizes, min(bits + SPLIT_BITS, KEY_BITS), bits, sorted(x[0] >> (KEY_BITS - bits) for x in split if x[1] == bits))
                found.sort()
        runs = Runs([x[2] for x in found], [x[3] for x in found])
        keys = [*(x[0] for x in found), 1 << KEY_BITS]
        return runs.capacity(self.shards, False) if found else 0, [keys[bisect_left(runs.ends, at)] for at in runs.cuts(self.shards)[0]] if found else []

    def assign(self, docs: DataFrame) -> DataFrame:
        """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row."""
        scratch = Scratch(docs.sparkSession, "sharding")
        text = F.coalesce(F.col("text"), F.lit(""))
        key = F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")
        rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"), F.pmod(F.xxhash64("doc_id"), F.lit(self.salts)).cast("int").alias("salt"))
        rows = scratch.keep(rows, "rows")
        groups = scratch.keep(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
        _, cuts = self.cuts(groups)
        # the shard of a key: cuts at or before it; empty shards share a cut
        shard = sum((F.when(F.col("key") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
        placed = rows.withColumns({"shard": shard, "cell": F.shiftright("key", KEY_BITS - self.cell_bits).cast("int")})
        parts = scratch.keep(placed.groupBy("shard", "cell", "salt").agg(F.count("*").alias("n")), "parts")
        running = lambda by, order: F.sum("n").over(Window.partitionBy(*by).orderBy(order)) - F.col("n")
        base = parts.groupBy("shard", "cell").agg(F.sum("n").alias("n")).select("shard", "cell", running(["shard"], "cell").alias("base"))  # 2 ** cell_bits and shards rows at most
        before = parts.select("shard", "cell", "salt", running(["shard", "cell"], "salt").alias("before")).join(F.broadcast(base), ["shard", "cell"])
        within = Window.partitionBy("shard", "cell", "salt").orderBy("doc_id", "text_crc32", "size")
        numbered = placed.withColumn("own", F.row_number().over(within) - 1).join(before, ["shard", "cell", "salt"])
        return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("before") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 of near equal bytes, no group of equal texts apart."""
    return Sharding().assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
