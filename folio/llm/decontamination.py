"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Of every ``window - gram + 1`` consecutive ``gram``-word hashes of a text the
smallest is kept as a fingerprint. A span of ``window`` words that stands in a
document and in an item has the same hashes in both, hence a fingerprint in
common: joining fingerprints finds every shared window. Only hashes and places
are joined; the words of texts with hits are then read once more, and each hit is
extended word by word to both sides, as far as a window with it reaches, and
counts if the extended span has ``window`` words or more.

An item with fewer words is one window of its own length m. For each such m
that occurs, every m-word hash is a fingerprint (winnowing with one hash a
window), and a hit must be the item.

Defined results: a null or empty text has no words, whether a document or an
item; such an item occurs nowhere. Items may repeat, under one id or several;
each distinct id counts once and a null id doesn't count, though its text does.
Each row of documents is judged by itself, also if ids repeat or are null. A very
long text is one row of words but its hits are rows of their own. Columns other
than ids and texts aren't read, so they may have any names.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._expr import NOT_ALNUM, ascii_lower, index, let, rolling, words
from ._store import Scratch

WINDOW, GRAM = 10, 5
#: Distinct fingerprints of items up to which they are broadcast, as two numbers each.
BROADCAST_ROWS = 200_000


def _fingerprints(text_words: Column, window: int, gram: int, short: list[int]) -> Column:
    """Array of (pos, kind, h): fingerprints for whole windows have kind 0, those for items of m words kind m."""

    def winnowed(h: Column) -> Column:
        width = window - gram + 1
        least = F.transform(index(F.size(h) - (width - 1)), lambda i: F.least(*[F.element_at(h, i + j) for j in range(width)]))
        # a position is kept if its hash is the least of a window that it stands in
        kept = lambda w, f: reduce(or_, [F.get(w, f.pos - 1 - j) == f.h for j in range(width)])
        numbered = F.transform(h, lambda x, i: F.struct((i + 1).alias("pos"), F.lit(0).alias("kind"), x.alias("h")))
        return let(least, lambda w: F.filter(numbered, lambda f: kept(w, f)))

    def every(m: int, h: Column) -> Column:
        return F.transform(rolling(h, m), lambda x, i: F.struct((i + 1).alias("pos"), F.lit(m).alias("kind"), x.alias("h")))

    hashes = F.transform(text_words, lambda w: F.xxhash64(w))
    return let(hashes, lambda wh: F.concat(let(rolling(wh, gram), winnowed), *[every(m, wh) for m in short]))


class Decontaminator:
    def __init__(self, window: int = WINDOW, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS):
        self.window, self.gram, self.broadcast_rows = window, gram, broadcast_rows

    def _around(self, w: Column, pos: Column) -> Column:
        """Up to window - gram words before pos, the gram, and as many after; null beyond the ends."""
        side = self.window - self.gram
        return F.transform(F.sequence(F.lit(-side), F.lit(self.window - 1)), lambda i: F.get(w, pos - 1 + i))

    def _found(self, docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(id, key, n_words) of each row of docs, and (id, key, first, end, items): words first to end - 1, from 1, stand in the items."""
        window, gram = self.window, self.gram
        side, scratch = window - gram, Scratch(docs.sparkSession, "decontamination")
        # bound by let, as the optimizer would put a column's expression into the functions, to be computed for each element
        w = words(ascii_lower(F.col("text")), NOT_ALNUM)
        short = sorted(r.m for r in items.select(F.size(w).alias("m")).where(F.col("m").between(1, window - 1)).distinct().collect())  # window - 1 rows at most
        own = lambda w, f: F.when(f.kind > 0, F.size(w) == f.kind).otherwise(F.size(w) >= window)
        around = lambda w, f: F.struct(f.kind.alias("kind"), f.h.alias("h"), self._around(w, f.pos).alias("there"))
        each = let(w, lambda w: F.transform(F.filter(_fingerprints(w, window, gram, short), lambda f: own(w, f)), lambda f: around(w, f)))
        # arrays are exploded out of a struct: the filter on their size that the optimizer puts in would compute them twice
        prints = items.select("item_id", let(each, lambda f: F.struct(f.alias("f"))).alias("both")).select("item_id", F.inline("both.f"))
        # a window that many items share is one row
        known = prints.groupBy("kind", "h", "there").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
        known = scratch.keep(known, "known")
        keys = known.select("kind", "h").distinct().withColumn("known", F.lit(True))

        texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), "text")
        itself = F.array(F.struct(F.lit(0).alias("pos"), F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("h")))
        both = let(w, lambda w: F.struct(F.size(w).alias("n_words"), F.concat(itself, _fingerprints(w, window, gram, short)).alias("f")))
        places = texts.select("id", "key", both.alias("both")).select("id", "key", "both.n_words", F.inline("both.f"))
        if keys.count() <= self.broadcast_rows:
            keys = F.broadcast(keys)
        found = scratch.keep(places.join(keys, ["kind", "h"], "left").where("kind = -1 OR known").drop("known"), "found")

        hits = found.where("kind >= 0").groupBy(F.col("id").alias("hit_id"), F.col("key").alias("hit_key")).agg(F.collect_set(F.struct("pos", "kind", "h")).alias("hits"))  # of one text
        again = texts.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key"))).dropDuplicates(["id", "key"])
        here = let(w, lambda w: F.struct(F.transform("hits", lambda x: F.struct(x.pos.alias("pos"), x.kind.alias("kind"), x.h.alias("h"), self._around(w, x.pos).alias("here"))).alias("f")))
        placed = again.select("id", "key", here.alias("both")).select("id", "key", F.inline("both.f")).join(known, ["kind", "h"])
        # equal words at both sides; the gram is verified too
        same = F.transform(index(F.lit(window + side)), lambda i: F.coalesce(F.element_at("here", i) == F.element_at("there", i), F.lit(False)))
        placed = placed.withColumn("same", same).drop("here", "there")
        left = F.aggregate(F.slice("same", 1, side), F.lit(0), lambda run, x: F.when(x, run + 1).otherwise(0))
        right = F.aggregate(F.slice("same", side + gram + 1, side), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a.n + F.when(a.on & x, 1).otherwise(0)).alias("n"), (a.on & x).alias("on")), lambda a: a.n)
        whole = F.col("kind") > 0
        length = F.when(whole, F.col("kind")).otherwise(gram)
        exact = F.forall(F.slice(F.col("same"), F.lit(side + 1), length), lambda x: x)
        placed = placed.where(exact).withColumns({"left": F.when(whole, 0).otherwise(left), "right": F.when(whole, 0).otherwise(right)})
        placed = placed.where(whole | (F.col("left") + F.col("right") + gram >= window))
        spans = placed.select("id", "key", (F.col("pos") - F.col("left")).alias("first"), (F.col("pos") + length + F.col("right")).alias("end"), "items")
        return found.where("kind = -1").select("id", "key", "n_words"), spans

    def spans(self, docs: DataFrame, items: DataFrame) -> DataFrame:
        """(doc_id, first, end, items): words first to end - 1, from 1, of a document stand in the items."""
        return self._found(docs, items)[1].select(F.col("id").alias("doc_id"), "first", "end", "items").distinct()

    def digests(self, docs: DataFrame, items: DataFrame) -> DataFrame:
        """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row."""
        rows, spans = self._found(docs, items)
        one = [F.col("id").alias("hit_id"), F.col("key").alias("hit_key")]
        covered = spans.select(*one, F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("at")).distinct().groupBy("hit_id", "hit_key").agg(F.count("*").alias("n_hit"))
        listed = spans.select(*one, "items").distinct().groupBy("hit_id", "hit_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        hit = covered.join(listed.withColumnsRenamed({"hit_id": "_id", "hit_key": "_key"}), F.col("hit_id").eqNullSafe(F.col("_id")) & (F.col("hit_key") == F.col("_key"))).select("hit_id", "hit_key", "n_hit", "items")
        out = rows.join(hit, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
        n_hit, ids = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
        return out.select(F.col("id").alias("doc_id"), F.col("n_words").cast("long"), n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))

    def clean(self, docs: DataFrame, items: DataFrame) -> DataFrame:
        """The documents in whose text no window of an item occurs."""
        hit = self._found(docs, items)[1].select("id", "key").distinct().select(F.struct("id", "key").alias("hit"))
        # a struct of both columns, whatever names docs has
        return docs.join(hit, F.struct(docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("key")).eqNullSafe(hit["hit"]), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all of benchmark; see above for nulls and repeats."""
    return Decontaminator().digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[p:p + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, ms WHERE len(w) >= m)),
h AS (SELECT doc_id, item_id, p, m FROM dw JOIN bw USING (m, g)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
