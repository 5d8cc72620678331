"""Search in words: hits with their boxes."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.sources.pdf import flat_map

PAGE = ["doc_id", "page_index"]


def _haystacks(words: DataFrame, keys: list[str]) -> DataFrame:
    """One row a page: its words in order, each with its first character a, and the text, each word followed by a blank."""
    n = F.length("text") + 1
    in_order = Window.partitionBy(*keys).orderBy("line_idx", "word_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = words.withColumn("_a", (F.sum(n).over(in_order) - n).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("line_idx", "word_idx", F.col("_a").alias("a"), "text", "x", "y", "width", "font_size")))
    pages = placed.groupBy(*keys).agg(ordered.alias("w"))
    return pages.select(*keys, "w", F.concat_ws("", F.transform("w", lambda w: F.concat(w.text, F.lit(" ")))).alias("text"))


def _cut(whole: bool, a: list, text: list, x: list, y: list, width: list, size: list, matches: Iterator[tuple[int, int]]) -> Iterator[tuple]:
    """(text, x1, y1, x2, y2) of each match (s, e) that touches a word; a word's place is looked up, not searched for."""
    ends = [i + len(t) for i, t in zip(a, text)]
    known = lambda values: [v for v in values if v is not None]

    def left(i: int, s: int) -> float | None:
        if whole or x[i] is None or width[i] is None:
            return x[i]
        return x[i] + width[i] / max(len(text[i]), 1) * max(s - a[i], 0)

    def right(i: int, e: int) -> float | None:
        if x[i] is None or width[i] is None:
            return None
        return x[i] + width[i] if whole else x[i] + width[i] / max(len(text[i]), 1) * (min(e, ends[i]) - a[i])

    def top(i: int) -> float | None:
        return None if y[i] is None or size[i] is None else y[i] + size[i]

    for s, e in matches:
        first, last = bisect_right(ends, s), bisect_left(a, e)
        if last - first == 1:
            yield text[first], left(first, s), y[first], right(first, e), top(first)
        elif first < last:
            some = range(first, last)
            x1, y1 = known(left(i, s) for i in some), known(y[i] for i in some)
            x2, y2 = known(right(i, e) for i in some), known(map(top, some))
            yield "".join(text[first:last]), min(x1, default=None), min(y1, default=None), max(x2, default=None), max(y2, default=None)


def _boxes(found: DataFrame, keys: list[str], whole: bool, places: list[str], matches: Callable[..., Iterator[tuple[int, int]]]) -> DataFrame:
    """Hits (keys, hit_idx, text, x1, y1, x2, y2) of a page's ``matches(*places)`` (s, e), in order: the union of touched words.

    Words are cut in proportion to characters unless ``whole``; the text is that
    of the touched words, without blanks. Work grows with words and hits of a
    page, not with their product.
    """
    parts, kinds = ("a", "text", "x", "y", "width", "font_size"), dict(found.dtypes)
    n = len(keys)

    def each(*values: Any) -> Iterator[tuple]:
        above, w, of = values[1:n], values[n : n + len(parts)], values[n + len(parts) :]
        for i, hit in enumerate(_cut(whole, *w, matches(*of))):
            yield (*above, i, *hit)

    rows = found.select(*keys, *[F.col(f"w.{c}").cast("array<double>" if c in ("x", "y", "width", "font_size") else "array<string>" if c == "text" else "array<int>").alias(f"_{c}") for c in parts], *places)
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys[1:]) + "hit_idx int, text string, x1 double, y1 double, x2 double, y2 double"
    return flat_map(rows, rows.columns, schema, each)


def search(words: DataFrame, query: str, case_sensitive: bool = True, keys: list[str] | None = None) -> DataFrame:
    """Hits of a literal; matches may overlap. An empty query has none.

    Without regard to case characters are compared one by one, so a letter whose
    lower case is longer moves nothing.
    """
    keys = keys or PAGE
    pages = _haystacks(words, keys)
    if not query:
        return _boxes(pages.limit(0), keys, False, [], lambda: iter(()))
    want = ("" if case_sensitive else "(?iu)") + "(?={})".format("".join(f"\\x{{{ord(c):X}}}" for c in query))
    # a cut before every match, overlapping ones too; all pieces but the first begin with one
    lengths = F.transform(F.split("text", want), lambda x: F.length(x))
    places = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda a, n: F.struct((a.at + n).alias("at"), F.concat(a.all, F.array(a.at)).alias("all")), lambda a: a.all)
    # pages without the query aren't looked at further
    cut = pages.where(F.col("text").rlike(want)).select(*keys, "w", F.col("text").rlike(f"\\A{want}").alias("_first"), places.alias("_at"))
    starts = cut.select(*keys, "w", F.filter("_at", lambda s, i: (i > 0) | F.col("_first")).alias("_s"))
    size = len(query)
    return _boxes(starts, keys, False, ["_s"], lambda at: ((s, s + size) for s in at))


_REJECTED = re.compile(r"\\[1-9]|\(\?(?:=|!|<=|<!|P=)")


def search_regex(words: DataFrame, pattern: str, case_sensitive: bool = True, keys: list[str] | None = None) -> DataFrame:
    """Hits of a regular expression, not overlapping; boxes take whole words.

    Look-around and back-references aren't in the dialect.
    """
    keys = keys or PAGE
    if _REJECTED.search(pattern):
        raise ValueError("look-around and back-references aren't supported")
    compiled = re.compile(pattern, 0 if case_sensitive else re.IGNORECASE)

    pages = _haystacks(words, keys).withColumnRenamed("text", "_page")
    return _boxes(pages, keys, True, ["_page"], lambda text: (m.span() for m in compiled.finditer(text or "") if m.end() > m.start()))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], lo: str, hi: str, first: str, end: str, cell: float) -> DataFrame:
    """Pairs of one key whose intervals (lo, hi) and (first, end) overlap, both open.

    Both sides are cut into cells of width ``cell``, so a key with very many
    intervals becomes many small groups; a pair is kept in the first cell that
    the two share.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    l, r = left.withColumn("_cell", cells(lo, hi)), right.withColumn("_cell", cells(first, end))  # noqa: E741
    both = l.join(r, [*keys, "_cell"]).where((F.col(lo) < F.col(end)) & (F.col(hi) > F.col(first)))
    return both.where(F.col("_cell") == F.floor(F.greatest(F.col(lo), F.col(first)) / cell)).drop("_cell")
