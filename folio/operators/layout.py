"""From spans to lines, words and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_index"]
#: Columns of spans that lines and words are made of, beside doc_id.
SPAN = ["page_index", "span_idx", "text", "x", "y", "width", "font_size", "font_name"]


def lines_of_spans(spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds line_idx, baseline_y and pos (order in the line) to spans.

    Spans are walked from the top down, left to right. A span joins the first
    line whose first span lies within half the span's font size, else begins a
    line: a greedy, order-dependent fold, done as one expression for each page.
    Lines are then ordered by baseline from the top, and a line's spans by x.
    """
    keys = keys or PAGE
    own = [c for c in spans.columns if c not in keys]
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.col("y")).alias("_k1"), F.col("x").alias("_k2"), F.col("span_idx").alias("_k3"), F.struct(*own).alias("s")))
    )
    start = F.struct(F.array().cast("array<double>").alias("anchors"), F.array().cast("array<int>").alias("at"))

    def join(a, e):
        near = F.filter(F.transform(a.anchors, lambda y, i: F.when(F.abs(e.s.y - y) <= 0.5 * e.s.font_size, i)), lambda i: i.isNotNull())
        new = F.struct(F.concat(a.anchors, F.array(e.s.y)).alias("anchors"), F.concat(a.at, F.array(F.size(a.anchors))).alias("at"))
        return F.when(F.size(near) > 0, F.struct(a.anchors.alias("anchors"), F.concat(a.at, F.array(F.element_at(near, 1))).alias("at"))).otherwise(new)

    pages = spans.groupBy(*keys).agg(ordered.alias("o"))
    folded = pages.withColumn("f", F.aggregate("o", start, join))
    flat = folded.select(*keys, F.explode(F.arrays_zip(F.col("o").alias("o"), F.col("f.at").alias("at"))).alias("z"), F.col("f.anchors").alias("anchors"))
    flat = flat.select(*keys, "z.o.s.*", F.col("z.at").alias("_line"), F.element_at("anchors", F.col("z.at") + 1).alias("baseline_y"))
    by_line = Window.partitionBy(*keys).orderBy(F.desc("baseline_y"), "_line")
    in_line = Window.partitionBy(*keys, "_line").orderBy("x", F.desc("y"), "span_idx")
    return flat.withColumn("line_idx", F.dense_rank().over(by_line) - 1).withColumn("pos", F.row_number().over(in_line) - 1).drop("_line")


def words(lined: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Words of a line: a new one where the gap to the span before is 0.3 of the font size or more.

    (keys, line_idx, word_idx, baseline_y, text, x, y, width, font_size, font_name)
    """
    keys = keys or PAGE
    line = Window.partitionBy(*keys, "line_idx").orderBy("pos")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(line)
    islands = lined.withColumn("word_idx", F.sum(F.when(gap < 0.3 * F.col("font_size"), 0).otherwise(1)).over(line) - 1)
    first = lambda c: F.min_by(c, "pos").alias(c)
    return islands.groupBy(*keys, "line_idx", "word_idx").agg(
        F.first("baseline_y").alias("baseline_y"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s.text), "").alias("text"),
        first("x"), first("y"), (F.max_by(F.col("x") + F.col("width"), "pos") - F.min_by("x", "pos")).alias("width"), first("font_size"), first("font_name"),
    )


def lines(word_rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, line_idx, baseline_y, x, width, text): words joined by blanks."""
    keys = keys or PAGE
    ordered = F.array_sort(F.collect_list(F.struct("word_idx", "text")))
    return word_rows.groupBy(*keys, "line_idx").agg(F.first("baseline_y").alias("baseline_y"), F.min_by("x", "word_idx").alias("x"), (F.max_by(F.col("x") + F.col("width"), "word_idx") - F.min_by("x", "word_idx")).alias("width"), F.array_join(F.transform(ordered, lambda w: w.text), " ").alias("text"))


def page_text(line_rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, text): lines joined by line feeds."""
    keys = keys or PAGE
    return line_rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda x: x.text), "\n").alias("text"))


def document_text(page_rows: DataFrame) -> DataFrame:
    """(doc_id, text) of all pages in order."""
    return page_rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "text"))), lambda x: x.text), "\n").alias("text"))


def islands(rows: DataFrame, keys: list[str], order: list, begins) -> DataFrame:
    """Adds island, a number that grows where ``begins`` holds; window functions in it see the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_new", F.when(begins(w), 1).otherwise(0)).withColumn("island", F.sum("_new").over(w)).drop("_new")


def edit_blocks(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Adds block: frames in sequence of one stream and font, near in y and with a gap of -0.1 to 2 sizes."""

    def begins(w):
        last = lambda c: F.lag(c).over(w)
        gap = F.col("x") - last(F.col("x") + F.col("width"))
        same = (F.col("stream") == last("stream")) & (F.col("font_name") == last("font_name")) & (F.abs(F.col("y") - last("y")) <= 0.4 * last("font_size")) & gap.between(-0.1 * last("font_size"), 2.0 * last("font_size"))
        return ~F.coalesce(same, F.lit(False))

    return islands(frames, keys, ["op_idx"], begins).withColumnRenamed("island", "block")
