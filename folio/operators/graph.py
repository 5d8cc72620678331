"""Closures, inheritance, renumbering and intervals."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_roots: dict[str, SparkSession] = {}


def _root(spark: SparkSession) -> str:
    """This process's folder below the shared checkpoint folder; a private one only where all runs in one process."""
    for at, owner in _roots.items():
        if owner is spark:
            return at
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='folio-checkpoint-')}"
    at = f"{base.rstrip('/')}/folio-graph-{uuid.uuid4().hex}"
    _roots[at] = spark
    return at


@atexit.register
def _clean() -> None:
    for at, spark in _roots.items():
        if spark._jvm is not None and not spark._jsc.sc().isStopped():
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a table in the shared folder: computed once, and safe if executors are lost."""
    path = f"{_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reachable(edges: DataFrame, roots: DataFrame, keys: list[str] | None = None, src: str = "src_obj", dst: str = "dst_obj") -> DataFrame:
    """(keys, dst): all that can be reached from ``roots`` (keys, dst), themselves included.

    Edges are written once. A loop over frontiers: each round joins only what is
    new and writes it.
    """
    keys = keys or ["doc_id"]
    seen = frontier = _cut(roots.select(*keys, dst).distinct())
    step = _cut(edges.select(*keys, F.col(src), F.col(dst)))
    while True:
        found = step.join(frontier.withColumnRenamed(dst, src), [*keys, src]).select(*keys, dst).distinct()
        frontier = _cut(found.join(seen, [*keys, dst], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = _cut(seen.unionByName(frontier))


def unreachable(nodes: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return nodes.join(seen, keys, "left_anti")


def newest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order, as cross-reference sections are merged."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def runs(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, first, count) of runs of consecutive numbers, as subsections are written."""
    w = Window.partitionBy(*keys).orderBy(number) if keys else Window.orderBy(number)
    return rows.withColumn("_run", F.col(number) - F.row_number().over(w)).groupBy(*keys, "_run").agg(F.min(number).alias("first"), F.count("*").alias("count")).drop("_run")


def merge_intervals(rows: DataFrame, keys: list[str], first: str, end: str) -> DataFrame:
    """(keys, first, end): overlapping or touching intervals as one."""
    w = Window.partitionBy(*keys).orderBy(first, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = rows.withColumn("_new", F.when(F.col(first) <= reach, 0).otherwise(1)).withColumn("_i", F.sum("_new").over(w))
    return islands.groupBy(*keys, "_i").agg(F.min(first).alias(first), F.max(end).alias(end)).drop("_i")


def object_lengths(xref: DataFrame, keys: list[str], offset: str = "offset", most: int = 65536) -> DataFrame:
    """Adds est_len: the distance to the next offset, at most ``most``."""
    w = Window.partitionBy(*keys).orderBy(offset)
    return xref.withColumn("est_len", F.least(F.lead(offset).over(w) - F.col(offset), F.lit(most)))


def missing_ranges(needed: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Needed (keys, first, end) that no cached interval contains."""
    # merged intervals are disjoint, so only the last one that begins no later can hold a range
    have = merge_intervals(cached, keys, "first", "end").select(*keys, F.col("first").alias("_a"), F.col("end").alias("_b"))
    marked = governing(needed, have, keys, "first", "_a", ["_b"])
    return marked.where(F.col("_b").isNull() | (F.col("_b") < F.col("end"))).select(*keys, "first", "end").distinct()


def governing(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, columns: list[str], cell: float | None = None) -> DataFrame:
    """Adds the columns of the range with the greatest start at or before each point: an as-of join by one window.

    With ``cell`` places are numbers and a key is cut into cells of that width, so
    a key with very many rows is many windows; what governs at a cell's beginning
    is the last range of the cells before it, one row for each cell.
    """
    place = (lambda c: F.floor(F.col(c) / cell)) if cell else (lambda c: F.lit(0).cast("long"))
    mark = lambda df, kind, by: df.select(*keys, place(by).alias("_cell"), F.col(by).alias("_at"), F.lit(kind).alias("_kind"), *[F.col(c) if c in df.columns else F.lit(None).cast(dict(ranges.dtypes)[c]).alias(c) for c in columns], (F.struct(*points.columns) if kind else F.lit(None).cast(points.select(F.struct(*points.columns).alias("s")).schema[0].dataType)).alias("_row"))
    both = mark(ranges, 0, start).unionByName(mark(points, 1, at))
    w = Window.partitionBy(*keys, "_cell").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_kind") == 0, F.struct(*columns)), ignorenulls=True).over(w)
    found = both.withColumn("_g", last).where("_kind = 1")
    if cell:
        # of equal starts the one that the windows take isn't fixed either
        ends = both.groupBy(*keys, "_cell").agg(F.max_by(F.when(F.col("_kind") == 0, F.struct(*columns)), F.when(F.col("_kind") == 0, F.col("_at"))).alias("_last"))
        before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        same = F.struct(*keys, "_cell")
        carried = ends.select(same.alias("_key"), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
        found = found.withColumn("_own", same).join(carried, F.col("_own").eqNullSafe(F.col("_key")), "left").withColumn("_g", F.coalesce("_g", "_carried"))
    return found.select("_row.*", *[F.col(f"_g.{c}").alias(c) for c in columns])


def inherited(nodes: DataFrame, keys: list[str], node: str, parent: str, value: str, depth: int = 100) -> DataFrame:
    """(keys, node, value): the nearest value at the node or above it; cycles end at ``depth``."""
    tree = nodes.select(*keys, F.col(node).alias("_n"), F.col(parent).alias("_p"), F.col(value).alias("_v"))
    now = _cut(tree.select(*keys, F.col("_n").alias(node), "_p", "_v"))
    up = tree.withColumnsRenamed({"_n": "_u", "_p": "_pp", "_v": "_vv"})
    for _ in range(depth):
        if now.where("_v IS NULL AND _p IS NOT NULL").isEmpty():
            break
        cond = [now[k] == up[k] for k in keys] + [(now["_p"] == up["_u"]) & now["_v"].isNull()]
        whole = cond[0]
        for c in cond[1:]:
            whole = whole & c
        now = _cut(now.join(up, whole, "left").select(*[now[k] for k in keys], now[node], F.when(now["_v"].isNull(), up["_pp"]).otherwise(now["_p"]).alias("_p"), F.coalesce(now["_v"], up["_vv"]).alias("_v")))
    return now.select(*keys, node, F.col("_v").alias(value))
