"""Streams of files and of byte ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_files(spark: SparkSession, path: str, pattern: str = "*.pdf", per_trigger: int = 1000) -> DataFrame:
    """(doc_id, content) of files as they arrive below a path; feed it to ``Pdf``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(path)
    return files.select(F.col("path").alias("doc_id"), "content")


def add_range(have: list[tuple[int, int]], first: int, end: int) -> list[tuple[int, int]]:
    """Sorted disjoint ranges with one more; ranges that overlap or touch become one."""
    out, (a, b) = [], (first, end)
    for x, y in have:
        if y < a or x > b:
            out.append((x, y))
        else:
            a, b = min(a, x), max(b, y)
    return sorted([*out, (a, b)])


def _feed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    have = list(zip(*state.get)) if state.exists else []
    for batch in batches:
        for first, end in zip(batch["first"], batch["end"]):
            if end > first:
                have = add_range(have, int(first), int(end))
    state.update(([a for a, _ in have], [b for _, b in have]))
    yield pd.DataFrame({"doc_id": [key[0]], "n_ranges": [len(have)], "n_bytes": [sum(b - a for a, b in have)]})


def cached_ranges(feeds: DataFrame) -> DataFrame:
    """Running (doc_id, n_ranges, n_bytes) of the byte ranges (doc_id, first, end) fed so far, of each file.

    Keyed state holds the disjoint ranges; touching ones merge.
    """
    return feeds.groupBy("doc_id").applyInPandasWithState(_feed, "doc_id long, n_ranges long, n_bytes long", "firsts array<long>, ends array<long>", "update", GroupStateTimeout.NoTimeout)


def complete(needed: DataFrame, cached: DataFrame) -> DataFrame:
    """(doc_id, ready) of a batch: whether every needed range (doc_id, first, end) is in a cached one."""
    from folio.operators.graph import missing_ranges

    lacking = missing_ranges(needed, cached, ["doc_id"]).select("doc_id").distinct().withColumn("_lacks", F.lit(True))
    return needed.select("doc_id").distinct().join(lacking, "doc_id", "left").select("doc_id", F.col("_lacks").isNull().alias("ready"))
