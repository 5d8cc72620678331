"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

HEADLINE = (
    "rt_page_count rt_plain_text rt_search_literal rt_search_regex rt_metadata rt_redact rt_optimize rt_dedup_streams "
    "k_line_cluster k_range_join_hits k_interval_merge k_asof_label k_matrix_concat g_reachable s_sha256_dedup"
).split()


def measure_rates(spark, sf_dir: str) -> dict[str, int]:
    """Rows a second of each step by itself, from a table that holds the step before."""
    import shutil
    import tempfile

    from folio.operators import layout, search
    from folio.plans.documents import text_documents
    from folio.sources.pdf import Pdf

    at, out = tempfile.mkdtemp(prefix="folio-bench-"), {}

    def step(name: str, df):
        began = time.time()
        df.write.parquet(f"file://{at}/{name}")
        kept = spark.read.parquet(f"file://{at}/{name}")
        out[name] = round(kept.count() / (time.time() - began))
        return kept

    files = step("documents", text_documents(spark, sf_dir))
    step("pages", Pdf(files).pages())
    spans = step("spans", Pdf(files).spans())
    words = step("words", layout.words(layout.lines_of_spans(spans)))
    step("hits", search.search(words, "the"))
    shutil.rmtree(at, ignore_errors=True)
    return out


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pyspark.sql import SparkSession

    from folio.plans import driver

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = driver.queries(), {}
    driver.entry(spark, sf_dir).limit(1).count()  # starts the Python workers
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    rates = measure_rates(spark, sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf.group(1)) if sf else None, "rates_per_second": rates}))


if __name__ == "__main__":
    main()
