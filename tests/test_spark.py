import hashlib

import pytest
from pyspark.sql import functions as F

from folio.core import writer
from folio.functions import color, geometry, text
from folio.operators import graph, layout, search
from folio.plans import kernels
from folio.sources.datasource import register
from folio.sources.pdf import Pdf, read_files, save, text_files
from folio.streaming.files import add_range, cached_ranges, complete

DOCS = [(1, "Page one\nthe end", "a"), (2, "", "b"), (3, None, None), (4, "aaa aa\n" * 50, "c")]


@pytest.fixture(scope="module")
def files(spark):
    return text_files(spark.createDataFrame(DOCS, "doc_id long, text string, title string"), info={"Title": "title"})


def words_of(files):
    return layout.words(layout.lines_of_spans(Pdf(files).spans()))


def test_files_through_a_folder(spark, files, tmp_path):
    save(files, str(tmp_path))
    got = Pdf(read_files(spark, f"file://{tmp_path}")).docs().select("page_count").orderBy("page_count").collect()
    assert [r[0] for r in got] == [1, 1, 1, 2]
    register(spark)
    table = spark.read.format("folio").option("path", str(tmp_path)).option("relation", "spans").load()
    one = table.where(F.col("doc_id") == f"{tmp_path}/1.pdf")
    assert [r.text for r in one.orderBy("span_idx").collect()] == ["Page one", "the end"]
    (tmp_path / "broken.pdf").write_bytes(b"junk")
    reader = spark.read.format("folio").option("path", str(tmp_path))
    assert [r.code for r in reader.option("relation", "errors").load().collect()] == ["InvalidXref"]
    few = reader.option("relation", "docs").option("partition_bytes", 150_000).load()
    assert few.count() == 4 and few.rdd.getNumPartitions() in (3, 5)


def test_files_over_the_limit_give_an_error_row(spark, files, tmp_path):
    save(files, str(tmp_path))
    most = max((tmp_path / f"{i}.pdf").stat().st_size for i in (1, 2, 3))
    pdf = Pdf(read_files(spark, f"file://{tmp_path}", max_bytes=most))
    assert pdf.docs().count() == 3 and pdf.files.where("content IS NULL").count() == 1
    assert [(r.doc_id[-6:], r.code) for r in pdf.errors().collect()] == [("/4.pdf", "FileTooLarge")]


def test_only_one_exchange_for_search(files):
    plan = search.search(words_of(files), "the")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_search(files):
    words = words_of(files)
    hits = search.search(words, "aa").groupBy("doc_id").count().collect()
    assert [(r.doc_id, r["count"]) for r in hits] == [(4, 150)]
    assert search.search(words, "").count() == 0
    r = search.search(words, "ONE", case_sensitive=False).first()
    assert (r.x1, r.y1, r.x2, r.y2, r.text) == (122.0, 740.0, 152.0, 750.0, "Page one")
    assert search.search_regex(words, r"Page\s+\w+").count() == 1
    with pytest.raises(ValueError):
        search.search_regex(words, r"(?=x)")


def test_search_of_any_characters(spark):
    rows = [(1, "x a\\Eb \\Q(.*) y"), (2, "İİİabc ABC"), (3, "straße STRASSE"), (4, "aXaxa")]
    words = words_of(text_files(spark.createDataFrame([(i, t.replace("İ", "Ì")) for i, t in rows], "doc_id long, text string")))
    hits = lambda q, **k: sorted((r.doc_id, r.hit_idx) for r in search.search(words, q, **k).collect())
    assert hits("a\\Eb") == [(1, 0)] and hits("\\Q(.*)") == [(1, 0)]
    assert hits("ÌABC", case_sensitive=False) == [(2, 0)] and hits("abc", case_sensitive=False) == [(2, 0), (2, 1)]
    assert hits("SSE", case_sensitive=False) == [(3, 0)] and hits("axa", case_sensitive=False) == [(4, 0), (4, 1)]
    odd = words.withColumn("text", F.regexp_replace("text", "Ì", "İ"))
    (r,) = search.search(odd, "ABC", case_sensitive=False).where("doc_id = 2 AND hit_idx = 0").collect()
    assert (r.x1, r.x2) == (72.0 + 30, 72.0 + 60)


def test_regex_hits_of_many_pages(files):
    words = words_of(files)
    assert search.search_regex(words, "a+").groupBy("doc_id").count().collect()[0]["count"] > 50
    assert search.search_regex(words, "AA", case_sensitive=False).where("doc_id = 4").count() == 100
    assert search.search_regex(words, "nowhere").count() == 0


@pytest.mark.parametrize("cell", [None, 1, 7, 1000])
def test_governing_ranges(spark, cell):
    points = [(k, at) for k in (1, 2, None) for at in range(-5, 120, 3)]
    ranges = [(1, 0, "a"), (1, 30, "b"), (1, 31, "c"), (1, 100, "d"), (2, 50, "e"), (None, 9, "f")]
    got = graph.governing(spark.createDataFrame(points, "k int, at int"), spark.createDataFrame(ranges, "k int, start int, name string"), ["k"], "at", "start", ["name"], cell=cell)
    want = [(k, at, max(((s, n) for r, s, n in ranges if r == k and s <= at), default=(0, None))[1]) for k, at in points]
    assert sorted(((r.k, r.at, r.name) for r in got.collect()), key=str) == sorted(want, key=str)


def test_missing_ranges(spark):
    cached = spark.createDataFrame([(1, 0, 10), (1, 10, 30), (1, 50, 60), (2, 5, 6)], "k int, first long, end long")
    needed = spark.createDataFrame([(1, 0, 30), (1, 0, 31), (1, 40, 41), (1, 50, 55), (1, 50, 55), (2, 5, 6), (2, 0, 1), (3, 1, 2)], "k int, first long, end long")
    assert sorted(tuple(r) for r in graph.missing_ranges(needed, cached, ["k"]).collect()) == [(1, 0, 31), (1, 40, 41), (2, 0, 1), (3, 1, 2)]


def test_errors_and_passwords(spark):
    key = writer.Encryption("rc4", b"u", b"o", -44, b"s")
    rows = [(1, writer.text_pdf("x", encryption=key), "u"), (2, writer.text_pdf("x", encryption=key), "bad"), (3, b"junk", ""), (4, None, "")]
    pdf = Pdf(spark.createDataFrame(rows, "doc_id int, content binary, pw string"), password_column="pw")
    assert [r.doc_id for r in pdf.docs().collect()] == [1]
    assert {(r.doc_id, r.code) for r in pdf.errors().collect()} == {(2, "InvalidPassword"), (3, "InvalidXref"), (4, "InvalidXref")}
    with pytest.raises(Exception):
        Pdf(pdf.files.withColumn("pw", F.col("_password")), strict=True).docs().collect()


def test_greedy_lines_are_not_gaps(spark):
    """A span joins a line by its distance to the line's first span, so a slope breaks where gaps wouldn't."""
    spans = spark.createDataFrame([(1, 0, i, f"s{i}", float(i), 100.0 - 4 * i, 1.0, 10.0) for i in range(5)], "doc_id int, page_index int, span_idx int, text string, x double, y double, width double, font_size double")
    got = layout.lines_of_spans(spans).orderBy("span_idx").collect()
    assert [r.line_idx for r in got] == [0, 0, 1, 1, 2]


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first().c


def test_expressions(spark):
    lit = F.lit
    assert [one(spark, text.roman(lit(n))) for n in (1, 4, 1994, 4999, 5000, 0)] == ["I", "IV", "MCMXCIV", "MMMMCMXCIX", "5000", "0"]
    assert [one(spark, text.alpha(lit(n))) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert one(spark, text.pdf_date(lit("D:2024"))).asDict() == {"year": 2024, "month": 1, "day": 1, "hour": 0, "minute": 0, "second": 0, "tz_sign": None, "tz_hour": 0, "tz_minute": 0}
    assert one(spark, text.pdf_date(lit("junk"))) is None
    assert one(spark, text.decode_text(text.encode_text(lit("a中")))) == "a中" and one(spark, text.decode_text(lit(b"\xef\xbb\xbfx\xc3\xa9"))) == "xé"
    assert one(spark, text.xml_unescape(text.xml_escape(lit("<&amp;>\"'")))) == "<&amp;>\"'"
    assert one(spark, text.strip_subset(lit("ABCDEF+Font"))) == "Font" and one(spark, text.real(lit(0.5))) == "0.5" and one(spark, text.real(lit(-0.0))) == "0"
    assert one(spark, F.array(*color.cmyk(lit(0.0), lit(0.5), lit(1.0), lit(0.0)))) == [255, 127, 0]
    m = tuple(map(lit, (2.0, 0.0, 0.0, 4.0, 1.0, 1.0)))
    assert one(spark, F.array(*geometry.inverse(m))) == [0.5, 0.0, 0.0, 0.25, -0.5, -0.25]
    assert len(one(spark, geometry.tiles(lit(100.0), lit(50.0), 40.0))) == 6


def test_text_strings_run_over_whole_texts(spark, tmp_path):
    texts = ["x" * 60 + "中", "x" * 60 + "é", "þÿab", "ï»¿x", "line\n", "line\u2028", "a😀", "", None, "þ" * 5000]
    rows = [(2 * i + odd, t) for i, t in enumerate(texts) for odd in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_bytes, r.n_chars, r.md5) for r in kernels.s_text_strings_whole(spark, str(tmp_path)).collect()}
    for i, t in rows:
        t = t if t is None or i % 2 == 0 else t + "中"
        latin = t is not None and max(t, default="") <= "ÿ" and not t.startswith(("þÿ", "ï»¿"))
        assert got[i] == ((None, None, None) if t is None else (len(t) if latin else 2 + len(t.encode("utf-16-be")), len(t), hashlib.md5(t.encode()).hexdigest()))


def test_graph(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 5, 6), (2, 1, 9)], "doc_id int, src_obj int, dst_obj int")
    roots = spark.createDataFrame([(1, 1)], "doc_id int, dst_obj int")
    assert sorted(r.dst_obj for r in graph.reachable(edges, roots).collect()) == [1, 2, 3]
    ranges = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 12), (1, 3, 4)], "k int, a int, b int")
    assert sorted((r.a, r.b) for r in graph.merge_intervals(ranges, ["k"], "a", "b").collect()) == [(0, 7), (9, 12)]


def test_subsections_take_every_order(spark, tmp_path):
    rows = [(7 * n, c) for n, c in enumerate([1, 2, 3, 3, 4, 6])]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {(r.in_use, r["first"], r["count"]) for r in kernels.k_xref_subsections_all(spark, str(tmp_path)).collect()}
    assert got == {(True, 0, 2), (False, 2, 2), (True, 4, 1), (False, 5, 1)}


def test_ranges_as_a_stream(spark, tmp_path):
    assert add_range([(0, 5), (10, 20)], 5, 10) == [(0, 20)] and add_range([(5, 6)], 0, 2) == [(0, 2), (5, 6)]
    feeds = spark.createDataFrame([(1, 0, 10), (1, 10, 30), (1, 50, 60), (2, 5, 6)], "doc_id long, first long, end long")
    feeds.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(feeds.schema).parquet(str(tmp_path / "in"))
    q = cached_ranges(stream).writeStream.outputMode("update").format("memory").queryName("ranges").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.doc_id, r.n_ranges, r.n_bytes) for r in spark.table("ranges").collect()} == {(1, 2, 40), (2, 1, 1)}
    needed = spark.createDataFrame([(1, 2, 25), (1, 55, 58), (2, 5, 9)], "doc_id long, first long, end long")
    assert {(r.doc_id, r.ready) for r in complete(needed, feeds).collect()} == {(1, True), (2, False)}
