"""Queries over real files: written from the tables, read back, and compared with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.core import edit, writer
from folio.operators import graph, layout, pdfa, search
from folio.sources.pdf import Pdf, build, text_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt out to all cores if its splits are fewer, or if their rows are uneven.

    A split has the row groups that begin in it, so of a file with few groups most splits are empty.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores, splits = spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if splits >= cores:
        rows = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("split")).count().collect()]  # of the footers
        if max(rows, default=0) * cores <= 1.25 * sum(rows):
            return df
    return df.repartition(max(cores, splits))


def text_documents(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return text_files(table(spark, sf_dir, "documents"), **options)


def _words(files: DataFrame) -> DataFrame:
    return layout.words(layout.lines_of_spans(Pdf(files).spans(*layout.SPAN)))


def _text(files: DataFrame) -> DataFrame:
    return layout.document_text(layout.page_text(layout.lines(_words(files))))


LINES = "unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n"
TEXT = "array_to_string(list_filter(string_split({0}, chr(10)), lambda x: x <> ''), chr(10))"


def rt_plain_text(spark, sf):
    return _text(text_documents(spark, sf))


def rt_page_count(spark, sf):
    return Pdf(text_documents(spark, sf)).docs("page_count")


def rt_lines_per_page(spark, sf):
    return layout.lines(_words(text_documents(spark, sf))).groupBy("doc_id", "page_index").agg(F.count("*").alias("n_lines"))


def rt_search_literal(spark, sf):
    hits = search.search(_words(text_documents(spark, sf)), "the")
    return hits.groupBy("doc_id", "page_index").agg(F.count("*").alias("n_hits"))


def rt_search_nocase(spark, sf):
    hits = search.search(_words(text_documents(spark, sf)), "THE", case_sensitive=False)
    return hits.groupBy("doc_id", "page_index").agg(F.count("*").alias("n_hits"))


def rt_search_regex(spark, sf):
    hits = search.search_regex(_words(text_documents(spark, sf)), "[A-Z][a-z]+")
    return hits.groupBy("doc_id", "page_index").agg(F.count("*").alias("n_hits"))


def rt_search_boxes(spark, sf):
    """Boxes of a literal: a line is one span of 1000/1000 em a character, so its words' boxes follow from positions."""
    hits = search.search(_words(text_documents(spark, sf)), "and")
    return hits.select("doc_id", "page_index", *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")])


def rt_flate_bytes(spark, sf):
    files = build(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id", "text"], lambda _, text: _raw_page(text))
    return Pdf(files).streams().select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.md5("data").alias("md5"))


def _raw_page(text: str) -> bytes:
    b = writer.Builder()
    b.page(text.encode("latin-1"))
    return b.build()


def rt_metadata(spark, sf):
    files = text_documents(spark, sf, info={"Title": "source", "Subject": "lang", "Keywords": "doc_id"})
    return Pdf(files).metadata().select("doc_id", "title", "subject", "keywords")


def _forms(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name", (F.col("c_acctbal") > 0).alias("good"), "c_mktsegment")
    return build(rows, rows.columns, lambda _, name, good, segment: edit.form([{"kind": "Text", "name": "name", "value": name}, {"kind": "Checkbox", "name": "good", "value": good}, {"kind": "Combo", "name": "segment", "value": segment, "options": [segment, "OTHER"]}]))


def rt_form_fields(spark, sf):
    return Pdf(_forms(spark, sf)).form_fields("full_name", "field_type", "value", "checked", "options").select("doc_id", "full_name", "field_type", "value", "checked", F.size("options").alias("n_options"))


def rt_form_fill(spark, sf):
    filled = build(_forms(spark, sf), ["doc_id", "content"], lambda key, data: edit.fill_fields(data, {"name": f"filled {key}", "good": "Yes"}))
    return Pdf(filled).form_fields("full_name", "value", "checked")


def rt_form_flatten(spark, sf):
    flat = build(_forms(spark, sf), ["doc_id", "content"], lambda _, data: edit.flatten_fields(data))
    return Pdf(flat).spans("span_idx", "text")


def rt_fdf_export(spark, sf):
    from folio.functions import text

    fields = Pdf(_forms(spark, sf)).form_fields()
    one = F.concat(F.lit('<field name="'), text.xml_escape(F.col("full_name")), F.lit('"><value>'), text.xml_escape(F.col("value")), F.lit("</value></field>"))
    return fields.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("obj_num", one.alias("x")))), lambda s: s.x), "").alias("xfdf"))


def rt_outline(spark, sf):
    nations = spark.read.parquet(f"{sf}/nation.parquet").groupBy(F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_list("n_name")).alias("below"))
    regions = spark.read.parquet(f"{sf}/region.parquet").join(nations, F.col("r_regionkey") == F.col("k")).select(F.col("r_regionkey").alias("doc_id"), "r_name", "below")
    files = build(regions, regions.columns, lambda _, name, below: edit.outline([(name, below)]))
    return Pdf(files).outline().select("doc_id", "depth", F.element_at("path", -1).alias("place"), "title", "dest_page", "open")


def rt_annotations(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_totalprice", "o_orderpriority")
    empty = _raw_page("")
    files = build(rows, rows.columns, lambda key, price, priority: edit.annotate(empty, 0, "Highlight", (float(key % 500), 10.0, float(key % 500 + 20), 30.0), (0.0, 1.0, 0.0), priority))
    return Pdf(files).annotations("page_index", "subtype", "rect", "color", "contents").select("doc_id", "page_index", "subtype", F.get("rect", 0).alias("x1"), F.get("rect", 2).alias("x2"), F.get("color", 1).alias("green"), "contents")


def rt_redact(spark, sf):
    """The top five lines of the first page go."""
    zone = (0, 0.0, 740 - 14 * 4 - 3.0, 1e9, 800.0)
    files = build(text_documents(spark, sf), ["doc_id", "content"], lambda _, data: edit.redact(data, [zone]))
    return _text(files)


def rt_watermark(spark, sf):
    files = build(text_documents(spark, sf), ["doc_id", "content"], lambda _, data: edit.watermark(data, "DRAFT"))
    spans = Pdf(files).spans("text")
    return spans.groupBy("doc_id").agg(F.count(F.when(F.col("text") == "DRAFT", 1)).alias("n_marks"), F.count("*").alias("n_spans"))


def rt_extract_pages(spark, sf):
    files = build(text_documents(spark, sf), ["doc_id", "content"], lambda _, data: edit.extract_pages(data, 0, 2))
    return _text(files)


def rt_reverse_pages(spark, sf):
    """Pages put in reverse order, one of them turned."""

    def turn(_, data):
        from folio.core.objects import Document

        n = Document(data).page_count()
        return edit.set_page(edit.arrange_pages(data, list(range(n))[::-1]), 0, rotate=90)

    files = build(text_documents(spark, sf), ["doc_id", "content"], turn)
    return Pdf(files).pages().select("doc_id", "page_index", "rotate", "width", "height")


def rt_merge(spark, sf):
    """Ten documents at a time; a group is bounded by its key."""
    files = text_documents(spark, sf).withColumn("part", F.floor(F.col("doc_id") / 10).cast("long"))
    groups = files.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "content"))), lambda s: s.content).alias("all")).withColumnRenamed("part", "doc_id")
    return _text(build(groups, ["doc_id", "all"], lambda _, every: edit.merge(every)))


def rt_pdfa_violations(spark, sf):
    return pdfa.violations(Pdf(text_documents(spark, sf)).facts("fact", "obj_num")).groupBy("rule").agg(F.count("*").alias("n"))


def rt_dedup_streams(spark, sf):
    files = build(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id", "text"], lambda _, text: _raw_page(text))
    keyed = Pdf(files).streams().select("doc_id", F.sha2("data", 256).alias("sha"))
    first = keyed.groupBy("sha").agg(F.min("doc_id").alias("canonical"))
    return keyed.join(first, "sha").select("doc_id", "canonical")


def rt_optimize(spark, sf):
    files = build(text_documents(spark, sf, compress=False), ["doc_id", "content"], lambda _, data: edit.optimize(data))
    return _text(files)


def rt_xref_stream(spark, sf):
    """Object streams and a cross-reference stream with a predictor, read back."""
    pdf = Pdf(text_documents(spark, sf, xref_stream=True))
    entries = pdf.xref().where("obj_num > 0").groupBy("doc_id").agg(F.count(F.when(F.col("kind") == "compressed", 1)).alias("n_packed"))
    return pdf.docs().select("doc_id", "page_count", "encrypted").join(entries, "doc_id")


def rt_incremental(spark, sf):
    """A changed title appended: the newest section wins and the first bytes stay."""
    base = text_documents(spark, sf, info={"Title": "source", "Subject": "lang"})
    changed = build(base, ["doc_id", "content"], lambda key, data: edit.set_info(data, {"Title": f"new {key}"}))
    rows = Pdf(changed).together(metadata=["title", "subject"], xref=["section"]).where(F.size("xref") > 0)
    return rows.select("doc_id", F.inline("metadata"), (F.array_max("xref.section") + 1).alias("n_sections"))


def rt_encrypted(spark, sf):
    """Two methods of encryption over the regions' names."""
    rows = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_regionkey").alias("doc_id"), "r_name", F.explode(F.array(*map(F.lit, ("rc4", "aes128")))).alias("method"))
    rows = rows.select(F.struct("doc_id", "method").alias("doc_id"), "r_name", "method")
    files = build(rows, rows.columns, lambda _, name, method: writer.text_pdf(name, encryption=writer.Encryption(method, b"user", b"owner", -3904, name.encode())))
    pdf = Pdf(files, password="user")
    text = pdf.spans().select("doc_id", "text")
    return pdf.docs().join(text, "doc_id").select("doc_id.doc_id", "doc_id.method", "encrypted", "permission_bits", "text")


def rt_objects(spark, sf):
    return Pdf(text_documents(spark, sf)).objects("type_name").groupBy("type_name").agg(F.count("*").alias("n"))


def rt_refs_closure(spark, sf):
    """Objects that the catalog reaches; all of a fresh file's are."""
    pdf = Pdf(text_documents(spark, sf))
    refs = pdf.refs()
    seen = graph.reachable(refs, refs.where("src_obj = 0").select("doc_id", "dst_obj"))
    return seen.groupBy("doc_id").agg(F.count("*").alias("n_reachable"))


def rt_operator_histogram(spark, sf):
    ops = Pdf(text_documents(spark, sf)).ops("operator")
    return ops.groupBy("operator").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "operator").limit(15)


def rt_display_items(spark, sf):
    items = Pdf(text_documents(spark, sf)).display_items("kind")
    return items.groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def rt_malformed(spark, sf):
    """Truncated files give an error row and no others."""
    half = build(text_documents(spark, sf), ["doc_id", "content"], lambda key, data: data if key % 3 else data[: len(data) // 2])
    return Pdf(half).errors().select("doc_id", "code")


N_LINES = "len(string_split(text, chr(10)))"
PER_PAGE = f"SELECT doc_id, n // 40 AS page_index, line, n % 40 AS place FROM (SELECT doc_id, {LINES} FROM documents)"
FULL = "text IS NOT NULL AND regexp_replace(text, chr(10), '', 'g') <> ''"

ORACLES = {
    "rt_plain_text": f"SELECT doc_id, {TEXT.format('text')} AS text FROM documents WHERE {FULL}",
    "rt_page_count": f"SELECT doc_id, CAST(greatest(1, ceil({N_LINES} / 40.0)) AS INTEGER) AS page_count FROM documents",
    "rt_lines_per_page": f"SELECT doc_id, CAST(page_index AS INTEGER) AS page_index, count(*) AS n_lines FROM ({PER_PAGE}) WHERE line <> '' GROUP BY ALL",
    "rt_search_literal": f"SELECT doc_id, CAST(page_index AS INTEGER) AS page_index, CAST(sum((length(line) - length(replace(line, 'the', ''))) / 3) AS BIGINT) AS n_hits FROM ({PER_PAGE}) WHERE contains(line, 'the') GROUP BY ALL",
    "rt_search_nocase": f"SELECT doc_id, CAST(page_index AS INTEGER) AS page_index, CAST(sum((length(line) - length(replace(lower(line), 'the', ''))) / 3) AS BIGINT) AS n_hits FROM ({PER_PAGE}) WHERE contains(lower(line), 'the') GROUP BY ALL",
    "rt_search_regex": f"SELECT doc_id, CAST(page_index AS INTEGER) AS page_index, CAST(sum(len(regexp_extract_all(line, '[A-Z][a-z]+'))) AS BIGINT) AS n_hits FROM ({PER_PAGE}) WHERE regexp_matches(line, '[A-Z][a-z]+') GROUP BY ALL",
    "rt_search_boxes": f"""SELECT doc_id, CAST(page_index AS INTEGER) AS page_index, round(72.0 + 10.0 * (i - 1), 4) AS x1, round(740.0 - 14.0 * place, 4) AS y1, round(72.0 + 10.0 * (i + 2), 4) AS x2, round(750.0 - 14.0 * place, 4) AS y2
FROM (SELECT *, unnest(range(1, length(line) - 1)) AS i FROM ({PER_PAGE}) WHERE contains(line, 'and')) WHERE substr(line, i, 3) = 'and'""",
    "rt_flate_bytes": "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_bytes, md5(CAST(from_hex(array_to_string(list_transform(string_split(text, ''), lambda c: printf('%02X', unicode(c))), '')) AS BLOB)) AS md5 FROM documents",
    "rt_metadata": "SELECT doc_id, source AS title, lang AS subject, CAST(doc_id AS VARCHAR) AS keywords FROM documents",
    "rt_form_fields": """SELECT c_custkey AS doc_id, 'name' AS full_name, 'Text' AS field_type, c_name AS value, false AS checked, 0 AS n_options FROM customer
UNION ALL SELECT c_custkey, 'good', 'Checkbox', CASE WHEN c_acctbal > 0 THEN 'Yes' ELSE 'Off' END, c_acctbal > 0, 0 FROM customer
UNION ALL SELECT c_custkey, 'segment', 'Combo', c_mktsegment, false, 2 FROM customer""",
    "rt_form_fill": """SELECT c_custkey AS doc_id, 'name' AS full_name, 'filled ' || c_custkey AS value, false AS checked FROM customer UNION ALL SELECT c_custkey, 'good', 'Yes', true FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment, false FROM customer""",
    "rt_form_flatten": "SELECT c_custkey AS doc_id, 0 AS span_idx, c_name AS text FROM customer UNION ALL SELECT c_custkey, 1, c_mktsegment FROM customer",
    "rt_fdf_export": """SELECT c_custkey AS doc_id, '<field name="name"><value>' || c_name || '</value></field><field name="good"><value>' || CASE WHEN c_acctbal > 0 THEN 'Yes' ELSE 'Off' END || '</value></field><field name="segment"><value>' || c_mktsegment || '</value></field>' AS xfdf FROM customer""",
    "rt_outline": """SELECT r_regionkey AS doc_id, 0 AS depth, 0 AS place, r_name AS title, 0 AS dest_page, true AS open FROM region
UNION ALL SELECT n_regionkey, 1, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS INTEGER), n_name, 0, false FROM nation""",
    "rt_annotations": "SELECT o_orderkey AS doc_id, 0 AS page_index, 'Highlight' AS subtype, CAST(o_orderkey % 500 AS DOUBLE) AS x1, CAST(o_orderkey % 500 + 20 AS DOUBLE) AS x2, 1.0::DOUBLE AS green, o_orderpriority AS contents FROM orders",
    "rt_redact": f"SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM (SELECT doc_id, {LINES} FROM documents) WHERE line <> '' AND n >= 5 GROUP BY doc_id",
    "rt_watermark": f"SELECT doc_id, CAST(greatest(1, ceil({N_LINES} / 40.0)) AS BIGINT) AS n_marks, CAST(greatest(1, ceil({N_LINES} / 40.0)) + len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS BIGINT) AS n_spans FROM documents",
    "rt_extract_pages": f"SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM (SELECT doc_id, {LINES} FROM documents) WHERE line <> '' AND n < 80 GROUP BY doc_id",
    "rt_reverse_pages": f"SELECT doc_id, CAST(p AS INTEGER) AS page_index, CASE WHEN p = 0 THEN 90 ELSE 0 END AS rotate, CASE WHEN p = 0 THEN 792.0::DOUBLE ELSE 612.0::DOUBLE END AS width, CASE WHEN p = 0 THEN 612.0::DOUBLE ELSE 792.0::DOUBLE END AS height FROM (SELECT doc_id, unnest(range(CAST(greatest(1, ceil({N_LINES} / 40.0)) AS BIGINT))) AS p FROM documents)",
    "rt_merge": f"SELECT doc_id // 10 AS doc_id, string_agg(line, chr(10) ORDER BY d, n) AS text FROM (SELECT doc_id, doc_id AS d, {LINES} FROM documents) WHERE line <> '' GROUP BY ALL",
    "rt_pdfa_violations": "SELECT rule, (SELECT count(*) FROM documents) AS n FROM (VALUES ('6.2.3'), ('6.7.2')) t(rule)",
    "rt_dedup_streams": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents",
    "rt_optimize": f"SELECT doc_id, {TEXT.format('text')} AS text FROM documents WHERE {FULL}",
    "rt_xref_stream": f"SELECT doc_id, CAST(greatest(1, ceil({N_LINES} / 40.0)) AS INTEGER) AS page_count, false AS encrypted, CAST(3 + greatest(1, ceil({N_LINES} / 40.0)) AS BIGINT) AS n_packed FROM documents",
    "rt_incremental": "SELECT doc_id, 'new ' || doc_id AS title, lang AS subject, 2 AS n_sections FROM documents",
    "rt_encrypted": "SELECT r_regionkey AS doc_id, method, true AS encrypted, -3904 AS permission_bits, r_name AS text FROM region, (VALUES ('rc4'), ('aes128')) t(method)",
    "rt_objects": f"SELECT type_name, CAST(sum(k) AS BIGINT) AS n FROM (SELECT unnest(['Catalog', 'Pages', 'Font', 'Page', NULL]) AS type_name, unnest([1, 1, 1, p, p]) AS k FROM (SELECT CAST(greatest(1, ceil({N_LINES} / 40.0)) AS BIGINT) AS p FROM documents)) GROUP BY ALL",
    "rt_refs_closure": f"SELECT doc_id, CAST(3 + 2 * greatest(1, ceil({N_LINES} / 40.0)) AS BIGINT) AS n_reachable FROM documents",
    "rt_operator_histogram": f"SELECT operator, CAST(sum(k) AS BIGINT) AS n FROM (SELECT unnest(['BT', 'ET', 'Tf', 'Tm', 'Tj']) AS operator, unnest([p, p, p, l, l]) AS k FROM (SELECT CAST(greatest(1, ceil({N_LINES} / 40.0)) AS BIGINT) AS p, len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS l FROM documents)) GROUP BY ALL",
    "rt_display_items": f"SELECT doc_id, 'text' AS kind, CAST(len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS BIGINT) AS n FROM documents WHERE {FULL}",
    "rt_malformed": "SELECT doc_id, 'InvalidXref' AS code FROM documents WHERE doc_id % 3 = 0",
}

QUERIES = {name: globals()[name] for name in ORACLES}
