"""Queries of value-level and relational kernels over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.core import filters
from folio.functions import color, editing, geometry, text
from folio.operators import graph, layout, search
from folio.sources.pdf import flat_map


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _seconds(c: str):
    return F.unix_seconds(F.col(c).cast("timestamp"))


def _r(c, digits: int = 6):
    return F.round(c, digits)


def k_gap_merge_words(spark, sf):
    """Events of a user as spans on a line of seconds: words where gaps are small."""
    e = read(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.lit(0).alias("page_index"), F.lit(0).alias("line_idx"), F.col("event_id").alias("pos"), _seconds("ts").cast("double").alias("x"), F.lit(60.0).alias("width"), F.lit(12000.0).alias("font_size"), F.lit("f").alias("font_name"), F.lit(0.0).alias("y"), F.lit(0.0).alias("baseline_y"), F.lit("e").alias("text"))
    ranked = e.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("x", "pos")))
    return layout.words(ranked).select(F.col("doc_id").alias("user_id"), F.col("word_idx").cast("long").alias("word_idx"), F.length("text").cast("long").alias("n"), "x")


def k_line_cluster(spark, sf):
    """The greedy fold over lineitems of an order as spans."""
    li = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.col("l_linenumber").alias("span_idx"), F.col("l_quantity").alias("y"), F.col("l_linenumber").cast("double").alias("x"), F.lit(1.0).alias("width"), F.lit(10.0).alias("font_size"))
    return layout.lines_of_spans(li).select("doc_id", "span_idx", "line_idx", "baseline_y")


def k_block_group(spark, sf):
    """Turns of a conversation as frames: a new block where the role changes."""
    c = read(spark, sf, "conversations").select("conv_id", F.col("turn").alias("op_idx"), F.lit(0).alias("stream"), F.col("role").alias("font_name"), F.lit(0.0).alias("y"), F.col("turn").cast("double").alias("x"), F.lit(1.0).alias("width"), F.lit(10.0).alias("font_size"))
    return layout.edit_blocks(c, ["conv_id"]).groupBy("conv_id", F.col("block").cast("long").alias("block")).agg(F.count("*").alias("n"), F.min("op_idx").alias("first"))


def k_range_join_hits(spark, sf):
    """Line items as intervals of days against zones of the same supplier's orders."""
    li = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber", (_seconds("l_shipdate") / 86400).alias("lo"))
    li = li.withColumn("hi", F.col("lo") + F.col("l_linenumber"))
    zones = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), (F.lit(8401.0) + F.col("s_suppkey") % 10 * 200).alias("a")).withColumn("b", F.col("a") + 300.5)
    return search.range_join(li, zones, ["k"], "lo", "hi", "a", "b", 64.0).select("k", "l_orderkey", "l_linenumber")


def k_rects_intersect(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 50).cast("double").alias("x"), (F.col("p_retailprice") % 40).alias("y"), F.col("p_size").cast("double").alias("s"))
    hit = geometry.intersects((F.col("x"), F.col("y"), F.col("x") + F.col("s"), F.col("y") + F.col("s")), (F.lit(20.0), F.lit(10.0), F.lit(30.0), F.lit(25.0)))
    return p.where(hit).select("p_partkey")


def k_page_label(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, ("D", "R", "r", "A", "a"))), (F.col("p_partkey") % 5 + 1).cast("int")).alias("style"))
    n = (F.col("p_partkey") % 900 + 1).cast("int")
    return p.select("p_partkey", text.page_label(F.col("style"), F.lit("p-"), n).alias("label"))


def k_asof_label(spark, sf):
    """The governing range of each order's day: the supplier range with the greatest start."""
    points = read(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("g"), F.col("o_totalprice").alias("at"))
    ranges = read(spark, sf, "supplier").select((F.col("s_suppkey") % 10).alias("g"), (F.col("s_suppkey") * 700).cast("double").alias("start"), "s_name")
    return graph.governing(points, ranges, ["g"], "at", "start", ["s_name"], cell=20_000).select("o_orderkey", "s_name")


def k_pdf_date(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("+05'30'")).alias("d"))
    p = text.pdf_date(F.col("d"))
    return o.select("o_orderkey", p.alias("p")).select("o_orderkey", "p.year", "p.month", "p.day", "p.hour", "p.minute", "p.second", "p.tz_sign", "p.tz_hour", "p.tz_minute")


def k_utc_time(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", text.utc_time(F.col("o_orderdate")).alias("t"))


def k_cmyk_to_rgb(spark, sf):
    r, g, b = color.cmyk(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, F.col("l_linenumber") / 10)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r"), g.alias("g"), b.alias("b"))


def k_blend_modes(spark, sf):
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("s"), (F.col("l_quantity") / 50).alias("d"))
    return li.select("l_orderkey", "l_linenumber", *[_r(color.blend(m, F.col("s"), F.col("d"))).alias(m.lower()) for m in ("Normal", "Multiply", "Screen", "Darken", "Lighten", "Overlay")], _r(color.over(F.col("s"), F.lit(0.25), F.col("d"))).alias("over"))


def k_shading_eval(spark, sf):
    t = F.col("l_quantity") / 50
    part = lambda c0, c1, n: lambda x: geometry.exponential(x, F.lit(c0), F.lit(c1), F.lit(n))
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", t.alias("t"))
    return li.select("l_orderkey", "l_linenumber", _r(geometry.exponential(F.col("t"), F.lit(0.2), F.lit(0.9), F.lit(2.0))).alias("exponential"), _r(geometry.stitch(F.col("t"), [0.5], [(0.0, 1.0), (1.0, 0.0)], (0.0, 1.0), [part(0.0, 1.0, 1.0), part(0.0, 1.0, 2.0)])).alias("stitched"), _r(geometry.axial(F.col("t"), F.lit(0.5), 0.0, 0.0, 2.0, 1.0)).alias("axial"))


def _matrix():
    return tuple(F.col(c) for c in ("l_quantity", "l_discount", "l_tax", "l_quantity", "l_extendedprice", "l_discount"))


def k_matrix_concat(spark, sf):
    n = tuple(map(F.lit, (2.0, 1.0, -1.0, 0.5, 3.0, 4.0)))
    out = geometry.concat(_matrix(), n)
    x, y = geometry.transform_point(_matrix(), F.lit(2.0), F.lit(3.0))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[_r(c, 4).alias(k) for k, c in zip("abcdef", out)], _r(x, 4).alias("x"), _r(y, 4).alias("y"))


def k_matrix_inverse(spark, sf):
    a, b, c, d, e, f = geometry.inverse(_matrix())
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _r(a, 5).alias("a"), _r(c, 12).alias("c"), _r(geometry.shear(_matrix()), 5).alias("shear"))


def k_tile_grid(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", (F.col("p_size") * 10.0).alias("w"), (F.col("p_retailprice") / 4).alias("h"))
    t = p.select("p_partkey", F.explode(geometry.tiles(F.col("w"), F.col("h"), 150.0)).alias("t"))
    return t.select("p_partkey", "t.col", "t.row", "t.x", "t.y", _r("t.w").alias("w"), _r("t.h").alias("h"))


def k_quad_bounds(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.array(*[F.col("p_size") * k + F.col("p_partkey") % m for k, m in ((1.0, 7), (2.0, 5), (3.0, 11), (0.5, 3), (0.0, 13), (1.5, 2), (2.5, 9), (4.0, 4))]).alias("q"))
    x1, y1, x2, y2 = geometry.quad_bounds(F.col("q"))
    return p.select("p_partkey", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), F.size(geometry.quads(F.col("q"))).alias("n"))


def k_permissions(spark, sf):
    p = (F.col("l_partkey") % 4096).cast("int")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.permissions(p).alias("p")).select("l_orderkey", "l_linenumber", "p.*")


def _coded(spark, sf, code):
    """Names coded and decoded again by a filter, in Arrow batches."""
    rows = read(spark, sf, "customer").select("c_custkey", F.encode("c_name", "UTF-8").alias("raw"))
    return flat_map(rows, ["c_custkey", "raw"], "back string, n_coded int", lambda _, raw: iter([code(raw)]))


def k_asciihex(spark, sf):
    c = read(spark, sf, "customer")
    return c.select("c_custkey", F.decode(text.ascii_hex_decode(F.concat(F.lower(F.hex(F.encode("c_name", "UTF-8"))), F.lit(" \n>"))), "UTF-8").alias("back"))


def k_ascii85(spark, sf):
    return _coded(spark, sf, lambda raw: (filters.decode("ASCII85Decode", x := filters.encode_ascii85(raw)).decode(), len(x)))


def k_runlength(spark, sf):
    return _coded(spark, sf, lambda raw: (filters.decode("RunLengthDecode", filters.encode_run_length(raw)).decode(), len(raw)))


def k_tiff_predictor(spark, sf):
    """Running sums modulo 256 of an order's line numbers, as the predictor undoes differences."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.sum(F.col("l_partkey") % 256).over(w) % 256).alias("byte"))


def k_interval_merge(spark, sf):
    e = read(spark, sf, "events").select("user_id", _seconds("ts").alias("first")).withColumn("end", F.col("first") + 7200)
    return graph.merge_intervals(e, ["user_id"], "first", "end")


def k_needed_ranges(spark, sf):
    o = read(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("k"), (F.col("o_orderkey") * 10).alias("first"), "o_orderstatus")
    cached = o.where("o_orderstatus = 'O'").select("k", "first", (F.col("first") + 500).alias("end"))
    needed = o.where("o_orderstatus <> 'O'").select("k", "first", (F.col("first") + 40).alias("end"))
    return graph.missing_ranges(needed, cached, ["k"])


def k_object_len(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") * 37).alias("offset"))
    return graph.object_lengths(o, ["o_custkey"])


def k_xref_newest_wins(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return graph.newest(o, ["o_custkey", "o_orderstatus"], [F.desc("o_orderkey")])


def k_xref_subsections_all(spark, sf):
    """Runs over all orders, in use or free."""
    o = read(spark, sf, "orders").select((F.col("o_orderkey") % 7).alias("g"), (F.col("o_custkey") % 3 != 0).alias("in_use"), F.floor(F.col("o_orderkey") / 7).alias("n"))
    return graph.runs(o, ["g", "in_use"], "n")


def _edges(spark, sf):
    """region -> nation -> customer -> orders, as references between numbers."""
    n, c, o = (read(spark, sf, t) for t in ("nation", "customer", "orders"))
    edge = lambda df, a, b: df.select(F.lit(0).alias("doc_id"), a.alias("src_obj"), b.alias("dst_obj"))
    nation = lambda x: F.lit(100) + F.col(x).cast("long")
    customer = lambda x: F.lit(1000) + F.col(x)
    return edge(n, F.col("n_regionkey").cast("long"), nation("n_nationkey")).unionByName(edge(c, nation("c_nationkey"), customer("c_custkey"))).unionByName(edge(o, customer("o_custkey"), F.lit(10_000_000) + F.col("o_orderkey")))


def _seen(spark, sf):
    return graph.reachable(_edges(spark, sf), spark.range(1).select(F.lit(0).alias("doc_id"), F.lit(1).cast("long").alias("dst_obj")))


def g_reachable(spark, sf):
    return _seen(spark, sf).select("dst_obj")


def g_unreachable(spark, sf):
    nodes = _edges(spark, sf).select("doc_id", "dst_obj").distinct()
    return graph.unreachable(nodes, _seen(spark, sf), ["doc_id", "dst_obj"]).select("dst_obj")


def g_inherit_attr(spark, sf):
    """A balance above 9000 is a customer's own value, else the nation's name, else the region's."""
    r = read(spark, sf, "region").select(F.lit(0).alias("doc_id"), F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("v"))
    n = read(spark, sf, "nation").select(F.lit(0).alias("doc_id"), F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("v"))
    c = read(spark, sf, "customer").select(F.lit(0).alias("doc_id"), F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.when(F.col("c_acctbal") > 9000, F.col("c_name")).alias("v"))
    return graph.inherited(r.unionByName(n).unionByName(c), ["doc_id"], "node", "parent", "v").select("node", "v")


def g_remap_offset(spark, sf):
    """Offsets of merged documents: the sum of the sizes before; sources are few."""
    d = read(spark, sf, "documents").groupBy("source").agg(F.max("doc_id").alias("size"))
    w = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    return d.select("source", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("offset"))


def g_name_tree_last_wins(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return graph.newest(e, ["user_id", "event_type"], [F.desc("event_id")]).select("user_id", "event_type", "value")


def g_permission_filter(spark, sf):
    o = read(spark, sf, "orders")
    p = F.when(F.col("o_orderstatus") != "F", (F.col("o_custkey") % 64).cast("int"))
    return o.where(text.allowed(p, "copy_text")).select("o_orderkey")


def s_sha256_dedup(spark, sf):
    keyed = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    first = keyed.groupBy("sha").agg(F.min("doc_id").alias("canonical"))
    return keyed.join(first, "sha").select("doc_id", "canonical", "sha")


def s_operator_histogram(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(15)


def s_html_text(spark, sf):
    body = F.regexp_replace(F.regexp_replace("html", r"<(script|style)[^>]*>[^<]*</(script|style)>", " "), r"<[^>]*>", " ")
    return read(spark, sf, "pages").select("page_id", F.trim(F.regexp_replace(body, r"[ \n\t\r]+", " ")).alias("text"))


def s_xml_escape(spark, sf):
    p = read(spark, sf, "pages").select("page_id", text.xml_escape(F.col("html")).alias("escaped"))
    return p.select("page_id", F.md5("escaped").alias("md5"), F.md5(text.xml_unescape(F.col("escaped"))).alias("back"))


def s_text_strings_whole(spark, sf):
    """Whole texts coded in Latin-1 or UTF-16 and decoded; every second one ends with a character outside Latin-1."""
    t = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("中")))
    coded = read(spark, sf, "documents").select("doc_id", text.encode_text(t).alias("raw")).withColumn("back", text.decode_text(F.col("raw")))
    return coded.select("doc_id", F.octet_length("raw").alias("n_bytes"), F.length("back").cast("long").alias("n_chars"), F.md5("back").alias("md5"))


def s_real_and_name(spark, sf):
    li = read(spark, sf, "lineitem")
    names = F.concat(F.col("l_returnflag"), F.lit(" ("), F.col("l_linestatus"), F.lit(")#é"))
    return li.select("l_orderkey", "l_linenumber", text.real(F.col("l_discount") - 0.05).alias("real"), text.pdf_name(names).alias("name"))


def k_caret_offsets(spark, sf):
    """Carets of an order's quantities as advances, and the one nearest to 40."""
    o = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda s: s.l_quantity).alias("w"))
    c = o.select("l_orderkey", editing.caret_offsets(F.col("w")).alias("c"), editing.text_width(F.col("w")).alias("width"))
    return c.select("l_orderkey", "width", editing.hit_test(F.col("c"), F.lit(40.0)).alias("hit"))


def k_decorations(spark, sf):
    return read(spark, sf, "part").select("p_partkey", editing.decoration(F.col("p_size").cast("double")).alias("d")).select("p_partkey", _r("d.thickness").alias("thickness"), _r("d.underline").alias("underline"), _r("d.strike").alias("strike"))


def k_wrap_lines(spark, sf):
    """Part names wrapped to 12 characters: joined again they are the name, and no line of words that fit is too long."""
    lines = editing.wrap(F.col("p_name"), F.lit(120.0), 10.0)
    p = read(spark, sf, "part").select("p_partkey", lines.alias("l"))
    return p.select("p_partkey", F.array_join("l", " ").alias("name"), F.exists("l", lambda x: (F.length(x) > 12) & x.contains(" ")).alias("too_long"))


def k_wrap_greedy(spark, sf):
    """Names, types and brands broken into lines of 12 characters, against a fold over words."""
    lines = editing.wrap(F.concat_ws(" ", "p_name", "p_type", "p_brand"), F.lit(120.0), 10.0)
    return read(spark, sf, "part").select("p_partkey", F.array_join(lines, "|").alias("lines"))


def k_xfdf_import(spark, sf):
    name = F.concat(F.col("c_name"), F.lit(" <&> \""))
    x = F.concat(F.lit('<xfdf><fields><field name="n"><value>'), text.xml_escape(name), F.lit('</value></field><field name="empty"></field><field name="s"><value>'), F.col("c_mktsegment"), F.lit("</value></field></fields></xfdf>"))
    return read(spark, sf, "customer").select("c_custkey", F.explode(editing.xfdf_fields(x)).alias("f")).select("c_custkey", "f.name", "f.value")


def k_xmp(spark, sf):
    packet = F.concat(F.lit("<x><dc:title><rdf:Alt><rdf:li xml:lang='x-default'>"), F.col("source"), F.lit("</rdf:li></rdf:Alt></dc:title><pdf:Producer>"), F.col("lang"), F.lit("</pdf:Producer></x>"))
    return read(spark, sf, "documents").select("doc_id", editing.xmp(packet).alias("m")).select("doc_id", "m.title", "m.producer", "m.creator")


def x_event_windows(spark, sf):
    """Tumbling windows; Spark's own, not part of the document engine."""
    e = read(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n")


_XML = "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_ROMAN = "repeat('M', n // 1000) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1]"

ORACLES = {
    "k_gap_merge_words": """SELECT user_id, word_idx, count(*) AS n, min(x) AS x FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY x, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS word_idx FROM (SELECT user_id, event_id, x, CASE WHEN x - (lag(x) OVER (PARTITION BY user_id ORDER BY x, event_id) + 60) < 3600 THEN 0 ELSE 1 END AS new FROM (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS DOUBLE) AS x FROM events))) GROUP BY ALL""",
    "k_line_cluster": """WITH RECURSIVE o AS (SELECT l_orderkey AS d, l_linenumber AS s, l_quantity AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS r FROM lineitem),
f AS (SELECT d, r, [y] AS anchors, 1 AS line, s FROM o WHERE r = 1
UNION ALL SELECT o.d, o.r, CASE WHEN len(list_filter(anchors, lambda a: abs(o.y - a) <= 5)) > 0 THEN anchors ELSE list_append(anchors, o.y) END,
  CASE WHEN len(list_filter(anchors, lambda a: abs(o.y - a) <= 5)) > 0 THEN list_position(anchors, list_filter(anchors, lambda a: abs(o.y - a) <= 5)[1]) ELSE len(anchors) + 1 END, o.s FROM f JOIN o ON o.d = f.d AND o.r = f.r + 1)
SELECT d AS doc_id, s AS span_idx, CAST(line - 1 AS INTEGER) AS line_idx, anchors[line] AS baseline_y FROM f""",
    "k_block_group": """SELECT conv_id, block, count(*) AS n, min(turn) AS first FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS block FROM (SELECT conv_id, turn, CASE WHEN role = lag(role) OVER w AND turn - (lag(turn) OVER w + 1) BETWEEN -1 AND 20 THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))) GROUP BY ALL""",
    "k_range_join_hits": """SELECT s_suppkey AS k, l_orderkey, l_linenumber FROM (SELECT *, epoch(l_shipdate) / 86400 AS lo FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey WHERE lo < 8401.0 + s_suppkey % 10 * 200 + 300.5 AND lo + l_linenumber > 8401.0 + s_suppkey % 10 * 200""",
    "k_rects_intersect": "SELECT p_partkey FROM (SELECT p_partkey, CAST(p_partkey % 50 AS DOUBLE) AS x, p_retailprice % 40 AS y, CAST(p_size AS DOUBLE) AS s FROM part) WHERE x < 30 AND x + s > 20 AND y < 25 AND y + s > 10",
    "k_page_label": f"""SELECT p_partkey, 'p-' || CASE p_partkey % 5 WHEN 0 THEN CAST(n AS VARCHAR) WHEN 1 THEN r WHEN 2 THEN lower(r) WHEN 3 THEN a ELSE lower(a) END AS label
FROM (SELECT p_partkey, n, {_ROMAN} AS r, CASE WHEN n > 702 THEN chr(CAST(65 + ((n - 703) // 676) % 26 AS INTEGER)) ELSE '' END || CASE WHEN n > 26 THEN chr(CAST(65 + ((n - 27) // 26) % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) AS a FROM (SELECT p_partkey, CAST(p_partkey % 900 + 1 AS INTEGER) AS n FROM part))""",
    "k_asof_label": "SELECT o_orderkey, s_name FROM (SELECT o_orderkey, o_custkey % 10 AS g, o_totalprice AS p FROM orders) o ASOF LEFT JOIN (SELECT s_suppkey % 10 AS g, CAST(s_suppkey * 700 AS DOUBLE) AS start, s_name FROM supplier) s ON o.g = s.g AND o.p >= s.start",
    "k_pdf_date": "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day, CAST(hour(o_orderdate) AS INTEGER) AS hour, CAST(minute(o_orderdate) AS INTEGER) AS minute, CAST(second(o_orderdate) AS INTEGER) AS second, '+' AS tz_sign, 5 AS tz_hour, 30 AS tz_minute FROM orders",
    "k_utc_time": "SELECT o_orderkey, strftime(o_orderdate, '%y%m%d%H%M%SZ') AS t FROM orders",
    "k_cmyk_to_rgb": "SELECT l_orderkey, l_linenumber, CAST(floor(least(greatest((1 - l_discount) * (1 - l_linenumber / 10), 0), 1) * 255) AS INTEGER) AS r, CAST(floor(least(greatest((1 - l_tax) * (1 - l_linenumber / 10), 0), 1) * 255) AS INTEGER) AS g, CAST(floor(least(greatest((1 - l_quantity / 50) * (1 - l_linenumber / 10), 0), 1) * 255) AS INTEGER) AS b FROM lineitem",
    "k_blend_modes": "SELECT l_orderkey, l_linenumber, round(s, 6) AS normal, round(s * d, 6) AS multiply, round(s + d - s * d, 6) AS screen, round(least(s, d), 6) AS darken, round(greatest(s, d), 6) AS lighten, round(CASE WHEN d <= 0.5 THEN 2 * d * s ELSE 2 * d - 1 + s - (2 * d - 1) * s END, 6) AS overlay, round(s * 0.25 + d * 0.75, 6) AS over FROM (SELECT *, l_discount * 10 AS s, l_quantity / 50 AS d FROM lineitem)",
    "k_shading_eval": "SELECT l_orderkey, l_linenumber, round(0.2 + pow(t, 2.0) * (0.9 - 0.2), 6) AS exponential, round(CASE WHEN t < 0.5 THEN t / 0.5 ELSE pow(1 - (t - 0.5) / 0.5, 2) END, 6) AS stitched, round((t * 2 + 0.5) / 5, 6) AS axial FROM (SELECT *, l_quantity / 50 AS t FROM lineitem)",
    "k_matrix_concat": "SELECT l_orderkey, l_linenumber, round(q * 2 + di * -1, 4) AS a, round(q * 1 + di * 0.5::DOUBLE, 4) AS b, round(t * 2 + q * -1, 4) AS c, round(t * 1 + q * 0.5::DOUBLE, 4) AS d, round(p * 2 + di * -1 + 3, 4) AS e, round(p * 1 + di * 0.5::DOUBLE + 4, 4) AS f, round(q * 2 + t * 3 + p, 4) AS x, round(di * 2 + q * 3 + di, 4) AS y FROM (SELECT *, l_quantity AS q, l_discount AS di, l_tax AS t, l_extendedprice AS p FROM lineitem)",
    "k_matrix_inverse": "SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(det) >= 1e-10 THEN q / det END, 5) AS a, round(CASE WHEN abs(det) >= 1e-10 THEN -t / det END, 12) AS c, round(CASE WHEN q * q + di * di > 0 THEN (q * t + di * q) / (q * q + di * di) ELSE 0 END, 5) AS shear FROM (SELECT *, q * q - di * t AS det FROM (SELECT *, l_quantity AS q, l_discount AS di, l_tax AS t, l_extendedprice AS p FROM lineitem))",
    "k_tile_grid": "SELECT p_partkey, CAST(c AS INTEGER) AS col, CAST(r AS INTEGER) AS row, c * 150.0::DOUBLE AS x, r * 150.0::DOUBLE AS y, round(least(150.0::DOUBLE, w - c * 150.0::DOUBLE), 6) AS w, round(least(150.0::DOUBLE, h - r * 150.0::DOUBLE), 6) AS h FROM (SELECT *, unnest(range(greatest(CAST(ceil(h / 150) AS BIGINT), 1))) AS r FROM (SELECT *, unnest(range(greatest(CAST(ceil(w / 150) AS BIGINT), 1))) AS c FROM (SELECT p_partkey, p_size * 10.0::DOUBLE AS w, p_retailprice / 4 AS h FROM part)))",
    "k_quad_bounds": "SELECT p_partkey, least(s + k % 7, s * 3 + k % 11, k % 13, s * 2.5::DOUBLE + k % 9) AS x1, least(s * 2 + k % 5, s * 0.5::DOUBLE + k % 3, s * 1.5::DOUBLE + k % 2, s * 4 + k % 4) AS y1, greatest(s + k % 7, s * 3 + k % 11, k % 13, s * 2.5::DOUBLE + k % 9) AS x2, greatest(s * 2 + k % 5, s * 0.5::DOUBLE + k % 3, s * 1.5::DOUBLE + k % 2, s * 4 + k % 4) AS y2, 1 AS n FROM (SELECT *, CAST(p_size AS DOUBLE) AS s, p_partkey AS k FROM part)",
    "k_permissions": "SELECT l_orderkey, l_linenumber, (p & 4) <> 0 AS print, (p & 8) <> 0 AS modify, (p & 16) <> 0 AS copy_text, (p & 32) <> 0 AS annotate, (p & 256) <> 0 AS fill_forms, (p & 512) <> 0 AS extract_accessibility, (p & 1024) <> 0 AS assemble, (p & 2048) <> 0 AS print_hq FROM (SELECT *, l_partkey % 4096 AS p FROM lineitem)",
    "k_asciihex": "SELECT c_custkey, c_name AS back FROM customer",
    "k_ascii85": "SELECT c_custkey, c_name AS back, CAST(length(c_name) + ceil(length(c_name) / 4.0) + 2 AS INTEGER) AS n_coded FROM customer",
    "k_runlength": "SELECT c_custkey, c_name AS back, CAST(length(c_name) AS INTEGER) AS n_coded FROM customer",
    "k_tiff_predictor": "SELECT l_orderkey, l_linenumber, CAST(sum(l_partkey % 256) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) % 256 AS BIGINT) AS byte FROM lineitem",
    "k_interval_merge": """SELECT user_id, min(f) AS first, max(e) AS "end" FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY f, e ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN f <= max(e) OVER (PARTITION BY user_id ORDER BY f, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS f, CAST(floor(epoch(ts)) AS BIGINT) + 7200 AS e FROM events))) GROUP BY user_id, i""",
    "k_needed_ranges": """WITH c AS (SELECT k, min(f) AS a, max(e) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY f, e ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN f <= max(e) OVER (PARTITION BY k ORDER BY f, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM (SELECT o_custkey % 100 AS k, o_orderkey * 10 AS f, o_orderkey * 10 + 500 AS e FROM orders WHERE o_orderstatus = 'O'))) GROUP BY k, i)
SELECT k, first, first + 40 AS "end" FROM (SELECT o_custkey % 100 AS k, o_orderkey * 10 AS first FROM orders WHERE o_orderstatus <> 'O') n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.k = n.k AND c.a <= n.first AND c.b >= n.first + 40)""",
    "k_object_len": "SELECT o_custkey, o_orderkey * 37 AS offset, CAST(CASE WHEN lead(o_orderkey) OVER w IS NULL THEN 65536 ELSE least((lead(o_orderkey) OVER w) * 37 - o_orderkey * 37, 65536) END AS BIGINT) AS est_len FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "k_xref_newest_wins": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, o_orderstatus FROM orders GROUP BY o_custkey, o_orderstatus",
    "k_xref_subsections_all": "SELECT g, in_use, min(n) AS first, count(*) AS count FROM (SELECT g, in_use, n, n - row_number() OVER (PARTITION BY g, in_use ORDER BY n) AS r FROM (SELECT o_orderkey % 7 AS g, o_custkey % 3 <> 0 AS in_use, o_orderkey // 7 AS n FROM orders)) GROUP BY g, in_use, r",
    "g_reachable": "SELECT CAST(1 AS BIGINT) AS dst_obj UNION ALL SELECT 100 + n_nationkey FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 1000 + c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 10000000 + o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1",
    "g_unreachable": "SELECT CAST(100 + n_nationkey AS BIGINT) AS dst_obj FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 1000 + c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 1 UNION ALL SELECT 10000000 + o_orderkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey IS DISTINCT FROM 1",
    "g_inherit_attr": "SELECT 'c' || c_custkey AS node, CASE WHEN c_acctbal > 9000 THEN c_name WHEN n_nationkey % 2 = 0 THEN n_name ELSE r_name END AS v FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE r_name END FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'r' || r_regionkey, r_name FROM region",
    "g_remap_offset": "SELECT source, CAST(coalesce(sum(size) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM (SELECT source, max(doc_id) AS size FROM documents GROUP BY source)",
    "g_name_tree_last_wins": "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type",
    "g_permission_filter": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR ((o_custkey % 64) & 16) <> 0",
    "s_sha256_dedup": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical, sha256(text) AS sha FROM documents",
    "s_operator_histogram": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 15",
    "s_html_text": "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\n\\t\\r]+', ' ', 'g')) AS text FROM pages",
    "s_xml_escape": f"SELECT page_id, md5({_XML}) AS md5, md5(html) AS back FROM pages",
    "s_text_strings_whole": r"SELECT doc_id, CAST(CASE WHEN regexp_full_match(t, '[\x{00}-\x{FF}]*') AND NOT starts_with(t, 'þÿ') AND NOT starts_with(t, 'ï»¿') THEN length(t) ELSE 2 + 2 * (length(t) + length(regexp_replace(t, '[^\x{10000}-\x{10FFFF}]', '', 'g'))) END AS INTEGER) AS n_bytes, length(t) AS n_chars, md5(t) AS md5 FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE text || '中' END AS t FROM documents)",
    "s_real_and_name": "SELECT l_orderkey, l_linenumber, CASE WHEN r IN ('-0', '') THEN '0' ELSE r END AS real, '/' || l_returnflag || '#20#28' || l_linestatus || '#29#23#C3#A9' AS name FROM (SELECT *, regexp_replace(printf('%.6f', l_discount - 0.05), '\\.?0+$', '') AS r FROM lineitem)",
    "k_caret_offsets": """SELECT l_orderkey, sum(q) AS width, CAST(arg_min(n, abs(c - 40) * 1000 + n) AS INTEGER) AS hit FROM (SELECT l_orderkey, l_quantity AS q, row_number() OVER w AS n, sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING) AS c FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) UNION ALL SELECT DISTINCT l_orderkey, 0.0::DOUBLE, 0, 0.0::DOUBLE FROM lineitem) GROUP BY l_orderkey""",
    "k_decorations": "SELECT p_partkey, round(greatest(p_size * 0.05::DOUBLE, 0.5::DOUBLE), 6) AS thickness, round(p_size * 0.12::DOUBLE, 6) AS underline, round(p_size * 0.3::DOUBLE, 6) AS strike FROM part",
    "k_wrap_lines": "SELECT p_partkey, p_name AS name, false AS too_long FROM part",
    "k_wrap_greedy": """WITH RECURSIVE p AS (SELECT p_partkey, string_split(concat_ws(' ', p_name, p_type, p_brand), ' ') AS w FROM part),
r AS (SELECT p_partkey, w, 1 AS i, w[1] AS line, CAST([] AS VARCHAR[]) AS done FROM p
UNION ALL SELECT p_partkey, w, i + 1, CASE WHEN length(line) + 1 + length(w[i + 1]) <= 12 THEN line || ' ' || w[i + 1] ELSE w[i + 1] END, CASE WHEN length(line) + 1 + length(w[i + 1]) <= 12 THEN done ELSE list_append(done, line) END FROM r WHERE i < len(w))
SELECT p_partkey, array_to_string(list_append(done, line), '|') AS lines FROM r WHERE i = len(w)""",
    "k_xfdf_import": """SELECT c_custkey, unnest(['n', 'empty', 's']) AS name, unnest([c_name || ' <&> "', NULL, c_mktsegment]) AS value FROM customer""",
    "k_xmp": "SELECT doc_id, source AS title, lang AS producer, CAST(NULL AS VARCHAR) AS creator FROM documents",
    "x_event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}

QUERIES = {name: globals()[name] for name in ORACLES}
