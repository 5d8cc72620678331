"""Queries over files with less common parts: encodings, inline images, fills, moved text, filters, conformance at all levels."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from folio.core import edit, encoding, filters, writer
from folio.core.objects import Document, Name, Stream
from folio.operators import layout, pdfa
from folio.plans.documents import FULL, TEXT, table, text_documents
from folio.sources.pdf import Pdf, build, flat_map, text_files
from folio.streaming.progressive import Progressive

_NAMES = {text: name for name, text in encoding.GLYPHS.items()}
_ACCENTS = {mark: name for name, mark in encoding.ACCENTS.items() if name != "commaaccent"}


def glyph_name(c: str) -> str:
    """A glyph name of a character."""
    parts = unicodedata.normalize("NFD", c)
    if len(parts) == 2 and parts[1] in _ACCENTS:
        return parts[0] + _ACCENTS[parts[1]]
    return _NAMES.get(c) or (c if c.isascii() and c.isalpha() else f"uni{ord(c):04X}")


def encoded_pdf(text: str | None) -> bytes:
    """Lines in turn in a font of Mac Roman codes, and in one whose codes from 128 on are given by glyph names."""
    b = writer.Builder()
    lines = (text or "").split("\n")
    own = sorted({c for x in lines for c in x if not 32 <= ord(c) < 127 or c.islower()})[:127]
    code = {c: 128 + i for i, c in enumerate(own)}
    plain = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}
    fonts = {
        "F1": b.add(plain | {"Encoding": Name("MacRomanEncoding")}),
        "F2": b.add(plain | {"Encoding": {"Type": Name("Encoding"), "BaseEncoding": Name("WinAnsiEncoding"), "Differences": [128, *(Name(glyph_name(c)) for c in own)]}}),
        "F3": b.font,
    }
    for at in range(0, max(1, len(lines)), 40):
        ops: list = [("BT", [])]
        for i, line in enumerate(lines[at : at + 40]):
            if line:
                try:
                    font, raw = ("F2", bytes(code.get(c, ord(c)) for c in line)) if i % 2 else ("F1", line.encode("mac_roman"))
                except ValueError:
                    font, raw = "F3", line.encode("cp1252", "replace")
                ops += [("Tf", [Name(font), 10]), ("Tm", [1, 0, 0, 1, 72, 740 - 14 * i]), ("Tj", [raw])]
        b.page(writer.content([*ops, ("ET", [])]), Resources={"Font": fonts})
    return b.build()


def rt_encoded_text(spark, sf):
    """Text through base encodings, differences and glyph names."""
    files = build(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id", "text"], lambda _, text: encoded_pdf(text))
    return layout.document_text(layout.page_text(layout.lines(layout.words(layout.lines_of_spans(Pdf(files).spans(*layout.SPAN))))))


def _with_image(lang: str, source: str) -> bytes:
    b = writer.Builder()
    samples = b"\x00 EI Q\xff" + source.encode() + b" EI \x01"  # the end mark stands in the samples too
    b.page(b"q 40 0 0 20 100 200 cm BI /W %d /H 1 /BPC 8 /CS /G ID " % len(samples) + samples + b"\nEI Q BT /F1 10 Tf 72 700 Td (" + lang.encode() + b") Tj ET")
    return b.build()


def rt_inline_image(spark, sf):
    files = build(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["doc_id", "lang", "source"], lambda _, lang, source: _with_image(lang, source))
    return Pdf(files).display_items().select("doc_id", "kind", "text", *[F.get("bbox", i).alias(c) for i, c in enumerate(("x1", "y1"))])


def rt_redact_moves(spark, sf):
    """The middle one of three strings on a line goes; the last one stays where it was."""

    def one(_, source, lang, key):
        b = writer.Builder()
        b.page(b"BT /F1 10 Tf 72 700 Td (%s) Tj (%s) Tj (%s) Tj ET BI /W 1 /H 1 /BPC 8 /CS /G ID x\nEI" % (source.encode(), lang.encode(), str(key).encode()))
        x = 72 + 10 * len(source)
        return edit.redact(b.build(), [(0, x + 1.0, 690.0, x + 10.0 * len(lang) - 1, 720.0)])

    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", F.col("doc_id").alias("key"))
    items = Pdf(build(docs, docs.columns, one)).display_items().where("kind <> 'fill'")
    return items.select("doc_id", "kind", "text", F.round(F.get("bbox", 0), 3).alias("x1"))


def rt_display_fills(spark, sf):
    """Rectangles under a matrix, cut by nothing, with their colours; a shading fills its clipping path."""

    def one(key, cust, price):
        b = writer.Builder()
        b.page(b"q 2 0 0 2 10 20 cm 0 1 0 rg %d %d 30 40 re f Q q %d 5 50 60 re W n /S1 sh Q /DeviceRGB cs 1 2 3 4 re f" % (key % 200, cust % 300, key % 100))
        return b.build()

    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey", "o_totalprice")
    items = Pdf(build(rows, rows.columns, one)).display_items("item_idx", "kind", "bbox", "color")
    return items.select("doc_id", "item_idx", "kind", *[F.get("bbox", i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))], F.get("color", 1).alias("green"))


def _lzw(raw: bytes) -> bytes:
    """Nine-bit literals, with a clear code before the table grows past nine bits."""
    bits = "".join(("100000000" if i % 200 == 0 else "") + f"{c:09b}" for i, c in enumerate(raw)) + "100000001"
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def k_lzw(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name")
    return flat_map(rows, ["c_custkey", "c_name"], "back string", lambda _, name: iter([(filters.decode("LZWDecode", _lzw((name * 20).encode())).decode(),)]))


def k_tiff_rows(spark, sf):
    """Bytes of names as differences along rows of eight samples, undone by predictor 2."""

    def each(_, name):
        raw = name.encode()[:16].ljust(16, b" ")
        coded = b"".join(bytes((row[i] - (row[i - 1] if i else 0)) & 255 for i in range(8)) for row in (raw[:8], raw[8:]))
        yield (filters.predict(coded, {"Predictor": 2, "Columns": 8, "Colors": 1, "BitsPerComponent": 8}).decode(),)

    return flat_map(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey", "c_name"], "back string", each)


def rt_encrypted_256(spark, sf):
    rows = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_regionkey").alias("doc_id"), "r_name")
    files = build(rows, rows.columns, lambda _, name: writer.text_pdf(name, encryption=writer.Encryption("aes256", b"user", b"owner", -3904, name.encode())))
    pdf = Pdf(files, password="user")
    return pdf.docs().join(pdf.spans().select("doc_id", "text"), "doc_id").select("doc_id", "encrypted", "permission_bits", "text")


def _conforming(key: int) -> bytes:
    """A file that has what levels ask for, but for one fault by its key."""
    b = writer.Builder()
    fault = key % 6
    font = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("ABCDEF+Own")}
    if fault != 1:
        font["FontDescriptor"] = {"Type": Name("FontDescriptor"), "FontFile": b.add(Stream({}, b"font"))}
    resources: dict = {"Font": {"F1": b.add(font)}}
    if fault == 2:
        resources["ExtGState"] = {"G1": b.add({"Type": Name("ExtGState"), "ca": 0.5})}
    b.page(b"BT /F1 10 Tf (x) Tj ET", Resources=resources)
    if fault != 3:
        b.root["OutputIntents"] = [{"Type": Name("OutputIntent")}]
    if fault != 4:
        b.root["Metadata"] = b.add(Stream({"Type": Name("Metadata"), "Subtype": Name("XML")}, b"<x/>"))
    if fault == 5:
        b.root["Names"] = {"JavaScript": {"Names": []}}
    return b.build(encryption=writer.Encryption("rc4", b"", b"o", -4, b"s") if key == 24 else None)


def rt_pdfa_levels(spark, sf):
    """Every rule at three levels, over files with one fault each."""
    rows = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("doc_id"), F.col("n_nationkey").alias("k"))
    facts = Pdf(build(rows, ["doc_id", "k"], lambda _, key: _conforming(key))).facts()
    levels = [pdfa.violations(facts, level).select("doc_id", F.lit(level).alias("level"), "rule") for level in ("1b", "2b", "3b")]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def rt_annotations_flatten(spark, sf):
    """A highlight becomes a filled box of the page, and no annotation is left."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey")
    empty = writer.text_pdf("x")
    files = build(rows, rows.columns, lambda key, cust: edit.flatten_annotations(edit.annotate(empty, 0, "Highlight", (float(key % 500), 10.0, float(key % 500 + 20), 30.0), (0.0, 1.0, 0.0))))
    items = Pdf(files).display_items("kind", "bbox", "color")
    return items.select("doc_id", "kind", *[F.get("bbox", i).alias(c) for i, c in enumerate(("x1", "y1", "x2"))], F.get("color", 1).alias("green"))


def rt_replace_text(spark, sf):
    """The source, written at a known place, replaced by the language."""

    def one(_, source, lang):
        return edit.replace_text(writer.text_pdf(f"{source}\n{source}"), 0, source, 72.0, 726.0, lang)

    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return Pdf(build(docs, docs.columns, one)).spans("span_idx", "text")


def _named(region: str, nations: list[str]) -> bytes:
    """A page for each nation, with destinations, scripts and form data packets by their names."""
    b = writer.Builder()
    pages = [b.page(b"") for _ in nations]
    half = len(nations) // 2
    rows = lambda some: [x for name, page in some for x in (name.encode(), [page, Name("XYZ"), 10, None, 0])]
    pairs = list(zip(nations, pages))
    kids = [b.add({"Names": rows(pairs[:half])}), b.add({"Names": rows(pairs[half:])})]
    script = lambda text: {"S": Name("JavaScript"), "JS": text.encode()}
    b.root["Names"] = {"Dests": {"Kids": kids}, "JavaScript": {"Names": [b"start", script(f"go({region})")]}}
    b.root["Dests"] = {"old": {"D": [0, Name("Fit")]}, nations[0]: [1, Name("Fit")]}
    b.root["OpenAction"] = script("open()")
    b.root["AcroForm"] = {"Fields": [], "XFA": [b"template", b.add(Stream({}, b"<t/>")), b"datasets", b.add(writer.flate(f"<d>{region}</d>".encode()))]}
    return b.build()


def _regions(spark, sf):
    nations = spark.read.parquet(f"{sf}/nation.parquet").groupBy(F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_list("n_name")).alias("below"))
    regions = spark.read.parquet(f"{sf}/region.parquet").join(nations, F.col("r_regionkey") == F.col("k")).select(F.col("r_regionkey").alias("doc_id"), "r_name", "below")
    return Pdf(build(regions, regions.columns, lambda _, name, below: _named(name, below)))


def rt_named_dests(spark, sf):
    return _regions(spark, sf).destinations().select("doc_id", "name", "page_index", "fit")


def rt_scripts(spark, sf):
    return _regions(spark, sf).scripts().select("doc_id", "place", "event", "script")


def rt_xfa(spark, sf):
    return _regions(spark, sf).xfa().select("doc_id", "name", "xml")


def rt_fdf_import(spark, sf):
    """Form data written, read again and filled into a form."""

    def one(_, name, segment):
        form = edit.form([{"kind": "Text", "name": "name", "value": ""}, {"kind": "Combo", "name": "segment", "value": "", "options": [segment]}])
        return edit.fill_fields(form, edit.fdf_fields(edit.fdf({"name": name, "segment": segment})))

    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name", "c_mktsegment")
    return Pdf(build(rows, rows.columns, one)).form_fields().select("doc_id", "full_name", "value")


def rt_pdfa_convert(spark, sf):
    """Converted files break no rule, and their metadata has the title."""
    from folio.functions.editing import xmp

    made = text_files(table(spark, sf, "documents"), info={"Title": "source", "Author": "lang"})
    files = Pdf(build(made, ["doc_id", "content"], lambda _, data: edit.convert_pdfa(data, "2b"))).together(streams=["data"], facts=["fact", "obj_num"])
    found = files.select("doc_id", "facts", F.inline("streams")).withColumn("packet", F.decode("data", "UTF-8")).where(F.col("packet").contains("pdfaid:part"))
    n = F.coalesce(pdfa.n_violations(F.col("facts"), "2b"), F.lit(0))
    return found.select("doc_id", xmp(F.col("packet")).alias("x"), n.alias("n_violations")).select("doc_id", "x.title", "x.creator", "n_violations")


def rt_progressive(spark, sf):
    """The second page, or the only one, of files fed in the ranges that were asked for."""

    def one(_, data):
        held, rounds = Progressive(len(data)), 0
        page = min(1, Document(data).page_count() - 1)
        while lacking := held.needed(page):
            rounds += 1
            for a, b in lacking:
                held.feed(a, data[a:b])
        return held.page_document(page)

    pages = Pdf(build(text_documents(spark, sf), ["doc_id", "content"], one))
    return layout.document_text(layout.page_text(layout.lines(layout.words(layout.lines_of_spans(pages.spans(*layout.SPAN))))))


ORACLES = {
    "rt_pdfa_convert": "SELECT doc_id, source AS title, lang AS creator, 0 AS n_violations FROM documents",
    "rt_progressive": "SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents) WHERE line <> '' AND n // 40 = CASE WHEN len(string_split(text, chr(10))) > 40 THEN 1 ELSE 0 END GROUP BY doc_id",
    "rt_annotations_flatten": """SELECT o_orderkey AS doc_id, 'text' AS kind, 72.0::DOUBLE AS x1, 740.0::DOUBLE AS y1, 82.0::DOUBLE AS x2, 0.0::DOUBLE AS green FROM orders
UNION ALL SELECT o_orderkey, 'fill', CAST(o_orderkey % 500 AS DOUBLE), 10.0, CAST(o_orderkey % 500 + 20 AS DOUBLE), 1.0 FROM orders""",
    "rt_replace_text": "SELECT doc_id, 0 AS span_idx, source AS text FROM documents UNION ALL SELECT doc_id, 1, lang FROM documents",
    "rt_named_dests": """SELECT n_regionkey AS doc_id, n_name AS name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS INTEGER) AS page_index, 'XYZ' AS fit FROM nation
UNION ALL SELECT r_regionkey, 'old', 0, 'Fit' FROM region""",
    "rt_scripts": "SELECT r_regionkey AS doc_id, 'catalog' AS place, 'OpenAction' AS event, 'open()' AS script FROM region UNION ALL SELECT r_regionkey, 'names', 'start', 'go(' || r_name || ')' FROM region",
    "rt_xfa": "SELECT r_regionkey AS doc_id, 'template' AS name, '<t/>' AS xml FROM region UNION ALL SELECT r_regionkey, 'datasets', '<d>' || r_name || '</d>' FROM region",
    "rt_fdf_import": "SELECT c_custkey AS doc_id, 'name' AS full_name, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer",
    "rt_encoded_text": f"SELECT doc_id, {TEXT.format('text')} AS text FROM documents WHERE {FULL}",
    "rt_inline_image": "SELECT doc_id, 'image' AS kind, NULL AS text, 100.0::DOUBLE AS x1, 200.0::DOUBLE AS y1 FROM documents UNION ALL SELECT doc_id, 'text', lang, 72.0, 700.0 FROM documents",
    "rt_redact_moves": "SELECT doc_id, 'text' AS kind, source AS text, 72.0::DOUBLE AS x1 FROM documents UNION ALL SELECT doc_id, 'text', CAST(doc_id AS VARCHAR), 72.0 + 10.0 * (length(source) + length(lang)) FROM documents UNION ALL SELECT doc_id, 'image', NULL, 0.0 FROM documents",
    "rt_display_fills": """SELECT o_orderkey AS doc_id, 0 AS item_idx, 'fill' AS kind, CAST(10 + 2 * (o_orderkey % 200) AS DOUBLE) AS x1, CAST(20 + 2 * (o_custkey % 300) AS DOUBLE) AS y1, CAST(70 + 2 * (o_orderkey % 200) AS DOUBLE) AS x2, CAST(100 + 2 * (o_custkey % 300) AS DOUBLE) AS y2, 1.0::DOUBLE AS green FROM orders
UNION ALL SELECT o_orderkey, 1, 'shading', CAST(o_orderkey % 100 AS DOUBLE), 5.0, CAST(o_orderkey % 100 + 50 AS DOUBLE), 65.0, NULL FROM orders
UNION ALL SELECT o_orderkey, 2, 'fill', 1.0, 2.0, 4.0, 6.0, 0.0 FROM orders""",
    "k_lzw": "SELECT c_custkey, repeat(c_name, 20) AS back FROM customer",
    "k_tiff_rows": "SELECT c_custkey, rpad(c_name, 16, ' ') AS back FROM customer",
    "rt_encrypted_256": "SELECT r_regionkey AS doc_id, true AS encrypted, -3904 AS permission_bits, r_name AS text FROM region",
    "rt_pdfa_levels": """SELECT n_nationkey AS doc_id, level, rule FROM nation, (VALUES (1, '6.2.2'), (2, '6.4.1'), (3, '6.2.3'), (4, '6.7.2'), (5, '6.6.1')) f(fault, rule), (VALUES ('1b'), ('2b'), ('3b')) l(level)
WHERE n_nationkey % 6 = fault AND (rule <> '6.4.1' OR level = '1b') UNION ALL SELECT 24, level, '6.1.1' FROM (VALUES ('1b'), ('2b'), ('3b')) l(level)""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
