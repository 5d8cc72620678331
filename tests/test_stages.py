"""Files that are built, changed and read: one Python stage, and no more of it than is asked for."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folio.core import edit, writer
from folio.core.extract import RELATIONS
from folio.core.objects import Document, Keyword, Lexer, Name, PdfError, Ref, operations
from folio.operators import layout, pdfa
from folio.plans import details, documents
from folio.sources import pdf as source
from folio.sources.pdf import Pdf, build, flat_map, text_files

DOCS = [(1, "one\ntwo"), (2, None), (3, "x" * 70)]


def stages(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def test_a_base_of_many_files_is_parsed_once(monkeypatch):
    parsed = []
    monkeypatch.setattr(edit, "Document", lambda *a: parsed.append(1) or Document(*a))
    base = writer.text_pdf("base of many")
    made = [edit.annotate(base, 0, "Highlight", (i, 10.0, i + 20, 30.0), contents=str(i)) for i in range(5)]
    assert len(parsed) == 1
    notes = [next(RELATIONS["annotations"][0](Document(d))) for d in made]
    assert [(n[3][0], n[6]) for n in notes] == [(float(i), str(i)) for i in range(5)]
    flat = edit.flatten_annotations(made[3])
    assert [x[3] for x in RELATIONS["display_items"][0](Document(flat))] == ["text", "fill"] and Document(base).page_count() == 1


def test_bytes_seen_before_are_neither_read_nor_written_again(monkeypatch):
    one, two = Document(writer.text_pdf("a")), Document(writer.text_pdf("another"))
    assert one.pages()[0][0] == two.pages()[0][0] and one.get(4) == {"Type": "Font", "Subtype": "Type1", "BaseFont": "Helvetica", "Encoding": "WinAnsiEncoding"}
    assert one.get(4) is two.get(4) and one.trailer == two.trailer and one.pages() is one.pages()
    # what only begins like a value, or like its end, is read where it stands
    base = writer.text_pdf("base of some")
    assert Document(base.replace(b" /Helvetica", b"%endobj\n/H1")).get(4) == one.get(4) | {"BaseFont": "H1"}
    coded = []
    monkeypatch.setattr(writer, "serialize", lambda x, f=writer.serialize: coded.append(x) or f(x))
    made = [edit.annotate(base, 0, "Highlight", (i, 10.0, i + 20, 30.0)) for i in range(3)]
    fonts = [x for x in coded if isinstance(x, dict) and x.get("Type") == "Font"]
    assert len(fonts) == 1 and len(set(made)) == 3
    assert [edit.annotate(base, 0, "Highlight", (i, 10.0, i + 20, 30.0)) for i in range(3)] == made
    assert [writer.real(x) for x in (3.0, -0.0, -2.5, 1e-9, 1e16)] == ["3", "0", "-2.5", "0", "10000000000000000"]


def test_plain_content_is_read_without_a_lexer(monkeypatch):
    monkeypatch.setattr("folio.core.objects.Lexer", None)
    content = b"q 2 0 0 -.5 10 +20 cm % note\n1 0 R /F#31 10 Tf (a) Tj true x ] Q % f"
    assert list(operations(content)) == [("q", []), ("cm", [2, 0, 0, -0.5, 10, 20]), ("R", [1, 0]), ("Tf", [Name("F1"), 10]), ("Tj", [b"a"]), ("x", [True]), ("]", []), ("Q", [])]


def test_content_of_words_is_split_and_stream_heads_are_read_once(monkeypatch):
    from random import Random
    from types import SimpleNamespace

    from folio.core import objects

    rng = Random(3)
    some = ["12", "-3", "+4.5", "--1", ".5", "1.2.3", "7x", "/F#31", "/DeviceRGB", "true", "null", "re", "f*", "R", "'", "\\", "123456789012345678"]
    bodies = ["".join(rng.choice(some) + rng.choice([" ", "\n", "\r\t"]) for _ in range(60)).encode() for _ in range(50)]
    odd = [b"1 2 m\x0b3", b"/ 1 f", b"/A/B gs", b"1 2 m%x\nf", b"1234567890123456789 w f", b"99999999999999999999 w f", b"1\x002 m", b"BI /W 1 /H 1 /BPC 8 /CS /G ID f EI 1 w", b" ", b""]
    kept = [list(operations(x)) for x in bodies + odd]
    with monkeypatch.context() as m:
        m.setattr(objects, "_WORDS", objects.re.compile(b"(?!)"))
        assert str([list(operations(x)) for x in bodies + odd]) == str(kept)
    with monkeypatch.context() as m:
        m.setattr(objects, "_CONTENT", SimpleNamespace(match=objects._CONTENT.match))
        assert [list(operations(x)) for x in bodies] == kept[: len(bodies)]
    made = [writer.text_pdf("stream heads", compress=c) for c in (True, False)]
    read = []
    monkeypatch.setattr(Lexer, "value", lambda lex, f=Lexer.value: read.append(lex.data) or f(lex))
    for data in made * 2:
        doc = Document(data)
        assert b"(stream heads) Tj" in doc.contents(doc.pages()[0][1])
        read.append(None)
    # of a file seen before only the numbers of its table are read
    assert [x == made[1] for x in read[read.index(None, read.index(None, read.index(None) + 1) + 1) + 1 : -1]] == [True] * 3
    # a head that isn't followed by its stream, or has such a word in it, is read where it stands
    for head in (b"<</Length 3/A (stream)>>\nstream\nabc\nendstream", b"<</Length 3>>% stream\nstream\nabc\nendstream"):
        assert Document.__new__(Document)._object_at.__func__(SimpleNamespace(data=b"1 0 obj\n" + head + b"\nendobj"), 0)[1].raw == b"abc"


def test_tokens():
    read = lambda data, refs=True: Lexer(data, refs=refs).value()
    assert read(b"% (x\n<</A#42 1 0 R/B[(a(b)\\)) <414> -.5 +5 0 R -1 0 R]/C true>>") == {"AB": Ref(1, 0), "B": [b"a(b))", b"A@", -0.5, Ref(5, 0), -1, 0], "C": True}
    assert read(b"1 0 R", False) == 1 and read(b"/") == Name("") and read(b"[1 2 0 Rx]") == [1, 2, 0]
    assert isinstance(read(b"truex"), Keyword) and read(b"<</A>>") == {}
    for bad in (b"[1 <</A 2>>", b"<</A [1]", b"(a(b)", b"<41", b"99999999999999999999"):
        with pytest.raises(PdfError):
            read(bad)
    assert list(operations(b"(a) Tj % Tj\n[(b) 3] TJ (c")) == [("Tj", [b"a"]), ("TJ", [[b"b", 3]])]


def test_files_built_changed_and_read_in_one_stage(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    marked = build(text_files(docs), ["doc_id", "content"], lambda _, data: edit.watermark(data, "M"))
    twice = build(marked, ["doc_id", "content"], lambda key, data: edit.set_info(data, {"Title": f"t{key}"}))
    spans = Pdf(twice).spans("text")
    assert stages(spans) == 1 and spans.columns == ["doc_id", "text"]
    assert sorted(map(tuple, spans.collect())) == [(1, "M"), (1, "one"), (1, "two"), (2, "M"), (3, "M"), (3, "x" * 70)]
    assert sorted(r.title for r in Pdf(twice).metadata("title").collect()) == ["t1", "t2", "t3"]
    # other columns, and files that went through something else, are taken as they are
    odd = Pdf(twice.where("doc_id > 1"))
    assert stages(odd.docs()) == 2 and odd.docs().count() == 2


def test_relations_of_a_file_in_one_pass(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    made = build(text_files(docs), ["doc_id", "content"], lambda key, data: edit.set_info(data, {"Title": f"t{key}"}))
    both = Pdf(made).together(metadata=["title", "subject"], xref=["section", "offset"])
    assert stages(both) == 1 and both.columns == ["doc_id", "metadata", "xref"]
    rows = {r.doc_id: r for r in both.collect()}
    for name, columns in (("metadata", ["title", "subject"]), ("xref", ["section", "offset"])):
        apart = sorted(map(str, Pdf(made).relation(name, *columns).collect()))
        assert apart == sorted(str(r) for r in both.select("doc_id", F.inline(name)).collect())
    assert rows[2].metadata[0].title == "t2" and {x.section for x in rows[2].xref} == {0, 1}
    # a file that can't be opened gives no row, a relation that fails is null, and with strict the job fails
    odd = build(docs, ["doc_id", "text"], lambda key, text: b"no file" if key == 1 else writer.text_pdf(text))
    monkeypatch.setitem(RELATIONS, "docs", (lambda doc: (1 // (doc.page_count() - 1) for _ in range(1)), "n_bytes long"))
    assert [tuple(r) for r in sorted(Pdf(odd).together(docs=["n_bytes"], metadata=["title"]).collect())] == [(2, None, [(None,)]), (3, None, [(None,)])]
    with pytest.raises(Exception, match="InvalidXref|ZeroDivision"):
        Pdf(odd, strict=True).together(docs=["n_bytes"]).collect()


def test_rows_of_structs_count_with_what_they_hold():
    batch = pa.RecordBatch.from_pydict({"k": list(range(20))})
    each = lambda k: iter([([{"data": b"x" * (source.HELD_BYTES // 4)}],)])
    kinds = [pa.int64(), pa.list_(pa.struct([("data", pa.binary())]))]
    assert [b.num_rows for b in source._rows_of(iter([batch]), each, ["k", "parts"], kinds, 4096)] == [4] * 5


def test_queries_of_two_relations_read_files_once(spark):
    sf = "/root/testdata/sf0.001"
    for query in (documents.rt_incremental, details.rt_pdfa_convert):
        assert stages(query(spark, sf)) == 1, query.__name__


def test_counts_of_violations_by_the_facts_of_a_file(spark):
    rows = [(1, "file", None), (1, "font/missing", 7), (1, "font/missing", 8), (1, "catalog/Metadata", None), (2, "file", None), (2, "extgstate/transparent", 9), (2, "catalog/OutputIntents", None)]
    some = spark.createDataFrame(rows, "doc_id long, fact string, obj_num int")
    whole = some.groupBy("doc_id").agg(F.collect_list(F.struct("fact", "obj_num")).alias("facts"))
    for level in ("1b", "2b"):
        wanted = {r.doc_id: r["count"] for r in pdfa.violations(some, level).groupBy("doc_id").count().collect()}
        assert {r.doc_id: r.n for r in whole.select("doc_id", pdfa.n_violations(F.col("facts"), level).alias("n")).collect()} == wanted
    none = spark.createDataFrame([(3, None)], "doc_id long, facts array<struct<fact: string, obj_num: int>>")
    assert none.select(pdfa.n_violations(F.col("facts")).alias("n")).first().n is None


def test_conformance_reads_facts_once(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    found = pdfa.violations(Pdf(text_files(docs)).facts("fact", "obj_num"))
    assert stages(found) == 1 and found.columns == ["doc_id", "rule", "description", "obj_num"]
    assert sorted((r.doc_id, r.rule, r.obj_num) for r in found.collect()) == [(i, rule, None) for i in (1, 2, 3) for rule in ("6.2.3", "6.7.2")]
    some = spark.createDataFrame([(1, "file", None), (1, "font/missing", 7), (1, "font/missing", 8), (1, "catalog/Metadata", None), (2, "file", None), (2, "extgstate/transparent", 9), (2, "catalog/OutputIntents", None)], "doc_id long, fact string, obj_num int")
    rows = lambda level: sorted((r.doc_id, r.rule, r.obj_num) for r in pdfa.violations(some, level).collect())
    assert rows("2b") == [(1, "6.2.2", 7), (1, "6.2.2", 8), (1, "6.2.3", None), (2, "6.7.2", None)]
    assert rows("1b") == [*rows("2b")[:3], (2, "6.4.1", 9), (2, "6.7.2", None)]


def test_a_file_that_cant_be_made_fails_the_job_and_one_that_cant_be_read_gives_no_rows(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    cut = build(text_files(docs), ["doc_id", "content"], lambda key, data: data if key == 1 else b"junk")
    assert [r.doc_id for r in Pdf(cut).docs("page_count").collect()] == [1] and Pdf(cut).errors().count() == 2
    with pytest.raises(Exception, match="division"):
        Pdf(build(text_files(docs), ["doc_id", "content"], lambda key, data: 1 // 0)).docs().collect()


def test_layout_asks_for_no_more_columns_than_it_reads(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    narrow, wide = Pdf(text_files(docs)).spans(*layout.SPAN), Pdf(text_files(docs)).spans()
    assert "char_cids" not in narrow.columns and "char_cids" not in documents._words(text_files(docs))._jdf.queryExecution().analyzed().toString()
    rows = lambda spans: sorted(map(str, layout.words(layout.lines_of_spans(spans)).collect()))
    assert rows(narrow) == rows(wide)


def test_what_costs_much_is_left_out():
    doc = Document(writer.text_pdf("a\nb"))
    for name, column, at in (("ops", "operands", 3), ("objects", "value", 4)):
        rows = RELATIONS[name][0]
        assert all(r[at] is None for r in rows(doc, ())) and any(r[at] for r in rows(doc))
        assert len(list(rows(doc, (column,)))) == len(list(rows(doc)))


def test_large_rows_are_handed_on_early(spark):
    given = [pa.RecordBatch.from_arrays([pa.array(range(100))], ["id"])]
    out = list(source._rows_of(iter(given), lambda i: iter([(bytes(1 << 20), [i])]), ["id", "big", "many"], [pa.int64(), pa.binary(), pa.list_(pa.int32())], 4096))
    assert [x for b in out for x in b["id"].to_pylist()] == list(range(100)) and max(b.num_rows for b in out) == 4
    assert flat_map(spark.range(0, 200, 1, 1), ["id"], "big binary", lambda i: iter([(bytes(1 << 20),)])).count() == 200


def test_tables_of_few_row_groups_are_dealt_out(spark, tmp_path):
    """A file with as many splits as cores, all of whose rows begin in one of them."""
    rows = pa.table({"doc_id": pa.array(range(40_000), pa.int64()), "text": [f"{i * 7919 % 40_009} {i}" * 40 for i in range(40_000)]})
    pq.write_table(rows, f"{tmp_path}/documents.parquet", compression="none", use_dictionary=False)
    assert spark.read.parquet(f"{tmp_path}/documents.parquet").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    dealt = documents.table(spark, str(tmp_path), "documents").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in dealt) == 40_000 and max(r["count"] for r in dealt) <= 12_000


def test_words_of_hits_are_looked_up():
    """Against a search through all words, as boxes were found before."""
    from random import Random

    from folio.operators.search import _cut

    rng = Random(5)
    for whole in (False, True):
        text = ["x" * rng.randint(0, 4) for _ in range(30)]
        a = [sum(len(t) + 1 for t in text[:i]) for i in range(30)]
        x, y, width, size = ([rng.randint(1, 99) / 8 for _ in text] for _ in range(4))
        matches = [(s, s + rng.randint(1, 12)) for s in range(a[-1])]
        want = []
        for s, e in matches:
            some = [i for i in range(30) if a[i] + len(text[i]) > s and a[i] < e]
            per = [w / max(len(t), 1) for w, t in zip(width, text)]
            if some:
                x1 = min(x[i] + (0 if whole else per[i] * max(s - a[i], 0)) for i in some)
                x2 = max(x[i] + (width[i] if whole else per[i] * (min(e, a[i] + len(text[i])) - a[i])) for i in some)
                want.append(("".join(text[i] for i in some), x1, min(y[i] for i in some), x2, max(y[i] + size[i] for i in some)))
        assert list(_cut(whole, a, text, x, y, width, size, iter(matches))) == want
    assert list(_cut(False, [0], ["ab"], [None], [1.0], [2.0], [3.0], iter([(0, 1)]))) == [("ab", None, 1.0, None, 4.0)]
