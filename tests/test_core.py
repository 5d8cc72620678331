import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.core import crypto, edit, filters, interp, objects, writer
from folio.core.extract import RELATIONS
from folio.core.objects import Document, Lexer, Name, PdfError, Ref, Stream, operations


def value(data, **options):
    return Lexer(data, **options).value()


@pytest.mark.parametrize(
    "data,want",
    [
        (b"-12", -12), (b"+3", 3), (b"4.", 4.0), (b"-.5", -0.5), (b"true", True), (b"null", None), (b"3 0 R", Ref(3, 0)),
        (b"/A#20b", Name("A b")), (b"(a\\(b\\)\\101\\n(c))", b"a(b)A\n(c)"), (b"(x\\\ny)", b"xy"), (b"<48 65 6>", b"He`"),
        (b"[1 2.5 /N (s) [3]]", [1, 2.5, "N", b"s", [3]]), (b"<</A 1/B<</C 2 0 R>>>>", {"A": 1, "B": {"C": Ref(2, 0)}}), (b"% note\n7", 7),
    ],
)
def test_values(data, want):
    assert value(data) == want


def test_bad_values():
    for data in (b"(open", b"[1 2", b"<</A 1", b"<41", b"99999999999999999999"):
        with pytest.raises(PdfError):
            value(data)


VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**40), 2**40) | st.binary(max_size=12) | st.text(st.characters(min_codepoint=33, max_codepoint=0x2FF), min_size=1, max_size=6).map(Name) | st.builds(Ref, st.integers(0, 999), st.just(0)),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(min_codepoint=33, max_codepoint=126), min_size=1, max_size=5).map(Name), x, max_size=4),
    max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_written_values_read_back(x):
    assert value(writer.serialize([x])) == [x]


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300))
def test_filters_round_trip(data):
    assert filters.decode("FlateDecode", zlib.compress(data)) == data
    assert filters.decode("ASCII85Decode", filters.encode_ascii85(data)) == data
    assert filters.decode("RunLengthDecode", filters.encode_run_length(data)) == data
    assert filters.decode("AHx", data.hex().encode() + b">") == data


def test_predictors_and_lzw():
    rows = bytes([0, 10, 20, 30, 1, 1, 2, 3, 2, 5, 5, 5, 3, 1, 1, 1, 4, 1, 2, 3])
    assert filters.predict(rows, {"Predictor": 15, "Columns": 3}) == bytes([10, 20, 30, 1, 3, 6, 6, 8, 11, 4, 7, 10, 5, 9, 13])
    assert filters.predict(bytes([1, 2, 3, 250, 10, 1]), {"Predictor": 2, "Columns": 3}) == bytes([1, 3, 6, 250, 4, 5])
    assert filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    for name, data in (("FlateDecode", b"junk"), ("ASCII85Decode", b"\x7f"), ("ASCIIHexDecode", b"zz"), ("Odd", b"")):
        with pytest.raises(filters.FilterError):
            filters.decode(name, data)


def test_ciphers():
    keys = crypto._round_keys(bytes(range(16)))
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypto._encrypt_block(keys, plain).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert crypto._decrypt_block(keys, crypto._encrypt_block(keys, plain)) == plain
    assert crypto.rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"


def words(data, password=b""):
    doc = Document(data, password)
    return [f["text"] for _, page in doc.pages() for kind, _, f in interp.Interpreter(doc, page).items() if kind == "text"]


TEXT = "Hello (World)\n\nsecond é line\\"


@pytest.mark.parametrize("method", ["rc4", "aes128", "aes256"])
def test_encryption(method):
    data = writer.text_pdf(TEXT, {"Title": "T中"}, encryption=writer.Encryption(method, b"user", b"owner", -3904, b"seed"))
    for password in (b"user", b"owner"):
        assert words(data, password) == ["Hello (World)", "second é line\\"]
    assert objects.text_string(Document(data, b"user").resolve(Document(data, b"user").trailer["Info"])["Title"]) == "T中"
    with pytest.raises(PdfError, match="InvalidPassword"):
        Document(data, b"wrong")


def test_cross_reference_stream_and_incremental():
    packed = writer.text_pdf(TEXT, {"Title": "a"}, xref_stream=True)
    assert words(packed) == ["Hello (World)", "second é line\\"] and any(e and e[2] for e in Document(packed).xref.values())
    base = writer.text_pdf(TEXT, {"Title": "a", "Author": "b"})
    new = edit.set_info(base, {"Title": "c"})
    row = next(RELATIONS["metadata"][0](Document(new)))
    assert new.startswith(base) and row[:2] == ("c", "b") and len(Document(new).sections) == 2


def test_broken_files():
    good = writer.text_pdf(TEXT)
    for data in (b"", b"junk", good[: len(good) // 2], good.replace(b"startxref", b"startxxxx"), good.replace(b"/Root", b"/Rood")):
        with pytest.raises(PdfError):
            Document(data).pages()


def test_cyclic_structures_end():
    b = writer.Builder()
    b.page(b"")
    data = b.build()
    d = edit.Draft(data)
    d.objects[2]["Kids"].append(Ref(2, 0))
    assert len(Document(d.bytes()).pages()) == 1
    form = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "Resources": {"XObject": {"X": Ref(9, 0)}}}, b"/X Do BT (in) Tj ET")
    page = next(n for n, x in d.objects.items() if isinstance(x, dict) and x.get("Type") == "Page")
    d.objects[9] = form
    d.objects[page] = d.objects[page] | {"Resources": {"XObject": {"X": Ref(9, 0)}}, "Contents": d.add(Stream({}, b"/X Do Q Q 1 Tf"))}
    assert words(d.bytes()) == ["in"]


def test_text_positions():
    b = writer.Builder()
    b.page(b"q 2 0 0 2 10 20 cm BT /F1 12 Tf 5 TL 100 70 Td (ab) Tj T* (c) Tj [(d) -500 (e)] TJ ET Q BT /F1 10 Tf 1 0 0 1 7 8 Tm 3 Ts (r) Tj ET")
    doc = Document(b.build())
    got = [(f["text"], f["x"], f["y"], f["width"], f["font_size"]) for _, _, f in interp.Interpreter(doc, doc.pages()[0][1]).items()]
    assert got == [("ab", 210, 160, 24, 12), ("c", 210, 150, 12, 12), ("d", 234, 150, 12, 12), ("e", 270, 150, 12, 12), ("r", 7, 11, 10, 10)]


def test_cmap():
    m = interp.CMap(b"1 beginbfchar <01> <0041> endbfchar 2 beginbfrange <02> <04> <0061> <05> <06> [<0078> <D83DDE00>] endbfrange").map
    assert m == {1: "A", 2: "a", 3: "b", 4: "c", 5: "x", 6: "😀"}


def test_page_edits():
    data = writer.text_pdf("\n".join(f"line {i}" for i in range(100)))
    assert words(edit.extract_pages(data, 1, 2)) == [f"line {i}" for i in range(40, 80)]
    assert words(edit.merge([data, data]))[100] == "line 0" and Document(edit.merge([data] * 3)).page_count() == 9
    assert words(edit.arrange_pages(data, [2, 0, 0]))[20] == "line 0"
    turned = Document(edit.set_page(data, 0, rotate=90, crop=(0, 0, 100, 200)))
    row = next(RELATIONS["pages"][0](turned))
    assert row[4:7] == (90, 200.0, 100.0)
    assert "line 0" not in words(edit.redact(data, [(0, 0, 730, 600, 760)])) and "line 2" in words(edit.redact(data, [(0, 0, 730, 600, 760)]))
    assert words(edit.watermark(data, "W", tile=(306, 396)))[-4:] == ["W"] * 4
    assert words(edit.optimize(data)) == words(data)


def test_forms_and_notes():
    data = edit.form([{"kind": "Text", "name": "a", "value": "x"}, {"kind": "Checkbox", "name": "b", "value": False}])
    rows = {r[2]: r for r in RELATIONS["form_fields"][0](Document(edit.fill_fields(data, {"a": "ü中", "b": "Yes"})))}
    assert rows["a"][4] == "ü中" and rows["b"][9] and rows["b"][3] == "Checkbox"
    assert not list(RELATIONS["form_fields"][0](Document(edit.flatten_fields(data)))) and words(edit.flatten_fields(data)) == ["x"]
    note = edit.annotate(data, 0, "Square", (1, 2, 3, 4), contents="c")
    assert [r[2] for r in RELATIONS["annotations"][0](Document(note))] == ["Widget", "Widget", "Square"]
    tree = list(RELATIONS["outline"][0](Document(edit.outline([("one", ["x", "y"]), ("two", [])]))))
    assert [(r[0], r[2], r[3]) for r in tree] == [([0], "one", 0), ([0, 0], "x", 0), ([0, 1], "y", 0), ([1], "two", 1)] or sorted(r[2] for r in tree) == ["one", "two", "x", "y"]


def items(body, **more):
    b = writer.Builder()
    b.page(body, **more)
    doc = Document(b.build())
    return [(kind, f) for kind, _, f in interp.Interpreter(doc, doc.pages()[0][1]).items()]


def test_redaction_leaves_what_is_outside():
    b = writer.Builder()
    b.page(b"q 5 0 0 5 400 400 cm BI /W 1 /H 1 /BPC 8 /CS /G ID x\nEI Q BT /F1 10 Tf 2 Tc 20 TL 72 700 Td (one) Tj [(two) -300 (three)] TJ (four) Tj T* (five) ' ET")
    before = {f["text"]: f["x"] for _, f in [(k, f) for k, _, f in interp.Interpreter(Document(b.build()), Document(b.build()).pages()[0][1]).items()] if "text" in f}
    doc = Document(edit.redact(b.build(), [(0, before["two"] + 1, 695, before["two"] + 9, 715)]))
    after = [(k, f) for k, _, f in interp.Interpreter(doc, doc.pages()[0][1]).items()]
    assert [k for k, _ in after].count("image") == 1
    assert {f["text"]: round(f["x"], 4) for _, f in after if "text" in f} == {t: round(x, 4) for t, x in before.items() if t not in ("two", "three")}


@pytest.mark.parametrize("head, data", [(b"/W 3 /H 2 /BPC 8 /CS /RGB", b" EI Q EI 1 2 EI Q"[:17] + b"z"), (b"/W 9 /H 1 /IM true", b"\xff\x00"), (b"/W 1 /H 1 /L 9", b"a EI Q EI"), (b"/W 1 /H 1 /F /Fl", b"ab EI \x00\x01\x02 z"), (b"/W 1 /H 1 /F /DCT", b"\xff\xd8 EI q \xff\xd9")])
def test_inline_images_end_where_their_data_does(head, data):
    ops = list(operations(b"BI " + head + b" ID " + data + b"\nEI\nBT (x) Tj ET"))
    assert [op for op, _ in ops] == ["BI", "BT", "Tj", "ET"] and ops[0][1][1] == data


def test_encodings_and_glyph_names():
    from folio.core import encoding

    assert [encoding.glyph(x) for x in ("eacute", "Scaron", "uni00E9", "u1F600", "f_i", "A.alt", "fi", "alpha", "Omega", "quoteright", "nosuchglyph", "germandbls", "ccedilla", "zcaron")] == ["é", "Š", "é", "😀", "fi", "A", "ﬁ", "α", "Ω", "’", None, "ß", "ç", "ž"]
    assert encoding.base("WinAnsiEncoding")[0x80] == "€" and encoding.base("MacRomanEncoding")[0x8E] == "é" and encoding.base("StandardEncoding")[0xAE] == "ﬁ" and encoding.base(None)[0xE9] == "é"
    names = encoding.of_font({"Differences": [65, Name("eacute"), Name("nosuch"), 200, Name("Euro")]}, lambda x: x)
    assert names[65] == "é" and names[66] == "B" and names[200] == "€" and names[0x27] == "’"
    fonts = {"F1": {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("X"), "Encoding": Name("MacRomanEncoding")}}
    assert [f["text"] for _, f in items(b"BT /F1 10 Tf (\x8e) Tj ET", Resources={"Font": fonts})] == ["é"]


def test_clips_and_shadings():
    got = items(b"q 0 0 50 50 re W n 10 10 100 100 re W* n /S sh Q q 1 1 2 2 re W f /S sh Q /S sh")
    assert [(k, f["bbox"]) for k, f in got] == [("shading", (10.0, 10.0, 50.0, 50.0)), ("fill", (1.0, 1.0, 3.0, 3.0)), ("shading", (1.0, 1.0, 3.0, 3.0)), ("shading", (0.0, 0.0, 612.0, 792.0))]
    assert items(b"0 1 0 rg /DeviceCMYK cs 0 0 1 1 re f")[0][1]["color"] == (0.0, 0.0, 0.0)


def test_annotations_deleted_and_flattened():
    data = edit.annotate(edit.annotate(writer.text_pdf("x"), 0, "Square", (1, 2, 3, 4), (1.0, 0.0, 0.0)), 0, "StrikeOut", (10, 10, 30, 20), (0.0, 0.0, 1.0), quads=[10, 20, 30, 20, 10, 10, 30, 10])
    assert [r[2] for r in RELATIONS["annotations"][0](Document(edit.delete_annotation(data, 0, 0)))] == ["StrikeOut"]
    flat = Document(edit.flatten_annotations(data))
    assert not list(RELATIONS["annotations"][0](flat))
    assert [(r[3], r[4]) for r in RELATIONS["display_items"][0](flat)][1:] == [("stroke", [1, 2, 3, 4]), ("stroke", [10, 15, 30, 15])]
    d = edit.Draft(data)
    page = d.flatten_tree()[0].num
    look = d.add(Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 10, 10]}, b"0 0 10 10 re f"))
    d.objects[page] = d.objects[page] | {"Annots": [d.add({"Subtype": Name("Stamp"), "Rect": [100, 100, 120, 140], "AP": {"N": look}}), d.add({"Subtype": Name("Square"), "Rect": [0, 0, 9, 9], "F": 2})]}
    flat = Document(edit.flatten_annotations(d.bytes()))
    assert [r[4] for r in RELATIONS["display_items"][0](flat)][1:] == [[100, 100, 120, 140]]


def test_text_replaced_pages_added_and_form_data():
    data = writer.text_pdf("one\ntwo\none")
    assert words(edit.replace_text(data, 0, "one", 73.0, 712.0, "néw")) == ["one", "two", "néw"]
    assert edit.replace_text(data, 0, "one", 90.0, 712.0, "x") is None
    more = Document(edit.add_blank_page(data, 0))
    assert more.page_count() == 2 and [len(list(interp.Interpreter(more, p).items())) for _, p in more.pages()] == [0, 3]
    assert edit.fdf_fields(edit.fdf({"a": "ü中", "b (c)": ""})) == {"a": "ü中", "b (c)": ""}
    assert edit.fdf_fields(b"<< /FDF << /Fields [ << /T (p) /Kids [ << /T (q) /V /Yes >> << /T (r) /V (z) >> ] >> ] >> >>") == {"p.q": "Yes", "p.r": "z"} and edit.fdf_fields(b"junk") == {}


@pytest.mark.parametrize("options", [{}, {"xref_stream": True}, {"compress": False}])
def test_pages_of_a_file_fed_in_parts(options):
    from folio.streaming.progressive import Progressive

    text = "\n".join(f"line {i} " + "x" * 300 for i in range(4000))
    data = writer.text_pdf(text, **options)
    for page in (0, 57, 99):
        held, fed = Progressive(len(data)), 0
        assert not held.ready(page)
        for _ in range(20):
            lacking = held.needed(page)
            if not lacking:
                break
            for a, b in lacking:
                held.feed(a, data[a:b])
                fed += b - a
        assert words(held.page_document(page)) == text.split("\n")[40 * page : 40 * page + 40]
        assert fed < len(data) or options
    with pytest.raises(PdfError):
        held.needed(100)


def test_archival_files():
    data = edit.convert_pdfa(writer.text_pdf("x", {"Title": "a < b", "Author": "c"}), "3b")
    facts = {r[0] for r in RELATIONS["facts"][0](Document(data))}
    assert {"catalog/Metadata", "catalog/OutputIntents"} <= facts and words(data) == ["x"] and b"<pdfaid:part>3</pdfaid:part>" in data and b"a &lt; b" in data


def test_flattened_fields_and_marks_keep_all_characters():
    data = edit.form([{"kind": "Text", "name": "a", "value": "ü中 €😀x"}, {"kind": "Text", "name": "b", "value": "plain"}])
    assert words(edit.flatten_fields(data)) == ["ü中 €😀x", "plain"]
    assert words(edit.watermark(writer.text_pdf("x"), "Žą"))[-1] == "Žą"
