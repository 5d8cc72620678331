"""Rows of each relation of a parsed document. Plain Python."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from typing import Any

from .interp import Interpreter
from .objects import Document, Name, PdfError, Ref, Stream, operations, references, text_string


def plain(x: Any) -> Any:
    """A value as JSON: names, references and bytes are wrapped."""
    if isinstance(x, Ref):
        return {"$ref": list(x)}
    if isinstance(x, Name):
        return {"$name": str(x)}
    if isinstance(x, bytes):
        return {"$bytes": base64.b64encode(x).decode()}
    if isinstance(x, Stream):
        return {k: plain(v) for k, v in x.dict.items()}
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


def as_json(x: Any) -> str:
    return json.dumps(plain(x), ensure_ascii=False, separators=(",", ":"))


def kind(x: Any) -> str:
    return {type(None): "null", bool: "boolean", int: "integer", float: "real", bytes: "string", Name: "name", list: "array", dict: "dictionary", Stream: "stream", Ref: "reference"}[type(x)]


def numbers(doc: Document, x: Any, n: int | None = None) -> list[float] | None:
    x = doc.resolve(x)
    if not isinstance(x, list):
        return None
    out = [float(v) for v in map(doc.resolve, x) if isinstance(v, (int, float)) and not isinstance(v, bool)]
    return out if n is None or len(out) >= n else None


# Bits of /P, from the file format.
PERMISSIONS = (("print", 4), ("modify", 8), ("copy_text", 16), ("annotate", 32), ("fill_forms", 256), ("extract_accessibility", 512), ("assemble", 1024), ("print_hq", 2048))
INFO = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate", "Trapped")


def docs(doc: Document) -> Iterator[tuple]:
    form = doc.resolve(doc.root().get("AcroForm"))
    flags = doc.resolve(form.get("SigFlags")) if isinstance(form, dict) else 0
    encrypted = "Encrypt" in doc.trailer
    p = doc.security.permissions if doc.security else None
    version = doc.data[5:8].decode("latin-1") if doc.data.startswith(b"%PDF-") else None
    yield len(doc.data), version, doc.page_count(), encrypted, bool((flags or 0) & 1), p, as_json(doc.trailer)


def metadata(doc: Document) -> Iterator[tuple]:
    info = doc.resolve(doc.trailer.get("Info"))
    info = info if isinstance(info, dict) else {}
    found = [doc.resolve(info.get(k)) for k in INFO]
    yield tuple(str(x) if isinstance(x, Name) else text_string(x) for x in found)


def xref(doc: Document) -> Iterator[tuple]:
    for i, section in enumerate(doc.sections):
        for num, e in section["entries"].items():
            if e is None:
                yield i, num, 0, "free", None, None, None
            elif e[2]:
                yield i, num, 0, "compressed", None, e[0], e[1]
            else:
                yield i, num, e[1], "in_use", e[0], None, None


def _each(doc: Document) -> Iterator[tuple[int, Any]]:
    for num in sorted(doc.xref):
        if doc.xref[num] is not None:
            yield num, doc.get(num)


def objects(doc: Document, want: tuple[str, ...] = ("value",)) -> Iterator[tuple]:
    for num, x in _each(doc):
        d = x.dict if isinstance(x, Stream) else x if isinstance(x, dict) else {}
        text = lambda v: str(v) if isinstance(v := doc.resolve(v), Name) else None
        names = doc.resolve(d.get("Filter"))
        filters = [str(doc.resolve(f)) for f in names] if isinstance(names, list) else [str(names)] if names else []
        yield num, kind(x), text(d.get("Type")), text(d.get("Subtype")), as_json(x) if "value" in want else None, list(d), filters, x.raw if isinstance(x, Stream) else None


def refs(doc: Document) -> Iterator[tuple]:
    for path, num in references(doc.trailer):
        yield 0, num, path
    for src, x in _each(doc):
        for path, num in references(x):
            yield src, num, path


def streams(doc: Document) -> Iterator[tuple]:
    for num, x in _each(doc):
        if isinstance(x, Stream) and x.dict.get("Type") not in ("XRef", "ObjStm"):
            yield num, doc.decode(x)


def pages(doc: Document) -> Iterator[tuple]:
    for i, (num, page) in enumerate(doc.pages()):
        media = numbers(doc, page.get("MediaBox"), 4)
        crop = numbers(doc, page.get("CropBox"), 4) or media
        rotate = int(doc.resolve(page.get("Rotate")) or 0)
        w, h = (abs(crop[2] - crop[0]), abs(crop[3] - crop[1])) if crop else (None, None)
        if rotate % 180 == 90:
            w, h = h, w
        body = doc.resolve(page.get("Contents"))
        refs_ = body if isinstance(body, list) else [page.get("Contents")]
        yield i, num, media, crop, rotate, w, h, as_json(doc.resolve(page.get("Resources"))), [r.num for r in refs_ if isinstance(r, Ref)]


def ops(doc: Document, want: tuple[str, ...] = ("operands",)) -> Iterator[tuple]:
    for i, (_, page) in enumerate(doc.pages()):
        for n, (op, args) in enumerate(operations(doc.contents(page))):
            yield i, n, op, as_json(args) if "operands" in want else None


def spans(doc: Document) -> Iterator[tuple]:
    for i, (_, page) in enumerate(doc.pages()):
        n = 0
        for what, _, f in Interpreter(doc, page).items():
            if what == "text":
                yield i, n, f["text"], f["x"], f["y"], f["width"], f["font_size"], f["font_size_px"], f["font_name"], f["char_advances"], f["char_cids"], f["m2x2"], f["stroke_text"]
                n += 1


def display_items(doc: Document) -> Iterator[tuple]:
    for i, (_, page) in enumerate(doc.pages()):
        for n, (what, op, f) in enumerate(Interpreter(doc, page).items()):
            box = f.get("bbox") or (f["x"], f["y"], f["x"] + f["width"], f["y"] + f["font_size"])
            yield i, n, op, what, [float(v) for v in box], f.get("text"), [float(v) for v in f["color"]] if "color" in f else None


def form_fields(doc: Document) -> Iterator[tuple]:
    form = doc.resolve(doc.root().get("AcroForm"))
    if not isinstance(form, dict):
        return
    where = {num: i for i, (num, _) in enumerate(doc.pages())}
    by_annotation = {r.num: i for i, (_, p) in enumerate(doc.pages()) for r in doc.resolve(p.get("Annots")) or [] if isinstance(r, Ref)}
    stack = [(r, "", {}) for r in reversed(doc.resolve(form.get("Fields")) or [])]
    seen: set[int] = set()
    while stack:
        ref, above, inherited = stack.pop()
        d = doc.resolve(ref)
        num = ref.num if isinstance(ref, Ref) else 0
        if not isinstance(d, dict) or (num and num in seen):
            continue
        seen.add(num)
        part = text_string(doc.resolve(d.get("T")))
        full = ".".join(x for x in (above, part) if x)
        own = inherited | {k: doc.resolve(d[k]) for k in ("FT", "Ff", "V", "DV", "MaxLen") if k in d}
        kids = doc.resolve(d.get("Kids")) or []
        if kids and any(isinstance(k := doc.resolve(x), dict) and "T" in k for x in kids):
            stack += [(k, full, own) for k in reversed(kids)]
            continue
        flags, ft = int(own.get("Ff") or 0), str(own.get("FT") or "")
        kind_ = {"Tx": "Text", "Sig": "Signature", "Ch": "Combo" if flags >> 17 & 1 else "List", "Btn": "Radio" if flags >> 15 & 1 else "Checkbox"}.get(ft, "Unknown")
        say = lambda x: str(x) if isinstance(x, Name) else text_string(x)
        options = [text_string(doc.resolve((doc.resolve(o) or [b""])[0] if isinstance(doc.resolve(o), list) else o)) for o in doc.resolve(d.get("Opt")) or []]
        state = doc.resolve(d.get("AS"))
        page = where.get(p.num) if isinstance(p := d.get("P"), Ref) else by_annotation.get(num, 0)
        yield num, part, full, kind_, say(own.get("V")), say(own.get("DV")), numbers(doc, d.get("Rect")), page or 0, options, state is not None and str(state) not in ("", "Off"), bool(flags & 1), bool(flags >> 1 & 1), bool(flags >> 12 & 1), own.get("MaxLen")


def annotations(doc: Document) -> Iterator[tuple]:
    for i, (_, page) in enumerate(doc.pages()):
        for n, ref in enumerate(doc.resolve(page.get("Annots")) or []):
            a = doc.resolve(ref)
            if isinstance(a, dict) and (sub := doc.resolve(a.get("Subtype"))):
                yield i, n, str(sub), numbers(doc, a.get("Rect")) or [0.0] * 4, numbers(doc, a.get("C")) or [1.0, 1.0, 0.0], numbers(doc, a.get("QuadPoints")) or [], text_string(doc.resolve(a.get("Contents")))


def outline(doc: Document) -> Iterator[tuple]:
    top = doc.resolve(doc.root().get("Outlines"))
    where = {num: i for i, (num, _) in enumerate(doc.pages())}
    stack = [(top.get("First"), [0], 0)] if isinstance(top, dict) and top.get("First") else []
    seen: set[int] = set()
    while stack:
        ref, path, depth = stack.pop()
        d = doc.resolve(ref)
        if not isinstance(d, dict) or (isinstance(ref, Ref) and ref.num in seen):
            continue
        if isinstance(ref, Ref):
            seen.add(ref.num)
        dest = doc.resolve(d.get("Dest"))
        target = dest[0] if isinstance(dest, list) and dest else None
        count = doc.resolve(d.get("Count")) or 0
        yield path, depth, text_string(doc.resolve(d.get("Title"))), where.get(target.num) if isinstance(target, Ref) else target if isinstance(target, int) else None, count > 0
        if d.get("Next"):
            stack.append((d["Next"], [*path[:-1], path[-1] + 1], depth))
        if d.get("First"):
            stack.append((d["First"], [*path, 0], depth + 1))


def _tree(doc: Document, ref: Any, key: str) -> Iterator[tuple[Any, Any]]:
    stack, seen = [ref], set()
    while stack:
        r = stack.pop()
        if isinstance(r, Ref):
            if r.num in seen:
                continue
            seen.add(r.num)
        d = doc.resolve(r)
        if isinstance(d, dict):
            rows = doc.resolve(d.get(key)) or []
            yield from zip(map(doc.resolve, rows[::2]), rows[1::2])
            stack += reversed(doc.resolve(d.get("Kids")) or [])


def label_ranges(doc: Document) -> Iterator[tuple]:
    for start, d in _tree(doc, doc.root().get("PageLabels"), "Nums"):
        d = doc.resolve(d)
        style = doc.resolve(d.get("S"))
        yield start, str(style) if style else None, text_string(doc.resolve(d.get("P"))) or "", int(doc.resolve(d.get("St")) or 1)


def names(doc: Document) -> Iterator[tuple]:
    tables = doc.resolve(doc.root().get("Names"))
    for table, ref in tables.items() if isinstance(tables, dict) else ():
        for i, (k, v) in enumerate(_tree(doc, ref, "Names")):
            yield str(table), text_string(k), as_json(doc.resolve(v)), i
    old = doc.resolve(doc.root().get("Dests"))
    for i, (k, v) in enumerate(old.items() if isinstance(old, dict) else ()):
        yield "Dests", str(k), as_json(doc.resolve(v)), i


def destinations(doc: Document) -> Iterator[tuple]:
    """Named destinations: those of the name tree, then old ones whose name isn't there; a dictionary's /D counts."""
    where = {num: i for i, (num, _) in enumerate(doc.pages())}
    tables, old, seen = doc.resolve(doc.root().get("Names")), doc.resolve(doc.root().get("Dests")), set()
    found = [(text_string(k), v) for k, v in _tree(doc, tables.get("Dests"), "Names")] if isinstance(tables, dict) else []
    for name, v in found + [(str(k), v) for k, v in (old.items() if isinstance(old, dict) else ())]:
        v = doc.resolve(v)
        v = doc.resolve(v.get("D")) if isinstance(v, dict) else v
        if name in seen or not isinstance(v, list) or not v:
            continue
        seen.add(name)
        page = where.get(v[0].num) if isinstance(v[0], Ref) else v[0] if isinstance(v[0], int) else None
        rest = [doc.resolve(x) for x in v[1:]]
        yield name, page, str(rest[0]) if rest else None, [float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None for x in rest[1:]]


def _script(doc: Document, action: Any) -> str | None:
    """The text of a JavaScript action, a string or a stream."""
    a = doc.resolve(action)
    if not isinstance(a, dict) or str(doc.resolve(a.get("S"))) != "JavaScript":
        return None
    js = doc.resolve(a.get("JS"))
    return text_string(doc.decode(js)) if isinstance(js, Stream) else text_string(js)


def scripts(doc: Document) -> Iterator[tuple]:
    """JavaScript by place: on opening, by name, and by event of the file, its pages, annotations and fields."""
    root = doc.root()

    def events(place: str, d: Any) -> Iterator[tuple]:
        table = doc.resolve(d.get("AA")) if isinstance(d, dict) else None
        for event, action in table.items() if isinstance(table, dict) else ():
            if (js := _script(doc, action)) is not None:
                yield place, str(event), js

    if (js := _script(doc, root.get("OpenAction"))) is not None:
        yield "catalog", "OpenAction", js
    yield from events("catalog", root)
    tables = doc.resolve(root.get("Names"))
    for name, action in _tree(doc, tables.get("JavaScript"), "Names") if isinstance(tables, dict) else ():
        if (js := _script(doc, action)) is not None:
            yield "names", text_string(name), js
    for i, (_, page) in enumerate(doc.pages()):
        yield from events(f"page {i}", page)
        for n, ref in enumerate(doc.resolve(page.get("Annots")) or []):
            note = doc.resolve(ref)
            if isinstance(note, dict):
                if (js := _script(doc, note.get("A"))) is not None:
                    yield f"annotation {i}/{n}", "A", js
                yield from events(f"annotation {i}/{n}", note)


def xfa(doc: Document) -> Iterator[tuple]:
    """Packets of an XFA form in order: names and streams in turn, or one stream."""
    form = doc.resolve(doc.root().get("AcroForm"))
    entry = doc.resolve(form.get("XFA")) if isinstance(form, dict) else None
    packets = [(text_string(doc.resolve(k)), v) for k, v in zip(entry[::2], entry[1::2])] if isinstance(entry, list) else [("", entry)] if entry is not None else []
    for i, (name, body) in enumerate(packets):
        body = doc.resolve(body)
        if isinstance(body, Stream):
            yield i, name, doc.decode(body).decode("utf-8", "replace")


def struct_nodes(doc: Document) -> Iterator[tuple]:
    root = doc.resolve(doc.root().get("StructTreeRoot"))
    if not isinstance(root, dict):
        return
    roles = doc.resolve(root.get("RoleMap")) or {}
    many = lambda k: k if isinstance(k, list) else [] if k is None else [k]
    stack = [(k, [i], 0) for i, k in reversed([*enumerate(many(doc.resolve(root.get("K"))))])]
    seen: set[int] = set()
    while stack:
        ref, path, depth = stack.pop()
        d = doc.resolve(ref)
        if not isinstance(d, dict) or (isinstance(ref, Ref) and ref.num in seen):
            continue
        if isinstance(ref, Ref):
            seen.add(ref.num)
        kids = many(doc.resolve(d.get("K")))
        mcids, below = [], []
        for k in kids:
            v = doc.resolve(k)
            if isinstance(v, int):
                mcids.append(v)
            elif isinstance(v, dict) and v.get("Type") == "MCR":
                mcids.append(doc.resolve(v.get("MCID")))
            elif isinstance(v, dict) and v.get("Type") != "OBJR":
                below.append(k)
        role = str(doc.resolve(d.get("S")) or "")
        yield path, depth, role, str(doc.resolve(roles.get(role)) or role), text_string(doc.resolve(d.get("Alt"))), mcids
        stack += [(k, [*path, i], depth + 1) for i, k in reversed([*enumerate(below)])]


def signatures(doc: Document) -> Iterator[tuple]:
    form = doc.resolve(doc.root().get("AcroForm"))
    for ref in (doc.resolve(form.get("Fields")) or []) if isinstance(form, dict) else ():
        d = doc.resolve(ref)
        v = doc.resolve(d.get("V")) if isinstance(d, dict) and doc.resolve(d.get("FT")) == "Sig" else None
        if isinstance(v, dict):
            r = [int(x) for x in numbers(doc, v.get("ByteRange")) or []]
            parts = b"".join(doc.data[a : a + n] for a, n in zip(r[::2], r[1::2]))
            whole = len(r) == 4 and r[0] == 0 and r[2] + r[3] == len(doc.data)
            yield text_string(doc.resolve(d.get("T"))), str(doc.resolve(v.get("SubFilter")) or ""), r, whole, hashlib.sha256(parts).hexdigest(), text_string(doc.resolve(v.get("Name"))), text_string(doc.resolve(v.get("Reason")))


STANDARD_FONTS = {f"{a}{b}" for a, bs in (("Helvetica", ("", "-Bold", "-Oblique", "-BoldOblique")), ("Courier", ("", "-Bold", "-Oblique", "-BoldOblique")), ("Times", ("-Roman", "-Bold", "-Italic", "-BoldItalic")), ("Symbol", ("",)), ("ZapfDingbats", ("",))) for b in bs}


def facts(doc: Document) -> Iterator[tuple]:
    """(fact, obj_num, value) rows that conformance rules are queries over; every file has one at least."""
    yield "file", None, None
    root = doc.root()
    for key in ("OutputIntents", "Metadata"):
        if key in root:
            yield f"catalog/{key}", None, None
    if "Encrypt" in doc.trailer:
        yield "trailer/Encrypt", None, None
    tables = doc.resolve(root.get("Names"))
    if isinstance(tables, dict) and "JavaScript" in tables:
        yield "names/JavaScript", None, None
    done: set = set()
    for _, page in doc.pages():
        resources = doc.resolve(page.get("Resources")) or {}
        for key, ref in (doc.resolve(resources.get("Font")) or {}).items():
            num = ref.num if isinstance(ref, Ref) else None
            d = doc.resolve(ref)
            if (num or key) in done or not isinstance(d, dict):
                continue
            done.add(num or key)
            kids = doc.resolve(d.get("DescendantFonts"))
            own = doc.resolve(kids[0]) if kids else d
            base = str(doc.resolve(d.get("BaseFont")) or "")
            desc = doc.resolve(own.get("FontDescriptor"))
            embedded = isinstance(desc, dict) and any(k in desc for k in ("FontFile", "FontFile2", "FontFile3"))
            yield ("font/standard" if base in STANDARD_FONTS else "font/embedded" if embedded else "font/missing"), num, base
        for ref in (doc.resolve(resources.get("ExtGState")) or {}).values():
            d = doc.resolve(ref)
            if isinstance(d, dict) and (doc.resolve(d.get("BM", "Normal")) != "Normal" or any(doc.resolve(d.get(k, 1)) != 1 for k in ("ca", "CA"))):
                yield "extgstate/transparent", ref.num if isinstance(ref, Ref) else None, None
    for num, x in _each(doc):
        if isinstance(x, Stream) and "F" in x.dict:
            yield "stream/external", num, None


#: name -> (rows, Spark schema without doc_id)
RELATIONS = {
    "docs": (docs, "n_bytes long, version string, page_count int, encrypted boolean, signed boolean, permission_bits int, trailer string"),
    "metadata": (metadata, "title string, author string, subject string, keywords string, creator string, producer string, creation_date string, mod_date string, trapped string"),
    "xref": (xref, "section int, obj_num int, gen int, kind string, offset long, stm_obj int, stm_index int"),
    "objects": (objects, "obj_num int, kind string, type_name string, subtype string, value string, keys array<string>, filters array<string>, raw binary"),
    "refs": (refs, "src_obj int, dst_obj int, path string"),
    "streams": (streams, "obj_num int, data binary"),
    "pages": (pages, "page_index int, page_obj int, media_box array<double>, crop_box array<double>, rotate int, width double, height double, resources string, content_objs array<int>"),
    "ops": (ops, "page_index int, op_idx int, operator string, operands string"),
    "spans": (spans, "page_index int, span_idx int, text string, x double, y double, width double, font_size double, font_size_px double, font_name string, char_advances array<double>, char_cids array<int>, m2x2 array<double>, stroke_text boolean"),
    "display_items": (display_items, "page_index int, item_idx int, op_idx int, kind string, bbox array<double>, text string, color array<double>"),
    "form_fields": (form_fields, "obj_num int, name string, full_name string, field_type string, value string, default_value string, rect array<double>, page_index int, options array<string>, checked boolean, readonly boolean, required boolean, multiline boolean, max_len int"),
    "annotations": (annotations, "page_index int, annot_idx int, subtype string, rect array<double>, color array<double>, quad_points array<double>, contents string"),
    "outline": (outline, "path array<int>, depth int, title string, dest_page int, open boolean"),
    "label_ranges": (label_ranges, "start int, style string, prefix string, first int"),
    "names": (names, "table_name string, key string, value string, pos int"),
    "struct_nodes": (struct_nodes, "path array<int>, depth int, role string, mapped_role string, alt string, mcids array<int>"),
    "signatures": (signatures, "field string, sub_filter string, byte_range array<long>, covers_whole_file boolean, sha256 string, signer string, reason string"),
    "destinations": (destinations, "name string, page_index int, fit string, position array<double>"),
    "scripts": (scripts, "place string, event string, script string"),
    "xfa": (xfa, "packet int, name string, xml string"),
    "facts": (facts, "fact string, obj_num int, value string"),
}

#: Relations whose functions leave out what costs much, if it isn't among the columns wanted.
LAZY = {"objects", "ops"}


__all__ = ["LAZY", "RELATIONS", "Document", "PdfError"]
