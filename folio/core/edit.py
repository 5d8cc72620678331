"""Changes to whole files: pages, merge, clean-up, redaction, marks, forms, metadata."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import Any

from . import writer
from .interp import Interpreter, concat
from .objects import Document, Lexer, Name, Ref, Stream, encode_text, operations, remap, targets, text_string

Zone = tuple[int, float, float, float, float]


#: Files up to this size are kept parsed, the last few of them: one file is often the start of many.
SMALL = 4096


def _parsed(data: bytes, password: bytes) -> tuple[Document, dict[int, Any]]:
    doc = Document(data, password)
    objects = {n: doc.get(n) for n in doc.xref if doc.xref[n] is not None}
    return doc, {n: x for n, x in objects.items() if not (isinstance(x, Stream) and x.dict.get("Type") in ("XRef", "ObjStm"))}


@lru_cache(4)
def _kept(data: bytes, password: bytes) -> tuple[Document, dict[int, Any], dict[int, Any], dict[int, tuple[Any, bytes]]]:
    """Also the objects of its flattened tree, and bytes of objects as writer.write takes them; both are filled when first needed."""
    return *_parsed(data, password), {}, {}


class Draft:
    """All objects of a file, to change and write again (without encryption). Values are replaced, never changed in place."""

    def __init__(self, data: bytes, password: bytes = b""):
        if len(data) <= SMALL:
            self.doc, self.base, self.flat, self.coded = _kept(data, password)
        else:
            (self.doc, self.base), self.flat, self.coded = _parsed(data, password), None, None
        self.objects: dict[int, Any] = dict(self.base)
        self.trailer = {k: v for k, v in self.doc.trailer.items() if k in ("Root", "Info", "ID")}

    def add(self, x: Any) -> Ref:
        n = max(self.objects, default=0) + 1
        self.objects[n] = x
        return Ref(n, 0)

    def flatten_tree(self) -> list[Ref]:
        """One level of pages, each with its inherited attributes; returns their references."""
        root = self.trailer["Root"]
        tree = self.objects[root.num]["Pages"]
        out = [Ref(num, 0) for num, _ in self.doc.pages()]
        fresh = self.flat is not None and all(self.objects.get(n) is x for n, x in self.base.items())
        if fresh and self.flat:
            self.objects |= self.flat
            return out
        for num, page in self.doc.pages():
            self.objects[num] = page | {"Parent": tree}
        self.set_pages(out)
        if fresh:
            self.flat |= {n: self.objects[n] for n in (tree.num, *(r.num for r in out))}
        return out

    def set_pages(self, refs: list[Ref]) -> None:
        tree = self.objects[self.trailer["Root"].num]["Pages"]
        self.objects[tree.num] = {"Type": Name("Pages"), "Kids": refs, "Count": len(refs)}

    def reachable(self) -> set[int]:
        seen, todo = set(), targets(self.trailer)
        while todo:
            n = todo.pop()
            if n not in seen and n in self.objects:
                seen.add(n)
                todo += targets(self.objects[n])
        return seen

    def collect(self) -> None:
        """Drops what can't be reached and numbers the rest from 1 on."""
        keep = sorted(self.reachable())
        to = {n: i + 1 for i, n in enumerate(keep)}
        self.objects = {to[n]: remap(self.objects[n], lambda m: to.get(m, 0)) for n in keep}
        self.trailer = remap(self.trailer, lambda m: to.get(m, 0))

    def bytes(self, **options: Any) -> bytes:
        if self.coded is not None:
            for n, x in self.objects.items():
                if n not in self.coded and (x is self.flat.get(n) or x is self.base.get(n) and n not in self.flat):
                    self.coded[n] = x, writer.whole(n, x)
        return writer.write(self.objects, self.trailer, coded=self.coded, **options)


def extract_pages(data: bytes, start: int, end: int, password: bytes = b"") -> bytes:
    """Pages start to end - 1 with all that they refer to."""
    d = Draft(data, password)
    d.set_pages(d.flatten_tree()[start:end])
    root = d.objects[d.trailer["Root"].num]
    d.objects[d.trailer["Root"].num] = {k: v for k, v in root.items() if k in ("Type", "Pages", "Version")}
    d.collect()
    return d.bytes()


def merge(files: list[bytes]) -> bytes:
    """All pages in order; numbers of later files are shifted, first outlines are chained."""
    out, shift, pages, outlines = {}, 2, [], []
    for data in files:
        d = Draft(data)
        refs = d.flatten_tree()
        by = shift
        out |= {n + by: remap(x, lambda m: m + by) for n, x in d.objects.items()}  # noqa: B023
        pages += [Ref(r.num + by, 0) for r in refs]
        top = d.doc.resolve(d.doc.root().get("Outlines"))
        if isinstance(top, dict) and isinstance(top.get("First"), Ref):
            outlines.append((Ref(top["First"].num + by, 0), Ref((top.get("Last") or top["First"]).num + by, 0)))
        shift += max(d.objects, default=0)
    tree = Ref(2, 0)
    for r in pages:
        out[r.num] = out[r.num] | {"Parent": tree}
    out[2] = {"Type": Name("Pages"), "Kids": pages, "Count": len(pages)}
    out[1] = {"Type": Name("Catalog"), "Pages": tree}
    if outlines:
        top = Ref(max(out) + 1, 0)
        for (_, last), (first, _) in zip(outlines, outlines[1:]):
            out[last.num] = out[last.num] | {"Next": first}
            out[first.num] = out[first.num] | {"Prev": last}
        out[top.num] = {"Type": Name("Outlines"), "First": outlines[0][0], "Last": outlines[-1][1]}
        out[1] |= {"Outlines": top}
    d = Draft.__new__(Draft)
    d.objects, d.trailer, d.coded = out, {"Root": Ref(1, 0)}, None
    d.collect()
    return d.bytes()


def optimize(data: bytes) -> bytes:
    """Unreachable objects go, equal streams become one, Flate and plain streams are compressed anew."""
    d = Draft(data)
    first: dict[str, int] = {}
    same: dict[int, int] = {}
    for n in sorted(d.reachable()):
        x = d.objects[n]
        if not isinstance(x, Stream):
            continue
        names = d.doc.resolve(x.dict.get("Filter"))
        if names is None or names == "FlateDecode" or names == ["FlateDecode"]:
            body = d.doc.decode(x)
            x = writer.flate(body, {k: v for k, v in x.dict.items() if k not in ("Length", "Filter", "DecodeParms")})
            d.objects[n] = x
        else:
            body = x.raw
        meta = writer.serialize({k: v for k, v in x.dict.items() if k != "Length"})
        same[n] = first.setdefault(hashlib.sha256(meta + body).hexdigest(), n)
    d.objects = {n: remap(x, lambda m: same.get(m, m)) for n, x in d.objects.items()}
    d.trailer = remap(d.trailer, lambda m: same.get(m, m))
    d.collect()
    return d.bytes()


def _overlaps(a: tuple, b: tuple) -> bool:
    return a[0] < b[2] and a[2] > b[0] and a[1] < b[3] and a[3] > b[1]


def redact(data: bytes, zones: list[Zone], color: tuple | None = (0.0, 0.0, 0.0)) -> bytes:
    """Drops every operation that shows something in a zone, covers the zones, and drops redaction annotations."""
    d = Draft(data)
    d.flatten_tree()
    for i, (num, page) in enumerate(d.doc.pages()):
        own = [z[1:] for z in zones if z[0] == i]
        if not own:
            continue
        every = list(operations(d.doc.contents(page)))
        gone, read = set(), Interpreter(d.doc, page)
        for what, op, f in read.items(every):
            box = f.get("bbox") or (f["x"], f["y"], f["x"] + f["width"], f["y"] + f["font_size"])
            if any(_overlaps(box, z) for z in own):
                gone.add(op)
        ops = []
        for n, (op, args) in enumerate(every):
            if n not in gone:
                ops.append((op, args))
            elif op in ("f", "F", "f*", "B", "B*", "b", "b*", "S", "s"):
                ops.append(("n", []))
            elif op in ("Tj", "TJ", "'", '"'):
                if op == '"':
                    ops += [("Tw", [args[0]]), ("Tc", [args[1]])]
                if op != "Tj" and op != "TJ":  # the move to the next line stays
                    ops.append(("T*", []))
                by, unit = read.moves.get(n, (0.0, 0.0))
                if by and unit:  # what follows on the line stays where it is
                    ops.append(("TJ", [[round(-by / unit * 1000, 6)]]))
        body = [("q", []), *ops, ("Q", [])]
        if color:
            body += [("q", []), ("rg", list(color))] + [("re", [z[0], z[1], z[2] - z[0], z[3] - z[1]]) for z in own] + [("f", []), ("Q", [])]
        new = d.objects[num] | {"Contents": d.add(writer.flate(writer.content(body)))}
        notes = d.doc.resolve(page.get("Annots"))
        if isinstance(notes, list):
            new["Annots"] = [a for a in notes if not isinstance(x := d.doc.resolve(a), dict) or x.get("Subtype") != "Redact"]
        d.objects[num] = new
    d.collect()
    return d.bytes()


def _layer(d: Draft, num: int, body: bytes, font: Ref | None = None, name: str = "FW") -> None:
    """Adds content over a page, with what is there enclosed in q and Q."""
    page = d.objects[num]
    res = dict(d.doc.resolve(page.get("Resources")) or {})
    if font:
        res["Font"] = dict(d.doc.resolve(res.get("Font")) or {}) | {name: font}
    was = page.get("Contents")
    was = d.doc.resolve(was) if isinstance(d.doc.resolve(was), list) else [was] if was is not None else []
    d.objects[num] = page | {"Resources": res, "Contents": [d.add(Stream({}, b"q\n")), *was, d.add(writer.flate(b"\nQ\n" + body))]}


def _font_for(d: Draft, texts: list[str]) -> tuple[Ref, dict[str, int]]:
    """A standard font whose codes from 128 on are given, by glyph names, to what of the texts isn't ASCII; the first 128 such characters."""
    more = list(dict.fromkeys(c for t in texts for c in t if ord(c) > 126))[:128]
    font: dict = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}
    if more:
        font["Encoding"] = {"Type": Name("Encoding"), "BaseEncoding": Name("WinAnsiEncoding"), "Differences": [128, *(Name(f"uni{ord(c):04X}" if ord(c) < 0x10000 else f"u{ord(c):X}") for c in more)]}
    return d.add(font), {c: 128 + i for i, c in enumerate(more)}


def _coded(text: str, codes: dict[str, int]) -> bytes:
    return bytes(codes.get(c, ord(c) if ord(c) < 127 else 63) for c in text)


def watermark(data: bytes, text: str, size: float = 48, angle: float = 45, gray: float = 0.8, tile: tuple[float, float] | None = None) -> bytes:
    """Text over each page: once in the middle, or on a grid of ``tile`` steps."""
    import math

    d = Draft(data)
    refs = d.flatten_tree()
    font, codes = _font_for(d, [text])
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    for r in refs:
        box = [float(d.doc.resolve(x)) for x in d.doc.resolve(d.objects[r.num].get("MediaBox")) or (0, 0, 612, 792)]
        w, h = box[2] - box[0], box[3] - box[1]
        at = [(box[0] + w / 2, box[1] + h / 2)] if not tile else [(box[0] + x * tile[0], box[1] + y * tile[1]) for y in range(math.ceil(h / tile[1])) for x in range(math.ceil(w / tile[0]))]
        ops = [("q", []), ("g", [gray]), ("BT", []), ("Tf", [Name("FW"), size])]
        for x, y in at:
            ops += [("Tm", [c, s, -s, c, x, y]), ("Tj", [_coded(text, codes)])]
        _layer(d, r.num, writer.content([*ops, ("ET", []), ("Q", [])]), font)
    d.collect()
    return d.bytes()


def arrange_pages(data: bytes, order: list[int]) -> bytes:
    """Pages by their old index: leaves out, repeats and moves as given."""
    d = Draft(data)
    refs, out, used = d.flatten_tree(), [], set()
    for i in order:
        r = refs[i]
        out.append(d.add(dict(d.objects[r.num])) if r in used else r)
        used.add(r)
    d.set_pages(out)
    d.collect()
    return d.bytes()


def set_page(data: bytes, index: int, rotate: int | None = None, crop: tuple | None = None) -> bytes:
    d = Draft(data)
    num = d.flatten_tree()[index].num
    if rotate is not None:
        d.objects[num] = d.objects[num] | {"Rotate": (int(d.doc.resolve(d.objects[num].get("Rotate")) or 0) + rotate) % 360}
    if crop:
        d.objects[num] = d.objects[num] | {"CropBox": list(crop)}
    return d.bytes()


def set_info(data: bytes, info: dict[str, str]) -> bytes:
    """An incremental update with changed metadata: the file's bytes stay in front."""
    doc = Document(data)
    old = doc.resolve(doc.trailer.get("Info")) or {}
    ref = doc.trailer.get("Info")
    size = int(doc.trailer.get("Size", max(doc.xref) + 1))
    num = ref.num if isinstance(ref, Ref) else size
    trailer = {k: v for k, v in doc.trailer.items() if k in ("Root", "ID")} | {"Info": Ref(num, 0)}
    return writer.append(data, {num: old | {k: encode_text(v) for k, v in info.items()}}, trailer, doc.startxref(), size)


def annotate(data: bytes, page: int, subtype: str, rect: tuple, color: tuple = (1.0, 1.0, 0.0), contents: str = "", quads: list[float] | None = None) -> bytes:
    d = Draft(data)
    num = d.flatten_tree()[page].num
    note = {"Type": Name("Annot"), "Subtype": Name(subtype), "Rect": list(rect), "C": list(color), "F": 4}
    note |= {"Contents": encode_text(contents)} if contents else {}
    note |= {"QuadPoints": quads} if quads else {}
    d.objects[num] = d.objects[num] | {"Annots": [*(d.doc.resolve(d.objects[num].get("Annots")) or []), d.add(note)]}
    return d.bytes()


def delete_annotation(data: bytes, page: int, index: int) -> bytes:
    """Without one annotation of a page; an index that isn't there is an error."""
    d = Draft(data)
    num = d.flatten_tree()[page].num
    notes = list(d.doc.resolve(d.objects[num].get("Annots")) or [])
    del notes[index]
    d.objects[num] = d.objects[num] | {"Annots": notes}
    d.collect()
    return d.bytes()


def _drawn(d: Draft, note: dict, forms: dict) -> list[tuple[str, list]]:
    """Operations that show an annotation: its appearance stream in its rectangle, else a plain shape by its kind."""
    get = d.doc.resolve
    rect = [float(get(x)) for x in get(note.get("Rect")) or (0, 0, 0, 0)]
    x1, y1, x2, y2 = min(rect[0], rect[2]), min(rect[1], rect[3]), max(rect[0], rect[2]), max(rect[1], rect[3])
    look = get(note.get("AP"))
    ref = look.get("N") if isinstance(look, dict) else None
    look = get(ref)
    if isinstance(look, dict):  # by state
        ref = look.get(str(get(note.get("AS"))))
        look = get(ref)
    if isinstance(look, Stream) and isinstance(ref, Ref):
        box = [float(get(x)) for x in get(look.dict.get("BBox")) or (0, 0, x2 - x1, y2 - y1)]
        m = tuple(float(get(x)) for x in get(look.dict.get("Matrix")) or (1, 0, 0, 1, 0, 0))
        corners = [(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]) for x in (box[0], box[2]) for y in (box[1], box[3])]
        left, low = min(p[0] for p in corners), min(p[1] for p in corners)
        wide, high = max(p[0] for p in corners) - left, max(p[1] for p in corners) - low
        sx, sy = (x2 - x1) / wide if wide else 1.0, (y2 - y1) / high if high else 1.0
        forms[name := f"FA{len(forms)}"] = ref
        return [("q", []), ("cm", [sx, 0, 0, sy, x1 - left * sx, y1 - low * sy]), ("Do", [Name(name)]), ("Q", [])]
    color = [float(get(x)) for x in get(note.get("C")) or (1.0, 1.0, 0.0)]
    paint = {1: ("g", "G"), 3: ("rg", "RG"), 4: ("k", "K")}.get(len(color))
    kind, quads = str(get(note.get("Subtype"))), [float(get(x)) for x in get(note.get("QuadPoints")) or []]
    if paint is None or kind in ("Link", "Popup", "Text"):
        return []
    boxes = [(min(q[::2]), min(q[1::2]), max(q[::2]), max(q[1::2])) for q in (quads[i : i + 8] for i in range(0, len(quads) - 7, 8))] or [(x1, y1, x2, y2)]
    ops: list[tuple[str, list]] = [("q", []), (paint[0], color), (paint[1], color)]
    for a, b, c, e in boxes:
        if kind == "Highlight":
            ops += [("re", [a, b, c - a, e - b]), ("f", [])]
        elif kind in ("Underline", "Squiggly", "StrikeOut"):
            y = (b + e) / 2 if kind == "StrikeOut" else b
            ops += [("m", [a, y]), ("l", [c, y]), ("S", [])]
    if kind == "Square":
        ops += [("re", [x1, y1, x2 - x1, y2 - y1]), ("S", [])]
    elif kind == "Line":
        ends = [float(get(x)) for x in get(note.get("L")) or (x1, y1, x2, y2)]
        ops += [("m", ends[:2]), ("l", ends[2:]), ("S", [])]
    return [*ops, ("Q", [])]


def flatten_annotations(data: bytes, pages: list[int] | None = None) -> bytes:
    """Annotations but for fields become page content; hidden ones only go."""
    d = Draft(data)
    for i, r in enumerate(d.flatten_tree()):
        if pages is not None and i not in pages:
            continue
        rest, ops, forms = [], [], {}
        for a in d.doc.resolve(d.objects[r.num].get("Annots")) or []:
            note = d.doc.resolve(a)
            if isinstance(note, dict) and str(d.doc.resolve(note.get("Subtype"))) == "Widget":
                rest.append(a)
            elif isinstance(note, dict) and not int(d.doc.resolve(note.get("F")) or 0) & 2:
                ops += _drawn(d, note, forms)
        if ops:
            res = dict(d.doc.resolve(d.objects[r.num].get("Resources")) or {})
            d.objects[r.num] = d.objects[r.num] | {"Resources": res | {"XObject": dict(d.doc.resolve(res.get("XObject")) or {}) | forms}}
            _layer(d, r.num, writer.content(ops))
        d.objects[r.num] = {k: v for k, v in d.objects[r.num].items() if k != "Annots"} | ({"Annots": rest} if rest else {})
    d.collect()
    return d.bytes()


def replace_text(data: bytes, page: int, old: str, x: float, y: float, new: str) -> bytes | None:
    """The first operation on the page that shows just ``old`` near a place shows ``new``; none if there isn't one.

    Near is within 2 units across and 0.6 of the font size up or down. ``new`` must be
    Latin-1 text, or of characters that the font's map gives codes.
    """
    d = Draft(data)
    num = d.flatten_tree()[page].num
    read = Interpreter(d.doc, d.objects[num])
    for what, op, f in read.items():
        if what == "text" and f["text"] == old and abs(f["x"] - x) <= 2.0 and abs(f["y"] - y) <= 0.6 * f["font_size"]:
            font = next((t for (_, key), t in read.fonts.items() if t and key == f["font_name"]), None)
            names = {t: bytes([c]) for c, t in reversed([*enumerate(font.names)])} if font and not font.composite and font.names else {}
            raw = b"".join(names.get(c) or c.encode("latin-1") for c in new)
            ops = list(operations(d.doc.contents(d.objects[num])))
            kind, args = ops[op]
            ops[op] = ("TJ", [[raw]]) if kind == "TJ" else (kind, [*args[:-1], raw])
            d.objects[num] = d.objects[num] | {"Contents": d.add(writer.flate(writer.content(ops)))}
            d.collect()
            return d.bytes()
    return None


def xmp(title: str = "", author: str = "", part: int = 1, conformance: str = "B") -> bytes:
    """A metadata packet that names the archival level."""
    from xml.sax.saxutils import escape

    said = f'<dc:title><rdf:Alt><rdf:li xml:lang="x-default">{escape(title)}</rdf:li></rdf:Alt></dc:title>' * bool(title) + f"<dc:creator><rdf:Seq><rdf:li>{escape(author)}</rdf:li></rdf:Seq></dc:creator>" * bool(author)
    return (
        '<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
        f'<rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:pdfaid="http://www.aiim.org/pdfa/ns/id/"><pdfaid:part>{part}</pdfaid:part><pdfaid:conformance>{conformance}</pdfaid:conformance>{said}</rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end="w"?>'
    ).encode()


def convert_pdfa(data: bytes, level: str = "1b") -> bytes:
    """Adds an output intent and metadata for level 1b, 2b or 3b, and drops scripts. Fonts are not embedded."""
    d = Draft(data)
    info = d.doc.resolve(d.doc.trailer.get("Info"))
    said = {k: text_string(d.doc.resolve(info.get(k))) or "" for k in ("Title", "Author")} if isinstance(info, dict) else {"Title": "", "Author": ""}
    num = d.trailer["Root"].num
    root = {k: v for k, v in d.objects[num].items() if k != "AA"}
    action = d.doc.resolve(root.get("OpenAction"))
    if isinstance(action, dict) and str(d.doc.resolve(action.get("S"))) == "JavaScript":
        del root["OpenAction"]
    tables = d.doc.resolve(root.get("Names"))
    if isinstance(tables, dict) and "JavaScript" in tables:
        root["Names"] = {k: v for k, v in tables.items() if k != "JavaScript"}
    root["Metadata"] = d.add(Stream({"Type": Name("Metadata"), "Subtype": Name("XML")}, xmp(said["Title"], said["Author"], int(level[0]), level[1:].upper())))
    root["OutputIntents"] = [{"Type": Name("OutputIntent"), "S": Name("GTS_PDFA1"), "OutputConditionIdentifier": b"sRGB", "Info": b"sRGB"}]
    d.objects[num] = root
    d.collect()
    return d.bytes()


def add_blank_page(data: bytes, at: int, box: tuple = (0, 0, 612, 792)) -> bytes:
    d = Draft(data)
    refs = d.flatten_tree()
    tree = d.objects[d.trailer["Root"].num]["Pages"]
    refs.insert(at, d.add({"Type": Name("Page"), "Parent": tree, "MediaBox": list(box), "Resources": {}}))
    d.set_pages(refs)
    return d.bytes()


def fdf(fields: dict[str, str]) -> bytes:
    """Form data of full names and values."""
    body = {"FDF": {"Fields": [{"T": encode_text(k), "V": encode_text(v)} for k, v in fields.items()]}}
    return b"%FDF-1.2\n1 0 obj\n" + writer.serialize(body) + b"\nendobj\ntrailer\n<< /Root 1 0 R >>\n%%EOF\n"


def fdf_fields(data: bytes) -> dict[str, str]:
    """Full names and values of form data; names of nested fields are joined by dots."""
    out: dict[str, str] = {}
    start = data.find(b"/Fields")
    if start < 0:
        return out
    stack = [("", x) for x in Lexer(data[start + 7 :]).value()]
    while stack:
        above, x = stack.pop()
        if isinstance(x, dict):
            part = text_string(x.get("T")) or ""
            full = f"{above}.{part}" if above and part else above or part
            stack += [(full, k) for k in x.get("Kids") or []]
            if "V" in x:
                out[full] = str(x["V"]) if isinstance(x["V"], Name) else text_string(x["V"]) or ""
    return out


def fill_fields(data: bytes, values: dict[str, str]) -> bytes:
    """Sets fields by full or partial name; a checkbox takes the name of a state or Off."""
    d = Draft(data)
    form = d.doc.resolve(d.doc.root().get("AcroForm")) or {}
    stack = [(r, "") for r in d.doc.resolve(form.get("Fields")) or []]
    while stack:
        r, above = stack.pop()
        x = d.doc.resolve(r)
        part = text_string(d.doc.resolve(x.get("T"))) or ""
        full = f"{above}.{part}" if above and part else above or part
        stack += [(k, full) for k in d.doc.resolve(x.get("Kids")) or []]
        value = values.get(full, values.get(part))
        if value is not None and isinstance(r, Ref):
            d.objects[r.num] = x | ({"V": Name(value), "AS": Name(value)} if d.doc.resolve(x.get("FT")) == "Btn" else {"V": encode_text(value)})
    return d.bytes()


def flatten_fields(data: bytes) -> bytes:
    """Text of fields becomes page content; fields and their widgets go."""
    d = Draft(data)
    refs = d.flatten_tree()
    for r in refs:
        notes = d.doc.resolve(d.objects[r.num].get("Annots")) or []
        widgets = [w for a in notes if isinstance(w := d.doc.resolve(a), dict) and d.doc.resolve(w.get("Subtype")) == "Widget"]
        shown = [(text_string(v) or "", rect) for w in widgets if isinstance(v := d.doc.resolve(w.get("V")), bytes) and (rect := d.doc.resolve(w.get("Rect")))]
        ops: list = []
        if shown:
            font, codes = _font_for(d, [t for t, _ in shown])
            for value, rect in shown:
                ops += [("BT", []), ("Tf", [Name("FW"), 10]), ("Td", [rect[0] + 2, rect[1] + 3]), ("Tj", [_coded(value, codes)]), ("ET", [])]
        if ops:
            _layer(d, r.num, writer.content(ops), font)
        rest = [a for a in notes if not isinstance(w := d.doc.resolve(a), dict) or d.doc.resolve(w.get("Subtype")) != "Widget"]
        d.objects[r.num] = {k: v for k, v in d.objects[r.num].items() if k != "Annots"} | ({"Annots": rest} if rest else {})
    root = d.trailer["Root"].num
    d.objects[root] = {k: v for k, v in d.objects[root].items() if k != "AcroForm"}
    d.collect()
    return d.bytes()


def form(fields: list[dict]) -> bytes:
    """A page with text, checkbox and combo fields: dicts of kind, name, value, and options for a combo."""
    b = writer.Builder()
    widgets = []
    for i, f in enumerate(fields):
        x = {"Type": Name("Annot"), "Subtype": Name("Widget"), "T": encode_text(f["name"]), "Rect": [72.0, 700.0 - 30 * i, 300.0, 720.0 - 30 * i], "F": 4}
        if f["kind"] == "Checkbox":
            state = Name("Yes" if f["value"] else "Off")
            x |= {"FT": Name("Btn"), "V": state, "AS": state}
        elif f["kind"] == "Combo":
            x |= {"FT": Name("Ch"), "Ff": 1 << 17, "V": encode_text(f["value"]), "Opt": [encode_text(o) for o in f["options"]]}
        else:
            x |= {"FT": Name("Tx"), "V": encode_text(f["value"] or "")}
        widgets.append(b.add(x))
    page = b.page(b"", Annots=widgets)
    for w in widgets:
        b.objects[w.num]["P"] = page
    b.root["AcroForm"] = {"Fields": widgets, "DA": b"/Helv 0 Tf 0 g"}
    return b.build()


def outline(chapters: list[tuple[str, list[str]]]) -> bytes:
    """A page for each chapter and a two-level outline: (title, child titles)."""
    b = writer.Builder()
    top = b.reserve()
    pages = [b.page(writer.lines_content([title])) for title, _ in chapters]

    def level(parent: Ref, items: list[tuple[str, list, Ref]]) -> dict:
        refs = [b.reserve() for _ in items]
        for i, (title, below, page) in enumerate(items):
            x = {"Title": encode_text(title), "Parent": parent, "Dest": [page, Name("Fit")]}
            x |= {"Prev": refs[i - 1]} if i else {}
            x |= {"Next": refs[i + 1]} if i + 1 < len(refs) else {}
            x |= level(refs[i], [(t, [], page) for t in below])
            b.objects[refs[i].num] = x
        return {"First": refs[0], "Last": refs[-1], "Count": len(refs)} if refs else {}

    b.objects[top.num] = {"Type": Name("Outlines")} | level(top, [(t, below, p) for (t, below), p in zip(chapters, pages)])
    b.root["Outlines"] = top
    return b.build()


__all__ = ["add_blank_page", "annotate", "arrange_pages", "concat", "convert_pdfa", "xmp", "delete_annotation", "fdf", "fdf_fields", "flatten_annotations", "replace_text", "extract_pages", "fill_fields", "flatten_fields", "form", "merge", "optimize", "outline", "redact", "set_info", "set_page", "watermark"]
