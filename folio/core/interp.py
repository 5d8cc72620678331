"""The content interpreter: one ordered fold over a page's operations.

Rows it can give: text spans, display items (paths, text, images) and bounding
boxes of operations. Positions include the current matrix; widths and font
sizes are those of text space, as the reports of the original tools have them.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import Any

from . import encoding
from .objects import Document, Name, PdfError, Stream, operations

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
MAX_ERRORS, MAX_FORMS = 2000, 10
_STROKES = frozenset(("S", "s"))
_PAINTS = _STROKES | {"f", "F", "f*", "B", "B*", "b", "b*"}


def concat(m: Matrix, n: Matrix) -> Matrix:
    """m applied first, then n."""
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l)


def apply(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


class CMap:
    """Code to text, from a ToUnicode stream."""

    _TOKEN = re.compile(rb"<([0-9A-Fa-f\s]*)>|\[|\]|([A-Za-z]+)")

    def __init__(self, data: bytes):
        self.map: dict[int, str] = {}
        mode, row, inside = None, [], False
        for m in self._TOKEN.finditer(data):
            word = m.group(2)
            if word in (b"beginbfchar", b"beginbfrange"):
                mode, row = word, []
            elif word in (b"endbfchar", b"endbfrange"):
                mode = None
            elif mode and m.group() == b"[":
                inside = True
                row.append([])
            elif mode and m.group() == b"]":
                inside = False
            elif mode and m.group(1) is not None:
                (row[-1] if inside else row).append(re.sub(rb"\s", b"", m.group(1)))
            if mode == b"beginbfchar" and len(row) == 2:
                self.map[int(row[0] or b"0", 16)] = self.text(row[1])
                row = []
            elif mode == b"beginbfrange" and len(row) == 3 and not inside:
                lo, hi, to = int(row[0] or b"0", 16), int(row[1] or b"0", 16), row[2]
                if isinstance(to, list):
                    self.map |= {lo + i: self.text(x) for i, x in enumerate(to[: max(0, hi - lo + 1)])}
                elif hi >= lo and to:
                    first = self.text(to)
                    self.map |= {c: first[:-1] + chr(ord(first[-1]) + c - lo) for c in range(lo, min(hi, lo + 65535) + 1)} if first else {}
                row = []

    @staticmethod
    def text(digits: bytes) -> str:
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        return raw.decode("utf-16-be", "replace") if len(raw) > 1 else raw.decode("latin-1")


@lru_cache(64)
def _charmap(names: tuple[str, ...]) -> str | None:
    """Texts of all codes as a decoding table, if each is one character."""
    return "".join(names) if all(len(x) == 1 and x != "\ufffe" for x in names) else None


class Font:
    def __init__(self, doc: Document, d: dict, key: str):
        get = doc.resolve
        self.key = key
        self.base = re.sub(r"^[A-Z]{6}\+", "", str(get(d.get("BaseFont")) or key))
        self.composite = get(d.get("Subtype")) == "Type0"
        uni = get(d.get("ToUnicode"))
        self.cmap = CMap(doc.decode(uni)) if isinstance(uni, Stream) else None
        self.first, self.widths, self.default = 0, {}, 1000.0
        self.names, self.charmap = None, None
        if self.composite:
            kids = get(d.get("DescendantFonts")) or []
            kid = get(kids[0]) if kids else {}
            self.default = float(get(kid.get("DW", 1000)))
            row, w = [], [get(x) for x in get(kid.get("W")) or []]
            while w:
                row.append(w.pop(0))
                if len(row) == 2 and isinstance(row[1], list):
                    for i, x in enumerate(row[1]):
                        self.widths.setdefault(int(row[0]) + i, float(get(x)))
                    row = []
                elif len(row) == 3:
                    for c in range(int(row[0]), min(int(row[1]), int(row[0]) + 65535) + 1):
                        self.widths.setdefault(c, float(row[2]))
                    row = []
        else:
            self.names = encoding.of_font(get(d.get("Encoding")), get, symbolic=bool(int(get((get(d.get("FontDescriptor")) or {}).get("Flags")) or 0) & 4))
            self.charmap = _charmap(tuple(self.names)) if self.names else None
            first = int(get(d.get("FirstChar")) or 0)
            self.widths = {first + i: float(get(x)) for i, x in enumerate(get(d.get("Widths")) or [])}

    def codes(self, raw: bytes) -> list[int]:
        return [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)] if self.composite else list(raw)

    def text(self, codes: list[int]) -> str:
        if self.cmap:
            return "".join(self.cmap.map.get(c, "" if self.composite else self.names[c] if self.names else chr(c)) for c in codes)
        return "".join(map(chr, codes)) if self.composite or self.names is None else "".join(self.names[c] for c in codes)

    def decode(self, raw: bytes, codes: list[int]) -> str:
        """The text of a string with these codes."""
        if self.charmap and not self.cmap:
            return codecs.charmap_decode(raw, "strict", self.charmap)[0]
        return self.text(codes)

    def width(self, code: int) -> float:
        return self.widths.get(code, self.default)


class _State:
    __slots__ = ("ctm", "font", "size", "tc", "tw", "tz", "tl", "rise", "mode", "fill", "stroke", "width", "fill_alpha", "stroke_alpha", "blend", "clip")

    def __init__(self):
        self.ctm = IDENTITY
        self.font, self.size, self.tc, self.tw, self.tz, self.tl, self.rise, self.mode = None, 0.0, 0.0, 0.0, 100.0, 0.0, 0.0, 0
        self.fill, self.stroke, self.width, self.fill_alpha, self.stroke_alpha, self.blend = (0.0,), (0.0,), 1.0, 1.0, 1.0, "Normal"
        self.clip: tuple | None = None  # the box that clipping paths leave

    def copy(self) -> _State:
        out = _State.__new__(_State)
        out.ctm, out.font, out.size, out.tc, out.tw, out.tz, out.tl, out.rise = self.ctm, self.font, self.size, self.tc, self.tw, self.tz, self.tl, self.rise
        out.mode, out.fill, out.stroke, out.width, out.clip = self.mode, self.fill, self.stroke, self.width, self.clip
        out.fill_alpha, out.stroke_alpha, out.blend = self.fill_alpha, self.stroke_alpha, self.blend
        return out


# Initial colours of the device colour spaces.
INITIAL_COLORS = {"DeviceGray": (0.0,), "DeviceRGB": (0.0, 0.0, 0.0), "DeviceCMYK": (0.0, 0.0, 0.0, 1.0)}


def _within(a: tuple | None, b: tuple) -> tuple:
    """The common part of two boxes, empty at b's corner if there is none."""
    if a is None:
        return b
    x1, y1, x2, y2 = max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])
    return (x1, y1, max(x1, x2), max(y1, y2))


def rgb(c: tuple) -> tuple[float, float, float]:
    if len(c) == 1:
        return (c[0],) * 3
    if len(c) == 4:
        k = 1 - c[3]
        return tuple((1 - x) * k for x in c[:3])
    return tuple(c[:3]) if len(c) >= 3 else (0.0, 0.0, 0.0)


class Interpreter:
    """Runs a page's content. ``items`` gives (kind, op_index, fields) in paint order."""

    def __init__(self, doc: Document, page: dict):
        self.doc, self.page = doc, page
        self.fonts: dict[tuple[int, str], Font | None] = {}
        self.errors = 0
        #: By operation of the page itself: how far it moves the text position, and the move of one unit of font size.
        self.moves: dict[int, tuple[float, float]] = {}

    def items(self, ops: Iterable[tuple[str, list]] | None = None) -> Iterator[tuple[str, int, dict]]:
        """``ops``: the operations of the page's content, if they are read already."""
        resources = self.doc.resolve(self.page.get("Resources")) or {}
        yield from self._run(operations(self.doc.contents(self.page)) if ops is None else ops, resources, _State(), [])

    def _resource(self, resources: dict, kind: str, key: Any) -> Any:
        table = self.doc.resolve(resources.get(kind))
        return self.doc.resolve(table.get(key)) if isinstance(table, dict) else None

    def _font(self, resources: dict, key: str) -> Font | None:
        at = (id(resources), key)
        if at not in self.fonts:
            d = self._resource(resources, "Font", key)
            if isinstance(d, dict) and (id(d), key) not in self.doc.fonts:
                self.doc.fonts[id(d), key] = d, Font(self.doc, d, key)  # d is held, so its id stays its own
            self.fonts[at] = self.doc.fonts[id(d), key][1] if isinstance(d, dict) else None
        return self.fonts[at]

    def _run(self, ops: Iterable[tuple[str, list]], resources: dict, s: _State, forms: list) -> Iterator[tuple[str, int, dict]]:
        stack: list[_State] = []
        tm = tlm = IDENTITY
        path: list[tuple[str, float, float]] = []
        clipping = False

        def moved(index: int, by: float) -> None:
            if not forms:
                self.moves[index] = (self.moves.get(index, (0.0, 0.0))[0] + by, s.size * s.tz / 100)

        def show(raw: bytes, index: int) -> dict | None:
            nonlocal tm
            font = s.font
            codes = font.codes(raw) if font else list(raw)
            text = font.decode(raw, codes) if font else raw.decode("latin-1")
            h = s.tz / 100
            if font and font.widths:
                of, other, size = font.widths.get, font.default, s.size
                widths = [of(c, other) / 1000 * size for c in codes]
            else:  # all of one width
                widths = [(font.default if font else 1000.0) / 1000 * s.size] * len(codes)
            full = concat((1, 0, 0, 1, 0, s.rise), concat(tm, s.ctm))
            x, y = full[4], full[5]
            tc, tw = s.tc, 0.0 if font and font.composite else s.tw
            if tw:
                total = sum([(w + tc + (tw if c == 32 else 0.0)) * h for c, w in zip(codes, widths)])
            elif font and font.widths:
                total = sum([(w + tc + 0.0) * h for w in widths])
            else:
                total = sum([(widths[0] + tc + 0.0) * h] * len(widths)) if widths else 0
            tm = concat((1, 0, 0, 1, total, 0), tm)
            moved(index, total)
            if not text:
                return None
            scale = (full[2] ** 2 + full[3] ** 2) ** 0.5
            return {"text": text, "x": x, "y": y, "width": sum(widths), "font_size": s.size, "font_size_px": s.size * scale, "font_name": font.key if font else "", "base_font": font.base if font else "", "char_advances": widths, "char_cids": codes, "m2x2": list(full[:4]), "stroke_text": s.mode in (1, 2, 5, 6), "mode": s.mode, "color": rgb(s.fill), "raw": raw}

        for index, (op, a) in enumerate(ops):
            try:
                if op == "Tj":  # the most frequent ones first
                    if shown := show(a[0], index):
                        yield "text", index, shown
                elif op == "Tm":
                    tm = tlm = tuple(map(float, a[:6]))
                elif op == "BT":
                    tm = tlm = IDENTITY
                elif op == "Tf":
                    s.font, s.size = self._font(resources, a[0]), float(a[1])
                elif op == "q":
                    stack.append(s.copy())
                elif op == "Q":
                    s = stack.pop()
                elif op == "cm":
                    s.ctm = concat(tuple(map(float, a[:6])), s.ctm)
                elif op == "re":
                    x, y, w, h = map(float, a[:4])
                    ctm = s.ctm
                    path += [("m", *apply(ctm, x, y)), ("l", *apply(ctm, x + w, y)), ("l", *apply(ctm, x + w, y + h)), ("l", *apply(ctm, x, y + h))]
                elif op in _PAINTS:
                    if path:
                        xs, ys = [p[1] for p in path], [p[2] for p in path]
                        box = min(xs), min(ys), max(xs), max(ys)
                        if clipping:
                            s.clip, clipping = _within(s.clip, box), False
                        what, color, alpha = ("stroke", s.stroke, s.stroke_alpha) if op in _STROKES else ("fill", s.fill, s.fill_alpha)
                        yield what, index, {"bbox": box, "color": rgb(color), "alpha": alpha, "points": path, "line_width": s.width}
                    path = []
                elif op in ("Td", "TD"):
                    if op == "TD":
                        s.tl = -float(a[1])
                    tm = tlm = concat((1, 0, 0, 1, float(a[0]), float(a[1])), tlm)
                elif op == "T*":
                    tm = tlm = concat((1, 0, 0, 1, 0, -s.tl), tlm)
                elif op in ("'", '"'):
                    if op == '"':
                        s.tw, s.tc = float(a[0]), float(a[1])
                    tm = tlm = concat((1, 0, 0, 1, 0, -s.tl), tlm)
                    if shown := show(a[-1], index):
                        yield "text", index, shown
                elif op == "TJ":
                    for x in a[0]:
                        if isinstance(x, bytes):
                            if shown := show(x, index):
                                yield "text", index, shown
                        else:
                            by = -float(x) / 1000 * s.size * s.tz / 100
                            tm = concat((1, 0, 0, 1, by, 0), tm)
                            moved(index, by)
                elif op in ("Tc", "Tw", "Tz", "TL", "Ts"):
                    setattr(s, {"Tc": "tc", "Tw": "tw", "Tz": "tz", "TL": "tl", "Ts": "rise"}[op], float(a[0]))
                elif op == "Tr":
                    s.mode = int(a[0])
                elif op in ("g", "rg", "k", "sc", "scn"):
                    s.fill = tuple(float(x) for x in a if not isinstance(x, Name))
                elif op in ("G", "RG", "K", "SC", "SCN"):
                    s.stroke = tuple(float(x) for x in a if not isinstance(x, Name))
                elif op in ("cs", "CS"):
                    setattr(s, "fill" if op == "cs" else "stroke", INITIAL_COLORS.get(str(a[0]), (0.0,)))
                elif op in ("W", "W*"):
                    clipping = True
                elif op == "sh":
                    box = s.clip or tuple(float(self.doc.resolve(v)) for v in self.doc.resolve(self.page.get("MediaBox")) or (0, 0, 612, 792))
                    yield "shading", index, {"bbox": box, "name": str(a[0]), "alpha": s.fill_alpha}
                elif op == "w":
                    s.width = float(a[0])
                elif op == "gs":
                    d = self._resource(resources, "ExtGState", a[0]) or {}
                    s.fill_alpha, s.stroke_alpha = float(self.doc.resolve(d.get("ca", s.fill_alpha))), float(self.doc.resolve(d.get("CA", s.stroke_alpha)))
                    s.width, s.blend = float(self.doc.resolve(d.get("LW", s.width))), str(self.doc.resolve(d.get("BM", s.blend)))
                elif op in ("m", "l"):
                    path.append((op, *apply(s.ctm, float(a[0]), float(a[1]))))
                elif op in ("c", "v", "y"):
                    path.append((op, *apply(s.ctm, float(a[-2]), float(a[-1]))))
                elif op == "n":
                    if path and clipping:
                        xs, ys = [p[1] for p in path], [p[2] for p in path]
                        s.clip = _within(s.clip, (min(xs), min(ys), max(xs), max(ys)))
                    path, clipping = [], False
                elif op == "Do":
                    x = self._resource(resources, "XObject", a[0])
                    if isinstance(x, Stream):
                        yield from self._object(x, a[0], index, s, resources, forms)
                elif op == "BI":
                    yield "image", index, self._image({"Width": a[0].get("Width"), "Height": a[0].get("Height")}, "inline", s)
            except PdfError:
                raise
            except (IndexError, TypeError, ValueError, AttributeError, KeyError):
                self.errors += 1
                if self.errors > MAX_ERRORS:
                    raise PdfError("TooManyErrors", "content") from None

    def _image(self, d: dict, name: str, s: _State) -> dict:
        corners = [apply(s.ctm, *p) for p in ((0, 0), (1, 0), (1, 1), (0, 1))]
        xs, ys = [p[0] for p in corners], [p[1] for p in corners]
        return {"bbox": (min(xs), min(ys), max(xs), max(ys)), "name": name, "pixel_width": self.doc.resolve(d.get("Width")), "pixel_height": self.doc.resolve(d.get("Height"))}

    def _object(self, x: Stream, name: str, index: int, s: _State, resources: dict, forms: list) -> Iterator[tuple[str, int, dict]]:
        d = x.dict
        if self.doc.resolve(d.get("Subtype")) == "Image":
            yield "image", index, self._image(d, str(name), s)
        elif self.doc.resolve(d.get("Subtype")) == "Form" and len(forms) < MAX_FORMS and x not in forms:
            inner = s.copy()
            matrix = self.doc.resolve(d.get("Matrix"))
            if matrix:
                inner.ctm = concat(tuple(float(self.doc.resolve(v)) for v in matrix), inner.ctm)
            box = self.doc.resolve(d.get("BBox"))
            if box:
                x1, y1, x2, y2 = (float(self.doc.resolve(v)) for v in box)
                corners = [apply(inner.ctm, *p) for p in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))]
                inner.clip = _within(inner.clip, (min(p[0] for p in corners), min(p[1] for p in corners), max(p[0] for p in corners), max(p[1] for p in corners)))
            own = self.doc.resolve(d.get("Resources")) or resources
            for kind, _, fields in self._run(operations(self.doc.decode(x)), own, inner, [*forms, x]):
                yield kind, index, fields
