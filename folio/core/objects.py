"""PDF values, lexing and document structure. Plain Python: no Spark here."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any, NamedTuple

from . import crypto, filters


class PdfError(Exception):
    """A failure with a code and the byte offset where it was found."""

    def __init__(self, code: str, message: str, offset: int = -1):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.offset = code, message, offset


class Name(str):
    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


class Stream:
    __slots__ = ("dict", "raw")

    def __init__(self, d: dict, raw: bytes):
        self.dict, self.raw = d, raw


class Keyword(str):
    __slots__ = ()


_WS = b"\x00\t\n\x0c\r "
_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_OCTAL = re.compile(rb"[0-7]{1,3}")
_PLAIN = re.compile(rb"[^()\\]*")
_ENTRY = re.compile(rb"(?>(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*)(\d+)\s+(\d+)\s+([nf])")
_OBJ = re.compile(rb"(?>(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*)(\d+)\s+(\d+)\s+obj")
_STARTXREF = re.compile(rb"startxref[\x00\t\n\x0c\r ]+(\d+)")
_END = object()

# One token after blanks and comments, by group: name, string without brackets and escapes in it,
# integer with what makes it a reference, dictionary, array, real, other word, string, hex string, end marks.
_REGULAR = rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]"
_TOKEN = re.compile(
    rb"(?>(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*)(?:/(REG*+)|\(([^()\\]*+)\)|([+-]?\d+)(?!REG)(?:[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?!REG))?"
    rb"|(<<)|(\[)|([+-]*(?:\d+\.?\d*|\.\d+))(?!REG)|(REG++)|(\()|(<)|(>>?)|([\]{})]))".replace(b"REG", _REGULAR)
)
# Tokens of content, where nothing is a reference; the groups are the same.
_CONTENT = re.compile(_TOKEN.pattern.replace(rb"(?:[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?!" + _REGULAR + rb"))?", rb"((?!))?"))
_NAME, _STRING, _INT, _REF, _DICT, _ARRAY, _REAL, _WORD, _OPEN, _HEX, _CLOSE, _MARK = range(1, 13)


@lru_cache(4096)
def _name(raw: bytes) -> Name:
    return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x.group(1), 16)]), raw).decode("utf-8", "replace"))


@lru_cache(1024)
def _keyword(raw: bytes) -> Any:
    return {b"true": True, b"false": False, b"null": None}.get(raw, Keyword(raw.decode("latin-1")))


@lru_cache(1024)
def _operator(raw: bytes) -> str | None:
    """A word of content as an operator; none if it is a value."""
    x = _keyword(raw)
    return str(x) if isinstance(x, Keyword) else None


def _real(token: bytes) -> float:
    sign = -1.0 if token.lstrip(b"+").startswith(b"-") else 1.0
    return sign * float(token.lstrip(b"+-"))


class Lexer:
    """Reads values from ``data`` from ``pos`` on; ``refs`` says whether ``n g R`` is a reference."""

    def __init__(self, data: bytes, pos: int = 0, refs: bool = True):
        self.data, self.pos, self.refs = data, pos, refs

    def skip(self) -> None:
        self.pos = _SKIP.match(self.data, self.pos).end()

    def value(self) -> Any:
        """The next value, Keyword, or the end marker."""
        data, pos, match = self.data, self.pos, _TOKEN.match
        above: list[tuple] = []  # containers around the one being read, each with its key and start
        inside: Any = None
        key, start = None, pos
        while True:
            m = match(data, pos)
            if m is None:  # every other byte begins a token
                self.pos = max(pos, len(data))
                if inside is not None:
                    raise PdfError("UnexpectedEof", "array not closed" if type(inside) is list else "dictionary not closed", start)
                return _END
            kind, pos = m.lastindex, m.end()
            if kind == _NAME:
                x = _name(m[1])
            elif kind == _STRING:
                x = m[2]
            elif kind == _INT:
                x = self._integer(m)
            elif kind == _REF:
                x = self._integer(m)
                if self.refs and x >= 0:
                    x = Ref(x, int(m[4]))
                else:
                    pos = m.end(3)
            elif kind == _DICT or kind == _ARRAY:
                above.append((inside, key, start))
                inside, key, start = ({}, None, pos) if kind == _DICT else ([], None, m.start(_ARRAY))
                continue
            elif kind == _REAL:
                x = _real(m[7])
            elif kind == _OPEN or kind == _HEX:
                self.pos = m.start(kind)
                x = self._literal() if kind == _OPEN else self._hex()
                pos = self.pos
            else:
                x = _keyword(m[8] if kind == _WORD else m[12] if kind == _MARK else b">>")
            if inside is None:
                self.pos = pos
                return x
            if isinstance(x, Keyword):
                if x != ("]" if type(inside) is list else ">>"):
                    key = None
                    continue
                x, (inside, key, start) = inside, above.pop()
                if inside is None:
                    self.pos = pos
                    return x
            if type(inside) is list:
                inside.append(x)
            elif key is not None:
                inside[key] = x
                key = None
            elif isinstance(x, Name):
                key = x

    @staticmethod
    def _integer(m: re.Match) -> int:
        n = int(m[_INT])
        if not -(2**63) <= n < 2**63:
            raise PdfError("InvalidNumber", m[_INT].decode(), m.start(_INT))
        return n

    def _literal(self) -> bytes:
        data, i, depth, out = self.data, self.pos + 1, 1, bytearray()
        while True:
            m = _PLAIN.match(data, i)
            out += m.group()
            i = m.end()
            if i >= len(data):
                raise PdfError("UnexpectedEof", "string not closed", self.pos)
            c = data[i : i + 1]
            if c == b"\\":
                e = data[i + 1 : i + 2]
                if e in _ESCAPES and e:
                    out += _ESCAPES[e]
                    i += 2
                elif e and e in b"01234567":
                    m = _OCTAL.match(data, i + 1)
                    out.append(int(m.group(), 8) & 255)
                    i = m.end()
                elif e in (b"\r", b"\n"):
                    i += 3 if data[i + 1 : i + 3] == b"\r\n" else 2
                else:
                    out += e
                    i += 2
                continue
            if c == b"(":
                depth += 1
            else:
                depth -= 1
                if not depth:
                    self.pos = i + 1
                    return bytes(out)
            out += c
            i += 1

    def _hex(self) -> bytes:
        end = self.data.find(b">", self.pos)
        if end < 0:
            raise PdfError("UnexpectedEof", "hex string not closed", self.pos)
        digits = self.data[self.pos + 1 : end]
        self.pos = end + 1
        try:
            return bytes.fromhex(digits.decode("latin-1"))
        except ValueError:  # an odd number of digits, or other characters between them
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", digits)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


@lru_cache(1024)
def _small(raw: bytes, mark: bytes) -> Any:
    """The value before a mark that ends ``raw``; _END if it must be read where it stands.

    Small objects of many files are the same bytes, so the last ones are kept. Values are never changed in place.
    """
    lex = Lexer(raw)
    try:
        x = lex.value()
    except PdfError:
        return _END
    lex.skip()
    if lex.pos + len(mark) != len(raw) or isinstance(x, Keyword):
        return _END
    return x


#: Up to so many bytes are looked through for the end of a small object.
SMALL = 300


# Content of numbers, names and other words between blanks only, none of them too long to be a number of 64 bits.
_WORDS = re.compile(rb"[\t\n\x0c\r ]*+(?:/?[!-$&'*-.0-;=?-Z\\^-z|~]{1,18}+(?:[\t\n\x0c\r ]++|\Z))*+\Z")


@lru_cache(4096)
def _word(raw: bytes) -> tuple[str | None, Any]:
    """A word of content: an operator, or none and a value."""
    m = _CONTENT.match(raw)
    kind = m.lastindex
    if kind == _WORD:
        return _operator(raw), _keyword(raw)
    return None, _name(m[1]) if kind == _NAME else int(raw) if kind == _INT else _real(raw)


def operations(content: bytes) -> Iterator[tuple[str, list]]:
    """Content operations; an inline image is (BI, [dict, data]). A lexing error ends the stream."""
    if b"BI" not in content and _WORDS.match(content):
        operands: list = []
        for raw in content.split():
            if raw.isdigit():
                operands.append(int(raw))
                continue
            op, x = _word(raw)
            if op is None:
                operands.append(x)
            else:
                yield op, operands
                operands = []
        return
    match, operands = _CONTENT.scanner(content).match, []
    while m := match():
        kind = m.lastindex
        if kind == _INT:
            n = int(m[3])
            if not -(2**63) <= n < 2**63:
                return
            operands.append(n)
            continue
        if kind == _STRING:
            operands.append(m[2])
            continue
        if kind == _WORD:
            op = _operator(m[8])
            if op is None:
                operands.append(_keyword(m[8]))
                continue
            if op == "BI":
                lex = Lexer(content, m.end(), refs=False)
                d: dict = {}
                while (k := lex.value()) is not _END and k != "ID":
                    if isinstance(k, Name):
                        d[INLINE_KEYS.get(k, k)] = lex.value()
                start = lex.pos + 1
                end, after = inline_end(content, start, d)
                operands = [d, content[start:end]]
                match = _CONTENT.scanner(content, after).match
            yield op, operands
            operands = []
        elif kind == _NAME:
            operands.append(_name(m[1]))
        elif kind == _REAL:
            operands.append(_real(m[7]))
        elif kind == _CLOSE or kind == _MARK:
            yield str(_keyword(m[12] if kind == _MARK else b">>")), operands
            operands = []
        else:
            lex = Lexer(content, m.start(kind), refs=False)
            try:
                operands.append(lex.value())
            except PdfError:
                return
            match = _CONTENT.scanner(content, lex.pos).match


_EI = re.compile(rb"[\x00\t\n\x0c\r ]*EI(?=[\x00\t\n\x0c\r ]|\Z)")
_BLANK_EI = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|\Z)")
# Components of the device colour spaces, long and short names.
COMPONENTS = {"DeviceGray": 1, "G": 1, "DeviceRGB": 3, "RGB": 3, "DeviceCMYK": 4, "CMYK": 4, "Indexed": 1, "I": 1}


def inline_end(content: bytes, start: int, d: dict) -> tuple[int, int]:
    """End of an inline image's data, and of its EI.

    The length is taken from /L, or for unfiltered samples from the size, or a
    JPEG's end mark, if an EI follows there. Else the first EI between blanks counts
    after which only text follows for some bytes, or the first one at all.
    """
    known = []
    length = d.get("Length", d.get("L"))
    if isinstance(length, int):
        known.append(start + length)
    name = d.get("Filter")
    name = name[0] if isinstance(name, list) and name else name
    if name in (None, []):
        space = d.get("ColorSpace")
        space = space[0] if isinstance(space, list) and space else space
        bits = 1 if d.get("ImageMask") else int(d.get("BitsPerComponent") or 8)
        parts = 1 if d.get("ImageMask") else COMPONENTS.get(str(space))
        if parts and isinstance(d.get("Width"), int) and isinstance(d.get("Height"), int):
            known.append(start + (d["Width"] * parts * bits + 7) // 8 * d["Height"])
    elif name in ("DCTDecode", "DCT") and (mark := content.find(b"\xff\xd9", start)) >= 0:
        known.append(mark + 2)
    for end in known:
        if start <= end <= len(content) and (m := _EI.match(content, end)):
            return end, m.end()
    first = None
    for m in _BLANK_EI.finditer(content, max(start - 1, 0)):
        first = first or m
        if all(c in b"\t\n\x0c\r" or 32 <= c < 127 for c in content[m.end() : m.end() + 12]):
            return m.start(), m.end()
    return (first.start(), first.end()) if first else (len(content), len(content))


# Abbreviated keys of inline images.
INLINE_KEYS = {"BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "DP": "DecodeParms", "F": "Filter", "H": "Height", "IM": "ImageMask", "I": "Interpolate", "W": "Width"}


class Document:
    """One file: cross-reference, trailer and objects, parsed when touched."""

    MAX_HOPS = 64

    def __init__(self, data: bytes, password: bytes = b""):
        self.data = bytes(data)
        self.xref: dict[int, tuple] = {}  # num -> (offset, gen, None) or (stream, index, "compressed") or None if free
        self.sections: list[dict] = []
        self.trailer: dict = {}
        self._objects: dict[int, Any] = {}
        self._streams: dict[int, bytes] = {}
        self._object_streams: dict[int, list] = {}
        self._pages: list[tuple[int, dict]] | None = None
        self.fonts: dict[tuple[int, str], tuple] = {}  # of the interpreter, by dictionary and key
        self.security: crypto.Security | None = None
        self._load(self.startxref())
        enc = self.trailer.get("Encrypt")
        if enc is not None:
            ids = self.trailer.get("ID") or [b""]
            first = self.resolve(ids)[0]
            self.encrypt_num = enc.num if isinstance(enc, Ref) else -1
            self.security = crypto.Security({k: self.resolve(v) for k, v in self.resolve(enc).items()}, self.resolve(first), password)
            if not self.security.key:
                raise PdfError("InvalidPassword", "the password doesn't open the file")
            self._objects.clear()

    def startxref(self) -> int:
        tail = self.data[-1024:]
        at = tail.rfind(b"startxref")
        m = _STARTXREF.match(tail, at) if at >= 0 else None
        if not m:
            raise PdfError("InvalidXref", "no startxref", max(0, len(self.data) - 1024))
        return int(m.group(1))

    def _load(self, offset: int | None) -> None:
        seen: set[int] = set()
        while offset is not None and offset not in seen:
            seen.add(offset)
            if not 0 <= offset < len(self.data):
                raise PdfError("InvalidXref", "offset outside the file", offset)
            lex = Lexer(self.data, offset)
            lex.skip()
            entries, trailer = self._table(lex) if self.data.startswith(b"xref", lex.pos) else self._xref_stream(lex.pos)
            self.sections.append({"offset": offset, "entries": entries})
            for num, entry in entries.items():
                self.xref.setdefault(num, entry)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            if isinstance(hybrid := trailer.get("XRefStm"), int) and hybrid not in seen:
                seen.add(hybrid)
                for num, entry in self._xref_stream(hybrid)[0].items():
                    self.xref.setdefault(num, entry)
            prev = trailer.get("Prev")
            offset = int(prev) if isinstance(prev, (int, float)) else None

    def _table(self, lex: Lexer) -> tuple[dict, dict]:
        lex.pos += 4
        out: dict[int, tuple | None] = {}
        while True:
            x = lex.value()
            if x == "trailer":
                break
            n = lex.value()
            if not (isinstance(x, int) and isinstance(n, int)):
                raise PdfError("InvalidXref", "bad subsection", lex.pos)
            match = _ENTRY.scanner(self.data, lex.pos).match
            for num in range(x, x + n):
                m = match()
                if not m:
                    lex.skip()
                    raise PdfError("InvalidXref", "bad entry", lex.pos)
                at, gen, kind = m.groups()
                out[num] = (int(at), int(gen), None) if kind == b"n" else None
                lex.pos = m.end()
        end = self.data.find(b"startxref", lex.pos, lex.pos + SMALL)
        trailer = _small(self.data[lex.pos : end + 9], b"startxref") if end >= 0 else _END
        if trailer is _END:
            trailer = lex.value()
        if not isinstance(trailer, dict):
            raise PdfError("InvalidXref", "no trailer", lex.pos)
        return out, trailer

    def _xref_stream(self, offset: int) -> tuple[dict, dict]:
        _, obj = self._object_at(offset)
        if not isinstance(obj, Stream):
            raise PdfError("InvalidXref", "no cross-reference stream", offset)
        d = obj.dict
        w = d.get("W")
        if not (isinstance(w, list) and len(w) == 3):
            raise PdfError("InvalidXref", "bad /W", offset)
        data = self._decode(obj, None)
        index = d.get("Index") or [0, d.get("Size", 0)]
        out: dict[int, tuple | None] = {}
        pos, a, b = 0, w[0], w[0] + w[1]
        for first, count in zip(index[::2], index[1::2]):
            for num in range(first, first + count):
                row = data[pos : pos + sum(w)]
                pos += sum(w)
                if len(row) < sum(w):
                    break
                kind = int.from_bytes(row[:a], "big") if a else 1
                x, y = int.from_bytes(row[a:b], "big"), int.from_bytes(row[b:], "big")
                out[num] = (x, y, None) if kind == 1 else (x, y, "compressed") if kind == 2 else None
        return out, {k: v for k, v in d.items() if k not in ("Length", "Filter", "DecodeParms", "W", "Index", "Type")}

    def _object_at(self, offset: int) -> tuple[int, Any]:
        m = _OBJ.match(self.data, offset)
        if not m:
            raise PdfError("InvalidObject", "no object here", offset)
        start = m.end()
        end, body = self.data.find(b"endobj", start, start + SMALL), self.data.find(b"stream", start, start + SMALL)
        if end >= 0 and not 0 <= body < end and (obj := _small(self.data[start : end + 6], b"endobj")) is not _END:
            return int(m.group(1)), obj
        lex = Lexer(self.data, start)
        obj = _small(self.data[start : body + 6], b"stream") if body >= 0 else _END
        if isinstance(obj, dict):
            lex.pos = body
        else:
            obj = lex.value()
            if isinstance(obj, Keyword) or obj is _END:
                obj = None
        if isinstance(obj, dict):
            lex.skip()
            if self.data.startswith(b"stream", lex.pos):
                start = lex.pos + 6
                start += 2 if self.data[start : start + 2] == b"\r\n" else 1 if self.data[start : start + 1] in (b"\n", b"\r") else 0
                length = obj.get("Length")
                if isinstance(length, Ref):
                    length = self.get(length.num)
                if not isinstance(length, int) or length < 0:
                    raise PdfError("InvalidStream", "no /Length", offset)
                end = min(start + length, len(self.data))
                if not self.data[end : end + 20].lstrip(_WS).startswith(b"endstream"):
                    found = self.data.find(b"endstream", start)
                    if found >= 0:
                        end = found - (2 if self.data[found - 2 : found] == b"\r\n" else 1 if self.data[found - 1 : found] in (b"\n", b"\r") else 0)
                obj = Stream(obj, self.data[start:end])
        return int(m.group(1)), obj

    def get(self, num: int) -> Any:
        """The object of a number; null if unknown or free."""
        if num in self._objects:
            return self._objects[num]
        entry = self.xref.get(num)
        if entry is None:
            return None
        a, b, kind = entry
        self._objects[num] = None  # against cycles
        if kind == "compressed":
            members = self._members(a)
            obj = members[b][1] if b < len(members) and members[b][0] == num else dict(members).get(num)
        else:
            found, obj = self._object_at(a)
            if found != num:
                raise PdfError("InvalidObject", f"object {found} where {num} should be", a)
            if self.security and num != self.encrypt_num:
                obj = self._decrypted(obj, num, b)
        self._objects[num] = obj
        return obj

    def _decrypted(self, obj: Any, num: int, gen: int) -> Any:
        if isinstance(obj, bytes):
            return self.security.decrypt(obj, num, gen)
        if isinstance(obj, list):
            return [self._decrypted(x, num, gen) for x in obj]
        if isinstance(obj, dict):
            return {k: self._decrypted(v, num, gen) for k, v in obj.items()}
        if isinstance(obj, Stream):
            if obj.dict.get("Type") == "XRef":
                return obj
            return Stream(self._decrypted(obj.dict, num, gen), self.security.decrypt(obj.raw, num, gen))
        return obj

    def _members(self, num: int) -> list[tuple[int, Any]]:
        if num not in self._object_streams:
            stream = self.get(num)
            out: list[tuple[int, Any]] = []
            if isinstance(stream, Stream):
                data = self.decode(stream)
                head, first = Lexer(data, refs=False), self.resolve(stream.dict.get("First", 0))
                pairs = [(head.value(), head.value()) for _ in range(self.resolve(stream.dict.get("N", 0)))]
                for n, at in pairs:
                    x = Lexer(data, first + at).value()
                    out.append((n, None if isinstance(x, Keyword) or x is _END else x))
            self._object_streams[num] = out
        return self._object_streams[num]

    def resolve(self, obj: Any) -> Any:
        if type(obj) is not Ref:
            return obj
        for _ in range(self.MAX_HOPS):
            if not isinstance(obj, Ref):
                return obj
            obj = self.get(obj.num)
        raise PdfError("InvalidReference", "too many hops")

    def decode(self, stream: Stream) -> bytes:
        return self._decode(stream, self.resolve)

    @staticmethod
    def _decode(stream: Stream, resolve) -> bytes:
        get = resolve or (lambda x: x)
        names = get(stream.dict.get("Filter"))
        names = [get(x) for x in names] if isinstance(names, list) else [names] if names else []
        parms = get(stream.dict.get("DecodeParms"))
        parms = [get(x) for x in parms] if isinstance(parms, list) else [parms] * bool(names)
        data = stream.raw
        for i, name in enumerate(names):
            p = parms[i] if i < len(parms) and isinstance(parms[i], dict) else {}
            data = filters.decode(str(name), data, {k: get(v) for k, v in p.items()})
        return data

    # ---- document structure ----------------------------------------------------

    def root(self) -> dict:
        root = self.resolve(self.trailer.get("Root"))
        if not isinstance(root, dict):
            raise PdfError("MissingKey", "/Root")
        return root

    def pages(self) -> list[tuple[int, dict]]:
        """(object number, page dictionary with inherited attributes) in order; cyclic trees end."""
        if self._pages is None:
            self._pages = self._leaves()
        return self._pages

    def _leaves(self) -> list[tuple[int, dict]]:
        out: list[tuple[int, dict]] = []
        inherited = ("MediaBox", "CropBox", "Rotate", "Resources")
        top = self.root().get("Pages")
        stack: list[tuple[Any, dict, int]] = [(top, {}, 0)]
        seen: set[int] = set()
        while stack:
            ref, above, depth = stack.pop()
            num = ref.num if isinstance(ref, Ref) else 0
            node = self.resolve(ref)
            if not isinstance(node, dict) or (num and num in seen) or depth > 100:
                continue
            seen.add(num)
            own = above | {k: node[k] for k in inherited if k in node}
            if "Kids" in node and node.get("Type") != "Page":
                kids = self.resolve(node["Kids"]) or []
                stack += [(k, own, depth + 1) for k in reversed(kids)]
            else:
                out.append((num, own | node))
        return out

    def page_count(self) -> int:
        pages = self.resolve(self.root().get("Pages"))
        count = self.resolve(pages.get("Count")) if isinstance(pages, dict) else None
        if not isinstance(count, int):
            raise PdfError("MissingKey", "/Count")
        return count

    def contents(self, page: dict) -> bytes:
        found = self.resolve(page.get("Contents"))
        parts = [self.resolve(x) for x in found] if isinstance(found, list) else [found]
        return b"\n".join(self.decode(x) for x in parts if isinstance(x, Stream))


def references(obj: Any, path: str = "") -> Iterator[tuple[str, int]]:
    """(path, number) of every reference in a value."""
    if isinstance(obj, Ref):
        yield path, obj.num
    elif isinstance(obj, Stream):
        yield from references(obj.dict, path)
    elif isinstance(obj, dict):
        for k, v in obj.items():
            yield from references(v, f"{path}/{k}")
    elif isinstance(obj, list):
        for i, v in enumerate(obj):
            yield from references(v, f"{path}[{i}]")


_ATOMS = frozenset((int, float, bool, bytes, str, Name, type(None)))


def targets(obj: Any) -> list[int]:
    """Numbers of all references in a value, in order."""
    out: list[int] = []
    todo = [obj]
    while todo:
        x = todo.pop()
        if type(x) in _ATOMS:
            continue
        if isinstance(x, Ref):
            out.append(x.num)
        elif isinstance(x, Stream):
            todo.append(x.dict)
        elif isinstance(x, dict):
            todo.extend(reversed(x.values()))
        elif isinstance(x, list):
            todo.extend(reversed(x))
    return out


def remap(obj: Any, to) -> Any:
    """A value with every reference number replaced."""
    if type(obj) in _ATOMS:
        return obj
    if isinstance(obj, Ref):
        return Ref(to(obj.num), 0)
    if isinstance(obj, Stream):
        return Stream(remap(obj.dict, to), obj.raw)
    if isinstance(obj, dict):
        return {k: v if type(v) in _ATOMS else remap(v, to) for k, v in obj.items()}
    if isinstance(obj, list):
        return [v if type(v) in _ATOMS else remap(v, to) for v in obj]
    return obj


def text_string(raw: Any) -> str | None:
    """Document strings: UTF-16BE or UTF-8 by byte-order mark, else Latin-1."""
    if not isinstance(raw, bytes):
        return None
    if raw.startswith(b"\xfe\xff"):
        return raw[2:].decode("utf-16-be", "replace")
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw[3:].decode("utf-8", "replace")
    return raw.decode("latin-1")


def encode_text(text: str) -> bytes:
    """Latin-1 if possible, else UTF-16BE with its mark."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return b"\xfe\xff" + text.encode("utf-16-be")
