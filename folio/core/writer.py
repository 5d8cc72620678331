"""Serialising values and whole files."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache
from typing import Any

from . import crypto
from .objects import Name, Ref, Stream

_PRINTABLE = re.compile(rb"[ -~\n\r\t]*+\Z")
_ESCAPED = re.compile(rb"[\\()\r\n]")
_DELIMITERS = b"()<>[]{}/%#"


def real(x: float) -> str:
    """At most six decimals, without trailing zeros."""
    if x == (n := int(x) if -1e15 < x < 1e15 else None):
        return str(n)
    out = f"{x:.6f}".rstrip("0").rstrip(".")
    return "0" if out in ("-0", "") else out


@lru_cache(4096)
def name(x: str) -> bytes:
    return b"/" + b"".join(bytes((c,)) if 0x21 <= c <= 0x7E and c not in _DELIMITERS else b"#%02X" % c for c in x.encode())


def string(raw: bytes) -> bytes:
    """Literal if mostly printable, else hexadecimal."""
    if _PRINTABLE.match(raw):
        if not _ESCAPED.search(raw):
            return b"(" + raw + b")"
        out = raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r").replace(b"\n", b"\\n")
        return b"(" + out + b")"
    return b"<" + raw.hex().upper().encode() + b">"


def serialize(x: Any) -> bytes:
    kind = type(x)  # the most frequent ones first
    if kind is Name:
        return name(x)
    if kind is int:
        return b"%d" % x
    if kind is Ref:
        return b"%d %d R" % x
    if kind is bytes:
        return string(x)
    if kind is float:
        return real(x).encode()
    if kind is dict:
        return b"<<" + b"".join([name(k) + b" " + serialize(v) for k, v in x.items()]) + b">>"
    if kind is list:
        return b"[" + b" ".join([serialize(v) for v in x]) + b"]"
    if x is None:
        return b"null"
    if isinstance(x, bool):
        return b"true" if x else b"false"
    if isinstance(x, Ref):
        return b"%d %d R" % x
    if isinstance(x, int):
        return b"%d" % x
    if isinstance(x, float):
        return real(x).encode()
    if isinstance(x, str):
        return name(x)
    if isinstance(x, bytes):
        return string(x)
    if isinstance(x, (list, tuple)):
        return b"[" + b" ".join(map(serialize, x)) + b"]"
    if isinstance(x, dict):
        return b"<<" + b"".join(name(k) + b" " + serialize(v) for k, v in x.items()) + b">>"
    if isinstance(x, Stream):
        return serialize(x.dict | {"Length": len(x.raw)}) + b"\nstream\n" + x.raw + b"\nendstream"
    raise TypeError(type(x))


def flate(data: bytes, d: dict | None = None) -> Stream:
    return Stream({**(d or {}), "Filter": Name("FlateDecode")}, zlib.compress(data, 6))


def content(ops: list[tuple[str, list]]) -> bytes:
    """Operations as content; an inline image is (BI, [dict, data])."""

    def one(op: str, args: list) -> bytes:
        if op == "BI":
            return b"BI " + b"".join(serialize(Name(k)) + b" " + serialize(v) + b" " for k, v in args[0].items()) + b"ID " + args[1] + b"\nEI\n"
        return b" ".join([*[b"%d" % a if type(a) is int else serialize(a) for a in args], op.encode() + b"\n"])

    return b"".join([one(op, args) for op, args in ops])


class Encryption:
    """Settings for writing: method ``rc4``, ``aes128`` or ``aes256``."""

    def __init__(self, method: str, user: bytes, owner: bytes, permissions: int, seed: bytes):
        self.first_id = hashlib.md5(seed).digest()
        p = permissions
        if method == "aes256":
            u_salts, o_salts, key = (hashlib.sha256(seed + x).digest() for x in (b"u", b"o", b"k"))
            u = crypto.hash_r6(user, u_salts[:8]) + u_salts[:16]
            o = crypto.hash_r6(owner, o_salts[:8], u) + o_salts[:16]
            self.dict = {"Filter": Name("Standard"), "V": 5, "R": 6, "Length": 256, "P": p, "U": u, "O": o, "UE": crypto.cbc_encrypt(crypto.hash_r6(user, u_salts[8:16]), bytes(16), key), "OE": crypto.cbc_encrypt(crypto.hash_r6(owner, o_salts[8:16], u), bytes(16), key), "CF": {"StdCF": {"CFM": Name("AESV3"), "Length": 32}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
            perms = (p & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff\xff\xff\xffTadb" + seed[:4].ljust(4, b"\0")
            self.dict["Perms"] = crypto.cbc_encrypt(key, bytes(16), perms)
        else:
            r = 4 if method == "aes128" else 3
            o = crypto.owner_entry(owner, user, r, 16)
            key = crypto.file_key(user, o, p, self.first_id, r, 16)
            self.dict = {"Filter": Name("Standard"), "V": 4 if r == 4 else 2, "R": r, "Length": 128, "P": p, "O": o, "U": crypto.user_entry(key, self.first_id, r)}
            if r == 4:
                self.dict |= {"CF": {"StdCF": {"CFM": Name("AESV2"), "Length": 16}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
        self.security = crypto.Security(self.dict, self.first_id, user)

    def apply(self, x: Any, num: int) -> Any:
        if isinstance(x, bytes):
            return self.security.encrypt(x, num, 0, hashlib.md5(b"%d" % num + x[:64]).digest())
        if isinstance(x, Ref):
            return x
        if isinstance(x, (list, tuple)):
            return [self.apply(v, num) for v in x]
        if isinstance(x, dict):
            return {k: self.apply(v, num) for k, v in x.items()}
        if isinstance(x, Stream):
            return Stream(self.apply(x.dict, num), self.apply(x.raw, num))
        return x


def whole(n: int, x: Any) -> bytes:
    """An object with its number."""
    return b"%d 0 obj\n" % n + serialize(x) + b"\nendobj\n"


def write(objects: dict[int, Any], trailer: dict, version: str = "1.7", xref_stream: bool = False, encryption: Encryption | None = None, coded: dict[int, tuple[Any, bytes]] | None = None) -> bytes:
    """A whole file. With ``xref_stream``, plain objects go into one object stream.

    ``coded`` has objects whose bytes are known: by number the object, which must be this very one, and its bytes.
    """
    trailer = dict(trailer)
    objects = dict(sorted(objects.items()))
    if encryption:
        objects = {n: encryption.apply(x, n) for n, x in objects.items()}
        enc = max(objects) + 1
        objects[enc] = encryption.dict
        trailer |= {"Encrypt": Ref(enc, 0), "ID": [encryption.first_id, encryption.first_id]}
    out = bytearray(b"%%PDF-%s\n%%\xe2\xe3\xcf\xd3\n" % version.encode())
    entries: dict[int, tuple] = {}
    if xref_stream:
        packed = [n for n, x in objects.items() if not isinstance(x, Stream)]
        holder = max(objects) + 1
        head, body = [], bytearray()
        for i, n in enumerate(packed):
            head += [n, len(body)]
            body += serialize(objects[n]) + b" "
            entries[n] = (2, holder, i)
        first = " ".join(map(str, head)).encode() + b"\n"
        objects = {n: x for n, x in objects.items() if isinstance(x, Stream)}
        objects[holder] = flate(first + bytes(body), {"Type": Name("ObjStm"), "N": len(packed), "First": len(first)})
    for n, x in objects.items():
        entries[n] = (1, len(out), 0)
        if coded and n in coded and coded[n][0] is x:
            out += coded[n][1]
        else:
            out += whole(n, x)
    start = len(out)
    if xref_stream:
        own = max(entries) + 1
        entries[own] = (1, start, 0)
        entries[0] = (0, 0, 65535)
        rows = [bytes((k,)) + a.to_bytes(4, "big") + b.to_bytes(2, "big") for k, a, b in (entries.get(n, (0, 0, 0)) for n in range(own + 1))]
        above, coded = bytes(7), bytearray()
        for row in rows:  # PNG predictor, tag Up
            coded += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above))
            above = row
        s = flate(bytes(coded), {"Type": Name("XRef"), "Size": own + 1, "W": [1, 4, 2], "DecodeParms": {"Predictor": 12, "Columns": 7}} | trailer)
        out += b"%d 0 obj\n" % own + serialize(s) + b"\nendobj\n"
    else:
        out += table(entries) + b"trailer\n" + serialize(trailer | {"Size": max(entries, default=0) + 1}) + b"\n"
    return bytes(out) + b"startxref\n%d\n%%%%EOF\n" % start


def table(entries: dict[int, tuple]) -> bytes:
    """The cross-reference table, with a subsection for each run of numbers."""
    rows = {0: b"0000000000 65535 f \n"} | {n: b"%010d %05d n \n" % (e[1], e[2]) for n, e in entries.items()}
    if max(rows) + 1 == len(rows):
        return b"xref\n0 %d\n" % len(rows) + b"".join([rows[n] for n in range(len(rows))])
    out, run = bytearray(b"xref\n"), []
    for n in sorted(rows):
        if run and n != run[-1] + 1:
            out += b"%d %d\n" % (run[0], len(run)) + b"".join(rows[x] for x in run)
            run = []
        run.append(n)
    return bytes(out + b"%d %d\n" % (run[0], len(run)) + b"".join(rows[x] for x in run))


def append(base: bytes, changed: dict[int, Any], trailer: dict, prev: int, size: int) -> bytes:
    """An incremental update after ``base``, which stays as it is."""
    out, entries = bytearray(base if base.endswith(b"\n") else base + b"\n"), {}
    for n, x in sorted(changed.items()):
        entries[n] = (1, len(out), 0)
        out += b"%d 0 obj\n" % n + serialize(x) + b"\nendobj\n"
    start = len(out)
    rows, run, body = {n: b"%010d %05d n \n" % (e[1], 0) for n, e in entries.items()}, [], bytearray(b"xref\n")
    for n in [*sorted(rows), None]:
        if run and (n is None or n != run[-1] + 1):
            body += b"%d %d\n" % (run[0], len(run)) + b"".join(rows[x] for x in run)
            run = []
        if n is not None:
            run.append(n)
    out += body + b"trailer\n" + serialize(trailer | {"Prev": prev, "Size": max(size, max(entries, default=0) + 1)}) + b"\n"
    return bytes(out) + b"startxref\n%d\n%%%%EOF\n" % start


class Builder:
    """Collects objects of a new file."""

    def __init__(self):
        self.objects: dict[int, Any] = {}
        self.catalog = self.reserve()
        self.tree = self.reserve()
        self.kids: list[Ref] = []
        self.root: dict = {"Type": Name("Catalog"), "Pages": self.tree}
        self.info: dict = {}
        self._font: Ref | None = None

    def reserve(self) -> Ref:
        n = len(self.objects) + 1
        self.objects[n] = None
        return Ref(n, 0)

    def add(self, x: Any) -> Ref:
        r = self.reserve()
        self.objects[r.num] = x
        return r

    @property
    def font(self) -> Ref:
        if self._font is None:
            self._font = self.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")})
        return self._font

    def page(self, body: bytes, compress: bool = True, box: tuple = (0, 0, 612, 792), **more: Any) -> Ref:
        stream = self.add(flate(body) if compress else Stream({}, body))
        r = self.add({"Type": Name("Page"), "Parent": self.tree, "MediaBox": list(box), "Resources": {"Font": {"F1": self.font}}, "Contents": stream, **more})
        self.kids.append(r)
        return r

    def build(self, **options: Any) -> bytes:
        self.objects[self.tree.num] = {"Type": Name("Pages"), "Kids": self.kids, "Count": len(self.kids)}
        self.objects[self.catalog.num] = self.root
        trailer = {"Root": self.catalog} | ({"Info": self.add(self.info)} if self.info else {})
        return write(self.objects, trailer, **options)


LINES_PER_PAGE = 40


def lines_content(lines: list[str], size: float = 10, leading: float = 14, left: float = 72, top: float = 740) -> bytes:
    """One Tj for each non-empty line, at its own place."""
    ops: list[tuple[str, list]] = [("BT", []), ("Tf", [Name("F1"), size])]
    for i, line in enumerate(lines):
        if line:
            ops += [("Tm", [1, 0, 0, 1, left, top - leading * i]), ("Tj", [line.encode("latin-1", "replace")])]
    return content([*ops, ("ET", [])])


def text_pdf(text: str | None, info: dict[str, str] | None = None, per_page: int = LINES_PER_PAGE, compress: bool = True, **options: Any) -> bytes:
    """A document of text, ``per_page`` lines a page."""
    from .objects import encode_text

    b = Builder()
    lines = (text or "").split("\n")
    for i in range(0, max(1, len(lines)), per_page):
        b.page(lines_content(lines[i : i + per_page]), compress)
    b.info = {k: encode_text(v) for k, v in (info or {}).items() if v is not None}
    return b.build(**options)
