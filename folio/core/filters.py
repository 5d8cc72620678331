"""Stream filters: decoders, encoders and predictors."""

from __future__ import annotations

import zlib

import numpy as np


class FilterError(ValueError):
    pass


# Abbreviations of filter names.
SHORT = {"Fl": "FlateDecode", "A85": "ASCII85Decode", "AHx": "ASCIIHexDecode", "LZW": "LZWDecode", "RL": "RunLengthDecode", "DCT": "DCTDecode", "CCF": "CCITTFaxDecode"}
#: Image codecs whose bytes pass through.
PASS = {"DCTDecode", "JPXDecode", "JBIG2Decode", "CCITTFaxDecode", "Crypt"}
_SPACE = b"\x00\t\n\x0c\r "


def decode(name: str, data: bytes, parms: dict | None = None) -> bytes:
    parms, name = parms or {}, SHORT.get(name, name)
    if name == "FlateDecode":
        try:
            out = zlib.decompress(data)
        except zlib.error as e:
            raise FilterError(f"FlateDecode: {e}") from e
    elif name == "LZWDecode":
        out = lzw(data, int(parms.get("EarlyChange", 1)))
    elif name == "ASCII85Decode":
        return ascii85(data)
    elif name == "ASCIIHexDecode":
        return ascii_hex(data)
    elif name == "RunLengthDecode":
        return run_length(data)
    elif name in PASS:
        return data
    else:
        raise FilterError(f"unsupported filter {name}")
    return predict(out, parms)


def ascii_hex(data: bytes) -> bytes:
    digits = bytes(c for c in data.split(b">", 1)[0] if c not in _SPACE)
    try:
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))
    except ValueError as e:
        raise FilterError(f"ASCIIHexDecode: {e}") from e


def ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.split(b"~>", 1)[0]:
        if c in _SPACE:
            continue
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 0x21 <= c <= 0x75:
            group.append(c - 33)
            if len(group) == 5:
                out += _base85(group)
                group = []
        else:
            raise FilterError(f"ASCII85Decode: byte {c}")
    if len(group) == 1:
        raise FilterError("ASCII85Decode: a single last digit")
    if group:
        out += _base85(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _base85(group: list[int]) -> bytes:
    n = 0
    for d in group:
        n = n * 85 + d
    if n >= 1 << 32:
        raise FilterError("ASCII85Decode: group too large")
    return n.to_bytes(4, "big")


def encode_ascii85(data: bytes) -> bytes:
    out = bytearray()
    for i in range(0, len(data), 4):
        part = data[i : i + 4]
        n = int.from_bytes(part.ljust(4, b"\0"), "big")
        digits = bytearray()
        for _ in range(5):
            n, d = divmod(n, 85)
            digits.append(d + 33)
        digits.reverse()
        out += b"z" if part == b"\0\0\0\0" else digits[: len(part) + 1]
    return bytes(out) + b"~>"


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n == 128:
            break
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def encode_run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        j = i
        while j < len(data) and data[j] == data[i] and j - i < 128:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), data[i]))
        else:
            while j < len(data) and j - i < 128 and not (j + 1 < len(data) and data[j] == data[j + 1]):
                j += 1
            out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out) + b"\x80"


def lzw(data: bytes, early: int = 1) -> bytes:
    table: list[bytes] = []
    out, width, bits, held, prev = bytearray(), 9, 0, 0, b""

    def reset():
        table[:] = [bytes((i,)) for i in range(256)] + [b"", b""]

    reset()
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            reset()
            width, prev = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif prev and code == len(table):
            entry = prev + prev[:1]
        else:
            raise FilterError("LZWDecode: bad code")
        out += entry
        if prev:
            table.append(prev + entry[:1])
        prev = entry
        width = 9 if (n := len(table) + early) < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    return bytes(out)


def predict(data: bytes, parms: dict) -> bytes:
    """Undoes a PNG (10 and up) or TIFF (2) predictor."""
    predictor = int(parms.get("Predictor", 1))
    colors, bpc, columns = int(parms.get("Colors", 1)), int(parms.get("BitsPerComponent", 8)), int(parms.get("Columns", 1))
    bpp, row = max(1, colors * bpc // 8), (columns * colors * bpc + 7) // 8
    if predictor == 2 and bpc == 8:
        n = len(data) // row * row
        a = np.frombuffer(data[:n], dtype=np.uint8).reshape(-1, columns, colors)
        return np.cumsum(a, axis=1, dtype=np.uint8).tobytes() + data[n:]
    if predictor < 10:
        return data
    out, above = bytearray(), np.zeros(row, dtype=np.uint8)
    for at in range(0, len(data) - row, row + 1):
        tag, line = data[at], np.frombuffer(data, dtype=np.uint8, count=row, offset=at + 1).copy()
        if tag == 1:
            for i in range(bpp):
                line[i::bpp] = np.cumsum(line[i::bpp], dtype=np.uint8)
        elif tag == 2:
            line += above
        elif tag in (3, 4):
            left, up = [0] * (row + bpp), above.tolist()
            for i, x in enumerate(line.tolist()):
                a, b, c = left[i], up[i], up[i - bpp] if i >= bpp else 0
                if tag == 3:
                    x += (a + b) // 2
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    x += a if pa <= pb and pa <= pc else b if pb <= pc else c
                left[i + bpp] = x & 255
            line = np.array(left[bpp:], dtype=np.uint8)
        out += line.tobytes()
        above = line
    return bytes(out)
