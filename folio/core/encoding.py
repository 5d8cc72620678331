"""Simple font encodings: code to text by base encoding, differences and glyph names."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from typing import Any

# Glyph names that don't follow from a character's Unicode name.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "exclamdown": "¡", "cent": "¢", "sterling": "£", "fraction": "⁄", "yen": "¥", "florin": "ƒ", "section": "§", "currency": "¤", "quotedblleft": "“", "guillemotleft": "«", "guilsinglleft": "‹", "guilsinglright": "›", "fi": "ﬁ", "fl": "ﬂ", "ff": "ﬀ", "ffi": "ﬃ", "ffl": "ﬄ",
    "endash": "–", "emdash": "—", "dagger": "†", "daggerdbl": "‡", "periodcentered": "·", "paragraph": "¶", "bullet": "•", "quotesinglbase": "‚", "quotedblbase": "„", "quotedblright": "”", "quoteleft": "‘", "quoteright": "’", "guillemotright": "»", "ellipsis": "…", "perthousand": "‰", "questiondown": "¿",
    "acute": "´", "circumflex": "ˆ", "tilde": "˜", "macron": "¯", "breve": "˘", "dotaccent": "˙", "dieresis": "¨", "ring": "˚", "cedilla": "¸", "hungarumlaut": "˝", "ogonek": "˛", "caron": "ˇ",
    "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ", "Oslash": "Ø", "oslash": "ø", "Lslash": "Ł", "lslash": "ł", "germandbls": "ß", "dotlessi": "ı", "ordfeminine": "ª", "ordmasculine": "º", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "mu": "µ", "Euro": "€",
    "copyright": "©", "registered": "®", "trademark": "™", "degree": "°", "plusminus": "±", "multiply": "×", "divide": "÷", "minus": "−", "logicalnot": "¬", "brokenbar": "¦", "onehalf": "½", "onequarter": "¼", "threequarters": "¾", "onesuperior": "¹", "twosuperior": "²", "threesuperior": "³", "nbspace": "\u00a0", "sfthyphen": "\u00ad",
}
# Accents in glyph names.
ACCENTS = {"grave": "\u0300", "acute": "\u0301", "circumflex": "\u0302", "tilde": "\u0303", "macron": "\u0304", "breve": "\u0306", "dotaccent": "\u0307", "dieresis": "\u0308", "ring": "\u030a", "hungarumlaut": "\u030b", "caron": "\u030c", "cedilla": "\u0327", "ogonek": "\u0328", "commaaccent": "\u0327"}
# Places of the standard encoding that differ from ASCII, from 0x60 and 0x27, then those from 0xA1 on.
STANDARD = {0x27: "quoteright", 0x60: "quoteleft", 0xA1: "exclamdown", 0xA2: "cent", 0xA3: "sterling", 0xA4: "fraction", 0xA5: "yen", 0xA6: "florin", 0xA7: "section", 0xA8: "currency", 0xA9: "quotesingle", 0xAA: "quotedblleft", 0xAB: "guillemotleft", 0xAC: "guilsinglleft", 0xAD: "guilsinglright", 0xAE: "fi", 0xAF: "fl", 0xB1: "endash", 0xB2: "dagger", 0xB3: "daggerdbl", 0xB4: "periodcentered", 0xB6: "paragraph", 0xB7: "bullet", 0xB8: "quotesinglbase", 0xB9: "quotedblbase", 0xBA: "quotedblright", 0xBB: "guillemotright", 0xBC: "ellipsis", 0xBD: "perthousand", 0xBF: "questiondown", 0xC1: "grave", 0xC2: "acute", 0xC3: "circumflex", 0xC4: "tilde", 0xC5: "macron", 0xC6: "breve", 0xC7: "dotaccent", 0xC8: "dieresis", 0xCA: "ring", 0xCB: "cedilla", 0xCD: "hungarumlaut", 0xCE: "ogonek", 0xCF: "caron", 0xD0: "emdash", 0xE1: "AE", 0xE3: "ordfeminine", 0xE8: "Lslash", 0xE9: "Oslash", 0xEA: "OE", 0xEB: "ordmasculine", 0xF1: "ae", 0xF5: "dotlessi", 0xF8: "lslash", 0xF9: "oslash", 0xFA: "oe", 0xFB: "germandbls"}
_GREEK = {"omega": "ω", "Omega": "Ω"}


@lru_cache(4096)
def glyph(name: str) -> str | None:
    """The text of a glyph name: uniXXXX, uXXXXXX, listed names, single letters, letters with an accent, Greek letters."""
    name = name.partition(".")[0]
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1:
        return name
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", name):
        return "".join(chr(int(m[1][i : i + 4], 16)) for i in range(0, len(m[1]), 4))
    if m := re.fullmatch(r"u([0-9A-F]{4,6})", name):
        return chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else None
    if name[1:] in ACCENTS and name[0].isalpha():
        return unicodedata.normalize("NFC", name[0] + ACCENTS[name[1:]])
    if name[1:] == "dotless":
        return None
    if "_" in name:
        parts = [glyph(x) for x in name.split("_")]
        return "".join(parts) if all(parts) else None
    try:
        kind = "CAPITAL" if name[0].isupper() else "SMALL"
        return _GREEK.get(name) or unicodedata.lookup(f"GREEK {kind} LETTER {name.upper()}")
    except KeyError:
        return None


@lru_cache(8)
def base(name: str | None) -> tuple[str, ...]:
    """Text of all 256 codes; Latin-1 where nothing else is said."""
    if name in ("WinAnsiEncoding", "MacRomanEncoding"):
        codec = "cp1252" if name == "WinAnsiEncoding" else "mac_roman"
        return tuple(bytes([c]).decode(codec, "replace").replace("\ufffd", "•") if c >= 32 else chr(c) for c in range(256))
    if name == "StandardEncoding":
        return tuple(GLYPHS[STANDARD[c]] if c in STANDARD else chr(c) if c < 127 else "" for c in range(256))
    return tuple(map(chr, range(256)))


def of_font(entry: Any, resolve: Callable[[Any], Any], symbolic: bool = False) -> list[str] | None:
    """Text by code of a font's /Encoding, a name or a dictionary with differences; none without one.

    A glyph without a known text has the base encoding's.
    """
    if isinstance(entry, str):
        return list(base(str(entry)))
    if not isinstance(entry, dict):
        return None
    named = resolve(entry.get("BaseEncoding"))
    out = list(base(str(named) if named is not None else None if symbolic else "StandardEncoding"))
    code = 0
    for x in resolve(entry.get("Differences")) or []:
        x = resolve(x)
        if isinstance(x, str):
            if 0 <= code < 256:
                out[code] = glyph(str(x)) or out[code]
            code += 1
        elif isinstance(x, (int, float)):
            code = int(x)
    return out
