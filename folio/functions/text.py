"""Strings, dates, labels, permissions and codecs as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of /P, from the file format.
PERMISSIONS = {"print": 4, "modify": 8, "copy_text": 16, "annotate": 32, "fill_forms": 256, "extract_accessibility": 512, "assemble": 1024, "print_hq": 2048}


def permissions(p: Column) -> Column:
    """Struct of eight booleans from the permission bits."""
    return F.struct(*[(p.bitwiseAND(bit) != 0).alias(name) for name, bit in PERMISSIONS.items()])


def allowed(p: Column, permission: str) -> Column:
    """Whether a permission holds; without encryption (null) it does."""
    return F.coalesce(p.bitwiseAND(PERMISSIONS[permission]) != 0, F.lit(True))


def decode_text(raw: Column) -> Column:
    """Document strings: UTF-16BE or UTF-8 by byte-order mark, else Latin-1."""
    start = lambda n: F.hex(F.substring(raw, 1, n))
    return F.when(start(2) == "FEFF", F.decode(F.substr(raw, F.lit(3)), "UTF-16BE")).when(start(3) == "EFBBBF", F.decode(F.substr(raw, F.lit(4)), "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))


def encode_text(text: Column) -> Column:
    """Latin-1 if every character is in it and the start is no byte-order mark, else UTF-16BE with its mark."""
    return F.when(text.rlike(r"^(?!\xFE\xFF|\xEF\xBB\xBF)[\x00-\xFF]*\z"), F.encode(text, "ISO-8859-1")).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))


def strip_subset(name: Column) -> Column:
    return F.regexp_replace(name, r"^[A-Z]{6}\+", "")


def xml_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def xml_unescape(x: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):  # & last: once only
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def pdf_date(x: Column) -> Column:
    """Struct of the parts of ``D:YYYYMMDDHHmmSSOHH'mm'``; all after the year may lack. Null without a year."""
    pattern = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?([Z+-])?(?:(\d{2})'?)?(?:(\d{2})'?)?"
    part = lambda i: F.regexp_extract(x, pattern, i)
    number = lambda i, default: F.when(part(i) != "", part(i).cast("int")).otherwise(default)
    parts = [number(1, None).alias("year"), number(2, 1).alias("month"), number(3, 1).alias("day"), number(4, 0).alias("hour"), number(5, 0).alias("minute"), number(6, 0).alias("second"), F.nullif(part(7), F.lit("")).alias("tz_sign"), number(8, 0).alias("tz_hour"), number(9, 0).alias("tz_minute")]
    return F.when(part(1) != "", F.struct(*parts))


def utc_time(ts: Column) -> Column:
    """YYMMDDHHMMSSZ."""
    return F.date_format(ts, "yyMMddHHmmss'Z'")


def roman(n: Column) -> Column:
    """Upper-case roman numerals of 1 to 4999; other numbers stay decimal."""
    # Roman numerals.
    values = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))])
    start = F.struct(n.cast("int").alias("n"), F.lit("").alias("s"))
    spelled = F.aggregate(values, start, lambda a, x: F.struct((a.n % x.v).cast("int").alias("n"), F.concat(a.s, F.repeat(x.s, F.floor(a.n / x.v).cast("int"))).alias("s")), lambda a: a.s)
    return F.when(n.between(1, 4999), spelled).otherwise(n.cast("string"))


def alpha(n: Column) -> Column:
    """A to Z, AA, AB and on: bijective base 26."""
    start = F.struct(n.cast("int").alias("n"), F.lit("").alias("s"))
    step = lambda a, _: F.when(a.n > 0, F.struct(F.floor((a.n - 1) / 26).cast("int").alias("n"), F.concat(F.chr(65 + (a.n - 1) % 26), a.s).alias("s"))).otherwise(a)
    return F.when(n >= 1, F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step, lambda a: a.s)).otherwise(n.cast("string"))


def page_label(style: Column, prefix: Column, n: Column) -> Column:
    """A label of style D, R, r, A or a; without style the prefix alone."""
    body = F.when(style == "D", n.cast("string")).when(style == "R", roman(n)).when(style == "r", F.lower(roman(n))).when(style == "A", alpha(n)).when(style == "a", F.lower(alpha(n))).otherwise("")
    return F.concat(F.coalesce(prefix, F.lit("")), body)


def ascii_hex_decode(data: Column) -> Column:
    """ASCIIHexDecode of a text: up to ``>``, white space ignored, an odd digit padded."""
    digits = F.regexp_replace(F.regexp_extract(data, "^[^>]*", 0), r"[\x00\t\n\x0C\r ]", "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def real(x: Column) -> Column:
    """A number as content streams have it: at most six decimals, no trailing zeros."""
    out = F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")
    return F.when(out.isin("-0", ""), "0").otherwise(out)


def real_text(x: Column) -> Column:
    return real(x)


def pdf_name(x: Column) -> Column:
    """A name token; characters outside the regular ones as #XX."""
    chars = F.split(x, "")
    return F.concat(F.lit("/"), F.array_join(F.transform(chars, lambda c: F.when(c.rlike(r"^[!-~]$") & ~c.rlike(r"^[()<>\[\]{}/%#]$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "#$1"))), ""))
