"""Text editing geometry, XMP and form data as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import xml_unescape


def caret_offsets(advances: Column) -> Column:
    """Positions before each character and after the last: running sums from 0."""
    return F.aggregate(advances, F.array(F.lit(0.0)), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + w)))


def text_width(advances: Column) -> Column:
    return F.aggregate(advances, F.lit(0.0), lambda a, w: a + w)


def hit_test(offsets: Column, x: Column) -> Column:
    """Index of the offset nearest to x; the first of two equally near."""
    return F.array_min(F.transform(offsets, lambda o, i: F.struct(F.abs(o - x).alias("d"), i.alias("i")))).i


def wrap(text: Column, width: Column, advance: float) -> Column:
    """Lines of at most ``width``, broken greedily at blanks; a longer word has a line of its own. Characters advance alike."""
    fits = lambda a, w: (F.length(a.line) + 1 + F.length(w)) * advance <= width
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("line"))

    def step(a, w):
        first = F.struct(a.done.alias("done"), w.alias("line"))
        joined = F.struct(a.done.alias("done"), F.concat(a.line, F.lit(" "), w).alias("line"))
        broken = F.struct(F.concat(a.done, F.array(a.line)).alias("done"), w.alias("line"))
        return F.when(a.line.isNull(), first).when(fits(a, w), joined).otherwise(broken)

    return F.aggregate(F.split(text, " "), start, step, lambda a: F.concat(a.done, F.array(a.line)))


def decoration(size: Column) -> Column:
    """Struct (thickness, underline, strike) of a font size."""
    return F.struct(F.greatest(size * 0.05, F.lit(0.5)).alias("thickness"), (size * 0.12).alias("underline"), (size * 0.30).alias("strike"))


def font_style(flags: Column, weight: Column, stem_v: Column, italic_angle: Column, name: Column) -> Column:
    """Struct (bold, italic) from a descriptor's values and the font's name; nulls say nothing."""
    low = F.lower(F.coalesce(name, F.lit("")))
    no = F.lit(False)
    bold = F.coalesce(flags.bitwiseAND(1 << 18) != 0, no) | F.coalesce(weight >= 700, no) | F.coalesce(stem_v >= 120, no) | low.contains("bold")
    italic = F.coalesce(flags.bitwiseAND(1 << 6) != 0, no) | F.coalesce(italic_angle != 0, no) | low.contains("italic") | low.contains("oblique")
    return F.struct(bold.alias("bold"), italic.alias("italic"))


def xmp(packet: Column) -> Column:
    """Struct of the usual tags of an XMP packet; title, creator and description from their first list item."""
    plain = lambda tag: F.regexp_extract(packet, f"<{tag}>([^<]*)</{tag}>", 1)
    listed = lambda tag: F.regexp_extract(packet, f"(?s)<{tag}>.*?<rdf:li[^>]*>([^<]*)</rdf:li>", 1)
    tags = {"title": listed("dc:title"), "creator": listed("dc:creator"), "description": listed("dc:description"), "producer": plain("pdf:Producer"), "keywords": plain("pdf:Keywords"), "creator_tool": plain("xmp:CreatorTool"), "create_date": plain("xmp:CreateDate"), "modify_date": plain("xmp:ModifyDate")}
    return F.struct(*[xml_unescape(F.nullif(v, F.lit(""))).alias(k) for k, v in tags.items()])


def xfdf_fields(xfdf: Column) -> Column:
    """Array of (name, value) of an XFDF text; a field without a value has null."""
    fields = F.regexp_extract_all(xfdf, F.lit(r"(<field name=\"[^\"]*\">(?:<value>[^<]*</value>)?)"), 1)
    value = lambda f: F.when(f.contains("<value>"), xml_unescape(F.regexp_extract(f, r"<value>([^<]*)</value>", 1)))
    return F.transform(fields, lambda f: F.struct(xml_unescape(F.regexp_extract(f, r'name="([^"]*)"', 1)).alias("name"), value(f).alias("value")))
