"""Catalyst expressions for words and their windows, for operators without Python workers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between words [^\x20\x09-\x0D]+
SPACES = r"[\x20\x09-\x0D]+"
#: Between lower-case words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ascii_lower(text: Column) -> Column:
    # lower() is fast, and the same where all characters are ASCII
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column, between: str) -> Column:
    """The words of a text, an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), between), lambda w: w != "")


def index(n: Column) -> Column:
    """1 to n; empty if n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def rolling(hashes: Column, k: int) -> Column:
    """A hash of each k consecutive elements."""
    return F.transform(index(F.size(hashes) - (k - 1)), lambda i: F.xxhash64(*[F.element_at(hashes, i + j) for j in range(k)]))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, changed as far as needed to be none of the columns."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
