"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing column names."""

import random

from pyspark.sql import Row

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, words string, row string, h string, _id string, _key string, starts string, id string, key string, cid string, block string, label string"


def texts(n=60, seed=7):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É!", "the", "The", "|", "***", "a.b", "x\u00a0y", "日本"]
    out = [None, "", " \n\t ", "one", "two words", "one two three four five", "Apache License apache license"]
    for _ in range(n):
        k = rng.choice([3, 6, 7, 11, 30, 80, 200])
        out.append(rng.choice(["", " "]) + "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", " "]) for _ in range(k)))
    for text in list(out[-30:]):  # near copies
        words = text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    out += [f"{rng.choice(vocabulary)} {passage} {rng.choice(vocabulary)}" for _ in range(4)]
    out += [out[20], out[20], out[21].upper(), passage]
    out.append(" ".join(rng.choice(vocabulary) for _ in range(20_000)))
    return out


def documents(spark, with_odd=True):
    found = texts()
    rows = [(i, t, "en", None, len(t or ""), *["clash"] * 11) for i, t in enumerate(found)]
    if with_odd:
        rows += [(None, "a text without an id that is long enough", *[None] * 14), rows[30], rows[30]]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


__all__ = ["COLUMNS", "Row", "as_rows", "documents", "lower", "texts"]
