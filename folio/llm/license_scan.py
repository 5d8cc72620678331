"""License scan by diagonal voting.

All rolling word k-gram hashes of a text join the k-gram hashes of license
templates. A match at text position p and template position t votes for the
diagonal p - t. Votes are counted by diagonal, neighbouring diagonals merge into
one span (a word put in or left out shifts the rest), and a span is verified by
the share of the template that voted and by its length.

Short phrases are templates too, with two-word grams; a phrase stands where its
words stand consecutively, which all of its votes on one diagonal say.

Defined results: a null or empty text has no words. Rows are judged each by
itself, also if ids repeat or are null; a very long text is scanned as a whole.
Only ``doc_id`` and ``text`` are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _words as W
from ._store import Scratch

# The phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Opening or characteristic passages of public licenses, by label.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
)


class LicenseScan:
    """``share`` of a template's grams must vote; merged diagonals lie at most ``drift`` apart."""

    def __init__(self, phrases: dict[str, str] | None = None, templates: tuple[tuple[str, str], ...] | None = None, gram: int = 4, share: float = 0.6, drift: int = 4):
        self.phrases, self.templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
        self.gram, self.share, self.drift = gram, share, drift

    def _library(self) -> list[tuple]:
        """(h, template, label, phrase, t, votes, words) of every gram of phrases and templates; of fixed size."""
        out = []
        for phrase, kinds in ((True, list(self.phrases.items())), (False, [(text, label) for label, text in self.templates])):
            k = 2 if phrase else self.gram
            for i, (text, label) in enumerate(kinds):
                chunk = W.Chunk([text.encode()], W.ALNUM, True)
                grams = W.signed(W.windows(chunk.hashes, k)).tolist()
                out += [(h, f"{'p' if phrase else 't'}{i}", label, phrase, t, len(grams), len(chunk.hashes)) for t, h in enumerate(grams)]
        return out

    def votes(self, docs: DataFrame) -> DataFrame:
        """(row, doc_id, n_words, pos, template, ...) of each match, and a row without template for each row of docs."""
        gram = self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row = 0
                for chunk in W.chunks(batch["text"], W.ALNUM, True):
                    pair, lo, hi = chunk.windows(2)
                    more, lo4, hi4 = chunk.windows(gram)
                    n = np.diff(chunk.at)
                    found = [np.concatenate((pair[a:b], more[c:d])) for a, b, c, d in zip(lo.tolist(), hi.tolist(), lo4.tolist(), hi4.tolist())]
                    part = batch.slice(row, len(chunk))
                    yield pa.RecordBatch.from_arrays([part["row"], part["doc_id"], pa.array(n, pa.int64()), W.lists([W.signed(x) for x in found], pa.int64())], ["row", "doc_id", "n_words", "grams"])
                    row += len(chunk)

        kind = dict(docs.dtypes)["doc_id"]
        rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, n_words long, grams array<long>")
        each = rows.select("row", "doc_id", "n_words", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), "grams")).alias("i", "h"))
        library = docs.sparkSession.createDataFrame(self._library(), "h long, template string, label string, phrase boolean, t int, votes int, words int")
        joined = each.join(F.broadcast(library), "h", "left").where("i = 0 OR template IS NOT NULL")  # the library is of fixed size
        pairs = F.greatest(F.col("n_words") - 1, F.lit(0))
        pos = F.when(F.col("i") > 0, F.when(F.col("phrase"), F.col("i") - 1).otherwise(F.col("i") - 1 - pairs)).cast("long")
        # a pair of words is no vote for a template's longer grams, nor the other way round
        return joined.withColumn("pos", pos).where(F.col("template").isNull() | F.col("phrase") & (F.col("i") <= pairs) | ~F.col("phrase") & (F.col("pos") >= 0))

    def spans(self, docs: DataFrame) -> DataFrame:
        """Verified spans (row, doc_id, n_words, label, phrase, first, end, score), and a row without label for each row of docs."""
        by_row = ["row", "doc_id", "n_words"]
        diagonal = self.votes(docs).groupBy(*by_row, "template", "label", "phrase", "votes", "words", (F.col("pos") - F.col("t")).alias("diagonal")).agg(F.countDistinct("t").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("t").alias("ts"))
        diagonal = Scratch(docs.sparkSession, "licenses").keep(diagonal, "diagonals")  # texts are read once
        exact = diagonal.where("template IS NULL OR (phrase AND n = votes)").select(*by_row, "label", "phrase", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("words")).alias("end"), F.lit(1.0).alias("score"))
        own = Window.partitionBy("row", "template").orderBy("diagonal")
        islands = diagonal.where("NOT phrase").withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(own) <= self.drift, 0).otherwise(1)).withColumn("island", F.sum("new").over(own))
        # an island longer than two templates falls apart into its diagonals
        whole = Window.partitionBy("row", "template", "island")
        length = F.max("hi").over(whole) + self.gram - F.min("lo").over(whole)
        islands = islands.withColumn("piece", F.when(length > 2 * F.col("words"), F.col("diagonal")))
        merged = islands.groupBy(*by_row, "template", "label", "phrase", "votes", "words", "island", "piece").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("n"), F.min("lo").alias("first"), (F.max("hi") + self.gram).alias("end"))
        sound = merged.withColumn("score", F.col("n") / F.col("votes")).where(F.col("score") >= self.share)
        return exact.unionByName(sound.select(*by_row, "label", "phrase", "first", "end", "score"))

    def digests(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
        base = F.col("phrase")
        named = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
        out = self.spans(docs).groupBy("row", "doc_id", "n_words").agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("first"))).alias("first_word"),
            F.max(F.when(base, F.col("first"))).alias("last_word"),
            named(F.when(base, F.col("label"))).alias("base_labels"),
            named("label").alias("labels"),
            F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("score"))), F.lit(0.0)).alias("score"),
        )
        return out.drop("row")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their phrases and labels; those without words have none."""
    return LicenseScan().digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
