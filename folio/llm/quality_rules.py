"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. A rule has
accuracies, the probabilities that a vote of it is right on good and on bad
documents. Expectation-maximisation over the counts of vote patterns estimates accuracies and the share of good
documents; a document's posterior probability of being good then decides.
Patterns number 3 ** rules at most, however many documents there are.

Defined results: a null or empty text has no words and fails the base rules.
Rows are independent; repeats vote like others. A very long text is counted as a
whole, in one row. Columns other than ``doc_id`` and ``text`` pass through or
aren't read, so they may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._expr import SPACES, index, let, words
from ._store import Scratch

SYMBOLS = "#*$%&|<>"
_SPACE_CHARS = " \t\n\x0b\x0c\r"


def _count(text: Column, part: str) -> Column:
    """Occurrences of an ASCII character."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))


def _covered(hashes: Column, k: int) -> Column:
    """Number of positions in windows of k that are found twice or more."""

    def of_sorted(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (x.h == F.get(s, i - 1).h) | (x.h == F.get(s, i + 1).h))
        places = F.sort_array(F.transform(twice, lambda x: x.p))
        start = F.struct(F.lit(0).alias("n"), F.lit(-k).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a.n + F.least(F.lit(k), p - a.last)).alias("n"), p.alias("last")), lambda a: a.n)

    windows = F.transform(index(F.size(hashes) - (k - 1)), lambda i: F.struct(F.xxhash64(*[F.element_at(hashes, i + j) for j in range(k)]).alias("h"), i.alias("p")))
    return let(F.sort_array(windows), of_sorted)


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns to keep and the counts that rules use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    spaces = sum((_count(text, c) for c in _SPACE_CHARS), F.lit(0))
    caps = lambda w: F.size(F.filter(w, lambda x: (x == F.upper(x)) & (x != F.lower(x)) & (F.length(x) > 1)))
    odd = lambda w: F.size(F.filter(w, lambda x: x.rlike(f"[{SYMBOLS}]")))
    of_words = let(
        words(F.col("text"), SPACES),
        lambda w: F.struct(F.size(w).alias("n_words"), caps(w).alias("n_caps"), odd(w).alias("n_odd"), let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _covered(h, 3)).alias("n_repeat_words")),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    out = docs.select(
        *keep,
        of_words.alias("_w"),
        of_lines.alias("_l"),
        (F.length(text) - spaces).cast("long").alias("word_chars"),
        sum((_count(text, c) for c in SYMBOLS), F.lit(0)).cast("long").alias("n_symbols"),
        _count(text, "!").cast("long").alias("n_bangs"),
        (_count(text, ".") + _count(text, ",")).cast("long").alias("n_stops"),
    )
    whole = [F.col(f"_w.{c}").cast("long").alias(c) for c in ("n_words", "n_caps", "n_odd", "n_repeat_words")] + [F.col(f"_l.{c}").cast("long").alias(c) for c in ("n_lines", "n_dup_lines")]
    return out.select(*keep, *whole, "word_chars", "n_symbols", "n_bangs", "n_stops")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(share: Column, good: tuple[float, float], bad: tuple[float, float]) -> Column:
    """Good within the first bounds, bad outside the second, else abstains."""
    return F.when(share.between(*good), 1).when(~share.between(*bad), -1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by rule; on texts without words all abstain."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    own = {
        "word_length": _vote(per_word("word_chars"), (3, 9), (2, 14)),
        "symbols": _vote(per_word("n_symbols"), (0, 0.03), (0, 0.15)),
        "symbol_words": _vote(per_word("n_odd"), (0, 0.02), (0, 0.1)),
        "capitals": _vote(per_word("n_caps"), (0, 0.1), (0, 0.35)),
        "exclamations": _vote(per_word("n_bangs"), (0, 0.05), (0, 0.25)),
        "stops": _vote(per_word("n_stops"), (0.02, 0.6), (0.005, 1.5)),
        "repeats": _vote(per_word("n_repeat_words"), (0, 0.15), (0, 0.4)),
        "lines": _vote(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), (0, 0.1), (0, 0.4)),
    }
    return {k: F.when(F.col("n_words") > 0, v).otherwise(0) for k, v in own.items()}


class WeakSupervision:
    """Accuracies of voters without labels.

    A rule that votes on a document is right with one probability if the
    document is good, and with another if it is bad; abstaining says nothing.
    ``steps`` rounds of expectation-maximisation start from ``good`` and ``bad``
    for these; ``prior`` counts as so many votes, as a share of the documents,
    at those values. A rule stays at least as good as a coin: the two together
    are 1 or more.
    """

    def __init__(self, steps: int = 40, good: float = 0.99, bad: float = 0.35, prior: float = 0.005):
        self.steps, self.good, self.bad, self.prior = steps, good, bad, prior

    @staticmethod
    def _posterior(votes: Column, share: Column, good: Column, bad: Column) -> Column:
        """Probability of a good document."""
        each = F.transform(F.arrays_zip(votes.alias("v"), good.alias("g"), bad.alias("b")), lambda x: F.when(x["v"] > 0, F.ln(x["g"] / (1 - x["b"]))).when(x["v"] < 0, F.ln((1 - x["g"]) / x["b"])).otherwise(0.0))
        return 1 / (1 + F.exp(-F.aggregate(each, F.ln(share / (1 - share)), lambda s, x: s + x)))

    def model(self, voted: DataFrame, rules: int) -> DataFrame:
        """One row (share, good, bad) from the counts of all documents' votes (array of int)."""
        patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
        table = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))  # 3 ** rules entries at most
        total = F.greatest(F.aggregate("patterns", F.lit(0.0), lambda s, p: s + p.n), F.lit(1.0))
        weight = F.lit(self.prior) * total

        def step(now: Column, _: Column) -> Column:
            known = F.transform("patterns", lambda p: F.struct(p.votes.alias("votes"), p.n.alias("n"), self._posterior(p.votes, now.share, now.good, now.bad).alias("q")))

            def update(rows: Column) -> Column:
                add = lambda f, zero: F.aggregate(rows, zero, lambda s, r: s + f(r))
                rate = lambda right, cast, start: F.least(F.greatest(add(right, start * weight) / add(cast, weight), F.lit(0.01)), F.lit(0.999))
                good = lambda j: rate(lambda r: F.when(r.votes[j] > 0, r.n * r.q).otherwise(0.0), lambda r: F.when(r.votes[j] != 0, r.n * r.q).otherwise(0.0), F.lit(self.good))
                bad = lambda j: rate(lambda r: F.when(r.votes[j] < 0, r.n * (1 - r.q)).otherwise(0.0), lambda r: F.when(r.votes[j] != 0, r.n * (1 - r.q)).otherwise(0.0), F.lit(self.bad))
                share = add(lambda r: r.n * r.q, F.lit(0.0)) / total
                pair = lambda j: let(good(j), lambda g: F.struct(g.alias("g"), F.greatest(bad(j), 1 - g).alias("b")))
                return let(F.array(*[pair(j) for j in range(rules)]), lambda pairs: F.struct(F.least(F.greatest(share, F.lit(0.01)), F.lit(0.99)).alias("share"), F.transform(pairs, lambda x: x.g).alias("good"), F.transform(pairs, lambda x: x.b).alias("bad")))

            return let(known, update)

        first = F.struct(F.lit(0.5).alias("share"), F.array(*[F.lit(self.good)] * rules).alias("good"), F.array(*[F.lit(self.bad)] * rules).alias("bad"))
        # no documents leave the starting values
        fitted = F.when(F.size("patterns") > 0, F.aggregate(F.sequence(F.lit(1), F.lit(self.steps)), first, step)).otherwise(first)
        return table.select(fitted.alias("m")).select("m.share", "m.good", "m.bad")


class QualityRules:
    def __init__(self, supervision: WeakSupervision | None = None, threshold: float = 0.5):
        self.supervision, self.threshold = supervision or WeakSupervision(), threshold

    def judge(self, docs: DataFrame) -> DataFrame:
        """doc_id and text_key of each row, its counts, votes, base_failed, quality (posterior) and kept."""
        scratch = Scratch(docs.sparkSession, "quality")
        names = list(rules())
        counted = features(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), ["doc_id", "text_key"])
        voted = scratch.keep(counted.withColumns({"base_failed": base_failed(), "votes": F.array(*[v.cast("int") for v in rules().values()])}), "votes")
        model = self.supervision.model(voted, len(names)).first()  # one row
        rates = [F.array(*map(F.lit, x)) for x in (model.good, model.bad)]
        quality = self.supervision._posterior(F.col("votes"), F.lit(model.share), *rates)
        return voted.withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= self.threshold))

    def keep(self, docs: DataFrame) -> DataFrame:
        """The documents that are kept."""
        gone = self.judge(docs).where(~F.col("kept")).select(F.struct(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).alias("gone")).distinct()
        return docs.join(gone, F.struct(docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("key")).eqNullSafe(gone["gone"]), "left_anti")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their counts and verdicts; those without words fail."""
    judged = QualityRules().judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
