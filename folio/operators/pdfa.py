"""Archival conformance: each rule is a query over facts; the report is their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule number, what is found, and whether its absence is the violation.
RULES_2B = (
    ("6.1.1", "trailer/Encrypt", False, "the file is encrypted"),
    ("6.2.2", "font/missing", False, "a font isn't embedded"),
    ("6.6.1", "names/JavaScript", False, "the file has scripts"),
    ("6.2.3", "catalog/OutputIntents", True, "no output intent"),
    ("6.7.2", "catalog/Metadata", True, "no metadata stream"),
)
RULES_1B = (*RULES_2B, ("6.4.1", "extgstate/transparent", False, "transparency is used"), ("6.1.3", "stream/external", False, "a stream has external data"))


def _rules(level: str) -> tuple[Column, list[str], Column]:
    """Rules by the fact that breaks them, the facts asked for, and the rules that break without these."""
    rules = RULES_1B if level == "1b" else RULES_2B
    lacking = [r for r in rules if r[2]]
    named = F.create_map(*[F.lit(x) for r in rules if not r[2] for x in (r[1], f"{r[0]}\t{r[3]}")])
    wanted = F.array(*[F.struct(F.lit(r[1]).alias("fact"), F.lit(f"{r[0]}\t{r[3]}").alias("_r")) for r in lacking])
    return named, [r[1] for r in lacking], wanted


def _absent(wanted: Column, have: Column) -> Column:
    return F.transform(F.filter(wanted, lambda w: ~F.array_contains(have, w["fact"])), lambda w: F.struct(w["_r"].alias("_r"), F.lit(None).cast("int").alias("obj_num")))


def n_violations(facts: Column, level: str = "1b") -> Column:
    """How many rows ``violations`` has of a file, by the array of its facts (fact, obj_num); null without one."""
    named, _, wanted = _rules(level)
    broken = F.filter(facts, lambda x: F.element_at(named, x["fact"]).isNotNull())
    return F.when(facts.isNotNull(), F.size(broken) + F.size(_absent(wanted, F.transform(facts, lambda x: x["fact"])))).cast("long")


def violations(facts: DataFrame, level: str = "1b") -> DataFrame:
    """(doc_id, rule, description, obj_num) for level 1b, 2b or 3b, which has the rules of 2b.

    Standard fonts without a descriptor count as missing in none of the levels.
    """
    named, asked, wanted = _rules(level)
    # facts are read once: of a file, what they break and which of those asked for are there; every file has a fact
    broken = F.when(F.element_at(named, F.col("fact")).isNotNull(), F.struct(F.element_at(named, F.col("fact")).alias("_r"), F.col("obj_num").cast("int").alias("obj_num")))
    have = facts.groupBy("doc_id").agg(F.collect_list(broken).alias("_broken"), F.collect_set(F.when(F.col("fact").isin(asked), F.col("fact"))).alias("_have"))
    out = have.select("doc_id", F.explode(F.concat("_broken", _absent(wanted, F.col("_have")))).alias("w"))
    return out.select("doc_id", F.split("w._r", "\t")[0].alias("rule"), F.split("w._r", "\t")[1].alias("description"), "w.obj_num")
