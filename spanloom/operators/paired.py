"""Paired comparison of two conditions of the same documents on their masked spans.

Rows with both conditions have gold_o, spans_o, gold_t and spans_t. Documents whose span counts differ are left out as a
whole; a span is masked if its text differs between the conditions; a span is found if any prediction overlaps it.
Each (span, system) counts as independent: no correction for clustering within documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import equivalent, mcnemar, paired_difference, ratio
from .match import equal_flags, overlap_flags


def pair_runs(original: DataFrame, changed: DataFrame, keys: Sequence[str] = ("benchmark", "doc_id", "system")) -> DataFrame:
    """Runs of both conditions, matched by key; what only one of them has is left out."""
    side = lambda df, tag: df.where("ok").select(*keys, F.col("gold").alias(f"gold_{tag}"), F.col("spans").alias(f"spans_{tag}"))
    return side(original, "o").join(side(changed, "t"), list(keys))


def paired_spans(both: DataFrame, keys: Sequence[str] = ("benchmark", "doc_id", "system"), exact: bool = False) -> DataFrame:
    """(keys, idx, label, original, changed, masked, found_o, found_t) of every pair of spans; with ``exact`` also exact_o and exact_t, whether a prediction has a span's very bounds."""
    flags = {"fo": overlap_flags("gold_o", "spans_o"), "ft": overlap_flags("gold_t", "spans_t")}
    if exact:
        flags |= {"eo": equal_flags("gold_o", "spans_o"), "et": equal_flags("gold_t", "spans_t")}
    return flagged_spans(both.select(*keys, "gold_o", "gold_t", *[c.alias(name) for name, c in flags.items()]), keys, exact)


def flagged_spans(flagged: DataFrame, keys: Sequence[str] = ("benchmark", "doc_id", "system"), exact: bool = False) -> DataFrame:
    """``paired_spans`` from rows that have the flags fo and ft (with ``exact`` also eo and et) of their spans."""
    flags = ("fo", "ft", "eo", "et") if exact else ("fo", "ft")
    # not a filter on the sizes: pushed below an exchange it would run the detectors and the rewriting twice
    even = F.when(F.size("gold_o") == F.size("gold_t"), F.arrays_zip("gold_o", "gold_t", *flags))
    each = flagged.select(*keys, F.posexplode(even).alias("idx", "z"))
    masked = ~F.col("z.gold_o.text").eqNullSafe(F.col("z.gold_t.text"))
    return each.select(*keys, "idx", F.col("z.gold_o.label").alias("label"), F.col("z.gold_o.text").alias("original"), F.col("z.gold_t.text").alias("changed"), masked.alias("masked"), F.col("z.fo").alias("found_o"), F.col("z.ft").alias("found_t"), *([F.col("z.eo").alias("exact_o"), F.col("z.et").alias("exact_t")] if exact else []))


#: Counts of a cell: all pairs, masked ones, and of the masked ones those found in either condition, in one alone (b, c), lost at the same length, and met by exact bounds.
CELL = ("n", "n_masked", "found_original", "found_changed", "b", "c", "b_same_length", "exact_original", "exact_changed")


def pair_cells(pairs: DataFrame) -> DataFrame:
    """Pairs as cells of one: rows that have the counts ``CELL`` beside their keys, system and label, and may stand for any number of pairs (those by exact bounds only where pairs have them). What counts pairs takes cells too."""
    if "n_masked" in pairs.columns:
        return pairs
    found_o, found_t = F.col("found_o"), F.col("found_t")
    flags = {"found_original": found_o, "found_changed": found_t, "b": found_o & ~found_t, "c": ~found_o & found_t, "b_same_length": found_o & ~found_t & (F.length("original") == F.length("changed"))}
    flags |= {f"exact_{name}": F.col(f"exact_{side}") for name, side in (("original", "o"), ("changed", "t")) if f"exact_{side}" in pairs.columns}
    one = lambda c: F.when(c, 1).otherwise(0).cast("bigint")
    keys = [c for c in ("benchmark", "doc_id", "system", "label") if c in pairs.columns]
    return pairs.select(*keys, F.lit(1).cast("bigint").alias("n"), one(F.col("masked")).alias("n_masked"), *[one(F.col("masked") & c).alias(name) for name, c in flags.items()])


def _masked(pairs: DataFrame) -> DataFrame:
    """Cells that have masked pairs, which n counts."""
    return pair_cells(pairs).where("n_masked > 0").drop("n").withColumnRenamed("n_masked", "n")


def _sums(*names: str) -> list[Column]:
    return [F.sum(c).alias(c) for c in names]


def contingency(pairs: DataFrame, by: Sequence[str] = ("benchmark",), pooled: bool = False) -> DataFrame:
    """Hits in both conditions and discordant pairs b, c over masked spans; ``pooled`` adds a row POOLED over all (for a single key)."""
    masked, counts = _masked(pairs), _sums("n", "found_original", "found_changed", "b", "c")
    if not pooled:
        return masked.groupBy(*by).agg(*counts)
    key = by[0]
    out = masked.rollup(key).agg(F.grouping(key).alias("_g"), *counts)
    return out.withColumn(key, F.when(F.col("_g") == 1, "POOLED").otherwise(F.col(key))).drop("_g")


def statistics(table: DataFrame, margins: Sequence[float] = (0.01, 0.02, 0.03), places: int = 9) -> DataFrame:
    """For each row of a contingency and each margin: difference, 95 % interval, McNemar's chi-square and the equivalence decision."""
    d, se = paired_difference(F.col("n"), F.col("b"), F.col("c"))
    rows = table.select("*", d.alias("difference"), se.alias("se"), mcnemar(F.col("b"), F.col("c")).alias("chi2"))
    each = rows.select("*", F.explode(F.array(*[F.lit(float(m)) for m in margins])).alias("margin"))
    half = 1.96 * F.col("se")
    low, high = F.col("difference") - half, F.col("difference") + half
    keep = [c for c in table.columns]
    return each.select(*keep, "margin", F.round("difference", places).alias("difference"), F.round(low, places).alias("low"), F.round(high, places).alias("high"), F.round("chi2", places).alias("chi2"), equivalent(F.col("n"), F.col("difference"), F.col("se"), F.col("margin")).alias("equivalent"))


def retention(pairs: DataFrame, by: Sequence[str] = ("system",)) -> DataFrame:
    """Recall in both conditions and their ratio (it may exceed 1) over masked spans, by overlap and by exact bounds."""
    t = _masked(pairs).groupBy(*by).agg(*_sums("n", *[f"{kind}_{side}" for kind in ("found", "exact") for side in ("original", "changed")]))
    rate = lambda a, b: F.round(ratio(F.col(a), F.col(b)), 9)
    overlap = [rate("found_original", "n").alias("recall_original"), rate("found_changed", "n").alias("recall_changed"), rate("found_changed", "found_original").alias("retention")]
    exact = [rate("exact_original", "n").alias("exact_recall_original"), rate("exact_changed", "n").alias("exact_recall_changed"), rate("exact_changed", "exact_original").alias("exact_retention")]
    return t.select(*by, "n", *overlap, *exact)


def coverage(pairs: DataFrame) -> DataFrame:
    """Share of labelled spans whose text changed, by label."""
    return pair_cells(pairs).groupBy("label").agg(*_sums("n", "n_masked")).select("label", "n", "n_masked", F.round(ratio(F.col("n_masked"), F.col("n")), 9).alias("share"))


def lost_composition(pairs: DataFrame) -> DataFrame:
    """Masked spans found only in the original condition, by label: number, share of all lost, and how many kept their length."""
    t = pair_cells(pairs).where("b > 0").groupBy("label").agg(F.sum("b").alias("n_lost"), F.sum("b_same_length").alias("n_same_length"))
    total = F.sum("n_lost").over(Window.partitionBy(F.lit(0)))  # over a row for each label
    return t.select("label", "n_lost", "n_same_length", F.round(ratio(F.col("n_lost"), total), 9).alias("share"))


def agreement(pairs: DataFrame, keys: Sequence[str] = ("benchmark", "doc_id")) -> DataFrame:
    """How many masked spans are found by how many systems, in the original condition."""
    each = pairs.where("masked").groupBy(*keys, "idx").agg(F.count_if("found_o").alias("n_systems"))
    return agreement_sums(each.withColumn("n_spans", F.lit(1)))


def agreement_sums(counts: DataFrame) -> DataFrame:
    """``agreement`` from rows that have numbers n_systems and n_spans."""
    return counts.groupBy("n_systems").agg(F.sum("n_spans").alias("n_spans"))


def recall_sums(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``recall_cells`` from rows that have counts n and found; groups without spans are left out."""
    t = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("found").alias("found")).where("n > 0")
    return t.select("*", F.round(ratio(100.0 * F.col("found"), F.col("n")), 1).alias("recall_pct"))


def recall_cells(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, found, recall_pct): hits among spans, in percent to one decimal, 0 for none."""
    t = found.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("found").alias("found"))
    return t.select("*", F.round(ratio(100.0 * F.col("found"), F.col("n")), 1).alias("recall_pct"))
