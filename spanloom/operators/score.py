"""Scores: additive counters by document and system, summed and turned into ratios last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio
from .match import COUNTED, overlap_flags, pooled

COUNTERS = ("tp", "fp", "fn", "gold_chars_leaked", "gold_chars_total")


def document_scores(runs: DataFrame, mode: str = "type", keys: Sequence[str] = ("benchmark", "doc_id", "system")) -> DataFrame:
    """Counters of each document and system, within the row. A missed span leaks its full length, even where it is partly covered."""
    if mode not in COUNTED:
        raise ValueError(f"unknown mode {mode!r}")
    rows = runs.where("ok").select(*keys, COUNTED[mode](F.col("gold"), F.col("spans")).alias("_s"))
    return rows.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in COUNTERS])


def label_scores(runs: DataFrame, keys: Sequence[str] = ("benchmark", "doc_id", "system"), by: Sequence[str] = ("system",)) -> DataFrame:
    """Strict counters by label and group."""
    tp = F.least("g", "p")
    return labelled_f1(pooled(runs, list(keys), True).where("label is not null").select(*by, "label", tp.alias("tp"), (F.col("p") - tp).alias("fp"), (F.col("g") - tp).alias("fn")), by)


def labelled_f1(rows: DataFrame, by: Sequence[str] = ("system",)) -> DataFrame:
    """``label_scores`` from rows that have the counters of a label."""
    t = rows.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return t.select("*", F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 9).alias("f1"))


def both_f1(both: DataFrame, by: Sequence[str] = ("system",), mode: str = "type") -> DataFrame:
    """(by, original, changed): F1 in both conditions, from rows with gold_o, spans_o, gold_t and spans_t, in one pass."""
    return counted_f1(both.select(*by, COUNTED[mode](F.col("gold_o"), F.col("spans_o")).alias("o"), COUNTED[mode](F.col("gold_t"), F.col("spans_t")).alias("t")), by)


def counted_f1(rows: DataFrame, by: Sequence[str] = ("system",)) -> DataFrame:
    """``both_f1`` from rows that have the counters o and t of both conditions."""
    sums = rows.groupBy(*by).agg(*[F.sum(f"{s}.{c}").alias(f"{s}_{c}") for s in "ot" for c in ("tp", "fp", "fn")])
    f1 = lambda s: ratio(2 * F.col(f"{s}_tp"), 2 * F.col(f"{s}_tp") + F.col(f"{s}_fp") + F.col(f"{s}_fn"))
    return sums.select(*by, f1("o").alias("original"), f1("t").alias("changed"))


def ratios(tp: Column, fp: Column, fn: Column, leaked: Column, total: Column) -> list[Column]:
    """precision, recall, f1, leakage_rate and char_leakage_rate; 0 for an empty denominator, so leakage is 1 without labelled spans."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), (1 - r).alias("leakage_rate"), ratio(leaked, total).alias("char_leakage_rate")]


def micro_average(scores: DataFrame, by: Sequence[str] = ("system",), places: int | None = None) -> DataFrame:
    """Summed counters and their ratios by group, with the number of successful documents."""
    total = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(c).alias(c) for c in COUNTERS])
    made = total.select("*", *ratios(*[F.col(c) for c in COUNTERS]))
    if places is None:
        return made
    return made.select(*by, "n_docs", *COUNTERS, *[F.round(c, places).alias(c) for c in ("precision", "recall", "f1", "leakage_rate", "char_leakage_rate")])


def over_redaction(runs: DataFrame, by: Sequence[str] = ("system",)) -> DataFrame:
    """Predictions that overlap no labelled span, and the share of documents without labelled spans that get any."""
    flags = overlap_flags(F.col("spans"), F.col("gold"))
    rows = runs.where("ok").select(*by, F.size("gold").alias("n_gold"), flags.alias("hit"))
    each = rows.select(*by, "n_gold", F.size("hit").alias("n"), F.size(F.filter("hit", lambda h: ~h)).alias("stray"))
    none = F.col("n_gold") == 0
    sums = each.groupBy(*by).agg(F.sum("n").alias("n_pred"), F.sum("stray").alias("n_stray"), F.count_if(none).alias("n_negative_docs"), F.count_if(none & (F.col("n") > 0)).alias("n_flagged_docs"))
    return sums.select("*", F.round(ratio(F.col("n_stray"), F.col("n_pred")), 9).alias("stray_rate"), F.round(ratio(F.col("n_flagged_docs"), F.col("n_negative_docs")), 9).alias("negative_fpr"))
