"""Merging, comparing, ranking and sampling of results. Every choice among rows has an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..functions.text import stable_number


def merged_runs(rows: DataFrame, keys: Sequence[str], first: Sequence[str], last: Sequence[str], order: str) -> DataFrame:
    """One row a key from several files: ``first`` columns from the lowest ``order``, ``last`` ones from the highest, nulls apart."""
    ends = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    ends += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in last]
    return rows.groupBy(*keys).agg(*ends)


def last_rows(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key."""
    names = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), F.col(order)).alias("_row")).select(*keys, "_row.*")


def missing_cells(cells: DataFrame, *dimensions: DataFrame) -> DataFrame:
    """Combinations of the dimensions' rows that have no cell."""
    grid = dimensions[0]
    for d in dimensions[1:]:  # the grid is what is asked for, so its product is the result's own size
        grid = grid.crossJoin(d)
    return grid.join(cells, grid.columns, "left_anti")


def macro_mean(cells: DataFrame, value: str, by: str = "system", over: str = "benchmark") -> DataFrame:
    """Mean over benchmarks, null for a system that lacks one of them; its coverage beside it."""
    each = cells.groupBy(by).agg(F.count(F.col(value)).alias("coverage"), F.avg(value).alias("_mean"), F.collect_set(over).alias("_over"))
    # over a row for each system; a system's benchmarks are few
    total = F.size(F.array_distinct(F.flatten(F.collect_list("_over").over(Window.partitionBy(F.lit(0))))))
    t = each.select(by, "coverage", "_mean", total.alias("_all")).where("coverage > 0")
    return t.select(by, "coverage", F.when(F.col("coverage") == F.col("_all"), F.round("_mean", 9)).alias("mean"))


def paired_cells(original: DataFrame, changed: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """(keys, original, changed) of stored cells of both conditions; what only one of them has is null in the other."""
    return original.select(*keys, F.col(value).alias("original")).join(changed.select(*keys, F.col(value).alias("changed")), list(keys), "full")


def values_of(rows: DataFrame, column: str, most: int = 1000) -> list[str]:
    """The values of a column that becomes columns, in order; more than ``most`` are refused."""
    found = rows.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(r[0] for r in found)


def delta_matrix(cells: DataFrame, by: str = "system", over: str = "benchmark", columns: Sequence[str] | None = None) -> DataFrame:
    """Changed minus original by system, a column for each benchmark; null where either is missing. Without ``columns`` the cells are computed twice, once to find them."""
    names = list(columns) if columns is not None else values_of(cells, over)
    return cells.groupBy(by).pivot(over, names).agg(F.round(F.max(F.col("changed") - F.col("original")), 9))


def extrema(cells: DataFrame, value: str, over: str, lower_is_better: bool = False) -> DataFrame:
    """Each cell with whether it is its column's best (all ties within 1e-9) and its place on the column's heat scale from 0 to 1."""
    w = Window.partitionBy(over)
    low, high = F.min(value).over(w), F.max(value).over(w)
    rows = cells.select("*", low.alias("_low"), high.alias("_high"))
    best = F.col("_low") if lower_is_better else F.col("_high")
    span = F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")).otherwise(1.0)
    heat = (F.col(value) - F.col("_low")) / span
    return rows.select(*cells.columns, (F.abs(F.col(value) - best) < 1e-9).alias("best"), F.round(1 - heat if lower_is_better else heat, 9).alias("heat"))


def delta_heat(value: Column, low: Column, high: Column) -> Column:
    """A difference's place on a scale around 0.5, which spans at least 0.02 to each side."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + value / (2 * F.greatest(F.abs(low), F.abs(high), F.lit(0.02)))))


def document_f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 of one document by its counters, with at least 1 in the denominator."""
    return tp / F.greatest(F.lit(1.0), tp + 0.5 * (fp + fn))


def ranked(scores: DataFrame, keys: Sequence[str] = ("benchmark", "doc_id")) -> DataFrame:
    """Systems in order of F1 within each document, equal ones by name."""
    f1 = scores.select(*keys, "system", F.round(document_f1(F.col("tp"), F.col("fp"), F.col("fn")), 9).alias("f1"))
    return f1.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("f1"), "system")))


def disagreement(scores: DataFrame, top: int | None = 12, keys: Sequence[str] = ("benchmark", "doc_id")) -> DataFrame:
    """Documents by how far their best and worst systems are apart, 0 for fewer than two; the ``top`` ones, or all."""
    f1 = document_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    t = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_systems"), F.round(F.max(f1) - F.min(f1), 9).alias("gap"))
    t = t.select(*keys, "n_systems", F.when(F.col("n_systems") < 2, 0.0).otherwise(F.col("gap")).alias("gap"))
    return t if top is None else t.orderBy(F.desc("gap"), *keys).limit(top)


def rank_preservation(cells: DataFrame) -> DataFrame:
    """(system, rank_original, rank_changed, spearman) from (system, original, changed): ranks in both conditions and Spearman's correlation (one row for each system, so the windows are small)."""
    rank = lambda c: F.rank().over(Window.orderBy(F.desc(c)))
    both = cells.select("system", rank("original").alias("rank_original"), rank("changed").alias("rank_changed"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rho = F.corr(F.col("rank_original").cast("double"), F.col("rank_changed").cast("double")).over(whole)
    return both.select("*", F.round(rho, 9).alias("spearman"))


def stratified_sample(rows: DataFrame, stratum: str, total: int, strata: int, order: Sequence[str], seed: int = 20260806) -> DataFrame:
    """``total // strata`` rows, at least 1, of each stratum, by a seeded hash order; strata that have fewer aren't filled up."""
    per = max(1, total // strata)
    h = stable_number(F.lit(seed), *[F.col(c) for c in order])
    w = Window.partitionBy(stratum).orderBy("_h", *order)
    picked = rows.select("*", h.alias("_h")).withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= per)
    return picked.drop("_h")


def seeded_take(rows: DataFrame, n: int, order: Sequence[str], seed: int = 0) -> DataFrame:
    """``n`` rows in a seeded hash order."""
    return rows.select("*", stable_number(F.lit(seed), *[F.col(c) for c in order]).alias("_h")).orderBy("_h", *order).limit(n).drop("_h")


def head(rows: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def frequencies(rows: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts of values and their shares, blank ones as (blank); the ``top`` most frequent, or all."""
    value = F.when(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == "", "(blank)").otherwise(F.trim(F.col(column).cast("string")))
    t = rows.groupBy(value.alias(column)).agg(F.count(F.lit(1)).alias("n"))
    # the total of the grouped rows: their own aggregate would compute them again. Distinct values are what the window holds
    t = t.select(column, "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 9).alias("share"))
    return t if top is None else t.orderBy(F.desc("n"), column).limit(top)


def annotation_rates(sheet: DataFrame) -> DataFrame:
    """Rows, unreviewed ones, valid and type-consistent shares by benchmark, and over ALL."""
    yes = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit("")))) == "Y"
    t = sheet.rollup("benchmark").agg(F.grouping("benchmark").alias("_g"), F.count(F.lit(1)).alias("n"), F.count_if(~yes("reviewed")).alias("unreviewed"), F.count_if(yes("valid")).alias("valid"), F.count_if(yes("type_consistent")).alias("consistent"))
    return t.where("n > 0").select(F.when(F.col("_g") == 1, "ALL").otherwise(F.col("benchmark")).alias("benchmark"), "n", "unreviewed", F.round(ratio(F.col("valid"), F.col("n")), 9).alias("valid_rate"), F.round(ratio(F.col("consistent"), F.col("n")), 9).alias("consistent_rate"))


def aligned(first: DataFrame, second: DataFrame, column: str, key: Sequence[str] = ("id",)) -> DataFrame:
    """(key, first, second): two raters' labels of the same items, by id. Items that only one has rated, or that either has twice, are an error: the sheets then don't belong together."""
    side = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(f"_{name}"), F.first(F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))).alias(name))
    both = side(first, "first").join(side(second, "second"), list(key), "full")
    fine = F.coalesce((F.col("_first") == 1) & (F.col("_second") == 1), F.lit(False))
    refuse = F.raise_error(F.concat(F.lit("not rated once by both: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in key])))
    return both.select(*key, F.when(fine, F.col("first")).otherwise(refuse).alias("first"), F.when(fine, F.col("second")).otherwise(refuse).alias("second"))


def rater_kappa(first: DataFrame, second: DataFrame, column: str = "failure", key: Sequence[str] = ("id",)) -> DataFrame:
    """``kappa`` of one column in two sheets, aligned by id."""
    return kappa(aligned(first, second, column, key), "first", "second")


def best_systems(scores: DataFrame, keys: Sequence[str] = ("benchmark", "doc_id")) -> DataFrame:
    """Each document's system of the highest F1, the first by name of equal ones, with that F1."""
    f1 = F.round(document_f1(F.col("tp"), F.col("fp"), F.col("fn")), 9)
    t = scores.groupBy(*keys).agg(F.min(F.struct((-f1).alias("f"), "system")).alias("b"))
    return t.select(*keys, F.col("b.system").alias("system"), (-F.col("b.f")).alias("f1"))


def all_systems(*runs: DataFrame) -> DataFrame:
    """Every system that any of the runs has, once."""
    out = runs[0].select("system")
    for r in runs[1:]:
        out = out.unionByName(r.select("system"))
    return out.distinct()


def kappa(ratings: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two columns of aligned labels: n, agree, observed, expected, kappa (1 if chance agreement is complete)."""
    cell = ratings.groupBy(F.col(a).cast("string").alias("_a"), F.col(b).cast("string").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    ends = cell.select(F.explode(F.array(F.struct(F.col("_a").alias("v"), F.col("_n").alias("x"), F.lit(0).alias("y")), F.struct(F.col("_b").alias("v"), F.lit(0).cast("bigint").alias("x"), F.col("_n").alias("y")))).alias("m")).select("m.*")
    chance = ends.groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("_e"))
    t = cell.agg(F.sum("_n").alias("n"), F.coalesce(F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n"))), F.lit(0)).alias("agree")).crossJoin(chance)
    po, pe = ratio(F.col("agree"), F.col("n")), ratio(F.col("_e"), F.col("n") * F.col("n"))
    return t.select("n", "agree", F.round(po, 9).alias("observed"), F.round(pe, 9).alias("expected"), F.round(F.when(pe >= 1, 1.0).otherwise(F.try_divide(po - pe, 1 - pe)), 9).alias("kappa"))


def manifest(docs: DataFrame, by: Sequence[str] = ("benchmark",)) -> DataFrame:
    """Documents, labelled spans and bytes of each dataset."""
    return docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("gold")).cast("bigint").alias("n_spans"), F.sum(F.octet_length("text")).cast("bigint").alias("n_bytes"))


def text_table(rows: DataFrame, columns: Sequence[str], sep: str = " | ") -> DataFrame:
    """A line of text for each row, for Markdown (" | ") or LaTeX (" & "); null as a dash."""
    return rows.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns]).alias("line"))


def run_index(summaries: DataFrame) -> DataFrame:
    """A row for each stored summary: its stem, benchmark, mode, systems and largest number of documents."""
    return summaries.groupBy("stem").agg(F.min_by("benchmark", "system").alias("benchmark"), F.min_by("mode", "system").alias("mode"), F.count_distinct("system").alias("n_systems"), F.max("n_docs").alias("n_docs"))


def changed_name(name: Column) -> Column:
    """The benchmark that a changed one was made from."""
    return F.regexp_replace(name, "_transformed$", "")


def paired_benchmarks(cells: DataFrame, value: str, order: str) -> DataFrame:
    """(system, benchmark, original, changed): cells of benchmarks and of their changed forms, matched by name; of repeated cells the last by ``order``."""
    base = changed_name(F.col("benchmark"))
    which = F.when(base == F.col("benchmark"), "original").otherwise("changed")
    pick = lambda w: F.max_by(F.when(F.col("_w") == w, F.col(value)), F.when(F.col("_w") == w, F.col(order))).alias(w)
    t = cells.select("system", base.alias("benchmark"), which.alias("_w"), value, order).groupBy("system", "benchmark").agg(pick("original"), pick("changed"))
    return t.where("original is not null and changed is not null")


def named(rows: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """rows with a display name from a dimension, the key itself where it has none. How it is joined follows from the sizes."""
    small = names.select(F.col(key).alias("_k"), F.col(name).alias("_n"))
    return rows.join(small, F.col(key) == F.col("_k"), "left").select(*rows.columns, F.coalesce("_n", key).alias(name))


def leaderboard(means: DataFrame, value: str = "mean", lower_is_better: bool = False) -> DataFrame:
    """Systems with a place: those with a value first, best first; the rest by falling coverage."""
    by = F.asc_nulls_last(value) if lower_is_better else F.desc_nulls_last(value)
    return means.withColumn("place", F.row_number().over(Window.orderBy(by, F.desc("coverage"), "system")))


def to_review(sheet: DataFrame, which: str = "unreviewed") -> DataFrame:
    """Rows of an annotation sheet that aren't reviewed yet, or that are flagged with a failure."""
    if which == "unreviewed":
        return sheet.where(F.upper(F.trim(F.coalesce("reviewed", F.lit("")))) != "Y")
    if which == "flagged":
        return sheet.where(~F.trim(F.coalesce("failure", F.lit(""))).isin("", "none"))
    raise ValueError(which)
