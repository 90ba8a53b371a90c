"""Mixing sources to target weights by capped water-filling.

Each source has an available amount (the code points of its documents) and a target weight. A budget is shared in
proportion to the weights; a source whose share exceeds ``max_epochs`` times its amount is clamped there, and the
excess goes to the others in proportion to their weights, until nothing exceeds its cap. With the ratio
cap / weight in ascending order this is one pass of running sums. A source then has ``share / amount`` repetitions:
every document gets the whole part, and one more with the probability of the fraction, decided by a seeded hash of
its id.

Defined cases: null source is a source of its own (the name ""); null or empty text counts 0 code points and is repeated
as the rest of its source; very long text counts all its code points; a source without code points, or with weight 0 or
less, gets 0 repetitions; if all caps together are under the budget, all are clamped. Sources of equal cap / weight are
clamped or free together, so their order doesn't matter. Repeated rows share their id's draw; null ids share one draw.
Further columns may have any names. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import roles, shielded, unit_hash

#: Rows of the allocation up to which it is sent to all executors; beyond it is joined with a shuffle.
BROADCAST_SOURCES = 100_000
MAX_EPOCHS, SEED = 4.0, 17


def _source(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def water_fill(docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, max_epochs: float = MAX_EPOCHS, budget_ratio: float = 1.0, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The allocation: source, n_docs, amount, weight, share (code points granted) and repeats, a row for each source.

    budget_ratio: the budget as a multiple of all code points. The order of ratios makes the one window here global, over
    one row for each source.
    """
    rows = roles(docs, s=source_col, t=text_col)
    sizes = rows.groupBy(_source(F.col("s")).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(F.length(F.col("t").cast("string"))), F.lit(0)).cast("bigint").alias("amount"))
    weight = F.lit(float(default_weight))
    if weights:
        weight = F.coalesce(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])[F.col("source")], weight)
    sizes = sizes.select("*", F.when(F.col("amount") > 0, F.greatest(weight, F.lit(0.0))).otherwise(0.0).alias("weight"))
    ranked = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("amount") * F.lit(float(max_epochs))
    level = (
        sizes.select("*", cap.alias("cap"), F.when(F.col("weight") > 0, cap / F.col("weight")).otherwise(F.lit(float("inf"))).alias("ratio"))
        .select("*", F.coalesce(F.sum("cap").over(ranked), F.lit(0.0)).alias("cap_before"), F.coalesce(F.sum("weight").over(ranked), F.lit(0.0)).alias("weight_before"), F.sum("weight").over(total).alias("all_weight"), (F.sum("amount").over(total) * F.lit(float(budget_ratio))).alias("budget"))
        # the water level if this source and all after it are free
        .select("*", ((F.col("budget") - F.col("cap_before")) / F.nullif(F.col("all_weight") - F.col("weight_before"), F.lit(0.0))).alias("free_level"))
        .select("*", ((F.col("weight") > 0) & (F.col("ratio") > F.col("free_level"))).alias("free"))
        .select("*", F.min(F.when(F.col("free"), F.col("ratio"))).over(total).alias("first_free"))
        .select("*", F.min(F.when(F.col("ratio") == F.col("first_free"), F.col("free_level"))).over(total).alias("level"))
    )
    share = F.when(F.col("weight") <= 0, 0.0).when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("level")))
    return level.select("source", "n_docs", "amount", "weight", share.alias("share")).select("*", F.when(F.col("amount") > 0, F.round(F.col("share") / F.col("amount"), 9)).otherwise(0.0).alias("repeats"))


def _repeats(docs: DataFrame, allocation: DataFrame, source: Column) -> DataFrame:
    """docs with its source's repetitions as a last column _repeats; docs has no column that begins with _."""
    rows = allocation.select("source", "repeats").take(BROADCAST_SOURCES + 1)
    few = len(rows) <= BROADCAST_SOURCES
    small = docs.sparkSession.createDataFrame(rows, "_s string, _repeats double") if few else allocation.select(F.col("source").alias("_s"), F.col("repeats").alias("_repeats"))
    return docs.join(F.broadcast(small) if few else small, _source(source) == F.col("_s")).drop("_s")


def copies(repeats: Column, id_col: Column, seed: int) -> Column:
    whole = F.floor(repeats)
    return (whole + (unit_hash(seed, id_col) < repeats - whole).cast("bigint")).cast("bigint")


def mixture(docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, max_epochs: float = MAX_EPOCHS, budget_ratio: float = 1.0, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each document: id, source, the source's repeats and the document's copies (0 if it isn't drawn)."""
    fill = water_fill(docs, weights, default_weight, max_epochs, budget_ratio, text_col, source_col)
    out = _repeats(roles(docs, i=id_col, s=source_col), fill, F.col("s"))
    return out.select(F.col("i").alias(id_col), _source(F.col("s")).alias("source"), F.col("_repeats").alias("repeats"), copies(F.col("_repeats"), F.col("i"), seed).alias("copies"))


def mixed(docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, max_epochs: float = MAX_EPOCHS, budget_ratio: float = 1.0, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: every row as often as drawn, all columns as they are. No shuffle of documents."""
    plain, find = shielded(docs)
    out = _repeats(plain, water_fill(docs, weights, default_weight, max_epochs, budget_ratio, text_col, source_col), find(source_col))
    n = copies(F.col("_repeats"), find(id_col), seed)
    return out.select(*plain.columns, F.explode(F.array_repeat(F.lit(1), n.cast("int"))).alias("_n")).drop("_n").toDF(*docs.columns)


def sql(weights: Mapping[str, float], default_weight: float = 1.0, max_epochs: float = MAX_EPOCHS, budget_ratio: float = 1.0, seed: int = SEED) -> str:
    """``mixture`` over a table ``documents``, by rounds: sources whose share exceeds the cap are clamped, the rest is shared anew."""
    cases = " ".join(f"WHEN '{k}' THEN {float(v)!r}::DOUBLE" for k, v in weights.items())
    return f"""
WITH RECURSIVE sizes AS (
  SELECT coalesce(source, '') AS source, coalesce(sum(length(text)), 0)::DOUBLE AS amount FROM documents GROUP BY ALL
), weighed AS (
  SELECT source, amount, CASE WHEN amount > 0 THEN greatest(CASE source {cases} ELSE {float(default_weight)!r}::DOUBLE END, 0) ELSE 0 END AS weight, amount * {float(max_epochs)!r} AS cap FROM sizes
), rounds AS (
  SELECT 0 AS i, source, amount, weight, cap, false AS clamped, 0::DOUBLE AS share FROM weighed
  UNION ALL
  SELECT i + 1, source, amount, weight, cap, clamped OR proposal > cap, CASE WHEN clamped OR proposal > cap THEN cap ELSE proposal END
  FROM (
    SELECT *, weight * (sum(amount) OVER () * {float(budget_ratio)!r} - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER (), 0) AS proposal
    FROM rounds WHERE i < (SELECT count(*) + 1 FROM weighed)
  )
), filled AS (
  SELECT source, CASE WHEN amount > 0 AND weight > 0 THEN round(share / amount, 9) ELSE 0 END AS repeats FROM rounds WHERE i = (SELECT max(i) FROM rounds)
)
SELECT d.doc_id, f.source, f.repeats,
  CAST(floor(f.repeats) + CASE WHEN CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < f.repeats - floor(f.repeats) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM documents d JOIN filled f ON f.source = coalesce(d.source, '')
"""
