"""Readers and writers as queries: the tables are written in a format, by Spark, and read again as any corpus or run of that format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import score
from ..sources import readers, sinks
from ..shared import scratch_path
from . import base
from .base import BASE_SQL, CHANGED_SQL, DOCS_SQL, GOLD_SQL, averaged_sql, scored_sql
from .queries import _TAG, query

_SPANS = 'CAST({id} AS VARCHAR) AS doc_id, CAST(g.idx AS INTEGER) AS idx, g.s AS start, g.e AS "end", g.label, g.text'


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode("gold").alias("idx", "g")).select("doc_id", "idx", "g.*")


@query(f"WITH {DOCS_SQL}, {GOLD_SQL} SELECT {_SPANS.format(id='g.doc_id')} FROM gold g")
def read_jsonl(spark, d):
    path = scratch_path(spark, "jsonl")
    docs = base.corpus(spark, d)
    docs.select(F.col("doc_id").cast("string").alias("id"), "text", F.col("gold").alias("phi_spans"), (F.size("gold") == 0).alias("hard_negative")).write.json(path)
    return _rows(readers.load(spark, "asq_phi", path))


@query(f"WITH {DOCS_SQL}, {GOLD_SQL} SELECT {_SPANS.format(id=chr(39) + 'pii_validation_' + chr(39) + ' || g.doc_id')} FROM gold g JOIN docs d USING (doc_id) WHERE d.language = 'de'")
def read_hub(spark, d):
    """A hub table of all languages, of which the corpus takes one."""
    path = scratch_path(spark, "hub") + ".parquet"
    docs = base.corpus(spark, d)
    docs.select(F.col("doc_id").alias("id"), F.col("text").alias("source_text"), "language", F.transform("gold", lambda g: F.struct(g["text"].alias("value"), *[g[c].alias(c) for c in ("start", "end", "label")])).alias("privacy_mask")).write.parquet(path)
    return _rows(readers.load(spark, "pii_masking_300k_german", path, language="de"))


_PASSAGES = "docs AS (SELECT item_id AS doc_id, text FROM benchmark)"


@query(f"WITH {_PASSAGES}, {GOLD_SQL} SELECT {_SPANS.format(id='g.doc_id')} FROM gold g")
def read_standoff(spark, d):
    """Two files for each passage of ``benchmark``: its text, and a line for each span."""
    path = scratch_path(spark, "standoff")
    gold = F.transform(base.spans_of(base.GOLD)(F.col("text")), lambda s, i: F.concat(F.lit("T"), i + 1, F.lit("\t"), s["label"], F.lit(" "), s["start"], F.lit(" "), s["end"], F.lit("\t"), s["text"]))
    rows = base.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text", F.array_join(gold, "\n").alias("ann"))
    sinks.write_standoff(rows, path)
    return _rows(readers.load(spark, "meddocan", path))


@query(
    f"""WITH tok AS (SELECT conv_id, turn, unnest(range(0, len(t))) AS i, unnest(t) AS tok FROM (SELECT conv_id, turn, string_split_regex(trim(text), '\\s+') AS t FROM conversations)),
tags AS (SELECT *, {_TAG} AS tag, (sum(length(tok) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i) - length(tok) - 1)::BIGINT AS s FROM tok WHERE tok <> ''),
runs AS (SELECT *, max(CASE WHEN tag <> 'I-NAME' THEN i END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS head FROM tags)
SELECT 'mc2_en_test_' || conv_id || '_' || turn AS doc_id, min(s) AS start, max(s + length(tok))::BIGINT AS "end", 'NAME' AS label, string_agg(tok, ' ' ORDER BY i) AS text FROM runs GROUP BY conv_id, turn, head HAVING bool_or(tag = 'B-NAME')"""
)
def read_tagged(spark, d):
    path = scratch_path(spark, "tagged")
    tokens = F.filter(F.split(F.trim(F.col("text"), F.lit(" \t\n\r")), r"\s+"), lambda t: t != "")
    tag = lambda t: F.when(t.rlike("^[A-Z]"), "B-NAME").when(F.length(t) < 4, "I-NAME").otherwise("O")
    lines = F.array_join(F.transform(tokens, lambda t: F.concat(t, F.lit(" _ _ "), tag(t))), "\n")
    rows = base.table(spark, d, "conversations").select(F.concat(F.lit("# id "), F.col("conv_id"), F.lit("_"), F.col("turn"), F.lit("\n"), lines, F.lit("\n")))
    rows.write.text(path)
    docs = readers.load(spark, "multiconer_v2", path)
    return docs.select("doc_id", F.explode("gold").alias("g")).select("doc_id", "g.start", "g.end", "g.label", "g.text")


@query(f"{BASE_SQL}, {CHANGED_SQL} SELECT {_SPANS.format(id='g.doc_id')} FROM gold_t g")
def read_rewritten(spark, d):
    """The changed corpus, written as rewritten documents."""
    path = scratch_path(spark, "rewritten")
    docs = base.changed_texts(spark, d)
    docs.select(F.col("doc_id").cast("string"), F.col("text_t").alias("text"), F.col("gold_t").alias("gold_spans")).write.json(path)
    return _rows(readers.load(spark, "asq_phi_transformed", path))


@query(f"{BASE_SQL}, {scored_sql('type')} {averaged_sql('system')}")
def stored_runs(spark, d):
    """Runs written as a JSON object for each document, read again and scored."""
    path = scratch_path(spark, "runs")
    runs = base.runs(spark, d, keep=("benchmark", "doc_id", "language", "text", "gold"))
    sinks.write_runs(runs.withColumn("doc_id", F.col("doc_id").cast("string")), path, include_text=True)
    back = readers.first_or_last(readers.read_runs(spark, path))
    return score.micro_average(score.document_scores(back, keys=("doc_id", "system")), ("system",), 9)


@query(f"{BASE_SQL}, {scored_sql('type')} SELECT system, 'all' AS benchmark, 'type' AS mode, n_docs, precision, recall, f1, leakage_rate, char_leakage_rate FROM ({averaged_sql('system')})")
def stored_summary(spark, d):
    path = scratch_path(spark, "summary")
    made = score.micro_average(base.run_scores(spark, d), ("system",), 9)
    sinks.write_summary(made.select("system", F.lit("all").alias("benchmark"), F.lit("type").alias("mode"), "n_docs", "precision", "recall", "f1", "leakage_rate", "char_leakage_rate"), path)
    return readers.read_summaries(spark, path).drop("stem")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, source AS benchmark, CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS original, 'a \"quoted\", ' || chr(10) || lang AS surrogate, '' AS notes FROM documents")
def stored_sheet(spark, d):
    """An annotation sheet with quotes, line breaks and empty cells; whole texts are cells of it."""
    path = scratch_path(spark, "sheet")
    rows = base.table(spark, d, "documents")
    sinks.write_sheet(rows.select(F.col("doc_id").alias("id"), F.col("source").alias("benchmark"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("original"), F.concat(F.lit('a "quoted", \n'), F.col("lang")).alias("surrogate")), path)
    return readers.read_sheet(spark, path).select("id", "benchmark", "original", "surrogate", "notes")


@query("SELECT l_returnflag AS system, 'orders' AS corpus, l_linestatus AS benchmark, count(*) AS masked, count(*) FILTER (WHERE l_quantity > 25) AS found, round(100 * (count(*) FILTER (WHERE l_quantity > 25))::DOUBLE / count(*), 1) AS recall_pct FROM lineitem GROUP BY ALL")
def stored_cells(spark, d):
    """Cells written twice: those that are there are left alone, unless all are forced."""
    path = scratch_path(spark, "cells")
    rows = base.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("system"), F.lit("orders").alias("corpus"), F.col("l_linestatus").alias("benchmark")).agg(F.count(F.lit(1)).alias("masked"), F.count_if(F.col("l_quantity") > 25).alias("found"))
    cells = rows.select("*", F.round(100.0 * F.col("found") / F.col("masked"), 1).alias("recall_pct"))
    sinks.write_cells(cells.where("benchmark = 'F'"), path)
    sinks.write_cells(cells.withColumn("found", F.when(F.col("benchmark") == "F", F.lit(-1).cast("bigint")).otherwise(F.col("found"))), path)
    return readers.read_cells(spark, path)


@query("SELECT doc_id, source FROM documents")
def resumed_append(spark, d):
    """A target that has the labelled documents gets the others, each once."""
    path = scratch_path(spark, "append")
    docs, labels = base.table(spark, d, "documents").select("doc_id", "source"), base.table(spark, d, "labels")
    docs.join(labels, "doc_id", "left_semi").write.json(path)
    sinks.append_missing(docs, path, ["doc_id"])
    return spark.read.schema("doc_id bigint, source string").json(path)


@query(f"WITH {DOCS_SQL}, {GOLD_SQL} SELECT d.benchmark, count(*) AS n_docs, sum(coalesce(g.n, 0))::BIGINT AS n_spans, sum(strlen(d.text))::BIGINT AS n_bytes, count(*) >= 60 AS complete FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gold GROUP BY doc_id) g USING (doc_id) GROUP BY d.benchmark")
def exported_datasets(spark, d):
    path = scratch_path(spark, "export")
    docs = base.corpus(spark, d)
    wanted = base.table(spark, d, "documents").select(F.col("source").alias("benchmark")).distinct().withColumn("n_docs", F.lit(60))
    return sinks.export_datasets(docs, path, wanted)
