"""The training sample of weak labels doesn't hang on ids alone, and keeps its bound."""

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import weak_quality


def test_null_ids_train(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_id", F.lit(None).cast("long"))
    _, scorer = weak_quality.fit(docs, train_docs=50)
    assert any(np.any(np.asarray(v) != 0) for v in vars(scorer).values() if isinstance(v, np.ndarray) and len(v) > 1)


GOOD = (
    "The ferry left the harbour at noon, and the town settled into its long afternoon. Somebody had painted the gate again, number {}. "
    "By evening most of us had gone up to the mill, where a few old men were playing cards, and nobody spoke of what we had seen. "
    "It rained a little; then the sky cleared from the west, as it does in spring, and we walked home along the river with lamp {}."
)
JUNK = "WIN!!! $$$ CLICK #{} NOW | FREE | FREE | @@@ >>> !!! WIN WIN WIN $$$ ### CLICK CLICK | {} |"


def test_null_ids_at_scale(spark):
    """8,000 rows without ids, a fifth of them junk: the sample has both kinds, within its bound, and the junk goes."""
    rows = spark.range(8000).select(F.lit(None).cast("bigint").alias("doc_id"), F.when(F.col("id") % 5 == 0, F.format_string(JUNK.replace("{}", "%d"), "id", "id")).otherwise(F.format_string(GOOD.replace("{}", "%d"), "id", "id")).alias("text"), (F.col("id") % 5 == 0).alias("junk"))
    kept = weak_quality.keep_good(rows).groupBy("junk").count().collect()
    assert {r["junk"]: r["count"] for r in kept} == {False: 6400}


def test_sample_is_bounded(spark):
    """Rows that repeat, here half of all, train once; others are drawn by id and text."""
    rows = spark.range(6000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "the same text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    u = [r["u"] for r in weak_quality.training_sample(rows, 500).collect()]
    assert len(u) == len(set(u)) and 500 <= len(u) <= 800
    small = weak_quality.training_sample(rows.limit(100), 500).count()
    assert small == rows.limit(100).distinct().count()
