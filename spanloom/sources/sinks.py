"""Writers of runs, summaries, datasets and sheets; resumable ones append only what is missing."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .readers import SHEET, _exists


def write_runs(runs: DataFrame, path: str, include_text: bool = False) -> None:
    """A JSON object for each document: predictions by system, and text and gold only where asked for. Failed attempts are left out."""
    first = [F.first("text").alias("text"), F.first("gold").alias("gold_spans")] if include_text else []
    entry = F.struct("system", F.struct("spans").alias("p"))
    rows = runs.groupBy("doc_id").agg(F.first(F.size("gold")).alias("gold_n"), *first, F.map_from_entries(F.collect_list(F.when(F.col("ok"), entry))).alias("predictions"))
    rows.write.mode("error").json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A JSON array of all rows in order of their first column, as readers of summaries expect it; a summary has a row for each system."""
    rows = summary.groupBy().agg(F.to_json(F.array_sort(F.collect_list(F.struct(*summary.columns)))).alias("value"))
    rows.coalesce(1).write.mode("overwrite").text(path)


def append_missing(rows: DataFrame, path: str, key: Sequence[str], known_new: bool = False) -> int:
    """Appends the rows whose key the target doesn't have yet (all, if they are known to be new), and says how many; failures that aren't written are tried again next time."""
    spark = rows.sparkSession
    new = rows
    if not known_new and _exists(spark, path):
        new = rows.join(spark.read.schema(rows.schema).json(path).select(*key), list(key), "left_anti")
    seen = Observation()
    new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").json(path)
    return seen.get["n"]


def write_cells(cells: DataFrame, path: str, key: Sequence[str] = ("corpus", "benchmark", "system"), force: bool = False) -> int:
    """Writes cells that the target doesn't have yet, or with ``force`` all of them in place of what it has under their keys; says how many."""
    spark = cells.sparkSession
    if not force or not _exists(spark, path):
        return append_missing(cells, path, key)
    # the old cells that stay are read before their files are replaced: written beside them, then put in their place
    rest = spark.read.schema(cells.schema).json(path).join(cells.select(*key), list(key), "left_anti")
    seen, beside = Observation(), f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    cells.observe(seen, F.count(F.lit(1)).alias("n")).unionByName(rest).write.mode("error").json(beside)
    replace_folder(spark, beside, path)
    return seen.get["n"]


def replace_folder(spark: SparkSession, new: str, old: str) -> None:
    """Puts a folder in another's place, by renames; if the second fails the first is undone."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    system = Path(old).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = f"{old.rstrip('/')}.old-{uuid.uuid4().hex}"
    if not system.rename(Path(old), Path(aside)):
        raise OSError(f"can't move {old}")
    if not system.rename(Path(new), Path(old)):
        system.rename(Path(aside), Path(old))
        raise OSError(f"can't move {new} to {old}")
    system.delete(Path(aside), True)


def export_datasets(docs: DataFrame, path: str, expected: DataFrame | None = None) -> DataFrame:
    """Texts and gold by benchmark, without predictions; returns the manifest with counts, bytes and whether each has its expected documents."""
    from ..operators.report import manifest

    docs.select("benchmark", "doc_id", "text", F.col("gold").alias("gold_spans")).write.mode("overwrite").partitionBy("benchmark").json(path)
    made = manifest(docs)
    if expected is None:
        return made.withColumn("complete", F.lit(True))
    wanted = expected.select("benchmark", F.col("n_docs").alias("_wanted"))
    return made.join(wanted, "benchmark", "left").select(*made.columns, (F.col("n_docs") >= F.coalesce("_wanted", F.lit(0))).alias("complete"))


def publish(summaries: DataFrame, samples: DataFrame, path: str, licensed: Sequence[str]) -> None:
    """All summaries, and samples of licensed benchmarks only."""
    write_summary(summaries, f"{path}/summaries")
    samples.where(F.col("benchmark").isin(list(licensed))).write.mode("overwrite").json(f"{path}/samples")


def write_standoff(rows: DataFrame, path: str) -> None:
    """Files <id>.txt and <id>.ann for each row of (id, text, ann), written by the tasks; the folder must not be there yet. A task that runs again writes the same files."""
    from ..shared import put_text

    spark = rows.sparkSession
    if _exists(spark, path):
        raise FileExistsError(path)

    def put(batches):
        for b in batches:
            for name, text, ann in zip(*(b.column(k).to_pylist() for k in range(3))):
                put_text(f"{path}/{name}.txt", text or "")
                put_text(f"{path}/{name}.ann", ann or "")
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    rows.select("id", "text", "ann").mapInArrow(put, "n bigint").collect()


def write_sheet(rows: DataFrame, path: str) -> None:
    """An annotation sheet of fixed columns; those that people fill in stay empty. White space at either end of a cell is kept."""
    have = set(rows.columns)
    rows.select(*[(F.col(c).cast("string") if c in have else F.lit("")).alias(c) for c in SHEET]).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
