"""A store of immutable Parquet shards with size-tiered compaction and a versioned manifest.

Arrivals are appended as small shards. Compaction puts shards into tiers by size, each ``FAN_IN`` times the one below;
where a tier has ``FAN_IN`` shards or more, runs of similarly sized ones are merged, up to the target size a file. A merge is
a task that streams its shards' row groups into a new file: no shuffle, no sort, memory of a row group. Every change
writes its new files first and then commits a manifest of the next version, created atomically and only if that version doesn't exist; a
writer that lost the race fails before anything visible has changed. Readers take the newest manifest, or any version that is kept.

Defined cases: an arrival without rows commits a version without new shards. A store without shards reads as no rows of
its schema. Rows are kept as they come, repeated, null, empty or very long (a row group is merged at a time, so memory
follows the longest rows of one); of all types that Parquet and Arrow share, timestamps with and without zone included.
Shards of equal size are merged in order of path. An arrival whose columns or types differ from the store's is refused.
Any column names are allowed; of those that differ in case alone the later ones have a number in the files.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch_path
from .files import created, listed, opened, replaced

FAN_IN, TARGET_BYTES, SHARD_ROWS = 4, 128 << 20, 2000
FLOOR_BYTES = 1 << 16
GROUP_BYTES = 32 << 20


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int


def _file_names(names: list[str]) -> list[str]:
    """Names for Parquet, which Spark wants to differ in more than case."""
    out: list[str] = []
    for name in names:
        taken, k, own = {n.lower() for n in out}, 2, name
        while own.lower() in taken:
            own, k = f"{name}_{k}", k + 1
        out.append(own)
    return out


class StaleManifest(RuntimeError):
    """Another writer committed this version first."""


def tier(size: int) -> int:
    return max(0, int(math.log(max(size, 1) / FLOOR_BYTES, FAN_IN)) + 1) if size > FLOOR_BYTES else 0


def plan(shards: list[Shard], target: int) -> list[list[Shard]]:
    """Runs to merge: neighbours by size within a tier of FAN_IN shards or more, each run up to the target; a run of fewer than FAN_IN must come to half of it."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if s.bytes < target * 3 // 4:
            tiers.setdefault(tier(s.bytes), []).append(s)
    runs: list[list[Shard]] = []
    for t in sorted(tiers):
        members = sorted(tiers[t], key=lambda s: (s.bytes, s.path))
        if len(members) < FAN_IN:
            continue
        run: list[Shard] = []
        for s in [*members, None]:
            size = sum(x.bytes for x in run)
            if s is None or size + s.bytes > target:
                if len(run) >= FAN_IN or len(run) > 1 and size >= target // 2:
                    runs.append(run)
                run = []
            if s is not None:
                run.append(s)
    return runs


@contextmanager
def _micros(spark: SparkSession) -> Iterator[None]:
    """Timestamps are written as microseconds in UTC: Arrow keeps their zone when it merges, which it can't know of the older 96-bit form."""
    key = "spark.sql.parquet.outputTimestampType"
    before = spark.conf.get(key)
    spark.conf.set(key, "TIMESTAMP_MICROS")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class ShardStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[int]:
        system, path = opened(f"{self.root}/_manifest")
        from pyarrow import fs

        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(int(x.base_name[:-5]) for x in found if x.base_name.endswith(".json") and x.base_name[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """version, schema (None before the first arrival) and shards."""
        known = self.versions()
        version = version if version is not None else (known[-1] if known else 0)
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        system, path = opened(f"{self.root}/_manifest/{version:012d}.json")
        with system.open_input_stream(path) as f:
            held = json.loads(f.read())
        return held | {"shards": [Shard(**s) for s in held["shards"]]}

    def _commit(self, base: dict, schema: str, shards: list[Shard]) -> int:
        version = base["version"] + 1
        content = json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in sorted(shards, key=lambda s: s.path)]})
        if not created(self.spark, f"{self.root}/_manifest/{version:012d}.json", content.encode()):
            raise StaleManifest(f"version {version} exists")
        return version

    def append(self, rows: DataFrame, shard_rows: int = SHARD_ROWS) -> int:
        """One arrival, as shards of at most ``shard_rows`` rows; the new version."""
        base = self.manifest()
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema]).json()
        if base["schema"] is not None and json.loads(base["schema"]) != json.loads(schema):
            raise ValueError("the arrival's columns differ from the store's")
        name = f"data/arrival-{uuid.uuid4().hex}"
        with _micros(self.spark):
            rows.toDF(*_file_names(rows.columns)).write.option("maxRecordsPerFile", shard_rows).option("compression", "zstd").parquet(f"{self.root}/{name}")
        new = self._measured([(f"{name}/{p}", size) for p, size in listed(f"{self.root}/{name}", ".parquet")])
        return self._commit(base, schema, base["shards"] + [s for s in new if s.rows])

    def _measured(self, files: list[tuple[str, int]]) -> list[Shard]:
        if not files:
            return []
        root = self.root

        def run(batches):
            for b in batches:
                for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    system, inside = opened(f"{root}/{path}")
                    with system.open_input_file(inside) as f:
                        yield pa.RecordBatch.from_pydict({"path": [path], "n_rows": [pq.ParquetFile(f).metadata.num_rows], "n_bytes": [size]})

        df = self.spark.createDataFrame(files, "path string, size bigint").repartition(min(len(files), 64))
        return [Shard(r["path"], r["n_rows"], r["n_bytes"]) for r in df.mapInArrow(run, "path string, n_rows bigint, n_bytes bigint").collect()]

    def compact(self, target: int = TARGET_BYTES, keep_versions: int = 2) -> int:
        """Merges until no tier has a run to merge (each round leaves fewer shards, so it ends); the version it ends with. Files of no kept version are deleted."""
        root = self.root

        def merge(batches):
            for b in batches:
                for paths in b.column(0).to_pylist():
                    name = f"data/merged-{uuid.uuid4().hex}.parquet"
                    rows = 0

                    def fill(out):
                        nonlocal rows
                        writer, held, size = None, [], 0
                        for p in paths:
                            system, inside = opened(f"{root}/{p}")
                            with system.open_input_file(inside) as f:
                                for part in pq.ParquetFile(f).iter_batches(2048):
                                    if writer is None:
                                        writer = pq.ParquetWriter(out, part.schema, compression="zstd")
                                    held.append(part)
                                    size += part.nbytes
                                    rows += part.num_rows
                                    if size >= GROUP_BYTES:
                                        writer.write_table(pa.Table.from_batches(held))
                                        held, size = [], 0
                        if held:
                            writer.write_table(pa.Table.from_batches(held))
                        writer.close()

                    replaced(f"{root}/{name}", fill)
                    system, inside = opened(f"{root}/{name}")
                    yield pa.RecordBatch.from_pydict({"old": [paths], "path": [name], "n_rows": [rows], "n_bytes": [system.get_file_info(inside).size]})

        while True:
            base = self.manifest()
            runs = plan(base["shards"], target)
            if not runs:
                return base["version"]
            df = self.spark.createDataFrame([([s.path for s in run],) for run in runs], "paths array<string>").repartition(min(len(runs), 10_000))
            done = df.mapInArrow(merge, "old array<string>, path string, n_rows bigint, n_bytes bigint").collect()
            old = {p for r in done for p in r["old"]}
            before = sum(s.rows for s in base["shards"] if s.path in old)
            if before != sum(r["n_rows"] for r in done):
                raise RuntimeError("a merge lost rows")
            self._commit(base, base["schema"], [s for s in base["shards"] if s.path not in old] + [Shard(r["path"], r["n_rows"], r["n_bytes"]) for r in done])
            self.vacuum(keep_versions)

    def vacuum(self, keep_versions: int) -> None:
        """Deletes manifests but the newest, and the data files that only deleted manifests name. Files of no manifest are left: a writer may be at work on them."""
        known = self.versions()
        kept, gone = known[-keep_versions:], known[:-keep_versions]
        live = {s.path for v in kept for s in self.manifest(v)["shards"]}
        dead = {s.path for v in gone for s in self.manifest(v)["shards"]} - live
        for p in sorted(dead) + [f"_manifest/{v:012d}.json" for v in gone]:
            system, path = opened(f"{self.root}/{p}")
            system.delete_file(path)

    def read(self, version: int | None = None) -> DataFrame:
        held = self.manifest(version)
        if held["schema"] is None:
            raise ValueError("the store is empty and has no schema yet")
        schema = T.StructType.fromJson(json.loads(held["schema"]))
        if not held["shards"]:
            return self.spark.createDataFrame([], schema)
        names = [f.name for f in schema]
        in_files = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(_file_names(names), schema)])
        return self.spark.read.schema(in_files).parquet(*[f"{self.root}/{s.path}" for s in held["shards"]]).toDF(*names)


def _kept(rows: DataFrame, shard_rows: int, target: int) -> ShardStore:
    store = ShardStore(rows.sparkSession, scratch_path(rows.sparkSession, "shards"))
    store.append(rows, shard_rows)
    store.compact(target, keep_versions=1)
    return store


def stored(rows: DataFrame, shard_rows: int = SHARD_ROWS, target: int = TARGET_BYTES) -> DataFrame:
    """The rows through a new store: arrived, compacted and read by its last manifest."""
    return _kept(rows, shard_rows, target).read()


def stored_with_state(rows: DataFrame, shard_rows: int = SHARD_ROWS, target: int = TARGET_BYTES) -> DataFrame:
    """``stored``, and beside each row what holds of its store: the rows that its manifest counts, whether all its shards keep to the target, and whether no tier has a run left to merge."""
    store = _kept(rows, shard_rows, target)
    shards = store.manifest()["shards"]
    largest = max((s.bytes for s in shards if "/merged-" in s.path), default=0)
    return store.read().select("*", F.lit(sum(s.rows for s in shards)).cast("bigint").alias("manifest_rows"), F.lit(largest <= target * 5 // 4).alias("within_target"), F.lit(not plan(shards, target)).alias("settled"))
