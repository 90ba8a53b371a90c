"""Rewriting a corpus through a service: tries with growing waits, remapped spans, and failures that are tried again at the next run."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.udf import arrow_column
from ..schema import SPAN
from ..sources.sinks import append_missing
from .rewrite import map_spans, plain_alignment

#: Seconds to wait after the k-th failed try, times k: where the service limits requests, and else.
LIMITED_WAIT, OTHER_WAIT, TRIES = 10.0, 2.0, 8
_ROW = f"struct<text:string,spans:array<{SPAN}>,meta:struct<orig_len:bigint,new_len:bigint,n_sensitive:bigint,changed:boolean,sdk_error:string>>"


class Service(Protocol):
    def transform(self, text: str) -> tuple[str, int] | None:
        """The new text and the number of sensitive places; None where there is nothing to change."""


def limited(error: str) -> bool:
    """Whether a failure is one of too many requests."""
    return "429" in error or "request limit" in error.lower()


def tried(service: Service, text: str, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> tuple[str, int, str | None]:
    """The new text, the number of sensitive places and no error; or after the last try the text as it was, and the last error."""
    error = None
    for k in range(1, tries + 1):
        try:
            made = service.transform(text)
            return (text, 0, None) if made is None else (made[0], made[1], None)
        except Exception as e:  # whatever a service raises is a failed try
            error = f"{type(e).__name__}: {e}"
            sleep(k * (LIMITED_WAIT if limited(error) else OTHER_WAIT))
    return text, 0, error


def transformed(docs: DataFrame, service: Service, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep, align: Callable = plain_alignment) -> DataFrame:
    """(doc_id, text, gold_spans, meta): each document rewritten and its spans moved along (``align`` for long texts: ``anchored_alignment``). Null text stays null, without spans. Tasks call the service one text at a time: partitions set how many calls are under way."""

    @arrow_column(_ROW, once=True)
    def run(text: pa.Array, gold: pa.Array) -> pa.Array:
        rows = []
        for t, spans in zip(text.to_pylist(), gold.to_pylist()):
            if t is None:
                rows.append({"text": None, "spans": [], "meta": {"orig_len": None, "new_len": None, "n_sensitive": 0, "changed": False, "sdk_error": None}})
                continue
            new, n, error = tried(service, t, tries, sleep)
            rows.append({"text": new, "spans": map_spans(t, new, spans or [], align), "meta": {"orig_len": len(t), "new_len": len(new), "n_sensitive": n, "changed": new != t, "sdk_error": error}})
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("text", pa.string())])
        meta = pa.struct([("orig_len", pa.int64()), ("new_len", pa.int64()), ("n_sensitive", pa.int64()), ("changed", pa.bool_()), ("sdk_error", pa.string())])
        return pa.array(rows, pa.struct([("text", pa.string()), ("spans", pa.list_(span)), ("meta", meta)]))

    made = docs.select("doc_id", run("text", "gold").alias("r"))
    return made.select("doc_id", "r.text", F.col("r.spans").alias("gold_spans"), "r.meta")


def transform_missing(docs: DataFrame, service: Service, path: str, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep, align: Callable = plain_alignment) -> int:
    """Rewrites the documents that the target doesn't have yet and appends those that worked; says how many. Failed ones aren't written, so the next run tries them again."""
    from ..sources.readers import REWRITTEN, _exists

    spark = docs.sparkSession
    if _exists(spark, path):  # before the service is called, not after
        docs = docs.join(spark.read.schema(REWRITTEN).json(path).select("doc_id"), "doc_id", "left_anti")
    rows = transformed(docs, service, tries, sleep, align)
    return append_missing(rows.where("meta.sdk_error is null"), path, ["doc_id"], known_new=True)
