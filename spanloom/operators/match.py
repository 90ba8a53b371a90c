"""Matching of labelled and predicted spans within a document.

Run rows have a document's key, ``system``, ``gold`` and ``spans`` (arrays in order), one row for each document and system.
Both sides are in the row, so matching needs no shuffle and no join. The exact modes are equivalences on a key: greedy
one-to-one matching is counting by key. The overlap modes take sorted starts and running maxima of ends, so a long
document costs n log n rather than the product of its spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.udf import arrow_column

#: strict: bounds and label; type: bounds alone; relaxed: any overlap, one to one, first come.
MODES = ("strict", "type", "relaxed")


def overlaps(a: Column, b: Column) -> Column:
    """Whether two span structs overlap; a zero-length span strictly inside another does."""
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def span_bounds(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    flat = lists.flatten()
    return np.concatenate(([0], np.cumsum(n))), np.asarray(flat.field("start")), np.asarray(flat.field("end"))


def any_overlap(gs: np.ndarray, ge: np.ndarray, ps: np.ndarray, pe: np.ndarray) -> np.ndarray:
    """For each first span, whether some second one overlaps it: of those that begin before its end, the furthest end lies past its start."""
    if not len(ps):
        return np.zeros(len(gs), bool)
    order = np.argsort(ps, kind="stable")
    reach = np.maximum.accumulate(pe[order])
    at = np.searchsorted(ps[order], ge, side="left")
    return (at > 0) & (reach[np.maximum(at - 1, 0)] > gs)


def greedy_overlap(gs: np.ndarray, ge: np.ndarray, ps: np.ndarray, pe: np.ndarray) -> np.ndarray:
    """For each first span in order, whether a second one, the first in order that overlaps and isn't taken, is left for it."""
    out = np.zeros(len(gs), bool)
    if not len(ps):
        return out
    if (np.diff(ps) >= 0).all():  # in order of start: candidates are a range
        high = np.searchsorted(ps, ge, side="left")
        low = np.searchsorted(np.maximum.accumulate(pe), gs, side="right")
    else:
        low, high = np.zeros(len(gs), np.int64), np.full(len(gs), len(ps))
    # plain numbers: the candidates of a span are few, so calls on slices would cost more than they do
    left, taken, starts, ends = low.tolist(), bytearray(len(ps)), ps.tolist(), pe.tolist()
    found = []
    for k, (a, b, s, e) in enumerate(zip(left, high.tolist(), gs.tolist(), ge.tolist())):
        for j in range(a, b):
            if not taken[j] and starts[j] < e and ends[j] > s:
                taken[j] = 1
                found.append(k)
                break
    out[found] = True
    return out


def on_one_axis(go: np.ndarray, po: np.ndarray, *sides: np.ndarray) -> list[np.ndarray]:
    """The bounds gs, ge, ps, pe of many documents on one axis, each document's beyond all of those before it."""
    gs, ge, ps, pe = sides
    least, most = min((x.min(initial=0) for x in sides)), max((x.max(initial=0) for x in sides))
    width = int(most - least) + 2
    row_g, row_p = np.repeat(np.arange(len(go) - 1), np.diff(go)), np.repeat(np.arange(len(po) - 1), np.diff(po))
    return [gs + row_g * width, ge + row_g * width, ps + row_p * width, pe + row_p * width]


def _lists(off: np.ndarray, flags: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flags))


@arrow_column("array<boolean>")
def overlap_flags(gold: pa.Array, spans: pa.Array) -> pa.Array:
    """Column: for each span of the first array, whether some span of the second overlaps it. All documents of a batch at once."""
    (go, gs, ge), (po, ps, pe) = span_bounds(gold), span_bounds(spans)
    return _lists(go, any_overlap(*on_one_axis(go, po, gs, ge, ps, pe)))


@arrow_column("array<boolean>")
def equal_flags(gold: pa.Array, spans: pa.Array) -> pa.Array:
    """Column: for each span of the first array, whether some span of the second has the same bounds."""
    (go, gs, ge), (po, ps, pe) = span_bounds(gold), span_bounds(spans)
    gs, ge, ps, pe = on_one_axis(go, po, gs, ge, ps, pe)
    start, end = np.concatenate((gs, ps)), np.concatenate((ge, pe))
    order = np.lexsort((end, start))
    head = np.ones(len(order), bool)
    head[1:] = (np.diff(start[order]) != 0) | (np.diff(end[order]) != 0)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(head) - 1
    there = np.zeros(len(order) + 1, bool)
    there[group[len(gs) :]] = True
    return _lists(go, there[group[: len(gs)]])


@arrow_column("array<boolean>")
def greedy_flags(gold: pa.Array, spans: pa.Array) -> pa.Array:
    """Column: for each span of the first array in order, whether a span of the second is left for it, one to one."""
    (go, gs, ge), (po, ps, pe) = span_bounds(gold), span_bounds(spans)
    return _lists(go, _greedy(go, gs, ge, po, ps, pe))


def _greedy(go: np.ndarray, gs: np.ndarray, ge: np.ndarray, po: np.ndarray, ps: np.ndarray, pe: np.ndarray) -> np.ndarray:
    """``greedy_overlap`` of many documents: in order of start they are one on a common axis, otherwise one after the other."""
    one_axis = on_one_axis(go, po, gs, ge, ps, pe)
    if (np.diff(one_axis[2]) >= 0).all():
        return greedy_overlap(*one_axis)
    out = np.zeros(len(gs), bool)
    for k in np.flatnonzero(np.diff(go) * np.diff(po)):
        g, p = slice(go[k], go[k + 1]), slice(po[k], po[k + 1])
        out[g] = greedy_overlap(gs[g], ge[g], ps[p], pe[p])
    return out


def _counters(mode: str):
    kind = "struct<tp:bigint,fp:bigint,fn:bigint,gold_chars_leaked:bigint,gold_chars_total:bigint>"

    @arrow_column(kind)
    def run(gold: pa.Array, spans: pa.Array) -> pa.Array:
        go, gs, ge = span_bounds(gold)
        po, ps, pe = span_bounds(spans)
        n, row_g, row_p = len(gold), np.repeat(np.arange(len(gold)), np.diff(go)), np.repeat(np.arange(len(gold)), np.diff(po))
        size = ge - gs
        if mode == "relaxed":
            hit = _greedy(go, gs, ge, po, ps, pe)
            tp, leaked = np.bincount(row_g, hit, n), np.bincount(row_g, np.where(hit, 0, size), n)
        else:
            keys = [np.concatenate(x) for x in ((ge, pe), (gs, ps), (row_g, row_p))]
            if mode == "strict":
                labels = pa.concat_arrays([gold.flatten().field("label"), spans.flatten().field("label")])
                keys.insert(0, np.asarray(pc.fill_null(labels.dictionary_encode("encode").indices, -1)))
            order = np.lexsort(keys)
            keys = [k[order] for k in keys]
            head = np.ones(len(order), bool)
            head[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            at = np.flatnonzero(head)
            mine = (order < len(gs)).astype(np.int64)
            g, p = (np.add.reduceat(x, at) if len(at) else x for x in (mine, 1 - mine))
            met, row = np.minimum(g, p), keys[-1][at]
            tp, leaked = np.bincount(row, met, n), np.bincount(row, (g - met) * (keys[-3][at] - keys[-2][at]), n)
        columns = (tp, np.diff(po) - tp, np.diff(go) - tp, leaked, np.bincount(row_g, size, n))
        return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["tp", "fp", "fn", "gold_chars_leaked", "gold_chars_total"])

    return run


#: Columns gold, spans to a struct of the counters, by mode.
COUNTED = {mode: _counters(mode) for mode in MODES}


@arrow_column("array<struct<label:string,tp:bigint,fp:bigint,fn:bigint>>")
def counted_by_label(gold: pa.Array, spans: pa.Array) -> pa.Array:
    """Column: the strict counters of each label that a document's labelled or predicted spans have; those without a label are left out."""
    (go, gs, ge), (po, ps, pe) = span_bounds(gold), span_bounds(spans)
    names = pa.concat_arrays([gold.flatten().field("label"), spans.flatten().field("label")]).dictionary_encode()
    code = np.asarray(pc.fill_null(names.indices, -1)).astype(np.int64)
    row = np.concatenate((np.repeat(np.arange(len(gold)), np.diff(go)), np.repeat(np.arange(len(gold)), np.diff(po))))
    keys = [row, code, np.concatenate((gs, ps)), np.concatenate((ge, pe))]
    order = np.flatnonzero(code >= 0)
    order = order[np.lexsort([k[order] for k in reversed(keys)])]
    keys = [k[order] for k in keys]
    heads = lambda ks: np.flatnonzero(np.concatenate((np.ones(min(1, len(ks[0])), bool), np.any([k[1:] != k[:-1] for k in ks], axis=0))))
    mine, at = (order < len(gs)).astype(np.int64), heads(keys)
    g, p = (np.add.reduceat(x, at) if len(at) else x for x in (mine, 1 - mine))
    tp, row, code = np.minimum(g, p), keys[0][at], keys[1][at]
    at = heads([row, code])
    total = [np.add.reduceat(x, at) if len(at) else x for x in (tp, p - tp, g - tp)]
    off = np.concatenate(([0], np.cumsum(np.bincount(row[at], minlength=len(gold)))))
    labels = names.dictionary.take(pa.array(code[at]))
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.StructArray.from_arrays([labels, *map(pa.array, total)], ["label", "tp", "fp", "fn"]))


def pooled(runs: DataFrame, keys: list[str], by_label: bool) -> DataFrame:
    """(keys, start, end[, label], g, p): how often each span is labelled and predicted, where a document's spans may lie in several rows or a breakdown needs the spans themselves: one shuffle, no join. Failed attempts are left out; a run without spans keeps one row of nulls, so that it counts."""
    side = lambda name, g, p: F.transform(F.coalesce(F.col(name), F.array().cast(f"{_array_of(runs, name)}")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), F.lit(g).alias("g"), F.lit(p).alias("p")))
    rows = runs.where("ok").select(*keys, F.explode_outer(F.concat(side("gold", 1, 0), side("spans", 0, 1))).alias("s"))
    label = ["label"] if by_label else []
    return rows.select(*keys, "s.start", "s.end", *[F.col(f"s.{c}") for c in label], F.coalesce("s.g", F.lit(0)).alias("g"), F.coalesce("s.p", F.lit(0)).alias("p")).groupBy(*keys, "start", "end", *label).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))


def _array_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def unmatched(runs: DataFrame, keys: list[str], which: str) -> DataFrame:
    """Predicted spans without an equal labelled one (which = "spans"), or labelled ones without a prediction ("gold"), by bounds as sets: duplicates all count as met. Within the row: no shuffle."""
    other = "gold" if which == "spans" else "spans"
    flagged = runs.where("ok").select(*keys, which, equal_flags(F.col(which), F.col(other)).alias("_met"))
    each = flagged.select(*keys, F.explode(F.arrays_zip(which, "_met")).alias("z")).where("not z._met")
    return each.select(*keys, f"z.{which}.*")


def found_spans(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, start, end, label, text, found): every labelled span of every successful run, and whether any prediction overlaps it."""
    flagged = runs.where("ok").select(*keys, "gold", overlap_flags(F.col("gold"), F.col("spans")).alias("found"))
    each = flagged.select(*keys, F.posexplode(F.arrays_zip("gold", "found")).alias("idx", "z"))
    return each.select(*keys, "idx", *[F.col(f"z.gold.{c}").alias(c) for c in ("start", "end", "label", "text")], F.col("z.found").alias("found"))


def from_relations(attempt: DataFrame, gold: DataFrame, pred: DataFrame, keys: tuple[str, ...] = ("benchmark", "doc_id")) -> DataFrame:
    """Run rows from the normalised relations: attempts (keys, system, ok), labelled spans (keys, idx, start, end, label, text) and predictions (with system). An attempt without spans keeps its row; spans without an attempt are left out."""
    span = F.struct("start", "end", "label", "text")
    listed = lambda df, by, name: df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", span.alias("s")))), lambda x: x["s"]).alias(name))
    rows = attempt.join(listed(gold, keys, "gold"), list(keys), "left").join(listed(pred, (*keys, "system"), "spans"), [*keys, "system"], "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(_array_of(rows, c)))
    return rows.select(*keys, "system", "ok", empty("gold").alias("gold"), empty("spans").alias("spans"))
