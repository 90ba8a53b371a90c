"""Probabilistic suffix tree over UTF-8 bytes: a variable-length language model counted on the whole corpus.

Symbols are bytes, 0xFF for the start and 0xFE for the end of a text (neither occurs in UTF-8). All runs of
``depth`` + 1 symbols are counted over every document; shorter contexts are sums of longer ones. A context stays if it
occurs ``min_count`` times or more and its next-symbol distribution diverges from that of its parent, the context
without its oldest symbol: count x Kullback-Leibler divergence >= ``divergence`` nats. Every suffix of a context that
stays does too. Distributions are smoothed towards the parent's:

    P(x | s) = (n(s, x) + alpha P(x | parent s)) / (n(s) + alpha),    P(x | root) = (n(x) + beta) / (n + 256 beta)

and every symbol is scored in the longest suffix state of what precedes it.

Counting is combined in each task; a level's tables come from the one below, and no join here has more than 258 partners
for a row (one for each symbol before it). A tree of at most ``broadcast_rows`` rows goes to all tasks, which score the
texts as they read them. A larger one is never in one place: texts are cut into chunks of about ``CHUNK`` bytes with their
distinct runs, the runs' probabilities, worked out level by level in joins, go back to the chunks that have them, and
each chunk's texts are scored beside its own runs. Both ways give the same numbers.

Defined cases: null text scores null; empty text scores its end symbol. A very long text is a chunk of its own, worked
through in pieces. Repeated rows count and score as often as they come; ids are only carried, so null and repeated ones
are allowed. There is no order among equals to decide. Further columns may have any names. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, roles, spans, text_bytes, written

DEPTH, MIN_COUNT, DIVERGENCE, ALPHA, BETA = 5, 16, 12.0, 4.0, 0.5
START, END = 0xFF, 0xFE
#: Runs are 64-bit integers: a context of 7 symbols and the next one would need the sign.
MOST_DEPTH = 6
#: Rows of a tree (some 17 bytes each) that the driver may collect and tasks hold.
BROADCAST_ROWS = 4_000_000
CHUNK, PIECE, CACHE = 32_000_000, 2_000_000, 2_000_000


def runs(data: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The run of depth + 1 symbols that ends at each symbol of each text, its end included, as integers; and offsets by text."""
    if not 0 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must be from 0 to {MOST_DEPTH}, not {depth}")
    sizes = np.diff(off)
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    padded = np.full(len(data) + len(sizes) * (depth + 1), START, np.uint8)
    place = np.repeat(np.arange(1, len(sizes) + 1) * depth + np.arange(len(sizes)), sizes)
    padded[np.arange(len(data)) + place] = data
    ends = off[1:] + np.arange(1, len(sizes) + 1) * depth + np.arange(len(sizes))
    padded[ends] = END
    key = np.zeros(len(padded) - depth, np.int64)
    for j in range(depth + 1):
        key <<= 8
        key |= padded[j : len(padded) - depth + j]
    whole = np.ones(len(key), bool)
    for j in range(1, depth + 1):
        cross = ends[:-1] - depth + j
        whole[cross] = False
    return key[whole], at


def run_pieces(data: np.ndarray, off: np.ndarray, depth: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, one past the last, runs, offsets by row) of texts, some million bytes at a time. A longer text comes in several pieces of the same row."""
    for lo, hi in spans(off, PIECE):
        a, b = int(off[lo]), int(off[hi])
        if b - a <= 2 * PIECE:
            yield (lo, hi, *runs(data[a:b], off[lo : hi + 1] - a, depth))
            continue
        for start in range(a, b, PIECE):  # one long text: each piece with the symbols before it
            stop = min(start + PIECE, b)
            before = min(depth, start - a)
            key, _ = runs(data[start - before : stop], np.array([0, stop - start + before]), depth)
            key = key[before:] if stop == b else key[before:-1]
            yield lo, hi, key, np.array([0, len(key)])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    turn = np.argsort(key, kind="stable")
    key, n = key[turn], n[turn]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[head], (np.add.reduceat(n, head) if len(head) else n)


def run_counts(docs: DataFrame, depth: int = DEPTH, text_col: str = "text") -> DataFrame:
    """(g, n): every run of depth + 1 symbols and its count over the corpus."""

    def count(batches):
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for b in batches:
            data, off = text_bytes(b.column(0))
            for _, _, key, _ in run_pieces(data, off, depth):
                parts.append(np.unique(key, return_counts=True))
                held += len(parts[-1][0])
                if held > 6_000_000:
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
                    if held > 4_000_000:  # a task's table stays bounded; the sum follows in the shuffle
                        yield from out(*parts[0])
                        parts, held = [], 0
        if parts:
            yield from out(*_merged(parts))

    def out(key, n):
        for lo in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + 100_000]), pa.array(n[lo : lo + 100_000])], names=["g", "n"])

    texts = roles(docs, t=text_col).select(F.col("t").cast("string")).where("t is not null")
    return texts.mapInArrow(count, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n"))


def chunked(docs: DataFrame, depth: int = DEPTH, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk, i, t, g, n): every row of docs with the number of its chunk, and beside them (i, t null) each chunk's distinct runs g with their counts."""
    source = roles(docs, i=id_col, t=text_col).select("i", F.col("t").cast("string"))
    id_type = source.schema["i"].dataType.simpleString()

    def cut(batches):
        number = TaskContext.get().partitionId() << 32
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = held = 0

        def counted():
            key, n = _merged(parts) if parts else (np.zeros(0, np.int64),) * 2
            for lo in range(0, len(key), 100_000):
                k = min(100_000, len(key) - lo)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, number)), pa.nulls(k, kind), pa.nulls(k, pa.string()), pa.array(key[lo : lo + k]), pa.array(n[lo : lo + k])], names=names)

        for b in batches:
            kind, (data, off) = b.schema.field(0).type, text_bytes(b.column(1))
            for lo, hi in spans(off, max(PIECE, chunk // 4)):
                if size and size + off[hi] - off[lo] > chunk:
                    yield from counted()
                    number, parts, size, held = number + 1, [], 0, 0
                rows = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, number)), rows.column(0), rows.column(1), pa.nulls(hi - lo, pa.int64()), pa.nulls(hi - lo, pa.int64())], names=names)
                size += int(off[hi] - off[lo])
                there = np.asarray(rows.column(1).is_valid())
                for first, last, key, at in run_pieces(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], depth):
                    if not there[first:last].all():
                        key = key[np.repeat(there[first:last], np.diff(at))]
                    parts.append(np.unique(key, return_counts=True))
                    held += len(parts[-1][0])
                    if held > 6_000_000 and len(parts) > 1:
                        parts = [_merged(parts)]
                        held = len(parts[0][0])
        if size or parts:
            yield from counted()

    names = ["chunk", "i", "t", "g", "n"]
    return source.mapInArrow(cut, f"chunk bigint, i {id_type}, t string, g bigint, n bigint")


def _low(column: Column, symbols: int) -> Column:
    return column.bitwiseAND(F.lit((1 << 8 * symbols) - 1).cast("bigint"))


def levels(counts: DataFrame, depth: int = DEPTH) -> dict[int, DataFrame]:
    """For each context length d: (g, n, total), a run of d + 1 symbols, its count, and that of its context, the run without its last symbol."""
    out: dict[int, DataFrame] = {}
    level = counts
    for d in range(depth, -1, -1):
        if d < depth:
            level = out[d + 1].groupBy(_low(F.col("g"), d + 1).alias("g")).agg(F.sum("n").alias("n"))
        context = Window.partitionBy(F.shiftright("g", 8))
        out[d] = written(level.select("g", "n", F.sum("n").over(context).alias("total")), f"runs{d}")
    return out


def grow(level: dict[int, DataFrame], min_count: int = MIN_COUNT, divergence: float = DIVERGENCE) -> dict[int, DataFrame]:
    """The tree's states by length: (c), the contexts of d symbols that stay, for d from 1 on. The root always does."""
    kept: dict[int, DataFrame] = {}
    longer = None
    for d in range(max(level), 0, -1):
        parent = level[d - 1].select(F.col("g").alias("pg"), F.col("n").alias("pn"), F.col("total").alias("pt"))
        child = level[d].where((F.col("total") >= min_count) & (F.col("n") > 0))
        gain = F.sum(F.col("n") * (F.log(F.col("n") / F.col("total")) - F.log(F.col("pn") / F.col("pt"))))
        passed = child.join(parent, _low(F.col("g"), d) == F.col("pg")).groupBy(F.shiftright("g", 8).alias("c")).agg(gain.alias("gain")).where(F.col("gain") >= divergence).select("c")
        if longer is not None:
            passed = passed.union(longer.select(_low(F.col("c"), d).alias("c"))).distinct()
        kept[d] = longer = written(passed, f"states{d}")
    return kept


def tree_rows(level: dict[int, DataFrame], kept: dict[int, DataFrame]) -> DataFrame:
    """(d, g, n): the counts of next symbols (the low byte of g) in each retained context of d symbols (the rest of g)."""
    tree = level[0].select(F.lit(0).alias("d"), "g", "n")
    for d, states in kept.items():
        rows = level[d].withColumn("c", F.shiftright("g", 8)).join(states, "c", "left_semi")
        tree = tree.unionByName(rows.select(F.lit(d).alias("d"), "g", "n"))
    return tree


class Tree:
    """The retained states as sorted arrays by context length, with smoothed log2 probabilities."""

    def __init__(self, d: np.ndarray, g: np.ndarray, n: np.ndarray, depth: int, alpha: float, beta: float):
        self.depth, self.runs, self.logs, self.states, self.back = depth, [], [], [], []
        before = None
        for k in range(depth + 1):
            pick = d == k
            turn = np.argsort(g[pick])
            key, count = g[pick][turn], n[pick][turn].astype(np.float64)
            if k == 0:
                total = count.sum()
                prob = (count + beta) / (total + 256 * beta)
                states, back = np.zeros(1, np.int64), np.array([beta / (total + 256 * beta)])
            else:
                context = key >> 8
                states, first = np.unique(context, return_index=True)
                total = np.add.reduceat(count, first) if len(first) else count
                each = np.repeat(total, np.diff(np.append(first, len(key))))
                at = np.searchsorted(self.runs[-1], key & ((1 << 8 * k) - 1))
                prob = (count + alpha * before[at]) / (each + alpha)
                back = alpha / (total + alpha)
            self.runs.append(key)
            self.logs.append(np.log2(prob))
            self.states.append(states)
            self.back.append(np.log2(back))
            before = prob
        self.known, self.value = np.zeros(0, np.int64), np.zeros(0)

    def _score(self, key: np.ndarray) -> np.ndarray:
        """log2 probability of the last symbol of each (distinct) run."""
        out = np.zeros(len(key))
        todo = np.arange(len(key))
        entered = np.zeros(len(key), bool)
        for k in range(self.depth, -1, -1):
            if not len(todo):
                break
            run = key[todo] & ((1 << 8 * (k + 1)) - 1)
            if k:
                at = np.minimum(np.searchsorted(self.states[k], run >> 8), max(len(self.states[k]) - 1, 0))
                here = (self.states[k][at] == run >> 8) if len(self.states[k]) else np.zeros(len(run), bool)
            else:
                at, here = np.zeros(len(run), np.int64), np.ones(len(run), bool)
            entered[todo[here]] = True  # a state's suffixes are states, so from here on all are
            table = self.runs[k]
            spot = np.minimum(np.searchsorted(table, run), max(len(table) - 1, 0))
            seen = here & (table[spot] == run) if len(table) else np.zeros(len(run), bool)
            out[todo[seen]] += self.logs[k][spot[seen]]
            miss = here & ~seen
            out[todo[miss]] += self.back[k][at[miss]]
            todo = todo[~seen]
        return out

    def score(self, key: np.ndarray) -> np.ndarray:
        """log2 probabilities; runs met before in this task are looked up."""
        distinct, inverse = np.unique(key, return_inverse=True)
        value = np.empty(len(distinct))
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
            old = self.known[at] == distinct
            value[old] = self.value[at[old]]
        else:
            old = np.zeros(len(distinct), bool)
        value[~old] = self._score(distinct[~old])
        if not old.all():
            if len(self.known) > CACHE:
                self.known, self.value = distinct, value
            else:
                known = np.concatenate((self.known, distinct[~old]))
                turn = np.argsort(known, kind="stable")
                self.known, self.value = known[turn], np.concatenate((self.value, value[~old]))[turn]
        return value[inverse]


def _collected(tree: DataFrame):
    got = tree.toArrow()
    return tuple(np.asarray(got[c]).astype(t) for c, t in (("d", np.int8), ("g", np.int64), ("n", np.int64)))


def probabilities(level: dict[int, DataFrame], kept: dict[int, DataFrame], alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """(g, lp): log2 of the smoothed probability of the last symbol of each of the longest runs, in the longest state before it."""
    p = level[0].select("g", ((F.col("n") + beta) / (F.col("total") + 256 * beta)).alias("p"))
    for d in range(1, max(level) + 1):
        state = kept[d].select(F.col("c").alias("sc"))
        above = p.select(F.col("g").alias("pg"), F.col("p").alias("pp"))
        rows = level[d].join(state, F.shiftright("g", 8) == F.col("sc"), "left").join(above, _low(F.col("g"), d) == F.col("pg"))
        own = (F.col("n") + alpha * F.col("pp")) / (F.col("total") + alpha)
        p = rows.select("g", F.when(F.col("sc").isNotNull(), own).otherwise(F.col("pp")).alias("p"))
    return p.select("g", F.log2("p").alias("lp"))


def score_held(docs: DataFrame, tree: DataFrame, depth: int = DEPTH, alpha: float = ALPHA, beta: float = BETA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, n_symbols, log2_prob) of documents, by a tree that all tasks hold. Map only."""
    held = docs.sparkSession.sparkContext.broadcast(_collected(tree))
    source = roles(docs, i=id_col, t=text_col).select("i", F.col("t").cast("string"))

    def run(batches):
        model = Tree(*held.value, depth, alpha, beta)
        for b in batches:
            data, off = text_bytes(b.column(1))
            total = np.zeros(b.num_rows)
            for lo, hi, key, at in run_pieces(data, off, depth):
                total[lo:hi] += np.add.reduceat(model.score(key), at[:-1])
            null = np.asarray(b.column(1).is_null())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off) + 1, mask=null), pa.array(total, mask=null)], names=["i", "n_symbols", "log2_prob"])

    return source.mapInArrow(run, f"i {source.schema['i'].dataType.simpleString()}, n_symbols bigint, log2_prob double")


def score(texts: DataFrame, logs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(i, n_symbols, log2_prob) of the texts of a chunked table, by the logs of its runs."""
    wanted = texts.where("g is not null").select(F.col("chunk").alias("of"), "g").join(logs, "g").select("of", "g", "lp")
    source = texts.where("g is null").select("chunk", "i", "t")
    id_type = source.schema["i"].dataType.simpleString()

    def scored(own: pa.Table, known: pa.Table) -> pa.Table:
        g, lp = np.asarray(known["g"]), np.asarray(known["lp"])
        turn = np.argsort(g)
        g, lp = g[turn], lp[turn]
        column = own["t"].combine_chunks()
        null = np.asarray(column.is_null())
        data, off = text_bytes(column)
        total = np.zeros(own.num_rows)
        for lo, hi, key, at in run_pieces(data, off, depth):
            if null[lo:hi].any():
                keep = np.repeat(~null[lo:hi], np.diff(at))
                value = np.zeros(len(key))
                value[keep] = lp[np.searchsorted(g, key[keep])]
            else:
                distinct, back = np.unique(key, return_inverse=True)
                value = lp[np.searchsorted(g, distinct)][back]
            total[lo:hi] += np.add.reduceat(value, at[:-1])
        return pa.table({"i": own["i"], "n_symbols": pa.array(np.diff(off) + 1, mask=null), "log2_prob": pa.array(total, mask=null)})

    return source.groupBy("chunk").cogroup(wanted.groupBy("of")).applyInArrow(scored, f"i {id_type}, n_symbols bigint, log2_prob double")


def suffix_tree_scores(docs: DataFrame, depth: int = DEPTH, min_count: int = MIN_COUNT, divergence: float = DIVERGENCE, alpha: float = ALPHA, beta: float = BETA, broadcast_rows: int = BROADCAST_ROWS, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text", train: DataFrame | None = None) -> DataFrame:
    """A row for each document: id, n_symbols (its bytes and its end), log2_prob, bits_per_symbol; by the tree of ``train``, or of the documents themselves."""
    if not 0 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must be from 0 to {MOST_DEPTH}, not {depth}")
    counts = run_counts(docs if train is None else train, depth, text_col)
    level = levels(counts, depth)
    kept = grow(level, min_count, divergence)
    tree = written(tree_rows(level, kept), "suffix-tree")
    if tree.count() <= broadcast_rows:
        out = score_held(docs, tree, depth, alpha, beta, id_col, text_col)
        discard(tree)  # it is collected
    else:
        table = written(chunked(docs, depth, chunk, id_col, text_col), "chunks", "zstd")
        if train is not None:
            unseen = table.where("g is not null").select("g", F.lit(0).cast("bigint").alias("n"))
            known, level = level, levels(level[depth].select("g", "n").unionByName(unseen).groupBy("g").agg(F.sum("n").alias("n")), depth)
            discard(*known.values())
        out = score(table, written(probabilities(level, kept, alpha, beta), "run-logs"), depth)
    discard(*level.values(), *kept.values())
    return out.select(F.col("i").alias(id_col), "n_symbols", "log2_prob", (-F.col("log2_prob") / F.col("n_symbols")).alias("bits_per_symbol"))
