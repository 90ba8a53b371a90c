"""Vector best-fit packing of documents into training sequences.

A document's tokens are its runs of non-white characters. One longer than a bin can take (by tokens, or by the square
root of the attention capacity) is split into pieces of that length and a rest, so that nothing is cut away. A bin has three capacities: tokens, documents (pieces) and
attention cost (the sum of squared piece lengths). Pieces come in order of falling length; each goes to the open bin
that fits it under every capacity and has the highest score, or to a new bin:

* ``dot``: the weighted dot product of the piece's needs and the bin's residuals, both as fractions of capacity;
* ``norm``: the least weighted norm of the residuals that would be left.

Bins are local to a group. A document's group comes from a hash of its id, and the number of groups follows the
total of tokens, so the result depends on the rows alone, not on partitions; each group holds ``GROUP_TOKENS`` tokens
on average, so that its last, half-empty bins weigh little.

Defined cases: null text and text without tokens give no piece and don't appear. A very long text is split into as many
pieces as it needs. Null ids are packed like others; repeated rows are pieces of their own. Pieces of equal length come
in order of id and piece; equal scores: the oldest bin. Further columns may have any names. No rows: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import roles, written

TOKENS, DOCUMENTS, GROUP_TOKENS = 2048, 16, 1_000_000
#: Of the largest possible attention cost TOKENS squared. Below 1, so that it binds; at 1 it follows from the tokens.
ATTENTION = 0.5
WEIGHTS = (1.0, 0.25, 0.5)
#: Repetitions of a row (same id, same number of tokens) that stay together.
LOT = 64


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float], rule: str) -> np.ndarray:
    """The bin of each piece. Lengths must fall and each fit an empty bin."""
    cap = np.asarray(capacity, np.float64)
    scale = np.asarray(weights, np.float64)
    bins = np.empty(len(lengths), np.int64)
    left = np.empty((256, 3))
    number = np.empty(256, np.int64)  # of the open bins, in order of age
    open_bins = made = 0
    least = lengths[-1] if len(lengths) else 0
    for i, n in enumerate(lengths.tolist()):
        need = np.array((n, 1.0, float(n) * n))
        room = left[:open_bins]
        fits = (room >= need).all(1).nonzero()[0]
        if len(fits):
            part = room[fits] / cap
            if rule == "dot":
                at = fits[np.argmax(part @ (scale * need / cap))]
            else:
                at = fits[np.argmin(((part - need / cap) ** 2) @ scale)]
        else:
            at = open_bins
            if at == len(left):
                left, number = np.concatenate((left, np.empty_like(left))), np.concatenate((number, np.empty_like(number)))
            left[at], number[at] = cap, made
            open_bins, made = open_bins + 1, made + 1
        left[at] -= need
        bins[i] = number[at]
        if left[at, 0] < least or left[at, 1] < 1 or left[at, 2] < least * least:  # nothing that is still to come fits
            left[at : open_bins - 1], number[at : open_bins - 1] = left[at + 1 : open_bins].copy(), number[at + 1 : open_bins].copy()
            open_bins -= 1
    return bins


def packed(docs: DataFrame, tokens: int = TOKENS, documents: int = DOCUMENTS, attention: float = ATTENTION, weights: tuple[float, float, float] = WEIGHTS, rule: str = "dot", group_tokens: int = GROUP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: pack_group, bin, slot (its place in the bin), id, piece, start_token, n_tokens. Only ids and lengths are shuffled; texts are read once."""
    if rule not in ("dot", "norm"):
        raise ValueError(f"unknown rule {rule!r}")
    capacity = (int(tokens), int(documents), int(tokens * tokens * min(1.0, attention)))
    longest = min(capacity[0], math.isqrt(capacity[2]))
    # tokens are counted once: their sum sets the number of groups before the rows are dealt out
    sized = written(roles(docs, i=id_col, t=text_col).select("i", token_count(F.col("t").cast("string")).cast("bigint").alias("t")), "token-counts").where("t > 0")
    total = sized.agg(F.sum("t")).first()[0] or 0
    groups = max(1, math.ceil(total / group_tokens))
    kind = sized.schema["i"].dataType.simpleString()
    # rows that repeat are counted first and dealt out in small lots, so that no group can hold all of them
    alike = sized.groupBy("i", "t").agg(F.count(F.lit(1)).alias("n"))
    lots = alike.select("i", "t", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / LOT))).alias("k"))
    hashed = F.pmod(F.xxhash64("i", "t", "k"), F.lit(groups)).cast("int")
    pieces = lots.select("i", "t", F.least(F.lit(LOT).cast("bigint"), F.col("n") - F.col("k") * LOT).alias("m"), hashed.alias("g"))

    def pack(table: pa.Table) -> pa.Table:
        copies = np.repeat(np.arange(table.num_rows), np.asarray(table["m"]))
        whole = np.asarray(table["t"]).astype(np.int64)[copies]
        count = -(-whole // longest)
        row = np.repeat(np.arange(len(whole)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(longest, whole[row] - piece * longest)
        ids = table["i"].combine_chunks()
        place = np.asarray(pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense")).astype(np.int64)[copies[row]]
        turn = np.lexsort((row, piece, place, -length))
        bins = best_fit(length[turn], capacity, weights, rule)
        slot = np.zeros(len(turn), np.int64)
        by = np.argsort(bins, kind="stable")
        size = np.bincount(bins)
        slot[by] = np.arange(len(by)) - np.repeat(np.cumsum(size) - size, size)
        group = np.full(len(turn), np.asarray(table["g"])[0], np.int32)
        columns = {"pack_group": group, "bin": bins, "slot": slot, "i": ids.take(pa.array(copies[row[turn]])), "piece": piece[turn], "start_token": piece[turn] * longest, "n_tokens": length[turn]}
        return pa.table({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})

    out = pieces.groupBy("g").applyInArrow(pack, f"pack_group int, bin bigint, slot bigint, i {kind}, piece bigint, start_token bigint, n_tokens bigint")
    return out.toDF(*[id_col if c == "i" else c for c in out.columns])
