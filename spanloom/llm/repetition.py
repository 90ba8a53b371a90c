"""Quality rules from suffix arrays: how much of a document is repeated inside it, and how long its longest repeat is.

A repeat is a substring of at least ``min_length`` code points that begins at two or more places of the same
document. The suffixes that share such a prefix form the longest-common-prefix intervals of the document's suffix
array; the spans of all their maximal repeated substrings are united.

Every document gets a row. Null text: null figures, not kept. Empty text and text shorter than ``min_length``: no
repeat, kept. A very long text is judged whole, with arrays of its own (some 60 bytes a code point). Repeats of equal
length are all covered, so ties need no order. Repeated rows are judged alike; ids aren't looked at, so null and
repeated ids are allowed. Further columns may have any names. No rows: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, roles, shielded, spans, text_bytes

MIN_LENGTH, MAX_FRACTION, MAX_REPEAT = 60, 0.25, 400
#: Code points a work array may hold; a longer document has arrays of its own.
CHUNK = 1_000_000
SCHEMA = "n_chars bigint, repeated_chars bigint, repeated_fraction double, longest_repeat bigint, keep boolean"


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and document offsets in code points."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    if len(codes) == len(data):
        return codes, off
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return codes, heads[off]


def _suspects(codes: np.ndarray, off: np.ndarray, length: int) -> np.ndarray:
    """Documents in which two windows of ``length`` code points hash alike. Others have no repeat; a collision only costs work."""
    n = len(off) - 1
    flags = np.zeros(n, bool)
    if len(codes) < length:
        return flags
    base, inverse = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
    scattered = (codes.astype(U64) + U64(0x1000003)) * U64(0xD6E8FEB86659FD93)
    scattered ^= scattered >> U64(29)
    powers = np.cumprod(np.full(len(codes), base, U64), dtype=U64)
    prefix = np.zeros(len(codes) + 1, U64)
    np.cumsum(scattered * powers, out=prefix[1:], dtype=U64)
    hashes = prefix[length:] - prefix[:-length]
    hashes *= np.cumprod(np.full(len(hashes), inverse, U64), dtype=U64)
    hashes ^= hashes >> U64(31)
    hashes *= U64(0x9E3779B97F4A7C15)
    doc = np.repeat(np.arange(n, dtype=U64), np.diff(off))
    key = (hashes & ~U64(0xFFFF)) | doc[: len(hashes)]
    whole = doc[: len(hashes)] == doc[length - 1 :]
    key = np.sort(key[whole])
    flags[(key[1:][key[1:] == key[:-1]] & U64(0xFFFF)).astype(np.int64)] = True
    return flags


def suffix_repeats(codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of all documents at once by prefix doubling, each document ending in a mark of its own.

    Returns the text positions in suffix order, the common prefix of each with the one before it (0 across documents),
    and the document of each position; positions are those of the marked text, in which document d starts at off[d] + d.
    """
    n_docs, sizes = len(off) - 1, np.diff(off)
    doc = np.repeat(np.arange(n_docs), sizes + 1)
    n = len(codes) + n_docs
    present = np.unique(codes)
    marks = off[1:] + np.arange(n_docs)
    sym = np.zeros(n, np.int64)
    body = np.ones(n, bool)
    body[marks] = False
    sym[body] = np.searchsorted(present, codes) + 1
    bits = max(1, int(len(present)).bit_length())
    first = doc.astype(np.int64) << bits | sym  # equal only within a document
    first[marks] = (doc[marks].astype(np.int64) << bits)
    snapshots: list[tuple[int, np.ndarray]] = [(1, first)]
    order = np.argsort(first, kind="stable")
    sa = order.copy()
    slots = np.arange(n)
    rank = np.zeros(n, np.int64)

    def regroup(key: np.ndarray, slots: np.ndarray, items: np.ndarray) -> np.ndarray:
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(head)
        size = np.diff(np.append(start, len(key)))
        rank[items] = np.repeat(slots[start], size)
        return np.repeat(size > 1, size)

    live = regroup(first[order], slots, order)
    active, slots = order[live], slots[live]
    h = 1
    while len(active):
        snapshots.append((h, rank.astype(np.int32))) if h > 1 else None
        key = rank[active] * n + rank[np.minimum(active + h, n - 1)]
        turn = np.argsort(key, kind="stable")
        active, key = active[turn], key[turn]
        sa[slots] = active
        live = regroup(key, slots, active)
        active, slots = active[live], slots[live]
        h *= 2
    lcp = np.zeros(n, np.int64)
    a, b = sa[:-1], sa[1:]
    pair = np.flatnonzero(doc[a] == doc[b])
    a, b = a[pair].copy(), b[pair].copy()
    depth = np.zeros(len(pair), np.int64)
    for size, ranks in reversed(snapshots):
        same = ranks[np.minimum(a, n - 1)] == ranks[np.minimum(b, n - 1)]
        depth[same] += size
        a[same] += size
        b[same] += size
    lcp[pair + 1] = depth
    return sa, lcp, doc


def _repeat_figures(codes: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Repeated code points and longest repeat of each document."""
    n_docs = len(off) - 1
    sa, lcp, doc = suffix_repeats(codes, off)
    reach = np.maximum(lcp, np.append(lcp[1:], 0))  # the deepest interval that holds the suffix
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, doc[sa], reach)
    far = reach >= length
    start, size = sa[far], reach[far]
    turn = np.argsort(start)
    start, stop = start[turn], (start + size)[turn]
    edge = np.maximum.accumulate(np.concatenate(([0], stop[:-1]))) if len(start) else start
    gain = np.maximum(0, stop - np.maximum(start, edge))
    covered = np.bincount(doc[start], gain, n_docs).astype(np.int64) if len(start) else np.zeros(n_docs, np.int64)
    return covered, np.where(longest >= length, longest, 0)


def repeats(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, repeated code points and longest repeat (0 if under ``length``) of each document in a buffer."""
    n = len(off) - 1
    chars, covered, longest = (np.zeros(n, np.int64) for _ in range(3))
    for lo, hi in spans(off, CHUNK):
        codes, at = code_points(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        chars[lo:hi] = np.diff(at)
        hit = np.flatnonzero(_suspects(codes, at, length))
        if len(hit):
            take = np.concatenate([codes[at[i] : at[i + 1]] for i in hit])
            sub = np.concatenate(([0], np.cumsum(at[hit + 1] - at[hit])))
            covered[lo + hit], longest[lo + hit] = _repeat_figures(take, sub, length)
    return chars, covered, longest


def _judge(text: pa.Array, length: int, most: float, most_repeat: int) -> list[pa.Array]:
    chars, covered, longest = repeats(*text_bytes(text), length)
    share = covered / np.maximum(chars, 1)
    keep = (share <= most) & (longest <= most_repeat)
    null = np.asarray(text.is_null())
    return [pa.array(x, mask=null) for x in (chars, covered, share, longest)] + [pa.array(keep & ~null)]


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, max_fraction: float = MAX_FRACTION, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row for each document: its id, code points, repeated ones, their fraction, the longest repeat and the verdict. Map only, no shuffle."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *_judge(b.column(1), min_length, max_fraction, max_repeat)], names=names)

    names = ["i", *(x.split()[0] for x in SCHEMA.split(", "))]
    source = roles(docs, i=id_col, t=text_col).select("i", F.col("t").cast("string"))
    out = source.mapInArrow(run, f"i {source.schema[0].dataType.simpleString()}, {SCHEMA}")
    return out.toDF(id_col, *out.columns[1:])


def keep_unrepetitive(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, max_fraction: float = MAX_FRACTION, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The rows, all columns as they are, whose text passes both limits."""

    @F.arrow_udf("boolean")
    def passes(text: pa.Array) -> pa.Array:
        return _judge(text, min_length, max_fraction, max_repeat)[-1]

    plain, find = shielded(docs)
    return plain.where(passes(find(text_col).cast("string"))).toDF(*docs.columns)
