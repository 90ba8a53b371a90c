"""Helpers shared by the training-data operators: columns by role, UTF-8 buffers, word hashes, the shared folder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import discard, scratch_path, shared_dir, written  # noqa: F401

U64 = np.uint64


def shielded(df: DataFrame) -> tuple[DataFrame, Callable[[str], Column]]:
    """df with its columns renamed by position to c0, c1, ..., and a function from a column's own name to the renamed column.

    Whatever the columns are called (in other letter cases, with dots or backticks, like a column that an operator
    adds, which begins with _), no name of theirs can clash. ``.toDF(*df.columns)`` gives the names back.
    """
    names = df.columns

    def find(name: str) -> Column:
        same = [k for k, c in enumerate(names) if c == name] or [k for k, c in enumerate(names) if c.lower() == name.lower()]
        if len(same) != 1:
            raise ValueError(f"{'no' if not same else 'more than one'} column {name!r} among {names}")
        return F.col(f"c{same[0]}")

    return df.toDF(*[f"c{k}" for k in range(len(names))]), find


def roles(df: DataFrame, **wanted: str) -> DataFrame:
    """The columns named by the values, as the names of the keywords."""
    plain, find = shielded(df)
    return plain.select(*[find(name).alias(role) for role, name in wanted.items()])


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut through a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def text_bytes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets into them, without Python strings; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if lower:
        column = pc.utf8_lower(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def spans(off: np.ndarray, most: int, rows: int = 4096) -> list[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes and ``rows`` rows (a longer document stands alone), so that work arrays stay bounded."""
    out, lo, n = [], 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, n)
        out.append((lo, hi))
        lo = hi
    return out


_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True
#: Odd multiplier and its powers for a polynomial hash modulo 2**64.
_BASE = U64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, _BASE, U64), dtype=U64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit hash over all bits."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (maximal runs of ASCII letters, digits and non-ASCII bytes that don't cross documents): 64-bit hashes, start and end bytes, and n + 1 offsets of documents into them."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _WORD[data]
    begin = inside[1:] & ~inside[:-1]
    end = inside[:-1] & ~inside[1:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    both = edges[inside[edges] & inside[edges + 1]]
    begin[both] = True
    end[both] = True
    start, stop = np.flatnonzero(begin), np.flatnonzero(end)
    if not len(start):
        return np.zeros(0, U64), start, stop, np.zeros(len(off), np.int64)
    at = np.flatnonzero(inside[1:-1])
    length = stop - start
    first = np.cumsum(length) - length
    place = (np.arange(len(at)) - np.repeat(first, length)) & 63
    h = np.add.reduceat((data[at].astype(U64) + U64(1)) * _POWERS[place], first)
    return mix(h + length.astype(U64)), start, stop, np.searchsorted(start, off).astype(np.int64)


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets, 0 for empty ranges."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def unit_hash(seed: int, column: Column) -> Column:
    """A number in [0, 1) from a seed and a column's text form: the first 8 hex digits of an MD5, which any SQL engine can repeat."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(column.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
