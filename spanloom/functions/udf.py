"""Arrow functions as column functions that are made when they are called: a module can be imported without a session."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows and bytes that a function works on at once: what it holds in Python objects doesn't grow with Spark's batches.
ROWS, BYTES = 512, 2 << 20


def slices(arrays: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """The arrays in ranges of at most ``ROWS`` rows and ``BYTES`` bytes (a larger row stands alone)."""
    n = len(arrays[0])
    if n <= 1 or (n <= ROWS and sum(a.nbytes for a in arrays) <= BYTES):
        yield arrays
        return
    half = n // 2
    yield from slices(tuple(a.slice(0, half) for a in arrays))
    yield from slices(tuple(a.slice(half) for a in arrays))


def arrow_column(kind: str, once: bool = False) -> Callable[[Callable], Callable[..., Column]]:
    """once: the function mustn't run twice on a row, as it would if a filter on what it gives were moved below it. The function itself, on arrays, is ``arrow`` of what is returned: functions of several steps are made of these, so that a task has one Python worker for all."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def run(*arrays: pa.Array) -> pa.Array:
            return pa.concat_arrays([f(*part) for part in slices(arrays)])

        def made(*columns: Column | str) -> Column:
            udf = F.arrow_udf(run, kind)
            return (udf.asNondeterministic() if once else udf)(*columns)

        made.__doc__, made.__name__, made.arrow = f.__doc__, f.__name__, f
        return made

    return wrap
