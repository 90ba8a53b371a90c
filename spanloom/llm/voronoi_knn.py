"""Exact k nearest neighbours of query vectors among all vectors, by a Voronoi join.

Pivots, about twice the square root of the number of vectors, chosen far apart from a bounded sample, cut the space
into Voronoi cells. Summaries of each cell (the
largest and smallest distance of its queries and of its vectors to the pivot, the k + 1 smallest of the vectors) bound
the k-th neighbour's distance of all its queries from above; distances to pivots and the hyperplanes between them bound
a vector's distance to a cell's queries from below. Cells are put into groups by queries, and a vector goes only to the
groups that hold a cell it can't be ruled out of. A group's work is cut into rectangles: its queries into slices of
``group_rows``, and its vectors into blocks of ``block_rows`` by how many the summaries leave to it, so that no task
holds more, whatever a cell holds; a query meets every block of its group, a vector every slice. Matrix products choose
candidates with a margin for rounding, their distances are computed exactly, and the blocks' best are merged.

Where the bounds rule out most vectors, what is shuffled follows the number of vectors. Where they rule out none (vectors
spread evenly over many dimensions), the work is that of all queries with all vectors: V vectors are sent Q / group_rows
times, and Q queries V / block_rows times.

Distances are Euclidean, in double precision. Equal distances are in order of id.

Defined cases: null or empty vectors, those with a null, NaN or infinite component and those of another length than
most have no neighbours and are nobody's neighbour. With k or fewer others, all are returned. Repeated rows are neighbours
of each other at distance 0; a row is never its own neighbour. Null ids are allowed and sort first. However many vectors
are equal, a block keeps the k + 1 first of them. Further columns may have any names. No rows, or no queries: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import roles, shielded, written

K, GROUP_ROWS, BLOCK_ROWS, SEED = 10, 20_000, 50_000, 5
#: Pivots grow with the square root of the vectors up to this: all tasks hold their mutual distances (8 MB). Each is chosen among so many rows of the sample.
MOST_PIVOTS, SAMPLE = 1024, 16
#: Pairs whose exact distances are computed at once.
PAIRS = 200_000


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact-as-doubles distances of every row of a to every row of b, row by row of b: no cancellation."""
    out = np.empty((len(a), len(b)))
    for j in range(len(b)):
        d = a - b[j]
        out[:, j] = np.sqrt((d * d).sum(1))
    return out


class Pivots:
    """Cells of vectors. Squared distances come from matrix products and are off by ``slack`` at most."""

    def __init__(self, centre: np.ndarray):
        self.centre, self.norms = centre, (centre * centre).sum(1)

    def squares(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = (v * v).sum(1)
        return np.maximum(own[:, None] + self.norms[None] - 2 * (v @ self.centre.T), 0), 1e-12 * (own + self.norms.max(initial=0.0)) * (4 + v.shape[1])

    def cells(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each vector and the exact distance to it."""
        cell = np.concatenate([self.squares(v[lo : lo + 4096])[0].argmin(1) for lo in range(0, len(v), 4096)]) if len(v) else np.zeros(0, np.int64)
        d = v - self.centre[cell]
        return cell, np.sqrt((d * d).sum(1))


def spread_out(sample: np.ndarray, number: int, seed: int) -> np.ndarray:
    """``number`` distinct rows of a sample, or all it has: each next one is drawn by the squares of the distances to those before it, so groups that lie apart all get some."""
    sample = np.unique(sample, axis=0)
    if len(sample) <= number:
        return sample
    rng = np.random.default_rng(seed)
    picked = [int(rng.integers(len(sample)))]
    gap = np.full(len(sample), np.inf)
    while len(picked) < number:
        d = sample - sample[picked[-1]]
        gap = np.minimum(gap, (d * d).sum(1))
        reach = np.cumsum(gap)
        picked.append(min(int(np.searchsorted(reach, rng.random() * reach[-1], side="right")), len(sample) - 1))
    return sample[np.unique(picked)]


def bounds(queries: np.ndarray, upper: np.ndarray, near: np.ndarray, owner: np.ndarray, between: np.ndarray, k: int) -> np.ndarray:
    """For each cell with queries, a distance within which all of them have k neighbours besides themselves. near: the k + 1 smallest distances of vectors to their pivots, owner."""
    out = np.full(len(queries), np.inf)
    for i in np.flatnonzero(queries):
        reach = upper[i] + between[i, owner] + near
        if len(reach) > k:
            out[i] = np.partition(reach, k)[k]
    return out


def grouped(queries: np.ndarray, between: np.ndarray, most: int) -> np.ndarray:
    """The group of each cell that has queries, -1 for others: a greedy chain of nearest pivots, cut where ``most`` queries would be exceeded."""
    group = np.full(len(queries), -1, np.int64)
    left = queries > 0
    if not left.any():
        return group
    at, number, size = int(np.flatnonzero(left)[0]), 0, 0
    while True:
        if size and size + queries[at] > most:
            number, size = number + 1, 0
        group[at] = number
        size += queries[at]
        left[at] = False
        if not left.any():
            return group
        at = int(np.where(left, between[at], np.inf).argmin())


def first_of_equals(order: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """``order`` without the rows that have ``most`` equal vectors before them in it."""
    plain = np.ascontiguousarray(v[order] + 0.0)
    raw = plain.view(np.dtype((np.void, plain.dtype.itemsize * plain.shape[1]))).ravel()
    _, inverse = np.unique(raw, return_inverse=True)
    turn = np.argsort(inverse, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[turn] = np.arange(len(order)) - np.searchsorted(inverse[turn], inverse[turn], side="left")
    return order[rank < most]


def local_neighbours(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, distance) of each query's k nearest candidates that aren't itself, by distance and order of c."""
    out: list[tuple[np.ndarray, ...]] = []
    norms = (c * c).sum(1)
    step = max(1, min(1024, 8_000_000 // max(len(c), 1)))
    for lo in range(0, len(q), step):
        part = q[lo : lo + step]
        own = (part * part).sum(1)
        d2 = own[:, None] + norms[None] - 2 * (part @ c.T)
        d2[q_ids[lo : lo + step][:, None] == c_ids[None]] = np.inf
        most = min(k, d2.shape[1]) - 1
        limit = np.partition(d2, most, axis=1)[:, most]
        slack = 1e-12 * (own + norms.max(initial=0.0)) * (4 + q.shape[1])
        hit = (d2 <= (limit + 2 * slack)[:, None]) & np.isfinite(d2)
        done = np.concatenate(([0], np.cumsum(hit.sum(1))))
        a = 0
        while a < len(part):
            b = max(a + 1, int(np.searchsorted(done, done[a] + PAIRS, side="right")) - 1)
            i, j = np.nonzero(hit[a:b])
            i += a
            diff = part[i] - c[j]
            d = np.sqrt((diff * diff).sum(1))
            turn = np.lexsort((j, d, i))
            i, j, d = i[turn], j[turn], d[turn]
            rank = np.arange(len(i)) - np.searchsorted(i, i, side="left")
            best = rank < k
            out.append((i[best] + lo, j[best], d[best]))
            a = b
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


class Router:
    """What the driver knows of the cells, and which rectangles a row goes to."""

    def __init__(self, pivots: Pivots, queries: np.ndarray, q_upper: np.ndarray, q_lower: np.ndarray, rows: np.ndarray, r_upper: np.ndarray, near: np.ndarray, owner: np.ndarray, k: int, group_rows: int, block_rows: int):
        between = _distances(pivots.centre, pivots.centre)
        self.pivots, self.between, self.queries = pivots, between, queries
        self.upper, self.lower = q_upper * (1 + 1e-9), q_lower * (1 - 1e-9)
        self.limit = bounds(queries, self.upper, near, owner, between, k) * (1 + 1e-9)
        self.group = grouped(queries, between, group_rows)
        number = int(self.group.max(initial=-1)) + 1
        self.slices, self.blocks = np.ones(number, np.int64), np.ones(number, np.int64)
        for g in range(number):
            cells = np.flatnonzero(self.group == g)
            self.slices[g] = max(1, -(-int(queries[cells].sum()) // group_rows))
            # vectors that the summaries leave to the group: of cells none of whose vectors could be ruled out by distances alone
            near_enough = (between[:, cells] - r_upper[:, None] - self.upper[cells][None] <= self.limit[cells][None]).any(1)
            self.blocks[g] = max(1, -(-int(rows[near_enough].sum()) // block_rows))

    def groups_of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, group) for every group in which a vector can be some query's neighbour."""
        d2, slack = self.pivots.squares(v)
        cell = d2.argmin(1)
        own = d2[np.arange(len(v)), cell]
        high, low = np.sqrt(d2 + slack[:, None]), np.sqrt(np.maximum(d2 - slack[:, None], 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d2 - own[:, None] - 4 * slack[:, None]) / (2 * self.between[cell])
        plane[~np.isfinite(plane)] = 0
        least = np.maximum(np.maximum(low - self.upper, self.lower - high), plane)
        meets = (least * (1 - 1e-9) <= self.limit) & (self.queries > 0)
        wanted = np.zeros((len(v), len(self.slices)), bool)
        i, c = np.nonzero(meets)
        wanted[i, self.group[c]] = True
        return np.nonzero(wanted)

    def places(self, r: np.ndarray, v: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, group, slice, block, role): role 1 of a vector among those that are searched, 0 of a query."""
        i, g = self.groups_of(v)
        times = self.slices[g]
        row1, g1 = np.repeat(i, times), np.repeat(g, times)
        slice1 = np.arange(len(row1)) - np.repeat(np.cumsum(times) - times, times)
        q = np.flatnonzero(asks)
        own = self.group[self.pivots.squares(v[q])[0].argmin(1)] if len(q) else q
        times = self.blocks[own]
        row0, g0 = np.repeat(q, times), np.repeat(own, times)
        block0 = np.arange(len(row0)) - np.repeat(np.cumsum(times) - times, times)
        mixed = (r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        pick = lambda a, b: np.concatenate((a, b))
        return pick(row1, row0), pick(g1, g0), pick(slice1, mixed[row0] % self.slices[g0]), pick(mixed[row1] % self.blocks[g1], block0), pick(np.ones(len(row1), np.int8), np.zeros(len(row0), np.int8))


def routed(vectors: DataFrame, k: int, pivots: int | None, group_rows: int, block_rows: int, seed: int, id_col: str, vector_col: str, queries: Column | None) -> DataFrame | None:
    """(g, s, b, role, r, i, v): every vector and query as often as a rectangle (group, slice, block) needs it; None without any fine vector."""
    spark = vectors.sparkSession
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    # the condition speaks of the table's own columns: it is worked out before those are renamed
    plain = vectors.select("*", asks).toDF(*[f"c{n}" for n in range(len(vectors.columns))], "q")
    _, find = shielded(vectors)
    # single precision is carried as it is, and widened where distances are computed
    item = "float" if plain.select(find(vector_col)).schema[0].dataType.simpleString() == "array<float>" else "double"
    fine = plain.select("q", find(id_col).alias("i"), find(vector_col).cast(f"array<{item}>").alias("v"))
    fine = fine.where(F.coalesce(F.size("v") > 0, F.lit(False)) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    lengths = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return None
    # rows may share an id, or have none: a number of their own tells them apart
    rows = written(fine.where(F.size("v") == lengths["d"]).select(F.monotonically_increasing_id().alias("r"), "q", "i", "v"), "vectors")
    number = pivots or min(MOST_PIVOTS, max(1, 2 * math.isqrt(lengths["count"])))
    chosen = rows.orderBy(F.xxhash64(F.lit(seed), "v"), "r").limit(SAMPLE * number).select("v").toArrow()
    cells = Pivots(spread_out(_matrix(chosen["v"].combine_chunks()), number, seed))
    held = spark.sparkContext.broadcast(cells)  # at most ``number`` vectors

    def assign(batches):
        for b in batches:
            cell, d = held.value.cells(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), pa.array(d)], names=["q", "cell", "d"])

    placed = rows.select("q", "v").mapInArrow(assign, "q boolean, cell int, d double")
    own = F.when(F.col("q"), F.col("d"))
    summary = written(placed, "cells")
    table = summary.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("u"), F.count_if("q").alias("qn"), F.max(own).alias("qu"), F.min(own).alias("ql")).toArrow()
    by = Window.partitionBy("cell").orderBy("d")  # each task sends its k + 1 least of a cell: the rank limit goes below the shuffle
    small = summary.withColumn("p", F.row_number().over(by)).where(F.col("p") <= k + 1).select("cell", "d").toArrow()
    at, size = np.asarray(table["cell"]), len(cells.centre)

    def column(name: str) -> np.ndarray:
        out = np.zeros(size)
        out[at] = np.asarray(pc.fill_null(table[name].cast(pa.float64()), 0.0))
        return out

    router = spark.sparkContext.broadcast(Router(cells, column("qn").astype(np.int64), column("qu"), column("ql"), column("n").astype(np.int64), column("u"), np.asarray(small["d"]), np.asarray(small["cell"]), k, group_rows, block_rows))
    kind = rows.schema["i"].dataType.simpleString()

    def route(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                take, g, s, block, role = router.value.places(np.asarray(part.column(0)), _matrix(part.column(3)), np.asarray(part.column(1)).astype(bool))
                for a in range(0, len(take), 20_000):
                    cut = slice(a, a + 20_000)
                    pick = pa.array(take[cut])
                    yield pa.RecordBatch.from_arrays([*[pa.array(x[cut].astype(np.int32)) for x in (g, s, block)], pa.array(role[cut]), *[part.column(n).take(pick) for n in (0, 2, 3)]], names=["g", "s", "b", "role", "r", "i", "v"])

    return rows.select("r", "q", "i", "v").mapInArrow(route, f"g int, s int, b int, role tinyint, r bigint, i {kind}, v array<{item}>")


def neighbours(vectors: DataFrame, k: int = K, pivots: int | None = None, group_rows: int = GROUP_ROWS, block_rows: int = BLOCK_ROWS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding", queries: Column | None = None) -> DataFrame:
    """query_id, neighbor_id, rank (from 1), distance: k rows for each query. queries: a condition on the table's columns; without it every vector is one."""
    rows = routed(vectors, k, pivots, group_rows, block_rows, seed, id_col, vector_col, queries)
    if rows is None:
        kind = roles(vectors, i=id_col).schema[0].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, neighbor_id {kind}, rank int, distance double")
    kind = rows.schema["i"].dataType.simpleString()

    def solve(table: pa.Table) -> pa.Table:
        role = np.asarray(table["role"])
        ids = table["i"].combine_chunks()
        r, v = np.asarray(table["r"]), _matrix(table["v"].combine_chunks())
        q, c = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        if len(c):
            place = np.asarray(pc.rank(ids.take(pa.array(c)), sort_keys="ascending", null_placement="at_start", tiebreaker="dense")).astype(np.int64)
            c = first_of_equals(c[np.lexsort((r[c], place))], v, k + 1)
        i, j, d = local_neighbours(r[q], v[q], r[c], v[c], k) if len(q) and len(c) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        a, b = q[i], c[j]
        return pa.table({"q": pa.array(r[a]), "query_id": ids.take(pa.array(a)), "n": pa.array(r[b]), "neighbor_id": ids.take(pa.array(b)), "distance": pa.array(d)})

    found = rows.groupBy("g", "s", "b").applyInArrow(solve, f"q bigint, query_id {kind}, n bigint, neighbor_id {kind}, distance double")
    best = Window.partitionBy("q").orderBy("distance", F.col("neighbor_id").asc_nulls_first(), "n")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "neighbor_id", "rank", "distance")


def sql(k: int = K) -> str:
    """The same over a table ``embeddings`` of fine vectors with ids of their own, distances rounded; queries are the rows whose id is divisible by 100."""
    return f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
ranked AS (SELECT query_id, neighbor_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbor_id) AS rank FROM pairs)
SELECT query_id, neighbor_id, CAST(rank AS INTEGER) AS rank, round(d, 9) AS distance FROM ranked WHERE rank <= {k}
"""
