"""SimHash near-duplicates with bit-sliced comparison.

A document's 128-bit SimHash sums, over its distinct-by-place word bigrams (lower case, punctuation apart), a +1 or -1
for each hash bit. Documents with the same hash are copies. Which different hashes are compared follows from content:
a one-permutation min-hash of the word trigrams has ``BANDS`` x ``ROWS`` bins, ``ROWS`` of them make a 64-bit key, and
documents that share any of their ``BANDS`` keys meet in its bucket. There 64 hashes stand in a block as 128 vertical bit
planes, one hash is compared with all 64 at once, the 64 distances grow in carry-save counters (ones, twos, fours, ...),
and a comparison ends early once all 64 exceed the radius. Pairs within the radius make groups by connected components,
and each group keeps its smallest id.

Keys are as long at any size of the corpus, so their number is fixed and buckets hold what shares content, not a share of
all rows. A pair of trigram similarity J meets with probability 1 - (1 - J ** ROWS) ** BANDS (``meeting_rate``): 0.9997 at
0.6, 0.99 at 0.5, 0.88 at 0.4; of the pairs within the radius on sf0.1, 0.998 meet, and 0.99 of those at distance 25 to 28.
There is no limit on bucket sizes or partners: a bucket of more than ``BUCKET`` hashes is cut into parts, and every two
parts meet in a task of their own.

Defined cases: null text and text without words have no hash and form no group: they stay. A document of one word is
that word's hash; one or two words are one trigram. A very long text is hashed whole, with arrays of its own. Null ids
sort last, so a group keeps one only if it has no other; of equal ids the one with the lesser content hash stays.
Repeated rows are copies of each other: one row stays. Further columns may have any names. No rows: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, cut, discard, mix, roles, shielded, spans, text_bytes, words, written

RADIUS, BANDS, ROWS = 28, 32, 3
LANES, PLANES = 64, 128
CHUNK = 1_000_000
#: Hashes that meet in one task; keys of more are known from a sample and cut into parts, the ``HEAVY`` largest at most (others are merely slow).
BUCKET, HEAVY = 1 << 16, 1_000_000


def band_keys(h: np.ndarray, at: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The keys of documents with words, a row each: min-hashes of word trigrams in bins, an empty bin filled from the next one that isn't."""
    bins, n = bands * rows, len(at) - 1
    count = np.diff(at)
    tri = h * U64(0x9E3779B97F4A7C15)
    tri[:-1] += h[1:] * U64(0xC2B2AE3D27D4EB4F)
    tri[:-2] += h[2:] * U64(0x165667B19E3779F9)
    place = np.arange(len(h)) - np.repeat(at[:-1], count)
    short = np.repeat(count < 3, count)
    tri[short] = h[short]
    own = (place < np.repeat(np.maximum(count - 2, 1), count))
    value = mix(tri[own])
    slot = np.repeat(np.arange(n), count)[own].astype(U64) * U64(bins) + value % U64(bins)
    packed = np.sort(slot << U64(43) | value >> U64(21))  # a document's number has 12 bits (see ``spans``), a bin's at most 9
    first = np.ones(len(packed), bool)
    first[1:] = packed[1:] >> U64(43) != packed[:-1] >> U64(43)
    least, full = np.zeros(n * bins, U64), np.zeros(n * bins, bool)
    where = (packed[first] >> U64(43)).astype(np.int64)
    least[where], full[where] = packed[first] & U64((1 << 43) - 1), True
    least, full = least.reshape(n, bins), full.reshape(n, bins)
    ahead = np.where(np.concatenate((full, full), axis=1), np.arange(2 * bins)[None], 2 * bins)
    ahead = np.minimum.accumulate(ahead[:, ::-1], axis=1)[:, ::-1][:, :bins]
    took = mix(np.take_along_axis(least, ahead % bins, axis=1) + (ahead - np.arange(bins)).astype(U64) * U64(0x9E3779B97F4A7C15)).reshape(n, bands, rows)
    key = np.arange(1, bands + 1).astype(U64)[None].repeat(n, 0)
    for j in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + took[:, :, j])
    return key


def fingerprints(text: pa.Array, keys: bool = False) -> tuple[np.ndarray, ...]:
    """High and low halves of each text's hash, and whether it has one; with ``keys`` also its band keys."""
    data, off = text_bytes(text, lower=True)
    n = len(off) - 1
    high, low, has = np.zeros(n, U64), np.zeros(n, U64), np.zeros(n, bool)
    key = np.zeros((n, BANDS if keys else 0), U64)
    for lo, hi in spans(off, CHUNK):
        h, _, _, at = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        count = np.diff(at)
        some = np.flatnonzero(count)
        if not len(some):
            continue
        doc = np.repeat(np.arange(hi - lo), count)
        joined = doc[1:] == doc[:-1]
        two = h.copy()  # a lone word stands for itself
        two[1:][joined] = mix(h[1:][joined] * U64(0x9E3779B97F4A7C15) + h[:-1][joined])
        first = np.zeros(len(h), bool)
        first[at[some]] = True
        use = ~first | np.repeat(count == 1, count)
        two = two[use]
        number = np.maximum(count[some] - 1, 1)
        begin = np.cumsum(number) - number
        for half, out in ((two, high), (mix(two + U64(0x632BE59BD9B4E019)), low)):
            made = np.zeros(len(some), U64)
            for bit in range(64):
                ones = np.add.reduceat(((half >> U64(bit)) & U64(1)).astype(np.uint8), begin, dtype=np.int64)
                made |= (2 * ones > number).astype(U64) << U64(bit)
            out[lo + some] = made
        has[lo + some] = True
        if keys:
            key[lo + some] = band_keys(h, np.append(at[some], len(h)))
    return (high, low, has, key) if keys else (high, low, has)


def _full(a, b, c):
    """Carry-save adder: sum and carry of three bit vectors."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose vertical count is greater than the radius."""
    above, equal = over.copy(), ~over
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def slice_planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of blocks of 64 values: rows of blocks by bit, lane l of plane p is bit p of value l; the last block is filled with 0."""
    n = -(-len(values) // LANES)
    full = np.zeros(n * LANES, U64)
    full[: len(values)] = values
    out = np.empty((n, 64), U64)
    for lo in range(0, n, 1024):
        part = full[lo * LANES : (lo + 1024) * LANES].view(np.uint8).reshape(-1, LANES, 8)
        bits = np.unpackbits(part, axis=2, bitorder="little").transpose(0, 2, 1)
        out[lo : lo + 1024] = np.packbits(np.ascontiguousarray(bits), axis=2, bitorder="little").view(U64)[:, :, 0]
    return out


def within(query_high: np.ndarray, query_low: np.ndarray, block: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """For each comparison of a query with a block, the lanes within the radius, as a bit mask.

    planes: blocks by 128 planes, the high half's first. Eight planes at a time go through a carry-save tree into the
    counters; comparisons in which every lane already exceeds the radius are dropped after each eight.
    """
    width = max(4, int(radius).bit_length())
    out = np.zeros(len(block), U64)
    live = np.arange(len(block))
    counters = [np.zeros(len(block), U64) for _ in range(width)]
    over = np.zeros(len(block), U64)
    for group in range(0, PLANES, 8):
        word = (query_high if group < 64 else query_low)[live]
        d = []
        for p in range(group, group + 8):
            flip = U64(0) - ((word >> U64(p & 63)) & U64(1))
            d.append(planes[block[live], p] ^ flip)
        one, two, four = counters[0], counters[1], counters[2]
        one, a = _full(one, d[0], d[1])
        one, b = _full(one, d[2], d[3])
        two, c = _full(two, a, b)
        one, a = _full(one, d[4], d[5])
        one, b = _full(one, d[6], d[7])
        two, e = _full(two, a, b)
        four, carry = _full(four, c, e)
        counters[0], counters[1], counters[2] = one, two, four
        for k in range(3, width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        gone = _exceeds(counters, over, radius)
        alive = gone != U64(0xFFFFFFFFFFFFFFFF)
        if not alive.all():
            live, over = live[alive], over[alive]
            counters = [c[alive] for c in counters]
            gone = gone[alive]
        if not len(live):
            break
    if len(live):
        out[live] = ~_exceeds(counters, over, radius)
    return out


def close_pairs(high: np.ndarray, low: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of the same bucket within the radius; buckets are consecutive rows."""
    n = len(bucket)
    change = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    start = np.concatenate(([0], change))
    size = np.diff(np.append(start, n))
    end = np.repeat(start + size, size)  # one past the last row of each row's bucket
    left, right = [], []
    row = np.flatnonzero(np.arange(n) + 1 < end)
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    planes = np.concatenate((slice_planes(high), slice_planes(low)), axis=1)
    first, last = (row + 1) // LANES, (end[row] - 1) // LANES
    spread = last - first + 1
    done = np.concatenate(([0], np.cumsum(spread)))
    lo = 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + (1 << 16), side="right")) - 1)
        reps = spread[lo:hi]
        q = np.repeat(row[lo:hi], reps)
        block = np.repeat(first[lo:hi], reps) + np.arange(len(q)) - np.repeat(np.cumsum(reps) - reps, reps)
        mask = within(high[q], low[q], block, planes, radius)
        # lanes of later rows of the same bucket only
        a = np.clip(q + 1 - block * LANES, 0, LANES)
        b = np.clip(end[q] - block * LANES, 0, LANES)
        full = U64(0xFFFFFFFFFFFFFFFF)
        below_b = np.where(b == LANES, full, (U64(1) << (b & 63).astype(U64)) - U64(1))
        below_a = np.where(a == LANES, full, (U64(1) << (a & 63).astype(U64)) - U64(1))
        mask &= below_b & ~below_a
        hit = np.flatnonzero(mask)
        if len(hit):
            lanes = np.unpackbits(mask[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, lane = np.nonzero(lanes)
            left.append(q[hit][i])
            right.append(block[hit][i] * LANES + lane)
        lo = hi
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return root


def heavy_keys(hashes: DataFrame, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order that more than ``bucket`` hashes are likely to share, and the number of parts for each: from a sample in which such a key has some 1024 rows."""
    one_in = max(1, bucket // 1024)
    sample = hashes.where(F.pmod(F.xxhash64("h", "l"), F.lit(one_in)) == 0).select("h", "l", F.explode("k").alias("key")).distinct()
    most = bucket // one_in
    found = sample.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).orderBy(F.desc("n"), "key").limit(HEAVY).toArrow()
    key, n = np.asarray(found["key"]), np.asarray(found["n"])
    turn = np.argsort(key)
    return key[turn], -(-n[turn] // most)


def _edges(hashes: DataFrame, radius: int, bucket: int) -> DataFrame:
    """Pairs (a, b) of hash structs, a < b, enough of them to connect all hashes that meet within the radius. hashes: h, l, t and the array k of keys."""
    heavy = hashes.sparkSession.sparkContext.broadcast(heavy_keys(hashes, bucket))  # at most HEAVY keys

    def keyed(batches):
        known, parts = heavy.value
        seen = np.zeros(0, np.int64)
        for b in batches:
            text = np.asarray(b.column(2))
            _, first = np.unique(text, return_index=True)
            first = np.sort(first[~np.isin(text[first], seen)])  # a task sends copies of a text once
            if not len(first):
                continue
            seen = np.concatenate((seen, text[first])) if len(seen) < 200_000 else text[first]
            b = b.take(pa.array(first))
            key = np.asarray(b.column(3).flatten())
            row = np.repeat(np.arange(len(first)), BANDS)
            h, low = np.asarray(b.column(0))[row], np.asarray(b.column(1))[row]
            if len(known):
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hot = np.flatnonzero(known[at] == key)
                p = parts[at[hot]]
                mine = (mix(h[hot].view(U64) ^ mix(low[hot].view(U64))) % p.astype(U64)).astype(np.int64)
                again = np.repeat(hot, p)
                other = np.arange(len(again)) - np.repeat(np.cumsum(p) - p, p)
                mine = np.repeat(mine, p)
                pair = (np.minimum(mine, other) << 32 | np.maximum(mine, other)).astype(U64)
                cold = np.ones(len(key), bool)
                cold[hot] = False
                key = np.concatenate((key[cold], mix(key[again].view(U64) ^ mix(pair + U64(1))).view(np.int64)))
                h, low = np.concatenate((h[cold], h[again])), np.concatenate((low[cold], low[again]))
            for lo in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 100_000]) for x in (h, low, key)], names=["h", "l", "key"])

    def flush(high, low, key):
        turn = np.lexsort((low, high, key))
        high, low, key = high[turn], low[turn], key[turn]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        high, low, key = high[new], low[new], key[new]
        a, b = close_pairs(high, low, key, radius)
        if not len(a):
            return None
        part = np.unique(np.concatenate((a, b)))
        root = part[local_roots(len(part), np.searchsorted(part, a), np.searchsorted(part, b))]
        move = root != part
        part, root = part[move], root[move]
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (high[part], low[part], high[root], low[root])], names=["ah", "al", "bh", "bl"])

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            held.append(tuple(np.asarray(batch.column(i)).copy() for i in range(3)))
            rows += batch.num_rows
            if rows < 100_000 or held[0][2][0] == held[-1][2][-1]:
                continue  # a bucket isn't cut
            h, low, key = (np.concatenate(x) for x in zip(*held))
            whole = int(np.flatnonzero(key != key[-1])[-1]) + 1
            if (out := flush(h[:whole].view(U64), low[:whole].view(U64), key[:whole])) is not None:
                yield out
            held, rows = [(h[whole:], low[whole:], key[whole:])], len(key) - whole
        if held and rows:
            h, low, key = (np.concatenate(x) for x in zip(*held))
            if (out := flush(h.view(U64), low.view(U64), key)) is not None:
                yield out

    placed = hashes.select("h", "l", "t", "k").mapInArrow(keyed, "h bigint, l bigint, key bigint").repartition(F.col("key")).sortWithinPartitions("key")
    pairs = placed.mapInArrow(run, "ah bigint, al bigint, bh bigint, bl bigint")
    x, y = F.struct(F.col("ah").alias("h"), F.col("al").alias("l")), F.struct(F.col("bh").alias("h"), F.col("bl").alias("l"))
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, root) for every vertex of the edges (a, b): alternate large-star and small-star steps, each cut by a checkpoint."""
    edges = cut(edges.where("a <> b").distinct())
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: every greater neighbour joins the least one
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a vertex and its smaller neighbours join the least of them
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = cut(small)
        # a star forest has no vertex that is both a child and a root, and no child of two roots
        tangled = new.select(F.col("a").alias("v")).intersect(new.select(F.col("b").alias("v"))).limit(1).count()
        edges = new
        if not tangled and not new.groupBy("a").count().where("count > 1").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(r, i, t, h, l, k): a number for the row, id, content hash, SimHash and band keys; h is null without words."""

    def run(batches):
        for b in batches:
            high, low, has, key = fingerprints(b.column(3), keys=True)
            off = np.concatenate(([0], np.cumsum(has * BANDS))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(key[has].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in range(3)], pa.array(high.view(np.int64), mask=~has), pa.array(low.view(np.int64), mask=~has), lists], names=["r", "i", "t", "h", "l", "k"])

    source = roles(docs, i=id_col, x=text_col).select(F.monotonically_increasing_id().alias("r"), "i", F.xxhash64(F.col("x").cast("string")).alias("t"), F.col("x").cast("string"))
    return source.mapInArrow(run, f"r bigint, i {source.schema['i'].dataType.simpleString()}, t bigint, h bigint, l bigint, k array<bigint>")


def _decided(docs: DataFrame, radius: int, bucket: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(i, t, stays, g, n, hashed): id, content, whether the row stays, its group's first id and size, and whether it has a hash; and the written table that this reads.

    Copies of a text are counted by hash before anything is joined, so a group of any size is never in one task; the
    last join has one row a hash on its other side, and is split where a hash is frequent.
    """
    table = written(_hashed(docs, id_col, text_col), "simhash")
    hashed = table.where("h is not null")
    found = components(_edges(hashed, radius, bucket))
    roots = found.select(F.col("v.h").alias("h"), F.col("v.l").alias("l"), F.col("root.h").alias("rh"), F.col("root.l").alias("rl"))
    first = F.struct(F.col("i").isNull().alias("none"), "i", "t", "r")
    own = hashed.groupBy("h", "l").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
    joined = own.join(roots, ["h", "l"])
    whole = joined.groupBy("rh", "rl").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    grouped = joined.select("h", "l", "rh", "rl").join(whole, ["rh", "rl"]).select("h", "l", F.col("first").alias("gf"), F.col("n").alias("gn"))
    facts = own.join(grouped, ["h", "l"], "left").select("h", "l", F.coalesce("gf", "first").alias("f"), F.coalesce("gn", "n").alias("n"))
    facts = facts.select("h", "l", F.col("f.i").alias("g"), F.col("f.r").alias("w"), "n")
    out = hashed.select("r", "i", "t", "h", "l").join(facts, ["h", "l"]).select("i", "t", (F.col("r") == F.col("w")).alias("stays"), "g", "n", F.lit(True).alias("hashed"))
    alone = table.where("h is null").select("i", "t", F.lit(True).alias("stays"), F.col("i").alias("g"), F.lit(1).cast("bigint").alias("n"), F.lit(False).alias("hashed"))
    return out.unionByName(alone), table


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, group_id (the smallest id of its group), group_size, keep."""
    out, _ = _decided(docs, radius, bucket, id_col, text_col)
    return out.select(F.col("i").alias(id_col), F.col("g").alias("group_id"), F.col("n").alias("group_size"), F.col("stays").alias("keep"))


def without_near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, without all but one of each group.

    Rows to drop are known by id and content; the documents are shuffled by these once, to meet them in a hash join whose
    other side has a row for each. Where the row that stays has repetitions (same id and content), those rows are made one,
    each task's first.
    """
    out, table = _decided(docs, radius, bucket, id_col, text_col)
    rows = written(out.where("hashed").groupBy("i", "t").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1"), "simhash-drop")
    discard(table)
    plain, find = shielded(docs)
    keyed = plain.select("*", find(id_col).alias("_i"), F.xxhash64(find(text_col).cast("string")).alias("_t"))
    listed = rows.select(F.col("i").alias("_ri"), F.col("t").alias("_rt"), "stays").hint("shuffle_hash")
    same = F.col("_i").eqNullSafe(F.col("_ri")) & (F.col("_t") == F.col("_rt"))
    kept = keyed.join(listed, same, "left_anti").select(*plain.columns)
    if rows.where("stays").limit(1).count():
        again = keyed.join(listed.where("stays"), same, "left_semi").withColumn("_u", F.xxhash64("_i", "_t"))
        kept = kept.unionByName(again.dropDuplicates(["_u", "_t"]).select(*plain.columns))
    return kept.toDF(*docs.columns)


def meeting_rate(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """The probability that two documents of this trigram similarity share a key."""
    return 1 - (1 - similarity**rows) ** bands
