"""The operators against plain versions of themselves."""

import datetime
import decimal
import gzip
import hashlib
import io
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import mixing, packing, rank_profiles, repetition, shards, simhash, suffix_tree, voronoi_knn, warc, weak_quality
from spanloom.llm.common import text_bytes


def texts_frame(spark, texts, **more):
    rows = [(i, t, *(more[k][i] for k in more)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string" + "".join(f", {k} string" for k in more)).repartition(3)


# 1 probabilistic suffix tree


def plain_tree(texts, depth, min_count, divergence, alpha, beta, train=None):
    count = [defaultdict(Counter) for _ in range(depth + 1)]
    for t in texts if train is None else train:
        s = [0xFF] * depth + list(t.encode()) + [0xFE]
        for k in range(depth, len(s)):
            for d in range(depth + 1):
                count[d][tuple(s[k - d : k])][s[k]] += 1
    kept = {()}
    for d in range(1, depth + 1):
        for c, nxt in count[d].items():
            n, parent = sum(nxt.values()), count[d - 1][c[1:]]
            m = sum(parent.values())
            if n >= min_count and sum(v * (math.log(v / n) - math.log(parent[x] / m)) for x, v in nxt.items()) >= divergence:
                kept |= {c[j:] for j in range(d + 1)}

    def prob(c, x):
        n = sum(count[len(c)][c].values())
        if not c:
            return (count[0][()][x] + beta) / (n + 256 * beta)
        return (count[len(c)][c][x] + alpha * prob(c[1:], x)) / (n + alpha)

    out = []
    for t in texts:
        s = [0xFF] * depth + list(t.encode()) + [0xFE]
        total = 0.0
        for k in range(depth, len(s)):
            state = next(tuple(s[k - d : k]) for d in range(depth, -1, -1) if tuple(s[k - d : k]) in kept)
            total += math.log2(prob(state, s[k]))
        out.append(total)
    return out


def scribbles(seed, letters="aab é", n=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("depth,rows,chunk", [(3, 10**6, 0), (6, 10**6, 0), (0, 10**6, 0), (3, 0, 40), (6, 0, 10**6)])
def test_suffix_tree(spark, depth, rows, chunk):
    """Held by all tasks, or in no place (rows 0), in chunks of several texts or one."""
    texts = scribbles(3)
    args = dict(depth=depth, min_count=3, divergence=2.0, alpha=2.0, beta=0.5)
    got = {r["doc_id"]: r["log2_prob"] for r in suffix_tree.suffix_tree_scores(texts_frame(spark, texts), **args, broadcast_rows=rows, chunk=chunk).collect()}
    want = plain_tree(texts, **args)
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("rows", [10**6, 0])
def test_suffix_tree_of_other_texts(spark, rows):
    """Runs that training never saw are smoothed down to their longest state."""
    texts, train = [*scribbles(5), "zzz", ""], scribbles(6)
    args = dict(depth=4, min_count=3, divergence=2.0, alpha=2.0, beta=0.5)
    got = {r["doc_id"]: r["log2_prob"] for r in suffix_tree.suffix_tree_scores(texts_frame(spark, texts), **args, broadcast_rows=rows, train=texts_frame(spark, train)).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(plain_tree(texts, **args, train=train), abs=1e-6)


def test_suffix_tree_depth_is_checked(spark):
    for depth in (7, 8, -1):
        with pytest.raises(ValueError):
            suffix_tree.suffix_tree_scores(texts_frame(spark, ["a"]), depth=depth)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("ab", max_size=30), min_size=1, max_size=5), st.integers(1, 6), st.integers(2, 9))
def test_runs_in_pieces(texts, depth, piece):
    data, off = text_bytes(pa.array(texts))
    whole, at = suffix_tree.runs(data, off, depth)
    before, suffix_tree.PIECE = suffix_tree.PIECE, piece
    try:
        parts = [[] for _ in texts]
        for lo, hi, key, ends in suffix_tree.run_pieces(data, off, depth):
            for k in range(lo, hi):
                parts[k] += key[ends[k - lo] : ends[k - lo + 1]].tolist()
    finally:
        suffix_tree.PIECE = before
    assert [x for p in parts for x in p] == whole.tolist() and (whole >= 0).all()


# 2 mixing


def plain_fill(amount, weight, cap, budget):
    share, clamped = {}, set()
    while True:
        free = [k for k in amount if k not in clamped and weight[k] > 0]
        left = budget - sum(cap[k] for k in clamped)
        total = sum(weight[k] for k in free)
        share = {k: cap[k] if k in clamped else left * weight[k] / total if k in free else 0.0 for k in amount}
        over = [k for k in free if share[k] > cap[k]]
        if not over:
            return share
        clamped |= set(over)


@pytest.mark.parametrize("ratio", [0.3, 1.0, 2.5])
def test_water_filling(spark, ratio):
    rng = random.Random(5)
    sources = [f"s{rng.randrange(6)}" for _ in range(60)]
    texts = ["x" * rng.randrange(1, 200) for _ in sources]
    weights = {"s0": 9.0, "s1": 5.0, "s2": 0.0, "s3": 0.1}
    amount = Counter()
    for s, t in zip(sources, texts):
        amount[s] += len(t)
    w = {k: weights.get(k, 1.0) for k in amount}
    want = plain_fill(amount, w, {k: 4.0 * v for k, v in amount.items()}, ratio * sum(amount.values()))
    got = {r["source"]: r for r in mixing.water_fill(texts_frame(spark, texts, source=sources), weights, budget_ratio=ratio).collect()}
    assert {k: r["share"] for k, r in got.items()} == pytest.approx(want)
    assert all(r["repeats"] == pytest.approx(want[k] / amount[k], abs=1e-8) for k, r in got.items())


# 3 suffix-array repetition


def plain_repeats(t, length):
    covered, longest = set(), 0
    for i in range(len(t)):
        best = 0
        for j in range(len(t)):
            if i != j:
                k = 0
                while max(i, j) + k < len(t) and t[i + k] == t[j + k]:
                    k += 1
                best = max(best, k)
        if best >= length:
            covered |= set(range(i, i + best))
            longest = max(longest, best)
    return len(covered), longest


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé😀", max_size=40), max_size=6), st.integers(1, 5))
def test_repetition(texts, length):
    chars, covered, longest = repetition.repeats(*text_bytes(pa.array(texts, pa.string())), length)
    assert chars.tolist() == [len(t) for t in texts]
    assert list(zip(covered.tolist(), longest.tolist())) == [plain_repeats(t, length) for t in texts]


# 4 SimHash


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 60))
def test_bit_sliced_distances(seed, radius):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 150))
    high, low = (rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) for _ in range(2))
    near = rng.integers(0, n, n // 2)
    high[: len(near)] = high[near] ^ np.uint64(int(rng.integers(0, 2**20)))
    bucket = np.sort(rng.integers(0, 3, n))
    a, b = simhash.close_pairs(high, low, bucket, radius)
    far = lambda i, j: int(high[i] ^ high[j]).bit_count() + int(low[i] ^ low[j]).bit_count()
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if bucket[i] == bucket[j] and far(i, j) <= radius}
    assert set(zip(a.tolist(), b.tolist())) == want


def plain_groups(texts, radius):
    high, low, has = simhash.fingerprints(pa.array(texts, pa.string()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if has[i] and has[j] and int(high[i] ^ high[j]).bit_count() + int(low[i] ^ low[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def varied(rng, n=40):
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts


def test_near_duplicates(spark):
    texts = varied(random.Random(11)) + ["", None, "..."]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(texts_frame(spark, texts)).collect()}
    want = plain_groups(texts, simhash.RADIUS)
    agree = sum(got[i]["group_id"] == want[i] for i in range(len(texts)))
    assert agree >= 0.98 * len(texts)
    assert all(got[i]["keep"] == (got[i]["group_id"] == i) for i in got)


def test_meeting_at_the_radius(spark):
    """Of the pairs within the radius, all but a few of a hundred share a key, the furthest ones too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    column = pa.array([r["text"] for r in docs.select("text").distinct().collect()])
    high, low, has, key = simhash.fingerprints(column, keys=True)
    high, low, key = high[has], low[has], key[has]
    a, b = simhash.close_pairs(high, low, np.zeros(len(high), np.int64), simhash.RADIUS)
    far = np.array([int(high[i] ^ high[j]).bit_count() + int(low[i] ^ low[j]).bit_count() for i, j in zip(a, b)])
    meet = (key[a] == key[b]).any(1)
    assert len(a) > 50 and meet.mean() > 0.98 and (far >= 22).sum() > 5 and meet[far >= 22].mean() > 0.9
    assert simhash.meeting_rate(0.6) > 0.999 and simhash.meeting_rate(0.02) < 0.001


def test_split_buckets_lose_nothing(spark):
    texts = varied(random.Random(4)) * 3
    whole = {r["doc_id"]: tuple(r) for r in simhash.near_duplicates(texts_frame(spark, texts)).collect()}
    split = {r["doc_id"]: tuple(r) for r in simhash.near_duplicates(texts_frame(spark, texts), bucket=2).collect()}
    assert split == whole


def test_frequent_keys_are_found(spark):
    rows = [(i, i, i, [1, 100 + i]) for i in range(50)] + [(99, 99, 99, [1, 7])] * 20
    hashes = spark.createDataFrame(rows, "h bigint, l bigint, t bigint, k array<bigint>")
    key, parts = simhash.heavy_keys(hashes, 10)
    assert key.tolist() == [1] and parts.tolist() == [6]  # copies count once


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (100, 102)]
    rng.shuffle(edges)
    got = {r["v"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


# 5 WARC


def test_warc_reader_on_damage():
    good = [warc.page_record(i, f"http://x/{i}", "body " * i) for i in range(4)]
    bad = warc.record({"WARC-Type": "resource", "WARC-Block-Digest": "sha1:" + "A" * 32}, b"other")
    broken = bytearray(good[1])
    broken[20] ^= 0xFF
    for block in (1, 7, 1 << 18):
        rows = list(warc.records(io.BytesIO(good[0] + bytes(broken) + good[2] + bad + b"junk" + good[3]), block))
        assert [r["offset"] for r in rows if r["status"] == "ok"] == [0, len(good[0]) + len(broken), len(good[0]) + len(broken) + len(good[2]), len(good[0]) + len(broken) + len(good[2]) + len(bad) + 4]
        assert [r.get("digest") for r in rows if r["status"] == "ok"] == ["ok", "ok", "bad", "ok"]
        assert any(r["status"] == "corrupt" for r in rows)
        cut = list(warc.records(io.BytesIO(good[3] + good[2][:-9]), block))
        assert [r["status"] for r in cut] == ["ok", "truncated"]
    assert list(warc.records(io.BytesIO(b""))) == []


def plain_record(body, length=None, end=b"\r\n\r\n"):
    return b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: " + str(len(body) if length is None else length).encode() + b"\r\n\r\n" + body + end


@pytest.mark.parametrize("block", [1, 13, 1 << 18])
def test_warc_members(block):
    pack = gzip.compress
    read = lambda raw: [(r["offset"], r["status"], r.get("block")) for r in warc.records(io.BytesIO(raw), block)]
    # several records in a member, then one of its own
    two = pack(plain_record(b"one") + plain_record(b"WARC/ two\r\n\r\n"))
    assert read(two + pack(plain_record(b""))) == [(0, "ok", b"one"), (0, "ok", b"WARC/ two\r\n\r\n"), (len(two), "ok", b"")]
    # a second record that isn't one, and one cut short
    assert read(pack(plain_record(b"one") + b"junk")) == [(0, "ok", b"one"), (0, "corrupt", None)]
    assert read(pack(plain_record(b"one") + plain_record(b"two", 99))) == [(0, "ok", b"one"), (0, "truncated", b"two\r\n\r\n")]
    # lengths that are none
    for bad in ("-1", "x", "", "+3", "²"):
        raw = pack(b"WARC/1.0\r\nContent-Length: " + bad.encode() + b"\r\n\r\nabc\r\n\r\n")
        assert [x[1] for x in read(raw + pack(plain_record(b"z")))] == ["corrupt", "ok"]
    # an empty member, headers without end, a long block
    assert [x[1] for x in read(pack(b"") + pack(b"WARC/1.0\r\nA: b") + pack(plain_record(b"z")))] == ["corrupt", "corrupt", "ok"]
    long = plain_record(b"0123456789" * 100_000)
    assert [len(x[2]) for x in read(pack(long) + pack(long))] == [1_000_000] * 2


def test_warc_memory_is_bounded():
    """Headers that go on and on are given up; what follows in the member is inflated in pieces and let go."""
    member = warc._Member(warc._Source(io.BytesIO(gzip.compress(b"WARC/1.0\r\nA: " + b"x" * (40 << 20))), 1 << 16))
    rows = list(warc._member_records(member))
    assert [r["status"] for r in rows] == ["corrupt"] and len(member.data) <= warc.HEAD + warc.PIECE
    member.drain()
    assert not member.data and member.inflate.eof


# 6 shards


def test_store(spark, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "store"))
    want = []
    for k in range(9):
        rows = [(k * 10 + i, f"t{i}" * k) for i in range(10)]
        want += rows
        store.append(spark.createDataFrame(rows, "id bigint, t string").coalesce(1))
    before = store.manifest()
    assert len(before["shards"]) == 9
    old = store.read(before["version"])
    store.compact(target=1 << 20)
    after = store.manifest()
    assert len(after["shards"]) == 1 and after["version"] == before["version"] + 1
    assert sorted(map(tuple, store.read().collect())) == sorted(want) == sorted(map(tuple, old.collect()))
    with pytest.raises(shards.StaleManifest):
        store._commit(before, after["schema"], [])
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([(1,)], "id bigint"))


def test_all_types_survive_compaction(spark, tmp_path):
    utc = datetime.timezone.utc
    moment = datetime.datetime(1969, 12, 31, 23, 59, 59, 999999, utc)
    kinds = "id int, ts timestamp, nt timestamp_ntz, day date, dec decimal(30,4), bin binary, list array<timestamp>, st struct<a timestamp, b double>, m map<string,timestamp>, f float, ok boolean, span interval day to second"
    row = lambda i: (i, moment, moment.replace(tzinfo=None), datetime.date(1, 1, 1), decimal.Decimal("12345678901234567890.1234"), b"\0\xff", [moment, None], (moment, -0.0), {"k": moment}, 0.1, None, datetime.timedelta(days=-1, microseconds=7))
    store = shards.ShardStore(spark, str(tmp_path / "types"))
    frames = [spark.createDataFrame([row(i), (i + 100, *[None] * 11)], kinds).coalesce(1) for i in range(5)]
    for f in frames:
        store.append(f)
    want = sorted(str(r) for f in frames for r in f.collect())
    before = sorted(map(str, store.read().collect()))
    store.compact()
    assert len(store.manifest()["shards"]) == 1 and before == want == sorted(map(str, store.read().collect()))


def test_tiers():
    make = lambda *sizes: [shards.Shard(f"p{i}", 1, s) for i, s in enumerate(sizes)]
    assert shards.plan(make(10, 10, 10), 1000) == []
    assert [len(r) for r in shards.plan(make(*[10] * 4), 1000)] == [4]
    runs = shards.plan(make(*[300] * 8), 1000)
    assert all(sum(s.bytes for s in r) <= 1000 for r in runs)


# 7 language profiles


def test_language_profiles(spark):
    rng = random.Random(9)
    texts, langs = [], []
    for i in range(40):
        lang = rng.choice(["x", "y", None])
        letters = {"x": "abcabcde", "y": "defghéé", None: "abcdefgh"}[lang]
        texts.append(" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(12))) + rng.choice(["", "!", "7 ßA"]))
        langs.append(lang)

    def grams(t):
        out, word = Counter(), ""
        for c in t.lower() + " ":
            if c.isalpha():
                word += c
            elif word:
                w = f" {word} "
                out.update(w[p : p + n] for p in range(len(w)) for n in (1, 2, 3) if p + n <= len(w) and w[p : p + n] != " ")
                word = ""
        return out

    size = 25
    ranked = lambda c: {g: r for r, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size])}
    known = defaultdict(Counter)
    for t, lang in zip(texts, langs):
        if lang:
            known[lang] += grams(t)
    profiles = {k: ranked(c) for k, c in known.items()}
    for r in rank_profiles.identified(texts_frame(spark, texts, lang=langs), size).collect():
        own = ranked(grams(texts[r["doc_id"]]))
        far = {k: sum(abs(p[g] - x) if g in p else size for g, x in own.items()) for k, p in profiles.items()}
        best = min(far, key=lambda k: (far[k], k)) if own else None
        assert (r["language"], r["distance"], r["n_grams"]) == (best, far.get(best), len(own))


# 8 Voronoi kNN


def check_neighbours(spark, x, k, every=1, **sizes):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in voronoi_knn.neighbours(df, k=k, queries=F.col("vec_id") % every == 0, **sizes).collect():
        got[r["query_id"]].append((r["rank"], r["distance"], r["neighbor_id"]))
    assert set(got) == set(range(0, len(x), every))
    for i in got:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want = sorted((d[j], j) for j in range(len(x)) if j != i)[:k]
        assert [(round(b, 9), c) for _, b, c in sorted(got[i])] == [(round(a, 9), j) for a, j in want]


def clusters(seed, centres, n, width=4):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centres, width))[rng.integers(0, centres, n)] * 20 + rng.normal(size=(n, width)) * 0.3


@pytest.mark.parametrize("every", [1, 7])
def test_neighbours(spark, every):
    x = np.round(clusters(1, 7, 400), 1)
    check_neighbours(spark, x, 5, every, pivots=12, group_rows=40, block_rows=90)
    check_neighbours(spark, np.random.default_rng(every).random((150, 5)), 4, every, group_rows=30, block_rows=40)


def test_neighbours_of_equal_vectors(spark):
    """A third of all vectors are one, far more than a block keeps."""
    x = np.round(clusters(2, 5, 300), 1)
    x[::3] = x[0]
    check_neighbours(spark, x, 6, 2, group_rows=25, block_rows=60)


def test_routing_follows_the_clusters(spark):
    """On clusters, rows sent grow as the vectors; so does what one task holds not."""
    sent = {}
    for n in (2000, 4000, 8000):
        x = clusters(3, 50, n, 8)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
        rows = voronoi_knn.routed(df, 10, None, 200, 400, 5, "vec_id", "embedding", None)
        sizes = rows.groupBy("g", "s", "b").agg(F.count_if(F.col("role") == 0).alias("q"), F.count_if(F.col("role") == 1).alias("c")).collect()
        sent[n] = sum(r["q"] + r["c"] for r in sizes)
        assert max(r["q"] for r in sizes) <= 300 and max(r["c"] for r in sizes) <= 600
    assert sent[8000] / sent[2000] < 4 * 1.35 and sent[8000] < 8000 * 8


# 9 packing


def plain_packs(lengths, cap, weights, rule):
    bins, out = [], []
    for n in lengths:
        need = (n, 1, n * n)
        best = None
        for k, left in enumerate(bins):
            if all(a >= b for a, b in zip(left, need)):
                if rule == "dot":
                    value = -sum(w * (b / c) * (a / c) for w, a, b, c in zip(weights, left, need, cap))
                else:
                    value = sum(w * ((a - b) / c) ** 2 for w, a, b, c in zip(weights, left, need, cap))
                if best is None or value < best[0] - 1e-12:
                    best = (value, k)
        if best is None:
            bins.append(list(cap))
            best = (0, len(bins) - 1)
        bins[best[1]] = [a - b for a, b in zip(bins[best[1]], need)]
        out.append(best[1])
    return out


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_best_fit(rule):
    rng = np.random.default_rng(4)
    for _ in range(30):
        lengths = np.sort(rng.integers(1, 65, rng.integers(1, 60)))[::-1]
        cap = (64, int(rng.integers(1, 6)), int(rng.choice([64 * 64, 70 * 64])))
        assert packing.best_fit(lengths, cap, packing.WEIGHTS, rule).tolist() == plain_packs(lengths.tolist(), cap, packing.WEIGHTS, rule)


def test_packed_rows(spark):
    rng = random.Random(8)
    texts = ["w " * rng.randrange(0, 300) for _ in range(80)]
    out = packing.packed(texts_frame(spark, texts), tokens=128, documents=5, attention=0.7, group_tokens=3000).collect()
    load, pieces = defaultdict(list), defaultdict(dict)
    for r in out:
        load[r["pack_group"], r["bin"]].append(r["n_tokens"])
        pieces[r["doc_id"]][r["start_token"]] = r["n_tokens"]
    assert all(sum(x) <= 128 and len(x) <= 5 and sum(n * n for n in x) <= 0.7 * 128 * 128 for x in load.values())
    for i, t in enumerate(texts):
        at = 0
        for start, n in sorted(pieces[i].items()):
            assert start == at
            at += n
        assert at == len(t.split())


# 10 weak labels


def test_expectation_maximisation():
    rng = np.random.default_rng(6)
    k = len(weak_quality.LABELLERS)
    truth = rng.random(6000) < 0.7
    right = np.linspace(0.65, 0.95, k)
    votes = np.where(rng.random((6000, k)) < right, truth[:, None], ~truth[:, None]).astype(np.int8)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    model = weak_quality.fit_labels(patterns, n)
    assert abs(model.prior - 0.7) < 0.05
    hit = model.rates[:, 1, 2] / (model.rates[:, 1, 1] + model.rates[:, 1, 2])
    assert np.abs(hit - right).max() < 0.08
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.95


WORD = regex.compile(r"[0-9A-Za-z\P{ASCII}]+")


def plain_statistics(t):
    raw, found = t.encode(), list(WORD.finditer(t))
    words = [m.group() for m in found]
    n, pairs = len(words), list(zip(words, words[1:]))
    upper, lower = sum(c.isascii() and c.isupper() for c in t), sum(c.isascii() and c.islower() for c in t)
    after = [t[m.end()] if m.end() < len(t) else " " for m in found]
    some = max(n, 1)
    return {
        "symbol_share": sum(c in "#$%&*@^~=<>_{}[]\\+`" for c in t) / max(len(raw), 1),
        "upper_share": upper / max(upper + lower, 1),
        "same_word_share": sum(a == b for a, b in pairs) / max(n - 1, 1),
        "bigram_variety": len(set(pairs)) / max(n - 1, 1) if n >= 10 else math.nan,
        "bar_share": t.count("|") / some,
        "short_word_share": sum(len(w.encode()) <= 3 for w in words) / some if n >= 10 else math.nan,
        "bang_share": t.count("!") / some,
        "clean_ends": sum(c in " \t\r\n.,;:?'\")-/" for c in after) / some if n >= 10 else math.nan,
        "stop_share": t.count(".") / some if n >= 50 else math.nan,
    }, n


def plain_votes(stats, n):
    out = []
    for _, name, good, bad in weak_quality.LABELLERS:
        x, vote = stats[name], -1
        up = good is None or good < bad
        if good is not None and (x <= good if up else x >= good):
            vote = 1
        if x >= bad if up else x <= bad:
            vote = 0
        out.append(vote if n else -1)
    return out


def plain_shapes(t):
    """(trigrams of bytes, shapes of words): what the hashed features stand for."""
    raw = t.encode()
    shapes, before = Counter(), None
    for m in WORD.finditer(t):
        w = m.group()
        follow = t[m.end()].encode()[0] if m.end() < len(t) else 32
        shapes[min(len(w.encode()), 20), min(sum(c.isascii() and c.isupper() for c in w), 3), w == before, follow] += 1
        before = w
    return Counter(raw[i : i + 3] for i in range(len(raw) - 2)), shapes


junky = st.lists(st.one_of(st.sampled_from(["the", "the", "Mill", "é", "日本", "a1", "WIN", "|", "!!", "$#", ".", ", ", "\n"]), st.text("aB. |!#é", max_size=4)), max_size=70).map(" ".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(junky, min_size=1, max_size=5))
def test_quality_statistics(texts):
    data, off = text_bytes(pa.array(texts))
    stats, n = weak_quality.statistics(data, off)
    votes = weak_quality.votes(stats, n)
    for k, t in enumerate(texts):
        want, count = plain_statistics(t)
        assert n[k] == count
        assert {c: float(v[k]) for c, v in stats.items()} == pytest.approx(want, nan_ok=True)
        assert votes[k].tolist() == plain_votes(want, count)


@settings(max_examples=60, deadline=None)
@given(st.lists(junky, min_size=2, max_size=6))
def test_quality_features(texts):
    """A document's buckets depend on its text alone; equal trigrams and shapes share one."""
    bucket, room = weak_quality.features(*text_bytes(pa.array(texts)))
    meaning: dict = {}
    for k, t in enumerate(texts):
        own = bucket[room[k] : room[k + 1]].tolist()
        grams, shapes = plain_shapes(t)
        assert len(own) == grams.total() + shapes.total()
        alone, _ = weak_quality.features(*text_bytes(pa.array([t])))
        assert own == alone.tolist()
        raw = t.encode()
        for i, b in enumerate(own[: grams.total()]):
            assert meaning.setdefault(raw[i : i + 3], b) == b
    assert all(0 <= b < weak_quality.BUCKETS for b in bucket.tolist())


def plain_fit(rows, targets, rounds, rate, ridge):
    w, seen, bias, seen_bias = defaultdict(float), defaultdict(lambda: 1e-8), 0.0, 1e-8
    good, bad = max(sum(targets), 1e-9), max(sum(1 - t for t in targets), 1e-9)
    touched = {b for row in rows for b in row}
    for _ in range(rounds):
        g, gb = defaultdict(float), 0.0
        for row, t in zip(rows, targets):
            z = bias + sum(w[b] * x for b, x in row.items())
            err = (1 / (1 + math.exp(-max(-50, min(50, z)))) - t) * (t / good + (1 - t) / bad) / 2
            for b, x in row.items():
                g[b] += err * x
            gb += err
        for b in touched:
            step = g[b] + ridge * w[b]
            seen[b] += step * step
            w[b] -= rate * step / math.sqrt(seen[b])
        seen_bias += gb * gb
        bias -= 0.1 * gb / math.sqrt(seen_bias)
    return w, bias


def test_quality_scorer():
    rng = random.Random(12)
    rows = [{rng.randrange(30): rng.random() for _ in range(rng.randrange(1, 6))} for _ in range(40)]
    targets = [min(1.0, max(0.0, 0.9 * (0 in r or 1 in r) + 0.1 * rng.random())) for r in rows]
    at = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    got = weak_quality.fit_scorer(np.array([b for r in rows for b in r]), np.array([x for r in rows for x in r.values()]), at, np.array(targets), 0.7, rounds=25)
    w, bias = plain_fit(rows, targets, 25, 2.0, 1e-6)
    assert got.bias == pytest.approx(bias) and {b: got.weights[b] for b in w} == pytest.approx(dict(w))
    assert np.count_nonzero(got.weights) == sum(v != 0 for v in w.values()) and got.prior_logit == pytest.approx(math.log(0.7 / 0.3))


def test_quality_of_rows(spark):
    """The whole of it against the plain parts: votes of all rows, models, the scores and what they keep."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    votes = {i: plain_votes(*plain_statistics(t)) for i, t in texts.items()}
    table = Counter(sum((v + 1) * 3**k for k, v in enumerate(x)) for x in votes.values())
    assert {r["pattern"]: r["n"] for r in weak_quality.vote_patterns(docs).collect()} == table
    want = plain_scores(docs, texts)
    for r in weak_quality.quality_scores(docs).collect():
        p = want[r["doc_id"]]
        assert (r["score"] is None) == (p is None) and r["keep"] == (p is not None and p >= weak_quality.THRESHOLD)
        assert p is None or r["score"] == pytest.approx(p, rel=1e-6)


def plain_scores(docs, texts):
    """Each document's score, added up feature by feature from the fitted weights."""
    _, scorer = weak_quality.fit(docs)
    out = {}
    for i, t in texts.items():
        bucket = weak_quality.features(*text_bytes(pa.array([t])))[0].tolist()
        own = scorer.bias + sum(scorer.weights[b] for b in bucket) / max(len(bucket), 1)
        z = (own * len(bucket) + scorer.prior_logit * weak_quality.SHRINK) / (len(bucket) + weak_quality.SHRINK)
        out[i] = 1 / (1 + math.exp(-z)) if WORD.search(t) else None
    return out


def test_quality_against_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = {r["doc_id"]: r["keep"] for r in weak_quality.quality_scores(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    right = [got[i] == bool(q) for i, q in labels.items()]
    clean = [got[i] for i, q in labels.items() if q]
    assert np.mean(right) > 0.9 and np.mean(clean) > 0.97


# the pipeline


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates", "source_mixing", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        steps[name] = docs.collect()
        docs = spark.createDataFrame(steps[name], docs.schema)
    ids = {n: [r["doc_id"] for r in rows] for n, rows in steps.items()}
    scores = plain_scores(spark.read.parquet(f"{sf}/documents.parquet"), texts)
    assert sorted(ids["quality_classifier"]) == sorted(i for i, p in scores.items() if p is not None and p >= weak_quality.THRESHOLD)
    calm = []
    for i in ids["quality_classifier"]:
        n, covered, longest = (int(x[0]) for x in repetition.repeats(*text_bytes(pa.array([texts[i]])), repetition.MIN_LENGTH))
        if covered / max(n, 1) <= repetition.MAX_FRACTION and longest <= repetition.MAX_REPEAT:
            calm.append(i)
    assert sorted(ids["quality_rules"]) == sorted(calm)
    order = sorted(calm)
    groups = plain_groups([texts[i] for i in order], simhash.RADIUS)
    assert sorted(ids["near_duplicates"]) == sorted({order[g] for g in groups})
    drawn = Counter(ids["source_mixing"])
    source = {r["doc_id"]: r["source"] for r in steps["near_duplicates"]}
    amount = Counter()
    for i, s in source.items():
        amount[s] += len(texts[i])
    weight = {s: corpus_pipeline.WEIGHTS.get(s, 1.0) for s in amount}
    share = plain_fill(amount, weight, {s: mixing.MAX_EPOCHS * n for s, n in amount.items()}, sum(amount.values()))
    for i, s in source.items():
        times = round(share[s] / amount[s], 9)
        luck = int(hashlib.md5(f"{mixing.SEED}|{i}".encode()).hexdigest()[:8], 16) / 2**32
        assert drawn[i] == int(times) + (luck < times - int(times))
    assert set(drawn) <= set(source)
    tokens = Counter()
    for r in steps["best_fit_packing"]:
        tokens[r["doc_id"]] += r["n_tokens"]
    assert tokens == {i: n * len(texts[i].split()) for i, n in drawn.items()}
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()) == Counter(ids["best_fit_packing"])
