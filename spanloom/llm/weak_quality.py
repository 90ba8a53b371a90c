"""Quality classifier from weak labels.

Heuristic labellers each vote good (1), bad (0) or abstain (-1) on every document of the corpus. The counts of vote
patterns, at most 3 ** len(LABELLERS) rows whatever the corpus, carry all that expectation-maximisation needs: it
estimates the class prior and each labeller's accuracy in each class. The posterior of a document's pattern is its
label, by which a linear scorer over hashed features is trained with logistic loss. Votes are counted over the whole
corpus; the scorer is fitted on a sample of at most ``train_docs`` documents, the first in order of a hash of id and text
among distinct ones (the one bounded sample here). The score of every document is the scorer's probability of good;
``threshold`` and above stays.

Defined cases: null or wordless text has no features, score null, and isn't kept. A very long text is voted on and scored
whole. A corpus whose labellers never disagree, or without any vote, gives the scorer one class only: all documents with
words then get the same side. Repeated rows get equal scores; each votes, but rows of the same id and text train once, so
however many there are the sample keeps its bound. Ids and texts pick the sample together, so null and repeated ids are
allowed; equal hashes have equal id and text. A score of exactly ``threshold`` stays. Further columns may have any names.
No rows: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, roles, shielded, spans, sums, text_bytes, words

BUCKETS, TRAIN_DOCS, THRESHOLD, SEED = 1 << 16, 4000, 0.4, 29
CHUNK = 1_000_000
#: name, statistic, good side, bad side: a value up to ``good`` votes 1, one from ``bad`` on votes 0 (the other way round if good > bad), between them none.
#: Without a good side a labeller only accuses: what it knows of one kind of junk says nothing for documents without it.
LABELLERS = (
    ("symbols", "symbol_share", None, 0.05),
    ("capitals", "upper_share", None, 0.4),
    ("stutter", "same_word_share", None, 0.2),
    ("tables", "bar_share", None, 0.2),
    ("shouting", "bang_share", None, 0.2),
    ("endings", "clean_ends", 0.97, 0.75),
    ("variety", "bigram_variety", 0.8, 0.45),
    ("short_words", "short_word_share", 0.15, 0.06),
    ("sentences", "stop_share", 0.04, 0.015),
)
#: Features of a document at which its own score weighs as much as the class prior.
SHRINK = 20
_PLAIN_END = np.zeros(256, bool)
for _c in " \t\r\n.,;:?'\")-/":
    _PLAIN_END[ord(_c)] = True
_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 symbol, 4 bar, 5 bang
for _s, _k in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("abcdefghijklmnopqrstuvwxyz", 2), ("#$%&*@^~=<>_{}[]\\+`", 3), ("|", 4), ("!", 5)):
    for _c in _s:
        _CLASS[ord(_c)] = _k


def statistics(data: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The labellers' statistics of each document, and its words."""
    kind = _CLASS[data]
    count = {k: sums(kind == k, off) for k in (1, 2, 3, 4, 5)}
    h, start, stop, at = words(data, off)
    n = np.diff(at)
    some = np.maximum(n, 1)
    pairs = np.maximum(n - 1, 1)
    doc = np.repeat(np.arange(len(n)), n)
    joined = doc[1:] == doc[:-1]
    same = np.zeros(len(h), bool)
    same[1:] = joined & (h[1:] == h[:-1])
    two = mix(h[1:] * U64(3) + h[:-1])[joined]
    two_doc = doc[1:][joined]
    key = np.sort((two & ~U64(0xFFFF)) | two_doc.astype(U64))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[fresh] & U64(0xFFFF)).astype(np.int64), minlength=len(n))
    size = np.maximum(np.diff(off), 1)
    last = np.zeros(len(data) + 1, bool)
    last[off[1:]] = True
    after = np.where(last[stop], 32, np.append(data, np.uint8(32))[stop])
    out = {
        "symbol_share": count[3] / size,
        "upper_share": count[1] / np.maximum(count[1] + count[2], 1),
        "same_word_share": sums(same, at) / pairs,
        "bigram_variety": np.where(n >= 10, distinct / pairs, np.nan),
        "bar_share": count[4] / some,
        "short_word_share": np.where(n >= 10, sums(stop - start <= 3, at) / some, np.nan),
        "bang_share": count[5] / some,
        "clean_ends": np.where(n >= 10, sums(_PLAIN_END[after], at) / some, np.nan),
        "stop_share": np.where(n >= 50, sums(data == ord("."), off) / some, np.nan),
    }
    return out, n


def votes(stats: dict[str, np.ndarray], n_words: np.ndarray) -> np.ndarray:
    """Votes by document and labeller; a document without words gets none, one of a word or two only from bars and symbols."""
    out = np.full((len(n_words), len(LABELLERS)), -1, np.int8)
    for k, (_, stat, good, bad) in enumerate(LABELLERS):
        x = stats[stat]
        up = good is None or good < bad
        with np.errstate(invalid="ignore"):
            if good is not None:
                out[(x <= good) if up else (x >= good), k] = 1
            out[(x >= bad) if up else (x <= bad), k] = 0
    out[n_words == 0] = -1
    return out


def _pattern(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) + 1) @ (3 ** np.arange(v.shape[1]))


def _unpattern(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8)


@dataclass(frozen=True)
class LabelModel:
    """The prior of good, and rates[k, c, v + 1]: the probability that labeller k says v (-1 abstains) about class c."""

    prior: float
    rates: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        log = np.log(np.array([1 - self.prior, self.prior]))[None].repeat(len(v), 0)
        for k in range(v.shape[1]):
            log += np.log(self.rates[k][:, v[:, k] + 1].T)
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over weighted vote patterns, with one pseudo-vote for each outcome; it starts from suspicion of whatever is accused at all."""
    v, w = patterns, counts.astype(np.float64)
    post = np.where((v == 0).any(1), 0.1, 0.9)
    model = LabelModel(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack((w * (1 - post), w * post))
        rates = np.ones((len(LABELLERS), 2, 3))
        for k in range(v.shape[1]):
            for said in (-1, 0, 1):
                rates[k, :, said + 1] += weight[:, v[:, k] == said].sum(1)
        rates /= rates.sum(2, keepdims=True)
        model = LabelModel(float((weight[1].sum() + 1) / (weight.sum() + 2)), rates)
        before, post = post, model.posterior(v)
        if not len(v) or np.abs(post - before).max() < 1e-9:
            break
    return model


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: buckets of byte trigrams and of word shapes (length, capitals, same as the word before), and document offsets into them."""
    n_docs = len(off) - 1
    h, start, stop, at = words(data, off)
    doc = np.repeat(np.arange(n_docs), np.diff(at))
    same = np.zeros(len(h), np.int64)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    upper = (_CLASS[data] == 1).astype(np.int64)
    running = np.concatenate(([0], np.cumsum(upper)))
    capitals = np.minimum(running[stop] - running[start], 3) if len(start) else same
    last = np.zeros(len(data) + 1, bool)
    last[off[1:]] = True
    ahead = np.where(last[stop], 32, np.append(data, np.uint8(32))[stop]).astype(np.int64)
    shape = mix((np.minimum(stop - start, 20) + 32 * (capitals + 4 * (same + 2 * ahead))).astype(U64) + U64(1 << 40))
    n_tri = np.maximum(np.diff(off) - 2, 0)
    room = np.concatenate(([0], np.cumsum(n_tri + np.diff(at))))
    out = np.empty(room[-1], np.int64)
    if len(data) > 2:
        x = data.astype(np.uint32)
        tri = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
        bucket = ((tri * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
        whole = np.ones(len(tri), bool)
        for back in (1, 2):
            cross = off[1:-1] - back
            whole[cross[(cross >= 0) & (cross < len(tri))]] = False
        tri_doc = np.repeat(np.arange(n_docs), n_tri)
        bucket = bucket[whole]
        first = np.concatenate(([0], np.cumsum(n_tri)))
        out[room[tri_doc] + np.arange(len(bucket)) - first[tri_doc]] = bucket
    out[room[doc] + n_tri[doc] + np.arange(len(h)) - at[doc]] = (shape % U64(BUCKETS)).astype(np.int64)
    return out, room


@dataclass(frozen=True)
class Scorer:
    """Weights of buckets, learned with both classes weighing the same, and the prior that short documents fall back to."""

    weights: np.ndarray
    bias: float
    prior_logit: float

    def logit(self, bucket: np.ndarray, room: np.ndarray) -> np.ndarray:
        n = np.diff(room)
        own = self.bias + sums(self.weights[bucket], room) / np.maximum(n, 1)
        return (own * n + self.prior_logit * SHRINK) / (n + SHRINK)


def fit_scorer(index: np.ndarray, share: np.ndarray, at: np.ndarray, target: np.ndarray, prior: float, rounds: int = 150, rate: float = 2.0, ridge: float = 1e-6) -> Scorer:
    """Logistic regression on rows of (bucket, share of the document's features), by AdaGrad over the whole sample; classes weigh the same."""
    w, bias, seen, seen_bias = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8), 1e-8
    row = np.repeat(np.arange(len(target), dtype=np.int32), np.diff(at))
    good, bad = max(target.sum(), 1e-9), max((1 - target).sum(), 1e-9)
    weight = (target / good + (1 - target) / bad) / 2
    for _ in range(rounds):
        z = bias + sums(w[index] * share, at)
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        err = (p - target) * weight
        g = np.bincount(index, err[row] * share, BUCKETS) + ridge * w
        gb = float(err.sum())
        seen += g * g
        seen_bias += gb * gb
        w -= rate * g / np.sqrt(seen)
        bias -= 0.1 * gb / np.sqrt(seen_bias)
    return Scorer(w, bias, float(np.log(prior / (1 - prior))))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return roles(docs, i=id_col, t=text_col).select("i", F.col("t").cast("string"))


def _chunks(column: pa.Array, rows: int = 2048):
    """(first row, one past the last, bytes, offsets) of runs of rows, so that neither a batch's bytes nor work arrays are held at once."""
    for first in range(0, len(column), rows):
        data, off = text_bytes(column.slice(first, rows))
        for lo, hi in spans(off, CHUNK):
            yield first + lo, first + hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def vote_patterns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of vote patterns over all documents: pattern, n."""

    def run(batches):
        seen = np.zeros(3 ** len(LABELLERS), np.int64)
        for b in batches:
            for _, _, data, off in _chunks(b.column(0)):
                seen += np.bincount(_pattern(votes(*statistics(data, off))), minlength=len(seen))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["pattern", "n"])

    return _source(docs, id_col, text_col).select("t").mapInArrow(run, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))


def training_sample(docs: DataFrame, train_docs: int, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(u, t): distinct documents with text by a hash u of id and text, some more than the ``train_docs`` least of u (all, if there are no more). Of a row that repeats one counts."""
    source = _source(docs, id_col, text_col).where("t is not null").select("i", "t", F.xxhash64(F.lit(seed), "i", "t").alias("u"))
    distinct = source.agg(F.approx_count_distinct("u", 0.02)).first()[0]
    # the estimate of distinct rows errs by some per cent
    share = min(1.0, 1.3 * train_docs / max(distinct, 1))
    if share < 1.0:
        source = source.where(F.col("u") < F.lit(int(share * 2**64) - 2**63))
    return source.groupBy("u").agg(F.min("t").alias("t"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, seed: int = SEED) -> tuple[LabelModel, Scorer]:
    """Both models. Votes of all documents are counted, then a sample of them is made into features."""
    table = vote_patterns(docs, id_col, text_col).collect()
    codes = np.array(sorted(r["pattern"] for r in table), np.int64)
    counts = {r["pattern"]: r["n"] for r in table}
    patterns = _unpattern(codes)
    n = np.array([counts[c] for c in codes.tolist()], np.int64)
    heard = (patterns >= 0).any(1) if len(codes) else np.zeros(0, bool)
    model = fit_labels(patterns[heard], n[heard])
    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            u = np.asarray(b.column(0))
            for lo, _, data, off in _chunks(b.column(1)):
                v = votes(*statistics(data, off))
                post = model.posterior(v)
                bucket, room = features(data, off)
                for k in np.flatnonzero((v >= 0).any(1)).tolist():
                    value, many = np.unique(bucket[room[k] : room[k + 1]], return_counts=True)
                    rows.append((value.astype(np.int32), (many / many.sum()).astype(np.float32), post[k], u[lo + k]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32())), pa.array([float(r[2]) for r in rows], pa.float64()), pa.array([int(r[3]) for r in rows], pa.int64())], names=["index", "share", "target", "u"])

    got = training_sample(docs, train_docs, seed, id_col, text_col).mapInArrow(run, "index array<int>, share array<float>, target double, u bigint").toArrow()
    got = got.take(np.argsort(np.asarray(got["u"]), kind="stable")[:train_docs])
    lists = got["index"].combine_chunks()
    index = np.asarray(lists.flatten())
    at = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths(), dtype=np.int64))))
    share = np.asarray(got["share"].combine_chunks().flatten())
    target = np.asarray(got["target"], dtype=np.float64)
    return model, fit_scorer(index, share, at, target, model.prior)


def _scores(text: pa.Array, scorer: Scorer) -> tuple[np.ndarray, np.ndarray]:
    score, has = np.zeros(len(text)), np.zeros(len(text), bool)
    for lo, hi, data, off in _chunks(text):
        bucket, room = features(data, off)
        score[lo:hi] = 1 / (1 + np.exp(-np.clip(scorer.logit(bucket, room), -50, 50)))
        has[lo:hi] = np.diff(words(data, off)[3]) > 0
    return score, has


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, train_docs: int = TRAIN_DOCS, seed: int = SEED) -> DataFrame:
    """A row for each document: id, score, keep."""
    _, scorer = fit(docs, id_col, text_col, train_docs, seed)
    held = docs.sparkSession.sparkContext.broadcast(scorer)  # BUCKETS weights, whatever the corpus

    def run(batches):
        for b in batches:
            score, has = _scores(b.column(1), held.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, mask=~has), pa.array(has & (score >= threshold))], names=["i", "score", "keep"])

    source = _source(docs, id_col, text_col)
    return source.mapInArrow(run, f"i {source.schema[0].dataType.simpleString()}, score double, keep boolean").toDF(id_col, "score", "keep")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, train_docs: int = TRAIN_DOCS, seed: int = SEED) -> DataFrame:
    """The rows, all columns as they are, that the classifier accepts."""
    _, scorer = fit(docs, id_col, text_col, train_docs, seed)
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        score, has = _scores(text, held.value)
        return pa.array(has & (score >= threshold))

    plain, find = shielded(docs)
    return plain.where(good(find(text_col).cast("string"))).toDF(*docs.columns)
