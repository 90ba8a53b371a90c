import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.operators import detect, match, paired, report, rewrite, score

SPAN = "struct<start:bigint,end:bigint,label:string,text:string>"
RUN = f"benchmark string, doc_id string, system string, ok boolean, gold array<{SPAN}>, spans array<{SPAN}>"


def spans(*triples):
    return [(a, b, label, "x" * max(b - a, 0)) for a, b, label in triples]


bounds = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 5)).map(lambda x: (x[0], x[0] + x[1])), max_size=8)


def plain_match(gold, pred, meets):
    used, hit = set(), []
    for g in gold:
        k = next((i for i, p in enumerate(pred) if i not in used and meets(g, p)), None)
        hit.append(k is not None)
        if k is not None:
            used.add(k)
    return hit


overlap = lambda g, p: p[0] < g[1] and p[1] > g[0]


@settings(max_examples=300, deadline=None)
@given(bounds, bounds, st.booleans())
def test_overlap_kernels(gold, pred, sort):
    pred = sorted(pred) if sort else pred
    args = [np.array([x[k] for x in side], np.int64) for side in (gold, pred) for k in (0, 1)]
    assert match.any_overlap(*args).tolist() == [any(overlap(g, p) for p in pred) for g in gold]
    assert match.greedy_overlap(*args).tolist() == plain_match(gold, pred, overlap)


def test_greedy_depends_on_order():
    gold, pred = [(0, 5), (3, 9), (20, 22)], [(4, 8), (0, 2)]
    args = [np.array([x[k] for x in side]) for side in (gold, pred) for k in (0, 1)]
    assert match.greedy_overlap(*args).tolist() == [True, False, False]


@pytest.fixture(scope="module")
def random_runs(spark):
    rng = random.Random(1)
    make = lambda: spans(*[(a := rng.randrange(10), a + rng.randrange(4), rng.choice("AB")) for _ in range(rng.randrange(7))])
    rows = [(f"b{i % 2}", f"d{i}", s, True, make(), make()) for i in range(60) for s in ("x.1", "y")]
    rows += [("b0", "failed", "y", False, spans((0, 3, "A")), None), ("b0", "empty", "y", True, spans((0, 3, "A")), []), ("b0", "null", "y", True, spans((1, 2, "B")), None)]
    return spark.createDataFrame(rows, RUN).repartition(4), rows


@pytest.mark.parametrize("mode", match.MODES)
def test_document_scores(random_runs, mode):
    df, rows = random_runs
    meets = {"strict": lambda g, p: g[:3] == p[:3], "type": lambda g, p: g[:2] == p[:2], "relaxed": overlap}[mode]
    got = {(r["doc_id"], r["system"]): tuple(r)[3:] for r in score.document_scores(df, mode).collect()}
    assert ("failed", "y") not in got and len(got) == len(rows) - 1
    for _, doc, system, ok, gold, pred in rows:
        if ok:
            pred = pred or []
            hit = plain_match(gold, pred, meets)
            size = lambda keep: sum(g[1] - g[0] for g, h in zip(gold, hit) if keep(h))
            assert got[doc, system] == (sum(hit), len(pred) - sum(hit), len(gold) - sum(hit), size(lambda h: not h), size(lambda h: True))


def test_micro_average_and_empty_denominators(spark):
    rows = [("b", "d", "s", True, spans((0, 4, "A"), (5, 6, "A")), spans((0, 4, "B"), (9, 10, "A"))), ("b", "e", "none", True, [], [])]
    out = {r["system"]: r for r in score.micro_average(score.document_scores(spark.createDataFrame(rows, RUN))).collect()}
    assert (out["s"]["precision"], out["s"]["recall"], out["s"]["f1"], out["s"]["leakage_rate"], out["s"]["char_leakage_rate"]) == (0.5, 0.5, 0.5, 0.5, 0.2)
    assert (out["none"]["f1"], out["none"]["leakage_rate"], out["none"]["char_leakage_rate"], out["none"]["n_docs"]) == (0.0, 1.0, 0.0, 1)


def test_pooled_keeps_runs_without_spans(random_runs):
    df, rows = random_runs
    keys = ["benchmark", "doc_id", "system"]
    t = match.pooled(df, keys, False)
    tp = F.least("g", "p")
    got = {r["doc_id"] + r["system"]: r["tp"] for r in t.groupBy(*keys).agg(F.sum(tp).alias("tp")).collect()}
    want = {r["doc_id"] + r["system"]: r["tp"] for r in score.document_scores(df).collect()}
    assert got == want


def test_unmatched_is_by_sets(spark):
    rows = [("b", "d", "s", True, spans((0, 4, "A"), (5, 6, "A")), spans((0, 4, "B"), (0, 4, "C"), (9, 10, "A")))]
    df = spark.createDataFrame(rows, RUN)
    assert [tuple(r)[3:5] for r in match.unmatched(df, ["benchmark", "doc_id", "system"], "spans").collect()] == [(9, 10)]
    assert [tuple(r)[3:5] for r in match.unmatched(df, ["benchmark", "doc_id", "system"], "gold").collect()] == [(5, 6)]


def test_over_redaction(spark):
    rows = [("b", "d", "s", True, spans((0, 4, "A")), spans((3, 6, "A"), (9, 10, "A"))), ("b", "e", "s", True, [], spans((1, 2, "A"))), ("b", "f", "s", True, [], [])]
    r = score.over_redaction(spark.createDataFrame(rows, RUN)).first()
    assert (r["n_pred"], r["n_stray"], r["n_negative_docs"], r["n_flagged_docs"], r["negative_fpr"]) == (3, 2, 2, 1, 0.5)


# rewriting

text_and_spans = st.text("ab😀é", max_size=30).flatmap(lambda t: st.tuples(st.just(t), st.lists(st.tuples(st.integers(0, len(t)), st.integers(0, 6)), max_size=5)))


@settings(max_examples=200, deadline=None)
@given(text_and_spans)
def test_splice(case):
    text, pairs = case
    marked = [{"start": a, "end": min(a + n, len(text)), "label": "L", "text": text[a : a + n]} for a, n in pairs]
    new, kept = rewrite.splice_text(text, marked, ["<" + "y" * k + ">" for k in range(len(marked))])
    assert all(new[s["start"] : s["end"]] == s["text"] for s in kept)
    same, _ = rewrite.splice_text(text, marked, [None] * len(marked))
    assert same == text
    stars, _ = rewrite.splice_text(text, marked, ["*" * (s["end"] - s["start"]) for s in marked], clip=True)
    hidden = {i for s in marked for i in range(s["start"], s["end"])}
    assert stars == "".join("*" if i in hidden else c for i, c in enumerate(text))


@settings(max_examples=200, deadline=None)
@given(text_and_spans, st.text("ab😀", max_size=20))
def test_remap(case, other):
    text, pairs = case
    marked = [{"start": a, "end": min(a + n, len(text)), "label": "L", "text": text[a : a + n]} for a, n in pairs]
    assert rewrite.map_spans(text, text, marked) == marked
    assert text == other or all(0 <= s["start"] < s["end"] <= len(other) and other[s["start"] : s["end"]] == s["text"] for s in rewrite.map_spans(text, other, marked))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([f"w{k}" for k in range(40)] + ["é", ",", "\n"]), max_size=60), st.lists(st.tuples(st.integers(0, 59), st.sampled_from(["", "new", "w3 w4"])), max_size=5))
def test_anchored_alignment(words, edits):
    """Its operations make the new text of the old one, in order and without gaps."""
    changed = list(words)
    for at, w in edits:
        if at < len(changed):
            changed[at] = w
    old, new = " ".join(words), " ".join(changed)
    i = j = 0
    for kind, a, b, c, d in rewrite.anchored_alignment(old, new):
        assert (a, c) == (i, j) and (kind != "equal" or old[a:b] == new[c:d] and b > a)
        i, j = b, d
    assert (i, j) == (len(old), len(new))


def test_anchored_alignment_of_a_long_text():
    """Half a million characters with surrogates here and there: spans end up where the rewriting put them."""
    rng = random.Random(3)
    words = [f"word{rng.randrange(5000)}" for _ in range(60_000)]
    text, at = " ".join(words), [0, *itertools.accumulate(len(w) + 1 for w in words)]
    spans = [{"start": at[k], "end": at[k] + len(words[k]), "label": "N", "text": words[k]} for k in sorted(rng.sample(range(60_000), 300))]
    new, kept = rewrite.splice_text(text, spans, ["#" * rng.randrange(1, 20) for _ in spans])
    assert rewrite.map_spans(text, new, spans, rewrite.anchored_alignment) == kept


def test_remap_of_a_replacement():
    moved = rewrite.map_spans("call Ann Lee now", "call Zoe now", [{"start": 5, "end": 12, "label": "N", "text": "Ann Lee"}])
    assert moved[0]["start"] >= 5 and "call Zoe now"[moved[0]["end"] :] == " now"


def test_text_columns(spark):
    df = spark.createDataFrame([("Ann <met> Bob", spans((0, 3, "N"), (2, 6, "X"), (10, 13, "N"))), (None, []), ("plain", None)], f"text string, gold array<{SPAN}>")
    rows = df.select(rewrite.mask_labels(F.col("text"), F.col("gold")).alias("m"), rewrite.redact(F.col("text"), F.col("gold")).alias("r"), rewrite.highlighted(F.col("text"), F.col("gold")).alias("h")).collect()
    assert rows[0]["m"] == "[N] <met> [N]" and rows[0]["r"] == "******et> ***" and rows[0]["h"] == '<mark data-label="N">xxx</mark> &lt;met&gt; <mark data-label="N">xxx</mark>'
    assert rows[1]["m"] is None and rows[2]["m"] == "plain"


# detectors


def test_failed_predictions_are_attempts(spark):
    class Failing:
        name = "fails.on_x"

        def predict(self, text):
            if "x" in text:
                raise ValueError("no")
            return [(0, 1, "L", text[:1], 0.5)]

    docs = spark.createDataFrame([("a", "abc"), ("b", "xyz"), ("c", None)], "doc_id string, text string")
    out = {r["doc_id"]: r for r in detect.run_rows(docs, [Failing()], keep=("doc_id",)).collect()}
    assert out["a"]["ok"] and out["a"]["spans"][0]["score"] == 0.5 and out["a"]["system"] == "fails.on_x"
    assert not out["b"]["ok"] and out["b"]["spans"] is None and out["c"]["spans"] == []


@pytest.mark.parametrize("answer,n", [('{"spans": [{"text": "a"}]}', 1), ('```json\n{"spans": [{"text": "a"}]}\n```', 1), ('Sure: {"spans": []} done', 0), ('{"spans": [{"start": 1, "end": 2, "label": "N", "text": "q\\"x"}, {"start": 3, "en', 1), ("[1]", 0), ("", 0), (None, 0)])
def test_tolerant_parse(answer, n):
    assert len(detect.parse_tolerant(answer).get("spans", [])) == n


def test_locating():
    claims = [{"text": "an", "start": 9, "label": "A"}, {"text": "an", "start": "?"}, "junk", {"text": " "}, {"text": "zz"}, {"text": "an", "start": 4}]
    assert [s[:3] for s in detect.locate_nearest("an ban can", claims)] == [(8, 10, "A"), (0, 2, "OTHER"), (4, 6, "OTHER")]
    tags = [{"identifier_type": "name", "value": "Ann Lee"}, {"identifier_type": "name", "value": "Ann"}, {"value": "absent"}]
    assert [(s["start"], s["end"], s["label"]) for s in detect.locate_first("Ann Lee and Ann", tags)] == [(0, 7, "NAME"), (12, 15, "NAME")]


def test_registry():
    detect.register("svc:a:x", lambda: detect.RegexDetector("a", (("D", "[0-9]"),)))
    detect.register("svc:b:x", lambda: detect.ParsedDetector("b", lambda t: '{"spans": [{"text": "1"}]}'))
    assert [d.name for d in detect.build(["svc_all"])] == ["a", "b"]
    assert detect.build(["svc:b:x"])[0].predict("x1") == [(1, 2, "OTHER", "1", 1.0)]
    with pytest.raises(ValueError):
        detect.build(["nope"])
    with pytest.raises(ValueError):
        detect.build(["svc:a:x", "svc_all"])


# paired


def test_paired(spark):
    o = [("b", "d", "s", True, spans((0, 3, "A"), (5, 7, "B")), spans((0, 1, "A"))), ("b", "odd", "s", True, spans((0, 3, "A")), []), ("b", "only", "s", True, [], [])]
    t = [("b", "d", "s", True, [(0, 4, "A", "new!"), (6, 8, "B", "xx")], spans((7, 9, "B"))), ("b", "odd", "s", True, [], [])]
    pairs = paired.paired_spans(paired.pair_runs(spark.createDataFrame(o, RUN), spark.createDataFrame(t, RUN)))
    rows = {r["idx"]: r for r in pairs.collect()}
    assert set(rows) == {0, 1} and rows[0]["masked"] and not rows[1]["masked"]
    assert (rows[0]["found_o"], rows[0]["found_t"], rows[1]["found_o"], rows[1]["found_t"]) == (True, False, False, True)
    t = {r["benchmark"]: r for r in paired.contingency(pairs, pooled=True).collect()}
    assert tuple(t["POOLED"])[1:] == tuple(t["b"])[1:] == (1, 1, 0, 1, 0)


# reports


def test_merging(spark):
    rows = [("d", 1, None, "p1"), ("d", 2, "g2", None), ("d", 3, "g3", "p3"), ("e", 1, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, f int, gold string, pred string")
    assert sorted(map(tuple, report.merged_runs(df, ["doc_id"], ["gold"], ["pred"], "f").collect())) == [("d", "g2", "p3"), ("e", None, None)]
    assert sorted(map(tuple, report.last_rows(df, ["doc_id"], "f").collect())) == [("d", 3, "g3", "p3"), ("e", 1, None, None)]


def test_macro_mean_and_deltas(spark):
    o = spark.createDataFrame([("s", "a", 0.5), ("s", "b", 0.7), ("t", "a", 0.9)], "system string, benchmark string, f1 double")
    t = spark.createDataFrame([("s", "a", 0.4), ("t", "a", 0.95), ("t", "b", 0.1)], "system string, benchmark string, f1 double")
    assert {r["system"]: (r["coverage"], r["mean"]) for r in report.macro_mean(o, "f1").collect()} == {"s": (2, 0.6), "t": (1, None)}
    cells = report.paired_cells(o, t, "f1", ["system", "benchmark"])
    assert {r["system"]: (r["a"], r["b"]) for r in report.delta_matrix(cells, columns=["a", "b"]).collect()} == {"s": (-0.1, None), "t": (0.05, None)}


def test_extrema_flag_all_ties(spark):
    df = spark.createDataFrame([("s", "a", 0.5), ("t", "a", 0.5 + 1e-12), ("u", "a", 0.1), ("s", "b", 0.3)], "system string, benchmark string, v double")
    best = {(r["system"], r["benchmark"]): r["best"] for r in report.extrema(df, "v", "benchmark").collect()}
    assert best == {("s", "a"): True, ("t", "a"): True, ("u", "a"): False, ("s", "b"): True}
    assert {r["system"] for r in report.extrema(df, "v", "benchmark", True).where("best and benchmark = 'a'").collect()} == {"u"}


def test_kappa(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "x string, y string")
    r = report.kappa(df, "x", "y").first()
    assert (r["n"], r["agree"], r["observed"], r["expected"], r["kappa"]) == (4, 3, 0.75, 0.5, 0.5)
    assert report.kappa(spark.createDataFrame([("a", "a")] * 3, "x string, y string"), "x", "y").first()["kappa"] == 1.0


def test_disagreement_and_ranks(spark):
    rows = [("b", "d", "x", 2, 0, 0), ("b", "d", "y", 0, 1, 1), ("b", "e", "x", 1, 0, 0)]
    df = spark.createDataFrame(rows, "benchmark string, doc_id string, system string, tp bigint, fp bigint, fn bigint")
    assert {r["doc_id"]: (r["n_systems"], r["gap"]) for r in report.disagreement(df).collect()} == {"d": (2, 1.0), "e": (1, 0.0)}
    assert {(r["doc_id"], r["system"]): r["place"] for r in report.ranked(df).collect()} == {("d", "x"): 1, ("d", "y"): 2, ("e", "x"): 1}
    cells = spark.createDataFrame([("x", 0.9, 0.5), ("y", 0.8, 0.6), ("z", 0.1, 0.2)], "system string, original double, changed double")
    assert {tuple(r)[:3] for r in report.rank_preservation(cells).collect()} == {("x", 1, 2), ("y", 2, 1), ("z", 3, 3)} and report.rank_preservation(cells).first()["spearman"] == 0.5


def test_samples(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("s"))
    picked = report.stratified_sample(df, "s", 30, 3, ["id"]).collect()
    assert sorted(r["s"] for r in picked) == ["0"] * 10 + ["1"] * 10 + ["2"] * 10
    assert {r["id"] for r in report.stratified_sample(df.repartition(7), "s", 30, 3, ["id"]).collect()} == {r["id"] for r in picked}
    assert report.seeded_take(df, 7, ["id"]).count() == 7 and [r["id"] for r in report.head(df, 2, ["id"]).collect()] == [0, 1]


def test_run_rows_from_relations(spark):
    attempt = spark.createDataFrame([("b", "d", "s", True), ("b", "d", "t", True), ("b", "e", "s", False)], "benchmark string, doc_id string, system string, ok boolean")
    kind = "idx int, start bigint, end bigint, label string, text string"
    gold = spark.createDataFrame([("b", "d", 1, 5, 6, "A", "y"), ("b", "d", 0, 0, 3, "A", "xxx")], f"benchmark string, doc_id string, {kind}")
    pred = spark.createDataFrame([("b", "d", "s", 0, 0, 3, "A", "xxx"), ("b", "f", "s", 0, 0, 3, "A", "xxx")], f"benchmark string, doc_id string, system string, {kind}")
    rows = {(r["doc_id"], r["system"]): r for r in match.from_relations(attempt, gold, pred).collect()}
    assert set(rows) == {("d", "s"), ("d", "t"), ("e", "s")} and rows["d", "t"]["spans"] == [] and [g["start"] for g in rows["d", "s"]["gold"]] == [0, 5]
    got = {r["system"]: (r["tp"], r["fn"]) for r in score.document_scores(match.from_relations(attempt, gold, pred)).collect()}
    assert got == {"s": (1, 1), "t": (0, 2)}


def test_null_arrays_count_as_empty(spark):
    df = spark.createDataFrame([("b", "d", "s", True, None, None), ("b", "e", "s", True, None, spans((0, 1, "A")))], RUN)
    for mode in match.MODES:
        assert {r["doc_id"]: (r["tp"], r["fp"], r["fn"]) for r in score.document_scores(df, mode).collect()} == {"d": (0, 0, 0), "e": (0, 1, 0)}
    assert match.found_spans(df, ["doc_id"]).collect() == [] and score.document_scores(df.where("false")).collect() == []


def test_indexes_and_reviews(spark):
    df = spark.createDataFrame([("r1", "x", "b", "type", 5), ("r1", "y", "b", "type", 9)], "stem string, system string, benchmark string, mode string, n_docs bigint")
    assert tuple(report.run_index(df).first()) == ("r1", "b", "type", 2, 9)
    sheet = spark.createDataFrame([("1", "y", "none"), ("2", None, "x_masked"), ("3", "Y", "")], "id string, reviewed string, failure string")
    assert [r["id"] for r in report.to_review(sheet).collect()] == ["2"] == [r["id"] for r in report.to_review(sheet, "flagged").collect()]
    assert [r["line"] for r in report.text_table(df.where("system = 'x'"), ["system", "n_docs"]).collect()] == ["x | 5"]
    heat = df.select(report.delta_heat(F.lit(0.01), F.lit(-0.005), F.lit(0.01)).alias("h")).first()["h"]
    assert heat == 0.75
