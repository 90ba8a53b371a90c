"""Registries, adapters, the transform driver, forced cells, alignment of raters, marks, and batch functions against their plain or JVM forms."""

import json
import pickle

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import adapters, detect, match, report, rewrite, transform
from spanloom.sources import readers, sinks
from spanloom import shared

SPAN = "struct<start:bigint,end:bigint,label:string,text:string>"
DOC = f"doc_id string, text string, gold array<{SPAN}>"


def test_null_labels_are_masked(spark):
    """A labelled place without a label must not stay in clear."""
    df = spark.createDataFrame([("a", "Ann lives", [(0, 3, None, "Ann")]), ("b", "Bob", [(0, 3, "N", None)])], DOC)
    rows = {r["doc_id"]: r for r in df.select("doc_id", rewrite.mask_labels(F.col("text"), F.col("gold")).alias("m"), rewrite.redact(F.col("text"), F.col("gold")).alias("r"), rewrite.highlighted(F.col("text"), F.col("gold")).alias("h"), rewrite.splice("text", "gold", rewrite.surrogates(F.col("gold"), F.col("doc_id"), F.lit("en"), 1))["text"].alias("s")).collect()}
    assert rows["a"]["m"] == "[PHI] lives" and rows["a"]["r"] == "*** lives" and rows["b"]["m"] == "[N]"
    assert rows["a"]["h"] == '<mark data-label="PHI">Ann</mark> lives' and "Ann" not in rows["a"]["s"]


def test_surrogates_in_batches_equal_the_expressions(spark):
    labels = ["EMAIL", "IPADDRESS", "USERNAME", "TELEPHONENUM", "EDAD", "SEXO", "FECHA", "IDCARD", "CITY", "GIVENNAME", None, "street", "BOD"]
    rows = [(k, lang, [(0, 1, x, "") for x in labels]) for k, lang in enumerate(["en", "fr", "de", "es", "nl", "xx", None])] + [(None, "en", [(0, 1, "CITY", "")]), (9, "en", []), (10, "en", None)]
    df = spark.createDataFrame(rows, f"doc_id bigint, lang string, gold array<{SPAN}>")
    for variant in text.VARIANTS:
        kind = lambda s: text.category(s["label"], variant)
        jvm = F.transform("gold", lambda s, i: text.fake_value(kind(s), F.col("lang"), text.stable_number(F.lit(5), F.col("doc_id"), i, kind(s))))
        both = df.select(rewrite.drawn_values(5, variant)("gold", "doc_id", "lang").alias("a"), jvm.alias("b"), text.stable_numbers(6)("gold", "doc_id").alias("c"), F.transform("gold", lambda s, i: text.stable_number(F.lit(6), F.col("doc_id"), i)).alias("d")).collect()
        assert all(r["a"] == r["b"] and (r["c"] or []) == (r["d"] or []) for r in both)


def test_contexts_equal_the_expression(spark):
    df = spark.createDataFrame([("a\nbé😀 SECRET c" * 9, [(0, 1, "L", ""), (6, 12, "L", ""), (100, 120, "L", ""), (3, 3, "L", "")]), ("x", []), (None, [(0, 1, "L", "")])], f"text string, gold array<{SPAN}>")
    jvm = F.transform("gold", lambda s: text.context_window(F.col("text"), s["start"], s["end"]))
    assert all(r["a"] == r["b"] for r in df.select(text.contexts()("text", "gold").alias("a"), jvm.alias("b")).collect())


def test_flags_across_documents(spark):
    """Spans of one document don't meet those of the next in a batch, in order or not, beyond 0 or not."""
    rows = [([(0, 5), (3, 9), (20, 22)], [(4, 8), (0, 2)]), ([(0, 5)], []), ([], [(0, 5)]), ([(4, 6), (0, 9)], [(0, 9), (4, 6), (5, 5)]), ([(0, 1)] * 3, [(0, 1)] * 2), ([(900, 990)], [(-5, 950)])]
    full = lambda pairs: [(a, b, "L", "") for a, b in pairs]
    df = spark.createDataFrame([(k, full(g), full(p)) for k, (g, p) in enumerate(rows)], f"k int, g array<{SPAN}>, p array<{SPAN}>").coalesce(1)
    meets = lambda g, p: p[0] < g[1] and p[1] > g[0]

    def greedy(g, p):
        free, out = list(range(len(p))), []
        for x in g:
            hit = next((i for i in free if meets(x, p[i])), None)
            out.append(hit is not None)
            if hit is not None:
                free.remove(hit)
        return out

    for r in df.select("k", match.overlap_flags("g", "p").alias("o"), match.equal_flags("g", "p").alias("e"), match.greedy_flags("g", "p").alias("c")).collect():
        g, p = rows[r["k"]]
        assert r["o"] == [any(meets(x, y) for y in p) for x in g] and r["e"] == [x in p for x in g] and r["c"] == greedy(g, p)


def test_marks():
    html = rewrite.marked_html("a<b cd ef", [(0, 3, "miss"), (2, 5, "fp"), (4, 6, "tp"), (7, 99, "fp"), (-4, 0, "tp")])
    bare = html.replace('style="background:#CDEBD9"', "").replace('style="background:#F6E7A6"', "").replace('style="background:#F3C9C4"', "").replace(" >", ">")
    assert bare == '<span class="miss">a&lt;</span><span class="fp">b </span><span class="tp">cd</span> <span class="fp">ef</span>'
    assert rewrite.marked_html("", []) == "" and rewrite.marked_html("x", []) == "x"


def test_judged_html(spark):
    df = spark.createDataFrame([("Ann met Bob", [(0, 3, "N", "Ann"), (8, 11, "N", "Bob")], [(0, 2, "N", "An"), (4, 7, "N", "met")]), (None, [], [])], f"text string, gold array<{SPAN}>, spans array<{SPAN}>")
    a, b = (r["h"] for r in df.select(rewrite.judged_html("text", "gold", "spans").alias("h")).collect())
    assert b is None and [x in a for x in ('class="tp"', 'class="fp"', 'class="miss"')] == [True] * 3 and a.startswith('<span class="tp"')


# registries


def test_families():
    detect.register_family("srv", lambda mode, kind: detect.RegexDetector(f"srv_{mode}_{kind}", (("D", "[0-9]"),)), [(m, k) for m in ("MASKED", "OPEN") for k in ("redact", "change")])
    assert detect.build(["srv:OPEN:redact"])[0].name == "srv_OPEN_redact"
    assert [d.name for d in detect.build(["srv_all"])] == ["srv_MASKED_redact", "srv_MASKED_change", "srv_OPEN_redact", "srv_OPEN_change"]
    with pytest.raises(ValueError):
        detect.build(["srv:OPEN:nothing"])


def test_corpora_by_name(spark, tmp_path):
    rows = [("1", "Anna hier", "German", [("Anna", 0, 4, "NAME")]), ("2", "Ann here", "English", [("Ann", 0, 3, "NAME")])]
    path = str(tmp_path / "hub.parquet")
    spark.createDataFrame(rows, "id string, source_text string, language string, privacy_mask array<struct<value:string,start:bigint,end:bigint,label:string>>").write.parquet(path)
    assert [(r["benchmark"], r["doc_id"]) for r in readers.load(spark, "pii_masking_300k_german", path).collect()] == [("pii_masking_300k_german", "pii_validation_1")]
    assert readers.load(spark, "hub", path).count() == 2
    (tmp_path / "t.jsonl").write_text(json.dumps({"doc_id": "d", "text": "Eva", "gold_spans": [{"start": 0, "end": 3, "label": "N", "text": "Eva", "masked": True}]}))
    r = readers.load(spark, "pii_masking_300k_german_transformed", str(tmp_path / "t.jsonl")).first()
    assert (r["benchmark"], r["language"], r["masked"]) == ("pii_masking_300k_german_transformed", "de", [True])
    assert len(readers.corpus_names()) == 14
    readers.register_corpus("mine", "jsonl", language="it")
    (tmp_path / "m.jsonl").write_text('{"id": "a", "text": "x"}')
    assert readers.load(spark, "mine", str(tmp_path / "m.jsonl")).first()["language"] == "it"
    with pytest.raises(ValueError):
        readers.load(spark, "nowhere", path)
    with pytest.raises(ValueError):
        readers.register_corpus("bad", "nothing")
    del readers.CORPORA["mine"]


def test_adapters(spark):
    """Without its package a detector fails on each document, which is no reason to fail the run; with an engine it gives spans."""

    class Entity:
        start, end, entity_type, score = 0, 3, "PERSON", 0.9

    class Analyzer:
        def analyze(self, text, language):
            return [Entity] if text and language == "de" else []

    held = adapters.EntityAnalyzer(language="de", engine=Analyzer())
    assert held.predict("Ann x") == [(0, 3, "PERSON", "Ann", 0.9)] and pickle.loads(pickle.dumps(held)).engine is None
    tagger = adapters.TokenClassifier(engine=lambda t: [{"start": 1, "end": 2, "entity_group": "ID", "score": 0.5}])
    assert tagger.predict("abc") == [(1, 2, "ID", "b", 0.5)]
    with pytest.raises(ValueError):
        adapters.EntityAnalyzer(language="xx")
    docs = spark.createDataFrame([("a", "x"), ("b", None)], "doc_id string, text string")
    out = {r["doc_id"]: r["ok"] for r in detect.run_rows(docs, [adapters.Pipeline()], keep=("doc_id",)).collect()}
    assert out == {"a": False, "b": True} and {"presidio", "obi", "philter", "jsl"} <= set(detect.REGISTRY)


# the transform driver


def test_waits():
    waited = []

    class Service:
        def __init__(self, *answers):
            self.answers = list(answers)

        def transform(self, t):
            a = self.answers.pop(0)
            if isinstance(a, Exception):
                raise a
            return a

    limit, other = RuntimeError("HTTP 429"), ValueError("no")
    assert transform.tried(Service(limit, RuntimeError("Request limit reached"), other, ("new", 2)), "old", sleep=waited.append) == ("new", 2, None)
    assert waited == [10.0, 20.0, 6.0]
    waited.clear()
    assert transform.tried(Service(*[other] * 9), "old", sleep=waited.append) == ("old", 0, "ValueError: no") and waited == [2.0 * k for k in range(1, 9)]
    assert transform.tried(Service(None), "old") == ("old", 0, None)


def test_transform_missing(spark, tmp_path):
    class Shouting:
        """Fails on some texts; notes each call in a folder."""

        def __init__(self, folder, broken):
            self.folder, self.broken = folder, broken

        def transform(self, t):
            with open(f"{self.folder}/calls", "a") as f:
                f.write(t + "\n")
            if self.broken and "Bob" in t:
                raise ValueError("down")
            return (t.replace("Ann", "Maria"), 1) if "Ann" in t else None

    docs = spark.createDataFrame([("a", "so Ann came", [(3, 6, "N", "Ann")]), ("b", "Bob", [(0, 3, "N", "Bob")]), ("c", "none", []), ("d", None, None)], DOC)
    path, calls = str(tmp_path / "out"), tmp_path / "calls"
    assert transform.transform_missing(docs, Shouting(str(tmp_path), True), path, tries=2, sleep=lambda s: None) == 3
    assert sorted(calls.read_text().split("\n"))[1:] == ["Bob", "Bob", "none", "so Ann came"]
    rows = {r["doc_id"]: r for r in readers.read_rewritten(spark, path).collect()}
    assert set(rows) == {"a", "c", "d"} and rows["a"]["text"] == "so Maria came" and [tuple(g) for g in rows["a"]["gold"]] == [(3, 8, "N", "Maria")]
    assert (rows["a"]["meta"]["changed"], rows["a"]["meta"]["n_sensitive"], rows["c"]["meta"]["changed"], rows["d"]["text"]) == (True, 1, False, None)
    assert transform.transform_missing(docs, Shouting(str(tmp_path), False), path, sleep=lambda s: None) == 1
    assert calls.read_text().count("Bob") == 3 and calls.read_text().count("Ann") == 1
    assert transform.transform_missing(docs, Shouting(str(tmp_path), False), path) == 0


# cells, raters, systems


def test_forced_cells(spark, tmp_path):
    kind, path = "system string, corpus string, benchmark string, masked bigint, found bigint, recall_pct double", str(tmp_path / "cells")
    cells = lambda *rows: spark.createDataFrame([(s, "c", "b", 4, n, 25.0 * n) for s, n in rows], kind)
    now = lambda: {r["system"]: r["found"] for r in readers.read_cells(spark, path).collect()}
    assert sinks.write_cells(cells(("x", 1), ("y", 2)), path) == 2
    assert sinks.write_cells(cells(("x", 3), ("z", 4)), path) == 1 and now() == {"x": 1, "y": 2, "z": 4}
    assert sinks.write_cells(cells(("x", 3), ("w", 0)), path, force=True) == 2 and now() == {"x": 3, "y": 2, "z": 4, "w": 0}


def test_raters_are_aligned_by_id(spark):
    sheet = lambda *rows: spark.createDataFrame(rows, "id string, failure string")
    a, b = sheet(("1", "none"), ("2", "x "), ("3", None)), sheet(("3", ""), ("1", "none"), ("2", "y"))
    r = report.rater_kappa(a, b).first()
    assert (r["n"], r["agree"]) == (3, 2)
    for wrong in (sheet(("1", "none"), ("2", "y")), sheet(("1", "none"), ("2", "y"), ("3", ""), ("3", "")), sheet(("1", "none"), ("2", "y"), ("4", ""))):
        with pytest.raises(Exception, match="not rated once"):
            report.rater_kappa(a, wrong).collect()


def test_best_and_all_systems(spark):
    df = spark.createDataFrame([("b", "d", "x", 1, 1, 0), ("b", "d", "y", 2, 0, 0), ("b", "d", "a", 2, 0, 0)], "benchmark string, doc_id string, system string, tp bigint, fp bigint, fn bigint")
    assert [tuple(r)[2:] for r in report.best_systems(df).collect()] == [("a", 1.0)]
    assert sorted(r["system"] for r in report.all_systems(df, df.limit(1)).collect()) == ["a", "x", "y"]
    with pytest.raises(ValueError):
        report.values_of(spark.range(20).select(F.col("id").cast("string").alias("v")), "v", most=10)


def test_summaries_come_back(spark, tmp_path):
    df = spark.createDataFrame([("x", "b", "type", 3, 0.5), ("y", "b", "type", 3, None)], "system string, benchmark string, mode string, n_docs bigint, f1 double")
    sinks.write_summary(df, str(tmp_path / "s"))
    assert sorted((r["system"], r["f1"]) for r in readers.read_summaries(spark, str(tmp_path / "s")).collect()) == [("x", 0.5), ("y", None)]


def test_shared_folder(spark, tmp_path):
    df = shared.written(spark.range(3).toDF("n"), "some")
    path = df._scratch
    assert df.count() == 3 and path.startswith(shared.shared_dir(spark))
    shared.discard(df)
    with pytest.raises(Exception):
        spark.read.parquet(path)
    shared.discard(df, spark.range(1))  # what isn't there, or isn't ours, is left alone

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        @property
        def _jsc(self):
            return self

        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return False

    class Cluster:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Cluster())
