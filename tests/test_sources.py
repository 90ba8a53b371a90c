import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators.score import document_scores, micro_average
from spanloom.sources import readers, sinks
from spanloom.streaming.scoring import RUN_ROW, event_windows, score_stream, scored_so_far


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def bare(spans):
    return [tuple(s)[:3] for s in spans]


def docs_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_jsonl(spark, tmp_path):
    rows = [{"id": "a", "text": "Ann", "phi_spans": [{"start": 0, "end": 3}]}, {"id": "", "query_id": "q", "text": "t", "hard_negative": True}, {"text": "z"}]
    got = docs_of(readers.load(spark, "jsonl", put(tmp_path / "a.jsonl", "\n".join(map(json.dumps, rows)))))
    assert set(got) == {"a", "q", "None"} and tuple(got["a"]["gold"][0]) == (0, 3, "PHI", "") and got["q"]["hard_negative"] and got["None"]["gold"] == []
    with pytest.raises(ValueError):
        readers.load(spark, "nope", "x")


def test_standoff(spark, tmp_path):
    put(tmp_path / "brat/d1.txt", "Ana vive en Madrid 😀 hoy")
    put(tmp_path / "brat/d1.ann", "T1\tNOMBRE 0 3\tAna\n#1\tnote\tx\nT2\tLUGAR 4 8;12 18\tvive Madrid\nT3\tBROKEN\n")
    put(tmp_path / "brat/d2.txt", "nada")
    got = docs_of(readers.read_standoff(spark, str(tmp_path / "absent"), str(tmp_path / "brat")))
    assert bare(got["d1"]["gold"]) == [(0, 3, "NOMBRE"), (4, 18, "LUGAR")] and got["d2"]["gold"] == []
    with pytest.raises(FileNotFoundError):
        readers.read_standoff(spark, str(tmp_path / "absent"))


def test_tagged(spark, tmp_path):
    lines = ["# id one", "Ann _ _ B-PER", "Lee _ _ I-PER", "x _ _ I-LOC", "short line", "", "Rome _ _ B-LOC", "Oslo _ _ B-LOC", "", "# id two", "hi _ _ O"]
    got = docs_of(readers.read_tagged(spark, put(tmp_path / "t.conll", "\n".join(lines) + "\n")))
    one = got["mc2_en_test_one"]
    assert one["text"] == "Ann Lee x Rome Oslo" and bare(one["gold"]) == [(0, 7, "PER"), (10, 14, "LOC"), (15, 19, "LOC")]
    assert all(one["text"][s["start"] : s["end"]] == s["text"] for s in one["gold"]) and got["mc2_en_test_two"]["gold"] == []


def test_tagged_path():
    assert readers.tagged_path("data/", "de", "dev") == "data/DE-German/de_dev.conll"
    with pytest.raises(ValueError):
        readers.tagged_path("data", "xx", "dev")


def test_blocks(spark, tmp_path):
    text = '===QUERY===\nAnn met Ann\n===PHI_TAGS===\n{"identifier_type": "name", "value": "Ann"}\nnot json\n{"identifier_type": "name", "value": "Ann"}\n{"value": "Zed"}\n===QUERY===\nno tags here\n===QUERY===\nnothing\n===PHI_TAGS===\n===QUERY===\nunfinished\n'
    got = [(r["text"], bare(r["gold"])) for r in readers.read_blocks(spark, put(tmp_path / "b.txt", text)).orderBy("doc_id").collect()]
    assert got == [("Ann met Ann", [(0, 3, "NAME"), (8, 11, "NAME")]), ("no tags here", []), ("nothing", [])]


def test_hub(spark):
    kind = "id string, source_text string, language string, privacy_mask array<struct<value:string,start:string,end:string,label:string>>"
    rows = [("1", "call 555", "en", [(None, "5", "8", "TEL"), ("x", "?", "1", "TEL"), ("y", "0", "1", None)]), ("2", None, "en", None), ("3", "non", "fr", [])]
    got = docs_of(readers.hub_documents(spark.createDataFrame(rows, kind), "en"))
    assert set(got) == {"pii_validation_1", "pii_validation_2"} and tuple(got["pii_validation_1"]["gold"][0]) == (5, 8, "TEL", "555") and got["pii_validation_2"]["text"] == ""


def test_rewritten_last_row_wins(spark, tmp_path):
    rows = [{"doc_id": "a", "text": "old", "gold_spans": []}, {"doc_id": "b", "text": "b"}, {"doc_id": "a", "text": "new", "gold_spans": [{"start": 0, "end": 3, "label": "N", "text": "new", "masked": True}], "meta": {"orig_len": 3}}]
    got = docs_of(readers.read_rewritten(spark, put(tmp_path / "r.jsonl", "\n".join(map(json.dumps, rows)))))
    assert got["a"]["text"] == "new" and got["a"]["masked"] == [True] and got["b"]["gold"] == []


def span(a, b):
    return {"start": a, "end": b, "label": "N", "text": "x", "score": 1.0}


def test_runs(spark, tmp_path):
    one = [{"doc_id": "a", "gold_n": 0, "gold_spans": [], "predictions": {"m.1": {"spans": [span(0, 1)]}}}, {"doc_id": None}]
    two = [{"doc_id": "a", "gold_n": 1, "gold_spans": [span(0, 1)], "predictions": {"m.1": {"spans": [span(5, 6)]}, "n": {"spans": []}}}]
    put(tmp_path / "r/run1.jsonl", "\n".join(map(json.dumps, one)) + "\n\n{broken\n")
    put(tmp_path / "r/run2.jsonl", "\n".join(map(json.dumps, two)))
    put(tmp_path / "r/run3_relaxed.jsonl", json.dumps(two[0]))
    runs = readers.read_runs(spark, str(tmp_path / "r"))
    last = {r["system"]: r for r in readers.first_or_last(runs).collect()}
    first = {r["system"]: r for r in readers.first_or_last(runs, "first").collect()}
    assert set(last) == {"m.1", "n"} and last["m.1"]["spans"][0]["start"] == 5 and first["m.1"]["spans"][0]["start"] == 0
    assert all(bare(r["gold"]) == [(0, 1, "N")] for r in [*last.values(), *first.values()])
    scored = {r["system"]: r["tp"] for r in document_scores(readers.first_or_last(runs, "first"), keys=("doc_id", "system")).collect()}
    assert scored == {"m.1": 1, "n": 0}
    sinks.write_runs(readers.first_or_last(runs), str(tmp_path / "out"), include_text=True)
    again = {r["system"]: r for r in readers.read_runs(spark, str(tmp_path / "out")).collect()}
    assert again["m.1"]["spans"][0]["start"] == 5 and again["n"]["spans"] == [] and bare(again["n"]["gold"]) == [(0, 1, "N")]


def test_summaries_and_cells(spark, tmp_path):
    put(tmp_path / "s/a_250.summary.json", json.dumps([{"system": "x", "f1": 0.5, "n_docs": 3}, {"system": "y", "f1": 0.1}]))
    put(tmp_path / "s/b.summary.json", "{oops")
    put(tmp_path / "s/c.summary.json", "[]")
    assert sorted((r["system"], r["stem"]) for r in readers.read_summaries(spark, str(tmp_path / "s")).collect()) == [("x", "a_250"), ("y", "a_250")]
    put(tmp_path / "c/x.json", json.dumps({"system": "x", "corpus": "fake", "benchmark": "b", "masked": 4, "found": 1, "recall_pct": 25.0}))
    assert readers.read_cells(spark, str(tmp_path / "c")).first()["recall_pct"] == 25.0


def test_sheet_keeps_white_space(spark, tmp_path):
    cells = [" a", "a ", "\n a", "a\n", "\r", "\ta\t", 'a,b\n"c"\n', "\x01", "a\r\nb", "\u00a0"]
    sinks.write_sheet(spark.createDataFrame([(str(k), x) for k, x in enumerate(cells)], "id string, original string"), str(tmp_path / "sheet"))
    got = {int(r["id"]): r["original"] for r in readers.read_sheet(spark, str(tmp_path / "sheet")).collect()}
    assert [got[k] for k in range(len(cells))] == cells


def test_sheet_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi", ok\nnext', "")], "id string, original string, valid string")
    sinks.write_sheet(df, str(tmp_path / "sheet"))
    r = readers.read_sheet(spark, str(tmp_path / "sheet")).first()
    assert tuple(r.asDict()) == readers.SHEET and r["original"] == 'say "hi", ok\nnext' and r["notes"] == ""


def test_responses(spark):
    body = json.dumps({"entities": [], "detections": [{"start": 0, "end": 3, "type": "N"}, {"start": "x", "end": 1}, {"start": 4, "end": 5, "label": "", "value": "v", "score": 0.2}]})
    got = spark.createDataFrame([(body, "Ann b")], "body string, text string").select(readers.response_spans(F.col("body"), F.col("text")).alias("s")).first()["s"]
    assert [tuple(s) for s in got] == [(0, 3, "N", "Ann", 1.0), (4, 5, "PHI", "v", 0.2)]
    found = spark.createDataFrame([("a 555",)], "text string").select(readers.substring_spans(F.col("text"), {"555": "TEL", "no": "X"}).alias("s")).first()["s"]
    assert bare(found) == [(2, 5, "TEL")]


def test_appending_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "append")
    rows = lambda *ids: spark.createDataFrame([(i, "t") for i in ids], "doc_id string, text string")
    assert sinks.append_missing(rows("a", "b"), path, ["doc_id"]) == 2
    assert sinks.append_missing(rows("b", "c"), path, ["doc_id"]) == 1
    assert sorted(r["doc_id"] for r in spark.read.json(path).collect()) == ["a", "b", "c"]


def test_export_and_publish(spark, tmp_path):
    kind = "benchmark string, doc_id string, text string, gold array<struct<start:bigint,end:bigint,label:string,text:string>>"
    docs = spark.createDataFrame([("a", "1", "é", [(0, 1, "N", "é")]), ("a", "2", "xy", []), ("b", "3", "z", [])], kind)
    expected = spark.createDataFrame([("a", 2), ("b", 5)], "benchmark string, n_docs bigint")
    made = {r["benchmark"]: tuple(r)[1:] for r in sinks.export_datasets(docs, str(tmp_path / "x"), expected).collect()}
    assert made == {"a": (2, 1, 4, True), "b": (1, 0, 1, False)} and spark.read.json(str(tmp_path / "x")).count() == 3
    sinks.publish(expected, docs, str(tmp_path / "p"), ["a"])
    assert {r["benchmark"] for r in spark.read.json(str(tmp_path / "p/samples")).collect()} == {"a"}


def test_stream(spark, tmp_path):
    row = lambda i, hit: (("b", str(i), "s", True, [(0, 2, "N", "xx")], [(0, 2 if hit else 1, "N", "x", 1.0)]))
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k in range(2):
        spark.createDataFrame([row(k * 2, True), row(k * 2 + 1, False)], RUN_ROW).write.mode("append").json(source)
        score_stream(spark, source, target, check).awaitTermination()
        r = scored_so_far(spark, target).first()
        assert (r["n_docs"], r["tp"], r["fn"]) == (2 * k + 2, k + 1, k + 1)
    assert micro_average(document_scores(spark.read.schema(RUN_ROW).json(source))).first()["f1"] == r["f1"]


def test_event_windows(spark, sf):
    out = event_windows(spark.read.parquet(f"{sf}/events.parquet"))
    assert out.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
