"""Scores of stored runs, whose bounds and labels (as numbers) stand in goldens.txt: a line for each document, labelled spans before the slash and predictions after it."""

import os

import pytest
from pyspark.sql import functions as F

from spanloom.operators import match, score

SPAN = "struct<start:bigint,end:bigint,label:string,text:string>"
RUN = f"benchmark string, doc_id string, system string, ok boolean, gold array<{SPAN}>, spans array<{SPAN}>"
#: tp, fp, fn and leaked characters by mode, and labelled spans that any prediction overlaps.
WANTED = {
    "gemma": {"type": (72, 26, 5, 73), "strict": (42, 56, 35, 492), "relaxed": (76, 22, 1, 13), "found": 76},
    "qwen": {"type": (49, 77, 28, 396), "strict": (24, 102, 53, 722), "relaxed": (75, 51, 2, 30), "found": 75},
    "deepseek": {"type": (28, 11, 49, 672), "strict": (17, 22, 60, 799), "relaxed": (32, 7, 45, 619), "found": 32},
    "fifty": {"type": (13, 3, 78, 825), "strict": (0, 16, 91, 980), "relaxed": (16, 0, 75, 807), "found": 20},
    "thinking": {"type": (41, 18, 47, 737), "strict": (0, 59, 88, 1368), "relaxed": (42, 17, 46, 700), "found": 42},
}


def parsed(side):
    out = []
    for part in side.split():
        where, _, label = part.partition(":")
        start, size = map(int, where.split("+"))
        out.append((start, start + size, label, ""))
    return out


@pytest.fixture(scope="module")
def runs(spark):
    rows, name = [], ""
    with open(os.path.join(os.path.dirname(__file__), "goldens.txt")) as f:
        for k, line in enumerate(f):
            if line.startswith("run "):
                name = line.split()[1]
            else:
                gold, _, pred = line.partition("/")
                rows.append(("b", str(k), name, True, parsed(gold), parsed(pred)))
    return spark.createDataFrame(rows, RUN).repartition(4)


@pytest.mark.parametrize("mode", match.MODES)
def test_stored_scores(runs, mode):
    got = {r["system"]: (r["tp"], r["fp"], r["fn"], r["gold_chars_leaked"]) for r in score.micro_average(score.document_scores(runs, mode)).collect()}
    assert got == {name: w[mode] for name, w in WANTED.items()}


def test_overlap_is_not_one_to_one(runs):
    """Of the four long documents 20 spans are overlapped, but only 16 can have a prediction of their own."""
    found = match.found_spans(runs, ["doc_id", "system"]).groupBy("system").agg(F.count_if("found").alias("n")).collect()
    assert {r["system"]: r["n"] for r in found} == {name: w["found"] for name, w in WANTED.items()}
