"""All three capacities of the registered packing constrain."""

from spanloom.llm import packing

T = packing.TOKENS


def pieces(spark, sizes):
    rows = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(sizes)], "doc_id int, text string")
    return sorted((r["doc_id"], r["start_token"], r["n_tokens"], r["bin"]) for r in packing.packed(rows).collect())


def test_default_attention_refuses(spark):
    """Two pieces that fill a bin's tokens exactly, but not under its attention capacity."""
    a, b = T * 5 // 8, T * 3 // 8
    got = pieces(spark, [a, b])
    assert [x[2] for x in got] == [a, b] and len({x[3] for x in got}) == 2


def test_default_attention_splits(spark):
    got = pieces(spark, [T])
    assert sum(x[2] for x in got) == T and got[1][1] == got[0][2]
    assert max(x[2] for x in got) ** 2 <= packing.ATTENTION * T * T < T * T
