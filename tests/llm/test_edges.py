"""Every operator over nulls, empty and very long texts, ties, repeated rows, no rows, and columns whose names clash."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import mixing, packing, rank_profiles, repetition, shards, simhash, suffix_tree, voronoi_knn, warc, weak_quality

PROSE = "The river ran past the old mill, and by noon the carts were full. Nobody asked where the grain would go. It was enough that the work was done and the light had held until evening came."
ROWS = [
    (1, PROSE, "en", "a"),
    (1, PROSE, "en", "a"),
    (2, PROSE + " Then rain.", "en", None),
    (3, None, "en", "a"),
    (4, "", None, "b"),
    (None, "word", "fr", "b"),
    (5, "one two " * 20000, "en", "b"),
    (6, " \n\t ", "en", "b"),
    (7, "Äpfel ünd Öl 😀 " * 3, "de", "c"),
    (None, None, None, None),
]
CLASH = ["i", "t", "g", "h", "l", "r", "s", "n", "n_", "key", "repeats", "repeats_", "content_key", "place", "score", "keep", "bin", "slot", "piece", "language", "copies", "group_id", "weight", "amount", "query_id", "c", "d", "x"]
COLUMNS = "doc_id bigint, text string, lang string, source string"


#: Names that only differ in case from ours, or need quoting.
QUOTED = ["Content_Key", "Repeats", "a.b", "tick`s", "DOC ID", "_i", "_T", "c0", "C1", "_repeats"]


def table(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).select("*", *[F.lit(f"#{c}").alias(c) for c in CLASH + QUOTED]).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


PER_DOCUMENT = {
    "suffix_tree": lambda d: suffix_tree.suffix_tree_scores(d, depth=3, min_count=2, divergence=1.0),
    "suffix_tree_in_chunks": lambda d: suffix_tree.suffix_tree_scores(d, depth=3, min_count=2, divergence=1.0, broadcast_rows=0, chunk=100),
    "mixture": lambda d: mixing.mixture(d, {"a": 2.0}),
    "repetition": repetition.repetition,
    "near_duplicates": simhash.near_duplicates,
    "language": rank_profiles.identified,
    "quality": weak_quality.quality_scores,
}
WHOLE_ROWS = {
    "keep_unrepetitive": repetition.keep_unrepetitive,
    "without_near_duplicates": simhash.without_near_duplicates,
    "mixed": lambda d: mixing.mixed(d, {"a": 2.0}),
    "keep_good": weak_quality.keep_good,
    "stored": shards.stored,
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_a_row_for_each_document(docs, none, name):
    out = PER_DOCUMENT[name](docs).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ROWS)
    assert PER_DOCUMENT[name](none).collect() == []


@pytest.mark.parametrize("name", WHOLE_ROWS)
def test_rows_keep_all_columns(docs, none, name):
    out = WHOLE_ROWS[name](docs)
    assert out.columns == docs.columns
    known = {tuple(r) for r in docs.collect()}
    assert all(tuple(r) in known for r in out.collect())
    assert WHOLE_ROWS[name](none).collect() == []
    assert WHOLE_ROWS[name](none).columns == none.columns


@pytest.mark.parametrize("name", WHOLE_ROWS)
def test_names_that_differ_in_case_alone(spark, docs, name):
    """Columns called like the operator's own, in capitals: the exact name is taken, all come back."""
    twice = docs.select("doc_id", "text", "lang", "source", F.lit("#").alias("DOC_ID"), F.lit("#").alias("Text"), F.lit("#").alias("SOURCE"))
    plain = docs.select("doc_id", "text", "lang", "source")
    out = WHOLE_ROWS[name](twice)
    assert out.columns == twice.columns
    assert sorted(str(tuple(r)) for r in out.collect()) == sorted(str((*r, "#", "#", "#")) for r in WHOLE_ROWS[name](plain).collect())
    assert all(PER_DOCUMENT[n](twice).count() == len(ROWS) for n in PER_DOCUMENT if n == "quality")


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_stated_cases(docs):
    scores = by_id(PER_DOCUMENT["suffix_tree"](docs))
    assert scores[3]["log2_prob"] is None and scores[4]["n_symbols"] == 1
    marks = by_id(PER_DOCUMENT["repetition"](docs))
    assert marks[3]["keep"] is False and marks[3]["n_chars"] is None
    assert marks[4]["keep"] and marks[4]["repeated_chars"] == 0
    assert not marks[5]["keep"] and marks[5]["longest_repeat"] == 160000 - 8
    lang = by_id(PER_DOCUMENT["language"](docs))
    assert lang[3]["language"] is None and lang[6]["n_grams"] == 0 and lang[7]["language"] == "de"
    good = by_id(PER_DOCUMENT["quality"](docs))
    assert good[3]["score"] is None and not good[3]["keep"] and good[6]["score"] is None


def test_near_duplicates_of_repeated_rows(docs):
    out = PER_DOCUMENT["near_duplicates"](docs).collect()
    same = [r for r in out if r["doc_id"] == 1]
    assert len(same) == 2 and sum(r["keep"] for r in same) == 1 and {r["group_id"] for r in same} == {1}
    assert all(r["keep"] for r in out if r["doc_id"] in (3, 4, 6, 7))
    kept = [r["doc_id"] for r in simhash.without_near_duplicates(docs).collect()]
    assert sorted(map(str, kept)) == sorted(str(r["doc_id"]) for r in out if r["keep"])


def test_mixed_rows_follow_the_mixture(docs):
    copies = {}
    for r in mixing.mixture(docs, {"a": 2.0}).collect():
        copies.setdefault(str(r["doc_id"]), []).append(r["copies"])
    got = {}
    for r in mixing.mixed(docs, {"a": 2.0}).collect():
        got[str(r["doc_id"])] = got.get(str(r["doc_id"]), 0) + 1
    assert got == {k: sum(v) for k, v in copies.items() if sum(v)}


def test_packing(docs, none):
    out = packing.packed(docs, tokens=512, documents=4).collect()
    assert {r["doc_id"] for r in out} == {1, 2, 5, 7, None}
    assert sum(r["n_tokens"] for r in out if r["doc_id"] == 5) == 40000
    assert packing.packed(none).collect() == []


def test_packing_of_one_row_many_times(spark):
    """Repetitions of a row are spread over groups, whole, and ids keep their value beside nulls."""
    big = 2**60 + 1
    df = spark.createDataFrame([(big, "a b c")] * 500 + [(None, "d e")] * 3, "doc_id bigint, text string")
    out = packing.packed(df, tokens=8, documents=4, group_tokens=300).collect()
    assert sum(r["doc_id"] == big and r["n_tokens"] == 3 for r in out) == 500 and sum(r["doc_id"] is None for r in out) == 3
    assert len({r["pack_group"] for r in out}) > 1
    load = {}
    for r in out:
        load.setdefault((r["pack_group"], r["bin"]), []).append(r)
    assert all(sum(r["n_tokens"] for r in x) <= 8 and sorted(r["slot"] for r in x) == list(range(len(x))) for x in load.values())


def test_pipeline_stages(spark, docs, none):
    """The chain over the edge cases, and over no rows: columns stay, and each stage's rows are rows of the one before."""
    for start in (docs, none):
        rows = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, rows, "").collect()
            assert {tuple(r) for r in made} <= {tuple(r) for r in rows.collect()}, name
            rows = spark.createDataFrame(made, start.schema)
            assert rows.columns == start.columns
        packs = corpus_pipeline.STAGES[-1][1](spark, rows, "").collect()
        tokens = sum(len((r["text"] or "").split()) for r in rows.collect())
        assert sum(r["n_tokens"] for r in packs) == tokens
    assert {r["doc_id"] for r in packs} == set()


def test_vectors(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [3.0, 4.0]), (None, [1.0, 0.0]), (3, None), (4, []), (5, [1.0]), (6, [float("nan"), 0.0]), (7, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in ("i", "v", "r", "d", "cell", "rank", "q", "a.b", "Embedding", "c0")])
    out = voronoi_knn.neighbours(df, k=10).collect()
    assert len(out) == 4 * 3
    assert [(r["neighbor_id"], r["distance"]) for r in sorted((r for r in out if r["query_id"] == 2), key=lambda r: r["rank"])] == [(None, 20**0.5), (1, 5.0), (1, 5.0)]
    assert voronoi_knn.neighbours(df.where("false")).collect() == []


def test_pages(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, None), (3, "", ""), (None, "line\nbreak", "é" * 2_000_000), (1, "http://a/", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").select("*", *[F.lit("z").alias(c) for c in ("file", "headers", "URL", "a.b", "i")])
    out = warc.round_trip(df).collect()
    assert sorted(str((r["page_id"], r["url"], r["html"])) for r in out) == sorted(map(str, rows))
    assert {(r["digest"], r["status"]) for r in out} == {("ok", "ok")}
    assert warc.round_trip(df.where("false")).collect() == []
