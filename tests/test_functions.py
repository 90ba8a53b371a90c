import math

import pytest
from pyspark.sql import functions as F

from spanloom.functions import stats, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "label,v1,v2,v3",
    [("EMAIL", "email", "email", "email"), ("ZIP", "ip", "ip", "ip"), ("BOD", "date", "age", "age"), ("BIRTHDAY", "date", "name", "name"), ("SEXO", "sex", "sex", "name"), ("fecha_alta", "date", "date", "date"), ("LICENSE", "idnum", "idnum", "idnum"), ("CALLE", "loc", "loc", "loc"), ("whatever", "name", "name", "name"), (None, "name", "name", "name")],
)
def test_category(spark, label, v1, v2, v3):
    col = F.lit(label).cast("string")
    assert tuple(one(spark, text.category(col, v)) for v in ("v1", "v2", "v3")) == (v1, v2, v3)


@pytest.mark.parametrize("kind", ["email", "ip", "username", "phone", "age", "sex", "date", "idnum", "loc", "name"])
def test_surrogates_are_well_formed(spark, kind):
    rows = spark.range(300).select((F.col("id") * 14317171).alias("h"), F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es", "nl", "xx"))), (F.col("id") % 6 + 1).cast("int")).alias("lang"))
    made = rows.select(text.fake_value(F.lit(kind), F.col("lang"), F.col("h")).alias("v"))
    bad = made.where(~text.well_formed(F.lit(kind), F.col("v")) | F.col("v").isNull())
    assert bad.count() == 0 and made.distinct().count() > 1


@pytest.mark.parametrize(
    "label,original,surrogate,want",
    [("NAME", "Ann", "Bob", ("none", "Y", "Y")), ("PHONE", "555", "XXXXX1", ("x_masked", "N", "Y")), ("ID", "xxxx1", "xxxx2", ("none", "Y", "Y")), ("EMAIL", "a@b.c", "nobody", ("truncated_garbled", "N", "N")), ("DATE", "1/2", "may", ("truncated_garbled", "N", "N")), ("NAME", "Ann", "  ", ("truncated_garbled", "N", "N")), ("NAME", "Ann", "Ž", ("none", "Y", "Y")), ("NAME", "Ann", None, ("truncated_garbled", "N", "N"))],
)
def test_verdict(spark, label, original, surrogate, want):
    assert tuple(one(spark, text.verdict(F.lit(label), F.lit(original), F.lit(surrogate).cast("string")))) == want


def test_small_text_functions(spark):
    assert one(spark, text.context_window(F.lit("a\nb SECRET c"), F.lit(4), F.lit(10))) == "a b ⟦SECRET⟧ c"
    assert one(spark, text.shortened(F.lit("abcdef"), 3)) == "abc…" and one(spark, text.shortened(F.lit("abc"), 3)) == "abc"
    assert one(spark, text.run_name(F.lit("demo_250_1700000000"))) == "demo_250" and one(spark, text.run_name(F.lit("demo_250"))) == "demo_250"
    assert one(spark, text.run_time(F.lit("r_1700000000"))) == "2023-11-14 22:13 UTC" and one(spark, text.run_time(F.lit("r"))) == ""
    assert one(spark, text.percent(F.lit(None).cast("double"))) == "—" and one(spark, text.percent(F.lit(0.1234))) == "12.3" and one(spark, text.delta(F.lit(0.05))) == "+0.050"


def test_paired_statistics_at_known_input(spark):
    n, b, c = (F.lit(x).cast("bigint") for x in (57112, 3300, 2612))
    d, se = stats.paired_difference(n, b, c)
    row = spark.range(1).select(d.alias("d"), se.alias("se"), stats.mcnemar(b, c).alias("chi"), stats.tost_p(n, d, se, F.lit(0.02)).alias("p"), stats.equivalent(n, d, se, F.lit(0.02)).alias("e")).first()
    assert row["d"] * 100 == pytest.approx(1.2047, abs=1e-4)
    assert (row["d"] - 1.96 * row["se"]) * 100 == pytest.approx(0.941, abs=1e-3) and (row["d"] + 1.96 * row["se"]) * 100 == pytest.approx(1.468, abs=1e-3)
    assert row["chi"] == pytest.approx(79.83, abs=0.01) and row["p"] == pytest.approx(1.69e-9, rel=0.01) and row["e"]


def test_statistics_at_the_edges(spark):
    zero = F.lit(0).cast("bigint")
    d, se = stats.paired_difference(zero, zero, zero)
    row = spark.range(1).select(d.alias("d"), se.alias("se"), stats.mcnemar(zero, zero).alias("chi"), stats.tost_p(zero, d, se, F.lit(0.02)).alias("p"), stats.equivalent(zero, d, se, F.lit(0.02)).alias("e"), stats.mcnemar(F.lit(5), F.lit(5)).alias("even")).first()
    assert tuple(row) == (0.0, 0.0, 0.0, 1.0, False, 0.1)


def test_decision_agrees_with_the_p_value(spark):
    rows = spark.range(200).select((F.col("id") * 7 + 100).alias("n"), (F.col("id") % 13).alias("b"), (F.col("id") % 7).alias("c"))
    d, se = stats.paired_difference(F.col("n"), F.col("b"), F.col("c"))
    both = rows.select(stats.equivalent(F.col("n"), d, se, F.lit(0.02)).alias("e"), stats.tost_p(F.col("n"), d, se, F.lit(0.02)).alias("p")).collect()
    assert all(r["e"] == (r["p"] < 0.05) for r in both) and {r["e"] for r in both} == {True, False}


def test_bootstrap(spark):
    rows = spark.createDataFrame([(50, 100), (0, 10), (0, 0), (10, 10)], "found bigint, n bigint").select("n", stats.bootstrap_half_width("found", "n").alias("w")).collect()
    w = [r["w"] for r in rows]
    assert w[0] == pytest.approx(196 * math.sqrt(0.25 / 100), abs=0.6) and w[1:] == [0.0, None, 0.0]
