"""The engine's operators as queries over whole tables, each with the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import Z95, bootstrap_half_width, paired_difference, tost_p
from ..functions.text import VARIANTS, category, category_sql, contexts, delta, percent, run_name, run_time, stable_number_sql, verdict, well_formed_sql
from ..operators import paired, report, rewrite, score
from ..operators.detect import answer_spans, spans_of
from ..operators.match import found_spans, from_relations, unmatched
from ..shared import written
from ..sources.readers import response_spans, tagged_spans
from ..streaming.scoring import event_windows
from . import base
from .base import BASE_SQL, CHANGED_SQL, DOCS_SQL, GOLD_SQL, PAIRED_SQL, REDACTED_SQL, averaged_sql, found_sql, ratio_sql, scored_sql, spliced_sql

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
DOC = ["benchmark", "doc_id"]
RUN = [*DOC, "system"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _gold_rows(docs: DataFrame) -> DataFrame:
    return docs.select(*DOC, F.posexplode("gold").alias("idx", "g")).select(*DOC, "idx", "g.*")


@query(f'WITH {DOCS_SQL}, {GOLD_SQL} SELECT d.benchmark, g.doc_id, CAST(g.idx AS INTEGER) AS idx, g.s AS start, g.e AS "end", g.label, g.text FROM gold g JOIN docs d USING (doc_id)')
def span_extract(spark, d):
    return _gold_rows(base.corpus(spark, d))


def _score(mode: str, by: tuple[str, ...]):
    def run(spark, d):
        keys = list(dict.fromkeys([*RUN, *by]))
        return score.micro_average(base.run_scores(spark, d, mode, keys), by, 9)

    return run


for _name, _mode, _by in (("score_type", "type", ("system",)), ("score_strict", "strict", ("system",)), ("score_by_language", "type", ("system", "language")), ("score_by_benchmark", "type", ("system", "benchmark"))):
    QUERIES[_name] = _score(_mode, _by)
    SQL[_name] = f"{BASE_SQL}, {scored_sql(_mode)} {averaged_sql(', '.join(_by))}"


@query(f"{BASE_SQL}, {scored_sql('type')} SELECT benchmark, doc_id, system, tp, fp, fn, gold_chars_leaked, gold_chars_total FROM scored")
def score_documents(spark, d):
    return base.run_scores(spark, d)


@query(f"{BASE_SQL}, k AS (SELECT coalesce(g.system, p.system) AS system, coalesce(g.label, p.label) AS label, coalesce(g.n, 0) AS g, coalesce(p.n, 0) AS p FROM (SELECT doc_id, system, s, e, label, count(*) AS n FROM gold CROSS JOIN systems GROUP BY ALL) g FULL JOIN (SELECT doc_id, system, s, e, label, count(*) AS n FROM pred GROUP BY ALL) p ON g.doc_id = p.doc_id AND g.system = p.system AND g.s = p.s AND g.e = p.e AND g.label = p.label) SELECT *, round({ratio_sql('2 * tp', '2 * tp + fp + fn')}, 9) AS f1 FROM (SELECT system, label, sum(least(g, p))::BIGINT AS tp, sum(p - least(g, p))::BIGINT AS fp, sum(g - least(g, p))::BIGINT AS fn FROM k GROUP BY system, label)")
def score_by_label(spark, d):
    return score.labelled_f1(base.label_counts(spark, d))


_GREEDY = f"""{BASE_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)}, offers AS MATERIALIZED (SELECT a.doc_id, a.system, coalesce(p.ps, []) AS ps FROM attempt a LEFT JOIN (SELECT doc_id, system, list({{'i': idx, 's': s, 'e': e}} ORDER BY idx) AS ps FROM pred GROUP BY ALL) p USING (doc_id, system)),
steps AS (SELECT doc_id, system, -1::BIGINT AS k, []::BIGINT[] AS taken, false AS hit, 0::BIGINT AS size FROM attempt
  UNION ALL SELECT doc_id, system, k + 1, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, pick IS NOT NULL, size FROM (
    SELECT t.doc_id, t.system, t.k, t.taken, g.e - g.s AS size, list_filter(o.ps, lambda x: x.s < g.e AND x.e > g.s AND NOT list_contains(t.taken, x.i))[1].i AS pick FROM steps t JOIN gold g ON g.doc_id = t.doc_id AND g.idx = t.k + 1 JOIN offers o ON o.doc_id = t.doc_id AND o.system = t.system)),
scored AS (SELECT a.benchmark, a.doc_id, a.language, a.system, count(*) FILTER (WHERE hit) AS tp, any_value(len(o.ps)) - count(*) FILTER (WHERE hit) AS fp, count(*) FILTER (WHERE NOT hit AND k >= 0) AS fn, coalesce(sum(size) FILTER (WHERE NOT hit), 0)::BIGINT AS gold_chars_leaked, sum(size)::BIGINT AS gold_chars_total
  FROM attempt a JOIN offers o USING (doc_id, system) JOIN steps USING (doc_id, system) GROUP BY ALL)"""


@query(f"{_GREEDY} {averaged_sql('system')}")
def relaxed_greedy(spark, d):
    return score.micro_average(base.run_scores(spark, d, "relaxed"), ("system",), 9)


@query(f"{BASE_SQL}, hit AS ({found_sql('gold', 'pred')}) SELECT s.system, g.label, count(*) AS n, count(h.idx) AS found, round({ratio_sql('100 * count(h.idx)', 'count(*)')}, 1) AS recall_pct FROM gold g CROSS JOIN systems s LEFT JOIN hit h ON h.doc_id = g.doc_id AND h.idx = g.idx AND h.system = s.system GROUP BY s.system, g.label")
def overlap_recall(spark, d):
    return paired.recall_cells(found_spans(base.runs(spark, d), RUN), ["system", "label"])


@query(f'{BASE_SQL} SELECT d.benchmark, p.doc_id, p.system, p.s AS start, p.e AS "end", p.label, p.text FROM pred p JOIN docs d USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e)')
def false_positive_spans(spark, d):
    return unmatched(base.runs(spark, d), RUN, "spans").select(*RUN, "start", "end", "label", "text")


@query(f'{BASE_SQL} SELECT d.benchmark, g.doc_id, d.system, g.s AS start, g.e AS "end", g.label, g.text FROM gold g JOIN attempt d USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id, system, s, e FROM pred) p ON p.system = d.system AND p.doc_id = g.doc_id AND g.s = p.s AND g.e = p.e WHERE p.doc_id IS NULL')
def missed_spans(spark, d):
    return unmatched(base.runs(spark, d), RUN, "gold").select(*RUN, "start", "end", "label", "text")


@query(
    f"""{BASE_SQL}, n AS (SELECT a.doc_id, a.system, (SELECT count(*) FROM gold g WHERE g.doc_id = a.doc_id) AS n_gold, coalesce(p.n, 0) AS n, coalesce(p.stray, 0) AS stray FROM attempt a
  LEFT JOIN (SELECT doc_id, system, count(*) AS n, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = pred.doc_id AND pred.s < g.e AND pred.e > g.s)) AS stray FROM pred GROUP BY ALL) p ON p.doc_id = a.doc_id AND p.system = a.system)
SELECT *, round({ratio_sql('n_stray', 'n_pred')}, 9) AS stray_rate, round({ratio_sql('n_flagged_docs', 'n_negative_docs')}, 9) AS negative_fpr FROM (
  SELECT system, sum(n)::BIGINT AS n_pred, sum(stray)::BIGINT AS n_stray, count(*) FILTER (WHERE n_gold = 0) AS n_negative_docs, count(*) FILTER (WHERE n_gold = 0 AND n > 0) AS n_flagged_docs FROM n GROUP BY system)"""
)
def over_redaction(spark, d):
    return score.over_redaction(base.runs(spark, d))


_LABELLED = "SELECT doc_id, idx, label, s, e, {} AS new FROM gold"


@query(f"WITH {DOCS_SQL}, {GOLD_SQL}, v AS ({_LABELLED.format(chr(39) + '[' + chr(39) + ' || label || ' + chr(39) + ']' + chr(39))}) {spliced_sql('docs', 'v')}")
def mask_label(spark, d):
    return base.corpus(spark, d).select("doc_id", rewrite.mask_labels(F.col("text"), F.col("gold")).alias("text"))


@query(f"WITH {DOCS_SQL}, {GOLD_SQL}, v AS ({_LABELLED.format('repeat(' + chr(39) + '*' + chr(39) + ', e - s)')}) {spliced_sql('docs', 'v')}")
def redact_stars(spark, d):
    return base.corpus(spark, d).select("doc_id", rewrite.redact(F.col("text"), F.col("gold")).alias("text"))


@query(f"{BASE_SQL}, {CHANGED_SQL} SELECT doc_id, text FROM docs_t")
def surrogate_splice(spark, d):
    return base.changed_texts(spark, d).select("doc_id", F.col("text_t").alias("text"))


@query(f'{BASE_SQL}, {CHANGED_SQL} SELECT d.benchmark, g.doc_id, CAST(g.idx AS INTEGER) AS idx, g.s AS start, g.e AS "end", g.label, g.text FROM gold_t g JOIN docs d USING (doc_id)')
def shifted_spans(spark, d):
    return _gold_rows(base.changed_texts(spark, d).withColumnRenamed("gold_t", "gold"))


@query(f"{BASE_SQL}, {CHANGED_SQL} SELECT d.doc_id, length(d.text)::BIGINT AS orig_len, length(t.text)::BIGINT AS new_len, d.text IS DISTINCT FROM t.text AS changed, (SELECT count(*) FROM gold g WHERE g.doc_id = d.doc_id) AS n_sensitive FROM docs d JOIN docs_t t USING (doc_id)")
def rewrite_meta(spark, d):
    docs = base.both_texts(spark, d)
    return docs.select("doc_id", F.length("text").cast("bigint").alias("orig_len"), F.length("text_t").cast("bigint").alias("new_len"), (~F.col("text").eqNullSafe(F.col("text_t"))).alias("changed"), F.size("gold").cast("bigint").alias("n_sensitive"))


_LABELS = ("EMAIL", "IPADDRESS", "USERNAME", "TELEPHONENUM", "EDAD_SUJETO", "SEXO", "GENDER", "FECHAS", "BOD", "BIRTHDATE", "DATE_OF_BIRTH", "SOCIALNUMBER", "PASSPORT", "ZIP", "CALLE", "CITY", "GIVENNAME", "LASTNAME1", "PATIENT", "OTHER", "")


@query("WITH labels AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in _LABELS) + f"]) AS label UNION SELECT event_type FROM events UNION SELECT p_type FROM part) SELECT label, {', '.join(f'{category_sql('label', v)} AS {v}' for v in VARIANTS)} FROM labels")
def category_map(spark, d):
    labels = spark.createDataFrame([(x,) for x in _LABELS], "label string").union(base.table(spark, d, "events").select("event_type")).union(base.table(spark, d, "part").select("p_type")).distinct()
    return labels.select("label", *[category(F.col("label"), v).alias(v) for v in VARIANTS])


_PREFILL = f"""CASE WHEN regexp_matches(changed, '(?i)x{{4,}}') AND NOT regexp_matches(original, '(?i)x{{4,}}') THEN 'x_masked' WHEN NOT {well_formed_sql(category_sql('label', 'v3'), 'changed')} THEN 'truncated_garbled' ELSE 'none' END"""


@query(f"{PAIRED_SQL} SELECT doc_id, CAST(idx AS INTEGER) AS idx, label, original, changed, failure, CASE WHEN failure = 'none' THEN 'Y' ELSE 'N' END AS valid, CASE WHEN failure = 'truncated_garbled' THEN 'N' ELSE 'Y' END AS type_consistent FROM (SELECT DISTINCT doc_id, idx, label, original, changed, {_PREFILL} AS failure FROM pairs WHERE masked)")
def format_check(spark, d):
    docs = base.both_texts(spark, d)
    each = docs.select("doc_id", F.posexplode(F.arrays_zip("gold", "gold_t")).alias("idx", "z")).select("doc_id", "idx", F.col("z.gold.label").alias("label"), F.col("z.gold.text").alias("original"), F.col("z.gold_t.text").alias("changed"))
    masked = each.where(~F.col("original").eqNullSafe(F.col("changed")))
    return masked.select("*", verdict(F.col("label"), F.col("original"), F.col("changed")).alias("v")).select("doc_id", "idx", "label", "original", "changed", "v.*")


@query(f"{PAIRED_SQL} SELECT benchmark, doc_id, system, CAST(idx AS INTEGER) AS idx, label, original, changed, masked, found_o, found_t FROM pairs")
def masked_pairs(spark, d):
    """Through the join of stored runs of both conditions: detectors run once for each text, what they found is written, a row for each document and condition, and joined by key."""
    runs = written(base.both_runs(spark, d), "runs")
    side = lambda c: runs.where(F.col("condition") == c)
    return paired.flagged_spans(base.flags_of_pairs(paired.pair_runs(side("o"), side("t"), DOC)))


_COUNTS = "count(*) AS n, count(*) FILTER (WHERE found_o) AS found_original, count(*) FILTER (WHERE found_t) AS found_changed, count(*) FILTER (WHERE found_o AND NOT found_t) AS b, count(*) FILTER (WHERE found_t AND NOT found_o) AS c"


@query(f"{PAIRED_SQL} SELECT benchmark, system, {_COUNTS} FROM pairs WHERE masked GROUP BY benchmark, system")
def paired_contingency(spark, d):
    return paired.contingency(base.pair_cells(spark, d), ("benchmark", "system"))


_POOLED = f"{PAIRED_SQL}, t AS (SELECT CASE WHEN grouping(benchmark) = 1 THEN 'POOLED' ELSE benchmark END AS benchmark, {_COUNTS} FROM pairs WHERE masked GROUP BY ROLLUP (benchmark))"


@query(f"{_POOLED} SELECT * FROM t")
def pooled_rollup(spark, d):
    return paired.contingency(base.pair_cells(spark, d), pooled=True)


@query(
    f"""{_POOLED}, s AS (SELECT *, (b - c)::DOUBLE / n AS d, sqrt(greatest(((b + c) - ((b - c) * (b - c))::DOUBLE / n) / (n * n), 0)) AS se, {ratio_sql('(abs(b - c) - 1) * (abs(b - c) - 1)', 'b + c')} AS chi FROM t)
SELECT benchmark, n, found_original, found_changed, b, c, margin, round(d, 9) AS difference, round(d - 1.96 * se, 9) AS low, round(d + 1.96 * se, 9) AS high, round(chi, 9) AS chi2, least(margin + d, margin - d) / greatest(se, 1e-12) > {Z95} AS equivalent
FROM s CROSS JOIN (SELECT unnest([0.01::DOUBLE, 0.02::DOUBLE, 0.03::DOUBLE]) AS margin)"""
)
def paired_statistics(spark, d):
    return paired.statistics(paired.contingency(base.pair_cells(spark, d), pooled=True))


@query()
def tost_p_values(spark, d):
    t = paired.contingency(base.pair_cells(spark, d), pooled=True)
    diff, se = paired_difference(F.col("n"), F.col("b"), F.col("c"))
    return t.select("benchmark", "n", "b", "c", tost_p(F.col("n"), diff, se, F.lit(0.02)).alias("p"))


_EXACT = "EXISTS (SELECT 1 FROM {pred} p WHERE p.doc_id = {gold}.doc_id AND p.system = a.system AND p.s = {gold}.s AND p.e = {gold}.e)"


@query(
    f"""{PAIRED_SQL}, x AS (SELECT a.system, count(*) AS n, count(*) FILTER (WHERE a.found_o) AS found_o, count(*) FILTER (WHERE a.found_t) AS found_t, count(*) FILTER (WHERE {_EXACT.format(pred='pred', gold='g')}) AS exact_o, count(*) FILTER (WHERE {_EXACT.format(pred='pred_t', gold='t')}) AS exact_t
  FROM pairs a JOIN gold g ON g.doc_id = a.doc_id AND g.idx = a.idx JOIN gold_t t ON t.doc_id = a.doc_id AND t.idx = a.idx WHERE a.masked GROUP BY a.system)
SELECT system, n, """
    + ", ".join(f"round({k}_o::DOUBLE / n, 9) AS {p}recall_original, round({k}_t::DOUBLE / n, 9) AS {p}recall_changed, round({ratio_sql(f'{k}_t', f'{k}_o')}, 9) AS {p}retention" for k, p in (("found", ""), ("exact", "exact_")))
    + " FROM x"
)
def retention(spark, d):
    return paired.retention(base.pair_cells(spark, d))


@query(f"{PAIRED_SQL} SELECT label, count(*) AS n, count(*) FILTER (WHERE masked) AS n_masked, round(count(*) FILTER (WHERE masked)::DOUBLE / count(*), 9) AS share FROM pairs GROUP BY label")
def coverage_by_type(spark, d):
    return paired.coverage(base.pair_cells(spark, d))


@query(f"{PAIRED_SQL} SELECT label, count(*) AS n_lost, count(*) FILTER (WHERE length(original) = length(changed)) AS n_same_length, round(count(*)::DOUBLE / (sum(count(*)) OVER ()), 9) AS share FROM pairs WHERE masked AND found_o AND NOT found_t GROUP BY label")
def lost_composition(spark, d):
    return paired.lost_composition(base.pair_cells(spark, d))


@query(f"{PAIRED_SQL} SELECT n_systems, count(*) AS n_spans FROM (SELECT doc_id, idx, count(*) FILTER (WHERE found_o) AS n_systems FROM pairs WHERE masked GROUP BY doc_id, idx) GROUP BY n_systems")
def agreement(spark, d):
    return paired.agreement_sums(base.agreements(spark, d))


_CELLS = f"""{PAIRED_SQL}, {REDACTED_SQL}, hits AS (SELECT 'original' AS condition, * FROM found_o UNION ALL SELECT 'changed', * FROM found_t UNION ALL SELECT 'redacted', * FROM ({found_sql('gold', 'pred_r')}) UNION ALL SELECT 'fake', * FROM ({found_sql('gold_f', 'pred_f')})),
cells AS (SELECT c.condition, s.system, count(*) AS n, count(h.idx) AS found FROM flags f CROSS JOIN (SELECT unnest(['original', 'changed', 'redacted', 'fake']) AS condition) c CROSS JOIN systems s LEFT JOIN hits h ON h.doc_id = f.doc_id AND h.idx = f.idx AND h.system = s.system AND h.condition = c.condition WHERE f.masked GROUP BY ALL)"""


def _cells(spark, d):
    return paired.recall_sums(base.condition_counts(spark, d), ["condition", "system"])


@query(f"{_CELLS} SELECT condition, system, n, found, round(100.0::DOUBLE * found / n, 1) AS recall_pct FROM cells")
def condition_recall(spark, d):
    return _cells(spark, d)


@query()
def condition_recall_intervals(spark, d):
    return _cells(spark, d).select("*", bootstrap_half_width(F.col("found"), F.col("n")).alias("half_width"))


def _run_files(spark, d, name: str) -> DataFrame:
    """Three overlapping run files from a column-only rule: file f holds the documents with (id + f) % 3 > 0."""
    docs = base.table(spark, d, "documents").select("doc_id", "source", "n_chars")
    files = docs.crossJoin(spark.range(3).select(F.col("id").alias("file"))).where("(doc_id + file) % 3 > 0")
    return files.select("doc_id", F.when(F.col("file") != 1, F.col("source")).alias("gold"), (F.col("n_chars") + 1000 * F.col("file")).alias(name), "file")


_FILES = "WITH files AS (SELECT doc_id, CASE WHEN file <> 1 THEN source END AS gold, n_chars + 1000 * file AS spans, file FROM documents CROSS JOIN (SELECT unnest([0, 1, 2]) AS file) WHERE (doc_id + file) % 3 > 0)"


@query(f"{_FILES} SELECT doc_id, arg_min(gold, file) FILTER (WHERE gold IS NOT NULL) AS gold, arg_max(spans, file) AS spans FROM files GROUP BY doc_id")
def run_merge_last_wins(spark, d):
    return report.merged_runs(_run_files(spark, d, "spans"), ["doc_id"], ["gold"], ["spans"], "file")


@query(f"{_FILES} SELECT doc_id, arg_min(gold, file) FILTER (WHERE gold IS NOT NULL) AS gold, arg_min(spans, file) AS spans FROM files GROUP BY doc_id")
def run_dedup_first_wins(spark, d):
    return report.merged_runs(_run_files(spark, d, "spans"), ["doc_id"], ["gold", "spans"], [], "file")


@query(f"{_FILES} SELECT doc_id, arg_max(spans, file) AS spans, max(file)::BIGINT AS file FROM files GROUP BY doc_id")
def keyed_last_row(spark, d):
    return report.last_rows(_run_files(spark, d, "spans").drop("gold"), ["doc_id"], "file")


@query("SELECT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = t.event_type AND e.value > 110)")
def grid_missing(spark, d):
    events = base.table(spark, d, "events")
    return report.missing_cells(events.where("value > 110").select("user_id", "event_type"), events.select("user_id").distinct(), events.select("event_type").distinct())


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti(spark, d):
    return base.table(spark, d, "documents").select("doc_id", "source").join(base.table(spark, d, "labels"), "doc_id", "left_anti")


_F1S = f"{BASE_SQL}, {CHANGED_SQL}, {scored_sql('type')}, {scored_sql('type', 'gold_t', 'pred_t', 'scored_t')}"


def _f1_sql(source: str, by: str) -> str:
    return f"SELECT {by}, {ratio_sql('2 * tp', '2 * tp + fp + fn')} AS f1 FROM (SELECT {by}, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM {source} GROUP BY {by})"


_LANGUAGES = ("de", "en", "es", "fr")  # of the driver's tables, for the SQL alone


@query(f"{_F1S}, c AS (SELECT o.system, o.language, t.f1 - o.f1 AS d FROM ({_f1_sql('scored', 'system, language')}) o JOIN ({_f1_sql('scored_t', 'system, language')}) t USING (system, language)) SELECT system, " + ", ".join(f"round(max(d) FILTER (WHERE language = '{x}'), 9) AS {x}" for x in _LANGUAGES) + " FROM c GROUP BY system")
def delta_matrix(spark, d):
    languages = report.values_of(base.table(spark, d, "documents"), "lang")
    return report.delta_matrix(score.counted_f1(base.both_counts(spark, d), ("system", "language")), over="language", columns=languages)


@query(f"{BASE_SQL}, {scored_sql('type')}, c AS ({_f1_sql('scored', 'system, benchmark')}) SELECT system, count(*) AS coverage, CASE WHEN count(*) = (SELECT count(DISTINCT benchmark) FROM c) THEN round(avg(f1), 9) END AS mean FROM c WHERE NOT (system = 'wide' AND benchmark = 'src0') GROUP BY system")
def macro_mean_guard(spark, d):
    cells = score.micro_average(base.run_scores(spark, d), ("system", "benchmark"))
    return report.macro_mean(cells.withColumn("f1", F.when(~((F.col("system") == "wide") & (F.col("benchmark") == "src0")), F.col("f1"))), "f1")


@query(f"{BASE_SQL}, {scored_sql('type')}, c AS ({_f1_sql('scored', 'system, benchmark')}) SELECT system, benchmark, round(f1, 9) AS f1, abs(f1 - high) < 1e-9 AS best, round((f1 - low) / CASE WHEN high > low THEN high - low ELSE 1 END, 9) AS heat FROM (SELECT *, min(f1) OVER (PARTITION BY benchmark) AS low, max(f1) OVER (PARTITION BY benchmark) AS high FROM c)")
def column_extrema(spark, d):
    cells = score.micro_average(base.run_scores(spark, d), ("system", "benchmark")).select("system", "benchmark", "f1")
    return report.extrema(cells, "f1", "benchmark").withColumn("f1", F.round("f1", 9))


_DOC_F1 = "tp / greatest(1.0::DOUBLE, tp + 0.5::DOUBLE * (fp + fn))"


@query(f"{BASE_SQL}, {scored_sql('type')} SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY f1 DESC, system) AS INTEGER) AS place FROM (SELECT benchmark, doc_id, system, round({_DOC_F1}, 9) AS f1 FROM scored)")
def rank_within_doc(spark, d):
    return report.ranked(base.run_scores(spark, d))


@query(f"{_F1S}, o AS ({_f1_sql('scored', 'system')}), t AS ({_f1_sql('scored_t', 'system')}), r AS (SELECT system, CAST(ro AS INTEGER) AS rank_original, CAST(rt AS INTEGER) AS rank_changed FROM (SELECT system, rank() OVER (ORDER BY f1 DESC) AS ro FROM o) JOIN (SELECT system, rank() OVER (ORDER BY f1 DESC) AS rt FROM t) USING (system)) SELECT *, (SELECT round(corr(rank_original, rank_changed), 9) FROM r) AS spearman FROM r")
def rank_preservation(spark, d):
    return report.rank_preservation(score.counted_f1(base.both_counts(spark, d)))


@query(f"{BASE_SQL}, {scored_sql('type')} SELECT benchmark, doc_id, count(*) AS n_systems, round(max(f) - min(f), 9) AS gap FROM (SELECT benchmark, doc_id, {_DOC_F1} AS f FROM scored) GROUP BY benchmark, doc_id ORDER BY gap DESC, benchmark, doc_id LIMIT 12")
def disagreement_topk(spark, d):
    return report.disagreement(base.run_scores(spark, d))


@query(f"WITH picked AS (SELECT doc_id, source AS benchmark, CAST(row_number() OVER (PARTITION BY source ORDER BY CAST('0x' || substr(md5(concat_ws('|', 20260806, doc_id)), 1, 8) AS BIGINT), doc_id) AS INTEGER) AS pick FROM documents) SELECT * FROM picked WHERE pick <= 10")
def stratified_sample(spark, d):
    docs = base.table(spark, d, "documents").select("doc_id", F.col("source").alias("benchmark"))
    return report.stratified_sample(docs, "benchmark", 200, 20, ["doc_id"])


@query(f"WITH {DOCS_SQL}, {GOLD_SQL} SELECT label, count(*) AS n, round(count(*)::DOUBLE / (sum(count(*)) OVER ()), 9) AS share FROM gold GROUP BY label")
def label_frequency(spark, d):
    return report.frequencies(_gold_rows(base.corpus(spark, d)), "label")


_KAPPA = "WITH r AS (SELECT CAST(quality AS VARCHAR) AS a, CAST(1 - toxic AS VARCHAR) AS b FROM labels), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS agree FROM r), e AS (SELECT sum((SELECT count(*) FROM r WHERE a = v) * (SELECT count(*) FROM r WHERE b = v))::DOUBLE AS e FROM (SELECT a AS v FROM r UNION SELECT b FROM r))"


@query(f"{_KAPPA} SELECT n, agree, round(agree::DOUBLE / n, 9) AS observed, round(e / (n * n), 9) AS expected, round((agree::DOUBLE / n - e / (n * n)) / (1 - e / (n * n)), 9) AS kappa FROM n, e")
def kappa(spark, d):
    """Of two sheets, aligned by document."""
    labels = base.table(spark, d, "labels")
    return report.rater_kappa(labels.select("doc_id", F.col("quality").alias("failure")), labels.select("doc_id", (1 - F.col("toxic")).alias("failure")), key=["doc_id"])


_SHEET = "WITH sheet AS (SELECT d.source AS benchmark, CASE l.quality WHEN 1 THEN 'Y' ELSE ' n' END AS valid, CASE l.toxic WHEN 0 THEN 'y ' ELSE 'N' END AS type_consistent, CASE WHEN d.doc_id % 2 = 0 THEN 'Y' END AS reviewed FROM documents d JOIN labels l USING (doc_id))"


@query(f"{_SHEET} SELECT CASE WHEN grouping(benchmark) = 1 THEN 'ALL' ELSE benchmark END AS benchmark, count(*) AS n, count(*) FILTER (WHERE upper(trim(coalesce(reviewed, ''))) <> 'Y') AS unreviewed, round(count(*) FILTER (WHERE upper(trim(valid)) = 'Y')::DOUBLE / count(*), 9) AS valid_rate, round(count(*) FILTER (WHERE upper(trim(type_consistent)) = 'Y')::DOUBLE / count(*), 9) AS consistent_rate FROM sheet GROUP BY ROLLUP (benchmark)")
def annotation_rates(spark, d):
    both = base.table(spark, d, "documents").select("doc_id", "source").join(base.table(spark, d, "labels"), "doc_id")
    sheet = both.select(F.col("source").alias("benchmark"), F.when(F.col("quality") == 1, "Y").otherwise(" n").alias("valid"), F.when(F.col("toxic") == 0, "y ").otherwise("N").alias("type_consistent"), F.when(F.col("doc_id") % 2 == 0, "Y").alias("reviewed"))
    return report.annotation_rates(sheet)


@query(f"WITH {DOCS_SQL}, {GOLD_SQL} SELECT g.doc_id, CAST(g.idx AS INTEGER) AS idx, g.label, translate(substr(d.text, greatest(s - 40, 0) + 1, s - greatest(s - 40, 0)) || '⟦' || substr(d.text, s + 1, e - s) || '⟧' || substr(d.text, e + 1, 40), chr(10), ' ') AS context FROM gold g JOIN docs d USING (doc_id)")
def span_context(spark, d):
    each = base.corpus(spark, d).select("doc_id", F.posexplode(F.arrays_zip(F.col("gold.label"), contexts()("text", "gold").alias("context"))).alias("idx", "z"))
    return each.select("doc_id", "idx", F.col("z.label").alias("label"), F.col("z.context").alias("context"))


@query(f"WITH {DOCS_SQL}, {GOLD_SQL} SELECT d.benchmark, count(*) AS n_docs, sum(coalesce(g.n, 0))::BIGINT AS n_spans, sum(strlen(d.text))::BIGINT AS n_bytes FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gold GROUP BY doc_id) g USING (doc_id) GROUP BY d.benchmark")
def dataset_manifest(spark, d):
    return report.manifest(base.corpus(spark, d))


_CONV = GOLD_SQL.replace("FROM docs)", "FROM turns)")


@query(f"""WITH turns AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations), {_CONV} SELECT g.doc_id // 1000 AS conv_id, g.doc_id % 1000 AS turn, g.s AS start, g.e AS "end", g.label, g.text FROM gold g""")
def conversation_spans(spark, d):
    rows = base.table(spark, d, "conversations").select("conv_id", "turn", F.explode(spans_of(base.GOLD)(F.col("text"))).alias("s"))
    return rows.select("conv_id", "turn", "s.start", "s.end", "s.label", "s.text")


_TAG = "CASE WHEN regexp_matches(tok, '^[A-Z]') THEN 'B-NAME' WHEN length(tok) < 4 THEN 'I-NAME' ELSE 'O' END"


@query(
    f"""WITH tok AS (SELECT conv_id, turn, unnest(range(0, len(t))) AS i, unnest(t) AS tok FROM (SELECT conv_id, turn, string_split(text, ' ') AS t FROM conversations)),
tags AS (SELECT *, {_TAG} AS tag, (sum(length(tok) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i) - length(tok) - 1)::BIGINT AS s FROM tok),
runs AS (SELECT *, max(CASE WHEN tag <> 'I-NAME' THEN i END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS head FROM tags)
SELECT conv_id, turn, min(s) AS start, max(s + length(tok))::BIGINT AS "end", 'NAME' AS label, string_agg(tok, ' ' ORDER BY i) AS text FROM runs GROUP BY conv_id, turn, head HAVING bool_or(tag = 'B-NAME')"""
)
def bio_islands(spark, d):
    tokens = F.split("text", " ", -1)
    tag = lambda t: F.when(t.rlike("^[A-Z]"), "B-NAME").when(F.length(t) < 4, "I-NAME").otherwise("O")
    rows = base.table(spark, d, "conversations").select("conv_id", "turn", tagged_spans(tokens, F.transform(tokens, tag)).alias("spans"))
    return rows.select("conv_id", "turn", F.explode("spans").alias("s")).select("conv_id", "turn", "s.start", "s.end", "s.label", "s.text")


@query("SELECT doc_id, source || '_250' AS name, strftime(make_timestamp((1700000000 + doc_id) * 1000000), '%Y-%m-%d %H:%M UTC') AS run_at FROM documents")
def run_names(spark, d):
    stem = F.concat(F.col("source"), F.lit("_250_"), (F.lit(1700000000) + F.col("doc_id")).cast("string"))
    return base.table(spark, d, "documents").select("doc_id", run_name(stem).alias("name"), run_time(stem).alias("run_at"))


@query()
def remapped_spans(spark, d):
    """Gold spans of conversation turns, moved onto their masked texts by alignment."""
    turns = base.spread(base.table(spark, d, "conversations"), "conv_id", "turn")
    return turns.select("conv_id", "turn", base.remapped_masks("text").alias("s")).select("conv_id", "turn", F.explode("s").alias("s")).select("conv_id", "turn", "s.*")


@query()
def remapped_documents(spark, d):
    """Gold spans of whole documents, moved onto their changed texts by anchored alignment."""
    made = base.documents(spark, d).select("doc_id", base.remapped_changes("text", "doc_id", "language").alias("s"))
    return made.select("doc_id", F.posexplode("s").alias("idx", "s")).select("doc_id", "idx", "s.*")


@query()
def highlighted_turns(spark, d):
    turns = base.spread(base.table(spark, d, "conversations"), "conv_id", "turn")
    rows = turns.select("conv_id", "turn", "text", base.GOLD_OF(F.col("text")).alias("gold"))
    return rows.select("conv_id", "turn", rewrite.highlighted(F.col("text"), F.col("gold")).alias("html"))


@query()
def judged_documents(spark, d):
    """Documents with the tight detector's hits, false alarms and misses marked."""
    docs = base.corpus(spark, d)
    return docs.select("doc_id", rewrite.judged_html(F.col("text"), F.col("gold"), spans_of(base.SYSTEMS[1])(F.col("text"))).alias("html"))


@query(f"{BASE_SQL}, {scored_sql('type')} {averaged_sql('system')}")
def score_from_relations(spark, d):
    """Through the normalised relations: spans taken apart, stored as rows and put together again."""
    rows = base.runs(spark, d)
    attempt = rows.select(*DOC, "system", "ok")
    gold = _gold_rows(base.corpus(spark, d))
    pred = rows.select(*DOC, "system", F.posexplode("spans").alias("idx", "s")).select(*DOC, "system", "idx", "s.*")
    return score.micro_average(score.document_scores(from_relations(attempt, gold, pred)), ("system",), 9)


@query("WITH c AS (SELECT lang AS system, source || CASE WHEN doc_id % 3 = 1 THEN '_transformed' ELSE '' END AS benchmark, n_chars, doc_id FROM documents), k AS (SELECT system, regexp_replace(benchmark, '_transformed$', '') AS benchmark, arg_max(n_chars, doc_id) FILTER (WHERE benchmark NOT LIKE '%_transformed') AS original, arg_max(n_chars, doc_id) FILTER (WHERE benchmark LIKE '%_transformed') AS changed FROM c GROUP BY ALL) SELECT * FROM k WHERE original IS NOT NULL AND changed IS NOT NULL")
def benchmark_pairing(spark, d):
    docs = base.table(spark, d, "documents")
    name = F.concat("source", F.when(F.col("doc_id") % 3 == 1, "_transformed").otherwise(""))
    return report.paired_benchmarks(docs.select(F.col("lang").alias("system"), name.alias("benchmark"), "n_chars", "doc_id"), "n_chars", "doc_id")


@query("SELECT n_nationkey, coalesce(r_name, CAST(n_regionkey AS VARCHAR)) AS region FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) ON n_regionkey = r_regionkey")
def dimension_lookup(spark, d):
    region = base.table(spark, d, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").cast("string").alias("k"), F.col("r_name").alias("region"))
    return report.named(base.table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("k")), region, "k", "region").drop("k")


@query(f"{BASE_SQL}, {scored_sql('type')}, c AS ({_f1_sql('scored', 'system, benchmark')}), m AS (SELECT system, count(*) AS coverage, CASE WHEN count(*) = (SELECT count(DISTINCT benchmark) FROM c) THEN round(avg(f1), 9) END AS mean FROM c WHERE NOT (system = 'wide' AND benchmark = 'src0') GROUP BY system) SELECT *, CAST(row_number() OVER (ORDER BY mean DESC NULLS LAST, coverage DESC, system) AS INTEGER) AS place FROM m")
def leaderboard(spark, d):
    return report.leaderboard(macro_mean_guard(spark, d))


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 3 <> 0 OR toxic = 1")
def review_filter(spark, d):
    sheet = base.table(spark, d, "labels").select("*", F.when(F.col("doc_id") % 3 == 0, "y").alias("reviewed"), F.when(F.col("toxic") == 1, "toxic").otherwise("none").alias("failure"))
    return report.to_review(sheet).unionByName(report.to_review(sheet, "flagged")).distinct().select("doc_id", "quality", "toxic")


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_counts(spark, d):
    return event_windows(base.table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query(f"{BASE_SQL}, {scored_sql('type')} SELECT benchmark, doc_id, arg_min(system, (-f1, system)) AS system, max(f1) AS f1 FROM (SELECT benchmark, doc_id, system, round({_DOC_F1}, 9) AS f1 FROM scored) GROUP BY benchmark, doc_id")
def best_system(spark, d):
    return report.best_systems(base.run_scores(spark, d))


@query("SELECT source AS system FROM documents UNION SELECT role FROM conversations")
def system_union(spark, d):
    return report.all_systems(base.table(spark, d, "documents").select(F.col("source").alias("system")), base.table(spark, d, "conversations").select(F.col("role").alias("system")))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def head_rows(spark, d):
    return report.head(base.table(spark, d, "documents").select("doc_id", "lang"), 50, ["doc_id"])


@query(f"SELECT doc_id, lang FROM documents ORDER BY {stable_number_sql('7', 'doc_id')}, doc_id LIMIT 50")
def seeded_rows(spark, d):
    return report.seeded_take(base.table(spark, d, "documents").select("doc_id", "lang"), 50, ["doc_id"], seed=7)


@query("SELECT event_id, coalesce(printf('%.1f', v * 100), '—') AS percent, coalesce(printf('%+.3f', v - 0.5), '—') AS delta FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN (event_id % 1000)::DOUBLE / 1000 END AS v FROM events)")
def shown_numbers(spark, d):
    """Of values with three decimals: engines round ties apart."""
    rows = base.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 1000) / 1000).alias("v"))
    return rows.select("event_id", percent(F.col("v")).alias("percent"), delta(F.col("v") - 0.5).alias("delta"))


@query(f'WITH {DOCS_SQL}, {GOLD_SQL} SELECT doc_id, CAST(idx AS INTEGER) AS idx, s AS start, e AS "end", label, text FROM gold')
def located_answers(spark, d):
    """Gold spans as a model would answer them, fenced JSON with hints, read tolerantly and located again."""
    entry = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["text"].alias("text"))
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.transform("gold", entry).alias("spans"))), F.lit("\n```"))
    rows = base.corpus(spark, d).select("doc_id", answer_spans(F.col("text"), answer).alias("s"))
    return rows.select("doc_id", F.posexplode("s").alias("idx", "s")).select("doc_id", "idx", "s.start", "s.end", "s.label", "s.text")


@query(f'WITH {DOCS_SQL}, {GOLD_SQL} SELECT doc_id, CAST(idx AS INTEGER) AS idx, s AS start, e AS "end", label, text FROM gold')
def service_answers(spark, d):
    """Gold spans as a service answers them, with text offsets, read again; documents take turns in the names of the parts."""
    entity = lambda s: F.struct(s["start"].cast("string").alias("start"), s["end"].cast("string").alias("end"), s["label"].alias("type"), s["text"].alias("value"))
    list_ = F.to_json(F.transform("gold", entity))
    name = F.element_at(F.array(*map(F.lit, ("entities", "detections", "phi_entities"))), (F.col("doc_id") % 3 + 1).cast("int"))
    body = F.concat(F.lit('{"'), name, F.lit('": '), list_, F.lit("}"))
    rows = base.corpus(spark, d).select("doc_id", response_spans(body, F.col("text")).alias("s"))
    return rows.select("doc_id", F.posexplode("s").alias("idx", "s")).select("doc_id", "idx", "s.start", "s.end", "s.label", "s.text")
