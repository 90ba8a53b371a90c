"""Readers of labelled corpora and stored runs: rows of benchmark, doc_id, language, text and gold (see ``schema.DOCUMENT``)."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.udf import arrow_column
from ..operators.detect import locate_first
from ..schema import PREDICTED, SPAN

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("text", pa.string())]))


def _span(start: Column, end: Column, label: Column, text: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), label.cast("string").alias("label"), text.cast("string").alias("text"))


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _piece(text: Column, start: Column, end: Column) -> Column:
    return text.substr((start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def read_jsonl(spark: SparkSession, path: str, benchmark: str = "jsonl", language: str = "en") -> DataFrame:
    """A JSON object a line: id (or query_id; "None" without either), text, phi_spans, hard_negative. Spans' label is PHI and their text "" where missing."""
    rows = spark.read.schema(f"id string, query_id string, text string, phi_spans array<{SPAN}>, hard_negative boolean").json(path)
    ident = F.coalesce(F.nullif("id", F.lit("")), F.col("query_id"), F.lit("None"))
    gold = F.transform(F.coalesce("phi_spans", _none()), lambda s: _span(s["start"], s["end"], F.coalesce(s["label"], F.lit("PHI")), F.coalesce(s["text"], F.lit(""))))
    return rows.select(F.lit(benchmark).alias("benchmark"), ident.alias("doc_id"), F.lit(language).alias("language"), "text", gold.alias("gold"), F.coalesce("hard_negative", F.lit(False)).alias("hard_negative"))


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def read_standoff(spark: SparkSession, *folders: str, benchmark: str = "standoff", language: str = "es") -> DataFrame:
    """Texts and annotations <id>.txt, <id>.ann of the first folder that exists. Lines T<n>, label with offsets, surface; a discontiguous span becomes its hull; a text without annotations has no spans."""
    folder = next((f for f in folders if _exists(spark, f)), None)
    if folder is None:
        raise FileNotFoundError(", ".join(folders))

    def files(kind: str) -> DataFrame:
        return spark.read.option("pathGlobFilter", f"*.{kind}").text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*)\.{kind}$", 1).alias("doc_id"), F.col("value").alias(kind))

    lines = F.transform(F.filter(F.split(F.col("ann"), "\r?\n"), lambda x: x.startswith("T")), lambda x: F.split(x, "\t", 3))
    lines = F.transform(F.filter(lines, lambda p: F.size(p) >= 3), lambda p: F.struct(F.split(F.trim(p[1]), r"\s+").alias("where"), p[2].alias("text")))
    gold = F.transform(F.filter(lines, lambda p: F.size(p["where"]) >= 3), lambda p: _span(p["where"][1], F.element_at(p["where"], -1), p["where"][0], p["text"]))
    both = files("txt").join(files("ann"), "doc_id", "left")
    return both.select(F.lit(benchmark).alias("benchmark"), "doc_id", F.lit(language).alias("language"), F.col("txt").alias("text"), F.coalesce(gold, _none()).alias("gold"))


def bio_spans(tokens: list[str], tags: list[str]) -> list[dict]:
    """Spans of B-X and the I-X right after it, in the tokens joined by single spaces; an I-X without its head is ignored."""
    out: list[dict] = []
    at, kind = 0, None
    for token, tag in zip(tokens, tags):
        mark, _, label = (tag or "").partition("-")
        if mark == "B" and label:
            out.append({"start": at, "end": at + len(token), "label": label, "text": token})
            kind = label
        elif mark == "I" and kind is not None and label == kind:
            out[-1]["end"] = at + len(token)
            out[-1]["text"] += " " + token
        else:
            kind = None
        at += len(token) + 1
    return out


@arrow_column(f"array<{SPAN}>", once=True)
def tagged_spans(tokens: pa.Array, tags: pa.Array) -> pa.Array:
    """Column form of ``bio_spans``."""
    return pa.array([bio_spans(a or [], b or []) for a, b in zip(tokens.to_pylist(), tags.to_pylist())], _SPANS)


#: Languages of the token-tagged corpus, by code.
LANGUAGES = dict(x.split(":") for x in "bn:Bangla de:German en:English es:Spanish fa:Farsi fr:French hi:Hindi it:Italian pt:Portuguese sv:Swedish uk:Ukrainian zh:Chinese".split())


def tagged_path(root: str, language: str, split: str) -> str:
    """The file of a language and split under a corpus folder."""
    if language not in LANGUAGES:
        raise ValueError(f"unknown language {language!r}; known: {', '.join(LANGUAGES)}")
    return f"{root.rstrip('/')}/{language.upper()}-{LANGUAGES[language]}/{language}_{split}.conll"


def read_tagged(spark: SparkSession, path: str, language: str = "en", split: str = "test", benchmark: str = "tagged") -> DataFrame:
    """Token lines under headers "# id <name>": the first column is the token, the last of four or more its tag; shorter lines are left out. Files are split at the headers, so large ones are read in parallel."""
    records = spark.read.option("lineSep", "# id ").text(path).where("trim(value) <> ''")
    lines = F.split("value", "\r?\n")
    rows = F.filter(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.split(F.trim(x), r"\s+")), lambda p: F.size(p) >= 4)
    parts = records.select(F.concat(F.lit(f"mc2_{language}_{split}_"), F.trim(F.element_at(lines, 1))).alias("doc_id"), F.transform(rows, lambda p: p[0]).alias("tokens"), F.transform(rows, lambda p: F.element_at(p, -1)).alias("tags"))
    return parts.select(F.lit(benchmark).alias("benchmark"), "doc_id", F.lit(language).alias("language"), F.array_join("tokens", " ").alias("text"), tagged_spans("tokens", "tags").alias("gold"))


@arrow_column(f"array<{SPAN}>")
def _located(text: pa.Array, lines: pa.Array) -> pa.Array:
    out = []
    for t, group in zip(text.to_pylist(), lines.to_pylist()):
        tags = []
        for line in group or []:
            try:
                tag = json.loads(line)
            except ValueError:
                continue
            if isinstance(tag, dict):
                tags.append(tag)
        out.append(locate_first(t or "", tags))
    return pa.array(out, _SPANS)


def read_blocks(spark: SparkSession, path: str, benchmark: str = "blocks", language: str = "en") -> DataFrame:
    """Blocks of a query, a tags mark and a JSON tag a line; each tag's value is located in the query. Bad tag lines are skipped; a last query without the mark is left out, as an unfinished one. One task a file."""
    files = spark.read.text(path, wholetext=True)
    blocks = files.select(F.col("_metadata.file_name").alias("f"), F.posexplode(F.split("value", r"(?m)^[ \t]*===QUERY===[ \t]*\r?$")).alias("n", "b"), F.size(F.split("value", r"(?m)^[ \t]*===QUERY===[ \t]*\r?$")).alias("size"))
    parts = F.split("b", r"(?m)^[ \t]*===PHI_TAGS===[ \t]*\r?$", 2)
    rows = blocks.where("n > 0").select("f", "n", parts.alias("p"), (F.col("n") == F.col("size") - 1).alias("last")).where("size(p) > 1 or not last")
    text = F.regexp_replace(F.regexp_replace(F.element_at("p", 1), r"^[\r\n]+", ""), r"\s+$", "")
    lines = F.filter(F.split(F.coalesce(F.try_element_at("p", F.lit(2)), F.lit("")), "\r?\n"), lambda x: F.trim(x) != "")
    made = rows.select(F.concat_ws("_", F.regexp_replace("f", r"\.[^.]*$", ""), F.col("n").cast("string")).alias("doc_id"), text.alias("text"), lines.alias("lines"))
    gold = made.select("doc_id", "text", _located("text", "lines").alias("gold"))
    return gold.select(F.lit(benchmark).alias("benchmark"), "doc_id", F.lit(language).alias("language"), "text", "gold", (F.size("gold") == 0).alias("hard_negative"))


def hub_documents(rows: DataFrame, language: str | None = None, split: str = "validation", benchmark: str = "hub") -> DataFrame:
    """A hub table (id, source_text, language, privacy_mask): filtered by language, spans without readable bounds or label left out one by one, their text the value or else the slice."""
    if language is not None:
        rows = rows.where(F.col("language") == language)
    text = F.coalesce("source_text", F.lit(""))
    mask = F.filter(F.coalesce("privacy_mask", F.array().cast(rows.schema["privacy_mask"].dataType)), lambda m: m["start"].try_cast("bigint").isNotNull() & m["end"].try_cast("bigint").isNotNull() & m["label"].isNotNull())
    gold = F.transform(mask, lambda m: _span(m["start"], m["end"], m["label"], F.coalesce(m["value"].cast("string"), _piece(text, m["start"].cast("bigint"), m["end"].cast("bigint")))))
    ident = F.coalesce(F.col("id").cast("string"), F.monotonically_increasing_id().cast("string"))
    return rows.select(F.lit(benchmark).alias("benchmark"), F.concat(F.lit(f"pii_{split}_"), ident).alias("doc_id"), "language", text.alias("text"), gold.alias("gold"))


REWRITTEN = f"doc_id string, text string, gold_spans array<struct<start:bigint,end:bigint,label:string,text:string,masked:boolean>>, meta struct<orig_len:bigint,new_len:bigint,n_sensitive:bigint,changed:boolean,sdk_error:string,mode:string,n_masked:bigint>"


def ordered(rows: DataFrame, name: str = "line") -> DataFrame:
    """rows of a file scan with their order by file, block and line."""
    return rows.withColumn(name, F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))


def read_rewritten(spark: SparkSession, path: str, benchmark: str = "rewritten", language: str = "en") -> DataFrame:
    """A rewritten corpus, a JSON object a line; of rows with the same id the last."""
    rows = ordered(spark.read.schema(REWRITTEN).json(path)).where("doc_id is not null")
    # a column at a time: what isn't asked for, texts above all, is neither parsed nor shuffled
    last = rows.groupBy("doc_id").agg(*[F.max_by(c, "line").alias(c) for c in ("text", "gold_spans", "meta")])
    bare = F.transform(F.coalesce("gold_spans", F.array().cast(rows.schema["gold_spans"].dataType)), lambda s: _span(s["start"], s["end"], s["label"], s["text"]))
    flags = F.transform("gold_spans", lambda s: F.coalesce(s["masked"], F.lit(False)))
    return last.select(F.lit(benchmark).alias("benchmark"), "doc_id", F.lit(language).alias("language"), "text", bare.alias("gold"), flags.alias("masked"), "meta")


SCORE = "struct<tp:bigint,fp:bigint,fn:bigint,gold_chars_leaked:bigint,gold_chars_total:bigint>"
RUN = f"doc_id string, gold_n bigint, text string, gold_spans array<{SPAN}>, predictions map<string,struct<spans:array<{PREDICTED}>,score:{SCORE}>>"


def read_runs(spark: SparkSession, path: str, exclude: tuple[str, ...] = ("_relaxed", "_thinking", "_type")) -> DataFrame:
    """Stored runs, a JSON object a line: (line, doc_id, gold_n, text, gold, system, spans, score), a row for each system; system names may have dots. Files whose name holds an excluded part, blank or unreadable lines and those without id are skipped."""
    lines = ordered(spark.read.text(path)).select("value", "line", F.col("_metadata.file_name").alias("file")).where("trim(value) <> ''")
    for part in exclude:
        lines = lines.where(~F.contains("file", F.lit(part)))
    rows = lines.select("line", F.from_json("value", RUN).alias("r")).where("r.doc_id is not null")
    return rows.select("line", "r.doc_id", "r.gold_n", "r.text", F.col("r.gold_spans").alias("gold"), F.explode_outer("r.predictions").alias("system", "p")).select("line", "doc_id", "gold_n", "text", "gold", "system", "p.spans", "p.score")


def first_or_last(runs: DataFrame, keep: str = "last") -> DataFrame:
    """One row for each document and system of several files: its spans from the last file, or the first; text and gold from the first that has any (an empty gold is filled up by a later file)."""
    from pyspark.sql import Window

    if keep not in ("first", "last"):
        raise ValueError(keep)
    whole = Window.partitionBy("doc_id")
    some = lambda c, there: F.min_by(F.col(c), F.when(there, F.col("line"))).over(whole)
    rows = runs.select("doc_id", "system", "spans", "score", "line", some("text", F.col("text").isNotNull()).alias("text"), F.coalesce(some("gold", F.size("gold") > 0), F.array().cast(runs.schema["gold"].dataType)).alias("gold")).where("system is not null")
    pick = F.max_by if keep == "last" else F.min_by
    row = F.struct("text", "gold", "spans", "score")
    return rows.groupBy("doc_id", "system").agg(pick(row, F.col("line")).alias("r")).select("doc_id", "system", "r.text", "r.gold", "r.spans", "r.score", F.lit(True).alias("ok"))


SUMMARY = "system string, benchmark string, mode string, n_docs bigint, precision double, recall double, f1 double, leakage_rate double, char_leakage_rate double"


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Summary files, each a JSON array, with their file stem; unreadable and empty ones are skipped."""
    rows = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema(SUMMARY).json(path)
    return rows.withColumn("stem", F.regexp_replace(F.col("_metadata.file_name"), r"(\.summary)?\.json$", "")).where("system is not null")


CELL = "system string, corpus string, benchmark string, masked bigint, found bigint, recall_pct double"


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells as JSON objects, one for a file, over lines or not, or one for a line; unreadable ones are skipped."""
    files = spark.read.text(path, wholetext=True)
    each = files.select(F.explode(F.split(F.trim(F.col("value"), F.lit(" \t\r\n")), r"\n(?=\{)")).alias("v"))
    return each.select(F.from_json("v", CELL).alias("c")).where("c.system is not null").select("c.*")


SHEET = tuple("id benchmark doc_id type original surrogate context failure valid type_consistent reviewed notes".split())


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """An annotation sheet: CSV with a header, doubled quotes and line breaks in cells; empty cells are ""."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("nullValue", None).csv(path).na.fill("")


def response_spans(body: Column, text: Column) -> Column:
    """Spans of a service's JSON answer: its entities, detections or phi_entities, whichever comes first non-empty; those without readable bounds are left out."""
    entity = "array<struct<start:string,end:string,type:string,label:string,value:string,text:string,score:double>>"
    parsed = F.from_json(body, f"entities {entity}, detections {entity}, phi_entities {entity}")
    full = lambda c: F.when(F.size(c) > 0, c)
    found = F.coalesce(full(parsed["entities"]), full(parsed["detections"]), full(parsed["phi_entities"]), F.array().cast(entity))
    fine = F.filter(found, lambda e: e["start"].try_cast("bigint").isNotNull() & e["end"].try_cast("bigint").isNotNull())
    full_text = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c])
    return F.transform(fine, lambda e: F.struct(e["start"].cast("bigint").alias("start"), e["end"].cast("bigint").alias("end"), F.coalesce(full_text(e["type"], e["label"]), F.lit("PHI")).alias("label"), F.coalesce(full_text(e["value"], e["text"]), _piece(text, e["start"].cast("bigint"), e["end"].cast("bigint"))).alias("text"), F.coalesce(e["score"], F.lit(1.0)).alias("score")))


def substring_spans(text: Column, wanted: dict[str, str]) -> Column:
    """The first occurrence of each wanted substring, absent ones left out."""
    found = F.array(*[_span(F.locate(s, text) - 1, F.locate(s, text) - 1 + len(s), F.lit(label), F.lit(s)) for s, label in wanted.items()])
    return F.filter(found, lambda s: s["start"] >= 0)


def read_hub(spark: SparkSession, path: str, language: str | None = None, split: str = "validation", benchmark: str = "hub") -> DataFrame:
    """A hub table stored as Parquet or as JSON lines."""
    rows = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.json(path)
    return hub_documents(rows, language, split, benchmark)


#: Formats by name; loaders take (spark, path) and their own options.
FORMATS: dict[str, Callable[..., DataFrame]] = {"jsonl": read_jsonl, "standoff": read_standoff, "tagged": read_tagged, "blocks": read_blocks, "hub": read_hub, "rewritten": read_rewritten}
#: Corpora by name: their format and its options. Each has a rewritten form, named with ``_transformed``.
CORPORA: dict[str, tuple[str, dict]] = {
    "asq_phi": ("jsonl", {"language": "en"}),
    "meddocan": ("standoff", {"language": "es"}),
    "multiconer_v2": ("tagged", {"language": "en"}),
    "pii_masking_300k": ("hub", {"language": "English"}),
    "pii_masking_300k_dutch": ("hub", {"language": "Dutch"}),
    "pii_masking_300k_french": ("hub", {"language": "French"}),
    "pii_masking_300k_german": ("hub", {"language": "German"}),
}
CHANGED = "_transformed"
_CODES = {"English": "en", "Dutch": "nl", "French": "fr", "German": "de"}


def register_corpus(name: str, kind: str, **options) -> None:
    if kind not in FORMATS:
        raise ValueError(f"unknown corpus format {kind!r}; known: {', '.join(sorted(FORMATS))}")
    CORPORA[name] = (kind, options)


def corpus_names() -> list[str]:
    return sorted([*CORPORA, *[f"{c}{CHANGED}" for c in CORPORA]])


def load(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    """A corpus by its name, or by that of its format: options given here come before the corpus's own."""
    if name in FORMATS:
        return FORMATS[name](spark, path, **options)
    base = name.removesuffix(CHANGED)
    if base not in CORPORA:
        raise ValueError(f"unknown corpus or format {name!r}; known: {', '.join([*corpus_names(), *sorted(FORMATS)])}")
    kind, own = CORPORA[base]
    if base != name:
        language = own.get("language", "en")
        kind, own = "rewritten", {"language": _CODES.get(language, language)}
    return FORMATS[kind](spark, path, **{"benchmark": name, **own, **options})
