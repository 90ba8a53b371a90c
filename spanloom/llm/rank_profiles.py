"""Language identification by rank-order profiles.

A text is lower-cased and cut into words, its maximal runs of letters; each word stands between single spaces, and its
n-grams of one to three characters, the lone space apart, are counted. A profile is the ``size`` most frequent n-grams in
order of falling count (equal counts in code-point order). A language's profile counts all documents that are
labelled with it. A document's distance to a language is the sum, over the n-grams of its own profile, of how far each is out of place in the
language's profile, ``size`` if it isn't there; the nearest language wins, the alphabetically first of equals.

Defined cases: null text and text without letters have no n-grams: language and distance null, n_grams 0. Documents without a label (null) train
nothing and are identified like all. Without any label every language is null. Very long texts count whole. Repeated rows are counted and
identified each; ids are only carried. Further columns may have any names. No rows: no rows.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import roles, spans, text_bytes
from .repetition import code_points

SIZE = 300
CHUNK, ROWS = 400_000, 4000
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return _letters


def _grams(codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of a few documents: alphabet-coded keys (first character highest, 0 where shorter), their documents, and the alphabet."""
    n_docs = len(off) - 1
    sizes = np.diff(off)
    doc = np.repeat(np.arange(n_docs), sizes)
    letter = _letter_table()[codes]
    first = letter.copy()  # first letter of a word
    first[1:] &= ~(letter[:-1] & (doc[1:] == doc[:-1]))
    word = np.cumsum(first) - 1
    kept = np.flatnonzero(letter)
    if not len(kept):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    # the text as " w1 w2 w3": a space before each word, and one after the last
    n_words = int(word[-1]) + 1
    text = np.full(len(kept) + n_words + 1, 32, np.uint32)
    at = np.arange(len(kept)) + word[kept] + 1
    text[at] = codes[kept]
    owner = np.empty(len(text), np.int64)
    owner[at] = doc[kept]
    owner[np.flatnonzero(text == 32)[:-1]] = doc[np.flatnonzero(first)]
    owner[-1] = doc[kept[-1]]
    present = np.zeros(0x110000, bool)
    present[text] = True
    alphabet = np.flatnonzero(present).astype(np.uint32)
    number = np.zeros(0x110000, np.int64)
    number[alphabet] = np.arange(1, len(alphabet) + 1)
    bits = int(len(alphabet)).bit_length()
    x = number[text]
    space = text == 32
    # a word's own space before it ends the word before: its document is that of the word
    one = ~space
    two = ~(space[:-1] & space[1:])
    three = ~space[1:-1] & ~(space[:-2] & space[1:-1])
    key = np.concatenate((x[one] << 2 * bits, (x[:-1] << 2 * bits | x[1:] << bits)[two], (x[:-2] << 2 * bits | x[1:-1] << bits | x[2:])[three]))
    # the document of an n-gram is that of its letter; "x " starts with it, " x" and " xy" end in it
    two_doc = np.where(space[:-1], owner[1:], owner[:-1])
    docs = np.concatenate((owner[one], two_doc[two], owner[1:-1][three]))
    return key, docs, alphabet


def _unkey(key: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Keys whose characters are code points of 21 bits, in the same order, for any alphabet."""
    bits = int(len(alphabet)).bit_length()
    table = np.concatenate((np.zeros(1, np.int64), alphabet.astype(np.int64)))
    mask = (1 << bits) - 1
    return table[key >> 2 * bits] << 42 | table[key >> bits & mask] << 21 | table[key & mask]


def _counts(key: np.ndarray, docs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, n-gram) in order, with counts."""
    both = np.sort(docs << 3 * bits | key) if bits <= 17 else None
    if both is None:
        turn = np.lexsort((key, docs))
        key, docs = key[turn], docs[turn]
        head = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (docs[1:] != docs[:-1]))))
        return docs[head], key[head], np.diff(np.append(head, len(key)))
    head = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    found = both[head]
    return found >> 3 * bits, found & ((1 << 3 * bits) - 1), np.diff(np.append(head, len(both)))


def _chunks(text: pa.Array):
    """(lo, hi, n-gram keys, documents, alphabet) of runs of rows."""
    data, off = text_bytes(text, lower=True)
    for lo, hi in spans(off, CHUNK, ROWS):
        codes, at = code_points(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        yield (lo, hi, *_grams(codes, at))


def _ranked(docs: np.ndarray, key: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, rank) of the ``size`` most frequent of each document; the input is in order of document and key."""
    order = np.argsort(docs << 40 | (int(count.max()) - count), kind="stable") if len(count) else np.zeros(0, np.int64)
    docs, key = docs[order], key[order]
    start = np.searchsorted(docs, docs, side="left") if len(docs) else docs
    rank = np.arange(len(docs)) - start
    top = rank < size
    return docs[top], key[top], rank[top]


def profiles(docs: DataFrame, size: int = SIZE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, g, rank): the profile of each label, from all its documents. g packs three code points; rank starts at 0."""

    def count(batches):
        total: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            names = pc.dictionary_encode(b.column(0))
            code, labels = np.asarray(names.indices), names.dictionary.to_pylist()
            for lo, _, key, owner, alphabet in _chunks(b.column(1)):
                bits = max(1, int(len(alphabet)).bit_length())
                lang, g, n = _counts(key, code[lo + owner].astype(np.int64), bits)
                g = _unkey(g, alphabet) if len(g) else g
                for k in np.unique(lang).tolist():
                    total.setdefault(labels[k], []).append((g[lang == k], n[lang == k]))
                    if len(total[labels[k]]) > 20:
                        total[labels[k]] = [_added(total[labels[k]])]
        for lang, parts in total.items():
            g, n = _added(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], names=["lang", "g", "n"])

    labelled = roles(docs, lang=lang_col, t=text_col).select(F.col("lang").cast("string"), F.col("t").cast("string")).where("lang is not null and t is not null")
    counts = labelled.mapInArrow(count, "lang string, g bigint, n bigint").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "g")
    return counts.select("lang", "g", (F.row_number().over(by) - 1).alias("rank")).where(F.col("rank") < size)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    g, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return g, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(g)).astype(np.int64)


def identify(docs: DataFrame, profile: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, language, distance, n_grams (in its own profile). Map only; the profiles, ``size`` rows a language, go to all tasks."""
    rows = profile.toArrow()
    languages = sorted(set(rows["lang"].to_pylist()))
    known = np.unique(np.asarray(rows["g"])) if rows.num_rows else np.zeros(0, np.int64)
    place = np.full((len(known) + 1, len(languages)), -1, np.int64)
    for lang, g, rank in zip(rows["lang"].to_pylist(), np.asarray(rows["g"]).tolist(), np.asarray(rows["rank"]).tolist()):
        place[np.searchsorted(known, g), languages.index(lang)] = rank
    held = docs.sparkSession.sparkContext.broadcast((languages, known, place))

    def run(batches):
        languages, known, place = held.value
        names = np.array([*languages, None], object)
        for b in batches:
            best = np.full(b.num_rows, len(languages))
            distance, number = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for lo, hi, key, owner, alphabet in _chunks(b.column(1)):
                if not len(key):
                    continue
                doc, g, rank = _ranked(*_counts(key, owner, int(len(alphabet)).bit_length()), size)
                number[lo:hi] = np.bincount(doc, minlength=hi - lo)
                if not languages:
                    continue
                g = _unkey(g, alphabet)
                at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                at[known[at] != g] = len(known)
                there = place[at]
                out = np.where(there < 0, size, np.abs(there - rank[:, None]))
                start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                total = np.add.reduceat(out, start, axis=0)
                win = total.argmin(1)
                best[lo + doc[start]] = win
                distance[lo + doc[start]] = total[np.arange(len(start)), win]
            none = best == len(languages)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best], pa.string()), pa.array(distance, mask=none), pa.array(number)], names=["i", "language", "distance", "n_grams"])

    source = roles(docs, i=id_col, t=text_col).select("i", F.col("t").cast("string"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"i {kind}, language string, distance bigint, n_grams bigint").toDF(id_col, "language", "distance", "n_grams")


def identified(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return identify(docs, profiles(docs, size, text_col, lang_col), size, id_col, text_col)


def sql(size: int = SIZE) -> str:
    """The same over a table ``documents``."""
    return f"""
WITH words AS (
  SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM documents WHERE text IS NOT NULL
), padded AS (
  SELECT doc_id, lang, ' ' || w || ' ' AS w, count(*) AS c FROM words GROUP BY ALL
), places AS (
  SELECT doc_id, lang, w, c, unnest(range(1, length(w) + 1)) AS p FROM padded
), grams AS (
  SELECT doc_id, lang, unnest([substr(w, p, 1), CASE WHEN p + 1 <= length(w) THEN substr(w, p, 2) END, CASE WHEN p + 2 <= length(w) THEN substr(w, p, 3) END]) AS g, c FROM places
), counted AS (
  SELECT doc_id, lang, g, sum(c) AS n FROM grams WHERE g IS NOT NULL AND g <> ' ' GROUP BY ALL
), labels_ranked AS (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) - 1 AS r FROM counted WHERE lang IS NOT NULL GROUP BY lang, g
), profile AS (
  SELECT * FROM labels_ranked WHERE r < {size}
), own AS (
  SELECT * FROM (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) - 1 AS r FROM counted) WHERE r < {size}
), languages AS (
  SELECT DISTINCT lang FROM profile
), distances AS (
  SELECT o.doc_id, l.lang, sum(CASE WHEN p.r IS NULL THEN {size} ELSE abs(p.r - o.r) END) AS distance, count(*) AS n_grams
  FROM own o CROSS JOIN languages l LEFT JOIN profile p ON p.lang = l.lang AND p.g = o.g GROUP BY o.doc_id, l.lang
), best AS (
  SELECT doc_id, arg_min(lang, (distance, lang)) AS language, min(distance) AS distance, any_value(n_grams) AS n_grams FROM distances GROUP BY doc_id
)
SELECT d.doc_id, b.language, CAST(b.distance AS BIGINT) AS distance, CAST(coalesce(b.n_grams, 0) AS BIGINT) AS n_grams
FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id
"""
