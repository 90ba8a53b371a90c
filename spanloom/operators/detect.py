"""Detectors: texts to predicted spans. A detector is any object with a name and ``predict(text)``.

A prediction that raises is a failed attempt: it has ok = false and takes no part in any denominator, whereas a
successful one without spans counts as misses.
"""

from __future__ import annotations

import functools
import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import partial
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.udf import arrow_column
from ..schema import PREDICTED, SPAN

Spans = list[tuple[int, int, str, str, float]]


class Detector(Protocol):
    name: str

    def predict(self, text: str) -> Spans: ...


def needed_literal(pattern: re.Pattern) -> str:
    """The longest string that every match holds, as far as the pattern's outermost sequence tells; "" if there is none."""
    if pattern.flags & re.IGNORECASE:
        return ""
    parts = re._parser.parse(pattern.pattern, pattern.flags)
    runs = "".join(chr(value) if op is re._constants.LITERAL else "\0\0" for op, value in parts).split("\0\0")
    return max(runs, key=len)


def linear_pattern(pattern: re.Pattern) -> str | None:
    """A pattern for Arrow's engine that is found in exactly the texts that ``pattern`` is found in; None unless it is made of characters, sets, groups, alternatives and greedy repeats alone, which both engines read alike."""
    ops = re._constants
    literal = lambda c: rf"\x{{{c:x}}}"

    def written(parts) -> str:
        out = []
        for op, v in parts:
            if op is ops.LITERAL:
                out.append(literal(v))
            elif op is ops.IN and all(o in (ops.LITERAL, ops.RANGE) for o, _ in v):
                out.append("[" + "".join(literal(x) if o is ops.LITERAL else f"{literal(x[0])}-{literal(x[1])}" for o, x in v) + "]")
            elif op is ops.MAX_REPEAT:
                out.append(f"(?:{written(v[2])}){{{v[0]},{'' if v[1] is ops.MAXREPEAT else v[1]}}}")
            elif op is ops.SUBPATTERN and not v[1] and not v[2]:
                out.append(f"(?:{written(v[3])})")
            elif op is ops.BRANCH:
                out.append(f"(?:{'|'.join(map(written, v[1]))})")
            else:
                raise ValueError(op)
        return "".join(out)

    try:
        made = written(re._parser.parse(pattern.pattern, pattern.flags)) if pattern.flags == re.UNICODE else None
        if made is not None:
            pc.match_substring_regex(pa.array([""]), made)
    except (ValueError, pa.ArrowInvalid):  # ArrowInvalid: repeats beyond that engine's limit
        return None
    return made


@functools.cache
def _compiled(pattern: str) -> tuple[re.Pattern, str | None, str]:
    made = re.compile(pattern)
    return made, linear_pattern(made), needed_literal(made)


def _matches(pattern: str, text: pa.Array, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts and ends of a pattern's matches. Most texts have none: an engine in linear time tells which do."""
    p, linear, literal = _compiled(pattern)
    if linear is not None:
        rows = np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(text, linear), False))).tolist()
    else:
        rows = [k for k, t in enumerate(texts) if t is not None and literal in t]
    bounds, sizes = [], []
    for k in rows:
        found = [m.span() for m in p.finditer(texts[k])]
        sizes.append(len(found))
        bounds += found
    both = np.array(bounds, np.int64).reshape(-1, 2)
    return np.repeat(np.array(rows, np.int64), np.array(sizes, np.int64)), both[:, 0], both[:, 1]


@dataclass(frozen=True)
class RegexDetector:
    """Spans of labelled patterns in order of start, end and label. Patterns should avoid look-around, so that SQL engines can run them too."""

    name: str
    patterns: tuple[tuple[str, str], ...]
    compiled: list = field(default_factory=list, compare=False, repr=False)

    def predict(self, text: str) -> Spans:
        if not self.compiled:
            self.compiled.extend((label, p, needed_literal(p)) for label, p in ((label, re.compile(p)) for label, p in self.patterns))
        # most texts lack the literal of a costly pattern: an address's is tried at each letter of each word
        out = [(m.start(), m.end(), label, m.group(), 1.0) for label, p, literal in self.compiled if literal in text for m in p.finditer(text)]
        return sorted(out, key=lambda s: s[:3])


@dataclass(frozen=True)
class ParsedDetector:
    """A model that answers in text: ``ask`` gives JSON-like answers, which are parsed and located in the text."""

    name: str
    ask: Callable[[str], str]

    def predict(self, text: str) -> Spans:
        return locate_nearest(text, parse_tolerant(self.ask(text)).get("spans", []))


REGISTRY: dict[str, Callable[[], Detector]] = {}
#: Detectors with settings in their names, as in ``service:MODE:TYPE``: what makes one from its settings, and all settings that there are.
FAMILIES: dict[str, tuple[Callable[..., Detector], tuple[tuple[str, ...], ...]]] = {}


def register(name: str, make: Callable[[], Detector]) -> None:
    REGISTRY[name] = make


def register_family(prefix: str, make: Callable[..., Detector], settings: Iterable[tuple[str, ...]]) -> None:
    FAMILIES[prefix] = (make, tuple(settings))


def _makers(name: str) -> list[Callable[[], Detector]]:
    if name in REGISTRY:
        return [REGISTRY[name]]
    prefix, *given = name.split(":")
    if given and prefix in FAMILIES:
        make, settings = FAMILIES[prefix]
        if tuple(given) not in settings:
            raise ValueError(f"{prefix!r} has no settings {':'.join(given)!r}; it has: {', '.join(':'.join(s) for s in settings)}")
        return [partial(make, *given)]
    if name.endswith("_all"):
        group = name[:-4]
        if group in FAMILIES:
            make, settings = FAMILIES[group]
            return [partial(make, *s) for s in settings]
        return [REGISTRY[k] for k in sorted(REGISTRY) if k.startswith(f"{group}:")]
    return []


def build(names: Iterable[str]) -> list[Detector]:
    """Detectors by name: registered ones, those of a family by their settings, and with ``group_all`` every one of a family or of the names that begin with ``group:``."""
    out: dict[str, Detector] = {}
    for name in names:
        makers = _makers(name)
        if not makers:
            raise ValueError(f"unknown detector {name!r}; known: {', '.join(sorted([*REGISTRY, *FAMILIES]))}")
        for make in makers:
            made = make()
            if made.name in out:
                raise ValueError(f"two detectors are named {made.name!r}")
            out[made.name] = made
    return list(out.values())


def parse_tolerant(answer: str | None) -> dict:
    """An object from a model's answer: as it is, without code fences, its outermost braces, or else the complete span objects in it."""
    text = answer or ""
    bare = text.strip().removeprefix("```json").strip("`").strip()
    braces = re.search(r"(?s)\{.*\}", bare)
    for candidate in (text, bare, braces.group() if braces else ""):
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        return found if isinstance(found, dict) else {}
    keys = ('"start"', r"\d+"), ('"end"', r"\d+"), ('"label"', r'"[^"]*"'), ('"text"', r'"[^"\\]*(?:\\.[^"\\]*)*"')
    whole = r"(?s)\{\s*" + r"\s*,\s*".join(rf"{k}\s*:\s*{v}" for k, v in keys) + r"\s*\}"
    spans = []
    for m in re.finditer(whole, bare):
        try:
            spans.append(json.loads(m.group()))
        except ValueError:
            pass
    return {"spans": spans}


def _occurrences(text: str, value: str) -> Iterable[int]:
    at = text.find(value)
    while at >= 0:
        yield at
        at = text.find(value, at + 1)


def _whole(x) -> int:
    """A number from what a model wrote, 0 if it isn't one."""
    try:
        return int(x)
    except (TypeError, ValueError):
        return 0


def _nearest_free(places: list[int], hint: int, taken: set[int]) -> int | None:
    """Of places in order the one nearest to the hint that isn't taken, the lesser of two."""
    right = bisect_left(places, hint)
    left = right - 1
    while left >= 0 or right < len(places):
        if left >= 0 and (right == len(places) or hint - places[left] <= places[right] - hint):
            at, left = places[left], left - 1
        else:
            at, right = places[right], right + 1
        if at not in taken:
            return at
    return None


def locate_nearest(text: str, claims: Sequence[dict]) -> Spans:
    """Each claimed surface at its occurrence nearest to the hinted start that no earlier claim has; claims that aren't objects are skipped."""
    known: dict[str, tuple[list[int], set[int]]] = {}  # a surface's occurrences, looked for once, and which of them are taken
    out: Spans = []
    for claim in claims if isinstance(claims, list) else []:
        if not isinstance(claim, dict):
            continue
        value, hint = str(claim.get("text") or "").strip(), _whole(claim.get("start"))
        if value and value not in known:
            known[value] = list(_occurrences(text, value)), set()
        at = _nearest_free(known[value][0], hint, known[value][1]) if value else None
        if at is not None:
            known[value][1].add(at)
            out.append((at, at + len(value), str(claim.get("label", "OTHER")), value, 1.0))
    return out


def locate_first(text: str, tags: Sequence[dict]) -> list[dict]:
    """Each tag's value at its first occurrence that doesn't begin inside an earlier tag's; in order of start."""
    taken: list[tuple[int, int]] = []
    out = []
    for tag in tags:
        value, label = (str(tag.get(k) or "").strip() for k in ("value", "identifier_type"))
        if value == "":
            continue
        at = next((i for i in _occurrences(text, value) if not any(a <= i < b for a, b in taken)), None)
        if at is not None:
            taken.append((at, at + len(value)))
            out.append({"start": at, "end": at + len(value), "label": label.upper() or "OTHER", "text": value})
    return sorted(out, key=lambda s: s["start"])


def _span_lists(found: list[Spans | None], fields: int = 5) -> pa.ListArray:
    """A list array of span structs, of their first ``fields`` fields, from one list for each row; None is null."""
    sizes = [len(x) if x is not None else 0 for x in found]
    flat = [s for x in found if x for s in x]
    columns = pa.StructArray.from_arrays([pa.array([s[k] for s in flat], kind) for k, kind in enumerate(list(_KINDS.values())[:fields])], list(_KINDS)[:fields])
    off = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), columns, mask=pa.array([x is None for x in found]) if len(found) else None)


@arrow_column(f"array<{PREDICTED}>", once=True)
def answer_spans(text: pa.Array, answer: pa.Array) -> pa.Array:
    """Column: the spans of a model's answers, read tolerantly and located in the texts; null text or answer has none."""
    rows = zip(text.to_pylist(), answer.to_pylist())
    return _span_lists([locate_nearest(t, parse_tolerant(a).get("spans", [])) if t is not None else [] for t, a in rows])


_KINDS = {"start": pa.int64(), "end": pa.int64(), "label": pa.string(), "text": pa.string(), "score": pa.float64()}


def _regex_lists(detectors: Sequence[RegexDetector], text: pa.Array, fields: int) -> list[pa.ListArray]:
    """What ``predict`` of each detector finds in all texts, of their first ``fields`` fields; null text has none. A pattern that several have is looked for once."""
    texts, known, out = text.to_pylist(), {}, []
    for d in detectors:
        labels = sorted({label for label, _ in d.patterns})
        parts = []
        for label, p in d.patterns:
            if p not in known:
                known[p] = _matches(p, text, texts)
            parts.append((*known[p], np.full(len(known[p][0]), labels.index(label))))
        row, start, end, code = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 4
        order = np.lexsort((code, end, start, row))
        row, start, end, code = row[order], start[order], end[order], code[order]
        columns = [pa.array(start), pa.array(end)]
        if fields > 2:
            columns.append(pa.array(labels, pa.string()).take(pa.array(code)))
        if fields > 3:
            columns.append(pa.array([texts[k][a:b] for k, a, b in zip(row.tolist(), start.tolist(), end.tolist())], pa.string()))
        if fields > 4:
            columns.append(pa.array(np.ones(len(row))))
        off = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(texts))))).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays(columns, list(_KINDS)[:fields])))
    return out


def spans_of(detector: Detector, scores: bool = True) -> Callable[[Column], Column]:
    """A column function: the spans of one detector, with their scores or without; null text has none."""

    @arrow_column(f"array<{PREDICTED if scores else SPAN}>", once=True)  # exploding it infers a filter that would run it again
    def run(text: pa.Array) -> pa.Array:
        if type(detector) is RegexDetector:
            return _regex_lists([detector], text, 5 if scores else 4)[0]
        return _span_lists([detector.predict(t) if t is not None else [] for t in text.to_pylist()], 5 if scores else 4)

    return run


def attempts(detectors: Sequence[Detector], text: pa.Array, fields: int = 5) -> list[pa.ListArray]:
    """For each detector the spans of all texts, of their first ``fields`` fields; null where it failed."""

    def one(d: Detector, t: str | None) -> Spans | None:
        try:
            return d.predict(t) if t is not None else []
        except Exception:  # a detector's failure on a document is data, see above
            return None

    if all(type(d) is RegexDetector for d in detectors):
        return _regex_lists(detectors, text, fields)
    texts = text.to_pylist()
    return [_span_lists([one(d, t) for t in texts], fields) for d in detectors]


def predictions(detectors: Sequence[Detector]) -> Callable[[Column], Column]:
    """A column function: for each detector its name, whether it succeeded, and its spans. One pass over the text for all of them."""
    names = [d.name for d in detectors]

    @arrow_column(f"array<struct<system:string,ok:boolean,spans:array<{PREDICTED}>>>", once=True)
    def run(text: pa.Array) -> pa.Array:
        found: list[Spans | None] = []
        for t in text.to_pylist():
            for d in detectors:
                try:
                    found.append(d.predict(t) if t is not None else [])
                except Exception:  # a detector's failure on a document is data, see above
                    found.append(None)
        rows = pa.StructArray.from_arrays([pa.array(names * len(text), pa.string()), pa.array([x is not None for x in found], pa.bool_()), _span_lists(found)], ["system", "ok", "spans"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32) * len(names)), rows)

    return run


def run_rows(docs: DataFrame, detectors: Sequence[Detector], text: str = "text", keep: Sequence[str] = ("benchmark", "doc_id", "language", "gold")) -> DataFrame:
    """A row for each document and detector: the columns kept, system, ok and spans (null where it failed). Map only."""
    each = docs.select(*keep, F.explode(predictions(detectors)(F.col(text))).alias("p"))
    return each.select(*keep, "p.system", "p.ok", "p.spans")
