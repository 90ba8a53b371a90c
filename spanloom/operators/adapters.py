"""Detectors that other packages bring. Each imports its package in the task that first predicts, so this module needs none of them; without its package a detector fails on every document."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from importlib import import_module
from typing import Any

from .detect import Spans, register

#: Language models of the entity recogniser, by language.
SPACY = {code: f"{code}_core_{'web' if code == 'en' else 'news'}_lg" for code in "ca de en es fr it nl pt".split()}


@dataclass
class Held:
    """A detector around an engine that is made once in a worker and not sent with the detector."""

    name: str
    engine: Any = field(default=None, compare=False, repr=False)

    def make(self) -> Any:
        raise NotImplementedError

    def spans(self, engine: Any, text: str) -> Spans:
        raise NotImplementedError

    def predict(self, text: str) -> Spans:
        if self.engine is None:
            self.engine = self.make()
        return self.spans(self.engine, text)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"engine": None}


@dataclass
class EntityAnalyzer(Held):
    """The analyzer of ``presidio_analyzer`` with spaCy's model of a language."""

    name: str = "presidio"
    language: str = "en"

    def __post_init__(self) -> None:
        if self.language not in SPACY:
            raise ValueError(f"no model for language {self.language!r}; there are: {', '.join(SPACY)}")

    def make(self) -> Any:
        engines = import_module("presidio_analyzer.nlp_engine")
        setup = {"nlp_engine_name": "spacy", "models": [{"lang_code": self.language, "model_name": SPACY[self.language]}]}
        nlp = engines.NlpEngineProvider(nlp_configuration=setup).create_engine()
        return import_module("presidio_analyzer").AnalyzerEngine(nlp_engine=nlp, supported_languages=[self.language])

    def spans(self, engine: Any, text: str) -> Spans:
        return [(r.start, r.end, r.entity_type, text[r.start : r.end], float(r.score)) for r in engine.analyze(text=text, language=self.language)]


@dataclass
class TokenClassifier(Held):
    """A token-classification pipeline of ``transformers``; neighbouring tokens of a kind are one span."""

    name: str = "obi"
    model: str = "obi/deid_roberta_i2b2"

    def make(self) -> Any:
        return import_module("transformers").pipeline("token-classification", model=self.model, aggregation_strategy="simple")

    def spans(self, engine: Any, text: str) -> Spans:
        return [(int(r["start"]), int(r["end"]), str(r["entity_group"]), text[int(r["start"]) : int(r["end"])], float(r["score"])) for r in engine(text)]


@dataclass
class RuleFilter(Held):
    """The rule-based filter of ``philter_ucsf``: its object maps a text's identifying characters."""

    name: str = "philter"
    settings: dict = field(default_factory=dict)

    def make(self) -> Any:
        return import_module("philter_ucsf").Philter(self.settings)

    def spans(self, engine: Any, text: str) -> Spans:
        return [(a, b, "PHI", text[a:b], 1.0) for a, b in engine.detect_phi(text)]


@dataclass
class Pipeline(Held):
    """A Spark NLP light pipeline, made by ``load`` (it needs a licence of the user's own)."""

    name: str = "jsl"
    load: Callable[[], Any] | None = None

    def make(self) -> Any:
        if self.load is None:
            raise RuntimeError("give a function that loads the licensed pipeline")
        return self.load()

    def spans(self, engine: Any, text: str) -> Spans:
        return [(c.begin, c.end + 1, str(c.metadata.get("entity", "PHI")), c.result, 1.0) for c in engine.fullAnnotate(text)[0]["ner_chunk"]]


for _name, _make in (("presidio", EntityAnalyzer), ("obi", TokenClassifier), ("philter", RuleFilter), ("jsl", Pipeline)):
    register(_name, _make)
