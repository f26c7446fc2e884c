"""Toxicity: boosted trees over dense features of a text, made probabilities by isotonic regression.

The lexicon is learned: whole words, and the beginnings of words, that mark labelled toxic texts.
Features are lexicon densities, the nearness of second-person words to lexicon words, capitals,
punctuation and how much of it hides a lexicon word (digits or signs for letters, letters spaced
out). Labels, language, source and ids are never inputs of a score.

Defined results: a null or empty text is scored as a text without words; ties and repeated rows get
equal scores; other columns are ignored; with no labels of both kinds every score is the base rate.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import as_bytes, batch_of, fold, text_bytes
from .quality import filtered, labelled

#: Labelled rows that lexicon, trees and calibration are fitted to at most.
FIT_ROWS = 20_000
#: Entries of the lexicon at most, the strongest first; documents that an entry needs in the sample.
LEXICON, LEAST_DOCS = 2_000, 5
PREFIXES = (5, 6, 7, 8)
#: Letters from which a word stands in the lexicon by its digest, which bounds the lexicon's bytes.
LONG = 64

_WORD = re.compile(r"[^\W\d_]+")
# From the beginning of a run of letters only, so that no run is read again from each of its letters.
_MASKED = re.compile(r"(?<![^\W_])[^\W_]*[0-9@$!*][0-9@$!*\w]*")
_SPACED = re.compile(r"(?<!\w)\w(?:[ .\-_]\w){3,}(?!\w)")
#: Bytes without one of which nothing is masked.
_SIGNS = np.frombuffer(b"0123456789@$!*", dtype=np.uint8)
#: Signs that stand for letters, and second-person words of the four languages.
_FOLD = str.maketrans("013457@$!", "oieastasi")
_YOU = frozenset("you your yours yourself u ur du dich dir dein deine tu te toi ton ta vous votre usted tú tus".split())

#: Features and how each may move the score.
FEATURES = {
    "strong_any": 1, "strong_density": 1, "words_any": 1, "words_density": 1, "stem_any": 1, "stem_density": 1, "best": 1, "near_you": 1, "hidden": 1,
    "log_words": 0, "capitals": 0, "shouted_words": 0, "exclamations": 0, "punctuation": 0, "masked": 0,
}


def entry(word: str) -> str:
    """A word (in small letters) as the lexicon has it."""
    return word if len(word) < LONG else hashlib.sha256(word.encode()).hexdigest() + "-"


@dataclass(frozen=True)
class Model:
    """words, stems: how many times as likely in toxic texts, as a logarithm."""

    words: dict[str, float]
    stems: dict[str, float]
    forest: gbt.Forest
    at: np.ndarray
    to: np.ndarray

    def score(self, texts: list[bytes], look: Lookup | None = None) -> np.ndarray:
        """look: kept from batch to batch, so that a word is looked up once."""
        look = look or Lookup(self.words, self.stems)
        rows = np.asarray([look.features(x) for x in texts], dtype=float).reshape(-1, len(FEATURES))
        return np.clip(np.interp(self.forest.probability(rows), self.at, self.to), 0, 1)


class Lookup:
    """Features of texts, with a bounded memory of the words met."""

    MOST = 200_000

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.known: dict[str, tuple[float, float] | None] = {}

    def weight(self, word: str) -> tuple[float, float] | None:
        """(as a word, as a beginning); None if neither is in the lexicon."""
        try:
            return self.known[word]
        except KeyError:
            low = word.lower()
            pair = (self.words.get(entry(low), 0.0), max((self.stems.get(low[:n], 0.0) for n in PREFIXES if len(low) >= n), default=0.0))
            found = pair if any(pair) else None
            if len(word) < LONG:
                if len(self.known) >= self.MOST:
                    self.known.clear()
                self.known[word] = found
            return found

    def features(self, raw: bytes) -> list[float]:
        text = raw.decode("utf-8", "replace")
        words = _WORD.findall(text)
        hits = [(i, p) for i, p in enumerate(map(self.weight, words)) if p]
        n = max(len(words), 1)
        strong = sum(max(p) >= 3 for _, p in hits)
        near = sum(1 for i, _ in hits if any(w.lower() in _YOU for w in words[max(0, i - 4) : i + 5]))
        of = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=128)
        masked = _MASKED.findall(text) if of[_SIGNS].any() else []
        hidden = sum(1 for m in masked if (p := self.weight(m.translate(_FOLD))) and max(p) >= 3)
        hidden += sum(1 for m in _SPACED.findall(text) if (p := self.weight(re.sub(r"\W|_", "", m))) and max(p) >= 3)
        up, low = int(of[65:91].sum()), int(of[97:123].sum())
        full, stems = sum(p[0] > 0 for _, p in hits), sum(p[1] > 0 for _, p in hits)
        return [
            min(strong, 3), strong / n, min(full, 3), full / n, min(stems, 3), stems / n, max((max(p) for _, p in hits), default=0.0), near / n, hidden / n,
            np.log1p(len(words)), up / max(up + low, 1), sum(w.isupper() for w in words) / n, of[33] / n, int(of[33:48].sum() + of[58:65].sum()) / n, len(masked) / n,
        ]


def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, mark, label) for each different word and beginning of a word in each labelled text."""
    schema = pa.schema([("kind", pa.string()), ("mark", pa.string()), ("label", pa.int32())])
    for batch in batches:
        out: list[tuple[str, str, int]] = []
        for text, label in zip(as_bytes(batch, "text"), batch.column("label").to_pylist(), strict=True):
            words = set(map(str.lower, _WORD.findall(text.decode("utf-8", "replace"))))
            out += [("word", entry(w), label) for w in words]
            out += [("stem", s, label) for s in {w[:n] for w in words for n in PREFIXES if len(w) >= n}]
        if out:
            yield batch_of(schema, zip(*out, strict=True))


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model of at most `rows` labelled documents outside fold 0.

    One part of the sample gives the lexicon, another the trees, the last the calibration, so that
    no text is judged by words which it has itself brought into the lexicon.
    """
    own = labels.filter(fold("doc_id") > 0)
    sample = labelled(documents, own, "toxic", rows).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(8)).cast("int"))
    totals = {r["label"]: r["n"] for r in sample.filter("part < 4").groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    found: dict[str, dict[str, float]] = {"word": {}, "stem": {}}
    if bad and good:
        counts = (
            sample.filter("part < 4").select("text", "label").mapInArrow(marks, "kind string, mark string, label int")
            .groupBy("kind", "mark").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
        )
        weight = F.log((F.col("a") + 0.5) / (bad + 1)) - F.log((F.col("b") + 0.5) / (good + 1))
        need = max(2, min(LEAST_DOCS, bad // 40))
        for r in counts.filter(f"a >= {need}").withColumn("weight", weight).filter("weight >= 1.5").orderBy(F.desc("weight"), F.desc("a"), "kind", "mark").limit(LEXICON).collect():
            found[r["kind"]][r["mark"]] = float(r["weight"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(found["word"], found["stem"])
        schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("label", pa.int32()), ("features", pa.list_(pa.float64()))])
        for batch in batches:
            yield batch_of(schema, [batch.column("doc_id"), batch.column("part"), batch.column("label"), [[float(v) for v in look.features(x)] for x in as_bytes(batch, "text")]])

    data = sample.filter("part >= 4").select("doc_id", "part", "label", "text").mapInArrow(features, "doc_id long, part int, label int, features array<double>").toPandas()
    if not len(data):
        return Model({}, {}, gbt.constant(0.1), np.asarray([0.0, 1.0]), np.asarray([0.1, 0.1]))
    x, y, part = np.asarray(data["features"].tolist()), data["label"].to_numpy().astype(float), data["part"].to_numpy()
    order = np.lexsort((*x.T, data["doc_id"].to_numpy()))
    x, y, part = x[order], y[order], part[order]
    trees = part < 7
    forest = gbt.fit(x[trees], y[trees], list(FEATURES.values()), trees=60, depth=3)
    at, to = gbt.isotonic(forest.probability(x[~trees]), y[~trees])
    return Model(found["word"], found["stem"], forest, at, to)


def judge(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(shared.value.words, shared.value.stems)
        for batch in batches:
            s = shared.value.score(as_bytes(batch, "text"), look)
            yield batch_of(schema, [batch.column("doc_id"), batch.column("held_out"), s, (s >= 0.5).astype(np.int32)])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id") == 0).alias("held_out"), text_bytes().alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def drop(documents: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted to be toxic, with all their columns."""

    def verdicts():
        look = Lookup(model.words, model.stems)
        return lambda texts: model.score(texts, look) < 0.5

    return filtered(documents, verdicts)
