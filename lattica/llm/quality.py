"""Quality rules: boosted trees over document statistics decide what the plain rules let pass.

Words are runs of characters other than space and tab to carriage return. The base rules reject a
document of under 50 words, or one of whose words more than half lie in three-word windows that
occur twice or more in it. The others are judged by trees fitted to a bounded labelled sample;
more symbols, repeated lines or repeated words never raise a document's score.

Defined results: a null or empty text has no words and fails the base rules; rows with equal ids
are judged one by one; other columns are ignored; with no labels of both kinds, base rules decide.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import as_bytes, batch_of, cut, text_bytes

#: Labelled rows that the trees are fitted to at most; which ones, a hash of the id decides.
FIT_ROWS = 12_000
#: Probability of good quality below which a document goes.
KEEP_FROM = 0.5
LEAST_WORDS, REPEAT_PERCENT = 50, 50

_SPACE = np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8)
_SYMBOL = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
_STOP = np.frombuffer(b".!?", dtype=np.uint8)
_OTHER = np.frombuffer(b"\"'(),-/:;=@[\\]^_`{}~+", dtype=np.uint8)

#: Features and how each may move the score.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_lines": -1, "repeat_words": -1, "distinct_words": 0,
    "capitals": -1, "digits": 0, "stops_per_word": 0, "others_per_word": 0, "shouts_per_word": -1, "words_per_line": 0, "wide": 0, "longest_word": 0,
}


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more, the first one's included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered = np.zeros(len(words), dtype=bool)
    again = np.fromiter((seen[x] > 1 for x in windows), dtype=bool, count=len(windows))
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and the model's features."""
    of = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, letters = len(words), int(of[:128].sum() + of[192:].sum() - of[_SPACE].sum())
    symbols, dup, again = int(of[_SYMBOL].sum()), len(lines) - len(set(lines)), repeat_words(words)
    per, low, up = max(n, 1), int(of[97:123].sum()), int(of[65:91].sum())
    features = [
        np.log1p(n), letters / per, symbols / per, dup / max(len(lines), 1), again / per, len(set(words)) / per,
        up / max(low + up, 1), of[48:58].sum() / max(letters, 1), of[_STOP].sum() / per, of[_OTHER].sum() / per,
        of[33] / per, n / max(len(lines), 1), of[192:].sum() / max(letters, 1), np.log1p(max(map(len, words), default=0)),
    ]
    return [n, letters, symbols, dup, again], features


_RAW = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("features", pa.list_(pa.float64()))])
_OUT = pa.schema(
    [("doc_id", pa.int64())]
    + [(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("quality", pa.float64()), ("kept", pa.bool_())]
)
_OUT_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def labelled(documents: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, label and text of at most `rows` labelled documents that a hash picks, repeated rows once; so few that their ids are broadcast.

    The bound is on documents, not ids: an id on very many rows gives at most `rows` of them.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = documents.select("doc_id", text_bytes().alias("text")).withColumn("digest", F.xxhash64("text"))
    chosen = texts.select("doc_id", "digest").join(F.broadcast(picked), "doc_id").distinct().orderBy(F.xxhash64("doc_id", "digest"), "doc_id", "digest").limit(rows)
    return cut(texts.join(F.broadcast(cut(chosen)), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select("doc_id", "label", "text"))


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> gbt.Forest:
    """Trees fitted to the features of at most `rows` labelled documents; only features reach the driver."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(_RAW, [batch.column("doc_id"), batch.column("label"), [[float(v) for v in statistics(x)[1]] for x in as_bytes(batch, "text")]])

    sample = labelled(documents, labels, "quality", rows).mapInArrow(features, "doc_id long, label int, features array<double>").toPandas()
    if not len(sample):
        return gbt.constant(0.9)
    x = np.asarray(sample["features"].tolist())
    order = np.lexsort((*x.T, sample["doc_id"].to_numpy()))
    return gbt.fit(x[order], sample["label"].to_numpy()[order].astype(float), list(FEATURES.values()))


def judge(documents: DataFrame, forest: gbt.Forest, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per document: the statistics, base_failed, quality (the trees' probability) and kept."""
    shared = documents.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            found = [statistics(x) for x in as_bytes(batch, "text")]
            if not found:
                continue
            base = np.asarray([x[0] for x in found], dtype=np.int64)
            quality = trees.probability(np.asarray([x[1] for x in found], dtype=float))
            failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > REPEAT_PERCENT * base[:, 0])
            yield batch_of(_OUT, [batch.column("doc_id"), *base.T, failed, quality, ~failed & (quality >= keep_from)])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(score, _OUT_DDL)


def keep(documents: DataFrame, forest: gbt.Forest, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents that pass, with all their columns."""

    def verdicts():
        def of(texts: list[bytes]) -> np.ndarray:
            found = [statistics(x) for x in texts]
            base = np.asarray([x[0] for x in found], dtype=np.int64)
            failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > REPEAT_PERCENT * base[:, 0])
            return ~failed & (forest.probability(np.asarray([x[1] for x in found], dtype=float)) >= keep_from)

        return of

    return filtered(documents, verdicts)


def filtered(documents: DataFrame, verdicts) -> DataFrame:
    """Rows to whose text verdicts() (made once for each partition) says True; no row leaves its task."""

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdict = verdicts()
        for batch in batches:
            if batch.num_rows:
                texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
                yield batch.filter(pa.array(np.asarray(verdict(texts), dtype=bool)))

    return documents.mapInArrow(passing, documents.schema)
