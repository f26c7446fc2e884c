"""Packing along a space-filling curve: documents of like content lie in the same sequences.

A document's ids are hashed into a vector, the vector is projected to three dimensions, and the cell
there has a place on a Hilbert curve. Documents are put in the order of that place, and the whole
order is cut every 2048 ids, so only the last sequence has padding. Boundaries of ranges of the
order come from exact counts of ids (splitters.find): a range knows where its ids begin, and one
exchange brings each range together. Equal documents have one place on the curve; hash bits of the
id below it let ranges part them.

Defined results: a null or empty text is the end id alone; repeated rows are packed each for
itself; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import splitters
from .bpe import PATTERN, Codec, vocabulary_path
from .common import as_bytes, batch_of, slices, table_in_shared_folder, text_bytes

LENGTH, END = 2048, 1
#: Dimensions of the hashed vectors and of the curve's space, bits of each of the latter.
HASHED, SPACE, BITS = 256, 3, 13
AT_ONCE = 4 << 20


class WordCodec(Codec):
    """The same ids; stretches that are new are encoded by a compiled encoder of the same vocabulary."""

    def __init__(self, path: str):
        super().__init__(path)
        special = set(self.special_ids)
        ranks = {b: i for i, b in enumerate(self.bytes_of) if b and b.decode("utf-8", "replace") not in special}
        self.compiled = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _learn(self, memory: dict, keys: set[str], space: str) -> None:
        """All at once where a stretch has no line break: a break between two stretches is a word of one id for itself."""
        line, odd = [], []
        for k in keys:
            if k.isalpha():
                line.append(k)
            elif not k or k[0].isspace() or k[-1].isspace():
                memory[k] = None
            else:
                (odd if "\n" in k or not space else line).append(k)
        for k in odd if space else [*odd, *line]:
            memory[k] = array("I", self.compiled(space + k)).tobytes()
        if space and line:
            ids = np.asarray(self.compiled(space + ("\n" + space).join(line)), dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self.byte_id[10]), len(ids))
            raw = ids.tobytes()
            starts = np.concatenate([[0], ends[:-1] + 1])
            memory.update((k, raw[a:b]) for k, a, b in zip(line, (4 * starts).tolist(), (4 * ends).tolist(), strict=True))

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        return {w: array("I", self.compiled(w.decode())).tobytes() for w in set(words)}


_codecs: dict[str, WordCodec] = {}


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of rows of cell coordinates below 2**bits.

    The coordinates are turned into the curve's transposed form bit by bit from the top (inverse undo
    of exchanges and inversions, then Gray code), whose bits are interleaved.
    """
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(flip, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | (x[i] >> b) & 1
    return place


def places(ids: list[np.ndarray]) -> np.ndarray:
    """Each document's place on the curve."""
    draw = np.random.default_rng(20_011)
    projection = draw.normal(size=(HASHED, SPACE))
    projection -= projection.mean(axis=0)
    cell = (np.concatenate([*ids, np.zeros(0, dtype="<u4")]).astype(np.uint32) * np.uint32(2654435761) >> np.uint32(24)).astype(np.int64)
    cell += np.repeat(np.arange(len(ids)) * HASHED, [len(x) for x in ids])
    vectors = np.sqrt(np.bincount(cell, minlength=len(ids) * HASHED).reshape(len(ids), HASHED))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    spread = (np.tanh(vectors @ projection) + 1) / 2
    return hilbert(np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def width_of(codec: Codec) -> str:
    return "<u2" if max(len(codec.bytes_of) - 1, END) < 1 << 16 else "<u4"


def tokenized(documents: DataFrame, path: Callable[[], str] = vocabulary_path) -> DataFrame:
    """doc_id, place, weight (ids with the end), ids (unsigned, 16 bits if all the vocabulary's are below 2**16, else 32)."""
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("weight", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _codecs.setdefault(p, WordCodec(p)) if (p := path()) not in _codecs else _codecs[p]
        width = width_of(own)
        end = np.asarray([END], dtype=width).tobytes()
        for whole in batches:
            for batch in slices(whole, "text", AT_ONCE):
                ids = [np.frombuffer(x, dtype="<u4").astype(width) for x in own.encode([x.decode("utf-8", "replace") for x in as_bytes(batch, "text")])]
                yield batch_of(schema, [batch.column("doc_id"), places(ids), [len(x) + 1 for x in ids], [x.tobytes() + end for x in ids]])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "doc_id long, place long, weight long, ids binary")


def pack(documents: DataFrame, path: Callable[[], str] = vocabulary_path, length: int = LENGTH) -> DataFrame:
    """One row per piece of a document in a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = documents.sparkSession
    salt = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), F.lit(1 << 16))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 8))
    rows = table_in_shared_folder(tokenized(documents, path).withColumn("key", F.shiftleft("place", 24) + F.shiftleft(salt, 8) + place).drop("place"))
    ranges = splitters.find(rows.select("key", "weight"), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 0.25)
    bounds, starts = spark.sparkContext.broadcast(ranges.bounds), spark.sparkContext.broadcast(ranges.starts("weight"))

    @F.pandas_udf("int")
    def fine(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, keys.to_numpy(), side="right").astype(np.int32))

    keyed = rows.withColumn("fine", fine("key"))
    return keyed.repartition("fine").sortWithinPartitions("fine", "key", "doc_id", "weight").mapInArrow(_pieces(starts, length), PIECES_DDL)


PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pieces(starts, length: int):
    schema = pa.schema([(x.split()[0], pa.int64()) for x in PIECES_DDL.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fine = 0, -1
        for batch in batches:
            out = []
            for doc, ids, weight, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "weight", "fine")), strict=True):
                if own != fine:
                    fine, at = own, int(starts.value[own])
                ids = np.frombuffer(ids, dtype=f"<u{len(ids) // weight}").astype("<u4")
                start = 0
                while start < len(ids):
                    n = min(len(ids) - start, length - at % length)
                    out.append((doc, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), at // length, at % length))
                    start, at = start + n, at + n
            if out:
                yield batch_of(schema, zip(*out, strict=True))

    return run
