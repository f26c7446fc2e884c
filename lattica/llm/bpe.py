"""Byte-pair encoding by contiguous rank arrays, and decoding.

A short word is a row of parts beside the ranks of adjacent parts. The least rank is scanned for,
the boundary there is deleted, and the two neighbouring ranks are refreshed, until no pair of parts
has a rank; many words go through these steps side by side as rows of one array. Long words, for
which repeated scans would be quadratic, keep their ranks in a heap.

Words come from the vocabulary's own pattern. Texts are first cut at single spaces between
non-spaces, which never lie inside a word, so that each different stretch is encoded once and then
looked up; the memory of stretches is bounded.

Defined results: a null or empty text has no ids; equal texts have equal ids; other columns stay out.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batch_of, slices, text_bytes

#: Fixed value: the pattern that public byte-level vocabularies split text by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.iinfo(np.int32).max
#: Bytes of a word up to which ranks are scanned; stretches kept in memory; bytes of text at a time.
SHORT, KEPT, AT_ONCE = 64, 400_000, 4 << 20


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary lies on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def alphabet() -> dict[str, int]:
    """Characters that stand for bytes: printable ones for themselves, the others shifted past 255 in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters, vocab = alphabet(), data["model"]["vocab"]
        special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token) if token not in special else token.encode()
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.zeros(256, dtype=np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        keys = np.asarray([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, NONE).astype(np.int32)
        self.made = np.asarray([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.pair_rank = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.special_ids = {s: np.asarray([i], dtype="<u4").tobytes() for s, i in special.items()}
        self.words = regex.compile(PATTERN)
        self.first: dict[str, bytes | None] = {}
        self.later: dict[str, bytes | None] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = np.where((left < 0) | (right < 0), -1, left << 32 | right)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def scan(self, words: list[bytes]) -> list[bytes]:
        """Ids of short words, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        width = max(map(len, words))
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(-1, width)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        own, columns = np.arange(len(words)), np.arange(width)
        parts = np.where(columns < size[:, None], self.byte_id[raw], -1)
        parts = np.pad(parts, ((0, 0), (0, 2)), constant_values=-1)
        rank = self.ranks(parts[:, :-1], parts[:, 1:])
        while len(own):
            at = rank.argmin(axis=1)
            line = np.arange(len(own))
            least = rank[line, at]
            live = least < NONE
            if not live.all():
                for i, row, n in zip(own[~live].tolist(), parts[~live].astype("<u4"), size[~live].tolist(), strict=True):
                    out[i] = row[:n].tobytes()
                own, parts, rank, size, at, least = (x[live] for x in (own, parts, rank, size, at, least))
                if not len(own):
                    break
                line = line[: len(own)]
            size -= 1
            keep = np.arange(parts.shape[1] - 1)
            take = keep + (keep > at[:, None])  # the boundary after part `at` goes
            parts[line, at] = self.made[least]
            parts = np.take_along_axis(parts, take, axis=1)
            rank = np.take_along_axis(np.pad(rank, ((0, 0), (0, 1)), constant_values=NONE), take[:, :-1] if take.shape[1] > rank.shape[1] else take, axis=1)[:, : parts.shape[1] - 1]
            rank[line, at] = self.ranks(parts[line, at], parts[line, np.minimum(at + 1, parts.shape[1] - 1)])
            before = np.maximum(at - 1, 0)
            rank[line, before] = np.where(at > 0, self.ranks(parts[line, before], parts[line, at]), rank[line, before])
        return out

    def long(self, word: bytes) -> bytes:
        """Ids of a long word: the ranks wait in a heap, the parts are a linked list."""
        ids = self.byte_id[np.frombuffer(word, dtype=np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := self.pair_rank.get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.made[r]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := self.pair_rank.get(ids[k] << 32 | ids[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
        return np.asarray([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each different word."""
        different = sorted(filter(None, set(words)), key=len)
        out = {b"": b""}
        start = 0
        for most in (8, 16, 32, SHORT):
            stop = start
            while stop < len(different) and len(different[stop]) <= most:
                stop += 1
            for k in range(start, stop, 20_000):
                part = different[k : min(k + 20_000, stop)]
                out.update(zip(part, self.scan(part), strict=True))
            start = stop
        out.update((w, self.long(w)) for w in different[start:])
        return out

    def _learn(self, memory: dict, keys: set[str], space: str) -> None:
        """Encodes stretches, each after `space`. One that a space could join to its neighbour is kept as None."""
        plain = [k for k in keys if k.isalpha()]
        rest = [k for k in keys if not k.isalpha()]
        cuts = [() if not k or k[0].isspace() or k[-1].isspace() else self.words.findall(space + k) for k in rest]
        words = [(space + k).encode() for k in plain]
        ids = self.encode_words(words + [w.encode() for c in cuts for w in c])
        memory.update(zip(plain, map(ids.__getitem__, words), strict=True))
        for k, c in zip(rest, cuts, strict=True):
            memory[k] = b"".join([ids[w.encode()] for w in c]) if c else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        segments = [self.special_split.split(t) if self.special_split and any(s in t for s in self.special_ids) else [t] for t in texts]
        stretches = [[s.split(" ") for s in row] for row in segments]
        heads = {s[0] for row in stretches for s in row}
        tails: set[str] = set()
        for row in stretches:
            for s in row:
                tails.update(s)
        if len(self.later) + len(self.first) > KEPT:  # what is met again now is kept
            self.first = {k: self.first[k] for k in heads & self.first.keys()}
            self.later = {k: self.later[k] for k in tails & self.later.keys()}
        heads -= self.first.keys()
        tails -= self.later.keys()
        self._learn(self.first, heads, "")
        self._learn(self.later, tails, " ")
        out = []
        for row, cut in zip(segments, stretches, strict=True):
            ids = []
            for i, (segment, s) in enumerate(zip(row, cut, strict=True)):
                if i % 2:
                    ids.append(self.special_ids[segment])
                elif segment:
                    try:
                        ids.append(self.first[s[0]] + b"".join(map(self.later.__getitem__, s[1:])))
                    except TypeError:  # spaces beside white space: the pattern must see the whole
                        found = [w.encode() for w in self.words.findall(segment)]
                        known = self.encode_words(found)
                        ids.append(b"".join(map(known.__getitem__, found)))
            out.append(b"".join(ids))
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each Python worker and path."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def round_trip(documents: DataFrame, path: Callable[[], str] = vocabulary_path) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them.

    path: gives the vocabulary's place, asked for where the task runs.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path())
        for whole in batches:
            for batch in slices(whole, "text", AT_ONCE):
                ids = own.encode([x.decode("utf-8", "replace") for x in as_bytes(batch, "text")])
                yield batch_of(
                    schema,
                    [
                        batch.column("doc_id"),
                        [len(x) // 4 for x in ids],
                        [hashlib.sha256(x).hexdigest() for x in ids],
                        [hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids],
                    ],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
