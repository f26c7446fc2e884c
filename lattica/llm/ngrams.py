"""Language-model scoring by deleted interpolation.

A word after h, the ORDER - 1 words before it, has the probability q_ORDER, where

    q_k = l_k * c(h_k, w) / c(h_k) + (1 - l_k) * q_(k - 1),    q_0 = 1 / (V + 1):

maximum-likelihood estimates of falling order, h_k being the k - 1 words before, whose weights l_k
depend on how frequent the context h_k is (one bucket for each power of two). The weights are learned
by expectation-maximisation: counts come from the main part of the training documents, the likelihood
from a part kept out; the counts of both are used afterwards. A context that was never met has weight
zero. Sums over all words are one, with one word for all that is unknown; what is before a text is an
end. Every word of the corpus has its own counts as word and as context; nothing is cut by frequency.

How it runs. Tasks turn documents into segments (local word numbers and the words), written once.
A segment sends every bucket its different words and n-grams of that bucket's range of hashes, sorted
and squeezed, with their times; the bucket answers each with one count for each of them, in the same
order, so what moves follows the number of different n-grams of the segments. With these counts a
segment has all that its documents' scores take. A frequent n-gram is one entry of each segment, so no
bucket is larger for it. No table of words or n-grams is broadcast or reaches the driver. Segments and
buckets grow with the square root of the corpus, so that what one sends the other is never a mere few.

N-grams are told apart by the leading bits of a 64-bit hash, COLLIDE more than the corpus has tokens
(as a power of two), so about one in 2**COLLIDE shares its count with another; words are compared whole.

Defined results: a null or empty text is the end alone; repeated rows count as often as they come; a
null id is trained on; with no training documents every estimate but the even one is zero.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batch_of, fold, table_in_shared_folder, text_bytes

ORDER = 3
#: Fold that is scored only, and the training fold that the weights are learned on.
SCORED, KEPT_OUT = 1, 2
#: Tokens of a segment and n-grams of a bucket, about, at least; buckets may be smaller while partitions are idle, down to LEAST_BUCKET.
SEGMENT, BUCKET, LEAST_BUCKET = 800_000, 1_500_000, 200_000
#: N-grams that a segment sends a bucket, about, from which both grow.
TOGETHER = 32
COLLIDE = 20
END = b""
CONTEXTS, LEVELS = 48, 64


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers; ascending ones become small as differences, byte planes apart."""
    out = []
    for x in arrays:
        d = np.diff(x.astype(np.int64), prepend=0).astype("<i8") if len(x) and (x[1:] >= x[:-1]).all() else None
        y = d if d is not None else x.astype("<i8")
        planes = max(1, -(-int(y.max()).bit_length() // 8)) if len(y) and y.min() >= 0 else 8
        out.append((d is not None, planes, np.ascontiguousarray(y.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(out, protocol=5))


def stretch(blob: bytes) -> list[np.ndarray]:
    out = []
    for summed, planes, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)):  # noqa: S301  its own tasks' bytes
        own = np.frombuffer(raw, dtype=np.uint8).reshape(planes, -1)
        x = np.zeros((own.shape[1], 8), dtype=np.uint8)
        x[:, :planes] = own.T
        x = x.view("<i8").ravel()
        out.append(np.cumsum(x) if summed else x)
    return out


def joined(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def parted(blob: bytes) -> list[bytes]:
    """Words hold no space; one word at least."""
    return zstandard.ZstdDecompressor().decompress(blob).split(b" ")


def tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def rows_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), fold("doc_id").alias("fold"), text_bytes().alias("text"))


#: What a segment's documents are for; their counts go to the main part, the part kept out, or nowhere.
MAIN, KEPT, HELD = 0, 1, 2


def segments(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """segment, part, n (tokens), data (ids, null ids, tokens of each document; word number of each token), words."""
    schema = pa.schema([("segment", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("data", pa.binary()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 24
        held = [Held() for _ in range(3)]

        def out(part: int) -> pa.RecordBatch:
            nonlocal at
            own, held[part] = held[part], Held()
            null = np.asarray([d is None for d in own.docs], dtype=np.int64)
            data = squeeze(np.asarray([d or 0 for d in own.docs]), null, np.asarray(own.size), np.concatenate(own.ids))
            at += 1
            return batch_of(schema, [[at], [part], [own.n], [data], [joined(list(own.known))]])

        for batch in batches:
            for doc, f, text in zip(batch.column("doc_id").to_pylist(), batch.column("fold").to_pylist(), as_bytes(batch, "text"), strict=True):
                part = HELD if f == SCORED else KEPT if f == KEPT_OUT else MAIN
                held[part].add(doc, tokens(text))
                if held[part].n >= most:
                    yield out(part)
        for part in range(3):
            if held[part].n:
                yield out(part)

    return rows.mapInArrow(run, "segment long, part int, n long, data binary, words binary")


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Held:
    """Documents of a segment that is being filled."""

    def __init__(self):
        self.docs: list[int | None] = []
        self.size: list[int] = []
        self.ids: list[np.ndarray] = []
        self.known = Numbers()
        self.n = 0

    def add(self, doc: int | None, own: list[bytes]) -> None:
        self.docs.append(doc)
        self.size.append(len(own))
        self.ids.append(np.fromiter(map(self.known.__getitem__, own), dtype=np.int64, count=len(own)))
        self.n += len(own)


@dataclass
class Grams:
    """What a segment asks for: its words and, for each order from 2, the sorted keys of its n-grams; of all of them the times, and which one ends at each token."""

    words: list[bytes]
    word_key: np.ndarray
    keys: list[np.ndarray]
    times: list[np.ndarray]
    spot: list[np.ndarray]
    first: np.ndarray
    docs: np.ndarray
    null: np.ndarray
    size: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def grams(data: bytes, words: bytes, bits: int) -> Grams:
    docs, null, size, ids = stretch(data)
    own = parted(words)
    h, away = hashes(own), np.uint64(64 - bits)
    order = np.argsort(h, kind="stable")
    place = np.empty(len(own), dtype=np.int64)
    place[order] = np.arange(len(own))
    own, h, ids = [own[i] for i in order.tolist()], h[order], place[ids]
    first = np.cumsum(size) - size
    keys, times, spot = [], [np.bincount(ids, minlength=len(own))], [ids]
    one = mixed(h)[ids]
    last = one
    for k in range(2, ORDER + 1):
        before = np.empty_like(last)
        before[1:] = last[:-1]
        before[first] = np.uint64(k)  # the ends before the text
        with np.errstate(over="ignore"):
            last = mixed(before * np.uint64(0xD6E8FEB86659FD93) + one)
        key, at, n = np.unique(last >> away, return_inverse=True, return_counts=True)
        keys.append(key.astype(np.int64))
        times.append(n)
        spot.append(at)
    return Grams(own, (h >> away).astype(np.int64), keys, times, spot, first, docs, null, size)


def edges(bits: int, buckets: int) -> np.ndarray:
    """Least key of each bucket, and the end of the last."""
    return np.asarray([-(-(b << bits) // buckets) for b in range(buckets + 1)], dtype=np.int64)


SENT_DDL = "bucket int, segment long, part int, data binary, words binary"


def sent(known: DataFrame, bits: int, buckets: int) -> DataFrame:
    """What each segment sends each bucket: words, keys and, where they count, times."""
    schema = pa.schema([("bucket", pa.int32()), ("segment", pa.int64()), ("part", pa.int32()), ("data", pa.binary()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = edges(bits, buckets)
        for batch in batches:
            for segment, part, data, words in zip(*(batch.column(c).to_pylist() for c in ("segment", "part", "data", "words")), strict=True):
                g = grams(data, words, bits)
                cuts = [np.searchsorted(k, edge) for k in (g.word_key, *g.keys)]
                some = np.flatnonzero(sum(np.diff(c) for c in cuts))
                for many in np.array_split(some, -(-len(some) // 256)):
                    rows = []
                    for b in many.tolist():
                        own = [slice(c[b], c[b + 1]) for c in cuts]
                        n_words = own[0].stop - own[0].start
                        times = [t[s] for t, s in zip(g.times, own, strict=True)] if part != HELD else []
                        data = squeeze(np.asarray([n_words]), *(k[s] for k, s in zip(g.keys, own[1:], strict=True)), *times)
                        rows.append((b, segment, part, data, joined(g.words[own[0]])))
                    yield batch_of(schema, zip(*rows, strict=True))

    return known.mapInArrow(run, SENT_DDL)


def together(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[list[dict]]:
    """Rows of one value of a column, from rows sorted by it."""
    own: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if own and r[name] != own[0][name]:
                yield own
                own = []
            own.append(r)
    if own:
        yield own


ANSWER = pa.schema([("segment", pa.int64()), ("part", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary()), ("words", pa.binary()), ("different", pa.int64()), ("main_different", pa.int64()), ("total", pa.int64()), ("main_total", pa.int64())])
ANSWER_DDL = "segment long, part int, bucket int, data binary, words binary, different long, main_different long, total long, main_total long"


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket to each segment's counts, and one row of each bucket (segment -1) with its different words and tokens."""
    for rows in together(batches, "bucket"):
        own = [stretch(r["data"]) for r in rows]
        names = Numbers()
        keys = [np.fromiter(map(names.__getitem__, parted(r["words"])), dtype=np.int64) if x[0][0] else np.zeros(0, dtype=np.int64) for r, x in zip(rows, own, strict=True)]
        answers: list[list[np.ndarray]] = [[] for _ in rows]
        stats = None
        for k in range(ORDER):
            keys = [x[k] for x in own] if k else keys
            size = [len(x) for x in keys]
            at = np.concatenate(keys)
            if k:
                key, at = np.unique(at, return_inverse=True)
            n = len(key) if k else len(names)
            part = np.repeat([r["part"] for r in rows], size)
            times = np.concatenate([x[ORDER + k] if r["part"] != HELD else np.zeros(m, dtype=np.int64) for r, x, m in zip(rows, own, size, strict=True)])
            main, all_of = (np.bincount(at, weights=times * (part <= p), minlength=n).astype(np.int64) for p in (MAIN, KEPT))
            if not k:
                stats = [int((all_of > 0).sum()), int((main > 0).sum()), int(all_of.sum()), int(main.sum())]
            start = 0
            for r, m, answer in zip(rows, size, answers, strict=True):
                spot = at[start : start + m]
                answer.append(all_of[spot])
                if r["part"] == KEPT:
                    answer.append(main[spot])
                start += m
        yield batch_of(ANSWER, [[-1], [None], [rows[0]["bucket"]], [None], [None], *([x] for x in stats)])
        yield batch_of(ANSWER, [[r["segment"] for r in rows], [r["part"] for r in rows], [r["bucket"] for r in rows], [squeeze(*a) for a in answers], *[[None] * len(rows)] * 5])


def context_bucket(n: np.ndarray) -> np.ndarray:
    """0 for what was never met, else one for each power of two."""
    return np.minimum(np.where(n > 0, 1 + np.log2(np.maximum(n, 1)).astype(np.int64), 0), CONTEXTS - 1)


def estimates(g: Grams, counts: list[np.ndarray], total: int, ends: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """At each token, by order: the estimate, and (from order 2) the context's bucket. counts: of words, then of n-grams by order; ends: training documents."""
    at = counts[0][g.spot[0]]
    found, contexts = [at / max(total, 1)], []
    for k in range(1, ORDER):
        context = np.empty_like(at)
        context[1:] = at[:-1]
        context[g.first] = ends
        at = counts[k][g.spot[k]]
        found.append(at / np.maximum(context, 1))
        contexts.append(context_bucket(context))
    return found, contexts


@dataclass(frozen=True)
class Weights:
    """By order: the weight of its estimate in each context bucket (one bucket for words)."""

    of: list[np.ndarray]

    def mix(self, found: list[np.ndarray], contexts: list[np.ndarray], different: int) -> list[np.ndarray]:
        """q_0 to q_ORDER."""
        q = [np.full(len(found[0]), 1 / (different + 1))]
        for k, p in enumerate(found):
            weight = self.of[k][contexts[k - 1] if k else np.zeros(len(p), dtype=np.int64)]
            q.append(weight * p + (1 - weight) * q[-1])
        return q


@dataclass(frozen=True)
class Totals:
    different: int
    main_different: int
    total: int
    main_total: int


def segment_rows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[dict, Grams, list[list[np.ndarray]]]]:
    """Each segment's row, n-grams and counts (lists by order: of all training documents, then of the main part if it is kept out), from rows sorted by segment and bucket."""
    for rows in together(batches, "segment"):
        g = grams(rows[0]["data"], rows[0]["words"], bits)
        answers = [stretch(r["data"]) for r in rows[1:]]
        step = 2 if rows[0]["part"] == KEPT else 1
        yield rows[0], g, [[np.concatenate([a[step * k + i] for a in answers]) for k in range(ORDER)] for i in range(step)]


def ends_of(g: Grams, counts: list[np.ndarray]) -> int:
    """Training documents: each has one end."""
    return int(counts[0][g.spot[0][g.first[0] + g.size[0] - 1]])


def gathered(known: DataFrame, answers: DataFrame, tasks: int) -> DataFrame:
    """Segments and the counts they asked for, side by side."""
    asked = known.select("segment", "part", F.lit(-1).alias("bucket"), "data", "words")
    return asked.unionByName(answers.select("segment", "part", "bucket", "data", "words")).repartition(tasks, "segment").sortWithinPartitions("segment", "bucket")


#: Contexts' buckets and estimates' levels, by order.
BIN = (CONTEXTS,) * (ORDER - 1) + (LEVELS,) * ORDER


def level_of(p: np.ndarray) -> np.ndarray:
    """0 for nothing, else one for each power of two, up to LEVELS."""
    return np.where(p > 0, np.minimum(1 + np.floor(-np.log2(np.where(p > 0, p, 1))).astype(np.int64), LEVELS - 1), 0)


def bins(batches: Iterator[pa.RecordBatch], bits: int, totals: Totals) -> Iterator[pa.RecordBatch]:
    """Tokens of the part kept out, by levels of their estimates and by context buckets: how many, and sums of the estimates."""
    schema = pa.schema([("bin", pa.int64()), ("n", pa.int64()), *((f"p{k}", pa.float64()) for k in range(ORDER))])
    for _, g, (_, main) in segment_rows(batches, bits):
        found, contexts = estimates(g, main, totals.main_total, ends_of(g, main))
        whole, at = np.unique(np.ravel_multi_index([*contexts, *map(level_of, found)], BIN), return_inverse=True)
        sums = [np.bincount(at, weights=p, minlength=len(whole)) for p in found]
        yield batch_of(schema, [whole, np.bincount(at, minlength=len(whole)), *sums])


def learn(known: DataFrame, answers: DataFrame, bits: int, totals: Totals, tasks: int) -> Weights:
    """Expectation-maximisation on tokens gathered in bins: a table bounded by levels and buckets, each bin with the mean of its estimates."""
    rows = gathered(known.filter(F.col("part") == KEPT), answers.filter(F.col("part") == KEPT), tasks)
    ddl = "bin long, n long, " + ", ".join(f"p{k} double" for k in range(ORDER))
    seen = rows.mapInArrow(lambda b: bins(b, bits, totals), ddl).groupBy("bin").agg(F.sum("n").alias("n"), *(F.sum(f"p{k}").alias(f"p{k}") for k in range(ORDER))).orderBy("bin").toArrow()
    n = seen.column("n").to_numpy().astype(float)
    found = [seen.column(f"p{k}").to_numpy() / n for k in range(ORDER)]
    contexts = list(np.unravel_index(seen.column("bin").to_numpy(), BIN)[: ORDER - 1])
    return maximised(n, found, contexts, totals.main_different)


def maximised(n: np.ndarray, found: list[np.ndarray], contexts: list[np.ndarray], different: int, rounds: int = 60) -> Weights:
    """The weights under which the outcomes (n times each, with these estimates) are likeliest."""
    zero = np.zeros(len(n), dtype=np.int64)
    at = [zero, *contexts]
    size = [1] + [CONTEXTS] * (ORDER - 1)
    w = Weights([np.full(s, 0.5) for s in size])
    for _ in range(rounds if len(n) else 0):
        q = w.mix(found, contexts, different)
        reached, new = n, [None] * ORDER
        for k in reversed(range(ORDER)):
            weight = w.of[k][at[k]]
            used = reached * weight * found[k] / q[k + 1]
            a, b = (np.bincount(at[k], weights=x, minlength=size[k]) for x in (used, reached))
            new[k] = np.where(b > 0, a / np.where(b > 0, b, 1), w.of[k])
            reached = reached - used
        w = Weights([np.clip(x, 1e-6, 1 - 1e-6) for x in new])
    of = [w.of[0]]
    for k in range(1, ORDER):
        own, seen = w.of[k].copy(), np.bincount(at[k], weights=n, minlength=CONTEXTS) > 0
        for b in range(1, CONTEXTS):
            own[b] = own[b] if seen[b] else own[b - 1] if seen[:b].any() else own[b]
        own[0] = 0.0  # nothing is known of what follows
        of.append(own)
    return Weights(of)


OUT_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(batches: Iterator[pa.RecordBatch], bits: int, totals: Totals, weights: Weights) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])
    for r, g, (counts, *_) in segment_rows(batches, bits):
        found, contexts = estimates(g, counts, totals.total, ends_of(g, counts))
        q = weights.mix(found, contexts, totals.different)[-1]
        word = counts[0][g.spot[0]]
        base = np.log10((word + 0.5) / (totals.total + 0.5 * (totals.different + 1)))
        n = len(g.docs)
        known = np.add.reduceat((word > 0).astype(np.int64), g.first)
        held = np.full(n, r["part"] == HELD)
        yield batch_of(schema, [pa.array(g.docs, mask=g.null.astype(bool)), held, g.size, known, np.full(n, totals.total), np.add.reduceat(base, g.first), np.add.reduceat(np.log10(q), g.first)])


@dataclass(frozen=True)
class Trained:
    """known: the segments; answers: the counts that each of them needs."""

    known: DataFrame
    answers: DataFrame
    bits: int
    totals: Totals
    weights: Weights
    tasks: int


def train(documents: DataFrame, segment: int = SEGMENT, bucket: int = BUCKET) -> Trained:
    rows = rows_of(documents)
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    about = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * ORDER // 8
    even = round((about * TOGETHER) ** 0.5)
    known = table_in_shared_folder(segments(rows, max(segment, even)))
    n, n_segments = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    asked = n * (ORDER - 1)
    # As many buckets as the n-grams need, or as there are partitions while each still gets a fair number.
    buckets = max(-(-asked // max(bucket, even)), min(partitions, -(-asked // LEAST_BUCKET)), 1)
    bits = min(62, int(asked).bit_length() + COLLIDE)
    tasks = lambda most: max(min(most, 4 * partitions), 1)
    dealt = sent(known, bits, buckets).repartition(tasks(buckets), "bucket").sortWithinPartitions("bucket")
    answers = table_in_shared_folder(dealt.mapInArrow(count, ANSWER_DDL))
    stats = answers.filter("segment = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("different", "main_different", "total", "main_total"))).first()
    totals, answers = Totals(*map(int, stats)), answers.filter("segment >= 0")
    return Trained(known, answers, bits, totals, learn(known, answers, bits, totals, tasks(n_segments)), tasks(n_segments))


def score(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    return scored(train(documents))


def scored(t: Trained) -> DataFrame:
    bits, totals, weights = t.bits, t.totals, t.weights
    return gathered(t.known, t.answers, t.tasks).mapInArrow(lambda b: scores(b, bits, totals, weights), OUT_DDL)
