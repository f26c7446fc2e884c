"""Removal of repeated passages by maximal repeats of an enhanced suffix array.

Every string of LENGTH bytes has one anchor: the GRAM-byte piece in it with the least hash, the first
of equals. Equal strings have their anchors at the same place, so strings can be compared anchor by
anchor. Documents are dealt into blocks of a few megabytes, and

1. each block sends the hashes of its different anchors, once each; those met in two documents or
   more are sent back to the blocks that have them;
2. each block sends the surroundings (context) of those anchors, each different one once with the
   smallest id that has it: a passage in very many documents is one row per block;
3. where the contexts of an anchor meet, different contexts make a text whose suffixes are sorted;
   a stack runs over the common prefix lengths of neighbours and pops the intervals of the
   common-prefix tree; an interval that can be extended to the left in two ways is a maximal repeat,
   and all its occurrences get its smallest id;
4. the blocks hear which of their contexts' strings have a smaller owner, and remove their bytes.

Defined results: a null or empty text has no bytes and loses none; rows with equal ids don't repeat
each other; a null id counts as larger than any other; texts under LENGTH bytes lose nothing; other
columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

LENGTH, GRAM = 50, 24
#: Bytes of text in a block, and bytes hashed at a time.
BLOCK, STEP = 4 << 20, 1 << 17
#: Bytes before an anchor that belong to a string with it, bytes of a context, strings in a context.
BEFORE = LENGTH - GRAM
WIDTH, STARTS = BEFORE + LENGTH, BEFORE + 1
#: Contexts looked at and suffixes sorted at a time, about.
PART, SUFFIXES = 1 << 15, 250_000
#: A byte that no UTF-8 text has stands where a document ends.
OUTSIDE, NO_ID = 0xFF, np.iinfo(np.int64).max
_BASE = 0x100000001B3


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each place on, by doubling: two known lengths make their sum."""
    power, span, done, have = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if size & span:
            if done is None:
                done, have = power, span
            else:
                n = len(data) - have - span + 1
                done, have = done[:n] * np.uint64(pow(_BASE, span, 1 << 64)) + power[have : have + n], have + span
        if have == size:
            return mixed(done)
        n = len(power) - span
        power = power[:n] * np.uint64(pow(_BASE, span, 1 << 64)) + power[span : span + n]
        span *= 2


class Block:
    """Documents of a block, one after another, with the anchors of their strings."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.ids = ids
        self.size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.at, self.hash = self._anchors()
        self.row = np.searchsorted(self.end, self.at, side="right")

    def _anchors(self) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(self.data), LENGTH - GRAM + 1
        places, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        last = -1
        if n >= LENGTH:
            ends = np.repeat(self.end, self.size)
            for a in range(0, n - LENGTH + 1, STEP):
                own = self.data[a : a + STEP + LENGTH - 1]
                h = gram_hashes(own, GRAM)
                low = np.uint64((1 << 18) - 1)  # the place in the step makes the first of equal hashes the least
                least, span = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
                key = least
                while 2 * span <= width:
                    least, span = np.minimum(least[:-span], least[span:]), 2 * span
                m = len(key) - width + 1
                least = np.minimum(least[:m], least[width - span : width - span + m])
                begin = np.arange(a, a + m)
                pick = (least[begin + LENGTH <= ends[a : a + m]] & low).astype(np.int64)
                pick = pick[np.concatenate([[True], pick[1:] != pick[:-1]])] if len(pick) else pick
                if len(pick) and pick[0] + a == last:
                    pick = pick[1:]
                if len(pick):
                    last = int(pick[-1]) + a
                    places.append(pick + a)
                    hashes.append(h[pick])
        at, h = np.concatenate(places), np.concatenate(hashes)
        at, first = np.unique(at, return_index=True)
        return at, h[first]

    def contexts(self, pick: np.ndarray) -> np.ndarray:
        """A row of WIDTH bytes around each of the anchors; OUTSIDE past the ends of their document."""
        out = np.full((len(pick), WIDTH), OUTSIDE, dtype=np.uint8)
        for k in range(0, len(pick), PART):
            own = pick[k : k + PART]
            at, row = self.at[own], self.row[own]
            place = at[:, None] + np.arange(-BEFORE, LENGTH)
            inside = (place >= self.start[row][:, None]) & (place < self.end[row][:, None])
            out[k : k + PART][inside] = self.data[place[inside]]
        return out


def row_hashes(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), dtype=np.uint64)
    for k in range(rows.shape[1]):
        out = out * np.uint64(_BASE) + rows[:, k].astype(np.uint64) + np.uint64(1)
    return mixed(out)


def classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each class of equal rows, class of each row); exact, hashes only speed it up."""
    _, first, own = np.unique(row_hashes(rows), return_index=True, return_inverse=True)
    if len(rows) and not (rows[first[own]] == rows).all():
        whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel()
        _, first, own = np.unique(whole, return_index=True, return_inverse=True)
    return first, own


# The enhanced suffix array.


def suffix_order(rows: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes (row, start) and the length of each one's common prefix with the one before it.

    A suffix ends with its row's bytes, or where OUTSIDE begins; ends differ from each other and from bytes.
    """
    padded = np.pad(rows, ((0, 0), (0, WIDTH + 8)), constant_values=OUTSIDE)
    words = np.lib.stride_tricks.sliding_window_view(padded, WIDTH + 4, axis=1)[row, start]
    keys = np.ascontiguousarray(words).view(">u8").astype(np.uint64)
    order = np.lexsort(keys.T[::-1])
    a, b = words[order[:-1]], words[order[1:]]
    differ = (a != b) | (a == OUTSIDE)
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
    return order, np.concatenate([[0], common])


def maximal_repeats(common: np.ndarray, left: np.ndarray, owner: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(length, first, last, smallest owner) of the intervals first..last of the suffix order that are maximal repeats.

    common: common prefix with the suffix before. left: the byte before each suffix, negative and different where there is none.
    """
    edges = np.flatnonzero(np.concatenate([common, [0]]) < least)
    change = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    spans = [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if b - a > 1 and change[b - 1] > change[a]]
    for a, b in spans:
        own, lengths = owner[a:b].tolist(), common[a:b].tolist()
        stack: list[list[int]] = []  # length, first, smallest owner of the open intervals
        for i in range(1, b - a + 1):
            here = lengths[i] if i < b - a else least - 1
            first, smallest = i - 1, own[i - 1]
            while stack and stack[-1][0] > here:
                length, first, seen = stack.pop()
                smallest = min(smallest, seen)
                if change[a + i - 1] > change[a + first]:
                    yield length, a + first, a + i - 1, smallest
                if stack and stack[-1][0] >= here:
                    stack[-1][2] = min(stack[-1][2], smallest)
            if here >= least:
                if stack and stack[-1][0] == here:
                    stack[-1][2] = min(stack[-1][2], smallest)
                else:
                    stack.append([here, first, smallest])


def smaller_owner(rows: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For different contexts with their smallest ids: a bit for each string that a context with a smaller id has too."""
    mask = np.zeros(len(rows), dtype=np.uint64)
    if len(rows) < 2:
        return mask
    inside = rows != OUTSIDE
    first, after = inside.argmax(axis=1), WIDTH - inside[:, ::-1].argmax(axis=1)
    j = np.arange(STARTS)
    row, start = np.nonzero((j >= first[:, None]) & (j + LENGTH <= after[:, None]))
    hashes = np.concatenate([string_hashes(rows[a : a + PART]) for a in range(0, len(rows), PART)])
    _, kind, times = np.unique(hashes[row, start], return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[kind] > 1)  # suffixes whose first LENGTH bytes nobody shares have no part in a repeat
    # Suffixes are sorted some at a time; those with the same first LENGTH bytes stay together, and no interval is wider.
    parts = -(-len(again) // SUFFIXES)
    for k in range(parts):
        own = again[kind[again] % parts == k] if parts > 1 else again
        _mark(mask, rows, owner, row[own], start[own])
    return mask


def string_hashes(rows: np.ndarray) -> np.ndarray:
    """A hash of the LENGTH bytes from each of the STARTS places of each context."""
    power = np.uint64(pow(_BASE, LENGTH, 1 << 64))
    prefix = np.zeros((WIDTH + 1, len(rows)), dtype=np.uint64)
    for k in range(WIDTH):
        prefix[k + 1] = prefix[k] * np.uint64(_BASE) + rows[:, k].astype(np.uint64) + np.uint64(1)
    return np.stack([prefix[j + LENGTH] - prefix[j] * power for j in range(STARTS)], axis=1)


def _mark(mask: np.ndarray, rows: np.ndarray, owner: np.ndarray, row: np.ndarray, start: np.ndarray) -> None:
    if not len(row):
        return
    order, common = suffix_order(rows, row, start)
    row, start = row[order], start[order]
    before = rows[row, np.maximum(start - 1, 0)].astype(np.int64)
    left = np.where((start > 0) & (before != OUTSIDE), before, -1 - np.arange(len(row)))
    for length, a, b, smallest in maximal_repeats(common, left, owner[row], LENGTH):
        at = np.arange(a, b + 1)
        at = at[owner[row[at]] > smallest]
        bits = np.uint64((1 << min(length - LENGTH + 1, STARTS)) - 1)
        np.bitwise_or.at(mask, row[at], (bits << start[at].astype(np.uint64)) & np.uint64((1 << STARTS) - 1))


# The Spark job.


def press(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def pressed(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def _low(h: np.ndarray) -> np.ndarray:
    """48 bits of an anchor's hash: what is compared to find shared ones. Equal bits of different anchors only cost time."""
    return h & np.uint64((1 << 48) - 1)


def _buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)


def _block(docs: pa.Table) -> tuple[Block, pa.Table]:
    """The block and its rows, in the order of ids, then texts: a shuffle brings them in any order, and places must stay the same."""
    ids, texts = docs.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_pylist(), docs.column("_bytes").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return Block(np.asarray([ids[i] for i in order], dtype=np.int64), [texts[i] for i in order]), docs.take(pa.array(order))


def _runs(of: np.ndarray) -> Iterator[tuple[int, slice]]:
    edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(of[a]), slice(a, b)


def send_anchors(buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("several", pa.binary())])

    def run(docs: pa.Table) -> pa.Table:
        block, _ = _block(docs)
        low = _low(block.hash)
        value, kind = np.unique(low, return_inverse=True)
        smallest, largest = np.full(len(value), NO_ID), np.full(len(value), -NO_ID)
        np.minimum.at(smallest, kind, block.ids[block.row])
        np.maximum.at(largest, kind, block.ids[block.row])
        to = _buckets(value, buckets)
        order = np.argsort(to, kind="stable")
        value, to, several = value[order], to[order], (smallest != largest)[order]
        number = docs.column("_block")[0].as_py()
        out = [(b, number, (value[s] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), (value[s] >> np.uint64(32)).astype("<u2").tobytes(), np.packbits(several[s]).tobytes()) for b, s in _runs(to)] if len(to) else []
        return pa.Table.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)

    return run


SHARED_DDL = "block int, shared binary"


def find_shared(rows: pa.Table) -> pa.Table:
    values, several = [], []
    for low, high, flags in zip(rows.column("low").to_pylist(), rows.column("high").to_pylist(), rows.column("several").to_pylist(), strict=True):
        values.append(np.frombuffer(low, dtype="<u4").astype(np.uint64) | np.frombuffer(high, dtype="<u2").astype(np.uint64) << np.uint64(32))
        several.append(np.unpackbits(np.frombuffer(flags, dtype=np.uint8), count=len(values[-1])).astype(bool))
    value, kind, times = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    shared = times > 1
    shared[kind[np.concatenate(several)]] = True
    own, at, out = shared[kind], 0, []
    for block, v in zip(rows.column("block").to_pylist(), values, strict=True):
        if len(found := v[own[at : at + len(v)]]):
            out.append({"block": block, "shared": found.astype("<u8").tobytes()})
        at += len(v)
    return pa.Table.from_pylist(out, schema=pa.schema([("block", pa.int32()), ("shared", pa.binary())]))


CONTEXT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("contexts", pa.binary()), ("ids", pa.binary()), ("places", pa.binary())])


def send_contexts(buckets: int):
    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        if not docs.num_rows or not shared.num_rows:
            return CONTEXT.empty_table()
        block, _ = _block(docs)
        known = np.sort(np.concatenate([np.frombuffer(x, dtype="<u8") for x in shared.column("shared").to_pylist()]))
        low = _low(block.hash)
        at = np.minimum(np.searchsorted(known, low), len(known) - 1)
        pick = np.flatnonzero(known[at] == low)
        out = []
        if len(pick):
            rows = block.contexts(pick)
            first, own = classes(rows)
            smallest = np.full(len(first), NO_ID)
            np.minimum.at(smallest, own, block.ids[block.row[pick]])
            to = _buckets(low[pick[first]], buckets)
            order = np.argsort(to, kind="stable")
            number = docs.column("_block")[0].as_py()
            for b, s in _runs(to[order]):
                part = order[s]
                out.append((b, number, *map(press, (rows[first[part]], smallest[part].astype("<i8"), block.at[pick[first[part]]].astype("<i8")))))
        return pa.Table.from_pylist([dict(zip(CONTEXT.names, x, strict=True)) for x in out], schema=CONTEXT)

    return run


OWNED = pa.schema([("block", pa.int32()), ("places", pa.binary()), ("masks", pa.binary())])


def compare_contexts(found: pa.Table) -> pa.Table:
    """For each block's contexts: which strings have an owner smaller than the block's smallest id for that context."""
    blocks, many, rows, ids, places = [], [], [], [], []
    for block, c, i, p in zip(*(found.column(x).to_pylist() for x in ("block", "contexts", "ids", "places")), strict=True):
        rows.append(pressed(c, np.uint8).reshape(-1, WIDTH))
        ids.append(pressed(i, "<i8"))
        places.append(pressed(p, "<i8"))
        blocks.append(block)
        many.append(len(rows[-1]))
    rows, ids, places = np.concatenate(rows), np.concatenate(ids), np.concatenate(places)
    first, own = classes(rows)
    smallest = np.full(len(first), NO_ID)
    np.minimum.at(smallest, own, ids)
    different = rows[first]
    gram = row_hashes(different[:, BEFORE : BEFORE + GRAM])
    _, kind, times = np.unique(gram, return_inverse=True, return_counts=True)
    mixed_group = np.flatnonzero(times[kind] > 1)  # an anchor with one context only has nothing to compare
    mask = np.zeros(len(first), dtype=np.uint64)
    mask[mixed_group] = smaller_owner(different[mixed_group], smallest[mixed_group])
    result = np.where(ids > smallest[own], np.uint64((1 << STARTS) - 1), mask[own])
    out, at = [], 0
    for block, n in zip(blocks, many, strict=True):
        part = np.flatnonzero(result[at : at + n])
        if len(part):
            out.append({"block": block, "places": places[at + part].astype("<i8").tobytes(), "masks": result[at + part].astype("<u4").tobytes()})
        at += n
    return pa.Table.from_pylist(out, schema=OWNED)


def removed_bytes(block: Block, places: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """A flag for each byte of the block. places: of one anchor of each context that has strings with smaller owners elsewhere."""
    none = np.zeros(len(block.data), dtype=bool)
    if not len(block.at):
        return none
    # contexts are equal within the block only where the hashed anchors are
    _, kind, times = np.unique(block.hash, return_inverse=True, return_counts=True)
    told = np.zeros(len(block.at), dtype=np.uint64)
    told[np.searchsorted(block.at, places)] = masks
    has = np.zeros(len(times), dtype=bool)
    has[kind[told > 0]] = True
    pick = np.flatnonzero((times[kind] > 1) | has[kind])
    if not len(pick):
        return none
    first, own = classes(block.contexts(pick))
    smallest, mask = np.full(len(first), NO_ID), np.zeros(len(first), dtype=np.uint64)
    ids, row, at = block.ids[block.row[pick]], block.row[pick], block.at[pick]
    np.minimum.at(smallest, own, ids)
    np.bitwise_or.at(mask, own, told[pick])
    final = np.where(ids > smallest[own], np.uint64((1 << STARTS) - 1), mask[own])
    hit = np.flatnonzero(final)
    begin = at[hit][:, None] + (np.arange(STARTS) - BEFORE)
    flagged = (final[hit][:, None] >> np.arange(STARTS, dtype=np.uint64) & np.uint64(1)).astype(bool)
    flagged &= (begin >= block.start[row[hit]][:, None]) & (begin + LENGTH <= block.end[row[hit]][:, None])
    begun = np.cumsum(np.bincount(begin[flagged], minlength=len(none)))
    begun[LENGTH:] -= begun[:-LENGTH].copy()  # strings that began in the last LENGTH bytes
    return begun > 0


def digest(docs: pa.Table, block: Block, gone: np.ndarray) -> pa.Table:
    n_removed, n_spans, kept = [], [], []
    for a, b in zip(block.start.tolist(), block.end.tolist(), strict=True):
        own = gone[a:b]
        n_removed.append(int(own.sum()))
        n_spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
        kept.append(hashlib.sha256(block.data[a:b][~own].tobytes()).hexdigest())
    return pa.table({"doc_id": docs.column("doc_id").cast(pa.int64()), "n_bytes": block.size, "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(kept, pa.string())})


DIGEST_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def rewritten(docs: pa.Table, block: Block, gone: np.ndarray) -> pa.Table:
    """Documents with what is left of their texts and its length; characters cut in two go, and so do documents of which nothing is left."""
    texts = [block.data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(block.start.tolist(), block.end.tolist(), strict=True)]
    keep = pa.array([bool(t.strip()) or n == 0 for t, n in zip(texts, block.size.tolist(), strict=True)])
    row = docs.column("_row").combine_chunks()
    own = pa.table(row.flatten(), names=[f.name for f in row.type])
    if "n_chars" in own.column_names:
        own = own.set_column(own.column_names.index("n_chars"), "n_chars", pa.array([len(t) for t in texts]).cast(own.schema.field("n_chars").type))
    empty = pa.array([t if n else None for t, n in zip(texts, block.size.tolist(), strict=True)], pa.string())
    was = own.column("text").combine_chunks()
    return own.set_column(own.column_names.index("text"), "text", pc.coalesce(empty, was)).filter(keep)


def remove_repeats(documents: DataFrame, finish=digest, ddl: str = DIGEST_DDL, carry: bool = False, block_bytes: int = BLOCK) -> DataFrame:
    """What `finish` makes of each block's documents; carry: give it all columns, as the struct _row."""
    spark = documents.sparkSession
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks // 2)
    whole = [F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_row")] if carry else []
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("_bytes"), *whole)
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("doc_id", "_bytes"), F.lit(blocks)).cast("int"))
    by_block = rows.groupBy("_block")

    def mark(docs: pa.Table, owned: pa.Table) -> pa.Table:
        block, docs = _block(docs)
        places = [np.frombuffer(x, dtype="<i8") for x in owned.column("places").to_pylist()]
        masks = [np.frombuffer(x, dtype="<u4").astype(np.uint64) for x in owned.column("masks").to_pylist()]
        gone = removed_bytes(block, np.concatenate([np.zeros(0, dtype=np.int64), *places]), np.concatenate([np.zeros(0, dtype=np.uint64), *masks]))
        return finish(docs, block, gone)

    anchors = by_block.applyInArrow(send_anchors(buckets), "bucket int, block int, low binary, high binary, several binary")
    shared = anchors.groupBy("bucket").applyInArrow(find_shared, SHARED_DDL)
    contexts = by_block.cogroup(shared.groupBy("block")).applyInArrow(send_contexts(buckets), "bucket int, block int, contexts binary, ids binary, places binary")
    owned = contexts.groupBy("bucket").applyInArrow(compare_contexts, "block int, places binary, masks binary")
    return by_block.cogroup(owned.groupBy("block")).applyInArrow(mark, ddl)


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents with repeated passages cut out of their texts, with all their columns."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return remove_repeats(documents, rewritten, ddl, carry=True)
