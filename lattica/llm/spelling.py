"""Spelling variants: words one edit apart, and the commoner form that each is a variant of.

Two words of equal length that differ in one code point agree once that place is deleted from both; where
one has a code point more, deleting it gives the other. So each word has a number (key) for itself and for
each of its deletions: the polynomial hash of what stands before the place plus that of what stands after,
worked out by NumPy from running sums over the code points of many words at once. A run of equal code
points gives one string, so one row with the run's first and last place.

Keys are dealt by their leading bits and sorted. A key that words meet under is looked at with the words'
strings, so a collision of hashes is never a link. Words that agree without place p differ there and
nowhere else: at most as many as there are letters, each near to all others, so counts and the best
neighbour follow from the group and no pair is formed. A word itself is near to all that give it by a deletion.

Defined results: a null text has no words; a null id changes no run; repeated rows count one by one; ties
of frequency go to the smallest word in code-point order; an empty table has no words; other columns are not
looked at. Long runs are words like others: a word of m code points has at most m + 1 rows of four numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, cut, table_in_shared_folder

#: Code points and occurrences that a word has at least; a run of a document is changed where this divides its checksum.
LONG, OFTEN, CHANGED = 5, 3, 97
#: A form is so many times as frequent as its variant, at least.
TIMES = 2
#: Different words that a task holds before it hands them on; code points hashed at a time.
HELD, STEP = 200_000, 1 << 19
#: Leading bits of a key that it is dealt by.
RADIX = 20
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _letters() -> bytes:
    """From Latin-1 bytes: A to Z lower-cased, a to z and from 0xC0 on as they are, all others to spaces."""
    kept = {c: c for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))} | {c: c + 32 for c in range(0x41, 0x5B)}
    return bytes(kept.get(c, 0x20) for c in range(256))


_LETTERS = _letters()


def words_of(doc_id: int | None, text: str) -> Counter:
    """Words of at least LONG code points, as Latin-1 bytes (a byte is a code point), with their counts, after the changes to the document's runs."""
    runs = text.encode("latin-1", "replace").translate(_LETTERS).split()
    own = Counter([w for w in runs if len(w) >= LONG])
    if doc_id is not None:
        start = crc32(b"%d:" % doc_id)
        sums = ((w, crc32(w if w.isascii() else w.decode("latin-1").encode(), start)) for w in own)
        hit = [(w, h % len(w), own[w]) for w, h in sums if not h % CHANGED]
        # All leave before any comes back changed: what a run becomes may be another run, and is not changed again.
        for word, _, _ in hit:
            del own[word]
        for word, at, n in hit:
            if len(word) > LONG:
                own[word[:at] + word[at + 1 :]] += n
    return own


def vocabulary(documents: DataFrame) -> DataFrame:
    """word, n: the words of at least LONG code points that occur OFTEN times or more."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.update(words_of(doc_id, text or ""))
                if len(held) >= HELD:
                    yield batch_of(schema, [[w.decode("latin-1") for w in held], list(held.values())])
                    held = Counter()
        yield batch_of(schema, [[w.decode("latin-1") for w in held], list(held.values())])

    counted = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def deletion_keys(chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, first, last, row for words that end at `ends` of `chars`: of each word itself (first and last -1), then of each run of equal
    code points (from place first to last of the word) with one of them deleted. Empty words are not allowed."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    power, back = powers(_BASE, len(chars) + 2), powers(_BACK, len(chars) + 2)
    before = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * power[: len(chars)])])
    whole = (before[ends] - before[starts]) * back[starts]
    new = np.concatenate([[True], chars[1:] != chars[:-1]])
    new[starts] = True
    at = np.flatnonzero(new)
    to = np.append(at[1:], len(chars)) - 1
    row = np.searchsorted(ends, at, side="right")
    s, e = starts[row], ends[row]
    deleted = (before[at] - before[s]) * back[s] + (before[e] - before[at + 1]) * back[s + 1]
    length = np.concatenate([ends - starts, e - s - 1]).astype(np.uint64)
    key = mixed(np.concatenate([whole, deleted]) ^ mixed(length))
    own = np.full(len(ends), -1, dtype=np.int64)
    return key.view(np.int64), np.concatenate([own, at - s]), np.concatenate([own, to - s]), np.concatenate([np.arange(len(ends)), row])


def keyed(words: DataFrame) -> DataFrame:
    """key, first, last, wid for the words (wid, word)."""
    schema = pa.schema([("key", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("wid", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            ids, sizes = batch.column("wid").to_numpy(), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            total = np.cumsum(sizes)
            start = 0
            while start < len(texts):
                stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + STEP, side="right")))
                key, first, last, row = deletion_keys(np.frombuffer(b"".join(texts[start:stop]), dtype=np.uint8), np.cumsum(sizes[start:stop]))
                yield batch_of(schema, [key, first.astype(np.int32), last.astype(np.int32), ids[start:stop][row]])
                start = stop

    return words.select("wid", "word").mapInArrow(run, "key long, first int, last int, wid long")


def dealt(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of one key together, by the key's leading bits, in order."""
    return rows.repartition(F.shiftrightunsigned("key", 64 - RADIX)).sortWithinPartitions("key", *order)


def meeting(rows: DataFrame) -> DataFrame:
    """The rows of keys under which a word meets its deletions, or two deletions share a place: numbers only, in one pass over sorted rows."""
    schema = pa.schema([("key", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("wid", pa.int64())])

    def kept(t: pa.Table) -> pa.Table:
        key, first, last = (t.column(c).to_numpy().astype(np.int64) for c in ("key", "first", "last"))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        # The furthest place that earlier rows of the key reach; a word itself (-1) reaches all.
        reach = group * (1 << 33) + np.where(first < 0, 1 << 32, last + 1)
        hit = np.zeros(len(key), dtype=bool)
        hit[1:] = ~new[1:] & (np.maximum.accumulate(reach)[:-1] >= group[1:] * (1 << 33) + first[1:] + 1)
        found = np.zeros(int(group[-1]) + 1, dtype=bool)
        found[group[hit]] = True
        return t.filter(pa.array(found[group]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = schema.empty_table()
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = pa.concat_tables([rest, pa.Table.from_batches([batch.cast(schema)])])
            key = rest.column("key").to_numpy()
            tail = int(np.searchsorted(key, key[-1], side="left"))
            if tail:
                yield from kept(rest.slice(0, tail).combine_chunks()).to_batches()
                rest = rest.slice(tail).combine_chunks()
        if rest.num_rows:
            yield from kept(rest.combine_chunks()).to_batches()

    return dealt(rows, "first").mapInArrow(run, "key long, first int, last int, wid long")


def neighbours(members: list[tuple[int, int, int, int, str]]) -> Iterator[tuple[int, int, int, str]]:
    """wid, n_near, form_n, form of the words of one key, each near pair once: from (first, last, wid, n, word) with first -1 for a word itself."""
    same: dict[str, list] = {}
    for m in members:
        first, word = m[0], m[4]
        same.setdefault(word if first < 0 else word[:first] + word[first + 1 :], []).append(m)
    for group in same.values():
        if len(group) < 2:
            continue
        whole = [m for m in group if m[0] < 0]
        others = [m for m in group if m[0] >= 0]
        if whole and others:
            best = min(others, key=lambda m: (-m[3], m[4]))
            for w in whole:
                yield w[2], len(others), best[3], best[4]
            for m in others:
                yield m[2], len(whole), whole[0][3], whole[0][4]
        # Two that share a place share it where the later one begins.
        places = np.unique([m[0] for m in others])
        at: dict[int, list] = {}
        for m in others:
            for p in places[np.searchsorted(places, m[0]) : np.searchsorted(places, m[1], side="right")].tolist():
                at.setdefault(p, []).append(m)
        for alike in at.values():
            if len(alike) < 2:
                continue
            one, two = sorted(alike, key=lambda m: (-m[3], m[4]))[:2]
            for m in alike:
                best = two if m is one else one
                yield m[2], len(alike) - 1, best[3], best[4]


def near(words: DataFrame, met: DataFrame) -> DataFrame:
    """wid, n_near, form_n, form: parts of each word's neighbours, to be added up; the strings decide."""
    schema = pa.schema([("wid", pa.int64()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, out = None, [], []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("key", "first", "last", "wid", "n", "word"))
            for k, *m in zip(*columns, strict=True):
                if k != key:
                    out.extend(neighbours(members))
                    key, members = k, []
                members.append(tuple(m))
            if out:
                yield batch_of(schema, zip(*out, strict=True))
                out = []
        out.extend(neighbours(members))
        if out:
            yield batch_of(schema, zip(*out, strict=True))

    with_strings = met.join(words, "wid").select("key", "first", "last", "wid", "n", "word")
    return dealt(with_strings).mapInArrow(run, "wid long, n_near long, form_n long, form string")


def roots(links: DataFrame, most_rounds: int = 7) -> DataFrame:
    """word, root from word, form: links followed to their end, by doubling.

    A form is at least TIMES as frequent as its variant, so no chain has more than 63 links (counts are longs) and no more
    rounds than these are ever needed.
    """
    links = cut(links.select("word", F.col("form").alias("root")))
    for _ in range(most_rounds):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = cut(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if links.filter("moved").isEmpty():
            break
        links = links.drop("moved")
    return links.select("word", "root")


def variants(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents (doc_id, text)."""
    words = table_in_shared_folder(vocabulary(documents).withColumn("wid", F.monotonically_increasing_id()))
    parts = near(words, meeting(keyed(words)))
    # The words go through the same sums as their neighbours, so that no join is needed to bring them together.
    rows = words.withColumns({"n_near": F.lit(0).cast("long"), "best": F.lit(None).cast("struct<less: bigint, form: string>")})
    found = parts.select(F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("n"), "wid", "n_near", F.struct((-F.col("form_n")).alias("less"), "form").alias("best"))
    whole = rows.unionByName(found).groupBy("wid").agg(F.max("word").alias("word"), F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    often = -F.col("best.less") >= TIMES * F.col("n")
    known = table_in_shared_folder(whole.select("word", "n", "n_near", F.when(often, F.col("best.form")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")))
    ends = roots(known.filter("form is not null").select("word", "form"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same words by joins of strings. A checksum is linear: each byte's part depends on its value and its distance from the end.
SQL = """
WITH RECURSIVE bits(b, c, step) AS (SELECT range::BIGINT, range::BIGINT, 0 FROM range(256) UNION ALL SELECT b, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), step + 1 FROM bits WHERE step < 8),
t AS (SELECT b, c FROM bits WHERE step = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
own AS (SELECT row_number() OVER () AS r, doc_id, w, count(*) AS n, hex(encode(doc_id::VARCHAR || ':' || w)) AS h FROM runs WHERE length(w) >= 5 GROUP BY doc_id, w),
longest AS (SELECT max(length(h)) // 2 AS m FROM own),
part(b, c, p) AS (SELECT b, c, 0 FROM t UNION ALL SELECT part.b, xor(part.c >> 8, t.c), p + 1 FROM part JOIN t ON t.b = part.c & 255 JOIN longest ON p < m),
begun(c, p) AS (SELECT 4294967295::BIGINT, 0 UNION ALL SELECT xor(begun.c >> 8, t.c), p + 1 FROM begun JOIN t ON t.b = begun.c & 255 JOIN longest ON p < m),
bytes AS (SELECT r, length(h) // 2 AS size, i, ('0x' || substr(h, (2 * i + 1)::INTEGER, 2))::BIGINT AS b FROM own, LATERAL (SELECT unnest(range(0, length(h) // 2)) AS i)),
sums AS (SELECT r, size, bit_xor(c) AS c FROM bytes JOIN part ON part.b = bytes.b AND part.p = size - 1 - i GROUP BY r, size),
crc AS (SELECT r, xor(xor(sums.c, begun.c), 4294967295) AS crc FROM sums JOIN begun ON p = size),
made AS (SELECT CASE WHEN crc % 97 = 0 THEN substr(w, 1, (crc % length(w))::INTEGER) || substr(w, (crc % length(w) + 2)::INTEGER) ELSE w END AS word, n FROM own LEFT JOIN crc USING (r)),
words AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gone AS (SELECT word, n, i, substr(word, 1, i::INTEGER) || substr(word, (i + 2)::INTEGER) AS s FROM words, LATERAL (SELECT unnest(range(0, length(word))) AS i)),
pairs AS (
  SELECT DISTINCT x.word AS a, y.word AS b FROM gone x JOIN gone y ON x.s = y.s AND x.i = y.i AND x.word <> y.word
  UNION SELECT g.word, w.word FROM gone g JOIN words w ON w.word = g.s UNION SELECT w.word, g.word FROM gone g JOIN words w ON w.word = g.s),
best AS (SELECT a, count(*) AS n_near, max(n) AS top FROM pairs JOIN words ON b = word GROUP BY a),
found AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * w.n THEN top END AS form_n FROM words w LEFT JOIN best ON a = w.word),
formed AS (SELECT f.*, (SELECT min(b) FROM pairs JOIN words ON words.word = b WHERE a = f.word AND words.n = f.form_n) AS form FROM found f),
ways(word, place) AS (SELECT word, word FROM formed UNION ALL SELECT ways.word, form FROM ways JOIN formed ON formed.word = place WHERE form IS NOT NULL)
SELECT word, form, place AS root, n, n_near, form_n FROM formed JOIN ways USING (word) WHERE place IN (SELECT word FROM formed WHERE form IS NULL)
"""
