"""Audit of filters that are applied one after another: what each removes in every order, from a packed bitmap index.

A document's failures are five bits. A task packs those of its documents into bitsets, one for each filter
and label, with the documents of a part (source) side by side from a byte's edge on. For each set of filters
that may come before (32 prefixes) it counts what each other filter removes: the filter's bitset AND NOT the
union of the prefix, by popcounts, added up over a part's bytes. Counts of tasks are added up by Spark; the
120 orders are then read from them.

Repeated texts are found by digests: the smallest id of each digest goes to the documents by id, so that a
text which a third of the documents have is no group that has to meet.

Defined results: a null text is empty; an empty text fails A alone, and E where a smaller id's is empty too;
a null source is the empty part; a null id is neither smaller nor larger than others, and has no labels; rows
equal in id and text don't repeat each other; a label counts if any of its id's rows has it; an empty table
has no parts; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batch_of, cut, text_bytes

FILTERS = "ABCDE"
#: A: least words. B: least share of different words, and C: most capitals, in hundredths. D: signs that a text may not hold.
LEAST_WORDS, LEAST_DIFFERENT, MOST_CAPITALS, SIGNS = 50, 65, 5, b"#$%&*|"
#: Documents of a bitset, parts that a task holds before it hands their counts on.
ROWS, PARTS = 1 << 16, 2048
_N = len(FILTERS)
_CAPITALS, _FOLLOWING = bytes(range(0x41, 0x5B)), bytes(range(0x80, 0xC0))
#: Prefixes (sets of filters as bits) with each filter that isn't in them.
_CASES = [(s, f) for s in range(1 << _N) for f in range(_N) if not s >> f & 1]


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # of bytes: at the six separators
    a = len(words) < LEAST_WORDS
    b = 100 * len(set(words)) < LEAST_DIFFERENT * len(words)
    c = 100 * (len(text) - len(text.translate(None, _CAPITALS))) > MOST_CAPITALS * len(text.translate(None, _FOLLOWING))
    d = len(text.translate(None, SIGNS)) < len(text)
    return a | b << 1 | c << 2 | d << 3


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, part, digest, fails: a narrow row for each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("fails", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(schema, [*(batch.column(c) for c in ("doc_id", "part", "digest")), [failures(x) for x in as_bytes(batch, "text")]])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_bytes().alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    return texts.select("doc_id", "part", digest, "text").mapInArrow(run, "doc_id long, part string, digest binary, fails int")


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits: failures of A to E, then quality and toxicity."""
    rows = cut(judged(documents))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("first", F.lit(True))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.col(c) == 1).alias(c) for c in ("quality", "toxic")))
    known = rows.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    again = F.col("first").isNull() & F.col("doc_id").isNotNull()
    bits = [(again, 4), (F.coalesce("quality", F.lit(False)), 5), (F.coalesce("toxic", F.lit(False)), 6)]
    return known.select("part", sum((F.when(c, F.lit(1 << k)).otherwise(0) for c, k in bits), F.col("fails")).alias("bits"))


def tally(part: np.ndarray, bits: np.ndarray, parts: int) -> np.ndarray:
    """counts[what, case, part] for documents of the parts 0 to parts - 1: removed, good removed, toxic removed, of each of _CASES."""
    order = np.argsort(part, kind="stable")
    size = np.bincount(part, minlength=parts)
    wide = -(-size // 8)  # bytes of each part
    start = np.cumsum(wide) - wide
    place = np.repeat(8 * start - (np.cumsum(size) - size), size) + np.arange(len(part))
    spread = np.zeros((_N + 2, 8 * int(wide.sum())), dtype=bool)
    spread[:, place] = bits[order][None, :] >> np.arange(_N + 2)[:, None] & 1
    sets = np.packbits(spread, axis=1)
    union = np.zeros((1 << _N, sets.shape[1]), dtype=np.uint8)
    for s in range(1, 1 << _N):
        low = (s & -s).bit_length() - 1
        union[s] = union[s & (s - 1)] | sets[low]
    out = np.zeros((3, len(_CASES), parts), dtype=np.int64)
    for k, (s, f) in enumerate(_CASES):
        gone = sets[f] & ~union[s]
        for what, own in enumerate((gone, gone & sets[_N], gone & sets[_N + 1])):
            out[what, k] = np.add.reduceat(np.bitwise_count(own), start, dtype=np.int64)
    return out


def counts(rows: DataFrame) -> DataFrame:
    """part, prefix, filter, n, good, toxic over all rows (part, bits); filter -1: the part's documents."""
    schema = pa.schema([("part", pa.string()), *((c, pa.int32()) for c in ("prefix", "filter")), *((c, pa.int64()) for c in ("n", "good", "toxic"))])
    prefix, which = (np.asarray(x, dtype=np.int32) for x in zip(*_CASES, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, (total, sums) in held.items():
                own = np.flatnonzero(sums[0])
                yield batch_of(schema, [[name] * (len(own) + 1), np.append(prefix[own], 0).astype(np.int32), np.append(which[own], -1).astype(np.int32), *(np.append(sums[k, own], total) for k in range(3))])

        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                some = batch.slice(k, ROWS)
                coded = some.column("part").dictionary_encode()
                names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                sums, total = tally(code, some.column("bits").to_numpy(), len(names)), np.bincount(code, minlength=len(names))
                for i, name in enumerate(names):
                    before = held.get(name, (0, 0))
                    held[name] = (before[0] + int(total[i]), before[1] + sums[:, :, i])
                if len(held) > PARTS:
                    yield from out()
                    held = {}
        yield from out()

    found = rows.mapInArrow(run, "part string, prefix int, filter int, n long, good long, toxic long")
    return found.groupBy("part", "prefix", "filter").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def interactions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of that step, for every part and each of the 120 orders."""
    key = F.col("prefix") * 8 + F.col("filter")
    cells = F.map_from_entries(F.collect_list(F.when(F.col("filter") >= 0, F.struct(key.alias("k"), F.struct("n", "good", "toxic").alias("v")))))
    sums = counts(labelled(documents, labels)).groupBy("part").agg(cells.alias("cells"), F.max(F.when(F.col("filter") < 0, F.col("n"))).alias("total"))

    def cell(before: Column | int, which: Column | int, what: str = "n") -> Column:
        at = (F.lit(before) if isinstance(before, int) else before) * 8 + (F.lit(which) if isinstance(which, int) else which)
        return F.coalesce(F.element_at("cells", at)[what], F.lit(0)).cast("long")

    def shapley(f: int) -> Column:
        """Orders in which exactly the filters of a prefix come before f: those within it, and those after it."""
        parts = [(factorial(s.bit_count()) * factorial(_N - 1 - s.bit_count()), s) for s, g in _CASES if g == f]
        return sum((F.lit(n) * cell(s, f) for n, s in parts[1:]), F.lit(parts[0][0]) * cell(parts[0][1], f))

    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))).alias("filter_order")
    each = sums.select("part", "cells", "total", F.array(*(shapley(f) for f in range(_N))).alias("shares"), orders)
    steps = each.select("*", F.explode(F.sequence(F.lit(1), F.lit(_N))).alias("step"))
    number = lambda c: F.ascii(c) - ord(FILTERS[0])
    before = F.aggregate(F.filter(F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), ""), lambda c: c != ""), F.lit(0), lambda s, c: s + F.element_at(F.lit([1 << f for f in range(_N)]), number(c) + 1))
    at = steps.select("*", before.alias("before"), number(F.substring("filter_order", F.col("step"), F.lit(1))).alias("which"))
    others = F.lit((1 << _N) - 1) - F.element_at(F.lit([1 << f for f in range(_N)]), F.col("which") + 1)
    # What is removed up to a step is what the first filter removes, then the second after it, and so on.
    order = F.split(F.col("filter_order"), "")
    gone = F.aggregate(
        F.slice(order, F.lit(1), F.col("step")), F.struct(F.lit(0).alias("before"), F.lit(0).cast("long").alias("n")),
        lambda s, c: F.struct((s["before"] + F.element_at(F.lit([1 << f for f in range(_N)]), number(c) + 1)).alias("before"), (s["n"] + cell(s["before"], number(c))).alias("n")),
    )["n"]
    removed = cell(F.col("before"), F.col("which"))
    return at.select(
        "part", "filter_order", "step", (F.col("total") - gone).alias("kept"), removed.alias("removed"), (cell(0, F.col("which")) - removed).alias("redundant"), cell(others, F.col("which")).alias("unique_fails"),
        cell(F.col("before"), F.col("which"), "good").alias("good_lost"), cell(F.col("before"), F.col("which"), "toxic").alias("toxic_lost"), F.element_at("shares", F.col("which") + 1).alias("shapley"),
    )


#: The same counts by classes of documents that fail the same filters, for each order.
SQL = r"""
WITH RECURSIVE orders(o) AS (SELECT '' UNION ALL SELECT o || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE o NOT LIKE '%' || f || '%'),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders WHERE length(o) = 5),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents),
least AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
fails AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > first THEN 'E' ELSE '' END AS f
  FROM d JOIN least USING (t) LEFT JOIN marks ON marks.doc_id = d.doc_id),
kinds AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM fails GROUP BY part, f),
found AS (SELECT part, o, step, n, good, bad, f, substr(o, step, 1) AS own, substr(o, 1, step - 1) AS before, f <> '' AND regexp_matches(substr(o, 1, step - 1), '[' || f || '_]') AS gone FROM kinds, steps),
counted AS (SELECT part, o, step, any_value(own) AS own,
  coalesce(sum(n) FILTER (NOT gone AND NOT contains(f, own)), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND contains(f, own)), 0) AS removed,
  coalesce(sum(n) FILTER (gone AND contains(f, own)), 0) AS redundant, coalesce(sum(n) FILTER (f = own), 0) AS unique_fails,
  coalesce(sum(good) FILTER (NOT gone AND contains(f, own)), 0) AS good_lost, coalesce(sum(bad) FILTER (NOT gone AND contains(f, own)), 0) AS toxic_lost FROM found GROUP BY part, o, step)
SELECT part, o AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted
"""
