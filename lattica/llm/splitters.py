"""Histogram sort: boundaries of sorted ranges from exact counts, without sorting first.

Candidate boundaries (probes) are spread over the keys. Each task adds up the weight and the rows
below every probe in its own rows, the sums are added up by Spark, and the probes move closer, until
every boundary meets its tolerance or no key is left between its neighbours. Only sums per probe
reach the driver: their number depends on the ranges asked for, not on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of

#: Probes between the two nearest known boundaries of a target, in each round.
PROBES = 12


@dataclass(frozen=True)
class Ranges:
    """Range i holds keys from bounds[i-1] (inclusive) to bounds[i]; weight and rows: below each bound."""

    bounds: np.ndarray
    weight: np.ndarray
    rows: np.ndarray
    total_weight: int
    total_rows: int
    rounds: int

    def starts(self, what: str) -> np.ndarray:
        """Weight or rows before each range."""
        return np.concatenate([[0], getattr(self, what)]).astype(np.int64)


def below(rows: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact weight and rows with keys below each probe (sorted)."""
    shared = rows.sparkSession.sparkContext.broadcast(probes)
    schema = pa.schema([("at", pa.int32()), ("weight", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, n = np.zeros(len(shared.value) + 1, dtype=np.int64), np.zeros(len(shared.value) + 1, dtype=np.int64)
        for batch in batches:
            at = np.searchsorted(shared.value, batch.column("key").to_numpy(), side="right")
            np.add.at(weight, at, batch.column("weight").to_numpy())
            n += np.bincount(at, minlength=len(n))
        own = np.flatnonzero(n)
        yield batch_of(schema, [own.astype(np.int32), weight[own], n[own]])

    weight, n = np.zeros(len(probes) + 1, dtype=np.int64), np.zeros(len(probes) + 1, dtype=np.int64)
    for r in rows.select("key", "weight").mapInArrow(count, "at int, weight long, n long").groupBy("at").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).collect():
        weight[r["at"]], n[r["at"]] = r["weight"], r["n"]
    return np.cumsum(weight)[:-1], np.cumsum(n)[:-1]


def find(rows: DataFrame, targets: int, tolerance: np.ndarray | float, most_rounds: int = 70) -> Ranges:
    """Bounds of `targets` ranges of equal weight.

    rows: key (long) and weight (long, none negative), cheap to read again. tolerance: weight by
    which each bound may be off, as a part of one range's weight; one value for each bound, or one for all.
    Equal keys are never parted: salt keys that may be heavy. A bound with no key left between its neighbours
    is as near as it can be; one that is still off after `most_rounds` is an error.
    """
    ends = rows.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("weight"), F.count("*").alias("n")).first()
    total, n = int(ends["weight"]), int(ends["n"])
    none = np.zeros(0, dtype=np.int64)
    if not n or targets < 2:
        return Ranges(none, none, none, total, n, 0)
    goal = np.asarray([total * i // targets for i in range(1, targets)], dtype=np.int64)
    off = np.broadcast_to(np.asarray(tolerance, dtype=float) * total / targets, goal.shape)
    # Known bounds: none of the weight is below the lowest key, and all of it below one past the highest.
    at, weight, count = [int(ends["low"]), int(ends["high"]) + 1], [0, total], [0, n]
    rounds = 0
    while True:
        keys, w, c = np.asarray(at, dtype=object), np.asarray(weight, dtype=np.int64), np.asarray(count, dtype=np.int64)
        right = np.clip(np.searchsorted(w, goal, side="left"), 1, len(w) - 1)
        left = right - 1
        near = np.where(goal - w[left] <= w[right] - goal, left, right)
        done = np.abs(w[near] - goal) <= off
        done |= np.asarray([keys[b] - keys[a] <= 1 for a, b in zip(left, right, strict=True)])
        if done.all():
            break
        if rounds >= most_rounds:
            raise RuntimeError(f"{int((~done).sum())} bounds are out of tolerance after {most_rounds} rounds")
        probes: set[int] = set()
        for a, b in {(int(left[i]), int(right[i])) for i in np.flatnonzero(~done)}:
            low, high = int(keys[a]), int(keys[b])
            inside = [int(g) for g in goal[(goal >= w[a]) & (goal <= w[b])]]
            span = high - low
            even = [low + span * i // (PROBES + 1) for i in range(1, PROBES + 1)]
            # where the goals would be if weight were spread evenly between the two known bounds
            guess = [low + span * (g - int(w[a])) // max(int(w[b] - w[a]), 1) for g in inside]
            probes.update(p for p in [*even, *guess] if low < p < high)
        fresh = np.asarray(sorted(probes), dtype=np.int64)
        weight_below, rows_below = below(rows, fresh)
        merged = sorted({*zip(at, weight, count, strict=True), *zip(fresh.tolist(), weight_below.tolist(), rows_below.tolist(), strict=True)})
        at, weight, count = (list(x) for x in zip(*merged, strict=True))
        rounds += 1
    return Ranges(np.asarray([keys[i] for i in near], dtype=np.int64), w[near], c[near], total, n, rounds)
