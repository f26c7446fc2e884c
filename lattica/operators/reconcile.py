"""Imports that may be repeated: outcomes of a staged batch against what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .temporal import spread


def outcomes(staged: DataFrame, current: DataFrame, key: str, digest: str, order: Column, broken: Column | None = None, failed: Column | None = None) -> DataFrame:
    """key, outcome: what importing each staged row would do; keys only in the current rows are skipped.

    failed: rows without a key, and rows for which `failed` (what could not be read) is true; quarantined: others for which
    `broken` is true. Of the sound rows of a key the first in the given order counts, the others are duplicates.
    """
    never = F.lit(False)
    state = F.when(F.col(key).isNull() | F.coalesce(failed if failed is not None else never, never), "failed").when(F.coalesce(broken if broken is not None else never, never), "quarantined")
    known = staged.select(F.col(key), F.col(digest).alias("_new"), state.alias("_state"), order.alias("_order"), F.monotonically_increasing_id().alias("_row"))
    sound, unsound = known.filter("_state is null"), known.filter("_state is not null")
    # The least row of a key is found by an aggregate: no task has to sort a key's rows.
    first = sound.groupBy(key).agg(F.min_by(F.struct("_new"), F.struct("_order", "_row"))["_new"].alias("_new"), F.count("*").alias("_n"))
    c = current.select(key, F.col(digest).alias("_old")).filter(F.col(key).isNotNull()).withColumn("_current", F.lit(True))
    outcome = F.when(F.col("_n").isNull(), "skipped").when(F.col("_current").isNull(), "inserted").when(F.col("_new").eqNullSafe(F.col("_old")), "unchanged").otherwise("updated")
    firsts = first.join(c, key, "full_outer").select(key, outcome.alias("outcome"), F.coalesce("_n", F.lit(1)).alias("_n"))
    # A key that has unsound rows only is not skipped: it was staged.
    staged_only = unsound.select(F.col(key).alias("_k")).filter("_k is not null").distinct().withColumn("_seen", F.lit(True))
    firsts = firsts.join(staged_only, F.col(key) == F.col("_k"), "left").filter("outcome != 'skipped' or _seen is null")
    repeated = spread(firsts.filter("_n > 1").select(key, F.col("_n")), F.lit(2), F.col("_n"), "_copy").select(key, F.lit("duplicate").alias("outcome"))
    each = firsts.select(key, "outcome").unionByName(repeated)
    return each.unionByName(unsound.select(key, F.col("_state").alias("outcome")))


def not_yet_imported(batches: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Batches whose idempotency key is new; those without a key are always new."""
    return batches.join(done.select(key).dropna(), key, "left_anti")


def merged_sightings(seen: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """One row for each key with its first and last moment."""
    return seen.groupBy(*keys).agg(F.min(first).alias(first), F.max(last).alias(last))
