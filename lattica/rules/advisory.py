"""What one may take for granted but the model does not enforce: advice, never a reason to refuse a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, temporal, versions


def code_without_reason(resources: DataFrame, types: DataFrame) -> DataFrame:
    """Resources that lack a code their type requires, or whose code has another prefix than their type."""
    both = resources.join(types.select("resource_type_code", "requires_jblr_code", "code_prefix"), "resource_type_code")
    lacks = F.col("requires_jblr_code") & F.col("jblr_code").isNull()
    other = F.split("jblr_code", "-")[1] != F.col("code_prefix")
    return both.filter(lacks | F.coalesce(other, F.lit(False))).select("resource_id", F.when(lacks, "missing_code").otherwise("other_prefix").alias("advice"))


def overlapping_validity(rows: DataFrame, entity: str, key: str) -> DataFrame:
    return temporal.overlapping(rows, entity, key, "valid_from", "valid_to")


def cyclic_parents(rows: DataFrame, key: str, parent: str) -> DataFrame:
    return graph.on_cycles(rows.filter(F.col(parent).isNotNull()).select(F.col(key).alias("child"), F.col(parent).alias("parent")))


def without_preferred(rows: DataFrame, entity: str, preferred: str) -> DataFrame:
    """Entities with rows of which none is the preferred one."""
    return rows.groupBy(entity).agg(F.coalesce(F.bool_or(preferred), F.lit(False)).alias("any")).filter("not any").select(entity)


def status_behind_events(resources: DataFrame, events: DataFrame) -> DataFrame:
    """Resources whose status isn't that of their latest review."""
    latest = versions.latest(events, ["target_resource_id"], [F.desc_nulls_last("occurred_at"), F.desc("resource_id")])
    both = resources.join(latest.select(F.col("target_resource_id").alias("resource_id"), "to_validation_status"), "resource_id")
    return both.filter("validation_status != to_validation_status").select("resource_id", "validation_status", "to_validation_status")


def unknown_metrics(measurements: DataFrame, metrics: DataFrame) -> DataFrame:
    return measurements.join(metrics.select("metric_code"), "metric_code", "left_anti").select("metric_code").distinct()


def same_digest(assets: DataFrame) -> DataFrame:
    """Digests that differ by the case of their letters only."""
    return assets.groupBy(F.lower("sha256").alias("digest")).agg(F.count_distinct("sha256").alias("n")).filter("n > 1")


def open_sequences(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Gaps in numbers that need not be contiguous."""
    return versions.gaps(rows, keys, number)


def changed_after_close(runs: DataFrame, revisions: DataFrame) -> DataFrame:
    """Closed runs that were revised later than they were closed, with the first such revision; what is closed should stay as it is."""
    closed = runs.filter("run_status = 'closed'").select("resource_id", "closed_at")
    later = revisions.select(F.col("target_resource_id").alias("resource_id"), "revision_no", "changed_at").join(closed, "resource_id").filter("changed_at > closed_at")
    return later.groupBy("resource_id").agg(F.min("revision_no").alias("revision_no"), F.count("*").alias("n"))


def other_type(subtype: DataFrame, resources: DataFrame, code: str) -> DataFrame:
    """Rows of a subtype's table whose resource is of another type than the subtype's, or of none."""
    both = subtype.select("resource_id").join(resources.select("resource_id", "resource_type_code"), "resource_id", "left")
    return both.filter(~F.col("resource_type_code").eqNullSafe(F.lit(code))).select("resource_id", "resource_type_code")


def odd_parents(parents: DataFrame, hybrid: str, position: str, expected: int = 2) -> DataFrame:
    """Hybrids with another number of parents than expected, or with two in one position."""
    n = parents.groupBy(hybrid).agg(F.count("*").alias("n_parents"), (F.count(position) - F.count_distinct(position)).alias("n_repeated"))
    return n.filter((F.col("n_parents") != expected) | (F.col("n_repeated") > 0))


def other_domain(rows: DataFrame, key: str, column: str, terms: DataFrame, domain: str) -> DataFrame:
    """Rows whose term is of another domain than the column's, or unknown. A missing term is no fault."""
    known = terms.select(F.col("term_key").alias(column), "term_domain")
    return rows.filter(F.col(column).isNotNull()).join(known, column, "left").filter(~F.col("term_domain").eqNullSafe(F.lit(domain))).select(key, column, "term_domain")
