"""Rules over a table: counts of broken rows, rows with what they break, and rows parted by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model.defs import Table
from . import templates


def report(rows: DataFrame, rules: dict[str, Column], table: str) -> DataFrame:
    """rule, table_name, violations: a row for each rule, in one pass over the rows."""
    counts = rows.agg(*(F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())))
    pairs = ", ".join(f"'{name}', r{i}" for i, name in enumerate(rules))
    return counts.select(F.expr(f"stack({len(rules)}, {pairs}) as (rule, violations)")).select("rule", F.lit(table).alias("table_name"), "violations")


def with_broken(rows: DataFrame, rules: dict[str, Column], column: str = "broken_rules") -> DataFrame:
    """The rows with the names of the rules that each one breaks, in the rules' order."""
    names = F.array(*(F.when(c, F.lit(name)) for name, c in rules.items()))
    return rows.withColumn(column, F.filter(names, lambda x: x.isNotNull()))


def parted(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that break nothing, and the others with what they break."""
    marked = with_broken(rows, rules)
    return marked.filter(F.size("broken_rules") == 0).drop("broken_rules"), marked.filter(F.size("broken_rules") > 0)


def rules_of(table: Table) -> dict[str, Column]:
    """All row rules that a table of the catalogue declares: checks, not-null columns and lengths."""
    rules = {c.name: templates.compiled(c) for c in table.checks}
    rules |= {f"{table.name}.not_null.{c.name}": templates.not_null(c.name) for c in table.columns if c.never_null}
    rules |= {f"{table.name}.length.{c.name}": templates.too_long(c.name, c.length, c.exact) for c in table.columns if c.length}
    return rules


def defaults_of(table: Table, now: Column | None = None) -> dict[str, Column]:
    """The defaults that a table declares. now: the clock, so that a load or a test can hold it; the session's by default."""
    now = F.current_timestamp() if now is None else now
    return {c.name: (now if c.default == "now" else F.expr(c.default)).cast(c.type) for c in table.columns if c.default}


def filled(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Defaults for columns that the rows lack. A null that is there stays a null."""
    return rows.withColumns({name: value for name, value in defaults.items() if name not in rows.columns})


def masked(rows: DataFrame, sensitive: Column, columns: list[str]) -> DataFrame:
    return rows.withColumns({c: F.when(sensitive, None).otherwise(F.col(c)) for c in columns})
