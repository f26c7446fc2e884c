"""What a table declares."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Column:
    """default: SQL for a value that a load may leave out; `now` is the load's clock."""

    name: str
    type: str
    never_null: bool
    length: int | None
    exact: bool
    default: str | None = None


@dataclass(frozen=True)
class Reference:
    """action: C cascade, R restrict, N set null."""

    table: str
    column: str
    target: str
    action: str


@dataclass(frozen=True)
class Unique:
    """where: rows that the key is unique among. Rows with a null in the key are never equal."""

    table: str
    key: tuple[str, ...]
    where: str | None = None


@dataclass(frozen=True)
class Check:
    table: str
    kind: str
    arguments: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"{self.table}.{self.kind}.{self.arguments[0]}"


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    key: tuple[str, ...]
    references: tuple[Reference, ...]
    uniques: tuple[Unique, ...]
    checks: tuple[Check, ...]
    complete: bool
