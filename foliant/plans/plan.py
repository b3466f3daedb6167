"""The state that stages transform: a DataFrame, its visible fields and its order.

Row order is physical (partitions in order, rows in order) while only narrow
steps and sorts have run. A step that shuffles loses it; if a later stage
needs the order, the hidden column RID (rising in pipeline order) is made
before and carried. Nothing is sorted or numbered that no later stage needs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.expressions import Scope
from foliant.plans.values import Value, quoted

RID = "__rid"


@dataclass(frozen=True)
class Plan:
    df: DataFrame
    fields: tuple[str, ...]
    collections: Callable[[str], DataFrame]
    natural: bool = True  # rows lie in pipeline order
    rid: bool = False
    variables: dict[str, Value] = field(default_factory=dict)
    part: tuple[str, ...] = ()  # hidden columns: each value is a pipeline of its own
    strict: bool = True

    @property
    def schema(self) -> T.StructType:
        return T.StructType([self.df.schema[n] for n in self.fields])

    @property
    def scope(self) -> Scope:
        return Scope(self.schema, self.variables)

    @property
    def hidden(self) -> list[str]:
        return [*([RID] if self.rid else []), *self.part]

    def with_(self, **changes: Any) -> Plan:
        return replace(self, **changes)

    def select(self, columns: dict[str, Any]) -> Plan:
        """Visible fields become columns (name to Column, in order); hidden ones stay."""
        df = self.df.select(*[c.alias(n) for n, c in columns.items()], *[quoted(h) for h in self.hidden])
        return self.with_(df=df, fields=tuple(columns))

    def numbered(self) -> Plan:
        """With RID."""
        if self.rid:
            return self
        return self.with_(df=self.df.withColumn(RID, F.monotonically_increasing_id()), rid=True)

    def visible(self) -> DataFrame:
        return self.df.select(*[quoted(n) for n in self.fields])


def plan_of(df: DataFrame, collections: Callable[[str], DataFrame] | None = None, strict: bool = True) -> Plan:
    def none(name: str) -> DataFrame:
        raise KeyError(f"no collection {name}")

    return Plan(df, tuple(df.columns), collections or none, strict=strict)
