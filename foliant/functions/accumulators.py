"""Accumulators of $group as aggregate Columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.errors import CompileError, UnsupportedOperator
from foliant.functions.expressions import Scope, compile_expression
from foliant.plans.values import Value

ORDERED = ("$first", "$last", "$push")


def accumulator(spec: Any, scope: Scope, order: Column | None) -> tuple[Column, T.DataType]:
    """The aggregate and its type. order: a column that rises in pipeline order, needed by ORDERED."""
    if not isinstance(spec, dict) or len(spec) != 1:
        raise CompileError("an accumulator is a document of one operator")
    name, operand = next(iter(spec.items()))
    if name not in ("$sum", "$avg", "$min", "$max", *ORDERED):
        raise UnsupportedOperator(f"no accumulator {name}")
    v: Value = compile_expression(operand, scope)
    if name == "$sum":
        if not v.number:
            return F.sum(F.lit(0.0)), T.DoubleType()
        if v.constant:
            return F.count(F.lit(1)).cast("double") * F.lit(float(v.literal)), T.DoubleType()
        return F.coalesce(F.sum(v.double()), F.lit(0.0)), T.DoubleType()
    if name == "$avg":
        return (F.avg(v.double()) if v.number else F.max(F.lit(None).cast("double"))), T.DoubleType()
    if name in ("$min", "$max"):
        return (F.min if name == "$min" else F.max)(v.col), v.type
    if order is None:
        raise CompileError(f"{name} needs an order")
    if name == "$first":
        return F.min_by(v.col, order), v.type
    if name == "$last":
        return F.max_by(v.col, order), v.type
    # the order is unique, so the struct's second field is never compared
    kept = F.when(v.col.isNotNull(), F.struct(order.alias("o"), v.col.alias("x"))) if v.absent else F.struct(order.alias("o"), v.col.alias("x"))
    return F.transform(F.array_sort(F.collect_list(kept)), lambda e: e["x"]), T.ArrayType(v.type, True)
