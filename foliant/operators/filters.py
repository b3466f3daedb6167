"""Filter documents as boolean Columns.

Inside, NULL stands for false wherever only AND and OR are around it: so
comparisons stay bare and reach the scan. Negations never see a NULL.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.errors import CompileError, UnsupportedOperator
from foliant.functions.expressions import Scope, compile_expression
from foliant.plans.values import MAX_DEPTH, Value, compare, constant, kind, of_kind, path, truthy



def _no() -> Column:
    return F.lit(False)


def _equal(field: Value, wanted: Value) -> Column:
    """Equal, or an array with an equal element. A missing field equals nothing."""
    if wanted.nothing and field.variant:
        return F.coalesce(F.is_variant_null(field.col), _no())
    if wanted.nothing:
        return _no() if field.absent else field.col.isNull()
    found = compare(field, wanted, "eq", loose=True)
    if field.variant:
        items = F.try_variant_get(field.col, "$", "array<variant>")
        inside = F.exists(items, lambda e: compare(Value(e, T.VariantType()), wanted, "eq"))
        return found | F.coalesce(F.when(kind(field.col) == "ARRAY", inside), _no())
    if field.array:
        inside = Value(F.col("_"), field.type.elementType)
        if not inside.array or wanted.array:
            found = found | F.coalesce(F.exists(field.col, lambda e: compare(Value(e, field.type.elementType), wanted, "eq")), _no())
    return found


def _among(field: Value, values: Any) -> Column:
    if not isinstance(values, (list, tuple)):
        return _no()
    wanted = [constant(x) for x in values if not isinstance(x, re.Pattern)]
    plain = [w for w in wanted if not w.nothing and not w.array and not w.document]
    kinds = {(w.number, w.string, w.boolean, w.time) for w in plain}
    if plain and len(plain) == len(wanted) == len(values) and len(kinds) == 1 and not field.array and (field.number, field.string, field.boolean, field.time) in kinds:
        literals = [w.literal for w in plain]
        col = field.double() if field.number and not all(w.whole for w in plain) else field.col  # one In: it is pushed to the scan
        return col.isin(literals)
    found = [_equal(field, w) for w in wanted] + [regex(field, x, "") for x in values if isinstance(x, re.Pattern)]
    return reduce(lambda a, b: a | b, found, _no())


def regex(field: Value, pattern: Any, options: Any) -> Column:
    """An unanchored search in strings; options i and s count; a pattern that does not compile where it runs matches nothing."""
    if isinstance(pattern, re.Pattern):
        options = (options or "") + ("i" if pattern.flags & re.IGNORECASE else "") + ("s" if pattern.flags & re.DOTALL else "")
        pattern = pattern.pattern
    if field.variant:
        field = Value(of_kind(field.col, "STRING"), T.StringType(), True)
    if not isinstance(pattern, str) or not isinstance(options or "", str) or not field.string:
        return _no()
    flags = "".join(f for f in "is" if f in (options or ""))
    pattern = (f"(?{flags})" if flags else "") + pattern
    return field.col.rlike(pattern) if _compiles(pattern) else _no()


def _compiles(pattern: str) -> bool:
    """Whether java.util.regex takes the pattern."""
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JError, IllegalArgumentException):
        return False
    return True


def _exists(field: Value, flag: Any) -> Column:
    if isinstance(flag, (bool, int, float)):
        return field.col.isNotNull() if flag else field.col.isNull()
    return _no()


def _negated(field: Value, found: Column) -> Column:
    """Not found, or the field is missing; in a form that the scan can take."""
    if field.absent and not field.nothing and not field.array and not field.variant:
        return field.col.isNull() | ~found
    return ~F.coalesce(found, _no())


def _operator(name: str, field: Value, operand: Any, spec: dict, strict: bool) -> Column:
    match name:
        case "$eq":
            return _equal(field, constant(operand))
        case "$ne":
            return _negated(field, _equal(field, constant(operand)))
        case "$gt" | "$gte" | "$lt" | "$lte":
            return compare(field, constant(operand), name[1:], loose=True)
        case "$in":
            return _among(field, operand)
        case "$nin":
            return _negated(field, _among(field, operand))
        case "$exists":
            return _exists(field, operand)
        case "$regex":
            return regex(field, operand, spec.get("$options", ""))
        case "$options":
            return F.lit(True)
    if strict:
        raise UnsupportedOperator(f"no filter operator {name}")
    return _no()


def compile_filter(spec: dict, scope: Scope, strict: bool = True, depth: int = 0) -> Column:
    """The filter as a Column; NULL means false. strict=False: unknown operators match nothing instead of raising."""
    if depth > MAX_DEPTH:
        raise CompileError(f"filters nest at most {MAX_DEPTH} deep")
    if not isinstance(spec, dict):
        raise CompileError("a filter is a document")
    clauses: list[Column] = []
    for name, value in spec.items():
        if name in ("$and", "$or"):
            if not isinstance(value, (list, tuple)) or not value:
                clauses.append(_no())
                continue
            parts = [compile_filter(x, scope, strict, depth + 1) if isinstance(x, dict) else _no() for x in value]
            clauses.append(reduce((lambda a, b: a & b) if name == "$and" else (lambda a, b: a | b), parts))
        elif name == "$expr":
            clauses.append(truthy(compile_expression(value, scope)))
        elif name.startswith("$"):
            if strict:
                raise UnsupportedOperator(f"no filter operator {name}")
            clauses.append(_no())
        else:
            field = path(scope.schema, name)
            if isinstance(value, re.Pattern):
                clauses.append(regex(field, value, ""))
            elif isinstance(value, dict) and value and all(k.startswith("$") for k in value):
                clauses += [_operator(k, field, v, value, strict) for k, v in value.items()]
            else:
                clauses.append(_equal(field, constant(value)))
    return reduce(lambda a, b: a & b, clauses, F.lit(True)) if clauses else F.lit(True)


def filter_documents(df, spec: dict, strict: bool = True):
    """The rows of df that match."""
    schema = T.StructType(df.schema.fields)
    return df.where(compile_filter(spec, Scope(schema), strict)) if spec else df
