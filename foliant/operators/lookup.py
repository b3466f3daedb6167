"""$lookup as joins.

The equality form joins on null-safe keys with the foreign rows gathered per
key. Followed by $unwind of its own field it becomes a plain inner or left
join, followed by a $match for an empty result a left anti join: no arrays are
built. The pipeline form is decorrelated: equalities of $expr between foreign
fields and let variables become join keys, the other conjuncts that use
variables join conditions, the rest runs on the foreign side. A sub-pipeline
that uses variables by equalities only runs once for each foreign key, any
other once for each distinct tuple of variables; the results are joined back
by these values, never by row numbers made twice.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.errors import CompileError
from foliant.functions.expressions import Scope, compile_expression
from foliant.operators.filters import compile_filter
from foliant.plans.plan import RID, Plan, plan_of
from foliant.plans.values import Value, pair, path, quoted, truthy


def _keys(local: Value, foreign: Value) -> tuple[Column, Column]:
    """Join columns of one type; values that can never be equal meet only as nulls."""
    if local.nothing or foreign.nothing:
        a = F.lit(None).cast("boolean") if local.nothing else F.when(local.col.isNotNull(), F.lit(True))
        b = F.lit(None).cast("boolean") if foreign.nothing else F.when(foreign.col.isNotNull(), F.lit(True))
        return (a, b) if not (local.nothing and foreign.nothing) else (F.lit(True), F.lit(True))
    if (cols := pair(local, foreign, False)) is None:
        return F.when(local.col.isNotNull(), F.lit(1)), F.when(foreign.col.isNotNull(), F.lit(2))
    return cols


def _document(df: DataFrame) -> Column:
    return F.struct(*[quoted(n).alias(n) for n in df.columns])


def _gathered(order: Column, value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("x")))), lambda e: e["x"])


def _empty(dtype: T.DataType) -> Column:
    return F.array().cast(T.ArrayType(dtype, True))


def _groupable(v: Value) -> Column:
    """A column that is equal where v is, and that groups and joins take."""
    return F.to_json(F.struct(v.col.alias("x"))) if v.variant or "map<" in v.type.simpleString() or "variant" in v.type.simpleString() else v.col


def _same(pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])


MOST_BYTES = 1 << 28  # of the result of an uncorrelated sub-pipeline: every local document holds all of it


def _output(plan: Plan, name: str, df: DataFrame, value: Column) -> Plan:
    fields = [n for n in plan.fields if n != name]
    df = df.select(*[quoted(n) for n in fields], value.alias(name), *[quoted(h) for h in plan.hidden])
    return plan.with_(df=df, fields=(*fields, name), natural=False)


def _wants_empty(one: Any, name: str) -> bool:
    if not (isinstance(one, dict) and set(one) == {"$match"} and isinstance(one["$match"], dict) and len(one["$match"]) == 1):
        return False
    key, value = next(iter(one["$match"].items()))
    return (key == name and value == []) or (key == f"{name}.0" and value == {"$exists": False})


def _wants_some(rest: list, name: str) -> bool:
    """A $match for a non-empty result whose contents no later stage reads."""
    if len(rest) < 2 or rest[0] != {"$match": {f"{name}.0": {"$exists": True}}}:
        return False
    kind, spec = next(iter(rest[1].items()))
    if kind == "$unset":
        return spec == name or (isinstance(spec, list) and name in spec)
    text = json.dumps(spec, default=str)
    return kind in ("$count", "$group") and f"${name}" not in text and "$$ROOT" not in text and "$$CURRENT" not in text


def lookup(plan: Plan, spec: Any, rest: list) -> tuple[Plan, int]:
    """The plan after $lookup, and how many of the following stages it has taken in."""
    from foliant.operators.stages import needs_order

    if not isinstance(spec, dict) or not isinstance(spec.get("from"), str) or not isinstance(spec.get("as"), str):
        raise CompileError("$lookup takes from and as")
    name = spec["as"]
    if "." in name or name.startswith("$"):
        raise CompileError("$lookup's as is a top-level name")
    has_keys = "localField" in spec and "foreignField" in spec
    if not has_keys and "pipeline" not in spec:
        raise CompileError("$lookup takes localField and foreignField, or a pipeline")
    if needs_order(rest):
        plan = plan.numbered()
    foreign = plan.collections(spec["from"])
    if "pipeline" in spec:
        return _by_pipeline(plan, spec, foreign, name), 0
    local_value = path(plan.schema, spec["localField"])
    foreign_value = path(T.StructType(foreign.schema.fields), spec["foreignField"])
    if local_value.array:
        return _by_elements(plan, name, local_value, foreign, foreign_value), 0
    a, b = _keys(local_value, foreign_value)
    left, right = plan.df.withColumn("__k", a), foreign.select(b.alias("__fk"), _document(foreign).alias("__doc"))
    on = F.col("__k").eqNullSafe(F.col("__fk"))
    doc = foreign.schema
    if rest and next(iter(rest[0])) == "$unwind":
        u = rest[0]["$unwind"]
        u = {"path": u} if isinstance(u, str) else u
        if u.get("path") == "$" + name and not u.get("includeArrayIndex"):
            joined = left.join(right, on, "left" if u.get("preserveNullAndEmptyArrays") else "inner")
            return _output(plan, name, joined, F.col("__doc")), 1
    if rest and _wants_empty(rest[0], name):
        return _output(plan, name, left.join(right, on, "left_anti"), _empty(doc)), 1
    if _wants_some(rest, name):
        return _output(plan, name, left.join(right, on, "left_semi"), _empty(doc)), 1
    numbered = foreign.select(b.alias("__fk"), _document(foreign).alias("__doc"), F.monotonically_increasing_id().alias("__o"))
    groups = numbered.groupBy("__fk").agg(_gathered(F.col("__o"), F.col("__doc")).alias("__docs"))
    joined = left.join(groups, on, "left")
    return _output(plan, name, joined, F.coalesce("__docs", _empty(doc))), 0


def _by_elements(plan: Plan, name: str, local: Value, foreign: DataFrame, foreign_value: Value) -> Plan:
    """The local field is an array: any element may match; a foreign row comes once. Equal arrays are looked up once."""
    df = plan.df.withColumn("__a", _groupable(local))
    element = Value(F.col("__e"), local.type.elementType, absent=True)
    a, b = _keys(element, foreign_value)
    arrays = df.select("__a", local.col.alias("__x")).dropDuplicates(["__a"])
    cells = arrays.select(F.col("__a").alias("__b"), F.explode(F.coalesce(F.array_distinct("__x"), F.array(F.lit(None).cast(local.type.elementType)))).alias("__e")).select("__b", a.alias("__k"))
    numbered = foreign.select(b.alias("__fk"), _document(foreign).alias("__doc"), F.monotonically_increasing_id().alias("__o"))
    met = cells.join(numbered, F.col("__k").eqNullSafe(F.col("__fk"))).select("__b", "__o", "__doc").dropDuplicates(["__b", "__o"])
    docs = met.groupBy("__b").agg(_gathered(F.col("__o"), F.col("__doc")).alias("__docs"))
    joined = df.join(docs, _same([("__a", "__b")]), "left")
    return _output(plan, name, joined, F.coalesce("__docs", _empty(foreign.schema)))


def _uses(spec: Any, names: set[str]) -> bool:
    if isinstance(spec, str):
        return spec.startswith("$$") and spec[2:].split(".")[0] in names
    if isinstance(spec, dict):
        return any(_uses(v, names) for k, v in spec.items() if k != "$literal")
    return isinstance(spec, (list, tuple)) and any(_uses(v, names) for v in spec)


def _fields_used(spec: Any) -> bool:
    if isinstance(spec, str):
        return spec.startswith("$") and (not spec.startswith("$$") or spec[2:].split(".")[0] in ("ROOT", "CURRENT"))
    if isinstance(spec, dict):
        return any(_fields_used(v) for k, v in spec.items() if k != "$literal")
    return isinstance(spec, (list, tuple)) and any(_fields_used(v) for v in spec)


def _conjuncts(expr: Any) -> list:
    if isinstance(expr, dict) and set(expr) == {"$and"} and isinstance(expr["$and"], (list, tuple)):
        return [y for x in expr["$and"] for y in _conjuncts(x)]
    return [expr]


def _by_pipeline(plan: Plan, spec: dict, foreign: DataFrame, name: str) -> Plan:
    from foliant.operators.stages import run_stages

    stages, let = list(spec["pipeline"]), spec.get("let") or {}
    names = set(let)
    keys: list[tuple[Column, Column, bool]] = []  # local, foreign, whether nulls meet
    conditions: list[Any] = []
    # plain filters and foreign-only conjuncts of the leading $match stages run on the foreign side
    while stages and set(stages[0]) == {"$match"}:
        clauses = stages[0]["$match"]
        plain = {k: v for k, v in clauses.items() if k != "$expr"}
        if _uses(plan_filters := list(plain.values()), names) and plan_filters:
            break
        if plain:
            foreign = foreign.where(compile_filter(plain, Scope(T.StructType(foreign.schema.fields)), plan.strict))
        for one in _conjuncts(clauses["$expr"]) if "$expr" in clauses else []:
            if not _uses(one, names):
                foreign = foreign.where(truthy(compile_expression(one, Scope(T.StructType(foreign.schema.fields)))))
            else:
                conditions.append(one)
        stages.pop(0)
    correlated = bool(conditions) or "localField" in spec or _uses(stages, names)
    document = T.StructType(foreign.schema.fields)
    if not correlated:
        inner = run_stages(plan_of(foreign, plan.collections, plan.strict).numbered(), stages)
        inner = inner.numbered()
        dtype = inner.schema
        doc = F.struct(*[quoted(n).alias(n) for n in inner.fields])
        size = F.sum(F.octet_length(F.to_json(doc)))
        one = inner.df.agg(_gathered(F.col(RID), doc).alias("__all"), size.alias("__size"))
        whole = F.when(F.coalesce("__size", F.lit(0)) <= MOST_BYTES, F.col("__all")).otherwise(F.raise_error(F.lit(f"the result of $lookup {name} without variables has more than {MOST_BYTES} bytes")))
        joined = plan.df.join(F.broadcast(one.select(whole.alias("__docs"))), F.lit(True), "left")  # one row of checked size
        return _output(plan, name, joined, F.coalesce("__docs", _empty(dtype)))
    values = {k: compile_expression(v, plan.scope) for k, v in let.items()}
    if "localField" in spec:
        values["\0local"] = path(plan.schema, spec["localField"])
    bound = {k: Value(F.col(f"__v_{k}"), v.type, k == "\0local") for k, v in values.items()}
    scope = Scope(document, bound)
    theta: list[Column] = []
    for one in conditions:
        if isinstance(one, dict) and set(one) == {"$eq"} and len(one["$eq"]) == 2:
            sides = list(one["$eq"])
            if _uses(sides[0], names):
                sides.reverse()
            if not _uses(sides[0], names) and not _fields_used(sides[1]):
                f, v = compile_expression(sides[0], scope), compile_expression(sides[1], scope)
                if (cols := pair(v, f, False)) is not None and f.absent:
                    keys.append((*cols, False))
                    continue
        theta.append(truthy(compile_expression(one, scope)))
    if "localField" in spec:
        keys.append((*_keys(bound["\0local"], path(document, spec["foreignField"])), True))
    right = foreign.withColumn(RID, F.monotonically_increasing_id())
    locals_ = {f"__v_{k}": v.col for k, v in values.items()}
    df = plan.df.withColumns(locals_)
    if keys and not theta and not _uses(stages, names):
        # the sub-pipeline runs for each foreign key
        parts = [f"__p{i}" for i in range(len(keys))]
        right = right.withColumns({p: b for p, (_, b, _) in zip(parts, keys, strict=True)})
        for p, (_, _, nulls) in zip(parts, keys, strict=True):
            right = right if nulls else right.where(F.col(p).isNotNull())
        inner = Plan(right, tuple(foreign.columns), plan.collections, natural=False, rid=True, part=tuple(parts), strict=plan.strict)
        back = [(a, p, nulls) for p, (a, _, nulls) in zip(parts, keys, strict=True)]
        on = lambda: reduce(lambda x, y: x & y, [a.eqNullSafe(F.col(p)) if nulls else a == F.col(p) for a, p, nulls in back])
    else:
        # the sub-pipeline runs for each distinct tuple of variables
        parts = [f"__d{i}" for i in range(len(values))]
        named = df.withColumns({p: _groupable(v) for p, v in zip(parts, [Value(F.col(c), v.type, True) for c, v in zip(locals_, values.values(), strict=True)], strict=True)})
        distinct = named.select(*parts, *locals_).dropDuplicates(parts) if parts else plan.df.limit(1).select(F.lit(0).alias("__d0"))
        parts = parts or ["__d0"]
        where = [a.eqNullSafe(b) if nulls else a == b for a, b, nulls in keys] + theta
        met = distinct.join(right, reduce(lambda x, y: x & y, where) if where else F.lit(True))
        inner = Plan(met, tuple(foreign.columns), plan.collections, natural=False, rid=True, variables=bound, part=(*parts, *locals_), strict=plan.strict)
        df = named.withColumns({f"__l{i}": F.col(p) for i, p in enumerate(parts)}).drop(*parts)
        on = lambda: _same([(f"__l{i}", p) for i, p in enumerate(parts)])
    inner = run_stages(inner, stages)
    order = F.col(RID) if inner.rid else F.lit(0)
    dtype = inner.schema
    gathered = inner.df.groupBy(*parts).agg(_gathered(order, F.struct(*[quoted(n).alias(n) for n in inner.fields])).alias("__docs"))
    joined = df.join(gathered, on(), "left")
    return _output(plan, name, joined, F.coalesce("__docs", _empty(dtype)))
