"""Pipeline stages: each takes (plan, spec, rest) to a plan; rest are the stages that follow."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.errors import CompileError, UnsupportedOperator
from foliant.functions.accumulators import ORDERED, accumulator
from foliant.functions.expressions import compile_expression
from foliant.operators.filters import compile_filter
from foliant.plans.plan import RID, Plan, plan_of
from foliant.plans.values import Value, quoted, sort_key

Stage = Callable[[Plan, Any, list], Plan]
STAGES: dict[str, Stage] = {}


def stage(*names: str) -> Callable[[Stage], Stage]:
    def add(f: Stage) -> Stage:
        for name in names:
            STAGES[name] = f
        return f

    return add


def opened(one: Any) -> tuple[str, Any]:
    if not isinstance(one, dict) or len(one) != 1:
        raise CompileError("a stage is a document of one key")
    return next(iter(one.items()))


def needs_order(rest: list) -> bool:
    """Whether a following stage depends on the order of its input, ties included."""
    for one in rest:
        name, spec = opened(one)
        if name in ("$skip", "$limit"):
            return True
        if name == "$group":
            return any(isinstance(a, dict) and next(iter(a), "") in ORDERED for k, a in spec.items() if k != "_id") or needs_order(rest[rest.index(one) + 1 :])
        if name == "$sortByCount":
            return needs_order(rest[rest.index(one) + 1 :])
        if name in ("$count",):
            return False
    return False


def _name(name: Any, what: str) -> str:
    if not isinstance(name, str) or not name or name.startswith("$") or "." in name:
        raise CompileError(f"{what} is a top-level name: {name!r}")
    return name


@stage("$match")
def match(plan: Plan, spec: Any, rest: list) -> Plan:
    return plan.with_(df=plan.df.where(compile_filter(spec, plan.scope, plan.strict))) if spec else plan


def sort_keys(plan: Plan, spec: Any) -> list[Column]:
    if not isinstance(spec, dict) or not spec:
        raise CompileError("$sort takes fields and directions")
    keys = []
    for name, direction in spec.items():
        v = compile_expression("$" + name, plan.scope)
        if v.nothing:  # no document has it: all tie
            continue
        if v.array or v.document:  # such values tie
            keys.append(v.col.isNotNull())
            if isinstance(direction, (int, float)) and direction < 0:
                keys[-1] = keys[-1].desc()
            continue
        if v.variant:
            v = Value(sort_key(v.col), T.StructType())
        down = isinstance(direction, (int, float)) and not isinstance(direction, bool) and direction < 0
        keys.append(v.col.desc_nulls_last() if down else v.col.asc_nulls_first())
    return keys


@stage("$sort")
def sort(plan: Plan, spec: Any, rest: list) -> Plan:
    ties = needs_order(rest)
    if ties:
        plan = plan.numbered()
    keys = [*sort_keys(plan, spec), *([F.col(RID)] if ties else [])]
    if plan.part:
        ranked = plan.df.withColumn(RID, F.row_number().over(Window.partitionBy(*map(quoted, plan.part)).orderBy(*keys)).cast("long"))
        return plan.with_(df=ranked, rid=True, natural=False)
    if not keys:
        return plan
    df = plan.df.orderBy(*keys)
    return plan.with_(df=df.drop(RID), rid=False, natural=True)


def _positions(plan: Plan) -> Plan:
    """RID as 1, 2, ... within each pipeline of a partitioned plan."""
    plan = plan.numbered()
    window = Window.partitionBy(*map(quoted, plan.part)).orderBy(RID)
    return plan.with_(df=plan.df.withColumn(RID, F.row_number().over(window).cast("long")), natural=False)


def ordered(plan: Plan) -> Plan:
    return plan if plan.natural or not plan.rid else plan.with_(df=plan.df.orderBy(RID), natural=True)


@stage("$skip")
def skip(plan: Plan, spec: Any, rest: list) -> Plan:
    n = max(0, int(spec))
    if plan.part:
        return (p := _positions(plan)).with_(df=p.df.where(F.col(RID) > n)) if n else plan
    if not n:
        return plan
    return (p := in_order(plan)).with_(df=p.df.offset(n))


@stage("$limit")
def limit(plan: Plan, spec: Any, rest: list) -> Plan:
    n = max(0, int(spec))
    if not n:
        return plan
    if plan.part:
        return (p := _positions(plan)).with_(df=p.df.where(F.col(RID) <= n))
    return (p := in_order(plan)).with_(df=p.df.limit(n))


def in_order(plan: Plan) -> Plan:
    """With a sort that a following limit or offset sees. A sort that is the last step serves as it is."""
    top = plan.df._jdf.queryExecution().logical()
    while top.getClass().getSimpleName() in ("Project", "GlobalLimit", "LocalLimit", "Offset"):
        top = top.children().head()
    if plan.natural and top.getClass().getSimpleName() == "Sort":
        return plan
    plan = plan.numbered()
    return plan.with_(df=plan.df.orderBy(RID), natural=True)


def _flag(value: Any) -> bool:
    return isinstance(value, (bool, int, float)) and bool(value)


@stage("$project")
def project(plan: Plan, spec: Any, rest: list) -> Plan:
    if not isinstance(spec, dict) or not spec:
        raise CompileError("$project takes fields")
    others = {k: v for k, v in spec.items() if k != "_id"}
    keep_id = "_id" not in spec or _flag(spec["_id"]) or not isinstance(spec["_id"], (bool, int, float))
    simple = all(isinstance(v, (bool, int, float)) for v in spec.values())
    if simple and (not others or not any(_flag(v) for v in others.values())):
        if not others and _flag(spec["_id"]):
            return plan.select({n: quoted(n) for n in plan.fields if n == "_id"})
        drop = {k for k in spec if not _flag(spec[k])}
        return plan.select({n: quoted(n) for n in plan.fields if n not in drop})
    if any(isinstance(v, (bool, int, float)) and not _flag(v) for v in others.values()):
        raise CompileError("$project mixes inclusion and exclusion")
    out: dict[str, Column] = {}
    if keep_id and "_id" in plan.fields and ("_id" not in spec or isinstance(spec["_id"], (bool, int, float))):
        out["_id"] = quoted("_id")
    elif keep_id and "_id" in spec and not isinstance(spec["_id"], (bool, int, float)):
        out["_id"] = compile_expression(spec["_id"], plan.scope).col
    for name, value in others.items():
        if isinstance(value, (bool, int, float)):
            if name in plan.fields:
                out[name] = quoted(name)
            continue
        v = compile_expression(value, plan.scope)
        if not (v.nothing and v.absent):
            out[_name(name, "an output field")] = v.col
    return plan.select(out)


@stage("$set", "$addFields")
def set_fields(plan: Plan, spec: Any, rest: list) -> Plan:
    if not isinstance(spec, dict):
        raise CompileError("$set takes fields")
    out = {n: quoted(n) for n in plan.fields}
    for name, value in spec.items():
        v = compile_expression(value, plan.scope)
        if not (v.nothing and v.absent):
            out[_name(name, "a field")] = v.col
    return plan.select(out)


@stage("$unset")
def unset(plan: Plan, spec: Any, rest: list) -> Plan:
    names = [spec] if isinstance(spec, str) else list(spec)
    return plan.select({n: quoted(n) for n in plan.fields if n not in names})


@stage("$group")
def group(plan: Plan, spec: Any, rest: list) -> Plan:
    if not isinstance(spec, dict) or "_id" not in spec:
        raise CompileError("$group takes an _id")
    accumulators = {_name(k, "an accumulator field"): v for k, v in spec.items() if k != "_id"}
    own = any(isinstance(a, dict) and next(iter(a), "") in ORDERED for a in accumulators.values())
    after = needs_order(rest)
    if own or after:
        plan = plan.numbered()
    key = compile_expression(spec["_id"], plan.scope)
    order = F.col(RID) if plan.rid else None
    aggregates = [accumulator(a, plan.scope, order)[0].alias(k) for k, a in accumulators.items()]
    if after:
        aggregates.append(F.min(RID).alias(RID))
    if not aggregates:
        aggregates = [F.count(F.lit(1)).alias("__n")]
    grouped = plan.df.groupBy((F.to_json(key.col) if key.variant else key.col).alias("_id"), *map(quoted, plan.part)).agg(*aggregates)
    if key.variant:  # VARIANT itself is no grouping key; a missing one is the group of null
        grouped = grouped.withColumn("_id", F.parse_json("_id"))
    return plan.with_(df=grouped, fields=("_id", *accumulators), natural=False, rid=after)


@stage("$count")
def count(plan: Plan, spec: Any, rest: list) -> Plan:
    name = _name(spec, "the count's field")
    counted = plan.df.groupBy(*map(quoted, plan.part)).agg(F.count(F.lit(1)).alias(name))
    return plan.with_(df=counted.where(quoted(name) > 0), fields=(name,), natural=not plan.part, rid=False)


@stage("$sortByCount")
def sort_by_count(plan: Plan, spec: Any, rest: list) -> Plan:
    after = needs_order(rest)
    if after:
        plan = plan.numbered()
    key = compile_expression(spec, plan.scope)
    grouped = plan.df.groupBy(key.col.alias("_id"), *map(quoted, plan.part)).agg(F.count(F.lit(1)).alias("count"), *([F.min(RID).alias(RID)] if after else []))
    out = plan.with_(df=grouped, fields=("_id", "count"), natural=False, rid=after)
    return sort(out, {"count": -1}, rest)


@stage("$replaceRoot")
def replace_root(plan: Plan, spec: Any, rest: list) -> Plan:
    if not isinstance(spec, dict) or "newRoot" not in spec:
        raise CompileError("$replaceRoot takes newRoot")
    return replace_with(plan, spec["newRoot"], rest)


@stage("$replaceWith")
def replace_with(plan: Plan, spec: Any, rest: list) -> Plan:
    v = compile_expression(spec, plan.scope)
    if not isinstance(v.type, T.StructType):
        raise CompileError("the new root is not a document")
    guarded = v.col if not v.absent else F.when(v.col.isNotNull(), v.col).otherwise(F.raise_error(F.lit("the new root is not a document")).cast(v.type))
    df = plan.df.select(guarded.alias("__root"), *[quoted(h) for h in plan.hidden])
    df = df.select(*[F.col("__root").getField(n).alias(n) for n in v.type.names], *[quoted(h) for h in plan.hidden])
    return plan.with_(df=df, fields=tuple(v.type.names))


@stage("$unwind")
def unwind(plan: Plan, spec: Any, rest: list) -> Plan:
    spec = {"path": spec} if isinstance(spec, str) else spec
    name = spec.get("path", "")
    if not name.startswith("$") or "." in name:
        raise CompileError("$unwind takes a top-level path")
    name, keep, index = name[1:], bool(spec.get("preserveNullAndEmptyArrays")), spec.get("includeArrayIndex")
    others = {n: quoted(n) for n in plan.fields if n != name}
    if name not in plan.fields:
        if not keep:
            return plan.with_(df=plan.df.where(F.lit(False)))
        return plan.select({**others, **({_name(index, "the index"): F.lit(None).cast("long")} if index else {})})
    dtype = plan.df.schema[name].dataType
    tail = {_name(index, "the index"): None} if index else {}
    if not isinstance(dtype, T.ArrayType):
        out = plan.select({**others, name: quoted(name), **{k: F.lit(None).cast("long") for k in tail}})
        return out if keep else out.with_(df=out.df.where(quoted(name).isNotNull()))
    if plan.natural is False and plan.rid and needs_order(rest):
        plan = ordered(plan).with_(rid=False) if not plan.part else plan
    if plan.rid and not plan.part:
        plan = plan.with_(df=plan.df.drop(RID), rid=False) if plan.natural else plan
    cells = quoted(name)
    if index:
        explode = (F.posexplode_outer if keep else F.posexplode)(cells).alias("__pos", "__cell")
    else:
        explode = (F.explode_outer if keep else F.explode)(cells).alias("__cell")
    df = plan.df.select(*[c.alias(n) for n, c in others.items()], *[quoted(h) for h in plan.hidden], explode)
    out = plan.with_(df=df, fields=tuple(others))
    df = df.select(*[quoted(n) for n in others], F.col("__cell").alias(name), *([F.col("__pos").cast("long").alias(index)] if index else []), *[quoted(h) for h in out.hidden])
    return out.with_(df=df, fields=(*others, name, *tail))


def run_stages(plan: Plan, pipeline: list) -> Plan:
    from foliant.operators import lookup

    i = 0
    while i < len(pipeline):
        name, spec = opened(pipeline[i])
        if name == "$lookup":
            plan, used = lookup.lookup(plan, spec, pipeline[i + 1 :])
            i += 1 + used
            continue
        if name not in STAGES:
            raise UnsupportedOperator(f"no stage {name}")
        plan = STAGES[name](plan, spec, pipeline[i + 1 :])
        i += 1
    return plan


def aggregate(df: DataFrame, pipeline: list, collections: Callable[[str], DataFrame] | dict | None = None, strict: bool = True) -> DataFrame:
    """The pipeline over the rows of df. collections: name to DataFrame, for $lookup."""
    found = collections.__getitem__ if isinstance(collections, dict) else collections
    return run_stages(plan_of(df, found, strict), pipeline).visible()
