"""Update specifications as copy-on-write projections."""

from __future__ import annotations

import uuid
from decimal import Decimal
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.errors import DocumentError
from foliant.functions.expressions import Scope
from foliant.operators.filters import compile_filter
from foliant.plans.values import Value, constant, pair, quoted, to_type, unify

HIT = "__hit"


@dataclass
class Updated:
    df: DataFrame  # all rows after the change
    matched: Column  # aggregates over the marked rows give the counts
    modified: Column


def is_replacement(spec: dict) -> bool:
    operators = [k for k in spec if k.startswith("$")]
    if operators and len(operators) != len(spec):
        raise DocumentError(9, "FailedToParse", "operators and plain fields do not mix in an update")
    return not operators


def _nested(df_type: T.DataType, col: Column, steps: list[str], new: Column | None, dtype: T.DataType | None) -> tuple[Column, T.DataType]:
    """col with the field at steps replaced (new None: dropped to NULL)."""
    head, rest = steps[0], steps[1:]
    base = df_type if isinstance(df_type, T.StructType) else T.StructType([])
    if not rest:
        if new is None:
            if head not in base.names:
                return col, base
            return col.withField(head, F.lit(None).cast(base[head].dataType)), base
        value, kind = new, dtype
    else:
        inner_type = base[head].dataType if head in base.names else T.StructType([])
        inner = col.getField(head) if head in base.names else None
        if inner is None or not isinstance(inner_type, T.StructType):
            if new is None:
                return col, base
            value, kind = new, dtype
            for name in reversed(rest):
                value, kind = F.struct(value.alias(name)), T.StructType([T.StructField(name, kind, True)])
        else:
            value, kind = _nested(inner_type, inner, rest, new, dtype)
    fields = [T.StructField(f.name, kind if f.name == head else f.dataType, True) for f in base.fields]
    if head not in base.names:
        fields.append(T.StructField(head, kind, True))
    made = F.struct(*[(value if f.name == head else col.getField(f.name)).alias(f.name) for f in fields])
    return made, T.StructType(fields)


def _sum64(a: Column, b: Column) -> Column:
    """The sum of two 64-bit integers, around the ends as in two's complement: no row fails the update."""
    wide = a.cast("decimal(20,0)") + b.cast("decimal(20,0)")
    turn = F.lit(Decimal(2**64))
    return F.coalesce(F.try_add(a, b), F.when(a > 0, wide - turn).otherwise(wide + turn).cast("decimal(20,0)").cast("long"))


def _incremented(name: str, old: Value, delta: Any) -> Value:
    by = constant(delta)
    if not by.number:
        raise DocumentError(14, "TypeMismatch", f"cannot increment {name} by a value that is no number")
    if old.nothing:
        return by
    if not old.number:
        raise DocumentError(14, "TypeMismatch", f"cannot increment {name}, which is no number")
    if old.whole and by.whole:
        return Value(_sum64(F.coalesce(old.long(), F.lit(0).cast("long")), by.long()), T.LongType())
    return Value(F.coalesce(old.double(), F.lit(0.0)) + by.double(), T.DoubleType())


def apply_spec(df: DataFrame, spec: dict, hit: Column, hidden: tuple[str, ...] = ()) -> DataFrame:
    """df with the update made where hit is true. hidden: columns that are no fields of the documents."""
    changed: dict[str, tuple[Column, T.DataType]] = {n: (quoted(n), df.schema[n].dataType) for n in df.columns}

    def put(name: str, new: Value | None) -> None:
        steps = name.split(".")
        head = steps[0]
        old, old_type = changed.get(head, (F.lit(None), T.NullType()))
        if len(steps) > 1:
            col, dtype = _nested(old_type, old, steps[1:], None if new is None else new.col, None if new is None else new.type)
            same = isinstance(old_type, T.StructType) and old_type == dtype
            kept = old if same else (F.when(old.isNotNull(), _nested(old_type, old, steps[1:], F.lit(None).cast(new.type), new.type)[0]) if isinstance(old_type, T.StructType) else F.lit(None))
            changed[head] = (F.when(hit, col).otherwise(kept if not same else old), dtype)
            return
        if new is None:
            if head in changed:
                changed[head] = (F.when(hit, F.lit(None)).otherwise(old).cast(old_type), old_type)
            return
        dtype = unify([old_type, new.type])
        changed[head] = (F.when(hit, to_type(new, dtype)).otherwise(old if old_type == dtype else old.cast(dtype)), dtype)

    if is_replacement(spec):
        if "_id" in spec and "_id" in df.columns:
            same = pair(Value(quoted("_id"), df.schema["_id"].dataType, True), constant(spec["_id"]), False)
            wrong = F.lit(True) if same is None else ~F.coalesce(same[0] == same[1], F.lit(False))
            keep = F.when(hit & wrong, F.raise_error(F.lit("ImmutableField: a replacement keeps the _id (code 66)"))).otherwise(quoted("_id"))
            changed["_id"] = (keep.cast(df.schema["_id"].dataType), df.schema["_id"].dataType)
        for n in df.columns:
            if n != "_id" and n not in spec and n not in hidden:
                put(n, None)
        for n, x in spec.items():
            if n != "_id":
                put(n, constant(x))
    else:
        seen: set[str] = set()
        for op, fields in spec.items():
            if op not in ("$set", "$unset", "$inc"):
                raise DocumentError(9, "FailedToParse", f"no update operator {op}")
            for name, x in fields.items():
                if name in seen:
                    raise DocumentError(40, "ConflictingUpdateOperators", f"{name} is updated twice")
                seen.add(name)
        # all values are of the row before the change
        before = Scope(T.StructType(df.schema.fields))
        for name, x in spec.get("$set", {}).items():
            put(name, constant(x))
        for name, x in spec.get("$inc", {}).items():
            from foliant.plans.values import path

            put(name, _incremented(name, path(before.schema, name), x))
        for name in spec.get("$unset", {}):
            put(name, None)
    return df.select(*[c.alias(n) for n, (c, _) in changed.items()])


def marked(df: DataFrame, query: dict, many: bool, order: str | None = None) -> DataFrame:
    """df with HIT: the rows to change; of the first match only, if not many (order: a unique column)."""
    schema = T.StructType([f for f in df.schema.fields if f.name != order])
    found = F.coalesce(compile_filter(query, Scope(schema)), F.lit(False))
    if many:
        return df.withColumn(HIT, found)
    if order is None:
        raise ValueError("changing one row needs an order")
    first = df.where(found).agg(F.min(order).alias("__first"))  # one row
    return df.join(F.broadcast(first), F.lit(True), "left").withColumn(HIT, F.coalesce(found & (F.col(order) == F.col("__first")), F.lit(False))).drop("__first")


def update(df: DataFrame, query: dict, spec: dict, many: bool = True, order: str | None = None) -> DataFrame:
    """All rows of df after the update."""
    rows = marked(df, query, many, order)
    out = apply_spec(rows, spec, F.col(HIT), (HIT, *([order] if order else [])))
    return out.drop(HIT)


def delete(df: DataFrame, query: dict, many: bool = True, order: str | None = None) -> DataFrame:
    rows = marked(df, query, many, order)
    return rows.where(~F.col(HIT)).drop(HIT)


def seed(query: dict, spec: dict) -> dict:
    """The document that an upsert inserts: the query's literal equalities, changed by spec."""
    document: dict = {}

    def take(q: dict) -> None:
        for k, v in q.items():
            if k == "$and" and isinstance(v, (list, tuple)):
                for x in v:
                    take(x)
            elif not k.startswith("$"):
                if isinstance(v, dict) and v and all(o.startswith("$") for o in v):
                    if "$eq" in v:
                        document[k] = v["$eq"]
                else:
                    document[k] = v

    take(query)
    if is_replacement(spec):
        document = {**({"_id": document["_id"]} if "_id" in document else {}), **spec}
    else:
        for k, v in spec.get("$set", {}).items():
            document[k] = v
        for k, v in spec.get("$inc", {}).items():
            document[k] = document.get(k, 0) + v
        for k in spec.get("$unset", {}):
            document.pop(k, None)
    nested: dict = {}
    for k, v in document.items():
        at = nested
        *outer, last = k.split(".")
        for name in outer:
            at = at.setdefault(name, {})
        at[last] = v
    nested.setdefault("_id", uuid.uuid4().hex[:24])
    return nested


def upserted(df: DataFrame, query: dict, spec: dict, many: bool = True, order: str | None = None) -> DataFrame:
    """As update, with the seed document added if no row matches."""
    schema = T.StructType([f for f in df.schema.fields if f.name != order])
    found = df.where(compile_filter(query, Scope(schema))).limit(1).count()
    if found:
        return update(df, query, spec, many, order)
    row = {k: v for k, v in seed(query, spec).items() if k != "_id" or "_id" in df.columns}
    one = df.sparkSession.range(1).select(*[constant(v).col.alias(k) for k, v in row.items()])
    for f in schema.fields:
        if f.name in one.columns and unify([f.dataType, one.schema[f.name].dataType]) == f.dataType:
            one = one.withColumn(f.name, quoted(f.name).cast(f.dataType))
    return df.unionByName(one, allowMissingColumns=True)
