"""Typed values: a Column, its type, and whether its NULL means a missing field or an explicit null.

Columns of a table never hold both: NULL there is a missing field. Computed
values give explicit nulls, unless an operator is said to give a missing one.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.errors import CompileError

NULL = T.NullType()
_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
MAX_DEPTH = 100


@dataclass(frozen=True)
class Value:
    col: Column
    type: T.DataType
    absent: bool = False  # NULL means missing
    literal: object = None
    constant: bool = False

    @property
    def number(self) -> bool:
        return isinstance(self.type, _INTS + _FLOATS)

    @property
    def whole(self) -> bool:
        return isinstance(self.type, _INTS)

    @property
    def string(self) -> bool:
        return isinstance(self.type, (T.StringType, T.VarcharType, T.CharType))

    @property
    def boolean(self) -> bool:
        return isinstance(self.type, T.BooleanType)

    @property
    def time(self) -> bool:
        return isinstance(self.type, _TIMES)

    @property
    def array(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    @property
    def document(self) -> bool:
        return isinstance(self.type, (T.StructType, T.MapType))

    @property
    def variant(self) -> bool:
        return isinstance(self.type, T.VariantType)

    @property
    def nothing(self) -> bool:
        """Null or missing on every row."""
        return isinstance(self.type, T.NullType)

    def missing(self) -> Column:
        """Whether the value is missing."""
        return self.col.isNull() if self.absent else F.lit(False)

    def double(self) -> Column:
        return self.col if isinstance(self.type, T.DoubleType) else self.col.cast("double")

    def long(self) -> Column:
        return self.col if isinstance(self.type, T.LongType) else self.col.cast("long")


def missing() -> Value:
    return Value(F.lit(None), NULL, absent=True)


def null() -> Value:
    return Value(F.lit(None), NULL, constant=True)


def computed(col: Column, dtype: T.DataType | str, absent: bool = False) -> Value:
    return Value(col, named_type(dtype) if isinstance(dtype, str) else dtype, absent)


def named_type(name: str) -> T.DataType:
    return {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}[name]


def constant(x: object) -> Value:
    """A literal Python value, lists and documents included."""
    if x is None:
        return null()
    if isinstance(x, bool):
        return Value(F.lit(x), T.BooleanType(), literal=x, constant=True)
    if isinstance(x, int):
        small = -(2**31) <= x < 2**31
        if not -(2**63) <= x < 2**63:
            raise CompileError(f"{x} is not a 64-bit integer")
        return Value(F.lit(x), T.IntegerType() if small else T.LongType(), literal=x, constant=True)
    if isinstance(x, float):
        return Value(F.lit(x), T.DoubleType(), literal=x, constant=True)
    if isinstance(x, Decimal):
        return Value(F.lit(float(x)), T.DoubleType(), literal=float(x), constant=True)
    if isinstance(x, str):
        return Value(F.lit(x), T.StringType(), literal=x, constant=True)
    if isinstance(x, datetime.datetime):
        return Value(F.lit(x), T.TimestampType(), literal=x, constant=True)
    if isinstance(x, datetime.date):
        return Value(F.lit(x), T.DateType(), literal=x, constant=True)
    if isinstance(x, (bytes, bytearray)):
        return Value(F.lit(bytes(x)), T.BinaryType(), literal=bytes(x), constant=True)
    if isinstance(x, (list, tuple)):
        return replace(array_of([constant(y) for y in x]), literal=list(x), constant=True)
    if isinstance(x, dict):
        return replace(struct_of({k: constant(y) for k, y in x.items()}), literal=x, constant=True)
    raise CompileError(f"no literal form for {type(x).__name__}")


def unify(types: list[T.DataType]) -> T.DataType:
    """The common type: numbers widen to long or double; null fits all."""
    kinds = [t for t in types if not isinstance(t, T.NullType)]
    if not kinds:
        return NULL
    first = kinds[0]
    if all(t == first for t in kinds):
        return first
    if all(isinstance(t, _INTS + _FLOATS) for t in kinds):
        return T.LongType() if all(isinstance(t, _INTS) for t in kinds) else T.DoubleType()
    if all(isinstance(t, T.ArrayType) for t in kinds):
        return T.ArrayType(unify([t.elementType for t in kinds]), True)
    if all(isinstance(t, T.StructType) for t in kinds) and all(t.names == first.names for t in kinds):
        return T.StructType([T.StructField(n, unify([t[n].dataType for t in kinds]), True) for n in first.names])
    if all(isinstance(t, T.StringType) for t in kinds):
        return T.StringType()
    if all(isinstance(t, _TIMES) for t in kinds):
        return T.TimestampType()
    raise CompileError(f"values of different types meet: {', '.join(sorted({t.simpleString() for t in kinds}))}; such data belongs in a dynamic collection")


def to_type(v: Value, dtype: T.DataType) -> Column:
    return v.col if v.type == dtype else v.col.cast(dtype)


def same_type(values: list[Value]) -> tuple[list[Column], T.DataType]:
    dtype = unify([v.type for v in values])
    return [to_type(v, dtype) for v in values], dtype


# ------------------------------------------------------------------ values of any type (VARIANT)

#: The order of types.
RANKS = {"VOID": 2, "number": 3, "STRING": 4, "OBJECT": 5, "ARRAY": 6, "BINARY": 7, "BOOLEAN": 9, "TIMESTAMP": 10, "DATE": 10}


def kind(col: Column) -> Column:
    """VOID, number, STRING, OBJECT, ARRAY, BOOLEAN, ... of a VARIANT; NULL if missing."""
    name = F.regexp_extract(F.schema_of_variant(col), "^[A-Z]+", 0)
    return F.when(name.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "TINYINT", "SMALLINT", "INT"), F.lit("number")).otherwise(name)


def of_kind(col: Column, name: str) -> Column:
    """The VARIANT as a double, string, boolean or timestamp if it is one, else NULL."""
    target = {"number": "double", "STRING": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp"}[name]
    return F.when(kind(col) == name, F.try_variant_get(col, "$", target))


def sort_key(col: Column) -> Column:
    """A struct that orders VARIANTs by type, then value; missing and null are equal and first. Documents tie, arrays tie."""
    rank = F.coalesce(*[F.when(kind(col) == k, F.lit(v)) for k, v in RANKS.items()], F.when(col.isNull(), F.lit(2)), F.lit(100))
    return F.struct(rank.alias("rank"), of_kind(col, "number").alias("n"), of_kind(col, "STRING").alias("s"), of_kind(col, "BOOLEAN").alias("b"), of_kind(col, "TIMESTAMP").alias("t"))


def to_variant(v: Value) -> Column:
    if v.variant:
        return v.col
    if v.nothing:
        return F.parse_json(F.lit("null"))
    return F.to_variant_object(v.col) if v.array or v.document else v.col.cast("variant")


def _variant_pair(a: Value, b: Value) -> tuple[Column, Column] | None:
    if a.variant and b.variant:
        return F.to_json(a.col), F.to_json(b.col)
    v, other = (a, b) if a.variant else (b, a)
    if other.number:
        cols = of_kind(v.col, "number"), other.double()
    elif other.string:
        cols = of_kind(v.col, "STRING"), other.col
    elif other.boolean:
        cols = of_kind(v.col, "BOOLEAN"), other.col
    elif other.time:
        cols = of_kind(v.col, "TIMESTAMP"), other.col.cast("timestamp")
    elif other.array or other.document:
        cols = F.to_json(v.col), F.to_json(F.to_variant_object(other.col))
    else:
        return None
    return cols if a.variant else cols[::-1]


def array_of(values: list[Value]) -> Value:
    """An array; missing elements are dropped, nulls stay."""
    values = [v for v in values if not (v.nothing and v.absent)]
    if not values:
        return Value(F.array().cast(T.ArrayType(T.NullType())), T.ArrayType(T.NullType(), True))
    try:
        cols, dtype = same_type(values)
    except CompileError:
        cols, dtype = [to_variant(v) for v in values], T.VariantType()
    if any(v.absent for v in values):
        parts = [F.when(v.missing(), F.array().cast(T.ArrayType(dtype))).otherwise(F.array(c).cast(T.ArrayType(dtype))) if v.absent else F.array(c).cast(T.ArrayType(dtype)) for v, c in zip(values, cols, strict=True)]
        return Value(F.concat(*parts), T.ArrayType(dtype, True))
    return Value(F.array(*cols), T.ArrayType(dtype, True))


def struct_of(fields: dict[str, Value]) -> Value:
    kept = {k: v for k, v in fields.items() if not (v.nothing and v.absent)}
    dtype = T.StructType([T.StructField(k, v.type, True) for k, v in kept.items()])
    if not kept:
        return Value(F.struct().cast(dtype), dtype)
    return Value(F.struct(*[v.col.alias(k) for k, v in kept.items()]), dtype)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def step(v: Value, name: str) -> Value:
    """One step of a dotted path below v."""
    if isinstance(v.type, T.StructType) and name in v.type.names:
        return Value(v.col.getField(name), v.type[name].dataType, absent=True)
    if isinstance(v.type, T.MapType) and isinstance(v.type.keyType, T.StringType):
        return Value(F.try_element_at(v.col, F.lit(name)), v.type.valueType, absent=True)
    if v.variant:
        if name.isdigit():
            return Value(F.try_variant_get(v.col, f"$[{name}]", "variant"), v.type, absent=True)
        return Value(F.try_variant_get(v.col, "$['" + name.replace("'", "\\'") + "']", "variant"), v.type, absent=True)
    if v.array and name.isdigit():
        return Value(F.get(v.col, F.lit(int(name))), v.type.elementType, absent=True)
    return missing()


def path(schema: T.StructType, dotted: str) -> Value:
    """The value at a dotted path of a row; missing if the type has no such field."""
    head, *rest = dotted.split(".")
    if head not in schema.names:
        return missing()
    v = Value(quoted(head), schema[head].dataType, absent=True)
    for name in rest:
        v = step(v, name)
        if v.nothing:
            return v
    return v


def truthy(v: Value) -> Column:
    """Null, missing, false and zero are false; all else, empty strings and arrays too, is true."""
    if v.nothing:
        return F.lit(False)
    if v.boolean:
        return F.coalesce(v.col, F.lit(False))
    if v.number:
        return F.coalesce(v.col != 0, F.lit(False))
    if v.variant:
        return v.col.isNotNull() & ~F.coalesce(F.is_variant_null(v.col), F.lit(False)) & ~F.coalesce(of_kind(v.col, "number") == 0, F.lit(False)) & F.coalesce(of_kind(v.col, "BOOLEAN"), F.lit(True))
    return v.col.isNotNull()


def pair(a: Value, b: Value, ordered: bool) -> tuple[Column, Column] | None:
    """Both columns as one type if values of the two can be equal (ordered: can be compared), else None."""
    if a.variant or b.variant:
        return _variant_pair(a, b) if not (ordered and a.variant and b.variant) else None
    if a.number and b.number:
        if a.type == b.type:
            return a.col, b.col
        if a.whole and b.whole:
            # a constant is given the column's type if it fits: a cast column is not pushed to the scan
            if b.constant or a.constant:
                column, other = (a, b) if b.constant else (b, a)
                if isinstance(column.type, T.LongType) or isinstance(other.type, T.IntegerType) and isinstance(column.type, T.IntegerType):
                    literal = F.lit(other.literal).cast(column.type)
                    return (column.col, literal) if b.constant else (literal, column.col)
            return a.long(), b.long()
        return a.double(), b.double()
    for kind in ("string", "boolean"):
        if getattr(a, kind) and getattr(b, kind):
            return a.col, b.col
    if a.time and b.time:
        return (a.col, b.col) if a.type == b.type else (a.col.cast("timestamp"), b.col.cast("timestamp"))
    if ordered:
        return None
    if a.array and b.array:
        if isinstance(a.type.elementType, T.NullType) or isinstance(b.type.elementType, T.NullType):
            return F.size(a.col), F.size(b.col)
        try:
            t = unify([a.type, b.type])
        except CompileError:
            return None
        return a.col.cast(t), b.col.cast(t)
    if isinstance(a.type, T.StructType) and isinstance(b.type, T.StructType) and a.type.names == b.type.names:
        try:
            t = unify([a.type, b.type])
        except CompileError:
            return None
        return a.col.cast(t), b.col.cast(t)
    if isinstance(a.type, T.BinaryType) and isinstance(b.type, T.BinaryType):
        return a.col, b.col
    return None


def compare(a: Value, b: Value, op: str, loose: bool = False) -> Column:
    """Two-valued comparison: false for incomparable and missing values; nulls are equal to each other.

    loose: NULL may stand for false, which lets the scan take the comparison.
    """
    there = ~(a.missing() | b.missing()) if a.absent or b.absent else F.lit(True)
    if op in ("eq", "ne"):
        if a.nothing and b.nothing:
            same = F.lit(True)
        elif a.nothing or b.nothing:
            other = b if a.nothing else a
            same = other.col.isNull() | F.coalesce(F.is_variant_null(other.col), F.lit(False)) if other.variant else other.col.isNull()
        elif (cols := pair(a, b, False)) is None:
            same = a.col.isNull() & b.col.isNull()
        elif (a.absent or a.constant) and (b.absent or b.constant):
            if loose and op == "eq":
                return cols[0] == cols[1]
            equal = F.coalesce(cols[0] == cols[1], F.lit(False))  # a NULL is missing or cannot be
            return equal if op == "eq" else there & ~equal
        else:
            same = cols[0].eqNullSafe(cols[1])
        return there & (same if op == "eq" else ~same)
    if a.variant and b.variant:
        x, y = sort_key(a.col), sort_key(b.col)
        found = {"gt": x > y, "gte": x >= y, "lt": x < y, "lte": x <= y}[op]
        return there & (x["rank"] == y["rank"]) & found
    if (cols := pair(a, b, True)) is None:
        return F.lit(False)
    found = {"gt": cols[0] > cols[1], "gte": cols[0] >= cols[1], "lt": cols[0] < cols[1], "lte": cols[0] <= cols[1]}[op]
    return found if loose else F.coalesce(found, F.lit(False))
