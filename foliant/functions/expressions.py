"""Aggregation expressions as Columns.

compile_expression(spec, scope) gives a Value: a built-in Column with a static
type. Operands of impossible types are folded to the answer (null, false, "")
while compiling, so that no cast can fail at run time; arithmetic uses the
try_ forms. No expression runs Python on the executors.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.errors import CompileError, UnsupportedOperator
from foliant.plans.values import (
    MAX_DEPTH,
    Value,
    array_of,
    compare,
    computed,
    constant,
    missing,
    null,
    path,
    quoted,
    same_type,
    step,
    struct_of,
    to_type,
    truthy,
    unify,
)


@dataclass(frozen=True)
class Scope:
    """What names mean: the fields of the document and the bound variables."""

    schema: T.StructType
    variables: dict[str, Value] = field(default_factory=dict)

    def root(self) -> Value:
        return Value(F.struct(*[quoted(n).alias(n) for n in self.schema.names]), self.schema)

    def resolve(self, reference: str) -> Value:
        if not reference.startswith("$$"):
            return path(self.schema, reference[1:])
        name, *rest = reference[2:].split(".")
        if name in ("ROOT", "CURRENT"):
            if rest:
                return path(self.schema, ".".join(rest))
            return self.root()
        if name not in self.variables:
            raise CompileError(f"no variable $${name}")
        return reduce(step, rest, self.variables[name])


Operator = Callable[[Any, "Compiler"], Value]
OPERATORS: dict[str, Operator] = {}


def operator(*names: str) -> Callable[[Operator], Operator]:
    def add(f: Operator) -> Operator:
        for name in names:
            OPERATORS[name] = f
        return f

    return add


class Compiler:
    def __init__(self, scope: Scope):
        self.scope, self.depth, self.name = scope, 0, ""

    def __call__(self, spec: Any) -> Value:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise CompileError(f"expressions nest at most {MAX_DEPTH} deep")
        try:
            return self._value(spec)
        finally:
            self.depth -= 1

    def _value(self, spec: Any) -> Value:
        if isinstance(spec, str) and spec.startswith("$"):
            return self.scope.resolve(spec)
        if isinstance(spec, dict):
            name = next(iter(spec), "")
            if name.startswith("$"):
                if len(spec) != 1:
                    raise CompileError(f"an operator stands alone: {list(spec)}")
                if name not in OPERATORS:
                    raise UnsupportedOperator(f"no expression operator {name}")
                self.name = name
                return OPERATORS[name](spec[name], self)
            return struct_of({k: self(v) for k, v in spec.items()})
        if isinstance(spec, (list, tuple)):
            return array_of([self(v) for v in spec])
        return constant(spec)

    def all(self, spec: Any) -> list[Value]:
        """The operands of an operator that takes a list; a single one may stand bare."""
        return [self(x) for x in spec] if isinstance(spec, (list, tuple)) else [self(spec)]

    def two(self, spec: Any) -> tuple[Value, Value] | None:
        """Two operands, or None if there are not two."""
        if not isinstance(spec, (list, tuple)) or len(spec) != 2:
            return None
        return self(spec[0]), self(spec[1])

    def one(self, spec: Any) -> Value:
        """The operand of a one-operand operator, bare or in a list of one."""
        return self(spec[0] if isinstance(spec, (list, tuple)) and len(spec) == 1 else spec)


def compile_expression(spec: Any, scope: Scope) -> Value:
    return Compiler(scope)(spec)


# ------------------------------------------------------------------ constants and conditions


@operator("$literal")
def _literal(spec: Any, c: Compiler) -> Value:
    return constant(spec)


@operator("$ifNull")
def _if_null(spec: Any, c: Compiler) -> Value:
    values = [v for v in c.all(spec) if not v.nothing]
    if not values:
        return null()
    cols, dtype = same_type(values)
    return computed(F.coalesce(*cols), dtype)


@operator("$cond")
def _cond(spec: Any, c: Compiler) -> Value:
    if isinstance(spec, dict):
        if set(spec) != {"if", "then", "else"}:
            raise CompileError("$cond takes if, then and else")
        parts = [spec["if"], spec["then"], spec["else"]]
    elif isinstance(spec, (list, tuple)) and len(spec) == 3:
        parts = list(spec)
    else:
        raise CompileError("$cond takes three operands")
    condition, then, other = map(c, parts)
    if condition.nothing and condition.absent:
        return missing()
    (a, b), dtype = same_type([then, other])
    chosen = F.when(truthy(condition), a).otherwise(b)
    if condition.absent:
        chosen = F.when(condition.col.isNotNull(), chosen)
    return computed(chosen, dtype, absent=then.absent and other.absent)  # a NULL of mixed branches counts as null


@operator("$switch")
def _switch(spec: Any, c: Compiler) -> Value:
    if not isinstance(spec, dict) or not isinstance(spec.get("branches"), (list, tuple)):
        raise CompileError("$switch takes branches")
    cases = [(c(b["case"]), c(b["then"])) for b in spec["branches"]]
    default = c(spec["default"]) if "default" in spec else missing()
    cols, dtype = same_type([*(t for _, t in cases), default])
    chosen = cols[-1]
    for (case, _), col in list(zip(cases, cols, strict=False))[::-1]:
        chosen = F.when(truthy(case), col).otherwise(chosen)
    return computed(chosen, dtype, absent=default.absent or any(t.absent for _, t in cases))


@operator("$and")
def _and(spec: Any, c: Compiler) -> Value:
    return computed(reduce(lambda a, b: a & b, [truthy(v) for v in c.all(spec)], F.lit(True)), "boolean")


@operator("$or")
def _or(spec: Any, c: Compiler) -> Value:
    return computed(reduce(lambda a, b: a | b, [truthy(v) for v in c.all(spec)], F.lit(False)), "boolean")


@operator("$not")
def _not(spec: Any, c: Compiler) -> Value:
    return computed(~truthy(c.one(spec)), "boolean")


def _comparison(name: str) -> None:
    @operator("$" + name)
    def run(spec: Any, c: Compiler) -> Value:
        if (both := c.two(spec)) is None:
            raise CompileError(f"${name} takes two operands")
        return computed(compare(*both, name), "boolean")


for _name in ("eq", "ne", "gt", "gte", "lt", "lte"):
    _comparison(_name)

# ------------------------------------------------------------------ arithmetic


def _fold(name: str, step_: Callable[[Column, Column], Column]) -> None:
    @operator(name)
    def run(spec: Any, c: Compiler) -> Value:
        values = c.all(spec)
        if not values or not all(v.number for v in values):
            return null()
        whole = all(v.whole for v in values)
        cols = [v.long() if whole else v.double() for v in values]
        return computed(reduce(step_, cols), "long" if whole else "double")


_fold("$add", F.try_add)
_fold("$subtract", F.try_subtract)
_fold("$multiply", F.try_multiply)


def _of_two_doubles(name: str, f: Callable[[Column, Column], Column]) -> None:
    @operator(name)
    def run(spec: Any, c: Compiler) -> Value:
        both = c.two(spec)
        if both is None or not all(v.number for v in both):
            return null()
        return computed(f(both[0].double(), both[1].double()), "double")




def _ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))


def _divided(x: Column, y: Column) -> Column:
    """IEEE division: by zero it gives an infinity or NaN."""
    zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))
    return F.when(y == 0, F.when(F.isnan(x), x).otherwise(zero)).otherwise(x / y)


_of_two_doubles("$divide", F.try_divide)
_of_two_doubles("$mod", F.try_mod)
_of_two_doubles("$pow", F.pow)
_of_two_doubles("$log", lambda x, b: _divided(_ln(x), _ln(b)))


def _of_one_double(name: str, f: Callable[[Column], Column]) -> None:
    @operator(name)
    def run(spec: Any, c: Compiler) -> Value:
        v = c.one(spec)
        return computed(f(v.double()), "double") if v.number else null()


def _whole(x: Column, rounded: Column) -> Column:
    """rounded, but x itself where it has no fraction (2 ** 53 and above, infinities) or is NaN; rounded is a bigint."""
    return F.when(F.abs(x) < 2.0**53, rounded.cast("double")).otherwise(x)


_of_one_double("$abs", F.abs)
_of_one_double("$ceil", lambda x: _whole(x, F.ceil(x)))
_of_one_double("$floor", lambda x: _whole(x, F.floor(x)))
_of_one_double("$trunc", lambda x: _whole(x, F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))))
_of_one_double("$sqrt", F.sqrt)
_of_one_double("$exp", F.exp)
_of_one_double("$ln", _ln)
_of_one_double("$log10", lambda x: F.when(x > 0, F.log10(x)).when(x == 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan"))))


@operator("$round")
def _round(spec: Any, c: Compiler) -> Value:
    parts = c.all(spec)
    if not 1 <= len(parts) <= 2 or not all(p.number for p in parts):
        return null()
    x = parts[0].double()
    if len(parts) == 1:
        return computed(F.round(x), "double")
    scale = F.pow(F.lit(10.0), parts[1].double())
    return computed(F.round(x * scale) / scale, "double")


# ------------------------------------------------------------------ strings


def _binary(v: Value) -> Column:
    return v.col.cast("binary")


@operator("$concat")
def _concat(spec: Any, c: Compiler) -> Value:
    if not isinstance(spec, (list, tuple)):
        return constant("")
    values = c.all(spec)
    if not all(v.string for v in values):
        return computed(F.lit(None).cast("string"), "string")
    return computed(F.concat(*[v.col for v in values]) if values else F.lit(""), "string")


@operator("$toString")
def _to_string(spec: Any, c: Compiler) -> Value:
    v = c.one(spec)
    if v.string:
        return computed(v.col, "string")
    if v.whole or v.boolean:
        return computed(v.col.cast("string"), "string")
    if v.number:
        return computed(F.when(v.col.isNotNull(), F.format_string("%.6f", v.double())), "string")
    return computed(F.lit(None).cast("string"), "string")


#: The letters that case operators map, and the white space that $trim drops.
_UPPER, _LOWER, _BLANK = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", " \t\n\r\f\v"


@operator("$toLower")
def _lower(spec: Any, c: Compiler) -> Value:
    v = c.one(spec)
    return computed(F.coalesce(F.translate(v.col, _UPPER, _LOWER), F.lit("")), "string") if v.string else constant("")


@operator("$toUpper")
def _upper(spec: Any, c: Compiler) -> Value:
    v = c.one(spec)
    return computed(F.coalesce(F.translate(v.col, _LOWER, _UPPER), F.lit("")), "string") if v.string else constant("")


@operator("$trim")
def _trim(spec: Any, c: Compiler) -> Value:
    given = isinstance(spec, dict) and "input" in spec
    v = c(spec["input"]) if given else c.one(spec)
    chars = c(spec["chars"]) if given and "chars" in spec else constant(_BLANK)
    if not v.string or not chars.string:
        return computed(F.lit(None).cast("string"), "string")
    return computed(F.btrim(v.col, chars.col), "string")


@operator("$substr", "$substrBytes", "$substrCP")
def _substring(spec: Any, c: Compiler) -> Value:
    parts = c.all(spec)
    if len(parts) != 3 or not parts[0].string or not all(p.number for p in parts[1:]):
        return constant("")
    s, (start, length) = _binary(parts[0]), (p.col.cast("int") for p in parts[1:])
    size = F.octet_length(parts[0].col)
    rest = F.when((length < 0) | (length > size - start), size - start).otherwise(length)
    cut = F.when((start >= 0) & (start <= size), F.substring(s, start + 1, rest).cast("string"))
    return computed(F.coalesce(cut, F.lit("")), "string")


@operator("$split")
def _split(spec: Any, c: Compiler) -> Value:
    both = c.two(spec)
    strings = T.ArrayType(T.StringType(), True)
    if both is None or not all(v.string for v in both):
        return computed(F.lit(None).cast(strings), strings)
    s, sep = both
    if sep.constant:
        if sep.literal == "":
            return computed(F.lit(None).cast(strings), strings)
        # one character, plain or escaped, is split without a pattern machine
        literal = re.sub(r"([\\.\[\](){}^$|?*+&~#-])", r"\\\1", str(sep.literal))
        return computed(F.split(s.col, literal, -1), strings)
    return computed(F.when(sep.col != "", F.split(s.col, F.concat(F.lit("\\Q"), F.replace(sep.col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), F.lit(-1))), strings)


@operator("$strLenBytes", "$strLenCP")
def _length(spec: Any, c: Compiler) -> Value:
    v = c.one(spec)
    return computed(F.octet_length(v.col).cast("long"), "long", absent=True) if v.string else missing()


# ------------------------------------------------------------------ types

_INT_PREFIX = r"^[ \t\n\r\f\x0B]*([+-]?[0-9]+)"
_REAL_PREFIX = r"^[ \t\n\r\f\x0B]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


@operator("$toInt", "$toLong")
def _to_long(spec: Any, c: Compiler) -> Value:
    v = c.one(spec)
    if v.string:
        return computed(F.regexp_extract(v.col, _INT_PREFIX, 1).try_cast("long"), "long")
    if v.whole or v.boolean:
        return computed(v.col.cast("long"), "long")
    return computed(v.double().try_cast("long"), "long") if v.number else computed(F.lit(None).cast("long"), "long")


@operator("$toDouble")
def _to_double(spec: Any, c: Compiler) -> Value:
    v = c.one(spec)
    if v.string:
        return computed(F.regexp_extract(v.col, _REAL_PREFIX, 1).try_cast("double"), "double")
    return computed(v.col.cast("double"), "double") if v.number or v.boolean else computed(F.lit(None).cast("double"), "double")


@operator("$toBool")
def _to_bool(spec: Any, c: Compiler) -> Value:
    v = c.one(spec)
    if v.nothing:
        return computed(F.lit(None).cast("boolean"), "boolean")
    if v.boolean:
        return computed(v.col, "boolean")
    if v.number:
        return computed(v.col != 0, "boolean")
    if v.string:
        return computed(F.octet_length(v.col) > 0, "boolean")
    return computed(F.when(v.col.isNotNull(), F.lit(True)), "boolean")


def type_name(v: Value) -> str:
    if v.nothing:
        return "missing" if v.absent else "null"
    t = v.type
    if isinstance(t, T.LongType):
        return "long"
    if v.whole:
        return "int"
    if isinstance(t, T.DecimalType):
        return "decimal"
    for flag, name in (("number", "double"), ("string", "string"), ("boolean", "bool"), ("time", "date"), ("array", "array"), ("document", "object")):
        if getattr(v, flag):
            return name
    return "binData" if isinstance(t, T.BinaryType) else "missing"


@operator("$type")
def _type(spec: Any, c: Compiler) -> Value:
    v = c.one(spec)
    name = F.lit(type_name(v))
    if not v.nothing and not v.constant:
        name = F.when(v.col.isNull(), F.lit("missing" if v.absent else "null")).otherwise(name)
    return computed(name, "string")


@operator("$isNumber")
def _is_number(spec: Any, c: Compiler) -> Value:
    v = c.one(spec)
    return computed(v.col.isNotNull() if v.number and not isinstance(v.type, T.DecimalType) else F.lit(False), "boolean")


@operator("$isArray")
def _is_array(spec: Any, c: Compiler) -> Value:
    v = c.one(spec)
    return computed(v.col.isNotNull() if v.array else F.lit(False), "boolean")


# ------------------------------------------------------------------ arrays


def _element(v: Value, at: Column) -> Value:
    return computed(F.try_element_at(v.col, at), v.type.elementType, absent=True)


@operator("$size")
def _size(spec: Any, c: Compiler) -> Value:
    v = c.one(spec)
    return computed(F.when(v.col.isNotNull(), F.size(v.col).cast("long")), "long", absent=True) if v.array else missing()


@operator("$arrayElemAt")
def _element_at(spec: Any, c: Compiler) -> Value:
    both = c.two(spec)
    if both is None or not both[0].array or not both[1].number:
        return missing()
    i = both[1].col.cast("int")
    return _element(both[0], F.when(i >= 0, i + 1).otherwise(i))


@operator("$first")
def _first(spec: Any, c: Compiler) -> Value:
    v = c.one(spec)
    return computed(F.try_element_at(v.col, F.lit(1)), v.type.elementType) if v.array else null()


@operator("$last")
def _last(spec: Any, c: Compiler) -> Value:
    v = c.one(spec)
    return computed(F.try_element_at(v.col, F.lit(-1)), v.type.elementType) if v.array else null()


@operator("$concatArrays")
def _concat_arrays(spec: Any, c: Compiler) -> Value:
    values = c.all(spec)
    if not values or not all(v.array for v in values):
        return null()
    cols, dtype = same_type(values)
    return computed(F.concat(*cols), dtype)


@operator("$reverseArray")
def _reverse(spec: Any, c: Compiler) -> Value:
    v = c.one(spec)
    return computed(F.reverse(v.col), v.type) if v.array else null()


@operator("$slice")
def _slice(spec: Any, c: Compiler) -> Value:
    parts = c.all(spec)
    if not 2 <= len(parts) <= 3 or not parts[0].array or not all(p.number for p in parts[1:]):
        return null()
    a, n = parts[0], F.size(parts[0].col)
    first = parts[1].col.cast("int")
    if len(parts) == 2:
        start = F.when(first >= 0, F.lit(0)).otherwise(F.greatest(n + first, F.lit(0)))
        count = F.least(F.abs(first), n)
    else:
        start = F.when(first >= 0, F.least(first, n)).otherwise(F.greatest(n + first, F.lit(0)))
        count = F.greatest(parts[2].col.cast("int"), F.lit(0))
    there = reduce(lambda x, y: x & y, [p.col.isNotNull() for p in parts])
    return computed(F.when(there, F.slice(a.col, start + 1, count)), a.type)


@operator("$range")
def _range(spec: Any, c: Compiler) -> Value:
    parts = c.all(spec)
    longs = T.ArrayType(T.LongType(), True)
    if not 2 <= len(parts) <= 3 or not all(p.number for p in parts):
        return computed(F.lit(None).cast(longs), longs)
    start, end = parts[0].long(), parts[1].long()
    by = parts[2].long() if len(parts) == 3 else F.lit(1).cast("long")
    none = ((by > 0) & (start >= end)) | ((by < 0) & (start <= end))
    # the step is made safe in the branch that is not taken as well
    sequence = F.sequence(start, F.when(none, start).otherwise(end - F.signum(by).cast("long")), F.when(none | (by == 0), F.lit(1).cast("long")).otherwise(by))
    return computed(F.when(by == 0, F.lit(None)).when(none, F.array().cast(longs)).otherwise(sequence), longs)


@operator("$in")
def _in(spec: Any, c: Compiler) -> Value:
    both = c.two(spec)
    if both is None or not both[1].array:
        return computed(F.lit(False), "boolean")
    x, a = both
    found = F.exists(a.col, lambda e: compare(x, Value(e, a.type.elementType), "eq"))
    return computed(F.coalesce(found, F.lit(False)), "boolean")


def _elements(spec: Any, c: Compiler) -> Value | None:
    """The operand as an array: an array of numbers, or a scalar as one element."""
    if isinstance(spec, (list, tuple)) and len(spec) != 1:
        return array_of(c.all(spec))
    v = c.one(spec)
    if v.nothing:
        return None
    return v if v.array else Value(F.array(v.col), T.ArrayType(v.type, True))


@operator("$sum")
def _sum(spec: Any, c: Compiler) -> Value:
    a = _elements(spec, c)
    if a is None or not Value(a.col, a.type.elementType).number:
        return constant(0)
    name = "long" if Value(a.col, a.type.elementType).whole else "double"
    zero = F.lit(0).cast(name)
    return computed(F.coalesce(F.aggregate(a.col, zero, lambda s, x: s + F.coalesce(x.cast(name), zero)), zero), name)


@operator("$avg")
def _avg(spec: Any, c: Compiler) -> Value:
    a = _elements(spec, c)
    if a is None or not Value(a.col, a.type.elementType).number:
        return computed(F.lit(None).cast("double"), "double")
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"))
    add = lambda s, x: F.struct((s["s"] + F.coalesce(x.cast("double"), F.lit(0.0))).alias("s"), (s["n"] + x.isNotNull().cast("double")).alias("n"))
    return computed(F.aggregate(a.col, zero, add, lambda s: F.try_divide(s["s"], s["n"])), "double")


def _extreme(name: str, f: Callable[[Column], Column]) -> None:
    @operator(name)
    def run(spec: Any, c: Compiler) -> Value:
        a = _elements(spec, c)
        return null() if a is None else computed(f(a.col), a.type.elementType)


_extreme("$min", F.array_min)
_extreme("$max", F.array_max)

# ------------------------------------------------------------------ documents


@operator("$mergeObjects")
def _merge(spec: Any, c: Compiler) -> Value:
    fields: dict[str, Value] = {}
    for v in c.all(spec):
        if v.nothing:
            continue
        if not isinstance(v.type, T.StructType):
            raise CompileError("$mergeObjects takes documents")
        for f in v.type.fields:
            own = Value(v.col.getField(f.name), f.dataType, absent=True)
            if f.name in fields:  # a missing later field leaves the earlier one
                cols, dtype = same_type([own, fields[f.name]])
                own = Value(F.coalesce(*cols), dtype, absent=True)
            fields[f.name] = own
    return struct_of(fields)


@operator("$objectToArray")
def _object_to_array(spec: Any, c: Compiler) -> Value:
    v = c.one(spec)
    if isinstance(v.type, T.MapType):
        entry = T.StructType([T.StructField("k", v.type.keyType), T.StructField("v", v.type.valueType)])
        return computed(F.transform(F.map_entries(v.col), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))), T.ArrayType(entry))
    if not isinstance(v.type, T.StructType):
        return null()
    fields = [Value(v.col.getField(f.name), f.dataType, absent=True) for f in v.type.fields]
    try:
        cols, dtype = same_type(fields)
    except CompileError:
        cols, dtype = [F.to_variant_object(x.col) if x.document or x.array else x.col.cast("variant") for x in fields], T.VariantType()
    entry = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", dtype)])
    pairs = F.array(*[F.struct(F.lit(f.name).alias("k"), col.alias("v")) for f, col in zip(v.type.fields, cols, strict=True)])
    return computed(F.when(v.col.isNotNull(), F.filter(pairs, lambda e: e["v"].isNotNull())), T.ArrayType(entry))


def _static_pairs(spec: Any, c: Compiler) -> dict[str, Value] | None:
    out = {}
    for entry in spec:
        if isinstance(entry, dict) and set(entry) == {"k", "v"} and isinstance(entry["k"], str) and not entry["k"].startswith("$"):
            out[entry["k"]] = c(entry["v"])
        elif isinstance(entry, (list, tuple)) and len(entry) == 2 and isinstance(entry[0], str) and not entry[0].startswith("$"):
            out[entry[0]] = c(entry[1])
        else:
            return None
    return out


@operator("$arrayToObject")
def _array_to_object(spec: Any, c: Compiler) -> Value:
    if not isinstance(spec, (list, tuple)) or len(spec) != 1:
        return null()
    inner = spec[0]
    if isinstance(inner, (list, tuple)) and (pairs := _static_pairs(inner, c)) is not None:
        return struct_of(pairs)
    v = c(inner)
    if not v.array:
        return null()
    t = v.type.elementType
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
        entries = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])
        v = computed(F.transform(v.col, lambda e: F.struct(F.get(e, F.lit(0)).alias("k"), F.get(e, F.lit(1)).alias("v"))), T.ArrayType(entries))
        t = entries
    if isinstance(t, T.StructType) and t.names == ["k", "v"] and isinstance(t["k"].dataType, T.StringType):
        unique = F.aggregate(v.col, F.create_map().cast(T.MapType(T.StringType(), t["v"].dataType)), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])).cast(T.MapType(T.StringType(), t["v"].dataType)))
        return computed(unique, T.MapType(T.StringType(), t["v"].dataType))
    return null()


@operator("$getField")
def _get_field(spec: Any, c: Compiler) -> Value:
    if isinstance(spec, dict) and "field" in spec:
        name, base = spec["field"], c(spec["input"]) if "input" in spec else c.scope.root()
    else:
        name, base = spec, c.scope.root()
    if isinstance(name, dict) and "$literal" in name:
        name = name["$literal"]
    if not isinstance(name, str):
        raise CompileError("$getField takes a constant name")
    if base.type == c.scope.schema and name in base.type.names:
        return Value(quoted(name), base.type[name].dataType, absent=True)
    return missing() if base.array else step(base, name)


__all__ = ["OPERATORS", "Compiler", "Scope", "compile_expression", "to_type", "unify"]
