"""Databases, collections and cursors over versioned Parquet."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.errors import CompileError, DocumentError
from foliant.functions.expressions import Scope
from foliant.operators import updates
from foliant.operators.filters import compile_filter
from foliant.operators.stages import aggregate
from foliant.plans.values import constant, path, quoted, unify
from foliant.sources.storage import Folder, Memory

RID, _BEFORE = "_rid", "_before"


def plain(x: Any) -> Any:
    if isinstance(x, Row):
        return {k: plain(v) for k, v in x.asDict(False).items() if v is not None}
    if isinstance(x, list):
        return [plain(v) for v in x]
    return x


class Cursor:
    """A lazy find: sort, skip, limit and project may be set until the first read."""

    def __init__(self, df: DataFrame, query: dict, rid: bool):
        self._df, self._query, self._rid = df, query, rid
        self._sort: dict = {}
        self._skip = self._limit = 0
        self._projection: dict | None = None
        self._batch = 101
        self._rows: Iterator[Row] | None = None

    def sort(self, keys: dict) -> Cursor:
        self._sort = keys
        return self

    def skip(self, n: int) -> Cursor:
        self._skip = max(0, n)
        return self

    def limit(self, n: int) -> Cursor:
        self._limit = max(0, n)
        return self

    def project(self, fields: dict) -> Cursor:
        self._projection = fields
        return self

    def batch_size(self, n: int) -> Cursor:
        self._batch = max(1, n)
        return self

    def to_df(self) -> DataFrame:
        """Filter, sort, skip, limit, projection, in this order; ties and unsorted reads in insertion order."""
        df = self._df
        fields = T.StructType([f for f in df.schema.fields if f.name != RID])
        if self._query:
            df = df.where(compile_filter(self._query, Scope(fields)))
        keys = []
        for name, direction in self._sort.items():
            v = path(fields, name)
            if not v.nothing:
                keys.append(v.col.desc_nulls_last() if direction < 0 else v.col.asc_nulls_first())
        if self._rid and (keys or self._skip or self._limit):
            keys.append(F.col(RID))
        if keys:
            df = df.orderBy(*keys)
        if self._skip:
            df = df.offset(self._skip)
        if self._limit:
            df = df.limit(self._limit)
        df = df.drop(RID) if self._rid else df
        if self._projection:
            if any(not isinstance(v, (bool, int, float)) for v in self._projection.values()):
                raise CompileError("a find projection includes or excludes fields only")
            df = aggregate(df, [{"$project": self._projection}])
        return df

    def __iter__(self) -> Iterator[dict]:
        return self

    def __next__(self) -> dict:
        if self._rows is None:
            self._rows = self.to_df().toLocalIterator(prefetchPartitions=True)
        return plain(next(self._rows))

    def next_batch(self) -> list[dict]:
        return list(itertools.islice(self, self._batch))

    def to_array(self) -> list[dict]:
        return list(self)


class Collection:
    def __init__(self, database: Database, name: str):
        self.database, self.name, self.spark = database, name, database.spark
        self.folder = database.folder(name)

    # ------------------------------------------------------------ reading

    def _read(self, state: dict) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"]) if state["schema"] else T.StructType([T.StructField(RID, T.LongType())])
        if not state["folders"]:
            return self.spark.createDataFrame([], schema)
        return self.folder.load(state["folders"], schema)

    def rows(self) -> DataFrame:
        """All documents of the current version with RID, which rises in insertion order."""
        return self._read(self.folder.read())

    def to_df(self) -> DataFrame:
        return self.rows().drop(RID)

    def find(self, query: dict | None = None) -> Cursor:
        return Cursor(self.rows(), query or {}, True)

    def find_one(self, query: dict | None = None) -> dict | None:
        return next(iter(self.find(query).limit(1)), None)

    def aggregate(self, pipeline: list) -> Cursor:
        return Cursor(self.aggregate_df(pipeline), {}, False)

    def aggregate_df(self, pipeline: list) -> DataFrame:
        rows = self.rows()
        ordered = rows.drop(RID)
        return aggregate(ordered, pipeline, lambda name: self.database.collection(name).to_df())

    # ------------------------------------------------------------ changes

    def _commit(self, df: DataFrame, state: dict, add: bool = False) -> None:
        """Writes df as the new version, or beside the present one, and moves the pointer."""
        new = {**state, "version": state["version"] + 1}
        folder = f"v{new['version']}-{uuid.uuid4().hex[:8]}"  # a failed change leaves a folder that no pointer names
        for index in state["indexes"].values():
            if index.get("cluster"):  # the layout that the index asked for
                key = path(T.StructType(df.schema.fields), index["paths"][0]).col
                df = df.repartitionByRange(key).sortWithinPartitions(key)
                break
        self.folder.save(df, folder)
        schema = df.schema if not add or not state["schema"] else _wider(T.StructType.fromJson(state["schema"]), df.schema)
        new["folders"] = [*(state["folders"] if add else []), folder]
        new["schema"] = schema.jsonValue()
        self._check_unique(self._read(new), new["indexes"])
        self.folder.write(new)

    def _check_unique(self, df: DataFrame, indexes: dict) -> None:
        for name, index in indexes.items():
            if index.get("unique"):
                keys = [path(df.schema, p).col.alias(f"k{i}") for i, p in enumerate(index["paths"])]
                if df.groupBy(*keys).count().where("count > 1").limit(1).count():
                    raise DocumentError(11000, "DuplicateKey", f"values of the unique index {name} repeat")

    def insert_df(self, df: DataFrame) -> int:
        """Appends the rows of df, in its order."""
        state = self.folder.read()
        first = state["next_rid"]
        # ids rise with the row's place and have gaps: no pass over the data numbers them
        df, number = _counted(df, F.lit(True))
        rows = df.withColumn(RID, F.monotonically_increasing_id() + F.lit(first))
        if state["schema"]:
            wide = _wider(T.StructType.fromJson(state["schema"]), rows.schema)
            if any(f.name in wide.names and wide[f.name].dataType != f.dataType for f in T.StructType.fromJson(state["schema"]).fields):
                old = self._read(state).select(*[quoted(f.name).cast(wide[f.name].dataType).alias(f.name) if f.name in state_names(state) else F.lit(None).cast(f.dataType).alias(f.name) for f in wide.fields])
                rows = old.unionByName(rows.select(*[quoted(n).cast(wide[n].dataType).alias(n) for n in rows.columns]), allowMissingColumns=True)
                self._insert(rows, state, False)
                return number()
            rows = rows.select(*[quoted(n).cast(wide[n].dataType).alias(n) for n in rows.columns])
        self._insert(rows, state, True)
        return number()

    def _insert(self, rows: DataFrame, state: dict, add: bool) -> None:
        last = state["version"] + 1
        self._commit(rows, {**state, "next_rid": (last + 1) << 42}, add)

    def insert_many(self, documents: list[dict]) -> int:
        return self.insert_df(documents_df(self.spark, documents)) if documents else 0

    def insert_one(self, document: dict) -> int:
        return self.insert_many([document])

    def _update(self, query: dict, spec: dict, many: bool, upsert: bool) -> dict:
        state = self.folder.read()
        rows = self._read(state)
        marked = updates.marked(rows, query, many, RID)
        matched = marked.where(updates.HIT).count()
        if not matched:
            updates.is_replacement(spec)
            if not upsert:
                return {"matched": 0, "modified": 0, "upserted": None}
            document = updates.seed(query, spec)
            self.insert_one(document)
            return {"matched": 0, "modified": 0, "upserted": document["_id"]}
        # the row before is carried through the change and compared in the pass that writes the row after
        text = lambda names: F.to_json(F.struct(*[quoted(n) for n in names]))
        before = marked.withColumn(_BEFORE, F.when(F.col(updates.HIT), text(rows.columns)))
        new = updates.apply_spec(before, spec, F.col(updates.HIT), hidden=(RID, updates.HIT, _BEFORE))
        fields = [n for n in new.columns if n not in (updates.HIT, _BEFORE)]
        new, changed = _counted(new, F.col(updates.HIT) & (F.col(_BEFORE) != text(fields)))
        self._commit(new.select(*[quoted(n) for n in fields]), state)
        return {"matched": matched, "modified": changed(), "upserted": None}

    def update_one(self, query: dict, spec: dict, upsert: bool = False) -> dict:
        return self._update(query, spec, False, upsert)

    def update_many(self, query: dict, spec: dict, upsert: bool = False) -> dict:
        return self._update(query, spec, True, upsert)

    def _delete(self, query: dict, many: bool) -> int:
        state = self.folder.read()
        rows = self._read(state)
        marked, gone = _counted(updates.marked(rows, query, many, RID), F.col(updates.HIT))
        self._commit(marked.where(~F.col(updates.HIT)).drop(updates.HIT), state)
        return gone()

    def delete_one(self, query: dict) -> int:
        return self._delete(query, False)

    def delete_many(self, query: dict) -> int:
        return self._delete(query, True)

    # ------------------------------------------------------------ indexes

    def create_index(self, name: str, keys: str | list | dict, unique: bool = False, cluster: bool = False) -> bool:
        """Whether the index is new. cluster: the rows are laid out by its first field, now and in later changes, so that the scan prunes by it."""
        paths = [keys] if isinstance(keys, str) else list(keys)
        if not paths:
            raise DocumentError(197, "InvalidIndexSpecificationOption", "an index has a field")
        state = self.folder.read()
        if name in {**{"_id_": 0}, **state["indexes"]}:
            return False
        index = {"paths": paths, "unique": unique, "cluster": cluster}
        rows = self._read(state)
        self._check_unique(rows, {name: index} if unique else {})
        state = {**state, "indexes": {**state["indexes"], name: index}}
        if cluster and state["folders"]:
            self._commit(rows, state)
        else:
            self.folder.write({**state, "version": state["version"] + 1})
        return True

    def drop_index(self, name: str) -> bool:
        if name == "_id_":
            raise DocumentError(72, "InvalidOptions", "the index on _id stays")
        state = self.folder.read()
        if name not in state["indexes"]:
            return False
        self.folder.write({**state, "version": state["version"] + 1, "indexes": {k: v for k, v in state["indexes"].items() if k != name}})
        return True

    def list_indexes(self) -> list[dict]:
        """name, field_path ('' if compound), field_paths, entries: an array gives an entry for each distinct element."""
        rows, out = self.rows(), []
        for name, index in {"_id_": {"paths": ["_id"]}, **self.folder.read()["indexes"]}.items():
            entries = F.lit(1)
            for p in index["paths"]:
                v = path(rows.schema, p)
                if v.array:
                    entries = entries * F.greatest(F.size(F.array_distinct(F.coalesce(v.col, F.array().cast(v.type)))), F.lit(1))
            n = rows.agg(F.coalesce(F.sum(entries), F.lit(0))).first()[0]
            out.append({"name": name, "field_path": index["paths"][0] if len(index["paths"]) == 1 else "", "field_paths": index["paths"], "entries": n})
        return out

    def clean(self) -> int:
        """Deletes the folders of older versions and of failed changes, when nobody reads them; the number of them."""
        return self.folder.clean()

    def drop(self) -> None:
        self.folder.delete()


class Database:
    """Collections below a path, or cached in memory without one; a collection that was never written reads as empty."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path.rstrip("/") if path else None
        self._memory: dict[str, Memory] = {}
        self._cursors: dict[int, tuple[str, Cursor]] = {}
        self._next = itertools.count(1)

    def folder(self, name: str) -> Folder | Memory:
        if self.path is None:
            return self._memory.setdefault(name, Memory(self.spark))
        return Folder(self.spark, f"{self.path}/{name.encode('utf-8').hex()}")

    def collection(self, name: str) -> Collection:
        return Collection(self, name)

    def open_cursor(self, name: str, cursor: Cursor) -> tuple[int, list[dict]]:
        """A first batch and the id of the rest, 0 if there is none."""
        batch = cursor.next_batch()
        following = next(cursor, None)
        if following is None:
            return 0, batch
        cursor._rows = itertools.chain([Row(**following)] if following else [], cursor._rows)
        key = next(self._next)
        self._cursors[key] = (name, cursor)
        return key, batch

    def get_more(self, name: str, key: int) -> tuple[int, list[dict]]:
        owner, cursor = self._cursors.get(key, (None, None))
        if cursor is None or owner != name:
            raise DocumentError(43, "CursorNotFound", f"no cursor {key}")
        batch = cursor.next_batch()
        following = next(cursor, None)
        if following is None:
            del self._cursors[key]
            return 0, batch
        cursor._rows = itertools.chain([Row(**following)], cursor._rows)
        return key, batch

    def kill_cursors(self, keys: list[int]) -> list[int]:
        return [k for k in keys if self._cursors.pop(k, None) is not None]


def _counted(df: DataFrame, hit: Column) -> tuple[DataFrame, Callable[[], int]]:
    """df, and the number of its rows with hit, once df has been written."""
    seen = Observation()
    return df.observe(seen, F.count(F.when(hit, F.lit(1))).alias("n")), lambda: int(seen.get.get("n") or 0)


def state_names(state: dict) -> list[str]:
    return T.StructType.fromJson(state["schema"]).names


def _wider(old: T.StructType, new: T.StructType) -> T.StructType:
    fields = [T.StructField(f.name, unify([f.dataType, new[f.name].dataType]) if f.name in new.names else f.dataType, True) for f in old.fields]
    return T.StructType([*fields, *[T.StructField(f.name, f.dataType, True) for f in new.fields if f.name not in old.names]])


def documents_df(spark: SparkSession, documents: list[dict]) -> DataFrame:
    """Python documents as rows; fields in order of first appearance."""
    types: dict[str, T.DataType] = {}
    for d in documents:
        for k, v in d.items():
            own = constant(v).type
            own = T.LongType() if isinstance(own, T.IntegerType) else own
            types[k] = unify([types[k], own]) if k in types else own
    schema = T.StructType([T.StructField(k, _stored(t), True) for k, t in types.items()])

    def fit(v: Any, t: T.DataType) -> Any:
        if v is None:
            return None
        if isinstance(t, T.DoubleType):
            return float(v)
        if isinstance(t, T.StructType):
            return tuple(fit(v.get(f.name), f.dataType) for f in t.fields)
        return [fit(x, t.elementType) for x in v] if isinstance(t, T.ArrayType) else v

    return spark.createDataFrame([tuple(fit(d.get(f.name), f.dataType) for f in schema.fields) for d in documents], schema).coalesce(1)


def _stored(t: T.DataType) -> T.DataType:
    """A type that Parquet can hold: ints are stored as 64 bits, nulls as strings."""
    if isinstance(t, T.IntegerType):
        return T.LongType()
    if isinstance(t, T.NullType):
        return T.StringType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_stored(t.elementType), True)
    return T.StructType([T.StructField(f.name, _stored(f.dataType), True) for f in t.fields]) if isinstance(t, T.StructType) else t


__all__ = ["Collection", "Cursor", "Database", "documents_df"]
