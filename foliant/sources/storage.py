"""Versioned Parquet folders on any Hadoop file system.

A collection is a folder of immutable versions (v1, v2, ...) and a file
_CURRENT that names one of them and holds the collection's metadata as JSON.
A change writes a new version and then replaces the pointer by a rename; a
reader keeps the version that it opened. Inserts add part files next to the
old ones by naming several folders in the pointer.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

EMPTY: dict[str, Any] = {"version": 0, "folders": [], "next_rid": 1, "indexes": {}, "schema": None}


class Folder:
    """Versions on a file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(f"{self.path}/{name}"))

    def read(self) -> dict[str, Any]:
        """The pointer; of a new collection an empty one."""
        if not self.exists("_CURRENT"):
            return json.loads(json.dumps(EMPTY))
        stream = self.fs.open(self._path(f"{self.path}/_CURRENT"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def write(self, state: dict[str, Any]) -> None:
        """Replaces the pointer. One writer at a time: a pointer that moved since it was read is an error."""
        if self.read()["version"] != state["version"] - 1:
            raise RuntimeError(f"{self.path} was changed by another writer")
        new = self._path(f"{self.path}/_NEXT-{state['version']}")
        stream = self.fs.create(new, True)
        stream.write(bytearray(json.dumps(state).encode("utf-8")))
        stream.close()
        current = self._path(f"{self.path}/_CURRENT")
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, current, options)

    def save(self, df: DataFrame, name: str) -> None:
        df.write.parquet(f"{self.path}/{name}")

    def load(self, names: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def clean(self) -> int:
        """Deletes version folders that the pointer does not name (older versions, failed changes); the number of them.

        For when no reader holds an older version.
        """
        if not self.fs.exists(self._path(self.path)):
            return 0
        named, gone = set(self.read()["folders"]), 0
        for status in self.fs.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if name.startswith(("v", "_NEXT-")) and name not in named:
                self.fs.delete(status.getPath(), True)
                gone += 1
        return gone

    def delete(self) -> None:
        self.fs.delete(self._path(self.path), True)


class Memory:
    """Versions as cached DataFrames, for collections that last as long as the session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.state: dict[str, Any] = json.loads(json.dumps(EMPTY))
        self.frames: dict[str, DataFrame] = {}

    def read(self) -> dict[str, Any]:
        return json.loads(json.dumps(self.state))

    def write(self, state: dict[str, Any]) -> None:
        if self.state["version"] != state["version"] - 1:
            raise RuntimeError("the collection was changed by another writer")
        self.state = json.loads(json.dumps(state))

    def save(self, df: DataFrame, name: str) -> None:
        self.frames[name] = df.persist()
        df.write.format("noop").mode("overwrite").save()  # fills the cache

    def load(self, names: list[str], schema: T.StructType) -> DataFrame:
        parts = [self.frames[n] for n in names]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        have = {f.name: f for f in out.schema.fields}
        return out.select(*[out[f"`{f.name}`"].cast(f.dataType).alias(f.name) for f in schema.fields if f.name in have])

    def clean(self) -> int:
        gone = [n for n in self.frames if n not in self.state["folders"]]
        for n in gone:
            self.frames.pop(n).unpersist()
        return len(gone)

    def delete(self) -> None:
        self.state = json.loads(json.dumps(EMPTY))
        self.clean()
