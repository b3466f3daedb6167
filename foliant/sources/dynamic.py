"""Collections without a schema: documents as VARIANT.

Each top-level field becomes a VARIANT column; an absent field is NULL, an
explicit null a VARIANT null, so missing and null stay apart. Filters, sorts,
groups and expressions then work as on typed tables, with types found per row.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fields_of(docs: DataFrame, column: str = "doc") -> list[str]:
    """All top-level names, in one aggregate pass."""
    keys = F.map_keys(F.try_variant_get(column, "$", "map<string,variant>"))
    return sorted(r[0] for r in docs.select(F.explode(keys)).distinct().collect())  # names, not rows


def dynamic_frame(docs: DataFrame, fields: list[str] | None = None, column: str = "doc") -> DataFrame:
    """docs (one VARIANT column) as one VARIANT column for each field."""
    names = fields_of(docs, column) if fields is None else fields
    return docs.select(*[F.try_variant_get(F.col(column), "$['" + n.replace("'", "\\'") + "']", "variant").alias(n) for n in names])


def from_json_lines(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    return dynamic_frame(spark.read.text(path).select(F.parse_json("value").alias("doc")), fields)


def from_documents(spark: SparkSession, documents: list[dict[str, Any]], fields: list[str] | None = None) -> DataFrame:
    rows = spark.createDataFrame([(json.dumps(d),) for d in documents], "value string").coalesce(1)
    if fields is None:
        fields = list(dict.fromkeys(k for d in documents for k in d))
    return dynamic_frame(rows.select(F.parse_json("value").alias("doc")), fields)
