"""Pipelines over streams.

The stages that need one document at a time run on a stream as they run on a
table: $match, $project, $set, $unset, $unwind, $replaceRoot, and $lookup of
a table followed by $unwind of its result. Groups run in event-time windows
behind a watermark.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.errors import CompileError
from foliant.functions.accumulators import ORDERED, accumulator
from foliant.functions.expressions import Scope, compile_expression
from foliant.operators.stages import opened, run_stages
from foliant.plans.plan import plan_of

STATELESS = ("$match", "$project", "$set", "$addFields", "$unset", "$unwind", "$replaceRoot", "$replaceWith")


def stream_pipeline(stream: DataFrame, pipeline: list, collections: Callable[[str], DataFrame] | dict | None = None) -> DataFrame:
    """The stateless pipeline over a stream."""
    for i, one in enumerate(pipeline):
        name, spec = opened(one)
        joined = name == "$lookup" and i + 1 < len(pipeline) and next(iter(pipeline[i + 1])) == "$unwind" and "pipeline" not in spec
        if name not in STATELESS and not joined:
            raise CompileError(f"{name} does not run on a stream by itself")
    found = collections.__getitem__ if isinstance(collections, dict) else collections
    return run_stages(plan_of(stream, found), pipeline).visible()


def windowed_group(stream: DataFrame, time: str, window: str, spec: dict[str, Any], late: str, slide: str | None = None) -> DataFrame:
    """$group per event-time window: window_start, window_end, _id and the accumulators. late: how long a window waits."""
    if any(next(iter(a), "") in ORDERED for k, a in spec.items() if k != "_id"):
        raise CompileError("a stream has no document order")
    scope = Scope(stream.schema)
    key = compile_expression(spec["_id"], scope)
    aggregates = [accumulator(a, scope, None)[0].alias(k) for k, a in spec.items() if k != "_id"]
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, window, slide).alias("w"), key.col.alias("_id")).agg(*aggregates)
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in grouped.columns if c != "w"])
