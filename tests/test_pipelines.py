"""Pipelines over small fixtures with their expected results."""

import re

import pytest
from pyspark.sql import functions as F

from foliant.errors import CompileError, UnsupportedOperator
from foliant.operators.filters import filter_documents
from foliant.operators.stages import aggregate
from foliant.sources.collection import documents_df, plain


def run(df, pipeline, **collections):
    out = aggregate(df, pipeline, collections)
    return [{k: (v.toPython() if type(v).__name__ == "VariantVal" else v) for k, v in plain(r).items()} for r in out.collect()]


@pytest.fixture(scope="module")
def agg(spark):
    return documents_df(spark, [{"kind": "ash", "score": 2}, {"kind": "ash", "score": 5}, {"kind": "elm", "score": 3}])


@pytest.fixture(scope="module")
def boats(spark):
    return documents_df(
        spark,
        [
            {"_id": 1, "name": "ketch", "harbour": "north", "weight": 190, "masts": 4, "crew": ["mate", "cook"]},
            {"_id": 2, "name": "raft", "harbour": "south", "weight": 15, "masts": 8},
            {"_id": 3, "name": "dhow", "harbour": "north", "weight": 110, "masts": 2, "crew": ["pilot"]},
        ],
    )


def test_group_stats(agg):
    spec = {"_id": "$kind", "lo": {"$min": "$score"}, "hi": {"$max": "$score"}, "avg": {"$avg": "$score"}, "last": {"$last": "$score"}}
    assert run(agg, [{"$group": spec}, {"$sort": {"_id": 1}}]) == [{"_id": "ash", "lo": 2, "hi": 5, "avg": 3.5, "last": 5}, {"_id": "elm", "lo": 3, "hi": 3, "avg": 3.0, "last": 3}]


def test_group_sparse(spark):
    sparse = documents_df(spark, [{"bucket": "a", "value": 1}, {"value": 2}, {"bucket": "a"}, {}])
    spec = {"_id": "$bucket", "first": {"$first": "$value"}, "last": {"$last": "$value"}, "values": {"$push": "$value"}, "count": {"$sum": 1}}
    found = {r.get("_id"): r for r in run(sparse, [{"$group": spec}])}
    assert found["a"] == {"_id": "a", "first": 1, "values": [1], "count": 2}
    assert found[None] == {"first": 2, "values": [2], "count": 2}


def test_group_empty_input(agg):
    none = [{"$match": {"kind": "fir"}}]
    assert run(agg, [*none, {"$group": {"_id": None, "n": {"$sum": 1}}}]) == []
    assert run(agg, [*none, {"$count": "n"}]) == []


def test_sort_skip_limit(agg):
    assert run(agg, [{"$sort": {"score": -1}}, {"$skip": 1}, {"$limit": 1}]) == [{"kind": "elm", "score": 3}]
    assert len(run(agg, [{"$limit": 0}])) == 3


def test_stable_ties(spark):
    df = documents_df(spark, [{"n": i, "age": a} for i, a in enumerate([40, 25, 30, 30, 35])])
    assert [r["n"] for r in run(df, [{"$sort": {"age": 1}}, {"$limit": 4}])] == [1, 2, 3, 4]
    assert [r["n"] for r in run(df, [{"$sort": {"age": -1}}, {"$limit": 5}])] == [0, 4, 2, 3, 1]


def test_project(agg):
    out = run(agg, [{"$project": {"_id": 0, "kind": 1, "renamed": "$score", "tag": "seen"}}])
    assert out[0] == {"kind": "ash", "renamed": 2, "tag": "seen"}
    assert run(agg, [{"$project": {"score": 0}}])[0] == {"kind": "ash"}
    with pytest.raises(CompileError):
        run(agg, [{"$project": {"kind": 0, "x": "$score"}}])


def test_arithmetic(agg):
    spec = {
        "doubled": {"$multiply": ["$score", 2]}, "plus": {"$add": ["$score", 1]}, "half": {"$divide": ["$score", 2]}, "rest": {"$mod": ["$score", 2]}, "delta": {"$subtract": ["$score", 3]},
        "abs": {"$abs": {"$subtract": ["$score", 3]}}, "ash": {"$eq": ["$kind", "ash"]}, "high": {"$gt": ["$score", 3]}, "rounded": {"$round": [{"$divide": ["$score", 3]}, 2]},
    }
    assert run(agg, [{"$sort": {"score": 1}}, {"$project": spec}]) == [
        {"doubled": 4, "plus": 3, "half": 1.0, "rest": 0.0, "delta": -1, "abs": 1.0, "ash": True, "high": False, "rounded": 0.67},
        {"doubled": 6, "plus": 4, "half": 1.5, "rest": 1.0, "delta": 0, "abs": 0.0, "ash": False, "high": False, "rounded": 1.0},
        {"doubled": 10, "plus": 6, "half": 2.5, "rest": 1.0, "delta": 2, "abs": 2.0, "ash": True, "high": True, "rounded": 1.67},
    ]


def test_conditional(agg):
    spec = {
        "tier": {"$cond": {"if": {"$gte": ["$score", 5]}, "then": "high", "else": "low"}},
        "bucket": {"$switch": {"branches": [{"case": {"$lt": ["$score", 3]}, "then": "small"}, {"case": {"$lt": ["$score", 5]}, "then": "medium"}], "default": "large"}},
        "both": {"$and": [{"$eq": ["$kind", "ash"]}, {"$gte": ["$score", 5]}]}, "either": {"$or": [{"$eq": ["$kind", "ash"]}, {"$lt": ["$score", 3]}]}, "not": {"$not": {"$eq": ["$kind", "ash"]}},
    }
    assert run(agg, [{"$sort": {"score": 1}}, {"$project": spec}]) == [
        {"tier": "low", "bucket": "small", "both": False, "either": True, "not": False},
        {"tier": "low", "bucket": "medium", "both": False, "either": False, "not": True},
        {"tier": "high", "bucket": "large", "both": True, "either": True, "not": False},
    ]


def one(agg, spec):
    return run(agg, [{"$sort": {"score": 1}}, {"$limit": 1}, {"$project": spec}])[0]


def test_strings(agg):
    assert one(agg, {"u": {"$toUpper": "$kind"}, "l": {"$toLower": "ASH"}, "t": {"$trim": {"input": "  hello  "}}, "c": {"$trim": {"input": "--ash--", "chars": "-"}}, "f": {"$substr": ["$kind", 0, 3]}, "p": {"$split": ["a,b,c", ","]}, "n": {"$strLenCP": "$kind"}, "s": {"$concat": ["$kind", ":", {"$toString": "$score"}]}}) == {
        "u": "ASH", "l": "ash", "t": "hello", "c": "ash", "f": "ash", "p": ["a", "b", "c"], "n": 3, "s": "ash:2",
    }


def test_string_edges(agg):
    assert one(agg, {"a": {"$toUpper": None}, "b": {"$concat": ["x", None]}, "c": {"$strLenBytes": "é"}, "d": {"$substr": ["héllo", 0, 3]}, "e": {"$substr": ["abc", 9, 1]}, "f": {"$substr": ["abc", 1, -1]}, "g": {"$split": ["a", ""]}, "h": {"$toString": 2.5}, "i": {"$split": ["a.b", "."]}}) == {
        "a": "", "c": 2, "d": "hé", "e": "", "f": "bc", "h": "2.500000", "i": ["a", "b"],
    }


def test_types(agg):
    assert one(agg, {"s": {"$type": "$score"}, "k": {"$type": "$kind"}, "m": {"$type": "$nothing"}, "i": {"$toInt": "42"}, "p": {"$toInt": "42abc"}, "d": {"$toDouble": "3.14"}, "b": {"$toBool": "$score"}, "e": {"$toBool": ""}, "n": {"$isNumber": "$score"}, "x": {"$isNumber": "$kind"}, "z": {"$toInt": "no"}}) == {
        "s": "long", "k": "string", "m": "missing", "i": 42, "p": 42, "d": 3.14, "b": True, "e": False, "n": True, "x": False,
    }


def test_arrays_and_math(agg):
    spec = {
        "sum": {"$sum": [1, 2, 3, 4]}, "field": {"$sum": "$score"}, "avg": {"$avg": [10, 20, 30]}, "min": {"$min": [3, 1, 2]}, "max": {"$max": [3, 1, 2]}, "pow": {"$pow": [2, 8]}, "sqrt": {"$sqrt": 16}, "log": {"$log": [100, 10]},
        "merged": {"$concatArrays": [[1, 2], [3, 4]]}, "sliced": {"$slice": [[10, 20, 30, 40], 1, 2]}, "ranged": {"$range": [0, 5]}, "in": {"$in": ["ash", ["elm", "ash", "fir"]]}, "is": {"$isArray": [[1, 2, 3]]},
        "first": {"$first": [[10, 20, 30]]}, "last": {"$last": [[10, 20, 30]]}, "reversed": {"$reverseArray": [[1, 2, 3]]},
    }
    assert one(agg, spec) == {"sum": 10, "field": 2, "avg": 20.0, "min": 1, "max": 3, "pow": 256.0, "sqrt": 4.0, "log": 2.0, "merged": [1, 2, 3, 4], "sliced": [20, 30], "ranged": [0, 1, 2, 3, 4], "in": True, "is": True, "first": 10, "last": 30, "reversed": [3, 2, 1]}


def test_array_edges(agg):
    assert one(agg, {"a": {"$slice": [[1, 2, 3], -2]}, "b": {"$range": [5, 0, -2]}, "c": {"$range": [0, 3, 0]}, "d": {"$arrayElemAt": [[1, 2], 5]}, "e": {"$arrayElemAt": [[1, 2], -1]}, "f": {"$range": [3, 3]}, "g": {"$avg": []}, "h": {"$divide": [1, 0]}, "i": {"$ln": 0}, "j": {"$round": [-2.5]}, "k": {"$add": ["$kind", 1]}}) == {
        "a": [2, 3], "b": [5, 3, 1], "e": 2, "f": [], "i": float("-inf"), "j": -3.0,
    }


def test_mixed_array(agg):
    out = run(agg, [{"$addFields": {"bundle": ["$kind", "$score"]}}, {"$project": {"_id": 0, "item": {"$arrayElemAt": ["$bundle", 0]}, "size": {"$size": "$bundle"}, "score": 1, "dollar": {"$literal": "$score"}}}, {"$sort": {"item": 1, "score": 1}}])
    assert [(r["item"], r["score"], r["size"], r["dollar"]) for r in out] == [("ash", 2, 2, "$score"), ("ash", 5, 2, "$score"), ("elm", 3, 2, "$score")]


def test_documents(agg):
    out = one(agg, {"m": {"$mergeObjects": [{"base": True}, {"kind": "$kind"}, {"base": False, "score": "$score"}]}, "r": {"$arrayToObject": [[{"k": "kind", "v": "$kind"}, {"k": "score", "v": "$score"}]]}, "f": {"$getField": "kind"}, "d": {"$getField": {"field": "odd.name", "input": {"$literal": {"odd.name": 2}}}}, "p": {"$objectToArray": {"a": 1, "b": "$score"}}})
    assert out == {"m": {"base": False, "kind": "ash", "score": 2}, "r": {"kind": "ash", "score": 2}, "f": "ash", "d": 2, "p": [{"k": "a", "v": 1}, {"k": "b", "v": 2}]}


def test_set_unset_count(agg):
    assert run(agg, [{"$set": {"other": "$kind", "seen": True}}, {"$unset": ["kind", "score"]}, {"$match": {"other": "ash"}}, {"$count": "n"}]) == [{"n": 2}]


def test_sort_by_count(agg):
    assert run(agg, [{"$sortByCount": "$kind"}]) == [{"_id": "ash", "count": 2}, {"_id": "elm", "count": 1}]


def test_unwind(spark):
    df = documents_df(spark, [{"name": "alpha", "tags": ["x", "y"]}, {"name": "beta", "tags": []}, {"name": "gamma"}])
    out = run(df, [{"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "i"}}, {"$sort": {"name": 1, "i": 1}}])
    assert out == [{"name": "alpha", "tags": "x", "i": 0}, {"name": "alpha", "tags": "y", "i": 1}, {"name": "beta"}, {"name": "gamma"}]
    assert [r["tags"] for r in run(df, [{"$unwind": "$tags"}])] == ["x", "y"]


@pytest.fixture(scope="module")
def owners(spark):
    return documents_df(spark, [{"ownerId": 1, "name": "alice"}, {"ownerId": 2, "name": "bob"}]), documents_df(spark, [{"ownerId": 1, "name": "milo"}, {"ownerId": 3, "name": "ghost"}])


_JOIN = {"$lookup": {"from": "pets", "localField": "ownerId", "foreignField": "ownerId", "as": "pets"}}


def test_lookup_unwind(owners):
    df, pets = owners
    assert run(df, [_JOIN, {"$unwind": "$pets"}, {"$project": {"_id": 0, "owner": "$name", "pet": "$pets.name"}}], pets=pets) == [{"owner": "alice", "pet": "milo"}]
    plan = aggregate(df, [_JOIN, {"$unwind": "$pets"}], {"pets": pets})._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_replace(owners):
    df, pets = owners
    out = run(df, [_JOIN, {"$unwind": "$pets"}, {"$replaceRoot": {"newRoot": "$pets"}}, {"$replaceWith": {"pet": "$name", "summary": {"$concat": ["$name", ":", {"$toString": "$ownerId"}]}}}], pets=pets)
    assert out == [{"pet": "milo", "summary": "milo:1"}]


def test_lookup_pipeline(owners):
    df, pets = owners
    spec = {"from": "pets", "let": {"o": "$ownerId"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$ownerId", "$$o"]}}}, {"$project": {"_id": 0, "name": 1}}], "as": "pets"}
    assert run(df, [{"$lookup": spec}, {"$project": {"name": 1, "pets": 1}}, {"$sort": {"name": 1}}], pets=pets) == [{"name": "alice", "pets": [{"name": "milo"}]}, {"name": "bob", "pets": []}]


def test_lookup_nulls(spark):
    local = documents_df(spark, [{"name": "missing"}, {"name": "null", "k": None}, {"name": "value", "k": "x"}])
    foreign = documents_df(spark, [{"label": "missing"}, {"label": "null", "k": None}, {"label": "value", "k": "x"}])
    out = {r["name"]: sorted(m["label"] for m in r["m"]) for r in run(local, [{"$lookup": {"from": "f", "localField": "k", "foreignField": "k", "as": "m"}}], f=foreign)}
    assert out == {"missing": ["missing", "null"], "null": ["missing", "null"], "value": ["value"]}


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ({"harbour": "north"}, [1, 3]), ({"harbour": {"$ne": "north"}}, [2]), ({"weight": {"$gt": 15, "$lte": 190}}, [1, 3]), ({"masts": {"$in": [2, 8]}}, [2, 3]), ({"masts": {"$nin": [2, 8]}}, [1]),
        ({"crew": {"$exists": False}}, [2]), ({"crew": "pilot"}, [3]), ({"crew": {"$ne": "pilot"}}, [1, 2]), ({"name": {"$regex": "^[RD]", "$options": "i"}}, [2, 3]), ({"name": re.compile("CH$", re.I)}, [1]),
        ({"name": {"$regex": "("}}, []), ({"$or": [{"masts": 8}, {"weight": 110}]}, [2, 3]), ({"$and": []}, []), ({"name": {"$gt": 5}}, []), ({"crew": None}, []), ({"nothing": {"$nin": [1]}}, [1, 2, 3]),
        ({"crew.1": {"$exists": True}}, [1]), ({"$expr": {"$gt": ["$weight", {"$multiply": ["$masts", 40]}]}}, [1, 3]), ({"weight": {"$gt": 14.5, "$lt": 15.5}}, [2]), ({}, [1, 2, 3]),
    ],
)
def test_filters(boats, query, ids):
    assert sorted(r["_id"] for r in filter_documents(boats, query).collect()) == ids


def test_unknown_operators(boats):
    with pytest.raises(UnsupportedOperator):
        filter_documents(boats, {"masts": {"$mod": [2, 0]}})
    assert filter_documents(boats, {"masts": {"$mod": [2, 0]}}, strict=False).count() == 0
    with pytest.raises(UnsupportedOperator):
        aggregate(boats, [{"$facet": {}}])


def test_nested_paths(spark):
    df = documents_df(spark, [{"_id": 1, "owner": {"name": "ann", "age": 30}}, {"_id": 2, "owner": {"name": "bo", "age": 20}}])
    assert [r["_id"] for r in run(df, [{"$match": {"owner.age": {"$gt": 25}}}])] == [1]
    assert run(df, [{"$sort": {"owner.age": 1}}, {"$limit": 1}, {"$project": {"n": "$owner.name"}}]) == [{"_id": 2, "n": "bo"}]


def test_pushdown(spark, tmp_path):
    spark.range(1000).withColumn("x", F.col("id") % 7).write.parquet(str(tmp_path / "t"))
    plan = aggregate(spark.read.parquet(str(tmp_path / "t")), [{"$match": {"x": {"$gt": 3}, "id": {"$in": [1, 2]}}}, {"$group": {"_id": None, "n": {"$sum": 1}}}])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,3)" in plan and "In(id" in plan and "Python" not in plan


def test_dynamic(spark):
    from foliant.sources.dynamic import from_documents

    df = from_documents(spark, [{"_id": 1, "v": 5}, {"_id": 2, "v": "zzz"}, {"_id": 3, "v": None}, {"_id": 4}, {"_id": 5, "v": True}, {"_id": 6, "v": [5, "q"]}, {"_id": 7, "v": {"w": 2.5}}])
    ids = lambda q: sorted(int(str(r["_id"])) for r in filter_documents(df, q).collect())
    assert ids({"v": 5}) == [1, 6] and ids({"v": None}) == [3] and ids({"v": {"$exists": False}}) == [4] and ids({"v": {"$gt": 4}}) == [1]
    assert ids({"v": {"$gt": "a"}}) == [2] and ids({"v": True}) == [5] and ids({"v.w": 2.5}) == [7] and ids({"v": {"$regex": "^z"}}) == [2]
    order = [int(str(r["_id"])) for r in aggregate(df, [{"$match": {"_id": {"$lte": 5}}}, {"$sort": {"v": 1}}, {"$limit": 5}]).collect()]
    assert order == [3, 4, 1, 2, 5]
    groups = aggregate(df, [{"$group": {"_id": "$v", "n": {"$sum": 1}}}]).collect()
    assert len(groups) == 7 or len(groups) == 6


def test_split_by_any_separator(spark):
    """Separators are plain strings, whatever they mean in patterns."""
    for sep in (".", " ", "\\", "|", "a.b", "$", "--", "\n", "é", "\\E", "#", "[x]", "^"):
        text = f"p{sep}q{sep}{sep}r"
        df = documents_df(spark, [{"s": text}])
        assert run(df, [{"$project": {"_id": 0, "x": {"$split": ["$s", {"$literal": sep}]}}}]) == [{"x": text.split(sep)}]
