"""Random filters and pipelines against a small interpreter of their meaning."""

import random

from foliant.operators.filters import filter_documents
from foliant.operators.stages import aggregate
from foliant.sources.collection import documents_df, plain

FIELDS = ("a", "b", "s", "t")


def documents(rng, n=40):
    out = []
    for i in range(n):
        d = {"_id": i, "a": rng.randrange(6), "b": rng.choice([0.5, 1.5, 2.0, -1.0]), "s": rng.choice(["x", "y", "xy", ""]), "t": [rng.randrange(4) for _ in range(rng.randrange(4))]}
        for k in FIELDS:
            if rng.random() < 0.2:
                del d[k]
        out.append(d)
    return out


def number(x):
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def same(x, y):
    return x == y if number(x) and number(y) else type(x) is type(y) and x == y


def equal(d, f, v):
    if f not in d:
        return False
    return same(d[f], v) or (isinstance(d[f], list) and any(same(e, v) for e in d[f]))


def holds(d, query):
    for f, c in query.items():
        if f in ("$and", "$or"):
            if not (all if f == "$and" else any)(holds(d, q) for q in c):
                return False
            continue
        for op, v in (c if isinstance(c, dict) else {"$eq": c}).items():
            x = d.get(f)
            comparable = f in d and (number(x) and number(v) or isinstance(x, str) and isinstance(v, str))
            ok = {
                "$eq": lambda: equal(d, f, v), "$ne": lambda: not equal(d, f, v), "$in": lambda: any(equal(d, f, y) for y in v), "$nin": lambda: not any(equal(d, f, y) for y in v),
                "$gt": lambda: comparable and x > v, "$gte": lambda: comparable and x >= v, "$lt": lambda: comparable and x < v, "$lte": lambda: comparable and x <= v, "$exists": lambda: (f in d) == bool(v),
            }[op]()
            if not ok:
                return False
    return True


def random_filter(rng, depth=0):
    out = {}
    for _ in range(rng.randrange(1, 3)):
        if depth < 2 and rng.random() < 0.25:
            out[rng.choice(["$and", "$or"])] = [random_filter(rng, depth + 1) for _ in range(rng.randrange(1, 3))]
            continue
        f = rng.choice(FIELDS)
        value = lambda: rng.choice([rng.randrange(6), 1.5, "x", "xy"])  # noqa: E731, B023
        op = rng.choice(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists"])
        out[f] = {op: [value(), value()] if op in ("$in", "$nin") else rng.random() < 0.5 if op == "$exists" else value()}
    return out


def test_filters(spark):
    rng = random.Random(1)
    docs = documents(rng)
    df = documents_df(spark, docs).cache()
    queries = [random_filter(rng) for _ in range(60)]
    for q in queries:
        assert sorted(r["_id"] for r in filter_documents(df, q).select("_id").collect()) == [d["_id"] for d in docs if holds(d, q)], q


def test_pipelines(spark):
    rng = random.Random(2)
    docs = documents(rng)
    df = documents_df(spark, docs).cache()
    for _ in range(12):
        q, direction, skip, limit = random_filter(rng), rng.choice([1, -1]), rng.randrange(3), rng.randrange(1, 12)
        rows = [d for d in docs if holds(d, q)]
        rows = sorted(rows, key=lambda d: (d.get("a") is not None, d.get("a") or 0), reverse=direction < 0) if direction > 0 else sorted(rows, key=lambda d: (d.get("a") is None, -(d.get("a") or 0)))
        rows = rows[skip : skip + limit]
        groups = {}
        for d in rows:
            g = groups.setdefault(d.get("s"), {"n": 0.0, "sum": 0.0, "first": d.get("a"), "push": []})
            g["n"] += 1
            g["sum"] += d.get("a", 0)
            g["push"] += [d["b"]] if "b" in d else []
        spec = {"_id": "$s", "n": {"$sum": 1}, "sum": {"$sum": "$a"}, "first": {"$first": "$a"}, "push": {"$push": "$b"}}
        out = aggregate(df, [{"$match": q}, {"$sort": {"a": direction}}, {"$skip": skip}, {"$limit": limit}, {"$group": spec}]).collect()
        got = {r["_id"]: {k: r[k] for k in ("n", "sum", "first", "push")} for r in out}
        assert got == groups, (q, direction, skip, limit, [plain(r) for r in out])
