import json
import urllib.error
import urllib.request

import pytest

from foliant.errors import CompileError


def test_stream(spark, tmp_path):
    from foliant.streaming import stream_pipeline, windowed_group

    rows = [(i, f"2024-01-01 00:{i:02d}:00", "view" if i % 2 else "buy", i) for i in range(30)]
    batch = spark.createDataFrame(rows, "id long, ts string, kind string, value long").selectExpr("id", "cast(ts as timestamp) ts", "kind", "value")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    names = spark.createDataFrame([("view", "seen"), ("buy", "bought")], "kind string, label string")
    out = stream_pipeline(stream, [{"$match": {"value": {"$gte": 10}}}, {"$lookup": {"from": "names", "localField": "kind", "foreignField": "kind", "as": "n"}}, {"$unwind": "$n"}, {"$project": {"id": 1, "label": "$n.label"}}], {"names": names})
    q = out.writeStream.format("memory").queryName("plain").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.id, r.label) for r in spark.table("plain").collect()} == {(i, "seen" if i % 2 else "bought") for i in range(10, 30)}
    groups = windowed_group(stream, "ts", "10 minutes", {"_id": "$kind", "n": {"$sum": 1}, "top": {"$max": "$value"}}, "5 minutes")
    q = groups.writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    found = {(r.window_start.minute, r._id): (r.n, r.top) for r in spark.table("windows").collect()}
    assert found[(10, "view")] == (5.0, 19) and len(found) == 6
    with pytest.raises(CompileError):
        stream_pipeline(stream, [{"$sort": {"id": 1}}])


def test_server(spark, tmp_path):
    from foliant.server import start_server

    with pytest.raises(ValueError):
        start_server(spark, str(tmp_path), 0, host="0.0.0.0")
    server = start_server(spark, str(tmp_path), 0, token="t")
    root = f"http://127.0.0.1:{server.server_address[1]}/api/v1"

    def post(url, body, token="t"):
        request = urllib.request.Request(root + url, json.dumps(body).encode(), {"Authorization": f"Bearer {token}"}, method="POST")
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert post("/zoo/pets/find", {}, "no")[0] == 401
        assert post("/zoo/pets/insert", {"documents": [{"_id": i, "n": i * i} for i in range(5)]}) == (200, {"insertedCount": 5})
        status, out = post("/zoo/pets/find", {"filter": {"n": {"$gt": 0}}, "sort": {"n": -1}, "batchSize": 2})
        assert [d["_id"] for d in out["batch"]] == [4, 3] and out["cursorId"] != "0"
        assert [d["_id"] for d in post(f"/cursors/{out['cursorId']}/get-more", {"db": "zoo", "coll": "pets"})[1]["batch"]] == [2, 1]
        assert post("/cursors/99/get-more", {"db": "zoo", "coll": "pets"}) == (400, {"error": "CursorNotFound", "code": 43})
        assert post("/cursors/kill", {"cursorIds": ["99"]})[1] == {"killed": [], "notFound": ["99"]}
        assert post("/zoo/pets/update", {"filter": {"_id": 1}, "update": {"$inc": {"n": 5}}})[1] == {"matched": 1, "modified": 1, "upsertedIds": []}
        assert post("/zoo/pets/aggregate", {"pipeline": [{"$group": {"_id": None, "s": {"$sum": "$n"}}}]})[1]["batch"] == [{"s": 35.0}]
        assert post("/zoo/pets/indexes/create", {"name": "by_n", "fieldPath": "n"})[1] == {"created": True}
        assert [i["name"] for i in post("/zoo/pets/indexes/list", {})[1]] == ["_id_", "by_n"]
        assert post("/zoo/pets/indexes/drop", {"name": "by_n"})[1] == {"dropped": True}
        assert post("/zoo/pets/delete", {"filter": {"n": {"$lt": 5}}})[1] == {"deleted": 2}
        assert post("/zoo/pets/nothing", {}) == (404, {"error": "Unknown action"})
        assert post("/zoo/pets/aggregate", {"pipeline": [{"$facet": {}}]})[0] == 400
    finally:
        server.shutdown()
