"""Stored collections: changes, indexes, cursors."""

import pytest

from foliant.errors import DocumentError
from foliant.sources import Database


@pytest.fixture(params=["folder", "memory"])
def db(spark, tmp_path, request):
    return Database(spark, str(tmp_path / "db") if request.param == "folder" else None)


@pytest.fixture
def boats(db):
    c = db.collection("boats")
    c.insert_many([{"_id": i, "name": n, "masts": masts} for i, (n, masts) in enumerate([("ketch", 4), ("yawl", 8), ("dhow", 2), ("brig", 6), ("punt", 2)], 1)])
    return c


def test_insert_and_find(boats):
    assert [d["_id"] for d in boats.find({"masts": {"$gt": 3}}).sort({"masts": -1})] == [2, 4, 1]
    assert boats.find({"masts": 2}).sort({"masts": 1}).skip(1).limit(1).project({"name": 1, "_id": 0}).to_array() == [{"name": "punt"}]
    assert boats.find_one({"name": "nobody"}) is None


def test_missing_collection_reads_empty(db):
    assert db.collection("none").find().to_array() == []


def test_new_fields_and_wider_types(boats):
    boats.insert_one({"_id": 6, "name": "scow", "masts": 2.5, "oars": 2})
    assert boats.find_one({"_id": 6}) == {"_id": 6, "name": "scow", "masts": 2.5, "oars": 2}
    assert boats.find({"oars": {"$exists": True}}).to_array()[0]["_id"] == 6


def test_updates(boats):
    assert boats.update_many({"masts": 2}, {"$inc": {"masts": 1}, "$set": {"tag.x": "two"}}) == {"matched": 2, "modified": 2, "upserted": None}
    assert boats.find_one({"_id": 3}) == {"_id": 3, "name": "dhow", "masts": 3, "tag": {"x": "two"}}
    assert boats.update_one({"masts": 3}, {"$set": {"name": "first"}})["modified"] == 1
    assert [d["name"] for d in boats.find({"masts": 3})] == ["first", "punt"]
    assert boats.update_many({"_id": 1}, {"$set": {"name": "ketch"}}) == {"matched": 1, "modified": 0, "upserted": None}
    assert boats.update_one({"_id": 1}, {"name": "new"})["matched"] == 1
    assert boats.find_one({"_id": 1}) == {"_id": 1, "name": "new"}
    boats.update_many({"_id": 2}, {"$unset": {"masts": ""}})
    assert boats.find_one({"_id": 2}) == {"_id": 2, "name": "yawl"}


def test_upsert(boats):
    assert boats.update_one({"_id": 9, "masts": {"$gt": 1}}, {"$set": {"name": "proa"}}, upsert=True)["upserted"] == 9
    assert boats.find_one({"_id": 9}) == {"_id": 9, "name": "proa"}


def test_update_errors(boats):
    with pytest.raises(DocumentError, match="14"):
        boats.update_many({}, {"$inc": {"name": 1}})
    with pytest.raises(DocumentError, match="9"):
        boats.update_many({}, {"$set": {"a": 1}, "b": 2})


def test_delete(boats):
    assert boats.delete_one({"masts": 2}) == 1
    assert [d["_id"] for d in boats.find()] == [1, 2, 4, 5]
    assert boats.delete_many({"masts": {"$gte": 4}}) == 3


def test_indexes(boats):
    assert boats.create_index("by_name", {"name": 1}, unique=True) and not boats.create_index("by_name", "name")
    with pytest.raises(DocumentError, match="11000"):
        boats.insert_one({"_id": 7, "name": "ketch"})
    assert boats.find({"name": "ketch"}).to_array() == [{"_id": 1, "name": "ketch", "masts": 4}]
    assert [(i["name"], i["entries"]) for i in boats.list_indexes()] == [("_id_", 5), ("by_name", 5)]
    assert boats.drop_index("by_name") and not boats.drop_index("by_name")
    with pytest.raises(DocumentError, match="72"):
        boats.drop_index("_id_")
    with pytest.raises(DocumentError, match="197"):
        boats.create_index("none", [])
    assert boats.create_index("c", "masts", cluster=True)
    assert boats.find().to_array()[0]["_id"] in (1, 3)


def test_cursors(db, boats):
    cursor = boats.find().batch_size(2)
    key, batch = db.open_cursor("boats", cursor)
    assert [d["_id"] for d in batch] == [1, 2]
    boats.insert_one({"_id": 10, "name": "late"})
    key2, batch = db.get_more("boats", key)
    assert key2 == key and [d["_id"] for d in batch] == [3, 4]
    assert db.get_more("boats", key) == (0, [{"_id": 5, "name": "punt", "masts": 2}])
    with pytest.raises(DocumentError, match="43"):
        db.get_more("boats", key)
    key, _ = db.open_cursor("boats", boats.find().batch_size(1))
    assert db.kill_cursors([key, 99]) == [key]


def test_aggregate_reopened(spark, db, boats):
    again = (Database(spark, db.path) if db.path else db).collection("boats")
    assert again.aggregate([{"$group": {"_id": None, "masts": {"$sum": "$masts"}}}]).to_array() == [{"masts": 22.0}]


def test_replacement_keeps_the_order(boats):
    assert boats.update_one({"_id": 2}, {"_id": 2, "name": "new"}) == {"matched": 1, "modified": 1, "upserted": None}
    assert [d["_id"] for d in boats.find()] == [1, 2, 3, 4, 5]


def test_increments_at_the_ends(boats):
    boats.insert_many([{"_id": 20, "masts": 2**63 - 1}, {"_id": 21, "masts": -(2**63)}])
    assert boats.update_many({"_id": 20}, {"$inc": {"masts": 1}})["modified"] == 1
    assert boats.update_many({"_id": 21}, {"$inc": {"masts": -1}})["modified"] == 1
    assert boats.find_one({"_id": 20})["masts"] == -(2**63) and boats.find_one({"_id": 21})["masts"] == 2**63 - 1


def test_clustered_layout_stays(boats):
    assert boats.create_index("c", "masts", cluster=True)
    boats.update_many({"masts": 2}, {"$set": {"name": "two"}})
    assert sorted(d["_id"] for d in boats.find({"masts": 2})) == [3, 5] and [d["_id"] for d in boats.find({}).sort({"_id": 1})] == [1, 2, 3, 4, 5]
    assert boats.clean() >= 1 and len(boats.find().to_array()) == 5
