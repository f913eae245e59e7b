"""Writes that meet: transactions, unique keys, snapshots."""

import pytest

from larkspur.operators.collection import DuplicateKey
from larkspur.operators.database import Database
from larkspur.sources import tables


def test_commit_keeps_what_others_wrote(spark):
    db = Database(spark)
    db.run_command({"insert": "foo", "documents": [{"x": 1}]})
    own = {"lsid": {"id": "a"}, "txnNumber": 1, "autocommit": False}
    assert db.run_command({"insert": "foo", "documents": [{"x": 2}], **own})["ok"]
    db.run_command({"insert": "foo", "documents": [{"x": 3}]})
    got = db.run_command({"commitTransaction": 1, **own})
    assert not got["ok"] and got["code"] == 112
    assert sorted(r.x for r in db.collection("foo").df.collect()) == [1, 3]
    again = own | {"txnNumber": 2}
    db.run_command({"insert": "foo", "documents": [{"x": 4}], **again})
    assert db.run_command({"commitTransaction": 1, **again})["ok"] and db.run_command({"commitTransaction": 1, **again})["ok"]
    assert sorted(r.x for r in db.collection("foo").df.collect()) == [1, 3, 4]


def test_replace_one_keeps_unique_keys(spark):
    db = Database(spark)
    foo = db.collection("foo")
    foo.insert([{"_id": 1, "k": 1}, {"_id": 2, "k": 2}])
    foo.create_index({"k": 1}, unique=True)
    with pytest.raises(DuplicateKey):
        foo.replace_one({"_id": 2}, {"k": 1})
    assert sorted(r.k for r in foo.df.collect()) == [1, 2]
    assert foo.replace_one({"_id": 2}, {"k": 5}) == 1


def test_text_is_swapped_in(spark, tmp_path):
    path = f"{tmp_path}/manifest"
    for text in ("one", "two é"):
        tables._write_text(spark, path, text)
        assert tables._read_text(spark, path) == text
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["manifest"]
