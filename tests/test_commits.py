"""Writers that work at a time, are cut off, or meet a bag that changes."""

from __future__ import annotations

import shutil
import threading

import pytest
from pyspark.sql import functions as F
from test_store import draft_files

from tracewright.operators import bags, merkle
from tracewright.operators.commits import WHOLE_EVERY, Commits, State
from tracewright.operators.store import Store


def test_one_of_two_is_first(spark, tmp_path):
    commits = Commits(spark, str(tmp_path / "t"))
    assert commits.latest() == -1 and commits.state() == State(-1) and not (tmp_path / "t").exists()
    one, two = commits.begin(), commits.begin()
    for tx, n in ((one, 1), (two, 2)):
        tx.append("x", spark.range(n))
        tx.facts["n"] = n
    assert commits.read(commits.state(), "x", "id long").count() == 0
    assert two.commit() and not one.commit()
    one.discard()
    assert commits.read(commits.state(), "x", "id long").count() == 2 and commits.state().facts == {"n": 2} and commits.unnamed(commits.state()) == []
    assert commits.begin().commit() and commits.latest() == 0  # nothing written, no manifest
    assert commits._renamed(_file(commits, "a"), commits._at("new")) and not commits._renamed(_file(commits, "b"), commits._at("new"))


def _file(commits, name):
    commits._fs.create(commits._at(name)).close()
    return commits._at(name)


def test_states_stay(spark, tmp_path):
    commits = Commits(spark, str(tmp_path / "t"))
    for i in range(WHOLE_EVERY + 3):
        tx = commits.begin()
        tx.append("x", spark.range(i, i + 1).withColumn("kind", F.lit(f"k{i % 2}")), "kind")
        tx.append("empty", spark.range(0))
        tx.facts["last"] = i
        assert tx.commit()
    ids = lambda n: sorted(r["id"] for r in commits.read(commits.state(n), "x", "id long, kind string").collect())
    assert ids(None) == list(range(WHOLE_EVERY + 3)) and ids(WHOLE_EVERY - 2) == list(range(WHOLE_EVERY - 1)) and ids(WHOLE_EVERY) == list(range(WHOLE_EVERY + 1))
    tx = commits.begin()
    tx.replace("x", commits.read(tx.state, "x", "id long, kind string"), "kind")
    assert tx.commit() and ids(None) == list(range(WHOLE_EVERY + 3)) and len(commits.state().folders["x"]) == 1
    assert ids(3) == [0, 1, 2, 3] and commits.state().facts == {"last": WHOLE_EVERY + 2} and "empty" not in commits.state().folders


def test_two_writers_leave_dense_unique_lines(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    faults = []

    def write(who):
        try:
            Store(spark, store.path).create(draft_files(spark, [(i, None, f"{who} {i}", f"{who}{i}", None) for i in range(3)] + [(9, None, "shared", "same", None)]))
        except Exception as e:
            faults.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in ("ann", "bob")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not faults
    lines = sorted((r["idx"], r["id"]) for r in store.table("log").collect())
    assert [i for i, _ in lines] == list(range(7)) and len({i for _, i in lines}) == 7 == store.size() == store.table("deeds").count()
    assert store.audit().count() == 0 and store.commits.unnamed(store.commits.state()) == []
    tree = merkle.nodes(merkle.leaves(store.table("log")), 7)
    assert store.head().first() == merkle.head(tree, 7).first()
    old = store.snapshot(0)
    assert old.size() == old.table("log").count() == 4 and old.head().first() == merkle.head(merkle.nodes(merkle.leaves(old.table("log")), 4), 4).first()
    assert store.receipts().where(merkle.included(F.col("idx"), F.col("size"), merkle.leaf(merkle.material(F.col("id"), F.col("digest"), F.col("unix_time"))), F.col("path"), F.col("root"))).count() == 7


def test_a_writer_that_is_cut_off_leaves_nothing_to_see(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    rows = draft_files(spark, [(0, None, "One", "1", None)])
    whole = Store._append

    def cut(self, tx, name, rows):
        if name == "log":
            raise OSError("lost")
        whole(self, tx, name, rows)

    monkeypatch.setattr(Store, "_append", cut)
    with pytest.raises(OSError, match="lost"):
        store.create(rows)
    monkeypatch.setattr(Store, "_append", whole)
    assert all(store.table(t).isEmpty() for t in ("deeds", "evidence", "log")) and store.commits.latest() == -1
    assert [r["status"] for r in store.create(rows).collect()] == ["created"] and store.size() == 1


def test_a_bag_that_changes_after_its_check_is_not_taken_in(spark, tmp_path, monkeypatch):
    sender, path = Store(spark, str(tmp_path / "sender")), str(tmp_path / "bag")
    sender.ingest(spark.createDataFrame([("p", bytearray(b"1")), ("q", bytearray(b"2"))], "path string, content binary"))
    sender.create(draft_files(spark, [(0, None, "One", "1", None), (1, None, "Two", "2", None)]))
    sender.export(spark.createDataFrame([("deed-file-one",), ("deed-file-two",)], "id string"), path)
    checked = bags.refusals

    def then_changed(bag, *rest):
        plan = bags.settled(checked(bag, *rest))
        for table in ("records", "products"):
            shutil.rmtree(f"{path}/{table}")
        spark.createDataFrame([("deed-file-one", "0" * 64, bytearray(b"other"))], "id string, hex string, content binary").write.parquet(f"{path}/products")
        spark.catalog.refreshByPath(f"{path}/products")
        return plan

    monkeypatch.setattr(bags, "refusals", then_changed)
    other = Store(spark, str(tmp_path / "other"))
    try:
        said = {r["action"].split(" ")[0] for r in other.import_bag(path, allow_unsigned=True).collect()}
    except Exception as e:  # files that are gone end the read
        said = {"refused:"} if "FILE_NOT_EXIST" in str(e) or "does not exist" in str(e) else {str(e)}
    assert said == {"refused:"}
    assert other.commits.latest() == -1 and other.table("blobs").isEmpty() and other.commits.unnamed(other.commits.state()) == []
