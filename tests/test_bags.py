"""Export, check and import between two stores, and superseding along a long chain."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from test_store import draft_files
from tracewright.functions import crypto
from tracewright.operators import audit, lineage, merkle
from tracewright.operators.bags import Bag
from tracewright.operators.store import Store

SEED = bytes(range(1, 33))
KEY = crypto.public_key(SEED)


@pytest.fixture(scope="module")
def sent(spark, tmp_path_factory):
    """A store with a superseded record, and a signed bag of two of its three records."""
    path = tmp_path_factory.mktemp("bags")
    store = Store(spark, str(path / "sender"), key=b"k" * 32, host=audit.Host((KEY,), True), seed=SEED)
    store.create(draft_files(spark, [(0, None, "One", "1", None), (1, None, "Other", "3", None)]))
    store.create(draft_files(spark, [(0, None, "Two", "2", "deed-file-one")]))
    contents = spark.createDataFrame([(f"p{c}", c.encode()) for c in "1233"], "path string, content binary")
    assert store.ingest(contents) == 3 and store.ingest(contents) == 0
    asked = spark.createDataFrame([("deed-file-one",), ("deed-file-two",)], "id string")
    assert {tuple(r) for r in store.export(asked, str(path / "bag")).collect()} == {("deed-file-one", "exported"), ("deed-file-two", "exported")}
    return store, str(path / "bag"), path


def told(df):
    return sorted(map(tuple, df.collect()))


def test_evidence_with_signatures(spark, sent):
    store, _, _ = sent
    assert {r["verdict"] for r in store.evidence().collect()} == {"ok"}
    strict = Store(spark, store.path, key=b"k" * 32, host=audit.Host((bytes(32),), True))
    assert {r["verdict"] for r in strict.evidence().collect()} == {"host signature"}


def test_nothing_is_written_unless_all_can_be(spark, sent):
    store, _, path = sent
    asked = spark.createDataFrame([("deed-file-one",), ("deed-file-none",)], "id string")
    assert told(store.export(asked, str(path / "none"))) == [("deed-file-none", "not found"), ("deed-file-one", "exported")]
    assert not (path / "none").exists()


def test_check(spark, sent):
    store, bag, path = sent
    assert told(store.check(bag, {KEY.hex()})) == []
    assert told(store.check(bag, set())) == [("", "signer not accepted")]
    assert told(store.check(bag, set(), allow_unsigned=True)) == []
    tree, n = store.tree()
    start, end, steps = store.bridge(2)
    assert end == (n, store.head().first()["root"]) and store.tree()[0] is tree
    assert told(store.check(bag, {KEY.hex()}, kept=start, joins=(start, end, steps))) == []
    assert told(store.check(bag, {KEY.hex()}, kept=start)) == [("", "head: no bridge")]
    assert told(store.check(bag, {KEY.hex()}, kept=(9, "a"))) == [("", "head: fewer entries than kept")]
    changed = Bag.read(spark, bag)
    changed.links = changed.links.withColumn("successor", F.lit(None).cast("string"))
    changed.records = changed.records.withColumn("folder", F.when(F.col("id") == "deed-file-two", "deed-file-zwei").otherwise(F.col("folder")))
    changed.write(str(path / "changed"))
    assert told(store.check(str(path / "changed"), {KEY.hex()})) == [("", "links changed"), ("deed-file-zwei", "no proof")]


def test_import_twice(spark, sent):
    store, bag, path = sent
    other = Store(spark, str(path / "receiver"), key=b"r" * 32, host=audit.Host((KEY,)))
    assert told(other.import_bag(bag)) == [("", "refused: signer not accepted")]
    assert other.table("deeds").count() == 0
    assert told(other.import_bag(bag, {KEY.hex()})) == [("deed-file-one", "put"), ("deed-file-two", "put")]
    assert [r["id"] for r in other.table("log").orderBy("idx").collect()] == ["deed-file-one", "deed-file-two"]
    assert {r["verdict"] for r in other.evidence().collect()} == {"ok"} and other.audit().count() == 0
    assert other.table("sidecars").count() == 2 and other.table("blobs").count() == 2
    starts = spark.createDataFrame([("deed-file-one",)], "id string")
    assert told(other.current(starts)) == [("deed-file-one", "tip", "deed-file-two")]
    assert told(other.import_bag(bag, {KEY.hex()})) == [("deed-file-one", "same"), ("deed-file-two", "same")]
    assert other.table("log").count() == 2 and other.table("deeds").count() == 2 and other.table("heads").count() == 2
    asked = spark.createDataFrame([(0, "deed-file-one"), (1, "deed-file-two"), (2, "deed-file-x")], "pos long, id string")
    lines = [r["line"] for r in other.current_lines(asked).orderBy("pos").collect()]
    assert lines == ["deed-file-one SUPERSEDED by deed-file-two", "deed-file-two current", "deed-file-x FAILED: not found"]
    walks = other.current(asked.select("id"))
    assert told(lineage.revised_by(walks, asked.select("id")))[:2] == [("deed-file-one", "deed-file-two"), ("deed-file-two", None)]
    assert other.leave(starts).first()["status"] == "ok" and len(other.timestamp_requests(starts).first()["request"]) == 56


def test_a_long_chain(spark):
    """10,000 links, a fork and a cycle beside them."""
    n = 10_000
    edges = spark.range(n).selectExpr("concat('n', id) as a", "concat('n', id + 1) as b")
    edges = edges.unionByName(spark.createDataFrame([("f", "x"), ("f", "n5"), ("c", "d"), ("d", "c"), ("e", "c")], "a string, b string"))
    starts = spark.createDataFrame([("n0",), (f"n{n}",), ("x",), ("alone",)], "id string")
    got = {r["start"]: (r["outcome"], r["ids"]) for r in lineage.current(edges, starts).collect()}
    assert got == {"n0": ("tip", f"n{n}"), f"n{n}": ("tip", f"n{n}"), "x": ("tip", "x"), "alone": ("tip", "alone")}
    small = edges.where("a in ('f', 'c', 'd', 'e')").unionByName(edges.where("a in ('n5')").withColumn("b", F.lit("end")))
    got = {r["start"]: (r["outcome"], r["ids"]) for r in lineage.current(small, spark.createDataFrame([("f",), ("e",)], "id string")).collect()}
    assert got == {"f": ("fork", "end,x"), "e": ("cycle", "c,d")}
