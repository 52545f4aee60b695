from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracewright.functions import derive
from tracewright.functions.encoding import KINDS, any_record_bytes, framed
from tracewright.operators.store import Store
from tracewright.plans import corpus
from tracewright.sources.frames import decode

PRODUCER = "struct<agent_id:string,activity_id:string>"
DRAFT = f"pos long, id string, kind string, name string, sources {corpus.TAGGED}, produced_by {PRODUCER}, grants {corpus.TAGGED}, unix_time long, supersedes string"


def draft_files(spark, rows):
    """rows: pos, id, name, content, supersedes"""
    flat = spark.createDataFrame([(p, i, "file", n, [], ("you", None), [], 1_700_000_000, s, c) for p, i, n, c, s in rows], f"{DRAFT}, content string")
    body = corpus.struct_of("file", path=corpus.address(F.col("content")), media_type=F.lit(None).cast("string"))
    whole = F.struct(*[(body if k == "file" else F.lit(None).cast(corpus.BODIES[k])).alias(k) for k in KINDS]).cast(corpus.BODY)
    return flat.withColumn("body", whole).drop("content")


def answers(df):
    return {r["pos"]: (r["status"], r["why"]) for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_known_roots(spark, store):
    """The format's published roots for a log of one and of two records."""
    store.create(draft_files(spark, [(0, None, "the parser patch", "fn main() {}\n", None)]))
    assert store.head().first()["root"] == "b1799b9f22404b3626b3c43e80f26232922113b997a1e3377bc803ff799f4ee8"
    store.create(draft_files(spark, [(0, None, "the notes", "second\n", None)]))
    assert store.head().first().asDict() == {"size": 2, "root": "794e67fe9ec9c80cfd3df9dd6bf5eb62e74c669c06a63693dde7a2b9bd97acc5"}


def test_create_again_changes_nothing(spark, store):
    rows = [(0, None, "One", "1", None), (1, None, "Two", "2", None)]
    assert answers(store.create(draft_files(spark, rows))) == {0: ("created", None), 1: ("created", None)}
    assert answers(store.create(draft_files(spark, rows))) == {0: ("same", None), 1: ("same", None)}
    assert store.table("log").count() == 2
    assert store.audit().count() == 0


def test_refusals(spark, store):
    store.create(draft_files(spark, [(0, None, "One", "1", None), (1, None, "Two", "2", None)]))
    got = answers(
        store.create(
            draft_files(
                spark,
                [
                    (0, None, "One", "other", None),
                    (1, "deed-page-x", "x", "1", None),
                    (2, None, "Three", "3", "deed-file-one"),
                    (3, None, "Four", "4", "deed-file-one"),
                    (4, None, "Five", "5", "deed-file-nothing"),
                    (5, "deed-file-six", "six", "6", "deed-file-six"),
                ],
            )
        )
    )
    assert got[0] == ("refused", "frozen")
    assert got[1] == ("refused", "id is not of its kind")
    assert got[2] == ("created", None)
    assert got[3] == ("refused", "already superseded")
    assert got[4] == ("refused", "supersedes nothing")
    assert got[5] == ("refused", "supersedes itself")
    starts = spark.createDataFrame([("deed-file-one",), ("deed-file-two",)], "id string")
    assert {(r["start"], r["outcome"], r["ids"]) for r in store.current(starts).collect()} == {("deed-file-one", "tip", "deed-file-three"), ("deed-file-two", "tip", "deed-file-two")}


def test_delete_shows_only_in_the_audit(spark, store):
    store.create(draft_files(spark, [(i, None, f"n{i}", str(i), None) for i in range(3)]))
    one = spark.createDataFrame([("deed-file-n1",), ("deed-file-none",)], "id string")
    assert {tuple(r) for r in store.delete(one).collect()} == {("deed-file-n1", "deleted"), ("deed-file-none", "not found")}
    assert {tuple(r) for r in store.delete(one).collect()} == {("deed-file-n1", "tombstoned"), ("deed-file-none", "not found")}
    assert [r["id"] for r in store.list().collect()] == ["deed-file-n0", "deed-file-n2"]
    assert [tuple(r) for r in store.audit().collect()] == [("missing", "deed-file-n1", "tombstoned")]
    assert store.table("log").count() == 3
    assert answers(store.create(draft_files(spark, [(0, None, "n1", "1", None)]))) == {0: ("refused", "frozen: tombstoned")}


def test_evidence(spark, store):
    store.create(draft_files(spark, [(0, None, "good", "g", None), (1, None, "gone", "x", None)]))
    blobs = spark.sql("select sha2('g', 256) as hex, sha2('g', 256) as sha")
    got = {r["id"]: r["verdict"] for r in store.evidence(blobs).collect()}
    assert got["deed-file-good"] == "ok" and got["deed-file-gone"].endswith("absent")


def test_minted_ids(spark):
    names = ["A ! b", "  x__y--z ", "Ünï", "", "---", "a\nb", "Q9"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(derive.mint_id(F.lit("file"), F.col("n")).alias("id"))
    assert [r["id"] for r in rows.collect()] == [f"deed-file-{s}" for s in ("a-b", "x-y-z", "n", "item", "item", "ab", "q9")]


def test_ids_end_where_they_end(spark):
    rows = spark.createDataFrame([("deed-file-a",), ("deed-file-a\n",), ("deed-FILE-a",), ("deed-file-",)], "i string")
    assert [r[0] for r in rows.select(derive.is_id(F.col("i"))).collect()] == [True, False, False, False]


def test_decode_gives_back_every_kind(spark):
    for kind in KINDS:
        records = corpus.MAKERS[kind](spark, "/root/testdata/sf0.001").orderBy("id").limit(20)
        raw = records.select(F.col("id").alias("name"), framed(any_record_bytes((kind,))).alias("raw"))
        back = decode(raw, framed=True)
        assert back.where("fault is not null").count() == 0
        again = back.select("record.*").withColumn("raw", framed(any_record_bytes((kind,)))).select(F.col("id").alias("name"), "raw")
        assert raw.exceptAll(again).count() == 0, kind


def test_decode_refuses_what_is_cut_or_longer(spark):
    records = corpus.files(spark, "/root/testdata/sf0.001").limit(1)
    raw = records.select(F.col("id").alias("name"), any_record_bytes(("file",)).alias("raw"))
    cut = raw.select("name", F.expr("substring(raw, 1, length(raw) - 1)").alias("raw"))
    more = raw.select("name", F.concat("raw", F.lit(b"\0")).alias("raw"))
    assert decode(cut.unionByName(more)).where("fault is null").count() == 0
