"""The name index against a plain scan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_store import draft_files

from tracewright.operators import catalog, names
from tracewright.operators.store import Store

RECORDS = "id string, digest string, paths array<string>"


def address(r) -> str:
    return f"sha256:{r.getrandbits(256):064x}"


@pytest.fixture(scope="module")
def tables(spark):
    """Records of which a third share a product, some without digest or products, a log and tombstones."""
    r = random.Random(4)
    shared, twins = address(r), address(r)
    rows = [(f"deed-file-{i:04d}", None if i % 50 == 7 else twins if i % 40 == 3 else address(r), None if i % 45 == 2 else [shared, shared] if i % 3 == 0 else [address(r)]) for i in range(600)]
    records = spark.createDataFrame(rows, RECORDS)
    log = spark.createDataFrame([(i, d) for i, d, _ in rows if i < "deed-file-0500"] + [("deed-file-0001", twins)], "id string, digest string")
    gone = spark.createDataFrame([("deed-file-0003",), ("deed-file-0163",)], "id string")
    asked = [d for _, d, _ in rows if d] + [p for _, _, ps in rows for p in ps or []] + [shared, twins, address(r), "sha256:1", "deed-file-x", "", None]
    return records, log, gone, spark.createDataFrame(list(enumerate(asked)), "pos long, raw string")


def plain(tables):
    records, log, gone, asked = ([r.asDict() for r in t.collect()] for t in tables)
    gone, said = {r["id"] for r in gone}, {(r["id"], r["digest"]) for r in log}
    live = [r for r in records if r["id"] not in gone]
    out = {}
    for a in asked:
        raw = a["raw"]
        of = [r["id"] for r in live if raw and r["digest"] == raw]
        made = {r["id"] for r in live if raw and raw in (r["paths"] or [])}
        found = max((i for i in of if (i, raw) in said), default=None) or max(of, default=None) or (max(made) if len(made) == 1 else None)
        out[a["pos"]] = raw if raw and raw.startswith("deed-file-") else found
    return out


def test_resolve_by_index_and_by_scan(spark, tables, tmp_path):
    records, log, gone, asked = tables
    sections = names.write(names.of_records(records).unionByName(names.of_log(log)), str(tmp_path), "n", per_file=50)
    named = names.looked_up(spark, str(tmp_path), sections, asked.withColumnRenamed("raw", "name"))
    want = plain(tables)
    assert sum(v is not None for v in want.values()) > 700
    for got in (catalog.resolved(asked, named, gone), catalog.resolve(asked, records, gone, log)):
        assert {r["pos"]: r["id"] for r in got.collect()} == want


def test_a_lookup_opens_few_files(spark, tables, tmp_path):
    records, log, gone, asked = tables
    sections = names.write(names.of_records(records), str(tmp_path), "n", per_file=10).cache()
    assert sections.count() > 120
    for name in (r["name"] for r in names.of_records(records).where("id < 'deed-file-0020'").collect()):
        key = spark.createDataFrame([(name,)], "name string")
        files = names.files_for(sections, key)
        held = sections.where((F.col("low") <= name) & (F.col("high") >= name)).count()
        assert len(files) == held >= 1 and (held <= 2 or records.where(F.array_contains("paths", name)).count() > 10)
        assert names.looked_up(spark, str(tmp_path), sections, key).where(F.col("name") == name).count() == names.of_records(records).where(F.col("name") == name).count()
        if name.endswith("5"):
            break
    assert names.files_for(sections, spark.createDataFrame([("zzz",), (None,)], "name string")) == []


def test_prefixes_by_index_and_by_scan(spark, tables, tmp_path, monkeypatch):
    records, _, gone, _ = tables
    asked = spark.createDataFrame([("deed-file-00",), ("sha256:a",), ("sha256:",), ("",), ("zz",), (None,), ("deed-file-0003",)], "raw string")
    sections = names.write(names.of_records(records), str(tmp_path), "n", per_file=20)
    keys = asked.withColumnRenamed("raw", "name")
    want = sorted(map(str, catalog.prefix_candidates(records, gone, asked).collect()))
    assert sorted(map(str, catalog.candidates(names.looked_up(spark, str(tmp_path), sections, keys, prefix=True), gone, asked).collect())) == want
    assert len(names.files_for(sections, keys.where("name = 'deed-file-00'"), prefix=True)) < sections.count() / 4
    monkeypatch.setattr(names, "SECTIONS_HELD", 3)  # too many to be held: all are read
    assert sorted(map(str, catalog.candidates(names.looked_up(spark, str(tmp_path), sections, keys, prefix=True), gone, asked).collect())) == want


def test_nothing_indexed(spark, tables, tmp_path):
    records, _, gone, asked = tables
    got = catalog.resolved(asked, names.looked_up(spark, str(tmp_path), spark.createDataFrame([], names.SECTIONS), asked.withColumnRenamed("raw", "name")), gone)
    assert got.where("id is not null and raw not like 'deed-%'").isEmpty() and got.count() == asked.count()


def test_store_keeps_the_index(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for i in range(3):
        store.create(draft_files(spark, [(0, f"deed-file-a{i}", "n", f"text {i}", None), (1, f"deed-file-b{i}", "n", "shared", None)]))
    store.delete(spark.createDataFrame([("deed-file-a1",)], "id string"))
    digests = store.table("deeds").select(F.substring("id", 11, 9).alias("k"), F.col("digest").alias("raw"))
    asked = digests.select(F.crc32("k").alias("pos"), "raw").unionByName(spark.createDataFrame([(1, "sha256:" + "0" * 64)], "pos long, raw string"))
    by_scan = lambda: sorted(map(str, catalog.resolve(asked, store.table("deeds"), store.table("tombstones"), store.table("log")).collect()))
    by_index = lambda: sorted(map(str, store.resolve(asked).collect()))
    assert by_index() == by_scan() and len(store._state().folders["names"]) == 3
    store.compact("names")
    assert by_index() == by_scan() and len(store._state().folders["names"]) == len(store._state().folders["sections"]) == 1
    assert store.candidates(spark.createDataFrame([("deed-file-",)], "raw string")).first()["n"] == 5
