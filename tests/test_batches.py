"""Batch verbs on batches that are larger than the registered queries ask."""

import hashlib

from tracewright.operators import catalog, handover


def test_prefixes_beyond_the_broadcast_bound(spark, monkeypatch):
    ids = [f"deed-{i:05d}" for i in range(1500)]
    monkeypatch.setattr(catalog, "served", lambda records, tombstones: records)
    records = spark.createDataFrame([(i, f"sha256:{i[5:]}", [f"p/{i[5:]}", "p/all"]) for i in ids], "id string, digest string, paths array<string>")
    typed = [*ids, "deed-000", "sha256:0149", "", "none", "x" * 999, None, "deed-000"]
    asked = spark.createDataFrame([(t,) for t in typed], "raw string")
    got = {r["raw"]: (r["n"], r["longer"], r["ids"]) for r in catalog.prefix_candidates(records, None, asked, 2).collect()}
    assert all(got[i] == (1, False, i) for i in ids)
    assert got["deed-000"] == (100, True, "deed-00000,deed-00001") and got["sha256:0149"] == (10, True, "deed-01490,deed-01491")
    assert got[""] == (1500, True, "deed-00000,deed-00001") and got["none"] == got["x" * 999] == got[None] == (0, False, "")


def test_commitment_is_hashed_as_a_stream(spark):
    rows = [(f"d-{i * 7 % 500:03d}é", f"s{i}\n" if i % 2 else None, None, "n\n" if i % 3 else "") for i in range(500)]
    files = spark.createDataFrame(rows, "id string, sources string, supersedes string, successor string").repartition(9)
    framed = lambda name, c: f"{name}\n" + ("-\n" if c is None else f"{len(c.encode())}\n{c}")
    texts = [f"{len(i.encode())}\n{i}{framed('sources', a)}{framed('supersedes', b)}{framed('successor', c)}" for i, a, b, c in sorted(rows)]
    for some, want in ((files, texts), (files.limit(0), [])):
        got = handover.link_commitment(some)
        assert got.collect() == [(hashlib.sha256(("links-v1\0" + "".join(want)).encode()).hexdigest(),)]
        assert "collect_list" not in got._jdf.queryExecution().toString()
