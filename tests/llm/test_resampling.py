"""Importance resampling against a plain version."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tracewright.llm import resampling

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = "doc_id long, text string, slice int, `rank` string, s int"


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return collections.Counter(zlib.crc32(f.encode()) % 10000 for f in [*w, *map(" ".join, zip(w, w[1:], strict=False))]), len(w)


def plain(rows, target, percent=25, least=20):
    own = [features(t) for _, t in rows]
    s, t = collections.Counter(), collections.Counter()
    for f, _ in own:
        s.update(f)
    for x in target:
        t.update(features(x)[0])
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for (i, _), (f, w) in zip(rows, own, strict=True):
        weight = sum(n * gain(b) for b, n in f.items()) // f.total() if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, w >= least])
    may = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return collections.Counter(tuple(r[:5]) for r in out)


def odd_rows():
    r = random.Random(5)
    vocabulary = ["The", "the", "été", "ÉTÉ", "a-b", "x9", "日本", "end.", "and", "AND", "q\x00q", "~"] + [f"w{i}" for i in range(50)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = [(None, None), (None, text(30)), (1, ""), (2, None), (3, " .,; \n"), (4, "one"), (5, "the end " * 40), (6, text(19)), (7, "w1 " * 20), (7, text(40))]
    rows += [(i, text(r.randint(1, 200))) for i in range(100, 260)]
    rows += [(8, "the end " * 40), (8, "the end " * 40), (-9, text(3000))]
    r.shuffle(rows)
    return rows, [text(50), None, "", "the end of it"]


@pytest.mark.parametrize(("slice_features", "percent"), [(1 << 20, 25), (300, 100)])
def test_resampling(spark, slice_features, percent):
    rows, target = odd_rows()
    docs = spark.createDataFrame([(*x, 1, "a", 2) for x in rows], COLUMNS).repartition(5).cache()
    wanted = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resample(docs, wanted, percent, slice_features=slice_features).collect()
    assert collections.Counter(map(tuple, got)) == plain(rows, target, percent)


def test_no_rows(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert resampling.resample(none, none).collect() == []
    rows = odd_rows()[0][:40]
    got = resampling.resample(spark.createDataFrame([(*x, 1, "a", 2) for x in rows], COLUMNS).coalesce(1), none)
    assert collections.Counter(map(tuple, got.collect())) == plain(rows, [])


def test_long_texts_are_counted_in_stretches(monkeypatch):
    text = "Ab cd, é! " * 5000 + "last"
    want, words = features(text)
    monkeypatch.setattr(resampling, "STRETCH", 1000)
    found, n = resampling.Counter(10000)(text)
    assert dict(zip(found.tolist(), n.tolist(), strict=True)) == dict(want) and n.sum() == 2 * words - 1
    assert not len(resampling.Counter(10000)("." * 5000)[0])
    assert resampling._bytes(255) == 1 and resampling._bytes(256) == 2 and resampling._bytes(70000) == 4


def test_gains_of_the_contract():
    assert resampling.gains(np.array([0.0, 5]), np.array([0.0, 0]), 90000, 0, 10000).tolist() == [math.floor(1000 * math.log(10)), math.floor(1000 * math.log(10 / 6))]


def test_query_and_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = collections.Counter(map(tuple, resampling.op12_resampling(spark, SF).collect()))
    assert got == collections.Counter(db.sql(f"select doc_id, n_features, weight, score, rank from ({resampling.OP12_SQL})").fetchall())
    assert got == plain(db.sql("select doc_id, text from documents").fetchall(), [x for (x,) in db.sql("select text from benchmark").fetchall()])
