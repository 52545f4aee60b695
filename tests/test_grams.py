"""The substring index against a plain scan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_store import draft_files

from tracewright.operators import grams, names
from tracewright.operators.store import Store

#: Letters that differ in length by case, in UTF-8 and beyond the basic plane, a line break and a character that patterns use.
LETTERS = "aAbBcÉéßИи\n. 😀"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    text = lambda n: "".join(r.choices(LETTERS, k=r.randrange(n)))
    return [(f"deed-quote-{i:03d}", [text(40) for _ in range(r.randrange(4))]) for i in range(150)] + [("deed-quote-long", ["ab" * 20_000 + "Éxyz", ""])]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("grams"))
    frame = spark.createDataFrame(rows, "id string, t array<string>").select("id", F.transform("t", F.lower).alias("low"))
    first, second = frame.where("id < 'deed-quote-1'"), frame.where("id >= 'deed-quote-1'")
    number = lambda df, after: df.selectExpr(f"row_number() over (order by id) + {after}L as n", "id", "low").selectExpr("cast(n as long) n", "id", "low")
    k = first.count()
    made = [grams.write(number(df, after), base, f, per_file=20, texts_per_file=10) for f, df, after in (("a", first, 0), ("b", second, k))]  # one bucket in two batches
    return base, made[0][0].unionByName(made[1][0]).cache(), made[0][1].unionByName(made[1][1]).cache()


def lower(spark, texts):
    return [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(F.lower("t")).collect()]


def test_needles_against_scan(spark, rows, index):
    r = random.Random(6)
    needles = ["", "a", "😀", "xyz", "ÉX", ".", "\n", "nowhere", "zzz"] + ["".join(r.choices(LETTERS, k=1 + i % 6)) for i in range(40)]
    pieces = [t for _, ts in rows for t in ts if len(t) > 12]
    needles += [t[j : j + 4 + i % 7] for i, t in enumerate(r.sample(pieces, 25)) for j in (i % 5,)]
    needles = sorted(set(needles))
    every = [t for _, ts in rows for t in ts]
    low = dict(zip(every, lower(spark, every), strict=True))
    want = {(n, i) for n, n_ in zip(needles, lower(spark, needles), strict=True) for i, ts in rows if not n or any(n_ in low[t] for t in ts)}
    asked = spark.createDataFrame([(n,) for n in [*needles, "a", None]], "needle string")
    got = [(x["needle"], x["id"]) for x in grams.matches(spark, *index, asked).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_a_needle_opens_few_files(spark, index):
    base, texts, runs = index
    asked = spark.createDataFrame([("éxyz",)], "needle string")
    keys = spark.createDataFrame([("éxy",), ("xyz",)], "name string")
    assert len(names.files_for(runs, keys)) <= 4 < runs.count() / 8
    found = grams.holders(names.looked_up(spark, base, runs, keys, schema=grams.POSTINGS), asked)
    assert found.count() == 1 and len(names.files_for(texts, found.select(F.col("n").alias("name")))) == 1 < texts.count() / 8


def test_numbers_have_no_gaps(spark):
    """Over many ranges; a record of which all texts are null is numbered like the others."""
    from tracewright.plans import corpus

    body = F.lit(None).cast(corpus.BODY)
    records = spark.range(1000).select(F.format_string("deed-file-%04d", "id").alias("id"), F.when(F.col("id") % 9 > 0, F.lit("Name")).alias("name"), body.alias("body"))
    got = grams.texts_of(records, 7).collect()
    assert sorted(r["n"] for r in got) == list(range(8, 1008)) and sum(r["low"] == ["name"] for r in got) == 888 and {len(r["low"]) for r in got} == {0, 1}
    assert grams.texts_of(records.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_records_without_an_index(spark, monkeypatch, few):
    from tracewright.plans import corpus

    monkeypatch.setattr(grams, "FEW_NEEDLES", few)
    records = spark.createDataFrame([("i1", "Alpha Beta"), ("i2", "beta"), ("i3", None)], "id string, name string").withColumn("body", F.lit(None).cast(corpus.BODY))
    asked = spark.createDataFrame([(n,) for n in ("BETA", "a b", "", "e", None, "gamma")], "needle string")
    want = {("BETA", "i1"), ("BETA", "i2"), ("a b", "i1"), ("", "i1"), ("", "i2"), ("", "i3"), ("e", "i1"), ("e", "i2")}
    got = [(r["needle"], r["id"]) for r in grams.scanned(records, asked).collect()]
    assert len(got) == len(want) and set(got) == want


def test_more_than_one_bucket(spark, tmp_path):
    texts = spark.range(1, 70_001).select(F.col("id").alias("n"), F.format_string("i%d", "id").alias("id"), F.array(F.format_string("common %d", "id")).alias("low"))
    sections = grams.write(texts, str(tmp_path), "g")
    got = grams.matches(spark, str(tmp_path), *sections, spark.createDataFrame([("COMMON 3276",), ("n 70000",)], "needle string"))
    assert {(r["needle"], r["id"]) for r in got.collect()} == {("COMMON 3276", f"i{n}") for n in [3276, *range(32760, 32770)]} | {("n 70000", "i70000")}


def test_store_finds_by_index_and_by_scan(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    draft = lambda i: store.create(draft_files(spark, [(0, f"deed-file-a{i}", f"Report {i}", f"t{i}", None), (1, f"deed-file-b{i}", f"Notes {i}", "s", None)]))
    found = lambda text, **k: sorted(r["id"] for r in store.find(text=text, **k).collect())
    assert found("report") == [] and store.index_texts() == 0
    draft(0)
    assert found("REPORT") == ["deed-file-a0"]  # nothing indexed: a scan
    assert store.index_texts() == 2 and store.index_texts() == 0 and store._uncovered() == ([], False)
    draft(1)
    assert found("report") == ["deed-file-a0", "deed-file-a1"] and found("1") == ["deed-file-a1", "deed-file-b1"]  # one by the index, one by a scan
    assert store.index_texts() == 2 and found("notes 1", kind="file", agent="you") == ["deed-file-b1"] and found("notes", kind="quote") == []
    store.delete(spark.createDataFrame([("deed-file-a0",)], "id string"))
    assert found("report") == ["deed-file-a1"] and len(found("")) == 3
    store.compact("deeds")
    assert store._uncovered()[1] and found("report") == ["deed-file-a1"]
    assert store.index_texts() == 4 and store._uncovered() == ([], False) and found("port 1") == ["deed-file-a1"]
