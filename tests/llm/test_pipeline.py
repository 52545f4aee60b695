from __future__ import annotations

import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import near_duplicates, pii, quality, repeats
from tracewright.llm.common import settled


def test_stages(spark):
    """Each stage against its operator on what the stage before left."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id")
    columns, labels = docs.columns, spark.read.parquet(f"{sf}/labels.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        at[name] = (docs, docs := settled(stage(spark, docs, sf)))
    before, after = at["quality"]
    assert after.columns == columns
    good = quality.classify(before, labels).where("predicted = 1").select("doc_id")
    assert sorted(map(tuple, good.collect())) == sorted(map(tuple, after.select("doc_id").collect()))
    before, after = at["near_duplicates"]
    classes = near_duplicates.near_duplicates(before)
    want = classes.where((F.col("doc_id") == F.col("component_id")) | (F.col("n_shingles") == 0)).select("doc_id")
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, after.select("doc_id").collect()))
    before, after = at["repeats"]
    kept = {bytes(r["of"]): r["kept"] for r in repeats.remove(before).collect()}
    old = {r["doc_id"]: (r["text"], kept[bytes(r["of"])]) for r in before.select("doc_id", "text", repeats.text_class().alias("of")).collect()}
    for r in after.collect():
        text, new = old[r["doc_id"]]
        assert r["text"] == (text if new is None else new) and r["n_chars"] == len(r["text"])
    before, after = at["personal_data"]
    assert after.columns == columns and after.count() == before.count()
    assert all(not pii.detect(r["text"]) or "[" in r["text"] for r in after.collect())
    before, after = at["packing"]
    assert after.select("doc_id").distinct().count() == before.count()
    assert {r["ids_crc32"] for r in after.where("length = 1").collect()} <= {zlib.crc32((2).to_bytes(4, "little"))}


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
