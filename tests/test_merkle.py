from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tracewright.operators import merkle
from tracewright.sources.texts import Policy, bridge_text, kept_head, read_bridge, read_receipts, receipt_text
from tracewright.streaming.log_tail import Frontier, appender


def h(b):
    return hashlib.sha256(b).digest()


def split(n):
    k = 1
    while 2 * k < n:
        k *= 2
    return k


def root(leaves):
    if not leaves:
        return h(b"")
    if len(leaves) == 1:
        return leaves[0]
    k = split(len(leaves))
    return h(b"\1" + root(leaves[:k]) + root(leaves[k:]))


def inclusion(i, leaves):
    if len(leaves) < 2:
        return []
    k = split(len(leaves))
    return [*inclusion(i, leaves[:k]), root(leaves[k:])] if i < k else [*inclusion(i - k, leaves[k:]), root(leaves[:k])]


def subproof(m, leaves, whole=True):
    if m == len(leaves):
        return [] if whole else [root(leaves)]
    k = split(len(leaves))
    return [*subproof(m, leaves[:k], whole), root(leaves[k:])] if m <= k else [*subproof(m - k, leaves[k:], False), root(leaves[:k])]


def log_of(spark, n):
    return spark.createDataFrame([(i, f"r{i}", f"sha256:{i}", 100 + i) for i in range(n)], "idx long, id string, digest string, unix_time long")


def leaves_of(n):
    return [h(b"\0" + f"r{i}\tsha256:{i}\t{100 + i}".encode()) for i in range(n)]


LEAF = merkle.leaf


def leaf_column(time=0):
    return merkle.leaf(merkle.material(F.col("id"), F.col("digest"), F.col("unix_time") + time))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 33])
def test_proofs(spark, n):
    log, leaves = log_of(spark, n), leaves_of(n)
    tree = merkle.nodes(merkle.leaves(log), n, block_bits=3).cache()
    assert merkle.head(tree, n).first()["root"] == root(leaves).hex()
    r = merkle.receipts(log, tree, n, root(leaves).hex())
    args = (F.col("idx"), F.col("size"))
    good = merkle.included(*args, leaf_column(), F.col("path"), F.col("root"))
    late = merkle.included(*args, leaf_column(1), F.col("path"), F.col("root"))
    more = merkle.included(*args, leaf_column(), F.concat("path", F.array(F.lit("0" * 64))), F.col("root"))
    for x in r.select("idx", "path", good.alias("good"), late.alias("late"), more.alias("more")).collect():
        assert x["path"] == [p.hex() for p in inclusion(x["idx"], leaves)]
        assert (x["good"], x["late"], x["more"]) == (True, False, False)
    by_place = {(x["level"], x["idx"]): bytes(x["hash"]).hex() for x in tree.collect()}
    for m in range(1, n):
        path = [by_place[p] for p in merkle.consistency_nodes(m, n)]
        assert path == [p.hex() for p in subproof(m, leaves)]
        old = root(leaves[:m]).hex()
        assert merkle.consistent(m, old, n, root(leaves).hex(), path)
        assert not merkle.consistent(m, "0" * 64, n, root(leaves).hex(), path)
        for i in range(len(path)):
            assert not merkle.consistent(m, old, n, root(leaves).hex(), [*path[:i], "f" * 64, *path[i + 1 :]])


def test_receipts_as_text(spark):
    log = log_of(spark, 5)
    tree = merkle.nodes(merkle.leaves(log), 5)
    r = merkle.receipts(log, tree, 5, root(leaves_of(5)).hex())
    back = read_receipts(receipt_text(r))
    assert back.where("fault is not null").count() == 0
    assert r.exceptAll(back.drop("fault")).count() == 0
    bad = receipt_text(r).select(F.concat("text", F.lit("more=1\n")).alias("text")).unionByName(receipt_text(r).select(F.regexp_replace("text", "size=.*\n", "").alias("text")))
    assert read_receipts(bad).where("fault is null").count() == 0


def test_small_texts():
    ends = ((3, "a" * 64), (5, "b" * 64), ["c" * 64])
    assert read_bridge(bridge_text(*ends)) == ends
    assert kept_head(f"size=1 root={'0' * 64}\nsize=2 root={'1' * 64}") == (2, "1" * 64)
    with pytest.raises(ValueError):
        kept_head(bridge_text(*ends))
    assert Policy.read(f"# none\nattestation=required\nsigner={'0' * 64} # one\nother=1").required
    with pytest.raises(ValueError):
        Policy.read("signer=A")


def test_streamed_log_has_the_same_head(spark, tmp_path):
    told, frontier = [], Frontier()
    append = appender(str(tmp_path / "log"), frontier, lambda *x: told.append(x))
    log = log_of(spark, 23).select("id", "digest", "unix_time")
    (tmp_path / "in").mkdir()
    for i, (a, b) in enumerate([(0, 1), (1, 8), (8, 13), (13, 23)]):
        log.where(f"unix_time >= {100 + a} and unix_time < {100 + b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(append).trigger(availableNow=True).start()
        q.awaitTermination()
        assert told[-1][1:] == (b, root(leaves_of(b)).hex())
    assert sorted(r["idx"] for r in spark.read.parquet(str(tmp_path / "log")).collect()) == list(range(23))


@pytest.mark.parametrize("sizes", [(0, 1, 1, 3, 8, 21), (7, 1, 9), (16, 16), (5, 40), (1, 63, 1)])
def test_a_tree_grows_by_what_new_leaves_complete(spark, sizes):
    log, kept, n, hashed = log_of(spark, sum(sizes)), None, 0, 0
    for more in sizes:
        if not more:
            continue
        new = merkle.leaves(log.where((F.col("idx") >= n) & (F.col("idx") < n + more)))
        known = merkle.chosen(kept, merkle.peaks(n)) if kept is not None else {}
        made = merkle.grown(new, n, more, known, block_bits=2)
        rows = made.collect()
        assert len(rows) <= 2 * more + max(1, n).bit_length()  # leaves and the nodes that they complete: nothing twice
        kept = spark.createDataFrame(rows, made.schema) if kept is None else kept.unionByName(spark.createDataFrame(rows, made.schema))
        n, hashed = n + more, hashed + len(rows)
        assert len(merkle.peaks(n)) == bin(n).count("1")
        got = {(r["level"], r["idx"]): bytes(r["hash"]) for r in merkle.whole(kept, n).collect()}
        anew = merkle.nodes(merkle.leaves(log.where(F.col("idx") < n)), n).collect()
        assert got == {(r["level"], r["idx"]): bytes(r["hash"]) for r in anew}
        assert got[(n - 1).bit_length(), 0] == root(leaves_of(n))
    assert hashed == sum(n >> level for level in range(n.bit_length()))


def test_consistency_of_many_heads(spark):
    """Every pair of sizes by columns, as one pair on the driver says; a changed node or root is never proven."""
    n = 37
    roots = [root(leaves_of(i)).hex() for i in range(n + 1)]
    pairs = [(m, k) for k in range(1, n + 1) for m in range(1, k + 1)]
    paths = {(m, k): [x.hex() for x in subproof(m, leaves_of(k))] for m, k in pairs}
    rows = [(m, roots[m], k, roots[k], paths[m, k], True) for m, k in pairs]
    rows += [(m, roots[m], k, roots[k], [*paths[m, k][:i], "f" * 64, *paths[m, k][i + 1 :]], False) for m, k in pairs[::5] for i in range(len(paths[m, k]))]
    rows += [(m, roots[m - 1], k, roots[k], paths[m, k], False) for m, k in pairs[::3]] + [(m, roots[m], k, roots[k - 1], paths[m, k], False) for m, k in pairs[::4]]
    rows += [(0, roots[0], 5, roots[5], [], False), (5, roots[5], 3, roots[3], [], False), (3, roots[3], 7, roots[7], None, False), (3, roots[3], 7, roots[7], [*paths[3, 7], roots[1]], False), (3, roots[3], 7, roots[7], ["x" * 64] * len(paths[3, 7]), False)]
    df = spark.createDataFrame(rows, "old long, was string, new long, now string, path array<string>, good boolean")
    got = df.withColumn("proven", merkle.prefix_proven(F.col("old"), F.col("was"), F.col("new"), F.col("now"), F.col("path")))
    assert got.where("proven <> good").collect() == []
    for m, k in ((1, 2), (3, 7), (8, 16), (21, 37)):
        one = df.limit(1).select(F.transform(merkle.consistency_steps(F.lit(m).cast("long"), F.lit(k).cast("long")), lambda s: F.concat_ws(",", s["level"], s["idx"])).alias("s")).first()["s"]
        assert one == [f"{a},{b}" for a, b in merkle.consistency_nodes(m, k)]
    tree = merkle.nodes(merkle.leaves(log_of(spark, n)), n)
    made = {r["old"]: r["path"] for r in merkle.bridges(spark.range(1, n + 1).withColumnRenamed("id", "old"), tree, n).collect()}
    assert made == {m: paths[m, n] for m in range(1, n + 1)}


def test_head_changes(spark):
    r, p = [root(leaves_of(i)).hex() for i in range(9)], [x.hex() for x in subproof(3, leaves_of(8))]
    cases = {
        "grown": (3, r[3], 8, r[8], 3, r[3], 8, r[8], p), "same": (8, r[8], 8, r[8], None, None, None, None, None), "no bridge": (3, r[3], 8, r[8], None, None, None, None, None),
        "fewer entries than kept": (8, r[8], 3, r[3], 3, r[3], 8, r[8], p), "bridge from another head": (3, r[3], 8, r[8], 2, r[2], 8, r[8], p), "bridge to another head": (3, r[3], 8, r[8], 3, r[3], 7, r[7], p),
        "not a prefix": (3, r[3], 8, r[8], 3, r[3], 8, r[8], p[::-1]),
    }
    rows = spark.createDataFrame([(*v, k) for k, v in cases.items()], f"{merkle.HEADS}, want string")
    assert merkle.head_change(rows).where("change <> want").collect() == []
