"""Connected components of an edge table."""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that a task folds at a time.
BLOCK = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The session's folder within the cluster's shared checkpoint folder, where a lost executor takes nothing with it.

    That folder is spark.checkpoint.dir's. Only a session on one machine (tests, a laptop) may do without: it gets one
    of its own.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not where:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, where, True)
        sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in shared_folder()."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def settled_in_files(df: DataFrame) -> DataFrame:
    """df, computed once and kept as files in shared_folder(), whose sizes Spark goes on with.

    What settled() returns goes on with its plan's estimate of size, and a join's estimate is the product of its sides'. Where
    rows are joined with themselves round by round, the digits of that number multiply each time: after two dozen rounds
    they don't fit into a driver's memory.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """node, least node of its component, for all nodes but the least ones."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(i):
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        apart = low != high
        i, j = i[apart], j[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to the same components, block by block: stars around their least nodes."""
    held: list[pa.RecordBatch] = []

    def fold() -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(a, b)], ["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= BLOCK:
            yield fold()
            held = []
    if held:
        yield fold()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: for every node of an undirected edge table, the same root for all nodes of its component.

    Nodes are longs. The graph is contracted: each task folds the edges that it has to stars, then a round maps a node
    to the foremost of itself and its neighbours, renames the edges and drops loops and repeats. By turns foremost is by
    id, which folds a star at once, and by a hash, which halves any path. Minima are summed up before the shuffle, so a
    hub with very many neighbours is one row from each task.
    """

    def fold(e: DataFrame) -> DataFrame:
        return settled(e.mapInArrow(_folded, "a long, b long").distinct())

    edges = fold(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b"))
    out: DataFrame | None = None
    for turn in itertools.count():
        if edges.isEmpty():
            break
        rank = _rank(turn)
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("v"))).alias("m"))
        own = F.struct(rank("a").alias("r"), F.col("a").alias("v"))
        step = settled(best.select(F.col("a").alias("node"), F.least(F.col("m"), own)["v"].alias("to")))
        moved = edges.join(step, edges["a"] == step["node"]).select(F.col("to").alias("a"), "b")
        moved = moved.join(step, moved["b"] == step["node"]).select("a", F.col("to").alias("b")).where("a <> b")
        edges = fold(moved)
        later = step.select(F.col("node").alias("_n"), F.col("to").alias("_to"))
        if out is None:
            out = step.select("node", F.col("to").alias("root"))
        else:
            out = settled(out.join(later, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_to", "root").alias("root")))
    if out is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return out


def _rank(turn: int):
    def rank(name: str) -> Column:
        return F.xxhash64(F.col(name), F.lit(turn)) if turn % 2 else F.lit(0).cast("long")

    return rank
