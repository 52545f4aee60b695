"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact reranking.

A table hashes a vector to `hashes` numbers floor((a.x + b) / w), with normal a (2-stable, for Euclidean distance). A
query visits its own bucket of each table and those reached by moving some numbers by one, in the order of how likely
they hold a near vector: the smaller the summed squared distances to the bucket borders crossed, the likelier.

Index rows and probes meet by bucket. Buckets are dealt to parts of bounded size, a large bucket to several, each of
which its probes visit; a part gives each query's nearest rows of its own, so that pairs never leave their task.

Queries whose probes meet fewer rows than asked for (a small table, a query far from all rows) are answered by an exact
scan: blocks of rows against blocks of such queries, each pair of blocks giving its nearest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, settled, table

TABLES, HASHES, PROBES = 8, 10, 200
#: The width w, in standard deviations of the projections of a sample of SAMPLE vectors.
WIDTH, SAMPLE = 2.5, 1000
#: Index rows in a part, about; and in a piece of a bucket.
PART_ROWS, PIECE_ROWS = 16_384, 2_048
#: Buckets of more than one piece that are broadcast, at most; beyond, they are joined by a shuffle.
BIG_BUCKETS = 10_000
#: Queries that one task of the exact scan compares with its PART_ROWS rows, about.
SCAN_QUERIES = 1_024


class Hashes:
    """The tables' projections. Picklable; the same seed gives the same tables everywhere."""

    def __init__(self, sample: np.ndarray, tables: int, hashes: int, width: float, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables, sample.shape[1], hashes))
        spread = float(np.sqrt(np.mean([(sample @ a).std() ** 2 for a in self.a]))) if len(sample) > 1 else 1.0
        self.w = width * (spread or 1.0)
        self.b = rng.uniform(0, self.w, (tables, 1, hashes))
        self.odd = rng.integers(1, 2**63, (tables, hashes), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def places(self, x: np.ndarray) -> np.ndarray:
        """tables x rows x hashes, in widths."""
        return (x @ self.a + self.b) / self.w

    def sums(self, floors: np.ndarray, t: int) -> np.ndarray:
        return (floors.astype(np.int64).view(np.uint64) * self.odd[t]).sum(-1, dtype=np.uint64)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """tables x rows: each vector's bucket."""
        return np.stack([mix(self.sums(np.floor(p), t)) for t, p in enumerate(self.places(x))]).view(np.int64)

    def probes(self, x: np.ndarray, count: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """table, row, buckets to visit, likeliest first."""
        for t, places in enumerate(self.places(x)):
            floors = np.floor(places)
            sums = self.sums(floors, t)
            for row, inside in enumerate(places - floors):
                yield t, row, mix(sums[row] + np.array([self.shift(move, t) for move in moves(inside, count)], np.uint64)).view(np.int64)

    def shift(self, move: tuple[tuple[int, int], ...], t: int) -> int:
        return sum(step * int(self.odd[t, i]) for i, step in move) % 2**64


def moves(inside: np.ndarray, count: int) -> list[tuple[tuple[int, int], ...]]:
    """Sets of (hash, -1 or 1), from none on, by their summed squared distances; inside: places within their buckets."""
    k = len(inside)
    steps = sorted([(float(inside[i]) ** 2, i, -1) for i in range(k)] + [(float(1 - inside[i]) ** 2, i, 1) for i in range(k)])
    out: list[tuple[tuple[int, int], ...]] = [()]
    heap = [(steps[0][0], (0,))]
    while heap and len(out) < count:
        cost, chosen = heapq.heappop(heap)
        if len({steps[j][1] for j in chosen}) == len(chosen):
            out.append(tuple((steps[j][1], steps[j][2]) for j in chosen))
        last = chosen[-1]
        if last + 1 < 2 * k:
            grown = steps[last + 1][0]
            heapq.heappush(heap, (cost - steps[last][0] + grown, (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + grown, (*chosen, last + 1)))
    return out


def usable(embedding: Column) -> Column:
    """Neither null nor zero, all components finite."""
    odd = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~F.coalesce(odd, F.lit(True)) & F.exists(embedding, lambda v: v != 0)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    tables: int = TABLES,
    hashes: int = HASHES,
    probes: int = PROBES,
    width: float = WIDTH,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with is_query the k nearest other rows found, by Euclidean distance.

    Vectors that are null, zero, not finite, or of another length than most take no part, neither do rows with a null
    vec_id. Of rows with the same vec_id one counts, the least vector. Ties go to the smaller vec_id. Each query gets k
    rows, or all others where the table has fewer; an empty table, or one without queries, gives none; other columns are
    ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").alias("x")).where(usable(F.col("x")))
    rows = rows.groupBy("vec_id").agg(F.min("x").alias("x"))
    lengths = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size, total = (lengths["n"], lengths["count"]) if lengths else (1, 0)
    rows = rows.where(F.size("x") == size)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["x"]
    kind = rows.schema["x"].dataType.simpleString()  # vectors move as they are stored, and are widened where they are used
    tool = spark.sparkContext.broadcast(Hashes(np.array(sample.tolist(), float).reshape(-1, size), tables, hashes, width))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                codes = tool.value.codes(np.stack(d["x"]).astype(float))
                yield pd.DataFrame({"vec_id": np.tile(d["vec_id"], tables), "x": [*d["x"]] * tables, "t": np.repeat(np.arange(tables), len(d)), "code": codes.ravel()})

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                ids = d["vec_id"].to_numpy()
                for t, row, codes in tool.value.probes(np.stack(d["x"]).astype(float), probes):
                    yield pd.DataFrame({"query_id": ids[row], "t": t, "code": codes})

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                yield pd.DataFrame({"t": np.repeat(np.arange(tables), len(d)), "code": tool.value.codes(np.stack(d["x"]).astype(float)).ravel()})

    indexed = rows.mapInPandas(index, f"vec_id long, x {kind}, t int, code long")
    sizes = settled(rows.mapInPandas(coded, "t int, code long").groupBy("t", "code").agg(F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("pieces")))
    big = sizes.where("pieces > 1")
    big = F.broadcast(big) if big.count() <= BIG_BUCKETS else big
    parts = max(1, -(-total * tables // PART_ROWS))
    part = F.pmod(F.xxhash64("t", "code", "piece"), F.lit(parts)).alias("part")
    stored = indexed.join(big, ["t", "code"], "left").withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.coalesce("pieces", F.lit(1))).cast("int"))
    stored = stored.select(part, "t", "code", "vec_id", "x")
    queries = rows.where(is_query)
    # A query makes `probes` rows for each table: few of them are work for a task.
    visited = queries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(visits, "query_id long, t int, code long").join(sizes.hint("merge"), ["t", "code"])
    visited = visited.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(part, "query_id", "t", "code").distinct()
    visited = visited.groupBy("part", "query_id").agg(F.collect_list("t").alias("t"), F.collect_list("code").alias("code"))  # a query's probes at most
    visited = visited.join(queries.select(F.col("vec_id").alias("query_id"), F.col("x").alias("q")), "query_id")

    def best(here: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(here) and len(asked):
            x, ids = np.stack(here["x"]).astype(float), here["vec_id"].to_numpy()
            buckets = pd.Series(np.arange(len(here))).groupby([here["t"].to_numpy(), here["code"].to_numpy()]).indices
            for query, ts, codes, q in zip(asked["query_id"], asked["t"], asked["code"], asked["q"], strict=True):
                at = [b for key in zip(ts, codes, strict=True) if (b := buckets.get(key)) is not None]
                if not at:
                    continue
                at = np.concatenate(at)
                at = at[np.unique(ids[at], return_index=True)[1]]
                at = at[ids[at] != query]
                score = np.sqrt(((x[at] - q) ** 2).sum(1))
                order = np.lexsort((ids[at], score))[:k]
                found.append(pd.DataFrame({"query_id": query, "vec_id": ids[at][order], "score": score[order]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    local = stored.groupBy("part").cogroup(visited.groupBy("part")).applyInPandas(best, "query_id long, vec_id long, score double")
    found = settled(_ranked(local.dropDuplicates(["query_id", "vec_id"]), k))
    # The union of the parts' nearest has fewer than k rows only if a query's probes met fewer.
    full = found.where(F.col("rank") == min(k, total - 1)).select(F.col("query_id").alias("vec_id"))
    short = settled(queries.join(full, "vec_id", "left_anti").select(F.col("vec_id").alias("query_id"), F.col("x").alias("q")))
    n = short.count()
    if not n or total < 2:
        return found
    rest = _ranked(scanned(rows, short, k, total, n), k)
    return found.join(short.select("query_id"), "query_id", "left_anti").select(*rest.columns).unionByName(rest)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of each query's first k pairs."""
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scanned(rows: DataFrame, asked: DataFrame, k: int, total: int, n: int) -> DataFrame:
    """query_id, vec_id, score: of each block of rows (vec_id, x; `total` of them) the k nearest to each of the n asked
    (query_id, q), among them the k nearest of all."""
    blocks, chunks = -(-total // PART_ROWS), -(-n // SCAN_QUERIES)
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    here = rows.select("vec_id", "x", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), every(chunks).alias("chunk"))
    there = asked.select("query_id", "q", every(blocks).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk"))

    def best(here: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        if len(here) and len(asked):
            x, ids = np.stack(here["x"]).astype(float), here["vec_id"].to_numpy()
            for query, q in zip(asked["query_id"], asked["q"], strict=True):
                score = np.sqrt(((x - q) ** 2).sum(1))
                score[ids == query] = np.inf
                at = np.flatnonzero(score <= np.partition(score, min(k, len(score)) - 1)[min(k, len(score)) - 1])
                order = at[np.lexsort((ids[at], score[at]))]
                order = order[ids[order] != query][:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[order], "score": score[order]}))
        return pd.concat(out)

    by = ["block", "chunk"]
    return here.groupBy(*by).cogroup(there.groupBy(*by)).applyInPandas(best, "query_id long, vec_id long, score double")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
