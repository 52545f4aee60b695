"""What records lead to, against a walk in plain Python."""

from __future__ import annotations

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from tracewright.operators import lineage


def walk(edges, starts):
    onward = collections.defaultdict(set)
    for a, b in edges:
        onward[a].add(b)
    out = {}
    for s in starts:
        seen, line = {}, collections.deque((b, 1) for b in onward[s])
        while line:
            node, depth = line.popleft()
            if node not in seen:
                seen[node] = depth
                line.extend((b, depth + 1) for b in onward[node])
        out |= {(s, n): d for n, d in seen.items()}
    return out


def graphs():
    r = random.Random(8)
    yield "chain", [(i, i + 1) for i in range(60)], [0, 7, 59, 60]
    yield "circle", [(i, (i + 1) % 12) for i in range(12)], [3]
    yield "circle with tails", [(i, (i + 1) % 9) for i in range(9)] + [(20 + i, 21 + i) for i in range(9)] + [(29, 4), (2, 40), (40, 41), (41, 42)], [20, 0, 41]
    yield "diamonds", [e for i in range(0, 45, 3) for e in ((i, i + 1), (i, i + 2), (i + 1, i + 3), (i + 2, i + 3))], [0, 4]
    yield "short cut found late", [(0, 1), (0, 10), *[(i, i + 1) for i in range(10, 30)], (30, 50), (1, 2), (2, 60), (60, 61), (61, 62), (1, 60), (2, 61), (62, 50), (50, 51), (51, 52)], [0]
    yield "loops", [(0, 0), (0, 1), (1, 1), (1, 2)], [0, 1, 2]
    yield "random", [(r.randrange(40), r.randrange(40)) for _ in range(60)], list(range(0, 40, 3))
    yield "forest", [(i, r.randrange(i)) for i in range(1, 120)], [119, 60, 5]


@pytest.mark.parametrize(("edges", "starts"), [g[1:] for g in graphs()], ids=[g[0] for g in graphs()])
def test_closure(spark, edges, starts):
    rows = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "a string, b string")
    asked = spark.createDataFrame([(str(s),) for s in starts], "id string")
    got = {(int(r["start"]), int(r["node"])): r["depth"] for r in lineage.closure(rows, asked).collect()}
    assert got == walk(edges, starts)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds, settled = 5000, [], lineage.settled
    monkeypatch.setattr(lineage, "settled", lambda df: rounds.append(1) or settled(df))
    edges = spark.range(n).selectExpr("cast(id as string) as a", "cast(id + 1 as string) as b")
    got = {r["node"]: r["depth"] for r in lineage.closure(edges, spark.createDataFrame([("0",)], "id string")).collect()}
    assert got == {str(i): i for i in range(1, n + 1)}
    assert len(rounds) < 40  # two for each doubling, of which there are 13


def plain_current(edges, starts):
    reach = collections.defaultdict(set)
    for s, n in walk(edges, {x for e in edges for x in e} | set(starts)):
        reach[s].add(n)
    onward = {a for a, _ in edges}
    out = {}
    for s in starts:
        met = reach[s] | {s}
        loop, ends = {n for n in met if n in reach[n]}, met - onward
        out[s] = ("cycle" if loop else "fork" if len(ends) > 1 else "tip", ",".join(sorted(loop or ends)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_current(spark, seed):
    """Circles, tails to them, forks before and behind them, loops, several circles behind one fork."""
    r = random.Random(seed)
    edges = [("z", "a"), ("a", "m"), ("m", "a"), ("p", "q"), ("p", "r"), ("q", "s"), ("r", "s"), ("l", "l"), ("k", "l")]
    edges += [(f"x{i}", f"x{(i + 1) % 7}") for i in range(7)] + [(f"t{i}", f"x{i % 3}") for i in range(5)] + [("f", "x1"), ("f", "a"), ("g", "f")]
    edges += [(f"r{r.randrange(25)}", f"r{r.randrange(25)}") for _ in range(22)]
    starts = sorted({x for e in edges for x in e} | {"alone"})
    got = lineage.current(spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame([(s,) for s in starts], "id string"))
    assert {r["start"]: (r["outcome"], r["ids"]) for r in got.collect()} == plain_current(edges, starts)


def test_a_great_circle_is_gone_round_by_doubling(spark, monkeypatch):
    """A circle of 3,000 with a tail at each node: no walk from each start, few rounds, no more rows than nodes."""
    n, rounds, settled = 3000, [], lineage.settled

    def counted(df):
        rounds.append(out := settled(df))
        return out

    monkeypatch.setattr(lineage, "settled", counted)
    monkeypatch.setattr(lineage, "_walked", None)
    edges = spark.range(n).selectExpr("concat('n', id) as a", f"concat('n', (id + 1) % {n}) as b")
    edges = edges.unionByName(spark.range(n).selectExpr("concat('t', id) as a", "concat('n', id) as b"))
    got = lineage.current(edges, edges.select(F.col("a").alias("id"))).select("outcome", F.size(F.split("ids", ",")).alias("n")).groupBy("outcome", "n").count().collect()
    assert [tuple(r) for r in got] == [("cycle", n, 2 * n)]
    assert len(rounds) < 25 and max(df.count() for df in rounds) == 2 * n


def estimated_digits(df):
    """Digits of what Spark takes for df's size in bytes; 0 where it is told in units."""
    told = df._jdf.queryExecution().optimizedPlan().stats().simpleString()
    power = re.search(r"sizeInBytes=[0-9.]+E\+(\d+) B", told)
    return int(power[1]) if power else 0


def followed(edges, monkeypatch):
    """ways() of edges, the rounds that it settled and the digits of their estimates."""
    rounds = []

    def counted(f):
        def run(df):
            rounds.append(out := f(df))
            return out

        return run

    for name in ("settled", "settled_in_files"):
        if hasattr(lineage, name):
            monkeypatch.setattr(lineage, name, counted(getattr(lineage, name)))
    return *lineage.ways(edges), rounds, max(map(estimated_digits, rounds))


def test_many_small_circles_take_as_many_rounds_as_one(spark, monkeypatch):
    """1,000 circles of 1 to 6, a tail of 3 before each: as in one, eight steps go round all of them and one more round says so."""
    edges = [e for c in range(1000) for k in [c % 6 + 1] for e in [*((f"n{c}-{i}", f"n{c}-{(i + 1) % k}") for i in range(k)), (f"a{c}", f"z{c}"), (f"z{c}", f"m{c}"), (f"m{c}", f"n{c}-{k // 2}")]]
    to_tip, to_ring, rounds, _ = followed(spark.createDataFrame(edges, "a string, b string"), monkeypatch)
    circles = {c: {f"n{c}-{i}" for i in range(c % 6 + 1)} for c in range(1000)}
    got = [(r["a"], r["on"], r["ring"]) for r in to_ring.collect()]
    assert to_tip.isEmpty() and len(got) == len(edges)
    assert all(ring == min(circles[c]) and on in circles[c] for a, on, ring in got for c in [int(re.search(r"\d+", a)[0])])
    assert {on for _, on, _ in got} == set().union(*circles.values())
    assert len(rounds) <= 6  # 14 while rounds were as many as all nodes would take in one circle


def test_estimates_of_a_long_way_stay_short(spark, monkeypatch):
    """A chain of 3,000 and a circle of 3,000: twelve rounds, in which an estimate's digits must not double each time."""
    n = 3000
    edges = spark.range(n).selectExpr("concat('n', id) as a", f"concat('n', (id + 1) % {n}) as b").unionByName(spark.range(n).selectExpr("concat('c', id) as a", "concat('c', id + 1) as b"))
    to_tip, to_ring, rounds, most = followed(edges, monkeypatch)
    assert to_tip.where(f"tip = 'c{n}'").count() == n
    assert [tuple(r) for r in to_ring.groupBy("ring").agg(F.count("*"), F.count_distinct("on")).collect()] == [("n0", n, n)]
    assert len(rounds) < 20 and most < 5_000
