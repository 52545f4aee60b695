"""Transitive queries: everything a record came from, and what now stands in its place."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import settled, settled_in_files

#: Every so many rounds of doubling the estimate of size begins again.
AFRESH = 4


def source_edges(records: DataFrame) -> DataFrame:
    """a, b: record a names record b as a source. Paths and urls aren't edges."""
    sources = F.explode(F.filter("sources", lambda s: s["tag"] == "deed"))
    return records.select(F.col("id").alias("a"), sources.alias("s")).select("a", F.col("s.value").alias("b")).distinct()


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node, depth: what edges (a, b) lead to from each start (column id), one step at least, with the fewest steps.

    Ways without a choice are laid out first (chains()): of a chain that a start reaches it reaches the whole rest, by one
    join. So a round is a branching, not a step; rows that a start has with as few steps before are dropped, so that cycles
    end and paths that meet again are not walked twice. A start that comes to a node by a shorter way later goes on from it
    again, which ends, as steps only become fewer. Each round is settled.
    """
    edges = settled(edges.select("a", "b").distinct())
    chain = chains(edges)
    on = chain.select(F.col("node").alias("_node"), "chain", "at")
    along = chain.select("chain", F.col("at").alias("_at"), F.col("node").alias("_next"))

    def spread(rows: DataFrame) -> DataFrame:
        """rows (start, node, depth) and what lies behind them on their chains, each pair with its fewest steps."""
        there = rows.join(on, F.col("node") == F.col("_node"), "left")
        # Of several places on one chain only those matter that are no further along with more steps than another.
        behind = there.where("chain is not null").groupBy("start", "chain").agg(F.collect_list(F.struct("at", "depth")).alias("ways"))
        far = behind.join(along, "chain").withColumn("depth", F.aggregate("ways", F.lit(None).cast("int"), lambda m, w: F.when(w["at"] < F.col("_at"), F.least(m, w["depth"] + F.col("_at") - w["at"])).otherwise(m)))
        return rows.unionByName(far.where("depth is not null").select("start", F.col("_next").alias("node"), "depth")).groupBy("start", "node").agg(F.min("depth").cast("int").alias("depth"))

    first = starts.select(F.col("id").alias("start")).distinct().join(edges, F.col("start") == F.col("a")).select("start", F.col("b").alias("node"), F.lit(1).alias("depth"))
    found = frontier = settled(spread(first))
    # Beyond a chain only its ends and the nodes with a choice lead on.
    within = chain.join(chain.select("chain", (F.col("at") - 1).alias("at")), ["chain", "at"], "left_semi").select(F.col("node").alias("a"))
    onward = settled(edges.join(within, "a", "left_anti"))
    while True:
        steps = frontier.join(onward, F.col("node") == F.col("a")).groupBy("start", F.col("b").alias("node")).agg((F.min("depth") + 1).alias("depth"))
        known = found.select("start", "node", F.col("depth").alias("_known"))
        better = lambda rows, known=known: rows.join(known, ["start", "node"], "left").where("_known is null or depth < _known").drop("_known")
        frontier = settled(better(spread(better(steps))))
        if frontier.isEmpty():
            return found
        found = settled(found.unionByName(frontier).groupBy("start", "node").agg(F.min("depth").alias("depth")))


def chains(edges: DataFrame) -> DataFrame:
    """node, chain, at: stretches of nodes of which each leads to the next one only, and is all that leads there.

    chain is the stretch's first node, at the place on it, from 0. Found by pointer doubling: every round doubles what a row
    spans. Stretches that close to a circle, and nodes on no stretch, have no rows.
    """
    one = edges.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1").select("a", "b")
    sole = edges.groupBy("b").agg(F.count("*").alias("n")).where("n = 1").select("b")
    links = settled(one.join(sole, "b", "left_semi").where("a <> b").select(F.col("b").alias("node"), F.col("a").alias("back")))
    heads = links.select(F.col("back").alias("node")).join(links.select("node"), "node", "left_anti")
    known = settled(heads.select("node", F.col("node").alias("chain"), F.lit(0).alias("at")))
    jump = links.withColumn("by", F.lit(1))
    for _ in range(links.count().bit_length() + 1):
        # Nodes whose jump lands on a known one are known; the others jump on from where they land.
        landed = jump.join(known.withColumnRenamed("node", "back"), "back")
        now = settled(landed.select("node", "chain", (F.col("at") + F.col("by")).cast("int").alias("at")))
        if now.isEmpty():
            break
        known = known.unionByName(now)
        rest = settled(jump.join(now.select("node"), "node", "left_anti"))
        onto = rest.select(F.col("node").alias("back"), F.col("back").alias("_back"), F.col("by").alias("_by"))
        further = F.coalesce("_back", "back").alias("back"), (F.col("by") + F.coalesce("_by", F.lit(0))).alias("by")
        jump = rest.join(onto, "back", "left").select("node", *further)
    return known


def trail(records: DataFrame, tombstones: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node, depth, status: each start itself (depth 0) and all it came from, once; ok, missing or tombstoned."""
    walked = closure(source_edges(records), starts)
    own = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("depth"))
    every = own.unionByName(walked.where("start <> node"))
    there = records.select(F.col("id").alias("node"), F.lit(True).alias("_there"))
    gone = tombstones.select(F.col("id").alias("node"), F.lit(True).alias("_gone")).distinct()
    status = F.when(F.col("_gone"), "tombstoned").when(F.col("_there"), "ok").otherwise("missing")
    return every.join(there, "node", "left").join(gone, "node", "left").select("start", "node", "depth", status.alias("status"))


def trail_status(trail_: DataFrame) -> DataFrame:
    """start, reached, status: a trail fails if anything on it is missing or tombstoned."""
    bad = F.min(F.when(F.col("status") != "ok", F.concat("status", F.lit(" "), "node")))
    return trail_.groupBy("start").agg(F.count("*").alias("reached"), F.coalesce(bad, F.lit("ok")).alias("status"))


def successor_edges(live: DataFrame, supersedes: DataFrame, successor: DataFrame | None = None) -> DataFrame:
    """a, b: b, a live record, stands in a's place, as either side says."""
    said = supersedes.select(F.col("prior").alias("a"), F.col("new").alias("b"))
    if successor is not None:
        said = said.unionByName(successor.select(F.col("prior").alias("a"), F.col("next").alias("b")))
    return said.distinct().join(live.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")


def ways(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where nodes lead whose way on has no choice, that is each node on it has one edge, up to an end or a circle.

    First a, tip: those that come to an end. Then a, on, ring: those that come to a circle, with a node on it and its least
    node. Every round doubles the steps that a row spans, so that a chain or circle of n takes about log2 n rounds, and no
    round has a row a pair. A circle has been gone round once the least node that its least node has passed is itself; then
    so have all its nodes, as their rows span as many steps, and all that passed that node stay where they landed. Rows that
    land on such a row later follow it. So rounds are as many as the longest way takes, not as all nodes would in one
    circle. Nodes on the way to a fork have no row.
    """
    edges = edges.select("a", "b").distinct()
    single = edges.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1").select("a", "b")
    ends = edges.select(F.col("b").alias("e")).distinct().join(edges.select(F.col("a").alias("e")).distinct(), "e", "left_anti")
    # ends: true where b is an end, false where it is on the circle of least, null on the way.
    jump = settled(single.join(ends.select(F.col("e").alias("b"), F.lit(True).alias("ends")), "b", "left").select("a", "b", F.col("b").alias("least"), "ends"))
    for turn in itertools.count(1):
        open_ = jump.where("ends is null")
        if open_.isEmpty():
            break
        rings = open_.where("a = least").select("least", F.lit(True).alias("_ring"))
        on = jump.select(F.col("a").alias("b"), F.col("b").alias("_b"), F.col("least").alias("_least"), F.col("ends").alias("_ends"))
        least = F.when(F.col("_ring"), F.col("least")).when(~F.col("_ends"), F.col("_least")).otherwise(F.least("least", "_least"))
        moved = open_.drop("ends").join(rings, "least", "left").join(on, "b")
        moved = moved.select("a", F.when(F.col("_ring"), F.col("b")).otherwise(F.col("_b")).alias("b"), least.alias("least"), F.when(F.col("_ring"), False).otherwise(F.col("_ends")).alias("ends"))
        jump = (settled if turn % AFRESH else settled_in_files)(jump.where("ends is not null").unionByName(moved))
    return jump.where("ends").select("a", F.col("b").alias("tip")), jump.where("not ends").select("a", F.col("b").alias("on"), F.col("least").alias("ring"))


def current(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, outcome, ids: where superseding leads from each start: tip (one record), fork (several) or cycle.

    A cycle on the way outweighs tips. Its ids are all reachable records that lead back to themselves. Starts that lead to
    one tip or one cycle without a choice, nearly all, are answered by ways(), and a cycle's ids are put together once;
    only the others' ways are walked.
    """
    edges = settled(edges.select("a", "b").distinct())
    every = starts.select(F.col("id").alias("start")).distinct()
    to_tip, to_ring = ways(edges)
    found = to_tip.select(F.col("a").alias("start"), "tip", F.lit(None).cast("string").alias("ring")).unionByName(to_ring.select(F.col("a").alias("start"), F.lit(None).cast("string").alias("tip"), F.col("ring").cast("string").alias("ring")))
    straight = settled(every.join(found, "start", "left").join(edges.select(F.col("a").alias("start"), F.lit(True).alias("_on")).distinct(), "start", "left"))
    plain = straight.where("ring is null and (tip is not null or _on is null)").select("start", F.lit("tip").alias("outcome"), F.coalesce("tip", "start").alias("ids"))
    # All nodes of a circle are landed on: to jump along it maps it onto itself.
    members = to_ring.select("on", "ring").distinct().groupBy("ring").agg(F.array_join(F.array_sort(F.collect_list("on")), ",").alias("ids"))
    plain = plain.unionByName(straight.where("ring is not null").select("start", "ring").join(members, "ring").select("start", F.lit("cycle").alias("outcome"), "ids"))
    rest = settled(straight.where("tip is null and ring is null and _on").select(F.col("start").alias("id")))
    if rest.isEmpty():
        return plain
    return plain.unionByName(_walked(edges, rest))


def _walked(edges: DataFrame, starts: DataFrame) -> DataFrame:
    reach = settled(closure(edges, starts).select("start", "node"))
    every = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).unionByName(reach).distinct()
    ends = every.join(edges.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
    met = every.select("node").distinct()
    near = settled(edges.join(met.withColumnRenamed("node", "a"), "a", "left_semi"))
    nodes = near.select(F.col("a").alias("id")).join(near.select(F.col("b").alias("id")), "id", "left_semi").distinct()
    looped = closure(near, nodes).where("start = node").select("node")
    ids = lambda df, name: df.groupBy("start").agg(F.array_sort(F.collect_set("node")).alias(name))
    out = starts.select(F.col("id").alias("start")).join(ids(ends, "_tips"), "start", "left")
    out = out.join(ids(every.join(looped, "node", "left_semi"), "_loop"), "start", "left")
    outcome = F.when(F.col("_loop").isNotNull(), "cycle").when(F.size("_tips") > 1, "fork").otherwise("tip")
    return out.select("start", outcome.alias("outcome"), F.array_join(F.coalesce("_loop", "_tips"), ",").alias("ids"))


def current_summary(walks: DataFrame) -> DataFrame:
    """current, n: how many starts are current: those that lead nowhere else. Forks and cycles count as such, too."""
    still = (F.col("outcome") != "tip") | (F.col("ids") == F.col("start"))
    return walks.agg(F.count_if(still).alias("current"), F.count("*").alias("n"))


def current_lines(walks: DataFrame, asked: DataFrame, live: DataFrame) -> DataFrame:
    """pos, id, line of asked ids: current, SUPERSEDED by what, a fork's or cycle's ids, or FAILED for one that isn't served."""
    there = live.select("id", F.lit(True).alias("_there"))
    rows = asked.select("pos", "id").join(there, "id", "left").join(walks.withColumnRenamed("start", "id"), "id", "left")
    line = (
        F.when(F.col("_there").isNull(), F.concat("id", F.lit(" FAILED: not found")))
        .when(F.col("outcome") != "tip", F.concat("id", F.lit(" "), "outcome", F.lit(" "), "ids"))
        .when(F.col("ids") == F.col("id"), F.concat("id", F.lit(" current")))
        .otherwise(F.concat("id", F.lit(" SUPERSEDED by "), "ids"))
    )
    return rows.select("pos", "id", line.alias("line"))


def revised_by(walks: DataFrame, frozen: DataFrame) -> DataFrame:
    """id, revised_by: for frozen records (id) that others stand in for, the ids they lead to now; null where there is none."""
    rows = frozen.select("id").distinct().join(walks.withColumnRenamed("start", "id"), "id", "left")
    return rows.select("id", F.when((F.col("outcome") != "tip") | (F.col("ids") != F.col("id")), F.col("ids")).alias("revised_by"))


def source_digests(trail_: DataFrame, records: DataFrame) -> DataFrame:
    """start, node, digest of all that a record came from, itself not."""
    return trail_.where("depth > 0").select("start", "node").join(records.select(F.col("id").alias("node"), "digest"), "node").select("start", "node", "digest")
