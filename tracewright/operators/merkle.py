"""An append-only log's hash tree (RFC 9162) as tables: leaves, all nodes, heads, inclusion and consistency proofs.

The tree's rule to split at the largest power of two is the same as folding neighbours level by level, an odd last node
going up as it is. So the whole tree is the table nodes(level, idx, hash), and every proof is a join with it: for n
leaves the proofs of all of them are about n log n rows, found in one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import settled

#: Levels folded within one row: a block of 2**BLOCK_BITS leaves is one group.
BLOCK_BITS = 10
EMPTY_ROOT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def material(id_: Column, digest: Column, unix_time: Column) -> Column:
    """What a log line commits to; the time is written as a number."""
    return F.concat_ws("\t", id_, digest, unix_time.cast("long").cast("string"))


def leaf(m: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(b"\0"), m.cast("binary")), 256))


def node(left: Column, right: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(b"\1"), left, right), 256))


def log_of(records: DataFrame) -> DataFrame:
    """idx, id, digest, unix_time: records in order of time and id, numbered from 0 without gaps.

    Rows are sorted by ranges; a range's numbers start after all before it. No task sees more than its range.
    """
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = records.select("id", "digest", "unix_time").repartitionByRange(n, "unix_time", "id").withColumn("_part", F.spark_partition_id())
    parts = settled(parts)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # as many rows as ranges
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("unix_time", "id")) - 1
    return parts.withColumn("_nth", nth).join(F.broadcast(starts), "_part").select((F.col("_start") + F.col("_nth")).alias("idx"), "id", "digest", "unix_time")


def leaves(log: DataFrame) -> DataFrame:
    """idx, hash"""
    return log.select("idx", leaf(material(F.col("id"), F.col("digest"), F.col("unix_time"))).alias("hash"))


def _up(nodes: Column) -> Column:
    """One level up within an aligned block."""
    pairs = F.sequence(F.lit(0), ((F.size(nodes) + 1) / 2).cast("int") - 1)
    return F.transform(pairs, lambda i: F.when(2 * i + 1 < F.size(nodes), node(F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1))).otherwise(F.get(nodes, 2 * i)))


def nodes(leaves_: DataFrame, size: int, block_bits: int = BLOCK_BITS) -> DataFrame:
    """level, idx, hash of all nodes up to the root. One shuffle for every block_bits levels."""
    top = max(0, (size - 1).bit_length())
    out, base, level = leaves_.select(F.lit(0).alias("level"), F.col("idx").cast("long").alias("idx"), "hash"), leaves_, 0
    while level < top:
        bits = min(block_bits, top - level)
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda s: s["hash"])
        block = base.groupBy(F.shiftright("idx", bits).alias("block")).agg(ordered.alias("l0"))
        for i in range(bits):  # a projection each, so that no level is written out twice
            block = block.withColumn(f"l{i + 1}", _up(F.col(f"l{i}")))
        rows = block.select("block", F.posexplode(F.array(*[f"l{i + 1}" for i in range(bits)])).alias("up", "level_nodes"))
        rows = rows.select("block", "up", F.posexplode("level_nodes").alias("at", "hash"))
        made = settled(rows.select((F.lit(level + 1) + F.col("up")).cast("int").alias("level"), (F.expr(f"shiftleft(block, {bits} - 1 - up)") + F.col("at")).alias("idx"), "hash"))
        out = out.unionByName(made)
        level += bits
        base = made.where(F.col("level") == level).select("idx", "hash")
    return out


# A log's nodes that are complete, those over 2**level leaves each, never change again. So a tree that is kept consists of
# them alone, and grows by what new leaves complete; what stands over the last, incomplete stretch follows from at most one
# node a level.


def peaks(size: int) -> list[tuple[int, int]]:
    """(level, idx) of the complete nodes that a log of that size is made of, the largest first."""
    return [(level, (size >> level) - 1) for level in reversed(range(size.bit_length())) if size >> level & 1]


def chosen(tree: DataFrame, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], bytes]:
    """Hashes of a few nodes. The filter reaches the files' statistics, so that only row groups that may hold them are read."""
    if not wanted:
        return {}
    one = lambda at: (F.col("level") == at[0]) & (F.col("idx") == at[1])
    rows = tree.where(reduce(Column.__or__, map(one, wanted))).select("level", "idx", "hash").collect()  # as many as are wanted
    return {(r["level"], r["idx"]): bytes(r["hash"]) for r in rows}


def grown(new_leaves: DataFrame, size: int, more: int, known: dict[tuple[int, int], bytes], block_bits: int = BLOCK_BITS) -> DataFrame:
    """level, idx, hash of the nodes that `more` leaves (idx from `size` on, hash) complete in a log of `size`, leaves included.

    known: the hashes of the old log's peaks(). Nothing else of the old log is read, and no node is hashed that was complete
    before: that is `more` leaves and fewer than more + log2(size) nodes over them. One shuffle for every block_bits levels.
    """
    none = F.array().cast("array<binary>")
    base, level = new_leaves.select(F.col("idx").cast("long").alias("idx"), "hash"), 0
    out = base.select(F.lit(0).alias("level"), "idx", "hash")
    top = (size + more).bit_length() - 1
    while level < top and size + more >> level + 1 > size >> level + 1:
        bits = min(block_bits, top - level)
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda s: s["hash"])
        block = base.groupBy(F.shiftright("idx", bits).alias("block")).agg(ordered.alias("l0"))
        first = F.col("block") == (size >> level) >> bits  # the one that goes on where the old log ended
        for i in range(bits):
            before = (level + i, (size >> level + i) - 1)
            row = F.when(first, F.concat(F.array(F.lit(known[before])), f"l{i}")).otherwise(F.col(f"l{i}")) if size >> level + i & 1 else F.col(f"l{i}")
            block = block.withColumn(f"r{i}", row)  # a projection each, so that no level is written out twice
            block = block.withColumn(f"l{i + 1}", F.coalesce(_pairs(F.col(f"r{i}")), none))
        rows = block.select("block", first.alias("first"), F.posexplode(F.array(*[f"l{i + 1}" for i in range(bits)])).alias("up", "hashes"))
        rows = rows.select("block", "first", "up", F.posexplode("hashes").alias("at", "hash"))
        begin = F.when(F.col("first"), F.call_function("shiftright", F.lit(size >> level), F.col("up") + 1)).otherwise(F.expr(f"shiftleft(block, {bits} - 1 - up)"))
        made = settled(rows.select((F.lit(level + 1) + F.col("up")).cast("int").alias("level"), (begin + F.col("at")).cast("long").alias("idx"), "hash"))
        out = out.unionByName(made)
        level += bits
        base = made.where(F.col("level") == level).select("idx", "hash")
    return out


def _pairs(row: Column) -> Column:
    """The nodes over neighbours; a last one without a neighbour waits for it."""
    places = F.when(F.size(row) > 1, F.sequence(F.lit(0), F.floor(F.size(row) / 2).cast("int") - 1))
    return F.transform(places, lambda j: node(F.get(row, 2 * j), F.get(row, 2 * j + 1)))


def edge(size: int, known: dict[tuple[int, int], bytes]) -> list[tuple[int, int, bytes]]:
    """(level, idx, hash) of the incomplete nodes of a log of that size, one a level at most, from its peaks()."""
    out, held = [], None
    for level in range((size - 1).bit_length() if size > 1 else 0):
        if size >> level & 1:
            peak = known[level, (size >> level) - 1]
            held = peak if held is None else _joined(peak, held)
        if held is not None:
            out.append((level + 1, size >> level + 1, held))
    return out


def whole(complete: DataFrame, size: int) -> DataFrame:
    """level, idx, hash of all nodes of a log of that size, from those that are complete in it: what nodes() makes anew."""
    rows = edge(size, chosen(complete, peaks(size)))
    right = complete.sparkSession.createDataFrame(rows, "level int, idx long, hash binary")
    return complete.select("level", "idx", "hash").unionByName(right)


def head(tree: DataFrame, size: int) -> DataFrame:
    """size, root (hex) of a log of that size."""
    top = max(0, (size - 1).bit_length())
    root = tree.where((F.col("level") == top) & (F.col("idx") == 0)).agg(F.max(F.lower(F.hex("hash"))).alias("root"))
    return root.select(F.lit(size).cast("long").alias("size"), F.coalesce("root", F.lit(EMPTY_ROOT)).alias("root"))


def siblings(idx: DataFrame, size: int) -> DataFrame:
    """idx, level, sibling: the nodes of each leaf's inclusion proof, innermost first."""
    top = max(0, (size - 1).bit_length())
    levels = F.sequence(F.lit(0), F.lit(top - 1)) if top else F.array().cast("array<int>")
    out = idx.select("idx", F.explode(levels).alias("level"))
    at = F.expr("shiftright(idx, level)")
    out = out.withColumn("sibling", at.bitwiseXOR(F.lit(1).cast("long")))
    last = F.expr(f"shiftright(cast({size - 1} as bigint), level)")
    return out.where(F.col("sibling") <= last)


def receipts(log: DataFrame, tree: DataFrame, size: int, root: str) -> DataFrame:
    """id, digest, unix_time, idx, size, root, path for every row of log: an inclusion proof each."""
    steps = siblings(log.select("idx"), size).join(tree.select("level", F.col("idx").alias("sibling"), "hash"), ["level", "sibling"])
    paths = steps.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("level", F.lower(F.hex("hash")).alias("h")))).alias("s"))
    path = F.coalesce(F.transform("s", lambda s: s["h"]), F.array().cast("array<string>"))
    return log.join(paths, "idx", "left").select("id", "digest", "unix_time", "idx", F.lit(size).cast("long").alias("size"), F.lit(root).alias("root"), path.alias("path"))


def _up_by(n: Column, levels: Column) -> Column:
    return F.call_function("shiftright", n, levels)


def proof_levels(idx: Column, size: Column) -> Column:
    """The levels at which a leaf's way up has a sibling, innermost first: those of siblings()."""
    last = size.cast("long") - 1
    beside = lambda level: _up_by(idx.cast("long"), level).bitwiseXOR(F.lit(1).cast("long"))
    every = F.sequence(F.lit(0), F.lit(62))
    return F.filter(every, lambda level: (_up_by(last, level) > 0) & (beside(level) <= _up_by(last, level)))


def included(idx: Column, size: Column, leaf_hash: Column, path: Column, root: Column) -> Column:
    """Whether a path leads from a leaf to the root: one step for each of its proof_levels(), at the side its index says."""
    levels = proof_levels(idx, size)
    steps = F.zip_with(levels, path, lambda level, p: F.struct(level.alias("level"), F.unhex(p).alias("other")))
    right = lambda level: _up_by(idx.cast("long"), level).bitwiseAND(F.lit(1).cast("long")) == 1
    top = F.aggregate(steps, leaf_hash, lambda h, s: F.when(right(s["level"]), node(s["other"], h)).otherwise(node(h, s["other"])))
    fits = (idx >= 0) & (idx < size) & (F.size(levels) == F.size(path)) & F.forall(path, lambda p: F.length(p) == 64)
    return F.coalesce(fits & (F.lower(F.hex(top)) == root), F.lit(False))


def consistency_nodes(old: int, new: int) -> list[tuple[int, int]]:
    """(level, idx) of the nodes that prove a log of `old` entries a prefix of one of `new`; at most twice the levels.

    The old log's last complete subtree, unless it is all of it, and what stands beside the way from there to the top.
    """
    if not 0 < old < new:
        return []
    base = (old & -old).bit_length() - 1
    out = [(base, (old >> base) - 1)] if old >> base > 1 else []
    for level in range(base, (new - 1).bit_length()):
        beside = (old - 1 >> level) ^ 1
        if beside <= new - 1 >> level:
            out.append((level, beside))
    return out


def consistency(spark: SparkSession, tree: DataFrame, old: int, new: int) -> DataFrame:
    """pos, level, idx, hash (hex): the proof's steps in order."""
    wanted = spark.createDataFrame([(i, lv, ix) for i, (lv, ix) in enumerate(consistency_nodes(old, new))], "pos int, level int, idx long")
    return tree.join(F.broadcast(wanted), ["level", "idx"]).select("pos", "level", "idx", F.lower(F.hex("hash")).alias("hash"))


def _joined(left: bytes, right: bytes) -> bytes:
    import hashlib

    return hashlib.sha256(b"\1" + left + right).digest()


def _root_of(size: int, known: dict[tuple[int, int], bytes], level: int, idx: int) -> bytes | None:
    """The hash of a node of a log of that size, from those of nodes below it; None if they don't make it up."""
    if (level, idx) in known or not level:
        return known.get((level, idx))
    left = _root_of(size, known, level - 1, 2 * idx)
    if 2 * idx + 1 << level - 1 >= size:
        return left
    right = _root_of(size, known, level - 1, 2 * idx + 1)
    return None if left is None or right is None else _joined(left, right)


def consistent(old: int, old_root: str, new: int, new_root: str, path: list[str]) -> bool:
    """Whether a consistency proof joins two heads: whether both roots follow from the nodes that consistency_nodes() names."""
    if old == new:
        return not path and old_root == new_root
    wanted = consistency_nodes(old, new)
    if not 0 < old < new or len(path) != len(wanted):
        return False
    known = {at: bytes.fromhex(p) for at, p in zip(wanted, path, strict=True)}
    if old & old - 1 == 0:  # a complete tree is its own last complete subtree
        known[old.bit_length() - 1, 0] = bytes.fromhex(old_root)
    roots = (_root_of(n, known, (n - 1).bit_length(), 0) for n in (old, new))
    return [r.hex() if r else None for r in roots] == [old_root, new_root]


def bridge(spark: SparkSession, tree: DataFrame, old: int, new: int) -> tuple[tuple[int, str], tuple[int, str], list[str]]:
    """Two heads of a log and the proof that joins them, from the tree of the larger one.

    The old head is put together from nodes that the tree has, at most one for each level; nothing is hashed anew.
    """
    if not 0 < old <= new:
        raise ValueError(f"no log of {old} entries before one of {new}")
    asked, tops = consistency_nodes(old, new), peaks(old)
    found = chosen(tree, sorted({*tops, *asked}))  # two steps a level
    was = found[tops[-1]]
    for peak in reversed(tops[:-1]):
        was = _joined(found[peak], was)
    return (old, was.hex()), (new, head(tree, new).first()["root"]), [found[n].hex() for n in asked]


def consistency_steps(old: Column, new: Column) -> Column:
    """consistency_nodes() as an array of (level, idx); null unless 0 < old < new."""
    base = F.bit_count(old.bitwiseAND(-old) - 1).cast("int")  # how many levels the last complete subtree has
    at = lambda level, idx: F.struct(level.cast("int").alias("level"), idx.cast("long").alias("idx"))
    beside = lambda level: _up_by(old - 1, level).bitwiseXOR(F.lit(1).cast("long"))
    over = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda level: (level >= base) & (_up_by(new - 1, level) > 0) & (beside(level) <= _up_by(new - 1, level)))
    own = F.when(_up_by(old, base) > 1, F.array(at(base, _up_by(old, base) - 1))).otherwise(F.array().cast("array<struct<level:int,idx:bigint>>"))
    return F.when((old > 0) & (old < new), F.concat(own, F.transform(over, lambda level: at(level, beside(level)))))


def prefix_proven(old: Column, old_root: Column, new: Column, new_root: Column, path: Column) -> Column:
    """consistent() for rows: whether both heads follow from a proof's nodes, folded upwards.

    A node to the left of the way up from the old log's last entry is part of both logs, one to its right of the new one.
    """
    old, new = old.cast("long"), new.cast("long")
    steps = F.zip_with(consistency_steps(old, new), path, lambda at, h: F.struct(at["level"].alias("level"), F.unhex(h).alias("hash")))
    complete = old.bitwiseAND(old - 1) == 0  # then the old root stands for its own last subtree
    begin = F.when(complete, F.unhex(old_root)).otherwise(F.get(steps, F.lit(0))["hash"])
    rest = F.when(complete, steps).otherwise(F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))))
    left = lambda level: _up_by(old - 1, level).bitwiseAND(F.lit(1).cast("long")) == 1
    both = lambda at, s: F.struct(node(s["hash"], at["was"]).alias("was"), node(s["hash"], at["now"]).alias("now"))
    one = lambda at, s: F.struct(at["was"].alias("was"), node(at["now"], s["hash"]).alias("now"))
    ends = F.aggregate(rest, F.struct(begin.alias("was"), begin.alias("now")), lambda at, s: F.when(left(s["level"]), both(at, s)).otherwise(one(at, s)))
    fits = (F.size(path) == F.size(consistency_steps(old, new))) & F.forall(path, lambda h: F.length(h) == 64)
    proven = fits & (F.lower(F.hex(ends["was"])) == old_root) & (F.lower(F.hex(ends["now"])) == new_root)
    return F.coalesce(F.when(old == new, (F.size(path) == 0) & (old_root == new_root)).otherwise(proven), F.lit(False))


def bridges(olds: DataFrame, tree: DataFrame, size: int) -> DataFrame:
    """old, path (hex): the consistency proof from each size in olds (column old) to the log's, all by one join with its nodes."""
    each = olds.select("old", F.posexplode(consistency_steps(F.col("old").cast("long"), F.lit(size).cast("long"))).alias("pos", "at"))
    found = each.select("old", "pos", "at.level", "at.idx").join(tree.select("level", "idx", "hash"), ["level", "idx"])
    paths = found.groupBy("old").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.lower(F.hex("hash")).alias("h")))), lambda s: s["h"]).alias("path"))
    return olds.select("old").join(paths, "old", "left").select("old", F.coalesce("path", F.array().cast("array<string>")).alias("path"))


def every_head(leaves_: DataFrame, tree: DataFrame, size: int) -> DataFrame:
    """old, root (hex) of the log at each of its sizes: the complete nodes that it was made of then, by one join, folded."""
    olds = leaves_.select((F.col("idx") + 1).cast("long").alias("old"))
    own = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda level: _up_by(F.col("old"), level).bitwiseAND(F.lit(1).cast("long")) == 1)
    each = olds.select("old", F.explode(own).alias("level")).withColumn("idx", F.expr("shiftright(old, level) - 1"))
    parts = each.join(tree.where(F.col("level") <= size.bit_length()).select("level", "idx", "hash"), ["level", "idx"]).groupBy("old").agg(F.array_sort(F.collect_list(F.struct("level", "hash"))).alias("p"))
    top = F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.get("p", F.lit(0))["hash"], lambda h, s: node(s["hash"], h))
    return parts.select("old", F.lower(F.hex(top)).alias("root"))


#: A head seen before, the head shown now, and the bridge that came with it, if any (then its heads and path).
HEADS = "kept_size long, kept_root string, size long, root string, from_size long, from_root string, to_size long, to_root string, path array<string>"


def head_change(rows: DataFrame) -> DataFrame:
    """rows (HEADS and more) with change: same, grown, or why the head isn't the kept one grown."""
    is_head = lambda size, root, at: (F.col(size) == F.col(f"{at}size")) & (F.col(root) == F.col(f"{at}root"))
    unbridged = F.col("from_size").isNull()
    why = (
        F.when(F.col("size") < F.col("kept_size"), "fewer entries than kept")
        .when(unbridged & is_head("size", "root", "kept_"), "same")
        .when(unbridged, "no bridge")
        .when(~is_head("from_size", "from_root", "kept_"), "bridge from another head")
        .when(~is_head("to_size", "to_root", ""), "bridge to another head")
        .when(~prefix_proven(F.col("kept_size"), F.col("kept_root"), F.col("size"), F.col("root"), F.col("path")), "not a prefix")
        .otherwise(F.when(F.col("size") == F.col("kept_size"), "same").otherwise("grown"))
    )
    return rows.withColumn("change", why)
