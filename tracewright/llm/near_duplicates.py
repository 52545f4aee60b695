"""N-gram Jaccard join: documents whose sets of word shingles are similar, found exactly by signature trees.

1. Routing. Sets are ordered by their shingles' hashes. Two sets as similar as asked for share some of their first
   shingles; how many follows from their sizes. Equal texts count once, texts are dealt to parts of bounded size, and a
   part names each of these shingles once, so that a shingle that a third of all texts have is a row from each part.
   Sets that share too few with any others are done. The rest are joined, through the rarer of the shingles they
   share, into groups that no similar pair can straddle; the most shared ones are passages of many unlike texts.
2. Signature trees. A group's sets, large groups in pieces, are the leaves of a tree whose nodes hold the OR of their
   sets' token bitmaps and the range of their sizes. A tree is traversed together with itself or another; a pair of
   nodes goes no further if no pair of sets below it can overlap enough. What is left is compared exactly, but for pairs
   already known to be connected: their component is settled. Pieces are compared with themselves and a few sets of their
   group first; only groups that aren't one component by then have their pieces compared in pairs, so that very many
   near copies of one text meet a bounded number of times.
3. Components of the links found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import WordHasher, arrow_schema, joined_by_class, settled, table, windows
from .repeats import in_parts, text_class, texts_of

WORDS, PERCENT = 5, 80
#: Sets in a piece of a group, and their bytes; two pieces meet in a task.
PIECE, PIECE_BYTES = 4096, 24 << 20
#: Bytes of bitmaps that are compared at once.
BLOCK_BYTES = 4 << 20
PIVOTS = 16
FAN = 8
#: Pairs of nodes that are taken down a level at once; each makes FAN * FAN pairs at most.
PAIRS = 1 << 12
#: One in SPARE of a set's shingles, more or less, must be shared before a set is routed anywhere.
SPARE = 8


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of runs of k words; of the whole text if it has fewer."""
    return np.unique(windows(words, min(k, len(words)))) if len(words) else np.empty(0, np.uint64)


def least_overlap(size: int, percent: int) -> int:
    """What a set of this size must share with any set similar enough."""
    return -(-percent * size // 100)


def spare(size: int) -> int:
    """How many shared first shingles a set of this size is asked for, if its partner is no smaller."""
    return 1 + size // SPARE


def first_shingles(found: np.ndarray, percent: int) -> np.ndarray:
    """Two similar sets x, y share at least min(spare(x), spare(y)) of these: of their common shingles in order, the j-th
    has no more than size - overlap + j before it in either set."""
    return found[: len(found) - least_overlap(len(found), percent) + spare(len(found))]


class Part:
    """The different shingle sets of a part's texts, in the order of their digests, which any run gives them."""

    def __init__(self, rows: pa.Table, k: int) -> None:
        hasher, by_digest = WordHasher(lower=True), {}
        for of, text in texts_of(rows):
            found = shingles(hasher(text), k)
            by_digest.setdefault(hashlib.sha256(found.tobytes()).digest(), (found, []))[1].append(of)
        self.part = rows.column("part")[0].as_py() if len(rows) else 0
        self.sets = [(found, sorted(of)) for _, (found, of) in sorted(by_digest.items())]

    def name(self, i: int) -> int:
        return (self.part << 32) | i


class Tree:
    """Leaves are sets, by size; each level above joins FAN neighbours. Levels are from the leaves up."""

    def __init__(self, sets: list[np.ndarray], bits: int) -> None:
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0])))
        self.order = np.array(order)
        sizes = np.array([len(sets[i]) for i in order])
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, i in enumerate(order):
            at = (sets[i] & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(maps[row], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        # More shingles than bits they set: what a bitmap's overlap may fall short of the sets'.
        slack = sizes - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, slack)]
        while len(maps) > 1:
            cut = np.arange(0, len(maps), FAN)
            maps = np.bitwise_or.reduceat(maps, cut)
            low, high, slack = (f.reduceat(a, cut) for f, a in zip((np.minimum, np.maximum, np.maximum), self.levels[-1][1:], strict=True))
            self.levels.append((maps, low, high, slack))


def _may_match(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether any pair of sets below nodes i of level a and j of level b can be similar enough."""
    (maps_a, low_a, high_a, slack_a), (maps_b, low_b, high_b, slack_b) = a, b
    low, other = low_a[i], low_b[j]
    out = (100 * high_a[i] >= percent * other) & (100 * high_b[j] >= percent * low)
    need = -(-percent * (low + other) // (100 + percent))
    block = max(1, BLOCK_BYTES // maps_a[:1].nbytes)
    for s in range(0, len(i), block):
        at = slice(s, s + block)
        ok = np.flatnonzero(out[at]) + s
        shared = np.bitwise_count(maps_a[i[ok]] & maps_b[j[ok]]).sum(1, dtype=np.int64)
        out[ok] = shared + np.minimum(slack_a[i[ok]], slack_b[j[ok]]) >= need[ok]
    return out


def _candidates(a: Tree, b: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves that may be similar enough, in batches: dual traversal from both roots, depth first by batches."""
    same = a is b
    depth = max(len(a.levels), len(b.levels)) - 1
    level = lambda t, d: t.levels[min(d, len(t.levels) - 1)]
    stack = [(depth, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        d, i, j = stack.pop()
        keep = _may_match(level(a, d), level(b, d), i, j, percent)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if d == 0:
            if same:
                i, j = i[i < j], j[i < j]
            yield i, j
            continue
        grown = []
        for t, nodes in ((a, i), (b, j)):
            below, here = len(level(t, d - 1)[1]), len(level(t, d)[1])
            grown.append((nodes, below) if below == here else (nodes[:, None] * FAN + np.arange(FAN), below))
        (ci, ni), (cj, nj) = ((x if x.ndim == 2 else x[:, None], n) for x, n in grown)
        pi = np.broadcast_to(ci[:, :, None], (len(i), ci.shape[1], cj.shape[1])).reshape(-1)
        pj = np.broadcast_to(cj[:, None, :], (len(i), ci.shape[1], cj.shape[1])).reshape(-1)
        ok = (pi < ni) & (pj < nj) & ((pi <= pj) if same else True)
        pi, pj = pi[ok], pj[ok]
        stack += [(d - 1, pi[s : s + PAIRS], pj[s : s + PAIRS]) for s in range(0, len(pi), PAIRS)]


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Similar pairs (index in left, index in right, or in left without right) that connect all that such pairs connect.

    known: a label for each set, left and right; sets with the same one are connected already.
    """
    every = left + (right or [])
    bits = max(1024, min(1 << 16, 1 << (2 * max(map(len, every)) - 1).bit_length()))
    a = Tree(left, bits)
    b = a if right is None else Tree(right, bits)
    shift = 0 if right is None else len(left)
    root = np.arange(len(every))  # each set's component, by its least member
    if known is not None:
        _, first, which = np.unique(known, return_index=True, return_inverse=True)
        root = first[which]
    out: list[tuple[int, int]] = []
    for i, j in _candidates(a, b, percent):
        i, j = a.order[i], b.order[j] + shift
        while len(i := i[apart := root[i] != root[j]]):
            j = j[apart]
            # One pair for each component of the left side at a time; its outcome may settle many others.
            _, pick = np.unique(root[i], return_index=True)
            rest = np.ones(len(i), bool)
            rest[pick] = False
            for x, y in zip(i[pick].tolist(), j[pick].tolist(), strict=True):
                if root[x] != root[y] and similar(every[x], every[y], percent):
                    out.append((x, y - shift))
                    low, high = sorted((int(root[x]), int(root[y])))
                    root[root == high] = low
            i, j = i[rest], j[rest]
    return out


def classes(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, piece: int = PIECE) -> DataFrame:
    """of (text_class), n_shingles, root (null for a set similar to no other) for each different text of docs; equal
    sets share a root or, without one, their set_name."""
    dealt = in_parts(docs)

    firsts_schema = "hash long, least long, n long"
    firsts_arrow = arrow_schema(firsts_schema)

    def firsts(rows: pa.Table) -> pa.Table:
        """Each hash once for the part: the least set that has it among its first, and how many have."""
        here = Part(rows, k)
        found = [first_shingles(x, percent) for x, _ in here.sets if len(x)]
        names = [here.name(i) for i, (x, _) in enumerate(here.sets) if len(x)]
        if not found:
            return firsts_arrow.empty_table()
        hashes, owner = np.concatenate(found), np.repeat(np.array(names), [len(f) for f in found])
        hashes, at, n = np.unique(hashes, return_index=True, return_counts=True)  # names ascend, so that the first is the least
        return pa.table({"hash": hashes.view(np.int64), "least": owner[at], "n": n}, schema=firsts_arrow)

    by_hash = Window.partitionBy("hash")
    shared = dealt.groupBy("part").applyInArrow(firsts, firsts_schema)
    shared = shared.select("hash", F.shiftright("least", 32).cast("int").alias("part"), F.min("least").over(by_hash).alias("least"), F.sum("n").over(by_hash).alias("n")).where("n > 1")

    sets_schema = "name long, n long, ofs array<binary>, hashes binary, near array<long>"
    sets_arrow = arrow_schema(sets_schema)

    def narrowed(rows: pa.Table, known: pa.Table) -> pa.Table:
        here = Part(rows, k)
        order = np.argsort(known.column("hash").to_numpy().view(np.uint64)) if len(known) else np.empty(0, np.int64)
        hashes = known.column("hash").to_numpy().view(np.uint64)[order] if len(known) else np.empty(0, np.uint64)
        least, sharers = ((known.column(c).to_numpy()[order] if len(known) else np.empty(0, np.int64)) for c in ("least", "n"))
        out: dict[str, list] = {name: [] for name in sets_arrow.names}
        for i, (found, ofs) in enumerate(here.sets):
            near: list[int] = []
            if len(found) and len(hashes):
                first = first_shingles(found, percent)
                at = np.minimum(np.searchsorted(hashes, first), len(hashes) - 1)
                at = at[hashes[at] == first]
                # A similar set shares `need` of these or more. If both leave out the need - 1 that most sets share, in
                # one order for all, the rarest that they share stays: texts aren't joined by a passage that many have.
                need = spare(least_overlap(len(found), percent))
                rarest = at[np.lexsort((at, sharers[at]))][: max(0, len(at) - need + 1)]
                near = np.unique(least[rarest]).tolist()
            for name, value in zip(sets_arrow.names, (here.name(i), len(found), ofs, found.tobytes() if near else None, near), strict=True):
                out[name].append(value)
        return pa.table(out, schema=sets_arrow)

    sets = settled(dealt.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(narrowed, sets_schema))
    near = sets.where("hashes is not null")
    groups = connected_components(near.select(F.col("name").alias("a"), F.explode("near").alias("b")))
    groups = settled(near.select("name", F.octet_length("hashes").alias("bytes")).join(groups.withColumnRenamed("node", "name"), "name"))
    pieces = F.ceil(F.greatest(F.count("*") / piece, F.sum("bytes") / PIECE_BYTES)).cast("int")
    large = groups.groupBy("root").agg(pieces.alias("pieces")).where("pieces > 1")
    groups = groups.join(large, "root", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    own = F.pmod(F.xxhash64("name"), F.col("pieces")).cast("int").alias("own")
    members = settled(near.select("name", "hashes").join(groups.select("name", "root", "pieces", own), "name").withColumn("comp", F.col("name")))
    large = members.where("pieces > 1")
    # Some sets of a large group, as many as PIVOTS in a piece's worth, meet all its pieces.
    pivots = large.where(F.pmod(F.xxhash64("name", F.lit(1)), F.col("pieces") * max(1, piece // PIVOTS)) == 0)
    others = pivots.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).where("own <> other").withColumn("own", F.col("other")).drop("other")
    first = members.unionByName(others)
    edges = settled(_compared(first.select("*", F.col("own").alias("low"), F.col("own").alias("high")), percent))
    found = connected_components(edges)
    if not large.isEmpty():
        now = large.join(found.select(F.col("node").alias("name"), F.col("root").alias("_comp")), "name", "left").withColumn("comp", F.coalesce("_comp", "name")).drop("_comp")
        apart = now.groupBy("root").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("root")
        now = settled(now.join(apart, "root", "left_semi"))
        if not now.isEmpty():
            met = now.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).where("own <> other")
            met = met.select("*", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
            found = connected_components(edges.unionByName(settled(_compared(met, percent))))
    named_sets = sets.select("name", "n", "ofs").join(found.withColumnRenamed("node", "name"), "name", "left")
    return named_sets.select(F.explode("ofs").alias("of"), F.col("n").alias("n_shingles"), F.coalesce("root", "name").alias("root"))


def _compared(members: DataFrame, percent: int) -> DataFrame:
    """a, b: links among sets (root, own, low, high, name, hashes, comp) of the pieces low and high of each group."""
    tasks = max(1, members.count() // 512)
    schema = "a long, b long"
    to = arrow_schema(schema)

    def compare(rows: pa.Table) -> pa.Table:
        """Each group of two pieces, or of one with itself, in turn."""
        by: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*(rows.column(c).to_pylist() for c in ("root", "low", "high")), strict=True)):
            by.setdefault(key, []).append(i)
        names, own, comp, hashes = rows.column("name").to_numpy(), rows.column("own").to_numpy(), rows.column("comp").to_numpy(), rows.column("hashes")
        out: list[tuple[int, int]] = []
        for (_, low, high), at in by.items():
            sides = [[i for i in at if own[i] == low], [] if low == high else [i for i in at if own[i] == high]]
            if not sides[0] or (low != high and not sides[1]):
                continue
            left, right = ([np.frombuffer(hashes[i].as_py(), np.uint64) for i in side] for side in sides)
            other = sides[0] if low == high else sides[1]
            found = links(left, None if low == high else right, percent, comp[sides[0] + sides[1]])
            out += [(names[sides[0][x]], names[other[y]]) for x, y in found]
        return pa.table({"a": [a for a, _ in out], "b": [b for _, b in out]}, schema=to)

    task = F.pmod(F.xxhash64("root", "low", "high"), F.lit(tasks)).alias("task")
    dealt = members.select("root", "own", "low", "high", "name", "hashes", "comp", task)
    return dealt.groupBy("task").applyInArrow(compare, schema)


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, piece: int = PIECE) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    A row's set holds its distinct shingles of k words, ASCII letters in lower case; a text of fewer words has one, all
    of it; without words or with a null text it has none and is linked with nothing. Two rows are linked if at least
    percent of all their shingles are common; component_id is the least doc_id that links reach. Repeated rows and equal
    texts are linked. Rows with a null doc_id belong to their component but don't name it. Other columns are ignored; an
    empty table gives no rows. Shingles are compared by 64-bit hashes of their words' hashes.
    """
    rows = docs.select("doc_id", text_class().alias("of"))
    found = settled(classes(docs, k, percent, piece).join(rows.groupBy("of").agg(F.min("doc_id").alias("least")), "of"))
    named = joined_by_class(found.drop("least"), found.groupBy("root").agg(F.min("least").alias("least")), "root")
    whose = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return joined_by_class(rows, named.drop("root")).select("doc_id", "n_shingles", whose.alias("component_id"))


def without_near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, that with the least doc_id (nulls last), and all rows without shingles.

    Rows whose text is null, empty or blank all stay; of rows repeated whole one does; columns may have any names; an
    empty table stays empty.
    """
    rows = docs.select(F.struct("*").alias("row"), text_class().alias("of"))
    id_ = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("id"))
    least = docs.select("doc_id", text_class().alias("of")).groupBy("of").agg(F.min(id_).alias("m"))
    found = settled(classes(docs, k, percent).join(least, "of"))
    first = F.min(F.struct("m.x", "m.id", "of")).alias("m")
    kept = found.where("n_shingles > 0").groupBy("root").agg(first).select(F.col("m.of").alias("of"), F.col("m.id").alias("id"), F.lit(False).alias("bare"))
    bare = found.where("n_shingles = 0").select("of", F.lit(None).cast("long").alias("id"), F.lit(True).alias("bare"))
    chosen = joined_by_class(rows, kept.unionByName(bare)).where(F.col("bare") | F.col("row.doc_id").eqNullSafe(F.col("id")))
    own = F.when(F.col("bare"), F.monotonically_increasing_id()).otherwise(-1).alias("own")
    return chosen.select("row", "of", own).dropDuplicates(["of", "own"]).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() over all of documents; nulls, short and empty texts, copies and empty tables as there."""
    return near_duplicates(table(spark, sf_dir, "documents"))
