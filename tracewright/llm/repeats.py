"""Substring dedup: words in passages that occur more than once are removed, wherever they occur.

A window is a run of WINDOW words. Texts, equal ones once, are dealt to parts of bounded size, and rounds go over the
same parts:

1. candidates. Of the ANCHOR-word phrases within a window, the one with the least hash is its anchor, a choice that equal
   windows make alike, so that a window can only recur if its anchor does. Parts count their anchors; Spark adds up.
2. phrases. One part, the first that has it, spells out the words of an anchor that recurs; Spark sends them to all
   parts that have counted it.
3. automata. A part compiles the phrases that it was sent, by their words, to an Aho-Corasick automaton: the shard of all
   phrases that its texts can hold. All its texts are streamed through it, and it alone tells where phrases are. Windows
   around what it locates are named by 128 bits and counted; Spark adds up.
4. removal. Of the windows around what the automata located those go whose passage was confirmed to occur elsewhere.

So a window goes if its anchor has been located by its words and the whole of it has been met again. Between rounds only
rows (name, part, count) and phrases move; each part names a thing once, so that a passage that a third of all texts have
is a row from each part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHasher, arrow_schema, joined_by_class, mix, settled, settled_as_dealt, swept, table, windows

WINDOW, ANCHOR = 35, 12
#: Bytes of text in a part, about.
PART_BYTES = 4 << 20
COUNTS = "a long, b long, part int, n long, at long"
LOCATED = "part int, of binary, starts binary, names binary"
RUNS = "part int, of binary, runs binary"
KEPT = "of binary, n_words long, n_removed long, kept_sha256 string, kept string"


def text_class() -> F.Column:
    """Equal texts' common name."""
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose first column this task hasn't seen lately, texts compressed. Spares the shuffle most copies; parts drop the rest."""
    seen: set[bytes] = set()
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        first = [i for i, c in enumerate(batch.column(0).to_pylist()) if c not in seen and not seen.add(c)]
        some = batch.take(pa.array(first, pa.int64()))
        packed = [pack(t.as_py().encode()) for t in some.column(1)]
        yield pa.RecordBatch.from_arrays([some.column(0), pa.array(packed, pa.binary())], ["of", "packed"])
        if len(seen) > 200_000:
            seen.clear()


def in_parts(docs: DataFrame) -> DataFrame:
    """of, packed, part: different texts, compressed, dealt to parts of about PART_BYTES of text. A text may come more than
    once, in one part."""
    named = docs.select(text_class().alias("of"), F.coalesce("text", F.lit("")).alias("text"))
    size = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_parts = max(1, -(-size // PART_BYTES))
    once = named.mapInArrow(_once, "of binary, packed binary")
    return once.withColumn("part", F.pmod(F.xxhash64("of"), F.lit(n_parts)).cast("int")).repartition(n_parts, "part")


def texts_of(rows: pa.Table) -> list[tuple[bytes, bytes]]:
    """A part's different texts with their names, in the same order in any run."""
    seen: dict[bytes, bytes] = {}
    unpack = zstandard.ZstdDecompressor().decompress
    for of, packed in zip(rows.column("of"), rows.column("packed"), strict=True):
        if (name := of.as_py()) not in seen:
            seen[name] = unpack(packed.as_py())
    return sorted(seen.items())


def _slide(x: np.ndarray, k: int, best: np.ufunc) -> np.ndarray:
    """best (minimum or maximum) of each k consecutive values."""
    width = 1
    while 2 * width <= k:
        x = best(x[:-width], x[width:])
        width *= 2
    return best(x[: len(x) - (k - width)], x[k - width :]) if width < k else x


def anchors(phrases: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """Places of phrases (by their hashes) that are the least of some window."""
    k = window - anchor + 1
    if len(phrases) < k:
        return np.empty(0, np.int64)
    least = _slide(phrases, k, np.minimum)
    pad = np.zeros(k - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate((pad, least, pad)), k, np.maximum) == phrases)


def names(words: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
    """128-bit names of the runs of k words that start at `at` (ascending), as two rows: two sums with weights of their own.

    They are made of 64-bit hashes of the words, so that two words that collide make equal names.
    """
    low = int(at[0]) if len(at) else 0
    dense = len(at) > 0 and 3 * len(at) > int(at[-1]) - low  # then all runs between are as cheap
    n = int(at[-1]) - low + 1 if dense else len(at)
    out, part = np.zeros((2, n), np.uint64), np.empty(n, np.uint64)
    weights = [0x2545F4914F6CDD1D, 0x9E6C63D0676A9A99]
    for i in range(k):
        run = words[low + i : low + i + n] if dense else words.take(at + i)
        for row in (0, 1):
            np.multiply(run, np.uint64(weights[row]), out=part)
            out[row] += part
            weights[row] = (weights[row] * 0x5851F42D4C957F2D + 2) & (2**64 - 1)
    return mix(out.take(at - low, 1) if dense else out)


class Names:
    """A set of 128-bit names."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        order = np.argsort(a, kind="stable")
        self.a, self.b = a[order], b[order]
        begins = np.flatnonzero(np.concatenate(([True], self.a[1:] != self.a[:-1]))) if len(a) else np.empty(0, np.int64)
        self.most = int(np.diff(np.append(begins, len(a))).max(initial=0))  # names that share their first number

    def has(self, found: np.ndarray) -> np.ndarray:
        out = np.zeros(found.shape[1], bool)
        at = np.searchsorted(self.a, found[0])
        for step in range(self.most):
            i = np.minimum(at + step, len(self.a) - 1)
            out |= (self.a[i] == found[0]) & (self.b[i] == found[1])
        return out


def _counted(found: list[np.ndarray], places: list[np.ndarray], part: int, schema: pa.Schema) -> pa.Table:
    """Each different name once, with its count and the first of its places."""
    a, b = np.concatenate([*found, np.empty((2, 0), np.uint64)], 1)
    at = np.concatenate([*places, np.empty(0, np.int64)])
    order = np.lexsort((at, b, a))
    a, b, at = a[order], b[order], at[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(a)))
    return pa.table({"a": a[first].view(np.int64), "b": b[first].view(np.int64), "part": np.full(len(first), part, np.int32), "n": n, "at": at[first]}, schema=schema)


def in_runs(starts: np.ndarray, width: int) -> np.ndarray:
    """What stretches of that width at ascending starts cover, as runs [begin, end)."""
    cut = np.flatnonzero(np.diff(starts) > width)
    begins, ends = starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))] + width
    return np.stack((begins, ends), 1).astype("<u4")


class Shard:
    """An automaton of phrases of `anchor` words. Each word is a letter. Two words may share one if there are more words
    than letters; what is found then is compared word by word."""

    LETTERS = 0x100000

    def __init__(self, phrases: list[bytes], anchor: int) -> None:
        self.anchor, self.letters = anchor, {}
        self.automaton = ahocorasick.Automaton()
        for phrase in phrases:
            words = phrase.split()
            for w in words:
                self.letters.setdefault(w, chr(0xE000 + len(self.letters) % self.LETTERS))
            self.automaton.add_word("".join(map(self.letters.__getitem__, words)), phrase)
        self.exact = len(self.letters) <= self.LETTERS
        if len(self.automaton):
            self.automaton.make_automaton()

    def places(self, words: list[bytes]) -> np.ndarray:
        """Where phrases begin."""
        if not len(self.automaton) or len(words) < self.anchor:
            return np.empty(0, np.int64)
        spelled = "".join([self.letters.get(w, "\0") for w in words])
        first = 1 - self.anchor
        found = self.automaton.iter(spelled)
        if self.exact:
            return np.fromiter((end + first for end, _ in found), np.int64)
        return np.array([end + first for end, phrase in found if b" ".join(words[end + first : end + 1]) == phrase], np.int64)

    def around(self, words: list[bytes], window: int) -> np.ndarray:
        """Starts of windows that hold a located phrase."""
        n = len(words) - window + 1
        if n < 1 or not len(places := self.places(words)):
            return np.empty(0, np.int64)
        at = np.zeros(n + 1, np.int64)
        np.add.at(at, np.clip(places - (window - self.anchor), 0, n), 1)
        np.add.at(at, np.minimum(places + 1, n), -1)
        return np.flatnonzero(np.cumsum(at[:-1]) > 0)


def remove(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """of (text_class), n_words, n_removed, kept_sha256, kept for each different text of docs.

    A word is removed if a window of `window` words covers it whose words also start anywhere else, in another row of
    docs or the same. kept: the other words, joined by single spaces; null if none is removed, or without with_text.
    A null or empty text has no words; shorter texts than a window keep all; a row of docs is a document of its own also
    if doc_id is null or repeated; other columns are ignored; an empty table gives no rows. Of a window that goes the
    anchor was located word by word, and all of it was named by 128 bits, of 64-bit word hashes.
    """
    dealt = settled_as_dealt(in_parts(docs))  # the rounds below don't send the texts again
    swept(docs.sparkSession)
    copies = docs.select(text_class().alias("of")).groupBy("of").agg((F.count("*") > 1).alias("copied"))
    kept_schema, counts_schema, located_schema, runs_schema = map(arrow_schema, (KEPT, COUNTS, LOCATED, RUNS))
    phrase_schema = arrow_schema("a long, b long, phrase binary")

    def count_anchors(rows: pa.Table) -> pa.Table:
        hasher, found, places = WordHasher(lower=False), [], []
        for i, (_, text) in enumerate(texts_of(rows)):
            words = hasher(text)
            at = anchors(windows(words, anchor), window, anchor)
            if len(at):
                found.append(names(words, anchor, at))
                places.append(at | (i << 32))
        return _counted(found, places, rows.column("part")[0].as_py(), counts_schema)

    def spell(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        """The words of the phrases that begin at the wanted places."""
        texts, phrases = texts_of(rows) if len(wanted) else [], []
        wanted = wanted.sort_by("at")
        held, words = -1, []
        for place in wanted.column("at").to_pylist():
            if place >> 32 != held:
                held = place >> 32
                words = texts[held][1].split()
            begin = place & 0xFFFFFFFF
            phrases.append(b" ".join(words[begin : begin + anchor]))
        return pa.table({"a": wanted.column("a"), "b": wanted.column("b"), "phrase": pa.array(phrases, pa.binary())}, schema=phrase_schema)

    def locate(rows: pa.Table, sent: pa.Table) -> pa.Table:
        """For each text in which the shard locates phrases: the windows around them, and their names."""
        if not len(rows) or not len(sent):
            return located_schema.empty_table()
        shard, hasher = Shard(sent.column("phrase").to_pylist(), anchor), WordHasher(lower=False)
        out: dict[str, list] = {name: [] for name in located_schema.names}
        for of, text in texts_of(rows):
            starts = shard.around(text.split(), window)
            if len(starts):
                made = (sent.column("part")[0].as_py(), of, in_runs(starts, 1).tobytes(), names(hasher(text), window, starts).tobytes())
                for name, value in zip(located_schema.names, made, strict=True):
                    out[name].append(value)
        return pa.table(out, schema=located_schema)

    def count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(0).to_numpy()
            for part in np.unique(parts).tolist():
                found = [np.frombuffer(x.as_py(), np.uint64).reshape(2, -1) for x, p in zip(batch.column(1), parts, strict=True) if p == part]
                yield from _counted(found, [np.zeros(f.shape[1], np.int64) for f in found], part, counts_schema).to_batches()

    def confirm(found: pa.Table, known: pa.Table) -> pa.Table:
        """For each text the words that go, as runs [begin, end) of places."""
        recurring = Names(*(known.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))) if len(known) and len(found) else None
        out: dict[str, list] = {name: [] for name in runs_schema.names}
        for row in zip(*(found.column(c) for c in ("part", "of", "starts", "names")), strict=True) if recurring else ():
            part, of, starts, named = (x.as_py() for x in row)
            starts = np.concatenate([np.arange(a, b) for a, b in np.frombuffer(starts, "<u4").reshape(-1, 2).tolist()])
            starts = starts[recurring.has(np.frombuffer(named, np.uint64).reshape(2, -1))]
            if len(starts):
                for name, value in zip(runs_schema.names, (part, of, in_runs(starts, window).tobytes()), strict=True):
                    out[name].append(value)
        return pa.table(out, schema=runs_schema)

    def take_out(rows: pa.Table, going: pa.Table) -> pa.Table:
        runs_of = dict(zip(going.column("of").to_pylist(), going.column("runs").to_pylist(), strict=True)) if len(going) else {}
        out: dict[str, list] = {name: [] for name in kept_schema.names}
        for of, text in texts_of(rows) if len(rows) else ():
            words, left, removed, last = text.split(), [], 0, 0
            for begin, end in np.frombuffer(runs_of.get(of, b""), "<u4").reshape(-1, 2).tolist():
                left += words[last:begin]
                removed, last = removed + end - begin, end
            kept = b" ".join(left + words[last:]) if removed else b" ".join(words)
            for name, made in zip(kept_schema.names, (of, len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode() if removed and with_text else None), strict=True):
                out[name].append(made)
        return pa.table(out, schema=kept_schema)

    def recurring(counts: DataFrame) -> DataFrame:
        """Names that occur twice or more in all parts together, for each part that has them; first: which part is the first."""
        by = Window.partitionBy("a", "b")
        return counts.withColumn("all", F.sum("n").over(by)).withColumn("first", F.min("part").over(by)).where("all > 1").select("a", "b", "part", "first", "at")

    by_part = dealt.groupBy("part")
    candidates = settled(recurring(by_part.applyInArrow(count_anchors, COUNTS)))
    swept(docs.sparkSession)
    owned = candidates.where("part = first").select("part", "a", "b", "at")
    spelled = by_part.cogroup(owned.groupBy("part")).applyInArrow(spell, "a long, b long, phrase binary")
    phrases = candidates.select("a", "b", "part").join(spelled.hint("shuffle_hash"), ["a", "b"]).select("part", "phrase")
    located = settled(by_part.cogroup(phrases.groupBy("part")).applyInArrow(locate, LOCATED))
    swept(docs.sparkSession)
    again = recurring(located.select("part", "names").mapInArrow(count_windows, COUNTS)).select("part", "a", "b")
    going = located.groupBy("part").cogroup(again.groupBy("part")).applyInArrow(confirm, RUNS)
    single = by_part.cogroup(going.groupBy("part")).applyInArrow(take_out, KEPT)
    # Of a text with copies every window recurs.
    whole = F.col("copied") & (F.col("n_words") >= window)
    nothing = hashlib.sha256(b"").hexdigest()
    return single.join(copies, "of").select(
        "of",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, nothing).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(whole & F.lit(with_text), "").otherwise(F.col("kept")).alias("kept"),
    )


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated passages taken out of text, all rows and columns kept; texts that have none stay as they are.

    As remove() has it: null and short texts stay, all of a longer text with copies goes, columns may have any names,
    n_chars follows the text where it is there, and an empty table stays empty.
    """
    found = remove(docs, window).select("of", "kept")
    out = joined_by_class(docs.select(F.struct("*").alias("row"), text_class().alias("of")), found)
    new = {"text": F.coalesce("kept", "row.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("kept").isNotNull(), F.length("kept")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove() over all of documents, a row for each; nulls, copies and empty tables as there."""
    docs = table(spark, sf_dir, "documents")
    found = remove(docs, with_text=False).select("of", "n_words", "n_removed", "kept_sha256")
    return joined_by_class(docs.select("doc_id", text_class().alias("of")), found).drop("of")
