"""Packing token sequences into fixed windows, planned on the histogram of lengths.

The plan is made from the histogram alone, which has at most `window` bins however many documents there are:

1. combinations of at most three piece lengths (with repeats) that fill the window exactly are enumerated;
2. non-negative least squares finds how often to use each so that the lengths used match the histogram;
3. the counts are rounded down to what the histogram still holds;
4. what is left is packed greedily, largest piece that fits first, again by whole groups of equal windows.

Every step of the plan is a pattern (lengths and repeats) with a count, so that the pieces find their places by their
rank among pieces of equal length: a join with a table of at most a few times `window` rows.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from copy import copy
from functools import cached_property, lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import over_texts, settled, table, tokenizer_path

WINDOW = 4096
END_ID = 2
#: Rows of the plan's table that are broadcast, at most; a longer one, of some more bytes than that, is joined by a shuffle.
FEW_PLACES = 1 << 18
#: Words kept with their ids in each task, up to twice as many.
CACHED_WORDS = 150_000
#: Fixed values of the vocabulary's format: its parts of words, the characters that show bytes, and what ends a part.
PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in VISIBLE} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(VISIBLE)))}
SUFFIX = "</w>"
PLAIN_LINES = regex.compile(r"[\n\x21-\x7e\xa1-\xff]*")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Plain BPE: join the neighbours of lowest rank, leftmost first, until none can be."""
    while len(symbols) > 1:
        rank, at = min((ranks.get(pair, len(ranks)), i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)))
        if rank == len(ranks):
            break
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols


class WordIds:
    """The ids of texts, word by word; a word's are little-endian unsigned 32-bit integers.

    The vocabulary drops white space and never joins across it, so that a text's ids are those of its words in turn, and
    words are kept. New words of Latin-1 characters are cut into the vocabulary's parts together and go through a second
    BPE engine, much faster than the first: it joins what spells a token, in the order of ranks, where the first joins
    listed pairs. That is the same if each token's own spelling leads to it, as can be seen from a border that is never
    joined across: between two borders both engines do what they do to that stretch alone. Tokens that don't lead to
    themselves can't come out of the first engine, and are left out of the second. A part's end is a byte of its own,
    joined before all else to the byte before it. Any other word the first engine encodes.
    """

    END, BREAK = "\x01", "\n"

    def __init__(self, path: str, size: int = CACHED_WORDS) -> None:
        import tiktoken

        self.path, self.size, self.known, self.older = path, size, {}, {}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = self.END.encode()
        spelled = lambda token: bytes(map(BYTE_OF.__getitem__, token.removesuffix(SUFFIX))) + (end if token.endswith(SUFFIX) else b"")
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        by_pair = {pair: i for i, pair in enumerate(pairs)}
        ranks = {bytes([b]): b for b in range(256)}
        ranks |= {bytes([b]) + end: 256 + b for b in range(256) if b != end[0]}
        for (left, right), rank in by_pair.items():
            token = left + right
            symbols = list(token.removesuffix(SUFFIX))
            if token.endswith(SUFFIX):
                symbols[-1] += SUFFIX
            if merged(symbols, by_pair) == [token]:
                ranks.setdefault(spelled(token), 512 + rank)
        self.engine = tiktoken.Encoding("words", pat_str=f"[^{self.END}{self.BREAK}]+{self.END}|{self.BREAK}", mergeable_ranks=ranks, special_tokens={})
        ids = {spelled(token): i for token, i in model["vocab"].items()}
        self.ids = np.zeros(512 + len(pairs), "<u4")
        for token, rank in ranks.items():
            self.ids[rank] = ids.get(token, 0)

    @cached_property
    def tokenizer(self):
        """The first engine, loaded when a word asks for it."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. The words of about the last `size` to twice as many are kept."""
        words = [t.split() for t in texts]
        self.learn(set().union(*words) - self.known.keys())
        out = [b"".join(map(self.known.__getitem__, w)) for w in words]
        if len(self.known) > self.size:
            self.known, self.older = {}, self.known
        return out

    def learn(self, words: set[bytes]) -> None:
        for word in words & self.older.keys():
            self.known[word] = self.older[word]
        new = list(words - self.older.keys())
        for i in range(0, len(new), 50_000):
            self.known.update(self.encode(new[i : i + 50_000]))

    def encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of some words."""
        out: dict[bytes, bytes] = {}
        lines = b"\n".join(words).decode()
        if not PLAIN_LINES.fullmatch(lines) or "<|" in lines:
            plain = [w for w in words if PLAIN_LINES.fullmatch(w.decode()) and b"<|" not in w]
            for word in set(words).difference(plain):
                out[word] = np.asarray(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            words, lines = plain, b"\n".join(plain).decode()
        if words:
            found = self.engine.encode_to_numpy(PART.sub(rf"\g<0>{self.END}", lines.lower() + self.BREAK), disallowed_special=())
            ends = (4 * np.flatnonzero(found == ord(self.BREAK))).tolist()
            ids = self.ids[found].tobytes()
            out.update(zip(words, map(ids.__getitem__, map(slice, [0, *[e + 4 for e in ends]], ends)), strict=False))
        return out


@lru_cache(2)
def _engine(path: str, size: int) -> WordIds:
    """One for each Python worker."""
    return WordIds(path, size)


def word_ids(path: str, size: int = CACHED_WORDS) -> WordIds:
    """For a task: the worker's engine, with words of its own, which go when the task does."""
    out = copy(_engine(path, size))
    out.known, out.older = {}, {}
    return out


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Each document's ids with the end id, cut at multiples of the window. Null and empty texts: the end id alone."""
    end = np.asarray([end_id], "<u4").tobytes()

    def make():
        ids_of = word_ids(path)

        def work(keys: list, texts: list[str]) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            for key, ids in zip(keys, ids_of([t.encode() for t in texts]), strict=True):
                all_ids = ids + end
                n = len(all_ids) // 4
                for start in range(0, n, window):
                    piece = all_ids[4 * start : 4 * (start + window)]
                    out["doc_id"].append(key)
                    out["start"].append(start)
                    out["length"].append(len(piece) // 4)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    out["doc_tokens"].append(n)
            return out

        return work

    return over_texts(docs, make, PIECES, limit=1 << 20)


def fills(lengths: np.ndarray, counts: np.ndarray, window: int, breadth: int = 48) -> list[dict[int, int]]:
    """Combinations of one to three lengths that there are, repeats included, which fill the window exactly."""
    have = np.zeros(window + 1, np.int64)
    have[lengths] = counts
    common = lengths[np.argsort(-counts * lengths, kind="stable")]
    out: dict[tuple, dict[int, int]] = {}

    def add(*parts: tuple[int, int]) -> None:
        made: dict[int, int] = defaultdict(int)
        for length, times in parts:
            made[length] += times
        if all(have[x] >= k for x, k in made.items()):
            out.setdefault(tuple(sorted(made.items())), dict(made))

    for a in map(int, lengths):
        for k in range(1, min(6, window // a) + 1):
            left = window - k * a
            if not left:
                add((a, k))
            for m in (1, 2, 3):
                if left and left % m == 0 and have[left // m]:
                    add((a, k), (left // m, m))
    for i, a in enumerate(map(int, common[: 8 * breadth])):
        for b in map(int, common[i : i + breadth]):
            for m in (1, 2, 3):
                left = window - a - m * b
                if left > 0 and have[left]:
                    add((a, 1), (b, m), (left, 1))
    return list(out.values())


def least_squares(patterns: list[dict[int, int]], have: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative x with patterns * x close to have: accelerated projected gradient on the sparse columns."""
    rows = np.array([x for p in patterns for x in p])
    cols = np.array([j for j, p in enumerate(patterns) for _ in p])
    vals = np.array([k for p in patterns for k in p.values()], float)
    scale = 1 / np.sqrt(np.maximum(have, 1))[rows]  # a length's misfit counts against its own number
    vals = vals * scale
    goal = have / np.sqrt(np.maximum(have, 1))
    per_row = np.bincount(rows, vals, len(have))
    bound = max(1e-9, float(np.bincount(cols, vals * per_row[rows], len(patterns)).max()))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        misfit = np.bincount(rows, vals * y[cols], len(have)) - goal
        new = np.maximum(0, y - np.bincount(cols, vals * misfit[rows], len(patterns)) / bound)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns with their counts; together they use each length exactly as often as the histogram has it."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[dict[int, int], int]] = []

    def take(pattern: dict[int, int], times: int) -> None:
        times = min([times, *(int(left[x]) // k for x, k in pattern.items())])
        if times > 0:
            for x, k in pattern.items():
                left[x] -= k * times
            out.append((pattern, times))

    lengths = np.flatnonzero(left)
    if len(lengths) and (patterns := fills(lengths, left[lengths], window)):
        wanted = least_squares(patterns, left)
        for j in np.argsort(-wanted, kind="stable"):
            take(patterns[j], int(wanted[j] + 0.5))
        for j in np.argsort(-wanted, kind="stable"):  # what rounding has left of exact fills
            take(patterns[j], max(1, int(wanted[j])))
    while left.any():
        room, pattern = window, defaultdict(int)
        rest = left.copy()
        while room and len(fit := np.flatnonzero(rest[: room + 1])):
            length = int(fit[-1])
            pattern[length] += 1
            rest[length] -= 1
            room -= length
        take(dict(pattern), int(left.sum()))
    return out


def places(spark: SparkSession, patterns: list[tuple[dict[int, int], int]]) -> DataFrame:
    """For each length, ranges of ranks [low, high) with the pattern they go to. At most a few rows for each pattern."""
    used: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for pattern, times in patterns:
        at = 0
        for length, k in sorted(pattern.items(), reverse=True):
            low = used[length]
            used[length] = high = low + k * times
            rows.append((length, low, high, k, first, at))
            at += k * length
        first += times
    return spark.createDataFrame(rows, "at_length long, low long, high long, repeats long, first long, base long")


def pack(cut: DataFrame, window: int = WINDOW, group_rows: int = 2_000) -> DataFrame:
    """cut with sequence_id and offset for each row, by its column length.

    Rows are ranked within their length in groups of about group_rows rows, dealt by hash, so that a length that a
    third of all rows have is no single task's. Equal rows are separate pieces.
    """
    spark = cut.sparkSession
    cut = settled(cut)
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # window rows at most
    groups = max(1, sum(histogram.values()) // group_rows)
    cut = cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.groupBy("length", "_group").agg(F.count("*").alias("_n")).select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_group").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("_rank", F.row_number().over(within)).join(bases, ["length", "_group"])
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1 + F.col("_base")).drop("_group", "_base")
    slots = places(spark, plan(histogram, window))
    if slots.count() <= FEW_PLACES:
        slots = F.broadcast(slots)
    placed = ranked.join(slots, (F.col("length") == F.col("at_length")) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high")))
    nth = F.col("_rank") - F.col("low")
    return placed.select(
        *[c for c in cut.columns if c != "_group"],
        (F.col("first") + F.floor(nth / F.col("repeats"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(nth, F.col("repeats")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most `window` tokens.

    Every row is a document of its own, also where doc_id is null or repeated; a null or empty text is one end id; a
    text longer than the window is cut into several pieces; an empty table gives no rows; other columns are ignored.
    """
    return pack(pieces(docs, path or tokenizer_path("word_bpe_49k.json"), window, end_id), window)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
