"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Python only tokenises: a block of texts becomes its distinct runs, each with the ids of both vocabularies and the byte
offsets at which tokens end, and for each text the runs that it is made of. A run is what both vocabularies cut off
anyway, a word behind a space, or else a whole text; so a word is tokenised and aligned once for all texts of a block.

From there on Spark's higher-order functions do all. Offsets at which tokens of both end (array_intersect) cut a run into
groups; the sorted offsets at which a token of either ends (array_union) stand for the links, as between two of them
exactly one token of each side lies.
"""

from __future__ import annotations

import functools
import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import shared_folder
from .bpe import OTHER_SCRIPTS, SAFE_CUT, TWO_SPACES, Vocabulary
from .common import over_texts, table, tokenizer_path

#: Whole texts are tokenised in stretches of about this many characters, cut before a space between two ASCII letters.
STRETCH = 1 << 20
#: Texts with longer words are left whole, to the library that takes its time in proportion.
LONG_RUN = 2000
#: Characters of a block.
BLOCK = 2 << 20
#: Fewer pairs than this hold more than one link in FREQUENT; only these are broadcast.
FREQUENT = 1 << 17

RUN = "a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>"
BLOCKS = f"runs array<struct<{RUN.replace(' ', ':').replace(',:', ', ')}>>, texts array<struct<doc_id:long, n_a:long, n_b:long, runs:array<int>>>"


class ByteTokens:
    """Ids of a byte-level vocabulary, and the bytes of each. Special tokens are plain text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(path)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        self.sizes = np.array(self.vocabulary.sizes, np.int32)
        made = [token for _, token in sorted(self.vocabulary.merges.values())]
        self.fast = None
        if made == sorted(set(made)):  # ids are in the order of merges: another library reads them as ranks, and is faster
            import public_tokenizers
            import tiktoken

            self.fast = tiktoken.Encoding(uuid.uuid4().hex, pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(self.vocabulary.ids), special_tokens={})

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def plain(self, text: str) -> np.ndarray:
        """whole(), of a text of words between single spaces."""
        return np.array(self.fast.encode_ordinary(text), np.int32) if self.fast else self.whole(text)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return self.vocabulary.decode(ids)


class PieceTokens:
    """Ids of a sentencepiece vocabulary, which puts a space before a text, and the bytes of each."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = self.library.id_to_piece
        self.bytes = [bytes([int(piece(i)[3:5], 16)]) if self.library.is_byte(i) else piece(i).replace("\u2581", " ").encode() for i in range(self.library.get_piece_size())]
        self.sizes = np.array(list(map(len, self.bytes)), np.int32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text), np.int32)

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        found = self.library.encode(texts, num_threads=1)
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(n.sum())), n

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def _stretches(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > STRETCH and (cut := SAFE_CUT.search(text, at + STRETCH)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Runs:
    """The distinct runs of a block of texts, tokenised."""

    def __init__(self, a: ByteTokens, b: PieceTokens) -> None:
        self.a, self.b = a, b

    def __call__(self, texts: list[str]) -> tuple[list[np.ndarray], list[pa.Array], np.ndarray, np.ndarray]:
        """For each text the runs that it is made of; of the runs the lists of RUN, and how many tokens A and B have.

        A text whose bytes the tokens don't give back is made of none.
        """
        words: dict[str, int] = {}
        split = []
        for text in texts:
            runs = text.split(" ") if text and self._safe(text) else []
            if runs and max(map(len, runs)) < LONG_RUN:
                split.append(np.array([words.setdefault(r, len(words)) for r in runs], np.int32))
            else:
                split.append(None)
        of_words = self._words(list(words))
        alone = [self._alone(t) for t, s in zip(texts, split, strict=True) if s is None and t]
        columns, good = [], np.concatenate([of_words[2], np.array([x is not None for x in alone], bool)])
        for side, (ids, n) in enumerate(of_words[:2]):
            own = [x[side] if x is not None else np.empty(0, np.int32) for x in alone]
            ids, n = np.concatenate([ids, *own]), np.concatenate([n, np.array(list(map(len, own)), np.int64)])
            at = np.concatenate(([0], np.cumsum(n)))
            ends = np.concatenate(([0], np.cumsum((self.a, self.b)[side].sizes[ids], dtype=np.int64)))
            ends = ends[1:] - np.repeat(ends[at[:-1]], n)
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (ids, ends)]
            columns.append((lists, n))
        made, nth = [], itertools.count(len(words))
        for text, runs in zip(texts, split, strict=True):
            runs = runs if runs is not None else np.array([next(nth)] if text else [], np.int32)
            made.append(runs if good[runs].all() else runs[:0])
        return made, [*columns[0][0], *columns[1][0]], columns[0][1], columns[1][1]

    def _safe(self, text: str) -> bool:
        """Whether both vocabularies cut a text before each of its spaces, and both libraries know all of its letters."""
        return not (text[0].isspace() or text[-1].isspace() or TWO_SPACES.search(text) or OTHER_SCRIPTS.search(text))

    def _words(self, words: list[str]):
        """((ids, how many each word has) of A, the same of B, whether the bytes come back) of words, a space before each."""
        none = np.empty(0, np.int32), np.empty(0, np.int64)
        if not words:
            return none, none, np.empty(0, bool)
        raw = [b" " + w.encode() for w in words]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        a_ids = self.a.plain(" " + " ".join(words))
        b_ids, b_n = self.b.each(words)
        found = np.searchsorted(ends, np.cumsum(self.a.sizes[a_ids], dtype=np.int64))
        a_n, good = np.bincount(found, minlength=len(words)), np.ones(len(words), bool)
        whole = b"".join(raw)
        if self.a.bytes_of(a_ids) != whole:
            raise ValueError("the byte-level vocabulary lacks a byte")
        if self.b.bytes_of(b_ids) != whole:
            at = np.concatenate(([0], np.cumsum(b_n)))
            good = np.array([self.b.bytes_of(b_ids[at[i] : at[i + 1]]) == r for i, r in enumerate(raw)], bool)
        return (a_ids, a_n), (b_ids, b_n), good

    def _alone(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        # A stretch after the first begins with a space, which is A's; B adds its own in its place.
        first, *more = _stretches(text)
        whole = [" " + first, *more]
        a_ids, b_ids = np.concatenate([self.a.whole(x) for x in whole]), np.concatenate([self.b.whole(x[1:]) for x in whole])
        raw = (" " + text).encode()
        return (a_ids, b_ids) if self.a.bytes_of(a_ids) == raw == self.b.bytes_of(b_ids) else None


@functools.lru_cache(1)
def loaded(a_path: str, b_path: str) -> Runs:
    """Kept by a Python worker from task to task."""
    return Runs(ByteTokens(a_path), PieceTokens(b_path))


def tokens(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block: int = BLOCK) -> DataFrame:
    """runs, texts: a row for each block of docs, with its distinct runs, and its rows by the runs that they are made of.

    A is given a space and the text, B the text, before which it puts a space itself. A null or empty text, and one whose
    bytes the tokens of A or B don't give back, has no runs.
    """
    a_path, b_path = a_path or tokenizer_path("byte_bpe_50k.json"), b_path or tokenizer_path("piece_bpe_32k.model")

    def make() -> Callable:
        runs_of = loaded(a_path, b_path)

        def work(keys: list, texts: list[str]) -> dict:
            made, lists, a_n, b_n = runs_of(texts)
            offsets = lambda sizes: pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            runs = pa.StructArray.from_arrays(lists, ["a_ids", "a_ends", "b_ids", "b_ends"])
            own = pa.ListArray.from_arrays(offsets(list(map(len, made))), pa.array(np.concatenate(made), pa.int32()))
            counts = [pa.array([int(n[r].sum()) for r in made], pa.int64()) for n in (a_n, b_n)]
            rows = pa.StructArray.from_arrays([pa.array(keys, pa.int64()), *counts, own], ["doc_id", "n_a", "n_b", "runs"])
            return {"runs": pa.ListArray.from_arrays(offsets([len(runs)]), runs), "texts": pa.ListArray.from_arrays(offsets([len(rows)]), rows)}

        return work

    return over_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, BLOCKS, limit=block)


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once, not in every step of the functions that use it."""
    return F.transform(F.array(value), use)[0]


def _covering(ends: Column) -> Column:
    """For each byte of the text the place of the token over it."""
    return F.flatten(F.transform(ends, lambda e, i: F.array_repeat(i, e - F.coalesce(F.get(ends, i - 1), F.lit(0)))))


def _joined(ids: Column, first: Column, last: Column) -> Column:
    one = ids[first].cast("string")
    return F.when(first == last, one).otherwise(F.array_join(F.transform(F.sequence(first, last), lambda i: ids[i].cast("string")), ","))


def pair_of(a_id: Column, b_id: Column) -> Column:
    """Two ids as one number, from which b_of() takes the second."""
    return F.shiftleft(a_id.cast("long"), 32) + b_id


def b_of(pair: Column) -> Column:
    return pair.bitwiseAND(F.lit((1 << 32) - 1))


def _aligned_run(run: Column) -> Column:
    """n_groups, groups, links of one run."""
    a, b, a_ends, b_ends = (run[c] for c in ("a_ids", "b_ids", "a_ends", "b_ends"))
    texts = lambda ids: ids.cast("array<string>")

    def groups(cuts: Column, over_a: Column, over_b: Column) -> Column:
        def group(end: Column, g: Column) -> Column:
            since = F.get(cuts, g - 1)
            first = lambda over: F.coalesce(over[since - 1] + 1, F.lit(0))
            return F.concat(_joined(a, first(over_a), over_a[end - 1]), F.lit("|"), _joined(b, first(over_b), over_b[end - 1]))

        return F.array_join(F.transform(cuts, group), ";")

    def made(n_groups: Column, text: Column, links: Column) -> Column:
        return F.struct(n_groups.cast("long").alias("n_groups"), text.alias("groups"), links.alias("links"))

    def all_of(cuts: Column, over_a: Column, over_b: Column) -> Column:
        ends = F.sort_array(F.array_union(a_ends, b_ends))
        return made(F.size(cuts), groups(cuts, over_a, over_b), F.transform(ends, lambda e: pair_of(a[over_a[e - 1]], b[over_b[e - 1]])))

    # The same ends are a token a group; only other runs need their shared ends looked for.
    text = F.array_join(F.zip_with(texts(a), texts(b), lambda x, y: F.concat(x, F.lit("|"), y)), ";")
    other = _named(
        F.array_intersect(a_ends, b_ends),
        lambda cuts: _named(_covering(a_ends), lambda over_a: _named(_covering(b_ends), lambda over_b: all_of(cuts, over_a, over_b))),
    )
    return F.when(a_ends == b_ends, made(F.size(a), text, F.zip_with(a, b, pair_of))).otherwise(other)


def aligned(blocks: DataFrame, shown: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, links of each text of tokens().

    groups: `a1,a2|b1;a3|b2,b3`, the ids of A and of B between two shared ends, in order, or what `shown` makes of it; without
    tokens it is empty.
    links: a pair_of() for every two tokens whose byte ranges overlap, in order.
    """

    def text(runs: Column, t: Column) -> Column:
        def joined(own: Column) -> Column:
            groups, links = F.array_join(own["groups"], ";"), F.flatten(own["links"])
            n_groups = F.aggregate(own["n_groups"], F.lit(0).cast("long"), lambda n, of_run: n + of_run)
            return F.struct(t["doc_id"].alias("doc_id"), t["n_a"].alias("n_a"), t["n_b"].alias("n_b"), n_groups.alias("n_groups"), shown(groups).alias("groups"), links.alias("links"))

        return _named(F.transform(t["runs"], lambda i: runs[i]), joined)

    made = _named(F.transform("runs", _aligned_run), lambda runs: F.transform("texts", lambda t: text(runs, t)))
    rows = blocks.select(F.explode(made).alias("t")).select("t.*")
    text = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.col("groups"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), text.alias("groups"), "links")


def kept(rows: DataFrame) -> DataFrame:
    """rows, written once to the cluster's shared folder by columns, so that each use reads those that it needs."""
    path = f"{shared_folder(rows.sparkSession)}/aligned-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n, best: how many links hold a pair; best if no other pair of its B id has more. links has a column links."""
    counts = links.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(b_of(F.col("pair"))))  # as many rows as A has ids, at most
    return counts.select("pair", "n", (F.col("n") == most).alias("best"))


def counted_links(rows: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """row, n_best, count_sum for rows (row, links): over a row's links, how many are best, and the sum of their counts.

    Pairs that hold more than one link in `frequent` are fewer than that, and are broadcast; the others' links, none of
    which is a hot key, are shuffled.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.broadcast(counts.where(F.col("n") * frequent > total))
    each = rows.select("row", F.explode("links").alias("pair"))
    summed = lambda df: df.groupBy("row").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum"))
    rest = each.join(often.select("pair"), "pair", "left_anti").join(counts.where(F.col("n") * frequent <= total).hint("merge"), "pair")
    both = summed(each.join(often, "pair")).unionByName(summed(rest))
    return both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def with_counts(rows: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """rows of aligned(), groups in any form, with n_best and count_sum in place of links."""
    held = kept(rows.withColumn("row", F.monotonically_increasing_id()))
    counts = kept(pair_counts(held))
    sums = counted_links(held, counts, frequent)
    zero = F.lit(0).cast("long")
    out = held.drop("links").join(sums, "row", "left")
    return out.withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")}).drop("row")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum of every row of docs.

    Null and empty texts, and texts that A or B doesn't give back byte for byte, have zeros and empty groups. Repeated
    rows each count and each come back; doc_id may be null; other columns are ignored; an empty table gives no rows.
    """
    return with_counts(aligned(tokens(docs, a_path, b_path)), frequent)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, groups by their digest; odd rows as in align()."""
    rows = aligned(tokens(table(spark, sf_dir, "documents")), lambda groups: F.sha2(groups, 256))
    return with_counts(rows.withColumnRenamed("groups", "groups_sha256"))
