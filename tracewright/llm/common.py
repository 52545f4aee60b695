"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import settled as settled

#: Words are runs of anything but ASCII white space; bytes.split() splits at exactly these.
TEXT_COLUMNS = ("doc_id", "text")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled_as_dealt(df: DataFrame) -> DataFrame:
    """settled(), of rows that keep the partitioning they were dealt by, so that grouping by it again sends none of them.

    Adaptive planning would merge partitions and forget it, and is off while these rows are made.
    """
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return settled(df.select("*"))
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def swept(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of what is settled by now; else they stay until the driver happens to collect garbage."""
    gc.collect()
    spark._jvm.System.gc()


def tokenizer_path(name: str) -> str:
    """Where the executors' installed tokenizer files are; callers may pass any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def over_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list, list[str]], dict[str, object] | None]],
    schema: str,
    columns: tuple[str, ...] = TEXT_COLUMNS,
    limit: int = 4 << 20,
) -> DataFrame:
    """Apply make()'s function to blocks of (first column, second column as text) of docs.

    A null text counts as empty. A block holds about `limit` characters, and one text at least, so that memory
    doesn't follow the batch. The function returns columns (lists or arrays) by name.
    """
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        work = make()

        def out(keys: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
            made = work(keys, texts)
            if made is not None and len(made[to.names[0]]):
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in to], schema=to)

        for batch in batches:
            keys, texts, held, n = [], [], batch.column(0).to_pylist(), 0
            for key, value in zip(held, batch.column(1), strict=True):
                text = value.as_py() or ""
                keys.append(key)
                texts.append(text)
                n += len(text)
                if n >= limit:
                    yield from out(keys, texts)
                    keys, texts, n = [], [], 0
            if keys:
                yield from out(keys, texts)

    return docs.select(*columns).mapInArrow(run, schema)


def rewrite_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[str | None]]]) -> DataFrame:
    """docs with each text replaced by what make()'s function gives for it, and without the rows for which that is None.

    All columns stay; n_chars, where there is one, follows the text. A null text counts as empty, and stays null if it
    isn't changed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                old = part.column("text").to_pylist()
                new = work([t or "" for t in old])
                kept = [i for i, t in enumerate(new) if t is not None]
                columns = {f.name: part.column(f.name).take(pa.array(kept, pa.int64())) for f in part.schema}
                texts = [old[i] if new[i] == (old[i] or "") else new[i] for i in kept]
                columns["text"] = pa.array(texts, part.schema.field("text").type)
                if "n_chars" in columns:
                    same = columns["n_chars"].to_pylist()
                    sizes = [n if t is None or t == old[i] else len(t) for i, t, n in zip(kept, texts, same, strict=True)]
                    columns["n_chars"] = pa.array(sizes, part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in part.schema], schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


#: A key that more than one HOT-th of all rows have is dealt out; by that definition there are fewer than HOT such keys.
HOT = 1000


def joined_by_class(rows: DataFrame, found: DataFrame, by: str = "of") -> DataFrame:
    """rows joined with found, which has one row for each value of `by`.

    Values that very many rows have are met by several copies of their row of found, so that no task gets all of them.
    """
    counts = rows.groupBy(by).agg(F.count("*").alias("_n"))
    least = rows.count() // HOT + 100
    hot = F.broadcast(counts.where(F.col("_n") > least).select(by, F.ceil(F.col("_n") / least).cast("int").alias("_pieces")))  # fewer than HOT rows
    dealt = rows.join(hot, by, "left").withColumn("_piece", F.pmod(F.monotonically_increasing_id(), F.coalesce("_pieces", F.lit(1))).cast("int")).drop("_pieces")
    copied = found.join(hot, by, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    return dealt.join(copied, [by, "_piece"]).drop("_piece")


def arrow_schema(ddl: str) -> pa.Schema:
    """Made on the driver: parsing the text needs a session."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of all words of a text, made in a few numpy passes.

    A word's bytes are taken eight at a time; each eight go through a multiplication by an odd number and the finaliser
    before the next are added, so that no arrangement of bytes cancels out. Words of more than LONG bytes get a BLAKE2b
    digest.
    """

    LONG = 64
    SEED, ODD = 0x5851F42D4C957F2D, 0xD6E8FEB86659FD93

    def __init__(self, lower: bool) -> None:
        self.lower = lower
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.masks = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

    def __call__(self, raw: bytes) -> np.ndarray:
        out = [self.hashed(part, *self.words(part)) for _, part in self.stretches(raw)]
        return out[0] if len(out) == 1 else np.concatenate([np.empty(0, np.uint64), *out])

    def stretches(self, raw: bytes) -> Iterator[tuple[int, bytes]]:
        """Where each begins, and its bytes. They end at a space, so that memory doesn't follow a very long text."""
        at = 0
        while at < len(raw):
            end = at + (1 << 20)
            while end < len(raw) and not self.space[raw[end]]:
                end += 1
            yield at, raw[at:end].lower() if self.lower else raw[at:end]
            at = end

    def words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where a stretch's words start and end."""
        edge = np.diff(np.concatenate(([True], self.space[np.frombuffer(raw, np.uint8)], [True])).view(np.int8))
        return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)

    def hashed(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(raw)
        padded = raw + bytes(8)
        eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        size = ends - starts
        out = mix(size.astype(np.uint64) * MULT + np.uint64(self.SEED))
        for step in range(0, min(self.LONG, int(size.max(initial=0))), 8):
            rows = np.flatnonzero(size > step) if step else slice(None)
            part = eight[starts[rows] + step] & self.masks[np.minimum(size[rows] - step, 8)]
            out[rows] = mix(out[rows] ^ (part * np.uint64(self.ODD)))
        for i in np.flatnonzero(size > self.LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
        return out


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words; none where there are fewer."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total, part, weight = np.zeros(n, np.uint64), np.empty(n, np.uint64), 0x2545F4914F6CDD1D
    for i in range(k):
        np.multiply(words[i : i + n], np.uint64(weight), out=part)
        total += part
        weight = (weight * 0x5851F42D4C957F2D + 2) & (2**64 - 1)
    return mix(total)
