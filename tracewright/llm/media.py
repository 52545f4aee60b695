"""Media payloads as content-defined chunks in a store without duplicates, and their reconstruction.

A rolling gear hash cuts a payload where its low-order window looks a certain way, so that equal stretches of different
payloads give equal chunks. A chunk's digest is its name. The store holds one compressed frame for each digest; a
payload is the ordered list of its chunks' digests, its recipe. Reading back joins recipes with the store, checks every
chunk against its name, and puts payloads together; equal payloads share a recipe, which is put together once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, over_texts, table

UNIT = 64
#: Chunks are at least LEAST and at most MOST bytes; between these, one byte in 2**CUT_BITS ends a chunk.
LEAST, CUT_BITS, MOST = 4096, 13, 65536
GEAR = np.random.Generator(np.random.PCG64(99)).integers(0, 2**32, 256, dtype=np.uint32)
MAGIC = b"chunked media 1\n"


def payload_of(text: str) -> bytes:
    """The text as UTF-8, with zero bytes up to a positive multiple of UNIT."""
    raw = text.encode()
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def cuts(payload: bytes) -> list[int]:
    """Where chunks end. Each place's hash is over the 32 bytes before it: a running sum, doubled with every byte."""
    n = len(payload)
    if n <= LEAST:
        return [n]
    h = GEAR[np.frombuffer(payload, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    places = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    out, at = [], 0
    while n - at > LEAST:
        i = int(np.searchsorted(places, at + LEAST))
        at = min(int(places[i]) if i < len(places) else n, at + MOST, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunks(payload: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Each chunk's digest and bytes."""
    at = 0
    for end in cuts(payload):
        yield hashlib.sha256(payload[at:end]).digest(), payload[at:end]
        at = end


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, recipe_id, digests (in order) for each row of docs."""

    def make():
        def work(keys: list, texts: list[str]) -> dict:
            out: dict[str, list] = {"doc_id": keys, "n_bytes": [len(t.encode()) for t in texts], "recipe_id": [], "digests": []}
            for text in texts:
                digests = [d for d, _ in chunks(payload_of(text))]
                out["digests"].append(digests)
                out["recipe_id"].append(hashlib.sha256(b"".join(digests)).digest())
            return out

        return work

    return over_texts(docs, make, "doc_id long, n_bytes long, recipe_id binary, digests array<binary>")


def chunk_store(docs: DataFrame) -> DataFrame:
    """digest, frame: one row for each different chunk of all payloads, compressed."""

    def make():
        import zstandard

        compress, seen = zstandard.ZstdCompressor(level=6).compress, set()

        def work(keys: list, texts: list[str]) -> dict:
            out: dict[str, list] = {"digest": [], "frame": []}
            if len(seen) > 100_000:
                seen.clear()
            for text in texts:
                for digest, data in chunks(payload_of(text)):
                    if digest not in seen:  # spares the shuffle most copies; the grouping below drops the rest
                        seen.add(digest)
                        out["digest"].append(digest)
                        out["frame"].append(compress(data))
            return out

        return work

    return over_texts(docs, make, "digest binary, frame binary").groupBy("digest").agg(F.first("frame").alias("frame"))


def feature_of(payload: bytes, n_chunks: int) -> str:
    """Chunks, mean, deviation and entropy of the samples, and how often the level crosses the mean."""
    data = np.frombuffer(payload, np.uint8).astype(np.float64)
    share = np.bincount(data.astype(np.int64), minlength=256) / len(data)
    share = share[share > 0]
    crossings = int(np.count_nonzero(np.diff(data > data.mean())))
    return f"chunks={n_chunks};mean={data.mean():.3f};sd={data.std():.3f};entropy={-(share * np.log2(share)).sum():.3f};crossings={crossings}"


BUILT = "recipe_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _rebuild(rows: DataFrame) -> DataFrame:
    """What is read back for rows of recipe_id, parts: array of (at, digest, frame), in any order."""
    to = arrow_schema(BUILT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: dict[str, list] = {name: [] for name in to.names}
            for recipe_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts = sorted(value.as_py(), key=lambda p: p["at"])
                data = [expand(p["frame"]) for p in parts]
                if any(hashlib.sha256(d).digest() != p["digest"] for d, p in zip(data, parts, strict=True)):
                    raise ValueError("a stored chunk doesn't match its digest")
                payload = b"".join(data)
                stored, size = hashlib.sha256(MAGIC), len(MAGIC)
                for p in parts:
                    for piece in (p["digest"], len(p["frame"]).to_bytes(4, "little"), p["frame"]):
                        stored.update(piece)
                        size += len(piece)
                for name, made in zip(to.names, (recipe_id, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), size, stored.hexdigest(), feature_of(payload, len(parts))), strict=True):
                    out[name].append(made)
            yield pa.RecordBatch.from_pydict(out, schema=to)

    return rows.mapInArrow(run, BUILT)


def store_and_read(docs: DataFrame) -> DataFrame:
    """Store every row's payload and read it back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    media_*: of the stored form, its chunks' digests, frame sizes and frames in order. A null or empty text is UNIT
    zero bytes; rows with null or repeated doc_id each have their own result; other columns are ignored; an empty
    table gives no rows.
    """
    made, store = recipes(docs), chunk_store(docs)
    wanted = made.select("recipe_id", "digests").dropDuplicates(["recipe_id"])
    parts = wanted.select("recipe_id", F.size("digests").alias("n"), F.posexplode("digests").alias("at", "digest"))
    found = store.join(parts.hint("shuffle_hash"), "digest").select("recipe_id", "n", F.struct("at", "digest", "frame").alias("part"))
    # A payload of one chunk is whole where its chunk is; only the others' chunks move again.
    single = found.where("n = 1").select("recipe_id", F.array("part").alias("parts"))
    several = found.where("n > 1").groupBy("recipe_id").agg(F.collect_list("part").alias("parts"))
    built = _rebuild(single).unionByName(_rebuild(several))
    return made.select("doc_id", "n_bytes", "recipe_id").join(built, "recipe_id").drop("recipe_id")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(table(spark, sf_dir, "documents"))
