"""Target-distribution importance resampling: documents whose hashed n-grams are likelier under a target corpus.

Documents become postings (bucket, document, count), which are shuffled by bucket. There the counts that both corpora
have in a bucket meet them, the bucket's gain is worked out, and what it adds to each document is sent on and summed up
by document. A group of buckets is dealt out in slices of about equal work, so that a frequent feature's postings are
never one task's. Counts are summed up before they are sent; the draw adds Gumbel noise from a digest of the id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, over_texts, settled, table

BUCKETS = 10_000
SEED = 7
PERCENT = 25
#: What documents without an id count as while they are summed up.
NO_ID = 2**63 - 1
LEAST_WORDS = 20
#: Groups of buckets: bucket b is in group b % GROUPS, there at place b // GROUPS.
GROUPS = 8
#: About so many features of a group are one slice.
SLICE = 1 << 20
#: Texts are worked on in stretches of about so many bytes.
STRETCH = 1 << 20

#: Letters and digits of ASCII, lower-cased, and all other bytes of UTF-8 make words; the rest is space.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


class Counter:
    """Buckets of a text's runs of one and of two words: crc32 goes on from the first word's to the second's."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """bucket, count. Short texts may name a bucket several times."""
        raw = text.encode().translate(_WORD_BYTES)
        if len(raw) <= STRETCH:
            found = self._stretch(raw.split(), None)[0]
            return found, np.ones(len(found), np.int64)
        total, before, at = np.zeros(self.buckets, np.int64), None, 0
        while at < len(raw):
            end = raw.find(b" ", at + STRETCH)
            end = len(raw) if end < 0 else end
            found, before = self._stretch(raw[at:end].split(), before)
            total += np.bincount(found, minlength=self.buckets)
            at = end
        some = np.flatnonzero(total)
        return some, total[some]

    def _stretch(self, words: list[bytes], before: int | None) -> tuple[np.ndarray, int | None]:
        """before: crc32 of the last word before these and a space, if there is one."""
        crc = zlib.crc32
        ones = list(map(crc, words))
        spaced = [crc(b" ", c) for c in ones]
        twos = list(map(crc, words[1:], spaced))
        if before is not None and words:
            twos.append(crc(words[0], before))
        found = np.array(ones + twos, np.int64) % self.buckets
        return found, spaced[-1] if spaced else before


def counted(texts: DataFrame, buckets: int = BUCKETS, columns: tuple[str, str] = ("doc_id", "text")) -> DataFrame:
    """bucket, n: the features of all texts."""

    def make():
        count = Counter(buckets)

        def work(_keys: list, block: list[str]) -> dict:
            total = np.zeros(buckets, np.int64)
            for text in block:
                found, n = count(text)
                total += np.bincount(found, n, minlength=buckets).astype(np.int64)
            some = np.flatnonzero(total)
            return {"bucket": some, "n": total[some]}

        return work

    return over_texts(texts, make, "bucket int, n long", columns).groupBy("bucket").agg(F.sum("n").alias("n"))


POSTINGS = "grp int, slice int, docs binary, tids binary, sizes binary, places binary, counts binary, wide int, deep int"


def postings(docs: DataFrame, slices: int, buckets: int = BUCKETS) -> DataFrame:
    """Blocks of postings, one row for each group of buckets.

    docs and tids are the block's documents (ids and hashes of their texts), sizes how many postings each of the group's
    buckets has, places (of `wide` bytes each) and counts (`deep` bytes) these postings: the document's number in the
    block, and how often it has the bucket. Group 0 has a row for every block, so that no document is lost.
    """

    def make():
        count, here, done = Counter(buckets), TaskContext.get().partitionId(), 0

        def work(keys: list, texts: list[str]) -> dict:
            nonlocal done
            done += 1
            every = [count(t) for t in texts]
            of = np.repeat(np.arange(len(texts)), [len(b) for b, _ in every])
            found, times = (np.concatenate([x[i] for x in every]) for i in (0, 1))
            key, at = np.unique((found % GROUPS * buckets + found // GROUPS) * len(texts) + of, return_inverse=True)
            times = np.bincount(at, times, minlength=len(key)).astype(np.int64)
            bucket, place = np.divmod(key, len(texts))
            group, bucket = np.divmod(bucket, buckets)
            ids, tids = (np.array([k[c] for k in keys], np.int64).tobytes() for c in ("doc", "tid"))
            wide = _bytes(len(texts))
            out: dict[str, list] = {f.name: [] for f in arrow}
            for g in range(GROUPS):
                lo, hi = np.searchsorted(group, [g, g + 1])
                if g and lo == hi:
                    continue
                deep = _bytes(int(times[lo:hi].max(initial=0)))
                sizes = np.bincount(bucket[lo:hi], minlength=-(-buckets // GROUPS)).astype("<u4")
                row = (g, (here * 7919 + done) % slices, ids, tids, sizes.tobytes(), place[lo:hi].astype(f"<u{wide}").tobytes(), times[lo:hi].astype(f"<u{deep}").tobytes(), wide, deep)
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            return out

        return work

    arrow = arrow_schema(POSTINGS)
    key = F.struct(_doc().alias("doc"), _tid().alias("tid"))
    return over_texts(docs.select(key.alias("key"), "text"), make, POSTINGS, ("key", "text"))


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _tid() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _bytes(most: int) -> int:
    """How many bytes an unsigned number up to `most` takes: 1, 2, 4 or 8."""
    return np.min_scalar_type(most).itemsize


def gains(s: np.ndarray, t: np.ndarray, source: int, target: int, buckets: int) -> np.ndarray:
    """What one occurrence of each bucket adds, in thousandths of a natural logarithm."""
    return np.floor(1000 * np.log((t + 1.0) * (source + buckets) / ((s + 1.0) * (target + buckets)))).astype(np.int64)


def contributions(held: DataFrame, totals: DataFrame, slices: int, source: int, target: int, buckets: int = BUCKETS) -> DataFrame:
    """doc, tid, gain, features, rows: what each group of buckets adds to each document that has some of them.

    totals: bucket, s, t. A group's totals go to each of its slices, where postings and totals meet.
    """
    own = F.struct(F.expr(f"bucket div {GROUPS}").cast("int").alias("place"), "s", "t")
    by_group = totals.groupBy((F.col("bucket") % GROUPS).alias("grp")).agg(F.collect_list(own).alias("totals"))  # all buckets, 10,000 or what is asked for
    every = held.sparkSession.range(GROUPS).select(F.col("id").cast("int").alias("grp")).join(by_group, "grp", "left")
    dealt = every.select("grp", "totals", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    met = held.join(dealt.hint("shuffle_hash"), ["grp", "slice"])
    schema = "doc long, tid long, gain long, features long, rows int"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i] for name in batch.schema.names}
                s, t = np.zeros((2, -(-buckets // GROUPS)))
                if r["totals"].is_valid:
                    flat = r["totals"].values
                    at = flat.field("place").to_numpy()
                    s[at], t[at] = flat.field("s").to_numpy(), flat.field("t").to_numpy()
                gain = gains(s, t, source, target, buckets)
                whole = lambda name, kind: np.frombuffer(r[name].as_buffer(), kind)  # noqa: B023, E731
                docs, tids, places = whole("docs", "<i8"), whole("tids", "<i8"), whole("places", f"<u{r['wide'].as_py()}")
                counts = whole("counts", f"<u{r['deep'].as_py()}").astype(np.int64)
                added = np.zeros((2, len(docs)), np.int64)
                np.add.at(added[0], places, counts * np.repeat(gain, whole("sizes", "<u4")))
                np.add.at(added[1], places, counts)
                first = r["grp"].as_py() == 0
                some = slice(None) if first else np.flatnonzero(added[1])
                columns = [docs[some], tids[some], added[0][some], added[1][some]]
                columns.append(np.full(len(columns[0]), int(first), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return met.mapInArrow(run, schema)


def ranked(rows: DataFrame, percent: int, least_features: int) -> DataFrame:
    """rows with rank: 1, 2, 3 from the highest score on, ties to the smaller id, for the share that is drawn; else null.

    Rows are sorted by ranges, of which each numbers its own from where those before it end.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "tid", "nth"]
    may = rows.where(F.col("n_features") >= least_features).select("score", "doc_id", "tid", "nth")
    parts = settled(may.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n")).collect()  # as many rows as ranges
    total = sum(r["_n"] for r in sizes)
    starts, at = [], 0
    for part, size in sorted(sizes):
        starts.append((part, at))
        at += size
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part int, _start long"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    drawn = parts.withColumn("_own", own).join(starts, "_part").withColumn("rank", F.col("_start") + F.col("_own")).where(F.col("rank") <= percent * total // 100)
    drawn = drawn.select(F.col("doc_id").alias("_doc"), F.col("tid").alias("_tid"), F.col("nth").alias("_nth"), "rank")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tid") == F.col("_tid")) & (F.col("nth") == F.col("_nth"))
    return rows.join(drawn, same, "left").drop("_doc", "_tid", "_nth")


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED, slice_features: int = SLICE) -> DataFrame:
    """doc_id, tid, nth, n_features, weight, score of every row of docs; tid is a hash of its text, nth tells equal rows apart.

    docs must give the same rows in the same order whenever a task reads them again, as files and settled tables do.
    """
    both = counted(docs.select("doc_id", "text"), buckets).withColumn("corpus", F.lit(0)).unionByName(counted(target.select(F.lit(0).alias("id"), "text"), buckets, ("id", "text")).withColumn("corpus", F.lit(1)))
    of = lambda corpus: F.sum(F.when(F.col("corpus") == corpus, F.col("n")).otherwise(0))
    totals = settled(both.groupBy("bucket").agg(of(0).alias("s"), of(1).alias("t")))
    source, wanted = (x or 0 for x in totals.agg(F.sum("s"), F.sum("t")).first())
    slices = source // (GROUPS * slice_features) + 1
    added = contributions(postings(docs, slices, buckets), totals, slices, source, wanted, buckets)
    total = lambda name: F.sum(name).alias(name)
    each = added.groupBy("doc", "tid").agg(total("gain"), total("features"), total("rows"))
    n = F.expr("features div rows")  # equal rows add up to as many times the same
    weight = F.when(n == 0, F.lit(0).cast("long")).otherwise(F.expr("(gain div rows - pmod(gain div rows, features div rows)) div (features div rows)"))
    rows = each.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "tid", n.alias("n_features"), weight.alias("weight"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("nth"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return rows.select("doc_id", "tid", "nth", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED, slice_features: int = SLICE) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank is null for those that aren't drawn.

    target has a column text. A null text counts as empty: no features, weight 0, never drawn. Rows are drawn one by one,
    so that a repeated row comes back as often and is drawn as often; equal scores go to the smaller doc_id, those without
    one last ("null" stands for it in the digest). Other columns are ignored. An empty table gives no rows; without target
    texts all gains come from the source alone.
    """
    rows = settled(scored(docs, target, buckets, seed, slice_features))
    return ranked(rows, percent, max(0, 2 * least_words - 1)).select("doc_id", "n_features", "weight", "score", "rank")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents resampled towards the texts of benchmark; odd rows as in resample()."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
with recursive words(corpus, doc_id, w) as (
  select corpus, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  from (select 0 as corpus, doc_id, text from documents union all select 1, null, text from benchmark)
),
counts as (
  select corpus, doc_id, f, count(*) as n
  from (
    select corpus, doc_id, unnest(w) as f from words
    union all
    select corpus, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from words
  ) group by all
),
crc_table as (
  select list(c order by i) as tab from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i)
  )
),
hashed as (
  select f, xor(list_reduce(
      list_prepend(4294967295, list_transform(range(octet_length(encode(f))), lambda i: (16 * (strpos('0123456789ABCDEF', substr(hex(encode(f)), 2 * i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(hex(encode(f)), 2 * i + 2, 1)) - 1)::bigint)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
  from (select distinct f from counts), crc_table
),
placed as (select corpus, doc_id, bucket, sum(n) as n from counts join hashed using (f) group by all),
totals as (select bucket, coalesce(sum(n) filter (where corpus = 0), 0) as s, coalesce(sum(n) filter (where corpus = 1), 0) as t from placed group by bucket),
gains as (
  select bucket, floor(1000 * ln((t + 1)::double * ((select sum(s) from totals) + 10000)::double / ((s + 1)::double * ((select sum(t) from totals) + 10000)::double))) as gain
  from totals
),
weights as (select doc_id, sum(n)::bigint as n_features, floor(sum(n * gain) / sum(n))::bigint as weight from placed join gains using (bucket) where corpus = 0 group by doc_id),
scored as (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from documents left join weights using (doc_id)
),
drawn as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from scored where n_features >= 39
)
select scored.*, case when rank <= 25 * n // 100 then rank end as rank from scored left join drawn using (doc_id)
"""
