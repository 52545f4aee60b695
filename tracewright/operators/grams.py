"""A substring index: for every run of one to three code points the records whose searched texts hold it, as bitmaps.

Records are numbered from 1. A posting is a run, a bucket of 32,768 numbers and a bit for each of them, so that a run that
most records hold is as many rows as there are buckets, and no row grows. A needle's runs are looked up in files sorted by run
(names.py), their bits met bucket by bucket, and the texts of what is left, kept in lower case beside the index, settle it.
A needle of three code points or fewer is a run itself. Postings of one bucket that came in several batches are or-ed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import names
from .catalog import searched
from .components import settled

#: The longest run that is kept.
RUN = 3
#: Records of a bucket: the bits that Spark's bitmap functions work on.
BUCKET = 1 << 15
TEXTS = "n long, id string, low array<string>"
TEXT_SECTIONS = "folder string, file string, low long, high long"
POSTINGS = "name string, bucket long, bits binary"
#: Postings in a file, at most: 4 KB each before compression.
PER_FILE = 1 << 12


def texts_of(records: DataFrame, after: int = 0) -> DataFrame:
    """n, id, low: the searched texts of each record in lower case, numbered without gaps from after + 1.

    Rows are settled in ranges of ids; a range's numbers follow those of all ranges before it, wherever it is computed.
    """
    rows = settled(records.select("id", F.transform(searched(), F.lower).alias("low")).repartitionByRange("id"))
    at = F.monotonically_increasing_id()  # of a settled row: its partition, then its place there
    rows = rows.withColumn("_part", F.shiftright(at, 33)).withColumn("_nth", at.bitwiseAND((1 << 33) - 1))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # as many rows as ranges
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    n = F.lit(after + 1) + F.col("_start") + F.col("_nth")
    return rows.join(F.broadcast(starts), "_part").select(n.alias("n"), "id", "low")


def _runs(chars: Column, k: int) -> Column:
    """All runs of k of an array of code points."""
    run = lambda i: F.concat(*(F.get(chars, i + j) for j in range(k)))
    return F.when(F.size(chars) >= k, F.transform(F.sequence(F.lit(0), F.size(chars) - k), run)).otherwise(F.array().cast("array<string>"))


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def runs_of(texts: Column) -> Column:
    """Different runs of one to RUN code points in any of some texts. Each text is taken apart once."""
    each = F.transform(F.transform(texts, _chars), lambda c: F.concat(*(_runs(c, k) for k in range(1, RUN + 1))))
    return F.array_distinct(F.flatten(each))


def postings(texts: DataFrame) -> DataFrame:
    """name (the run), bucket, bits."""
    each = texts.select("n", F.explode(runs_of(F.col("low"))).alias("name"))
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("n"))
    return each.groupBy("name", F.bitmap_bucket_number("n").alias("bucket")).agg(bits.alias("bits"))


def in_files(postings_: DataFrame) -> DataFrame:
    """Postings in the order that their files are in."""
    return postings_.select("name", "bucket", "bits").repartitionByRange("name", "bucket").sortWithinPartitions("name", "bucket")


def write(texts: DataFrame, base: str, folder: str, per_file: int = PER_FILE, texts_per_file: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Write an index of texts into base/folder-texts and base/folder-runs; the sections of both."""
    spark = texts.sparkSession
    texts.write.option("maxRecordsPerFile", texts_per_file).parquet(f"{base}/{folder}-texts")
    kept = spark.read.schema(TEXTS).parquet(f"{base}/{folder}-texts")
    in_files(postings(kept)).write.option("maxRecordsPerFile", per_file).parquet(f"{base}/{folder}-runs")
    return names.sections(spark, base, f"{folder}-texts", TEXTS, "n"), names.sections(spark, base, f"{folder}-runs", POSTINGS)


@F.pandas_udf(ArrayType(IntegerType()))
def _places(bits: pd.Series) -> pd.Series:
    """The bits that are set."""
    return pd.Series([np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")).astype(np.int32) for b in bits], dtype="object")


def _needle_runs(needles: DataFrame) -> DataFrame:
    """needle, _k, name: a needle's _k different runs of RUN code points, or itself if it has no more."""
    needle = F.col("needle")
    runs = F.when(F.length(needle) <= RUN, F.array(needle)).otherwise(F.transform(F.array(_chars(needle)), lambda c: _runs(c, RUN))[0])
    return needles.select("needle", F.array_distinct(runs).alias("_runs")).select("needle", F.size("_runs").alias("_k"), F.explode("_runs").alias("name"))


def holders(postings_: DataFrame, needles: DataFrame) -> DataFrame:
    """needle, n: records that hold all runs of a needle (column needle: lower case, not empty)."""
    each = postings_.join(_needle_runs(needles), "name").groupBy("needle", "_k", "bucket", "name").agg(F.bitmap_or_agg("bits").alias("bits"))
    met = each.groupBy("needle", "_k", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("_n")).where("_n = _k")
    return met.select("needle", "bucket", F.explode(_places(F.col("bits"))).alias("_at")).select("needle", ((F.col("bucket") - 1) * BUCKET + F.col("_at") + 1).alias("n"))


#: Needles that a scan takes to its tasks, at most; more are looked up by runs, index or not.
FEW_NEEDLES = 1_000


def _asked(needles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different needles with their lower case (needle, _low), and the different lower cases that are not empty (needle)."""
    asked = needles.select("needle", F.lower("needle").alias("_low")).where("needle is not null").distinct()
    return asked, asked.where("_low <> ''").select(F.col("_low").alias("needle")).distinct()


def _verified(found: DataFrame, texts: DataFrame, asked: DataFrame) -> DataFrame:
    """needle, id of those found (needle in lower case, n) whose texts do hold the needle."""
    held = F.exists("low", lambda t: F.contains(t, F.col("_low")))
    return found.withColumnRenamed("needle", "_low").join(texts, "n").where(held).select("_low", "id").distinct().join(asked, "_low").select("needle", "id")


def matches(spark: SparkSession, base: str, text_sections: DataFrame, run_sections: DataFrame, asked: DataFrame) -> DataFrame:
    """needle, id for needles (column needle) that a searched text of a record holds, whatever the case.

    Files are opened that can hold one of the needles' runs, and then those with texts of records that hold all runs of a needle.
    An empty needle is in every record; one that is null, or that nothing holds, has no row. Equal needles count once.
    """
    asked, low = _asked(asked)
    postings_ = names.looked_up(spark, base, run_sections, _needle_runs(low).select("name").distinct(), schema=POSTINGS)
    found = settled(holders(postings_, low))
    texts = names.looked_up(spark, base, text_sections, found.select(F.col("n").alias("name")), schema=TEXTS)
    hits = _verified(found, texts, asked)
    if asked.where("_low = ''").isEmpty():
        return hits
    folders = [f"{base}/{r['folder']}" for r in text_sections.select("folder").distinct().collect()]
    every = spark.read.schema(TEXTS).parquet(*folders) if folders else spark.createDataFrame([], TEXTS)
    return hits.unionByName(every.select(F.lit("").alias("needle"), "id").distinct())


def scanned(records: DataFrame, asked: DataFrame) -> DataFrame:
    """matches() over records without an index. A few needles go to all tasks; more meet the records by their runs."""
    asked, low = _asked(asked)
    if asked.limit(FEW_NEEDLES + 1).count() <= FEW_NEEDLES:
        texts = records.select("id", F.transform(searched(), F.lower).alias("low"))
        held = (F.col("_low") == "") | F.exists("low", lambda t: F.contains(t, F.col("_low")))
        return texts.join(F.broadcast(asked), held).select("needle", "id").distinct()
    texts = settled(texts_of(records))
    hits = _verified(holders(postings(texts), low), texts, asked)
    return hits if asked.where("_low = ''").isEmpty() else hits.unionByName(texts.select(F.lit("").alias("needle"), "id").distinct())
