"""A name index: what records can be asked for by, in files sorted by name, and the range of names that each file holds.

A lookup opens the files whose range can hold a name that is asked for, and no others. What many records share (a product
that a third of them has) is sorted by id within its name and so spread over as many files as it needs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = "name string, id string, role string"
SECTIONS = "folder string, file string, low string, high string"
#: Names in a file, at most.
PER_FILE = 1 << 20
#: Sections that are taken to the tasks of a lookup, at most; beyond these all files are read and joined.
SECTIONS_HELD = 200_000
#: The last code point: a prefix and this come after all that begins with the prefix.
LAST = "\U0010ffff"


def of_records(records: DataFrame) -> DataFrame:
    """name, id, role of each record's id, digest and products, each once. A name that is null has no row."""
    as_ = lambda c, role: F.struct(c.alias("name"), F.lit(role).alias("role"))
    products = F.transform(F.array_distinct(F.coalesce("paths", F.array().cast("array<string>"))), lambda p: as_(p, "product"))
    each = F.concat(F.array(as_(F.col("id"), "id"), as_(F.col("digest"), "digest")), products)
    return records.select("id", F.explode(each).alias("n")).select("n.name", "id", "n.role").where("name is not null")


def of_log(log: DataFrame) -> DataFrame:
    """name, id, role of the digests that log lines name records by."""
    return log.select(F.col("digest").alias("name"), "id", F.lit("logged").alias("role")).where("name is not null")


def ranged(rows: DataFrame) -> DataFrame:
    """Rows in the order that files of the index are in: by name, then id, in ranges of about equal size."""
    return rows.select("name", "id", "role").repartitionByRange("name", "id").sortWithinPartitions("name", "id")


def sections(spark: SparkSession, base: str, folder: str, schema: str = NAMES, by: str = "name") -> DataFrame:
    """folder, file, low, high: the first and last name in each file of a folder under base. by: the column that has the names."""
    rows = spark.read.schema(schema).parquet(f"{base}/{folder}").select(F.col(by).alias("name"), F.regexp_extract(F.input_file_name(), "[^/]+$", 0).alias("file"))
    return rows.groupBy("file").agg(F.min("name").alias("low"), F.max("name").alias("high")).select(F.lit(folder).alias("folder"), "file", "low", "high")


def write(rows: DataFrame, base: str, folder: str, per_file: int = PER_FILE) -> DataFrame:
    """Write rows as an index into base/folder; its sections."""
    ranged(rows).write.option("maxRecordsPerFile", per_file).parquet(f"{base}/{folder}")
    return sections(rows.sparkSession, base, folder)


def _numbers(held: list, name: Column, prefix: bool) -> Column:
    """The numbers of the files, in the order of held, whose range can hold a name, or one that begins with it."""
    folders, at = [], 0
    for folder in sorted({r["folder"] for r in held}):
        some = [r for r in held if r["folder"] == folder]
        low, high = (np.array([r[k] for r in some], dtype=object) for k in ("low", "high"))
        folders.append((at, low, high))
        at += len(some)

    @F.pandas_udf("array<int>")
    def numbers(keys: pd.Series) -> pd.Series:
        first = keys.to_numpy(dtype=object)
        last = np.array([k + LAST for k in first], dtype=object) if prefix else first
        ways = [(at, np.searchsorted(high, first, "left"), np.searchsorted(low, last, "right")) for at, low, high in folders]
        return pd.Series([[n for at, i, j in ways for n in range(at + i[k], at + j[k])] for k in range(len(first))], dtype="object")

    return numbers(name)


def files_for(sections_: DataFrame, keys: DataFrame, prefix: bool = False) -> list[str]:
    """The files, under the index's base, that can hold the keys (column name): by equality, or as prefixes."""
    found = sections_.select("folder", "file", "low", "high")
    if found.limit(SECTIONS_HELD + 1).count() > SECTIONS_HELD:
        return [f"{r['folder']}/*" for r in found.select("folder").distinct().collect()]
    held = sorted(found.collect(), key=lambda r: (r["folder"], r["low"], r["high"], r["file"]))
    if not held:
        return []
    asked = keys.select("name").where("name is not null").distinct()
    met = asked.select(F.explode(_numbers(held, F.col("name"), prefix)).alias("n")).distinct().collect()  # at most one a section
    return [f"{held[r['n']]['folder']}/{held[r['n']]['file']}" for r in sorted(met)]


def looked_up(spark: SparkSession, base: str, sections_: DataFrame, keys: DataFrame, prefix: bool = False, schema: str = NAMES) -> DataFrame:
    """Rows of the files that can hold the keys (column name); rows that no key asks for are among them."""
    files = files_for(sections_, keys, prefix)
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{base}/{f}" for f in files))
