"""Line deduplication: of the lines that several documents hold, those of the first document stay.

Documents come in batches. The keys of all lines seen before are kept as runs: tables of 128-bit hashes, each sorted and
split into the same buckets, so that a batch's keys meet them by merge joins that move no run. A batch adds its own new
keys as one more run, and FANOUT runs of one level are merged to a run of the next: after n batches there are about
FANOUT * log(n) of them. All of it is DataFrame expressions; no Python runs on the rows.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import shared_folder
from .common import settled, table

#: Lines are told apart by their text without these at both ends, in lower case as far as ASCII letters go.
ENDS = " \t\n\x0b\x0c\r"
#: Lines whose key has fewer code points are left alone.
SHORTEST = 10
#: Parts of a table that is taken in at once; batches that come one by one are not cut.
BATCHES = 8
#: Runs of one level that are merged to one of the next.
FANOUT = 4
#: What documents without an id count as: one document, the last.
NO_ID = 2**63 - 1
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    stripped = F.trim(line, F.lit(ENDS))
    ascii_only = F.octet_length(stripped) == F.length(stripped)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(ascii_only, F.lower(stripped)).otherwise(F.translate(stripped, letters, letters.lower()))


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _doc(docs: DataFrame) -> DataFrame:
    """doc_id, text, doc (the id that lines are owned by) and tid (a hash of the text: rows may repeat an id)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("tid"))


def keyed_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc, tid, pos, h1, h2: the lines that are long enough to count, by the hashes of their keys."""
    each = _doc(docs).select("doc", "tid", F.posexplode(_split(F.col("text"))).alias("pos", "line"))
    keys = each.select("doc", "tid", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= shortest)
    return keys.select("doc", "tid", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


class LineRuns:
    """The keys of all batches so far, under a folder that outlives the session.

    A run is named by the batches that it covers. Runs are written once; one whose batches another run covers is left
    over from a merge and no longer read, so that a merge that was cut short, or a lost driver, changes nothing. Batches
    are added by one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.tables: dict[tuple[int, int, int], str] = {}
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def runs(self) -> list[tuple[int, int, int]]:
        """(first batch, last batch, buckets) of the runs that count, oldest first."""
        if not self._fs.exists(self._at()):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at())]
        found = [tuple(map(int, m.groups())) for n in names if (m := re.fullmatch(r"run-(\d+)-(\d+)-(\d+)", n)) and self._fs.exists(self._at(f"{n}/_SUCCESS"))]
        covered = lambda r: any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found)
        return sorted(r for r in found if not covered(r))

    def _name(self, run: tuple[int, int, int]) -> str:
        return "run-{}-{}-{}".format(*run)

    def read(self, run: tuple[int, int, int]) -> DataFrame:
        """h1, h2, doc of a run."""
        if run not in self.tables:
            self.tables[run] = f"line_run_{uuid.uuid4().hex}"
            self.spark.sql(
                f"create table {self.tables[run]} (h1 bigint, h2 bigint, doc bigint) using parquet options (path '{self.path}/{self._name(run)}') "
                f"clustered by (h1, h2) sorted by (h1, h2) into {run[2]} buckets"
            )
        return self.spark.table(self.tables[run])

    def _write(self, rows: DataFrame, first: int, last: int, buckets: int) -> DataFrame:
        run = (first, last, buckets)
        self._fs.delete(self._at(self._name(run)), True)  # what a cut-off attempt left
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{self._name(run)}").format("parquet").saveAsTable(name)
        self.tables[run] = name
        return self.spark.table(name)

    def add(self, lines: DataFrame) -> DataFrame:
        """The rows of lines (doc, h1, h2 and more), without h1 and h2, whose key an earlier batch has, or a smaller doc of this one; settled.

        Keys are summed up to one row each before they are sent. What stays is found again by key and document, so that a
        line that very many documents share is as well dealt out as any other.
        """
        runs = self.runs()
        batch = runs[-1][1] + 1 if runs else 0
        buckets = runs[-1][2] if runs else int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        new = lines.groupBy(*KEY).agg(F.min("doc").alias("doc"))
        for run in runs:
            seen = self.read(run).select(*KEY).hint("merge")
            # A condition on the minimum keeps Spark from joining before the keys are summed up.
            new = new.join(seen, (new["h1"] == seen["h1"]) & (new["h2"] == seen["h2"]) & new["doc"].isNotNull(), "left_anti")
        own = self._write(new, batch, batch, buckets)
        late = settled(lines.join(own, [*KEY, "doc"], "left_anti").drop(*KEY))
        self._merge()
        return late

    def _merge(self) -> None:
        while True:
            last = self.runs()[-self.fanout :]
            if len(last) < self.fanout or len({b - a for a, b, _ in last}) > 1:
                return
            rows = reduce(DataFrame.unionByName, map(self.read, last))
            self._write(rows.groupBy(*KEY).agg(F.min("doc").alias("doc")), last[0][0], last[-1][1], last[0][2])
            for run in last:
                self.spark.sql(f"drop table if exists {self.tables.pop(run)}")
                self._fs.delete(self._at(self._name(run)), True)

    def forget(self) -> None:
        """Drop the tables' names; the files stay."""
        for name in self.tables.values():
            self.spark.sql(f"drop table if exists {name}")
        self.tables = {}


def late_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, shortest: int = SHORTEST) -> DataFrame:
    """doc, tid, pos of the lines that a document with a smaller id holds, too.

    The table is hashed once, into ranges of ids of about the same size, which are added in order.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    shares = [i / batches for i in range(1, batches)]
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    bounds = docs.agg(F.percentile_approx(doc, shares).alias("b")).first()["b"] or [] if shares else []
    before = reduce(Column.__add__, [(F.lit(b) < F.col("doc")).cast("int") for b in bounds], F.lit(0))
    keyed_lines(docs, shortest).withColumn("batch", before).write.partitionBy("batch").parquet(f"{folder}/keyed")
    keyed = spark.read.schema("doc long, tid long, pos int, h1 long, h2 long, batch int").parquet(f"{folder}/keyed")
    runs = LineRuns(spark, f"{folder}/runs", fanout)
    late = [runs.add(keyed.where(F.col("batch") == i).drop("batch")) for i in range(len(set(bounds)) + 1 if bounds else 1)]
    runs.forget()
    return reduce(DataFrame.unionByName, late)


def without_late_lines(docs: DataFrame, late: DataFrame) -> DataFrame:
    """doc_id, text, n_lines, n_dropped: docs without the lines (doc, tid, pos)."""
    gone = late.groupBy("doc", "tid").agg(F.collect_set("pos").alias("gone"))
    rows = _doc(docs).join(gone.hint("shuffle_hash"), ["doc", "tid"], "left")
    rest = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: lines[i])
    joined = F.transform(F.array(_split(F.col("text"))), lambda lines: F.array_join(rest(lines), "\n"))[0]  # split once, named
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(joined)
    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return rows.select("doc_id", text.alias("text"), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, text, n_lines, n_dropped: each document without the lines that one with a smaller id has, too.

    Lines are told apart by 128 bits of their key; keys of fewer than `shortest` code points stay. A null text counts as
    empty, and an empty text has one empty line. Rows with one doc_id count as one document and keep each other's lines;
    those without an id count as one, the last. Repeated rows come back as often; other columns are ignored; an empty
    table gives no rows.
    """
    return without_late_lines(docs, late_lines(docs, batches, fanout, shortest))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the kept text of all documents; odd rows as in dedup_lines()."""
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = r"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
lines as (
  select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as line from docs
),
keyed as (
  select doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
),
owners as (select key, min(doc_id) as first from keyed where length(key) >= 10 group by key),
marked as (select keyed.*, coalesce(owners.first < keyed.doc_id, false) as late from keyed left join owners using (key))
select doc_id, count(*) as n_lines, count(*) filter (where late) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not late), '')) as kept_sha256
from marked group by doc_id
"""
