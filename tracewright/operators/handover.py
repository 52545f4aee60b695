"""Handing records from one store to another: what a bag holds, whether it checks, and what importing it would do."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.derive import is_address
from ..functions.encoding import framed
from . import merkle

#: What the commitment to a bag's link files starts with. A store may set its own.
LINKS_DOMAIN = "links-v1"
#: Fixed value of RFC 3161: a request, version 1, for a SHA-256 imprint, up to the imprint itself.
TIMESTAMP_PREFIX = bytes.fromhex("30360201013031300d060960864801650304020105000420")


def link_files(ids: DataFrame, digests: DataFrame, supersedes: DataFrame, live: DataFrame) -> DataFrame:
    """id, sources, supersedes, successor: the texts of a folder's link files; null where there is none.

    digests: start, node, digest of what a record came from. A supersedes file names the prior and its digest; a
    successor file the first live record that supersedes this one.
    """
    line = F.concat("node", F.lit("\t"), "digest", F.lit("\n"))
    sources = digests.groupBy("start").agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("sources"))
    known = live.select(F.col("id").alias("prior"), F.col("digest").alias("_d"))
    prior = supersedes.join(known, "prior", "left").groupBy("new").agg(F.min(F.concat("prior", F.coalesce(F.concat(F.lit("\t"), "_d"), F.lit("")), F.lit("\n"))).alias("supersedes"))
    following = supersedes.join(live.select(F.col("id").alias("new")), "new", "left_semi").groupBy("prior").agg(F.concat(F.min("new"), F.lit("\n")).alias("successor"))
    out = ids.select("id").join(sources, F.col("id") == F.col("start"), "left").drop("start")
    out = out.join(prior, F.col("id") == F.col("new"), "left").drop("new")
    return out.join(following, F.col("id") == F.col("prior"), "left").select("id", "sources", "supersedes", "successor")


def _framed_text(name: str) -> Column:
    c = F.col(name)
    return F.concat(F.lit(f"{name}\n"), F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit("\n"), c), F.lit("-\n")))


def link_commitment(files: DataFrame, domain: str = LINKS_DOMAIN) -> DataFrame:
    """commitment: one digest of all folders' link files, folders in byte order.

    Spark makes and range-sorts the folders' texts; the driver hashes them as they come, one partition at a time, so that
    the transcript is never put together. It is computed when this is called.
    """
    folder = F.concat(F.octet_length("id").cast("string"), F.lit("\n"), "id", _framed_text("sources"), _framed_text("supersedes"), _framed_text("successor"))
    hashed = hashlib.sha256(f"{domain}\0".encode())
    for row in files.select("id", folder.alias("t")).where("t is not null").orderBy("id", "t").select("t").toLocalIterator():
        hashed.update(row["t"].encode())
    return files.sparkSession.createDataFrame([(hashed.hexdigest(),)], "commitment string")


def check(bag: DataFrame, receipts: DataFrame, size: int, root: str) -> DataFrame:
    """id, verdict for a bag of records (folder, id, digest of the bytes carried): its proof present, its bytes those of the
    proof, folder and names agreeing, and the proof leading to the head. The first failure of each counts."""
    proof = receipts.select(F.col("id").alias("proof_id"), F.col("digest").alias("proof_digest"), F.col("unix_time").alias("proof_time"), "idx", F.col("size").alias("proof_size"), F.col("root").alias("proof_root"), "path")
    rows = bag.join(proof, F.col("folder") == F.col("proof_id"), "left")
    leaf = merkle.leaf(merkle.material(F.col("proof_id"), F.col("proof_digest"), F.col("proof_time")))
    proven = merkle.included(F.col("idx"), F.col("proof_size"), leaf, F.col("path"), F.col("proof_root"))
    verdict = (
        F.when(F.col("proof_id").isNull(), "no proof")
        .when(F.col("digest") != F.col("proof_digest"), "digest")
        .when((F.col("id") != F.col("proof_id")) | (F.col("folder") != F.col("id")), "names")
        .when((F.col("proof_size") != size) | (F.col("proof_root") != root), "head")
        .when(~proven, "path")
        .otherwise("ok")
    )
    return rows.select(F.col("folder").alias("id"), verdict.alias("verdict"))


def head_agreement(receipts: DataFrame) -> DataFrame:
    """heads, agree: how many different heads the receipts name."""
    return receipts.agg(F.countDistinct("size", "root").alias("heads")).select("heads", (F.col("heads") <= 1).alias("agree"))


def conflicts(log: DataFrame) -> DataFrame:
    """id, versions of ids that a log names with more than one digest or time."""
    return log.groupBy("id").agg(F.countDistinct("digest", "unix_time").alias("versions")).where("versions > 1")


def link_uniqueness(supersedes: DataFrame) -> DataFrame:
    """side, id, n: records that several supersede (prior), and those that supersede several (new)."""
    each = supersedes.select("new", "prior").distinct()
    many = lambda side: each.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(side).alias("side"), "id", "n")
    return many("prior").unionByName(many("new"))


def import_plan(bag: DataFrame, bag_log: DataFrame, records: DataFrame, log: DataFrame, tombstones: DataFrame) -> DataFrame:
    """id, action for each record of a checked bag: put, log, same, or why it is refused.

    bag: id, digest. bag_log, log: idx, id, digest, unix_time. Of an id that a log names twice the first line counts; a bag
    whose lines of an id disagree is refused. A second import of the same bag finds everything the same.
    """
    entry = F.struct("digest", "unix_time")
    own = records.select("id", F.col("digest").alias("_own"))
    line = log.groupBy("id").agg(F.min_by(entry, "idx").alias("_line"))
    sent = bag_log.groupBy("id").agg(F.min_by(entry, "idx").alias("_sent"), F.countDistinct("digest", "unix_time").alias("_versions"))
    gone = tombstones.select("id", F.lit(True).alias("_gone")).distinct()
    rows = bag.select("id", "digest").join(own, "id", "left").join(line, "id", "left").join(sent, "id", "left").join(gone, "id", "left")
    action = (
        F.when(F.col("_gone"), "refused: tombstoned")
        .when(F.col("_versions") > 1, "refused: sent twice")
        .when(F.col("_own") != F.col("digest"), "refused: frozen")
        .when(F.col("_line").isNotNull() & F.col("_sent").isNotNull() & (F.col("_line") != F.col("_sent")), "refused: logged otherwise")
        .when(F.col("_own").isNull(), "put")
        .when(F.col("_line").isNull(), "log")
        .otherwise("same")
    )
    return rows.select("id", action.alias("action"))


def manifests(records: DataFrame, blobs: DataFrame) -> DataFrame:
    """id, kind, hash, status of each record: for files, sets and clips the digest of their products' bytes in order.

    blobs: hex, content. A record of another kind, or one of whose products isn't kept or isn't write-once, has a status
    that says so and no hash.
    """
    leaves = F.col("kind").isin("file", "set", "clip")
    each = records.where(leaves).select("id", F.posexplode("paths").alias("at", "path"))
    each = each.withColumn("hex", F.when(is_address(F.col("path")), F.substring("path", 8, 64))).join(blobs.select("hex", "content"), "hex", "left")
    missing = F.min(F.when(F.col("content").isNull(), F.struct("at", F.concat(F.lit("absent "), "path").alias("why"))))["why"]
    found = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "content"))).alias("parts"), missing.alias("missing"))
    whole = F.aggregate("parts", F.lit(b"").cast("binary"), lambda done, p: F.concat(done, p["content"]))
    rows = records.select("id", "kind").join(found, "id", "left")
    status = F.when(~leaves, "not left").otherwise(F.coalesce("missing", F.lit("ok")))
    hashed = F.when(status == "ok", F.sha2(F.coalesce(whole, F.lit(b"").cast("binary")), 256))
    return rows.select("id", "kind", hashed.alias("hash"), status.alias("status"))


def timestamp_request(file: Column) -> Column:
    """An RFC 3161 request for a time stamp over an evidence file."""
    return F.concat(F.lit(TIMESTAMP_PREFIX), F.unhex(F.sha2(file, 256)))


def ingest(new: DataFrame, kept: DataFrame) -> DataFrame:
    """hex, content of those of new contents (path, content) that aren't kept (hex) yet, each once."""
    named = new.where(F.col("content").isNotNull()).select(F.sha2("content", 256).alias("hex"), "content")
    return named.groupBy("hex").agg(F.first("content").alias("content")).join(kept.select("hex"), "hex", "left_anti")


def addressed(drafts: DataFrame, new: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """drafts with local paths replaced by the addresses of what they hold, in columns of a path or of an array of paths.

    new: path, content. A path that isn't among them stays as it is. The order of arrays stays.
    """
    known = new.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("_address")).dropDuplicates(["path"])
    out = drafts
    for c in columns:
        if drafts.schema[c].dataType.typeName() == "array":
            rows = out.withColumn("_row", F.monotonically_increasing_id())
            each = rows.select("_row", F.posexplode(c).alias("_at", "path")).join(known, "path", "left")
            lists = each.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_address", "path").alias("p")))).alias("_new"))
            out = rows.join(lists, "_row", "left").withColumn(c, F.when(F.col("_new").isNotNull(), F.col("_new.p")).otherwise(F.col(c))).drop("_row", "_new")
        else:
            out = out.join(known.withColumnRenamed("path", "_path"), F.col(c) == F.col("_path"), "left").withColumn(c, F.coalesce("_address", c)).drop("_path", "_address")
    return out.select(*drafts.columns)
