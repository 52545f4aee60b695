"""Whether log and shelf agree, both ways, and what would settle it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crypto
from ..functions.derive import is_address, is_id
from .catalog import served


def findings(log: DataFrame, records: DataFrame, tombstones: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """finding, id, why: a row for each log line without its record (missing) and each record without a line (unlogged)."""
    live = served(records, tombstones).select("id", F.col("digest").alias("_has"))
    gone = tombstones.select("id", F.lit(True).alias("_gone")).distinct()
    lines = log.select("id", "digest").join(live, "id", "left").join(gone, "id", "left")
    why = F.when(~is_id(F.col("id")), "not an id").when(F.col("_gone"), "tombstoned").when(F.col("_has").isNull(), "not found").when(F.col("_has") != F.col("digest"), "another digest")
    missing = lines.select(F.lit("missing").alias("finding"), "id", why.alias("why")).where("why is not null")
    logged = log.select("id").distinct()
    out = missing.unionByName(live.join(logged, "id", "left_anti").select(F.lit("unlogged").alias("finding"), "id", F.lit("no line").alias("why")))
    if unreadable is not None:
        out = out.unionByName(unreadable.join(logged, "id", "left_anti").select(F.lit("unreadable").alias("finding"), "id", "why"))
    return out


def summary(log: DataFrame, found: DataFrame) -> DataFrame:
    """logged, missing, unlogged, unreadable, clean, backfill_settles_it, predates_the_log"""
    count = lambda what: F.count_if(F.col("finding") == what).alias(what)
    counts = found.agg(count("missing"), count("unlogged"), count("unreadable"))
    logged = log.agg(F.countDistinct("id").alias("logged"))
    rows = logged.crossJoin(counts)  # one row each
    return rows.select(
        "*",
        ((F.col("missing") == 0) & (F.col("unlogged") == 0) & (F.col("unreadable") == 0)).alias("clean"),
        ((F.col("missing") == 0) & (F.col("unlogged") > 0)).alias("backfill_settles_it"),
        ((F.col("logged") == 0) & (F.col("unlogged") > 0)).alias("predates_the_log"),
    )


def backfill(log: DataFrame, records: DataFrame, tombstones: DataFrame, now: int, held: DataFrame) -> DataFrame:
    """id, digest, unix_time of lines that the log lacks. held: id, verdict, signed_at of evidence; where it is good and has a
    time, that counts, else now."""
    lacking = served(records, tombstones).join(log.select("id").distinct(), "id", "left_anti").select("id", "digest")
    time = F.when((F.col("verdict") == "ok") & (F.col("signed_at") != 0), F.col("signed_at")).otherwise(F.lit(now)).cast("long")
    return lacking.join(held.select("id", "verdict", "signed_at"), "id", "left").select("id", "digest", time.alias("unix_time"))


def products(records: DataFrame, blobs: DataFrame) -> DataFrame:
    """id, path, verdict of each product of each record. blobs: hex, sha (of the bytes kept under that name)."""
    each = records.select("id", F.explode("paths").alias("path"))
    each = each.withColumn("hex", F.when(is_address(F.col("path")), F.substring("path", 8, 64)))
    out = each.join(blobs.select("hex", "sha").distinct(), "hex", "left")
    verdict = F.when(F.col("hex").isNull(), "not write-once").when(F.col("sha").isNull(), "absent").when(F.col("sha") != F.col("hex"), "altered").otherwise("ok")
    return out.select("id", "path", verdict.alias("verdict"))


def first_failure(*checks: Column) -> Column:
    """The first of several reasons that isn't null."""
    return F.coalesce(*checks, F.lit("ok"))


@dataclass
class Host:
    """What a store asks of host sidecars: signers it accepts, whether it demands one, and its own host key, if any."""

    signers: tuple[bytes, ...] = ()
    required: bool = False
    key: bytes | None = None


def attested(records: DataFrame, sidecars: DataFrame, host: Host) -> DataFrame:
    """id, why: null if a record's host sidecar (id, raw) does what the host asks, else why not. records: id, payload, signed_at."""
    rows = records.select("id", "payload", "signed_at").join(sidecars.select("id", "raw"), "id", "left")
    message, kind = crypto.host_message(F.col("payload"), F.col("signed_at")), crypto.sidecar_kind(F.col("raw"))
    own = F.lit(False) if host.key is None else F.unhex(crypto.hmac_sha256(host.key, message)) == F.col("raw")
    given = F.unhex(F.regexp_extract(F.decode("raw", "ISO-8859-1"), r"\Aed25519:([0-9a-f]{128})", 1))
    made_by = crypto.signed_by(list(host.signers), F.when(kind == "signature", message), F.when(kind == "signature", given)) if host.signers else F.lit(None)
    rows = rows.withColumn("_signer", made_by)
    why = crypto.attestation(kind, F.coalesce(own, F.lit(False)), F.col("_signer").isNotNull(), host.required, host.key is not None)
    return rows.select("id", why.alias("why"))


def evidence(records: DataFrame, evidence_: DataFrame, product_verdicts: DataFrame, mac: Column, sidecars: DataFrame | None = None, host: Host | None = None) -> DataFrame:
    """id, verdict, signed_at: evidence there, products good, keyed hash right, producer and grants those of the record, host
    sidecar as the host asks; the first failure counts.

    evidence_: deed_id, signature, unix_time, produced_by, grants. Nulls agree with nulls only.
    """
    bad = product_verdicts.where("verdict <> 'ok'").groupBy("id").agg(F.min(F.concat("path", F.lit(" "), "verdict")).alias("_bad"))
    kept = evidence_.select(F.col("deed_id").alias("id"), "signature", F.col("unix_time").alias("signed_at"), F.col("produced_by").alias("_producer"), F.col("grants").alias("_grants"))
    out = records.join(kept, "id", "left").join(bad, "id", "left")
    if host is not None:
        empty = records.sparkSession.createDataFrame([], "id string, raw binary")
        out = out.join(attested(out, empty if sidecars is None else sidecars, host).withColumnRenamed("why", "_host"), "id", "left")
    same = lambda a, b: F.struct(*[a[n] for n in ("agent_id", "activity_id")]).eqNullSafe(F.struct(*[b[n] for n in ("agent_id", "activity_id")]))
    verdict = first_failure(
        F.when(F.col("signature").isNull(), "no evidence"),
        F.concat(F.lit("product "), "_bad"),
        F.when(F.col("signature") != mac, "keyed hash"),
        F.when(~same(F.col("_producer"), F.col("produced_by")), "another producer"),
        F.when(~F.col("_grants").eqNullSafe(F.col("grants")), "other grants"),
        F.col("_host") if host is not None else F.lit(None).cast("string"),
    )
    return out.select("id", verdict.alias("verdict"), "signed_at")


def verified(verdicts: DataFrame) -> DataFrame:
    """verified, n: how many records' evidence holds."""
    return verdicts.agg(F.count_if(F.col("verdict") == "ok").alias("verified"), F.count("*").alias("n"))


def over_trails(trail_: DataFrame, verdicts: DataFrame) -> DataFrame:
    """start, verdict: a record's evidence holds if that of all it came from does; the nearest failure counts."""
    each = trail_.join(verdicts.select(F.col("id").alias("node"), "verdict"), "node", "left")
    why = F.when(F.col("status") != "ok", F.col("status")).otherwise(F.coalesce("verdict", F.lit("no evidence")))
    worst = F.min(F.when(why != "ok", F.struct("depth", "node", why.alias("why"))))
    return each.groupBy("start").agg(worst.alias("w")).select("start", F.coalesce(F.concat("w.node", F.lit(" "), "w.why"), F.lit("ok")).alias("verdict"))


def successors_in_order(links: DataFrame) -> DataFrame:
    """prior, nth, new: all that supersede a record, in byte order."""
    return links.select("prior", F.row_number().over(Window.partitionBy("prior").orderBy("new")).alias("nth"), "new")
