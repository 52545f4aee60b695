"""Bags: records on their way from one store to another, as tables; how they are made, checked and taken in.

A bag has these tables, Parquet folders of the same names on disk:

    records    the records' own columns, and the folder each lies in
    evidence, sidecars (id, raw), products (id, hex, content)
    links      id, sources, supersedes, successor: the texts of a folder's link files
    proofs     inclusion receipts
    head       one row: size, root, links, signer, signature; empty for an unsigned bag

Every verb is joins over whole tables. Failures are rows; what writes does so only if there are none.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import crypto
from ..functions.derive import is_address
from . import audit, catalog, handover, lineage, merkle
from .components import settled

#: What a head's signature starts with. A store may set its own.
HEAD_DOMAIN = "head-v1"
HEAD = "size long, root string, links string, signer string, signature string"


def head_message(size: int, root: str, links: str | None, domain: str = HEAD_DOMAIN) -> bytes:
    return f"{domain}\0{size} {root}".encode() + (b"" if links is None else b"\0" + links.encode())


@dataclass
class Bag:
    records: DataFrame
    evidence: DataFrame
    sidecars: DataFrame
    products: DataFrame
    links: DataFrame
    proofs: DataFrame
    head: DataFrame

    def write(self, path: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Bag:
        return cls(*(spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)))

    def settled(self) -> Bag:
        """The bag as it is now: what is checked is what is taken in, whatever becomes of its files. Products stay where they
        are; their hashes tell."""
        return Bag(*(getattr(self, f.name) if f.name == "products" else settled(getattr(self, f.name)) for f in fields(self)))

    def folders(self) -> DataFrame:
        """folder of each record, in byte order."""
        return self.records.select("folder").orderBy("folder")


def signed_head(spark: SparkSession, size: int, root: str, links: str | None, seed: bytes) -> DataFrame:
    key, signature = crypto.public_key(seed), crypto.sign(seed, head_message(size, root, links))
    return spark.createDataFrame([(size, root, links, key.hex(), signature.hex())], HEAD)


def head_complaint(head: DataFrame, size: int, root: str, links: str | None, has_links: bool, accepted: set[str]) -> str | None:
    """Why a bag's head isn't to be relied on, or None: unsigned, not covering what it names, of another log, not binding the
    link files, or by a signer who isn't accepted."""
    row = head.first()
    if row is None:
        return "head unsigned"
    key, signature = (bytes.fromhex(row[c]) for c in ("signer", "signature"))
    if not crypto.verify(key, head_message(row["size"], row["root"], row["links"]), signature):
        return "head signature"
    if (row["size"], row["root"]) != (size, root):
        return "head of another log"
    if row["links"] is None and has_links:
        return "links not covered"
    if row["links"] is not None and row["links"] != links:
        return "links changed"
    return None if row["signer"] in accepted else "signer not accepted"


def export(
    asked: DataFrame,
    records: DataFrame,
    evidence: DataFrame,
    sidecars: DataFrame,
    blobs: DataFrame,
    supersedes: DataFrame,
    tombstones: DataFrame,
    log: DataFrame,
    tree: DataFrame,
    size: int,
    seed: bytes | None = None,
) -> tuple[DataFrame, Bag]:
    """(id, status) of the asked ids, and the bag of those that are exported.

    status: exported, or the first of not found, tombstoned, not logged, logged otherwise, a product that isn't kept or was
    altered (blobs: hex, content), or a source that isn't there. The tree of the log is made once for all. Of an id that the
    log names twice the first line counts.
    """
    spark = records.sparkSession
    ids = asked.select("id").distinct()
    first = log.join(ids, "id", "left_semi").groupBy("id").agg(F.min_by(F.struct("idx", "digest", "unix_time"), "idx").alias("line"))
    gone = tombstones.select("id", F.lit(True).alias("_gone")).distinct()
    mine = records.join(ids, "id", "left_semi")
    kept = blobs.select("hex", F.sha2("content", 256).alias("sha"))
    bad = audit.products(mine, kept).where("verdict in ('absent', 'altered')").groupBy("id").agg(F.min(F.concat("verdict", F.lit(" "), "path")).alias("_bad"))
    walked = settled(lineage.trail(records, tombstones, mine.select("id")))
    lost = walked.where("status <> 'ok' and depth > 0").groupBy("start").agg(F.min(F.concat("status", F.lit(" source "), "node")).alias("_lost")).withColumnRenamed("start", "id")
    rows = ids.join(mine.select("id", F.col("digest").alias("_digest")), "id", "left").join(gone, "id", "left").join(first, "id", "left").join(bad, "id", "left").join(lost, "id", "left")
    status = (
        F.when(F.col("_gone"), "tombstoned")
        .when(F.col("_digest").isNull(), "not found")
        .when(F.col("line").isNull(), "not logged")
        .when(F.col("line.digest") != F.col("_digest"), "logged otherwise")
        .otherwise(F.coalesce("_bad", "_lost", F.lit("exported")))
    )
    answers = settled(rows.select("id", status.alias("status"), "line"))
    out = answers.where("status = 'exported'").select("id", "line")
    live = catalog.served(records, tombstones)
    chosen = live.join(out.select("id"), "id", "left_semi").withColumn("folder", F.col("id"))
    paths = chosen.select("id", F.explode("paths").alias("path")).where(is_address(F.col("path"))).select("id", F.substring("path", 8, 64).alias("hex")).distinct()
    digests = lineage.source_digests(walked, records)
    links = settled(handover.link_files(out.select("id"), digests, supersedes, live))
    root = merkle.head(tree, size).first()["root"]
    head = spark.createDataFrame([], HEAD)
    if seed is not None:
        bound = handover.link_commitment(links).first()["commitment"] if linked(links) else None
        head = signed_head(spark, size, root, bound, seed)
    return answers.select("id", "status"), Bag(
        chosen,
        evidence.join(out.select(F.col("id").alias("deed_id")), "deed_id", "left_semi"),
        sidecars.join(out.select("id"), "id", "left_semi"),
        paths.join(blobs.select("hex", "content"), "hex").select("id", "hex", "content"),
        links,
        merkle.receipts(out.select("id", "line.digest", "line.unix_time", "line.idx"), tree, size, root),
        head,
    )


def linked(links: DataFrame) -> bool:
    return not links.where("sources is not null or supersedes is not null or successor is not null").isEmpty()


def held_head(bag: Bag) -> tuple[int, str] | None:
    """The head that the bag is checked against: the signed one if its signature covers it, else that of the first receipt
    (by id) that leads to its own root."""
    row = bag.head.first()
    if row is not None and crypto.verify(bytes.fromhex(row["signer"]), head_message(row["size"], row["root"], row["links"]), bytes.fromhex(row["signature"])):
        return row["size"], row["root"]
    leaf = merkle.leaf(merkle.material(F.col("id"), F.col("digest"), F.col("unix_time")))
    good = bag.proofs.where(merkle.included(F.col("idx"), F.col("size"), leaf, F.col("path"), F.col("root"))).agg(F.min_by(F.struct("size", "root"), "id").alias("h")).first()["h"]
    return None if good is None else (good["size"], good["root"])


def complaints(bag: Bag, accepted: set[str] = frozenset(), allow_unsigned: bool = False) -> DataFrame:
    """folder, complaint: the first failure of every record, and those of the bag as a whole (folder empty).

    Of a record: its proof, its bytes against the proof, folder and names, its products, the head, the path up to it, its
    link files against the records carried beside it. Everything is looked at, whatever fails.
    """
    spark = bag.records.sparkSession
    held = held_head(bag)
    size, root = held or (0, merkle.EMPTY_ROOT)
    carried = bag.records.select("folder", "id", F.concat(F.lit("sha256:"), F.sha2("payload", 256)).alias("digest"))
    proven = handover.check(carried, bag.proofs, size, root).withColumnRenamed("id", "folder")
    kept = bag.products.select("id", "hex", F.sha2("content", 256).alias("sha"))
    each = bag.records.select("folder", "id", F.explode("paths").alias("path")).where(is_address(F.col("path"))).withColumn("hex", F.substring("path", 8, 64))
    products = each.join(kept, ["id", "hex"], "left").withColumn("why", F.when(F.col("sha").isNull(), "absent").when(F.col("sha") != F.col("hex"), "altered"))
    products = products.where("why is not null").groupBy("folder").agg(F.min(F.concat(F.lit("product "), "path", F.lit(" "), "why")).alias("product"))
    wrong = link_complaints(bag).groupBy("folder").agg(F.min("why").alias("link"))
    rows = proven.join(products, "folder", "left").join(wrong, "folder", "left")
    early = F.col("verdict").isin("no proof", "digest", "names")
    why = F.when(early, F.col("verdict")).otherwise(F.coalesce("product", F.when(F.col("verdict") != "ok", F.col("verdict")), "link"))
    out = rows.select("folder", why.alias("complaint")).where("complaint is not null")
    whole = []
    if held is None:
        whole.append("no proof leads to a head")
    has_links = linked(bag.links)
    bound = handover.link_commitment(bag.links).first()["commitment"] if has_links else None
    why_head = head_complaint(bag.head, size, root, bound, has_links, accepted)
    if why_head and not (allow_unsigned and why_head in ("head unsigned", "signer not accepted")):
        whole.append(why_head)
    said = _link_rows(bag)
    twice = said.where("side = 'supersedes' and digest is not null").groupBy(F.col("target").alias("new")).agg(F.countDistinct("digest").alias("n")).where("n > 1")
    out = out.unionByName(link_conflicts(said))
    out = out.unionByName(twice.select(F.lit("").alias("folder"), F.concat(F.lit("digests bound to "), "new").alias("complaint")))
    return out.unionByName(spark.createDataFrame([("", w) for w in whole], "folder string, complaint string"))


def _link_rows(bag: Bag) -> DataFrame:
    """folder, side, target, digest (null where a file names none) of every line of the link files."""
    sides = [bag.links.select("id", F.lit(side).alias("side"), F.explode(F.split(side, "\n")).alias("line")).where("line <> ''") for side in ("sources", "supersedes", "successor")]
    lines = sides[0].unionByName(sides[1]).unionByName(sides[2])
    parts = F.split("line", "\t")
    return lines.select(F.col("id").alias("folder"), "side", F.get(parts, F.lit(0)).alias("target"), F.get(parts, F.lit(1)).alias("digest"))


def link_conflicts(said: DataFrame) -> DataFrame:
    """folder (empty), complaint: records that a bag's link files (folder, side, target) have superseded by several others,
    superseding several, or superseding themselves, whichever side says so."""
    forward = said.where("side = 'supersedes'").select(F.col("folder").alias("new"), F.col("target").alias("prior"))
    links = forward.unionByName(said.where("side = 'successor'").select(F.col("target").alias("new"), F.col("folder").alias("prior"))).distinct()
    itself = links.where("new = prior").select(F.concat("new", F.lit(" supersedes itself")).alias("complaint"))
    several = handover.link_uniqueness(links.where("new <> prior"))
    told = F.concat("id", F.when(F.col("side") == "prior", " is superseded by ").otherwise(" supersedes "), F.col("n").cast("string"), F.lit(" records"))
    return several.select(told.alias("complaint")).unionByName(itself).select(F.lit("").alias("folder"), "complaint")


def needed(records: DataFrame) -> DataFrame:
    """id, hex of the products that records name."""
    return records.select("id", F.explode("paths").alias("path")).where(is_address(F.col("path"))).select("id", F.substring("path", 8, 64).alias("hex")).distinct()


def named_heads(bag: Bag) -> DataFrame:
    """id and the bag's signed head, for the records whose proof names the same log."""
    return bag.proofs.select("id", "size", "root").distinct().join(F.broadcast(bag.head.limit(1)), ["size", "root"]).select("id", "size", "root", "links", "signer", "signature")


def link_complaints(bag: Bag) -> DataFrame:
    """folder, why: link lines whose digest isn't that of the record carried under the name."""
    carried = bag.records.select(F.col("id").alias("target"), F.concat(F.lit("sha256:"), F.sha2("payload", 256)).alias("_carried"))
    rows = _link_rows(bag).where("digest is not null").join(carried, "target")
    return rows.where("digest <> _carried").select("folder", F.concat("side", F.lit(" "), "target").alias("why"))


def proven(bag: Bag, found: DataFrame) -> DataFrame:
    """proven, records: how many records no complaint names, of how many."""
    bad = found.where("folder <> ''").select("folder").distinct()
    n = bag.records.join(bad, "folder", "left_anti").agg(F.count("*").alias("proven"))
    return n.crossJoin(bag.records.agg(F.count("*").alias("records")))  # one row each


def refusals(bag: Bag, records: DataFrame, tombstones: DataFrame, log: DataFrame, supersedes: DataFrame, blobs: DataFrame, held_evidence: DataFrame, kept_heads: DataFrame, kept_signed: DataFrame | None = None) -> DataFrame:
    """id, action of every record of a checked bag: put, log, same, or why it is refused.

    Beyond import_plan(): products come from the store where it keeps them unaltered, else from the bag; a source that the
    bag doesn't carry must be the store's, with the digest named and good evidence (held_evidence: id, verdict); a record
    named as prior or successor that the store has must have the digest named; the store may not have another link on the
    same side; a proof kept for the record (kept_heads: id, size, root, digest, unix_time) must be of the same entry, and a
    signed head kept for it (kept_signed: id, size, root) of the log that this proof names, if the bag's own head is.
    """
    sent = bag.proofs.select("idx", "id", "digest", "unix_time")
    plan = handover.import_plan(bag.records.select("id", "digest"), sent, records, log, tombstones)
    own = records.select(F.col("id").alias("target"), F.col("digest").alias("_own"))
    inside = bag.records.select(F.col("id").alias("target"), F.lit(True).alias("_inside"))
    links = _link_rows(bag).join(own, "target", "left").join(inside, "target", "left").join(held_evidence.select(F.col("id").alias("target"), "verdict"), "target", "left")
    beside = links.where("_inside is null")
    why = (
        F.when((F.col("side") == "sources") & F.col("_own").isNull(), F.concat(F.lit("refused: source "), "target", F.lit(" absent")))
        .when(F.col("_own").isNotNull() & F.col("digest").isNotNull() & (F.col("_own") != F.col("digest")), F.concat(F.lit("refused: "), "side", F.lit(" "), "target", F.lit(" differs")))
        .when((F.col("side") == "sources") & (F.coalesce("verdict", F.lit("none")) != "ok"), F.concat(F.lit("refused: source "), "target", F.lit(" unproven")))
    )
    wrong = beside.withColumn("why", why).where("why is not null").groupBy(F.col("folder").alias("id")).agg(F.min("why").alias("_link"))
    mine = _link_rows(bag).where("side = 'supersedes'").select(F.col("folder").alias("new"), F.col("target").alias("prior"))
    theirs = supersedes.select(F.col("new").alias("_new"), "prior").distinct()
    clash = mine.join(theirs, "prior").where("new <> _new").groupBy(F.col("new").alias("id")).agg(F.lit("refused: prior already superseded").alias("_clash"))
    kept = blobs.select("hex", F.sha2("content", 256).alias("sha")).where("sha = hex").select("hex").distinct()
    need = needed(bag.records)
    carried = bag.products.select("hex", F.sha2("content", 256).alias("sha")).where("sha = hex").select("hex").distinct()
    missing = need.join(kept, "hex", "left_anti").join(carried, "hex", "left_anti").groupBy("id").agg(F.concat(F.lit("refused: product "), F.min("hex")).alias("_product"))
    entry = sent.select("id", F.col("digest").alias("_d"), F.col("unix_time").alias("_t"))
    unlike = kept_heads.join(entry, "id").where("digest <> _d or unix_time <> _t").groupBy("id").agg(F.lit("refused: another proof is kept").alias("_proof"))
    signed = named_heads(bag).select("id", "size", "root").join(kept_heads.select("id", "size", "root").distinct(), ["id", "size", "root"], "left_semi")
    held = kept_heads.sparkSession.createDataFrame([], "id string, size long, root string") if kept_signed is None else kept_signed
    other = signed.join(held.select("id", F.col("size").alias("_s"), F.col("root").alias("_r")), "id").where("size <> _s or root <> _r").groupBy("id").agg(F.lit("refused: another head is kept").alias("_head"))
    out = plan
    for t in (wrong, clash, missing, unlike, other):
        out = out.join(t, "id", "left")
    refused = F.when(F.col("action").startswith("refused"), F.col("action"))
    return out.select("id", F.coalesce(refused, "_link", "_clash", "_product", "_proof", "_head", "action").alias("action"))


def in_log_order(bag: Bag, rows: DataFrame) -> DataFrame:
    """nth, id, digest, unix_time: log lines of rows (id) in the sender's order, numbered from 0 by ranges."""
    lines = settled(bag.proofs.join(rows.select("id"), "id", "left_semi").groupBy("id").agg(F.min_by(F.struct("idx", "digest", "unix_time"), "idx").alias("l")).select("id", "l.*"))
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = settled(lines.repartitionByRange(n, "idx").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # as many rows as ranges
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("idx")) - 1
    return parts.withColumn("_nth", nth).join(F.broadcast(starts), "_part").select((F.col("_start") + F.col("_nth")).alias("nth"), "id", "digest", "unix_time")
