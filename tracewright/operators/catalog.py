"""Listing, filtering and looking up records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.derive import body_json, is_address, is_id, label, plain_number, tag_texts
from . import names

#: How many candidates of a prefix are shown.
SHOWN = 8


def served(records: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Records, or other rows with an id, that no tombstone hides."""
    return records.join(tombstones.select("id"), "id", "left_anti")


def listing(records: DataFrame, tombstones: DataFrame) -> DataFrame:
    """All served records, in byte order of their ids."""
    return served(records, tombstones).orderBy("id")


def _fields() -> tuple[list[Column], list[Column]]:
    """What a search looks at: texts, and arrays of texts."""
    b = F.col("body")
    one = [F.col("name"), b["quote"]["excerpt"], b["set"]["title"], b["mailDraft"]["subject"], b["page"]["url"]]
    return one, [b["quote"]["urls"], F.transform(b["procedure"]["steps"], lambda s: s["text"])]


def searched() -> Column:
    """The texts of a record that a search looks at; none of them is null."""
    one, many = _fields()
    none = F.array().cast("array<string>")
    return F.array_compact(F.concat(F.array(*one), *(F.coalesce(c, none) for c in many)))


def text_matches(needle: str) -> Column:
    """Whether one of the searched fields holds the needle, whatever the case. Fields are not joined."""
    if not needle:
        return F.lit(True)
    low = F.lower(F.lit(needle))
    hit = lambda c: F.coalesce(F.contains(F.lower(c), low), F.lit(False))
    one, many = _fields()
    return reduce(Column.__or__, [*map(hit, one), *(F.coalesce(F.exists(c, hit), F.lit(False)) for c in many)])


def find(records: DataFrame, tombstones: DataFrame, kind: str | None = None, agent: str | None = None, text: str | None = None) -> DataFrame:
    """Served records that meet all conditions given. Kind and agent are exact; the scan gets them as filters."""
    out = records
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    if agent is not None:
        out = out.where(F.col("produced_by.agent_id") == agent)
    if text is not None:
        out = out.where(text_matches(text))
    return served(out, tombstones)


def get(asked: DataFrame, records: DataFrame, tombstones: DataFrame) -> DataFrame:
    """pos, id, status for rows pos, id: tombstoned, found, not found, or not an id."""
    there = records.select("id", F.lit(True).alias("_there"))
    gone = tombstones.select("id", F.lit(True).alias("_gone")).distinct()
    status = F.when(~is_id(F.col("id")), "not an id").when(F.col("_gone"), "tombstoned").when(F.col("_there"), "found").otherwise("not found")
    return asked.join(there, "id", "left").join(gone, "id", "left").select("pos", "id", status.alias("status"))


def resolve(asked: DataFrame, records: DataFrame, tombstones: DataFrame, log: DataFrame) -> DataFrame:
    """pos, raw, id, why for rows pos, raw.

    An id passes as it is. Otherwise raw must be an address: the greatest logged live record that still has that digest;
    else the greatest served record with that digest; else the only served record with that product.
    """
    return resolved(asked, names.of_records(records).unionByName(names.of_log(log)), tombstones)


def resolved(asked: DataFrame, named: DataFrame, tombstones: DataFrame) -> DataFrame:
    """resolve() by rows name, id, role (names.py), which may hold more than is asked for."""
    keys = asked.select(F.col("raw").alias("name")).where(is_address(F.col("name"))).distinct()
    hits = served(named.where("role <> 'id'").join(keys, "name", "left_semi"), tombstones)
    # By name and record first, so that of a product that very many records have a task sends one row on.
    is_ = lambda role: F.max(F.col("role") == role)
    each = hits.groupBy("name", "id").agg(is_("digest").alias("d"), is_("logged").alias("l"), is_("product").alias("p"))
    most = lambda c: F.max(F.when(c, F.col("id")))
    d, p = F.col("d"), F.col("p")
    found = each.groupBy(F.col("name").alias("raw")).agg(most(d & F.col("l")).alias("_log"), most(d).alias("_shelf"), F.count_if(p).alias("_n"), most(p).alias("_path"))
    out = asked.join(found, "raw", "left")
    raw = F.col("raw")
    digest_hit = F.coalesce("_log", "_shelf")
    found = F.when(is_id(raw), raw).when(digest_hit.isNotNull(), digest_hit).when(F.col("_n") == 1, F.col("_path"))
    why = F.when(found.isNotNull(), None).when(~is_address(raw), "not an id or address").when(F.col("_n") > 1, F.concat(F.lit("product of "), F.col("_n").cast("string"), F.lit(" records"))).otherwise("not found")
    return out.select("pos", "raw", found.alias("id"), why.alias("why"))


#: Different prefixes that are broadcast, at most.
FEW_PREFIXES = 1_000


def prefix_candidates(records: DataFrame, tombstones: DataFrame, asked: DataFrame, shown: int = SHOWN) -> DataFrame:
    """raw, n, longer, ids (the first `shown`) for prefixes raw of ids, digests or products.

    A few different prefixes are broadcast; more are joined by equality with the names' beginnings of the lengths asked.
    """
    return candidates(names.of_records(records), tombstones, asked, shown)


def candidates(named: DataFrame, tombstones: DataFrame, asked: DataFrame, shown: int = SHOWN) -> DataFrame:
    """prefix_candidates() by rows name, id, role (names.py), which may hold more than begins so."""
    named = served(named.where("role <> 'logged'"), tombstones).select("name", "id")
    prefixes = asked.select("raw").where("raw is not null").distinct()
    if prefixes.limit(FEW_PREFIXES + 1).count() <= FEW_PREFIXES:
        hits = named.join(F.broadcast(prefixes), F.col("name").startswith(F.col("raw")))
    else:
        longest = named.agg(F.coalesce(F.max(F.length("name")), F.lit(0))).first()[0]
        lengths = [r["n"] for r in prefixes.select(F.length("raw").alias("n")).where(F.col("n") <= longest).distinct().collect()]  # longest + 1 at most
        begun = named.select("id", "name", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("_n")).where(F.col("_n") <= F.length("name"))
        hits = begun.withColumn("raw", F.expr("substring(name, 1, _n)")).join(prefixes, "raw")
    each = hits.groupBy("raw", "id").agg(F.max(F.length("name") > F.length("raw")).alias("longer"))
    # A rank with a bound is kept to that many rows of a prefix in each task, before they are sent.
    counts = each.groupBy("raw").agg(F.count("*").alias("n"), F.max("longer").alias("longer"))
    first = each.select("raw", "id", F.row_number().over(Window.partitionBy("raw").orderBy("id")).alias("r")).where(F.col("r") <= shown)
    ids = first.groupBy("raw").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    return asked.join(counts, "raw", "left").join(ids, "raw", "left").select("raw", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("longer", F.lit(False)).alias("longer"), F.coalesce("ids", F.lit("")).alias("ids"))


def rows(records: DataFrame) -> DataFrame:
    """Flat rows: label, sources as text, agent, products."""
    return records.select(
        "id",
        "kind",
        label(F.col("kind"), F.col("name")).alias("label"),
        F.array_join("paths", ",").alias("paths"),
        F.array_join(tag_texts(F.col("sources")), ",").alias("sources"),
        F.col("produced_by.agent_id").alias("agent"),
        "face",
    )


def whole_rows(records: DataFrame) -> DataFrame:
    """Rows that carry all of a record: sources as text, agent, products, digest, and the body as JSON."""
    sources = tag_texts(F.col("sources")).alias("sources")
    return records.select("id", "kind", "name", "paths", sources, F.col("produced_by.agent_id").alias("agent"), "digest", body_json(F.col("kind"), F.col("body")).alias("body"))


def block(records: DataFrame) -> DataFrame:
    """id, block: the lines a listing prints for a record. A clip's sources, a form's fields and the steps themselves are left out."""
    b = F.col("body")
    join = lambda c: F.array_join(c, ",")
    dash = lambda c: F.coalesce(c, F.lit("-"))
    lines = {
        "file": [("file=", b["file"]["path"])],
        "set": [("title=", b["set"]["title"]), ("\nmembers=", join(b["set"]["members"]))],
        "quote": [("edition=", b["quote"]["edition"]), (" range=", b["quote"]["start"].cast("string")), ("-", b["quote"]["end"].cast("string")), ("\nexcerpt=", b["quote"]["excerpt"]), ("\nquoteUrls=", join(b["quote"]["urls"]))],
        "patch": [("tree=", b["patch"]["tree"]), ("\ndiffs=", join(b["patch"]["diffs"])), ("\nfunctionaries=", join(b["patch"]["functionaries"]))],
        "mailDraft": [("messageId=", b["mailDraft"]["message_id"]), ("\ninReplyTo=", dash(b["mailDraft"]["in_reply_to"])), ("\nsubject=", b["mailDraft"]["subject"])],
        "clip": [("clip=", b["clip"]["path"]), (" in=", plain_number(b["clip"]["in_point"])), (" out=", plain_number(b["clip"]["out_point"])), (" duration=", plain_number(b["clip"]["duration"]))],
        "page": [("page=", b["page"]["url"]), (" snapshot=", b["page"]["snapshot"])],
        "form": [("form=", b["form"]["blank"]), (" path=", b["form"]["path"])],
        "table": [("measures=", join(F.transform(b["table"]["measures"], lambda m: F.concat(m["name"], F.lit("="), m["value"]))))],
        "procedure": [("steps=", F.size(b["procedure"]["steps"]).cast("string"))],
        "event": [("when=", b["event"]["when"]), (" where=", b["event"]["where"]), (" who=", b["event"]["who"])],
    }
    tail = F.lit("")
    for kind, parts in lines.items():
        tail = F.when(F.col("kind") == kind, F.concat(*[x for head, value in parts for x in (F.lit(head), value)])).otherwise(tail)
    head = F.concat(
        F.lit("id="), "id", F.lit(" kind="), "kind", F.lit(" name="), "name",
        F.lit("\npaths="), join(F.col("paths")), F.lit("\nsources="), join(tag_texts(F.col("sources"))),
        F.lit("\nproducedBy="), "produced_by.agent_id", F.lit(" "), dash(F.col("produced_by.activity_id")),
        F.lit("\ngrants="), join(tag_texts(F.col("grants"))), F.lit("\nface="), "face", F.lit("\n"),
    )
    return records.select("id", F.concat(head, tail, F.lit("\n")).alias("block"))
