"""Records of all kinds from the star-schema tables: inputs for queries and tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import derive
from ..functions.encoding import KINDS, any_record_bytes, digest

TAGGED = "array<struct<tag:string,value:string>>"
PAIRS = "array<struct<name:string,value:string>>"
BODIES = {
    "file": "struct<path:string,media_type:string>",
    "set": "struct<title:string,members:array<string>>",
    "quote": "struct<edition:string,start:bigint,end:bigint,excerpt:string,urls:array<string>>",
    "patch": "struct<tree:string,diffs:array<string>,functionaries:array<string>>",
    "mailDraft": "struct<message_id:string,in_reply_to:string,subject:string,path:string>",
    "clip": "struct<sources:array<string>,in_point:double,out_point:double,duration:double,path:string>",
    "page": "struct<url:string,snapshot:string>",
    "form": f"struct<blank:string,fields:{PAIRS},path:string>",
    "table": f"struct<measures:{PAIRS}>",
    "procedure": "struct<steps:array<struct<text:string,done:boolean>>>",
    "event": "struct<when:string,where:string,who:string>",
}
BODY = "struct<" + ",".join(f"`{k}`:{BODIES[k]}" for k in KINDS) + ">"
RECORD = ("id", "kind", "name", "paths", "sources", "produced_by", "grants", "face", "body", "unix_time")
#: Time of the first record, and the writer's and the host's keys.
EPOCH = 1_700_000_000
WRITER_KEY, HOST_KEY = bytes(range(32)), bytes(range(32, 64))
HOST_SEED = bytes(32)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def address(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def struct_of(kind: str, **fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()]).cast(BODIES[kind])


def records(rows: DataFrame, kind: str, key: Column, name: Column, agent: Column, body: Column, time: Column, sources: Column | None = None) -> DataFrame:
    """rows as records of one kind, with everything derived that follows from a draft."""
    sources = F.array() if sources is None else sources
    body = F.struct(*[(body if k == kind else F.lit(None).cast(BODIES[k])).alias(k) for k in KINDS]).cast(BODY)
    made = rows.select(
        F.concat(F.lit(f"{derive.ID_PREFIX}{kind}-"), key).alias("id"),
        F.lit(kind).alias("kind"),
        name.alias("name"),
        sources.cast(TAGGED).alias("sources"),
        F.struct(agent.alias("agent_id"), F.lit(None).cast("string").alias("activity_id")).alias("produced_by"),
        F.array().cast(TAGGED).alias("grants"),
        time.cast("long").alias("unix_time"),
        body.alias("body"),
    )
    if kind == "quote":
        made = made.withColumn("sources", derive.with_quoted_urls(F.col("sources"), F.col("body.quote.urls")))
    made = made.withColumn("paths", derive.paths(F.col("kind"), F.col("body"))).withColumn("face", derive.face(F.col("kind"), F.col("body.file.media_type")))
    return made.select(*RECORD)


def _tag(tag: str, value: Column) -> Column:
    return F.struct(F.lit(tag).alias("tag"), value.alias("value"))


def _pair(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))


def _text(c: str | Column) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    body = struct_of("file", path=address(F.col("text")), media_type=F.lit("text/plain"))
    return records(d, "file", F.concat(F.lit("d"), _text("doc_id")), F.concat(F.lit("document "), _text("doc_id")), F.col("source"), body, EPOCH + F.col("doc_id"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    key = F.concat(F.lit("c"), _text("conv_id"), F.lit("-t"), _text("turn"))
    before = F.concat(F.lit(f"{derive.ID_PREFIX}quote-c"), _text("conv_id"), F.lit("-t"), _text(F.col("turn") - 1))
    url = F.concat(F.lit("https://conv.example/"), _text("conv_id"))
    body = struct_of("quote", edition=url, start=F.lit(0), end=F.octet_length("text"), excerpt=F.col("text"), urls=F.array(url))
    # The turn before, where there is one: turns count up from the least of their conversation.
    first = c.groupBy("conv_id").agg(F.min("turn").alias("_first"))
    c = c.join(first, "conv_id")
    sources = F.when(F.col("turn") > F.col("_first"), F.array(_tag("deed", before))).otherwise(F.array().cast(TAGGED))
    name = F.concat(F.lit("turn "), _text("turn"), F.lit(" of "), _text("conv_id"))
    return records(c, "quote", key, name, F.col("role"), body, EPOCH + F.col("conv_id") * 100 + F.col("turn"), sources)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "pages")
    body = struct_of("page", url=F.col("url"), snapshot=address(F.col("html")))
    return records(p, "page", F.concat(F.lit("p"), _text("page_id")), F.concat(F.lit("page "), _text("page_id")), F.lit("crawler"), body, EPOCH + F.col("page_id"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    body = struct_of("event", when=F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), where=F.col("event_type"), who=_text("user_id"))
    return records(e, "event", F.concat(F.lit("e"), _text("event_id")), F.concat(F.lit("event "), _text("event_id")), F.concat(F.lit("user "), _text("user_id")), body, EPOCH + F.col("event_id"))


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("v")).alias("line"))
    lines = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    o = load(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    measures = F.transform(F.coalesce("lines", F.array().cast("array<struct<l_linenumber:int,v:string>>")), lambda x: F.struct(F.concat(F.lit("line "), x["l_linenumber"].cast("string")).alias("name"), x["v"].alias("value")))
    return records(o, "table", F.concat(F.lit("o"), _text("o_orderkey")), F.concat(F.lit("order "), _text("o_orderkey")), F.col("o_orderpriority"), struct_of("table", measures=measures), EPOCH + F.col("o_orderkey"))


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    fields = F.array(_pair("name", F.col("c_name")), _pair("segment", F.col("c_mktsegment")), _pair("nation", F.col("c_nationkey")))
    body = struct_of("form", blank=F.lit("customer form"), fields=fields, path=address(F.col("c_name")))
    return records(c, "form", F.concat(F.lit("c"), _text("c_custkey")), F.col("c_name"), F.col("c_mktsegment"), body, EPOCH + F.col("c_custkey"))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    mid = derive.message_id(F.concat(F.lit(" <c"), _text("c_custkey"), F.lit("@example.com> ")))
    body = struct_of("mailDraft", message_id=mid, in_reply_to=F.lit(None), subject=F.concat(F.lit("To "), F.col("c_name")), path=address(F.concat(F.lit("mail "), F.col("c_name"))))
    return records(c, "mailDraft", F.concat(F.lit("c"), _text("c_custkey")), F.concat(F.lit("draft "), _text("c_custkey")), F.col("c_mktsegment"), body, EPOCH + F.col("c_custkey"))


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    r = load(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    members = F.transform(F.coalesce("names", F.array().cast("array<string>")), address)
    body = struct_of("set", title=F.concat(F.lit("Nations of "), F.col("r_name")), members=members)
    return records(r, "set", F.concat(F.lit("r"), _text("r_regionkey")), F.col("r_name"), F.lit("geography"), body, EPOCH + F.col("r_regionkey"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    body = struct_of("clip", sources=F.array(address(F.col("p_brand"))), in_point=F.lit(0.0), out_point=F.col("p_retailprice"), duration=F.col("p_size").cast("double"), path=address(F.col("p_name")))
    return records(p, "clip", F.concat(F.lit("p"), _text("p_partkey")), F.col("p_name"), F.col("p_brand"), body, EPOCH + F.col("p_partkey"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier")
    body = struct_of("patch", tree=F.col("s_name"), diffs=F.array(address(F.col("s_name"))), functionaries=F.array(F.concat(F.lit("nation "), _text("s_nationkey"))))
    return records(s, "patch", F.concat(F.lit("s"), _text("s_suppkey")), F.col("s_name"), F.concat(F.lit("nation "), _text("s_nationkey")), body, EPOCH + F.col("s_suppkey"))


def procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's kinds of events, in order of name; done if any of that kind has a positive value."""
    e = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.coalesce("value", F.lit(0.0))).alias("most"))
    step = F.struct(F.col("event_type").alias("text"), (F.col("most") > 0).alias("done"))
    e = e.groupBy("user_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return records(e, "procedure", F.concat(F.lit("u"), _text("user_id")), F.concat(F.lit("user "), _text("user_id")), F.concat(F.lit("user "), _text("user_id")), struct_of("procedure", steps=F.col("steps")), EPOCH + F.col("user_id"))


MAKERS = {"file": files, "set": sets, "quote": quotes, "patch": patches, "mailDraft": drafts, "clip": clips, "page": pages, "form": forms, "table": tables, "procedure": procedures, "event": events}


def shelf(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    return reduce(DataFrame.unionByName, (MAKERS[k](spark, sf_dir) for k in kinds))


def digested(records_: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """records with payload (canonical bytes) and digest."""
    return records_.withColumn("payload", any_record_bytes(kinds)).withColumn("digest", digest(F.col("payload")))


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of toxic documents."""
    toxic = load(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    return toxic.select(F.concat(F.lit(f"{derive.ID_PREFIX}file-d"), _text("doc_id")).alias("id"))


def unlogged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of poor documents, which the log lacks."""
    poor = load(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    return poor.select(F.concat(F.lit(f"{derive.ID_PREFIX}file-d"), _text("doc_id")).alias("id"))


def supersedes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """new, prior: each copy of a document supersedes the first with its text, each turn of a conversation the turn before."""
    d = load(spark, sf_dir, "documents").select("doc_id", address(F.col("text")).alias("path"))
    least = d.groupBy("path").agg(F.min("doc_id").alias("least"))
    name = lambda c: F.concat(F.lit(f"{derive.ID_PREFIX}file-d"), _text(c))
    copies = d.join(least, "path").where("doc_id > least").select(name("doc_id").alias("new"), name("least").alias("prior"))
    turns = quotes(spark, sf_dir).select(F.col("id").alias("new"), F.explode("sources").alias("s")).where("s.tag = 'deed'").select("new", F.col("s.value").alias("prior"))
    return copies.unionByName(turns)
