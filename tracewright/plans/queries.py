"""The registered queries over the corpus, each with the same query in DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import crypto, derive
from ..functions.encoding import KINDS, WITH_EVIDENCE, evidence_bytes, evidence_file
from ..operators import audit, bags, catalog, grams, handover, lineage, merkle, names
from ..operators.components import settled, shared_folder
from . import corpus, oracle
from .corpus import EPOCH, WRITER_KEY
from .oracle import LOG, SUPERSEDES, TOMBSTONES, UNLOGGED, digested_sql, log_sql, nodes_sql, records_sql, told_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
LINKED = ("file", "quote")
LOGGED_SQL = log_sql(LINKED, UNLOGGED)
LIVE = f"SELECT * FROM ({digested_sql(LINKED)}) AS r WHERE id NOT IN ({TOMBSTONES})"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _live_sql(where: str = "TRUE") -> str:
    return f"SELECT id, kind, name, agent FROM ({records_sql()}) AS r WHERE id NOT IN ({TOMBSTONES}) AND {where}"


def _found(df: DataFrame) -> DataFrame:
    return df.select("id", "kind", "name", F.col("produced_by.agent_id").alias("agent"))


# Catalog ------------------------------------------------------------------------------------------------------------


@query("catalog_list", _live_sql())
def catalog_list(spark: SparkSession, d: str) -> DataFrame:
    return _found(catalog.listing(corpus.shelf(spark, d), corpus.tombstones(spark, d)))


@query("find_kind", _live_sql("kind = 'page'"))
def find_kind(spark: SparkSession, d: str) -> DataFrame:
    return _found(catalog.find(corpus.shelf(spark, d), corpus.tombstones(spark, d), kind="page"))


@query("find_agent", _live_sql("agent = 'src0'"))
def find_agent(spark: SparkSession, d: str) -> DataFrame:
    return _found(catalog.find(corpus.shelf(spark, d), corpus.tombstones(spark, d), agent="src0"))


def _text_sql(needle: str) -> str:
    return f"(contains(lower(name), '{needle}') OR len(list_filter(search, lambda t: contains(lower(t), '{needle}'))) > 0)"


@query("find_text", _live_sql(_text_sql("the")))
def find_text(spark: SparkSession, d: str) -> DataFrame:
    return _found(catalog.find(corpus.shelf(spark, d), corpus.tombstones(spark, d), text="The"))


NEEDLES = ["the", "To", "e", "qz", "nations of", "customer#00000000", "nothing has this", "https://"]


@query(
    "find_texts_indexed",
    f"SELECT needle, id FROM (SELECT unnest([{', '.join(repr(n) for n in NEEDLES)}]) AS needle) AS n, ({records_sql()}) AS r WHERE id NOT IN ({TOMBSTONES}) AND (contains(lower(name), lower(needle)) OR len(list_filter(search, lambda t: contains(lower(t), lower(needle)))) > 0)",
)
def find_texts_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Several needles by the substring index, written once, its postings and texts opened where they can hold one."""
    base, folder = shared_folder(spark), f"grams-{uuid.uuid4().hex}"
    texts, runs = (settled(s) for s in grams.write(grams.texts_of(corpus.shelf(spark, d)), base, folder))
    hits = grams.matches(spark, base, texts, runs, spark.createDataFrame([(n,) for n in NEEDLES], "needle string"))
    return catalog.served(hits, corpus.tombstones(spark, d)).select("needle", "id")


@query("find_conjunction", _live_sql("kind = 'quote' AND agent = 'user' AND " + _text_sql("is")))
def find_conjunction(spark: SparkSession, d: str) -> DataFrame:
    return _found(catalog.find(corpus.shelf(spark, d), corpus.tombstones(spark, d), kind="quote", agent="user", text="IS"))


ASKED_IDS = f"SELECT doc_id AS pos, CASE doc_id % 3 WHEN 0 THEN '{derive.ID_PREFIX}file-d' || doc_id WHEN 1 THEN '{derive.ID_PREFIX}file-d' || (doc_id + 1000000) ELSE 'file-' || doc_id END AS id FROM documents"


def _asked_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that are there, that are not, and texts that are none."""
    key = F.col("doc_id").cast("string")
    far = (F.col("doc_id") + 1_000_000).cast("string")
    p = f"{derive.ID_PREFIX}file-d"
    id_ = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(p), key)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(p), far)).otherwise(F.concat(F.lit("file-"), key))
    return corpus.load(spark, d, "documents").select(F.col("doc_id").alias("pos"), id_.alias("id"))


@query(
    "get_status",
    f"SELECT pos, id, CASE WHEN NOT regexp_matches(id, '^{derive.ID_PREFIX}({'|'.join(KINDS)})-[a-z0-9-]+$') THEN 'not an id' WHEN id IN ({TOMBSTONES}) THEN 'tombstoned' "
    f"WHEN id IN (SELECT '{derive.ID_PREFIX}file-d' || doc_id FROM documents) THEN 'found' ELSE 'not found' END AS status FROM ({ASKED_IDS})",
)
def get_status(spark: SparkSession, d: str) -> DataFrame:
    return catalog.get(_asked_ids(spark, d), corpus.files(spark, d), corpus.tombstones(spark, d))


RESOLVE_SQL = (
    f"WITH r AS MATERIALIZED ({digested_sql(('file',))}), live AS MATERIALIZED (SELECT * FROM r WHERE id NOT IN ({TOMBSTONES})), log AS (SELECT id, digest FROM r WHERE id NOT IN ({UNLOGGED})), "
    "asked AS ({asked}), inlog AS (SELECT digest AS raw, max(id) AS i FROM live SEMI JOIN log USING (id, digest) GROUP BY 1), onshelf AS (SELECT digest AS raw, max(id) AS i FROM live GROUP BY 1), "
    "paths AS (SELECT p AS raw, count(DISTINCT id) AS n, max(id) AS i FROM (SELECT id, unnest(paths) AS p FROM live) GROUP BY 1) "
    "SELECT pos, raw, CASE WHEN starts_with(raw, 'deed-') THEN raw ELSE coalesce(inlog.i, onshelf.i, CASE WHEN n = 1 THEN paths.i END) END AS id, "
    "CASE WHEN starts_with(raw, 'deed-') OR coalesce(inlog.i, onshelf.i) IS NOT NULL OR n = 1 THEN NULL WHEN NOT regexp_matches(raw, '^sha256:[0-9a-f]{{64}}$') THEN 'not an id or address' WHEN n > 1 THEN 'product of ' || n || ' records' ELSE 'not found' END AS why "
    "FROM asked LEFT JOIN inlog USING (raw) LEFT JOIN onshelf USING (raw) LEFT JOIN paths USING (raw)"
)


def _resolved(spark: SparkSession, d: str, asked: DataFrame, records: DataFrame) -> DataFrame:
    log = records.join(corpus.unlogged(spark, d), "id", "left_anti").select("id", "digest")
    return catalog.resolve(asked, records, corpus.tombstones(spark, d), log)


ASKED_DIGESTS = "SELECT substr(id, 12)::BIGINT AS pos, digest AS raw FROM r UNION ALL SELECT -1, 'sha256:' || repeat('0', 64) UNION ALL SELECT -2, 'deed-file-unseen' UNION ALL SELECT -3, 'sha256:xyz'"


def _asked_digests(spark: SparkSession, records: DataFrame) -> DataFrame:
    asked = records.select(F.substring("id", 12, 20).cast("long").alias("pos"), F.col("digest").alias("raw"))
    odd = spark.createDataFrame([(-1, "sha256:" + "0" * 64), (-2, "deed-file-unseen"), (-3, "sha256:xyz")], "pos long, raw string")
    return asked.unionByName(odd)


@query("resolve_digest", RESOLVE_SQL.format(asked=ASKED_DIGESTS))
def resolve_digest(spark: SparkSession, d: str) -> DataFrame:
    records = corpus.digested(corpus.files(spark, d), ("file",))
    return _resolved(spark, d, _asked_digests(spark, records), records)


def _indexed(spark: SparkSession, records: DataFrame, log: DataFrame | None = None) -> tuple[str, DataFrame]:
    """A name index of records and log in the shared folder: where it is, and its sections."""
    base, folder = shared_folder(spark), f"names-{uuid.uuid4().hex}"
    rows = names.of_records(records)
    return base, settled(names.write(rows if log is None else rows.unionByName(names.of_log(log)), base, folder))


@query("resolve_indexed", RESOLVE_SQL.format(asked=f"{ASKED_DIGESTS} UNION ALL SELECT substr(id, 12)::BIGINT + 1000000000, paths[1] FROM r"))
def resolve_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Digests and products through the name index, written once and opened where it can hold them."""
    records = settled(corpus.digested(corpus.files(spark, d), ("file",)).select("id", "digest", "paths"))
    base, sections = _indexed(spark, records, records.join(corpus.unlogged(spark, d), "id", "left_anti"))
    products = records.select((F.substring("id", 12, 20).cast("long") + 1_000_000_000).alias("pos"), F.col("paths")[0].alias("raw"))
    asked = _asked_digests(spark, records).unionByName(products)
    return catalog.resolved(asked, names.looked_up(spark, base, sections, asked.withColumnRenamed("raw", "name")), corpus.tombstones(spark, d))


@query("resolve_product_path", RESOLVE_SQL.format(asked="SELECT substr(id, 12)::BIGINT AS pos, paths[1] AS raw FROM r"))
def resolve_product_path(spark: SparkSession, d: str) -> DataFrame:
    records = corpus.digested(corpus.files(spark, d), ("file",))
    return _resolved(spark, d, records.select(F.substring("id", 12, 20).cast("long").alias("pos"), F.col("paths")[0].alias("raw")), records)


PREFIXES_SQL = (
    f"WITH live AS MATERIALIZED (SELECT id, list_distinct(list_concat([id, digest], paths)) AS names FROM ({LIVE}) AS l), asked AS (SELECT unnest(['deed-file-d1', 'sha256:a', 'deed-quote-c7-', 'nothing']) AS raw), "
    "each AS (SELECT raw, id, max(strlen(name)) > strlen(raw) AS longer FROM asked, (SELECT id, unnest(names) AS name FROM live) WHERE starts_with(name, raw) GROUP BY raw, id), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY id) AS r FROM each) "
    "SELECT raw, count(id) AS n, coalesce(bool_or(longer), FALSE) AS longer, coalesce(string_agg(id, ',' ORDER BY id) FILTER (r <= 8), '') AS ids FROM asked LEFT JOIN ranked USING (raw) GROUP BY raw"
)
PREFIXES = [("deed-file-d1",), ("sha256:a",), ("deed-quote-c7-",), ("nothing",)]


@query("prefix_candidates", PREFIXES_SQL)
def prefix_candidates(spark: SparkSession, d: str) -> DataFrame:
    records = corpus.digested(corpus.shelf(spark, d, LINKED), LINKED)
    return catalog.prefix_candidates(records, corpus.tombstones(spark, d), spark.createDataFrame(PREFIXES, "raw string"))


@query("prefix_indexed", PREFIXES_SQL)
def prefix_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Prefixes through the name index: the files whose range can hold a name that begins so."""
    base, sections = _indexed(spark, corpus.digested(corpus.shelf(spark, d, LINKED), LINKED))
    asked = spark.createDataFrame(PREFIXES, "raw string")
    return catalog.candidates(names.looked_up(spark, base, sections, asked.withColumnRenamed("raw", "name"), prefix=True), corpus.tombstones(spark, d), asked)


@query("flatten_rows", f"SELECT id, kind, kind || ' · ' || name AS label, array_to_string(paths, ',') AS paths, array_to_string(sources, ',') AS sources, agent, face FROM ({records_sql()}) AS r")
def flatten_rows(spark: SparkSession, d: str) -> DataFrame:
    return catalog.rows(corpus.shelf(spark, d))


_HEAD = "'id=' || id || ' kind=' || kind || ' name=' || name || chr(10) || 'paths=' || array_to_string(paths, ',') || chr(10) || 'sources=' || array_to_string(sources, ',') || chr(10) || 'producedBy=' || agent || ' -' || chr(10) || 'grants=' || chr(10) || 'face=' || face || chr(10)"


@query(
    "record_blocks",
    f"SELECT id, {_HEAD} || CASE WHEN kind = 'file' THEN 'file=' || paths[1] ELSE 'page=' || search[1] || ' snapshot=' || paths[1] END || chr(10) AS block FROM ({records_sql(('file', 'page'))}) AS r",
)
def record_blocks(spark: SparkSession, d: str) -> DataFrame:
    return catalog.block(corpus.shelf(spark, d, ("file", "page")))


_TOLD = " UNION ALL ".join(f"({told_sql(k)})" for k in KINDS)


@query("record_blocks_all", f"SELECT id, {_HEAD} || lines || chr(10) AS block FROM ({records_sql()}) AS r JOIN ({_TOLD}) AS t USING (id)")
def record_blocks_all(spark: SparkSession, d: str) -> DataFrame:
    return catalog.block(corpus.shelf(spark, d))


#: Clips hold doubles, whose bits SQL does not give, and so have no digest in SQL.
WITH_DIGEST = tuple(k for k in KINDS if k != "clip")


def _joined(rows: DataFrame) -> DataFrame:
    """Lists as text, which compares alike everywhere."""
    return rows.withColumns({c: F.array_join(c, ",") for c in ("paths", "sources")})


@query("record_rows", f"SELECT id, kind, name, array_to_string(paths, ',') AS paths, array_to_string(sources, ',') AS sources, agent, digest, body FROM ({digested_sql(WITH_DIGEST)}) AS r JOIN ({_TOLD}) AS t USING (id)")
def record_rows(spark: SparkSession, d: str) -> DataFrame:
    return _joined(catalog.whole_rows(corpus.digested(corpus.shelf(spark, d, WITH_DIGEST), WITH_DIGEST)))


@query("clip_rows", f"SELECT id, kind, name, array_to_string(paths, ',') AS paths, array_to_string(sources, ',') AS sources, agent, body FROM ({records_sql(('clip',))}) AS r JOIN ({told_sql('clip')}) AS t USING (id)")
def clip_rows(spark: SparkSession, d: str) -> DataFrame:
    return _joined(catalog.whole_rows(corpus.digested(corpus.shelf(spark, d, ("clip",)), ("clip",)))).drop("digest")


# Derived columns ------------------------------------------------------------------------------------------------------


@query("mint_ids", "SELECT p_partkey, 'deed-clip-' || coalesce(nullif(trim(regexp_replace(lower(regexp_replace(p_name || ' ! ' || p_type, '[^A-Za-z0-9 _-]', '', 'g')), '[ _-]+', '-', 'g'), '-'), ''), 'item') AS id FROM part")
def mint_ids(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" ! "), "p_type")
    return corpus.load(spark, d, "part").select("p_partkey", derive.mint_id(F.lit("clip"), name).alias("id"))


MEDIA = ("text/plain", " Audio/MP3 ", "video/x", "message/rfc822", "image/svg+xml", "application/pdf", "application/x-source", "application/json", "application/xhtml+xml", "", "application/zip")


@query(
    "face_of_media",
    f"SELECT doc_id, media, CASE WHEN regexp_matches(m, '^(audio|video)/') THEN 'waveform' WHEN m IN ('message/rfc822', 'message/rfc2822') THEN 'letter' WHEN starts_with(m, 'image/') OR m = 'application/pdf' THEN 'document' "
    "WHEN starts_with(m, 'text/') OR contains(m, 'source') OR m IN ('application/javascript', 'application/json', 'application/x-rust') OR ends_with(m, '+xml') THEN 'syntax' ELSE 'document' END AS face "
    f"FROM (SELECT doc_id, media, lower(trim(media)) AS m FROM (SELECT doc_id, {list(MEDIA)}[(doc_id % {len(MEDIA)})::INT + 1] AS media FROM documents))",
)
def face_of_media(spark: SparkSession, d: str) -> DataFrame:
    media = F.get(F.array(*map(F.lit, MEDIA)), (F.col("doc_id") % len(MEDIA)).cast("int"))
    return corpus.load(spark, d, "documents").select("doc_id", media.alias("media")).withColumn("face", derive.face(F.lit("file"), F.col("media")))


@query("validate_tables", "SELECT 'deed-table-o' || o_orderkey AS id, CASE WHEN count(l_orderkey) = 0 THEN 'table: no measures' END AS fault FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def validate_tables(spark: SparkSession, d: str) -> DataFrame:
    return corpus.tables(spark, d).select("id", derive.fault(F.col("kind"), F.col("body")).alias("fault"))


@query(
    "validate_quotes",
    "SELECT 'deed-quote-c' || conv_id || '-t' || turn AS id, CASE WHEN trim(text) = '' THEN 'quote: excerpt is blank' WHEN turn * 40 > strlen(text) THEN 'quote: start is after end' WHEN conv_id % 5 = 0 THEN 'quote: a url is not one' END AS fault FROM conversations",
)
def validate_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotes from ever later places, and every fifth conversation without a scheme in its url."""
    q = corpus.load(spark, d, "conversations")
    url = F.when(F.col("conv_id") % 5 == 0, "conv.example/0").otherwise("https://conv.example/0")
    body = corpus.struct_of("quote", edition=F.lit("first"), start=F.col("turn") * 40, end=F.octet_length("text"), excerpt=F.col("text"), urls=F.array(url))
    whole = F.struct(*[(body if k == "quote" else F.lit(None).cast(corpus.BODIES[k])).alias(k) for k in KINDS]).cast(corpus.BODY)
    id_ = F.concat(F.lit("deed-quote-c"), F.col("conv_id").cast("string"), F.lit("-t"), F.col("turn").cast("string"))
    return q.select(id_.alias("id"), derive.fault(F.lit("quote"), whole).alias("fault"))


@query("validate_all", "SELECT id, CASE WHEN kind = 'table' AND id IN (SELECT 'deed-table-o' || o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) THEN 'table: no measures' END AS fault FROM (" + records_sql(tuple(k for k in KINDS if k not in ("set", "quote"))) + ") AS r")
def validate_all(spark: SparkSession, d: str) -> DataFrame:
    return corpus.shelf(spark, d, tuple(k for k in KINDS if k not in ("set", "quote"))).select("id", derive.fault(F.col("kind"), F.col("body")).alias("fault"))


@query(
    "message_ids",
    "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '<c' || c_custkey || '@example.com>' WHEN 1 THEN '<c' || c_custkey || '@localhost>' END AS message_id FROM customer",
)
def message_ids(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("  c"), key, F.lit("@example.com "))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("<c"), key, F.lit("@localhost>")))
    raw = raw.when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("c"), key, F.lit("@nodot"))).otherwise(F.concat(F.lit("c "), key, F.lit("@example.com")))
    return corpus.load(spark, d, "customer").select("c_custkey", derive.message_id(raw).alias("message_id"))


@query("url_predicates", "SELECT page_id, regexp_matches(u, '^(https?|file)://') AND strlen(u) >= 8 AS is_url FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'ftp://' || page_id ELSE substr(url, 1, (page_id % 9)::INT) END AS u FROM pages)")
def url_predicates(spark: SparkSession, d: str) -> DataFrame:
    u = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("ftp://"), F.col("page_id").cast("string"))).otherwise(F.expr("substr(url, 1, cast(page_id % 9 as int))"))
    return corpus.load(spark, d, "pages").select("page_id", derive.is_url(u).alias("is_url"))


@query("set_members_sources", "SELECT 'deed-set-r' || r_regionkey AS id, count(n_name) AS members FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def set_members(spark: SparkSession, d: str) -> DataFrame:
    return corpus.sets(spark, d).select("id", F.size("body.set.members").cast("long").alias("members"))


# Canonical bytes ------------------------------------------------------------------------------------------------------


def _digest_query(kind: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return corpus.digested(corpus.MAKERS[kind](spark, d), (kind,)).select("id", "digest")

    query(f"digest_{kind}", None if kind == "clip" else f"SELECT id, digest FROM ({digested_sql((kind,))}) AS r")(run)


for _kind in KINDS:
    _digest_query(_kind)


# Log and proofs -------------------------------------------------------------------------------------------------------


def _log(spark: SparkSession, d: str, kinds: tuple[str, ...] = ("file",)) -> DataFrame:
    return settled(merkle.log_of(corpus.digested(corpus.shelf(spark, d, kinds), kinds)))


@query("log_entries", log_sql())
def log_entries(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d)


@query("leaf_hashes", nodes_sql(log_sql()) + "SELECT idx, h AS hash FROM leaves")
def leaf_hashes(spark: SparkSession, d: str) -> DataFrame:
    return merkle.leaves(_log(spark, d)).select("idx", F.lower(F.hex("hash")).alias("hash"))


def _tree(spark: SparkSession, d: str, kinds: tuple[str, ...] = ("file",)) -> tuple[DataFrame, DataFrame, int]:
    log = _log(spark, d, kinds)
    n = log.count()
    return log, settled(merkle.nodes(merkle.leaves(log), n)), n


@query("merkle_nodes", nodes_sql(log_sql()) + "SELECT level, idx, h AS hash FROM nodes")
def merkle_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d)[1].select("level", "idx", F.lower(F.hex("hash")).alias("hash"))


@query("tree_append", nodes_sql(log_sql()) + "SELECT level, idx, h AS hash FROM nodes")
def tree_append(spark: SparkSession, d: str) -> DataFrame:
    """The same nodes, of a tree that is kept and grows by three appends, of which none reads the leaves before it."""
    log = settled(_log(spark, d))
    n, size = log.count(), 0
    kept = spark.createDataFrame([], "level int, idx long, hash binary")
    for upto in (n // 3, n // 3 + 1, n):
        new = merkle.leaves(log.where((F.col("idx") >= size) & (F.col("idx") < upto)))
        kept = settled(kept.unionByName(merkle.grown(new, size, upto - size, merkle.chosen(kept, merkle.peaks(size)))))
        size = upto
    return merkle.whole(kept, n).select("level", "idx", F.lower(F.hex("hash")).alias("hash"))


_HEAD_SQL = "SELECT n AS size, (SELECT h FROM nodes WHERE level = (SELECT top FROM size) AND idx = 0) AS root FROM size"


@query("log_head", nodes_sql(log_sql()) + _HEAD_SQL)
def log_head(spark: SparkSession, d: str) -> DataFrame:
    _, tree, n = _tree(spark, d)
    return merkle.head(tree, n)


@query("log_head_events", nodes_sql(log_sql(("event",))) + _HEAD_SQL)
def log_head_events(spark: SparkSession, d: str) -> DataFrame:
    _, tree, n = _tree(spark, d, ("event",))
    return merkle.head(tree, n)


@query("log_head_prefix", nodes_sql(log_sql(), "WHERE idx < 150") + _HEAD_SQL)
def log_head_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The head when the log had 150 entries."""
    old = settled(merkle.leaves(_log(spark, d)).where("idx < 150"))
    n = old.count()
    return merkle.head(merkle.nodes(old, n), n)


_STEPS = (
    "steps AS (SELECT l.idx, n.level, n.h FROM (SELECT idx, unnest(range((SELECT top FROM size))) AS level FROM log) AS l JOIN nodes AS n ON n.level = l.level AND n.idx = xor(l.idx >> l.level, 1)) "
)


@query(
    "inclusion_proofs",
    nodes_sql(log_sql()).rstrip() + ", " + _STEPS + "SELECT id, idx, (SELECT n FROM size) AS size, coalesce(string_agg(h, ',' ORDER BY level), '') AS path FROM log LEFT JOIN steps USING (idx) GROUP BY id, idx",
)
def inclusion_proofs(spark: SparkSession, d: str) -> DataFrame:
    log, tree, n = _tree(spark, d)
    return merkle.receipts(log, tree, n, "").select("id", "idx", "size", F.array_join("path", ",").alias("path"))


@query("verify_inclusion", f"SELECT id, (row_number() OVER (ORDER BY unix_time, id) - 1) % 7 <> 3 AS verified FROM ({digested_sql(('file',))}) AS r")
def verify_inclusion(spark: SparkSession, d: str) -> DataFrame:
    """Proofs of all entries, every seventh with another time than the log's."""
    log, tree, n = _tree(spark, d)
    r = merkle.receipts(log, tree, n, merkle.head(tree, n).first()["root"])
    time = F.col("unix_time") + F.when(F.col("idx") % 7 == 3, 1).otherwise(0)
    leaf = merkle.leaf(merkle.material(F.col("id"), F.col("digest"), time))
    return r.select("id", merkle.included(F.col("idx"), F.col("size"), leaf, F.col("path"), F.col("root")).alias("verified"))


QUARTERS = "SELECT DISTINCT greatest(1, n * k // 4) AS old FROM size, (SELECT unnest([1, 2, 3, 4]) AS k)"
_PREFIXES = (
    nodes_sql(log_sql()).rstrip() + f", olds AS MATERIALIZED (SELECT old, CASE WHEN old < 2 THEN 0 ELSE ceil(log2(old))::INT END AS t FROM ({QUARTERS})), "
    "part(old, t, level, idx, h) AS (SELECT old, t, 0, idx::BIGINT, h FROM olds JOIN leaves ON idx < old UNION ALL "
    "SELECT old, t, level + 1, idx // 2, CASE WHEN count(*) = 2 THEN sha256(unhex('01' || arg_min(h, idx) || arg_max(h, idx))) ELSE min(h) END FROM part WHERE level < t GROUP BY old, t, level, idx // 2) "
)


@query("log_is_prefix", _PREFIXES + "SELECT old, h AS was, (SELECT h FROM nodes WHERE level = (SELECT top FROM size) AND idx = 0) AS now FROM part WHERE level = t AND idx = 0")
def log_is_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Bridges from every quarter of the log to the whole; the new root counts only if the proof leads to it."""
    _, tree, n = _tree(spark, d)
    rows = []
    for old in sorted({max(1, n * k // 4) for k in (1, 2, 3, 4)}):
        start, end, path = merkle.bridge(spark, tree, old, n)
        rows.append((*start, *end, *start, *end, path))
    changes = merkle.head_change(spark.createDataFrame(rows, merkle.HEADS))
    return changes.select(F.col("kept_size").alias("old"), F.col("kept_root").alias("was"), F.when(F.col("change").isin("same", "grown"), F.col("root")).alias("now"))


_EVERY_PREFIX = (
    nodes_sql(log_sql()).rstrip() + ", olds AS MATERIALIZED (SELECT idx + 1 AS old, CASE WHEN idx < 1 THEN 0 ELSE ceil(log2(idx + 1))::INT END AS t FROM log), "
    "part(old, t, level, idx, h) AS (SELECT old, t, 0, idx::BIGINT, h FROM olds JOIN leaves ON idx < old UNION ALL "
    "SELECT old, t, level + 1, idx // 2, CASE WHEN count(*) = 2 THEN sha256(unhex('01' || arg_min(h, idx) || arg_max(h, idx))) ELSE min(h) END FROM part WHERE level < t GROUP BY old, t, level, idx // 2), "
    "was AS (SELECT old, h FROM part WHERE level = t AND idx = 0) "
)


@query(
    "prefix_bridges",
    _EVERY_PREFIX + "SELECT w.old, CASE WHEN w.old = (SELECT n FROM size) THEN 'same' WHEN coalesce(c.h, w.h) = w.h THEN 'grown' ELSE 'not a prefix' END AS change FROM was w LEFT JOIN was c ON c.old = w.old - 1 AND w.old % 7 = 3",
)
def prefix_bridges(spark: SparkSession, d: str) -> DataFrame:
    """What every earlier head of the log is to the log as it is now, by a proof each; of some the head before is claimed in its place."""
    log, tree, n = _tree(spark, d)
    heads = settled(merkle.every_head(merkle.leaves(log), tree, n))
    claimed = heads.where("old % 7 = 2").select((F.col("old") + 1).alias("old"), F.col("root").alias("claimed"))
    rows = merkle.bridges(heads, tree, n).join(heads, "old").join(claimed, "old", "left").withColumn("was", F.coalesce("claimed", "root"))
    now = merkle.head(tree, n).first()["root"]
    old = F.col("old").cast("long")
    asked = rows.select(old.alias("kept_size"), F.col("was").alias("kept_root"), F.lit(n).cast("long").alias("size"), F.lit(now).alias("root"), old.alias("from_size"), F.col("was").alias("from_root"), F.lit(n).cast("long").alias("to_size"), F.lit(now).alias("to_root"), "path")
    return merkle.head_change(asked).select(F.col("kept_size").alias("old"), "change")


@query(
    "consistency_proof",
    nodes_sql(log_sql()).rstrip() + ", o AS (SELECT greatest(1, n * 3 // 5)::BIGINT AS old, n, top FROM size), b AS (SELECT *, bit_count((old & -old) - 1)::INT AS base FROM o), "
    "w AS (SELECT base AS level, (old >> base) - 1 AS idx, 0 AS k FROM b WHERE old >> base > 1 AND old < n UNION ALL "
    "SELECT level, xor((old - 1) >> level, 1::BIGINT), 1 FROM (SELECT *, unnest(range(base, top))::INT AS level FROM b) WHERE xor((old - 1) >> level, 1::BIGINT) <= (n - 1) >> level AND old < n) "
    "SELECT (row_number() OVER (ORDER BY k, level) - 1)::INT AS pos, w.level, w.idx, h AS hash FROM w JOIN nodes USING (level, idx)",
)
def consistency_proof(spark: SparkSession, d: str) -> DataFrame:
    _, tree, n = _tree(spark, d)
    return merkle.consistency(spark, tree, max(1, n * 3 // 5), n)


# Lineage --------------------------------------------------------------------------------------------------------------

_TRAIL = (
    f"WITH RECURSIVE r AS MATERIALIZED (SELECT id, sources FROM ({records_sql(LINKED)}) AS q), edges AS (SELECT id AS a, substr(s, 6) AS b FROM (SELECT id, unnest(sources) AS s FROM r) WHERE starts_with(s, 'deed:')), "
    "walk(start, node) AS (SELECT id, id FROM r UNION SELECT start, b FROM walk JOIN edges ON node = a), "
    f"trail AS (SELECT start, node, CASE WHEN node IN ({TOMBSTONES}) THEN 'tombstoned' WHEN node IN (SELECT id FROM r) THEN 'ok' ELSE 'missing' END AS status FROM walk) "
)


def _trail(spark: SparkSession, d: str) -> DataFrame:
    records = corpus.shelf(spark, d, LINKED)
    return lineage.trail(records, corpus.tombstones(spark, d), records.select("id"))


@query("trail_closure", _TRAIL + "SELECT start, node, status FROM trail")
def trail_closure(spark: SparkSession, d: str) -> DataFrame:
    return _trail(spark, d).select("start", "node", "status")


@query("trail_status", _TRAIL + "SELECT start, count(*) AS reached, coalesce(min(CASE WHEN status <> 'ok' THEN status || ' ' || node END), 'ok') AS status FROM trail GROUP BY start")
def trail_status(spark: SparkSession, d: str) -> DataFrame:
    return lineage.trail_status(_trail(spark, d))


@query("trail_digests", _TRAIL + f", d AS MATERIALIZED (SELECT id, digest FROM ({digested_sql(LINKED)}) AS q) SELECT start, node, digest FROM trail JOIN d ON d.id = node WHERE start <> node")
def trail_digests(spark: SparkSession, d: str) -> DataFrame:
    return lineage.source_digests(_trail(spark, d), corpus.digested(corpus.shelf(spark, d, LINKED), LINKED))


_CURRENT = (
    f"WITH RECURSIVE live AS MATERIALIZED (SELECT id FROM ({records_sql(LINKED)}) AS q WHERE id NOT IN ({TOMBSTONES})), edges AS MATERIALIZED (SELECT DISTINCT prior AS a, new AS b FROM ({SUPERSEDES}) AS x WHERE new IN (SELECT id FROM live)), "
    "walk(start, node) AS (SELECT id, id FROM live UNION SELECT start, b FROM walk JOIN edges ON node = a), "
    "tips AS (SELECT start, count(*) AS n, string_agg(node, ',' ORDER BY node) AS ids FROM walk WHERE node NOT IN (SELECT a FROM edges) GROUP BY start) "
)


def _walks(spark: SparkSession, d: str) -> DataFrame:
    live = catalog.served(corpus.shelf(spark, d, LINKED), corpus.tombstones(spark, d)).select("id")
    return lineage.current(lineage.successor_edges(live, corpus.supersedes(spark, d)), live)


@query("current_walk", _CURRENT + "SELECT start, CASE WHEN n > 1 THEN 'fork' ELSE 'tip' END AS outcome, ids FROM tips")
def current_walk(spark: SparkSession, d: str) -> DataFrame:
    return _walks(spark, d)


@query("current_forks", _CURRENT + "SELECT start, ids FROM tips WHERE n > 1")
def current_forks(spark: SparkSession, d: str) -> DataFrame:
    return _walks(spark, d).where("outcome = 'fork'").select("start", "ids")


@query("current_summary", _CURRENT + "SELECT count(*) FILTER (n > 1 OR ids = start) AS current, count(*) AS n FROM tips")
def current_summary(spark: SparkSession, d: str) -> DataFrame:
    return lineage.current_summary(_walks(spark, d))


@query(
    "current_cycles",
    "WITH o AS (SELECT o_custkey AS c, string_agg('o' || o_orderkey, ',' ORDER BY 'o' || o_orderkey) AS ids FROM orders GROUP BY 1) "
    "SELECT 'o' || o_orderkey AS start, 'cycle' AS outcome, ids FROM orders JOIN o ON o_custkey = c "
    "UNION ALL SELECT 'c' || c_custkey, CASE WHEN ids IS NULL THEN 'tip' ELSE 'cycle' END, coalesce(ids, 'c' || c_custkey) FROM customer LEFT JOIN o ON c_custkey = c",
)
def current_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders in a circle, an order to the customer's next and the last to the first; customers lead to their last order."""
    named = lambda c, name: F.concat(F.lit(c), F.col(name).cast("string"))
    orders = corpus.load(spark, d, "orders").select("o_custkey", "o_orderkey", named("o", "o_orderkey").alias("a"))
    turn = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    first = orders.groupBy("o_custkey").agg(F.min_by("a", "o_orderkey").alias("first"), F.max_by("a", "o_orderkey").alias("last"))
    circle = orders.withColumn("next", F.lead("a").over(turn)).join(first, "o_custkey").select("a", F.coalesce("next", "first").alias("b"))
    customers = corpus.load(spark, d, "customer").select("c_custkey", named("c", "c_custkey").alias("a"))
    edges = circle.unionByName(customers.join(first, F.col("c_custkey") == F.col("o_custkey")).select("a", F.col("last").alias("b")))
    return lineage.current(edges, orders.select(F.col("a").alias("id")).unionByName(customers.select(F.col("a").alias("id"))))


# Audit ----------------------------------------------------------------------------------------------------------------

_AUDIT = (
    f"WITH r AS MATERIALIZED (SELECT id, digest, unix_time FROM ({digested_sql(LINKED)}) AS q), live AS (SELECT * FROM r WHERE id NOT IN ({TOMBSTONES})), log AS (SELECT id, digest FROM r WHERE id NOT IN ({UNLOGGED})), "
    "found AS (SELECT 'missing' AS finding, id, 'tombstoned' AS why FROM log WHERE id NOT IN (SELECT id FROM live) UNION ALL SELECT 'unlogged', id, 'no line' FROM live WHERE id NOT IN (SELECT id FROM log)) "
)


def _audited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    records = corpus.digested(corpus.shelf(spark, d, LINKED), LINKED).select("id", "digest", "unix_time")
    return records.join(corpus.unlogged(spark, d), "id", "left_anti"), records, corpus.tombstones(spark, d)


@query("audit_findings", _AUDIT + "SELECT finding, id, why FROM found")
def audit_findings(spark: SparkSession, d: str) -> DataFrame:
    return audit.findings(*_audited(spark, d))


@query(
    "audit_summary",
    _AUDIT + ", c AS (SELECT (SELECT count(DISTINCT id) FROM log) AS logged, count(*) FILTER (finding = 'missing') AS missing, count(*) FILTER (finding = 'unlogged') AS unlogged, 0::BIGINT AS unreadable FROM found) "
    "SELECT *, missing = 0 AND unlogged = 0 AS clean, missing = 0 AND unlogged > 0 AS backfill_settles_it, logged = 0 AND unlogged > 0 AS predates_the_log FROM c",
)
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    log, records, gone = _audited(spark, d)
    return audit.summary(log, audit.findings(log, records, gone))


@query("backfill_plan", _AUDIT + f"SELECT id, digest, CASE WHEN starts_with(id, 'deed-file') AND substr(id, 12)::BIGINT % 3 = 1 THEN {EPOCH - 9} ELSE unix_time END AS unix_time FROM live WHERE id NOT IN (SELECT id FROM log)")
def backfill_plan(spark: SparkSession, d: str) -> DataFrame:
    """Lines with the time of the evidence; now for every third file, whose evidence fails."""
    log, records, gone = _audited(spark, d)
    bad = F.col("id").startswith("deed-file") & (F.substring("id", 12, 20).cast("long") % 3 == 1)
    held = records.select("id", F.when(bad, "keyed hash").otherwise("ok").alias("verdict"), F.col("unix_time").alias("signed_at"))
    return audit.backfill(log, records, gone, EPOCH - 9, held)


# Evidence -------------------------------------------------------------------------------------------------------------

_PADS = tuple(bytes(k ^ p for k in WRITER_KEY.ljust(64, b"\0")).hex() for p in (0x36, 0x5C))
_MAC = f"sha256(unhex('{_PADS[1]}' || sha256(unhex('{_PADS[0]}' || payload || {oracle.le('unix_time', 8)}))))"


@query("evidence_mac", f"SELECT id, {_MAC} AS mac FROM ({digested_sql(('file', 'page'))}) AS r")
def evidence_mac(spark: SparkSession, d: str) -> DataFrame:
    records = corpus.digested(corpus.shelf(spark, d, ("file", "page")), ("file", "page"))
    return records.select("id", crypto.evidence_mac(WRITER_KEY, F.col("payload"), F.col("unix_time")).alias("mac"))


def _blobs(spark: SparkSession, d: str) -> DataFrame:
    """Kept products: all texts but every eleventh; every thirteenth altered."""
    docs = corpus.load(spark, d, "documents")
    first = docs.groupBy(F.sha2("text", 256).alias("hex")).agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    return first.where("doc_id % 11 <> 5").select("hex", F.when(F.col("doc_id") % 13 == 6, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("hex")).alias("sha"), F.col("text").cast("binary").alias("content"))


_BLOBS = "SELECT sha256(text) AS hex, CASE WHEN min(doc_id) % 13 = 6 THEN sha256(min(text) || '!') ELSE sha256(text) END AS sha, min(text) AS content FROM documents GROUP BY sha256(text) HAVING min(doc_id) % 11 <> 5"
_PRODUCTS = f"SELECT id, path, CASE WHEN sha IS NULL THEN 'absent' WHEN sha <> hex THEN 'altered' ELSE 'ok' END AS verdict FROM (SELECT id, paths[1] AS path, substr(paths[1], 8) AS h FROM ({oracle.rows_sql('file')}) AS q) AS f LEFT JOIN ({_BLOBS}) AS b ON b.hex = f.h"


@query("product_check", _PRODUCTS)
def product_check(spark: SparkSession, d: str) -> DataFrame:
    return audit.products(corpus.files(spark, d), _blobs(spark, d))


@query(
    "evidence_verdict",
    f"SELECT id, CASE WHEN n % 17 = 8 THEN 'no evidence' WHEN verdict <> 'ok' THEN 'product ' || path || ' ' || verdict WHEN n % 19 = 9 THEN 'keyed hash' WHEN n % 23 = 11 THEN 'another producer' ELSE 'ok' END AS verdict FROM (SELECT *, substr(id, 12)::BIGINT AS n FROM ({_PRODUCTS}) AS p)",
)
def evidence_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of all files, some without, some with a wrong keyed hash or another producer."""
    records = corpus.digested(corpus.files(spark, d), ("file",))
    mac = crypto.evidence_mac(WRITER_KEY, F.col("payload"), F.col("unix_time"))
    n = F.substring("id", 12, 20).cast("long")
    kept = records.where(n % 17 != 8).select(
        F.col("id").alias("deed_id"),
        F.when(n % 19 == 9, F.concat(F.lit("0"), mac)).otherwise(mac).alias("signature"),
        "unix_time",
        _producer(F.when(n % 23 == 11, "other").otherwise(F.col("produced_by.agent_id"))),
        "grants",
    )
    return audit.evidence(records, kept, audit.products(records, _blobs(spark, d)), mac).select("id", "verdict")


def _producer(agent: Column, activity: Column | None = None) -> Column:
    return F.struct(agent.alias("agent_id"), (F.lit(None).cast("string") if activity is None else activity).alias("activity_id")).alias("produced_by")


@query(
    "evidence_full",
    "SELECT id, CASE WHEN n % 17 = 8 THEN 'no evidence' WHEN n % 19 = 9 THEN 'another producer' WHEN n % 23 = 11 THEN 'another producer' WHEN n % 29 = 12 THEN 'another producer' WHEN n % 31 = 13 THEN 'other grants' "
    "WHEN k = 1 THEN CASE WHEN n % 2 = 1 THEN 'host keyed hash' END WHEN k = 2 THEN 'host sidecar unreadable' WHEN k = 3 THEN CASE WHEN n % 2 = 1 THEN 'host signature' END WHEN k = 0 THEN 'host sidecar' END AS why "
    f"FROM (SELECT *, page_id AS n, page_id % 4 AS k, '{derive.ID_PREFIX}page-p' || page_id AS id FROM pages)",
)
def evidence_full(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of all pages with producers, activities and grants that agree or don't, nulls among them, and host sidecars of every kind."""
    n = F.substring("id", 12, 20).cast("long")
    records = corpus.digested(corpus.pages(spark, d), ("page",))
    mac = crypto.evidence_mac(WRITER_KEY, F.col("payload"), F.col("unix_time"))
    own = F.col("produced_by.agent_id")
    agent = F.when(n % 19 == 9, F.lit(None).cast("string")).when(n % 23 == 11, "other").otherwise(own)
    grants = F.when(n % 31 == 13, F.array(F.struct(F.lit("host").alias("tag"), F.lit("h").alias("value")))).otherwise(F.col("grants"))
    kept = records.where(n % 17 != 8).select(F.col("id").alias("deed_id"), mac.alias("signature"), "unix_time", _producer(agent, F.when(n % 29 == 12, "some activity")), grants.alias("grants"))
    message = crypto.host_message(F.concat("payload", F.when(n % 2 == 1, F.lit(b"!")).otherwise(F.lit(b""))), F.col("unix_time"))
    signature = F.concat(F.lit("ed25519:"), F.lower(F.hex(crypto.signed(corpus.HOST_SEED, F.when(n % 4 == 3, message))))).cast("binary")
    raw = F.when(n % 4 == 1, F.unhex(crypto.hmac_sha256(corpus.HOST_KEY, message))).when(n % 4 == 2, F.lit(b"ed25519:xx")).when(n % 4 == 3, signature)
    sidecars = records.select("id", raw.alias("raw")).where("raw is not null")
    none = spark.createDataFrame([], "id string, path string, verdict string")
    host = audit.Host((crypto.public_key(corpus.HOST_SEED),), False, corpus.HOST_KEY)
    found = audit.evidence(records, kept, none, mac, sidecars, host)
    return found.select("id", F.when(F.col("verdict") != "ok", F.col("verdict")).alias("why"))


@query("evidence_summary", "SELECT count(*) FILTER (verdict = 'ok') AS verified, count(*) AS n FROM (SELECT CASE WHEN page_id % 5 = 2 THEN 'keyed hash' ELSE 'ok' END AS verdict FROM pages)")
def evidence_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many pages' evidence holds; that of every fifth has a wrong keyed hash."""
    records = corpus.digested(corpus.pages(spark, d), ("page",))
    mac = crypto.evidence_mac(WRITER_KEY, F.col("payload"), F.col("unix_time"))
    wrong = F.substring("id", 12, 20).cast("long") % 5 == 2
    kept = records.select(F.col("id").alias("deed_id"), F.when(wrong, F.reverse(mac)).otherwise(mac).alias("signature"), "unix_time", "produced_by", "grants")
    return audit.verified(audit.evidence(records, kept, spark.createDataFrame([], "id string, path string, verdict string"), mac))


@query(
    "evidence_over_trails",
    f"WITH RECURSIVE r AS MATERIALIZED (SELECT id, sources FROM ({oracle.rows_sql('quote')}) AS q), edges AS (SELECT id AS a, substr(s, 6) AS b FROM (SELECT id, unnest(sources) AS s FROM r) WHERE starts_with(s, 'deed:')), "
    "walk(start, node, depth) AS (SELECT id, id, 0 FROM r UNION SELECT start, b, depth + 1 FROM walk JOIN edges ON node = a), "
    "bad AS (SELECT start, arg_min(node, depth) AS node FROM walk WHERE ends_with(node, '-t2') GROUP BY start) "
    "SELECT id AS start, CASE WHEN node IS NULL THEN 'ok' ELSE node || ' keyed hash' END AS verdict FROM r LEFT JOIN bad ON start = id",
)
def evidence_over_trails(spark: SparkSession, d: str) -> DataFrame:
    """Turns whose own or earlier turns' evidence fails; that of every turn 2 does."""
    records = corpus.digested(corpus.quotes(spark, d), ("quote",))
    mac = crypto.evidence_mac(WRITER_KEY, F.col("payload"), F.col("unix_time"))
    kept = records.select(F.col("id").alias("deed_id"), F.when(F.col("id").endswith("-t2"), "0").otherwise(mac).alias("signature"), "unix_time", "produced_by", "grants")
    verdicts = audit.evidence(records, kept, audit.products(records, _blobs(spark, d)), mac)
    trail = lineage.trail(records, corpus.tombstones(spark, d), records.select("id"))
    return audit.over_trails(trail, verdicts)


@query(
    "attestation_decision",
    "SELECT p_partkey, required, keyed, CASE kind WHEN 0 THEN CASE WHEN required OR keyed THEN 'host sidecar' END WHEN 1 THEN CASE WHEN NOT good THEN 'host signature' END "
    "WHEN 2 THEN CASE WHEN required THEN 'host attestation required' WHEN keyed AND NOT good THEN 'host keyed hash' END ELSE 'host sidecar unreadable' END AS why "
    "FROM (SELECT p_partkey, p_partkey % 4 AS kind, p_size % 2 = 0 AS good FROM part), (VALUES (TRUE, TRUE), (TRUE, FALSE), (FALSE, TRUE), (FALSE, FALSE)) AS p(required, keyed)",
)
def attestation_decision(spark: SparkSession, d: str) -> DataFrame:
    """The decision table: no sidecar, a signature, a keyed hash and junk, under each policy."""
    k = F.col("p_partkey") % 4
    raw = F.when(k == 1, F.lit(b"ed25519:" + b"0" * 128)).when(k == 2, F.lit(b"\1\2\3")).when(k == 3, F.lit(b"ed25519:xx"))
    part = corpus.load(spark, d, "part").select("p_partkey", (F.col("p_size") % 2 == 0).alias("good"), crypto.sidecar_kind(raw).alias("kind"))
    out = None
    for required in (True, False):
        for keyed in (True, False):
            why = crypto.attestation(F.col("kind"), F.col("good"), F.col("good"), required, keyed)
            one = part.select("p_partkey", F.lit(required).alias("required"), F.lit(keyed).alias("keyed"), why.alias("why"))
            out = one if out is None else out.unionByName(one)
    return out


@query("ed25519_sidecars")
def ed25519_sidecars(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of the region records by a host key, verified on the executors; one is of another record."""
    records = corpus.digested(corpus.sets(spark, d), ("set",)).select("id", crypto.host_message(F.col("payload"), F.col("unix_time")).alias("m"))
    made = [(r["id"], crypto.sign(corpus.HOST_SEED, bytes(r["m"]))) for r in records.orderBy("id").collect()]  # a handful of regions
    swapped = made[:-1] + [(made[-1][0], made[0][1])]
    signed = records.join(spark.createDataFrame([(i, bytearray(s)) for i, s in swapped], "id string, s binary"), "id")
    key = crypto.public_key(corpus.HOST_SEED)
    return signed.select("id", crypto.signed_by([key], F.col("m"), F.col("s")).alias("signer"))


# Hand-over ------------------------------------------------------------------------------------------------------------


def _bag(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A sender's files with doc_id under 2/3 of all, some changed since; the receiver has every other one, some otherwise logged."""
    records = corpus.digested(corpus.files(spark, d), ("file",)).select("id", "digest", "unix_time", F.substring("id", 12, 20).cast("long").alias("n"))
    bag = records.where("n % 3 <> 0").withColumn("digest", F.when(F.col("n") % 29 == 4, F.concat(F.lit("sha256:"), F.sha2("id", 256))).otherwise(F.col("digest")))
    return bag, records.where("n % 2 = 0"), records


_BAG = (
    f"WITH r AS MATERIALIZED (SELECT id, digest, unix_time, substr(id, 12)::BIGINT AS n FROM ({digested_sql(('file',))}) AS q), own AS (SELECT * FROM r WHERE n % 2 = 0), "
    "bag AS (SELECT id, CASE WHEN n % 29 = 4 THEN 'sha256:' || sha256(id) ELSE digest END AS digest, unix_time, n FROM r WHERE n % 3 <> 0), own_log AS (SELECT id, digest, unix_time + CASE WHEN n % 31 = 10 THEN 1 ELSE 0 END AS unix_time, n FROM own WHERE n % 37 <> 2) "
)


def _own_log(own: DataFrame) -> DataFrame:
    return own.where("n % 37 <> 2").withColumn("unix_time", F.col("unix_time") + F.when(F.col("n") % 31 == 10, 1).otherwise(0))


@query(
    "import_plan",
    _BAG + f"SELECT b.id, CASE WHEN b.id IN ({TOMBSTONES}) THEN 'refused: tombstoned' WHEN o.digest <> b.digest THEN 'refused: frozen' WHEN l.id IS NOT NULL AND (l.digest <> b.digest OR l.unix_time <> b.unix_time) THEN 'refused: logged otherwise' "
    "WHEN o.id IS NULL THEN 'put' WHEN l.id IS NULL THEN 'log' ELSE 'same' END AS action FROM bag AS b LEFT JOIN own AS o ON o.id = b.id LEFT JOIN own_log AS l ON l.id = b.id",
)
def import_plan(spark: SparkSession, d: str) -> DataFrame:
    bag, own, _ = _bag(spark, d)
    numbered = lambda log: log.withColumn("idx", F.col("n"))
    sent = numbered(bag)
    # A second line of some ids, which is not the first and so doesn't count.
    own_log = numbered(_own_log(own))
    own_log = own_log.unionByName(own_log.where("n % 5 = 0").withColumn("idx", F.col("idx") + 1_000_000).withColumn("digest", F.lit("")))
    return handover.import_plan(bag, sent, own, own_log, corpus.tombstones(spark, d))


@query("import_conflicts", _BAG + "SELECT id, count(DISTINCT (digest, unix_time)) AS versions FROM (SELECT id, digest, unix_time FROM bag UNION ALL SELECT id, digest, unix_time FROM own_log) GROUP BY id HAVING count(DISTINCT (digest, unix_time)) > 1")
def import_conflicts(spark: SparkSession, d: str) -> DataFrame:
    bag, own, _ = _bag(spark, d)
    return handover.conflicts(bag.select("id", "digest", "unix_time").unionByName(_own_log(own).select("id", "digest", "unix_time")))


@query("link_uniqueness", f"WITH e AS (SELECT DISTINCT new, prior FROM ({SUPERSEDES}) AS x) SELECT 'prior' AS side, prior AS id, count(*) AS n FROM e GROUP BY prior HAVING count(*) > 1 UNION ALL SELECT 'new', new, count(*) FROM e GROUP BY new HAVING count(*) > 1")
def link_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return handover.link_uniqueness(corpus.supersedes(spark, d))


@query("handover_check", _BAG + f"SELECT id, CASE WHEN id IN ({UNLOGGED}) THEN 'no proof' WHEN n % 29 = 4 THEN 'digest' ELSE 'ok' END AS verdict FROM bag")
def handover_check(spark: SparkSession, d: str) -> DataFrame:
    """A bag's records against the receipts of the sender's log; some aren't logged, some were changed."""
    bag, _, records = _bag(spark, d)
    log = settled(merkle.log_of(records.join(corpus.unlogged(spark, d), "id", "left_anti")))
    n = log.count()
    tree = settled(merkle.nodes(merkle.leaves(log), n))
    root = merkle.head(tree, n).first()["root"]
    return handover.check(bag.select(F.col("id").alias("folder"), "id", "digest"), merkle.receipts(log, tree, n, root), n, root)


@query("head_agreement", "SELECT count(DISTINCT s) AS heads, count(DISTINCT s) <= 1 AS agree FROM (SELECT count(*) AS s FROM documents UNION ALL SELECT count(*) // 2 FROM documents)")
def head_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Receipts against the whole log and against its first half."""
    log, tree, n = _tree(spark, d)
    half = settled(log.where(F.col("idx") < n // 2))
    early = settled(merkle.nodes(merkle.leaves(half), n // 2))
    made = [merkle.receipts(lines, t, size, merkle.head(t, size).first()["root"]) for lines, t, size in ((log, tree, n), (half, early, n // 2))]
    return handover.head_agreement(made[0].unionByName(made[1]))


def _link_files(spark: SparkSession, d: str) -> DataFrame:
    records = corpus.digested(corpus.quotes(spark, d), ("quote",))
    trail = lineage.trail(records, corpus.tombstones(spark, d), records.select("id"))
    links = corpus.supersedes(spark, d).where(F.col("new").startswith("deed-quote"))
    return handover.link_files(records, lineage.source_digests(trail, records), links, records)


_LINKS = (
    f"WITH RECURSIVE r AS MATERIALIZED (SELECT id, digest, sources FROM ({digested_sql(('quote',))}) AS q), edges AS (SELECT id AS a, substr(s, 6) AS b FROM (SELECT id, unnest(sources) AS s FROM r) WHERE starts_with(s, 'deed:')), "
    "walk(start, node) AS (SELECT id, id FROM r UNION SELECT start, b FROM walk JOIN edges ON node = a), "
    "src AS (SELECT start AS id, string_agg(node || chr(9) || digest || chr(10), '' ORDER BY node) AS sources FROM walk JOIN r ON r.id = node WHERE start <> node GROUP BY start), "
    "files AS (SELECT r.id, src.sources, p.b || chr(9) || pr.digest || chr(10) AS supersedes, nx.a || chr(10) AS successor FROM r LEFT JOIN src ON src.id = r.id LEFT JOIN edges AS p ON p.a = r.id LEFT JOIN r AS pr ON pr.id = p.b LEFT JOIN edges AS nx ON nx.b = r.id) "
)


@query("link_files", _LINKS + "SELECT id, sources, supersedes, successor FROM files")
def link_files(spark: SparkSession, d: str) -> DataFrame:
    return _link_files(spark, d)


def _framed_sql(name: str) -> str:
    return f"'{name}' || chr(10) || coalesce(strlen({name}) || chr(10) || {name}, '-' || chr(10))"


@query("link_commitment", _LINKS + f"SELECT sha256(unhex(hex('{handover.LINKS_DOMAIN}') || '00' || hex(string_agg(strlen(id) || chr(10) || id || {_framed_sql('sources')} || {_framed_sql('supersedes')} || {_framed_sql('successor')}, '' ORDER BY id)))) AS commitment FROM files")
def link_commitment(spark: SparkSession, d: str) -> DataFrame:
    return handover.link_commitment(_link_files(spark, d))


_LEFT = "'file', 'set', 'clip'"


@query(
    "leave_manifests",
    f"WITH b AS MATERIALIZED ({_BLOBS}), f AS (SELECT id, kind, paths[1] AS path FROM ({oracle.rows_sql('file')}) AS q UNION ALL SELECT id, kind, paths[1] FROM ({oracle.rows_sql('page')}) AS p) "
    "SELECT id, kind, CASE WHEN kind = 'file' THEN sha256(content) END AS hash, CASE WHEN kind <> 'file' THEN 'not left' WHEN content IS NULL THEN 'absent ' || path ELSE 'ok' END AS status FROM f LEFT JOIN b ON kind = 'file' AND b.hex = substr(path, 8)",
)
def leave_manifests(spark: SparkSession, d: str) -> DataFrame:
    return handover.manifests(corpus.files(spark, d).unionByName(corpus.pages(spark, d)), _blobs(spark, d))


_EVIDENCE = f"{oracle.s('id')} || {oracle.s('agent')} || '00000000' || '00000000' || {oracle.le('unix_time', 8)} || {oracle.le('32', 4)} || {_MAC}"


@query(
    "timestamp_requests",
    f"SELECT id, '{handover.TIMESTAMP_PREFIX.hex()}' || sha256(unhex(hex('CapNdeed') || '01000000' || {oracle.le('strlen(w) // 2', 4)} || w)) AS request FROM (SELECT id, '{WITH_EVIDENCE:02x}' || payload || {_EVIDENCE} AS w FROM ({digested_sql(('page',))}) AS r)",
)
def timestamp_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests over the evidence files of all pages."""
    records = corpus.digested(corpus.pages(spark, d), ("page",))
    mac = F.unhex(crypto.evidence_mac(WRITER_KEY, F.col("payload"), F.col("unix_time")))
    own = evidence_bytes(F.col("id"), F.col("produced_by"), F.col("grants"), F.col("unix_time"), mac)
    return records.select("id", F.lower(F.hex(handover.timestamp_request(evidence_file(F.col("payload"), own)))).alias("request"))


# Bags -----------------------------------------------------------------------------------------------------------------


def _contents(spark: SparkSession, d: str) -> DataFrame:
    """Kept products as bytes: as _blobs(), the altered ones with a letter more."""
    return _blobs(spark, d).select("hex", F.when(F.col("sha") != F.col("hex"), F.concat("content", F.lit(b"!"))).otherwise(F.col("content")).alias("content"))


def _exported(spark: SparkSession, d: str, asked: DataFrame | None = None, seed: bytes | None = None) -> tuple[DataFrame, bags.Bag]:
    records = corpus.digested(corpus.files(spark, d), ("file",))
    log = settled(merkle.log_of(records.join(corpus.unlogged(spark, d), "id", "left_anti")))
    n = log.count()
    tree = settled(merkle.nodes(merkle.leaves(log), n))
    mac = crypto.evidence_mac(WRITER_KEY, F.col("payload"), F.col("unix_time"))
    kept = records.select(F.col("id").alias("deed_id"), "produced_by", "grants", "unix_time", mac.alias("signature"))
    none = spark.createDataFrame([], "id string, raw binary")
    links = corpus.supersedes(spark, d).where(F.col("new").startswith("deed-file"))
    asked = records.select("id") if asked is None else asked
    return bags.export(asked, records, kept, none, _contents(spark, d), links, corpus.tombstones(spark, d), log, tree, n, seed)


_EXPORT = (
    f"WITH p AS MATERIALIZED ({_PRODUCTS}), asked AS (SELECT id, path, verdict FROM p UNION ALL SELECT 'deed-file-unseen', NULL, NULL), "
    f"out AS MATERIALIZED (SELECT id, path, CASE WHEN id IN ({TOMBSTONES}) THEN 'tombstoned' WHEN path IS NULL THEN 'not found' WHEN id IN ({UNLOGGED}) THEN 'not logged' WHEN verdict <> 'ok' THEN verdict || ' ' || path ELSE 'exported' END AS status FROM asked) "
)


@query("export_bag", _EXPORT + "SELECT id, status FROM out")
def export_bag(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of every file, and one that isn't there, when all are asked for at once."""
    asked = corpus.files(spark, d).select("id").unionByName(spark.createDataFrame([("deed-file-unseen",)], "id string"))
    return _exported(spark, d, asked)[0]


_FLAWED = "(SELECT id, path, substr(id, 12)::BIGINT AS n FROM out WHERE status = 'exported')"


@query("handover_complaints", _EXPORT + f"SELECT id AS folder, CASE WHEN n % 7 = 1 THEN 'no proof' WHEN n % 11 = 2 THEN 'digest' WHEN n % 17 = 4 THEN 'product ' || path || ' absent' ELSE 'product ' || path || ' altered' END AS complaint FROM {_FLAWED} WHERE n % 7 = 1 OR n % 11 = 2 OR n % 17 = 4 OR n % 19 = 5")
def handover_complaints(spark: SparkSession, d: str) -> DataFrame:
    """All complaints about a bag of files of which some lack proofs, some were changed, and some products are gone or altered."""
    bag = _exported(spark, d)[1]
    n = F.substring("id", 12, 20).cast("long")
    bag.records = bag.records.withColumn("payload", F.when(n % 11 == 2, F.concat("payload", F.lit(b"!"))).otherwise(F.col("payload")))
    bag.proofs = bag.proofs.where(n % 7 != 1)
    bag.products = bag.products.where(n % 17 != 4).withColumn("content", F.when(n % 19 == 5, F.concat("content", F.lit(b"?"))).otherwise(F.col("content")))
    bag.links = bag.links.withColumns({c: F.lit(None).cast("string") for c in ("sources", "supersedes", "successor")})
    return bags.complaints(bag, allow_unsigned=True)


@query("handover_proven", _EXPORT + f"SELECT count(*) FILTER (NOT (n % 7 = 1)) AS proven, count(*) AS records FROM {_FLAWED}")
def handover_proven(spark: SparkSession, d: str) -> DataFrame:
    bag = _exported(spark, d)[1]
    bag.proofs = bag.proofs.where(F.substring("id", 12, 20).cast("long") % 7 != 1)
    return bags.proven(bag, bags.complaints(bag, allow_unsigned=True))


@query(
    "import_refusals",
    _EXPORT + f", e AS (SELECT * FROM {_FLAWED}) SELECT id, CASE WHEN n % 29 = 4 THEN 'refused: frozen' WHEN n % 23 = 3 AND n % 2 = 1 THEN 'refused: another proof is kept' WHEN n % 2 = 0 THEN 'same' ELSE 'put' END AS action FROM e",
)
def import_refusals(spark: SparkSession, d: str) -> DataFrame:
    """What importing a bag of files would do to a store that has every second one, some changed, and other proofs of some."""
    bag = _exported(spark, d)[1]
    bag.links = bag.links.withColumns({c: F.lit(None).cast("string") for c in ("sources", "supersedes", "successor")})
    n = F.substring("id", 12, 20).cast("long")
    own = bag.records.where((n % 2 == 0) | (n % 29 == 4)).withColumn("digest", F.when(n % 29 == 4, "sha256:other").otherwise(F.col("digest")))
    log = bag.proofs.where(n % 2 == 0).select("idx", "id", "digest", "unix_time")
    heads = bag.proofs.where((n % 23 == 3) & (n % 2 == 1)).select("id", "size", "root", "digest", (F.col("unix_time") + 1).alias("unix_time"))
    none = lambda ddl: spark.createDataFrame([], ddl)
    return bags.refusals(bag, own, none("id string"), log, none("new string, prior string, digest string"), none("hex string, content binary"), none("id string, verdict string"), heads)


@query(
    "import_link_conflicts",
    "WITH links AS (SELECT DISTINCT new, prior FROM (SELECT o_orderkey AS new, o_orderkey - o_orderkey % 3 AS prior FROM orders WHERE o_orderkey % 5 < 2 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F')), "
    "apart AS (SELECT * FROM links WHERE new <> prior) "
    "SELECT '' AS folder, 'deed-file-' || prior || ' is superseded by ' || count(*) || ' records' AS complaint FROM apart GROUP BY prior HAVING count(*) > 1 "
    "UNION ALL SELECT '', 'deed-file-' || new || ' supersedes ' || count(*) || ' records' FROM apart GROUP BY new HAVING count(*) > 1 "
    "UNION ALL SELECT '', 'deed-file-' || new || ' supersedes itself' FROM links WHERE new = prior",
)
def import_link_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the links that a bag's folders name, one a side of orders: priors by key, successors by customer."""
    orders = corpus.load(spark, d, "orders")
    name = lambda c: F.concat(F.lit("deed-file-"), c.cast("string"))
    key = F.col("o_orderkey")
    forward = orders.where(key % 5 < 2).select(name(key).alias("folder"), F.lit("supersedes").alias("side"), name(key - key % 3).alias("target"))
    back = orders.where("o_orderstatus = 'F'").select(name(F.col("o_custkey")).alias("folder"), F.lit("successor").alias("side"), name(key).alias("target"))
    return bags.link_conflicts(forward.unionByName(back))


@query("imported_log_order", _EXPORT + f"SELECT row_number() OVER (ORDER BY {EPOCH} + n, id) - 1 AS nth, id FROM {_FLAWED}")
def imported_log_order(spark: SparkSession, d: str) -> DataFrame:
    """The log lines of a bag, in the sender's order without gaps."""
    bag = _exported(spark, d)[1]
    return bags.in_log_order(bag, bag.records).select("nth", "id")


@query("signed_head_check")
def signed_head_check(spark: SparkSession, d: str) -> DataFrame:
    """What is said of a signed head: of an accepted signer, of another, of a changed root, and unsigned."""
    _, tree, n = _tree(spark, d)
    root = merkle.head(tree, n).first()["root"]
    made = bags.signed_head(spark, n, root, None, corpus.HOST_SEED)
    key = crypto.public_key(corpus.HOST_SEED).hex()
    cases = {
        "accepted": bags.head_complaint(made, n, root, None, False, {key}),
        "another signer": bags.head_complaint(made, n, root, None, False, {"0" * 64}),
        "links": bags.head_complaint(made, n, root, "0" * 64, True, {key}),
        "changed": bags.head_complaint(made.withColumn("size", F.col("size") + 1), n + 1, root, None, False, {key}),
        "unsigned": bags.head_complaint(made.limit(0), n, root, None, False, {key}),
    }
    return spark.createDataFrame(list(cases.items()), "case string, complaint string")


@query("blob_ingest", "SELECT sha256(text) AS hex, octet_length(encode(min(text))) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) HAVING NOT bool_or(doc_id % 3 = 0)")
def blob_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Contents that a store keeps anew, which has every third already; each once."""
    docs = corpus.load(spark, d, "documents")
    kept = docs.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("hex")).distinct()
    new = handover.ingest(docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content")), kept)
    return new.select("hex", F.octet_length("content").cast("long").alias("bytes"))


@query("body_ingest", "SELECT n_regionkey AS region, string_agg(CASE WHEN n_nationkey % 2 = 0 THEN 'sha256:' || sha256(n_name) ELSE n_name END, ',' ORDER BY n_name) AS members FROM nation GROUP BY n_regionkey")
def body_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Regions' nations, those with even keys kept under their addresses."""
    nations = corpus.load(spark, d, "nation")
    names = nations.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("members"))
    new = nations.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("path"), F.col("n_name").cast("binary").alias("content"))
    return handover.addressed(names, new, ("members",)).select(F.col("n_regionkey").alias("region"), F.array_join("members", ",").alias("members"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The head of the log of files, with three receipts verified against it."""
    log, tree, n = _tree(spark, d)
    root = merkle.head(tree, n).first()["root"]
    chosen = log.where(F.col("idx").isin(0, n // 2, n - 1))
    r = merkle.receipts(chosen, tree, n, root)
    leaf = merkle.leaf(merkle.material(F.col("id"), F.col("digest"), F.col("unix_time")))
    return r.select("id", "idx", "size", "root", merkle.included(F.col("idx"), F.col("size"), leaf, F.col("path"), F.col("root")).alias("verified"))
