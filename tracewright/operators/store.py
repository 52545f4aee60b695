"""A store of records: parquet tables under one path, and the verbs that write them.

A verb takes a batch and answers with a row for each item. All that it reads is of one state of the tables, and all that it
writes appears at once (commits.py). Several writers may work at a time: of those that began from one state one is first,
the others begin again. The log's hash tree is kept and grows with the log.
"""

from __future__ import annotations

import copy
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import crypto, derive, encoding
from ..functions.encoding import KINDS, any_record_bytes, digest
from ..plans.corpus import BODY, TAGGED
from . import audit, bags, catalog, grams, handover, lineage, merkle, names
from .commits import Commits, State, Transaction
from .components import settled

PRODUCED_BY = "struct<agent_id:string,activity_id:string>"
TABLES = {
    "deeds": f"id string, kind string, name string, paths array<string>, sources {TAGGED}, produced_by {PRODUCED_BY}, grants {TAGGED}, face string, body {BODY}, unix_time long, payload binary, digest string",
    "evidence": f"deed_id string, produced_by {PRODUCED_BY}, grants {TAGGED}, unix_time long, signature string",
    "log": "idx long, id string, digest string, unix_time long",
    "supersedes": "new string, prior string, digest string",
    "successor": "prior string, next string",
    "tombstones": "id string",
    "blobs": "hex string, content binary",
    "sidecars": "id string, raw binary",
    "heads": "id string, size long, root string, digest string, unix_time long",
    "signed": "id string, size long, root string, links string, signer string, signature string",
    "nodes": "level int, idx long, hash binary",
    "names": names.NAMES,
    "sections": names.SECTIONS,
    "texts": grams.TEXTS,
    "text_sections": grams.TEXT_SECTIONS,
    "runs": grams.POSTINGS,
    "run_sections": names.SECTIONS,
    "covered": "folder string",
}
#: What a table's folders are named by, so that a filter on it reads no others.
PARTITIONED = {"deeds": "kind"}
#: How often a writer begins again because another was first.
ATTEMPTS = 30


def _of_one_state(verb: Callable) -> Callable:
    """A verb that reads several tables, all as they are when it is called."""

    @functools.wraps(verb)
    def run(self: Store, *args, **named):
        return verb(self.snapshot(), *args, **named)

    return run


class Store:
    def __init__(self, spark: SparkSession, path: str, key: bytes = bytes(32), host: audit.Host | None = None, seed: bytes | None = None) -> None:
        """Reading creates nothing: a table that isn't there reads as empty. seed: the host's signing key, for heads and sidecars."""
        self.spark, self.path, self.key, self.host, self.seed = spark, path.rstrip("/"), key, host or audit.Host(), seed
        self.commits = Commits(spark, self.path)
        self._pinned: State | None = None
        self._trees: dict[tuple[str, ...], DataFrame] = {}

    def snapshot(self, number: int | None = None) -> Store:
        """This store as it is now, or was after commit `number`, whatever is written meanwhile."""
        if self._pinned is not None and number is None:
            return self
        out = copy.copy(self)
        out._pinned = self.commits.state(number)
        return out

    def _state(self) -> State:
        return self._pinned or self.commits.state()

    def table(self, name: str) -> DataFrame:
        return self.commits.read(self._state(), name, TABLES[name])

    def size(self) -> int:
        """How many lines the log has."""
        return self._state().facts.get("size", 0)

    @functools.cached_property
    def _schemas(self) -> dict[str, list[str]]:
        return {name: self.spark.createDataFrame([], ddl).columns for name, ddl in TABLES.items()}

    def _append(self, tx: Transaction, name: str, rows: DataFrame) -> None:
        tx.append(name, rows.select(*self._schemas[name]), PARTITIONED.get(name))

    def _index(self, tx: Transaction, rows: DataFrame) -> None:
        folder = tx.append("names", names.ranged(rows), per_file=names.PER_FILE)
        if folder:
            self._append(tx, "sections", names.sections(self.spark, self.path, folder))

    def _index_written(self, tx: Transaction) -> None:
        """Index what a transaction adds, read from its own files."""
        of = {"deeds": names.of_records, "log": names.of_log}
        rows = [f(tx.written(t, TABLES[t])) for t, f in of.items() if t in tx.added and t not in tx.dropped]
        if rows:
            self._index(tx, functools.reduce(DataFrame.unionByName, rows))

    def _written(self, work: Callable[[Store, Transaction], DataFrame | int]) -> DataFrame | int:
        """What work(store as it is, transaction) gives, once what it wrote is in place. Its answers may not rest on files."""
        for _ in range(ATTEMPTS):
            at = self.snapshot()
            tx = at.commits.begin(at._pinned)
            try:
                out = work(at, tx)
                at._index_written(tx)
                if tx.commit():
                    return out
            except BaseException:
                tx.discard()
                raise
            tx.discard()
        raise RuntimeError(f"other writers were first {ATTEMPTS} times")

    # Reading

    @_of_one_state
    def list(self) -> DataFrame:
        return catalog.listing(self.table("deeds"), self.table("tombstones"))

    @_of_one_state
    def find(self, kind: str | None = None, agent: str | None = None, text: str | None = None) -> DataFrame:
        """Served records. Where text is sought, records in the substring index are looked up there, the others are scanned."""
        if not text:
            return catalog.find(self.table("deeds"), self.table("tombstones"), kind, agent, text)
        ids = self.mentions(self.spark.createDataFrame([(text,)], "needle string")).select("id")
        return catalog.find(self.table("deeds").join(ids, "id", "left_semi"), self.table("tombstones"), kind, agent)

    @_of_one_state
    def mentions(self, asked: DataFrame) -> DataFrame:
        """needle, id of records, deleted ones too, for needles (column needle) that one of their searched texts holds."""
        hits = grams.matches(self.spark, self.path, self.table("text_sections"), self.table("run_sections"), asked)
        rest = self._uncovered()[0]
        if not rest:
            return hits
        return hits.unionByName(grams.scanned(self._of_folders("deeds", rest), asked)).distinct()

    def _uncovered(self) -> tuple[list[str], bool]:
        """Folders of records that the substring index lacks, and whether it has some that are no more (after a compaction)."""
        now = self._state().folders.get("deeds", ())
        covered = {r["folder"] for r in self.table("covered").collect()}  # as many as the manifest names
        return [f for f in now if f not in covered], not covered.issubset(now)

    def _of_folders(self, name: str, folders: list[str]) -> DataFrame:
        return self.commits.read(State(-1, {name: tuple(folders)}), name, TABLES[name])

    @_of_one_state
    def get(self, asked: DataFrame) -> DataFrame:
        return catalog.get(asked, self.table("deeds"), self.table("tombstones"))

    @_of_one_state
    def rows(self, ids: DataFrame) -> DataFrame:
        """id, kind, name, paths, sources, agent, digest, body (JSON) of served records among ids (column id)."""
        return catalog.whole_rows(catalog.served(self.table("deeds").join(ids.select("id"), "id", "left_semi"), self.table("tombstones")))

    @_of_one_state
    def resolve(self, asked: DataFrame) -> DataFrame:
        """By the name index: of the names only those files are read that can hold one asked for."""
        return catalog.resolved(asked, self._named(asked), self.table("tombstones"))

    @_of_one_state
    def candidates(self, asked: DataFrame, shown: int = catalog.SHOWN) -> DataFrame:
        """raw, n, longer, ids (the first `shown`) for prefixes raw of ids, digests or products, by the name index."""
        return catalog.candidates(self._named(asked, True), self.table("tombstones"), asked, shown)

    def _named(self, asked: DataFrame, prefix: bool = False) -> DataFrame:
        return names.looked_up(self.spark, self.path, self.table("sections"), asked.select(F.col("raw").alias("name")), prefix)

    @_of_one_state
    def trail(self, starts: DataFrame) -> DataFrame:
        return lineage.trail(self.table("deeds"), self.table("tombstones"), starts)

    @_of_one_state
    def current(self, starts: DataFrame) -> DataFrame:
        live = catalog.served(self.table("deeds"), self.table("tombstones"))
        return lineage.current(lineage.successor_edges(live, self.table("supersedes"), self.table("successor")), starts)

    @_of_one_state
    def current_lines(self, asked: DataFrame) -> DataFrame:
        """pos, id, line for rows pos, id."""
        return lineage.current_lines(self.current(asked), asked, catalog.served(self.table("deeds"), self.table("tombstones")))

    @_of_one_state
    def audit(self, unreadable: DataFrame | None = None) -> DataFrame:
        """unreadable: id, why of record files that could not be read, as the frame reader tells."""
        return audit.findings(self.table("log"), self.table("deeds"), self.table("tombstones"), unreadable)

    @_of_one_state
    def evidence(self, blobs: DataFrame | None = None) -> DataFrame:
        """id, verdict, signed_at. blobs: hex, sha of the bytes kept; those of the store by default."""
        deeds = self.table("deeds")
        blobs = self.table("blobs").select("hex", F.sha2("content", 256).alias("sha")) if blobs is None else blobs
        mac = crypto.evidence_mac(self.key, F.col("payload"), F.col("signed_at"))
        return audit.evidence(deeds, self.table("evidence"), audit.products(deeds, blobs), mac, self.table("sidecars"), self.host)

    def tree(self) -> tuple[DataFrame, int]:
        """The log's hash tree, as it is kept, and the log's size. Nothing is hashed but the right edge."""
        at = self.snapshot()
        key = at._state().folders.get("nodes", ())
        if key not in self._trees:
            self._trees.clear()
            self._trees[key] = merkle.whole(at.table("nodes"), at.size())
        return self._trees[key], at.size()

    def bridge(self, old: int) -> tuple[tuple[int, str], tuple[int, str], list[str]]:
        """The heads of the log at `old` entries and now, and what joins them."""
        tree, n = self.tree()
        return merkle.bridge(self.spark, tree, old, n)

    @_of_one_state
    def leave(self, ids: DataFrame) -> DataFrame:
        """id, kind, hash, status of records that leave: the digest of their products' bytes."""
        return handover.manifests(catalog.served(self.table("deeds"), self.table("tombstones")).join(ids.select("id"), "id", "left_semi"), self.table("blobs"))

    @_of_one_state
    def timestamp_requests(self, ids: DataFrame) -> DataFrame:
        """id, request: an RFC 3161 request over each record's evidence file."""
        rows = self.table("deeds").join(ids.select("id"), "id", "left_semi").select("id", "payload").join(self.table("evidence").withColumnRenamed("deed_id", "id"), "id")
        own = encoding.evidence_bytes(F.col("id"), F.col("produced_by"), F.col("grants"), F.col("unix_time"), F.unhex("signature"))
        return rows.select("id", handover.timestamp_request(encoding.evidence_file(F.col("payload"), own)).alias("request"))

    @_of_one_state
    def export(self, asked: DataFrame, path: str) -> DataFrame:
        """Write a bag of the asked ids (column id) under path, if all of them can be exported; id, status of each."""
        tree, n = self.tree()
        t = self.table
        answers, bag = bags.export(asked, t("deeds"), t("evidence"), t("sidecars"), t("blobs"), t("supersedes").select("new", "prior"), t("tombstones"), t("log"), tree, n, self.seed)
        if answers.where("status <> 'exported'").isEmpty():
            bag.write(path)
        return answers

    def head(self) -> DataFrame:
        return merkle.head(*self.tree())

    @_of_one_state
    def receipts(self, ids: DataFrame | None = None) -> DataFrame:
        """Inclusion proofs. Of an id that the log names twice, the first line counts."""
        tree, n = self.tree()
        log = self.table("log")
        if ids is not None:
            first = log.join(ids.select("id"), "id", "left_semi").groupBy("id").agg(F.min("idx").alias("idx"))
            log = log.join(first, ["id", "idx"], "left_semi")
        return merkle.receipts(log, tree, n, merkle.head(tree, n).first()["root"])

    # Writing

    @_of_one_state
    def classify(self, drafts: DataFrame) -> DataFrame:
        """drafts (pos, id, kind, name, sources, produced_by, grants, body, unix_time, supersedes) as records with status, why.

        status: created, same (there is an equal one), or refused. A null id is minted from the name; a blank name
        is the id. Of drafts with one id in a batch the first counts, as if they came one by one.
        """
        kind, body = F.col("kind"), F.col("body")
        made = drafts.withColumn("id", F.coalesce("id", derive.mint_id(kind, F.coalesce("name", F.lit("")))))
        made = made.withColumn("name", F.when(derive.blank(F.col("name")), F.col("id")).otherwise(F.col("name")))
        urls = F.coalesce(F.when(kind == "quote", body["quote"]["urls"]), F.array().cast("array<string>"))
        made = made.withColumn("sources", derive.with_quoted_urls(F.col("sources"), urls)).withColumn("paths", F.coalesce(derive.paths(kind, body), F.array().cast("array<string>")))
        made = made.withColumn("face", derive.face(kind, body["file"]["media_type"])).withColumn("fault", derive.fault(kind, body))
        payload = any_record_bytes(KINDS)
        made = settled(made.withColumn("payload", F.when(F.col("fault").isNull(), payload)).withColumn("digest", digest(F.col("payload"))))
        own = self.table("deeds").select("id", F.col("digest").alias("_own"))
        gone = self.table("tombstones").select("id", F.lit(True).alias("_gone")).distinct()
        taken = self.table("supersedes").select(F.col("prior").alias("supersedes"), F.lit(True).alias("_taken")).distinct()
        prior = catalog.served(self.table("deeds"), self.table("tombstones")).select(F.col("id").alias("supersedes"), F.lit(True).alias("_prior"))
        rows = made.join(own, "id", "left").join(gone, "id", "left").join(taken, "supersedes", "left").join(prior, "supersedes", "left")
        turn = Window.partitionBy("id").orderBy("pos")
        rows = rows.withColumn("_nth", F.row_number().over(turn)).withColumn("_first", F.first("digest").over(turn))
        claims = made.where("supersedes is not null").select("pos", F.row_number().over(Window.partitionBy("supersedes").orderBy("pos")).alias("_claim"))
        rows = rows.join(claims, "pos", "left")
        there = F.coalesce("_own", F.when(F.col("_nth") > 1, F.col("_first")))
        linked = F.col("supersedes").isNotNull()
        why = (
            F.when(F.col("fault").isNotNull(), F.col("fault"))
            .when(~derive.is_id(F.col("id")) | ~F.col("id").startswith(F.concat(F.lit(derive.ID_PREFIX), kind, F.lit("-"))), "id is not of its kind")
            .when(F.col("_gone"), "frozen: tombstoned")
            .when(linked & (F.col("supersedes") == F.col("id")), "supersedes itself")
            .when(linked & F.col("_prior").isNull(), "supersedes nothing")
            .when(linked & (F.col("_taken").isNotNull() | (F.col("_claim") > 1)), "already superseded")
            .when(there.isNotNull() & ((there != F.col("digest")) | linked), "frozen")
        )
        status = F.when(why.isNotNull(), "refused").when(there.isNotNull(), "same").otherwise("created")
        return rows.select("pos", *self._schemas["deeds"], "supersedes", status.alias("status"), why.alias("why"))

    def create(self, drafts: DataFrame) -> DataFrame:
        """Write what classify() finds to be new; pos, id, status, why of all."""
        return self._written(lambda at, tx: at._create(tx, drafts))

    def _create(self, tx: Transaction, drafts: DataFrame) -> DataFrame:
        answers = settled(self.classify(drafts))
        new = answers.where("status = 'created'")
        self._put(tx, new)
        message = crypto.host_message(F.col("payload"), F.col("unix_time"))
        if self.seed is not None:
            self._append(tx, "sidecars", new.select("id", F.concat(F.lit(b"ed25519:"), F.lower(F.hex(crypto.signed(self.seed, message))).cast("binary")).alias("raw")))
        elif self.host.key is not None:
            self._append(tx, "sidecars", new.select("id", F.unhex(crypto.hmac_sha256(self.host.key, message)).alias("raw")))
        linked = new.where("supersedes is not null").select(F.col("id").alias("new"), F.col("supersedes").alias("prior"))
        known = self.table("deeds").select(F.col("id").alias("prior"), "digest").unionByName(new.select(F.col("id").alias("prior"), "digest"))
        self._append(tx, "supersedes", linked.join(known, "prior", "left").dropDuplicates(["new", "prior"]))
        self._append(tx, "successor", linked.select("prior", F.col("new").alias("next")))
        self._log(tx, merkle.log_of(new))
        return answers.select("pos", "id", "status", "why")

    def _put(self, tx: Transaction, new: DataFrame) -> None:
        """Records, and evidence of them under this store's key."""
        self._append(tx, "deeds", new)
        mac = crypto.evidence_mac(self.key, F.col("payload"), F.col("unix_time"))
        self._append(tx, "evidence", new.select(F.col("id").alias("deed_id"), "produced_by", "grants", "unix_time", mac.alias("signature")))

    def _log(self, tx: Transaction, lines: DataFrame) -> int:
        """Append lines (idx from 0, id, digest, unix_time) to the log, and to its tree what they complete; how many."""
        size = self.size()
        lines = settled(lines.select((F.col("idx") + size).alias("idx"), "id", "digest", "unix_time"))
        more = lines.count()
        if more:
            self._append(tx, "log", lines)
            known = merkle.chosen(self.table("nodes"), merkle.peaks(size))
            self._append(tx, "nodes", merkle.grown(merkle.leaves(lines), size, more, known))
            tx.facts["size"] = size + more
        return more

    def ingest(self, contents: DataFrame) -> int:
        """Keep contents (path, content) under their hashes, those that aren't kept yet; how many that were."""
        return self._written(lambda at, tx: at._ingest(tx, contents))

    def _ingest(self, tx: Transaction, contents: DataFrame) -> int:
        self._append(tx, "blobs", handover.ingest(contents, self.table("blobs")))
        return tx.written("blobs", TABLES["blobs"]).select("hex").count()

    def compact(self, name: str) -> None:
        """Put the files of many small commits together. Earlier states keep theirs. Of names, the sections follow."""
        if name in ("names", "sections"):
            self._written(lambda at, tx: at._index_anew(tx))
            return
        self._written(lambda at, tx: tx.replace(name, at.table(name).select(*at._schemas[name]), PARTITIONED.get(name)))

    def _index_anew(self, tx: Transaction) -> None:
        for name in ("names", "sections"):
            tx.dropped[name] = list(tx.state.folders.get(name, ()))
        self._index(tx, self.table("names"))

    def index_texts(self) -> int:
        """Take the records that the substring index lacks into it; how many. Until then find() scans those."""
        return self._written(lambda at, tx: at._index_texts(tx))

    def _index_texts(self, tx: Transaction) -> int:
        rest, stale = self._uncovered()
        if stale:  # the records were put together anew: so is the index
            rest = list(self._state().folders["deeds"])
            for name in ("texts", "text_sections", "runs", "run_sections", "covered"):
                tx.dropped[name] = list(self._state().folders.get(name, ()))
        if not rest:
            return 0
        after = 0 if stale else self._state().facts.get("texts", 0)
        folder = tx.append("texts", grams.texts_of(self._of_folders("deeds", rest), after), per_file=grams.BUCKET)
        self._append(tx, "text_sections", names.sections(self.spark, self.path, folder, grams.TEXTS, "n"))
        texts = tx.written("texts", grams.TEXTS)
        folder = tx.append("runs", grams.in_files(grams.postings(texts)), per_file=grams.PER_FILE)
        if folder:  # a record without any text has no runs
            self._append(tx, "run_sections", names.sections(self.spark, self.path, folder, grams.POSTINGS))
        self._append(tx, "covered", self.spark.createDataFrame([(f,) for f in rest], TABLES["covered"]))
        added = texts.count()
        tx.facts["texts"] = after + added
        return added

    def check(self, path: str, accepted: set[str] = frozenset(), allow_unsigned: bool = False, kept: tuple[int, str] | None = None, joins: tuple | None = None) -> DataFrame:
        """folder, complaint of the bag under path. kept: a head seen before, which the bag's must be grown from by the bridge joins."""
        bag = bags.Bag.read(self.spark, path)
        out = bags.complaints(bag, accepted, allow_unsigned)
        held = bags.held_head(bag)
        if kept is None or held is None:
            return out
        start, end, path = joins or ((None, None), (None, None), None)
        change = merkle.head_change(self.spark.createDataFrame([(*kept, *held, *start, *end, path)], merkle.HEADS))
        why = change.where("change not in ('same', 'grown')").select(F.lit("").alias("folder"), F.concat(F.lit("head: "), "change").alias("complaint"))
        return out.unionByName(why)

    def import_bag(self, path: str, accepted: set[str] = frozenset(), allow_unsigned: bool = False) -> DataFrame:
        """Take in the bag under path, if it checks and nothing is refused; id, action of its records, or its complaints.

        The bag is read once, before it is checked; products are hashed again as they are written. Evidence is issued anew
        under this store's key at the proof's time, host sidecars travel as they are, log lines are appended in the sender's
        order, and the proofs' heads are kept, with the signed head that names the same log. A second import changes nothing.
        """
        bag = bags.Bag.read(self.spark, path).settled()
        wrong = settled(bags.complaints(bag, accepted, allow_unsigned))
        if not wrong.isEmpty():
            return wrong.select(F.col("folder").alias("id"), F.concat(F.lit("refused: "), "complaint").alias("action"))
        return self._written(lambda at, tx: at._take_in(tx, bag))

    def _take_in(self, tx: Transaction, bag: bags.Bag) -> DataFrame:
        t = self.table
        plan = settled(bags.refusals(bag, t("deeds"), t("tombstones"), t("log"), t("supersedes"), t("blobs"), self.evidence(), t("heads"), t("signed")))
        if not plan.where("action like 'refused%'").isEmpty():
            return plan
        put, logged = plan.where("action = 'put'").select("id"), plan.where("action in ('put', 'log')").select("id")
        self._ingest(tx, bag.products)
        kept = t("blobs").select("hex").unionByName(tx.written("blobs", TABLES["blobs"]).select("hex"))
        lost = bags.needed(bag.records.join(put, "id", "left_semi")).join(kept, "hex", "left_anti")
        if not lost.isEmpty():  # the bag's products are not what they were when they were checked
            tx.discard()
            tx.added.clear()
            return settled(lost.groupBy("id").agg(F.concat(F.lit("refused: product "), F.min("hex")).alias("action")))
        lines = settled(bags.in_log_order(bag, logged))
        self._put(tx, bag.records.join(put, "id", "left_semi").drop("unix_time").join(lines.select("id", "unix_time"), "id"))
        self._append(tx, "sidecars", bag.sidecars.join(put, "id", "left_semi"))
        links = bags._link_rows(bag).join(put.select(F.col("id").alias("folder")), "folder", "left_semi")
        self._append(tx, "supersedes", links.where("side = 'supersedes'").select(F.col("folder").alias("new"), F.col("target").alias("prior"), "digest"))
        self._append(tx, "successor", links.where("side = 'successor'").select(F.col("folder").alias("prior"), F.col("target").alias("next")))
        proofs = bag.proofs.select("id", "size", "root", "digest", "unix_time")
        self._append(tx, "heads", proofs.join(t("heads").select("id"), "id", "left_anti"))
        self._append(tx, "signed", bags.named_heads(bag).join(t("signed").select("id"), "id", "left_anti"))
        self._log(tx, lines.withColumnRenamed("nth", "idx"))
        return plan

    def delete(self, ids: DataFrame) -> DataFrame:
        """id, status: deleted, tombstoned before, or not found. The log stays as it is."""
        return self._written(lambda at, tx: at._delete(tx, ids))

    def _delete(self, tx: Transaction, ids: DataFrame) -> DataFrame:
        known, gone = self.table("deeds").select("id", F.lit(True).alias("_there")), self.table("tombstones").select("id", F.lit(True).alias("_gone")).distinct()
        asked = ids.select("id").distinct().join(known, "id", "left").join(gone, "id", "left")
        answers = settled(asked.select("id", F.when(F.col("_gone"), "tombstoned").when(F.col("_there"), "deleted").otherwise("not found").alias("status")))
        self._append(tx, "tombstones", answers.where("status = 'deleted'"))
        return answers

    def backfill(self, now: int) -> int:
        """Log what the log lacks; how many lines that were."""
        return self._written(lambda at, tx: at._log(tx, merkle.log_of(audit.backfill(at.table("log"), at.table("deeds"), at.table("tombstones"), now, at.evidence()))))
