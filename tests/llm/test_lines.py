"""Line deduplication against a plain version, batch by batch and whole."""

from __future__ import annotations

import collections
import hashlib
import random
import shutil
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright.llm import lines

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
COLUMNS = "doc_id long, text string, h1 string, gone int, batch string"


def key(line):
    return line.strip(lines.ENDS).translate(LOWER)


def plain(rows, shortest=lines.SHORTEST):
    owner = {}
    ident = lambda i: lines.NO_ID if i is None else i
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= shortest:
                owner[key(line)] = min(owner.get(key(line), ident(i)), ident(i))
    out = []
    for i, text in rows:
        every = (text or "").split("\n")
        kept = [line for line in every if owner.get(key(line), ident(i)) == ident(i)]
        out.append((i, "\n".join(kept), len(every), len(every) - len(kept)))
    return collections.Counter(out)


def odd_rows():
    r = random.Random(11)
    pool = [" ".join(r.choice(["Über", "ÉTÉ", "Wort", "line", "of", "TEXT"]) for _ in range(r.randint(1, 6))) for _ in range(40)]
    rows = [(None, None), (None, "no id, a line of its own\nshared by all of them"), (5, ""), (6, "\n\n"), (7, None), (8, "123456789\n1234567890"), (9, "123456789\n1234567890")]
    rows += [(10, "again and again\nagain and again\nAGAIN AND again \t"), (11, "\x0b again and again\r\nand more"), (11, "again and again\nanother text of one id"), (3, "ÄGAIN AND AGAIN"), (4, "ägain and again")]
    rows += [(i, "\n".join(r.choice([x, x.upper(), f"  {x}\t", "shared by all of them", ""]) for x in r.choices(pool, k=r.randint(1, 30)))) for i in range(100, 180)]
    rows += [rows[-1], rows[-1], (2**62, "\n".join(f"line number {i // 2}" for i in range(9000))), (-3, "Line Number 17\nshared by all of them")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("batches", "fanout"), [(1, 4), (8, 2), (5, 3)])
def test_lines(spark, batches, fanout):
    rows = odd_rows()
    docs = spark.createDataFrame([(*x, "a", 1, "b") for x in rows], COLUMNS).repartition(3)
    got = collections.Counter(map(tuple, lines.dedup_lines(docs, batches, fanout).collect()))
    assert got == plain(rows)
    assert sum(got.values()) == len(rows)


def test_no_lines(spark):
    assert lines.dedup_lines(spark.createDataFrame([], COLUMNS)).collect() == []
    assert lines.dedup_lines(spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")).count() == 2


def test_runs_grow_by_levels_and_stay(spark, tmp_path):
    """Batches in any order: what came first stays. Another session goes on where the last one ended."""
    path, seen = str(tmp_path / "runs"), set()
    r = random.Random(2)
    for i in range(9):
        store = lines.LineRuns(spark, path, 2)  # opened anew each time
        rows = [(d, " ".join(r.choice("abcdefg") * 4 for _ in range(3))) for d in r.sample(range(100), 30)]
        batch = spark.createDataFrame(rows, "doc_id long, text string")
        late = {x["doc"] for x in store.add(lines.keyed_lines(batch)).collect()}
        first = {}
        for d, text in sorted(rows):
            first.setdefault(text, d)
        assert late == {d for d, text in rows if text in seen or first[text] != d}
        seen |= set(first)
        assert sum(b - a + 1 for a, b, _ in store.runs()) == i + 1 and len(store.runs()) == bin(i + 1).count("1")
        assert sum(store.read(x).count() for x in store.runs()) == len(seen)
        store.forget()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
    # A merge that was cut short leaves its parts beside it, or no mark of success.
    store = lines.LineRuns(spark, path, 2)
    before = store.runs()
    shutil.copytree(f"{path}/run-8-8-4", f"{path}/run-3-3-4")
    shutil.copytree(f"{path}/run-0-7-4", f"{path}/run-0-8-4")
    (tmp_path / "runs" / "run-0-8-4" / "_SUCCESS").unlink()
    assert store.runs() == before == [(0, 7, 4), (8, 8, 4)]


def test_runs_are_not_moved(spark, tmp_path):
    """A batch's keys are summed up before they are sent, and meet the runs without an exchange of these."""
    store = lines.LineRuns(spark, str(tmp_path / uuid.uuid4().hex))
    batch = lines.keyed_lines(spark.createDataFrame(odd_rows(), "doc_id long, text string"))
    store.add(batch)
    seen = store.read(store.runs()[0])
    new = batch.groupBy(*lines.KEY).agg(F.min("doc").alias("doc"))
    plan = new.join(seen.hint("merge"), (new["h1"] == seen["h1"]) & (new["h2"] == seen["h2"]) & new["doc"].isNotNull(), "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and plan.index("SortMergeJoin") < plan.index("partial_min")
    store.forget()


def test_query_and_sql(spark):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = db.sql(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({lines.OP11_SQL})").fetchall()
    got = lines.op11_line_dedup(spark, SF)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    rows = db.sql("select doc_id, text from documents").fetchall()
    assert plain(rows) == collections.Counter(map(tuple, lines.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet")).collect()))
    assert {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t, *_ in plain(rows)} == {(r[0], r[3]) for r in want}
