"""Cross-tokenizer alignment against a plain version on the libraries' own ids of whole texts."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm import alignment
from tracewright.llm.bpe import Vocabulary
from tracewright.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, runs int, links string, `row` long, n_a string"


@pytest.fixture(scope="module")
def libraries():
    path = tokenizer_path("byte_bpe_50k.json")
    a = Tokenizer.from_file(path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    return a, Vocabulary(path).bytes, b


def plain(texts, libraries):
    """(n_a, n_b, n_groups, n_links, groups, n_best, count_sum) of each text."""
    a, a_bytes, b = libraries
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))]
    rows, counts = [], collections.Counter()
    for text in texts:
        raw = (" " + text).encode() if text else b""
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text, num_threads=1) if text else []
        if b"".join(a_bytes[i] for i in x) != raw or b"".join(b_bytes[i] for i in y) != raw:
            x, y = [], []
        spans = [np.cumsum([0, *(len(of[i]) for i in ids)]).tolist() for ids, of in ((x, a_bytes), (y, b_bytes))]
        links, j = [], 0
        for i, (lo, hi) in enumerate(zip(spans[0], spans[0][1:], strict=False)):
            while j and spans[1][j] > lo:
                j -= 1
            while j < len(y) and spans[1][j] < hi:
                if spans[1][j + 1] > lo:
                    links.append((x[i], y[j]))
                j += 1
        cuts = sorted(set(spans[0][1:]) & set(spans[1][1:]))
        groups, before = [], 0
        for cut in cuts:
            inside = [",".join(str(k) for k, end in zip(ids, s[1:], strict=True) if before < end <= cut) for ids, s in zip((x, y), spans, strict=True)] if len(cuts) < 4000 else None
            groups.append("|".join(inside) if inside else "")
            before = cut
        counts.update(links)
        rows.append((len(x), len(y), len(cuts), links, ";".join(groups)))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(na, nb, ng, len(links), g, sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links)) for na, nb, ng, links, g in rows]


def odd_texts():
    r = random.Random(4)
    letters = "abcdefghinorstuéüß"
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 12))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    return [
        None, "", " ", "  two  spaces ", " leads", "trails ", "line\nbreak and\tmore", "a \n b", "word\n\nword", "one", "<|endoftext|> </s> <s> <unk> is text", "▁ is no space", "日本語のテキスト です", "é ﬁ ½   x y 　",
        "😀👍🏽 emoji", "Աა other scripts ẞ", "<0x41> A", "it's don't 'll 12345 6.5%", "x" * 3000, "ab" * 1500 + " and more", "a" * 1999 + " b", text(50), text(700), text(50), "word " * 300 + "end", "\x00 control \x7f", *[text(r.randint(1, 90)) for _ in range(60)],
    ]


@pytest.mark.parametrize(("block", "frequent"), [(4 << 20, 1 << 17), (500, 5)])
def test_alignment(spark, libraries, block, frequent):
    texts = odd_texts()
    texts += [texts[22], texts[22]]
    docs = spark.createDataFrame([(i if i % 9 else None, t, 1, "a", 2, "b") for i, t in enumerate(texts)], COLUMNS).repartition(3)
    found = alignment.with_counts(alignment.aligned(alignment.tokens(docs, block=block)), frequent)
    want = collections.Counter((i if i % 9 else None, *row) for i, row in enumerate(plain(texts, libraries)))
    assert collections.Counter(map(tuple, found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum").collect())) == want
    assert sum(r[1] == 0 for r in want.elements()) == 3  # null, empty, and the text that B does not give back


def test_long_texts_are_cut_where_both_cut(spark, libraries, monkeypatch):
    text = " ".join(odd_texts()[22].split()) + "  two spaces in a long text, " + "more of it and more " * 300
    runs = alignment.Runs(alignment.ByteTokens(tokenizer_path("byte_bpe_50k.json")), alignment.PieceTokens(tokenizer_path("piece_bpe_32k.model")))
    once = [x.to_pylist() for x in runs([text])[1]]
    monkeypatch.setattr(alignment, "STRETCH", 200)
    assert len(list(alignment._stretches(text))) > 20 and "".join(alignment._stretches(text)) == text
    assert [x.to_pylist() for x in runs([text])[1]] == once


def test_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], COLUMNS)).collect() == []
    got = alignment.align(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).collect()
    assert sorted(tuple(r[1:]) for r in got) == [(0, 0, 0, 0, "", 0, 0)] * 2


def test_query(spark, libraries):
    """All columns of the registered query, on a whole table."""
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    want = {}
    for i, row in zip(table.column("doc_id").to_pylist(), plain(table.column("text").to_pylist(), libraries), strict=True):
        want[i] = (*row[:4], hashlib.sha256(row[4].encode()).hexdigest() if row[0] else "", *row[5:])
    got = alignment.op13_alignment(spark, SF).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    rows = {r[0]: tuple(r[1:]) for r in got.collect()}
    large = {i for i, w in want.items() if w[2] >= 4000}  # the plain version leaves their groups out
    assert rows.keys() == want.keys()
    assert all(rows[i] == want[i] for i in want.keys() - large)
    assert all(rows[i][:4] + rows[i][5:] == want[i][:4] + want[i][5:] for i in large)


def test_python_ends_with_the_tokens(spark):
    """One pass of Python; the rest is of Spark's functions."""
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = alignment.aligned(alignment.tokens(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Python" not in plan.replace("MapInArrow", "") and all(f in plan for f in ("array_intersect", "transform", "aggregate", "sequence"))
    assert alignment.aligned(alignment.tokens(docs)).select(F.size("links")).first()[0] == 2


def test_shared_ends_are_looked_for_only_where_they_differ(spark):
    """Runs whose tokens end alike, by far the most, need no sets of ends."""
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = alignment.aligned(alignment.tokens(docs))._jdf.queryExecution().optimizedPlan().toString()
    same = plan.find(".a_ends = ")
    assert 0 <= same < plan.find("array_intersect")
