"""The operators against plain versions on small tables that hold nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import bpe, language_model, media, near_duplicates, neighbours, packing, pii, quality, repeats, url_filter
from tracewright.llm.common import WordHasher, tokenizer_path, windows

SF = "/root/testdata/sf0.001"


def passage(r, n):
    return " ".join("".join(r.choice("abcdeg") for _ in range(r.randint(1, 6))) for _ in range(n))


def odd_texts():
    r = random.Random(3)
    base, shared = passage(r, 120), passage(r, 60)
    near = base.split()
    near[50] = "changed"
    return [
        None, "", "   \n\t ", "one", "One", "one two three four five", base, base, base.upper(), " ".join(near), base.replace(" ", "\n"),
        passage(r, 40) + " " + shared, shared + " " + passage(r, 70), passage(r, 9000), "é ü 日本語 <|endoftext|> it's",
        "again " * 200, " ".join(["rep eat"] * 90), "x" * 5000, "a  b \n\n c ", "mail me (at) example (dot) com or a.b@c.de +1 (212) 555-0123 and 10.0.0.1",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", i * 2) for i, t in enumerate(odd_texts())]
    rows += [rows[6], (None, "no id at all here", "y", 1), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, length long").repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def by_id(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def test_hashes_of_words():
    h, low = WordHasher(False), WordHasher(True)
    words = "to be or not to be BE tobe".split()
    got = h(" to  be\tor not\nto be BE tobe ".encode()).tolist()
    assert [got.index(x) for x in got] == [words.index(w) for w in words]
    assert low(b"To bE")[1] == low(b"be")[0] and not len(h(b" \n"))
    assert windows(h(b"a b c d"), 2)[1] == windows(h(b"x b c"), 2)[1] and not len(windows(h(b"a"), 2))
    odd = [bytes([97 + bin(i).count("1") % 2 ^ flip for i in range(n)]) for n in (8, 64, 512, 2048) for flip in (0, 1)]
    odd += [b"a\0", b"a", b"\0a", b"y" * 63, b"y" * 64, b"y" * 65, b"y" * 72, b"12345678", b"123456789", bytes(9), bytes(10)]
    assert len(set(h(b" ".join(odd)).tolist())) == len(odd)
    long = " ".join(str(i) for i in range(400_000)).encode()
    assert len(np.unique(h(long))) == 400_000


def thue_morse(n, flip):
    return "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(n))


def test_unlike_words_of_a_pattern_stay(spark):
    """Words that polynomial hashes modulo a power of two can't tell apart."""
    side = [f"w{i}" for i in range(17)]
    rows = [(flip, " ".join([*side, thue_morse(1024, flip), *side])) for flip in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["n_removed"] for r in repeats.remove(docs).collect()] == [0, 0]
    assert {r["component_id"] for r in near_duplicates.near_duplicates(docs).collect()} == {0, 1}


def test_the_automaton_decides(docs):
    text = " ".join(f"w{i % 40}" for i in range(120)).encode()
    words, hasher = text.split(), WordHasher(False)
    phrases = [b" ".join(words[i : i + 12]) for i in range(108)]
    recurring = repeats.Names(*repeats.names(hasher(text), 35, np.arange(86)))
    assert repeats.Shard(phrases, 12).around(words, 35).tolist() == list(range(86))
    assert not len(repeats.Shard([], 12).around(words, 35))
    assert repeats.Shard([b" ".join(words[5:17])], 12).around(words, 35).tolist() == sorted({i for p in (5, 45, 85) for i in range(max(0, p - 23), min(86, p + 1))})
    assert recurring.has(repeats.names(hasher(text), 35, np.arange(86))).all() and not repeats.Names(*np.empty((2, 0), np.uint64)).has(repeats.names(hasher(text), 35, np.arange(86))).any()
    again = b"x y " + text + b" z"
    assert recurring.has(repeats.names(hasher(again), 35, np.arange(89))).tolist() == [False] * 2 + [True] * 86 + [False]
    few = repeats.Shard(phrases, 12)
    few.letters = {w: "\ue000" for w in few.letters}  # all words alike, but compared
    few.automaton, few.exact = repeats.ahocorasick.Automaton(), False
    few.automaton.add_word("\ue000" * 12, phrases[3])
    few.automaton.make_automaton()
    assert few.places(words).tolist() == [3, 43, 83]


def test_odd_columns(spark):
    """Stages keep columns that are named as their own."""
    rows = [(i, t, 1, 2, "k", "o", "r") for i, t in enumerate(odd_texts())]
    named = spark.createDataFrame(rows, "doc_id long, text string, kept int, _of int, of string, `row` string, root string")
    for stage in (repeats.without_repeats, near_duplicates.without_near_duplicates, pii.mask):
        got = stage(named)
        assert got.columns == named.columns and {tuple(r)[2:] for r in got.collect()} == {tuple(rows[0])[2:]}
        assert stage(named.limit(0)).collect() == []


def test_packing(spark, docs, none):
    tokenizer = packing.WordIds(tokenizer_path("word_bpe_49k.json")).tokenizer
    got = packing.pack_documents(docs).collect()
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in odd_texts()]
    for i, want in enumerate(ids):
        own = sorted({(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got if r["doc_id"] == i})
        assert sum(p[1] for p in own) == len(want) and all(p[3] == len(want) for p in own)
        assert all(zlib.crc32(want[a : a + n].tobytes()) == c for a, n, c, _ in own)
    assert len([r for r in got if r["doc_id"] == 6]) == 2
    at = collections.defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in at.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 4096
    assert packing.pack_documents(none).count() == 0


def test_packing_plan():
    r = random.Random(1)
    counts = collections.Counter(r.choice([r.randint(1, 4096), r.randint(100, 900)]) for _ in range(20_000))
    used, sequences = collections.Counter(), 0
    for pattern, times in packing.plan(counts):
        assert sum(n * k for n, k in pattern.items()) <= 4096
        sequences += times
        for n, k in pattern.items():
            used[n] += k * times
    assert used == counts
    assert sequences * 4096 < 1.01 * sum(n * k for n, k in counts.items())


def test_repeats(docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    words = [(t or "").encode().split() for _, t in rows]
    count = collections.Counter(b" ".join(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = {}
    for (_, text), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[b" ".join(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[hashlib.sha256((text or "").encode()).digest()] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode() if any(gone) else None)
    got = {bytes(r["of"]): tuple(r)[1:] for r in repeats.remove(docs).collect()}
    assert got == want
    assert repeats.remove(none).count() == 0
    cleaned = repeats.without_repeats(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()


def jaccard_components(rows, k=5, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((key, len(sets[i]), min(ids, default=None) if sets[i] else key))
    return collections.Counter(out)


@pytest.mark.parametrize("piece", [4096, 3])
def test_near_duplicates(docs, none, piece):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = near_duplicates.near_duplicates(docs, piece=piece)
    assert collections.Counter(map(tuple, got.collect())) == jaccard_components(rows)
    assert near_duplicates.near_duplicates(none).count() == 0


def test_near_duplicates_of_changed_texts(spark):
    """Chains of ever more changed copies, whose ends aren't similar, and sizes around the threshold."""
    r = random.Random(5)
    rows, n = [], 0
    for size in (6, 9, 30, 200):
        words = passage(r, size).split()
        for _ in range(25):
            rows.append((n, " ".join(words)))
            n += 1
            for _ in range(r.randint(1, max(1, size // 30))):
                words[r.randrange(len(words))] = f"w{r.random()}"
            if r.random() < 0.3:
                words.append(f"w{r.random()}")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for piece in (4096, 4):
        got = near_duplicates.near_duplicates(df, piece=piece)
        assert collections.Counter(map(tuple, got.collect())) == jaccard_components(rows)
    kept = near_duplicates.without_near_duplicates(df)
    assert {x["doc_id"] for x in kept.collect()} == {c for _, _, c in jaccard_components(rows)}


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    encoded = bpe.encode_documents(docs)
    for key, rows in by_id(encoded).items():
        for r in rows:
            if key is not None:
                assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(odd_texts()[key] or "", add_special_tokens=False).ids
    for key, rows in by_id(bpe.decode_documents(encoded)).items():
        if key is not None:
            assert {r["text"] for r in rows} == {odd_texts()[key] or ""}
    assert encoded.count() == docs.count() and bpe.encode_documents(none).count() == 0


def test_bpe_of_random_words():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library, encoder, r = Tokenizer.from_file(path), bpe.Encoder(path), random.Random(2)
    for alphabet in ("etaoin shrdlu", "aab ", "0123 .,", "éüß日 ", " \n\t", "'st'reve ll", "\x1c\x85\u2003x "):
        for _ in range(150):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
            assert np.frombuffer(b"".join(encoder.encode(text)), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def plain_identifiers(x):
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, x):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
            if k == 0 or (k == 1 and all(int(p) <= 255 for p in m[0].split("."))) or (k == 2 and 12 <= len(digits) <= 19 and luhn % 10 == 0) or (k == 3 and 9 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_plain_identifiers():
    r = random.Random(4)
    for alphabet in ("a@.b1-", "1.2 0", "12 -3456", "+1 (2).-3", "a1@.+ -(", "0123456789 -"):
        for _ in range(3000):
            x = "".join(r.choice(alphabet) for _ in range(r.randint(0, 30)))
            assert pii.detect(x) == plain_identifiers(x), x


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write john.doe (at) example (dot) com now", "email", "john.doe (at) example (dot) com"),
        ("write john at example dot com now", "email", "john at example dot com"),
        ("write jоhn@exаmple.com now", "email", "jоhn@exаmple.com"),
        ("at １２３.４５.６.７ ok", "ip", "１２３.４５.６.７"),
        ("call plus one two one two five five five one two three four", "phone", "plus one two one two five five five one two three four"),
        ("meet at noon, a dot at the end", None, None),
        ("one two three go", None, None),
    ],
)
def test_disguised_identifiers(text, kind, found):
    base, every = pii.find(text)
    assert base == [] and [(pii.KINDS[k], text[a:b]) for a, k, b in every] == ([(kind, found)] if kind else [])
    assert (found or "\0") not in pii.masked(text)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail alice at example.com now", "email", "alice at example.com"),
        ("mail ALICE AT example.com now", "email", "ALICE AT example.com"),
        ("host one nine two dot one six eight dot one dot one up", "ip", "one nine two dot one six eight dot one dot one"),
        ("One two seven dot zero dot zero dot one", "ip", "One two seven dot zero dot zero dot one"),
        ("we met at noon and left at ten", None, None),
        ("one dot two and three", None, None),
    ],
)
def test_disguises_without_other_hints(text, kind, found):
    base, every = pii.find(text)
    assert base == [] and [(pii.KINDS[k], text[a:b]) for a, k, b in every] == ([(kind, found)] if kind else [])
    assert pii.masked(text) == (text.replace(found, f"[{kind}]") if kind else text)


def test_pii_rows(docs, none):
    got = pii.spans_of(docs)
    assert got.count() == docs.count() and pii.spans_of(none).count() == 0
    (row,) = by_id(got)[19]
    assert [(s["kind"], s["plain"]) for s in row["spans"]] == [("email", False), ("email", True), ("phone", True), ("ip", True)]
    assert pii.mask(docs).columns == docs.columns


def test_quality(spark, docs, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    some = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality.classify(some, labels).where("held_out").join(labels, "doc_id")
    assert got.where("predicted = quality").count() > 0.97 * got.count()
    empty = labels.limit(0)
    assert {r["score"] for r in quality.classify(docs, empty).collect()} == {0.5}
    scored = quality.score(docs, quality.fit(some, labels)).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.classify(none, labels).count() == 0


def test_media(docs, none):
    got = by_id(media.store_and_read(docs))
    for i, text in enumerate(odd_texts()):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        for r in got[i]:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[0][0][1:] == got[1][0][1:] and len(got[6]) == 2
    assert media.store_and_read(none).count() == 0


def test_cuts_follow_content():
    r = np.random.default_rng(1)
    a = r.integers(0, 256, 400_000, dtype=np.uint8).tobytes()
    b = b"something before" + a
    ends = media.cuts(a)
    assert ends[-1] == len(a) and max(np.diff([0, *ends])) <= media.MOST and min(np.diff([0, *ends[:-1]])) >= media.LEAST
    same = {d for d, _ in media.chunks(a)} & {d for d, _ in media.chunks(b)}
    assert len(same) >= len(ends) - 3


def test_urls(spark):
    urls = [
        (1, "http://A.Example.NET/en/x?q"), (2, "https://example.net"), (3, "ftp://example.com/de/a#b"), (4, "http://notexample.com/de/"), (5, "http://x.org/fr/1"),
        (6, None), (7, "no scheme/here"), (8, ""), (9, "http://net/"), (10, "http://a.net?x=/"), (11, "http://u@h.net:80/p"), (12, "x://y://z.net/q"), (1, "http://A.Example.NET/en/x?q"),
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in urls], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.filter_urls(pages).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/") and got[2] == ("example.net", "", None)
    assert got[3] == ("example.com", "/de/a", "example.com/de/") and got[4] == ("notexample.com", "/de/", None)
    assert got[5] == ("x.org", "/fr/1", "org/fr/") and got[6] == got[7] == got[8] == ("", "", None)
    assert got[9] == ("net", "/", "net/") and got[10] == ("a.net", "", None) and got[11] == ("u@h.net:80", "/p", None)
    assert got[12] == ("y:", "//z.net/q", None)
    assert url_filter.filter_urls(pages).count() == len(urls)
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    real = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    spam = url_filter.filter_urls(real).where("rule is null and host rlike 'casino|bets|pills|track'")
    assert spam.where("verdict = 'block'").count() > 0.9 * spam.count()


def test_neighbours(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((600, 16))
    x[100:110] = x[100]
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)]
    odd = [(600, None), (700, [0.0] * 16), (800, [float("nan")] * 16), (900, [1.0] * 5), (None, [1.0] * 16), (1000, [None] * 16), (100, rows[100][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for n in neighbours.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[n["query_id"]].append((n["vec_id"], n["score"]))
    assert set(got) == {0, 100, 200, 300, 400, 500}
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10]
        hits += len(set(want) & {v for v, _ in found})
        assert all(s == d[v] for v, s in found) and found == sorted(found, key=lambda f: (f[1], f[0]))
    assert hits >= 0.9 * 60
    assert [v for v, _ in got[100]][:9] == list(range(101, 110))
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_url_statistics_count_all_rows(spark, monkeypatch):
    """However few URLs the trees learn from; a URL that is a third of all rows counts as one of these, with its weight."""
    many = [(f"http://h{i % 40}.com/s{i % 90}/p{i}", f"h{i % 40}.com", f"/s{i % 90}/p{i}", i % 3 % 2) for i in range(600)]
    labelled = spark.createDataFrame(many + 300 * [("http://hot.org/a/", "hot.org", "/a/", 1)], "url string, host string, path string, label int")
    few, every = url_filter.UrlModel(labelled, 50), url_filter.UrlModel(labelled, 10_000)
    for a, b, n in ((few.suffixes, every.suffixes, 41), (few.sections, every.sections, 361)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == n
    hot = few.suffixes.where("_suffix = 'hot.org'").first()
    assert hot["suffix_n"] == hot["suffix_bad"] == 300
    model = every._assembled(url_filter._sample(labelled, 10_000), F.col("label"), F.col("weight")).where("host = 'hot.org'").first()
    assert (model["suffix_share"], model["suffix_log"]) == (0.5, 0.0)  # its own rows tell it nothing
    judged = every._assembled(labelled).where("host = 'hot.org'").first()
    assert judged["suffix_share"] == pytest.approx(301 / 302) and judged["suffix_log"] == pytest.approx(math.log1p(300))
    for limit in (1, 50, 10_000):
        rows = url_filter._sample(labelled, limit).collect()
        assert 0 < len(rows) <= limit and all(r["weight"] == (300 if r["host"] == "hot.org" else 1) for r in rows)
    assert sum(r["weight"] for r in rows) == 900
    pages = labelled.select(F.xxhash64("url").alias("page_id"), "url").union(spark.createDataFrame([(1, None)], "page_id long, url string"))
    found = sorted(map(str, url_filter.filter_urls(pages).collect()))
    monkeypatch.setattr(url_filter, "FEW", 0)
    assert sorted(map(str, url_filter.filter_urls(pages).collect())) == found


@pytest.mark.parametrize(("n", "far", "block"), [(1, 1, 16384), (2, 1, 16384), (5, 1, 16384), (11, 1, 16384), (400, 4, 16384), (400, 1e6, 60)])
def test_neighbours_are_never_short(spark, monkeypatch, n, far, block):
    """Small tables, and queries far from all rows; far: by how much their norms exceed the others'."""
    monkeypatch.setattr(neighbours, "PART_ROWS", block)
    monkeypatch.setattr(neighbours, "SCAN_QUERIES", 7)
    r = np.random.default_rng(6)
    x = r.standard_normal((n, 64))
    asked = np.arange(n) % (20 if n > 20 else 1) == 0
    x[asked] *= far
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for m in neighbours.nearest(df, F.col("vec_id") % (20 if n > 20 else 1) == 0).orderBy("query_id", "rank").collect():
        assert m["rank"] == len(got[m["query_id"]]) + 1
        got[m["query_id"]].append((m["vec_id"], m["score"]))
    assert set(got) == (set(np.flatnonzero(asked)) if n > 1 else set())
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [v for v in np.lexsort((np.arange(n), d)) if v != q][:10]
        assert len(found) == min(10, n - 1) and q not in dict(found)
        hits += len(set(want) & set(dict(found)))
    assert hits >= 0.9 * sum(map(len, got.values()))


def test_language_model(docs, none):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter(w for i, t in rows if not held(i) for w in [*t.encode().lower().split(), None])
    total, kinds = sum(count.values()), len(count)
    for head in (1 << 20, 8):
        got = language_model.score_documents(docs, head=head).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] is not None:
                words = [*(odd_texts()[r["doc_id"]] or "").encode().lower().split(), None]
                assert r["held_out"] == held(r["doc_id"]) and r["n_tokens"] == len(words) and r["train_tokens"] == total
                assert r["n_known"] == sum(count[w] > 0 for w in words)
                assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in words), rel_tol=1e-9)
            assert r["score"] < 0 and math.isfinite(r["score"])
    assert language_model.score_documents(none).count() == 0


def test_attention_learns_from_every_text(spark):
    """Two corpora with the same counts and the same 256 texts that come first by hash; the order of words differs in the rest."""
    first, ahead, back = "e f", "a b c d " * 40, "d c b a " * 40
    hashes = [F.xxhash64(F.col("id"), F.lit(t)).alias(f"h{i}") for i, t in enumerate((first, ahead, back))]
    rows = spark.range(1500).select("id", language_model.learnable(F.col("id")).alias("learned"), *hashes).collect()
    learned = sorted((r for r in rows if r["learned"]), key=lambda r: r["h0"])
    border = learned[255]["h0"]
    rest = [r["id"] for r in learned[256:] if r["h1"] > border and r["h2"] > border]
    asked = next(r["id"] for r in rows if not r["learned"])
    scores = []
    for text in (ahead, back):
        made = [(r["id"], first) for r in learned[:256]] + [(i, text) for i in rest] + [(asked, ahead)]
        got = language_model.score_documents(spark.createDataFrame(made, "doc_id long, text string"))
        scores.append(got.where(F.col("doc_id") == asked).first()["score"])
    assert scores[0] > scores[1] + 5


def test_every_learnable_id_is_trained_on(docs, none):
    path = tokenizer_path("word_bpe_49k.json")
    rows = language_model.coded(docs, path).where("learn")
    n = sum(len(r["ids"]) // 2 + 1 for r in rows.collect())
    counts = language_model.corpus_counts(rows)
    assert counts.where("kind = 1").agg(F.sum("n")).first()[0] == n
    fresh = language_model.fit(rows, counts)
    assert language_model.train_on_all(fresh, rows, 2) == [n, n]
    assert language_model.train_on_all(fresh, language_model.coded(none, path)) == []


def test_coded_texts(docs):
    path = tokenizer_path("word_bpe_49k.json")
    code, tokenizer = language_model.Coder(path), packing.word_ids(path).tokenizer
    texts = [(r["text"] or "") for r in docs.collect()]
    for _ in range(2):
        for text, (words, ids) in zip(texts, code([t.encode() for t in texts]), strict=True):
            assert (words == WordHasher(lower=True)(text.encode())).all()
            if "<|" not in text:
                assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert code([]) == []


def test_windows_score_each_id_once():
    texts = [np.arange(n) for n in (0, 1, 22, 23, 24, 25, 47, 48, 500)]
    ids, targets, scored, of = language_model.cut_windows(texts)
    for i, t in enumerate(texts):
        at = of == i
        assert targets[at][scored[at]].tolist() == [*t.tolist(), language_model.END_ID]
        fresh = ids[at][:, language_model.WINDOW - language_model.FRESH :]
        assert fresh[scored[at]].tolist() == [language_model.END_ID, *t.tolist()]
        assert (ids[at][0, : language_model.WINDOW - language_model.FRESH] == -1).all()


def learned(texts):
    """As fit() does it with one part."""
    counts = np.bincount(np.concatenate(texts), minlength=language_model.N_IDS).astype(float)
    counts[language_model.END_ID] = len(texts)
    slots = language_model.slots_of(counts)
    pairs = np.zeros((language_model.SLOTS, language_model.SLOTS))
    for t in texts:
        s = slots[np.concatenate(([language_model.END_ID], t, [language_model.END_ID]))]
        np.add.at(pairs, (s[:-1], s[1:]), 1)
    model = language_model.Model.fit(counts, slots, pairs)
    adam = language_model.Adam(model.attention)
    for _ in range(language_model.trainers(int(counts.sum()))[1]):
        model.train(adam, texts)
    return model


def plain_probabilities(m, text):
    """p of every id at each place of a text and at its end, place by place."""
    width, ahead = language_model.WIDTH, language_model.WINDOW - language_model.FRESH
    inputs = [m.slots[i] for i in [language_model.END_ID, *text.tolist()]]
    a, out = m.attention, []
    for t in range(len(inputs)):
        begin = t // language_model.FRESH * language_model.FRESH - ahead
        x = np.array([a.embed[inputs[j] if j >= 0 else m.pad] + a.places[j - begin] for j in range(begin, t + 1)], float)
        q, k, v = x[-1] @ a.query, x @ a.both[:, :width], x @ a.both[:, width:]
        w = np.exp(np.minimum(k @ q, 30))
        logits = (x[-1] + w @ v / w.sum()) @ a.out + a.bias + m.prior[inputs[t]]
        p = np.exp(logits - logits.max())
        p /= p.sum()
        by_slot = np.exp(m.bigram[inputs[t]].astype(float)) * (p / np.exp(m.prior[inputs[t]].astype(float)))[m.classes]
        out.append(by_slot[m.slots] * np.exp(m.within.astype(float)))
    return np.array(out)


def test_attention_learns_and_sums_to_one():
    r = np.random.default_rng(0)
    kinds = [np.array(k) for k in ([3, 5, 9, 11], [3, 7, 9, 2], [900, 5, 9, 40000])]
    texts = [np.concatenate([kinds[i % 3][r.permutation(4)] for _ in range(30)]) for i in range(240)]
    model = learned(texts)
    for text in (texts[0], texts[2][:50], np.array([], np.int64), np.array([49000, 3, 17, 900] * 9)):
        p = plain_probabilities(model, text)
        assert np.allclose(p.sum(1), 1, atol=1e-3)
        want = np.log10(p[np.arange(len(p)), [*text.tolist(), language_model.END_ID]]).sum()
        assert math.isclose(model.score([text, texts[1]])[0][0], want, rel_tol=1e-3)
    both, bigram = model.score(texts)
    assert both.sum() > 0.85 * bigram.sum()  # what the context says beyond the last id


def test_held_out_texts_take_fewer_bits_than_the_bigram(spark):
    """Whatever the partitions that the table comes in: parts of 16 texts learn as well as one of all."""
    docs, found = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), []
    for parts in (1, 16, 64):
        got = language_model.score_documents(docs.repartition(parts)).where("held_out")
        r = got.agg(F.sum("score").alias("s"), F.sum("bigram_score").alias("b"), F.sum("n_subwords").alias("n")).first()
        bits, bigram = (-r[k] * math.log2(10) / r["n"] for k in ("s", "b"))
        found.append(bits)
        assert bits < bigram - 0.25 and bits < 6.03
    assert max(found) - min(found) < 0.05
    assert language_model.trainers(10 * language_model.TRAINED + 5) == (10, 1) and language_model.trainers(0)[0] == 1
