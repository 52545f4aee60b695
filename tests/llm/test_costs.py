"""What operators send, hold and repeat, where a plainer plan gives the same rows at a higher cost."""

from __future__ import annotations

import numpy as np
import pytest

from tracewright.llm import bpe, language_model, near_duplicates, quality
from tracewright.llm.common import WordHasher, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_labels_meet_no_texts(docs, labels, monkeypatch):
    joined, join = [], type(docs).join
    monkeypatch.setattr(type(docs), "join", lambda self, *a, **b: joined.append(self.columns) or join(self, *a, **b))
    quality.classify(docs, labels)
    quality.keep_good(docs, labels)
    assert len(joined) == 2 and not any("text" in columns for columns in joined)


def test_a_task_has_one_python_worker(spark, docs, labels, monkeypatch):
    plans, call = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, *a, **b: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or call(self, *a, **b))
    quality.keep_good(docs, labels)
    # A chain of sets of which each shares a rare shingle with the next only, so that its pieces meet in pairs.
    chain = [" ".join(f"w{i + j}" for j in range(12)) for i in range(0, 60, 6)]
    texts = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    asked = [near_duplicates.near_duplicates(texts, percent=20, piece=p).collect() for p in (2, 4096)]
    assert sorted(asked[0]) == sorted(asked[1])
    assert plans and not any("InArrow" in p for p in plans)


def test_new_words_of_a_block_are_encoded_at_once(monkeypatch):
    calls, plain = [], bpe.Vocabulary.encode_words
    monkeypatch.setattr(bpe.Vocabulary, "encode_words", lambda self, words: calls.append(1) or plain(self, words))
    path = tokenizer_path("byte_bpe_50k.json")
    texts = ["first words", "Other starts here", "", " led by a space", "last one ", "line\nbreak it's 12,5 é 日本"]
    made = [b"".join(x) for x in bpe.Encoder(path).encode_block(texts)]
    assert len(calls) <= 2  # of runs, and of what texts begin with
    monkeypatch.setattr(bpe, "CACHED_RUNS", 1)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 1)
    mixed = ["two  spaces", *texts, "two \n lines <|endoftext|> more", *texts]
    again = [b"".join(x) for x in bpe.Encoder(path).encode_block(mixed)]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in mixed]
    assert again == want and made == want[1 : 1 + len(texts)]
    assert bpe.encoder_of(path) is bpe.encoder_of(path)


def test_gradients_by_slot():
    r = np.random.default_rng(1)
    at, rows = r.integers(0, 50, 400), r.standard_normal((400, 3)).astype(np.float32)
    want = np.stack([np.bincount(at, rows[:, c], 60) for c in range(3)], 1)
    assert np.allclose(language_model._by_slot(at, rows, 60), want, atol=1e-5)
    path = tokenizer_path("word_bpe_49k.json")
    assert language_model.coder_of(path) is language_model.coder_of(path)


def test_frequent_words_stay_known(monkeypatch):
    code, asked = language_model.Coder(tokenizer_path("word_bpe_49k.json"), size=40), []
    encode = code.engine.encode
    monkeypatch.setattr(code.engine, "encode", lambda words: asked.extend(words) or encode(words))
    common = [f"c{chr(97 + i)}".encode() for i in range(10)]
    blocks = [[b" ".join([*common, *(f"n{k}x{i}".encode() for i in range(9))])] for k in range(8)]
    made = [code(block)[0] for block in blocks]
    assert all(asked.count(w) == 1 for w in common) and len(code.known) <= 60
    for block, (words, ids) in zip(blocks, made, strict=True):
        again = language_model.Coder(tokenizer_path("word_bpe_49k.json"), size=1)(block)[0]
        assert (words == again[0]).all() and (ids == again[1]).all()


def test_words_used_most_stay_known(monkeypatch):
    path = tokenizer_path("word_bpe_49k.json")
    code, asked = language_model.Coder(path, size=40), []
    encode = code.engine.encode
    monkeypatch.setattr(code.engine, "encode", lambda words: asked.extend(words) or encode(words))
    common = [f"c{chr(97 + i)}".encode() for i in range(10)]
    rare = [[f"n{k}x{i}".encode() for i in range(25)] for k in range(6)]
    for k in range(6):  # the blocks that fill it up don't hold the common words
        code([b" ".join(common * 3)])
        code([b" ".join(rare[k])])
    assert all(asked.count(w) == 1 for w in common) and len(code.known) <= 40
    # Texts and words at the borders of what is hashed together are the same as alone.
    texts = [b"", b" ", *(b" ".join(common + r) for r in rare), b"Ab\x0bab\x0c" + b"x" * 70 + b"\xc2\x85y", b"cd " * 400_000, b"cd", b"ab\n" * 400_000 + b"e"]
    monkeypatch.undo()
    for text, (words, ids) in zip(texts, code(texts), strict=True):
        split = text.lower().split()
        by_word = encode([*{*split}]) if split else {}
        assert np.array_equal(words, WordHasher(lower=True)(text)) and len(words) == len(split)
        assert np.array_equal(ids, np.frombuffer(b"".join(map(by_word.get, split)), "<u4"))
