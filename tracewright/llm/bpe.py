"""Byte-level BPE, encoding the distinct words of a block by one walk of their trie, and decoding.

A prefix's encoding ends in exactly one token: the vocabulary entry t, a suffix of the prefix, that may follow the last
token of what stands before it ("may follow": merging the bytes of both gives just these two tokens). So a trie node's
state is its last token. Walking the trie depth-first carries the states of the current path down; words that share a
prefix share its states, and a word's ids are read back from its own path.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import over_texts, table, tokenizer_path

#: Fixed values of the byte-level format: how a text is cut into words, and which bytes stand for themselves.
WORD = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

CACHED_WORDS = 300_000
CACHED_RUNS = 400_000
CACHED_PAIRS = 400_000
NEVER = 1 << 40
#: Texts are cut into stretches of about this many characters, at a space between two ASCII letters, where words end.
STRETCH = 1 << 20
TWO_SPACES = regex.compile(r"\s\s")
#: Beyond these, Unicode versions differ on what a letter or a number is.
OTHER_SCRIPTS = regex.compile(r"[^\x00-\u052f\u2000-\u206f\u3040-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")
SAFE_CUT = regex.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {chr(b): b for b in VISIBLE} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(VISIBLE)))}
        self.ids = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        raw = lambda token: self.ids[bytes(byte_of[c] for c in token)]
        self.merges = {(raw(a), raw(b)): (rank, raw(a + b)) for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes = [b""] * size
        for token, i in [*self.ids.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes[i] = token
        self.sizes = list(map(len, self.bytes))
        self.endings = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.endings.add_word(token.decode("latin-1"), i)
        self.endings.make_automaton()
        self.parts = {made: pair for pair, (_, made) in self.merges.items()}
        self._whole: dict[int, bool] = {}
        self._edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._follows: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE of a few bytes: merge the pair of lowest rank, leftmost first, until none is left."""
        seq = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(seq) > 1:
            rank, at = min((self.merges.get(pair, (NEVER, 0))[0], i) for i, pair in enumerate(zip(seq, seq[1:], strict=False)))
            if rank == NEVER:
                break
            seq[at : at + 2] = [self.merges[seq[at], seq[at + 1]][1]]
        return seq

    def whole(self, token: int) -> bool:
        """Whether BPE of a token's own bytes gives that token."""
        if token not in self._whole:
            self._whole[token] = self.merged(self.bytes[token]) == [token]
        return self._whole[token]

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one side (0 left, 1 right) while a token is merged, each with the rank that ends it."""
        if (token, side) not in self._edges:
            out, rank, part = [], NEVER, token
            while True:
                out.append((part, rank))
                if part not in self.parts:
                    break
                rank, part = self.merges[self.parts[part]][0], self.parts[part][side]
            self._edges[token, side] = out
        return self._edges[token, side]

    def follows(self, before: int, token: int) -> bool:
        """Whether BPE leaves the border between two whole tokens alone: no merge across it comes before its parts go."""
        known = self._follows.get((before, token))
        if known is None:
            known = self.whole(token)
            for left, left_ends in self.edge(before, 1):
                for right, right_ends in self.edge(token, 0):
                    rank = self.merges.get((left, right), (NEVER, 0))[0]
                    if rank < left_ends and rank <= right_ends and rank != NEVER:
                        known = False
            if len(self._follows) > CACHED_PAIRS:
                self._follows.clear()
            self._follows[before, token] = known
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct words, as little-endian unsigned 32-bit integers.

        Sorted words visit the trie's nodes depth-first, so that only the states of the current path are kept: last[i]
        is the last token of the path's first i bytes. An automaton of all vocabulary entries names those that end at
        a node, longest first.
        """
        out: dict[str, bytes] = {}
        before, last, follows, sizes, ending = b"", [0], self._follows, self.sizes, self.endings.iter
        for data, word in sorted((w.encode(), w) for w in words):
            shared, most = 0, min(len(before), len(data))
            while shared < most and before[shared] == data[shared]:
                shared += 1
            del last[shared + 1 :]
            done = shared
            for at, token in ending(data.decode("latin-1")):
                if at >= done:
                    start = at + 1 - sizes[token]
                    if start:
                        fits = follows.get((last[start], token))
                        fits = self.follows(last[start], token) if fits is None else fits
                    else:
                        fits = self.whole(token)
                    if fits:
                        last.append(token)
                        done = at + 1
            if done < len(data):
                raise ValueError("the vocabulary lacks a byte")
            ids, end = [], len(data)
            while end:
                ids.append(last[end])
                end -= sizes[last[end]]
            out[word] = array("I", reversed(ids)).tobytes()
            before = data
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


class Encoder:
    """Texts to ids. Keeps the ids of frequent words, and of frequent runs between spaces, from block to block."""

    def __init__(self, path: str) -> None:
        self.vocabulary, self.path = Vocabulary(path), path
        self.find_words = regex.compile(WORD).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.vocabulary.special)) + ")") if self.vocabulary.special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.older_runs: dict[str, bytes] = {}
        self.library = None

    def words(self, text: str) -> list[str]:
        """How the format cuts a text. Letters of the newest scripts: as the library's own tables have them."""
        if text.isascii() or not OTHER_SCRIPTS.search(text):
            return self.find_words(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def learn(self, words: set[str]) -> None:
        if new := words.difference(self.known):
            kept = {w: ids for w in new if (ids := self.older.get(w))}
            if len(self.known) + len(new) > CACHED_WORDS:
                self.older = self.known
                self.known = {w: self.known[w] for w in words.intersection(self.known)}
            self.known |= kept
            self.known |= self.vocabulary.encode_words(new.difference(kept))

    def learn_runs(self, runs: set[str]) -> None:
        """runs: what stands between single spaces. A space before it is part of its first word."""
        if new := runs.difference(self.runs):
            kept = {r: ids for r in new if (ids := self.older_runs.get(r))}
            if len(self.runs) + len(new) > CACHED_RUNS:
                self.older_runs = self.runs
                self.runs = {r: self.runs[r] for r in runs.intersection(self.runs)}
            self.runs |= kept
            cut = {run: self.words(f" {run}") for run in new.difference(kept)}
            self.learn({w for words in cut.values() for w in words})
            self.runs |= {run: b"".join(map(self.known.__getitem__, words)) for run, words in cut.items()}

    def stretches(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > STRETCH and (cut := SAFE_CUT.search(text, at + STRETCH)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> Iterator[bytes]:
        """A text's ids as bytes, a stretch at a time."""
        for part in self.special.split(text) if self.special and self.special.search(text) else [text]:
            if part in self.vocabulary.special:
                yield np.array([self.vocabulary.special[part]], "<u4").tobytes()
                continue
            for stretch in self.stretches(part):
                if TWO_SPACES.search(stretch):  # words then depend on what stands beside them
                    words = self.words(stretch)
                    self.learn(set(words))
                    yield b"".join(map(self.known.__getitem__, words))
                else:
                    first, *runs = stretch.split(" ")
                    words = self.words(first)
                    self.learn_runs(set(runs))
                    self.learn(set(words))
                    yield b"".join(map(self.known.__getitem__, words)) + b"".join(map(self.runs.__getitem__, runs))

    def encode_block(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        """For each text its ids, in stretches. One trie holds the new words of all texts of the block."""
        plain = {i: x.split(" ") for i, x in enumerate(texts) if len(x) <= STRETCH and not TWO_SPACES.search(x) and not (self.special and self.special.search(x))}
        first = {i: self.words(runs[0]) for i, runs in plain.items()}
        # All at once, and before the other texts, which may send what is learned here out of the caches.
        self.learn_runs(set().union(*(runs[1:] for runs in plain.values())))
        self.learn({w for words in first.values() for w in words})
        made = {i: b"".join([*map(self.known.__getitem__, first[i]), *map(self.runs.__getitem__, runs[1:])]) for i, runs in plain.items()}
        for i, text in enumerate(texts):
            yield iter([made[i]]) if i in made else self.encode(text)


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One for each Python worker: tables and caches of bounded size, which its tasks share."""
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) of each whole text, as the vocabulary's own library gives them.

    A null or empty text has no ids. Each row stands for itself, also with a null or repeated doc_id; other columns are
    ignored; an empty table gives no rows.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")

    def make():
        encoder = encoder_of(path)

        def work(keys: list, texts: list[str]) -> dict:
            return {"doc_id": keys, "ids": [b"".join(x) for x in encoder.encode_block(texts)]}

        return work

    return over_texts(docs, make, "doc_id long, ids binary", limit=1 << 20)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of what encode_documents gives; bytes that aren't UTF-8 become U+FFFD."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def make():
        vocabulary = encoder_of(path).vocabulary

        def work(keys: list, ids: list[bytes]) -> dict:
            return {"doc_id": keys, "text": [vocabulary.decode(np.frombuffer(x or b"", "<u4")).decode(errors="replace") for x in ids]}

        return work

    return over_texts(encoded, make, "doc_id long, text string", columns=("doc_id", "ids"))


def _utf8(raw: bytes) -> bytes:
    """What decoding it and encoding that again gives."""
    try:
        raw.decode()
    except UnicodeDecodeError:
        return raw.decode(errors="replace").encode()
    return raw


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the text decoded from them, made in one pass: neither needs to leave its task."""
    path = tokenizer_path("byte_bpe_50k.json")

    def make():
        encoder = encoder_of(path)
        vocabulary = encoder.vocabulary

        def work(keys: list, texts: list[str]) -> dict:
            out: dict[str, list] = {"doc_id": keys, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for stretches in encoder.encode_block(texts):
                n, of_ids, decoded = 0, hashlib.sha256(), []
                for ids in stretches:
                    n += len(ids) // 4
                    of_ids.update(ids)
                    decoded.append(vocabulary.decode(np.frombuffer(ids, "<u4")))
                text = _utf8(b"".join(decoded))
                out["n_tokens"].append(n)
                out["ids_sha256"].append(of_ids.hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(text).hexdigest())
            return out

        return work

    return over_texts(table(spark, sf_dir, "documents"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", limit=1 << 20)
