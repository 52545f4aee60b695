"""Language-model scoring: a causal self-attention model over subword ids, beside a word-count base score.

Ids are held in SLOTS slots: frequent ones have one each, the others share the rest by frequency. The corpus's counts of
neighbouring slots give a smoothed bigram; an attention layer over the context moves its mass between CLASSES groups of
slots that are used alike (by the bigram's leading singular vectors):

    p(id | context) = p(class | attention, last id) * p(slot | class, last id) * p(id | slot)

where the class's logits are the bigram's own and what attention adds. So the untrained model is the bigram, and training
only has to find what the context says beyond the last id. Contexts are overlapping windows: a window scores its last
FRESH ids, each id is scored once, with at least WINDOW - FRESH ids before it unless the text starts later.

All counts and all training go over all texts that may be learned from. Trainers start from the same weights, each on a
part of the texts; Spark adds up what comes out, weighted by how many ids each has seen. A part has TRAINED ids at least,
whatever partitions the table came in; a corpus of fewer is one part, which is gone through several times.

Word counts may be far too many to broadcast. Words that make up more than one HEAD-th of all tokens, fewer than HEAD of
them by that definition, go to the tasks; the rest are joined on the word's hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, arrow_schema, over_texts, settled, table, tokenizer_path
from .packing import word_ids

WINDOW, FRESH = 32, 24
WIDTH, CLASSES, SLOTS, SHARED = 12, 32, 2048, 64
ROUNDS = 1
#: Ids that a trainer learns from, at least; fewer steps leave the weights where they began.
TRAINED = 2 << 20
#: Windows in a step of training, and in one of scoring.
STEP, SCORED_AT_ONCE = 128, 256
#: Ids of the texts that a task holds at once, about.
HELD = 1 << 18
#: Ids whose words are counted at once: a block's different words are rows, of which larger blocks have fewer.
COUNTED_AT_ONCE = 1 << 21
HEAD = 1 << 22
END_WORD = np.uint64(0x5E17E7C0DE0E7D01)  # no word hashes to it but by a chance of 2**-64
END_ID = 49407
N_IDS = 49408
CACHED_WORDS = 250_000


def _sums(a: np.ndarray) -> np.ndarray:
    """Over the last axis, which stays; a product, which is faster for short axes."""
    return _times(a, np.ones((a.shape[-1], 1), np.float32))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for one matrix b, as one product and not one for each window."""
    return (a.reshape(-1, a.shape[-1]) @ b).reshape(*a.shape[:-1], b.shape[1])


def _wider(a: np.ndarray) -> np.ndarray:
    """a with a column of zeros after its last."""
    out = np.zeros((len(a), a.shape[1] + 1), np.float32)
    out[:, :-1] = a
    return out


def _at_most(a: np.ndarray, most: float) -> np.ndarray:
    """a, in place; hardly ever is there anything to do."""
    return np.minimum(a, most, out=a) if a.max(initial=0) > most else a


def _by_slot(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The rows' sums by their slots, of which there are n."""
    return np.stack([np.bincount(at, column, n) for column in rows.T.astype(float, order="C")], 1, dtype=np.float32, casting="same_kind")


#: Which of a window's inputs each scored place may see.
MASK = np.tril(np.ones((FRESH, WINDOW), np.float32), WINDOW - FRESH)


@dataclass
class Attention:
    """One causal attention layer with a residual, float32. The slot after the last stands for no input."""

    embed: np.ndarray
    places: np.ndarray
    query: np.ndarray
    both: np.ndarray  # keys and values
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, features: np.ndarray, classes: int, seed: int = 7) -> Attention:
        """features: slots x WIDTH, of about unit size."""
        rng = np.random.default_rng(seed)
        w = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        embed = np.concatenate((features, np.zeros((1, WIDTH)))).astype(np.float32)
        return cls(embed, w(WINDOW, WIDTH) * np.float32(0.3), w(WIDTH, WIDTH), w(WIDTH, 2 * WIDTH), np.zeros((WIDTH, classes), np.float32), np.zeros(classes, np.float32))

    def joint(self) -> np.ndarray:
        """Queries, keys and values as one matrix for _wider() inputs; its last column makes room for ones beside the values."""
        return _wider(np.concatenate((self.query, self.both, np.zeros((WIDTH, 1), np.float32)), 1).T).T

    @staticmethod
    def seen(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the scored places see of a window's inputs: weights whose sum isn't 1, what each sum is to be multiplied by,
        as often as there are columns, and the mean values, with ones beside them.

        y: windows x WINDOW x what joint() makes of the inputs, with ones in its last column."""
        weights = y[:, WINDOW - FRESH :, :WIDTH] @ y[..., WIDTH : 2 * WIDTH].transpose(0, 2, 1)
        np.exp(_at_most(weights, 30), out=weights)
        weights *= MASK
        mean = weights @ y[..., 2 * WIDTH :]
        share = np.repeat(1 / (mean[..., WIDTH:] + np.float32(1e-30)), WIDTH + 1, -1)
        mean *= share
        return weights, share, mean

    def gradients(self, slots: np.ndarray, prior: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> dict[str, np.ndarray]:
        flat = lambda a: a.reshape(-1, a.shape[-1])
        joint = self.joint()
        x = _wider(self.embed).take(slots, 0)
        x += _wider(self.places)
        y = _times(x, joint)
        y[..., -1] = 1
        weights, share, mean = self.seen(y)
        h = flat(mean + x[:, WINDOW - FRESH :])  # the ones beside it are for the bias
        p = h @ np.concatenate((self.out, self.bias[None]))
        p += flat(prior)
        np.exp(_at_most(p, 60), out=p)
        each = scored.ravel() / np.float32(scored.sum())
        p *= each[:, None] / _sums(p)
        p.reshape(-1)[np.arange(0, p.size, p.shape[1]) + targets.ravel()] -= each
        of_out = h.T @ p
        out = {"out": of_out[:-1], "bias": of_out[-1]}
        dh = (p @ _wider(self.out.T)).reshape(mean.shape)
        # What goes back through the weights' sum is a column beside the values' own.
        back = dh * share
        mean *= back
        np.negative(_sums(mean)[..., 0], out=back[..., WIDTH])
        ds = back @ y[..., 2 * WIDTH :].transpose(0, 2, 1)
        ds *= weights
        dy = np.empty_like(y)
        dy[:, : WINDOW - FRESH, :WIDTH] = 0
        np.matmul(ds, y[..., WIDTH : 2 * WIDTH], out=dy[:, WINDOW - FRESH :, :WIDTH])
        np.matmul(ds.transpose(0, 2, 1), y[:, WINDOW - FRESH :, :WIDTH], out=dy[..., WIDTH : 2 * WIDTH])
        np.matmul(weights.transpose(0, 2, 1), back, out=dy[..., 2 * WIDTH :])
        of_joint = flat(x).T @ flat(dy)
        out |= {"query": of_joint[:-1, :WIDTH], "both": of_joint[:-1, WIDTH:-1]}
        dx = _times(dy, joint.T)
        dx[:, WINDOW - FRESH :] += dh
        out["places"] = (np.ones(len(dx), np.float32) @ dx.reshape(len(dx), -1)).reshape(dx.shape[1:])[:, :-1]
        out["embed"] = _by_slot(slots.ravel(), flat(dx)[:, :-1], len(self.embed))
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in vars(self).values()]).astype(float)

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for name, w in list(vars(self).items()):
            setattr(self, name, flat[at : at + w.size].reshape(w.shape).astype(np.float32))
            at += w.size


class Adam:
    """Steps of training on batches of windows. The layer's weights become parts of one array of its own."""

    def __init__(self, layer: Attention, rate: float = 0.01) -> None:
        self.layer, self.rate, self.step = layer, rate, 0
        self.weights = np.concatenate([w.ravel() for w in vars(layer).values()], dtype=np.float32)
        self.first, self.second = np.zeros_like(self.weights), np.zeros_like(self.weights)
        at = 0
        for name, w in list(vars(layer).items()):
            setattr(layer, name, self.weights[at : at + w.size].reshape(w.shape))
            at += w.size

    def train(self, slots: np.ndarray, prior: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> None:
        self.step += 1
        rate = self.rate / (1 + self.step / 200) ** 0.5
        found = self.layer.gradients(slots, prior, targets, scored)
        g = np.concatenate([found[name].ravel() for name in vars(self.layer)])
        move = g - self.first
        move *= np.float32(0.1)
        self.first += move
        np.multiply(g, g, out=g)
        g -= self.second
        g *= np.float32(0.01)
        self.second += g
        np.divide(self.second, np.float32(1 - 0.99**self.step), out=move)
        np.sqrt(move, out=move)
        move += np.float32(1e-8)
        np.divide(self.first, move, out=move)
        move *= np.float32(rate / (1 - 0.9**self.step))
        self.weights -= move


def cut_windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts as ids: windows of input ids, the ids after the last FRESH of these, which of them count, and each window's text.

    The end id stands before and after each text; -1 is no input. Every id, and the end after it, counts once.
    """
    sizes = np.array([len(t) + 1 for t in texts])
    per_text = -(-sizes // FRESH)
    room = per_text * FRESH + WINDOW - FRESH + 1
    begins = np.cumsum(room) - room
    stream = np.full(int(room.sum()), -1, np.int64)
    at = begins + (WINDOW - FRESH)
    stream[at] = stream[at + sizes] = END_ID
    inside = np.concatenate(texts) if texts else np.empty(0, np.int64)
    shift = np.repeat(at + 1 - (np.cumsum(sizes - 1) - (sizes - 1)), sizes - 1)
    stream[np.arange(len(inside)) + shift] = inside
    of = np.repeat(np.arange(len(texts)), per_text)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    both = np.lib.stride_tricks.sliding_window_view(stream, WINDOW + 1)[begins[of] + nth * FRESH] if len(of) else np.empty((0, WINDOW + 1), np.int64)
    targets = both[:, WINDOW - FRESH + 1 :]
    scored = nth[:, None] * FRESH + np.arange(FRESH) < sizes[of][:, None]
    return both[:, :WINDOW], np.where(scored, targets, END_ID), scored, of


def slots_of(counts: np.ndarray, slots: int = SLOTS, shared: int = SHARED) -> np.ndarray:
    """Each id's slot: the most frequent ids have their own, the others share `shared` ones, alike ones by their counts."""
    order = np.argsort(-counts, kind="stable")
    out = np.empty(len(counts), np.int64)
    alone = min(slots - shared, len(counts))
    out[order[:alone]] = np.arange(alone)
    rest = len(counts) - alone
    out[order[alone:]] = alone + np.arange(rest) * shared // max(1, rest)
    return out


@dataclass
class Model:
    slots: np.ndarray  # of each id
    classes: np.ndarray  # of each slot
    within: np.ndarray  # natural log of an id's share of its slot
    bigram: np.ndarray  # natural log of p(slot | last slot), a row for each last slot
    prior: np.ndarray  # the same of classes
    attention: Attention
    pad: int = field(default=0)

    @classmethod
    def fit(cls, counts: np.ndarray, slots: np.ndarray, pairs: np.ndarray) -> Model:
        """counts: of each id; pairs: how often a slot (column) follows another (row); slots: of each id."""
        n = len(pairs)
        smooth = counts + 0.01
        in_slot = np.bincount(slots, smooth, n)
        within = np.log(smooth / in_slot[slots])
        singles = in_slot / in_slot.sum()
        # Absolute discounting: what is taken from the pairs seen goes to all slots by their own shares.
        rows, kinds = pairs.sum(1, keepdims=True), (pairs > 0).sum(1, keepdims=True)
        taken = 0.75
        left = np.where(rows > 0, taken * kinds / np.maximum(rows, 1), 1.0)
        p = np.maximum(pairs - taken, 0) / np.maximum(rows, 1)
        p += left * singles
        features, classes = _alike(p, singles)
        of_class = np.zeros((n, CLASSES))
        of_class[np.arange(n), classes] = 1
        prior = np.log(np.maximum(p @ of_class, 1e-30))
        layer = Attention.fresh(features, CLASSES)
        return cls(slots, classes, within.astype(np.float32), np.log(p).astype(np.float32), prior.astype(np.float32), layer, n)

    def windows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """As cut_windows(), with slots for inputs."""
        ids, targets, scored, of = cut_windows(texts)
        return np.append(self.slots, self.pad).take(ids), targets, scored, of  # -1, no input, takes the last

    def train(self, adam: Adam, texts: list[np.ndarray]) -> int:
        """One pass over the texts; how many ids they have."""
        slots, targets, scored, _ = self.windows(texts)
        goals = self.classes.take(self.slots.take(targets))
        order = np.random.default_rng(len(slots)).permutation(len(slots))
        for i in range(0, len(order), STEP):
            at = order[i : i + STEP]
            some = slots.take(at, 0)
            last = np.minimum(some[:, WINDOW - FRESH :], self.pad - 1)
            adam.train(some, self.prior.take(last, 0), goals[at], scored[at])
        return int(scored.sum())

    def score(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each text's probability, its end included; and what the bigram alone gives."""
        plain, moved = np.zeros(len(texts)), np.zeros(len(texts))
        if texts:
            layer, slots_too = self.attention, len(self.prior)
            joint = layer.joint()
            # What a slot and what a place add to queries, keys, values and logits is worked out once.
            of_slot, of_place = _wider(layer.embed) @ joint, _wider(layer.places) @ joint
            of_place[:, -1] = 1
            of_last = self.prior + layer.embed[:slots_too] @ layer.out + layer.bias
            of_next, out_of_mean = layer.places[WINDOW - FRESH :] @ layer.out, _wider(layer.out.T).T
            slots, targets, scored, of = self.windows(texts)
            for i in range(0, len(slots), SCORED_AT_ONCE):
                s = slice(i, i + SCORED_AT_ONCE)
                y = of_slot.take(slots[s], 0)
                y += of_place
                mean = layer.seen(y)[-1]
                last = np.minimum(slots[s, WINDOW - FRESH :], self.pad - 1)
                to = self.slots.take(targets[s])
                kind = self.classes.take(to)
                logits = _times(mean, out_of_mean)
                logits += of_last.take(last, 0)
                logits += of_next
                _at_most(logits, 60)
                change = logits.take(np.arange(0, logits.size, CLASSES).reshape(to.shape) + kind)
                change -= np.log(_sums(np.exp(logits, out=logits))[..., 0])
                change -= self.prior.take(last * CLASSES + kind)
                base = self.bigram.take(last * slots_too + to) + self.within.take(targets[s])
                for out, log in ((plain, base), (moved, change)):
                    log[~scored[s]] = 0
                    out += np.bincount(of[s], log.sum(-1, dtype=float), len(texts))
        return (plain + moved) / np.log(10), plain / np.log(10)


def _alike(p: np.ndarray, singles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of slots, and CLASSES classes, from what follows them and what they follow (as far from their shares)."""
    share = np.maximum(singles, 1e-12)
    weight = np.sqrt(share)
    ratio = (weight[:, None] * (p / share - 1) * weight).astype(np.float32)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((len(p), 2 * WIDTH)).astype(np.float32)
    for _ in range(6):  # subspace iteration
        base, _ = np.linalg.qr(ratio @ (ratio.T @ base))
    small = base.T @ ratio
    u, s, vt = np.linalg.svd(small, full_matrices=False)
    before, after = (base @ u[:, :WIDTH]) / weight[:, None], vt[:WIDTH].T / weight[:, None]
    both = np.concatenate((before, after), 1) * np.concatenate((s[:WIDTH], s[:WIDTH]))
    both = np.nan_to_num(both)
    both /= np.maximum(np.linalg.norm(both, axis=1, keepdims=True), 1e-6)
    centres = both[np.linspace(0, len(both) - 1, CLASSES).astype(int)]
    for _ in range(12):
        near = (both @ centres.T).argmax(1)
        for c in range(CLASSES):
            own = near == c
            if own.any():
                centre = (both[own] * share[own, None]).sum(0)
                centres[c] = centre / max(np.linalg.norm(centre), 1e-12)
    features = np.clip(before / np.maximum(np.sqrt((before**2 * share[:, None]).sum(0)), 1e-12), -3, 3)
    return features, near


def learnable(doc_id: Column) -> Column:
    """Rows that may be learned from; those with a null doc_id may not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(False))


class Coder:
    """The word hashes and subword ids of texts.

    A block's words are hashed together. Their ids are known from block to block by these 64-bit hashes, as the corpus's
    counts are, in arrays; only words that aren't known become Python objects. When there are more than `size`, those
    used most stay.
    """

    def __init__(self, path: str, size: int = CACHED_WORDS) -> None:
        self.hasher, self.engine, self.size = WordHasher(lower=False), word_ids(path), size
        self.known, self.place = np.empty(0, np.uint64), np.empty(0, np.int64)  # hashes in order, and where each is in the rest
        self.ids, self.lengths, self.uses = np.empty(0, "<u2"), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        ids = self.engine.encode(words)
        coded = [ids[w] for w in words]
        order = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[order])
        self.known, self.place = np.insert(self.known, at, hashes[order]), np.insert(self.place, at, len(self.place) + order)
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(coded), "<u4").astype("<u2")))
        self.lengths = np.concatenate((self.lengths, np.fromiter(map(len, coded), np.int64, len(coded)) // 4))
        self.uses = np.concatenate((self.uses, np.zeros(len(coded), np.int64)))

    def _forget(self) -> None:
        """Three quarters of `size` stay. Uses count by half from now on, so that words go that aren't used any more."""
        most = 3 * self.size // 4
        stay = np.zeros(len(self.uses), bool)
        stay[np.argpartition(-self.uses, most)[:most]] = True
        self.ids = self.ids[np.repeat(stay, self.lengths)]
        self.lengths, self.uses = self.lengths[stay], self.uses[stay] // 2
        here = stay[self.place]
        self.known, self.place = self.known[here], (np.cumsum(stay) - 1)[self.place[here]]

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """Of different words; -1 for one that isn't known."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.place[at], -1)

    def __call__(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        raw = b" ".join(texts).lower()
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))]
        for begin, part in self.hasher.stretches(raw):
            starts, ends = self.hasher.words(part)
            parts.append((starts + begin, ends + begin, self.hasher.hashed(part, starts, ends)))
        starts, ends, hashes = map(np.concatenate, zip(*parts, strict=True))
        which, every = pd.factorize(hashes)
        places = self._places(every)
        new = np.flatnonzero(places < 0)
        if len(new):
            one = np.empty(len(every), np.int64)
            one[which] = np.arange(len(which))  # where a word occurs
            one = one[new]
            self._learn(every[new], [raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
            places[new] = np.arange(len(self.lengths) - len(new), len(self.lengths))
        self.uses[places] += np.bincount(which, minlength=len(every))
        lengths = self.lengths[places]
        begins = np.cumsum(self.lengths)[places] - lengths
        each = lengths[which]
        stops = np.cumsum(each)
        ids = self.ids[np.arange(each.sum()) + np.repeat(begins[which] - (stops - each), each)]
        if len(self.lengths) > self.size:
            self._forget()
        first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))  # words before each text
        cuts = np.concatenate(([0], stops))[first].tolist()
        first = first.tolist()
        return [(hashes[p:q], ids[a:b]) for p, q, a, b in zip(first[:-1], first[1:], cuts[:-1], cuts[1:], strict=True)]


@lru_cache(1)
def coder_of(path: str) -> Coder:
    """One for each Python worker, whose tasks share the words that it knows, CACHED_WORDS and a block's at most."""
    return Coder(path)


def coded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, words (hashes), ids, learn of each row. Both are little-endian, of 64 and 16 bits."""

    def make():
        code = coder_of(path)

        def work(keys: list, texts: list[str]) -> dict:
            made = code([t.encode() for t in texts])
            return {"doc_id": keys, "words": [w.tobytes() for w, _ in made], "ids": [i.tobytes() for _, i in made]}

        return work

    return over_texts(docs, make, "doc_id long, words binary, ids binary", limit=1 << 21).withColumn("learn", learnable(F.col("doc_id")))


def over_blocks(rows: DataFrame, start: Callable, schema: str, columns: tuple[str, ...], at_once: int = HELD) -> DataFrame:
    """Apply functions to blocks of binary columns, about `at_once` ids at a time. start() gives two: one for a block (a list of
    bytes for each column), one for the end; either gives rows as arrays for the schema's columns, or None."""
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, end = start()
        held: list[list[bytes]] = [[] for _ in columns]
        size = 0

        def out(made) -> Iterator[pa.RecordBatch]:
            if made is not None:
                yield pa.RecordBatch.from_arrays([pa.array(m, type=f.type) for m, f in zip(made, to, strict=True)], schema=to)

        for batch in batches:
            for values in zip(*(batch.column(i) for i in range(len(columns))), strict=True):
                for into, value in zip(held, values, strict=True):
                    into.append(value.as_py())
                size += len(held[-1][-1])
                if size >= 2 * at_once:
                    yield from out(block(*held))
                    held, size = [[] for _ in columns], 0
        if held[0]:
            yield from out(block(*held))
        yield from out(end())

    return rows.select(*columns).mapInArrow(run, schema)


def _ids(raw: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(r, "<u2").astype(np.int64) for r in raw]


def corpus_counts(rows: DataFrame) -> DataFrame:
    """kind, key, n: how often each word (kind 0, by its hash; the end of a text too) and each id (kind 1) occurs in coded rows."""

    def start():
        of_ids = np.zeros(N_IDS, np.int64)

        def block(words: list[bytes], ids: list[bytes]):
            of_ids[:] += np.bincount(np.frombuffer(b"".join(ids), "<u2"), minlength=N_IDS)
            of_ids[END_ID] += len(ids)
            keys, n = np.unique(np.frombuffer(b"".join(words), "<u8"), return_counts=True)
            return np.zeros(len(keys) + 1, np.int32), np.append(keys.view(np.int64), END_WORD.astype(np.int64)), np.append(n, len(ids))

        def end():
            seen = np.flatnonzero(of_ids)
            return np.ones(len(seen), np.int32), seen, of_ids[seen]

        return block, end

    return over_blocks(rows, start, "kind int, key long, n long", ("words", "ids"), COUNTED_AT_ONCE).groupBy("kind", "key").agg(F.sum("n").alias("n"))


def slot_pairs(rows: DataFrame, slots: np.ndarray, n_slots: int) -> np.ndarray:
    """How often each slot (column) follows each (row) in all coded rows: n_slots**2 numbers, whatever the input."""
    known = rows.sparkSession.sparkContext.broadcast(slots)

    def start():
        counts, of = np.zeros(n_slots * n_slots, np.int64), known.value

        def block(ids: list[bytes]):
            stop = np.array([END_ID], "<u2").tobytes()
            s = of[np.frombuffer(stop + stop.join(ids) + stop, "<u2")]
            np.add.at(counts, s[:-1] * n_slots + s[1:], 1)

        def end():
            seen = np.flatnonzero(counts)
            return seen, counts[seen]

        return block, end

    summed = over_blocks(rows, start, "pair long, n long", ("ids",)).groupBy("pair").agg(F.sum("n").alias("n"))
    at, n = _arrays(summed)
    out = np.zeros(n_slots * n_slots)
    out[at] = n
    return out.reshape(n_slots, n_slots)


def trainers(ids: int) -> tuple[int, int]:
    """How many parts a corpus of so many ids is trained in, at most, and how often each goes through its texts."""
    return max(1, ids // TRAINED), max(1, -(-TRAINED // max(1, ids)))


def train_on_all(model: Model, rows: DataFrame, rounds: int = ROUNDS, parts: int | None = None, passes: int = 1) -> list[int]:
    """Train the model's attention layer on all coded rows; gives how many ids each round has learned from.

    A part goes through its texts block by block. What it makes of the weights counts by its ids, so that every text has
    its share in them. parts: at most so many; passes: of each part, whose texts are then held.
    """
    sc, seen = rows.sparkSession.sparkContext, []
    rows = rows if parts is None else rows.coalesce(parts)
    for _ in range(rounds):
        now = sc.broadcast(model)

        def start(now=now):
            m = now.value
            own = Model(**vars(m) | {"attention": Attention(**vars(m.attention))})
            adam, total, held = Adam(own.attention), [0], []

            def block(ids: list[bytes]):
                total[0] += own.train(adam, _ids(ids))
                if passes > 1:
                    held.append(ids)

            def end():
                for _ in range(passes - 1):
                    for ids in held:
                        own.train(adam, _ids(ids))
                if total[0]:
                    w = own.attention.flat()
                    return np.arange(len(w)), w * total[0], np.full(len(w), total[0])

            return block, end

        summed = over_blocks(rows, start, "at int, total double, n long", ("ids",)).groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        at, total, n = _arrays(summed)  # a row for each weight
        if not len(at):
            break
        model.attention.put((total / n)[np.argsort(at)])
        seen.append(int(n[0]))
    return seen


def _arrays(df: DataFrame) -> list[np.ndarray]:
    t = df.toArrow()
    return [t.column(i).to_numpy() for i in range(t.num_columns)]


def fit(rows: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of coded rows, with their corpus_counts()."""
    ids, n = _arrays(counts.where("kind = 1").select("key", "n"))  # N_IDS rows at most
    of_ids = np.zeros(N_IDS)
    of_ids[ids] = n
    slots = slots_of(of_ids)
    model = Model.fit(of_ids, slots, slot_pairs(rows, slots, SLOTS))
    train_on_all(model, rows, rounds, *trainers(int(of_ids.sum())))
    return model


def score_documents(docs: DataFrame, path: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords, bigram_score of each row of docs.

    bigram_score is what the counts alone give, without attention. A null or empty text is its end alone; a row with a
    null doc_id is scored but not learned from; repeated rows count and are scored each; other columns are ignored; an
    empty table gives no rows. With nothing to learn from, all counts are 0 and the attention layer stays untrained.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path("word_bpe_49k.json")
    texts = settled(coded(docs, path))
    allowed = texts.where("learn")
    counts = settled(corpus_counts(allowed))
    words = counts.where("kind = 0").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = total // head + 1
    at_end = F.col("key") == int(END_WORD.astype(np.int64))
    heads, n_heads = _arrays(words.where((F.col("n") >= least) | at_end))  # at most head rows, as each is over total / head, and the end's
    order = np.argsort(heads.view(np.uint64))
    frequent = spark.sparkContext.broadcast((heads.view(np.uint64)[order], np.log10(n_heads[order] + 1.0).astype(np.float64)))
    model = spark.sparkContext.broadcast(fit(allowed, counts))
    scale = float(np.log10(total + distinct + 1))
    schema = "doc_id long, n_tokens long, n_subwords long, score double, bigram_score double, n_head long, head_sum double, rest array<long>"
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, logs), lm = frequent.value, model.value
        sure = len(known) > 0

        def work(keys: list, words: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
            out: dict[str, object] = {"doc_id": keys, "n_tokens": [len(w) + 1 for w in words], "n_subwords": [len(i) + 1 for i in ids]}
            out["score"], out["bigram_score"] = lm.score(ids)
            found, sums, rest = [], [], []
            back, every = pd.factorize(np.concatenate([*words, [END_WORD]]).astype(np.uint64))
            at = np.minimum(np.searchsorted(known, every), max(0, len(known) - 1))
            hit = known[at] == every if sure else np.zeros(len(every), bool)
            log = np.where(hit, logs[at], 0.0) if sure else np.zeros(len(every))
            begin = 0
            for w in words:
                mine = back[begin : begin + len(w)]
                begin += len(w)
                found.append(int(hit[mine].sum()) + int(hit[back[-1]]))
                sums.append(float(log[mine].sum()) + float(log[back[-1]]))
                rest.append(every[mine[~hit[mine]]].view(np.int64))
            out |= {"n_head": found, "head_sum": sums, "rest": rest}
            return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in to], schema=to)

        for batch in batches:
            keys, words, ids, size = [], [], [], 0
            for key, w, i in zip(*(batch.column(c) for c in range(3)), strict=True):
                keys.append(key.as_py())
                words.append(np.frombuffer(w.as_py(), "<u8"))
                ids.append(np.frombuffer(i.as_py(), "<u2").astype(np.int64))
                size += len(ids[-1])
                if size >= HELD:
                    yield work(keys, words, ids)
                    keys, words, ids, size = [], [], [], 0
            if keys:
                yield work(keys, words, ids)

    scored = settled(texts.select("doc_id", "words", "ids").mapInArrow(run, schema)).withColumn("_row", F.monotonically_increasing_id())
    rest = scored.select("_row", F.explode("rest").alias("key")).join(words.where((F.col("n") < least) & ~at_end), "key")
    rest = rest.groupBy("_row").agg(F.count("*").alias("n_rest"), F.sum(F.log10(F.col("n") + 1.0)).alias("rest_sum"))
    base = F.col("head_sum") + F.coalesce("rest_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)
    return scored.join(rest, "_row", "left").select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rest", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        "n_subwords",
        "bigram_score",
    )


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_documents() over all of documents; nulls, empty texts, repeated rows and empty tables as there."""
    return score_documents(table(spark, sf_dir, "documents"))
