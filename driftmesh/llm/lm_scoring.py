"""Language-model scores: a causal self-attention model on subword ids, beside word counts over the whole corpus.

Counts. Every word of every training text is counted; workers fold words before the shuffle. N, V and the counts are
those of all training tokens, the end of each text among them. The most frequent words, `head_words` at most, are
broadcast with their counts; the others meet their counts in a join, with the network's probability of each occurrence,
so that both scores use the true count of every word, for any vocabulary.

Model. Every text is written once as the places of its words among the head words; a table of the head words' ids, small
enough for a broadcast, turns places into subword ids, and only other words are written with their ids. One layer of causal attention over a window of ids
predicts the class of the next id; classes are learnt from the neighbourhoods of ids in all training texts, and within a
class ids follow their counts over all training texts (taken from the counts of words). The network's weights start from
a fit in numpy on at most `sample_rows` training rows; from there each shard of all training rows fits an epoch of its own
(more where it is small), and the weights are averaged, an id's by its occurrences, so every training row counts whatever
their number. A word's probability mixes the product over its ids with its smoothed share (c+1)/(N+V+1), as in the base;
the weight of the network goes by the size of c, two dozen numbers, fitted to all tokens of all training rows with each
word left out of its own count (tokens are counted by how the network's probability compares with the share, in steps of
two hundredths of its logarithm). The network runs once over every text: its probability of each word is kept, the
logarithm to 1/262144, until the mixture is known. Windows overlap: each has `context` ids that only give context and `stride` ids that are scored, so every id is
scored once, in batches with a causal mask. Both softmaxes are taken from their maximum.

Texts are lower-cased A-Z; words part at ASCII white space; null counts as empty, whose only token is the end. Rows whose
crc32 of the id is held out are scored, not learnt from. Null and repeated ids are rows like others. Without training
rows the base score is that of empty counts and the model is uniform over classes. An empty table gives no rows. Texts
are read whole, very long ones too; a word of any length is one token. Other columns, whatever their names, are not looked
at.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmesh.llm.common import discard, giving_back, materialize, slices
from driftmesh.llm.packing import Remembered, WordTokenizer

HEAD_WORDS = 300_000
SAMPLE_ROWS = 800
#: Rows of a shard, and the ids after which a shard of long texts is cut.
SHARD_ROWS, SHARD_IDS = 2_000, 1_000_000
#: Steps that a shard takes at least, by repeating its rows.
LEAST_STEPS = 200
CLASSES = 128
WIDTH = 16
CONTEXT, STRIDE = 8, 24
#: Distinct words that a worker counts before it hands them on.
COUNTED = 120_000
CACHE_WORDS = 100_000
#: Ids of the tokenizer's marks for start and end of text.
START_ID, END_ID = 49_406, 49_407
IDS = 49_408
#: log10 of the probability of a word without ids.
NO_IDS = -9.0

#: Stands before the ids of each word in a written text; no id of the tokenizer is as large.
MARK = 0xFFFF
#: Sizes of counts by which the network's weight in the mixture goes: powers of two up to this.
COUNT_SIZES = 24
#: Steps to one, and the end either way, of the natural logs by which tokens are counted when the mixture is fitted.
RATIO_STEPS, RATIO_END = 50, 60
RATIOS = 2 * RATIO_STEPS * RATIO_END
#: Windows that a kernel takes at a time: its arrays stay in a core's cache, and small enough that their memory is used
#: again, where larger ones would come fresh from the system each time.
PART = 64
#: Steps to each doubling of counts when head words are chosen.
LEVELS = 8


def split_words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over all rows of (text); the end of text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "c"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                counts.update(split_words(text))
                counts[b""] += 1
            if len(counts) > COUNTED:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return rows.mapInArrow(giving_back(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class AttentionModel:
    """class_of: of each id; within: log of its share of the class; mix: weight of the network by the size of a count."""

    class_of: np.ndarray
    within: np.ndarray
    weights: dict[str, np.ndarray]
    mix: np.ndarray = field(default_factory=lambda: np.full(COUNT_SIZES, 0.5))

    def windows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs (windows x (CONTEXT + STRIDE)), targets (windows x STRIDE, -1 where there is none) of id sequences."""
        sizes = np.array([len(t) for t in texts])
        counts = -(-sizes // STRIDE)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        padded = np.full(int(counts.sum()) * STRIDE, -1, np.int32)
        for t, s in zip(texts, starts):
            padded[s * STRIDE : s * STRIDE + len(t)] = t
        targets = padded.reshape(-1, STRIDE)
        inputs = np.full((len(targets), CONTEXT + STRIDE), START_ID, np.int32)
        inputs[:, CONTEXT + 1 :] = targets[:, :-1]
        follows = np.ones(len(targets), bool)
        follows[starts] = False
        later = np.flatnonzero(follows)
        inputs[later, : CONTEXT + 1] = targets[later - 1, STRIDE - CONTEXT - 1 :]
        np.maximum(inputs, 0, out=inputs)
        return inputs, targets, sizes

    def log_probs(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of each target's probability; meaningless where the target is -1."""
        w = self.weights
        out = np.empty(targets.shape, np.float32)
        last = _last(w)
        for at in range(0, len(inputs), PART):
            x, y = inputs[at : at + PART], np.maximum(targets[at : at + PART], 0)
            h, mine, q, k, v, attn, total = _attend(w, x)
            logits = _with_one(_flat(mine) + _flat(np.matmul(attn, v)) / total) @ last
            target = logits[np.arange(len(logits)), self.class_of.take(y.ravel())]
            top = _top(logits)
            p, total = _exponentials(logits, None if top is None else -top)
            shift = 0 if top is None else top[:, 0]
            out[at : at + PART] = (target - shift - np.log(total[:, 0])).reshape(y.shape) + self.within.take(y)
        return out


def _flat(a: np.ndarray) -> np.ndarray:
    return a.reshape(-1, a.shape[-1])


def _sides(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w["k"], w["v"]], axis=1)


def _last(w: dict[str, np.ndarray]) -> np.ndarray:
    """The last layer, its bias as the row of a one."""
    return np.concatenate([w["out"], w["bias"][None]])


def _with_one(z: np.ndarray) -> np.ndarray:
    return np.concatenate([z, np.ones((len(z), 1), z.dtype)], axis=1)


def _attend(w: dict[str, np.ndarray], x: np.ndarray):
    """(all places, those that are scored, their queries, keys, values, attention not yet divided by its sums, the sums)."""
    h = w["emb"].take(x, axis=0) + w["pos"]
    mine = np.ascontiguousarray(h[:, CONTEXT:])
    k, v = ((_flat(h) @ w[c]).reshape(h.shape) for c in "kv")
    q = (_flat(mine) @ w["q"]).reshape(mine.shape)
    attn, total = _exponentials(np.matmul(q, k.transpose(0, 2, 1)), _HIDDEN)
    return h, mine, q, k, v, attn, total


#: Exponents up to this, either way, neither overflow nor vanish in single precision, sums of thousands included.
SAFE = 60.0


def _top(x: np.ndarray) -> np.ndarray | None:
    """The maximum of each row, where exponentials need it."""
    return None if -SAFE < x.min(initial=0) and x.max(initial=0) < SAFE else x.max(axis=-1, keepdims=True)


def _exponentials(x: np.ndarray, add: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """exp of x + add, in place, and the sums of its rows as a column. From the maximum of each row, where the values are
    not small; what add hides stays hidden."""
    if add is _HIDDEN:
        top = _top(x)
        x += _HIDDEN
        if top is not None:
            x -= x.max(axis=-1, keepdims=True)
    elif add is not None:
        x += add
    np.exp(x, out=x)
    flat = _flat(x)
    return x, flat @ np.ones((flat.shape[1], 1), x.dtype)


#: Added to scores: what a place may not look at gets no weight.
_HIDDEN = np.where(np.arange(CONTEXT + STRIDE)[None, :] <= np.arange(CONTEXT, CONTEXT + STRIDE)[:, None], 0, -1e30).astype(np.float32)


COMMON_IDS = 96


def common_places(totals: np.ndarray) -> np.ndarray:
    """Of each id its place among the most frequent ids, or -1."""
    place = np.full(IDS, -1)
    place[np.argsort(-totals, kind="stable")[:COMMON_IDS]] = np.arange(COMMON_IDS)
    return place


def add_neighbours(table: np.ndarray, stream: np.ndarray, place: np.ndarray) -> None:
    """Adds to table (IDS x 2 COMMON_IDS) how often a common id stands up to three places after, or before, each id of the
    same text; stream: the ids of texts, each with its end."""
    ends = stream == END_ID
    text = np.cumsum(ends) - ends
    at, flat, row = place[stream], table.reshape(-1), stream.astype(np.int64) * (2 * COMMON_IDS)
    one = table.dtype.type(1)  # of another type it takes numpy ten times as long
    for shift in (1, 2, 3):
        same = text[shift:] == text[:-shift]
        after, before = np.flatnonzero(same & (at[shift:] >= 0)), np.flatnonzero(same & (at[:-shift] >= 0))
        np.add.at(flat, row[after] + at[after + shift], one)
        np.add.at(flat, row[before + shift] + (at[before] + COMMON_IDS), one)


def cluster(table: np.ndarray, totals: np.ndarray, classes: int, seed: int = 3) -> np.ndarray:
    """A class for each id: ids of the training texts by neighbours (k-means on square roots of shares), others last."""
    rng = np.random.default_rng(seed)
    class_of = np.full(IDS, classes - 1, np.int32)
    seen = np.flatnonzero(totals)
    if len(seen) < 2:
        return class_of
    shares = table[seen].astype(np.float32)
    shares = np.sqrt(shares / np.maximum(shares.sum(axis=1, keepdims=True), 1))
    weight = totals[seen].astype(np.float64)
    k = min(classes - 1, len(seen))
    centres = shares[rng.choice(len(seen), k, replace=False, p=weight / weight.sum())]
    for _ in range(12):
        nearest = np.argmax(shares @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        for c in range(k):
            mine = nearest == c
            if mine.any():
                centres[c] = np.average(shares[mine], axis=0, weights=weight[mine])
    class_of[seen] = nearest
    return class_of


def train_model(texts: list[np.ndarray], totals: np.ndarray, classes: int = CLASSES, width: int = WIDTH, epochs: int = 4, rate: float = 0.01, seed: int = 5, table: np.ndarray | None = None) -> AttentionModel:
    """texts: id sequences, each with its end. totals, table: counts of ids and neighbours over all training texts."""
    rng = np.random.default_rng(seed)
    if table is None:
        table = np.zeros((IDS, 2 * COMMON_IDS), np.int32)
        add_neighbours(table, np.concatenate(texts) if texts else np.zeros(0, np.int64), common_places(totals))
    class_of = cluster(table, totals, classes)
    mass = np.bincount(class_of, totals + 0.5, minlength=classes)
    within = np.log((totals + 0.5) / mass[class_of]).astype(np.float32)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(width), shape)
    w = {"emb": draw(IDS, width) * 0.5, "pos": draw(CONTEXT + STRIDE, width) * 0.1, "q": draw(width, width), "k": draw(width, width), "v": draw(width, width), "out": draw(width, classes) * 0.3, "bias": np.log(np.maximum(mass, 1e-12) / mass.sum())}
    model = AttentionModel(class_of, within, {k: v.astype(np.float32) for k, v in w.items()})
    if texts:
        fit_weights(model, texts, epochs, rate, rng)
    return model


def fit_weights(model: AttentionModel, texts: list[np.ndarray], epochs: int, rate: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, int]:
    """Adam on windows, from the weights that the model has; returns the ids met, how often, and the number of targets.

    The row of an id and its moments change in the steps that meet the id."""
    inputs, targets, _ = model.windows(texts)
    times = np.bincount(inputs.ravel(), minlength=IDS)
    ids = np.flatnonzero(times)
    times, place = times[ids], np.zeros(IDS, np.int32)
    place[ids] = np.arange(len(ids))
    x_all = place[inputs]
    classes = np.where(targets < 0, np.int32(-1), model.class_of[np.maximum(targets, 0)])
    every, w = model.weights["emb"], {k: (v[ids] if k == "emb" else v.copy()) for k, v in model.weights.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(inputs))
        for at in range(0, len(order), 128):
            pick = order[at : at + 128]
            step += 1
            met, g = gradients(w, x_all[pick], classes[pick])
            for name, dw in g.items():
                rows = met if name == "emb" else slice(None)
                one = 0.9 * first[name][rows] + 0.1 * dw
                two = 0.99 * second[name][rows] + 0.01 * dw * dw
                first[name][rows], second[name][rows] = one, two
                w[name][rows] -= rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
    emb = every.copy()
    emb[ids] = w["emb"]
    model.weights = {k: v.astype(np.float32) for k, v in (w | {"emb": emb}).items()}
    return ids, times, int((targets >= 0).sum())


def gradients(w: dict[str, np.ndarray], x: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of the mean cross-entropy over the targets that are not -1; by hand, back through the one layer. The gradient of
    emb is for the ids that come first."""
    times = np.bincount(x.ravel(), minlength=len(w["emb"]))
    met = np.flatnonzero(times)
    place = np.zeros(len(times), np.int32)
    place[met] = np.arange(len(met))
    sides, last, real = _sides(w), _last(w), classes >= 0
    back, share = np.ascontiguousarray(w["out"].T), 1 / max(1, real.sum())
    out, of_last = {k: np.zeros_like(w[k]) for k in ("pos", "q", "k", "v")}, np.zeros_like(last)
    dh = np.empty((*x.shape, w["emb"].shape[1]), last.dtype)
    for at in range(0, len(x), PART):
        part = slice(at, at + PART)
        h, mine, q, k, v, attn, total = _attend(w, x[part])
        attn /= total.reshape(*attn.shape[:2], 1)
        z = _with_one(_flat(mine) + _flat(np.matmul(attn, v)))
        d = z @ last
        top = _top(d)
        d, total = _exponentials(d, None if top is None else -top)
        # the gradient of a row of d is this over its total, times its share; both go to the narrower factors
        d[np.arange(len(d)), np.maximum(classes[part], 0).ravel()] -= total[:, 0]
        scale = (real[part].reshape(-1, 1) * share).astype(d.dtype) / total
        of_last += (z * scale).T @ d
        dz = (d @ back * scale).reshape(mine.shape)
        da = np.matmul(dz, v.transpose(0, 2, 1))
        dv = np.matmul(attn.transpose(0, 2, 1), dz)
        da *= attn
        da -= attn * (_flat(da) @ np.ones((da.shape[2], 1), da.dtype)).reshape(*da.shape[:2], 1)
        dq, dk = np.matmul(da, k), np.matmul(da.transpose(0, 2, 1), q)
        dkv = np.concatenate([_flat(dk), _flat(dv)], axis=1)
        of_k, of_v = np.split(_flat(h).T @ dkv, 2, axis=1)
        for name, dw in (("q", _flat(mine).T @ _flat(dq)), ("k", of_k), ("v", of_v)):
            out[name] += dw
        here = dh[part]
        np.matmul(dkv, sides.T, out=here.reshape(len(dkv), -1))
        here[:, CONTEXT:] += dz + (_flat(dq) @ w["q"].T).reshape(dz.shape)
        out["pos"] += here.sum(axis=0)
    width = dh.shape[2]
    cells = (place[x].reshape(-1, 1) * width + np.arange(width)).ravel()
    of_emb = np.bincount(cells, dh.ravel(), minlength=len(met) * width).reshape(-1, width).astype(dh.dtype)
    return met, out | {"out": of_last[:-1], "bias": of_last[-1], "emb": of_emb}


def count_size(counts: np.ndarray) -> np.ndarray:
    """The place in the mixture's weights: the largest power of two not over c + 1."""
    return np.minimum(np.frexp(np.asarray(counts, np.float64) + 1)[1] - 1, COUNT_SIZES - 1)


def read_stream(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each word) of a written text."""
    stream = np.frombuffer(raw, np.uint16)
    marks = np.flatnonzero(stream == MARK)
    return stream[stream != MARK].astype(np.int32), np.diff(np.append(marks, len(stream))) - 1


class TextEncoder:
    """Encodes texts in a worker: one look-up gives a word's mark and ids, another its place among the head words."""

    def __init__(self, tokenizer_file: str, head: dict[bytes, int]):
        self.tokenizer, self.head = WordTokenizer(tokenizer_file, CACHE_WORDS // 10), head
        self.look_up = Remembered(self._fill, CACHE_WORDS)
        self.mark = array("H", [MARK]).tobytes()
        self.end = np.array([MARK, END_ID], np.uint16).tobytes()

    def _fill(self, words: list[bytes]) -> list[bytes]:
        """A mark and the ids of each word. Words of ASCII letters are parts of their own and stand for themselves in the
        table of bytes; all others go the tokenizer's whole way."""
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        if plain:
            texts = b"\n".join([words[i] for i in plain]).decode().split("\n")
            for i, done in zip(plain, self.tokenizer.model.encode_batch_fast(texts, add_special_tokens=False)):
                out[i] = self.mark + array("H", done.ids).tobytes()
        others = [i for i, found in enumerate(out) if found is None]
        for i, ids in zip(others, self.tokenizer._words([words[i].decode() for i in others])):
            out[i] = self.mark + np.frombuffer(ids, np.uint32).astype(np.uint16).tobytes()
        return out

    def encode(self, text: str) -> tuple[bytes, bytes, list[bytes]]:
        """The stream of marks and ids, of each word its place among the head words (from 1; 0: not one), and the words
        that are none; the end of text is the empty word."""
        words = split_words(text)
        stream = b"".join([*self.look_up(words), self.end])
        words.append(b"")
        places = list(map(self.head.get, words, repeat(0)))
        return stream, array("I", places).tobytes(), [w for w, p in zip(words, places) if not p] if 0 in places else []

    def places(self, text: str) -> tuple[bytes, bytes, list[bytes]]:
        """As encode() gives, with a stream of the words only that are no head words, and the places by to_planes()."""
        words = split_words(text)
        words.append(b"")
        places = list(map(self.head.get, words, repeat(0)))
        rare = [w for w, p in zip(words, places) if not p] if 0 in places else []
        stream = b"".join([self.look_up([w])[0] if w else self.end for w in rare]) if b"" in rare else b"".join(self.look_up(rare)) if rare else b""
        return to_planes(np.array(places, np.uint32)), stream, rare


def to_planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as all their highest bytes, then the next, to the lowest; small numbers so compress well."""
    return numbers.astype(">u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(">u4").ravel().astype(np.int64)


@dataclass
class HeadWords:
    """ids of the head words, one after the other; of each place, from 1, where they begin and how many there are."""

    ids: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, streams: list[bytes]) -> HeadWords:
        """From the ids of each head word, as unsigned 16-bit integers."""
        sizes = np.array([0, *[len(s) // 2 for s in streams]], np.int64)
        return cls(np.frombuffer(b"".join(streams), np.uint16), np.cumsum(sizes) - sizes, sizes)

    def expand(self, places: list[bytes], rare: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the texts, ids of each word, words of each text, places) of what TextEncoder.places() gives."""
        parts = [from_planes(p) for p in places]
        at = np.concatenate(parts)
        others, of_other = read_stream(b"".join(rare))
        starts, sizes, gaps = self.starts[at], self.sizes[at], np.flatnonzero(at == 0)
        starts[gaps], sizes[gaps] = len(self.ids) + np.cumsum(of_other) - of_other, of_other
        ends = np.cumsum(sizes)
        ids = np.concatenate([self.ids, others.astype(np.uint16)])[np.arange(int(ends[-1])) + np.repeat(starts - (ends - sizes), sizes)]
        return ids.astype(np.int32), sizes, np.array([len(p) for p in parts]), at

    def texts(self, places: list[bytes], rare: list[bytes]) -> list[np.ndarray]:
        ids, sizes, lengths, _ = self.expand(places, rare)
        return split_texts(ids, sizes, lengths)


def split_texts(ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(lengths)]
    return np.split(ids, ends[:-1])


def probs_of_words(model: AttentionModel, texts: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
    """The network's natural log of the probability of every word of the texts; counts: the ids of each word."""
    inputs, targets, _ = model.windows(texts)
    logs = model.log_probs(inputs, targets)[targets >= 0].astype(np.float64)
    sums, ends = np.concatenate([[0.0], np.cumsum(logs)]), np.cumsum(counts)
    return np.where(counts > 0, sums[ends] - sums[ends - counts], NO_IDS * np.log(10))


def word_probs(model: AttentionModel, streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The network's probability of every word of the texts, and the number of words of each text."""
    texts = [read_stream(s) for s in streams]
    logs = probs_of_words(model, [ids for ids, _ in texts], np.concatenate([c for _, c in texts]))
    return np.exp(logs), np.array([len(c) for _, c in texts])


#: Steps to one of the logarithms of probabilities that are kept, 32 bits each: none above 1e-7000 is cut.
KEPT_STEPS = 1 << 18


def kept(logs: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(logs * -KEPT_STEPS), 2**32 - 1).astype(np.uint32)


def score_texts(model: AttentionModel, head_counts: np.ndarray, norm: float, streams: list[bytes], places: list[bytes]):
    """For each text: tokens, head tokens, their base score and model score, and of other words the network's
    probability of each occurrence."""
    of_ids, lengths = word_probs(model, streams)
    return score_words(model.mix, head_counts, norm, of_ids, lengths, np.frombuffer(b"".join(places), np.uint32).astype(np.int64))


def score_words(mixture: np.ndarray, head_counts: np.ndarray, norm: float, of_ids: np.ndarray, lengths: np.ndarray, at: np.ndarray):
    """score_texts() from the network's probability of every word and its place among the head words."""
    firsts = np.cumsum(lengths) - lengths
    shares = (head_counts + 1) / norm
    known, share, mix = at > 0, shares[at], mixture[count_size(head_counts)][at]
    base = np.add.reduceat(np.where(known, np.log10(shares)[at], 0.0), firsts)
    scores = np.add.reduceat(np.where(known, np.log10(mix * of_ids + (1 - mix) * share), 0.0), firsts)
    n_known = np.add.reduceat(known.astype(np.int64), firsts)
    rest = [p[~k] for p, k in zip(np.split(of_ids, firsts[1:]), np.split(known, firsts[1:]))] if not known.all() else [of_ids[:0]] * len(firsts)
    return lengths, n_known, base, scores, rest


#: The least probability of the network that is told apart from zero.
LEAST = 1e-300


def ratio_places(of_ids: np.ndarray, counts: np.ndarray, norm: float) -> np.ndarray:
    """Of each token its place in a table (COUNT_SIZES x RATIOS): the size of its count, from which it is left out, and the
    log of the network's probability over its share."""
    left = np.maximum(counts - 1, 0)
    ratio = np.floor(np.log(np.maximum(of_ids, LEAST) * norm / (left + 1)) * RATIO_STEPS) + RATIOS // 2
    return count_size(left).astype(np.int64) * RATIOS + np.clip(ratio, 0, RATIOS - 1).astype(np.int64)


def fit_mix(tokens: np.ndarray) -> np.ndarray:
    """The network's weight by the size of a count, by expectation maximisation over tokens counted by ratio_places()."""
    ratio = np.exp((np.arange(RATIOS) + 0.5) / RATIO_STEPS - RATIO_END)
    tokens, mix = tokens.reshape(COUNT_SIZES, RATIOS), np.full((COUNT_SIZES, 1), 0.5)
    for _ in range(30):
        part = mix * ratio / (mix * ratio + 1 - mix)
        mix = ((tokens * part).sum(axis=1, keepdims=True) + 0.5) / (tokens.sum(axis=1, keepdims=True) + 1)
    return np.clip(mix[:, 0], 0.02, 0.98)


def network_probs(encoded: DataFrame, others: DataFrame, model: AttentionModel, words: HeadWords, head_counts: np.ndarray, norm: float) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """The network once over all rows of `encoded`; others: (word, c) of words that are no head words. Returns
    (row, doc_id, held_out, places, probs) with kept() logarithms by to_planes(), (row, held_out, p, c) of the other words'
    occurrences, c 0 for those that no training text has, and the counts that fit_mix() takes, over all training tokens. A
    count a place reaches the driver."""
    shared = encoded.sparkSession.sparkContext.broadcast((model, words, head_counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words, head_counts = shared.value
        table = np.zeros(COUNT_SIZES * RATIOS, np.int64)
        for batch in slices(batches, 64):
            held_out, places = batch.column("held_out").to_numpy(zero_copy_only=False), batch.column("places").to_pylist()
            ids, sizes, lengths, at = words.expand(places, batch.column("rare_ids").to_pylist())
            numbers = kept(probs_of_words(model, split_texts(ids, sizes, lengths), sizes))
            of_ids, ends = np.exp(numbers / -KEPT_STEPS), np.cumsum(lengths)
            learnt = (at > 0) & ~np.repeat(held_out, lengths)
            table += np.bincount(ratio_places(of_ids[learnt], head_counts[at[learnt]], norm), minlength=len(table))
            probs = [to_planes(n) for n in np.split(numbers, ends[:-1])]
            gaps = np.flatnonzero(at == 0)
            cuts = np.searchsorted(gaps, np.concatenate([[0], ends])).astype(np.int32)
            p = pa.ListArray.from_arrays(cuts, pa.array(of_ids[gaps]))
            nothing = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("held_out"), batch.column("places"), pa.array(probs, pa.binary()), batch.column("rare"), p, nothing, nothing], names=_names(_PROBS))
        found = np.flatnonzero(table)
        columns = [pa.nulls(len(found), t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(found), pa.array(table[found])], names=_names(_PROBS))

    written = materialize(encoded.mapInArrow(giving_back(run), _PROBS), "probs")
    discard(encoded)
    asked = written.filter("row is not null").select("row", "held_out", F.explode(F.arrays_zip("rare", "rare_probs")).alias("o")).select("row", "held_out", F.col("o.rare").alias("word"), F.col("o.rare_probs").alias("p"))
    met = materialize(asked.join(others, "word", "left").select("row", "held_out", "p", F.coalesce("c", F.lit(0)).alias("c")), "rare")
    left = F.greatest(F.col("c") - 1, F.lit(0))
    size = F.least(F.length(F.bin(left + 1)) - 1, F.lit(COUNT_SIZES - 1)).cast("long")
    ratio = F.floor(F.ln(F.greatest(F.col("p"), F.lit(LEAST)) * F.lit(float(norm)) / (left + 1)) * RATIO_STEPS) + RATIOS // 2
    rare = met.filter("not held_out").select((size * RATIOS + F.greatest(F.lit(0), F.least(F.lit(RATIOS - 1), ratio))).alias("place"), F.lit(1).cast("long").alias("n"))
    counted = written.filter("place is not null").select("place", "n").unionByName(rare).groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(COUNT_SIZES * RATIOS, np.int64)
    table[counted["place"].to_numpy()] = counted["n"].to_numpy()
    return written.filter("row is not null").select("row", "doc_id", "held_out", "places", "probs"), met, table


def _ids(raw: bytes) -> np.ndarray:
    return read_stream(raw)[0]


def averaged_weights(encoded: DataFrame, model: AttentionModel, words: HeadWords, shards: int, rate: float = 0.003) -> dict[str, np.ndarray]:
    """The weights after an epoch over all rows of (row, places, rare_ids): each shard starts from the model's; their mean counts
    a shard by its targets, and the row of an id by how often the shard met the id."""
    shared = encoded.sparkSession.sparkContext.broadcast((model, words))
    width, dense = model.weights["emb"].shape[1], [k for k in model.weights if k != "emb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, words = shared.value
        emb, met, rest, n = np.zeros((IDS, width)), np.zeros(IDS), {k: np.zeros(start.weights[k].shape) for k in dense}, 0

        def learn(shard, texts):
            nonlocal n
            own = AttentionModel(start.class_of, start.within, dict(start.weights))
            windows = sum(-(-len(t) // STRIDE) for t in texts)
            epochs = -(-LEAST_STEPS // -(-windows // 128))  # one, but for small shards
            ids, times, targets = fit_weights(own, texts, epochs, rate, np.random.default_rng(shard))
            emb[ids] += own.weights["emb"][ids].astype(np.float64) * times[:, None]
            met[ids] += times
            for k in dense:
                rest[k] += own.weights[k].astype(np.float64) * targets
            n += targets

        at, texts, held = None, [], 0
        for batch in slices(batches):
            for shard, ids in zip(batch.column(0).to_pylist(), words.texts(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if texts and (shard != at or held > SHARD_IDS):
                    learn(at, texts)
                    texts, held = [], 0
                at, held = shard, held + len(ids)
                texts.append(ids.astype(np.uint16))
        if texts:
            learn(at, texts)
        if n:
            seen = np.flatnonzero(met)
            vectors = [pa.array(c) for c in emb[seen].T]
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(met[seen]), *vectors], names=names)
            flat = np.concatenate([rest[k].ravel() for k in dense])
            lines = np.zeros((-(-len(flat) // width), width))
            lines.reshape(-1)[: len(flat)] = flat
            yield pa.RecordBatch.from_arrays([pa.array(IDS + np.arange(len(lines)), pa.int64()), pa.array(np.full(len(lines), float(n))), *[pa.array(c) for c in lines.T]], names=names)

    names = ["id", "n", *[f"w{k}" for k in range(width)]]
    dealt = encoded.select(F.pmod(F.xxhash64("places", "rare_ids"), F.lit(shards)).alias("shard"), "row", "places", "rare_ids").repartition("shard").sortWithinPartitions("shard", "row").drop("row")
    sums = dealt.mapInArrow(giving_back(run), "id long, " + ", ".join(f"{c} double" for c in names[1:])).groupBy("id").agg(*[F.sum(c).alias(c) for c in names[1:]])
    got = sums.orderBy("id").toPandas()
    ids, means = got["id"].to_numpy(), (got[names[2:]].to_numpy() / got[["n"]].to_numpy()).astype(np.float32)
    mine = ids < IDS
    out = {"emb": np.tile(np.average(means[mine], axis=0, weights=got["n"].to_numpy()[mine]).astype(np.float32), (IDS, 1))}  # ids of no training text
    out["emb"][ids[mine]] = means[mine]
    flat, at = means[~mine].ravel(), 0
    for k in dense:
        shape = model.weights[k].shape
        out[k] = flat[at : at + int(np.prod(shape))].reshape(shape)
        at += int(np.prod(shape))
    return out


_ENCODED = "row long, doc_id long, held_out boolean, places binary, rare_ids binary, rare array<binary>"
_PROBS = "row long, doc_id long, held_out boolean, places binary, probs binary, rare array<binary>, rare_probs array<double>, place long, n long"
_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def lm_scores(docs: DataFrame, held_out: Column, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; held_out: over docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = materialize(word_counts(rows.filter(~F.col("held_out")).select("text")), "words")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(total["n"]), int(total["v"])
    norm = n + 1.0 * (v + 1)

    # head words: those of the highest levels of counts that hold at most head_words; a level is an eighth of a doubling
    level = F.floor(F.log2(F.col("c").cast("double")) * LEVELS).cast("int")
    levels = {r["level"]: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}
    least, held = 64 * LEVELS + 1, 0
    for k in sorted(levels, reverse=True):
        if held + levels[k] > head_words:
            break
        least, held = k, held + levels[k]

    def head_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_file, 1_000)
        for batch in slices(batches, 8192):
            words = batch.column(0).to_pylist()
            ids = [np.frombuffer(i, np.uint32).astype(np.uint16).tobytes() for i in tokenizer._words([w.decode() for w in words])]
            own = [i if w else np.array([END_ID], np.uint16).tobytes() for w, i in zip(words, ids)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary())], names=["word", "c", "ids"])

    found = counts.filter(level >= least).coalesce(spark.sparkContext.defaultParallelism)
    head_table = found.mapInArrow(giving_back(head_ids), "word binary, c long, ids binary").toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    head = {w: i for i, w in enumerate(head_table["word"].to_pylist(), 1)}
    words = HeadWords.of(head_table["ids"].to_pylist())
    head_counts = np.concatenate([[0], head_table["c"].to_numpy()]).astype(np.float64)
    del head_table

    def id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, tokenizer = np.zeros(IDS), WordTokenizer(tokenizer_file, 1_000)  # words come once each
        for batch in slices(batches, 8192):
            words = batch.column(0).to_pylist()
            ids = tokenizer._words([w.decode() for w in words])
            times = np.repeat(batch.column(1).to_numpy().astype(np.float64), [len(i) // 4 for i in ids])
            sums += np.bincount(np.frombuffer(b"".join(ids), np.uint32), times, minlength=IDS)[:IDS]
            sums[END_ID] += sum(c for w, c in zip(words, batch.column(1).to_pylist()) if not w)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sums[found], pa.float64())], names=["id", "n"])

    totals = np.zeros(IDS)
    for r in counts.mapInArrow(giving_back(id_counts), "id long, n double").groupBy("id").agg(F.sum("n").alias("n")).collect():  # one row per id of the tokenizer at most
        totals[r["id"]] = r["n"]

    # every text as places of its words, once for all that follows
    shared_head, shared_words = spark.sparkContext.broadcast(head), spark.sparkContext.broadcast(words)  # head_words bounds them

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(tokenizer_file, shared_head.value)
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            places, streams, rare = zip(*[encoder.places(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([
                pa.array(range(row, row + batch.num_rows), pa.int64()), batch.column(0), batch.column(2), pa.array(places, pa.binary()), pa.array(streams, pa.binary()), pa.array(rare, pa.list_(pa.binary())),
            ], names=_names(_ENCODED))
            row += batch.num_rows

    encoded = materialize(rows.mapInArrow(giving_back(encode), _ENCODED), "encoded")
    training = encoded.filter(~F.col("held_out"))
    n_rows = training.count()
    place = common_places(totals)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words = np.zeros((IDS, 2 * COMMON_IDS), np.int32), shared_words.value
        for batch in slices(batches):
            add_neighbours(table, words.expand(batch.column(0).to_pylist(), batch.column(1).to_pylist())[0], place)
        for at in range(0, IDS, 4096):
            i, j = np.nonzero(table[at : at + 4096])
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(i + at, pa.int32()), pa.array(j, pa.int32()), pa.array(table[i + at, j], pa.int64())], names=["id", "place", "n"])

    table = np.zeros((IDS, 2 * COMMON_IDS), np.float32)
    found = training.select("places", "rare_ids").mapInArrow(giving_back(neighbours), "id int, place int, n long").groupBy("id", "place").agg(F.sum("n").cast("float").alias("n"))
    by_id = found.groupBy("id").agg(F.collect_list("place").alias("places"), F.collect_list("n").alias("times"))
    for part in by_id.select("id", "places", "times").toArrow().to_batches():  # a row per id of the tokenizer at most
        for i, at, times in zip(part.column(0).to_pylist(), part.column(1), part.column(2)):
            table[i, at.values.to_numpy()] = times.values.to_numpy()

    chosen = encoded.filter(~F.col("held_out")).select("doc_id", "row").orderBy(F.xxhash64("doc_id"), "row").limit(sample_rows).select("row")
    sample = encoded.join(F.broadcast(chosen), "row", "left_semi").select("places", "rare_ids").toArrow()
    texts = words.texts(sample["places"].to_pylist(), sample["rare_ids"].to_pylist()) if sample.num_rows else []
    model = train_model(sorted(texts, key=lambda ids: ids.tobytes()), totals, table=table)
    if n_rows:
        model.weights = averaged_weights(training.select("row", "places", "rare_ids"), model, words, -(-n_rows // SHARD_ROWS))
    probs, met, tokens = network_probs(encoded, counts.filter(level < least), model, words, head_counts, norm - 1)
    discard(counts)
    if n_rows:
        model.mix = fit_mix(tokens)
    shared = spark.sparkContext.broadcast((model.mix, head_counts))  # head_words bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix, head_counts = shared.value
        for batch in slices(batches, 64):
            parts = [from_planes(p) for p in batch.column(3).to_pylist()]
            of_ids = np.exp(np.concatenate([from_planes(p) for p in batch.column(4).to_pylist()]) / -KEPT_STEPS)
            lengths, n_known, base, scores, _ = score_words(mix, head_counts, norm, of_ids, np.array([len(p) for p in parts]), np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lengths, pa.int64()), pa.array(n_known), pa.array(base), pa.array(scores)], names=_names(_SCORED))

    scored = materialize(probs.mapInArrow(giving_back(run), _SCORED), "scored")
    discard(probs)
    size = F.least(F.length(F.bin(F.col("c") + 1)) - 1, F.lit(COUNT_SIZES - 1))
    mix, share = F.get(F.array(*[F.lit(float(x)) for x in model.mix]), size), (F.col("c") + 1) / F.lit(norm)
    rest = met.groupBy("row").agg(
        F.sum(F.log10(share)).alias("base"), F.sum((F.col("c") > 0).cast("long")).alias("known"), F.sum(F.log10(mix * F.col("p") + (1 - mix) * share)).alias("mixed")
    )
    return scored.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("mixed", F.lit(0.0))).alias("score"),
    )
