"""Toxicity by a factorization machine over hashed terms.

A text's terms are its lower-case words and their beginnings of four to nine letters, hashed. The terms most unlike
between toxic and other texts (chi-squared on document counts, from the sample) are kept; a factorization machine then
learns a weight for each and, by factors, an interaction for each pair of terms that meet in a text, so an insult can
count for more beside a mention of a group than alone.

The machine is fitted on a sample of labelled rows of at most `sample_rows`: those of least hash of doc_id. Everything
else covers all rows and whole texts, very long ones too. Null and empty texts have no terms and get the score of the
intercept. Labels that are null are left out, rows that repeat a doc_id among the labels count once, toxic if any is; of
documents that repeat one, the least text is learnt from, and each is scored. Without both labels in the sample the score
is the smoothed share of toxic rows, at most one half. An empty table gives no rows. Other columns of the input, whatever
their names, are not looked at.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.llm.common import SLICE_ROWS, crc_of_id, give_back, giving_back, materialize, slices

SAMPLE_ROWS = 12_000
TERMS = 2_048
BUCKET_BITS = 22
FACTORS = 8
#: The score from which a text is predicted to be toxic.
THRESHOLD = 0.7
CACHE_WORDS = 300_000
BEGINNINGS = (4, 5, 6, 7, 8, 9)

_letters = re.compile(r"[^\W\d_]+")
_MASK = (1 << BUCKET_BITS) - 1


def term_buckets(token: str) -> list[int]:
    """Hashes of the terms of a token that is lower-case and without white space."""
    out = []
    for word in _letters.findall(token):
        raw = word.encode()
        out.append(zlib.crc32(raw) & _MASK)
        out += [zlib.crc32(word[:k].encode() + b"*") & _MASK for k in BEGINNINGS if len(word) >= k]
    return out


@dataclass
class FactorizationMachine:
    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def decision(self, x: np.ndarray) -> np.ndarray:
        met = x @ self.factors
        return self.bias + x @ self.weights + 0.5 * ((met**2) - (x * x) @ (self.factors**2)).sum(axis=1)

    def score(self, places: list[int]) -> float:
        return float(self.scores([places])[0])

    def scores(self, rows: list) -> np.ndarray:
        """Of each row of places: bias, weights, and half of (sum of factors squared - sum of squared factors)."""
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter(itertools.chain.from_iterable(rows), np.int64, int(sizes.sum()))
        z, full = np.full(len(rows), self.bias), sizes > 0
        if len(flat):
            starts = (np.cumsum(sizes) - sizes)[full]
            v = self.factors[flat]
            pairs = np.add.reduceat(v, starts, axis=0) ** 2 - np.add.reduceat(v * v, starts, axis=0)
            z[full] += np.add.reduceat(self.weights[flat], starts) + 0.5 * pairs.sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[list[int]], labels: np.ndarray, buckets: np.ndarray, epochs: int = 25, rate: float = 0.2, decay: float = 1e-4, seed: int = 7) -> FactorizationMachine:
    """rows: the places in buckets of each text's terms. Logistic loss, AdaGrad over shuffled batches."""
    rng = np.random.default_rng(seed)
    n, k = len(rows), len(buckets)
    share = (labels.sum() + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    w, v = np.zeros(k), rng.normal(0, 0.02, (k, FACTORS))
    if not n or not k or labels.min() == labels.max():
        return FactorizationMachine(buckets, min(bias, 0.0), w, np.zeros((k, FACTORS)))
    gw, gv, gb = np.full(k, 1e-6), np.full((k, FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            pick = order[at : at + 256]
            x = np.zeros((len(pick), k))
            for i, row in enumerate(pick):
                x[i, rows[row]] = 1.0
            met = x @ v
            z = bias + x @ w + 0.5 * (met**2 - x @ (v**2)).sum(axis=1)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)
            dw = x.T @ err + decay * w
            dv = x.T @ (err[:, None] * met) - (x.T @ err)[:, None] * v + decay * v
            db = err.sum()
            gw += dw**2
            gv += dv**2
            gb += db**2
            w -= rate * dw / np.sqrt(gw)
            v -= 0.25 * rate * dv / np.sqrt(gv)
            bias -= rate * db / np.sqrt(gb)
    return FactorizationMachine(buckets, float(bias), w, v)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list[int]] = {}
    for batch in slices(batches):
        out = []
        for text in batch.column(1).to_pylist():
            found: set[int] = set()
            if len(known) > CACHE_WORDS:
                known.clear()
            for token in set(text.lower().split()):
                terms = known.get(token)
                if terms is None:
                    terms = known[token] = term_buckets(token)
                found.update(terms)
            out.append(np.fromiter(found, np.int32, len(found)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["toxic", "terms"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, terms: int = TERMS) -> FactorizationMachine:
    """Fits on the given labels; at most sample_rows rows of at most `terms` small numbers reach the driver."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = materialize(rows.select("toxic", "text").mapInArrow(giving_back(_terms), "toxic int, terms array<int>"), "terms")
    total = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if not total["n"]:
        return fit([], np.zeros(0), np.zeros(0, np.int64))
    n, t = float(total["n"]), float(total["toxic"])
    counts = found.select("toxic", F.explode("terms").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("df"), F.sum("toxic").alias("hit"))
    gap = F.col("hit") * n - F.col("df") * t
    chi = gap * gap / (F.col("df") * (n + 1 - F.col("df")))  # chi-squared up to a factor that all terms share
    kept = [r["bucket"] for r in counts.orderBy(chi.desc(), "bucket").limit(terms).select("bucket").collect()]
    buckets = np.sort(np.array(kept, np.int64))
    wanted = F.array(*[F.lit(int(b)) for b in buckets])
    texts = found.select("toxic", F.array_sort(F.array_intersect("terms", wanted)).alias("terms")).toPandas() if len(kept) else found.select("toxic").toPandas()
    places = [np.searchsorted(buckets, x).tolist() for x in texts["terms"]] if len(kept) else [[] for _ in range(len(texts))]
    order = sorted(range(len(places)), key=lambda i: (places[i], int(texts["toxic"].iloc[i])))  # the fit must not hang on the order of rows
    return fit([places[i] for i in order], texts["toxic"].to_numpy(np.float64)[order], buckets)


def scorer(model: FactorizationMachine):
    """A Column function: the score of a text column."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        place = {int(b): i for i, b in enumerate(model.buckets)}
        known: dict[str, tuple[int, ...]] = {}
        for texts in parts:
            rows = []
            for text in texts:
                if len(known) > CACHE_WORDS:
                    known.clear()
                found: set[int] = set()
                for token in set((text or "").lower().split()):
                    terms = known.get(token)
                    if terms is None:
                        terms = known[token] = tuple(place[b] for b in term_buckets(token) if b in place)
                    if terms:
                        found.update(terms)
                rows.append(sorted(found))
            yield pd.Series(np.concatenate([model.scores(rows[at : at + SLICE_ROWS]) for at in range(0, len(rows), SLICE_ROWS)]) if rows else [], dtype="float64")
        del place, known
        give_back()

    return score


def learnable(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels that are not held out: crc32 of the id as text, modulo 3, is not 1."""
    return labels.filter(crc_of_id(id_col) % 3 != 1)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = train(docs, learnable(labels, id_col), id_col, text_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), scorer(model)(F.col(text_col)).alias("score"))
    return rows.select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
