"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms. Besides a weight, every term has a vector; the score
adds the inner products of all pairs of terms in the text, so pairs such as an insult with
a mention of a group weigh more (or less) than their sum, which additive weights miss. The
sum over pairs needs one pass: ((sum of vectors)^2 - sum of squares) / 2.

Training (AdaGrad on the logistic loss, numpy on the driver) reads about ``max_rows``
labelled documents, those below a cut of a hash of doc_id, and their whole texts; of rows that
share a doc_id, one. Scoring reads every row. The model's size is fixed by ``bits`` and ``rank``.
A term is trained if it departs from the base rate by itself or together with another term:
all pairs of terms of enough rows are counted, so a term without a say of its own is trained
for the pairs that it has a say in. Training all terms instead memorizes the sample. The pairs
cost the square of the terms that can tell anything, which the bound on the sample limits.

Rows: a null or empty text has no terms and the score of the bias. Labels that are null
are left out; a doc_id labelled twice counts as toxic if either label says so. Repeated
rows are scored one by one. Without labels, or with one class only, every score is the
smoothed share of toxic labels.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attention import _hash_cut

_TERM = re.compile(r"[^\W\d_]+")
#: Fixed values of the contract: fold of the held-out rows and the threshold.
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7


@dataclass(frozen=True)
class FmParams:
    bits: int = 18
    rank: int = 8
    max_rows: int = 6_000
    epochs: int = 20
    batch: int = 256
    rate: float = 0.2
    min_rows: int = 5
    min_z: float = 3.5
    pair_chance: float = 0.01
    l2: float = 1e-4
    l2_pair: float = 1e-3
    seed: int = 7


#: Besides words, their beginnings of these lengths are terms: insults inflect and compound.
PREFIXES = (4, 5)


def terms(text: str | None, bits: int) -> np.ndarray:
    """Distinct hashed terms of the whole text, ascending."""
    words = set(_TERM.findall(text.lower())) if text else set()
    if not words:
        return np.empty(0, np.int32)
    found = [*words, *{f"{w[:k]}-" for k in PREFIXES for w in words if len(w) > k}]
    words = np.empty(len(found), object)
    words[:] = found
    return np.unique(pd.util.hash_array(words, categorize=False) >> np.uint64(64 - bits)).astype(np.int32)


@dataclass
class FactorizationMachine:
    bias: float
    weight: np.ndarray
    vector: np.ndarray

    @classmethod
    def fit(cls, rows: list[np.ndarray], toxic: np.ndarray, p: FmParams) -> FactorizationMachine:
        rng = np.random.default_rng(p.seed)
        share = (toxic.sum() + 1.0) / (len(toxic) + 2.0)
        fm = cls(
            float(np.log(share / (1 - share))),
            np.zeros(1 << p.bits, np.float32),
            rng.normal(0, 0.01, (1 << p.bits, p.rank)).astype(np.float32),
        )
        if not 0 < toxic.sum() < len(toxic):
            fm.vector[:] = 0
            return fm
        sum_w = np.full(1 << p.bits, 1e-6, np.float32)  # AdaGrad's sums of squared gradients
        sum_v = np.full((1 << p.bits, p.rank), 1e-6, np.float32)
        # terms of few rows would only memorize them
        used_by = np.bincount(np.concatenate(rows), minlength=1 << p.bits)
        toxic_by = np.bincount(
            np.concatenate(rows), np.repeat(toxic, np.fromiter(map(len, rows), np.int64, len(rows))), 1 << p.bits
        )
        off = (toxic_by - share * used_by) / np.sqrt(np.maximum(used_by, 1) * share * (1 - share))
        often = used_by >= p.min_rows
        seen = often & (np.abs(off) >= p.min_z)
        seen[paired_terms(rows, toxic, np.flatnonzero(often), p)] = True
        rows = [r[seen[r]] for r in rows]
        used = np.flatnonzero([len(r) > 0 for r in rows])
        for _ in range(p.epochs):
            order = rng.permutation(used)
            for k in range(0, len(order), p.batch):
                chosen = order[k : k + p.batch]
                fm._step([rows[i] for i in chosen], toxic[chosen], p, sum_w, sum_v)
        fm.vector[~seen] = 0  # a term without training has no say
        return fm

    def _step(self, rows: list[np.ndarray], toxic: np.ndarray, p: FmParams, sum_w: np.ndarray, sum_v: np.ndarray):
        term = np.concatenate(rows)
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        start = np.cumsum(size) - size
        row = np.repeat(np.arange(len(rows)), size)
        v = self.vector[term]
        total = np.add.reduceat(v, start)
        margin = self.bias + np.add.reduceat(self.weight[term], start)
        margin = margin + 0.5 * ((total**2).sum(1) - np.add.reduceat((v**2).sum(1), start))
        error = (_sigmoid(margin) - toxic).astype(np.float32)
        by_term = np.argsort(term, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(term[by_term]) != 0])
        where = term[by_term][first]
        grad_w = np.add.reduceat(error[row][by_term], first) + p.l2 * self.weight[where]
        pair = (error[row, None] * (total[row] - v))[by_term]
        grad_v = np.add.reduceat(pair, first) + p.l2_pair * self.vector[where]
        sum_w[where] += grad_w**2
        sum_v[where] += grad_v**2
        self.weight[where] -= p.rate * grad_w / np.sqrt(sum_w[where])
        self.vector[where] -= 0.1 * p.rate * grad_v / np.sqrt(sum_v[where])
        self.bias -= p.rate * float(error.mean()) * 0.1

    def score(self, row: np.ndarray) -> float:
        return float(self.scores([row])[0])

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores of several texts' terms, summed over the terms of all of them at once."""
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        margin = np.full(len(rows), self.bias, np.float64)
        some = np.flatnonzero(size)
        if len(some):
            term = np.concatenate([rows[k] for k in some])
            start = np.cumsum(size[some]) - size[some]
            v = self.vector[term].astype(np.float64)
            total = np.add.reduceat(v, start)
            margin[some] += np.add.reduceat(self.weight[term].astype(np.float64), start)
            margin[some] += 0.5 * ((total**2).sum(1) - np.add.reduceat((v**2).sum(1), start))
        return _sigmoid(margin)


#: Pairs are counted in blocks of about this many cells, from so many rows at a time.
PAIR_CELLS, PAIR_ROWS = 1 << 22, 512


def paired_terms(rows: list[np.ndarray], toxic: np.ndarray, often: np.ndarray, p: FmParams) -> np.ndarray:
    """Those of the terms ``often`` (ascending) that form a pair in which each tells something
    about the toxic rows among the other's rows.

    The limit of the likelihood ratio rises with the number of pairs: of pairs without any
    say, ``pair_chance`` are expected to pass. A ratio is never above what there is to tell
    about the rows of either term, so terms below the limit are left out, and not counted
    in it, without losing a pair (Tarone's test); all pairs of the others are counted.
    """
    size = int(often[-1]) + 1 if len(often) else 0
    n_by, toxic_by = np.zeros((2, size))
    for r, t in zip(rows, toxic, strict=True):
        r = r[: np.searchsorted(r, size)]
        n_by[r] += 1
        toxic_by[r] += t > 0
    n_by, toxic_by = n_by[often], toxic_by[often]
    open_to_tell = -2 * _fit(n_by, toxic_by)
    k = np.arange(2, len(often) + 1)
    limits = 2 * np.log(k * (k - 1) / 2 / p.pair_chance)
    enough = np.flatnonzero(np.sort(open_to_tell)[::-1][1:] >= limits)
    if not len(enough):
        return often[:0]
    limit = limits[enough[-1]]
    kept = open_to_tell >= limit
    often, n_by, toxic_by = often[kept], n_by[kept], toxic_by[kept]
    n = len(often)
    place = np.full(size, -1, np.int32)
    place[often] = np.arange(n)
    local = [place[r[: np.searchsorted(r, size)]] for r in rows]
    local = [r[r >= 0] for r in local]
    classes = [[r for r, t in zip(local, toxic, strict=True) if (t > 0) == k] for k in (False, True)]
    found = np.zeros(n, bool)
    step = max(1, PAIR_CELLS // n)
    for first in range(0, n, step):
        width = min(step, n - first)
        both = np.zeros((2, width, n - first), np.float32)  # clean and toxic rows; whole numbers
        for k, of in enumerate(classes):
            for at in range(0, len(of), PAIR_ROWS):
                later = [r[np.searchsorted(r, first) :] - first for r in of[at : at + PAIR_ROWS]]
                x = np.zeros((len(later), n - first), np.float32)
                x[np.repeat(np.arange(len(later)), [len(r) for r in later]), np.concatenate(later)] = 1
                both[k] += x[:, :width].T @ x
        both[0] += both[1]
        a, b = np.nonzero(_may_tell(both, n_by[first:], toxic_by[first:], limit))
        a, b = a[a < b], b[a < b]
        n_ab, t_ab = both[:, a, b].astype(np.float64)
        a, b = a + first, b + first
        tells = np.flatnonzero(
            (_told(n_by[a], toxic_by[a], n_ab, t_ab) >= limit) & (_told(n_by[b], toxic_by[b], n_ab, t_ab) >= limit)
        )
        found[a[tells]] = found[b[tells]] = True
    return often[found]


def _may_tell(both: np.ndarray, n: np.ndarray, t: np.ndarray, limit: float) -> np.ndarray:
    """Pairs of a block whose ratios may reach the limit: none is above twice Pearson's
    chi-square, which needs no logarithms."""
    rate, n = (t / n).astype(np.float32), n.astype(np.float32)
    n_ab, t_ab = both
    may = n_ab > 0
    for r, size in ((rate[: len(n_ab), None], n[: len(n_ab), None]), (rate, n)):
        # a share of the limit covers the rounding
        may &= (t_ab - n_ab * r) ** 2 * size >= 0.49 * np.float32(limit) * r * (1 - r) * n_ab * (size - n_ab)
    return may


def _fit(n: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log-likelihood of t toxic rows of n at their own rate."""
    rate = t / np.maximum(n, 1)
    return t * np.log(np.where(t > 0, rate, 1)) + (n - t) * np.log(np.where(t < n, 1 - rate, 1))


def _told(n: np.ndarray, t: np.ndarray, n_in: np.ndarray, t_in: np.ndarray) -> np.ndarray:
    """Likelihood ratio (chi-square, one degree) of a split of n rows, t of them toxic, into n_in with t_in and the rest."""
    return 2 * (_fit(n_in, t_in) + _fit(n - n_in, t - t_in) - _fit(n, t))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def is_held_out(doc_id: Column) -> Column:
    """Rows never trained on: crc32 of the id as text, modulo 3, is 1 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _terms_of(text: Column, bits: int) -> Column:
    """The terms as 32-bit integers in one binary value, light to collect."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([terms(t, bits).astype("<i4").tobytes() for t in texts], dtype=object)

    return of(text)


def training_rows(docs: DataFrame, labels: DataFrame, p: FmParams) -> DataFrame:
    """(doc_id, toxic, terms): labelled documents that are not held out, one row per id."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    known = _hash_cut(known, p.max_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # max_rows small rows
    chosen = chosen.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return chosen.select("doc_id", "toxic", _terms_of(F.col("text"), p.bits).alias("terms"))


def train(docs: DataFrame, labels: DataFrame, params: FmParams = FmParams()) -> FactorizationMachine:
    found = training_rows(docs, labels, params).collect()  # at most max_rows documents
    rows = sorted((r["doc_id"], r["toxic"], bytes(r["terms"])) for r in found)
    features = [np.frombuffer(t, "<i4") for _, _, t in rows]
    return FactorizationMachine.fit(features, np.array([t for _, t, _ in rows], np.float64), params)


#: Texts that are scored at once.
SLICE = 64


def score_documents(
    docs: DataFrame, model: FactorizationMachine, params: FmParams = FmParams(), text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weight, model.vector))
    bits = params.bits

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        fm = FactorizationMachine(*shared.value)
        out = [np.empty(0)]
        for k in range(0, len(texts), SLICE):  # a few texts' terms at a time
            out.append(fm.scores([terms(t, bits) for t in texts.iloc[k : k + SLICE]]))
        return pd.Series(np.concatenate(out), dtype="float64")

    scored = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), of(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
