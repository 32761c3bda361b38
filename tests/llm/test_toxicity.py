"""Toxicity: the model's algebra, pairs beyond additive weights, held-out accuracy."""

import itertools
import zlib

import numpy as np
import pandas as pd
import pytest

from tests.llm.data import awkward, empty, frame
from tillroll.llm import toxicity as T
from tillroll.llm.common import table


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    fm = T.FactorizationMachine(0.3, rng.normal(size=50).astype(np.float32), rng.normal(0, 0.3, (50, 4)).astype(np.float32))
    row = np.array([1, 5, 17, 30])
    pairs = sum(float(fm.vector[a] @ fm.vector[b]) for a, b in itertools.combinations(row, 2))
    margin = fm.bias + float(fm.weight[row].sum()) + pairs
    assert fm.score(row) == pytest.approx(1 / (1 + np.exp(-margin)), rel=1e-5)


def test_learns_a_pair_that_weights_alone_cannot():
    """Toxic is the insult with the group mention; either alone, with much else, is not."""
    p = T.FmParams(bits=10, epochs=150, min_rows=1, min_z=0.0, l2_pair=1e-4)
    rng = np.random.default_rng(2)
    rows, toxic = [], []
    for _ in range(800):
        a, b = rng.random(2) < 0.5
        rows.append(np.array(sorted({*([1] if a else [2]), *([3] if b else [4])}), np.int32))
        toxic.append(float(a == b))  # exclusive-or: no additive weights separate it
    fm = T.FactorizationMachine.fit(rows, np.array(toxic), p)
    right = [(fm.score(r) > 0.5) == bool(t) for r, t in zip(rows, toxic, strict=True)]
    assert np.mean(right) > 0.95
    fm.vector[:] = 0
    additive = [(fm.score(r) > 0.5) == bool(t) for r, t in zip(rows, toxic, strict=True)]
    assert np.mean(additive) < 0.8


def _pair_rows(seed, n):
    """Toxic is term 1 beside term 3; both are as common in clean rows, 40 other terms are noise."""
    rng = np.random.default_rng(seed)
    rows, toxic = [], []
    for _ in range(n):
        bad = rng.random() < 0.5
        a = rng.random() < 0.5
        b = a if bad else not a
        noise = 10 + np.flatnonzero(rng.random(40) < 0.3)
        rows.append(np.array([*([1] if a else [2]), *([3] if b else [4]), *noise], np.int32))
        toxic.append(float(bad))
    return rows, np.array(toxic)


def test_defaults_learn_a_pair_of_terms_without_a_say_of_their_own():
    rows, toxic = _pair_rows(4, 2000)
    fm = T.FactorizationMachine.fit(rows, toxic, T.FmParams())
    rows, toxic = _pair_rows(5, 1000)
    assert np.mean([(fm.score(r) > 0.5) == bool(t) for r, t in zip(rows, toxic, strict=True)]) > 0.95


def test_paired_terms_against_all_pairs(monkeypatch):
    rng = np.random.default_rng(6)
    rows, toxic = _pair_rows(7, 600)
    rows = [np.unique(np.r_[r, 60 + rng.integers(0, 30, 3)]).astype(np.int32) for r in rows]
    often = np.unique(np.concatenate(rows))
    has = np.array([np.isin(often, r) for r in rows])
    p = T.FmParams()

    def told(within, other):
        n, t = within.sum(), toxic[within].sum()
        n_in, t_in = (within & other).sum(), toxic[within & other].sum()
        return T._told(*(np.array([x], float) for x in (n, t, n_in, t_in)))[0]

    limit = 2 * np.log(len(often) * (len(often) - 1) / 2 / p.pair_chance)  # all terms but rare ones have something to tell
    brute = set()
    for a, b in itertools.combinations(range(len(often)), 2):
        if min(told(has[:, a], has[:, b]), told(has[:, b], has[:, a])) >= limit:
            brute |= {int(often[a]), int(often[b])}
    assert brute == {1, 2, 3, 4}
    assert set(T.paired_terms(rows, toxic, often, p).tolist()) == brute
    monkeypatch.setattr(T, "PAIR_CELLS", 1)  # a block for each term
    assert set(T.paired_terms(rows, toxic, often, p).tolist()) == brute
    assert T.paired_terms(rows, toxic, often[:1], p).tolist() == []


def test_terms():
    assert T.terms(None, 18).tolist() == [] and T.terms(" 12 _", 18).tolist() == []
    assert T.terms("Idiot idiot IDIOT", 18).tolist() == T.terms("idiot", 18).tolist()
    assert set(T.terms("a b", 18).tolist()) == set(T.terms("b  a a", 18).tolist())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = T.score_documents(docs, T.train(docs, labels)).toPandas()
    assert len(scored) == docs.count()
    assert scored["held_out"].tolist() == [zlib.crc32(str(d).encode()) % 3 == 1 for d in scored["doc_id"]]
    both = scored.merge(labels.toPandas(), on="doc_id")
    out = both[both["held_out"]]
    rank = pd.Series(out["score"].to_numpy()).rank().to_numpy()
    y = out["toxic"].to_numpy()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    assert auc > 0.95
    assert out.loc[out["predicted"] == 1, "toxic"].mean() > 0.95
    assert out.loc[out["toxic"] == 1, "predicted"].mean() > 0.7


def test_held_out_labels_and_other_columns_have_no_say(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    one = T.train(docs, labels)
    turned = labels.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - toxic, toxic) AS toxic")
    other = T.train(docs.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source"), turned)
    assert np.array_equal(one.weight, other.weight) and np.array_equal(one.vector, other.vector)


def test_awkward_rows(spark):
    rows = awkward()
    docs = frame(spark, rows)
    labels = spark.createDataFrame(
        [(3, 1), (3, 0), (4, None), (None, 1), (5, 0), (7, 0), (999, 1)], "doc_id long, toxic int"
    )
    model = T.train(docs, labels)
    found = T.score_documents(docs, model).collect()
    assert len(found) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert not any(r.held_out for r in found if r.doc_id is None)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.train(frame(spark, awkward()), none)
    assert {r.score for r in T.score_documents(frame(spark, awkward()), model).collect()} == {0.5}
    assert T.score_documents(empty(spark), T.train(empty(spark), none)).count() == 0
