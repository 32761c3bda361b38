"""Substring dedup against a brute-force reading of its contract."""

import random

import numpy as np
import pytest

from tests.llm.data import awkward, empty, frame
from tillroll.llm import substring
from tillroll.llm.common import LAST


def brute(rows, window):
    least = {}
    order = lambda d: LAST if d is None else d
    split = [(order(d), (t or "").encode().split()) for d, t in rows]
    for o, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, o), o)
    out = []
    for (d, _), (o, w) in zip(rows, split, strict=True):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < o:
                gone[i : i + window] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        out.append((str(d), len(w), int(gone.sum()), kept))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in df.collect())


def test_awkward_rows(spark):
    rows = awkward()
    found = substring.cut_repeats(frame(spark, rows))
    assert got(found) == brute([(d, t) for d, t, *_ in rows], 50)


@pytest.mark.parametrize(("window", "vocabulary"), [(8, 2), (8, 3), (50, 1), (50, 2)])
def test_runs_and_periods(spark, window, vocabulary):
    r = random.Random(window + vocabulary)
    rows, pool = [], []
    for d in range(40):
        w = [f"w{r.randrange(vocabulary)}" for _ in range(r.choice((0, 5, window, 60, 200)))]
        if pool:
            p = r.choice(pool)
            a = r.randrange(len(p) + 1)
            at = r.randrange(len(w) + 1)
            w = w[:at] + p[a : a + 3 * window] + w[at:]
        pool.append(w)
        rows.append((r.choice((d, d // 2, None)), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(substring.cut_repeats(df, window=window)) == brute(rows, window)


def test_symbols_recur_wherever_their_context_does():
    """A symbol whose context lies in a shared passage stands in both texts, at the same place."""
    rng = np.random.default_rng(1)
    for alphabet in (2, 50):
        passage = substring.word_hashes([b"p%d" % k for k in rng.integers(0, alphabet, 80)])
        texts = [
            np.concatenate([substring.word_hashes([b"%d-%d" % (t, k) for k in range(t * 7)]), passage, passage[:t]])
            for t in (1, 4)
        ]
        seen = []
        for t, h in zip((1, 4), texts, strict=True):
            name, lo, hi = substring.parse(h)
            inside = (lo >= t * 7) & (hi < t * 7 + 80)
            seen.append(set(zip(name[inside].tolist(), (lo[inside] - t * 7).tolist(), (hi[inside] - t * 7).tolist())))
        assert seen[0] == seen[1]
        assert seen[0]


def test_texts_of_a_group_do_not_touch():
    hashes = [substring.word_hashes([b"a"] * n) for n in (60, 0, 55, 49)]
    together = substring.blocks(hashes)
    alone = [substring.blocks([h]) for h in hashes]
    assert together.content.tolist() == [c for b in alone for c in b.content.tolist()]


def test_stage_keeps_rows_and_columns(spark):
    rows = awkward()
    docs = frame(spark, rows)
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns
    assert out.count() == len(rows)
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[2] == " \n\t "  # untouched texts stay as they were
    assert text[4] == "x y"
    assert all(r.n_chars == len(r.text) for r in out.where("text IS NOT NULL").collect())


def test_empty_table(spark):
    assert substring.cut_repeats(empty(spark)).count() == 0
    assert substring.without_repeats(empty(spark)).count() == 0
