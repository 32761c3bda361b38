"""Token rollups: signed batches, replays and interrupted commits against a recount."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import awkward, empty, frame
from tillroll.llm import token_counts as T

PATTERNS = {n: t.pattern.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff") for n, t in T.TOKENIZERS.items()}


def recount(rows):
    out = Counter()
    for _, text, lang, source in rows:
        t = text or ""
        for name, p in PATTERNS.items():
            k = (source, lang, name)
            out[(*k, "documents")] += 1
            out[(*k, "tokens")] += len(re.findall(p, t))
            out[(*k, "chars")] += len(t)
    return {k: v for k, v in out.items() if v}


def summed(df):
    out = Counter()
    for r in df.collect():
        for s in T.SUMS:
            out[(r.source, r.lang, r.tokenizer, s)] += r[s]
    return {k: v for k, v in out.items() if v}


def state(rollup):
    return summed(rollup.totals())


@pytest.fixture
def rollup(spark, tmp_path):
    return T.Rollup(spark, f"file://{tmp_path}/ledger")


def test_classes_count_as_the_patterns_do():
    r = random.Random(4)
    texts = ["".join(r.choice("ab Z09 \n\t.!#\u00e9\u00df\u4e2d\U0001f600\x1c") for _ in range(r.randrange(40))) for _ in range(2000)]
    for name, t in T.TOKENIZERS.items():
        table = np.array(t.classes, np.int8)
        for x in texts:
            expected = len(re.findall(PATTERNS[name], x))
            assert T.count_tokens(x.encode(), table) == T.count_tokens(x.encode(), table, step=3) == expected


def test_batches_keep_up_with_a_recount(spark, rollup):
    rows = awkward()
    first, second = rows[:25], rows[25:]
    assert rollup.commit("1", T.inserts(frame(spark, first)))
    assert rollup.commit("2", T.inserts(frame(spark, second)))
    assert state(rollup) == recount(rows)
    gone = rows[3:11]
    assert rollup.commit("3", T.deletes(frame(spark, gone)))
    left = rows[:3] + rows[11:]
    assert state(rollup) == recount(left)
    changed = frame(spark, left[:8]).selectExpr("source", "lang", "text", "concat(text, ' and more 42') AS new")
    assert rollup.commit("4", T.revisions(changed, "text", "new"))
    revised = [(d, None if t is None else t + " and more 42", x, s) for d, t, x, s in left[:8]] + left[8:]
    assert state(rollup) == recount(revised)
    by = {r.tokenizer: r.documents for r in rollup.totals_by("tokenizer").collect()}
    assert by == dict.fromkeys(T.TOKENIZERS, len(left))


def test_replays_change_nothing(spark, rollup):
    rows = awkward()
    changes = T.inserts(frame(spark, rows))
    assert T.replay(rollup, [("a", changes), ("a", changes), ("b", T.deletes(frame(spark, rows[:1])))]) == [
        True,
        False,
        True,
    ]
    assert not rollup.commit("b", changes)
    assert state(rollup) == recount(rows[1:])


def test_interrupted_commits(spark, tmp_path):
    """A commit that breaks off before its totals are complete counts for nothing and can be
    repeated; one that breaks off behind them is not applied twice."""
    rollup = T.Rollup(spark, str(tmp_path / "r"))
    rows = awkward()
    rollup.commit("a", T.inserts(frame(spark, rows[:5])))
    before = state(rollup)
    rollup.commit("b/1", T.inserts(frame(spark, rows[5:])))
    after = state(rollup)
    folded = tmp_path / "r" / "batches" / "b%2F1" / "_FOLDED"
    done = tmp_path / "r" / "totals" / "v=000002-b%2F1" / "_SUCCESS"
    folded.unlink()  # broken off before the mark: the next commit sets it
    assert rollup.batches() == {"a", "b/1"}
    assert not rollup.commit("b/1", T.inserts(frame(spark, rows[5:]))) and folded.exists()
    folded.unlink()
    assert rollup.commit("c", T.inserts(empty(spark))) and folded.exists()
    assert not rollup.commit("b/1", T.inserts(frame(spark, rows[5:]))) and state(rollup) == after
    other = T.Rollup(spark, str(tmp_path / "s"))
    other.commit("a", T.inserts(frame(spark, rows[:5])))
    other.commit("b/1", T.inserts(frame(spark, rows[5:])))
    for f in ("batches/b%2F1/_FOLDED", "totals/v=000002-b%2F1/_SUCCESS"):  # broken off before the totals' end
        (tmp_path / "s" / f).unlink()
    assert done.exists() and state(other) == before and other.batches() == {"a"}
    assert other.commit("b/1", T.inserts(frame(spark, rows[5:]))) and state(other) == after == recount(rows)


def test_totals_equal_the_ledger_summed_anew(spark, rollup):
    rows = awkward()
    for k in range(6):
        rollup.commit(f"in {k}", T.inserts(frame(spark, rows[k::6])))
    rollup.commit("out", T.deletes(frame(spark, rows[::6])))
    assert state(rollup) == summed(rollup.recounted())
    assert len(rollup._versions()) == T.KEPT_TOTALS


def test_later_copies(spark):
    rows = awkward() + [(300 + k, "the same text 12", "en", "a" if k % 3 else None) for k in range(40)]
    rows += [(300, "the same text 12", "en", "b"), (300, "the same text 12", None, None), (None, "the same text 12", "en", "a")]
    docs = frame(spark, rows).withColumn("content", F.md5(F.coalesce("text", F.lit(""))))
    counted = T.document_counts(docs, keep=("doc_id", "source", "lang", "content"))
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    copies = [r for r in rows if r[0] is not None and r[0] > first[r[1] or ""]]
    got = {k: -v for k, v in summed(T.later_copies(counted)).items()}
    assert got == recount(copies)


def test_empty_batches_and_keys_that_end(spark, rollup):
    assert rollup.commit("none", T.inserts(empty(spark)))
    assert not rollup.commit("none", T.inserts(frame(spark, awkward())))
    assert state(rollup) == {} and rollup.totals().count() == 0
    docs = frame(spark, awkward())
    rollup.commit("in", T.inserts(docs))
    rollup.commit("out", T.deletes(docs))
    assert rollup.totals().count() == 0


def test_new_tokenizer_version_joins_later(spark, rollup):
    rows = awkward()
    old = {k: T.TOKENIZERS[k] for k in ("words-1",)}
    new = {k: T.TOKENIZERS[k] for k in ("pieces-2",)}
    rollup.commit("old", T.inserts(frame(spark, rows), old))
    rollup.commit("new", T.inserts(frame(spark, rows), new))
    assert state(rollup) == {k: v for k, v in recount(rows).items() if k[2] in ("words-1", "pieces-2")}
