"""Mixing: targets by water filling, thresholds near the budget, nested and repeatable."""

import hashlib
from collections import defaultdict

import pytest

from tests.llm.data import awkward, empty, frame, pad, SCHEMA
from tillroll.llm import mixing


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    """Share by weight, stop at the caps, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    rest, open_ = float(sum(sizes.values())), set(order)
    while open_ and rest > 1e-9:
        total = sum(w[s] for s in open_)
        share = {s: rest * w[s] / total for s in open_}
        rest = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def check(spark, df, rows):
    found = mixing.mixture(df).collect()
    assert len(found) == len(rows)
    size, taken, seen = defaultdict(int), defaultdict(int), {}
    for r in found:
        size[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
        seen[r.source] = (r.source_size, r.target)
    target = brute_targets(size)
    biggest = max(r.size for r in found)
    for s, (source_size, t) in seen.items():
        assert source_size == size[s]
        assert t == pytest.approx(target[s], abs=1e-6)
        assert abs(taken[s] - t) <= biggest
    return found


def test_awkward_rows(spark):
    rows = awkward()
    df = frame(spark, rows)
    found = check(spark, df, rows)
    assert {r.doc_id: r.size for r in found}[5] == 6000
    again = mixing.mixture(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_boundary_is_the_nearest_document(spark):
    """A source with thousands of documents comes within half of the boundary document of its target."""
    rows = [(k, "w " * (1 + k % 9), "en", "hot" if k % 3 else f"s{k % 7}") for k in range(3000)]
    found = check(spark, spark.createDataFrame(pad(rows), SCHEMA), rows)
    taken, target = defaultdict(int), {}
    for r in found:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 4.5 for s, t in target.items())


def test_thresholds_are_nested(spark):
    slim = spark.range(400).selectExpr("'a' AS source", "id % 5 AS size", "id * 2882303761517117 AS h")
    found = []
    for b in (10.0, 100.0, 500.0):
        budgets = spark.createDataFrame([("a", b)], "source string, budget double")
        found.append(mixing.hash_thresholds(slim, budgets).first()["threshold"])
    assert found == sorted(found)


def test_hash_is_md5_of_id_and_text(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(7, "a b"), (None, None)], "doc_id long, text string")
    got = [r[0] for r in df.select(mixing.text_hash(F.col("doc_id"), F.col("text"))).collect()]
    assert got == [int(hashlib.md5(k).hexdigest()[:15], 16) for k in (b"7 a b", b"- ")]


def test_stage_repeats_documents(spark):
    rows = awkward()
    docs = frame(spark, rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    expected = defaultdict(int)
    for r in mixing.mixture(docs).collect():
        expected[r.doc_id] += r.copies
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
    assert got == {d: n for d, n in expected.items() if n}


def test_no_python_in_the_plan(spark):
    plan = mixing.mixture(frame(spark, awkward()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert mixing.mixture(empty(spark)).count() == 0
    assert mixing.mixed_documents(empty(spark)).count() == 0
