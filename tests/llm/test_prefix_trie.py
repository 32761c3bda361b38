"""Prefix trie against a trie built in memory, with and without false alarms of the sketch."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from tillroll.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth long, n long, d0 long, owner long, last boolean, maybe int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, True, 5) for r in rows], SCHEMA)


def digest(turn):
    role, text = turn
    return hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).hexdigest()


def rebuilt(rows):
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, digest((role or "", text or "")), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))  # a remainder with the sign of the id, as in SQL
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, cs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        leaf = lambda m: not any(len(o) == len(m) + 1 and o[: len(m)] == m for o in members)
        ends = sorted(c for c in cs if len(convs[c]) == len(node))
        out.append(
            (
                min(cs),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(cs),
                len(children),
                sum(map(leaf, below)),
                sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def random_rows(seed, n=60, vocabulary=6, ids=lambda k: k * 7):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        c = ids(k)
        for t in range(r.choice((0, 1, 2, 5, 8, 8))):
            first = t < 3 and r.random() < 0.7
            rows.append((c, t, r.choice(("user", "assistant")), "same start" if first else f"text {r.randrange(vocabulary)} é"))
    return rows


AWKWARD = [
    (0, 1, "user", "hi"),
    (0, None, None, "null turn sorts first"),
    (0, 2, "user", None),
    (0, 2, "user", None),  # a repeated row
    (100, 0, "user", ""),
    (101, 0, "user", "alone"),
    (102, 5, "user", "tie b"),
    (102, 5, "user", "tie a"),
    (None, 0, "user", "no conversation"),
    (None, None, None, None),
    (250, 0, "user", "no base here"),
    (251, 0, "", "x" * 300_000),
    (-5, 0, "user", "a negative id"),
    (-5, 1, "user", "more"),
    *[(300 + k, t, "user", f"copy {t}") for k in range(25) for t in range(7)],
]


@pytest.mark.parametrize("sketch", [P.Sketch(), P.Sketch(max_cells=64), P.Sketch(rows=1, max_cells=256)])
def test_trie_equals_brute_force(spark, sketch):
    rows = AWKWARD + random_rows(1, ids=lambda k: 1000 + k * 7) + random_rows(2, 40, 2, lambda k: 5000 + k)
    got = sorted((tuple(r) for r in P.trie(frame(spark, rows), sketch).collect()), key=str)
    assert got == brute(rows)


def test_single_conversation_and_empty_table(spark):
    rows = [(7, 0, "user", "hi"), (7, 1, "assistant", "ho")]
    got = sorted((tuple(r) for r in P.trie(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows)
    assert P.trie(frame(spark, [])).count() == 0


def test_turnless_conversation_is_a_member_of_the_root_only(spark):
    c = next(c for c in range(101, 200) if P.shared_turns(c) >= 1)
    rows = [(c, 0, "user", "taken from a base that is not there")]
    got = [tuple(r) for r in P.trie(frame(spark, rows)).collect()]
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_long_conversation_across_batches(spark):
    rows = [(c, t, "user", f"t{t}") for c in (100, 101, 102) for t in range(12_000)]
    got = P.trie(frame(spark, rows)).groupBy("n_convs").count().collect()
    assert {r["n_convs"]: r["count"] for r in got} == {3: 12_001}


def test_the_sketch_never_counts_too_little(spark):
    rows = random_rows(3, 80, 3, lambda k: 2000 + k * 3)
    found = P.prefixes(frame(spark, rows)).persist()
    truth = {(r["d0"], r["d1"]): r["n"] for r in found.groupBy("d0", "d1").agg({"*": "count"}).toDF("d0", "d1", "n").collect()}
    for sketch in (P.Sketch(), P.Sketch(max_cells=64)):
        judged = P.screened(found, sketch).collect()
        assert len(judged) == sum(truth.values())
        assert all(truth[r["d0"], r["d1"]] == 1 for r in judged if not r["maybe"])
    proved = sum(not r["maybe"] for r in P.screened(found).collect())
    single = sum(n == 1 for n in truth.values())
    assert proved > 0.9 * single
    found.unpersist()


def test_member_lists_are_cut_in_pieces(monkeypatch, spark):
    monkeypatch.setattr(P, "_IDS", 20)
    rows = [(c, 0, "user", "same") for c in range(0, 20_000, 100)]
    got = {r["depth"]: r["ends_sha256"] for r in P.trie(frame(spark, rows)).collect()}
    ids = ",".join(map(str, range(0, 20_000, 100)))
    # every base conversation keeps its own turn
    assert got[1] == hashlib.sha256(ids.encode()).hexdigest() and got[0] == P._NO_ENDS


def test_cells_are_inside_the_sketch():
    d = np.random.default_rng(1).integers(-(2**62), 2**62, (2, 1000))
    cells = P._cells(d[0], d[1], 3, 64)
    assert cells.shape == (3, 1000) and cells.min() >= 0 and cells.max() < 64
