"""Filter audit: masks, diagrams and steps against brute force over every order."""

import itertools
import random
import re

from tests.llm.data import awkward, empty, frame
from tillroll.llm import filter_audit as A

LABELS = "doc_id long, quality int, toxic int, lang string, n long, good long"


def brute_mask(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = (
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        re.search(r"[#$%&*|]", text) is not None,
    )
    return sum(bit << k for k, bit in enumerate(fails))


def brute(rows, labels):
    """(part, order, step) -> the counts, by applying the filters one after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for doc_id, text, lang, *_ in rows:
        earlier = any(o[0] is not None and doc_id is not None and o[0] < doc_id and (o[1] or "") == (text or "") for o in rows)
        failed = {f for k, f in enumerate("ABCD") if brute_mask(text) >> k & 1} | ({"E"} if earlier else set())
        parts.setdefault(lang or "", []).append((failed, doc_id in good, doc_id in toxic))
    out = {}
    for part, docs in parts.items():
        removed_sum = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                fails = sum(f in d[0] for d in docs)
                only = sum(d[0] == {f} for d in docs)
                lost = sum(d[1] for d in here), sum(d[2] for d in here)
                out[part, order, step] = [len(left), len(here), fails - len(here), only, *lost]
                removed_sum[f] += len(here)
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(removed_sum[order[step - 1]])
    return out


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in df.collect()}


def test_adjacent_swaps_visit_every_order_once():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in A.adjacent_swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))


def test_a_swapped_diagram_equals_one_built_in_that_order():
    r = random.Random(3)
    counts = {m: (r.randrange(5), r.randrange(3), r.randrange(2)) for m in range(32) if r.random() < 0.6}
    d = A.Diagram(counts, range(5))
    for k in A.adjacent_swaps(5):
        d.swap(k)
        built = A.Diagram(counts, d.order)
        assert list(d.all_pass()) == list(built.all_pass())
        assert [len(x) for x in d.levels] == [len(x) for x in built.levels]  # as reduced as a new one


def test_equal_nodes_are_shared():
    d = A.Diagram({m: (1, 0, 0) for m in range(32)}, range(5))
    assert [len(level) for level in d.levels] == [1] * 5


def test_text_masks():
    texts = [None, "", "a " * 100, " ".join(f"w{k}" for k in range(100)), "AB cd", "x # y", "\x1ca\x0bB", "é" * 300]
    texts += [" ".join(f"w{k % 80}" for k in range(100)), " ".join(f"w{k % 79}" for k in range(100)), "Aaaaaaaaaa", "Aaaaaaaaa"]
    assert [A.text_mask(t) for t in texts] == [brute_mask(t) for t in texts]


def test_audit_equals_brute_force(spark):
    rows = awkward()
    rows += [(200 + k, rows[9][1], "en", "a") for k in range(30)]  # a group of copies
    rows += [(5, rows[9][1], "fr", "a"), (None, rows[9][1], None, "a"), (400, "UP # " * 60, "", None)]
    r = random.Random(4)
    labels = [(k, r.choice((0, 1, None)), r.choice((0, 1, None))) for k in range(60) if r.random() < 0.8]
    labels += [(3, 1, 0), (3, 0, 1), (None, 1, 1), (999, 1, 1)]
    frame_of_labels = spark.createDataFrame([(*x, "zz", 1, 1) for x in labels], LABELS)
    masks = A.failure_masks(frame(spark, rows), frame_of_labels)
    assert found(A.audit(masks)) == brute(rows, labels)


def test_very_long_text_and_empty_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    rows = [(1, "word " * 400_000, "en", "a"), (2, "word " * 400_000, "en", "a")]
    got = found(A.audit(A.failure_masks(frame(spark, rows), labels)))
    assert got["en", "EABCD", 1][:2] == [1, 1] and got["en", "BAECD", 1][:2] == [0, 2]
    assert A.audit(A.failure_masks(empty(spark), labels)).count() == 0
