"""Winnowing: selection, guarantee, edited texts and the order of documents."""

import hashlib
import random

import numpy as np

from tests.llm.data import awkward, empty, frame
from tillroll.llm import winnow


def brute_select(h, window):
    window = min(window, len(h))
    out = set()
    for s in range(len(h) - window + 1):
        part = h[s : s + window]
        low = min(part)
        out.add(s + max(k for k, x in enumerate(part) if x == low))
    return sorted(out)


def test_rightmost_minimum_of_each_window():
    r = random.Random(2)
    for n in (1, 2, 5, 23, 24, 25, 200):
        for top in (1, 3, 1000):
            h = [r.randrange(top) for _ in range(n)]
            for w in (1, 4, 24):
                assert winnow.select(np.array(h, np.uint64), w).tolist() == brute_select(h, w)


def test_equal_grams_have_equal_hashes():
    p = np.array([ord(c) for c in "abcabcabcx"], np.uint32)
    h = winnow.gram_hashes(p, 3).tolist()
    assert h[0] == h[3] == h[6] and len(set(h)) == 4
    assert len(winnow.gram_hashes(p, 7)) == 4


def test_stretches_do_not_change_the_selection():
    r = random.Random(3)
    text = "".join(r.choice("abc d") for _ in range(5000))
    whole = winnow.winnow(text)
    for stretch in (50, 333):
        parts = winnow.winnow(text, stretch=stretch)
        assert parts[0].tolist() == whole[0].tolist() and parts[1].tolist() == whole[1].tolist()


def test_guarantee():
    """A shared run of window + gram - 1 code points gives a shared selected hash."""
    r = random.Random(4)
    n = winnow.GRAM + winnow.WINDOW - 1
    for _ in range(200):
        shared = "".join(r.choice("abcdefgh é\U0001f600") for _ in range(n))
        a, b = ("".join(r.choice("ijklmnop") for _ in range(r.randrange(60))) + shared + "z" * k for k in (3, 40))
        assert set(winnow.winnow(a)[0].tolist()) & set(winnow.winnow(b)[0].tolist())


def test_positions_point_at_their_grams(spark):
    rows = awkward()
    texts = {d: t for d, t, *_ in rows}
    for r in winnow.fingerprints(frame(spark, rows)).where("doc_id IS NOT NULL").collect():
        t = texts[r.doc_id] or ""
        for s in r.selected[:20]:
            p = np.array([ord(c) for c in t[s.position : s.position + winnow.GRAM]], np.uint32)
            assert int(winnow.gram_hashes(p, min(winnow.GRAM, len(t)))[0] >> np.uint64(32)) == s.hash


def test_order_and_edits(spark):
    rows = [(d, t) for d, t, *_ in awkward() if d is not None]
    rows = list(dict(rows).items())
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: r for r in winnow.compare_edited(df).collect()}
    order = sorted(found)
    texts = {d: t or "" for d, t in rows}
    assert len(found) == len(rows)
    for d, n in zip(order, order[1:] + order[:1], strict=True):
        own, following = texts[d], texts[n]
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        r = found[d]
        assert (r.n_chars, r.edited) == (len(own), edited)
        a, b, c = (winnow.winnow(t)[0] for t in (own, edited, following))
        assert r.fingerprint == winnow.as_string(a) and r.edited_fingerprint == winnow.as_string(b)
        assert r.near_edited == winnow.likeness(a, b) and r.near_next == winnow.likeness(a, c)


def test_match_spans():
    """Spans are equal stretches, and a common stretch of window + gram - 1 lies in one of them."""
    r = random.Random(9)
    n = winnow.GRAM + winnow.WINDOW - 1
    letters = "abcdefgh é\U0001f600"
    text = lambda k: "".join(r.choice(letters) for _ in range(k))
    for k in range(60):
        shared = text(n + 3 * k)
        a, b = text(r.randrange(200)) + shared + text(50), text(r.randrange(90)) + shared + text(r.randrange(70))
        spans = winnow.match_spans(winnow.winnow(a), winnow.winnow(b), winnow.GRAM, winnow.WINDOW).tolist()
        assert all(b[x:y] == a[z : z + y - x] for x, y, z in spans)
        at = b.index(shared)
        assert any(x < at + n and y > at for x, y, _ in spans)
    repeated = "x" * 500
    spans = winnow.match_spans(winnow.winnow(repeated), winnow.winnow(repeated), winnow.GRAM, winnow.WINDOW).tolist()
    assert spans and all(repeated[x:y] == repeated[z : z + y - x] for x, y, z in spans)
    none = winnow.winnow("")
    assert len(winnow.match_spans(none, none, 16, 24)) == len(winnow.match_spans(winnow.winnow("abc"), none, 16, 24)) == 0


def test_registered_query_on_whole_documents(spark):
    """Every row of the query against the plain statement, over the whole given table."""
    from tillroll.llm.common import table
    from tillroll.llm.queries import op2_fingerprints

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    order = sorted(texts)
    found = {r["doc_id"]: r for r in op2_fingerprints(spark, sf).collect()}
    assert sorted(found) == order
    for d, n in zip(order, order[1:] + order[:1], strict=True):
        half = len(texts[d]) // 2
        edited = texts[d][: len(texts[d]) - half] + texts[n][:half]
        r = found[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(texts[d]), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (winnow.winnow(t)[0] for t in (texts[d], edited, texts[n]))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (winnow.as_string(a), winnow.as_string(b))
        assert (r["near_edited"], r["near_next"]) == (winnow.likeness(a, b), winnow.likeness(a, c))
        assert all(edited[x["first"] : x["end"]] == texts[d][x["own_first"] :][: x["end"] - x["first"]] for x in r["match_spans"])


def test_slices_and_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(winnow, "SLICE", 100)
    rows = [(k, f"text {k} " * (k + 1)) for k in range(30)] + [(99, "long text of many words " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = winnow.compare_edited(df).select("doc_id", "n_chars", "edited").collect()
    assert sorted((r["doc_id"], r["n_chars"]) for r in found) == [(d, len(t)) for d, t in rows]


def test_awkward_rows(spark):
    """Null and repeated ids have a place in the order too; every row comes out once."""
    rows = awkward()
    found = winnow.compare_edited(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in found) == sorted((str(d), len(t or "")) for d, t, *_ in rows)
    by_text = {}
    for r in found:
        by_text.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert all(len(s) == 1 for (d, _), s in by_text.items() if d is not None)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")
    r = winnow.compare_edited(one).first()
    assert (r.edited, r.near_next) == ("abcabc", 1.0)
    assert winnow.compare_edited(empty(spark)).count() == 0


def test_likeness_of_empty_fingerprints():
    none, some = np.empty(0, np.uint32), np.array([1], np.uint32)
    assert winnow.likeness(none, none) == 1 and winnow.likeness(none, some) == 0
