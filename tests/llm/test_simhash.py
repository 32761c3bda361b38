"""SimHash near-dedup against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from tests.llm.data import awkward, empty, frame
from tillroll.llm import simhash
from tillroll.llm.components import connected_components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, max_bits=4):
    """nodes: (id, fp); smallest id reachable."""
    ids = sorted({d for d, _ in nodes})
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(nodes):
        for b, y in nodes[k + 1 :]:
            if (x ^ y).bit_count() <= max_bits:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: find(d) for d in ids}


def unsigned(x):
    return x & (1 << 64) - 1


def test_fingerprint():
    for t in (None, "", "One", "a b c d", "A b C d E", "x " * 50, "é à ü " * 9, "one\x1ctwo three\x0bfour five six"):
        assert unsigned(simhash.fingerprint(t)) == brute_fingerprint(t)
    assert simhash.fingerprint("a b c " * 500, step=7) == simhash.fingerprint("a b c " * 500)


def test_awkward_rows(spark):
    rows = awkward()
    found = simhash.near_duplicates(frame(spark, rows)).collect()
    fps = [(d, brute_fingerprint(t)) for d, t, *_ in rows]
    assert Counter((r.doc_id, unsigned(r.fp)) for r in found) == Counter(fps)
    expected = brute_components([(d, f) for d, f in fps if d is not None])
    assert all(r.component_id == (expected[r.doc_id] if r.doc_id is not None else None) for r in found)


def near_fingerprints(seed, n=250):
    """Chains, tight clusters and far fingerprints."""
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(20)]
    while len(out) < n:
        x = r.choice(out[-40:])
        for b in r.sample(range(64), r.choice((1, 2, 3, 4, 4, 5, 6))):
            x ^= 1 << b
        out.append(x)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("max_bucket", [simhash.MAX_BUCKET, 5])
def test_links_connect_all_in_reach(spark, max_bucket):
    """Both ways for buckets, gathered and too large to gather, give the brute-force components."""
    fps = near_fingerprints(3)
    nodes = spark.createDataFrame([(simhash._signed(f), k) for k, f in enumerate(fps)], "fp long, rep long")
    links = simhash.fingerprint_links(nodes, max_bucket=max_bucket)
    assert all((fps[r.a] ^ fps[r.b]).bit_count() <= 4 for r in links.collect())
    comps = {r.node: r.component for r in connected_components(links).collect()}
    expected = brute_components(list(enumerate(fps)))
    assert {k: comps.get(k, k) for k in expected} == expected


def test_bucket_forest_is_a_forest():
    fp = np.array(near_fingerprints(9), np.uint64)
    a, b = simhash.bucket_forest(fp, np.arange(len(fp)), 4)
    assert len(a) < len(fp)
    assert len(set(b.tolist())) == len(b)
    root = brute_components(list(enumerate(fp.tolist())))
    assert len(fp) - len(a) == len(set(root.values()))


def test_blocks_cover_every_close_pair():
    masks = simhash.block_masks(6, 4)
    r = random.Random(1)
    for _ in range(300):
        flips = sum(1 << b for b in r.sample(range(64), 4))
        assert any(m & flips == 0 for m in masks)


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in connected_components(chain).collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_stage(spark):
    """One row of each group stays, also of groups of rows without an id and of repeated rows."""
    rows = awkward() + [(2_000, "row of its own " * 3, "en", "a"), (2_000, "another text of the same id", "en", "a")]
    docs = frame(spark, rows)
    kept = simhash.keep_first_of_groups(docs)
    assert kept.columns == docs.columns
    # by brute force: rows without an id are documents behind all others, equal texts one of them
    behind = {t: 10**12 + k for k, t in enumerate(sorted({t or "" for d, t, *_ in rows if d is None}))}
    nodes = [(behind[t or ""] if d is None else d, brute_fingerprint(t)) for d, t, *_ in rows]
    groups = brute_components(nodes)
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert sum(got.values()) == len(set(groups.values()))
    firsts = {(d, t) for (i, _), (d, t, *_) in zip(nodes, rows, strict=True) if groups[i] == i}
    assert set(got) <= firsts and {d for d, _ in got} == {d for d, _ in firsts}
    assert sum(d == 2_000 for d, _ in got) == 1


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_first_of_groups(empty(spark)).count() == 0
