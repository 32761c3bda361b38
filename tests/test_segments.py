from collections import Counter

from tillroll.functions.segments import SEGMENT_NAMES, TARGET_ACTIONS
from tillroll.operators.rfm import segment_map, segment_map_counts

# Triples per segment in the reference's published 125-row score map.
EXPECTED_TRIPLES = {
    "Lost": 43,
    "Loyal Customers": 24,
    "Hibernating": 12,
    "Potential Loyalists": 12,
    "At Risk": 6,
    "Cannot Lose Them": 6,
    "Champions": 6,
    "Need Attention": 6,
    "About to Sleep": 5,
    "Promising": 5,
    "New Customers": 0,
}


def test_segment_map_counts(spark):
    m = segment_map(spark)
    rows = m.collect()
    assert len(rows) == 125
    got = Counter(r["Segment"] for r in rows)
    for name, n in EXPECTED_TRIPLES.items():
        assert got.get(name, 0) == n, name
    counts = {r["Segment"]: r["triples"] for r in segment_map_counts(m).collect()}
    assert list(counts) == list(SEGMENT_NAMES)
    assert counts == EXPECTED_TRIPLES


def test_rule_order_quirks(spark):
    m = {(r["R"], r["F"], r["M"]): r["Segment"] for r in segment_map(spark).collect()}
    assert m[(3, 5, 5)] == "Lost"  # R=3 with high engagement falls through
    assert m[(5, 1, 1)] == "Potential Loyalists"  # "New Customers" is unreachable
    assert m[(5, 2, 3)] == "Lost"  # fm = 2.5
    assert m[(1, 3, 3)] == "Lost"
    assert m[(5, 4, 4)] == "Champions"
    assert m[(4, 3, 3)] == "Loyal Customers"
    assert m[(2, 3, 3)] == "About to Sleep"
    assert m[(2, 5, 3)] == "At Risk"
    assert m[(1, 4, 5)] == "Cannot Lose Them"
    assert m[(1, 1, 1)] == "Hibernating"
    assert m[(3, 3, 3)] == "Promising"
    assert m[(3, 1, 2)] == "Need Attention"


def test_actions_cover_targets():
    from tillroll.params import REFERENCE_TARGET_SEGMENTS

    assert set(TARGET_ACTIONS) == set(REFERENCE_TARGET_SEGMENTS)
