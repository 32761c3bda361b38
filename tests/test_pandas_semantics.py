"""Customer and RFM rules checked one at a time on the small tables.

Each test states one rule over sets of raw line tuples and holds the library's column
against it; no test builds the customer frame in another engine.
"""

from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest

from tests.conftest import SF001
from tillroll.plans.analysis import RetailAnalysis


class Facts:
    """Distinct priced lines of the window with a customer, by customer."""

    def __init__(self, a: RetailAnalysis):
        p = a.params
        self.snapshot = p.snapshot_ts
        lines = {
            tuple(r)
            for r in a.raw.collect()
            if r["UnitPrice"] > 0 and p.start_ts <= r["InvoiceDate"] <= p.end_ts and r["CustomerID"] is not None
        }
        names = a.raw.columns
        self.by = defaultdict(list)
        for t in lines:
            r = dict(zip(names, t, strict=True))
            r["kept"] = r["Quantity"] >= 0 and not r["InvoiceNo"].startswith("C")
            r["money"] = Decimal(str(r["UnitPrice"])) * Decimal(str(r["Quantity"]))
            self.by[r["CustomerID"]].append(r)
        self.net = {c: sum(r["money"] for r in rows) for c, rows in self.by.items()}


@pytest.fixture(scope="module")
def facts_and_frame(spark):
    a = RetailAnalysis.from_test_tables(spark, SF001, cache=False)
    frame = {r["CustomerID"]: r for r in a.customers.collect()}
    return Facts(a), frame, {r["Segment"]: r["Customers"] for r in a.segment_summary.collect()}


def test_only_net_positive_customers_stay(facts_and_frame):
    facts, frame, _ = facts_and_frame
    assert set(frame) == {c for c, m in facts.net.items() if m > 0}


def test_money(facts_and_frame):
    facts, frame, _ = facts_and_frame
    for c, r in frame.items():
        assert r["Monetary"] == pytest.approx(float(facts.net[c]), abs=1e-9)


@pytest.mark.parametrize(
    ("column", "rule"),
    [
        ("Frequency", lambda rows: len({r["InvoiceNo"] for r in rows if r["kept"]})),
        ("DistinctStockCodes", lambda rows: len({r["StockCode"] for r in rows if r["kept"]})),
        ("TotalLines", lambda rows: sum(r["kept"] for r in rows)),
        ("TotalQuantity", lambda rows: sum(r["Quantity"] for r in rows if r["kept"])),
        ("first_invoice", lambda rows: min(r["InvoiceDate"] for r in rows)),
        ("last_invoice", lambda rows: max(r["InvoiceDate"] for r in rows)),
    ],
)
def test_counts_and_dates(facts_and_frame, column, rule):
    facts, frame, _ = facts_and_frame
    assert {c: r[column] for c, r in frame.items()} == {c: rule(facts.by[c]) for c in frame}


def test_days(facts_and_frame):
    facts, frame, _ = facts_and_frame
    for r in frame.values():
        assert r["Recency"] == (facts.snapshot - r["last_invoice"]).days
        assert r["Tenure_days"] == (r["last_invoice"] - r["first_invoice"]).days


def test_cancellation_rate_and_country(facts_and_frame):
    facts, frame, _ = facts_and_frame
    for c, r in frame.items():
        rows = facts.by[c]
        assert r["CancellationRate"] == pytest.approx(sum(not x["kept"] for x in rows) / len(rows))
        seen = Counter(x["Country"] for x in rows)
        assert r["Country"] == min(k for k, n in seen.items() if n == max(seen.values()))


def test_ratios_are_rounded_quotients(facts_and_frame):
    _, frame, _ = facts_and_frame
    for r in frame.values():
        assert abs(r["AvgBasketSize"] - r["TotalQuantity"] / max(r["Frequency"], 1)) <= 0.005 + 1e-9
        assert abs(r["AvgUnitPrice"] - r["Monetary"] / max(r["TotalQuantity"], 1)) <= 0.0005 + 1e-9


@pytest.mark.parametrize(("score", "key"), [("F_score", "Frequency"), ("M_score", "Monetary")])
def test_rank_scores_cut_the_order_in_fifths(facts_and_frame, score, key):
    """Along the order (value, id), the score is 1 + how many fifth points of the ranks lie below."""
    _, frame, _ = facts_and_frame
    line = sorted(frame, key=lambda c: (frame[c][key], c))
    edges = np.quantile(np.arange(len(line)), [0.2, 0.4, 0.6, 0.8])
    assert [frame[c][score] for c in line] == [1 + int((edges < k - 1e-9).sum()) for k in range(len(line))]


def test_recency_score_cuts_the_values(facts_and_frame):
    _, frame, _ = facts_and_frame
    near = np.array([-r["Recency"] for r in frame.values()], dtype=float)
    edges = np.quantile(near, [0.2, 0.4, 0.6, 0.8])
    assert [r["R_score"] for r in frame.values()] == [1 + int((edges < v - 1e-9).sum()) for v in near]


def test_segment_sizes(facts_and_frame):
    _, frame, sizes = facts_and_frame
    assert Counter(r["Segment"] for r in frame.values()) == sizes
