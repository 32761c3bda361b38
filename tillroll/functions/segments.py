"""RFM segment rules (P12) and the retention actions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Segment names in the order the report lists them.
SEGMENT_NAMES = (
    "Champions",
    "Loyal Customers",
    "Potential Loyalists",
    "New Customers",
    "Promising",
    "Need Attention",
    "About to Sleep",
    "At Risk",
    "Cannot Lose Them",
    "Hibernating",
    "Lost",
)

# Suggested actions for the retention target segments.
TARGET_ACTIONS = {
    "At Risk": "Win-back: discount + personalized re-engagement",
    "Cannot Lose Them": "VIP rescue: account manager outreach + early-access offers",
    "About to Sleep": "Awareness nudge: lifecycle email + best-seller promo",
}


def segment_expr(r="R_score", f="F_score", m="M_score") -> Column:
    """First matching rule wins; fm = (F + M) / 2 is compared through F + M.

    fm >= 4 <=> F+M >= 8, fm <= 2 <=> F+M <= 4, fm == 3 <=> F+M == 6. Rule 4
    ("New Customers", R = 5 and fm <= 2) can never fire because rule 3 catches it
    first; it is kept so the rule list reads like the specification.
    """
    R = F.col(r) if isinstance(r, str) else r
    s = (F.col(f) if isinstance(f, str) else f) + (F.col(m) if isinstance(m, str) else m)
    return (
        F.when((R >= 5) & (s >= 8), "Champions")
        .when((R >= 4) & (s >= 6), "Loyal Customers")
        .when((R >= 4) & (s <= 4), "Potential Loyalists")
        .when((R == 5) & (s <= 4), "New Customers")
        .when((R >= 3) & (s == 6), "Promising")
        .when((R == 3) & (s <= 4), "Need Attention")
        .when((R == 2) & (s == 6), "About to Sleep")
        .when((R == 2) & (s >= 8), "At Risk")
        .when((R == 1) & (s >= 8), "Cannot Lose Them")
        .when((R <= 2) & (s <= 4), "Hibernating")
        .otherwise("Lost")
    )


def action_expr(segment="Segment") -> Column:
    """Action keyed by segment name (a literal map, no join)."""
    pairs = []
    for k, v in TARGET_ACTIONS.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), F.col(segment) if isinstance(segment, str) else segment)
