"""Hand-made line items for edge cases."""

from __future__ import annotations

import datetime as dt

from tillroll.sources.schema import LINE_ITEM_SCHEMA


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def line(inv, code, qty, when, price, cust, country="United Kingdom", desc=None):
    return (inv, code, desc, qty, ts(when), price, cust, country)


def frame(spark, rows):
    return spark.createDataFrame(rows, LINE_ITEM_SCHEMA)
