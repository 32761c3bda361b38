"""Winnowing fingerprints.

Every run of ``gram`` code points is hashed, the smallest hash of each window of ``window``
hashes is selected (the rightmost of equals), and selected hashes keep their positions.
Two texts that share ``window + gram - 1`` consecutive code points share a selected hash;
no match shorter than ``gram`` is reported.

A text shorter than ``gram`` is one gram, one with fewer hashes than ``window`` is one
window. Nulls and empty texts select nothing; two empty fingerprints are alike (1), an
empty and another are not (0). Long texts are hashed in overlapping stretches, so memory
does not grow with the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRAM, WINDOW = 16, 24
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """Rolling polynomial hash (modulo 2^64) of each run of ``gram`` code points, scrambled.

    Runs double: a run of 2k is the hash of its first k times base^k plus that of its last k.
    """
    total, length = None, 0
    part, size, left = points.astype(np.uint64) + _U(1), 1, gram
    n = len(points) - gram + 1
    while left:
        if left & 1:  # append the present power of two to what is hashed so far
            piece = part[length : length + n]
            total = piece if total is None else total * _U(pow(_BASE, size, 1 << 64)) + piece
            length += size
        left >>= 1
        if left:
            part = part[: len(part) - size] * _U(pow(_BASE, size, 1 << 64)) + part[size:]
            size *= 2
    x = (total ^ (total >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def select(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the rightmost minimum of every window, ascending."""
    if not len(hashes):
        return np.empty(0, np.int64)
    window = min(window, len(hashes))
    value, at, size = hashes, np.arange(len(hashes)), 1
    while size < window:
        step = min(size, window - size)
        right = value[step:] <= value[:-step]
        at = np.where(right, at[step:], at[:-step])
        value = np.where(right, value[step:], value[:-step])
        size += step
    return np.unique(at)


def winnow(text: str | None, gram: int = GRAM, window: int = WINDOW, stretch: int = 1 << 18):
    """Selected (hashes, positions) of a text; hashes have 32 bits."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    hashes, places = [], []
    for first in range(0, max(1, len(points) - gram + 1), stretch):
        # as many further points as the last window of this stretch needs
        piece = points[first : first + stretch + gram + window - 2]
        h = gram_hashes(piece, min(gram, len(piece)))
        at = select(h, window)
        hashes.append(h[at])
        places.append(at + first)
    place, once = np.unique(np.concatenate(places), return_index=True)
    return (np.concatenate(hashes)[once] >> _U(32)).astype(np.uint32), place


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two sets of hashes (Jaccard)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b))
    return both / (len(np.unique(a)) + len(np.unique(b)) - both)


def as_string(hashes: np.ndarray) -> str:
    """The fingerprint as text: its distinct hashes, ascending, 8 hex digits each."""
    return np.unique(hashes).astype(">u4").tobytes().hex()


def fingerprints(
    docs: DataFrame, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``selected``, an array of (hash, position)."""

    @F.pandas_udf("array<struct<hash: long, position: long>>")
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            h, at = winnow(t, gram, window)
            out.append([{"hash": x, "position": p} for x, p in zip(h.tolist(), at.tolist(), strict=True)])
        return pd.Series(out, dtype=object)

    return docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col)).alias("selected"))


# -- comparison with an edited text and with the next document ---------------------------


#: Blocks per shuffle partition.
BLOCKS = 4


def _block_of(docs: DataFrame, n_blocks: int):
    """Column: number of a block of neighbouring doc_ids; rows without id form further blocks by text hash."""
    share = [k / n_blocks for k in range(1, n_blocks)]
    found = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, share)), 10_000)).first()[0] if share else None
    bounds = np.array(sorted(set(found or [])), np.int64)  # fewer numbers than blocks

    @F.pandas_udf("long")
    def block(doc_id: pd.Series, h: pd.Series) -> pd.Series:
        none = doc_id.isna().to_numpy()
        at = np.searchsorted(bounds, doc_id.fillna(0).to_numpy(np.int64))
        by_hash = n_blocks + ((h.to_numpy(np.int64).astype(np.float64) / 2.0**64 + 0.5) * n_blocks).astype(np.int64)
        return pd.Series(np.where(none, by_hash, at))

    return block(F.coalesce("doc_id", F.lit(None).cast("long")), F.col("h"))


def beside_next(docs: DataFrame, n_blocks: int | None = None) -> DataFrame:
    """Rows dealt out so that each stands before the next in the order: (block, guest, doc_id, text), sorted.

    The order is doc_id (null last), then a hash of the text. A block holds neighbouring
    ids, and the first row of the next block (after the last: of the first) as a guest at
    its end. So each text is shuffled once, but for one guest a block.
    """
    spark = docs.sparkSession
    n_blocks = n_blocks or BLOCKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    placed = keyed.withColumn("block", _block_of(docs, n_blocks))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    heads = placed.groupBy("block").agg(F.min(order).alias("head"))
    # one row a block: at most twice n_blocks rows in this window and in the broadcast
    line = Window.orderBy("block")
    last = F.max("block").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("block", "head", F.coalesce(F.lag("block").over(line), last).alias("prior"))
    at = F.array(F.struct("block", F.lit(False).alias("guest")))
    guest = F.array(F.struct(F.col("prior").alias("block"), F.lit(True).alias("guest")))
    is_head = (F.col("doc_id").eqNullSafe(F.col("head.doc_id"))) & F.col("h").eqNullSafe(F.col("head.h"))
    rows = placed.join(F.broadcast(heads), "block").withColumn(
        "p", F.explode(F.when(is_head, F.concat(at, guest)).otherwise(at))
    )
    return (
        rows.select("p.block", "p.guest", "doc_id", "text", "h")
        .repartition("block")
        .sortWithinPartitions("block", "guest", F.col("doc_id").isNull(), "doc_id", "h")
        .select("block", "guest", "doc_id", "text")
    )


def edit(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by the first as many of the next text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def match_spans(a: tuple, b: tuple, gram: int, window: int) -> np.ndarray:
    """Stretches of text b that also stand in text a: rows (first, end, first in a), from selected positions.

    ``a`` and ``b`` are (hashes, positions). A stretch joins the selected grams that both texts
    have at one shift and that start at most a window apart, so every common stretch of
    window + gram - 1 code points is met. Of several places in a, a gram takes the one at the
    shift of the gram before it, else the first.
    """
    key_a = np.sort(a[0].astype(np.uint64) << _U(32) | a[1].astype(np.uint64))
    low = np.searchsorted(key_a, b[0].astype(np.uint64) << _U(32))
    low = np.minimum(low, max(len(key_a) - 1, 0))
    some = np.flatnonzero((key_a[low] >> _U(32)) == b[0]) if len(key_a) else np.empty(0, np.int64)
    if not len(some):
        return np.empty((0, 3), np.int64)
    hashes, at = b[0][some], b[1][some].astype(np.int64)
    shift = (key_a[low[some]] & _U(0xFFFFFFFF)).astype(np.int64) - at
    wanted = np.r_[shift[:1], shift[:-1]]
    place = np.maximum(at + wanted, 0)
    key = hashes.astype(np.uint64) << _U(32) | place.astype(np.uint64)
    shift = np.where(np.isin(key, key_a), place - at, shift)
    first = np.flatnonzero(np.r_[True, (np.diff(shift) != 0) | (np.diff(at) > window)])
    last = np.r_[first[1:], len(at)] - 1
    return np.column_stack([at[first], at[last] + gram, at[first] + shift[first]])


_SPANS = "array<struct<first: long, end: long, own_first: long>>"
_EDITED = {
    "doc_id": "long",
    "n_chars": "long",
    "edited": "string",
    "edited_sha256": "string",
    "fingerprint": "string",
    "edited_fingerprint": "string",
    "near_edited": "double",
    "near_next": "double",
    "match_spans": _SPANS,
}
#: Code points that are compared before their rows are handed on.
SLICE = 1 << 20


def _compare(gram: int, window: int, columns: list[str]):
    def one(doc_id, own: str, own_marks: tuple, following: str, next_hashes: np.ndarray) -> dict:
        edited = edit(own, following)
        marks = winnow(edited, gram, window)
        spans = match_spans(own_marks, marks, min(gram, max(len(own), 1)), window)
        return {
            "doc_id": doc_id,
            "n_chars": len(own),
            "edited": edited if "edited" in columns else None,
            "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            "fingerprint": as_string(own_marks[0]),
            "edited_fingerprint": as_string(marks[0]),
            "near_edited": likeness(own_marks[0], marks[0]),
            "near_next": likeness(own_marks[0], next_hashes),
            "match_spans": [dict(zip(("first", "end", "own_first"), x, strict=True)) for x in spans.tolist()],
        }

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row before: block, id, text, selected hashes and positions
        out, size = [], 0
        for pdf in batches:
            for block, guest, doc_id, text in pdf.itertuples(index=False, name=None):
                text = text or ""
                marks = winnow(text, gram, window)
                if held is not None and held[0] == block:
                    out.append(one(*held[1:], text, marks[0]))
                    size += len(held[2])
                    if size >= SLICE:
                        yield frame(out)
                        out, size = [], 0
                # a guest only follows; of several equal guests the first has been used
                held = None if guest else (block, None if pd.isna(doc_id) else int(doc_id), text, marks)
        yield frame(out)

    return run


def compare_edited(
    docs: DataFrame, gram: int = GRAM, window: int = WINDOW, n_blocks: int | None = None, with_text: bool = True
) -> DataFrame:
    """One row per row of ``docs``: fingerprints of the text and of its edited text, how near they
    are, and ``match_spans``, the stretches of the edited text that the text has too.

    Rows leave a task in slices of a megabyte of text, so a batch of long texts is never held
    with its results; ``with_text=False`` leaves out the edited text (its hash stays).
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    columns = [c for c in _EDITED if with_text or c != "edited"]
    ddl = ", ".join(f"{c} {_EDITED[c]}" for c in columns)
    return beside_next(slim, n_blocks).mapInPandas(_compare(gram, window, columns), ddl)
