"""Substring dedup by recompression.

A text is its sequence of word hashes. Each round renames maximal runs of one symbol, then
the pairs (left, right) of symbols that a bit of their names puts on the left and right
side; a name is a hash of what it stands for, so a run or pair has the same name in every
document and every task, and Spark needs no dictionary join to name it globally. A symbol
is tagged with the words its naming looked at (its context): wherever those words recur,
so does the symbol. Equal long substrings therefore hold the same interior symbols.

1. Each window of ``window`` words points to the smallest-named symbol of the last round
   whose context lies inside it (its anchor, named by the symbol and its context; a window
   without one is its own). Consecutive windows with one anchor make a block. An anchor
   that stands in two documents reveals a repeat.
2. Blocks of revealed anchors are counted by (anchor, content): a block that a smaller
   document has verifies all its windows at once. Only where an anchor has blocks of
   different content, at the edges of repeats, the windows of the first block of each
   content are compared one by one. A window's smallest document holds it in the first
   block of some content, so the minimum over these windows is exact.
3. The words of windows that a smaller document has are removed, judged on the input.

Anchors only propose. What decides is a pair of independent 64-bit hashes (anchor and
content). Counts are combined before they are shuffled and never gathered by content, so a
passage in a third of all documents is one row per task and name. Document lists are
bounded by the document's own length.

Rows: nulls and empty texts have no words; fewer than ``window`` words are kept whole.
Rows that share a doc_id never remove each other's words (none is smaller). Rows without a
doc_id count as larger than any id and do not remove each other's words either. Extra
columns do no harm: working columns live in frames of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import order_id, text_words, written

WINDOW = 50
ROUNDS = 3

_U = np.uint64
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _MIX[0]
    x = (x ^ (x >> _U(27))) * _MIX[1]
    return x ^ (x >> _U(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    out = np.empty(len(words), object)
    out[:] = words
    return pd.util.hash_array(out, categorize=False)


def _name_runs(name: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Maximal runs a^k become one symbol; the context reaches the neighbours that end the run."""
    first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    last = np.r_[first[1:], len(name)] - 1
    count = (last - first + 1).astype(np.uint64)
    named = np.where(count > 1, mix(name[first] + count * _MIX[1]), name[first])
    return named, lo[np.maximum(first - 1, 0)], hi[np.minimum(last + 1, len(name) - 1)], first == 0, last == len(name) - 1


def _name_pairs(name: np.ndarray, lo: np.ndarray, hi: np.ndarray, round_no: int):
    """Left symbols followed by right symbols become one; sides are a bit of the scrambled name."""
    salt = _U((round_no + 1) * int(_MIX[0]) & 0xFFFFFFFFFFFFFFFF)
    right = (mix(name + salt) >> _U(63)).astype(bool)
    opens = np.r_[~right[:-1] & right[1:], False]
    closes = np.r_[False, opens[:-1]]
    merged = name.copy()
    at = np.flatnonzero(opens)
    merged[at] = mix(name[at] * _MIX[0] + mix(name[at + 1] + _U(round_no)))
    # a left symbol without partner has looked at its successor, a right one at its predecessor
    new_lo = np.where(right & ~closes, np.r_[lo[:1], lo[:-1]], lo)
    new_hi = np.where(~right & ~opens, np.r_[hi[1:], hi[-1:]], hi)
    new_hi[at] = hi[at + 1]
    keep = ~closes
    return merged[keep], new_lo[keep], new_hi[keep]


def parse(h: np.ndarray, rounds: int = ROUNDS):
    """Symbols after the rounds: name, first and last word of the context.

    A context that would reach over an end of ``h`` includes a word outside (-1 or n), so
    no window holds it.
    """
    name, lo, hi = h, np.arange(len(h)), np.arange(len(h))
    for k in range(rounds):
        name, lo, hi, at_start, at_end = _name_runs(name, lo, hi)
        lo, hi = np.where(at_start, -1, lo), np.where(at_end, len(h), hi)
        name, lo, hi = _name_pairs(name, lo, hi, k)
    return name, lo, hi


def _powers(base: np.uint64, size: int) -> np.ndarray:
    return np.cumprod(np.r_[_U(1), np.full(size, base, np.uint64)])


def content_prefix(h: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any stretch of words follows."""
    return np.r_[_U(0), np.cumsum(mix(h ^ _BASE) * _powers(_BASE, len(h))[:-1])]


def content_hashes(prefix: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the words first..last (inclusive), the same wherever these words stand."""
    content = (prefix[last + 1] - prefix[first]) * _powers(_INVERSE, len(prefix))[first]
    return mix(content + (last - first + 1).astype(np.uint64) * _MIX[0])


def _range_argmin(value: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Position of the leftmost minimum of value[first..last] for each (non-empty) range."""
    levels = [np.arange(len(value))]
    while (1 << len(levels)) <= int((last - first).max()) + 1:
        a = levels[-1]
        half = 1 << (len(levels) - 1)
        left, right = a[:-half], a[half:]
        levels.append(np.where(value[right] < value[left], right, left))
    k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out = np.empty(len(first), np.int64)
    for level, table in enumerate(levels):
        s = np.flatnonzero(k == level)
        left, right = table[first[s]], table[last[s] - (1 << level) + 1]
        out[s] = np.where(value[right] < value[left], right, left)
    return out


@dataclass
class Blocks:
    """Blocks of the windows of several texts; positions count in the joined texts."""

    label: np.ndarray  # anchor name
    content: np.ndarray  # hash of all words of the block
    begin: np.ndarray  # first window start
    end: np.ndarray  # last window start
    text: np.ndarray  # which text
    prefix: np.ndarray
    offset: np.ndarray  # where each text begins

    def windows(self, chosen: np.ndarray, window: int):
        """Of the chosen blocks: start of every window, its block and its content hash."""
        size = self.end[chosen] - self.begin[chosen] + 1
        at = np.repeat(self.begin[chosen] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return at, np.repeat(chosen, size), content_hashes(self.prefix, at, at + window - 1)


def blocks(hashes: list[np.ndarray], window: int = WINDOW, rounds: int = ROUNDS) -> Blocks:
    """The blocks of all texts at once, their words joined with one unlike symbol between texts.

    No window reaches over such a symbol, and no symbol whose context does lies in a window,
    so the blocks are those of each text alone.
    """
    size = np.fromiter(map(len, hashes), np.int64, len(hashes))
    offset = np.cumsum(size + 1) - size - 1
    h = np.empty(int(size.sum()) + len(hashes), np.uint64)
    for k, x in enumerate(hashes):
        h[offset[k] : offset[k] + size[k]] = x
    h[offset + size] = mix(np.arange(len(hashes)).astype(np.uint64) + _MIX[1])
    count = np.maximum(size - window + 1, 0)  # windows of each text
    text = np.repeat(np.arange(len(hashes)), count)
    start = np.arange(len(text)) + np.repeat(offset - np.cumsum(count) + count, count)
    name, lo, hi = parse(h, rounds)
    below = np.cumsum(np.bincount(lo + 1, minlength=len(h) + 2))  # how many lo are below a position
    upto = np.cumsum(np.bincount(hi, minlength=len(h) + 1))  # how many hi are at a position or before
    first, last = below[start], upto[start + window - 1] - 1
    held = np.flatnonzero(first <= last)
    anchor = -1 - start  # a window without a symbol is a block of its own
    if len(held):
        anchor[held] = _range_argmin(mix(name), first[held], last[held])
    edge = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]][: len(anchor)])
    begin, end = start[edge], start[np.r_[edge[1:], len(start)][: len(edge)] - 1]
    prefix = content_prefix(h)
    content = content_hashes(prefix, begin, end + window - 1)
    at = anchor[edge]
    of = np.maximum(at, 0)
    context = content_hashes(prefix, np.maximum(lo[of], 0), np.minimum(hi[of], len(h) - 1))
    label = np.where(at >= 0, mix(name[of] + context), mix(content))
    return Blocks(label, content, begin, end, text[edge], prefix, offset)


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _key(frame: DataFrame) -> DataFrame:
    """Order and join key of a row: ``ord`` (id, missing ones last) and, for rows without id, ``sub``."""
    sub = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return frame.select(order_id().alias("ord"), sub.alias("sub"), "*")


def _groups(pdf: pd.DataFrame, column: str = "text", words: int = 100_000) -> Iterator[tuple[pd.DataFrame, list]]:
    """Rows of a batch in groups of about so many words, with the words of each text."""
    first, held, found = 0, 0, []
    for k, text in enumerate(pdf[column]):
        found.append(text_words(text))
        held += len(found[-1])
        if held >= words:
            yield pdf.iloc[first : k + 1], found
            first, held, found = k + 1, 0, []
    if found:
        yield pdf.iloc[first:], found


def _emit_blocks(window: int, rounds: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows, words in _groups(pdf):
                b = blocks([word_hashes(w) for w in words], window, rounds)
                yield pd.DataFrame(
                    {
                        "anchor": _as_long(b.label),
                        "content": _as_long(b.content),
                        "ord": rows["ord"].to_numpy()[b.text],
                        "sub": rows["sub"].to_numpy()[b.text],
                    }
                ).drop_duplicates()

    return run


#: A list of (anchor, content) as one flat array of longs, light to hand to Python.
def _pair_list():
    """The distinct (anchor, content) of a document: no more than it has windows, however many rows repeat it."""
    return F.flatten(F.collect_set(F.array("anchor", "content")))


def _pairs(flat) -> set[tuple[int, int]]:
    return set() if flat is None else set(map(tuple, np.asarray(flat, np.int64).reshape(-1, 2).tolist()))


def _listed(anchor: np.ndarray, content: np.ndarray) -> list[tuple[int, int]]:
    return list(zip(_as_long(anchor).tolist(), _as_long(content).tolist(), strict=True))


def _emit_windows(window: int, rounds: int):
    """Windows of the blocks in ``mine`` of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows, words in _groups(pdf):
                b = blocks([word_hashes(w) for w in words], window, rounds)
                mine = [_pairs(m) for m in rows["mine"]]
                pairs = _listed(b.label, b.content)
                hit = [k for k, (p, t) in enumerate(zip(pairs, b.text.tolist(), strict=True)) if p in mine[t]]
                _, owner, content = b.windows(np.array(hit, np.int64), window)
                yield pd.DataFrame(
                    {
                        "anchor": _as_long(b.label[owner]),
                        "content": _as_long(content),
                        "ord": rows["ord"].to_numpy()[b.text[owner]],
                        "sub": rows["sub"].to_numpy()[b.text[owner]],
                    }
                ).drop_duplicates()

    return run


def removed_words(words: list[list[bytes]], gone: list[set], window: int = WINDOW, rounds: int = ROUNDS) -> list[np.ndarray]:
    """For each text, which words lie in a window whose block, or which itself, is in its set ``gone``."""
    masks = [np.zeros(len(w), bool) for w in words]
    some = [k for k, g in enumerate(gone) if g and len(words[k]) >= window]
    if not some:
        return masks
    b = blocks([word_hashes(words[k]) for k in some], window, rounds)
    covered = np.zeros(len(b.prefix) + window, np.int64)
    pairs = zip(_listed(b.label, b.content), b.text.tolist(), strict=True)
    whole = np.fromiter((p in gone[some[t]] for p, t in pairs), bool, len(b.text))
    np.add.at(covered, b.begin[whole], 1)
    np.add.at(covered, b.end[whole] + window, -1)
    at, owner, content = b.windows(np.flatnonzero(~whole), window)
    pairs = zip(_listed(b.label[owner], content), b.text[owner].tolist(), strict=True)
    single = np.fromiter((p in gone[some[t]] for p, t in pairs), bool, len(at))
    np.add.at(covered, at[single], 1)
    np.add.at(covered, at[single] + window, -1)
    mask = np.cumsum(covered) > 0
    for k, first in zip(some, b.offset.tolist(), strict=True):
        masks[k] = mask[first : first + len(words[k])]
    return masks


def spans(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true as (first, after last)."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


_CUT = "n_words long, n_removed long, kept_text string, removed array<struct<first: long, last: long>>"


def _cutter(window: int, rounds: int):
    @F.pandas_udf(_CUT)
    def cut(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for rows, words in _groups(pd.DataFrame({"text": text, "gone": gone})):
            masks = removed_words(words, [_pairs(g) for g in rows["gone"]], window, rounds)
            for w, mask in zip(words, masks, strict=True):
                kept = [x for x, m in zip(w, mask.tolist(), strict=True) if not m] if mask.any() else w
                found = [{"first": a, "last": b - 1} for a, b in spans(mask)]
                out.append((len(w), int(mask.sum()), b" ".join(kept).decode("utf-8", "surrogatepass"), found))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text", "removed"])

    return cut


def repeated_windows(keyed: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(ord, sub, gone): per document the blocks and windows that a smaller document has."""
    schema = "anchor long, content long, ord long, sub long"
    every = keyed.select("ord", "sub", "text").mapInPandas(_emit_blocks(window, rounds), schema)
    shared = every.groupBy("anchor").agg(F.min("ord").alias("a"), F.max("ord").alias("b")).where("a < b")
    shared = written(shared.select("anchor"), "shared-anchors")
    # texts are parsed again rather than kept: most blocks go here
    found = written(every.join(shared, "anchor", "left_semi"), "blocks")
    content = found.groupBy("anchor", "content").agg(F.min("ord").alias("least"), F.max("ord").alias("most"))
    content = written(content, "block-contents")
    # blocks that a smaller document has as well
    verified = found.join(content.where("least < most"), ["anchor", "content"]).where("ord > least")
    # anchors with several contents go window by window, the first block of each content
    # (stored, so that the join deals both sides out anew and a hot anchor's partition can be split)
    several = content.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    several = written(several, "edge-anchors")
    first = found.join(content.join(several, "anchor", "left_semi"), ["anchor", "content"]).where("ord = least")
    mine = first.groupBy("ord", "sub").agg(_pair_list().alias("mine"))
    # the join on (ord, sub) deals the texts out like the last join below, so Spark reuses that exchange
    windows = keyed.join(mine, ["ord", "sub"]).mapInPandas(_emit_windows(window, rounds), schema)
    least = windows.groupBy("anchor", "content").agg(F.min("ord").alias("least"), F.max("ord").alias("most"))
    later = windows.join(least.where("least < most"), ["anchor", "content"]).where("ord > least")
    columns = ["ord", "sub", "anchor", "content"]
    gone = verified.select(columns).unionByName(later.select(columns))
    return gone.groupBy("ord", "sub").agg(_pair_list().alias("gone"))


def cut_repeats(
    docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text and the removed word spans."""
    keyed = _key(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    gone = repeated_windows(keyed, window, rounds)
    cut = _cutter(window, rounds)(F.col("text"), F.col("gone"))
    return keyed.join(gone, ["ord", "sub"], "left").select("doc_id", cut.alias("c")).select("doc_id", "c.*")


def without_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with repeated words cut from ``text`` (and ``n_chars`` to match, if there is one).

    Every row stays. A text that loses words has the rest joined by one space; the others
    are as they were.
    """
    held = F.struct(*docs.columns)
    keyed = _key(docs.select("doc_id", "text", held.alias("row")))
    gone = repeated_windows(keyed, window, rounds)
    cut = _cutter(window, rounds)(F.col("text"), F.col("gone"))
    both = keyed.join(gone, ["ord", "sub"], "left")
    fate = both.withColumn("c", F.when(F.col("gone").isNotNull(), cut))
    new = F.when(F.col("c.n_removed") > 0, F.col("c.kept_text")).otherwise(F.col("text"))
    named = {"text": new, "n_chars": F.char_length(new).cast("long")}
    return fate.select(*[(named[c] if c in named else F.col("row")[c]).alias(c) for c in docs.columns])
