"""BPE encoding and decoding with batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. A round looks every adjacent
pair up by binary search over the sorted pair keys, finds the lowest rank in each word and
merges it everywhere at once; words without a known pair leave the array. Texts are cut
into white-space chunks first (no pre-token spans white space), so a task encodes each
distinct chunk once and assembles texts from a bounded chunk cache.

The vocabulary file is read on the driver and broadcast as arrays; its size is fixed by
the vocabulary. Nulls and empty texts have no ids and decode to the empty text. Rows are
encoded one by one, so repeated rows, ties and extra columns need no care.
"""

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the tokenizer's format: Unicode white space, pre-token pattern, end-of-word mark.
_SPACES = "\\t-\\r \\x85\\xa0" + "".join(
    map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
_CHUNK = re.compile(f"[^{_SPACES}]+")
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
#: Fixed values of the tokenizer's Unicode version: letters of newer versions, which are no letters to it.
_NO_LETTERS = (
    (0x558, 0x558), (0x58b, 0x58c), (0x88f, 0x88f), (0xc5c, 0xc5c), (0xcdc, 0xcdc), (0x208f, 0x208f),
    (0x209d, 0x209f), (0xa7ce, 0xa7cf), (0xa7d2, 0xa7d2), (0xa7d4, 0xa7d4), (0xa7dd, 0xa7dd), (0xa7e2, 0xa7e2),
    (0xa7f1, 0xa7f1), (0xab6c, 0xab6d), (0x107bb, 0x107bf), (0x10940, 0x10959), (0x10ec5, 0x10ec7),
    (0x10ed9, 0x10eee), (0x11b0a, 0x11b0a), (0x11db0, 0x11ddb), (0x11df1, 0x11df1), (0x16ea0, 0x16eb8),
    (0x16ebb, 0x16ed3), (0x16ff2, 0x16ff3), (0x187f8, 0x187ff), (0x18cd6, 0x18cda), (0x18d09, 0x18d20),
    (0x18d80, 0x18df2), (0x18e00, 0x19191), (0x191a0, 0x191d2), (0x1b123, 0x1b128), (0x1b168, 0x1b168),
    (0x1d6a6, 0x1d6a6), (0x1df1f, 0x1df24), (0x1df2b, 0x1df81), (0x1df90, 0x1df96), (0x1dfcd, 0x1dfff),
    (0x1e6c0, 0x1e6de), (0x1e6e0, 0x1e6e2), (0x1e6e4, 0x1e6e5), (0x1e6e7, 0x1e6ed), (0x1e6f0, 0x1e6f4),
    (0x1e6fe, 0x1e6ff), (0x2b73a, 0x2b73f), (0x2b81e, 0x2b81e), (0x2cea2, 0x2cead), (0x323b0, 0x33479),
    (0x3d000, 0x3fc3f),
)
#: Numbers of newer versions, which are no numbers to it.
_NO_NUMBERS = ((0x11de0, 0x11de9), (0x1246f, 0x1246f), (0x12475, 0x1247f), (0x12550, 0x12686), (0x16ff4, 0x16ff6))
#: Lower-case letters of capitals that the standard library does not know yet, singly and by ranges.
_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB,
    0xA7DC: 0x19B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
_CAPITALS = re.compile("[\u1c89\ua7cb-\ua7dc\U00010d50-\U00010d65\U00016ea0-\U00016eb8]")  # where they stand
_SETS = ["".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) for ranges in (_NO_LETTERS, _NO_NUMBERS)]
_BEYOND = re.compile(f"[{chr(_NO_LETTERS[0][0])}-\U0010ffff]")  # a quick look before the long list
_HAS_NEWER = re.compile(f"[{''.join(_SETS)}]")
_LETTER, _NUMBER = rf"[\p{{L}}--[{_SETS[0]}]]", rf"[\p{{N}}--[{_SETS[1]}]]"
_PRETOKEN_NEWER = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|{_LETTER}+|{_NUMBER}|(?:(?!{_LETTER}|{_NUMBER}).)+", regex.V1 | regex.DOTALL
)
_WORD_END = "</w>"
#: Bytes from which on a word is merged by itself.
LONG_WORD = 1000
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@dataclass(frozen=True)
class BpeModel:
    """A vocabulary as arrays; ``pair_keys`` is sorted, the other pair arrays follow it."""

    tokens: tuple[str, ...]
    inner: np.ndarray  # id of each byte inside a word
    final: np.ndarray  # id of each byte at the end of a word
    pair_keys: np.ndarray
    pair_rank: np.ndarray
    merged: np.ndarray  # by rank
    steady: np.ndarray  # by rank: no pair with the merged symbol has a lower rank
    special: dict[str, int]

    @classmethod
    def read(cls, path: str | Path) -> "BpeModel":
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        vocab: dict[str, int] = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for t, k in (vocab | special).items():
            tokens[k] = t
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys)
        rank = np.arange(len(pairs))
        first_use = np.full(len(tokens), _NONE)
        np.minimum.at(first_use, left, rank)
        np.minimum.at(first_use, right, rank)
        shown = byte_symbols()
        return cls(
            tuple(tokens),
            np.array([vocab[c] for c in shown], np.int64),
            np.array([vocab[c + _WORD_END] for c in shown], np.int64),
            keys[order],
            rank[order],
            merged,
            first_use[merged] > rank,
            special,
        )

    def merge_words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and the number of ids of each word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        if len(words) and size.max() > LONG_WORD:  # words of many ranks would keep the others waiting
            parts = [self.merge_long(w) if len(w) > LONG_WORD else None for w in words]
            ids, count = self.merge_words([w for w, part in zip(words, parts, strict=True) if part is None])
            short = iter(np.split(ids, np.cumsum(count)[:-1]) if len(count) else [])
            parts = [next(short) if part is None else part for part in parts]
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inner[raw]
        ends = np.cumsum(size) - 1
        symbol[ends] = self.final[raw[ends]]
        owner = np.repeat(np.arange(len(words)), size)
        done_symbol, done_owner = [], []
        while len(symbol):
            rank = self._ranks(symbol, owner)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            low = np.repeat(lowest, np.diff(np.r_[first, len(symbol)]))
            over = low == _NONE
            done_symbol.append(symbol[over])
            done_owner.append(owner[over])
            symbol, owner, rank, low = symbol[~over], owner[~over], rank[~over], low[~over]
            if not len(symbol):
                break
            at = self._choose(np.flatnonzero(rank == low), rank, owner, symbol)
            symbol[at] = self.merged[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, owner = symbol[keep], owner[keep]
        ids, whose = np.concatenate([np.empty(0, np.int64), *done_symbol]), np.concatenate(
            [np.empty(0, np.int64), *done_owner]
        )
        order = np.argsort(whose, kind="stable")
        return ids[order], np.bincount(whose, minlength=len(words))

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: the same rounds, but symbols stay in place under links, and a
        round looks up only the pairs beside its merges."""
        symbol = self.inner[np.frombuffer(word, np.uint8)]
        symbol[-1] = self.final[word[-1]]
        while True:
            n = len(symbol)
            before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
            rank = np.full(n + 1, _NONE)  # the place behind the word never starts a pair
            rank[: n - 1] = self._rank_of(symbol[:-1], symbol[1:])
            live = np.ones(n, bool)
            left = n
            while left > n // 2 and (lowest := rank.min()) != _NONE:
                at = np.flatnonzero(rank == lowest)
                made = self.merged[lowest]
                follows = np.r_[False, after[at[:-1]] == at[1:]]  # overlaps the pair before it
                run = np.flatnonzero(~follows)
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
                if len(at) > 1 and not self.steady[lowest]:
                    touches = np.r_[False, after[after[at[:-1]]] == at[1:]]
                    west, east = before[at], after[after[at]]
                    low_west = np.where(touches, made, symbol[np.maximum(west, 0)])
                    opens = ((west >= 0) & (self._rank_of(low_west, np.full(len(at), made)) <= lowest)) | (
                        (east < n) & (self._rank_of(np.full(len(at), made), symbol[np.minimum(east, n - 1)]) <= lowest)
                    )
                    if opens.any():
                        at = at[: int(opens.argmax()) + 1]
                gone = after[at]
                symbol[at], live[gone], rank[gone] = made, False, _NONE
                after[at] = after[gone]
                inside = after[at] < n
                before[after[at[inside]]] = at[inside]
                here = np.r_[at, before[at][before[at] >= 0]]
                there = after[here]
                paired = there < n
                rank[here] = _NONE
                rank[here[paired]] = self._rank_of(symbol[here[paired]], symbol[there[paired]])
                left -= len(gone)
            symbol = symbol[live]
            if left > n // 2:  # no known pair is left
                return symbol

    def _ranks(self, symbol: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each symbol, by binary search over the sorted keys."""
        rank = np.full(len(symbol), _NONE)
        same = owner[:-1] == owner[1:]
        rank[:-1][same] = self._rank_of(symbol[:-1][same], symbol[1:][same])
        return rank

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], _NONE)

    def _choose(self, at: np.ndarray, rank: np.ndarray, owner: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Of the lowest pairs, those that merge in this round.

        Overlapping pairs (x x x) merge from the left, every other one. A merge may open a pair
        of lower rank with a neighbour, which then comes before the merges to its right: of a
        word, those up to the first such place merge.
        """
        start = np.r_[True, np.diff(at) != 1]
        offset = np.arange(len(at)) - np.flatnonzero(start)[np.cumsum(start) - 1]
        at = at[offset % 2 == 0]
        opens = np.zeros(len(at), bool)
        doubt = np.flatnonzero(~self.steady[rank[at]])
        if len(doubt):
            here, made = at[doubt], self.merged[rank[at[doubt]]]
            # to the left may stand the same symbol, just merged; to the right nothing has merged yet
            merged_left = np.r_[False, (np.diff(at) == 2) & (owner[at][1:] == owner[at][:-1])][doubt]
            left = np.where(merged_left, made, symbol[np.maximum(here - 1, 0)])
            has_left = merged_left | ((here > 0) & (owner[np.maximum(here - 1, 0)] == owner[here]))
            after = np.minimum(here + 2, len(symbol) - 1)
            has_right = (here + 2 < len(symbol)) & (owner[after] == owner[here])
            lower = lambda a, b, has: has & (self._rank_of(a, b) <= rank[here])
            opens[doubt] = lower(left, made, has_left) | lower(made, symbol[after], has_right)
        # of each word, what lies behind its first opening place waits
        word_start = np.flatnonzero(np.r_[True, owner[at][1:] != owner[at][:-1]])
        before = np.cumsum(opens) - opens
        waits = before > np.repeat(before[word_start], np.diff(np.r_[word_start, len(at)]))
        return at[~waits]


def normalize(text: str) -> str:
    """NFC and lower case, letter by letter (a capital sigma has no special final form)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
    return text.translate(_LOWER) if _CAPITALS.search(text) else text


def pre_tokens(chunk: str) -> list[str]:
    """Pieces of a chunk without white space."""
    newer = not chunk.isascii() and _BEYOND.search(chunk) and _HAS_NEWER.search(chunk)
    return (_PRETOKEN_NEWER if newer else _PRETOKEN).findall(chunk)


class Encoder:
    """Encodes texts with a model; remembers the ids of recent chunks up to a bound."""

    def __init__(self, model: BpeModel, max_chunks: int = 100_000):
        self.model, self.max_chunks, self.cache = model, max_chunks, {}
        self.special = re.compile("|".join(map(re.escape, model.special)) or r"(?!)")

    def parts(self, text: str) -> list[tuple[str, int | None]]:
        """Plain stretches, and the ids of special tokens between them."""
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], None), (m[0], self.model.special[m[0]])]
            at = m.end()
        return [*out, (text[at:], None)]

    def learn(self, chunks: Iterable[str]) -> None:
        """Put the ids of all chunks into the cache: one batch of merge rounds for the unknown words."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.cache]
        if len(self.cache) + len(new) > self.max_chunks:
            self.cache.clear()
            new = list(dict.fromkeys(chunks))
        if not new:
            return
        split = [pre_tokens(c) for c in new]
        place = {w: k for k, w in enumerate(dict.fromkeys(w for ws in split for w in ws))}
        ids, count = self.model.merge_words([w.encode("utf-8", "surrogatepass") for w in place])
        ends = np.cumsum(count) * 4
        raw, starts = ids.astype("<u4").tobytes(), ends - count * 4
        word = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        for c, ws in zip(new, split, strict=True):
            self.cache[c] = b"".join([word[place[w]] for w in ws])

    def encode(self, texts: Sequence[str | None], batch_chars: int = 1_000_000) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        batch: list[list[tuple[list[str], int | None]]] = []
        held = 0
        for text in texts:
            rows = []
            for part, k in self.parts(text or ""):
                rows.append(([], k) if k is not None else (_CHUNK.findall(normalize(part)), None))
            batch.append(rows)
            held += len(text or "")
            if held >= batch_chars:
                out += self._flush(batch)
                batch, held = [], 0
        return out + self._flush(batch)

    def _flush(self, batch: list) -> list[bytes]:
        self.learn([c for rows in batch for chunks, _ in rows for c in chunks])
        known = self.cache.__getitem__
        one = lambda k: int(k).to_bytes(4, "little")
        return [
            b"".join([one(k) if k is not None else b"".join(map(known, chunks)) for chunks, k in rows])
            for rows in batch
        ]


def decode_ids(model_tokens: np.ndarray, ids: bytes | None) -> str:
    """Tokens joined by one space, as a tokenizer without a decoder does; specials are kept."""
    return " ".join(model_tokens[np.frombuffer(ids or b"", "<u4")].tolist())


def _pieces(batch: pa.RecordBatch, column: int, piece_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many bytes of text, so that few texts are Python objects at a time."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size) // piece_bytes
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True][: len(group) + 1]) if len(group) else []
    for first, last in zip(edge, [*edge[1:], len(group)], strict=False):
        if last > first:
            yield batch.slice(first, last - first)


def decoder(spark: SparkSession, path: str | Path):
    """Column function: ids (binary) -> text."""
    tokens = spark.sparkContext.broadcast(np.array(BpeModel.read(path).tokens, dtype=object))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series([decode_ids(tokens.value, b) for b in ids], dtype=object)

    return F.pandas_udf(run, "string")


def ids_array(ids: Column) -> Column:
    """The binary ids as an array of integers."""
    word = lambda k: F.conv(
        F.concat(*[F.substring(F.hex(ids), k * 8 + 7 - 2 * b, 2) for b in range(4)]), 16, 10
    )
    n = (F.length(ids) / 4).cast("int")
    return F.when(n == 0, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda k: word(k).cast("long"))
    )


def encode(
    docs: DataFrame, path: str | Path, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """One row per row of ``docs``: id, ``ids`` (binary), ``n_tokens`` and, if asked for, the text decoded from them.

    Texts go through Python a small slice at a time; the vocabulary is broadcast.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = docs.sparkSession.sparkContext.broadcast(vars(BpeModel.read(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = BpeModel(**fields.value)
        enc, tokens = Encoder(model), np.array(model.tokens, dtype=object)
        for batch in batches:
            for piece in _pieces(batch, 1):
                ids = enc.encode(piece.column(1).to_pylist())
                out = {"doc_id": piece.column(0), "ids": pa.array(ids, pa.binary())}
                if decoded:
                    out["decoded"] = pa.array([decode_ids(tokens, b) for b in ids], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    schema = T.StructType([slim.schema["doc_id"], T.StructField("ids", T.BinaryType())])
    if decoded:
        schema = schema.add("decoded", T.StringType())
    found = slim.mapInArrow(run, schema)
    return found.withColumn("n_tokens", (F.length("ids") / 4).cast("long"))


def decode(encoded: DataFrame, path: str | Path) -> DataFrame:
    """Adds the column ``decoded`` to a frame with ``ids``."""
    return encoded.withColumn("decoded", decoder(encoded.sparkSession, path)(F.col("ids")))
