"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (``passage`` consecutive words each, the last may be
shorter). Every passage is encoded: learned vectors of its hashed words and word shapes,
averaged, beside measurements of its form, go through one tanh layer to the representation h.
Gated attention weighs the passages, a = softmax over the bag of w . (tanh(V h) * sigmoid(U h)),
and the weighted representation, sum of a h, is scored. Only documents are labelled; which passages
decide is learned with the rest, by back-propagation through the attention.

Training (Adam on the logistic loss, numpy on the driver) reads about ``max_rows`` labelled
documents, those below a cut of a hash of doc_id, and their whole texts; of rows that share a
doc_id, one. Scoring reads every row. Scoring keeps a running softmax over blocks of passages, so
a text of any length is scored whole in bounded memory.

Rows: a null or empty text is one passage without words. Labels that are null are left out;
a doc_id labelled twice is good only if both labels say so. Repeated rows are scored one by
one; a null doc_id is not held out. Without labels, or with one class only, every score is
the smoothed share of good labels. Only named columns are read, so further columns of any
name do no harm; an empty table has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: fold of the held-out rows and the threshold.
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7

MEASURES = 15


def _class(byte: int) -> int:
    if 0x80 <= byte < 0xC0:
        return 5  # a further byte of a character: not counted
    c = chr(byte)
    if byte >= 0xC0:
        return 0
    return 1 if c.isupper() else 0 if c.isalpha() else 2 if c.isdigit() else 3 if c in " \t\n\x0b\x0c\r" else 4


#: Class of each byte of UTF-8: letter (also the first byte of any other character), capital, digit, white space, sign.
_CLASS = np.array([_class(k) for k in range(256)], np.uint8)
#: The same as signs: letters, capitals and digits by one sign each, other bytes as they are.
_SHAPE = bytes(b"aA0"[c] if c < 3 else k for k, c in enumerate(_CLASS.tolist()))
_ENDS = np.frombuffer(b".,;:?", np.uint8)


@dataclass(frozen=True)
class MilParams:
    passage: int = 64  # words
    bits: int = 14  # hashed words and shapes
    word_dim: int = 12
    hidden: int = 24
    gate: int = 12
    max_rows: int = 8_000
    epochs: int = 10
    batch: int = 64  # documents
    rate: float = 4e-3
    l2: float = 1e-5
    seed: int = 11
    block: int = 256  # passages scored at a time


# --------------------------------------------------------------------------- passages
def term_code(word: bytes) -> int:
    """Two 32-bit hashes in one number: of the word with its letters A-Z lower-cased, and of its
    shape, the classes of its first two and last three bytes."""
    shape = word.translate(_SHAPE)
    return crc32(word.lower()) | crc32(shape[:2] + shape[-3:], 1) << 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted, and where a value stands first in its row."""
    rows = np.sort(rows, axis=1)
    first = np.ones(rows.shape, bool)
    first[:, 1:] = rows[:, 1:] != rows[:, :-1]
    return rows, first


def encode(text: str | None, p: MilParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each passage the measurements, how many hashed terms it has, and all those terms in order.

    Words are runs of anything but space and \\t..\\r. The measurements of a passage: its words,
    classes of characters, lengths of words, repeated words and word pairs, pairs that an earlier
    passage has, lines and repeated lines, words that end in punctuation.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), p.passage
    if not n:
        form = np.zeros((1, MEASURES), np.float32)
        form[0, 1] = 1
        return form, np.zeros(1, np.int32), np.empty(0, np.int32)
    code = np.fromiter(map(term_code, words), np.uint64, n)
    byte = np.frombuffer(raw, np.uint8)
    kind = _CLASS[byte]
    inside = np.flatnonzero(np.diff(np.r_[True, kind == 3, True].astype(np.int8)))
    start, end = inside[::2], inside[1::2]
    at = np.arange(0, n, size)  # the first word of each passage
    rows = len(at)
    per = np.diff(np.r_[at, n])  # words of each passage
    # bytes by class: of letters, capitals, digits and signs
    cut = start[at]
    letters, capitals, digits, signs = (np.add.reduceat(kind == k, cut, dtype=np.int64) for k in (0, 1, 2, 4))
    chars = np.maximum(letters + capitals + digits + signs, 1)
    length = end - start
    # a matrix of words, the last passage filled up with its last word, and one of word pairs
    grid = np.full(rows * size, code[-1])
    grid[:n] = code
    grid = grid.reshape(rows, size)
    _, new_word = _distinct(grid)
    n_pairs = np.maximum(per - 1, 0)
    with np.errstate(over="ignore"):
        pair = _mixed(grid[:, :-1] * np.uint64(0x9E3779B97F4A7C15) + grid[:, 1:])
    for row in np.flatnonzero(n_pairs < size - 1):
        pair[row, n_pairs[row] :] = pair[row, 0]
    _, first, ids = np.unique(pair.ravel(), return_index=True, return_inverse=True)
    ids, new_pair = _distinct(ids.reshape(pair.shape))
    known = new_pair & (first[ids] // (size - 1) < np.arange(rows)[:, None])
    same = np.r_[False, code[1:] == code[:-1]]
    same[at] = False
    # lines: their number and how many differ, by the words that they have in the passage
    line = np.searchsorted(np.flatnonzero(byte == 10), start)
    opens = np.r_[True, line[1:] != line[:-1]]
    opens[at] = True
    begin = np.flatnonzero(opens)
    place = np.arange(n) - np.repeat(begin, np.diff(np.r_[begin, n]))
    with np.errstate(over="ignore"):
        content = np.add.reduceat(_mixed(code + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), begin)
    of = begin // size
    order = np.lexsort((content, of))
    fresh = np.r_[True, (np.diff(of[order]) != 0) | (content[order][1:] != content[order][:-1])]
    lines = np.bincount(of, minlength=rows)
    form = np.column_stack(
        [
            np.log1p(per),
            np.zeros(rows),
            (letters + capitals) / chars,
            capitals / chars,
            digits / chars,
            signs / chars,
            np.log1p(np.add.reduceat(length, at) / per),
            np.log1p(np.maximum.reduceat(length, at)),
            new_word.sum(1) / per,
            np.where(n_pairs > 0, new_pair.sum(1), 0) / np.maximum(n_pairs, 1),
            np.add.reduceat(same, at, dtype=np.int64) / per,
            np.where(n_pairs > 0, known.sum(1) / new_pair.sum(1), 0),
            lines / per,
            np.bincount(of[order][fresh], minlength=rows) / lines,
            np.add.reduceat(np.isin(byte[end - 1], _ENDS), at, dtype=np.int64) / per,
        ]
    )
    terms = (code.astype("<u8").view("<u4") >> np.uint32(32 - p.bits)).astype(np.int32)
    return form.astype(np.float32), (2 * per).astype(np.int32), terms


# ------------------------------------------------------------------------------ model
def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Word vectors E, encoder W, gated attention (V, U, w) and the score (c, b)."""

    def __init__(self, p: MilParams, share: float):
        rng = np.random.default_rng(p.seed)
        wide = p.word_dim + MEASURES
        normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.mean, self.scale = np.zeros(MEASURES, np.float32), np.ones(MEASURES, np.float32)
        self.weights = {
            "E": rng.normal(0, 0.1, (1 << p.bits, p.word_dim)).astype(np.float32),
            "W": normal(wide, p.hidden),
            "wb": np.zeros(p.hidden, np.float32),
            "V": normal(p.hidden, p.gate),
            "U": normal(p.hidden, p.gate),
            "w": normal(p.gate),
            "c": np.zeros(p.hidden, np.float32),
            "b": np.array([np.log(share / (1 - share))], np.float32),
        }

    def represent(self, form: np.ndarray, size: np.ndarray, terms: np.ndarray):
        """(inputs, h, gates t and s, attention logits) of passages."""
        m = self.weights
        n = len(form)
        words = np.zeros((n, m["E"].shape[1]), np.float32)
        some = np.flatnonzero(size)
        if len(some):
            start = (np.cumsum(size) - size)[some]
            words[some] = np.add.reduceat(m["E"][terms], start) / size[some, None]
        x = np.concatenate([words, (form - self.mean) / self.scale], axis=1)
        h = np.tanh(x @ m["W"] + m["wb"])
        t, s = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
        return x, h, t, s, (t * s) @ m["w"]

    def step(self, bags, good: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss over a batch of bags."""
        m = self.weights
        form, size, terms = (np.concatenate(part) for part in zip(*bags, strict=True))
        n_passages = np.array([len(b[0]) for b in bags])
        start = np.cumsum(n_passages) - n_passages
        bag = np.repeat(np.arange(len(bags)), n_passages)
        x, h, t, s, logit = self.represent(form, size, terms)
        e = np.exp(logit - np.maximum.reduceat(logit, start)[bag])
        a = e / np.add.reduceat(e, start)[bag]
        z = np.add.reduceat(a[:, None] * h, start)
        error = ((_sigmoid(z @ m["c"] + m["b"]) - good) / len(bags)).astype(np.float32)
        grad = {"c": z.T @ error, "b": error.sum(keepdims=True)}
        gz = error[:, None] * m["c"]
        ga = (gz[bag] * h).sum(1)
        glogit = a * (ga - np.add.reduceat(a * ga, start)[bag])
        gts = glogit[:, None] * m["w"]
        grad["w"] = (t * s).T @ glogit
        gt, gs = gts * s * (1 - t * t), gts * t * s * (1 - s)
        grad["V"], grad["U"] = h.T @ gt, h.T @ gs
        gh = (a[:, None] * gz[bag] + gt @ m["V"].T + gs @ m["U"].T) * (1 - h * h)
        grad["W"], grad["wb"] = x.T @ gh, gh.sum(0)
        gwords = (gh @ m["W"].T)[:, : m["E"].shape[1]] / np.maximum(size, 1)[:, None]
        of = np.repeat(np.arange(len(size)), size)
        order = np.argsort(terms, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(terms[order]) != 0]) if len(terms) else np.empty(0, np.int64)
        grad["E"] = np.add.reduceat(gwords[of[order]], first) if len(first) else gwords[:0]
        self.touched = terms[order][first]
        return grad

    def score(self, bag, block: int) -> float:
        """Score of one document; passages are read in blocks under a running softmax."""
        m = self.weights
        form, size, terms = bag
        upto = np.r_[0, np.cumsum(size)]
        top, total, z = -np.inf, 0.0, np.zeros(m["W"].shape[1])
        for k in range(0, len(form), block):
            part = slice(k, k + block)
            last = min(k + block, len(form))
            _, h, _, _, logit = self.represent(form[part], size[part], terms[upto[k] : upto[last]])
            high = max(top, float(logit.max()))
            keep, e = np.exp(top - high), np.exp((logit - high).astype(np.float64))
            z, total, top = z * keep + e @ h, total * keep + e.sum(), high
        return float(_sigmoid((z / total) @ m["c"].astype(np.float64) + float(m["b"][0])))

    @classmethod
    def fit(cls, bags: list, good: np.ndarray, p: MilParams) -> AttentionModel:
        model = cls(p, (good.sum() + 1.0) / (len(good) + 2.0))
        if not 0 < good.sum() < len(good):
            model.weights["c"][:] = 0
            return model
        form = np.concatenate([b[0] for b in bags])
        model.mean, model.scale = form.mean(0), form.std(0) + 1e-3
        m = model.weights
        m["c"][:] = np.random.default_rng(p.seed + 1).normal(0, 0.1, p.hidden)
        first = {k: np.zeros_like(v) for k, v in m.items()}
        second = {k: np.zeros_like(v) for k, v in m.items()}
        rng, t = np.random.default_rng(p.seed + 2), 0
        for epoch in range(p.epochs):
            order = rng.permutation(len(bags))
            rate = p.rate * (1 - epoch / p.epochs) ** 0.5
            for k in range(0, len(order), p.batch):
                chosen = order[k : k + p.batch]
                grad = model.step([bags[i] for i in chosen], good[chosen])
                t += 1
                for name, g in grad.items():  # Adam; of the word vectors only those in the batch move
                    at = model.touched if name == "E" else slice(None)
                    g = g + p.l2 * m[name][at]
                    first[name][at] = 0.9 * first[name][at] + 0.1 * g
                    second[name][at] = 0.99 * second[name][at] + 0.01 * g * g
                    step = first[name][at] / (1 - 0.9**t) / (np.sqrt(second[name][at] / (1 - 0.99**t)) + 1e-8)
                    m[name][at] -= rate * step
        return model


# ------------------------------------------------------------------------------ Spark
def is_held_out(doc_id: Column) -> Column:
    """Rows never trained on: crc32 of the id as text, modulo 4, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _hash_cut(known: DataFrame, max_rows: int) -> DataFrame:
    """Rows below a cut of a hash of doc_id: as many as ``max_rows`` less four deviations are expected."""
    n = known.count()
    if n <= max_rows:
        return known
    share = max_rows / n - 4 * np.sqrt(max_rows) / n
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))


def training_rows(docs: DataFrame, labels: DataFrame, p: MilParams) -> DataFrame:
    """(doc_id, good, bag): labelled documents that are not held out, one row per id."""
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("good"))
    )
    known = _hash_cut(known, p.max_rows)

    @F.pandas_udf("form binary, size binary, terms binary")
    def bags(texts: pd.Series) -> pd.DataFrame:
        rows = [tuple(part.tobytes() for part in encode(t, p)) for t in texts]
        return pd.DataFrame(rows, columns=["form", "size", "terms"])

    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # max_rows small rows
    chosen = chosen.groupBy("doc_id", "good").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return chosen.select("doc_id", "good", bags("text").alias("bag"))


def train(docs: DataFrame, labels: DataFrame, params: MilParams = MilParams()) -> AttentionModel:
    found = training_rows(docs, labels, params).collect()  # at most max_rows documents
    rows = sorted((r["doc_id"], r["good"], bytes(r["bag"][0]), bytes(r["bag"][1]), bytes(r["bag"][2])) for r in found)
    bags = [
        (np.frombuffer(f, np.float32).reshape(-1, MEASURES), np.frombuffer(s, np.int32), np.frombuffer(t, np.int32))
        for _, _, f, s, t in rows
    ]
    return AttentionModel.fit(bags, np.array([g for _, g, *_ in rows], np.float32), params)


def score_documents(
    docs: DataFrame, model: AttentionModel, params: MilParams = MilParams(), text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(encode(t, params), params.block) for t in texts], dtype="float64")

    scored = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), of(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
