"""Attention over passages: gradients, the running softmax, held-out labels, awkward rows."""

import re
import zlib

import numpy as np
import pytest

from tests.llm.data import awkward, empty, frame
from tillroll.llm import attention as A
from tillroll.llm.common import table

SF01 = "/root/testdata/sf0.1"
SMALL = A.MilParams(passage=8, bits=8, word_dim=3, hidden=5, gate=4, epochs=3, block=2)


def bags_of(texts, p=SMALL):
    return [A.encode(t, p) for t in texts]


def loss(model, bags, good, p):
    s = np.array([model.score(b, p.block) for b in bags])
    return -np.mean(good * np.log(s) + (1 - good) * np.log(1 - s))


def test_gradients_equal_differences():
    texts = ["one two three four five six seven eight nine ten " * 2, "A b\nC", "", "x y z " * 20]
    bags, good = bags_of(texts), np.array([1, 0, 0, 1], np.float32)
    model = A.AttentionModel(SMALL, 0.5)
    rng = np.random.default_rng(5)
    for k, v in model.weights.items():
        model.weights[k] = v.astype(np.float64)
    model.weights["c"] = rng.normal(size=SMALL.hidden)
    grad = model.step(bags, good)
    for name, g in grad.items():
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 12)]:
            where = (model.touched[at[0]], at[1]) if name == "E" else at
            w, eps = model.weights[name], 1e-5
            w[where] += eps
            up = loss(model, bags, good, SMALL)
            w[where] -= 2 * eps
            down = loss(model, bags, good, SMALL)
            w[where] += eps
            assert g[at] == pytest.approx((up - down) / (2 * eps), abs=2e-5), name


def test_score_does_not_depend_on_the_block():
    bag = A.encode("some words here. " * 100 + "AND OTHERS!! " * 30, SMALL)
    model = A.AttentionModel(SMALL, 0.4)
    model.weights["c"] += 1
    scores = [model.score(bag, k) for k in (1, 2, 7, 1000)]
    assert np.allclose(scores, scores[0], rtol=1e-6)


def brute_form(text, size):
    """The measurements by plain Python over the words and lines of each passage."""
    text = text or ""
    words = [(m.group(), text.count("\n", 0, m.start())) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, seen = [], set()
    for k in range(0, max(len(words), 1), size):
        part = words[k : k + size]
        ws, n = [w for w, _ in part], max(len(part), 1)
        chars = "".join(ws)
        letters = sum(c.isalpha() or ord(c) > 127 for c in chars)
        signs = sum(ord(c) < 128 and not c.isalnum() for c in chars)
        total = max(len(chars), 1)
        lengths = [len(w.encode("utf-8", "surrogatepass")) for w in ws] or [0]
        codes = [A.term_code(w.encode("utf-8", "surrogatepass")) for w in ws]
        pairs = set(zip(codes, codes[1:], strict=False))
        lines = [tuple(c for c, (_, x) in zip(codes, part, strict=True) if x == line) for line in sorted({x for _, x in part})]
        out.append(
            [
                np.log1p(len(ws)),
                not ws,
                letters / total,
                sum("A" <= c <= "Z" for c in chars) / total,
                sum("0" <= c <= "9" for c in chars) / total,
                signs / total,
                np.log1p(sum(lengths) / n),
                np.log1p(max(lengths)),
                len(set(codes)) / n,
                len(pairs) / max(len(ws) - 1, 1),
                sum(a == b for a, b in zip(codes, codes[1:], strict=False)) / n,
                len(pairs & seen) / max(len(pairs), 1),
                len(lines) / n,
                len(set(lines)) / max(len(lines), 1),
                sum(w[-1] in ".,;:?" for w in ws) / n,
            ]
        )
        seen |= pairs
    return np.array(out, np.float32)


TEXTS = [
    None,
    "",
    " \n\t",
    "one",
    "one one",
    "a b. c, d\n\nE F G\n" * 30,
    "same line here\n" * 40 + "another",
    "Ünï cödé \x1c \U0001f600 ÉCOLE 42 #$ " * 9,
    "x " * 64 + "y " * 64 + "z",
    "  lead\x0band\x0ctrail  \r\n",
]


@pytest.mark.parametrize("size", [2, 8, 64])
def test_measurements_equal_brute_force(size):
    p = A.MilParams(passage=size)
    for text in TEXTS:
        form, n_terms, terms = A.encode(text, p)
        words = (text or "").encode().split()
        assert np.allclose(form, brute_form(text, size), atol=1e-6), text
        assert n_terms.sum() == len(terms) == 2 * len(words)
        codes = [A.term_code(w) for w in words]
        assert terms.tolist() == [x >> (32 - p.bits) for c in codes for x in (c & 0xFFFFFFFF, c >> 32)]


def test_attention_finds_the_passage_that_decides():
    """One bad passage among many good ones: the mean of the passages barely moves."""
    rng = np.random.default_rng(6)
    words = [f"word{k}" for k in range(200)]
    texts, good = [], []
    for k in range(600):
        parts = [" ".join(rng.choice(words, 8)) for _ in range(20)]
        good.append(float(k % 2))
        if not k % 2:
            parts[rng.integers(20)] = " ".join(["SPAM!!!"] * 8)
        texts.append(" ".join(parts))
    p = A.MilParams(passage=8, epochs=8)
    bags = bags_of(texts, p)
    model = A.AttentionModel.fit(bags[:400], np.array(good[:400], np.float32), p)
    right = [(model.score(b, p.block) > 0.5) == bool(g) for b, g in zip(bags[400:], good[400:], strict=True)]
    assert np.mean(right) > 0.95
    i = 400
    form, size, terms = bags[i]
    logit = model.represent(form, size, terms)[4]
    bad = texts[i].split().index("SPAM!!!") // 8
    assert int(logit.argmax()) == bad


def test_held_out_labels(spark):
    docs, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    model = A.train(docs, labels)
    got = A.score_documents(docs, model).toPandas()
    assert len(got) == docs.count()
    truth = labels.toPandas().merge(got, on="doc_id")
    held = truth[truth["held_out"]]
    assert {zlib.crc32(str(i).encode()) % 4 == 2 for i in held["doc_id"]} == {True}
    good = held["quality"] == 1
    assert ((held["predicted"] == 1) == good).mean() > 0.98
    ranks = held["score"].rank()
    auc = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.99


def test_awkward_rows(spark):
    rows = awkward() + [(900, "long text, " * 500_000, "en", "a"), (901, "\ud800".encode("utf-8", "replace").decode(), None, None)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame(
        [(k, k % 2, 0, "x") for k in range(3, 40)] + [(None, 1, 0, "x"), (41, None, 0, "x"), (6, 0, 1, "x")],
        "doc_id long, quality int, toxic int, text string",
    )
    model = A.train(docs, labels, A.MilParams(epochs=2))
    got = A.score_documents(docs, model).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.7).astype(int) == got["predicted"]).all()
    same = got[got["doc_id"] == 6]["score"]
    assert len(same) == 2 and same.nunique() == 1
    assert not got[got["doc_id"].isna()]["held_out"].any()
    again = A.score_documents(docs, A.train(docs, labels, A.MilParams(epochs=2))).toPandas()
    assert np.allclose(again["score"].sort_values(), got["score"].sort_values())


def test_without_labels_or_with_one_class(spark):
    docs = frame(spark, awkward())
    ddl = "doc_id long, quality int, toxic int"
    none = A.train(docs, spark.createDataFrame([], ddl))
    assert set(A.score_documents(docs, none).toPandas()["score"]) == {0.5}
    one = A.train(docs, spark.createDataFrame([(k, 1, 0) for k in (3, 5, 7)], ddl))
    scores = set(A.score_documents(docs, one).toPandas()["score"].round(6))
    assert len(scores) == 1 and scores.pop() > 0.5
    assert A.score_documents(empty(spark), none).count() == 0


def test_the_cut_of_the_sample(spark):
    known = spark.range(50_000).withColumnRenamed("id", "doc_id")
    n = A._hash_cut(known, 5_000).count()
    assert 4_300 < n < 5_000
    assert A._hash_cut(known, 60_000).count() == 50_000
