"""BPE against the tokenizers library and an exact round trip."""

import hashlib
import random

import numpy as np
import pytest

from tests.llm.data import awkward, empty, frame
from tillroll.llm import bpe
from tillroll.llm.queries import TOKENIZER

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def model():
    return bpe.BpeModel.read(TOKENIZER)


def ids_of(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_random_texts(library, model):
    r = random.Random(1)
    letters = "aaabbbccc'sdtrmvlleABİΣσéÑ́123٣½ \t\n\x0b\x1c\x85 　!?#%-_\U0001f600中​"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(3000)]
    texts += ["a" * 3000, "ab" * 2000, "", "it's we'll they'RE 'S", "<|endoftext|><|startoftext|> x <|ENDOFTEXT|>y"]
    found = bpe.Encoder(model).encode(texts)
    tokens = np.array(model.tokens, dtype=object)
    for t, ids in zip(texts, found, strict=True):
        assert ids == ids_of(library, t), t
        assert bpe.decode_ids(tokens, ids) == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_cache_and_batches_do_not_matter(model):
    texts = [t or "" for _, t, *_ in awkward()]
    whole = bpe.Encoder(model).encode(texts)
    assert bpe.Encoder(model, max_chunks=10).encode(texts, batch_chars=50) == whole


def test_merge_order_of_a_small_vocabulary():
    """Overlaps merge from the left; a pair that a merge opens at a lower rank goes first."""
    shown = bpe.byte_symbols()
    vocab = {c: k for k, c in enumerate(shown)} | {c + "</w>": 256 + k for k, c in enumerate(shown)}
    ids = iter(range(512, 600))
    merges = [("aa", "a"), ("a", "a"), ("a", "b")]  # the first rule needs the second's symbol
    for x, y in merges:
        vocab.setdefault(x + y, next(ids))
    vocab.setdefault("aa", next(ids))
    import json
    import tempfile

    spec = {"added_tokens": [], "model": {"vocab": vocab, "merges": [list(m) for m in merges]}}
    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:
        f.write(json.dumps(spec))
        f.flush()
        m = bpe.BpeModel.read(f.name)
    assert not m.steady.all()
    ids, n = m.merge_words([b"aaaaac", b"aac", b"c"])
    assert [m.tokens[k] for k in ids] == ["aaa", "aa", "c</w>", "aa", "c</w>", "c</w>"]
    assert n.tolist() == [3, 2, 1]


def test_awkward_rows(spark, library):
    rows = awkward()
    found = bpe.decode(bpe.encode(frame(spark, rows), TOKENIZER), TOKENIZER).collect()
    expected = sorted((str(d), ids_of(library, t or "")) for d, t, *_ in rows)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in found) == expected
    for r in found:
        assert r.n_tokens == len(r.ids) // 4
        assert r.decoded == library.decode(np.frombuffer(bytes(r.ids), "<u4").tolist(), skip_special_tokens=False)


def test_ids_array_and_digest(spark, library):
    df = spark.createDataFrame([(1, "Hello <|endoftext|> wörld"), (2, None)], "doc_id long, text string")
    from pyspark.sql import functions as F

    out = bpe.encode(df, TOKENIZER).select(bpe.ids_array(F.col("ids")).alias("a"), F.sha2("ids", 256).alias("s")).collect()
    expected = library.encode("Hello <|endoftext|> wörld", add_special_tokens=False).ids
    assert out[0].a == expected and out[1].a == []
    assert out[0].s == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()


def test_empty_table(spark):
    assert bpe.decode(bpe.encode(empty(spark), TOKENIZER), TOKENIZER).count() == 0


def test_every_code_point_equals_the_library(model, library):
    """Classes, lower case and NFC of the library's Unicode version, between letters and beside a sign."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for shape in ("a{}b", "{}!"):
        for k in range(0, len(points), 50_000):
            texts = [shape.format(chr(c)) for c in points[k : k + 50_000]]
            expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
            got = [np.frombuffer(x, "<u4").tolist() for x in bpe.Encoder(model).encode(texts)]
            assert got == expected


def test_mixes_of_any_code_points(model, library):
    r = random.Random(12)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    newer = [chr(c) for a, b in (*bpe._NO_LETTERS, *bpe._NO_NUMBERS) for c in range(a, b + 1)] + list(map(chr, bpe._LOWER))
    pools = (points, newer, "ab '1sS ")
    texts = ["".join(r.choice(r.choice(pools)) for _ in range(r.randrange(1, 30))) for _ in range(5000)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Encoder(model).encode(texts)] == expected


def _long_words(r):
    parts = ["the", "ing", "lo", "ha", "an", "in", "er"]
    yield from ("".join(r.choice("abcdehinorst") for _ in range(r.randrange(1001, 6000))) for _ in range(20))
    yield from ("".join(r.choice(parts) for _ in range(r.randrange(400, 2000))) for _ in range(20))
    yield from ("".join(r.choice("abn") for _ in range(2000)) + " x " + "ha" * 2000 for _ in range(5))
    yield from (c * r.randrange(1000, 4000) + "z" for c in "aehlo.")


@pytest.mark.parametrize("long_word", [3, 1000, 10**9])
def test_long_words_equal_the_library(monkeypatch, model, library, long_word):
    """Words merged by themselves and words merged in the batch give the library's ids."""
    monkeypatch.setattr(bpe, "LONG_WORD", long_word)
    r = random.Random(13)
    texts = [t[: 400 if long_word == 10**9 else None] for t in _long_words(r)]
    texts += ["".join(r.choice("abcdehinorst ") for _ in range(r.randrange(1, 60))) for _ in range(300)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Encoder(model).encode(texts)] == expected


def test_a_word_of_32000_letters_is_quick(model):
    import time

    word = "".join(random.Random(14).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(32_000))
    start = time.perf_counter()
    bpe.Encoder(model).encode([word])
    assert time.perf_counter() - start < 2  # 0.12 s on an idle core


def test_registered_query_equals_the_library(spark, library):
    from tillroll.llm.common import table
    from tillroll.llm.queries import op9_bpe

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    found = {r["doc_id"]: r for r in op9_bpe(spark, sf).collect()}
    assert found.keys() == texts.keys()
    for d, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert found[d]["n_tokens"] == len(ids)
        assert found[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[d]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
