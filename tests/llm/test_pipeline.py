"""The pipeline against a brute-force reading of its stages."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as P
from tests.llm.data import awkward, empty, frame
from tests.llm.test_mixing import brute_targets
from tests.llm.test_quality import brute as measured
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_substring import brute as cut
from tillroll.llm.queries import TOKENIZER

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage returns, written and read in between."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (_, f) in enumerate(P.STAGES):
        f(spark, docs, SF).write.parquet(f"file://{folder}/{k}")
        docs = spark.read.parquet(f"file://{folder}/{k}")
        out.append(docs.collect())
    return out


def good(text):
    m = measured(text)
    return not (
        m["n_words"] < 50
        or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        or 100 * m["n_symbols"] > 5 * m["word_chars"]
        or 100 * m["n_upper"] > 40 * m["word_chars"]
        or 100 * m["n_dup_lines"] > 50 * m["n_lines"]
        or not 2 * m["n_words"] <= m["word_chars"] <= 20 * m["n_words"]
    )


def test_quality_stage(stages):
    assert sorted(r.doc_id for r in stages[1]) == sorted(r.doc_id for r in stages[0] if good(r.text))
    assert stages[1]


def test_near_dedup_stage(stages):
    nodes = [(r.doc_id, brute_fingerprint(r.text)) for r in stages[1]]
    groups = brute_components(nodes)
    assert sorted(r.doc_id for r in stages[2]) == sorted(d for d, _ in nodes if groups[d] == d)


def test_substring_stage(stages):
    assert len(stages[3]) == len(stages[2])
    got = sorted((str(r.doc_id), " ".join(r.text.encode().decode().split(" "))) for r in stages[3])
    expected = {d: kept for d, _, _, kept in cut([(r.doc_id, r.text) for r in stages[2]], 50)}
    assert [(d, b" ".join(t.encode().split()).decode()) for d, t in got] == sorted(expected.items())


def test_mixing_stage(stages):
    size = {r.doc_id: len(r.text.encode().split()) for r in stages[3]}
    source = {r.doc_id: r.source for r in stages[3]}
    total, taken = defaultdict(int), defaultdict(int)
    for d, n in size.items():
        total[source[d]] += n
    copies = Counter(r.doc_id for r in stages[4])
    for d, n in copies.items():
        taken[source[d]] += n * size[d]
    assert max(copies.values()) <= 3
    target = brute_targets(total)
    assert all(abs(taken[s] - t) <= max(size.values()) for s, t in target.items())
    texts = {r.doc_id: r.text for r in stages[3]}
    assert all(r.text == texts[r.doc_id] for r in stages[4])


def test_encoding_stage(stages):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    expected = Counter()
    for r in stages[4]:
        ids = library.encode(r.text, add_special_tokens=False).ids
        expected[r.doc_id, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in stages[5]) == expected


def test_run(spark, stages):
    assert sorted(map(str, P.run(spark, SF).collect())) == sorted(map(str, stages[5]))


def test_awkward_rows_and_empty_table(spark):
    for docs in (frame(spark, awkward()), empty(spark)):
        for _, f in P.STAGES:
            out = f(spark, docs, SF)
            out.count()
            if f is not P.bpe_encoding:
                assert out.columns == docs.columns
