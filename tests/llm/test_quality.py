"""Quality ledger: measurements against brute force, policies and ablations on stored bits."""

from collections import Counter

import re

from tests.llm.data import awkward, empty, frame
from tillroll.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    spots = {}
    for i in range(len(words) - 2):
        spots.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {i + k for at in spots.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "n_upper": len(re.findall(r"[A-Z]", text)),
    }


TEXTS = [
    None,
    "",
    "\n\n \n",
    "a b c a b c a b",
    "# x\n# x\n\n# x \n|<>|",
    "\x1cA B \x0bC D",
    "one two three " * 30,
    "CAPS ONLY " * 40,
]


def test_measurements():
    for t in TEXTS + [t for _, t, *_ in awkward()]:
        assert dict(zip(quality.MEASURES, quality.measure_text(t), strict=True)) == brute(t)


def test_ledger_of_awkward_rows(spark):
    rows = awkward()
    found = quality.apply_policy(quality.ledger(frame(spark, rows)), quality.PROSE).collect()
    assert len(found) == len(rows)
    names = [r.name for r in quality.rules()]
    for r in found:
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        bits = {n for k, n in enumerate(names) if r.failures >> k & 1}
        assert base == bool(bits & set(quality.BASE.rules))
        assert r.kept == (not bits)


def test_policies_read_the_same_bits(spark):
    ledger = quality.ledger(frame(spark, awkward()))
    only_size = quality.Policy("size", 2, ("few_words",))
    both = quality.apply_policy(quality.apply_policy(ledger, only_size, "size_ok"), quality.PROSE)
    assert both.where("kept AND NOT size_ok").count() == 0
    assert quality.mask_of(only_size) == 1


def test_ablations(spark):
    ledger = quality.ledger(frame(spark, awkward()))
    masks = [r.failures for r in ledger.collect()]
    bit = {r.name: 1 << k for k, r in enumerate(quality.rules())}
    for r in quality.ablations(ledger).collect():
        policy = {p.name: p for p in (quality.BASE, quality.PROSE)}[r.policy]
        mask = quality.mask_of(policy)
        assert r.failed == sum(m & bit[r.rule] != 0 for m in masks)
        assert r.rejected_only == sum(m & mask == bit[r.rule] for m in masks)
        assert r.kept == sum(m & mask == 0 for m in masks)


def test_stage(spark):
    rows = awkward()
    docs = frame(spark, rows)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    verdict = quality.apply_policy(quality.ledger(docs), quality.PROSE).where("kept").collect()
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in verdict)


def test_empty_table(spark):
    assert quality.ledger(empty(spark)).count() == 0
    assert quality.ablations(quality.ledger(empty(spark))).count() == 0
    assert quality.keep_good(empty(spark)).count() == 0
