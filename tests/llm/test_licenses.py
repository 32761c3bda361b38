"""Licence scan: base places against brute force, positions of templates, verification."""

import re

from tests.llm.data import SCHEMA, awkward, empty, frame, pad
from tillroll.llm import license_scan as L

TEXTS = [
    None,
    "",
    "The MIT License, the mit-license and mit\nLICENSE; permit license mitlicense MIT licenses",
    "Apache License v2 and the GNU General\tPublic  License general public license",
    "Licensed under CC BY-NC 4.0.",
    "something under nc cc by 4 0 licensed",
    "cc by nc alone",
    "mıt license MİT license KMIT license émit license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files, to deal in the Software without restriction, including without limitation the rights to use",
    "without restriction permission is hereby granted free of charge " + "filler " * 200,
    "mit license " * 400,
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
]


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    spots = []
    for phrase, label in L.BASE_PHRASES:
        p = phrase.split()
        spots += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in spots]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in spots}))


def rows():
    return [(k, t, "en", "a") for k, t in enumerate(TEXTS)] + [(3, "MIT license twice", "en", "a")] * 2


def test_base(spark):
    docs = rows() + [(100 + k, t, s, u) for k, (_, t, s, u) in enumerate(awkward())]
    found = L.scan_licenses(spark.createDataFrame(pad(docs), SCHEMA)).collect()
    expected = sorted(map(str, ((d, *brute(t)) for d, t, *_ in docs)))
    got = sorted(
        str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in found
    )
    assert got == expected
    for r in found:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels)


def test_templates(spark):
    found = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame(pad(rows()), SCHEMA)).collect() if r.doc_id != 3}
    assert found[4].labels == "cc-by-nc"
    assert found[5].labels == ""  # the words in another order
    assert found[8].labels == "mit" and found[8].base_labels == ""
    assert found[11].labels == "bsd"


def test_two_notices_in_a_file(spark):
    """Each notice is found as if it stood alone, also in a long file with licence words all over."""
    text = {t.name: t.text for t in L.TEMPLATES}
    label = {t.name: t.label for t in L.TEMPLATES}
    vocabulary = sorted({w for t in L.TEMPLATES for w in t.text.split()})
    scattered = " filler ".join(vocabulary * 3)
    pairs = [(a, b) for a in text for b in text if label[a] != label[b]]
    files = [f"{text[a]} in other words {text[b]}" for a, b in pairs]
    files += [f"{scattered} {f} {scattered}" for f in files]
    # words are as frequent as in a corpus where the notices' own words differ in rarity
    rest = [(" ".join(vocabulary[k::7]) + " ") * 2 for k in range(40)]
    docs = [(k, f, "en", "a") for k, f in enumerate(files + rest)]
    found = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame(pad(docs), SCHEMA)).collect()}
    for k in range(len(files)):
        a, b = pairs[k % len(pairs)]
        assert {label[a], label[b]} <= set(found[k].labels.split(",")), files[k]
        assert found[k].score == 1.0


def test_no_python_in_the_plan(spark):
    plan = L.scan_licenses(frame(spark, awkward()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert L.scan_licenses(empty(spark)).count() == 0
