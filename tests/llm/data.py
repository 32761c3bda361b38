"""Small documents with the awkward cases that every operator must take."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # extra columns under names that operators use inside
    "size long, h long, fp long, ord long, sub long, words string, row long, block long, n_words long, kept string, "
    "p_whole long, p_threshold long, p_source string, p_salt int, __mix_hash long, __copy int, __quality int, m int, "
    "of string, copy int, failures long, bag int, part string, mask int, content string, good int, labelled long, guest int"
)


def pad(rows):
    """(doc_id, text, lang, source) rows with n_chars and the extra columns."""
    extra = (1, 2, 3, 4, 5, "x", 6, 7, 8, "y", 0, 9, "z", 1, 2, 3, 4, 5, "of", 6, 7, 8, "p", 9, "c", 1, 2, 3)
    return [(*r, len(r[1] or ""), *extra) for r in rows]


def awkward(seed: int = 5, n: int = 40, vocabulary: int = 400):
    """Nulls in any column, empty and long texts, repeated rows and ids, copies, shared passages."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    passage = " ".join(r.choice(words) for _ in range(70))
    rows = [
        (0, None, "en", "a"),
        (1, "", "en", "a"),
        (2, " \n\t ", None, "a"),
        (None, "no id " * 30, "en", None),
        (None, "no id " * 30, "en", None),
        (None, None, None, None),
        (3, passage, "en", "b"),
        (4, "x " + passage + " y", "en", "b"),
        (5, " ".join(r.choice(words) for _ in range(6000)), "de", "c"),
        (6, "same " * 300, "de", "c"),
        (6, "same " * 300, "de", "c"),
        (7, "same " * 120, "de", None),
        (8, "Short\x0btext\x1cin one", "fr", "\U0001f600"),
    ]
    for k in range(9, 9 + n):
        body = " ".join(r.choice(words) for _ in range(r.choice((3, 49, 50, 51, 80, 200))))
        if k % 5 == 0:
            body += "\n" + passage
        if k % 7 == 0:
            body = rows[-1][1]
        rows.append((k, body, r.choice(("en", "fr")), r.choice(("a", "b", "d"))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(pad(rows), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
