"""Licence scans by a positional index of rare words.

Templates are short public notices. Their words have postings (template, position); which
of them are rare is counted over the whole corpus. A file looks up the words of each
template whose mandatory key phrases stand in it, and every occurrence votes for the place
where that template would start (its own position minus the posting's). Votes of several
words for one start mean that the words stand at the right distances; the template's rarest
words and all of its words are counted, and either may show the match. Templates vote apart
from each other, so several notices in a file do not compete. Base labels come from fixed
phrases alone and always stay. Built from DataFrame functions only.

Only files that hold a key phrase can pass the verification, so only they are looked up:
the filter drops nothing. Votes are aggregated by (file, template, start), so a long or a
hot file spreads over its starts.

Rows: a null text has no words, no labels and score 0. Rows are kept apart by a row number
within this operator, so rows with a repeated or null doc_id are scanned one by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed values of the contract: phrase and label.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Anything that is not part of a word; letters are still of either case.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence notice; all ``keys`` must stand in the file."""

    name: str
    label: str
    text: str
    keys: tuple[str, ...]


#: Short public licence notices and the phrases that a match must show.
TEMPLATES = (
    Template("mit-line", "mit", "released under the mit license", ("mit license",)),
    Template(
        "mit-grant",
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    Template("apache-line", "apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template(
        "apache-header",
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
        "with the license you may obtain a copy of the license at",
        ("apache license", "in compliance with the license"),
    ),
    Template(
        "gpl-line",
        "gpl",
        "this work is licensed under the gnu general public license version 3",
        ("gnu general public license",),
    ),
    Template(
        "gpl-header",
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        ("gnu general public license", "free software foundation"),
    ),
    Template(
        "bsd-terms",
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    Template("cc-by-nc", "cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template(
        "cc-line", "cc-by", "this work is licensed under a creative commons attribution 4 0", ("creative commons attribution",)
    ),
)


#: So many of a template's words in a file are its rarest ones.
LOOKED_UP = 8
#: A match needs this many words in place, and this share of those that could be, of the rarest or of all.
MIN_ALIGNED, MIN_SHARE = 3, 0.6


def word_line(text: Column) -> Column:
    """The words in lower case, with one space before and after each.

    ``lower`` changes letters beyond A-Z too. That never makes or hides one of the phrases:
    all of them are ASCII, and of the other letters only the Kelvin sign becomes an ASCII
    letter alone, a k, which no base phrase has.
    """
    return F.lower(F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), _GAP, " "))


def _has(line: Column, phrase: str) -> Column:
    return line.contains(f" {phrase} ")


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _all_keys(line: Column, template: Template) -> Column:
    out = F.lit(True)
    for k in template.keys:
        out = out & _has(line, k)
    return out


def scanned_lines(docs: DataFrame, templates: Sequence[Template], id_col: str, text_col: str) -> DataFrame:
    """Per row: a row number, doc_id, n_words, its distinct licence words, and all words if a key phrase is there."""
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    line = F.col("line")
    lined = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), word_line(F.col(text_col)).alias("line")
    )
    keyed = _any([_has(line, p) for p, _ in BASE_PHRASES] + [_all_keys(line, t) for t in templates])
    words = F.split(F.trim(line), " ")
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return written(
        lined.select(
            "row",
            "doc_id",
            (spaces - 1).cast("long").alias("n_words"),
            F.array_intersect(words, F.array(*map(F.lit, vocabulary))).alias("found"),
            F.when(keyed, words).alias("words"),
        ),
        "licence-lines",
    )


def inverse_frequencies(lines: DataFrame) -> dict[str, float]:
    """IDF of every template word over the corpus; at most as many entries as the templates have words."""
    n = lines.count()
    counted = lines.select(F.explode("found").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    scored = counted.select("word", F.log((F.lit(n) + 1) / (F.col("df") + 1)).alias("idf"))
    return {r["word"]: r["idf"] for r in scored.collect()}


def _places(phrase: str) -> Column:
    """Starts of a phrase in the column ``words``."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        ok = F.lit(True)
        for k, w in enumerate(parts):
            ok = ok & (F.get(F.col("words"), i + k) == w)
        return F.coalesce(ok, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size("words") - 1), here)


def _labelled(phrase: str, label: str) -> Column:
    return F.transform(_places(phrase), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def template_matches(
    lines: DataFrame, idf: dict[str, float], templates: Sequence[Template], looked_up: int = LOOKED_UP
) -> DataFrame:
    """(row, label, score): templates whose words stand at one start in a file that has their key phrases."""
    spark = lines.sparkSession
    postings = spark.createDataFrame(
        [(t.name, w, k) for t in templates for k, w in enumerate(t.text.split())],
        "template string, word string, at int",
    )
    line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))

    def candidate(t: Template) -> Column:
        by_rank = sorted(set(t.text.split()), key=lambda w: (-idf.get(w, 0.0), w))
        rarest = F.slice(F.array_intersect(F.array(*map(F.lit, by_rank)), "found"), 1, looked_up)
        return F.when(
            _all_keys(line, t),
            F.struct(
                F.lit(t.name).alias("template"),
                F.lit(t.label).alias("label"),
                F.array(*map(F.lit, t.text.split())).alias("text"),
                rarest.alias("rarest"),
            ),
        )

    candidates = (
        lines.where("words IS NOT NULL")
        .select("row", "words", "found", F.filter(F.array(*map(candidate, templates)), lambda t: t.isNotNull()).alias("of"))
        .where(F.size("of") > 0)
    )
    looked = F.array_distinct(F.flatten(F.transform("of", lambda t: t["text"])))
    occurrences = candidates.select("row", "of", looked.alias("looked"), F.posexplode("words").alias("pos", "word")).where(
        F.array_contains("looked", F.col("word"))
    )
    of = F.filter("of", lambda t: t["template"] == F.col("template"))
    votes = (
        occurrences.join(F.broadcast(postings), "word")  # as large as the templates
        .withColumn("own", F.get(of, 0))
        .where("own IS NOT NULL")
        .groupBy("row", "template", (F.col("pos") - F.col("at")).alias("start"))
        .agg(
            F.count(F.lit(1)).alias("aligned"),
            F.count_if(F.array_contains("own.rarest", F.col("word"))).alias("aligned_rare"),
        )
        .groupBy("row", "template")
        .agg(F.max("aligned").alias("aligned"), F.max("aligned_rare").alias("aligned_rare"))
    )
    checked = candidates.select("row", "found", F.explode("of").alias("t")).select(
        "row",
        "t.template",
        "t.label",
        F.size(F.filter("t.text", lambda w: F.array_contains("found", w))).alias("could"),
        F.size(F.filter("t.text", lambda w: F.array_contains("t.rarest", w))).alias("could_rare"),
    )

    def share(aligned: str, could: str) -> Column:
        in_place = F.col(aligned) / F.greatest(F.col(could), F.lit(MIN_ALIGNED))
        return F.when(F.col(aligned) >= MIN_ALIGNED, F.least(in_place, F.lit(1.0))).otherwise(0.0)

    best = F.greatest(share("aligned", "could"), share("aligned_rare", "could_rare"))
    return (
        checked.join(votes, ["row", "template"])
        .select("row", "label", best.alias("score"))
        .where(F.col("score") >= MIN_SHARE)
        .groupBy("row", "label")
        .agg(F.max("score").alias("score"))
    )


def scan_licenses(
    docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, base places, labels and score.

    ``score`` is the best share of the words of a matching template (its rarest ones or all
    of them) that stand in place; base phrases without such a match score 0.5.
    """
    lines = scanned_lines(docs, templates, id_col, text_col)
    matches = template_matches(lines, inverse_frequencies(lines), templates)
    found = matches.groupBy("row").agg(F.collect_set("label").alias("own"), F.max("score").alias("score"))
    base = F.concat(*[_labelled(p, label) for p, label in BASE_PHRASES])
    no_places = F.array().cast("array<struct<at: int, label: string>>")
    based = lines.select("row", "doc_id", "n_words", F.when(F.col("words").isNotNull(), base).otherwise(no_places).alias("base"))
    starts = F.transform("base", lambda x: x["at"].cast("long"))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    own = F.coalesce(F.col("own"), F.array().cast("array<string>"))
    n_base = F.size("base").cast("long")
    return based.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, own)), ",").alias("labels"),
        F.greatest(F.coalesce("score", F.lit(0.0)), F.when(n_base > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )
