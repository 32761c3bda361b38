"""Quality rules as a bitmask ledger.

One pass measures every text and evaluates every rule once; the ledger keeps the
measurements and one failure bit per rule. Policies are versioned masks over those bits,
so a policy change, or the question what a rule costs, reads the narrow ledger and never a
text again: a row passes when ``failures & mask = 0``, and ablations come from the counts
per distinct failure mask (at most 2^rules rows).

Nulls and empty texts have no words (every measurement 0) and fail ``few_words``. Repeated
rows are judged row by row. Only the id and text columns are read, so extra columns of any
name do no harm; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_words

#: Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")
_SCHEMA = ", ".join(f"{m} long" for m in MEASURES)
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """A named test: given a function from measurement names to columns, true where the row fails."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules."""

    name: str
    version: int
    rules: tuple[str, ...]


def rules(
    symbol_percent: int = 5, upper_percent: int = 40, dup_line_percent: int = 50, word_length: tuple[int, int] = (2, 20)
) -> list[Rule]:
    """The rules in bit order. New rules go to the end, so that stored bits keep their meaning."""
    low, high = word_length
    return [
        Rule("few_words", lambda m: m("n_words") < MIN_WORDS),
        Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > MAX_REPEAT_PERCENT * m("n_words")),
        Rule("symbol_heavy", lambda m: 100 * m("n_symbols") > symbol_percent * m("word_chars")),
        Rule("shouting", lambda m: 100 * m("n_upper") > upper_percent * m("word_chars")),
        Rule("duplicate_lines", lambda m: 100 * m("n_dup_lines") > dup_line_percent * m("n_lines")),
        Rule(
            "word_length",
            lambda m: (m("word_chars") < low * m("n_words")) | (m("word_chars") > high * m("n_words")),
        ),
    ]


BASE = Policy("base", 1, ("few_words", "repeated_words"))
PROSE = Policy(
    "prose", 1, ("few_words", "repeated_words", "symbol_heavy", "shouting", "duplicate_lines", "word_length")
)


def repeated_words(words: Sequence[bytes]) -> int:
    """Words inside a 3-word window that occurs at least twice in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    hit = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def duplicate_lines(lines: Iterable[str]) -> tuple[int, int]:
    """Lines that hold a word, and those of them equal to an earlier line."""
    worded = [x for x in lines if x.strip(_SPACE)]
    return len(worded), len(worded) - len(set(worded))


def measure_text(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = text_words(text)
    n_lines, n_dup = duplicate_lines(text.split("\n"))
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACE)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        n_lines,
        n_dup,
        repeated_words(words),
        len(raw) - len(raw.translate(None, _UPPER)),
    )


def measure(text: Column) -> Column:
    """The measurements of a text column as a struct."""

    @F.pandas_udf(_SCHEMA)
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure_text(t) for t in texts], columns=list(MEASURES), dtype="int64")

    return of(text)


def failure_bits(ledger_rules: Sequence[Rule], of: Callable[[str], Column] = F.col) -> Column:
    bits = F.lit(0).cast("long")
    for k, r in enumerate(ledger_rules):
        bits = bits.bitwiseOR(F.when(r.fails(of), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def mask_of(policy: Policy, ledger_rules: Sequence[Rule] | None = None) -> int:
    names = [r.name for r in (ledger_rules or rules())]
    return sum(1 << names.index(n) for n in policy.rules)


def passes(policy: Policy, ledger_rules: Sequence[Rule] | None = None, failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(mask_of(policy, ledger_rules)).cast("long")) == 0


def ledger(
    docs: DataFrame, ledger_rules: Sequence[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, the measurements and the failure bits."""
    measured = docs.select(F.col(id_col).alias("doc_id"), measure(F.col(text_col)).alias("m")).select("doc_id", "m.*")
    return measured.withColumn("failures", failure_bits(ledger_rules or rules()))


def apply_policy(
    ledger_df: DataFrame, policy: Policy, column: str = "kept", ledger_rules: Sequence[Rule] | None = None
) -> DataFrame:
    return ledger_df.withColumn(column, passes(policy, ledger_rules))


def mask_counts(ledger_df: DataFrame) -> DataFrame:
    """Rows and words per distinct failure mask: all that ablations need."""
    return ledger_df.groupBy("failures").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_words").alias("words"))


def ablations(
    ledger_df: DataFrame, policies: Sequence[Policy] = (BASE, PROSE), ledger_rules: Sequence[Rule] | None = None
) -> DataFrame:
    """Per policy and rule: rows and words that fail it, that only it rejects, and that the policy keeps.

    ``rejected_only`` is what would come back if the rule were dropped from the policy.
    ``shared_bits`` has the other bits of the policy that ever fail together with the rule.
    """
    listed = list(ledger_rules or rules())
    bit = {r.name: 1 << k for k, r in enumerate(listed)}
    each = F.array(
        *[
            F.struct(
                F.lit(p.name).alias("policy"),
                F.lit(p.version).alias("version"),
                F.lit(n).alias("rule"),
                F.lit(bit[n]).cast("long").alias("bit"),
                F.lit(mask_of(p, listed)).cast("long").alias("mask"),
            )
            for p in policies
            for n in p.rules
        ]
    )
    failed = F.col("failures").bitwiseAND(F.col("mask"))
    hit = failed.bitwiseAND(F.col("bit")) != 0
    only = failed == F.col("bit")
    return (
        mask_counts(ledger_df)
        .withColumn("p", F.explode(each))
        .select("failures", "rows", "words", "p.*")
        .groupBy("policy", "version", "rule")
        .agg(
            F.sum(F.when(hit, F.col("rows")).otherwise(0)).alias("failed"),
            F.sum(F.when(only, F.col("rows")).otherwise(0)).alias("rejected_only"),
            F.sum(F.when(only, F.col("words")).otherwise(0)).alias("words_rejected_only"),
            F.sum(F.when(failed == 0, F.col("rows")).otherwise(0)).alias("kept"),
            F.coalesce(F.bit_or(F.when(hit, failed.bitwiseXOR(F.col("bit")))), F.lit(0).cast("long")).alias(
                "shared_bits"
            ),
        )
    )


def keep_good(docs: DataFrame, policy: Policy = PROSE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the policy, all columns unchanged (they travel as one struct)."""
    bits = failure_bits(rules(), lambda k: F.col(f"m.{k}"))
    judged = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), measure(docs[text_col]).alias("m"))
    return judged.where(bits.bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0).select("row.*")
