"""Mixing sources to target weights by hash-threshold histograms, without a sort.

Every document has a fixed hash. A source whose target is r times its size is taken
floor(r) times whole, and the rest of its budget goes to the documents whose hash lies
below the source's threshold. Thresholds come from histograms of words by source and hash
bucket: the bucket in which the running sum crosses the budget is the only one that is
refined, by the next bits of the hash, until it holds a single hash. Thresholds are nested:
a larger budget takes a superset. Built from DataFrame functions only.

Hot sources: the histogram aggregates before it shuffles, and the final join is salted by
the hash, so a source with any share of the rows spreads over ``SALTS`` keys.

Rows: a null text has size 0. A null source is a source of its own, the last in the order.
The hash covers doc_id and text, so rows that repeat both share one decision; a repeated
or null doc_id with another text does not. Documents of size 0 take no words and have no
copies. Columns of ``docs`` of any name are kept as they are: the mix carries each row as one
struct beside its own columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from .common import WORD, written

#: Fixed values of the contract.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3.0
#: 60 hash bits in five rounds of 12.
ROUND_BITS, ROUNDS = 12, 5
SALTS = 32


def text_size(text: Column) -> Column:
    """Number of words in the text (0 if null)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of MD5 over doc_id and text (MD5, so that other engines can recompute it)."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(" "), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: float = MAX_REPEATS
) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Weights repeat along the sources by code point, null last. All words are shared out by
    weight; a target stops at ``max_repeats`` times its source, and what is over is shared
    again by weight among the others. The level (words per weight) rises in a few rounds of
    one aggregate each; sources are never gathered.
    """
    ranked = global_rank(
        sizes.withColumn("none", F.col("source").isNull()), ["none", "source"], rank_col="position"
    ).select(
        "source",
        "source_size",
        F.element_at(F.array(*map(F.lit, weights)), ((F.col("position") - 1) % len(weights) + 1).cast("int")).alias("w"),
    )
    ranked = written(ranked, "sources")
    cap = F.col("source_size") * float(max_repeats)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, n_capped = 0.0, -1
    while True:  # ends: the capped set only grows
        capped = cap <= F.lit(level) * F.col("w")
        n, taken, weight = ranked.agg(
            F.count(F.when(capped, 1)), F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("w")))
        ).first()
        if n == n_capped or not weight:
            break
        n_capped, level = n, (total - (taken or 0.0)) / weight
    return ranked.select("source", "source_size", F.least(cap, F.lit(level) * F.col("w")).alias("target"))


def _salted(plan: DataFrame) -> DataFrame:
    """Each source's row once per salt, under names that do not clash with the other side."""
    named = plan.select(*[F.col(c).alias(f"p_{c}") for c in plan.columns])
    return named.withColumn("p_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def join_sources(rows: DataFrame, plan: DataFrame, source: Column, h: Column, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``plan`` (prefix ``p_``) of their source.

    The salt comes from the hash, so the rows of a hot source have ``SALTS`` join keys.
    Spark broadcasts the plan if it is below its own size threshold.
    """
    p = _salted(plan)
    return rows.join(p, source.eqNullSafe(p["p_source"]) & (F.pmod(h, F.lit(SALTS)) == p["p_salt"]), how)


def hash_thresholds(slim: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): the documents with a hash below it come nearest to the source's budget.

    ``slim`` has (source, size, h); ``budgets`` has (source, budget), one row per source.
    Each round has one open bucket per source: ``prefix`` are its leading hash bits and
    ``filled`` the words below it. A round counts only the documents in open buckets, and
    rounds end when every open bucket holds one hash.
    """
    state = budgets.select(
        "source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("filled")
    )
    for k in range(ROUNDS):
        shift = ROUND_BITS * (ROUNDS - k)  # the open buckets have this many free bits
        inside = join_sources(slim, state, F.col("source"), F.col("h")).where(
            F.shiftrightunsigned("h", shift) == F.col("p_prefix")
        )
        hist = inside.groupBy(
            F.col("p_source").alias("source"),
            F.col("p_budget").alias("budget"),
            F.col("p_filled").alias("filled"),
            F.shiftrightunsigned("h", shift - ROUND_BITS).alias("prefix"),
        ).agg(F.sum("size").alias("words"), F.min("h").alias("first_h"), F.max("h").alias("last_h"))
        upto = F.col("filled") + F.sum("words").over(Window.partitionBy("source").orderBy("prefix"))
        below = upto - F.col("words")
        crossed = hist.withColumn("below", below).where(
            (F.col("below") <= F.col("budget")) & (F.col("below") + F.col("words") > F.col("budget"))
        )
        state = written(
            crossed.select("source", "budget", "prefix", F.col("below").alias("filled"), "words", "first_h", "last_h"),
            "thresholds",
        )
        if not state.where("first_h < last_h").limit(1).count():
            break
    # the boundary hash itself is taken if that comes nearer to the budget
    nearer = (F.col("filled") + F.col("words") - F.col("budget")) < (F.col("budget") - F.col("filled"))
    return state.select("source", F.when(nearer, F.col("last_h") + 1).otherwise(F.col("first_h")).alias("threshold"))


def mix_plan(
    slim: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: float = MAX_REPEATS
) -> DataFrame:
    """(source, source_size, target, whole, threshold), one row per source."""
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, weights, max_repeats), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    shares = targets.withColumn("whole", whole.cast("long"))
    budgets = shares.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    found = hash_thresholds(slim, budgets).select(F.col("source").alias("s"), "threshold")
    plan = shares.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return written(plan.withColumn("threshold", F.coalesce("threshold", F.lit(0).cast("long"))), "mix-plan")


def _copies(size: Column, h: Column) -> Column:
    return F.when(size > 0, F.col("p_whole") + F.when(h < F.col("p_threshold"), 1).otherwise(0)).otherwise(0)


def mixture(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_repeats: float = MAX_REPEATS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken."""
    text, doc_id = F.col(text_col), F.col(id_col)
    slim = written(
        docs.select(
            doc_id.alias("doc_id"),
            F.col(source_col).alias("source"),
            text_size(text).alias("size"),
            text_hash(doc_id, text).alias("h"),
        ),
        "slim",
    )
    plan = mix_plan(slim, weights, max_repeats)
    return join_sources(slim, plan, F.col("source"), F.col("h")).select(
        "doc_id",
        "source",
        "size",
        F.col("p_source_size").alias("source_size"),
        F.col("p_target").alias("target"),
        _copies(F.col("size"), F.col("h")).alias("copies"),
        (F.col("size") * _copies(F.col("size"), F.col("h"))).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: float = MAX_REPEATS
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, columns unchanged."""
    text = F.col("text")
    own = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.col("source").alias("of"),
        text_size(text).alias("size"),
        text_hash(F.col("doc_id"), text).alias("h"),
    )
    plan = mix_plan(written(own.select(F.col("of").alias("source"), "size", "h"), "slim"), weights, max_repeats)
    joined = join_sources(own, plan, F.col("of"), F.col("h"))
    copies = _copies(F.col("size"), F.col("h")).cast("int")
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).select("row.*")
