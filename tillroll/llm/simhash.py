"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are cut into blocks of bits. Two that differ in at most ``max_bits`` bits
agree on all but ``max_bits`` of the blocks, so they share every block of at least one
choice of ``n_blocks - max_bits`` blocks. Distinct fingerprints are bucketed by each such
choice, Hamming distances are verified inside the buckets, and the links are joined into
components.

Equal fingerprints are one node from the start, so exact copies never meet in a bucket. A
bucket is walked as a forest: it yields at most one edge for each of its members, not
all pairs. Buckets above ``max_bucket`` fingerprints are not gathered: their members are
spread over every value within half the distance, and two fingerprints are in reach
exactly if they meet at such a value (a group of bounded size). No bucket is dropped.

Rows: a null or empty text has fingerprint zero and links like any other. Rows that share
a doc_id are one document. Rows without a doc_id keep their fingerprint, take part in no
component and have a null ``component_id``. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST, text_words, written
from .components import connected_components

#: Fixed values of the contract.
SHINGLE = 4
SEED = 42
MAX_BITS = 4

_UPPER_TO_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Members of one bucket that one task compares with each other: at most this many.
MAX_BUCKET = 16_384


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; of the whole sequence if it is shorter."""
    words = text_words(text.translate(_UPPER_TO_LOWER) if text else None)
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    last = start[shingle - 1 :] + size[shingle - 1 :]
    digest = xxhash.xxh64_intdigest
    spans = zip(start.tolist(), last.tolist(), strict=False)
    return np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(last))


def fingerprint(text: str | None, shingle: int = SHINGLE, step: int = 1 << 16) -> int:
    """Bit k is 1 if it is set in over half of the shingle hashes; as a signed 64-bit integer."""
    h = shingle_hashes(text, shingle)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), step):  # in steps, so that long texts need little memory
        bits = np.unpackbits(h[k : k + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    value = int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row."""

    @F.pandas_udf("long")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in text], dtype="int64")

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), of(F.col(text_col)).alias("fp"))


def block_masks(n_blocks: int, max_bits: int) -> list[int]:
    """For each choice of blocks that close fingerprints can share: the mask of its bits."""
    if n_blocks <= max_bits:
        raise ValueError("n_blocks must be above max_bits")
    edge = [round(64 * k / n_blocks) for k in range(n_blocks + 1)]
    block = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edge, edge[1:], strict=False)]
    return [sum(block[k] for k in chosen) for chosen in combinations(range(n_blocks), n_blocks - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_forest(fp: np.ndarray, rep: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (rep, rep) of a spanning forest of the graph of close fingerprints in one bucket."""
    left = np.arange(len(fp))
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= max_bits
            found, left = left[near], left[~near]
            a.append(np.full(len(found), rep[at]))
            b.append(rep[found])
            queue += found.tolist()
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _bucket_links(max_bits: int, small: int = 64):
    """Links inside buckets given as rows with arrays ``fps`` and ``reps``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["fps"].map(len).to_numpy(np.int64)
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            little = pdf[(size <= small) & (size > 1)]
            if len(little):  # all small buckets at once: compare each member with the k-th after it
                fp = np.concatenate(little["fps"].tolist()).astype(np.int64).view(np.uint64)
                rep = np.concatenate(little["reps"].tolist()).astype(np.int64)
                bucket = np.repeat(np.arange(len(little)), size[(size <= small) & (size > 1)])
                for k in range(1, small):
                    same = np.flatnonzero(bucket[k:] == bucket[:-k])
                    if not len(same):
                        break
                    near = same[np.bitwise_count(fp[same] ^ fp[same + k]) <= max_bits]
                    a.append(rep[near])
                    b.append(rep[near + k])
            for fps, reps in pdf.loc[size > small, ["fps", "reps"]].itertuples(index=False):
                x, y = bucket_forest(np.asarray(fps, np.int64).view(np.uint64), np.asarray(reps, np.int64), max_bits)
                a.append(x)
                b.append(y)
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    return run


def _ball_links(members: DataFrame, max_bits: int) -> DataFrame:
    """Exact links of fingerprints whose buckets are too large to gather.

    Two values within ``max_bits`` meet at a value within ceil(max_bits / 2) of one and
    floor of the other; every meeting value gathers a bounded number of fingerprints (those
    within that radius of it).
    """
    radius = (max_bits + 1) // 2
    flips = [_signed(sum(1 << b for b in c)) for r in range(radius + 1) for c in combinations(range(64), r)]
    near = members.select(
        "fp", "rep", F.explode(F.transform(F.lit(flips), lambda f: F.col("fp").bitwiseXOR(f))).alias("value")
    )
    met = near.groupBy("value").agg(F.collect_list(F.struct("rep", "fp")).alias("m")).where(F.size("m") > 1)
    one = met.select("m", F.explode("m").alias("x"))
    pair = one.withColumn("y", F.explode(F.filter("m", lambda y: y["rep"] > F.col("x.rep"))))
    return pair.where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits).select(
        F.col("x.rep").alias("a"), F.col("y.rep").alias("b")
    )


def fingerprint_links(
    nodes: DataFrame, max_bits: int = MAX_BITS, n_blocks: int | None = None, max_bucket: int = MAX_BUCKET
) -> DataFrame:
    """Links (a, b) between the ``rep`` of distinct fingerprints ``fp`` that connect all that are in reach."""
    masks = block_masks(n_blocks or max_bits + 2, max_bits)
    keyed = nodes.select(
        "fp",
        "rep",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key"))
                    for k, m in enumerate(masks)
                ]
            )
        ).alias("k"),
    ).select("fp", "rep", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = written(sizes.where(F.col("n") > max_bucket), "large-buckets")
    usual = keyed.join(sizes, ["t", "key"], "left_anti")
    buckets = (
        usual.groupBy("t", "key")
        .agg(F.collect_list("fp").alias("fps"), F.collect_list("rep").alias("reps"))
        .where(F.size("fps") > 1)
        .select("fps", "reps")
    )
    links = buckets.mapInPandas(_bucket_links(max_bits), "a long, b long")
    large = keyed.join(sizes, ["t", "key"], "left_semi").select("fp", "rep").distinct()
    return links.unionByName(_ball_links(large, max_bits)).distinct()


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    n_blocks: int | None = None,
    max_bucket: int = MAX_BUCKET,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, fp, component_id): every row with the smallest doc_id it reaches over links."""
    rows = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    known = rows.where("doc_id IS NOT NULL")
    nodes = written(known.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    links = fingerprint_links(nodes, max_bits, n_blocks, max_bucket)
    # a doc_id with several texts ties the fingerprints of its rows together
    several = known.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    tied = (
        known.join(several.select("doc_id"), "doc_id", "left_semi")
        .join(nodes, "fp")
        .select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    )
    comps = connected_components(links.unionByName(tied))
    of_fp = (
        nodes.join(comps, nodes["rep"] == comps["node"], "left")
        .select("fp", F.coalesce("component", "rep").alias("component_id"))
    )
    return rows.join(of_fp, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def keep_first_of_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group, columns unchanged: the one of the smallest doc_id.

    Rows without a doc_id belong to groups too, under an id from their text behind all others.
    Of several rows with the smallest id the one with the least hash of the text stays (any of
    them, if their texts are equal). Columns of any name are kept; a text may be null, empty or
    of any length; an empty table gives no rows.
    """
    own = F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST) - F.pmod(F.xxhash64(docs["text"]), F.lit(1 << 62)))
    found = near_duplicates(docs.select(own.alias("doc_id"), docs["text"].alias("text")), shingle, max_bits)
    later = found.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    several = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), own.alias("own"))
    first = rows.join(later, F.col("own") == later["id"], "left_anti")
    alone = first.join(several, F.col("own") == several["id"], "left_anti")
    one = first.join(several, F.col("own") == several["id"], "left_semi")
    one = one.groupBy("own").agg(F.min_by("row", F.xxhash64("row.text")).alias("row"))
    return alone.select("row.*").unionByName(one.select("row.*"))
