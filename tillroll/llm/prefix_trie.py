"""Trie of conversation prefixes, screened by a count-min sketch before anything is grouped.

Every prefix of a conversation has a 128-bit digest, chained from turn to turn. A count-min
sketch over all prefix digests never counts too little, so an estimate of one proves that a
single conversation has the prefix; so it has everything longer, and that tail of the trie
is emitted where it stands. Only prefixes that may be shared are shuffled, and grouped
exactly: a false alarm of the sketch costs a row in that shuffle, never a wrong result.

Sums over a node's subtree need no walk up the trie. A node belongs to its smallest member;
the nodes of one conversation are then the end of its path, from some depth on. So each
member adds to a node what it owns below (a child, a leaf, texts counted once) and what it
repeats, all known from its own path, and one aggregation by digest has the sums.

Scale: texts are read once and leave as digest and length; the slim turns move once by base
conversation (at most ``base`` ids each) and are chained in order, a row at a time, so one
very long conversation needs a long task but no memory. Aggregations by digest combine
before the shuffle, so the root or a first turn that a third of all conversations share is
one row per task. Children look up their parent's smallest member with a salt. The member
lists behind ``ends_sha256`` are cut into sorted pieces in parallel and only the pieces of a
node meet. The sketch grows with the number of prefixes up to ``max_cells`` (an eighth of a
byte each, ``rows`` times, in the broadcast); beyond it, it proves fewer singletons and more prefixes are
shuffled.

Rows: null roles and texts are empty; a null turn sorts first, turns that tie by the digest
of role and text, and repeated rows are turns of their own. Rows without a conv_id belong to
no conversation and are left out. The base of a negative id has the remainder of its sign, as
in SQL. Texts may be of any length. Only the named columns are
read; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed values of the rebuilt conversations.
BASE, SHARED_TURNS = 100, 6
SALTS = 16
#: Cells of the sketch per piece that travels, and bytes of ids per piece of a member list.
_PIECE, _IDS = 1 << 16, 1 << 16
_NO_ENDS = hashlib.sha256(b"").hexdigest()

PREFIXES = "conv_id long, depth long, d0 long, d1 long, p0 long, p1 long, before long, points long, last boolean"
_NAMES = [c.split()[0] for c in PREFIXES.split(", ")]


@dataclass(frozen=True)
class Sketch:
    """Bounds of the count-min sketch: hash rows, cells per prefix and row, most cells per row."""

    rows: int = 3
    cells_per_prefix: int = 4
    max_cells: int = 1 << 26


# ---------------------------------------------------------------------------- prefixes
def shared_turns(conv_id: int) -> int:
    """How many turns a conversation takes from its base: crc32 of its decimal id, modulo 6."""
    return zlib.crc32(str(conv_id).encode()) % SHARED_TURNS


def slim_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, points): a turn's 128-bit digest of role and text, and the text's code points."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    both = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.md5(both.cast("binary"))).alias("digest"),
        F.char_length(text).cast("long").alias("points"),
    )


class _Path:
    """The prefixes of one conversation, in order; a row is given out when the next one is known."""

    def __init__(self, conv_id: int):
        self.conv_id, self.depth, self.before, self.points = conv_id, 0, 0, 0
        self.digest, self.parent = bytes(16), bytes(16)

    def row(self, last: bool) -> tuple:
        return (
            self.conv_id,
            self.depth,
            *struct.unpack("<qq", self.digest),
            *struct.unpack("<qq", self.parent),
            self.before,
            self.points,
            last,
        )

    def turn(self, digest: bytes, points: int) -> tuple:
        done = self.row(False)
        self.parent, self.digest = self.digest, hashlib.md5(self.digest + digest).digest()
        self.before, self.points, self.depth = self.before + self.points, points, self.depth + 1
        return done


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rebuilt conversations from turns sorted by base, the base conversation first."""
    path, skip, head_of, head = None, 0, None, []
    for pdf in batches:
        out = []
        turns = zip(pdf["base"].tolist(), pdf["conv_id"].tolist(), pdf["digest"], pdf["points"].tolist(), strict=True)
        for base, conv_id, digest, points in turns:
            if path is None or path.conv_id != conv_id:
                if path is not None:
                    out.append(path.row(True))
                path, skip = _Path(conv_id), 0
                if base == conv_id:
                    head_of, head = base, []
                else:
                    skip = shared_turns(conv_id)
                    out.extend(path.turn(*t) for t in (head[:skip] if head_of == base else ()))
            if base == conv_id and len(head) < SHARED_TURNS:
                head.append((digest, points))
            if skip:
                skip -= 1
            else:
                out.append(path.turn(digest, points))
        yield pd.DataFrame(out, columns=_NAMES)
    if path is not None:
        yield pd.DataFrame([path.row(True)], columns=_NAMES)


def prefixes(conversations: DataFrame) -> DataFrame:
    """One row per rebuilt conversation and depth, the root included.

    d0, d1 and p0, p1 are the digests of the prefix and of its parent; ``before`` are the code
    points of the turns up to the parent, ``points`` those of the prefix's last turn.
    """
    base = F.col("conv_id") - F.col("conv_id") % BASE
    return (
        slim_turns(conversations)
        .withColumn("base", base)
        .repartition("base")
        .sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "digest")
        .select("base", "conv_id", "digest", "points")
        .mapInPandas(_chain, PREFIXES)
    )


# ------------------------------------------------------------------------------ sketch
def _cells(d0: np.ndarray, d1: np.ndarray, rows: int, width: int) -> np.ndarray:
    """Cells of each digest, one per row of the sketch; ``width`` is a power of two."""
    a, b = d0.view(np.uint64), d1.view(np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([((a + np.uint64(k) * b) & np.uint64(width - 1)).astype(np.int64) for k in range(rows)])


def _partial_sketch(rows: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros(rows * width, np.uint8)  # 0, 1 or 2 for more
        shift = (np.arange(rows) * width)[:, None]
        for pdf in batches:
            cells = _cells(pdf["d0"].to_numpy(), pdf["d1"].to_numpy(), rows, width)
            at, n = np.unique(cells + shift, return_counts=True)
            count[at] = np.minimum(count[at] + n, 2)
        for k in range(0, rows * width, _PIECE):
            piece = count[k : k + _PIECE]
            if piece.any():
                bits = [np.packbits(piece >= n).tobytes() for n in (1, 2)]
                yield pd.DataFrame({"piece": [k // _PIECE], "once": [bits[0]], "more": [bits[1]]})

    return run


def _merge_sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds up sorted pieces, one at a time: a cell has more than one if two parts have any."""
    held = None
    for pdf in batches:
        for piece, once, more in pdf.itertuples(index=False, name=None):
            once, more = np.frombuffer(once, np.uint8), np.frombuffer(more, np.uint8)
            if held is not None and held[0] == piece:
                held = piece, held[1] | once, held[2] | more | (held[1] & once)
                continue
            if held is not None:
                yield pd.DataFrame({"piece": [held[0]], "more": [held[2].tobytes()]})
            held = piece, once, more
    if held is not None:
        yield pd.DataFrame({"piece": [held[0]], "more": [held[2].tobytes()]})


def shared_cells(found: DataFrame, sketch: Sketch) -> tuple[np.ndarray, int]:
    """The sketch's cells that count more than one, as packed bits, and the width of a row."""
    n = found.count() * sketch.cells_per_prefix
    width = min(max(_PIECE, 1 << max(n - 1, 1).bit_length()), sketch.max_cells)
    merged = (
        found.select("d0", "d1")
        .mapInPandas(_partial_sketch(sketch.rows, width), "piece long, once binary, more binary")
        .repartition("piece")
        .sortWithinPartitions("piece")
        .mapInPandas(_merge_sketches, "piece long, more binary")
    )
    bits = np.zeros(sketch.rows * width // 8, np.uint8)
    for row in merged.toLocalIterator():  # bounded by rows * max_cells / 8 bytes
        bits[row["piece"] * _PIECE // 8 :][: _PIECE // 8] = np.frombuffer(row["more"], np.uint8)
    return bits, width


def screened(found: DataFrame, sketch: Sketch = Sketch()) -> DataFrame:
    """``found`` with ``maybe`` (the prefix may be shared) and ``parent_maybe``.

    A prefix with an estimate of one, or longer than such a prefix of its conversation, has
    one member.
    """
    bits, width = shared_cells(found, sketch)
    shared, rows = found.sparkSession.sparkContext.broadcast(bits), sketch.rows

    def estimate_above_one(d0: pd.Series, d1: pd.Series) -> np.ndarray:
        cells = _cells(d0.to_numpy(), d1.to_numpy(), rows, width)
        at = cells + (np.arange(rows) * width)[:, None]
        return ((shared.value[at >> 3] >> (7 - (at & 7))) & 1).all(axis=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # conversation, depth and proof at the end of the batch before
        for pdf in batches:
            if not len(pdf):
                continue
            conv_id, depth = pdf["conv_id"].to_numpy(), pdf["depth"].to_numpy()
            index = np.arange(len(pdf))
            proved = ~estimate_above_one(pdf["d0"], pdf["d1"])
            parent_proved = ~estimate_above_one(pdf["p0"], pdf["p1"]) & (depth > 0)
            starts = np.r_[True, (conv_id[1:] != conv_id[:-1]) | (depth[1:] != depth[:-1] + 1)]
            if held is not None and held[:2] == (conv_id[0], depth[0] - 1):
                parent_proved[0] |= held[2]
            own = proved | parent_proved
            start = np.maximum.accumulate(np.where(starts, index, 0))
            proved = np.maximum.accumulate(np.where(own, index, -1)) >= start
            parent_proved[1:] |= proved[:-1] & ~starts[1:]
            held = conv_id[-1], depth[-1], bool(proved[-1])
            yield pdf.assign(maybe=~proved, parent_maybe=~parent_proved)

    return found.mapInPandas(run, PREFIXES + ", maybe boolean, parent_maybe boolean")


# -------------------------------------------------------------------------- exact nodes
def _pieces_of_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (d0, d1, conv_id) as (d0, d1, first, ids): up to ``_IDS`` bytes of a node's ids in a row."""
    names = ["d0", "d1", "first", "ids"]
    node, ids, size = None, [], 0
    for pdf in batches:
        out = []
        for d0, d1, conv_id in pdf.itertuples(index=False, name=None):
            if node is not None and (node[:2] != (d0, d1) or size >= _IDS):
                out.append((*node, ",".join(ids).encode()))
                node = None
            if node is None:
                node, ids, size = (d0, d1, conv_id), [], 0
            ids.append(str(conv_id))
            size += len(ids[-1]) + 1
        yield pd.DataFrame(out, columns=names)
    if node is not None:
        yield pd.DataFrame([(*node, ",".join(ids).encode())], columns=names)


def _hash_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted pieces as (d0, d1, ends_sha256), fed to the hash one at a time."""
    names = ["d0", "d1", "ends_sha256"]
    node, digest = None, None
    for pdf in batches:
        out = []
        for d0, d1, ids in pdf.itertuples(index=False, name=None):
            if node == (d0, d1):
                digest.update(b"," + ids)
                continue
            if node is not None:
                out.append((*node, digest.hexdigest()))
            node, digest = (d0, d1), hashlib.sha256(ids)
        yield pd.DataFrame(out, columns=names)
    if node is not None:
        yield pd.DataFrame([(*node, digest.hexdigest())], columns=names)


def _ends(maybe: DataFrame) -> DataFrame:
    """(d0, d1, ends_sha256) of the possibly shared prefixes at which a conversation ends."""
    return (
        maybe.where("last")
        .select("d0", "d1", "conv_id")
        .repartitionByRange("d0", "d1", "conv_id")
        .sortWithinPartitions("d0", "d1", "conv_id")
        .mapInPandas(_pieces_of_ids, "d0 long, d1 long, first long, ids binary")
        .repartition("d0", "d1")
        .sortWithinPartitions("d0", "d1", "first")
        .select("d0", "d1", "ids")
        .mapInPandas(_hash_ids, "d0 long, d1 long, ends_sha256 string")
    )


def _owners(judged: DataFrame) -> DataFrame:
    """(owner, from_depth, repeated, leaf): from which depth a conversation owns its path.

    ``repeated`` are the code points before that depth, ``leaf`` tells whether the path ends
    in a leaf of its own. A conversation that owns nothing starts behind its last turn.
    """
    grouped = (
        judged.where("maybe")
        .groupBy("d0", "d1")
        .agg(
            F.min("conv_id").alias("owner"),
            F.min("depth").alias("from_depth"),
            F.min("before").alias("repeated"),
            (F.sum(F.col("last").cast("long")) == F.count(F.lit(1))).alias("leaf"),
        )
        .select("owner", "from_depth", "repeated", "leaf")
    )
    behind = judged.where("last").select(
        "conv_id", F.col("depth") + 1, F.col("before") + F.col("points"), ~F.col("maybe")
    )
    tails = judged.where(~F.col("maybe") & F.col("parent_maybe")).select("conv_id", "depth", "before", F.lit(False))
    return (
        grouped.union(behind)
        .union(tails)
        .groupBy("owner")  # the least depth has the fewest code points before it
        .agg(F.min("from_depth").alias("from_depth"), F.min("repeated").alias("repeated"), F.max("leaf").alias("leaf"))
    )


def _grouped_nodes(judged: DataFrame) -> DataFrame:
    """The nodes of the possibly shared prefixes; ``starts`` if the owner's path starts there."""
    maybe = judged.where("maybe")
    owners = _owners(judged)
    rows = maybe.join(owners, maybe["conv_id"] == owners["owner"])
    as_long = lambda c: c.cast("long")
    return rows.groupBy("d0", "d1").agg(
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.min("p0").alias("p0"),
        F.min("p1").alias("p1"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(as_long(~F.col("last") & (F.col("from_depth") <= F.col("depth") + 1))).alias("n_children"),
        F.sum(as_long(F.col("leaf"))).alias("n_leaves"),
        F.sum(F.greatest(F.lit(0).cast("long"), F.col("repeated") - F.col("before"))).alias("saved_tokens"),
        F.max(F.col("from_depth") == F.col("depth")).alias("starts"),
    )


def _tail_nodes(judged: DataFrame) -> DataFrame:
    """The proven singletons, from their own rows alone."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    alone = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    return judged.where(~F.col("maybe")).select(
        "conv_id",
        "depth",
        "p0",
        "p1",
        one.alias("n_convs"),
        F.when(F.col("last"), zero).otherwise(one).alias("n_children"),
        one.alias("n_leaves"),
        zero.alias("saved_tokens"),
        F.col("parent_maybe").alias("starts"),
        F.when(F.col("last"), alone).otherwise(_NO_ENDS).alias("ends_sha256"),
    )


def trie(conversations: DataFrame, sketch: Sketch = Sketch()) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    judged = written(screened(written(prefixes(conversations), "prefixes"), sketch), "screened")
    root = judged.agg(F.min("conv_id")).first()[0]
    grouped = written(_grouped_nodes(judged), "trie-nodes")
    ends = _ends(judged.where("maybe")).withColumnsRenamed({"d0": "e0", "d1": "e1"})
    shared = grouped.join(ends, (F.col("d0") == F.col("e0")) & (F.col("d1") == F.col("e1")), "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS))
    )
    nodes = shared.drop("d0", "d1", "e0", "e1").unionByName(_tail_nodes(judged))
    # where an owner's path starts, its parent is another's; the root's children need no look-up
    asks = F.col("starts") & (F.col("depth") > 1)
    parents = grouped.where("n_convs > 1 and depth > 0").select(
        F.col("d0").alias("q0"),
        F.col("d1").alias("q1"),
        F.col("conv_id").alias("found"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    asking = nodes.where(asks).join(
        parents,
        (F.col("p0") == F.col("q0")) & (F.col("p1") == F.col("q1")) & (F.pmod(F.hash("conv_id"), F.lit(SALTS)) == F.col("salt")),
        "left",
    )
    parent = F.when(F.col("depth") == 1, F.lit(root)).when(F.col("depth") > 1, F.col("conv_id")).cast("long")
    result = asking.withColumn("parent_conv_id", F.coalesce("found", "conv_id")).drop("q0", "q1", "found", "salt")
    result = result.unionByName(nodes.where(~asks).withColumn("parent_conv_id", parent))
    return result.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )

