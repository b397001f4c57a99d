"""Prefix trie of conversations, with a count-min sketch that keeps unshared tails out of the shuffle.

A node is a distinct sequence of first turns. Each turn has a 128-bit code of its depth, role and text,
and the exclusive or of a conversation's first d codes names its node at depth d. Prefixes are screened
by a sketch of all of them: an estimate of one proves that nobody else has that prefix, nor any longer
one of the same conversation, so that these nodes are written out where they are. Only prefixes that
may be shared are shuffled and counted exactly.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofspark.llm.common import mixed, stored

#: Turns of a conversation in one row; longer ones are rows of their own.
CHUNK = 4096
#: The sketch: counters of each row for every prefix, at least and at most 2 to the power of so many.
SKETCH_ROWS, PER_PREFIX, LEAST_BITS, MOST_BITS = 3, 4, 12, 25
BLOCK_BITS = 15
#: Nodes with more than this share of all shared prefixes are looked up by broadcast, so at most so many.
MOST_HOT = 20_000
PIECE_BYTES = 1 << 20

KEY = ("depth", "x1", "x2")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def conversation_paths(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Turns in order, as rows (conv_id, chunk, start, length, turns) of at most ``chunk`` turns.

    ``start`` counts the turns before, ``length`` those of the whole conversation; ``turns`` holds two
    codes and the bytes of the text. Turns are ordered by ``turn``, null first; equal ones by the SHA-256
    of role and text. Null roles and texts are empty ones. Rows without ``conv_id`` are left out.

    Windows run inside of (conversation, range of turn numbers), so that a very long conversation is
    numbered in many tasks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.unhex(F.sha2(content, 256)).alias("sha"),
        F.octet_length(text).alias("bytes"),
        F.coalesce(F.floor(F.col("turn").cast("long") / chunk), F.lit(-(1 << 62))).alias("part"),
    )
    inside = Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "sha")
    along = Window.partitionBy("conv_id").orderBy("part")
    parts = (
        rows.groupBy("conv_id", "part")
        .agg(F.count("*").alias("n"))
        .select(
            "conv_id",
            "part",
            F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
            F.sum("n").over(Window.partitionBy("conv_id")).alias("length"),
        )
    )
    numbered = (
        rows.withColumn("in_part", F.row_number().over(inside) - 1)
        .join(parts, ["conv_id", "part"])
        .select(
            "conv_id",
            "length",
            (F.col("before") + F.col("in_part")).alias("pos"),
            F.xxhash64(F.lit(1), "sha").alias("c1"),
            F.xxhash64(F.lit(2), "sha").alias("c2"),
            "bytes",
        )
    )
    return (
        numbered.groupBy("conv_id", F.floor(F.col("pos") / chunk).alias("chunk"))
        .agg(
            F.min("pos").alias("start"),
            F.first("length").alias("length"),
            F.sort_array(F.collect_list(F.struct("pos", "c1", "c2", "bytes"))).alias("turns"),
        )
        .withColumn("turns", F.transform("turns", lambda t: F.struct(t.c1.alias("c1"), t.c2.alias("c2"), t.bytes.alias("bytes"))))
    )


def with_borrowed_heads(paths: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """Each conversation c with its first h turns replaced by the first h of conversation c - c % family.

    h is the CRC-32 of the decimal id modulo ``most`` + 1. A shorter lender gives all its turns, a missing
    one none. The lender's own turns stay as they are.
    """
    heads = paths.where(f"chunk = 0 and conv_id % {family} = 0").select(
        F.col("conv_id").alias("lender"), F.slice("turns", 1, most).alias("head")
    )
    none = F.array().cast(paths.schema["turns"].dataType)
    joined = (
        paths.withColumns(
            {"lender": F.expr(f"conv_id - conv_id % {family}"), "h": (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")}
        )
        .join(heads, "lender", "left")
        .withColumn("head", F.slice(F.coalesce("head", none), F.lit(1), F.col("h")))
    )
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    shift = F.size("head") - F.col("h")
    return joined.select(
        "conv_id",
        "chunk",
        F.when(F.col("chunk") == 0, 0).otherwise(F.col("start") + shift).cast("long").alias("start"),
        (F.size("head") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length"),
        F.when(F.col("chunk") == 0, F.concat("head", own)).otherwise(F.col("turns")).alias("turns"),
    )


class _Prefixes:
    """The prefixes of a batch of paths: codes of nodes, by position in the flattened turns."""

    def __init__(self, batch: pa.RecordBatch):
        turns = batch.column("turns")
        flat = turns.flatten()
        offsets = turns.offsets.to_numpy().astype(np.int64)
        self.at = offsets - offsets[0]
        self.sizes = np.diff(self.at)
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.start = batch.column("start").to_numpy()
        self.depth = self.start[self.row] + np.arange(len(self.row)) - self.at[self.row] + 1
        self.bytes = flat.field("bytes").to_numpy()
        level = mixed(self.depth.astype(np.uint64))
        self.codes = []
        for name, salt in (("c1", 0x1F0A), ("c2", 0x73B5)):
            code = flat.field(name).to_numpy().view(np.uint64)
            self.codes.append(mixed(mixed(code + np.uint64(salt)) ^ level))
        self.carry = [batch.column(f"carry{i}").to_numpy().view(np.uint64) for i in (1, 2)]
        self.x = []
        for code, carry in zip(self.codes, self.carry):
            total = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(code)])
            self.x.append(total[1:] ^ (total[self.at[:-1]] ^ carry)[self.row])

    def buckets(self, bits: int) -> list[np.ndarray]:
        """The counters of every prefix, one a row of the sketch."""
        mask = np.uint64((1 << bits) - 1)
        return [(x & mask).astype(np.int64) for x in (self.x[0], self.x[1], mixed(self.x[0] + self.x[1]))]

    def first(self, found: np.ndarray) -> np.ndarray:
        """For each row the position of its first turn that is ``found``, or the end of its turns."""
        out = self.at[1:].copy()
        hits = np.flatnonzero(found)
        np.minimum.at(out, self.row[hits], hits)
        return out


def _with_carries(paths: DataFrame) -> DataFrame:
    """Rows of long conversations with the exclusive or of the codes before their first turn."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _Prefixes(batch)
            sums = [np.zeros(len(p.sizes), np.uint64) for _ in p.codes]
            for total, code in zip(sums, p.codes):
                np.bitwise_xor.at(total, p.row, code)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("chunk"), *[pa.array(s.view(np.int64)) for s in sums]],
                names=["conv_id", "chunk", "t1", "t2"],
            )

    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = paths.mapInArrow(totals, "conv_id long, chunk long, t1 long, t2 long").select(
        "conv_id", "chunk", *[F.bit_xor(f"t{i}").over(earlier).alias(f"of{i}") for i in (1, 2)]
    )
    return (
        paths.join(sums, ["conv_id", "chunk"], "left")
        .withColumns({f"carry{i}": F.coalesce(f"of{i}", F.lit(0).cast("long")) for i in (1, 2)})
        .drop("of1", "of2")
    )


def shared_buckets(paths: DataFrame, bits: int) -> np.ndarray:
    """Of each row of the sketch one bit a counter: whether two prefixes or more fell on it.

    Tasks count for themselves, up to two, and hand on bitmaps of blocks of counters; blocks are merged
    by their number. What reaches the driver is the sketch, at most 3 x 4 MB whatever the input.
    """
    size = 1 << min(bits, BLOCK_BITS)
    blocks = (1 << bits) // size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(1 << bits, np.uint8) for _ in range(SKETCH_ROWS)]
        for batch in batches:
            for counters, at in zip(seen, _Prefixes(batch).buckets(bits)):
                where, n = np.unique(at, return_counts=True)
                counters[where] = np.minimum(counters[where] + np.minimum(n, 2).astype(np.uint8), 2)
        for row, counters in enumerate(seen):
            for block in range(blocks):
                part = counters[block * size : (block + 1) * size]
                if part.any():
                    packed = [zlib.compress(np.packbits(part >= least), 1) for least in (1, 2)]
                    yield pa.RecordBatch.from_pydict(
                        {"row": pa.array([row], pa.int32()), "block": pa.array([block], pa.int32()), "once": [packed[0]], "more": [packed[1]]}
                    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                once, more = (np.frombuffer(zlib.decompress(r[c]), np.uint8) for c in ("once", "more"))
                old = state.setdefault((r["row"], r["block"]), [np.zeros(size // 8, np.uint8) for _ in range(2)])
                old[1] |= more | (old[0] & once)
                old[0] |= once
        for (row, block), (_, more) in state.items():
            yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int32()), "block": pa.array([block], pa.int32()), "more": [more.tobytes()]})

    counted = paths.mapInArrow(count, "row int, block int, once binary, more binary")
    merged = counted.repartition("row", "block").mapInArrow(merge, "row int, block int, more binary")
    sketch = np.zeros((SKETCH_ROWS, (1 << bits) // 8), np.uint8)
    for r in merged.collect():
        sketch[r["row"], r["block"] * size // 8 : (r["block"] + 1) * size // 8] = np.frombuffer(r["more"], np.uint8)
    return sketch


def _alone(p: _Prefixes, sketch: np.ndarray, bits: int) -> np.ndarray:
    """Which prefixes have an estimate of one, which proves that only one conversation has them."""
    shared = np.ones(len(p.row), bool)
    for row, at in zip(sketch, p.buckets(bits)):
        shared &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return ~shared


_SCREENED = (
    "conv_id long, chunk long, depth long, x1 long, x2 long, p1 long, p2 long, bytes long, last boolean, opens boolean,"
    " long boolean, until long, length long"
)


def _screen(sketch: np.ndarray, bits: int) -> Callable:
    """Rows of prefixes that may be shared (``until`` null), and rows of tails, depths up to ``until``."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _Prefixes(batch)
            conv, chunk, length = (batch.column(c).to_numpy() for c in ("conv_id", "chunk", "length"))
            begun = batch.column("begun").to_numpy(zero_copy_only=False)  # an earlier row has begun the tail
            first = np.where(begun, p.at[:-1], p.first(_alone(p, sketch, bits)))
            long = length > p.sizes
            x = [v.view(np.int64) for v in p.x]
            before = []  # the node before each prefix
            for v, carry in zip(x, p.carry):
                shifted = np.concatenate([np.zeros(1, np.int64), v[:-1]]) if len(v) else v
                heads = p.at[:-1][p.sizes > 0]
                shifted[heads] = carry.view(np.int64)[p.sizes > 0]
                before.append(shifted)
            keep = np.arange(len(p.row)) < first[p.row]
            row = p.row[keep]
            out = {
                "conv_id": conv[row],
                "chunk": chunk[row],
                "depth": p.depth[keep],
                "x1": x[0][keep],
                "x2": x[1][keep],
                "p1": before[0][keep],
                "p2": before[1][keep],
                "bytes": p.bytes[keep].astype(np.int64),
                "last": p.depth[keep] == length[row],
                "opens": (np.flatnonzero(keep) + 1 == first[row]) & (first[row] < p.at[1:][row]),
                "long": long[row],
                "length": length[row],
            }
            yield _rows(out, None)
            root = np.flatnonzero(chunk == 0)
            zero = np.zeros(len(root), np.int64)
            out = {c: zero for c in ("chunk", "depth", "x1", "x2", "p1", "p2", "bytes")}
            out |= {"conv_id": conv[root], "last": length[root] == 0, "long": long[root], "length": length[root]}
            out["opens"] = (first[root] == p.at[:-1][root]) & (p.sizes[root] > 0)
            yield _rows(out, None)
            tail = np.flatnonzero(first < p.at[1:])
            at = first[tail]
            out = {
                "conv_id": conv[tail],
                "chunk": chunk[tail],
                "depth": p.depth[at],
                "x1": x[0][at],
                "x2": x[1][at],
                "p1": before[0][at],
                "p2": before[1][at],
                "bytes": np.zeros(len(tail), np.int64),
                "last": ~begun[tail] & (chunk[tail] > 0) & (at == p.at[:-1][tail]),  # no prefix of this row opens it
                "opens": ~begun[tail],
                "long": long[tail],
                "length": length[tail],
            }
            yield _rows(out, p.start[tail] + p.sizes[tail])

    names = [c.split()[0] for c in _SCREENED.split(",")]

    def _rows(out: dict[str, np.ndarray], until: np.ndarray | None) -> pa.RecordBatch:
        n = len(out["conv_id"])
        out["until"] = pa.nulls(n, pa.int64()) if until is None else until
        return pa.RecordBatch.from_arrays([v if isinstance(v := out[c], pa.Array) else pa.array(v) for c in names], names=names)

    return screen


def _looked_up(rows: DataFrame, nodes: DataFrame, hot: DataFrame, added: list[str]) -> DataFrame:
    """``rows`` with columns of their nodes; nodes of many rows by broadcast, all others by a join."""
    on = [F.col(k) == F.col(f"_{k}") for k in KEY]
    renamed = lambda t: t.select(*[F.col(k).alias(f"_{k}") for k in KEY], *added)
    names = rows.columns
    keyed = rows.join(F.broadcast(renamed(hot)), on, "left")
    found = keyed.where("_depth is not null")
    rest = keyed.where("_depth is null").select(*names)
    cold = renamed(nodes.where("not hot"))
    return found.select(*names, *added).union(rest.join(cold, on).select(*names, *added))


def _ends_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids of each node, joined by commas.

    Ids are sorted by range over all nodes, so that those of one node spread over tasks; each writes
    pieces of at most 1 MB, and the pieces of a node run in order through one digest, a piece at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in KEY]
            ids = batch.column("conv_id").to_numpy()
            new = np.zeros(len(ids), bool)
            new[:1] = True
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            borders = [*np.flatnonzero(new).tolist(), len(ids)]
            texts = batch.column("conv_id").cast(pa.string()).to_pylist()
            firsts, joined = [], []
            for begin, end in zip(borders, borders[1:]):
                for at in range(begin, end, PIECE_BYTES // 21):
                    firsts.append(at)
                    joined.append(",".join(texts[at : min(end, at + PIECE_BYTES // 21)]))
            out = [pa.array(c[firsts]) for c in columns] + [pa.array(ids[firsts]), pa.array(joined, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=[*KEY, "first_id", "ids"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        names = [*KEY, "ends_sha256"]
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                here = tuple(r[k] for k in KEY)
                if here != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = here, hashlib.sha256(r["ids"].encode())
                else:
                    digest.update(b"," + r["ids"].encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, digest.hexdigest())], names=names)

    order = [*KEY, "conv_id"]
    sorted_ends = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = sorted_ends.mapInArrow(pieces, "depth long, x1 long, x2 long, first_id long, ids string")
    by_node = parts.repartition(*KEY).sortWithinPartitions(*KEY, "first_id")
    return by_node.mapInArrow(chain, "depth long, x1 long, x2 long, ends_sha256 string")


def prefix_trie(paths: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per node of the trie of ``paths``, as :func:`conversation_paths` gives them.

    Columns: conv_id (smallest member), depth, parent_conv_id (the parent's conv_id, null at the root),
    n_convs (members), n_children, n_leaves (childless nodes in the subtree, itself included),
    saved_tokens (over the subtree, bytes of the last text times members but one) and ends_sha256 (of the
    ids of members that end here). No conversations, no nodes.

    Sums over subtrees need no levels: each node is owned by its smallest member, the nodes that a
    conversation owns below a node are a suffix of its own path, and a node's subtree is owned by its
    members. So a node's sum is that of its members' suffix sums, which one window over paths gives.
    """
    paths = stored(paths.withColumns({"carry1": F.lit(0).cast("long"), "carry2": F.lit(0).cast("long")}))
    turns, chunks = paths.agg(F.sum(F.size("turns")), F.max("chunk")).first()
    bits = min(max(most_bits, 3), max(LEAST_BITS, int(PER_PREFIX * (turns or 0)).bit_length()))
    paths = paths.withColumn("begun", F.lit(False))
    if chunks:
        paths = stored(_with_carries(paths))
    sketch = shared_buckets(paths, bits)
    if chunks:
        paths = _with_begun_tails(paths, sketch, bits)

    screened = stored(paths.mapInArrow(_screen(sketch, bits), _SCREENED))
    shared = screened.where("until is null")
    tails = screened.where("until is not null")

    counted = stored(
        shared.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("conv_id").alias("owner"), F.sum(F.col("last").cast("long")).alias("n_ends"))
    )
    limit = max(1000, (counted.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    counted = counted.withColumn("hot", F.col("n") > limit)
    hot = counted.where("hot")

    owned = F.col("owner") == F.col("conv_id")
    placed = _looked_up(shared, counted, hot, ["n", "owner", "n_ends"]).withColumns(
        {
            "saved": F.when(owned, (F.col("n") - 1) * F.col("bytes")).otherwise(0),
            "leaf": (F.col("opens") | (F.col("last") & owned & (F.col("n_ends") == F.col("n")))).cast("long"),
        }
    )
    below = Window.partitionBy("conv_id", "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({c: F.sum(c).over(below) for c in ("saved", "leaf")})
    if chunks:
        later = Window.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
        # a tail that opens with a row is a leaf after the rows before
        opened = tails.where("opens and last").select("conv_id", "chunk", F.lit(0).alias("saved"), F.lit(1).alias("leaf"))
        after = (
            placed.where("long")
            .select("conv_id", "chunk", "saved", "leaf")
            .union(opened)
            .groupBy("conv_id", "chunk")
            .agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
            .select("conv_id", "chunk", *[F.sum(c).over(later).alias(f"later_{c}") for c in ("saved", "leaf")])
        )
        summed = summed.join(after, ["conv_id", "chunk"], "left").withColumns(
            {c: F.col(c) + F.coalesce(f"later_{c}", F.lit(0)) for c in ("saved", "leaf")}
        )
    nodes = summed.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.first("p1").alias("p1"),
        F.first("p2").alias("p2"),
        F.count("*").alias("n_convs"),
        F.sum("leaf").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    nodes = stored(nodes)
    tops = tails.where("opens")
    children = (
        nodes.where("depth > 0")
        .selectExpr("depth - 1 as depth", "p1 as x1", "p2 as x2")
        .union(tops.selectExpr("depth - 1 as depth", "p1 as x1", "p2 as x2"))
        .groupBy(*KEY)
        .agg(F.count("*").alias("n_children"))
    )
    below_root = _with_parent(nodes.where("depth > 0"), counted, hot)
    whole = (
        below_root.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
        .join(children, list(KEY), "left")
        .join(_ends_hashes(shared.where("last")), list(KEY), "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        )
    )
    top = _with_parent(tops, counted, hot).unionByName(tails.where("not opens").withColumn("parent_conv_id", F.col("conv_id")))
    alone = top.select("conv_id", "length", "parent_conv_id", F.col("depth").alias("top"), F.explode(F.sequence("depth", "until")).alias("depth"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ended = F.col("depth") == F.col("length")
    return whole.union(
        alone.select(
            "conv_id",
            "depth",
            F.when(F.col("depth") == F.col("top"), F.col("parent_conv_id")).otherwise(F.col("conv_id")),
            one,
            F.when(ended, none).otherwise(one),
            one,
            none,
            F.when(ended, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(EMPTY_SHA),
        )
    )


def _with_parent(rows: DataFrame, counted: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with the owner of the node that their ``p1`` and ``p2`` name."""
    names = rows.columns
    kept = rows.withColumnsRenamed({k: f"own_{k}" for k in KEY}).withColumns(
        {"depth": F.expr("own_depth - 1"), "x1": F.col("p1"), "x2": F.col("p2")}
    )
    found = _looked_up(kept, counted, hot, ["owner"])
    return found.drop(*KEY).withColumnsRenamed({f"own_{k}": k for k in KEY}).select(*names, F.col("owner").alias("parent_conv_id"))


def _with_begun_tails(paths: DataFrame, sketch: np.ndarray, bits: int) -> DataFrame:
    """``begun`` is true on rows of long conversations whose tail begins in a row before."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _Prefixes(batch)
            proven = p.first(_alone(p, sketch, bits)) < p.at[1:]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array(proven)], names=["conv_id", "chunk", "proven"])

    firsts = (
        paths.where(F.col("length") > F.size("turns"))
        .mapInArrow(prove, "conv_id long, chunk long, proven boolean")
        .where("proven")
        .groupBy("conv_id")
        .agg(F.min("chunk").alias("first_chunk"))
    )
    return (
        paths.drop("begun")
        .join(firsts, "conv_id", "left")
        .withColumn("begun", F.coalesce(F.col("chunk") > F.col("first_chunk"), F.lit(False)))
        .drop("first_chunk")
    )


def op13_prefix_trie(spark, folder: str) -> DataFrame:
    """The trie of all conversations, each with a head borrowed within its family of five."""
    return prefix_trie(with_borrowed_heads(conversation_paths(spark.read.parquet(f"{folder}/conversations.parquet"))))
