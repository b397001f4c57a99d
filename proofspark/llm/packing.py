"""Packing token sequences: a cutting-stock problem over the histogram of piece lengths."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofspark.llm.common import documents, ranked, stored

#: Texts of these characters only are split alike by every Unicode version in use.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ‐-‧‰-⁞€]*")
RUN = re.compile(r"\S{2000}")
Pattern = dict[int, int]  # copies by bin


class Tokens:
    """Token ids by a byte-level BPE file of ``tokenizers``; plain texts go through the same ranks faster."""

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.fast = None
        if ranks_path:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast and PLAIN.fullmatch(text) and "<|" not in text and not RUN.search(text):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    pattern: str | None = None,
    size: int = 2048,
    end: int = 1,
    text: str = "text",
    id_column: str = "doc_id",
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``size`` ids: whole sequences from the front of a document, then its rest.

    Columns: the id, start, length, ids_crc32, doc_tokens and, with ``keep_ids``, the ids as little-endian
    32-bit binary.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer, ranks, pattern)
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for at, value in enumerate(batch.column(1)):
                ids = np.array([*tokens.ids(value.as_py() or ""), end], dtype="<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size].tobytes()
                    new = (at, start, len(piece) // 4, zlib.crc32(piece), len(ids), piece if keep_ids else None)
                    for column, x in zip(rows, new, strict=True):
                        column.append(x)
            columns = [batch.column(0).take(pa.array(rows[0], pa.int64()))]
            columns += [pa.array(c, pa.int64()) for c in rows[1:5]]
            names = [id_column, "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns, names = [*columns, pa.array(rows[5], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_column}` {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select(id_column, text).mapInArrow(cut, schema + (", ids binary" if keep_ids else ""))


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable pattern, as copies by type."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fit = int(np.searchsorted(sizes, c, "right"))
        if fit:
            gains = best[c - sizes[:fit]] + values[:fit]
            i = int(gains.argmax())
            if gains[i] > best[c] + 1e-12:
                best[c], choice[c] = gains[i], i
    copies, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            copies[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[capacity]), copies


def column_generation(
    sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, most: int = 3000
) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used in the linear program that covers ``demand``.

    Revised simplex on the restricted program; the knapsack prices the entering column. Prices are drawn
    towards the best ones so far (at first in proportion to size), which steadies them; surplus enters
    where a price falls below zero. Ends at the optimum, when the dual bound is within ``gap``, or after
    ``most`` columns; every end covers the demand.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))  # columns are patterns
    inverse, cost = np.diag(1.0 / np.diag(basis)), np.ones(m)
    x = inverse @ demand
    centre = sizes / capacity
    bound = float(centre @ demand)
    for step in range(most):
        if cost @ x <= bound * (1 + gap) + 1e-9:
            break
        prices = cost @ inverse
        low = int(prices.argmin())
        if prices[low] < -1e-9:
            column, price = -np.eye(m)[low], 0.0
        else:
            for pull in (0.7, 0.0):
                value, column = _best_pattern(sizes, pull * centre + (1 - pull) * prices, capacity)
                if (dual := (pull * centre + (1 - pull) * prices) / max(value, 1.0)) @ demand > bound:
                    bound, centre = float(dual @ demand), dual
                if column @ prices > 1 + 1e-9:
                    break
            else:
                break
            price = 1.0
        direction = inverse @ column
        up = direction > 1e-9
        if not up.any():
            break
        leave = int(np.where(up, x / np.where(up, direction, 1), np.inf).argmin())
        basis[:, leave], cost[leave] = column, price
        if step % 200 == 199:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[leave] / direction[leave]
            inverse = inverse - np.outer(direction, row)
            inverse[leave] = row
        x = np.maximum(inverse @ demand, 0)
    real = cost > 0
    return basis.T[real], x[real]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns and whole-number counts that place every piece of ``histogram`` (pieces by bin) once.

    Rounded-down patterns of the linear program first; what they leave (less than a pattern each) is
    placed best-fit, largest first. Work depends on the number of bins, not on the number of pieces.
    """
    bins = np.array(sorted(b for b, n in histogram.items() if n), dtype=np.int64)
    if not len(bins):
        return []
    left = np.array([histogram[b] for b in bins], dtype=np.int64)
    patterns, use = column_generation(bins, left.astype(float), capacity)
    out: list[tuple[Pattern, int]] = []
    for pattern, times in zip(patterns.round().astype(np.int64), use, strict=True):
        rest = int(times + 1e-9)
        while rest > 0 and (pattern := np.minimum(pattern, left)).any():  # less than the pattern where it covers more than is left
            has = pattern > 0
            now = min(rest, int((left[has] // pattern[has]).min()))
            left, rest = left - pattern * now, rest - now
            out.append(({int(b): int(n) for b, n in zip(bins[has], pattern[has], strict=True)}, now))
    open_: dict[int, list[Pattern]] = {}  # by free room
    for b, n in sorted(zip(bins.tolist(), left.tolist(), strict=True), reverse=True):
        for _ in range(n):
            room = min((r for r, some in open_.items() if some and r >= b), default=None)
            one = open_[room].pop() if room is not None else {}
            one[b] = one.get(b, 0) + 1
            open_.setdefault((capacity if room is None else room) - b, []).append(one)
    return out + [(one, 1) for some in open_.values() for one in some]


def pack(pieces: DataFrame, size: int = 2048, grain: int = 8, id_column: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (as by ``token_pieces``); no sequence exceeds ``size``.

    Lengths are counted in bins of ``grain`` ids, rounded up; ``size / grain`` bounds the histogram, the
    program and the placing table that goes to every task. Pieces are ranked within their bin and take
    the bin's places in pattern order. Repeated rows are pieces of their own. An empty table stays empty.
    """
    pieces = stored(pieces.withColumn("_bin", F.ceil(F.col("length") / grain)))
    counts = {r["_bin"]: r["n"] for r in pieces.groupBy("_bin").agg(F.count("*").alias("n")).collect()}
    key, base, copies, slots = [], [], [], []
    ranks: dict[int, int] = {}
    sequences = 0
    for pattern, times in plan(counts, size // grain):
        slot = 0
        for b, n in sorted(pattern.items(), reverse=True):
            key.append((b, ranks.get(b, 0)))
            base.append(sequences)
            copies.append(n)
            slots.append(slot)
            ranks[b] = ranks.get(b, 0) + n * times
            slot += n
        sequences += times
    order = sorted(range(len(key)), key=key.__getitem__)
    wide = 1 << 48
    keys = np.array([key[i][0] * wide + key[i][1] for i in order], dtype=np.int64)
    table = np.array([(base[i], copies[i], slots[i]) for i in order], dtype=np.int64).reshape(-1, 3)

    names = [c for c in pieces.columns if c != "_bin"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("_bin").to_numpy() * wide + batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, own, "right") - 1
            into = own - keys[at]
            first, many, slot = table[at].T
            columns = [batch.column(c) for c in names]
            columns += [pa.array(first + into // many), pa.array(slot + into % many)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "_slot"])

    numbered = ranked(pieces, ["_bin"], F.struct(id_column, "start", "ids_crc32"), "_rank", 64)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "_bin")
    placed = numbered.mapInArrow(place, schema + ", sequence_id long, _slot long")
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("_slot")


def pack_documents(docs: DataFrame, size: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Tokenizes, cuts and packs documents with the public 50k byte-level vocabulary.

    A null text is an empty one: the end token alone. Repeated rows are documents of their own; other
    columns of ``docs`` are left out. An empty table gives an empty result.
    """
    import public_tokenizers as P

    ranks = P.path("byte_bpe_50k.tiktoken")
    return pack(token_pieces(docs, P.path("byte_bpe_50k.json"), ranks, P.PATTERN, size, keep_ids=keep_ids), size)


def op10_packing(spark, folder: str) -> DataFrame:
    """Every piece of every document with its place."""
    return pack_documents(documents(spark, folder))
