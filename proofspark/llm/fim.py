"""Fill-in-the-middle: texts cut at two token borders and put in the order prefix, suffix, middle."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from proofspark.llm.common import by_bytes, documents

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"

CONTAINER = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class BoundarySet:
    """An ordered set of positions in containers of 65,536, with the k-th position on demand.

    A container holds the low 16 bits of its positions as an array (2 bytes a position), a bitmap (8 KB)
    or runs (4 bytes a run), whichever is smallest. ``ends`` are cumulative cardinalities: the container
    of the k-th position is found by bisection in them, the position by a select inside of it.
    """

    def __init__(self) -> None:
        self.high: list[int] = []
        self.kinds: list[str] = []
        self.data: list[tuple[np.ndarray, ...]] = []
        self.ends: list[int] = []

    def add(self, high: int, low: np.ndarray) -> None:
        """The next container: ascending distinct low halves of its positions."""
        if not len(low):
            return
        breaks = np.flatnonzero(np.diff(low) != 1) + 1
        sizes = {"array": 2 * len(low), "runs": 4 * (len(breaks) + 1), "bitmap": CONTAINER // 8}
        kind = min(sizes, key=sizes.__getitem__)
        if kind == "array":
            data = (low.astype(np.uint16),)
        elif kind == "runs":
            firsts = np.concatenate([[0], breaks])
            data = (low[firsts].astype(np.uint16), firsts.astype(np.uint16))
        else:
            bits = np.zeros(CONTAINER, np.uint8)
            bits[low] = 1
            data = (np.packbits(bits, bitorder="little").view(np.uint64),)
        self.high.append(high)
        self.kinds.append(kind)
        self.data.append(data)
        self.ends.append(len(self) + len(low))

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def select(self, k: int) -> int:
        """The k-th smallest position, from 0."""
        at = int(np.searchsorted(self.ends, k, side="right"))
        k -= self.ends[at - 1] if at else 0
        kind, data = self.kinds[at], self.data[at]
        if kind == "array":
            low = int(data[0][k])
        elif kind == "runs":
            run = int(np.searchsorted(data[1], k, side="right")) - 1
            low = int(data[0][run]) + k - int(data[1][run])
        else:
            before = np.cumsum(np.bitwise_count(data[0]), dtype=np.int64)
            word = int(np.searchsorted(before, k, side="right"))
            k -= int(before[word - 1]) if word else 0
            left = int(data[0][word])
            for _ in range(k):
                left &= left - 1
            low = word * 64 + (left & -left).bit_length() - 1
        return self.high[at] * CONTAINER + low


def token_ends(text: np.ndarray) -> BoundarySet:
    """The last bytes of the tokens of a UTF-8 text, read a container at a time.

    A token is a word with the blanks before it, or the blanks at the end of the text.
    """
    found = BoundarySet()
    for begin in range(0, len(text), CONTAINER):
        space = _SPACE[text[begin : begin + CONTAINER + 1]]
        last = ~space
        last[:-1] &= space[1:]
        if begin + CONTAINER >= len(text):
            last[-1] = True
        else:
            last = last[:CONTAINER]
        found.add(begin // CONTAINER, np.flatnonzero(last))
    return found


def _chars(utf8: np.ndarray) -> int:
    return int(np.count_nonzero((utf8 & 0xC0) != 0x80))


def _transformed(doc_id, raw: bytes, seed: int, fim_percent: int, spm_percent: int) -> tuple:
    """The row of one text: n, form, prefix_chars, middle_chars, output."""
    text = np.frombuffer(raw, np.uint8)
    ends = token_ends(text)
    n = len(ends)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h = [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]
    marked = any(m.encode() in raw for m in (PREFIX, SUFFIX, MIDDLE))
    if not raw or marked or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, raw
    cuts = sorted(x % (n + 1) for x in h[:2])
    a, b = (ends.select(c - 1) + 1 if c else 0 for c in cuts)
    p, m, s = (x.encode() for x in (PREFIX, MIDDLE, SUFFIX))
    if h[3] % 100 < spm_percent:
        form, parts = "spm", (s, raw[b:], p, raw[:a], m, raw[a:b])
    else:
        form, parts = "psm", (p, raw[:a], s, raw[b:], m, raw[a:b])
    return n, form, _chars(text[:a]), _chars(text[a:b]), b"".join(parts)


def fill_in_middle(
    docs: DataFrame,
    seed: int = 42,
    fim_percent: int = 50,
    spm_percent: int = 80,
    text: str = "text",
    id_column: str = "doc_id",
) -> DataFrame:
    """All rows of ``docs`` with n (tokens), form, prefix_chars, middle_chars and output.

    Two token borders are drawn by the hash of seed and id; ``output`` holds prefix, suffix and middle
    behind their marks (form ``psm``), or suffix first (``spm``); what is to stay whole is ``plain``, with
    null counts. Texts that hold a mark stay plain, so that :func:`restored` always gives back the text.

    A null text counts as empty and is plain; a null id is hashed as an empty one. Rows with equal ids
    get equal draws; each row is cut by its own text. A text of any length is read in containers of
    64 KB. Columns of ``docs`` whose names clash with added ones are replaced. An empty table gives none.
    """
    fields = StructType.fromDDL(ADDED).fields
    taken = {f.name.lower() for f in fields} - {text.lower(), id_column.lower()}
    rows = docs.drop(*[c for c in docs.columns if c.lower() in taken])
    at, key = rows.columns.index(text), rows.columns.index(id_column)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary())
            lengths = [0 if x is None else x for x in pc.binary_length(texts).to_pylist()]
            for begin, end in by_bytes([range(x) for x in lengths], 8 << 20):
                part = batch.slice(begin, end - begin)
                out = [
                    _transformed(i.as_py(), t.as_py() or b"", seed, fim_percent, spm_percent)
                    for i, t in zip(part.column(key), texts[begin:end])
                ]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                added = [pa.array(x, k) for x, k in zip(zip(*out), kinds)]
                added[-1] = added[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, *[f.name for f in fields]])

    return rows.mapInArrow(cut, StructType([*rows.schema.fields, *fields]))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that a transformed one was made from."""
    psm = F.split(F.col(output), f"{SUFFIX}|{MIDDLE}", -1)
    spm = F.split(F.col(output), f"{PREFIX}|{MIDDLE}", -1)
    skip = len(PREFIX) + 1
    return (
        F.when(F.col(form) == "psm", F.concat(F.substr(psm[0], F.lit(skip)), psm[2], psm[1]))
        .when(F.col(form) == "spm", F.concat(spm[1], spm[2], F.substr(spm[0], F.lit(skip))))
        .otherwise(F.col(output))
    )


def op12_fill_in_middle(spark, folder: str) -> DataFrame:
    """Cuts and digests of every document."""
    cut = fill_in_middle(documents(spark, folder).select("doc_id", "text"))
    return cut.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(), 256).alias("restored_sha256"),
    )
