"""Near-duplicate lines: an exact set-similarity join over prefixes of the rarest words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofspark.llm.blocks import blocked, groups_of
from proofspark.llm.common import by_bytes, documents, mixed, stored

#: Frequent words whose order goes to every task; all others count as rare, ordered by their code.
FREQUENT = 50_000
#: Characters whose postings a task holds at once, and bytes of text that one shard of postings stands for.
PART_BYTES = 8 << 20
#: Posting lists beyond so many lines are split into blocks of about so many; how many such lists are told to all tasks.
HOT_LIST, MOST_HOT = 8192, 100_000
#: One in so many documents is asked for long posting lists, and each one beyond so many bytes.
SAMPLE, LONG_TEXT = 16, 1 << 16
NO_WORDS = np.zeros(0, np.uint64)
SHARD_TEXT = 8 << 20
#: Counted words that a task holds before it hands them on.
MOST_COUNTED = 1 << 20

#: Bytes that end a word, and masks of the first 0 to 8 bytes of a little-endian integer.
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words beyond so many bytes are coded one by one.
LONG_WORD = 512
LENGTHS = mixed(np.arange(LONG_WORD + 1, dtype=np.uint64))
#: Bytes of text whose words are coded and sorted at once, so that their arrays stay in a core's cache.
CACHED_BYTES = 1 << 18


def line_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, line number) of every line with a word, the 64-bit codes of all words in their order, words per line.

    Words of up to 8 bytes have codes of their own; longer ones share one with a chance of 2^-64.
    """
    data = b"\n".join([b"", *texts, bytes(8)])
    n = len(data) - 8
    chars = np.frombuffer(data, np.uint8, n)
    space = SPACES[chars]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    eight = np.ndarray((n,), "<u8", buffer=data, strides=(1,))
    length = ends - starts
    code = mixed(LENGTHS[np.minimum(length, LONG_WORD)] ^ (eight[starts] & MASKS[np.minimum(length, 8)]))
    left, at = np.flatnonzero((length > 8) & (length <= LONG_WORD)), 8
    while len(left):
        rest = length[left] - at
        code[left] = mixed(code[left] ^ (eight[starts[left] + at] & MASKS[np.minimum(rest, 8)]))
        left, at = left[rest > 8], at + 8
    for k in np.flatnonzero(length > LONG_WORD).tolist():
        code[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    breaks = np.flatnonzero(chars == 10)  # one before each line, and one at the end
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.searchsorted(breaks, np.cumsum(sizes) - sizes)
    text = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(breaks) - 1)))
    words = np.diff(np.searchsorted(starts, breaks))
    some = np.flatnonzero(words)
    text = text[some]
    return text, some - first[text], code, words[some]


def _rank_table(order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes in ascending order, their ranks from 1 by their place in ``order``, and where each leading 17 bits begin."""
    by_code = np.argsort(order, kind="stable")
    ordered = np.append(order[by_code], np.uint64((1 << 64) - 1))
    first = np.searchsorted(ordered[:-1], np.arange(1 << 17, dtype=np.uint64) << np.uint64(47)).astype(np.int32)
    return ordered, np.append(by_code + 1, 0), first


def _ranks(code: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """1 and up for codes by their place in the order of ``_rank_table``, 0 for others."""
    ordered, ranks, first = table
    at = first[code >> np.uint64(47)]
    found = ordered[at]
    rank = np.where(found == code, ranks[at], 0)
    left = np.flatnonzero(found < code)
    at = at[left] + 1
    while len(left):
        found, mine = ordered[at], code[left]
        hit = found == mine
        rank[left[hit]] = ranks[at[hit]]
        more = found < mine
        left, at = left[more], at[more] + 1
    return rank


def _sorted_words(number: np.ndarray, rank: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by line number, rank and code, and which of them are new in their line.

    Sorted by one 64-bit key, by all three if two words share one.
    """
    if len(number) and number[-1] < 1 << 24 and rank.max() < 1 << 39:
        within = np.where(rank > 0, rank.astype(np.uint64) | np.uint64(1 << 39), code >> np.uint64(25))
        key = (number.astype(np.uint64) << np.uint64(40)) | within
        by = np.argsort(key)
        key, sorted_code = key[by], code[by]
        same_key, same = key[1:] == key[:-1], sorted_code[1:] == sorted_code[:-1]
        if not (same_key & ~same).any():
            return sorted_code, np.append(True, ~same_key)
    by = np.lexsort((code, rank, number))
    number, code = number[by], code[by]
    return code, np.append(True, (number[1:] != number[:-1]) | (code[1:] != code[:-1]))[: len(code)]


def _cached_sets(texts: list[bytes], order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What ``line_sets`` gives, for about ``CACHED_BYTES`` of texts after another."""
    table = _rank_table(order)
    for begin, end in by_bytes(texts, CACHED_BYTES):
        text, line, code, words = line_words(texts[begin:end])
        if not len(text):
            continue
        code, keep = _sorted_words(np.repeat(np.arange(len(words)), words), _ranks(code, table), code)
        yield text + begin, line, np.add.reduceat(keep, np.cumsum(words) - words, dtype=np.int64), code[keep]


def line_sets(texts: list[bytes], order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word as (text, line number, words), and their distinct word codes, rarest first, one line
    after another. ``order`` has the codes of frequent words, rarest first; others come before them by code.
    """
    none = np.zeros(0, np.int64)
    text, line, size, codes = zip((none, none, none, NO_WORDS), *_cached_sets(texts, order))
    return np.concatenate(text), np.concatenate(line), np.concatenate(size), np.concatenate(codes)


def _texts(column: pa.Array) -> list[bytes]:
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches with about ``PART_BYTES`` of text, and those texts as bytes."""
    for batch in batches:
        texts = _texts(batch.column(column))
        for begin, end in by_bytes(texts, PART_BYTES):
            yield batch.slice(begin, end - begin), texts[begin:end]


def frequent_words(docs: DataFrame, text: str, most: int) -> tuple[np.ndarray, int]:
    """Codes of the ``most`` words met most often, rarest first, and the bytes of all texts.

    Words met once in a part of a task count as rare.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            codes, of = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return codes, np.bincount(of, np.concatenate([n for _, n in held]), len(codes)).astype(np.int64)

        for _, texts in _parts(batches, 0):
            total += sum(map(len, texts))
            part = [line_words(texts[begin:end])[2] for begin, end in by_bytes(texts, CACHED_BYTES)]
            codes, n = np.unique(np.concatenate(part), return_counts=True)
            held.append((codes[n > 1], n[n > 1]))
            if sum(len(c) for c, _ in held) > MOST_COUNTED:
                yield _counts(*summed())
                held = []
        if held:
            yield _counts(*summed())
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([total])], names=["code", "n"])

    counted = docs.select(text).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.col("code").isNull().desc(), F.desc("n"), "code").limit(most + 1).collect()
    total = top[0]["n"] if top else 0
    return np.array([r["code"] for r in reversed(top[1:])], np.int64).view(np.uint64), total


def _counts(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n)], names=["code", "n"])


def _prefix(size: np.ndarray, p: int, q: int) -> np.ndarray:
    """Words of a set of which a partner with p * intersection >= q * union shares one at least."""
    return size - -(-q * size // p) + 1


def _parity(codes: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
    """128 bits a line, each the parity of the words that hash to it: sets differ in as many words as bits, or more.

    ``codes`` has one line after another, of ``size`` words each; all are of one line by default.
    """
    size = np.array([len(codes)]) if size is None else size
    bit = mixed(codes) >> np.uint64(57)
    starts = np.cumsum(size) - size
    out = np.zeros((len(size), len(PARITY)), np.uint64)
    for k in range(len(PARITY)):
        one = np.where(bit >> np.uint64(6) == k, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
        out[:, k] = np.bitwise_xor.reduceat(one, starts) if len(starts) else 0
    return out.view(np.int64)


def _prefixes(size: np.ndarray, codes: np.ndarray, own: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For some lines, how many postings each has, and the place and code of each posting."""
    starts = np.cumsum(size) - size
    n = _prefix(size[own], p, q)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return n, at, mixed(codes[np.repeat(starts[own], n) + at])


def hot_tokens(docs: DataFrame, text: str, order: np.ndarray, p: int, q: int, least: int, sample: int = SAMPLE) -> np.ndarray:
    """Sorted codes of the longest posting lists, of more than about ``least`` lines.

    Counted on a hashed sample of the texts and on all long ones. It only decides how work is split, not results.
    """
    long = F.octet_length(text) > LONG_TEXT
    weight = F.when(long, 1).otherwise(sample).cast("long")
    some = docs.where(long | (F.pmod(F.xxhash64(text, F.lit(9)), F.lit(sample)) == 0)).select(weight, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _parts(batches, 1):
            which, _, size, codes = line_sets(texts, order)
            n, _, flat = _prefixes(size, codes, np.arange(len(size)), p, q)
            each = np.repeat(batch.column(0).to_numpy()[which], n)
            token, of = np.unique(flat, return_inverse=True)
            total = np.bincount(of, each, len(token)).astype(np.int64)
            yield _counts(token, total)

    counted = some.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    top = counted.orderBy(F.desc("n"), "code").limit(MOST_HOT).collect()
    return np.sort(np.array([r["code"] for r in top], np.int64).view(np.uint64))


def _entries(
    docs: DataFrame, text: str, id_column: str, shards: int, order: np.ndarray, p: int, q: int, hot: np.ndarray = NO_WORDS
) -> DataFrame:
    """Postings of all lines in packed rows (shard, kind, arrays).

    Kind 0 names lines that repeat one of their part, kind 2 holds postings of the lists ``hot``, with 64-bit
    tokens; each part has a shard of its own for these.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for part_of_task, (batch, texts) in enumerate(_parts(batches, 1)):
            cached = []
            for which, line, size, codes in _cached_sets(texts, order):
                starts = np.cumsum(size) - size
                names = [np.add.reduceat(mixed(codes ^ np.uint64(salt)), starts) for salt in (0x51, 0xA7)]  # of whole sets
                cached.append((which, line, size, *names, _parity(codes, size), *_prefixes(size, codes, np.arange(len(size)), p, q)))
            if not cached:
                continue
            which, line, size, *names, parity, n, at, flat = map(np.concatenate, zip(*cached, strict=True))
            doc = batch.column(0).to_numpy(zero_copy_only=False)[which]
            by = np.lexsort((line, doc, names[1], names[0]))
            new = np.append(True, (names[0][by][1:] != names[0][by][:-1]) | (names[1][by][1:] != names[1][by][:-1]))
            first = by[np.flatnonzero(new)][np.cumsum(new) - 1]
            again = ~new & ((doc[by] != doc[first]) | (line[by] != line[first]))
            if again.any():
                yield _packed([(task + part_of_task, np.stack([doc[by][again], line[by][again]], axis=1))], 0)
            own = np.sort(by[new])
            posted = np.repeat(np.isin(np.arange(len(n)), own), n)
            n, at, flat, parity = n[own], at[posted], flat[posted], parity[own]
            whole = (names[0][own] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            own_columns = {"doc": doc[own], "line": line[own], "size": size[own], "whole": whole} | dict(zip(PARITY, parity.T, strict=True))
            of = np.repeat(np.arange(len(own)), n)

            def postings(some: np.ndarray, own_columns=own_columns, of=of, flat=flat, at=at) -> dict[str, np.ndarray]:
                token = (flat[some] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                columns = {"token": token, "at": at[some]} | {name: values[of[some]] for name, values in own_columns.items()}
                return {name: columns[name].astype(POSTING[name]) for name in POSTING.names}

            short = np.ones(len(flat), bool)
            if len(hot):
                short = hot[np.minimum(np.searchsorted(hot, flat), len(hot) - 1)] != flat
                if not short.all():
                    long = np.flatnonzero(~short)
                    out = np.zeros(len(long), POSTING)
                    for name, values in postings(long).items():
                        out[name] = values
                    wide = np.concatenate([flat[long].astype("<u8").view(np.uint8), out.view(np.uint8)])
                    yield _packed([(task + part_of_task, wide)], 2)
            some = np.flatnonzero(short)
            shard = (flat[some] % np.uint64(shards)).astype(np.int64)
            by = np.argsort(shard)
            shard, columns = shard[by], postings(some[by])
            starts = np.flatnonzero(np.diff(shard, prepend=-1))
            ends = [*starts[1:].tolist(), len(shard)]
            if len(shard):
                parts = [(int(shard[a]), {name: v[a:b] for name, v in columns.items()}) for a, b in zip(starts.tolist(), ends, strict=True)]
                yield _packed(parts, 1)

    return docs.select(F.col(id_column).cast("long"), text).mapInArrow(post, "shard long, kind int, packed binary")


#: Columns of a posting: token, document, line, words, parity bits, code of the whole set, place in the prefix.
PARITY = ("p0", "p1")
POSTING = np.dtype(
    [("token", "<i4"), ("doc", "<i8"), ("line", "<i4"), ("size", "<i4"), *((p, "<i8") for p in PARITY), ("whole", "<i4"), ("at", "<i4")]
)


def _packed(parts: list[tuple[int, np.ndarray | dict[str, np.ndarray]]], kind: int) -> pa.RecordBatch:
    blobs = [rows.tobytes() if kind != 1 else b"".join(rows[name].tobytes() for name in POSTING.names) for _, rows in parts]
    return pa.RecordBatch.from_arrays(
        [pa.array([s for s, _ in parts], pa.int64()), pa.array([kind] * len(parts), pa.int32()), pa.array(blobs, pa.binary())],
        names=["shard", "kind", "packed"],
    )


def _unpacked(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """The columns of packed postings."""
    out: dict[str, list[np.ndarray]] = {name: [] for name in POSTING.names}
    for blob in blobs:
        n, begin = len(blob) // POSTING.itemsize, 0
        for name in POSTING.names:
            out[name].append(np.frombuffer(blob, POSTING[name], n, begin))
            begin += n * POSTING[name].itemsize
    return {name: np.concatenate(parts) for name, parts in out.items()}


#: Posting lists up to this length are compared in one go; links of longer ones are summed up after as many offsets,
#: and after so many links, so that a list of near copies is not held pair by pair.
SHORT_LIST, MOST_LINKS = 64, 2_000_000


def _labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least reachable number of each of ``n``, over links x - y."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _passing(p: int, q: int, size: np.ndarray, at: np.ndarray, parity: list[np.ndarray], line_of: np.ndarray):
    def passed(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that may be similar enough, and in how many parity bits those differ."""
        a, b = size[i].astype(np.int64), size[j].astype(np.int64)
        left = np.minimum(a - at[i], b - at[j]) + np.minimum(at[i], at[j])
        ok = (p * np.minimum(a, b) >= q * np.maximum(a, b)) & ((p + q) * left >= q * (a + b))
        i, j, both = i[ok], j[ok], (a + b)[ok]
        differ = np.zeros(len(i), np.int64)
        for word in parity:
            differ += np.bitwise_count(word[i] ^ word[j])
        ok = ((p + q) * differ <= (p - q) * both) & (line_of[i] != line_of[j])
        return i[ok], j[ok], differ[ok]

    return passed


def _nearest(
    p: int, q: int, token: np.ndarray, size: np.ndarray, at: np.ndarray, parity: list[np.ndarray], line_of: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For postings ordered by line: those with candidates before them in their list, the best of these, in how many
    parity bits it differs, and for all the least posting that candidates join to each.

    A list is ordered by size and compared offset by offset, all lists at once; a line leaves when the next one
    before it is too small, as are all the others then.
    """
    n = len(token)
    by = np.argsort(token.astype(np.int64) << 32 | size)
    passed = _passing(p, q, size[by], at[by], [word[by] for word in parity], line_of[by])
    sizes = size[by].astype(np.int64)
    first = np.append(True, np.diff(token[by]) != 0)
    place = np.arange(n) - np.flatnonzero(first)[np.cumsum(first) - 1]
    none = np.iinfo(np.int64).max
    best = np.full(n, none)
    links, held = [], 0
    later, back = np.flatnonzero(place > 0), 1
    while len(later):
        x, y, differ = passed(later, later - back)
        if len(x):
            i, j = np.maximum(by[x], by[y]), np.minimum(by[x], by[y])
            np.minimum.at(best, i, differ << 40 | j)
            links.append(np.stack([i, j]))
            held += len(i)
        if held and (held > MOST_LINKS or back % SHORT_LIST == 0):
            label = _labels(n, *np.concatenate(links, axis=1))
            i = np.flatnonzero(label != np.arange(n))
            links, held = [np.stack([i, label[i]])], 0
        back += 1
        later = later[place[later] >= back]
        later = later[p * sizes[later - back] >= q * sizes[later]]
    label = _labels(n, *np.concatenate([np.zeros((2, 0), np.int64), *links], axis=1))
    i = np.flatnonzero(best != none)
    return i, best[i] & ((1 << 40) - 1), best[i] >> 40, label


def _candidates(p: int, q: int):
    """For a shard, rows (doc, line, doc0, line0, differ) of three kinds.

    Lines equal to an earlier one have null in doc0. Lines with candidates have the best of each posting list
    as doc0, line0. Lines that candidates join in a posting list share the code of a cluster, with line0 = -1.
    """

    def find(key: int, table: pa.Table) -> pa.Table:
        rows = _unpacked([b.as_py() for b in table.column("packed")])
        signed = mixed(rows["token"].astype(np.uint64) << np.uint64(32) | rows["whole"].view(np.uint32))
        signed = mixed(signed ^ (rows["size"].astype(np.uint64) << np.uint64(32) | rows["at"].astype(np.uint64)))
        for word in PARITY:
            signed = mixed(signed ^ rows[word].view(np.uint64))
        by = np.argsort(signed)
        rows = {name: values[by] for name, values in rows.items()}
        signed, doc, line = signed[by], rows["doc"], rows["line"]
        # Equal sets, told by their size, parities and code, meet at their first word; the first stands for all.
        new = np.append(True, signed[1:] != signed[:-1])
        of, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        first = doc == np.minimum.reduceat(doc, starts)[of]
        first &= line == np.minimum.reduceat(np.where(first, line, np.iinfo(np.int32).max), starts)[of]
        again = ~first & (rows["at"] == 0)
        one = np.flatnonzero(first)
        one = one[np.append(True, np.diff(of[one]) != 0)]
        one = one[np.lexsort((line[one], doc[one]))]
        token, size, at, *parity = (rows[name][one] for name in ("token", "size", "at", *PARITY))
        parity = [word.view(np.uint64) for word in parity]
        line_of = np.cumsum(np.append(False, (np.diff(doc[one]) != 0) | (np.diff(line[one]) != 0)))

        i, j, differ, label = _nearest(p, q, token, size, at, parity, line_of)
        joined = np.bincount(label, minlength=len(one))[label] > 1
        cluster = mixed(token.astype(np.uint64) ^ mixed(np.uint64(key) + mixed(label.astype(np.uint64)))).view(np.int64)
        a, b, c = ({name: rows[name][at] for name in ("doc", "line")} for at in (one[i], one[j], one[joined]))
        sizes = [int(again.sum()), len(i), len(c["doc"])]
        doc = np.concatenate([rows["doc"][again], a["doc"], c["doc"]])
        line = np.concatenate([rows["line"][again], a["line"], c["line"]]).astype(np.int64)
        doc0 = np.concatenate([np.zeros(sizes[0], np.int64), b["doc"], cluster[joined]])
        line0 = np.concatenate([np.zeros(sizes[0], np.int64), b["line"], np.full(sizes[2], -1)]).astype(np.int64)
        differ = np.concatenate([np.zeros(sizes[0], np.int64), differ, np.zeros(sizes[2], np.int64)])
        return pa.table({
            "doc": doc, "line": line, "doc0": pa.array(doc0, mask=np.arange(len(doc)) < sizes[0]), "line0": line0, "differ": differ,
        })

    return find


def _hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed postings of long lists as rows."""
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            n = len(blob) // (8 + POSTING.itemsize)
            token, rows = np.frombuffer(blob, "<i8", n), np.frombuffer(blob, POSTING, n, 8 * n)
            for begin in range(0, n, 1 << 16):
                part = rows[begin : begin + (1 << 16)]
                columns = [pa.array(token[begin : begin + len(part)])] + [pa.array(np.ascontiguousarray(part[c])) for c in POSTING.names[1:]]
                yield pa.RecordBatch.from_arrays(columns, names=["token", *POSTING.names[1:]])


def _hot_candidates(p: int, q: int):
    """For a pair of blocks of long posting lists, the same links and clusters as ``_candidates``; all sets are distinct."""

    def find(table: pa.Table) -> pa.Table:
        names = ("token", "doc", "line", "size", "at", *PARITY)
        token, doc, line, size, at, *parity = (table.column(c).to_numpy() for c in names)
        earlier = np.empty(len(doc), np.int64)
        earlier[np.lexsort((line, doc))] = np.arange(len(doc))
        line_of = np.rec.fromarrays([doc, line], names="doc,line").view(np.ndarray)
        passed = _passing(p, q, size, at.astype(np.int64), [word.view(np.uint64) for word in parity], line_of)
        cell = [table.column(c)[0].as_py() if len(doc) else 0 for c in ("_i", "_j")]
        rows = []
        for mine, others in groups_of(table, ["token"]):
            same = mine is others
            both = mine if same else np.concatenate([mine, others])
            both = both[np.argsort(earlier[both])]
            place = np.zeros(len(doc), np.int64)
            place[both] = np.arange(len(both))
            best, least = np.full(len(both), -1), np.full(len(both), np.iinfo(np.int64).max)
            label = np.arange(len(both))
            for k, i in enumerate(both.tolist()) if same else ((place[i], i) for i in mine.tolist()):
                right = both[:k] if same else others
                _, j, differ = passed(np.full(len(right), i), right)
                if not len(j):
                    continue
                j = place[j]
                late = j > k
                closer = j[late][differ[late] < least[j[late]]]
                least[closer], best[closer] = differ[late][differ[late] < least[j[late]]], k
                if not late.all():
                    near = np.argmin(differ[~late])
                    if differ[~late][near] < least[k]:
                        least[k], best[k] = differ[~late][near], j[~late][near]
                low = min(label[k], label[j].min())
                if label[k] != low or (label[j] != low).any():
                    label[np.isin(label, np.append(label[j], label[k]))] = low
            linked = np.flatnonzero(best >= 0)
            joined = np.flatnonzero(np.bincount(label, minlength=len(both))[label] > 1)
            name = mixed(mixed(token[both[:1]].view(np.uint64) ^ np.uint64(0xC3)) + np.uint64(cell[0] << 32 | cell[1]))
            cluster = mixed(name ^ mixed(label[joined].astype(np.uint64))).view(np.int64)
            a, b, c = both[linked], both[best[linked]], both[joined]
            rows.append((doc[a], line[a], doc[b], line[b], least[linked]))
            rows.append((doc[c], line[c], cluster, np.full(len(c), -1), np.zeros(len(c), np.int64)))
        out = [np.concatenate([r[k] for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64) for k in range(5)]
        return pa.table(dict(zip(("doc", "line", "doc0", "line0", "differ"), out, strict=True)))

    return find


def _hot_lists(packed: DataFrame, p: int, q: int, block: int) -> DataFrame:
    """What ``_candidates`` gives, for long posting lists: pairs of their blocks are tasks, equal sets are one before."""
    names = [c for c in POSTING.names if c not in ("doc", "line")]
    types = {"<i4": "int", "<i8": "long"}
    schema = ", ".join(["token long", *(f"{c} {types[POSTING[c].str]}" for c in POSTING.names[1:])])
    rows = packed.mapInArrow(_hot_rows, schema)
    distinct = stored(rows.groupBy(*names).agg(F.min(F.struct("doc", "line")).alias("first")).select(*names, "first.*"))
    first = distinct.where("at = 0").select(*names, F.col("doc").alias("doc0"), F.col("line").alias("line0"))
    again = rows.where("at = 0").join(first, names).where("doc != doc0 or line != line0")
    none = F.lit(None).cast("long")
    exact = again.select("doc", F.col("line").cast("long").alias("line"), none.alias("doc0"), none.alias("line0"), none.alias("differ"))
    cells = blocked(distinct.withColumn("id", F.xxhash64("doc", "line")), ["token"], "id", block=block, shard_rows=4 * block)
    near = cells.groupBy("_cell", "_i", "_j").applyInArrow(_hot_candidates(p, q), "doc long, line long, doc0 long, line0 long, differ long")
    return stored(exact.union(near))


def _settle(p: int, q: int):
    """For a cluster cell: undecided lines with an earlier line that is similar enough."""

    def find(table: pa.Table) -> pa.Table:
        doc, line = table.column("doc").to_numpy(), table.column("line").to_numpy()
        undecided = table.column("undecided").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(c.as_buffer(), np.uint64) for c in table.column("codes")]
        size = np.array([len(c) for c in sets], np.int64)
        parity = _parity(np.concatenate([NO_WORDS, *sets]), size).view(np.uint64)
        found = set()
        for left, right in groups_of(table, ["cluster"]):
            for mine, other in [(left, right)] if left is right else [(left, right), (right, left)]:
                for i in (i for i in mine.tolist() if undecided[i] and i not in found):
                    near = other[(doc[other] < doc[i]) | (doc[other] == doc[i]) & (line[other] < line[i])]
                    near = near[p * np.minimum(size[near], size[i]) >= q * np.maximum(size[near], size[i])]
                    differ = np.bitwise_count(parity[near] ^ parity[i]).sum(axis=1, dtype=np.int64)
                    for j in near[(p + q) * differ <= (p - q) * (size[near] + size[i])].tolist():
                        n = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if p * n >= q * (size[i] + size[j] - n):
                            found.add(i)
                            break
        at = np.array(sorted(found), np.int64)
        return pa.table({"doc": doc[at], "line": line[at]})

    return find


def repeated_lines(
    docs: DataFrame, above: tuple[int, int] = (10, 8), text: str = "text", id_column: str = "doc_id", frequent: int = FREQUENT
) -> DataFrame:
    """(doc, line) of every line that ``_repeated_lines`` finds, each once."""
    return _repeated_lines(docs, above, text, id_column, frequent).distinct()


def _repeated_lines(docs: DataFrame, above: tuple[int, int], text: str, id_column: str, frequent: int) -> DataFrame:
    """(doc, line), once or more, of every line with an earlier line at p * intersection >= q * union of their word sets.

    Earlier is a smaller (id, line number); lines are judged on the input, whether or not the earlier one
    is removed itself. Words are ordered by rarity; each line is posted under its prefix. In a posting
    list, length, position and a 128-bit parity sketch (which never drops a true pair) leave the
    candidates; each line's best one is verified on full sets. Lists of more than about ``HOT_LIST`` lines
    are cut into blocks, and pairs of blocks are tasks. Lines that this leaves undecided are
    compared with all earlier ones that candidates join to them in a posting list. Equal sets are told by
    size, parities and a 32-bit code (wrong for a near pair with a chance below 1 in 10^11).
    """
    p, q = above
    rows = docs.where(F.col(id_column).isNotNull())
    order, total = frequent_words(rows, text, frequent)
    shards = max(8, total // SHARD_TEXT + 1)
    hot = hot_tokens(rows, text, order, p, q, HOT_LIST)
    entries = _entries(rows, text, id_column, shards, order, p, q, hot)
    candidates = _candidates(p, q)

    def find(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind = key[1].as_py()
        if kind == 2:
            none = pa.nulls(len(table), pa.int64())
            return pa.table({c: none for c in ("doc", "line", "doc0", "line0", "differ")} | {"packed": table.column("packed")})
        out = candidates(key[0].as_py(), table) if kind else _repeats(table)
        return out.append_column("packed", pa.nulls(len(out), pa.binary()))

    found = stored(
        entries.groupBy("shard", "kind").applyInArrow(find, "doc long, line long, doc0 long, line0 long, differ long, packed binary")
    )
    packed = found.where("packed is not null").select("packed")
    found = found.where("packed is null").drop("packed")
    if len(hot):
        found = found.union(_hot_lists(packed, p, q, HOT_LIST))
    exact = found.where("doc0 is null").select("doc", "line")
    members = found.where("line0 = -1").select("doc", "line", F.col("doc0").alias("cluster"))
    links = (
        found.where("doc0 is not null and line0 >= 0")
        .groupBy("doc", "line")
        .agg(F.min(F.struct("differ", "doc0", "line0")).alias("best"))
        .select("doc", "line", "best.doc0", "best.line0")
    )
    wanted = members.groupBy("doc").agg(F.collect_set("line").alias("lines"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _parts(batches, 1):
            some = batch.column(2)
            asked = np.repeat(np.arange(len(texts)), pa.compute.list_value_length(some).to_numpy()) << 40
            asked |= some.flatten().to_numpy()
            which, line, size, codes = line_sets(texts, NO_WORDS)
            wanted = np.flatnonzero(np.isin((which << 40) | line, asked))
            ends = np.cumsum(size)
            blobs = [codes[ends[k] - size[k] : ends[k]].tobytes() for k in wanted.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which[wanted])), pa.array(line[wanted]), pa.array(blobs, pa.binary())],
                names=["doc", "line", "codes"],
            )

    joined = rows.select(F.col(id_column).cast("long").alias("doc"), F.col(text).alias("text")).join(wanted.hint("shuffle_hash"), "doc")
    sets = stored(joined.select("doc", "text", "lines").mapInArrow(sets_of, "doc long, line long, codes binary").dropDuplicates(["doc", "line"]))
    second = sets.select(F.col("doc").alias("doc0"), F.col("line").alias("line0"), F.col("codes").alias("codes0"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = []
            flat = []
            for column in (4, 5):
                many.append(pa.compute.binary_length(batch.column(column)).to_numpy() // 8)
                flat.append(np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint64))
            pair = np.concatenate([np.repeat(np.arange(len(batch)), n) for n in many])
            code = np.concatenate(flat)
            order = np.lexsort((code, pair))
            pair, code = pair[order], code[order]
            common = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (code[1:] == code[:-1])], minlength=len(batch))
            keep = p * common >= q * (many[0] + many[1] - common)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keep)], names=["doc", "line", "similar"])

    pairs = links.join(sets, ["doc", "line"]).join(second, ["doc0", "line0"]).select("doc", "line", "doc0", "line0", "codes", "codes0")
    verified = stored(pairs.mapInArrow(verify, "doc long, line long, similar boolean"))
    true = verified.where("similar").select("doc", "line")
    undecided = verified.where("not similar").select("doc", "line", F.lit(True).alias("undecided"))
    if undecided.isEmpty():
        return exact.union(true)
    members = (
        members.join(members.join(undecided, ["doc", "line"]).select("cluster").distinct(), "cluster", "left_semi")
        .join(undecided, ["doc", "line"], "left")
        .fillna(False, ["undecided"])
        .withColumn("id", F.xxhash64("doc", "line"))
    )
    cells = blocked(stored(members), ["cluster"], "id", block=512, shard_rows=4096).join(sets, ["doc", "line"])
    rest = cells.groupBy("_cell", "_i", "_j").applyInArrow(_settle(p, q), "doc long, line long")
    return exact.union(true).union(rest)


def _repeats(table: pa.Table) -> pa.Table:
    rows = np.concatenate([np.frombuffer(b.as_py(), np.int64).reshape(-1, 2) for b in table.column("packed")])
    none = pa.nulls(len(rows), pa.int64())
    return pa.table({"doc": rows[:, 0], "line": rows[:, 1], "doc0": none, "line0": none, "differ": none})


def drop_repeated_lines(
    docs: DataFrame, above: tuple[int, int] = (10, 8), text: str = "text", id_column: str = "doc_id", frequent: int = FREQUENT
) -> DataFrame:
    """``docs`` without ``repeated_lines`` in ``text``, and ``n_removed_lines``.

    Lines without words stay. A document all of whose lines go keeps an empty text. A null text or id
    stays as it is. Rows with one id are one document: a line number that repeats goes in all of them.
    Columns whose names clash with the added one are replaced. An empty table stays empty.
    """
    gone = _repeated_lines(docs, above, text, id_column, frequent).groupBy("doc").agg(F.collect_set("line").alias("_gone"))
    rows = docs.drop("n_removed_lines") if text != "n_removed_lines" else docs
    joined = rows.join(gone.hint("shuffle_hash"), F.col(id_column).cast("long") == F.col("doc"), "left").drop("doc")
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("_gone", i.cast("long")))
    return (
        joined.withColumn("n_removed_lines", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
        .withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
        .drop("_gone")
    )


def op8_line_dedup(spark, folder: str) -> DataFrame:
    """All documents without later near-duplicate lines."""
    return drop_repeated_lines(documents(spark, folder).select("doc_id", "text"))
