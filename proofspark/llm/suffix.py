"""Repeated byte strings across documents, found in suffix arrays built by induced sorting."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofspark.llm.common import by_bytes, documents, mixed, shard_count, stored

#: Bytes of a gram; every string of the wanted length holds a chosen one.
GRAM = 16
#: Bytes of text that one shard stands for; a suffix array takes about 100 bytes a character.
SHARD_TEXT = 2 << 20
#: Anchors of more than about so many texts don't gather in a shard; how many of them are told to all tasks.
HOT_ANCHOR, MOST_HOT = 4096, 100_000
#: One in so many texts is asked for such anchors, and each one beyond so many characters.
SAMPLE, LONG_TEXT = 16, 1 << 16
#: Bytes of text whose grams are held at once, and strings of a segment at most.
PART_BYTES, MOST_STRINGS = 1 << 20, 64


def grams(data: bytes) -> np.ndarray:
    """A 64-bit code of the ``GRAM`` bytes from each position on."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    return mixed(words[:n] ^ mixed(words[8 : 8 + n]))


def _least(x: np.ndarray, width: int, worse) -> np.ndarray:
    """``worse``-reduced windows of ``width`` values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = worse(x[:-step], x[step:])
        have += step
    return x


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, codes) of the grams with the least code of some window of ``length`` bytes.

    Which grams are chosen depends on the window's bytes alone, so equal strings of ``length`` bytes
    hold equal chosen grams at equal places.
    """
    codes = grams(data)
    width = length - GRAM + 1
    if len(codes) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = _least(codes, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    best = _least(np.concatenate([pad, low, pad]), width, np.maximum)
    at = np.flatnonzero(codes == best)
    return at, codes[at]


def segments_of(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in all texts joined, strings, code) of runs of strings of ``length`` bytes, and all grams' codes.

    The neighbouring strings of a run have one least gram code; each string of each text is in one run. That code
    depends on the string alone, so equal strings are in runs of one code.
    """
    data = b"".join(texts)
    codes = grams(data)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    width = length - GRAM + 1
    if len(codes) < width:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), codes
    low = _least(codes, width, np.minimum)
    new = np.append(True, low[1:] != low[:-1])
    for edge in (ends - sizes, np.maximum(ends - sizes, ends - length + 1)):  # the first string, and the first that would cross
        new[edge[edge < len(low)]] = True
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(low)))
    cuts = -(-many // MOST_STRINGS)
    step = (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * MOST_STRINGS
    at, many = np.repeat(at, cuts) + step, np.minimum(np.repeat(many, cuts) - step, MOST_STRINGS)
    text = np.searchsorted(ends, at, side="right")
    inside = at + length <= ends[text]
    at = at[inside]
    return text[inside], at, many[inside], low[at], codes


def _string_codes(codes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit codes of the strings of ``length`` bytes at some places, from the codes of all grams."""
    out = np.zeros(len(at), np.uint64)
    for k in [*range(0, length - GRAM, GRAM), length - GRAM]:
        out = mixed(out ^ codes[at + k])
    return out


def _ranges(begins: np.ndarray, many: np.ndarray) -> np.ndarray:
    """``many`` numbers from each of ``begins`` on."""
    return np.arange(many.sum()) + np.repeat(begins - (np.cumsum(many) - many), many)


def _scatter(pending: list[list[np.ndarray]], at: np.ndarray, t: np.ndarray) -> None:
    """Appends positions to their first character's bucket, in order."""
    if len(at):
        chars = t[at]
        order = np.argsort(chars, kind="stable")
        at, chars = at[order], chars[order]
        cuts = np.flatnonzero(np.diff(chars)) + 1
        for part, c in zip(np.split(at, cuts), chars[np.append(0, cuts)].tolist(), strict=True):
            pending[c].append(part)


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _sorted_lms(t: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """Leftmost-smaller positions ordered by what follows, up to ``depth`` characters.

    Substrings between neighbouring positions are named by rank; then the string of names is sorted in
    turn: pairs of names get new names, twice as deep each time, until all differ or are deep enough.
    """
    gap = np.diff(np.append(lms, len(t)))
    padded = np.concatenate([t, np.zeros(depth + 8, t.dtype)]).astype(np.uint64)
    name = np.zeros(len(lms), np.int64)
    for begin in range(0, min(depth, int(gap.max(initial=0)) + 1), 7):
        word = np.zeros(len(lms), np.uint64)
        for k in range(7):
            inside = begin + k <= gap
            word = word * np.uint64(261) + np.where(inside, padded[lms + begin + k], np.uint64(260))  # an end is larger
        ids = np.unique(word, return_inverse=True)[1]
        name = np.unique(name * (int(ids.max(initial=0)) + 1) + ids, return_inverse=True)[1]
    reach = 1
    covered = gap.copy()
    while len(lms) and name.max() + 1 < len(name) and covered.min(initial=depth) < depth and reach < len(lms):
        follow = np.append(name[reach:] + 1, np.zeros(min(reach, len(name)), np.int64))
        name = np.unique(name * (int(name.max()) + 2) + follow, return_inverse=True)[1]
        covered = covered + np.append(covered[reach:], np.full(min(reach, len(name)), depth))
        reach *= 2
    return lms[np.argsort(name, kind="stable")]


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``t`` (characters 0 to 257, 0 at the end alone) in the order of their suffixes.

    Suffixes that agree in ``depth`` characters are neighbours in any order. Induced sorting: suffixes are
    classed as larger (L) or smaller (S) than their right neighbour; the leftmost S of each run is sorted;
    from these, one pass up the buckets places all L, one pass down all S. A pass takes a bucket at a time:
    what it holds names its left neighbours, which go to the ends of their buckets.
    """
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int16), append=-1))
    known = np.where(step != 0, np.arange(n), n)
    after = np.minimum.accumulate(known[::-1])[::-1]
    small = np.append(step, -1)[after] > 0
    small[-1] = True
    lms = np.flatnonzero(small & np.append(False, ~small[:-1]))
    size = 258
    seeds: list[list[np.ndarray]] = [[] for _ in range(size)]
    _scatter(seeds, _sorted_lms(t, lms, depth), t)
    large: list[list[np.ndarray]] = [[] for _ in range(size)]
    for c in range(size):
        done, now = [], _join(large[c])
        while len(now):
            done.append(now)
            left = now[now > 0] - 1
            left = left[~small[left]]
            same = t[left] == c
            _scatter(large, left[~same], t)
            now = left[same]
        large[c] = done
        seed = _join(seeds[c])
        left = seed[seed > 0] - 1
        _scatter(large, left[~small[left]], t)
    lesser: list[list[np.ndarray]] = [[] for _ in range(size)]
    lesser[0].append(np.array([n - 1]))
    out: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):
        done, now = [], _join(lesser[c])
        while len(now):
            done.append(now)
            left = now[now > 0] - 1
            left = left[small[left]]
            same = t[left] == c
            _scatter(lesser, left[~same], t)
            now = left[same]
        own = _join(large[c])[::-1]
        left = own[own > 0] - 1
        _scatter(lesser, left[small[left]], t)
        out.append(_join([*done, own]))
    return np.concatenate(out)[::-1]


def _same(data: bytes, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether ``length`` bytes agree at two places."""
    words = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    equal = np.ones(len(a), bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        equal &= words[a + k] == words[b + k]
    return equal


def least_owners(segments: list[bytes], owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, offset, least owner of a segment that holds it) of each string of ``length`` bytes.

    One suffix array over all segments; neighbours whose common prefix (permuted back to text order)
    has ``length`` characters hold one string, and the least owner of such a run owns it.
    """
    joined = b"\xff".join(segments) + b"\xff"  # no byte of UTF-8
    t = np.append(np.frombuffer(joined, np.uint8).astype(np.int16) + 2, np.int16(0))
    t[t == 257] = 1
    lengths = np.array([len(s) for s in segments]) + 1
    lengths[-1:] += 1
    begins = np.cumsum(lengths) - lengths
    segment = np.repeat(np.arange(len(segments)), lengths)
    room = np.repeat(begins + np.array([len(s) for s in segments]), lengths) - np.arange(len(t))
    order = suffix_array(t, length)
    order = order[room[order] >= length]
    if not len(order):
        return (np.zeros(0, np.int64),) * 3
    before = np.full(len(t), -1)  # the left neighbour of each place
    before[order[1:]] = order[:-1]
    plcp = np.zeros(len(t), bool)  # in text order: as long a prefix in common with it
    places = np.flatnonzero(before >= 0)
    plcp[places] = _same(joined, places, before[places], length)
    run = np.cumsum(~plcp[order]) - 1
    owner = owners[segment[order]]
    least = np.minimum.reduceat(owner, np.flatnonzero(~plcp[order]))
    return segment[order], order - begins[segment[order]], least[run]


def _spans(doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, from, to) of the bytes that strings of ``length`` cover, merged."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    if not len(doc):
        return doc, start, start
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length))
    at = np.flatnonzero(new)
    return doc[at], start[at], start[np.append(at[1:], len(doc)) - 1] + length


def _met_twice(codes: np.ndarray) -> np.ndarray:
    """Which codes may be there more than once; those that are, surely."""
    bits = max(10, (4 * len(codes)).bit_length())
    some = np.arange(len(codes))
    for shift in (64 - bits, 0):
        slot = ((codes[some] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        some = some[np.bincount(slot, minlength=1 << bits)[slot] > 1]
    out = np.zeros(len(codes), bool)
    out[some] = True
    return out


def repeated_spans(
    pieces: pa.Array, which: np.ndarray, doc: np.ndarray, begin: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, from, to) of the strings of ``length`` bytes that a smaller document holds too.

    ``pieces`` are distinct segments; segment ``which`` is in ``doc`` at ``begin``. A place whose document isn't
    the segment's least goes whole. In the least document go the strings that another segment gives a lesser
    owner; only strings that may be in two segments are sorted for that.
    """
    offsets = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, 8 * pieces.offset)
    data = pieces.buffers()[2].to_pybytes() if len(pieces) else b""
    owners = np.full(len(pieces), np.iinfo(np.int64).max)
    np.minimum.at(owners, which, doc)
    size = np.diff(offsets)
    late = doc > owners[which]
    out = [(doc[late], begin[late], begin[late] + size[which[late]])]

    many = np.maximum(size - length + 1, 0)
    at, segment = _ranges(offsets[:-1], many), np.repeat(np.arange(len(many)), many)
    some = np.flatnonzero(_met_twice(_string_codes(grams(data), at, length))) if len(at) else at
    if len(some):
        at, segment = at[some], segment[some]
        first = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(segment) != 0)))
        last = np.append(first[1:], len(at)) - 1
        number: dict[bytes, int] = {}  # equal parts of segments are sorted once
        kind = np.array(
            [number.setdefault(data[a:b], len(number)) for a, b in zip(at[first].tolist(), (at[last] + length).tolist(), strict=True)]
        )
        owner = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(owner, kind, owners[segment[first]])
        of, offset, least = least_owners(list(number), owner, length)
        least = least[np.lexsort((offset, of))]
        strings = np.bincount(of, minlength=len(number))
        least = least[_ranges((np.cumsum(strings) - strings)[kind], strings[kind])]
        hit = least < owners[segment]
        seg, lo, hi = _spans(segment[hit], (at - offsets[segment])[hit], length)
        own = np.flatnonzero(~late)
        own = own[np.argsort(which[own], kind="stable")]
        places = np.searchsorted(which[own], np.arange(len(pieces) + 1))
        times = np.diff(places)[seg]
        place = own[_ranges(places[seg], times)]
        out.append((doc[place], begin[place] + np.repeat(lo, times), begin[place] + np.repeat(hi, times)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def hot_anchors(rows: DataFrame, length: int, least: int, sample: int = SAMPLE) -> np.ndarray:
    """Sorted codes of the anchors in most texts, of more than about ``least``.

    Counted on a hashed sample of the texts and on all long ones. It only decides how work is split, not results.
    """
    long = F.length("text") > LONG_TEXT
    weight = F.when(long, 1).otherwise(sample).cast("long")
    some = rows.where(long | (F.pmod(F.xxhash64("text", F.lit(9)), F.lit(sample)) == 0)).select(weight, "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.unique(anchors(v.as_py().encode("utf-8", "surrogatepass"), length)[1]) for v in batch.column(1)]
            each = np.repeat(batch.column(0).to_numpy(), [len(c) for c in codes])
            code, of = np.unique(np.concatenate([np.zeros(0, np.uint64), *codes]), return_inverse=True)
            total = np.bincount(of, each, len(code)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(total)], names=["code", "n"])

    counted = some.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    top = counted.orderBy(F.desc("n"), "code").limit(MOST_HOT).collect()
    return np.sort(np.array([r["code"] for r in top], np.int64).view(np.uint64))


def _text_parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches with about ``PART_BYTES`` of text, and those texts as bytes."""
    for batch in batches:
        texts = [v.encode("utf-8", "surrogatepass") for v in batch.column(column).to_pylist()]
        for begin, end in by_bytes(texts, PART_BYTES):
            yield batch.slice(begin, end - begin), texts[begin:end]


def repeated_bytes(docs: DataFrame, length: int = 50, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """For each document: id, n_bytes, n_removed, n_spans, kept_sha256 and the remaining bytes as ``kept``.

    A byte is removed if a string of ``length`` bytes over it also starts in a document with a smaller id,
    in the input. Equal texts are one, owned by the smallest id; its copies go whole. Texts are routed by
    anchors: the least gram of each string of ``length`` bytes. Anchors that only one text has are
    dropped (codes in packed rows, no text moves); for the others, the segment of the neighbouring strings of
    that anchor goes to the anchor's shard, where ``repeated_spans`` finds the strings. Strings of an anchor of
    very many texts go one by one to the shards of their own bytes.

    A null text is empty and has no bytes. Rows with a null id are returned whole: nothing is removed from
    them or owned by them. Rows that repeat an id are one document: they own nothing before each other,
    and spans found in one are removed from each. Other columns are left out; empty tables stay empty.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shards = shard_count(docs, text, size=SHARD_TEXT)
    hot = hot_anchors(rows.where("doc is not null"), length, HOT_ANCHOR)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for k, (_, texts) in enumerate(_text_parts(batches, 0)):
            text, _, _, code, _ = segments_of(texts, length)
            text_code = np.array([xxhash.xxh3_64_intdigest(d) for d in texts], np.uint64)[text]
            shard = (mixed(code) % np.uint64(shards)).astype(np.int64)
            shard[np.isin(code, hot)] = -1 - task - k  # known to be shared: a group a part
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            parts = [p for p in np.split(order, cuts) if len(p)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(shard[p[0]]) for p in parts], pa.int64()), pa.array([code[p].tobytes() for p in parts], pa.binary()),
                 pa.array([text_code[p].tobytes() for p in parts], pa.binary())],
                names=["shard", "codes", "texts"],
            )

    def shared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        code, own = (np.concatenate([np.frombuffer(b.as_buffer(), np.uint64) for b in table.column(c)]) for c in ("codes", "texts"))
        order = np.lexsort((own, code))
        code, own = code[order], own[order]
        run = np.append(True, code[1:] != code[:-1])
        other = np.append(False, (own[1:] != own[:-1]) & ~run[1:])
        several = np.logical_or.reduceat(other, np.flatnonzero(run))[np.cumsum(run) - 1] if len(code) else other
        several |= key[0].as_py() < 0
        code, own = code[several], own[several]
        order = np.argsort(own, kind="stable")
        code, own = code[order], own[order]
        at = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        ends = np.append(at, len(own))[1:]
        return pa.table({
            "text_code": pa.array(own[at].view(np.int64)),
            "codes": pa.array([code[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()),
        })

    packed = rows.where("doc is not null").select("text").mapInArrow(sketch, "shard long, codes binary, texts binary")
    wanted = packed.groupBy("shard").applyInArrow(shared, "text_code long, codes binary")
    wanted = stored(wanted.groupBy("text_code").agg(F.collect_list("codes").alias("codes")))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [v.as_py().encode("utf-8", "surrogatepass") for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for d in data]),
                 pa.array(np.array([xxhash.xxh3_64_intdigest(d) for d in data], np.uint64).view(np.int64))],
                names=["doc", "n_bytes", "sha", "text_code"],
            )

    described = stored(rows.mapInArrow(describe, "doc long, n_bytes long, sha string, text_code long"))
    firsts = described.where("doc is not null").groupBy("sha", "text_code").agg(F.min("doc").alias("first"))
    asked = firsts.join(wanted, "text_code").groupBy(F.col("first").alias("doc")).agg(F.flatten(F.collect_list("codes")).alias("codes"))
    asked = stored(rows.join(asked, "doc"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments in packed rows: distinct ones of a part and their sizes, and which one is where."""
        for batch, texts in _text_parts(batches, 1):
            text, at, many, code, codes = segments_of(texts, length)
            wanted = [b"".join(c) for c in batch.column(2).to_pylist()]
            of = np.repeat(np.arange(len(texts)), [len(w) // 8 for w in wanted]).astype(np.uint64)
            want = mixed(np.frombuffer(b"".join(wanted), np.uint64) ^ mixed(of))
            hit = np.isin(mixed(code ^ mixed(text.astype(np.uint64))), want)
            text, at, many, code = text[hit], at[hit], many[hit], code[hit]
            one = np.isin(code, hot)  # these go string by string, by their own bytes
            alone = _ranges(at[one], many[one])
            code = np.concatenate([code[~one], _string_codes(codes, alone, length)])
            text = np.concatenate([text[~one], np.repeat(text[one], many[one])])
            at, size = np.concatenate([at[~one], alone]), np.append(many[~one], np.ones(len(alone), np.int64)) + (length - 1)
            if not len(at):
                continue
            data = b"".join(texts)
            number: dict[bytes, int] = {}
            piece = np.array([number.setdefault(data[a:b], len(number)) for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)])
            sizes = np.array([len(t) for t in texts])
            doc, begin = batch.column(0).to_numpy()[text], at - (np.cumsum(sizes) - sizes)[text]
            shard = (mixed(code) % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((piece, shard))
            shard, piece, doc, begin, size = shard[order], piece[order], doc[order], begin[order], size[order]
            new = np.append(True, (piece[1:] != piece[:-1]) | (shard[1:] != shard[:-1]))
            which = np.cumsum(new) - 1
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            pieces = list(number)
            rows: list[list] = [[], [], [], [], [], []]
            for a, b in itertools.pairwise(cuts):
                some = new[a:b]
                values = (
                    int(shard[a]), doc[a:b].astype("<i8").tobytes(), begin[a:b].astype("<i8").tobytes(), (which[a:b] - which[a]).astype("<i4").tobytes(),
                    size[a:b][some].astype("<i8").tobytes(), b"".join([pieces[k] for k in piece[a:b][some].tolist()]),
                )
                for column, x in zip(rows, values, strict=True):
                    column.append(x)
            kinds = [pa.int64(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)

    def find(table: pa.Table) -> pa.Table:
        doc, begin, size = (np.frombuffer(b"".join(table.column(c).to_pylist()), "<i8") for c in ("docs", "begins", "sizes"))
        before = np.cumsum([0, *(len(b) // 8 for b in table.column("sizes").to_pylist())])
        which = np.concatenate([np.frombuffer(b, "<i4") + n for b, n in zip(table.column("which").to_pylist(), before.tolist(), strict=False)])
        offsets = np.append(0, np.cumsum(size)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(table.column("pieces").to_pylist()))]
        ).dictionary_encode()
        which = pieces.indices.to_numpy().astype(np.int64)[which]
        d, lo, hi = repeated_spans(pieces.dictionary, which, doc, begin, length)
        return pa.table({"doc": d, "lo": lo, "hi": hi})

    names = ["shard", "docs", "begins", "which", "sizes", "pieces"]
    schema = ", ".join(["shard long", *(f"{c} binary" for c in names[1:])])
    segments = asked.select("doc", "text", "codes").mapInArrow(cut, schema)
    spans = segments.groupBy("shard").applyInArrow(find, "doc long, lo long, hi long")
    spans = spans.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            spans = batch.column(2)
            ends = np.cumsum(pa.compute.list_value_length(spans).to_numpy()).tolist()
            bounds = spans.flatten()
            lows, highs = (bounds.field(c).to_numpy() for c in ("lo", "hi"))
            for i, value, begin, end in zip(batch.column(0).to_pylist(), batch.column(1), [0, *ends], ends, strict=False):
                data = value.as_py().encode("utf-8", "surrogatepass")
                lo, hi = lows[begin:end], highs[begin:end]
                edges = np.zeros(len(data) + 1, np.int64)
                np.add.at(edges, np.minimum(lo, len(data)), 1)
                np.add.at(edges, np.minimum(hi, len(data)), -1)
                gone = np.cumsum(edges)[:-1] > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                starts = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                for column, x in zip(out, (i, int(gone.sum()), starts, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc", "n_removed", "n_spans", "kept_sha256", "kept"]
            )

    changed = asked.select("doc", "text").join(spans, "doc").mapInArrow(
        remove, "doc long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    owner = described.join(firsts, ["sha", "text_code"], "left")
    copy = (F.col("first") < F.col("doc")) & (F.col("n_bytes") >= length)
    empty = hashlib.sha256(b"").hexdigest()
    return owner.join(changed.dropDuplicates(["doc"]), "doc", "left").select(
        F.col("doc").alias(id_column),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),  # null: the whole text
    )


def op4_suffix_array_dedup(spark, folder: str) -> DataFrame:
    """What 50-byte strings leave of every document."""
    return repeated_bytes(documents(spark, folder)).drop("kept")
