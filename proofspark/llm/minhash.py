"""Near-duplicate documents: an inverted join of MinHash signature coordinates, confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofspark.llm.blocks import Forest, blocked_apart, groups_of
from proofspark.llm.common import documents, dropped, mixed, shingle_codes, stored
from proofspark.llm.components import components

COORDINATES = 64
#: Members of one confirming group.
GROUP = 1000


def match_threshold(similarity: float, coordinates: int = COORDINATES, miss: float = 1e-6) -> int:
    """The most matching coordinates a pair at ``similarity`` falls short of with a chance of ``miss`` at most."""
    total = 0.0
    for t in range(coordinates + 1):
        total += comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if total > miss:
            return max(1, t)
    return coordinates


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _signature(codes: np.ndarray) -> np.ndarray:
    """The least 32-bit hash of the set in each coordinate."""
    if not len(codes):
        return np.zeros(COORDINATES, np.uint64)
    odd = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(codes), 4096):
        part = codes[begin : begin + 4096]
        low = np.minimum(low, np.array([(part * o).min() for o in odd], np.uint64))
    return mixed(low) >> np.uint64(32)


def signatures(docs: DataFrame, text: str, id_column: str, words: int) -> DataFrame:
    """One row per document: id, n_shingles, set_hash (128 bits of the full set) and its coordinate tokens."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (np.arange(COORDINATES, dtype=np.uint64) + np.uint64(1)) << np.uint64(32)
        for batch in batches:
            count, hashes, tokens = [], [], []
            for value in batch.column(1):
                codes = shingle_codes(_words(value.as_py()), words)
                count.append(len(codes))
                hashes.append(xxhash.xxh3_128_digest(codes.tobytes()))
                tokens.append((_signature(codes) | base).astype(np.int64))
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            offsets = pa.array(np.arange(len(count) + 1, dtype=np.int32) * COORDINATES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(hashes, pa.binary()),
                 pa.ListArray.from_arrays(offsets, pa.array(flat))],
                names=["id", "n_shingles", "set_hash", "tokens"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(
        sign, f"id {kind}, n_shingles long, set_hash binary, tokens array<long>"
    )


def _short(tokens: Column) -> Column:
    """The lowest byte of each coordinate: agrees where the coordinates do, and by chance in 1 of 256."""
    return F.transform(tokens, lambda t: (t.bitwiseAND(255) - 128).cast("byte"))


def postings(reps: DataFrame, least: int) -> DataFrame:
    """(token, id) for the prefix of each signature, rarest tokens first.

    Two signatures that agree in ``least`` of m coordinates share one of the m - ``least`` + 1 rarest
    tokens of each. Tokens of one document lead the order and match nothing, so they only shorten what
    is left of the prefix; a document with too few shared tokens is skipped altogether.
    """
    flat = reps.select("id", F.explode("tokens").alias("token"))
    shared = flat.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    by_doc = (
        flat.join(shared, "token")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
        .where(F.size("shared") >= least)
    )
    prefix = by_doc.select("id", F.explode(F.expr(f"slice(shared, 1, size(shared) - {least} + 1)")).alias("p"))
    return prefix.select("id", F.col("p.token").alias("token"))


def confirm(pairs: DataFrame, sets: DataFrame, above: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have p * intersection >= q * union, (p, q) = ``above``.

    Pairs are dealt by b in groups of about ``GROUP``; the set of b goes to each of its groups, comes
    first there and is compared with one member after the other, so that a task holds two sets at a time.
    """
    times, share = above
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("_s"))
    salted = pairs.join(hubs, "b").withColumn("_salt", F.pmod(F.xxhash64("a"), F.col("_s")).cast("int"))
    columns = ["b", "_salt", "_first", "a", "codes"]
    members = salted.join(sets.select(F.col("id").alias("a"), "codes"), "a").withColumn("_first", F.lit(1)).select(columns)
    heads = (
        hubs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
        .join(sets.select(F.col("id").alias("b"), "codes"), "b")
        .select("b", "_salt", F.lit(0).alias("_first"), F.col("b").alias("a"), "codes")
    )
    dealt = members.unionByName(heads).repartition("b", "_salt").sortWithinPartitions("b", "_salt", "_first")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for hub, first, member, codes in zip(
                batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True
            ):
                own = np.frombuffer(codes.as_buffer(), np.uint64)
                if not first:
                    head = own.copy()
                    continue
                both = len(np.intersect1d(head, own, assume_unique=True))
                if both and times * both >= share * (len(head) + len(own) - both):
                    a.append(member)
                    b.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def _trees(rows: DataFrame, short: DataFrame, least: int) -> DataFrame:
    """Links (a, b) between components of one posting list that agree in ``least`` short coordinates.

    Of each cell only as many as join its components to trees, the best partners of a document first.
    ``short`` has the short coordinates ``sig`` by id.
    """

    def pairs(table: pa.Table) -> pa.Table:
        ids, comp = table.column("id").to_numpy(), table.column("component_id").to_numpy()
        sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(len(ids), COORDINATES)
        forest, chosen = Forest(), []
        for left, right in groups_of(table, ["token"]):
            for x in left:
                against = right[(comp[right] != comp[x]) & ((ids[right] < ids[x]) if left is right else True)]
                if not len(against):
                    continue
                same = (sig[against] == sig[x]).sum(axis=1)
                likely = np.flatnonzero(same >= least)
                for y in against[likely[np.argsort(-same[likely], kind="stable")]].tolist():
                    cx, cy = int(comp[x]), int(comp[y])
                    if forest.root(cx) != forest.root(cy):
                        forest.link(cx, cy)
                        chosen.append((max(int(ids[x]), int(ids[y])), min(int(ids[x]), int(ids[y]))))
        both = np.array(chosen, np.int64).reshape(-1, 2)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    cells = blocked_apart(rows, ["token"], "id", "component_id").join(short, "id")
    return cells.groupBy("_cell", "_i", "_j").applyInArrow(pairs, "a long, b long").distinct()


def _shared(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of 0/1 matrices."""
    vocabulary = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)

    def ones(sets: list[np.ndarray], words: np.ndarray) -> np.ndarray:
        m = np.zeros((len(sets), len(words)), np.float32)
        for i, s in enumerate(sets):
            part = s[np.searchsorted(s, words[0]) : np.searchsorted(s, words[-1], "right")]
            at = np.searchsorted(words, part)
            m[i, at[words[at] == part]] = 1
        return m

    for begin in range(0, len(vocabulary), columns):
        words = vocabulary[begin : begin + columns]
        out += ones(left, words) @ ones(right, words).T
    return out


def _settle(rows: DataFrame, content: DataFrame, least: int, above: tuple[int, int]) -> DataFrame:
    """Confirmed links between components of one cluster: all its pairs, in blocks, as trees.

    ``rows`` has cluster, id and component_id, ``content`` sig and codes by id. Nothing but links that join
    two trees of a cell leaves it, however many pairs are compared.
    """
    times, share = above

    def pairs(table: pa.Table) -> pa.Table:
        ids, comp = table.column("id").to_numpy(), table.column("component_id").to_numpy()
        sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(len(ids), COORDINATES)
        sets = [np.frombuffer(c.as_buffer(), np.uint64) for c in table.column("codes")]
        sizes = np.array([len(s) for s in sets])
        forest, chosen = Forest(), []
        for left, right in groups_of(table, ["cluster"]):
            for begin in range(0, len(left), 256):
                for start in range(0, len(right), 256):
                    x, y = left[begin : begin + 256], right[start : start + 256]
                    close = comp[x][:, None] != comp[y][None, :]
                    for i in np.flatnonzero(close.any(axis=1)):
                        close[i] &= (sig[y] == sig[x[i]]).sum(axis=1) >= least
                    rows_, cols = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
                    if not len(rows_):
                        continue
                    x, y = x[rows_], y[cols]
                    both = _shared([sets[k] for k in x], [sets[k] for k in y]).astype(np.int64)
                    either = sizes[x][:, None] + sizes[y][None, :] - both
                    true = (times * both >= share * either) & (comp[x][:, None] != comp[y][None, :])
                    for i, j in zip(*np.nonzero(true), strict=True):
                        cx, cy = int(comp[x[i]]), int(comp[y[j]])
                        if forest.root(cx) != forest.root(cy):
                            forest.link(cx, cy)
                            chosen.append((int(ids[x[i]]), int(ids[y[j]])))
        out = np.array(chosen, np.int64).reshape(-1, 2)
        return pa.table({"a": out[:, 0], "b": out[:, 1]})

    cells = blocked_apart(rows, ["cluster"], "id", "component_id", block=1024, shard_rows=4096).join(content, "id")
    return cells.groupBy("_cell", "_i", "_j").applyInArrow(pairs, "a long, b long")


def _undecided(posted: DataFrame, parts: DataFrame) -> DataFrame:
    """Postings with their component, of lists that hold more than one."""
    placed = posted.join(parts, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    placed = stored(placed)
    several = (
        placed.groupBy("token")
        .agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi"))
        .where("lo != hi")
        .select("token")
    )
    rest = stored(placed.join(several, "token", "left_semi"))
    dropped(placed)
    return rest


def near_duplicates(
    docs: DataFrame,
    above: tuple[int, int] = (100, 85),
    words: int = 5,
    text: str = "text",
    id_column: str = "doc_id",
) -> DataFrame:
    """For each row of ``docs``: id, n_shingles, component_id and kept (the smallest id of its component).

    Documents are linked where p * intersection >= q * union of their sets of ``words``-word shingles,
    (p, q) = ``above``; components are all that links reach. Equal sets are one node. Documents are
    posted under the rarest of their signature tokens; every posting list is first linked to its smallest
    document, then the likeliest pairs between components are tried twice, as trees; by then groups of
    copies are mostly one component. At last clusters of components that agree in enough coordinates are
    compared pair by pair, in blocks inside of tasks. A pair at the limit is
    missed with a chance below one in a million; none is linked without a confirmation on full sets.

    Null and empty texts have no shingles and link with nothing. Rows with the same id are one document
    for the components. A null id takes no part and gets a null component, and kept false. Other columns
    are left out; an empty table gives an empty result.
    """
    least = match_threshold(above[1] / above[0])
    signed = stored(signatures(docs, text, id_column, words))
    reps = stored(
        signed.where("n_shingles > 0 and id is not null")
        .groupBy("set_hash")
        .agg(F.min("id").alias("id"), F.first("tokens").alias("tokens"))
    )
    posted = stored(postings(reps, least))
    able = stored(posted.select("id").distinct().join(reps.select("id", "set_hash"), "id"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [shingle_codes(_words(t.as_py()), words).tobytes() for t in batch.column(1)]
            hashes = [xxhash.xxh3_128_digest(c) for c in codes]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hashes, pa.binary()), pa.array(codes, pa.binary())], names=["id", "set_hash", "codes"]
            )

    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    sets = texts.join(able.select("id").distinct(), "id").select("id", "text").mapInArrow(
        collect, "id long, set_hash binary, codes binary"
    )
    sets = stored(sets.join(able, ["id", "set_hash"], "left_semi").dropDuplicates(["id", "set_hash"]).select("id", "codes"))

    short = stored(reps.select("id", _short(F.col("tokens")).alias("sig")).dropDuplicates(["id"]))
    centres = posted.groupBy("token").agg(F.min("id").alias("b"))
    stars = posted.join(centres, "token").where("id != b").select(F.col("id").alias("a"), "b").distinct()
    stars = stored(stars)
    links = stored(confirm(stars, sets, above))
    dropped(stars)
    parts = components(links)
    for agree in (above[1] / above[0], (above[1] / above[0] + least / COORDINATES) / 2):
        open_lists = _undecided(posted, parts)
        likely = stored(_trees(open_lists, short, int(agree * COORDINATES)))
        found = stored(confirm(likely, sets, above))
        dropped(open_lists, likely)
        # components so far are stars; only they and the new links are gone through again
        old = links
        links = stored(parts.where("id != component_id").select(F.col("id").alias("a"), F.col("component_id").alias("b")).union(found))
        dropped(old, found)
        parts = components(links)
    hashed = able
    able = stored(able.select("id").distinct().join(parts, "id", "left").withColumn("component_id", F.coalesce("component_id", "id")))
    dropped(hashed)
    joined = able.where("id != component_id").select(F.col("id").alias("a"), F.col("component_id").alias("b"))
    open_lists = _undecided(posted, parts)
    likely = stored(_trees(open_lists, short, least))
    dropped(open_lists, posted)
    clusters = components(likely.union(joined))
    named = able.join(clusters.select("id", F.col("component_id").alias("cluster")), "id")
    several = named.groupBy("cluster").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi"))
    open_ = stored(named.join(several.where("lo != hi").select("cluster"), "cluster", "left_semi"))
    content = short.join(sets.dropDuplicates(["id"]), "id")
    settled = stored(_settle(open_.select("cluster", "id", "component_id"), content, least, above))
    dropped(likely, open_, short, sets)
    final = components(links.union(settled))
    dropped(links, settled)
    return (
        signed.join(reps.select("set_hash", F.col("id").alias("rep")), "set_hash", "left")
        .join(final.select(F.col("id").alias("rep"), "component_id"), "rep", "left")
        .select(
            F.col("id").alias(id_column),
            "n_shingles",
            F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.coalesce("component_id", "rep")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(False)))
    )


def op7_minhash_dedup(spark, folder: str) -> DataFrame:
    """Component of every document at a similarity of 0.85."""
    return near_duplicates(documents(spark, folder))
