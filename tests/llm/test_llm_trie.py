"""The prefix trie against a dictionary of all prefixes, and against SQL."""

from __future__ import annotations

import hashlib
import os
import random
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from check_queries import differences, oracle_connection  # noqa: E402

from proofspark.llm import sql, trie  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def code(role, text):
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()


def rem(c, m):
    return c - m * int(c / m)


def expected(rows, borrow=True):
    by_conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by_conv[c].append((turn is not None, turn or 0, code(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in by_conv.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - rem(c, 5), [])[:h] + own[c][h:] if borrow else own[c]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in members:
        if key:
            children[key[:-1]] += 1
    for key, convs in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += (len(convs) - 1) * len(key[-1][1].encode()) if key else 0
    out = set()
    for key, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(key))
        parent = min(members[key[:-1]]) if key else None
        out.add((min(convs), len(key), parent, len(convs), children[key], leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def drawn(seed, convs=60, most=14):
    """Conversations of few distinct turns, some copied, with nulls, ties and gaps in ids and turns."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 200), convs):
        path = [(rng.choice(["user", None, ""]), rng.choice(["a", "bb", None, "", "é\n"])) for _ in range(rng.randint(1, most))]
        copies = rng.choice([1, 1, 1, 4])
        for k in range(copies):
            rows += [(c + 1000 * k, rng.choice([t, t, t // 2, None]) if rng.random() < 0.1 else t, *x) for t, x in enumerate(path)]
    return rows + [(None, 1, "user", "no id"), rows[0]]


@pytest.mark.parametrize("seed,chunk,bits", [(1, 4096, 25), (2, 10, 25), (3, 10, 3), (4, 12, 6)])
def test_trie_equals_brute_force(spark, seed, chunk, bits, monkeypatch):
    monkeypatch.setattr(trie, "LEAST_BITS", 3)
    rows = drawn(seed, 40, 45 if chunk < 4096 else 9)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    paths = trie.with_borrowed_heads(trie.conversation_paths(df, chunk))
    assert got(trie.prefix_trie(paths, bits)) == expected(rows)


def test_long_copies_and_tails_that_open_a_row(spark):
    rows = [(c, t, "user", f"{t}" if t < cut else f"{t} {c}") for c, cut in [(1, 50), (2, 30), (3, 20), (4, 20), (5, 21), (6, 0), (7, 50), (8, 40)] for t in range(50)]
    paths = trie.conversation_paths(spark.createDataFrame(rows, SCHEMA), 10)
    assert paths.count() == 40
    assert got(trie.prefix_trie(paths)) == expected(rows, borrow=False)


def test_matches_sql(spark):
    ours = trie.op13_prefix_trie(spark, FOLDER).toPandas()
    assert differences(ours, oracle_connection(FOLDER).execute(sql.PREFIX_TRIE).df()) is None


def test_a_third_of_all_conversations_alike(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_BYTES", 21 * 50)
    monkeypatch.setattr(trie, "MOST_HOT", 10)
    rows = [(c, t, "u", f"{t}") for c in range(2000) for t in range(3)] + [(c, t, "u", f"{t} {c % 100} {t * (c % 7)}") for c in range(3000, 4000) for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(trie.prefix_trie(trie.conversation_paths(df))) == expected(rows, borrow=False)


def test_empty_turnless_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(trie.with_borrowed_heads(trie.conversation_paths(empty))).count() == 0
    rows = [(c, 0, "u", "x" * 100_000) for c in range(6, 10)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("x"), "length": F.lit(1), "chunk": F.lit(None)})
    assert got(trie.prefix_trie(trie.with_borrowed_heads(trie.conversation_paths(df)))) == expected(rows)


def test_sketch_never_proves_a_shared_prefix_alone(spark):
    rows = [(c, t, "u", f"{t} {c // 2}") for c in range(400) for t in range(3)]
    paths = trie.conversation_paths(spark.createDataFrame(rows, SCHEMA)).withColumns({"carry1": F.lit(0).cast("long"), "carry2": F.lit(0).cast("long")})
    sketch = trie.shared_buckets(paths.repartition(7), 12)
    alone = []

    def look(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(trie._alone(trie._Prefixes(b), sketch, 12))], names=["alone"])

    alone = [r.alone for r in paths.mapInArrow(look, "alone boolean").collect()]
    assert len(alone) == 1200 and not any(alone)
    assert np.unpackbits(sketch[0]).sum() > 300
