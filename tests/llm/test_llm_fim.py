"""Fill-in-the-middle: the boundary set against sorted lists, the transformation against SQL."""

from __future__ import annotations

import os
import random
import re
import sys

import duckdb
import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from check_queries import differences, oracle_connection  # noqa: E402

from proofspark.llm import fim, sql  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def boundary_set(positions):
    found = fim.BoundarySet()
    at = np.array(sorted(positions), np.int64)
    for high in np.unique(at >> 16):
        found.add(int(high), (at[at >> 16 == high] & 0xFFFF))
    return found


def test_select_in_each_kind_of_container():
    rng = random.Random(1)
    sparse = rng.sample(range(65536), 900)
    dense = [65536 + x for x in rng.sample(range(65536), 30_000)]
    runs = [5 * 65536 + x for x in [*range(100, 9000), *range(20_000, 65536)]]
    whole = [6 * 65536 + x for x in range(65536)]
    want = sorted(sparse + dense + runs + whole)
    found = boundary_set(want)
    assert found.kinds == ["array", "bitmap", "runs", "runs"] and len(found) == len(want)
    for k in [0, 1, 899, 900, 901, len(want) - 1, *rng.sample(range(len(want)), 3000)]:
        assert found.select(k) == want[k]


def test_token_ends_over_containers():
    rng = random.Random(2)
    for text in ["", " ", "a", " a", "a ", "é ß  ü\n", "x" * 65536, "x" * 65535 + " y", "x" * 65536 + " ", " " * 70_000, "a" + " " * 65536]:
        check_ends(text)
    for _ in range(20):
        check_ends("".join(rng.choice(["a", "bc", "é", "\U0001f600", " ", "\n", "\t\r", "\x0b\x0c", "\xa0", "\x1f"]) for _ in range(rng.choice([5, 50, 60_000]))))


def check_ends(text):
    found = fim.token_ends(np.frombuffer(text.encode(), np.uint8))
    ends, total = [], 0
    for t in TOKEN.findall(text):
        total += len(t.encode())
        ends.append(total - 1)
    assert len(found) == len(ends)
    for k in range(0, len(ends), max(1, len(ends) // 50)):
        assert found.select(k) == ends[k]


def test_matches_sql(spark):
    ours = fim.op12_fill_in_middle(spark, FOLDER).toPandas()
    assert differences(ours, oracle_connection(FOLDER).execute(sql.FILL_IN_MIDDLE).df()) is None
    assert set(ours.form) == {"plain", "psm", "spm"}


def test_edge_cases_match_sql(spark):
    texts = [None, "", " ", "\n\t a", "one", "x" * 200_000, "wörter \U0001f600 und so  ", "a <P> b", "<S>", "c<M>", "a<", "<P", "S>", "a\x00b c"]
    rows = [(i, t) for i, t in enumerate(texts * 8)] + [(3, "same id"), (3, "same id"), (3, "other text"), (None, "no id at all"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("clash")).withColumn("N", F.lit(1))
    got = fim.fill_in_middle(docs)
    assert got.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = got.select(F.coalesce("text", F.lit("")).eqNullSafe(fim.restored()).alias("same"))
    assert back.where("not same").count() == 0
    ours = got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"text": object, "doc_id": "Int64"}))
    assert differences(ours.toPandas(), con.execute(sql.FILL_IN_MIDDLE).df()) is None


def test_empty_table_and_text_ids(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = fim.fill_in_middle(spark.createDataFrame([("x", "a b c d e f")], "key string, body string"), text="body", id_column="key", fim_percent=100)
    assert got.select(fim.restored().alias("t")).first().t == "a b c d e f"
