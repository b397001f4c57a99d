from __future__ import annotations

import math
import random
import statistics
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofspark.operators.quantiles import (
    describe,
    grouped_quantiles,
    large_groups,
    radix_quantiles,
    with_order,
)

QS = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q90": 0.9, "q100": 1.0}


def _groups(seed):
    rng = random.Random(seed)
    return {
        "hot": [rng.gauss(70, 15) for _ in range(3000)],
        "copies": [70.0] * 500 + [71.0],
        "one": [68.25],
        "two": [60.0, 90.0],
        "below zero": [-3.3, -0.1, 0.0, 0.2, 4.5, 4.5],
    }


def _frame(spark, groups):
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]]
    return spark.createDataFrame(rows, "g string, v double").repartition(5)


@pytest.mark.parametrize("limit", [20_000_000, 100, 0], ids=["sorted", "both", "radix"])
@pytest.mark.parametrize("interpolation", ["linear", "nearest"])
def test_quantiles_are_exact(spark, limit, interpolation):
    groups = _groups(1)
    rows = grouped_quantiles(
        _frame(spark, groups), ["g"], "v", QS, interpolation,
        extras={"low": (F.min, "v"), "high": (F.max, "v")}, limit=limit,
    ).collect()
    assert {r.g for r in rows} == set(groups)
    for r in rows:
        values = sorted(groups[r.g])
        assert (r.n, r.low, r.high) == (len(values), values[0], values[-1])
        for name, q in QS.items():
            if interpolation == "linear":
                want = np.quantile(values, q)
            else:
                want = values[math.floor(q * (len(values) - 1) + 0.5)]
            assert r[name] == pytest.approx(want, abs=1e-9), (r.g, name)


@pytest.mark.parametrize("limit", [20_000_000, 1000])
def test_having_drops_groups(spark, limit):
    rows = grouped_quantiles(
        _frame(spark, _groups(2)), ["g"], "v", {"m": 0.5}, having=lambda: F.col("n") > 400, limit=limit
    ).collect()
    assert {r.g for r in rows} == {"hot", "copies"}


def test_coarser_groups_spare_the_count(spark):
    rows = _frame(spark, _groups(2)).withColumn("all", F.lit(1))
    for limit, found in ((100_000, None), (3000, None), (2999, {"hot"})):
        large = large_groups(rows.filter("v is not null"), ["g"], limit)
        assert (large and {r.g for r in large.collect()}) == found
    got = [grouped_quantiles(rows, ["g"], "v", {"m": 0.5}, limit=2999, within=(rows, [k])) for k in ("all", "g")]
    assert sorted(got[0].collect()) == sorted(got[1].collect())


def test_order_of_doubles(spark):
    rng = random.Random(7)
    values = [s * 2.0**e * f for e in range(-1074, 1024) for s in (1, -1) for f in (1.0, 1.25)]
    values += [math.nextafter(2.0**e, to) for e in range(-1060, 1024) for to in (0.0, math.inf)]
    values += [struct.unpack("d", rng.randbytes(8))[0] for _ in range(3000)]
    values = [v for v in values if not math.isnan(v)] + [math.inf, -math.inf, 0.0, -0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, order in with_order(df, "v").collect():
        bits = struct.unpack("q", struct.pack("d", abs(v)))[0]
        assert order == (-bits if v < 0 else bits), v
    nan = spark.createDataFrame([(math.nan,), (None,)], "v double")
    assert [r._order for r in with_order(nan, "v").collect()] == [0x7FF8 << 48, None]


def test_full_precision_without_an_exchange_of_rows(spark):
    """Doubles of all bits: what is shuffled is at most a few counts a task, not rows."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(0, 400_000, 1, 8).select(F.lit("a").alias("g"), (F.rand(3) * 30 + 60).alias("v"))
        got = radix_quantiles(df, ["g"], "v", QS, "nearest")
        values = sorted(r.v for r in df.select("v").collect())
        (row,) = got.collect()
        for name, q in QS.items():
            assert row[name] == values[math.floor(q * (len(values) - 1) + 0.5)]
        plan = got._jdf.queryExecution().executedPlan().toString()
        for line in plan.split("\n"):
            if "Exchange hashpartitioning" in line:
                assert "_order" not in line and "v#" not in line
        assert plan.count("partial_count") >= 4 and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_describe_of_nothing(spark):
    none = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    found = {(r.measure, r.statistic): r.value for r in describe(none, ["a", "b"]).collect()}
    assert (found["a", "count"], found["a", "null_count"], found["a", "mean"], found["a", "std"]) == (0, 2, None, None)
    assert found["b", "std"] == pytest.approx(math.sqrt(0.5)) and ("a", "50%") not in found
    assert describe(none.limit(0), ["a"]).count() == 0


@pytest.mark.parametrize("few", [False, True], ids=["radix", "sorted"])
def test_describe(spark, few):
    values = _groups(3)["hot"]
    df = spark.createDataFrame([(v, 1) for v in values] + [(None, 3)], "a double, b int")
    found = {(r.measure, r.statistic): r.value for r in describe(df, ["a", "b"], within=df if few else None).collect()}
    values.sort()
    n = len(values)
    want = {
        "count": n, "null_count": 1, "mean": statistics.fmean(values),
        "std": statistics.stdev(values), "min": values[0], "max": values[-1],
        "25%": values[math.floor(0.25 * (n - 1) + 0.5)],
        "50%": values[math.floor(0.5 * (n - 1) + 0.5)],
        "75%": values[math.floor(0.75 * (n - 1) + 0.5)],
    }
    for name, value in want.items():
        assert found["a", name] == pytest.approx(value), name
    assert found["b", "count"] == n + 1 and found["b", "max"] == 3 and found["b", "50%"] == 1


def test_unknown_interpolation(spark):
    with pytest.raises(ValueError):
        grouped_quantiles(_frame(spark, {"a": [1.0]}), ["g"], "v", QS, "cubic")
