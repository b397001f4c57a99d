"""Quality rules, the quality classifier, mixing and pseudonyms."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from check_queries import differences, oracle_connection  # noqa: E402

from proofspark.llm import classifier, mixing, pii, quality, sql  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)), schema)


def test_quality_matches_sql(spark):
    ours = quality.op1_quality_rules(spark, FOLDER).toPandas()
    assert differences(ours, oracle_connection(FOLDER).execute(sql.QUALITY).df()) is None


def test_quality_edge_cases_match_sql(spark):
    texts = [None, "", " \n\t", "a b c d e f g h i j", "x " * 4000, "a b c d e a b c d e k l", "l\nl\n\nl\n m", "é ü\xa0ß #*|<>", "WORD!! " * 12]
    docs = make(spark, texts)
    got = quality.quality_cascade(docs, measures=True).drop("text", "rejected_by").toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"text": object}))
    assert differences(got, con.execute(sql.QUALITY).df()) is None


def test_cascade_order_and_short_circuit(spark):
    docs = make(spark, ["a"] * 50)
    rules = {"never": lambda t: False, "always": lambda t: True}
    assert [r["rule"] for r in quality.rule_order(docs, rules)] == ["always", "never"]
    got = quality.quality_cascade(docs.withColumn("kept", F.lit("x")), rules)
    assert {r.rejected_by for r in got.collect()} == {"always"} and got.columns.count("kept") == 1


def test_filters_on_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert quality.quality_cascade(empty, measures=True).count() == 0
    assert classifier.resample(empty, empty, 0.5).count() == 0
    assert pii.pseudonymize(empty, "k").count() == 0
    assert mixing.mix(empty).count() == 0


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fit = labels.where("doc_id % 2 = 0")
    target, share = classifier.quality_target(docs, fit)
    got = classifier.resample(docs, target, share).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.95 and got[got.quality == 0].kept.mean() < 0.1


def test_classifier_keeps_the_exact_share(spark):
    docs = make(spark, [None, "", *[f"word{i} and {i}" for i in range(98)]])
    got = classifier.resample(docs, docs.limit(0), 0.25)
    rows = sorted(got.collect(), key=lambda r: -r.score)
    assert [r.kept for r in rows] == [True] * 25 + [False] * 75
    assert {r.log_ratio for r in rows if r.doc_id < 2} == {0.0}


def test_kth_largest(spark):
    values = [-(1 << 62), -5, -5, 0, 3, 3, 1 << 61]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for k, v in enumerate(sorted(values, reverse=True), 1):
        assert classifier.kth_largest(rows, "v", k) == v
    assert classifier.kth_largest(rows, "v", 8) is None


def test_raking_meets_margins_and_draw_follows(spark):
    rows = [(i, "w " * (1 + i % 7), "en" if i % 3 else None, f"s{i % 4 and i % 2}", 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, DOCS)
    want = {"source": {"s0": 0.5, "s1": 0.5}, "lang": {"en": 0.4, None: 0.6}}
    targets = {m: spark.createDataFrame(list(t.items()), f"{m} string, target double") for m, t in want.items()}
    got = mixing.mix(docs, targets).toPandas()
    got["w"] = got.tokens * got.probability
    for margin, goal in want.items():
        for value, share in goal.items():
            own = got[margin].isna() if value is None else got[margin] == value
            assert got.w[own].sum() / got.w.sum() == pytest.approx(share, abs=1e-4)
    assert got.tokens[got.sampled].sum() == pytest.approx(got.w.sum(), rel=0.1)
    assert got.probability.max() == pytest.approx(1)


def test_mix_keeps_the_expected_total_and_handles_nulls(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), *[(i, "a b c", "en", f"s{i % 9 and 1}", 5) for i in range(900)]]
    docs = spark.createDataFrame(rows, DOCS).withColumn("tokens", F.lit("clash"))
    got = mixing.mix(docs, keep=0.7).toPandas()
    assert len(got) == 902 and (got.tokens * got.probability).sum() == pytest.approx(0.7 * 2700, rel=1e-6)
    assert not got.sampled[got.tokens == 0].any()


def test_mixing_twice_is_one_draw(spark):
    a, b = (sorted(map(tuple, mixing.op2_mix_sources(spark, FOLDER).collect())) for _ in range(2))
    assert a == b


def test_feistel_is_a_permutation(spark):
    cells = spark.range(30 * 7).select(F.floor(F.col("id") / 7).alias("l"), (F.col("id") % 7).alias("r"))
    key = F.lit("k")
    got = cells.select(pii.feistel(F.col("l"), F.col("r"), F.lit(30), F.lit(7), key, F.lit("t")).alias("s")).collect()
    assert {(r.s.l, r.s.r) for r in got} == {(i, j) for i in range(30) for j in range(7)}
    four = spark.range(10_000).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 4, "0"), key, "t").alias("d"))
    assert four.distinct().count() == 10_000


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    texts = [
        "card 4111 1111 1111 1111, again 4111111111111111; no card 4111111111111112",
        "mail a.b@c.example.com and A.B@c.example.com from 10.1.2.3 not 999.1.1.1",
        "+1 (988) 555-2485 on 2024-02-29 or 29.02.2024, never 2023-02-30; 123-45-6789, 000-12-3456",
        "DE89 3704 0044 0532 0130 00 and GB29NWBK60161331926819 but DE88370400440532013000",
        None, "", "clean text, 3.14 of 12", "x" * 100_000 + " 4111111111111111",
    ]
    got = [r.text for r in pii.pseudonymize(make(spark, texts), "k").orderBy("doc_id").collect()]
    import re

    cards = re.findall(r"\d{4}(?: ?\d{4}){3}", got[0])
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111" and luhn(cards[1]) and cards[2] == "4111111111111112"
    assert got[7].endswith(cards[1]) and got[4] is None and got[5] == "" and got[6] == texts[6]
    mails = re.findall(r"\S+@\S+", got[1])
    assert mails[0] == mails[1] and "999.1.1.1" in got[1] and "10.1.2.3" not in got[1]
    dates = re.findall(r"\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}", got[2])
    assert dates[1].split(".")[::-1] == dates[0].split("-") and dates[2] == "2023-02-30" and "000-12-3456" in got[2]
    iban = got[3].split(" and ")[0].replace(" ", "")
    number = "".join(str(int(c, 36)) for c in iban[4:] + iban[:4])
    assert int(number) % 97 == 1 and iban[:2] == "DE" and "DE88370400440532013000" in got[3]


def test_account_numbers_before_capitals(spark):
    ibans = ["AT611904300234573201", "ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "SE4550000000058398257466", "DE89 3704 0044 0532 0130 00", "NO9386011117947"]
    texts = [f"{front}{iban}{end}" for iban in ibans for front in ("", "XX12 ") for end in ("", " BIC", " 7 EUR", " 2024", ".")]
    got = [r.text for r in pii.pseudonymize(make(spark, texts), "k").orderBy("doc_id").collect()]
    for t, g, iban in zip(texts, got, [i for i in ibans for _ in range(10)], strict=True):
        front, end = t.split(iban)
        new = g.removeprefix(front).removesuffix(end)
        plain = new.replace(" ", "")
        assert new != iban and len(new) == len(iban) and g == front + new + end
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert len({g.removeprefix("XX12 ")[:15] for g in got}) == len(ibans)


def test_secrets_are_replaced_to_their_end(spark):
    run = lambda n: "".join("aB3dE6gHjK"[(i * i + i // 7) % 10] for i in range(n))
    jwt = f"eyJhbGciOiJI.{run(300)}.{run(43)}-_"
    secrets = [f"sk-{run(100)}", f"sk-proj-{run(70)}_{run(40)}-{run(9)}", "sk-" + "abcdefghij" * 3, f"ghp_{run(60)}", f"token={jwt}", f"password: {run(5000)}", f"api_key='{run(20)}=='", f"secret={run(9)}!x$"]
    texts = [f"see {s} end." for s in secrets] + [f"see token={jwt}.", "a sk-learn and task-abcdefghijklmnopqrstuvwxyz1"]
    rows = pii.pseudonymize(make(spark, texts), "k").orderBy("doc_id").collect()
    got = [r.text for r in rows]
    assert [r.n_replaced for r in rows] == [1] * 9 + [0] and got[9] == texts[9]
    for t, g in zip(texts[:9], got[:9], strict=True):
        assert len(t) == len(g) and g[-5:].lstrip("0123456789abcdefABCDEF") in (t[-5:], "' end."[-5:], " end.", ".")
        assert not any(t[i : i + 12] in g for i in range(len("see password: "), len(t) - 17))
    body = got[5].removeprefix("see password: ").removesuffix(" end.")
    assert len(body) == 5000 and set(body) <= set("0123456789abcdef") and body[:64] != body[64:128] != body[128:192] != body[192:256]


def test_pseudonyms_need_no_python(spark, capsys):
    pii.op6_pii(spark, FOLDER).explain()
    assert not any(w in capsys.readouterr().out for w in ("Python", "Arrow", "Pandas"))
