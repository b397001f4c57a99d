"""Quality rules as a short-circuit cascade ordered by rejections per cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from proofspark.llm.common import mixed, word_codes

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
Rule = Callable[["Text"], bool]


class Text:
    """One text; each feature is computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\x0c\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\x0b\x0c\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside runs of five words that occur at least twice."""
        if self.n_words < 6:
            return 0
        codes = word_codes(self.words)
        _, at, count = np.unique(_windows(codes), return_inverse=True, return_counts=True)
        starts = np.flatnonzero(count[at] > 1)
        edges = np.zeros(self.n_words + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + 5, -1)
        return int((np.cumsum(edges) > 0).sum())

    @cached_property
    def n_bangs(self) -> int:
        return self.text.count("!")

    @cached_property
    def capitals(self) -> int:
        return sum(self.text.count(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    @cached_property
    def smalls(self) -> int:
        return sum(self.text.count(c) for c in "abcdefghijklmnopqrstuvwxyz")


def _windows(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(len(codes) - 4, np.uint64)
    for i in range(5):
        h = mixed(h + codes[i : i + len(h)] + np.uint64(i + 1))
    return h


#: The two rules of the base verdict.
BASE_RULES: dict[str, Rule] = {
    "few_words": lambda t: t.n_words < 10,
    "repeated_windows": lambda t: 100 * t.n_repeat_words > 20 * t.n_words,
}
#: What else rejects a text. Only whole-number comparisons, so that any order gives one verdict.
MORE_RULES: dict[str, Rule] = {
    "short_words": lambda t: t.word_chars < 2 * t.n_words,
    "long_words": lambda t: t.word_chars > 20 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "repeated_lines": lambda t: 10 * t.n_dup_lines > 3 * len(t.lines),
    "bangs": lambda t: 10 * t.n_bangs > 3 * t.n_words,
    "capitals": lambda t: t.capitals > t.smalls,
}
RULES = BASE_RULES | MORE_RULES


def rule_order(
    docs: DataFrame, rules: dict[str, Rule], text: str = "text", id_column: str = "doc_id", sample: int = 2000
) -> list[dict]:
    """The rules in the order of the cascade, with ``seconds`` and ``rejected`` of ``tried`` sampled texts.

    About ``sample`` texts are chosen by the hash of their ids, whatever the size of the table. Each rule
    runs on each of them from the bare text, so that its cost holds the features it needs; the rule with
    the most rejections per second is first. On no rows, the given order stays.
    """
    n = docs.count()
    share = min(1.0, sample / max(1, n))
    chosen = docs.where(F.pmod(F.xxhash64(id_column, F.lit(17)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, rule in rules.items():
                rejected, begun = 0, time.perf_counter()
                for value in batch.column(0).to_pylist():
                    rejected += rule(Text(value))
                yield pa.RecordBatch.from_pylist(
                    [{"rule": name, "seconds": time.perf_counter() - begun, "rejected": rejected, "tried": len(batch)}]
                )

    seen = chosen.select(text).mapInArrow(measure, "rule string, seconds double, rejected long, tried long")
    rows = seen.groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("seconds", "rejected", "tried")]).collect()
    found = {r["rule"]: r.asDict() for r in rows}
    order = sorted(found.values(), key=lambda r: (-r["rejected"] / max(r["seconds"], 1e-9), r["rule"]))
    return order + [{"rule": name, "seconds": 0.0, "rejected": 0, "tried": 0} for name in rules if name not in found]


def quality_cascade(
    docs: DataFrame,
    rules: dict[str, Rule] | None = None,
    text: str = "text",
    id_column: str = "doc_id",
    measures: bool = False,
    sample: int = 2000,
) -> DataFrame:
    """All rows of ``docs`` with ``kept`` and ``rejected_by``, the first rule of the cascade that fired.

    Rules run one after the other, ordered by ``rule_order``; the first that fires ends the work on a
    text. ``kept`` is independent of the order, ``rejected_by`` is not. With ``measures``, the five counts
    of ``MEASURES`` and ``base_failed`` are added for every row, and a text that fails the base is not
    tried further.

    A null text counts as an empty one, which has no words and is rejected by the rules above. Repeated
    rows and ids are judged each by itself. Columns of ``docs`` whose names clash with added ones are
    replaced. An empty table gives an empty result.
    """
    rules = RULES if rules is None else rules
    names = [r["rule"] for r in rule_order(docs, rules, text, id_column, sample)]
    added = ["kept", "rejected_by", *([*MEASURES, "base_failed"] if measures else [])]
    rows = docs.drop(*[c for c in docs.columns if c in added and c != text])
    at = rows.columns.index(text)
    base = [n for n in names if n in BASE_RULES] if measures else []
    order = base + [n for n in names if n not in base]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in added}
            for value in batch.column(at):
                t = Text(value.as_py())
                by = next((n for n in order if rules[n](t)), None)
                out["kept"].append(by is None)
                out["rejected_by"].append(by)
                if measures:
                    for m in MEASURES:
                        out[m].append(getattr(t, m))
                    out["base_failed"].append(any(r(t) for r in BASE_RULES.values()))
            kinds = {"kept": pa.bool_(), "rejected_by": pa.string(), "base_failed": pa.bool_()}
            columns = [pa.array(out[c], kinds.get(c, pa.int64())) for c in added]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    more = ", ".join(
        f"{c} {'boolean' if c in ('kept', 'base_failed') else 'string' if c == 'rejected_by' else 'long'}" for c in added
    )
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(more).fields])
    return rows.mapInArrow(judge, schema)


def op1_quality_rules(spark, folder: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    judged = quality_cascade(docs, measures=True)
    return judged.select("doc_id", *MEASURES, "base_failed", "kept")
