"""Near-duplicate documents, vectors and lines, and repeated bytes, against brute force."""

from __future__ import annotations

import functools
import hashlib
import importlib
import random

import numpy as np
import pyarrow as pa
import pytest

from proofspark.llm import embeddings, lines, minhash, suffix
from proofspark.llm.common import ranked, stored
from proofspark.llm.components import components

FOLDER = "/root/testdata/sf0.001"


def make(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)), schema)


def variants(seed: int, n: int) -> list:
    """Texts with exact copies, near copies in a chain, shared passages, nulls and a very long one."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(120)]
    out: list = [None, "", " \n ", "one two", "One TWO", " ".join(base), " ".join(base)]
    for _ in range(n):
        base = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 6])):
            base[r.randrange(len(base))] = word()
        out.append(r.choice([" ", "\n", "  "]).join(base))
    passage = " ".join(word() for _ in range(60))
    out += [f"{' '.join(word() for _ in range(80))}\n{passage}\n{' '.join(word() for _ in range(9))}" for _ in range(20)]
    return [*out, " ".join(word() for _ in range(20_000))]


def roots(n, linked):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(400, 400 + i) for i in range(1, 300)] + [(i, i + 1) for i in range(800, 900)]
    got = {x.id: x.component_id for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(1000, pairs)
    assert all(got.get(i, i) == want[i] for i in range(1000))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_have_small_plans(spark, monkeypatch):
    """The driver holds the plan of each table: one join at most, the links read twice; stars are not written again."""
    import proofspark.llm.components as c

    plans = []

    def record(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df)

    monkeypatch.setattr(c, "stored", record)
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 300), (300, 9), (None, 3), (4, None)]
    pairs += [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(120)]
    found = components(spark.createDataFrame([(None if a is None else f"{a:03d}", None if b is None else f"{b:03d}") for a, b in pairs], "a string, b string"))
    links = [(a, b) for a, b in pairs if a is not None and b is not None and a != b]
    least = {x: x for link in links for x in link}
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert sorted((int(x.id), int(x.component_id)) for x in found.collect()) == sorted(least.items())
    assert len(plans) > 1 and max(p.count("Join ") for p in plans) == 1 and max(p.count("Relation ") for p in plans) == 2
    plans.clear()
    stars = components(spark.createDataFrame([(5, 1), (1, 6), (1, 5), (8, 2)], "a long, b long"))
    assert {(x.id, x.component_id) for x in stars.collect()} == {(1, 1), (5, 1), (6, 1), (2, 2), (8, 2)}
    assert len(plans) == 1


@pytest.mark.parametrize("above", [(100, 85), (100, 80)])
def test_near_documents(spark, above):
    texts = variants(1, 60)
    got = {r.doc_id: r for r in minhash.near_duplicates(make(spark, texts), above).collect()}
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    linked = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if sets[i] and above[0] * len(sets[i] & sets[j]) >= above[1] * len(sets[i] | sets[j])
    ]
    want = roots(len(texts), linked)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert all(got[i].kept == (want[i] == i) for i in got)


def test_near_documents_odd_rows(spark):
    rows = [(None, "a b c"), (None, None), (5, "a b c"), (5, "a b c"), (9, "a b c")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [(5, 5, True), (5, 5, True), (9, 5, False)]
    assert [r.kept for r in got if r.doc_id is None] == [False, False]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_threshold_of_matches():
    assert 30 < minhash.match_threshold(0.85) < 54 and minhash.match_threshold(1.0) == minhash.COORDINATES


def test_clusters_are_settled_in_blocks(spark, monkeypatch):
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(90):
        t = list(base)
        for _ in range(r.choice([1, 2])):
            t[r.randrange(60)] = f"x{r.random()}"
        texts.append(" ".join(t))
    blocked = minhash.blocked_apart
    monkeypatch.setattr(minhash, "blocked_apart", lambda rows, keys, i, apart, **k: blocked(rows, keys, i, apart, block=10, shard_rows=20))
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(make(spark, texts)).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    want = roots(90, [(i, j) for i in range(90) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])])
    assert [got[i] for i in range(90)] == want


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 8)) * rng.choice([0, 0.15, 0.4], 300)[:, None]
    rows = [(i, [float(v) for v in x[i]], int(i % 3) if i % 11 else None) for i in range(300)]
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] * 8, 1), (303, [float("inf")] + [1.0] * 7, 1), (304, [1.0, None], 1), (305, [], 1), (306, [2.0, 1.0], 1), (307, [2.0, 1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    blocked = embeddings.blocked
    for block in (2048, 7):
        monkeypatch.setattr(embeddings, "blocked", lambda rows, keys, i, b=block: blocked(rows, keys, i, block=b))
        got = {r.vec_id: r for r in embeddings.near_vectors(table, cell_rows=20).collect()}
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = (unit @ unit.T >= 0.93) & np.array([[a[2] is not None and a[2] == b[2] for b in rows[:300]] for a in rows[:300]])
        np.fill_diagonal(near, False)
        assert [got[i].n_links for i in range(300)] == near.sum(axis=1).tolist()
        assert [got[i].component_id for i in range(300)] == roots(300, list(zip(*np.nonzero(near), strict=True)))
        assert [(got[i].n_links, got[i].component_id) for i in range(300, 308)] == [(0, i) for i in range(300, 306)] + [(1, 306), (1, 306)]
    assert embeddings.near_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize(("all_pairs", "split"), [(16_384, 131_072), (50, 131_072), (50, 200)])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_wide_vectors_are_not_copied(spark, monkeypatch, kind, all_pairs, split):
    """Of many wide vectors only those that may have a partner are compared in full, each in one cell; before, most went to most cells."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 64))
    for i in range(400, 700):
        x[i] = x[i - 400] + rng.normal(size=64) * rng.choice([0, 0.1, 0.38])
    x[700:760] = x[0] + rng.normal(size=(60, 64)) * 0.15
    x[760], x[761] = 0.0, x[763]
    x = x.astype(np.float32).astype(np.float64) if kind == "float" else x
    label = (np.arange(1500) % 400 % 2).tolist()
    rows = [(i, [float(v) for v in x[i]], f"a{label[i]}") for i in range(1500)]
    rows += [(None, rows[0][1], "a0"), (1500, rows[0][1], None), (1501, [float("inf")] * 64, "a0"), (1502, [1.0] * 63, "a0"), (1503, None, "a0")]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label string").repartition(3)
    blocked, sizes = embeddings.blocked, []
    monkeypatch.setattr(embeddings, "blocked", lambda rows, keys, i: sizes.append(rows.count()) or blocked(rows, keys, i))
    sketches = importlib.import_module("proofspark.llm.sketches")
    monkeypatch.setattr(sketches, "ALL_PAIRS", all_pairs)
    monkeypatch.setattr(sketches, "SPLIT", split)
    monkeypatch.setattr(sketches, "HOT", 40 if all_pairs == 50 else 4096)
    got = {r.vec_id: r for r in embeddings.near_vectors(table, cell_rows=40).collect()}
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    near = (unit @ unit.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(near, False)
    assert near.sum() > 300
    assert [got[i].n_links for i in range(1500)] == near.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(1500)] == roots(1500, list(zip(*np.nonzero(near), strict=True)))
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(1500, 1504)] == [(0, i, True) for i in range(1500, 1504)]
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert sizes[0] < 1500


def brute_lines(texts):
    seen, gone = [], set()
    for i, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            s = frozenset(line.split())
            if s:
                if any(10 * len(s & o) >= 8 * len(s | o) for o in seen):
                    gone.add((i, n))
                seen.append(s)
    return gone


def test_lines(spark, monkeypatch):
    texts = [t and t.replace("a", " a\n", 4) for t in variants(2, 50)[:-1]] + ["x y\nx y\n\nx y", "a"]
    docs = make(spark, texts).repartition(3)
    want = brute_lines(texts)
    for short in (64, 2):
        monkeypatch.setattr(lines, "SHORT_LIST", short)
        assert {(r.doc, r.line) for r in lines.repeated_lines(docs, frequent=20).collect()} == want
    got = {r.doc_id: r for r in lines.drop_repeated_lines(docs).collect()}
    for i, t in enumerate(texts):
        left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want)
        assert got[i].text == left


def test_lines_odd_rows(spark):
    rows = [(None, "a b"), (1, "a b\nc"), (1, "a b\nc"), (2, "c\nd"), (3, None), (4, "a b")]
    got = lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "a b"), (1, "a b\nc"), (1, "a b\nc"), (2, "d"), (3, ""), (4, "")]
    assert lines.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeats_of_parts_have_groups_of_their_own(spark):
    docs = make(spark, ["same words here\nsame words here\nother"] * 40).repartition(8)
    entries = lines._entries(docs, "text", "doc_id", 2, lines.NO_WORDS, 10, 8)
    groups = [r["count"] for r in entries.where("kind = 0").groupBy("shard").count().collect()]
    assert len(groups) == 8 and max(groups) == 1
    gone = lines.repeated_lines(docs)
    assert {(r.doc, r.line) for r in gone.collect()} == {(i, n) for i in range(40) for n in range(3) if i or n == 1}


def test_long_posting_lists_are_split(spark, monkeypatch):
    r = random.Random(11)
    template = "posted by {} on the board of all members today at noon".format
    texts = ["\n".join([template(f"name{r.randrange(150)}") for _ in range(3)] + [f"u{r.random()} v w{r.randrange(9)} x y"]) for _ in range(80)]
    texts += variants(3, 10)[:-1]
    rows = make(spark, texts).repartition(3)
    monkeypatch.setattr(lines, "HOT_LIST", 16)
    monkeypatch.setattr(lines, "hot_tokens", functools.partial(lines.hot_tokens, sample=1))
    cells, sizes = lines.blocked, []
    monkeypatch.setattr(lines, "blocked", lambda *a, **k: sizes.append(cells(*a, **k)) or sizes[-1])
    assert {(x.doc, x.line) for x in lines.repeated_lines(rows, frequent=20).collect()} == brute_lines(texts)
    hot = lines.hot_tokens(rows, "text", lines.NO_WORDS, 10, 8, 16)
    assert len(hot) and len(lines.hot_tokens(rows, "text", lines.NO_WORDS, 10, 8, 100_000)) == 0
    assert sizes[0].where("_i < _j").count() > 0
    kinds = lines._entries(rows, "text", "doc_id", 8, lines.NO_WORDS, 10, 8, hot).where("kind = 1").select("packed").collect()
    left = lines._unpacked([k.packed for k in kinds])["token"]
    assert not np.isin(left, (hot >> np.uint64(32)).astype(np.uint32).view(np.int32)).any()


@pytest.mark.parametrize("most", [20, 2_000_000])
def test_long_posting_lists_are_compared_together(monkeypatch, most):
    rng = np.random.default_rng(7)
    n = 400
    size = rng.integers(5, 200, n)
    size[:30] = 40
    rows = np.zeros(n, lines.POSTING)
    rows["doc"], rows["size"], rows["token"], rows["whole"] = rng.permutation(n), size, 9, np.arange(n)
    parity = rng.integers(0, 1 << 60, (n, 2))
    parity[:30] = parity[0] ^ (1 << rng.integers(0, 3, (30, 2)))  # near copies
    rows["p0"], rows["p1"] = parity.T
    passing, compared = lines._passing, []
    count = lambda passed: lambda i, j: (compared.append(len(i)), passed(i, j))[1]
    monkeypatch.setattr(lines, "_passing", lambda *a: count(passing(*a)))
    monkeypatch.setattr(lines, "MOST_LINKS", most, raising=False)
    found = lines._candidates(10, 8)(0, pa.table({"packed": [lines._packed([(0, rows)], 1).column(2)[0].as_py()]})).to_pylist()
    assert len(compared) < 250 and sum(compared) < n * n // 4  # not line by line, and not sizes that are too far apart
    rows = rows[np.argsort(rows["doc"])]
    passed = passing(10, 8, rows["size"], rows["at"], [rows[c].view(np.uint64) for c in ("p0", "p1")], rows[["doc", "line"]])
    want, label = {}, np.arange(n)
    for i in range(1, n):
        _, j, differ = passed(np.full(i, i), np.arange(i))
        if len(j):
            want[i] = (int(j[np.argmin(differ)]), int(differ.min()))
            label[np.isin(label, np.append(label[j], label[i]))] = label[j].min()
    assert len(want) >= 29
    assert {r["doc"]: (r["doc0"], r["differ"]) for r in found if r["line0"] >= 0} == want
    joined: dict = {}
    for r in found:
        if r["line0"] < 0:
            joined.setdefault(r["doc0"], set()).add(r["doc"])
    assert sorted(map(sorted, joined.values())) == sorted(g for k in set(label) if len(g := np.flatnonzero(label == k).tolist()) > 1)


def test_line_sets():
    texts = ["", "b a b\n\n \t\nc", "long" * 200 + " " + "x" * 9 + "\n" + "x" * 17, "\u00e9 a\u00a0b a\x0bb\r\n", "a" + "\x00"]
    which, line, size, codes = lines.line_sets([t.encode() for t in texts], np.zeros(0, np.uint64))
    want = [(i, n, set(x.encode().split())) for i, t in enumerate(texts) for n, x in enumerate(t.split("\n")) if x.encode().split()]
    assert list(zip(which, line, size, strict=True)) == [(i, n, len(s)) for i, n, s in want]
    named = {}
    for (_, _, s), part in zip(want, np.split(codes, np.cumsum(size)[:-1]), strict=True):
        assert list(part) == sorted(part)
        for w in s:
            named[w] = int(lines.line_words([w])[2][0])
        assert {named[w] for w in s} == set(part.tolist())
    assert len(set(named.values())) == len(named)
    order = codes[::-3].copy()
    again = np.split(lines.line_sets([t.encode() for t in texts], order)[3], np.cumsum(size)[:-1])
    rank = {c: k + 1 for k, c in enumerate(order.tolist())}
    for part, before in zip(again, np.split(codes, np.cumsum(size)[:-1]), strict=True):
        assert list(part) == sorted(before, key=lambda c: (rank.get(int(c), 0), c))


def test_words_are_coded_in_pieces_that_stay_in_cache(monkeypatch):
    r = random.Random(4)
    texts = ["\n".join(" ".join(f"w{r.randrange(4000)}" for _ in range(12)) for _ in range(30)).encode() for _ in range(900)]
    order = lines.line_words(texts)[2][::5].copy()
    order = order[np.sort(np.unique(order, return_index=True)[1])]
    words, coded = lines.line_words, []
    monkeypatch.setattr(lines, "line_words", lambda some: coded.append(sum(map(len, some))) or words(some))
    pieces = lines.line_sets(texts, order)
    assert sum(coded) == sum(map(len, texts)) > 4 * max(coded) and max(coded) < (1 << 18) + 4096
    monkeypatch.setattr(lines, "CACHED_BYTES", 1 << 40, raising=False)
    assert all((a == b).all() for a, b in zip(pieces, lines.line_sets(texts, order), strict=True))


def test_undecided_lines_are_compared_where_sizes_and_parities_allow(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 60, rng.integers(5, 60))).astype(np.uint64) for _ in range(120)]
    sets += [np.append(s[:-1], np.uint64(7)) for s in sets[:10]]
    n = len(sets)
    doc, line = rng.permutation(n) // 2, np.zeros(n, np.int64)
    line[np.unique(doc, return_index=True)[1]] = 1
    undecided = np.arange(n) % 3 > 0
    near = lambda a, b: 10 * len(np.intersect1d(a, b)) >= 8 * len(np.union1d(a, b))
    want = {
        (doc[i], line[i]) for i in range(n) for j in range(n)
        if undecided[i] and (doc[j], line[j]) < (doc[i], line[i]) and near(sets[i], sets[j])
    }
    common, calls = np.intersect1d, []
    monkeypatch.setattr(np, "intersect1d", lambda *a, **k: calls.append(a) or common(*a, **k))
    for own in (np.zeros(n, np.int64), np.arange(n) % 2):
        columns = {"doc": doc, "line": line, "undecided": undecided, "cluster": np.full(n, 5), "_own": own}
        table = pa.table(columns | {"_i": np.zeros(n, np.int64), "_j": np.full(n, own.max()), "codes": [s.tobytes() for s in sets]})
        got = lines._settle(10, 8)(table)
        found = set(zip(got["doc"].to_pylist(), got["line"].to_pylist(), strict=True))
        assert found <= want and (own.any() or found == want)
    assert want and len(calls) < n


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 1 << 60, rng.integers(1, 200)).astype(np.uint64)
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 1 << 60, 5).astype(np.uint64)]))
        differ = np.bitwise_count((lines._parity(np.unique(a)) ^ lines._parity(b)).view(np.uint64)).sum()
        assert differ <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("depth", [3, 8, 10_000])
def test_suffix_array(depth):
    r = random.Random(depth)
    for _ in range(150):
        t = np.array([r.randint(1, r.choice([1, 2, 3, 257])) for _ in range(r.randint(0, 150))] + [0], dtype=np.int16)
        got = suffix.suffix_array(t, depth)
        assert sorted(got.tolist()) == list(range(len(t)))
        keys = [tuple(t[i : i + depth].tolist()) for i in got]
        assert keys == sorted(keys)


def test_anchors_depend_on_the_window_alone():
    r = random.Random(4)
    window = bytes(r.randrange(256) for _ in range(50))
    places = None
    for _ in range(20):
        front, back = (bytes(r.randrange(256) for _ in range(r.randrange(90))) for _ in range(2))
        at, codes = suffix.anchors(front + window + back, 50)
        inside = (at >= len(front)) & (at <= len(front) + 50 - suffix.GRAM)
        least = codes[inside].min()
        here = (at[inside][codes[inside] == least] - len(front)).tolist()
        places = places or here
        assert here == places


def brute_bytes(texts, length=50):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        edges, mine = np.zeros(len(b) + 1, int), set()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                edges[p] += 1
                edges[p + length] -= 1
            mine.add(s)
        seen |= mine
        gone = np.cumsum(edges)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_bytes(spark):
    texts = variants(6, 25) + ["é" * 60, "aé" * 40, "é" * 60, "short", "short", "z" * 500, "y" + "z" * 49, "z" * 50]
    got = {r.doc_id: r for r in suffix.repeated_bytes(make(spark, texts).repartition(3)).collect()}
    for i, (n, removed, spans, sha, kept) in enumerate(brute_bytes(texts)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, sha)
        assert (texts[i] or "").encode() == kept if r.kept is None else bytes(r.kept) == kept


def test_hot_anchors_are_split(spark, monkeypatch):
    r = random.Random(12)
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    phrase = word(16) + word(20)
    texts = [f"{word(60)}{r.choice('xy') * 30}{phrase}{r.choice('pq') * 8}{word(60)}" for _ in range(40)]
    texts += variants(6, 10)[:-1] + ["é" * 60, "aé" * 40, "z" * 500]
    monkeypatch.setattr(suffix, "HOT_ANCHOR", 6)
    monkeypatch.setattr(suffix, "hot_anchors", functools.partial(suffix.hot_anchors, sample=1))
    rows = make(spark, texts).repartition(3)
    hot = suffix.hot_anchors(rows.fillna(""), 50, 6)
    assert len(hot) and np.isin(suffix.anchors(texts[0].encode(), 50)[1], hot).any()
    got = {x.doc_id: x for x in suffix.repeated_bytes(rows).collect()}
    for i, (n, removed, spans, sha, _) in enumerate(brute_bytes(texts)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (n, removed, spans, sha)


def test_segments_hold_each_string_once():
    r = random.Random(5)
    texts = [bytes(r.choice(b"abc") for _ in range(r.choice([0, 10, 49, 50, 51, 300]))) for _ in range(60)]
    texts += [b"z" * 500, b"ab" * 200, b"", b"q" * 50]
    begins = np.cumsum([0, *map(len, texts)])
    text, at, many, code, _ = suffix.segments_of(texts, 50)
    places = [(i, a - begins[i] + k, c) for i, a, n, c in zip(text, at, many, code, strict=True) for k in range(n)]
    assert sorted(p[:2] for p in places) == [(i, k) for i, t in enumerate(texts) for k in range(len(t) - 49)]
    codes: dict = {}
    assert all(codes.setdefault(texts[i][k : k + 50], c) == c for i, k, c in places)


def test_only_strings_of_two_segments_are_sorted(monkeypatch):
    r = random.Random(6)
    word = lambda n: bytes(r.choice(b"abcdefgh") for _ in range(n))
    common, sorted_bytes = word(55), []
    pieces = [word(80) for _ in range(40)] + [common + word(20), word(20) + common]
    which = np.array([*range(42), 0, 0, 41])
    doc, begin = np.array([*range(100, 142), 300, 99, 150]), np.arange(45) * 1000
    whole = suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_array", lambda t, depth: (sorted_bytes.append(len(t)), whole(t, depth))[1])
    got = suffix.repeated_spans(pa.array(pieces, pa.large_binary()), which, doc, begin, 50)
    # 99 owns piece 0, 141 owns piece 41 but for its common part, which 140 owns
    want = [(100, 0, 80), (300, 42_000, 42_080), (150, 44_000, 44_075), (141, 41_020, 41_075)]
    assert sorted(zip(*(c.tolist() for c in got), strict=True)) == sorted(want)
    assert sum(sorted_bytes) < 500


def test_strings_of_hot_anchors_are_not_joined(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_ANCHOR", 2)
    monkeypatch.setattr(suffix, "hot_anchors", functools.partial(suffix.hot_anchors, sample=1))
    phrase = "".join(random.Random(8).choice("abcdefghij") for _ in range(70))
    rows = suffix.repeated_bytes(make(spark, [f"{phrase}{i:030d}" for i in range(8)]))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "piece" in line]
    assert {r.doc_id: r.n_removed for r in rows.collect()} == {0: 0} | {i: 99 for i in range(1, 8)}


def test_bytes_odd_rows(spark):
    long = "q" * 20 + "w" * 40
    rows = [(None, long), (1, long), (1, long), (2, long), (3, None)]
    got = suffix.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 60), (3, 0)]
    assert suffix.repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ranks_are_gapless(spark):
    rows = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(200)], "g int, v long")
    got = ranked(rows, ["g"], rows.v, "n").toPandas()
    for _, part in got.groupby("g", dropna=False):
        assert sorted(part.n) == list(range(len(part)))


def test_blocks_of_rows_that_differ(spark):
    """Every two rows of a key that differ in their component meet once, whatever the sizes."""
    from collections import Counter

    from proofspark.llm.blocks import blocked_apart

    sizes = {1: {10: 90, 11: 3, 12: 30}, 2: {10: 55, 13: 1}, 3: {14: 5, 15: 4}, 4: {16: 100, 17: 80}, 5: {18: 70}}
    rows, i = [], 0
    for token, comps in sizes.items():
        for comp, n in comps.items():
            rows += [(token, i + k, comp) for k in range(n)]
            i += n
    df = stored(spark.createDataFrame(rows, "token long, id long, comp long"))
    cells = blocked_apart(df, ["token"], "id", "comp", block=20, shard_rows=10)
    met, copies = Counter(), Counter()
    groups = {}
    for r in cells.collect():
        groups.setdefault((r._cell, r._i, r._j, r.token), []).append(r)
        copies[r.token] += 1
    for (_, i, j, _), members in groups.items():
        for x in members:
            for y in members:
                if x.id < y.id and x.comp != y.comp and (i == j or {x._own, y._own} == {i, j}):
                    met[x.id, y.id] += 1
    comp = {i: (t, c) for t, i, c in rows}
    want = {(x, y) for x in comp for y in comp if x < y and comp[x][0] == comp[y][0] and comp[x][1] != comp[y][1]}
    assert set(met) == want and set(met.values()) == {1}
    assert copies[5] == 0 and copies[2] <= 2 * 56 + 3
