from __future__ import annotations

import difflib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobtrail.llm import graph
from jobtrail.llm import order_minhash as om
from jobtrail.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_components(spark):
    chain = [(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(101, 140)] + [(5, 139), (7, 7), (3, 4), (4, 3)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 10 for i in range(10, 61)} | {i: 5 for i in [5, *range(100, 140)]} | {3: 3, 4: 3}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        before = 0
        for j, b in enumerate(y):
            before, row[j + 1] = row[j + 1], before + 1 if a == b else max(row[j], row[j + 1])
    return row[-1]


def test_similarity_is_the_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        x = np.array([rng.randrange(9) for _ in range(rng.randrange(1, 40))], np.uint64)
        y = np.array([rng.randrange(9) for _ in range(rng.randrange(1, 40))], np.uint64)
        common = lcs(x.tolist(), y.tolist())
        assert om.similarity(x, y, 100) == pytest.approx(common / (len(x) + len(y) - common))
        assert om.similarity(x, y, 3) <= om.similarity(x, y, 100)


def test_alignment_in_a_moving_window(monkeypatch):
    rng = random.Random(2)
    for steps, few in ((1, 0), (3, 8), (7, 0), (1024, 2)):
        monkeypatch.setattr(om, "STEPS", steps)
        monkeypatch.setattr(om, "FEW", few)
        for _ in range(100):
            x, y = (np.array([rng.randrange(5) for _ in range(rng.randrange(1, 60))], np.uint64) for _ in range(2))
            common = lcs(x.tolist(), y.tolist())
            assert om.similarity(x, y, 60) == pytest.approx(common / (len(x) + len(y) - common))


def test_very_long_near_copies_take_linear_memory():
    rng = np.random.default_rng(6)
    n = 300_000
    x = rng.integers(0, 2**62, n).astype(np.uint64)
    y = x.copy()
    changed = np.concatenate(([0, n - 1], rng.choice(np.arange(1, n - 1), n // 100, replace=False)))
    y[changed] = rng.integers(2**62, 2**63, len(changed)).astype(np.uint64)
    tracemalloc.start()
    try:
        found = om.similarity(x, y, n // 4 + om.K)
        assert tracemalloc.get_traced_memory()[1] < 200 << 20
    finally:
        tracemalloc.stop()
    assert found == (n - len(changed)) / (n + len(changed))


def brute_classes(texts):
    """Classes over all pairs that share a k-mer."""
    table = om.WordHashes()
    values = {i: om.kmers(table.of(t or "")) for i, t in texts.items()}
    values = {i: om.labelled(v) for i, v in values.items() if len(v)}
    holders, shared = defaultdict(list), Counter()
    for i in sorted(values):
        for v in values[i].tolist():
            for j in holders[v]:
                shared[j, i] += 1
            holders[v].append(i)
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, j), n in shared.items():
        if n >= om.SIMILAR * (len(values[i]) + len(values[j]) - n) - 1e-9 and root(i) != root(j):
            if om.similarity(values[i], values[j], 10**6) >= om.SIMILAR:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in texts}


def test_classes_of_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_order_minhash"](spark, SF).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(texts) and len(rows) == len(texts)
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)


def test_hub_with_far_copies_and_edge_cases(docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(200)]
    given = {1000: " ".join(base)}
    for i in range(700):  # more than a block; each copy is near the original, few are near each other
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(200)] = word()
        given[i + 1] = " ".join(copy)
    moved = base[100:] + base[:100]
    given |= {2000: " ".join(moved), 2001: " ".join(base[:120] + [word() for _ in range(80)]), 2002: "one two", 2003: "One  two", 2004: "one three"}
    given |= {3000: None, 3001: "", 3002: " \n"}
    rows = docs(*given.items(), (None, "one two"), (2002, "one two")).withColumn("words", F.lit(1)).withColumn("part", F.lit(2)).withColumn("keys", F.lit("x"))
    got = {r.doc_id: r.class_id for r in om.near_duplicates(rows).collect()}
    assert got == brute_classes(given)
    assert got[1000] == 1 and got[2000] == 2000 and got[2001] == 2001 and got[2003] == 2002 and got[3001] == 3001
    kept = om.keep_first(rows)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*{*got.values()}, 2002, None], key=str)
    assert om.near_duplicates(docs()).count() == 0


def near_copies(n, length, most, seed):
    """Copies of one text, each with up to ``most`` words changed: some far from most others."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(length)]
    out = {}
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randrange(most)):
            copy[rng.randrange(length)] = word()
        out[i] = " ".join(copy)
    return out


@pytest.mark.parametrize("block", [2_000, 500_000])
def test_classes_of_copies_of_all_degrees(docs, monkeypatch, block):
    monkeypatch.setattr(om, "BLOCK", block)
    given = near_copies(400, 200, 7, seed=4) | {1000 + i: t for i, t in near_copies(60, 40, 3, seed=5).items()}
    got = {r.doc_id: r.class_id for r in om.near_duplicates(docs(*given.items())).collect()}
    assert got == brute_classes(given)
    assert 2 < len(set(got.values())) < 300


def test_pairs_stay_in_proportion_to_the_texts(docs, monkeypatch):
    given = near_copies(5000, 200, 7, seed=7)
    made = []
    verified, between = om._verified, om._between_parts
    monkeypatch.setattr(om, "_verified", lambda pairs, texts: made.append(pairs.count()) or verified(pairs, texts))
    monkeypatch.setattr(om, "_between_parts", lambda apart, texts: made.append((links := between(apart, texts)).count()) or links)
    om.near_duplicates(docs(*given.items())).count()
    assert len(made) > 1 and sum(made) < 5 * len(given)


def test_very_long_texts_through_the_query(docs):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    other = list(base)
    for i in range(0, len(other), 100):
        other[i] = "changed"
    given = {1: " ".join(base), 2: " ".join(other), 3: " ".join(base[:60_000])}
    assert {r.doc_id: r.class_id for r in om.near_duplicates(docs(*given.items())).collect()} == {1: 1, 2: 1, 3: 3}


def test_order_matters():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**62, 400).astype(np.uint64)
    swapped = np.concatenate([x[200:], x[:200]])
    assert (om.sketches(x) == om.sketches(swapped)).mean() < 0.6
    assert difflib.SequenceMatcher(None, x.tolist(), swapped.tolist(), False).ratio() == 0.5
