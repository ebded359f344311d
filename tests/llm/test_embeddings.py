from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobtrail.llm import projection_dedup as pd_
from jobtrail.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows):
    """(n_links, component) by comparing everything."""
    ok = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(ok)
    unit = {i: ok[i] / np.abs(ok[i]).max() for i in ids}
    unit = {i: u / np.linalg.norm(u) for i, u in unit.items()}
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    n = dict.fromkeys(parent, 0)
    for size in {len(u) for u in unit.values()}:
        at = [i for i in ids if len(unit[i]) == size]
        m = np.stack([unit[i] for i in at])
        for x, y in zip(*np.nonzero(np.triu(m @ m.T >= 0.95, 1))):
            n[at[x]] += 1
            n[at[y]] += 1
            a, b = root(at[x]), root(at[y])
            parent[max(a, b)] = min(a, b)
    return n, {i: root(i) for i in parent}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_table(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    n, comp = brute(rows)
    got = {r.vec_id: r for r in QUERIES["op10_projection_dedup"](spark, d).collect()}
    assert set(got) == set(n)
    assert all(got[i].n_links <= n[i] for i in n)  # no link below the threshold
    found, there = sum(r.n_links for r in got.values()), sum(n.values())
    assert found >= 0.98 * there
    assert sum(got[i].component_id == comp[i] for i in n) >= 0.98 * len(n)
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())


def test_large_and_wide_groups_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    center, wide = rng.standard_normal((2, 32))
    rows = [(i, (center + 0.06 * rng.standard_normal(32)).tolist()) for i in range(1, 700)]  # a tight group, more than a block
    rows += [(1000 + i, (wide + 0.21 * rng.standard_normal(32)).tolist()) for i in range(600)]  # some pairs link, some don't
    rows += [(3000 + i, rng.standard_normal(32).tolist()) for i in range(200)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 32), (5003, [1.0] * 31 + [None]), (5004, [float("nan")] * 32), (5005, [float("inf")] + [0.0] * 31)]
    rows += [(5006, [1.0, 0.0]), (5007, [1.0, 0.0]), (5008, [1e38] * 3), (5009, [1e38, 1e38, 0.9e38])]
    data = spark.createDataFrame([(i, v, 0) for i, v in [*rows, (5006, [1.0, 0.0]), (None, [1.0, 0.0])]], SCHEMA)
    data = data.withColumn("unit", F.lit(1)).withColumn("component", F.lit("x"))
    got = {r.vec_id: r for r in pd_.near_duplicates(data).collect()}
    n, comp = brute([(i, None if v is None else v) for i, v in rows])
    assert set(got) == {*n, None} and got[None].n_links == 0
    assert all(got[i].n_links == n[i] for i in n if i < 1000)  # counted exactly, whatever the windows
    big = [i for i in n if 1000 <= i < 2000]
    assert all(got[i].n_links <= n[i] for i in n) and sum(got[i].n_links for i in big) >= 0.95 * sum(n[i] for i in big)
    assert got[5006].n_links == got[5007].n_links == 1 and got[5007].component_id == 5006 and got[5009].component_id == 5008
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(5000, 5006))
    assert pd_.near_duplicates(data.limit(0)).count() == 0


def dense_topic(n, dims=64, seed=4):
    """n vectors at cosine 0.9 to one centre, every 20th with a partner near the threshold."""
    rng = np.random.default_rng(seed)
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    center = unit(rng.standard_normal(dims))
    aside = lambda: rng.standard_normal((n, dims))
    away = aside()
    first = 0.9 * center + np.sqrt(1 - 0.81) * unit(away - (away @ center)[:, None] * center)
    turn = aside()
    partner = 0.952 * first + np.sqrt(1 - 0.952**2) * unit(turn - (turn * first).sum(axis=1)[:, None] * first)
    return np.concatenate((first, partner[::20]))


@pytest.mark.parametrize("n, queries, least", [(3_000, 4_096, 1.0), (12_000, 1_500, 0.98)])
def test_isolated_pairs_of_a_dense_topic(spark, monkeypatch, n, queries, least):
    monkeypatch.setattr(pd_, "QUERIES", queries, raising=False)
    m = dense_topic(n)
    near = {(x, y) for x, y in zip(*np.nonzero(np.triu(m @ m.T >= 0.95, 1)))}
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.component_id for r in pd_.near_duplicates(data).collect()}
    assert len(near) >= n // 20 and sum(got[x] == got[y] for x, y in near) >= least * len(near)
