"""The embedding graph against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.llm import embedding_graph as eg
from evidentia.llm.common import table


def brute(rows, least=0.93):
    """vec_id -> (n_links, component) of (vec_id, label, embedding)."""
    links = {v: set() for v, _, _ in rows}

    def fine(e):
        return e is not None and all(c is not None and np.isfinite(c) for c in e) and any(e)

    use = [(v, lab, np.array(e, float)) for v, lab, e in rows if lab is not None and fine(e)]
    for lab in {u[1] for u in use}:
        own = [u for u in use if u[1] == lab]
        for i, (v, _, a) in enumerate(own):
            for w, _, b in own[:i]:
                if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                    links[v].add(w)
                    links[w].add(v)
    out = {}
    for v in links:
        todo, seen = [v], {v}
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[v] = len(links[v]), min(seen)
    return out


def clusters(n, groups, seed, noise=0.02, dim=32):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, dim))
    return [(i, int(i % 3), (base[rng.integers(groups)] + noise * rng.normal(size=dim) * rng.integers(0, 12)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize(("shard", "least"), [(100_000, 1.0), (150, 0.9)])
def test_links_equal_brute_force(spark, shard, least):
    rows = clusters(1500, 60, 1)
    rows += [(2000 + i, 1, rows[1][2]) for i in range(40)]  # copies
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in eg.near_duplicate_vectors(df, shard=shard).collect()}
    want = brute(rows)
    assert all(got[v][0] <= want[v][0] for v in want)  # none below the threshold, none twice
    recall = sum(n for n, _ in got.values()) / sum(n for n, _ in want.values())
    assert recall >= (0.995 if least == 1.0 else least)
    if recall == 1:
        assert got == want


@pytest.mark.parametrize(("dim", "shard"), [(4, 300), (4, 75), (4, 19), (64, 75), (64, 19)])
def test_no_border_loses_links(spark, dim, shard):
    """4 to 64 clusters, of vectors that fill all dimensions alike and have pairs of cosine 0.93 to 0.99."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 600, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    cos = rng.uniform(0.93, 0.99, 600)[:, None]
    x = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * b])
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: r.n_links for r in eg.near_duplicate_vectors(df, shard=shard).collect()}
    recall = sum(got.values()) / want.sum()
    print(f"dim {dim} shard {shard}: recall {recall:.4f}")
    assert recall >= 0.999 and all(got[i] <= want[i] for i in got)


def test_recall_on_the_table(spark, sf):
    df = table(spark, sf, "embeddings")
    out = eg.op8_embedding_graph(spark, sf)
    want = brute([(r.vec_id, r.label, r.embedding) for r in df.collect()])
    got = {r.vec_id: (r.n_links, r.component_id) for r in out.collect()}
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values()) and set(got) == set(want)
    found, there = eg.audit_recall(df, out)
    assert there == sum(want[v][0] for v in want if v % 100 == 0) and found >= 0.9 * there


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 1, [1.0, 0.0]), (2, 1, [2.0, 0.0]), (3, 2, [1.0, 0.0]), (4, None, [1.0, 0.0]), (5, 1, None), (6, 1, [0.0, 0.0]), (7, 1, [nan, 1.0]), (8, 1, [inf, 0.0]), (9, 1, [None, 1.0]),
        (10, 1, []), (11, 1, [1.0, 0.0, 0.0]), (12, 1, [1e300, 1e299]), (13, 1, [1e-300, 1e-301]), (14, 1, [1.0, 0.0]), (15, 1, [0.0, -1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("copies", F.lit("x")).withColumn("shard", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in eg.near_duplicate_vectors(df).collect()}
    assert all(got[v] == (4, 1, v == 1) for v in (1, 2, 12, 13, 14))
    assert all(got[v] == (0, v, True) for v in (3, 4, 5, 6, 7, 8, 9, 10, 11, 15))
    assert eg.near_duplicate_vectors(df.limit(0)).count() == 0
    twice = {(r.vec_id, r.n_links) for r in eg.near_duplicate_vectors(df.where("vec_id = 3").unionAll(df.where("vec_id = 3"))).collect()}
    assert twice == {(3, 1)}


def test_robust_pruning_equals_plain_loops():
    rng = np.random.default_rng(2)
    x = eg.unit(rng.normal(size=(5, 6))[rng.integers(5, size=80)] + 0.3 * rng.normal(size=(80, 6)))
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    near = np.argsort(-sims, axis=1)[:, :30]
    got = eg.pruned(x, np.take_along_axis(sims, near, axis=1), near, degree=8, alpha=1.44)
    for i in range(len(x)):
        kept = []
        for c in near[i]:
            if len(kept) < 8 and not any(1.44 * (2 - 2 * x[k] @ x[c]) <= 2 - 2 * sims[i, c] for k in kept):
                kept.append(c)
        assert 0 < len(kept) <= 8 and got[i].tolist() == (kept + [c for c in near[i] if c not in kept])[:8]


def test_search_follows_lists_beyond_the_beam():
    """A dense crowd larger than the beam is found whole from medoids, over its lists; without lists only medoids are met."""
    rng = np.random.default_rng(3)
    x = eg.unit(np.concatenate([rng.normal(size=(700, 16)), rng.normal(size=16) + 0.03 * rng.normal(size=(300, 16))])).astype(np.float32)
    built = eg._build(pa.table({"label": ["a"] * 1000, "dim": [16] * 1000, "node": np.arange(1000), "embedding": eg.as_list(x.ravel().astype(float), np.full(1000, 16), pa.float64())}))
    lists = eg.followed(x, np.arange(1000), built["near"].combine_chunks())
    row, to = eg.searched(x[900:], x, lists, eg.medoids(x), 0.93)
    want = x[900:] @ x.T >= 0.93
    assert len(row) == len(set(zip(row.tolist(), to.tolist(), strict=True))) and (x[900 + row] * x[to]).sum(axis=1).min() > 0.9299
    assert want.sum() > 100 * eg.BEAM and len(row) >= 0.999 * want.sum()
    row, to = eg.searched(x[900:], x, np.full_like(lists, -1), eg.medoids(x), 0.93)
    assert len(row) < 0.5 * want.sum()
