"""Exact nearest chunks by clusters against all products, and the choice of way by size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import evidence as E
from evidentia.operators import nearest as N


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, v array<double>")


def by_hand(claims, chunks, k):
    out = {}
    for i, v in claims:
        scored = sorted((-float(np.einsum("d,d->", np.asarray(v, float), np.asarray(w, float))), j) for j, w in chunks if len(v) == len(w) and i != j)
        for rank, (s, j) in enumerate(scored[:k], 1):
            out[i, rank] = (j, -s)
    return out


def rows_of(seed, n, dim, groups, spread, start=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    x = centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))
    return list(enumerate(x / np.linalg.norm(x, axis=1, keepdims=True), start))


def ranked(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.claim_id, []).append((-r.score, r.chunk_id))
    return {(c, n): (j, -s) for c, own in out.items() for n, (s, j) in enumerate(sorted(own), 1)}


def same(got, want):
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


@pytest.mark.parametrize(("groups", "spread", "k"), [(12, 0.02, 4), (1, 1.0, 3)])
def test_equal_to_all_products(spark, groups, spread, k):
    chunks = rows_of(1, 900, 6, groups, spread)
    claims = [*chunks[:40:2], *rows_of(2, 40, 6, groups, spread, start=5000)]
    chunks += [(7001, chunks[0][1]), (7000, chunks[0][1])]  # equal vectors: the lesser id comes first
    visited = []
    got = N.nearest(table(spark, claims), table(spark, chunks), k, clusters=16, block=20, visited=visited)
    same(ranked(got), by_hand(claims, chunks, k))
    if groups > 1:  # clusters apart: most pairs are left out
        assert sum(visited) < 16 * 16 / 2


def test_few_chunks_other_lengths_and_nothing(spark):
    claims = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0]), (4, [1.0, 1.0, 1.0])]
    chunks = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (9, [2.0])]
    same(ranked(N.nearest(table(spark, claims), table(spark, chunks), 5, clusters=2, block=1)), by_hand(claims, chunks, 5))
    assert N.nearest(table(spark, claims), table(spark, []), 5).count() == 0 == N.nearest(table(spark, []), table(spark, chunks), 5).count()


def test_both_ways_agree_and_claims_are_made_once(spark, sf, monkeypatch):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def embed(vectors):
        made.add(len(vectors))
        return vectors

    claims = lambda: e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("claim_id"), embed(F.col("embedding").cast("array<double>")).alias("claim_vec"))
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("chunk_vec"))
    small = {(r.claim_id, r["rank"]): (r.chunk_id, r.score) for r in E.top_similar(claims(), chunks, 5, 0.25).collect()}
    n = claims().count()
    before = made.value
    monkeypatch.setattr(E, "CLAIM_BYTES", 0)
    large = {(r.claim_id, r["rank"]): (r.chunk_id, r.score) for r in E.top_similar(claims(), chunks, 5, 0.25).collect()}
    assert before >= n and made.value - before == n and large == small and small
