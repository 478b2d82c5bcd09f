"""The exact nearest chunks of a set of claims that is too large to go to every task.

Both sides are dealt to clusters around centres of a bounded sample, each with a radius, and
kept as blocks of vectors. Two clusters bound the scores between them: with centres a and b
and radii r and s no score is over a.b + |a| s + |b| r + r s. Each claim cluster visits chunk
clusters in order of that bound, four times as many a round; what is left is left out only if its
bound is under the k-th score of every claim of the cluster, or under the least score asked for.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from evidentia.plans.barrier import shared_folder

#: Rows that centres are fitted on, clusters at most, vectors of a block, clusters visited first and growth by round.
SAMPLE, CLUSTERS, BLOCK, FIRST, GROWTH = 20_000, 1024, 512, 2, 4
#: What rounding may take from a bound, as a share of the lengths it is made of.
SLACK = 1e-9


def fitted_centres(vectors: DataFrame, clusters: int, sample: int = SAMPLE, rounds: int = 3) -> dict[int, np.ndarray]:
    """By length of vector, centres of at most `sample` vectors (id, v), the first by hash: each
    begins as the vector farthest from those before it, so that groups apart have centres of their own."""
    some = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"]
    out = {}
    for n in sorted({len(v) for v in some}):
        x = np.array([v for v in some if len(v) == n], float)
        at, far = [0], ((x - x[0]) ** 2).sum(1)
        while len(at) < clusters and far.max() > 0:
            at.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(1))
        c = x[at].copy()
        for _ in range(rounds):
            own = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
            for i in np.unique(own):
                c[i] = x[own == i].mean(0)
        out[n] = c
    return out


def clustered(vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """(id, size, cluster, away, v): each vector with its nearest centre. Lengths that no centre has have none: they meet nothing."""
    held = vectors.sparkSession.sparkContext.broadcast(centres)
    kind = vectors.schema["id"].dataType
    names = ["id", "size", "cluster", "away", "v"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            length = np.asarray(lists.value_lengths())
            for n, c in held.value.items():
                at = np.flatnonzero(length == n)
                if not len(at):
                    continue
                x = np.asarray(lists.take(pa.array(at)).flatten(), float).reshape(len(at), n)
                own = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
                away = np.sqrt(((x - c[own]) ** 2).sum(1))
                columns = [batch.column(0).take(pa.array(at)).cast(to_arrow_type(kind)), pa.array(np.full(len(at), n, np.int32)), pa.array(own.astype(np.int32)), pa.array(away), lists.take(pa.array(at))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return vectors.select("id", "v").mapInArrow(deal, f"id {kind.simpleString()}, size int, cluster int, away double, v array<double>")


def blocks(rows: DataFrame, stats: DataFrame, block: int = BLOCK) -> DataFrame:
    """(size, cluster, part, ids, vectors): a cluster's vectors by hash in parts of about `block`."""
    parts = F.ceil(F.col("n") / block).cast("int")
    dealt = rows.join(F.broadcast(stats.select("size", "cluster", "n")), ["size", "cluster"]).withColumn("part", F.pmod(F.xxhash64("id"), parts))
    return dealt.groupBy("size", "cluster", "part").agg(F.collect_list(F.struct("id", "v")).alias("rows")).select("size", "cluster", "part", F.col("rows.id").alias("ids"), F.col("rows.v").alias("vectors"))


def bounds(claims: DataFrame, centres: dict[int, np.ndarray], chunks: list[tuple[int, int, float, int]]) -> DataFrame:
    """(size, a, b, bound, place) of claim clusters (size, cluster, radius) and chunk clusters (size, cluster, radius, n), place by bound from 0."""
    held = claims.sparkSession.sparkContext.broadcast((centres, chunks))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size, others = held.value
        for batch in batches:
            for size, a, radius in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                mine = [(b, s) for n, b, s, _ in others if n == size]
                if not mine:
                    continue
                c = by_size[size]
                b, s = np.array([m[0] for m in mine]), np.array([m[1] for m in mine])
                la, lb = np.linalg.norm(c[a]), np.linalg.norm(c[b], axis=1)
                top = c[b] @ c[a] + la * s + lb * radius + radius * s + SLACK * (la + radius) * (lb + s)
                order = np.argsort(-top, kind="stable")
                n = len(order)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, a, np.int32)), pa.array(b[order].astype(np.int32)), pa.array(top[order]), pa.array(np.arange(n, dtype=np.int32))], names=["size", "a", "b", "bound", "place"])

    return claims.select("size", "cluster", "radius").mapInArrow(pairs, "size int, a int, b int, bound double, place int")


def products(pairs: DataFrame, claims: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(size, cluster, claim_id, chunk_id, score): of each pair of blocks in pairs (size, a, b) the k best of each claim."""
    both = pairs.join(claims.select("size", F.col("cluster").alias("a"), F.col("ids").alias("claim_ids"), F.col("vectors").alias("claim_vectors")), ["size", "a"]).join(chunks.select("size", F.col("cluster").alias("b"), "ids", "vectors"), ["size", "b"])
    out = f"size int, cluster int, claim_id {claims.schema['ids'].dataType.elementType.simpleString()}, chunk_id {chunks.schema['ids'].dataType.elementType.simpleString()}, score double"
    schema = to_arrow_schema(StructType.fromDDL(out))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                size, a = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                asked, ids = batch.column(2)[r].as_py(), batch.column(4)[r].as_py()
                q, x = (np.asarray(batch.column(i)[r].values.flatten(), float).reshape(-1, size) for i in (3, 5))
                scores = np.einsum("cd,qd->qc", x, q)  # equal vectors have equal scores
                rows = []
                for claim, own in zip(asked, scores, strict=True):
                    few = np.flatnonzero(own >= np.partition(own, -k - 1)[-k - 1]) if len(own) > k + 1 else range(len(own))
                    best = sorted((-own[c], ids[c]) for c in few if ids[c] != claim)[:k]
                    rows += [(size, a, claim, c, -s) for s, c in best]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return both.select("size", "a", "claim_ids", "claim_vectors", "ids", "vectors").mapInArrow(multiply, out)


def nearest(claims: DataFrame, chunks: DataFrame, k: int, least: float = -math.inf, clusters: int | None = None, block: int = BLOCK, visited: list[int] | None = None) -> DataFrame:
    """(claim_id, chunk_id, score) of the k chunks (id, v) nearest to each claim (id, v) by dot product.

    Vectors are arrays of doubles without nulls; lengths that differ don't meet, nor does a chunk a claim of its id. Of
    equal scores the least chunk id counts. Scores under `least` may be missing. Each table, with each round's
    best, is written to the shared folder. visited, if given, gets the pairs of clusters of each round.
    """
    spark = claims.sparkSession
    folder = f"{shared_folder(spark)}/nearest/{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    n = chunks.count()
    centres = fitted_centres(chunks, clusters or max(1, min(CLUSTERS, n // block)))
    sides, stats = [], []
    for name, rows in (("claims", claims), ("chunks", chunks)):
        dealt = kept(clustered(rows, centres), f"{name}-dealt")
        stats.append(kept(dealt.groupBy("size", "cluster").agg(F.max("away").alias("radius"), F.count("*").alias("n")), f"{name}-clusters"))
        sides.append(kept(blocks(dealt, stats[-1], block), name))
    others = [(r["size"], r["cluster"], r["radius"], r["n"]) for r in stats[1].collect()]  # as many as clusters
    pairs = kept(bounds(stats[0], centres, others).where(F.col("bound") >= least), "pairs")
    out = f"size int, cluster int, claim_id {claims.schema['id'].dataType.simpleString()}, chunk_id {chunks.schema['id'].dataType.simpleString()}, score double"
    best, low, upto, turn = spark.createDataFrame([], out), 0, FIRST, 0
    rank = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("score"), "chunk_id"))
    while True:
        # the k-th score of a cluster's claims, the lowest; none while a claim has fewer
        each = best.groupBy("size", "cluster", "claim_id").agg(F.min("score").alias("s"), F.count("*").alias("found"))
        done = each.where(F.col("found") == k).groupBy("size", "cluster").agg(F.min("s").alias("s"), F.count("*").alias("m"))
        full = stats[0].join(done, ["size", "cluster"]).where("m = n").select("size", F.col("cluster").alias("a"), "s")
        todo = pairs.where(F.col("place") >= low).join(F.broadcast(full), ["size", "a"], "left").where(F.col("s").isNull() | (F.col("bound") >= F.col("s")))
        if visited is not None:
            visited.append(todo.where(F.col("place") < upto).count())
        if todo.isEmpty():
            return best.select("claim_id", "chunk_id", "score")
        more = products(todo.where(F.col("place") < upto).select("size", "a", "b"), *sides, k)
        best = kept(best.unionByName(more).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), f"best-{turn}")
        low, upto, turn = upto, upto * GROWTH, turn + 1
