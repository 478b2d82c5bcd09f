"""Near-duplicate embeddings: a robust-pruned flat graph, searched in range from medoids.

Vectors of one label are dealt to clusters, each to its nearest as its home and to the
second nearest beside it. In each of these overlapping shards every vector gets a list of
neighbours: of its nearest candidates those that no nearer one covers (robust pruning), filled
up with the nearest left. The lists a vector got in its shards are united.

Each shard then searches the united lists of all its vectors: from the medoids nearest
to a query a beam goes greedily to the nearest vectors, then all neighbours of vectors in
range are followed until none is new. Found pairs are verified by cosine in double
precision. A vector is a query at its home, and also a guest of every cluster whose border is
so near that a vector in range of it can be at home beyond (see reached()): so no border
loses a link, and a link is missed only where a search misses it, which audit_recall() measures.

How many clusters a vector is a guest of depends on the vectors: where they fill all
dimensions alike it is a quarter of them, and searches grow as the square of a label's size.

Equal vectors are one point with a number of copies, so a very common vector is one
point. A pair counts in one shard, so counts add up and no list of pairs leaves a task; a
shard passes on counts and a star of links for each of its components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import as_list, mix64, renamed, table, written
from evidentia.llm.components import components

COSINE = 0.93
#: Vectors at home in a shard, clusters of all labels and vectors to fit them on at most.
SHARD, CLUSTERS, SAMPLE = 4096, 4096, 40_000
#: Clusters of a label for each part that the guests of a shard come in.
GUESTS = 16
#: Candidates and neighbours of a vector in a shard; a nearer neighbour covers a candidate
#: if ALPHA times their squared distance is at most the candidate's from the vector.
CANDIDATES, DEGREE, ALPHA = 48, 24, 1.44
#: Neighbours followed from a vector: its united lists, and vectors that list it.
WIDTH = 64
#: Medoids of a shard, vectors a search keeps in view, and how many it goes on from at a time.
MEDOIDS, BEAM, STEP = 64, 48, 4
#: Queries searched at a time, and vectors in range that are gone on from at a time.
BATCH, SPREAD = 256, 16_384


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small ones stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(column.flatten(), np.float64)
    return values.reshape(len(column), -1)


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    c = x[np.random.default_rng(k).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, x)
        full = np.bincount(nearest, minlength=len(c)) > 0
        c[full] = unit(sums[full] + 1e-12)
    return c


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that can link: a label, and a vector of finite components that aren't all zero."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return vectors.where(
        F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(F.forall("embedding", fine), F.lit(False)) & F.exists("embedding", lambda v: v != 0)
    )


def _fit(points: DataFrame, shard: int) -> dict[tuple, np.ndarray]:
    """Centroids of each (label, dim) that needs more than a shard, on a sample bounded by SAMPLE."""
    sizes = {(r.label, r.dim): r.n for r in points.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > shard).collect()}
    want = {k: -(-n // shard) for k, n in sizes.items()}
    whole = sum(want.values())
    want = {k: max(2, min(n, n * CLUSTERS // whole)) for k, n in want.items()}
    out = {}
    if want:
        share = min(1.0, SAMPLE / sum(sizes.values()))
        sample = points.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 20)) < share * (1 << 20)).select("label", "dim", "embedding").toPandas()
        for key, rows in sample.groupby(["label", "dim"]):
            if key in want:
                out[key] = centroids(unit(np.stack(rows["embedding"].to_numpy()).astype(np.float64)), want[key])
    return out


#: What a row is in a shard: at home, a member as in its second nearest cluster, or a guest.
HOME, SECOND, GUEST = 0, 1, 2
POINTS = "label string, dim int, shard int, part int, kind int, node long, copies long, near array<long>, embedding array<double>"


def reached(x: np.ndarray, c: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, whether a unit vector with `cosine` or more to it can be at home in each cluster) of unit vectors.

    Home is the nearest centroid, a. A partner y at home in c has (c - a) y >= 0, and lies
    at most the angle of `cosine` from x, so x is at most its sine below that border.
    """
    sims = x @ c.T
    home = np.argmax(sims, axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
    sine = np.sqrt(1 - cosine * cosine) if 0 < cosine < 1 else float(cosine <= 0)
    return home, sims - sims[np.arange(len(x)), home][:, None] >= -sine * apart[home] - 1e-6


def _deal(points: DataFrame, fitted: dict[tuple, np.ndarray], cosine: float, guests: bool) -> DataFrame:
    """Every vector in its home shard and its second nearest, and as a guest where a partner can be at home.

    One of two clusters sends its guests to the other, chosen so that each sends to half.
    The guests of a shard come in parts, each with all its members.
    """
    held = points.sparkSession.sparkContext.broadcast(fitted)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, dim in {(g["label"], g["dim"]) for g in batch.select(["label", "dim"]).to_pylist()}:
                own = pa.Table.from_batches([batch]).filter((pc.field("label") == label) & (pc.field("dim") == dim)).combine_chunks()
                raw, nodes = matrix(own["embedding"]), own["node"].to_numpy()
                c = held.value.get((label, dim))
                c = np.zeros((1, dim)) if c is None else c
                k = len(c)
                parts, step = -(-k // GUESTS) if guests else 1, max(1, (1 << 20) // k)
                for i in range(0, len(raw), step):
                    home, reach = reached(unit(raw[i : i + step]), c, cosine)
                    at, groups = np.arange(len(home)), [(np.arange(len(home)), home, HOME)]
                    if k > 1:
                        sims = unit(raw[i : i + step]) @ c.T
                        sims[at, home] = -np.inf
                        groups.append((at, np.argmax(sims, axis=1), SECOND))
                    row = np.concatenate([np.repeat(r, parts) for r, _, _ in groups])
                    shard = np.concatenate([np.repeat(to, parts) for _, to, _ in groups])
                    kind = np.concatenate([np.full(len(r) * parts, kind) for r, _, kind in groups])
                    part = np.tile(np.arange(parts), len(row) // parts)
                    if guests:
                        other = np.arange(k)[None, :]
                        sends = (home[:, None] < other) != ((home[:, None] + other) % 2 == 1)
                        r, to = np.nonzero(reach & sends & (home[:, None] != other))
                        row, shard, kind = np.concatenate([row, r]), np.concatenate([shard, to]), np.concatenate([kind, np.full(len(r), GUEST)])
                        part = np.concatenate([part, (mix64(nodes[i + r].astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int64)])
                    for j in range(0, len(row), 8192):
                        r, some = pa.array(i + row[j : j + 8192]), kind[j : j + 8192]
                        near = own["near"].combine_chunks().take(pa.array(i + row[j : j + 8192], mask=some == GUEST))
                        n = len(some)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([label] * n, pa.string()), pa.array(np.full(n, dim, np.int32)), pa.array(shard[j : j + n].astype(np.int32)), pa.array(part[j : j + n].astype(np.int32)),
                                pa.array(some.astype(np.int32)), own["node"].combine_chunks().take(r), own["copies"].combine_chunks().take(r), near.cast(pa.list_(pa.int64())),
                                as_list(raw[i + row[j : j + n]].ravel(), np.full(n, dim), pa.float64()),
                            ],
                            names=[c.split()[0] for c in POINTS.split(", ")],
                        )

    return points.select("label", "dim", "node", "copies", "near", "embedding").mapInArrow(deal, POINTS)


LISTS = "label string, dim int, node long, near array<long>"


def pruned(x: np.ndarray, sims: np.ndarray, near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """The neighbours of each row of candidates (near, nearest first, at cosines sims): those
    that no nearer neighbour covers, then the nearest of the rest."""
    points = x[near]
    between, own = 2 - 2 * points @ points.transpose(0, 2, 1), 2 - 2 * sims
    open_, kept = np.ones(near.shape, bool), np.zeros(near.shape, bool)
    for j in range(near.shape[1]):
        kept[:, j] = open_[:, j] & (kept.sum(axis=1) < degree)
        open_ &= ~(kept[:, j, None] & (alpha * between[:, j] <= own))
    order = np.argsort(~kept, axis=1, kind="stable")[:, :degree]
    return np.take_along_axis(near, order, axis=1)


def _build(rows: pa.Table) -> pa.Table:
    """The list of neighbours of every member of a shard."""
    rows = rows.take(pa.array(np.argsort(rows["node"].to_numpy(), kind="stable")))
    x, node = unit(matrix(rows["embedding"])).astype(np.float32), rows["node"].to_numpy()
    n, out = len(x), []
    c = min(CANDIDATES, n - 1)
    for i in range(0, n if c else 0, BATCH):
        sims = x[i : i + BATCH] @ x.T
        at = np.arange(len(sims))[:, None]
        sims[at[:, 0], i + at[:, 0]] = -np.inf
        near = np.argpartition(-sims, c - 1, axis=1)[:, :c]
        near = np.take_along_axis(near, np.argsort(-sims[at, near], axis=1, kind="stable"), axis=1)
        out.append(node[pruned(x, sims[at, near], near)])
    lists = np.concatenate(out) if out else np.zeros((n, 0), np.int64)
    near = as_list(lists.ravel(), np.full(n, lists.shape[1]), pa.int64())
    return pa.table({"label": rows["label"], "dim": rows["dim"], "node": rows["node"], "near": near})


FOUND = "node long, n_links long, root long"


def followed(x: np.ndarray, node: np.ndarray, near: pa.ListArray) -> np.ndarray:
    """Places of the neighbours of each member, in WIDTH columns, -1 where there are fewer:
    those of its united lists that are members here, then the nearest that list it."""
    n, order = len(node), np.argsort(node, kind="stable")
    to, at = np.asarray(near.flatten(), np.int64), np.repeat(np.arange(n), np.asarray(near.value_lengths().fill_null(0), np.int64))
    place = order[np.minimum(np.searchsorted(node[order], to), n - 1)]
    at, place = at[node[place] == to], place[node[place] == to]
    key, first = np.unique(np.concatenate([at * n + place, place * n + at]), return_index=True)
    u, v, back = key // n, key % n, first >= len(at)
    sims = np.concatenate([np.zeros(0, np.float32), *[np.einsum("ij,ij->i", x[u[i : i + SPREAD]], x[v[i : i + SPREAD]]) for i in range(0, len(u), SPREAD)]])
    by = np.lexsort((-sims, back, u))
    u, v = u[by], v[by]
    rank = np.arange(len(u)) - np.searchsorted(u, u)
    out = np.full((n, WIDTH), -1, np.int64)
    some = (rank < WIDTH) & (u != v)
    out[u[some], rank[some]] = v[some]
    return out


def medoids(x: np.ndarray) -> np.ndarray:
    """The members nearest to the centres of MEDOIDS clusters of evenly taken ones."""
    c = centroids(x[:: max(1, len(x) // 4096)], MEDOIDS, rounds=3)
    return np.unique(np.argmax(c @ x.T, axis=1))


def searched(queries: np.ndarray, x: np.ndarray, lists: np.ndarray, starts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) of the pairs with a cosine of `least` or more that the search of some queries meets."""
    b, n = len(queries), len(x)
    seen, mark = np.zeros(b * n, bool), np.zeros(b * n, np.int32)
    hits = [np.zeros(0, np.int64)]

    def meet(row: np.ndarray, from_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, cosine) of neighbours not met before, each once, by row; those in range are hits."""
        to = lists[from_]
        key = (row[:, None] * n + to)[to >= 0]
        key = key[~seen[key]]
        mark[key] = np.arange(len(key), dtype=np.int32)
        key = np.sort(key[mark[key] == np.arange(len(key))])
        seen[key] = True
        sims = np.concatenate([np.zeros(0, np.float32), *[np.einsum("ij,ij->i", queries[key[i : i + SPREAD] // n], x[key[i : i + SPREAD] % n]) for i in range(0, len(key), SPREAD)]])
        hits.append(key[sims >= least])
        return key, sims

    view = queries @ x[starts].T
    row, col = np.nonzero(view >= least)
    hits.append(row * n + starts[col])
    seen[(np.arange(b)[:, None] * n + starts).ravel()] = True
    size = min(BEAM, len(starts))
    top = np.argpartition(-view, size - 1, axis=1)[:, :size]
    ids, near, live = starts[top], np.take_along_axis(view, top, axis=1), np.arange(b)
    done, gone = np.zeros(ids.shape, bool), [np.zeros(0, np.int64)]
    while len(live):
        open_ = np.where(done, -np.inf, near)
        pick = np.argsort(-open_, axis=1, kind="stable")[:, :STEP]
        fine = np.take_along_axis(open_, pick, axis=1) > -np.inf
        going = fine.any(axis=1)
        live, ids, near, done, pick, fine = live[going], ids[going], near[going], done[going], pick[going], fine[going]
        if not len(live):
            break
        r, c = np.nonzero(fine)
        c = pick[r, c]
        done[r, c] = True
        gone.append(live[r] * n + ids[r, c])
        key, sims = meet(live[r], ids[r, c])
        at = np.searchsorted(live, key // n)
        rank = np.arange(len(key)) - np.searchsorted(at, at)
        wide = int(rank.max()) + 1 if len(rank) else 0
        new_ids, new_near = np.zeros((len(live), wide), np.int64), np.full((len(live), wide), -np.inf, np.float32)
        new_ids[at, rank], new_near[at, rank] = key % n, sims
        ids, near, done = np.hstack([ids, new_ids]), np.hstack([near, new_near]), np.hstack([done, np.zeros(new_ids.shape, bool)])
        if ids.shape[1] > BEAM:
            top = np.argpartition(-near, BEAM - 1, axis=1)[:, :BEAM]
            ids, near, done = (np.take_along_axis(a, top, axis=1) for a in (ids, near, done))
    # all in range that the beam hasn't gone on from
    todo = np.setdiff1d(np.concatenate(hits), np.concatenate(gone))
    while len(todo):
        before = len(hits)
        for i in range(0, len(todo), SPREAD):
            meet(todo[i : i + SPREAD] // n, todo[i : i + SPREAD] % n)
        todo = np.concatenate(hits[before:])
    found = np.concatenate(hits)
    return found // n, found % n


def _links(least: float):
    def find(rows: pa.Table) -> pa.Table:
        order = np.lexsort((rows["node"].to_numpy(), rows["kind"].to_numpy()))
        rows = rows.take(pa.array(order))
        kind, node, raw, copies, n = rows["kind"].to_numpy(), rows["node"].to_numpy(), matrix(rows["embedding"]), rows["copies"].to_numpy(), len(rows)
        homes, members = int(np.searchsorted(kind, SECOND)), int(np.searchsorted(kind, GUEST))
        asked = np.arange(0 if rows["part"][0].as_py() == 0 else members, n)  # those at home ask in one part only
        asked = asked[(asked < homes) | (asked >= members)]
        pairs = [np.zeros((0, 2), np.int64)]
        if homes and len(asked):
            x = unit(raw).astype(np.float32)
            own = x[:members]
            lists, starts = followed(own, node[:members], rows["near"].combine_chunks()[:members]), medoids(own)
            for i in range(0, len(asked), BATCH):
                q, m = searched(x[asked[i : i + BATCH]], own, lists, starts, least - 1e-5)
                pairs.append(np.stack([asked[i + q], m], axis=1)[m < homes])
        pairs = np.concatenate(pairs)
        lo, hi = pairs.min(axis=1), pairs.max(axis=1)
        key = np.unique((lo * n + hi)[lo != hi])
        lo, hi = key // n, key % n
        keep = np.zeros(len(lo), bool)
        for i in range(0, len(lo), 1 << 18):
            a, b = lo[i : i + (1 << 18)], hi[i : i + (1 << 18)]
            scale_a, scale_b = np.abs(raw[a]).max(axis=1), np.abs(raw[b]).max(axis=1)
            u, v = raw[a] / scale_a[:, None], raw[b] / scale_b[:, None]
            cosine = (u * v).sum(axis=1) / (np.sqrt((u * u).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))
            keep[i : i + (1 << 18)] = cosine >= least
        lo, hi = lo[keep], hi[keep]
        links = (np.bincount(lo, copies[hi], n) + np.bincount(hi, copies[lo], n)).astype(np.int64)
        root = np.arange(n)
        while True:
            new = root.copy()
            np.minimum.at(new, lo, root[hi])
            np.minimum.at(new, hi, root[lo])
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = links > 0
        return pa.table({"node": pa.array(node[some]), "n_links": pa.array(links[some]), "root": pa.array(node[root[some]])})

    return find


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row.

    Rows link when labels are equal and not null and the cosine is `cosine` or more. A
    vector that is null, zero or holds null or non-finite components, or has no label,
    links with nothing; so do vectors of different lengths. Equal vectors link with
    each other. A search may miss links, never invent one; audit_recall() tells how many. An empty table gives no
    rows; other columns are ignored. A null vec_id takes
    part, but can't be a component's id unless it is alone.
    """
    rows = renamed(vectors, vec_id="vec_id", label="label", embedding="embedding").selectExpr("cast(vec_id as long) vec_id", "cast(label as string) label", "cast(embedding as array<double>) embedding")
    points = (
        usable(rows).withColumn("dim", F.size("embedding")).groupBy("label", "dim", "embedding")
        .agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    )
    points = written(points, "points")
    linkable = points.where("node is not null")
    fitted = _fit(linkable, shard)
    members = _deal(linkable.withColumn("near", F.lit(None).cast("array<long>")), fitted, cosine, guests=False)
    lists = members.groupBy("label", "dim", "shard").applyInArrow(_build, LISTS)
    lists = written(lists.groupBy("label", "dim", "node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "neighbours")
    dealt = _deal(linkable.join(lists, ["label", "dim", "node"], "left"), fitted, cosine, guests=True)
    found = written(dealt.groupBy("label", "dim", "shard", "part").applyInArrow(_links(cosine), FOUND), "vector-links")
    counts = found.groupBy("node").agg(F.sum("n_links").alias("other"))
    classes = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    answers = (
        points.join(counts, "node", "left").join(classes, "node", "left")
        .select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("other", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("c"))
    )
    return (
        rows.join(answers, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def audit_recall(vectors: DataFrame, found: DataFrame, cosine: float = COSINE, block: int = 4096) -> tuple[int, int]:
    """(links found, links there) of all vectors with an id divisible by 100, by brute force
    against all rows, `block` queries at a time."""
    rows = usable(vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")))
    asked = rows.where("vec_id % 100 = 0")
    blocks = max(1, -(-asked.count() // block))
    there = 0
    for k in range(blocks):
        held = vectors.sparkSession.sparkContext.broadcast(asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k).toPandas())

        def count(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            q = {key: (own["vec_id"].to_numpy(), unit(np.stack(own["embedding"].to_numpy()))) for key, own in held.value.groupby(["label", held.value["embedding"].str.len()])}
            for part in batches:
                for key, own in part.groupby(["label", part["embedding"].str.len()]):
                    if key in q:
                        hit = q[key][1] @ unit(np.stack(own["embedding"].to_numpy())).T >= cosine
                        hit &= q[key][0][:, None] != own["vec_id"].to_numpy()[None, :]
                        yield pd.DataFrame({"n": [int(hit.sum())]})

        there += rows.mapInPandas(count, "n long").agg(F.sum("n")).first()[0] or 0
        held.destroy()
    links = asked.select("vec_id").distinct().join(found, "vec_id").agg(F.sum("n_links")).first()[0]
    return int(links or 0), int(there)


def op8_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
