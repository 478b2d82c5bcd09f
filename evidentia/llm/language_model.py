"""Language-model scoring by a hierarchical Pitman-Yor model.

Each context, the token before, has a restaurant where the tokens that follow it
are seated; all share the root restaurant as parent, whose customers are the tables
of its children, and the root's base is uniform over the known tokens and one unknown.
A seating matters only through the number of tables that serve a token, so a Gibbs
sweep draws that number for every (context, token) from its conditional: generalised
Stirling numbers times powers of the mass of a new table. Probabilities are
averaged over the samples of several sweeps, and a text's score is the sum of their logs.

The model is as large as the corpus and never in one place. Documents are cut into
chunks of some megabytes; a chunk asks the buckets that own its words and
(context, token) pairs, each of them once, and gets counts and tables back. Requests
and answers are few rows of packed arrays. Pairs belong to the bucket of their context;
those of a context with more than its share of the tokens are dealt over all
buckets. A bucket seats its restaurants with the parent's probabilities from token
counts; then the owners of words seat the root. That blocked order, and the
estimate of a dealt context's tables from a bucket's share, are the approximations made.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import SPACED_TABLE, _U, as_list, give_back, hash_words, mix64, renamed, table, text_blocks, written

#: Bytes of text in a chunk; tokens to a bucket; buckets at least.
CHUNK_BYTES, BUCKET_TOKENS, BUCKETS = 8 << 20, 2_000_000, 64
#: Discount and strength of the root and of contexts.
ROOT, CHILD = (0.5, 1.0), (0.8, 20.0)
BURN_IN, SAMPLES = 2, 2
#: Bytes of rows that go to a worker at a time.
BATCH = "8m"
#: Counts up to here have their number of tables drawn from the exact conditional.
EXACT = 128
END, START = _U(0x1D8E4E27C47D124F), _U(0xEB44ACCAB455D165)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed string; the bytes of equal place are put together."""
    parts = [(a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts))


def unpacked(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind))
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


# --- seating -------------------------------------------------------------------

_stirling: dict[float, np.ndarray] = {}


def stirling(discount: float) -> np.ndarray:
    """log of the generalised Stirling numbers of counts and tables up to EXACT."""
    if discount not in _stirling:
        s = np.full((EXACT + 1, EXACT + 1), -np.inf)
        s[1, 1] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            for n in range(1, EXACT):
                t = np.arange(1, n + 2)
                s[n + 1, 1 : n + 2] = np.logaddexp(s[n, t - 1], s[n, t] + np.log(np.maximum(n - discount * t, 1e-300)))
        _stirling[discount] = s
    return _stirling[discount]


def draw_tables(counts: np.ndarray, mass: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """A number of tables for each count, given the mass of a new table."""
    tables = np.minimum(counts, 1).astype(np.int64)
    if not len(counts):
        return tables
    logs, mass = stirling(discount), np.maximum(mass, 1e-300)
    start = np.minimum(counts, EXACT)
    order = np.argsort(start, kind="stable")
    values, at = np.unique(start[order], return_index=True)
    for c, rows in zip(values.tolist(), np.split(order, at[1:]), strict=True):
        if c < 2:
            continue
        for i in range(0, len(rows), 1 << 14):
            r = rows[i : i + (1 << 14)]
            p = logs[c, 1 : c + 1][None, :] + np.log(mass[r])[:, None] * np.arange(1, c + 1)
            p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
            tables[r] = 1 + (rng.random(len(r))[:, None] * p[:, -1:] > p).sum(axis=1)
    # later customers of frequent tokens, in runs that double
    rows, n = np.flatnonzero(counts > EXACT), float(EXACT)
    while len(rows):
        to = np.minimum(counts[rows], 2 * n)
        free = mass[rows] - discount * tables[rows]
        mean = mass[rows] * np.log((to + np.maximum(free, -n / 2)) / (n + np.maximum(free, -n / 2)))
        tables[rows] += np.minimum(rng.poisson(np.minimum(mean, 1e12)), (to - n).astype(np.int64))
        n *= 2
        rows = rows[counts[rows] > n]
    return tables


# --- chunks --------------------------------------------------------------------

CHUNK = "chunk long, n_tokens long, data binary"


def is_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def chunks(docs: DataFrame) -> DataFrame:
    """Chunks of (doc_id, held_out, text): documents, tokens as places in the chunk's
    sorted words, and how often each word occurs in training documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j, raw, offsets in text_blocks(batch.column(2), CHUNK_BYTES):
                h, first, _, _ = hash_words(raw, offsets, SPACED_TABLE)
                n = np.diff(first) + 1
                ends = np.cumsum(n) - 1
                tokens = np.insert(h, first[1:], END)
                words, places = np.unique(tokens, return_inverse=True)
                ids = batch.column(0)[i:j]
                held = np.array(batch.column(1)[i:j].to_pylist(), bool)
                train = np.bincount(places[np.repeat(~held, n)], minlength=len(words))
                data = packed(
                    np.array(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64), np.array(ids.is_null().to_numpy(zero_copy_only=False), np.uint8),
                    held.astype(np.uint8), n.astype(np.int64), places.astype(np.int32), words, train.astype(np.int64),
                )
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([int(ends[-1]) + 1], pa.int64()), pa.array([data], pa.binary())], names=["chunk", "n_tokens", "data"])
                number += 1
                del raw, offsets, h, n, ends, tokens, words, places, data
                give_back()

    return docs.select("doc_id", "held_out", "text").mapInArrow(cut, CHUNK)


MESSAGE = "kind string, bucket long, chunk long, data binary"


def messages(rows: list[tuple]) -> pa.Table:
    kind, bucket, chunk, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"kind": pa.array(kind, pa.string()), "bucket": pa.array(bucket, pa.int64()), "chunk": pa.array(chunk, pa.int64()), "data": pa.array(data, pa.binary())})


def owner(words: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(words ^ _U(0x5851F42D4C957F2D)) % _U(buckets)).astype(np.int64)


def split(owners: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, places in order) of what each bucket owns."""
    if not len(owners):
        return []
    order = np.argsort(owners, kind="stable")
    found, at = np.unique(owners[order], return_index=True)
    return [(int(b), rows) for b, rows in zip(found, np.split(order, at[1:]), strict=True)]


def merged(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct keys, sums of values, places of each list's keys in them)."""
    every, back = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(back, np.concatenate(values), len(every)).astype(np.int64)
    return every, sums, np.split(back, np.cumsum([len(k) for k in keys])[:-1])


def ask_words(chunked: DataFrame, buckets: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                *_, words, train = unpacked(data.as_py())
                rows = [("word", b, chunk, packed(deltas(words[r]), train[r])) for b, r in split(owner(words, buckets), buckets)]
                yield from messages(rows).to_batches()

    return chunked.mapInArrow(ask, MESSAGE)


def count_words(asked: pa.Table) -> pa.Table:
    """The training count of every word asked for; and the bucket's totals."""
    chunk = asked["chunk"].to_pylist()
    parts = [unpacked(x.as_py()) for x in asked["data"]]
    words, counts, back = merged([np.cumsum(k, dtype=_U) for k, _ in parts], [n for _, n in parts])
    bucket = asked["bucket"][0].as_py()
    rows = [("count", bucket, c, packed(counts[b])) for c, b in zip(chunk, back, strict=True)]
    ends = counts[words == END].sum()
    return messages([*rows, ("total", bucket, -1, packed(np.array([counts.sum(), (counts > 0).sum(), ends], np.int64)))])


def answers(received: pa.Table, kind: str) -> dict[int, list[np.ndarray]]:
    return {b.as_py(): unpacked(x.as_py()) for k, b, x in zip(received["kind"], received["bucket"], received["data"], strict=True) if k.as_py() == kind}


class Chunk:
    """A chunk with what the owners of its words have answered."""

    def __init__(self, data: bytes, received: pa.Table, buckets: int, totals: np.ndarray):
        self.ids, self.null, held, self.sizes, self.tokens, self.words, _ = unpacked(data)
        self.held, self.buckets = held.astype(bool), buckets
        self.n, self.v, self.documents = (int(x) for x in totals)
        self.owned = split(owner(self.words, buckets), buckets)
        self.counts = np.zeros(len(self.words), np.int64)
        found = answers(received, "count")
        for b, r in self.owned:
            self.counts[r] = found[b][0]

    def pairs(self) -> None:
        """Distinct (context, token) pairs by the bucket that owns them, and the pair of each token."""
        w = len(self.words)
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = w  # the start of a text
        before *= w + 1
        before += self.tokens
        pair, pair_of = np.unique(before, return_inverse=True)
        self.pair_of = pair_of.astype(np.int32)
        del before, pair_of
        self.u, self.w = pair // (w + 1), pair % (w + 1)
        train = np.repeat(~self.held, self.sizes)
        self.train = np.bincount(self.pair_of[train], minlength=len(pair))
        hashes = np.append(self.words, START)
        self.context_counts = np.append(self.counts, self.documents)
        end = np.searchsorted(self.words, END)
        self.context_counts[end] = 0  # nothing follows an end
        key = mix64(hashes[self.u] * _U(0x9E3779B97F4A7C15) + hashes[self.w])
        spread = self.context_counts[self.u] * 2 * self.buckets > self.n
        at = np.where(spread, owner(key, self.buckets), owner(hashes, self.buckets)[self.u])
        self.keys, self.hashes = key, hashes
        order = np.lexsort((key, self.u, at))
        found, starts = np.unique(at[order], return_index=True)
        self.pair_owners = [(int(b), r) for b, r in zip(found, np.split(order, starts[1:]), strict=True)]

    def parent(self) -> np.ndarray:
        """First estimate of the root's probabilities, in steps of a quarter of a power of two."""
        d, s = ROOT
        p = (np.maximum(self.counts - d, 0) + (s + d * self.v) / (self.v + 1)) / (s + max(self.n, 1))
        return np.clip(np.round(-4 * np.log2(p)), 0, 255).astype(np.uint8)

    def ask_pairs(self, chunk: int) -> pa.Table:
        self.pairs()
        parent, rows = self.parent(), []
        for b, r in self.pair_owners:
            u, first, n = np.unique(self.u[r], return_index=True, return_counts=True)
            # contexts in order of place, pairs of each in order of key: only the low 48 bits travel
            keys = self.keys[r] >> _U(16)
            rows.append(("pair", b, chunk, packed(self.hashes[u], self.context_counts[u], n, np.where(np.isin(np.arange(len(r)), first), keys, deltas(keys)), parent[self.w[r]], self.train[r])))
        return messages(rows)


def seat_pairs(asked: pa.Table, seed: int) -> pa.Table:
    """Gibbs sweeps over the restaurants of a bucket. Answers counts and tables of each pair
    to those that asked, and a context's tables to the owner of its word."""
    chunk, bucket = asked["chunk"].to_pylist(), asked["bucket"][0].as_py()
    contexts, sizes, keys, parents, trains = [], [], [], [], []
    for x in asked["data"]:
        u, total, n, delta, parent, train = unpacked(x.as_py())
        start = np.cumsum(n) - n
        sums = np.cumsum(delta, dtype=_U)
        base = np.where(start > 0, sums[start - 1], 0).astype(_U)
        keys.append(mix64(sums - np.repeat(base, n)) ^ mix64(np.repeat(u, n)))
        contexts.append(np.repeat(u, n))
        sizes.append(np.repeat(total, n))
        parents.append(parent)
        trains.append(train)
    every, counts, back = merged(keys, trains)
    one = np.unique(np.concatenate(keys), return_index=True)[1]
    context, total = np.concatenate(contexts)[one], np.concatenate(sizes)[one]
    parent = np.exp2(-np.concatenate(parents)[one] / 4.0)
    owners, of = np.unique(context, return_inverse=True)
    here = np.bincount(of, counts, len(owners))
    scale = np.bincount(of, total, len(owners)) / np.maximum(np.bincount(of, minlength=len(owners)), 1) / np.maximum(here, 1)
    d, s = CHILD
    rng = np.random.default_rng([seed, bucket])
    tables, samples = np.minimum(counts, 1), []
    several = np.flatnonzero(counts > 1)
    for sweep in range(BURN_IN + SAMPLES):
        seated = np.bincount(of, tables, len(owners)) * scale
        tables = tables.copy()
        tables[several] = draw_tables(counts[several], (s + d * seated[of[several]]) * parent[several], d, rng)
        if sweep >= BURN_IN:
            samples.append(tables)
    rows, taken = [], np.zeros(len(every), bool)
    for c, b in zip(chunk, back, strict=True):
        mine = ~taken[b]  # the first that asked passes the tables on to the token's owner
        taken[b] = True
        rows.append(("tables", bucket, c, packed(counts[b].astype(np.int32), mine.astype(np.uint8), *[t[b].astype(np.int32) for t in samples])))
    at = [np.bincount(of, t, len(owners)).astype(np.int64) for t in samples]
    some = at[0] > 0
    rows.append(("context", bucket, -1, packed(owners[some], *[t[some] for t in at])))
    return messages(rows)


def route_contexts(rows: pa.Table, buckets: int) -> list[tuple]:
    out = []
    for x in rows["data"]:
        words, *tables = unpacked(x.as_py())
        out += [("context", b, -1, packed(words[r], *[t[r] for t in tables])) for b, r in split(owner(words, buckets), buckets)]
    return out


def seat_root(asked: pa.Table, seed: int, v: int) -> pa.Table:
    """The root's customers and tables of every word asked for, and its tables as a context."""
    kinds, chunk = asked["kind"].to_pylist(), asked["chunk"].to_pylist()
    bucket, parts = asked["bucket"][0].as_py(), [unpacked(x.as_py()) for x in asked["data"]]
    words = [np.cumsum(p[0], dtype=_U) if k == "root" else p[0] for k, p in zip(kinds, parts, strict=True)]
    every, back = np.unique(np.concatenate(words), return_inverse=True)
    back = np.split(back, np.cumsum([len(w) for w in words])[:-1])
    d, s = ROOT
    rng, found, totals = np.random.default_rng([seed, bucket, 1]), [], []
    for k in range(SAMPLES):
        sums = {"root": np.zeros(len(every), np.int64), "context": np.zeros(len(every), np.int64)}
        for kind, p, b in zip(kinds, parts, back, strict=True):
            np.add.at(sums[kind], b, p[k + 1].astype(np.int64))
        customers = sums["root"]
        seated = np.minimum(customers, 1)
        for _ in range(BURN_IN + 1):
            whole = seated.sum() * v / max(1, (customers > 0).sum())  # words are dealt evenly
            seated = draw_tables(customers, np.full(len(every), (s + d * whole) / (v + 1)), d, rng)
        found += [customers, seated, sums["context"]]
        totals += [customers.sum(), seated.sum()]
    rows = [("root", bucket, c, packed(*[f[b] for f in found])) for kind, c, b in zip(kinds, chunk, back, strict=True) if kind == "root"]
    start = every == START
    starts = [int(found[3 * k + 2][start].sum()) for k in range(SAMPLES)]
    return messages([*rows, ("total", bucket, -1, packed(np.array([*totals, *starts], np.int64)))])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _totals(df: DataFrame, size: int) -> np.ndarray:
    """Sums of the buckets' totals: a few numbers from each bucket, added up as they come."""
    total = np.zeros(size, np.int64)
    for row in df.where("kind = 'total'").select("data").toLocalIterator():
        total += unpacked(bytes(row[0]))[0]
    return total


def score_documents(docs: DataFrame, seed: int = 11, each: bool = False) -> DataFrame:
    """Scores of (doc_id, held_out, text): doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score and score, a row for each row. each adds token_scores,
    the log10 probability of every token.

    Tokens are runs of all but white space, A-Z lower-cased, and one end to each text.
    The model learns from the documents that aren't held out. base_score sums
    log10((c + 1) / (N + V + 1)); score is the log10 probability by the Pitman-Yor
    model. A null text is empty and has the end alone. Repeated rows each count and
    are each scored, as are rows without doc_id. Where nothing is learned every token has
    the unknown's probability. A text of any length counts whole; an empty table gives
    no rows; other columns are ignored, whatever their names.
    """
    chunked = written(chunks(docs), "lm-chunks", BATCH)
    tokens = chunked.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(BUCKETS, -(-tokens // BUCKET_TOKENS))
    counted = written(ask_words(chunked, buckets).groupBy("bucket").applyInArrow(count_words, MESSAGE), "lm-counts", BATCH)
    totals = _totals(counted, 3)

    def ask(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        return Chunk(left["data"][0].as_py(), right, buckets, totals).ask_pairs(key[0].as_py()) if len(left) else messages([])

    def seat(rows: pa.Table) -> pa.Table:
        found = seat_pairs(rows, seed)
        give_back()
        return found

    by_chunk = chunked.groupBy("chunk")
    pairs = by_chunk.cogroup(counted.where("kind = 'count'").groupBy("chunk")).applyInArrow(ask, MESSAGE)
    seated = written(pairs.groupBy("bucket").applyInArrow(seat, MESSAGE), "lm-tables", BATCH)

    def ask_root(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        if not len(left):
            return messages([])
        c = Chunk(left["data"][0].as_py(), right, buckets, totals)
        c.pairs()
        found, sums = answers(right, "tables"), [np.zeros(len(c.words), np.int64) for _ in range(SAMPLES)]
        for b, r in c.pair_owners:
            _, mine, *tables = found[b]
            for s, t in zip(sums, tables, strict=True):
                np.add.at(s, c.w[r], t * mine.astype(np.int64))
        return messages([("root", b, key[0].as_py(), packed(deltas(c.words[r]), *[s[r] for s in sums])) for b, r in c.owned])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from messages(route_contexts(pa.Table.from_batches([batch]), buckets)).to_batches()

    v = int(totals[1])

    def root(rows: pa.Table) -> pa.Table:
        found = seat_root(rows, seed, v)
        give_back()
        return found

    told = counted.where("kind = 'count'").unionByName(seated.where("kind = 'tables'"))
    roots = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(ask_root, MESSAGE)
    contexts = seated.where("kind = 'context'").mapInArrow(route, MESSAGE)
    rooted = written(roots.unionByName(contexts).groupBy("bucket").applyInArrow(root, MESSAGE), "lm-root", BATCH)
    sums = _totals(rooted, 3 * SAMPLES)

    kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2] + [pa.list_(pa.float64())] * each
    schema = SCORES + ", token_scores array<double>" * each
    names = [x.split()[0] for x in schema.split(", ")]

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        if not len(left):
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds, strict=True)})
        c = Chunk(left["data"][0].as_py(), right, buckets, totals)
        c.pairs()
        tables, roots = answers(right, "tables"), answers(right, "root")
        count = np.zeros(len(c.u), np.int64)
        seats = [np.zeros(len(c.u), np.int64) for _ in range(SAMPLES)]
        for b, r in c.pair_owners:
            count[r], _, *t = tables[b]
            for s, x in zip(seats, t, strict=True):
                s[r] = x
        (d0, s0), (d, s) = ROOT, CHILD
        whole, p = c.context_counts[c.u], np.zeros(len(c.u))
        for k in range(SAMPLES):
            customers, at_root, as_context = (np.zeros(len(c.words), np.int64) for _ in range(3))
            for b, r in c.owned:
                customers[r], at_root[r], as_context[r] = roots[b][3 * k : 3 * k + 3]
            parent = (customers - d0 * at_root + (s0 + d0 * sums[2 * k + 1]) / (c.v + 1)) / (s0 + sums[2 * k])
            mine = np.append(as_context, sums[2 * SAMPLES + k])[c.u]
            mine[whole == 0] = 0
            p += ((count - d * seats[k]) + (s + d * mine) * parent[c.w]) / (s + whole)
        logs = np.log10(p / SAMPLES)[c.pair_of]
        known = c.counts[c.tokens]
        base = np.log10((known + 1) / (c.n + c.v + 1))
        first = np.cumsum(c.sizes) - c.sizes
        ids = pa.array(c.ids, mask=c.null.astype(bool))
        columns = [
            ids, pa.array(c.held), pa.array(c.sizes), pa.array(np.add.reduceat((known > 0).astype(np.int64), first)), pa.array(np.full(len(ids), c.n, np.int64)),
            pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(logs, first)), *[as_list(logs, c.sizes, pa.float64())] * each,
        ]
        return pa.table(dict(zip(names, columns, strict=True)))

    everything = told.unionByName(rooted.where("kind = 'root'"))
    return by_chunk.cogroup(everything.groupBy("chunk")).applyInArrow(score, schema)


def perplexity(scores: DataFrame, column: str = "score") -> DataFrame:
    """Perplexity of all tokens of the held-out and of the other documents."""
    return scores.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum(column) / F.sum("n_tokens")).alias("perplexity"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = renamed(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return score_documents(docs.select("doc_id", is_held_out().alias("held_out"), "text"))
