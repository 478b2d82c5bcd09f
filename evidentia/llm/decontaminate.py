"""Benchmark decontamination by winnowing.

Of each GUARD consecutive k-grams of words the least hash is kept as a fingerprint,
in documents and benchmark items alike, so any shared run of K + GUARD - 1 words
(here the 10 of a window) holds a fingerprint of both at the same place. Documents'
fingerprints are joined to the items', and each hit is extended word by word to both
sides; a run of 10 or more equal words is a set of occurring windows. Items with
fewer words are looked up whole.

The benchmark is taken in blocks of at most BLOCK_BYTES of text, each of which
goes to every task; its size is read before. One block is the usual case. With
more, each block is one pass over the documents and passes are merged by document. A
benchmark of more than JOIN_BYTES is joined by its windows (see window_join.py), in
one pass and with equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import as_list, give_back, hash_words, mix64, renamed, table, text_blocks

WINDOW = 10
K = 5
GUARD = WINDOW - K + 1
BLOCK_BYTES = 8 << 20
JOIN_BYTES = 4 * BLOCK_BYTES
#: Places of documents and items with equal hashes compared at a time.
PAIRS = 1 << 20
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def gram_hashes(words: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; all ones where its text has fewer left."""
    n = len(words)
    out = np.full(n, _TOP, np.uint64)
    if n >= k:
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h = h * np.uint64(0xBF58476D1CE4E5B9) + words[j : n - k + 1 + j]
        out[: n - k + 1] = mix64(h) >> np.uint64(1)
    out[np.arange(n) + k > ends] = _TOP
    return out


def winnow(grams: np.ndarray) -> np.ndarray:
    """Positions of the least hash of any GUARD consecutive k-grams of one text; all of equal least ones."""
    n = len(grams) - GUARD + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = grams[:n].copy()
    whole = grams[:n] != _TOP
    for j in range(1, GUARD):
        np.minimum(least, grams[j : n + j], out=least)
        whole &= grams[j : n + j] != _TOP
    least[~whole] = _TOP
    kept = np.zeros(len(grams), bool)
    for j in range(GUARD):
        kept[j : n + j] |= (grams[j : n + j] == least) & whole
    return np.flatnonzero(kept)


class Index:
    """Fingerprints of items: a bit table, then the sorted hashes with their places."""

    def __init__(self, items: list[tuple[str | None, str]]):
        column = pa.array([t or "" for _, t in items], pa.string())
        words, bounds = [np.zeros(0, np.uint64)], [0]
        for _, _, raw, offsets in text_blocks(column):
            h, first, _, _ = hash_words(raw, offsets)
            words.append(h)
            bounds += [bounds[-1] + int(n) for n in np.cumsum(np.diff(first))]
        self.words = np.concatenate(words)
        bounds = np.array(bounds, np.int64)
        sizes = np.diff(bounds)
        # Items of the same words are one entry with all their ids.
        self.ids: list[list[str]] = []
        seen: dict[bytes, int] = {}
        starts, ends, entry = [], [], np.full(len(self.words), -1, np.int64)
        for (item, _), a, b in zip(items, bounds[:-1], bounds[1:], strict=True):
            if a == b:
                continue
            e = seen.setdefault(self.words[a:b].tobytes(), len(self.ids))
            if e == len(self.ids):
                self.ids.append([])
                starts.append(a)
                ends.append(b)
                entry[a:b] = e
            if item is not None and item not in self.ids[e]:
                self.ids[e].append(item)
        self.entry, self.starts, self.ends = entry, np.array(starts, np.int64), np.array(ends, np.int64)
        kept = np.flatnonzero(entry >= 0)
        grams = gram_hashes(self.words, self.ends[entry] if len(kept) else np.zeros(len(entry), np.int64), K)
        grams[entry < 0] = _TOP
        at = winnow(grams)
        if len(at):
            at = at[(self.ends - self.starts)[entry[at]] >= WINDOW]
        order = np.argsort(grams[at], kind="stable")
        self.places, self.hashes = at[order], grams[at][order]
        self.bits = self._bits(self.hashes)
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({int(s) for s in (self.ends - self.starts) if s < WINDOW}) if self.ids else []:
            e = np.flatnonzero(self.ends - self.starts == size)
            h = gram_hashes(self.words, self.ends[np.maximum(entry, 0)], size)[self.starts[e]]
            order = np.argsort(h, kind="stable")
            self.short[size] = h[order], self.starts[e][order]
        del sizes

    @staticmethod
    def _bits(hashes: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << max(16, (16 * len(hashes)).bit_length()), bool)
        bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        return bits

    def _pairs(self, at: np.ndarray, h: np.ndarray, hashes: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(document word, item word) for every equal hash, about PAIRS at a time."""
        lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        ends = np.cumsum(n)
        i = 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + PAIRS, "right")))
            m = n[i:j]
            skip = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            yield np.repeat(at[i:j], m), places[np.repeat(lo[i:j], m) + skip]
            i = j

    def spans(self, words: np.ndarray, first: np.ndarray):
        """(start, end, entry) of runs of words in occurring windows, in a block of texts."""
        ends = np.repeat(first[1:], np.diff(first))
        begins = np.repeat(first[:-1], np.diff(first))
        out = []
        if len(self.hashes):
            grams = gram_hashes(words, ends, K)
            at = winnow(grams)
            at = at[self.bits[(grams[at] & np.uint64(len(self.bits) - 1)).astype(np.int64)]]
            for p, q in self._pairs(at, grams[at], self.hashes, self.places):
                e = self.entry[q]
                left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
                same = np.ones(len(p), bool)
                for j in range(K):
                    same &= words[p + j] == self.words[q + j]
                go = same.copy()
                for j in range(1, GUARD):
                    go &= (p - j >= begins[p]) & (q - j >= self.starts[e])
                    go[go] = words[p[go] - j] == self.words[q[go] - j]
                    left += go
                go = same.copy()
                for j in range(GUARD - 1):
                    go &= (p + K + j < ends[p]) & (q + K + j < self.ends[e])
                    go[go] = words[p[go] + K + j] == self.words[q[go] + K + j]
                    right += go
                hit = same & (left + K + right >= WINDOW)
                out.append(((p - left)[hit], (p + K + right)[hit], e[hit]))
        for size, (hashes, places) in self.short.items():
            grams = gram_hashes(words, ends, size)
            at = np.flatnonzero(grams != _TOP)
            if len(hashes) < 1024:
                at = at[np.isin(grams[at], hashes)]
            for p, q in self._pairs(at, grams[at], hashes, places):
                same = np.ones(len(p), bool)
                for j in range(size):
                    same &= words[p + j] == self.words[q + j]
                out.append((p[same], p[same] + size, self.entry[q[same]]))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


SCAN = "row_id long, text_key long, n_words long, spans array<long>, items array<string>"
_SPAN = np.int64(1) << 32


def _scan(docs: DataFrame, index: Index, hits_only: bool) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = held.value
        for batch in batches:
            for i, j, raw, offsets in text_blocks(batch.column(2)):
                words, first, _, _ = hash_words(raw, offsets)
                start, end, entry = index.spans(words, first)
                doc = np.searchsorted(first, start, "right") - 1
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, start, 1)
                np.add.at(depth, end, -1)
                # spans that touch in one document are joined, those of neighbours aren't
                inside = np.concatenate(([False], np.cumsum(depth[:-1]) > 0, [False]))
                edge = np.zeros(len(words) + 1, bool)
                edge[first] = True
                a = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
                b = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
                of = np.searchsorted(first, a, "right") - 1
                spans = ((a - first[of]) * _SPAN + (b - first[of])).astype(np.int64)
                items: list[list[str]] = [[] for _ in range(j - i)]
                for d, e in np.unique(np.stack([doc, entry]), axis=1).T if len(doc) else ():
                    items[d] += index.ids[e]
                n_spans = np.bincount(of, minlength=j - i)
                out = pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i:j], batch.column(1)[i:j], pa.array(np.diff(first), pa.int64()),
                        as_list(spans, n_spans, pa.int64()), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
                    ],
                    names=["row_id", "text_key", "n_words", "spans", "items"],
                )
                if hits_only:
                    out = out.filter(pa.array(n_spans > 0))
                yield out
            give_back()

    return docs.mapInArrow(scan, SCAN)


def _merge(spans):
    """Words covered by spans that may overlap."""
    start, end = lambda x: F.shiftrightunsigned(x, 32), lambda x: x.bitwiseAND(F.lit((1 << 32) - 1))
    zero = F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(
        F.greatest(s["to"], end(x)).alias("to"),
        (s["n"] + F.greatest(F.lit(0).cast("long"), end(x) - F.greatest(s["to"], start(x)))).alias("n"),
    )
    return F.aggregate(F.array_sort(spans), zero, step, lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, keyed: bool = False, join_bytes: int = JOIN_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans and items, a row for each row.

    spans are first and last-but-one word, items the ids. A null or wordless text
    has no words and no hits; items without words occur nowhere. Items that repeat
    count once for each id; one without id marks words but isn't counted. spans may overlap where
    there are several blocks or windows are joined. A text of any
    length is taken whole; an empty table of documents gives no rows, one of items no hits;
    other columns are ignored. keyed adds text_key, the xxhash64 of the text.
    """
    spark = docs.sparkSession
    items = renamed(benchmark, item_id="item_id", text="text").selectExpr("cast(item_id as string) item_id", "text").where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    rows = renamed(docs, row_id="doc_id", text="text").selectExpr("cast(row_id as long) row_id", "xxhash64(text) text_key", "text")

    def index(block: int) -> Index:
        return Index(sorted(((r[0], r[1]) for r in items.where(key == block).collect()), key=lambda r: (r[0] or "", r[1])))

    if size > join_bytes:
        from evidentia.llm.window_join import joined

        found, blocks = joined(rows, items), 0
    else:
        found = _scan(rows, index(0), hits_only=False)
    if blocks > 1:
        more = None
        for b in range(1, blocks):
            part = _scan(rows, index(b), hits_only=True)
            more = part if more is None else more.unionByName(part)
        more = more.distinct().groupBy(F.col("row_id").alias("r"), F.col("text_key").alias("t")).agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))
        found = found.join(more, F.col("row_id").eqNullSafe(F.col("r")) & F.col("text_key").eqNullSafe(F.col("t")), "left").select(
            "row_id", "text_key", "n_words",
            F.concat("spans", F.coalesce("s", F.array().cast("array<long>"))).alias("spans"),
            F.array_distinct(F.concat("items", F.coalesce("i", F.array().cast("array<string>")))).alias("items"),
        )
    return found.select(
        F.col("row_id").alias("doc_id"), *["text_key"] * keyed, "n_words", _merge(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        "spans", "items",
    ).withColumn("contaminated", F.col("n_hit") > 0)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
