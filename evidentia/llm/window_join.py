"""Windows of large benchmarks joined with those of documents.

Where a benchmark is too large to go to every task, its windows are a table: each distinct
window of WINDOW words (or whole shorter item) by two hashes, with the set of items that
have it. Documents are winnowed as usual; a fingerprint that may be an item's is extended
to the windows around it, and those that may be an item's are joined with the table. As the
table's windows differ from each other, a window that many documents and many items
share meets one row, never all pairs.

What may be an item's is told by a bit table of FILTER_BITS bits, whatever the size of
the benchmark; it lets too much through where it fills up, and never leaves anything out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import as_list, hash_words, mix64, text_blocks, written
from evidentia.llm.decontaminate import _SPAN, _TOP, GUARD, WINDOW, K, gram_hashes, winnow

#: Bits of the filter, which goes to every task: 16 MB.
FILTER_BITS = 1 << 27
#: In the table of windows, rows of this size are fingerprints.
FINGERPRINT = 0
WINDOWS = "item_id string, size int, h1 long, h2 long, bit long"
CANDIDATES = "row_id long, text_key long, n_words long, sizes array<int>, h1 array<long>, h2 array<long>, places array<long>"


def two_hashes(words: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the k words from each word on; all ones in the first where its text has fewer left."""
    return gram_hashes(words, ends, k), gram_hashes(mix64(words ^ np.uint64(0x5851F42D4C957F2D)), ends, k)


def bit_of(h: np.ndarray, size: int) -> np.ndarray:
    """The filter's bit for a hash of so many words."""
    return (mix64(h + np.uint64(size)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, _, raw, offsets in text_blocks(batch.column(1)):
            words, first, _, _ = hash_words(raw, offsets)
            n = np.diff(first)
            ends = np.repeat(first[1:], n)
            grams = gram_hashes(words, ends, K)
            p = winnow(grams)
            found = [(FINGERPRINT, p, grams, np.zeros_like(grams))]
            h1, h2 = two_hashes(words, ends, WINDOW)
            found.append((WINDOW, np.flatnonzero(h1 != _TOP), h1, h2))
            for size in sorted({int(x) for x in n if 0 < x < WINDOW}):
                found.append((size, first[:-1][n == size], *two_hashes(words, ends, size)))
            for size, at, a, b in found:
                of = np.searchsorted(first, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(of + i, pa.int64())), pa.array(np.full(len(at), size, np.int32)), pa.array(a[at].astype(np.int64)), pa.array(b[at].astype(np.int64)),
                        pa.array(bit_of(a[at], size)),
                    ],
                    names=["item_id", "size", "h1", "h2", "bit"],
                )


def filter_words(windows: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The filter as 64-bit words: bits / 64 rows at most come to the driver. bits is a power of two, FILTER_BITS at most."""
    rows = windows.withColumn("bit", F.col("bit").bitwiseAND(F.lit(bits - 1))).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("x")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().astype(np.uint64)
    return out


def _candidates(rows: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """Each row of rows with its windows that may be an item's."""
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: np.ndarray = held.value

        def may(h: np.ndarray, size: int) -> np.ndarray:
            bit = bit_of(h, size) & (64 * len(table) - 1)
            return (table[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1

        for batch in batches:
            for i, j, raw, offsets in text_blocks(batch.column(2)):
                words, first, _, _ = hash_words(raw, offsets)
                n = np.diff(first)
                ends = np.repeat(first[1:], n)
                found = []
                if WINDOW in sizes:
                    grams = gram_hashes(words, ends, K)
                    p = winnow(grams)
                    p = p[may(grams[p], FINGERPRINT)]
                    begins = np.repeat(first[:-1], n)
                    around = np.unique(np.concatenate([(p - s)[p - s >= begins[p]] for s in range(GUARD)]))
                    h1, h2 = two_hashes(words, ends, WINDOW)
                    found.append((WINDOW, around[h1[around] != _TOP], h1, h2))
                for size in sizes:
                    if size < WINDOW:
                        h1, h2 = two_hashes(words, ends, size)
                        found.append((size, np.flatnonzero(h1 != _TOP), h1, h2))
                kept = [(size, at[may(a[at], size)], a, b) for size, at, a, b in found]
                at = np.concatenate([np.zeros(0, np.int64), *[x[1] for x in kept]])
                order = np.argsort(at, kind="stable")
                col = lambda xs, kind: np.concatenate([np.zeros(0, kind), *xs])[order]
                at = at[order]
                of = np.searchsorted(first, at, "right") - 1
                lengths = np.bincount(of, minlength=j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i:j], batch.column(1)[i:j], pa.array(n, pa.int64()),
                        as_list(col([np.full(len(x[1]), x[0], np.int32) for x in kept], np.int32), lengths, pa.int32()),
                        as_list(col([x[2][x[1]].astype(np.int64) for x in kept], np.int64), lengths, pa.int64()),
                        as_list(col([x[3][x[1]].astype(np.int64) for x in kept], np.int64), lengths, pa.int64()),
                        as_list(at - first[of], lengths, pa.int64()),
                    ],
                    names=["row_id", "text_key", "n_words", "sizes", "h1", "h2", "places"],
                )

    return rows.mapInArrow(scan, CANDIDATES)


def joined(rows: DataFrame, items: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """row_id, text_key, n_words, spans, items of each row of rows (row_id, text_key, text) against items (item_id, text)."""
    windows = written(items.select("item_id", "text").repartition(F.col("text")).mapInArrow(_item_rows, WINDOWS), "item-windows")
    sizes = sorted(r[0] for r in windows.where(F.col("size") != FINGERPRINT).select("size").distinct().collect())
    found = written(_candidates(rows, filter_words(windows, filter_bits), sizes), "candidate-windows")
    # each different window with the set of items that have it; a set is told by its items
    own = F.array_sort(F.collect_set("item_id"))
    sets = windows.where(F.col("size") != FINGERPRINT).groupBy("size", "h1", "h2").agg(own.alias("items"))
    sets = written(sets.withColumn("set", F.sha2(F.to_json("items").cast("binary"), 256)), "window-items")
    each = found.where(F.size("places") > 0).select("row_id", "text_key", F.explode(F.arrays_zip("sizes", "h1", "h2", "places")).alias("x"))
    each = each.select("row_id", "text_key", F.col("x.sizes").alias("size"), F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2"), F.col("x.places").alias("place"))
    span = F.col("place") * F.lit(int(_SPAN)) + F.col("place") + F.col("size")
    hit = written(
        each.join(sets.select("size", "h1", "h2", "set"), ["size", "h1", "h2"])
        .groupBy("row_id", "text_key").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.collect_set("set").alias("sets")),
        "window-hits",
    )
    named = hit.select("row_id", "text_key", F.explode("sets").alias("set")).join(sets.select("set", "items").dropDuplicates(["set"]), "set")
    named = named.groupBy(F.col("row_id").alias("r"), F.col("text_key").alias("t")).agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    same = F.col("row_id").eqNullSafe(F.col("r")) & F.col("text_key").eqNullSafe(F.col("t"))
    hit = hit.drop("sets").join(named, same).select(F.col("r").alias("r1"), F.col("t").alias("t1"), "spans", "items")
    out = found.select("row_id", "text_key", "n_words").join(hit, F.col("row_id").eqNullSafe(F.col("r1")) & F.col("text_key").eqNullSafe(F.col("t1")), "left")
    return out.select("row_id", "text_key", "n_words", F.coalesce("spans", F.array().cast("array<long>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
