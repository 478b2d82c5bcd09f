"""Ranked lexical search by windowed bucket scoring.

Documents become rows of postings (term, occurrences) of the terms that any item asks for.
A task deals its rows, by doc_id, to windows of a fixed size and turns each to lists by term.
For each item it goes through the lists of its terms, adds what each is worth to an array
with a slot for each document of the window, small enough for a cache, and marks the slot
in a bitset of occupied ones; these alone are harvested into the item's heap. A document's
postings are one row, so windows need no shuffle; the heaps of all tasks are ranked in two
steps, by parts of an item and by item.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm.common import WORD_TABLE, as_list, drop_tables, hash_words, renamed, table, text_blocks, written

TOP = 50
#: Documents of a window, consecutive by doc_id among the rows a task has at hand.
WINDOW = 1 << 13
#: Bytes of items' text whose terms go to every task at a time.
BLOCK_BYTES = 4 << 20
#: Parts of an item's ranking.
PARTS = 64
#: Bytes of text sent to a Python worker at a time.
BATCH = "8m"
LONG_MAX = (1 << 63) - 1


def word_bytes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' lower-cased bytes one after the other, and where each begins, with the end."""
    lengths = ends - starts
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return WORD_TABLE[raw[at]], offsets


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, term as bytes) of items (item, text), each term once a row."""
    for batch in batches:
        for first, last, raw, offsets in text_blocks(batch.column(1)):
            _, words, starts, ends = hash_words(raw, offsets)
            data, at = word_bytes(raw, starts, ends)
            whole = data.tobytes()
            found = [sorted({whole[at[w] : at[w + 1]] for w in range(words[i], words[i + 1])}) for i in range(last - first)]
            ids = pa.array(np.repeat(np.arange(first, last), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(ids), pa.array([t for x in found for t in x], pa.binary())], names=["item", "term"])


@dataclass
class Terms:
    """Terms in order of their hash, with their bytes."""

    words: list[bytes]

    def __post_init__(self):
        joined = np.frombuffer(b" ".join(self.words), np.uint8)
        hashes, _, starts, ends = hash_words(joined, np.array([0, len(joined)]))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.words = hashes[order], [self.words[i] for i in order]
        self.data, self.offsets = word_bytes(joined, starts[order], ends[order])

    def find(self, raw: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words that are terms, their terms): equal in hash and in every byte."""
        if not len(self.hashes) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        term = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        at = np.flatnonzero(self.hashes[term] == hashes)
        term = term[at]
        while len(at):  # of terms with one hash the next is tried where the bytes differ
            same = self._same(raw, starts[at], ends[at], term)
            if same.all():
                break
            other = np.flatnonzero(~same)
            term[other] += 1
            keep = np.ones(len(at), bool)
            beyond = term[other] >= len(self.hashes)
            keep[other[beyond]] = False
            inside = other[~beyond]
            keep[inside[self.hashes[term[inside]] != hashes[at[inside]]]] = False
            at, term = at[keep], term[keep]
        return at, term

    def _same(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, term: np.ndarray) -> np.ndarray:
        same = ends - starts == self.offsets[term + 1] - self.offsets[term]
        some = np.flatnonzero(same)
        got, offsets = word_bytes(raw, starts[some], ends[some])
        lengths = np.diff(offsets)
        own = self.data[np.arange(offsets[-1]) + np.repeat(self.offsets[term[some]] - offsets[:-1], lengths)]
        wrong = np.add.reduceat(got != own, offsets[:-1]) if len(some) else np.zeros(0)
        same[some[wrong > 0]] = False
        return same


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, occurrences) of docs (doc_id, text) with a term at all: n its words with repeats."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(held.value)
        for batch in batches:
            for first, last, raw, offsets in text_blocks(batch.column(1)):
                hashes, words, starts, ends = hash_words(raw, offsets)
                at, term = known.find(raw, hashes, starts, ends)
                doc = np.searchsorted(words, at, side="right") - 1
                keys, times = np.unique(doc * max(1, len(known.words)) + term, return_counts=True)
                doc, term = np.divmod(keys, max(1, len(known.words)))
                lengths = np.bincount(doc, minlength=last - first)
                n = np.diff(words)
                some = np.flatnonzero(n)
                lists = [as_list(x, lengths, kind).take(pa.array(some)) for x, kind in ((term, pa.int32()), (times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some + first)), pa.array(n[some], pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    return docs.mapInArrow(scan, "doc_id long, n long, terms array<int>, times array<long>")


class Searcher:
    """The items of a block over windows of documents: weights by term, terms by item, a heap for each item."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_words: int, top: int = TOP):
        self.items, self.weights, self.n_docs, self.n_words, self.top = items, weights, n_docs, n_words, top
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in items]
        self.scores = np.zeros(WINDOW, np.int64)
        self.occupied = np.zeros(WINDOW // 64, np.uint64)

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """m of documents with n words: whole numbers, by Python's where 64 bits would not hold a product."""
        if len(n) and 50 * int(n.max()) * self.n_docs > LONG_MAX:
            return np.array([50 + 50 * int(x) * self.n_docs // self.n_words for x in n], np.int64)
        return 50 + 50 * n * self.n_docs // self.n_words

    def window(self, docs: np.ndarray, n: np.ndarray, term: np.ndarray, slot: np.ndarray, times: np.ndarray) -> None:
        """One window: docs and n by slot, and its postings, term by term."""
        if not len(term):
            return
        m = self.lengths(n)
        order = np.argsort(term, kind="stable")
        term, slot, times = term[order], slot[order], times[order]
        worth = self.weights[term] * (1_000_000_000 * times // (1000 * times + 20 * m[slot]))
        places, bit = slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64)
        kinds, first = np.unique(term, return_index=True)
        lists = dict(zip(kinds.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(term)], strict=True), strict=True))
        scores, occupied = self.scores, self.occupied
        for heap, asked in zip(self.heaps, self.items, strict=True):
            for a, b in (lists[t] for t in asked if t in lists):
                scores[slot[a:b]] += worth[a:b]
                np.bitwise_or.at(occupied, places[a:b], bit[a:b])
            words = np.flatnonzero(occupied)
            if not len(words):
                continue
            bits = np.unpackbits(occupied[words].view(np.uint8), bitorder="little").reshape(len(words), 64)
            row, col = np.nonzero(bits)
            slots = words[row] * 64 + col
            self.harvest(heap, docs[slots], scores[slots])
            scores[slots] = 0
            occupied[words] = 0

    def harvest(self, heap: list[tuple[int, int]], docs: np.ndarray, scores: np.ndarray) -> None:
        """The best of a window into a heap whose root is the worst: the lowest score, of these the greatest id."""
        least = heap[0][0] if len(heap) == self.top else 1
        some = np.flatnonzero(scores >= max(1, least))
        if len(some) > self.top:
            least = np.partition(scores[some], -self.top)[-self.top]
            some = some[scores[some] >= least]
            some = some[np.lexsort((docs[some], -scores[some]))[: self.top]]
        for score, doc in zip(scores[some].tolist(), docs[some].tolist(), strict=True):
            if len(heap) < self.top:
                heapq.heappush(heap, (score, -doc))
            elif (score, -doc) > heap[0]:
                heapq.heapreplace(heap, (score, -doc))


#: Stands for a null doc_id, ranked last among equals.
NULL_ID = LONG_MAX


def scored(rows: DataFrame, items: list[list[int]], weights: list[int], n_docs: int, n_words: int, top: int = TOP) -> DataFrame:
    """(item, doc_id, score): the best of each task's rows of postings for each item (by its place)."""
    held = rows.sparkSession.sparkContext.broadcast((items, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, by_term = held.value
        s = Searcher(own, np.array(by_term, np.int64), n_docs, n_words, top)
        for batch in batches:
            docs = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            n = batch.column(1).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            lengths = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(docs)), lengths)
            term, times = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            order = np.argsort(docs, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            by_place = np.argsort(place[row], kind="stable")
            at = place[row][by_place]
            for c in range(0, len(order), WINDOW):
                d = min(len(order), c + WINDOW)
                own_rows = slice(*np.searchsorted(at, (c, d)))
                posted = by_place[own_rows]
                s.window(docs[order[c:d]], n[order[c:d]], term[posted], at[own_rows] - c, times[posted])
        rows = [(i, None if -d == NULL_ID else -d, score) for i, heap in enumerate(s.heaps) for score, d in heap]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["item", "doc_id", "score"])

    return rows.select("doc_id", "n", "terms", "times").mapInArrow(search, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the top documents (doc_id, text) of each item (item_id, text).

    Terms, weights and scores are the module's fixed integers: see weight and Searcher. An
    item is an item_id with the terms of all its rows, each once; a null id is an item too.
    A null or wordless text is no document and finds nothing. Rows of documents that repeat
    are ranked each by itself; a null doc_id comes last among equal scores. Empty tables give
    no rows. Texts of any length are taken whole, and only the columns named here are read.
    Items go to every task in blocks of block_bytes of text, whose size is read first; each
    block is one pass over the documents.
    """
    spark = docs.sparkSession
    items = renamed(items, item="item_id", text="text").where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    texts = renamed(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind, found = items.schema["item"].dataType, None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        asked: dict = {}
        for item, term in own.mapInArrow(item_terms, f"item {kind.simpleString()}, term binary").distinct().collect():
            asked.setdefault(item, []).append(bytes(term))
        names = list(asked)
        known = Terms(sorted({t for ts in asked.values() for t in ts})).words
        place = {t: i for i, t in enumerate(known)}
        rows = written(postings(texts, known), "search-postings", BATCH)
        n_docs, n_words = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = [0] * len(known)
        for t, w in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(weight(n_docs, F.count("*")).alias("w")).collect():
            weights[t] = w
        best = scored(rows, [sorted(place[t] for t in asked[i]) for i in names], weights, n_docs, n_words, top)
        parts = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        whole = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top).withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top)
        ids = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {kind.simpleString()}")
        part = written(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), "search-best")
        drop_tables(rows)
        found = part if found is None else found.unionByName(part)
    return found


def weight(n_docs: int, df):
    """What a term in df of n_docs documents weighs."""
    return F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * df + 1))).cast("long")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TERMS_SQL = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
OP12_SQL = f"""WITH q AS (SELECT DISTINCT item_id, unnest({TERMS_SQL.format('text')}) AS term FROM benchmark),
d AS (SELECT row_number() OVER () AS row, doc_id, {TERMS_SQL.format('text')} AS words FROM documents),
s AS (SELECT count(*)::BIGINT AS total, sum(len(words))::BIGINT AS length FROM d WHERE len(words) > 0),
m AS (SELECT row, doc_id, 50 + (50 * len(words)::BIGINT * total) // length AS m FROM d, s WHERE len(words) > 0),
o AS (SELECT row, term, count(*)::BIGINT AS times FROM (SELECT row, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM o GROUP BY 1), s),
p AS (SELECT row, term, weight * ((1000000000 * times) // (1000 * times + 20 * m)) AS worth FROM o JOIN w USING (term) JOIN m USING (row)),
r AS (SELECT item_id, row, sum(worth)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r JOIN m USING (row) WHERE score > 0) WHERE rank <= {TOP}"""
