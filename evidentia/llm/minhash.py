"""Near-duplicates by DartMinHash.

A document is a weighted set of word shingles. Over every element lies a plane of
weight and time in unit squares, and a hash of element and square throws one dart
into each. A dart counts if it lies below the element's weight; each of the
signature's k coordinates keeps the earliest dart that falls to it. Two documents
agree in a coordinate with the probability of their (weighted) Jaccard similarity.
Time goes on until every coordinate has a dart, after about k ln k / W units for a
document of total weight W, so a long document throws one or two darts per element.

Signatures are joined in bands. Copies share one entry. In a band's bucket no pairs
of all members are made: members are compared with a hub, the one with most
neighbours. Buckets still apart after that are split by prefixes: of shingles in one
order, rare ones first, two texts that are similar enough share one of the first few.
In these finer buckets members are again compared with a hub, those
still apart with 2 more, then 4, until every member that isn't in one class with the
rest has been a hub itself. Pairs whose signatures are too far apart are left out
first; each comparison is exact, on the shingles of both texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import _U, as_list, give_back, hash_words, mix64, renamed, shingle_hashes, table, text_blocks, written
from evidentia.llm.components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 26, 5
#: A bucket of at most so many members is compared at once.
SMALL_BUCKET = 8
#: What a worker is sent at a time of texts and of pairs of shingle sets.
BATCH = "8m"
#: Places of the sketch that orders shingles by how common they are: 8 MB, of any corpus.
SLOTS = 1 << 20


def weighted_sets(words: np.ndarray, first: np.ndarray, k: int = WORDS, weights: str = "set") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles, weights, first shingle of each text and the end) of a block of texts.

    Weights are 1 each ("set") or how often the shingle occurs ("count"). A text of
    fewer than k words is one shingle of all of them.
    """
    n, texts = len(words), len(first) - 1
    doc = np.repeat(np.arange(texts), np.diff(first))
    if n >= k:
        h = np.zeros(n - k + 1, _U)
        for j in range(k):
            h = h * _U(0xBF58476D1CE4E5B9) + words[j : n - k + 1 + j]
        whole = np.arange(n - k + 1) + k <= first[1:][doc[: n - k + 1]]
        h, of = mix64(h[whole] + _U(k)), doc[: n - k + 1][whole]
    else:
        h, of = np.zeros(0, _U), np.zeros(0, np.int64)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < k))
    if len(short):
        h = np.concatenate([h, *[shingle_hashes(words[first[d] : first[d + 1]], k) for d in short]])
        of = np.concatenate([of, short])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(h))).astype(np.float64)
    return h[at], n if weights == "count" else np.ones(len(at)), np.searchsorted(of[at], np.arange(texts + 1))


def weighted_set(words: np.ndarray, k: int = WORDS, weights: str = "set") -> tuple[np.ndarray, np.ndarray]:
    return weighted_sets(words, np.array([0, len(words)]), k, weights)[:2]


def dart_signatures(elements: np.ndarray, weights: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """`size` hashes for each weighted set of a block, none of them empty; those of two
    sets are equal with the chance of their weighted Jaccard similarity."""
    sets = len(first) - 1
    out = np.zeros(sets * size, _U)
    high = np.ceil(weights).astype(np.int64)
    e = np.repeat(np.arange(len(elements)), high)
    level = np.arange(len(e)) - np.repeat(np.cumsum(high) - high, high)
    room = None if (high == weights).all() else weights[e] - level  # of a square, that lies below the weight
    seed = mix64(elements[e] + level.astype(_U) * _U(0x9E3779B97F4A7C15))
    doc = np.repeat(np.arange(sets), np.diff(first))[e]
    squares = np.bincount(doc, minlength=sets)
    step, begin, todo = np.clip(300 // np.maximum(squares, 1), 1, 256), np.zeros(sets, np.int64), np.ones(sets, bool)
    while todo.any():
        row = np.flatnonzero(todo[doc])
        n = step[doc[row]]
        if (n > 1).any():
            later = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row = np.repeat(row, n)
        else:
            later = np.zeros(len(row), np.int64)
        of = doc[row]
        dart = mix64(seed[row] + (begin[of] + later + 1).astype(_U) * _U(0xD1342543DE82EF95))
        place = of * size + ((dart & _U(0xFFFFFFFF)) * _U(size) >> _U(32)).astype(np.int64)
        key = (place.astype(_U) << _U(38)) | (later.astype(_U) << _U(29)) | (dart >> _U(35))
        if room is not None:
            key = key[(mix64(dart) >> _U(11)) * 2.0**-53 < room[row]]
        key.sort()
        place = (key >> _U(38)).astype(np.int64)
        new = np.ones(len(key), bool)
        new[1:] = place[1:] != place[:-1]
        new &= out[place] == 0
        key, place = key[new], place[new]
        out[place] = (key & _U((1 << 38) - 1)) + (begin[place // size].astype(_U) << _U(29)) + _U(1)
        begin += step
        todo &= ~(out.reshape(sets, size) != 0).all(axis=1)
    return mix64(out).reshape(sets, size)


def band_hashes(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A hash for each band of each signature."""
    rows = signatures.reshape(len(signatures), bands, -1)
    h = np.broadcast_to(np.arange(bands, dtype=_U) * _U(0x9E3779B97F4A7C15), rows.shape[:2])
    for j in range(rows.shape[2]):
        h = mix64(h * _U(0xBF58476D1CE4E5B9) + rows[:, :, j])
    return h


SIGNED = "doc_id long, text_key long, k1 long, k2 long, n_words long, bands array<long>, sketch binary"


def signatures(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, weights: str = "set") -> DataFrame:
    """A hash of the text, a key of its words (k1, k2) and its band hashes, of each document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in text_blocks(batch.column(2)):
                h, first, _, _ = hash_words(raw, offsets)
                n = np.diff(first)
                k1, k2 = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                some = np.flatnonzero(n)
                found, sketch = np.zeros(0, np.int64), [None] * (j - i)
                if len(some):
                    at = (np.arange(len(h)) - np.repeat(first[:-1], n) + 1).astype(_U)
                    for k, m in ((k1, 0xA0761D6478BD642F), (k2, 0xE7037ED1A0B428DB)):
                        k[some] = np.add.reduceat(mix64(h + at * _U(m)), first[some]).view(np.int64)
                    elements, each, begin = weighted_sets(h, first, words, weights)
                    begin = np.append(begin[some], len(elements))
                    signed = dart_signatures(elements, each, begin, bands * rows)
                    found = band_hashes(signed, bands).reshape(-1).view(np.int64)
                    for d, own in zip(some, signed.astype(np.uint8), strict=True):
                        sketch[d] = own.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(1)[i:j], pa.array(k1), pa.array(k2), pa.array(n, pa.int64()), as_list(found, bands * (n > 0), pa.int64()), pa.array(sketch, pa.binary())],
                    names=["doc_id", "text_key", "k1", "k2", "n_words", "bands", "sketch"],
                )
            give_back()

    return renamed(docs, doc_id="doc_id", text="text").selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) text_key", "text").mapInArrow(sign, SIGNED)


SETS = "node long, shingles array<long>, weights array<double>"


def shingle_sets(texts: DataFrame, words: int = WORDS, weights: str = "set") -> DataFrame:
    """The weighted set of each of (node, text), shingles in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in text_blocks(batch.column(1)):
                h, first, _, _ = hash_words(raw, offsets)
                e, w, begin = weighted_sets(h, first, words, weights)
                n = np.diff(begin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], as_list(e.view(np.int64), n, pa.int64()), as_list(w, n, pa.float64())], names=["node", "shingles", "weights"]
                )
            give_back()

    return texts.select("node", "text").mapInArrow(cut, SETS)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(column.values), np.asarray(column.offsets)


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, similarity) of pairs (u, v) of documents with shingle_sets()."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, ao), (wa, _), (b, bo), (wb, _) = (_lists(batch.column(k)) for k in (2, 3, 4, 5))
            found = np.zeros(len(batch))
            for k in range(len(batch)):
                x, y = slice(ao[k], ao[k + 1]), slice(bo[k], bo[k + 1])
                _, i, j = np.intersect1d(a[x], b[y], assume_unique=True, return_indices=True)
                low = np.minimum(wa[x][i], wb[y][j]).sum()
                found[k] = low / max(wa[x].sum() + wb[y].sum() - low, 1e-300)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["u", "v", "similarity"])

    asked = pairs.select(F.col("u").alias("node")).distinct()  # few sets are moved for few pairs
    a = sets.join(asked, "node", "left_semi").select(F.col("node").alias("u"), F.col("shingles").alias("x"), F.col("weights").alias("wx"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("y"), F.col("weights").alias("wy"))
    return pairs.join(b, "v").join(a, "u").select("u", "v", "x", "wx", "y", "wy").mapInArrow(compare, "u long, v long, similarity double")


#: Rests are sums of doubles: a rest smaller by this share still counts.
SLIGHT = 1e-9


def meet(rest: Column, other: Column, weights: Column, similarity: float) -> Column:
    """Whether the rests at a shingle are what sets with this sum of weights must share."""
    return F.least(rest, other) >= F.lit(similarity / (1 + similarity) * (1 - SLIGHT)) * weights


def frequencies(sets: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """How many shingles of all the sets fall to each of `slots` places: a sketch of fixed size,
    counted in each task first, that tells shingles of many sets from rare ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            values, offsets = _lists(batch.column(0))
            total += np.bincount(values[offsets[0] : offsets[-1]].view(_U) % _U(slots), minlength=slots)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    found = sets.select("shingles").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(slots, np.int64)
    out[found["slot"].to_numpy(np.int64)] = found["n"]
    return out


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(bucket, node, rest, weight) of each set: a row for each shingle of its prefix.

    Shingles have one order, rare ones first; how rare need not be exact. weight is the
    set's, rest what of it begins at the shingle. Sets x and y as similar have
    s / (1 + s) (weight x + weight y) in common, so also a shingle with a rest of that
    much in both: see `meet`. A prefix ends where no set could ask for less.
    """
    held = sets.sparkSession.sparkContext.broadcast(frequencies(sets))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = held.value
        for batch in batches:
            (a, ao), (w, _) = (_lists(batch.column(k)) for k in (1, 2))
            found, rests, whole = [np.zeros(0, np.int64)], [np.zeros(0)], np.zeros(len(batch))
            for k in range(len(batch)):
                own, each = a[ao[k] : ao[k + 1]], w[ao[k] : ao[k + 1]]
                order = np.lexsort((own, many[own.view(_U) % _U(len(many))]))
                each = each[order]
                rest = each.sum() - np.cumsum(each) + each
                whole[k] = each.sum()
                taken = rest >= similarity * whole[k] * (1 - SLIGHT)
                found.append(own[order[taken]])
                rests.append(rest[taken])
            n = [len(x) for x in found[1:]]
            node, weight = np.repeat(np.asarray(batch.column(0)), n), np.repeat(whole, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(node), pa.array(np.concatenate(rests)), pa.array(weight)], names=["bucket", "node", "rest", "weight"])

    return sets.select("node", "shingles", "weights").mapInArrow(cut, "bucket long, node long, rest double, weight double")


def likely(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) whose sketches (a byte of each coordinate) agree in no fewer places than
    the similarity implies, less six standard deviations: one in 10^9 is lost."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(len(batch), -1) for k in (2, 3))
            size = max(1, x.shape[1])
            least = similarity - 6 * np.sqrt(similarity * (1 - similarity) / size)
            yield batch.select([0, 1]).filter(pa.array((x == y).mean(axis=1) >= least)) if len(batch) else batch.select([0, 1])

    pairs = written(pairs, "candidates")
    asked = pairs.select(F.col("u").alias("node")).distinct()
    a, b = sketches.join(asked, "node", "left_semi").select(F.col("node").alias("u"), F.col("sketch").alias("x")), sketches.select(F.col("node").alias("v"), F.col("sketch").alias("y"))
    return pairs.join(b, "v").join(a, "u").select("u", "v", "x", "y").mapInArrow(keep, "u long, v long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, weights: str = "set", keyed: bool = False) -> DataFrame:
    """doc_id, class_id, n_words and kept of each row; class_id is the least doc_id of its class.

    Documents are linked when their shingles of `words` words have a Jaccard
    similarity of `similarity` or more, and classes are what links connect. Texts of
    the same words are one class. A text of fewer words is one shingle of all of them. A null or
    wordless text links with nothing and is a class of its own. kept marks the rows
    that hold the least doc_id of their class; rows with equal doc_id count as one
    document. A null doc_id links nothing and stays unless a copy has an id. A text of any
    length is taken whole, an empty table gives no rows, and other columns are ignored.
    keyed adds text_key, the xxhash64 of the text, by which rows are told apart.
    """
    signed = written(signatures(docs, words, bands, rows, weights), "signatures", BATCH)
    copies = signed.where("n_words > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = written(copies, "distinct-texts")
    members = nodes.where("node is not null").select("node", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    # written first: a join plans by the size of a table, and few texts share a bucket
    members = written(members.join(written(sizes, "bucket-sizes"), "bucket").distinct(), "buckets")
    degree = written(members.groupBy("node").agg(F.sum(F.col("n") - 1).alias("degree")), "degrees")
    ids = renamed(docs, node="doc_id", text="text").selectExpr("cast(node as long) node", "text")
    sets = written(shingle_sets(ids.join(degree.select("node"), "node"), words, weights), "shingle-sets", BATCH)
    sketches = written(nodes.join(degree.select("node"), "node").select("node", "sketch"), "sketches")
    members = written(members.join(degree, "node").select("bucket", "node", "degree", F.col("node").alias("class"), F.lit(float("inf")).alias("rest"), F.lit(0.0).alias("weight")), "members")

    # a row leads if it could meet one as heavy: of two that meet the lighter does
    leads = meet(F.col("rest"), F.col("rest"), 2 * F.col("weight"), similarity)
    links, classes, step, split = None, None, 0, False
    while True:
        # buckets whose members are still in more than one class, and that have one that leads
        apart = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi"), F.max(leads).alias("some")).where("lo <> hi and some").select("bucket", "n")
        members = written(members.join(apart, "bucket").select("bucket", "node", "degree", "class", "rest", "weight", "n"), "members")
        if members.isEmpty():
            break
        small = F.col("n") <= SMALL_BUCKET
        part = F.pmod(F.xxhash64("node", F.lit(step)), F.lit(2**step))
        best = F.max(F.struct("degree", (-F.col("node")).alias("minus"), "class", "rest", "weight"))
        hubs = members.where(~small & leads).groupBy("bucket", part.alias("part")).agg(best.alias("hub")).select("bucket", (-F.col("hub.minus")).alias("h"), F.col("hub.class").alias("hc"), F.col("hub.rest").alias("hr"), F.col("hub.weight").alias("hw"))
        few = members.where(small & leads).select("bucket", F.col("node").alias("h"), F.col("class").alias("hc"), F.col("rest").alias("hr"), F.col("weight").alias("hw"))
        centres = written(hubs.unionByName(few), "hubs")
        pairs = (
            members.join(centres, "bucket").where("class <> hc").where(meet(F.col("rest"), F.col("hr"), F.col("weight") + F.col("hw"), similarity))
            .select(F.least("h", "node").alias("u"), F.greatest("h", "node").alias("v")).distinct()
        )
        pairs = written(likely(pairs, sketches, similarity), "pairs")
        found = written(similarities(pairs, sets).where(F.col("similarity") >= similarity).select("u", "v"), "near", BATCH)
        done = centres.select("bucket", F.col("h").alias("node"))
        members = members.join(done, ["bucket", "node"], "left_anti").select("bucket", "node", "degree", "class", "rest", "weight")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            classes = components(links)
            known = classes.select("node", F.col("component").alias("now"))
            members = members.join(known, "node", "left").select("bucket", "node", "degree", F.coalesce("now", "class").alias("class"), "rest", "weight")
        if split:
            step += 1
            continue
        # only buckets of many members are left: those still apart are split, once
        members, split = written(members, "members"), True
        apart = members.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("bucket")
        known = written(members.join(apart, "bucket").select("node", "degree", "class").distinct(), "crowds")
        finer = prefixes(written(sets.join(known.select("node"), "node", "left_semi"), "crowd-sets", BATCH), similarity)
        members = finer.join(known, "node").select("bucket", "node", "degree", "class", "rest", "weight")

    keys = nodes.where("node is not null").select("k1", "k2", "node")
    if classes is not None:
        keys = keys.join(classes, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("class"))
    else:
        keys = keys.withColumnRenamed("node", "class")
    return (
        signed.join(keys, (signed.k1 == keys.k1) & (signed.k2 == keys.k2) & (signed.n_words > 0), "left")
        .select("doc_id", *["text_key"] * keyed, F.coalesce("class", "doc_id").alias("class_id"), "n_words")
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
    )


def audit_recall(docs: DataFrame, classes: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, every: int = 100) -> tuple[int, int]:
    """(links, links within one class) of documents whose id is divisible by `every` to all others.

    Exact: two documents with a link share a shingle, so the shingles of the asked ones are joined with
    all shingles and each pair's are counted; no signatures are used. classes is near_duplicates()'s
    result. Rows that share an id count as one document, with the text that comes first.
    """
    rows = renamed(docs, node="doc_id", text="text").selectExpr("cast(node as long) node", "text").where("node is not null")
    rows = rows.groupBy("node").agg(F.min("text").alias("text"))
    sets = written(shingle_sets(rows, words).select("node", "shingles", F.size("shingles").alias("n")), "audit-sets", BATCH)
    asked = sets.where(F.col("node") % every == 0)
    ours = asked.select(F.col("node").alias("q"), F.explode("shingles").alias("s"))
    theirs = sets.select("node", F.explode("shingles").alias("s")).join(ours.select("s").distinct(), "s", "left_semi")
    common = ours.join(theirs, "s").where("q <> node").groupBy("q", "node").agg(F.count("*").alias("both"))
    size = sets.select("node", "n")
    pairs = common.join(size, "node").join(size.select(F.col("node").alias("q"), F.col("n").alias("m")), "q")
    links = pairs.where(F.col("both") >= similarity * (F.col("n") + F.col("m") - F.col("both")))
    of = classes.groupBy("doc_id").agg(F.min("class_id").alias("class"))
    own = links.join(of.select(F.col("doc_id").alias("node"), F.col("class").alias("a")), "node").join(of.select(F.col("doc_id").alias("q"), F.col("class").alias("b")), "q")
    n, found = own.agg(F.count("*"), F.count_if(F.col("a") == F.col("b"))).first()
    return n, found


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
