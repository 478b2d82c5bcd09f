"""Packing of documents into training sequences.

First-fit decreasing over a tournament tree of bin capacities, run independently
in random groups of documents: each group is one small task, so groups are packed
side by side whatever the size of the corpus, and random groups all hold the same
mix of lengths. Text never moves: a document is cut where it is tokenized, and
only the lengths of its pieces are shuffled.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import give_back, renamed, table
from evidentia.llm.tokenizer import encoder, small_batches, vocabulary

SEQUENCE = 4096
END_ID = 2
#: Documents in a group, on average.
GROUP_DOCS = 1024

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, copy int"


def cut_documents(
    docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Pieces of at most `sequence` token ids of each document with its end id.

    A document of more ids is cut at the multiples of `sequence`. A null or empty
    text is the end id alone; a text of any length is cut whole. copy numbers repeated
    rows within a task, so that they can be dealt apart. with_ids adds the ids themselves.
    """
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(path), Counter()
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for i, j in small_batches(texts):
                for doc, ids in zip(doc_ids[i:j], enc.batch(texts[i:j]), strict=True):
                    ids += end
                    whole = hash((doc, zlib.crc32(ids), len(ids)))
                    copy = seen[whole]
                    seen[whole] += 1
                    for at in range(0, len(ids), 4 * sequence):
                        part = ids[at : at + 4 * sequence]
                        row = (doc, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, copy)
                        rows.append((*row, np.frombuffer(part, "<i4")) if with_ids else row)
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            del texts, rows
            give_back()
            kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return (
        renamed(docs, doc_id="doc_id", text="text")
        .selectExpr("cast(doc_id as long) doc_id", "text")
        .mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)
    )


class BinTree:
    """Tournament tree over the room left in bins: finds the first bin with enough."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """(bin, room it had)."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < length:
                i += 1
        had = room[i]
        room[i] -= length
        found = i - self.leaves
        i //= 2
        while i:
            most = max(room[2 * i], room[2 * i + 1])
            if room[i] == most:
                break
            room[i] = most
            i //= 2
        return found, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each length."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = BinTree(len(lengths), capacity)
    for i in np.argsort(-lengths, kind="stable"):
        found, had = tree.place(int(lengths[i]))
        bins[i], offsets[i] = found, capacity - had
    return bins, offsets


def pack(pieces: DataFrame, n_docs: int, sequence: int = SEQUENCE, group_docs: int = GROUP_DOCS, seed: int = 17) -> DataFrame:
    """sequence_id and offset for each piece; offsets in a sequence have no gaps.

    Documents are dealt to groups by a hash, so a retry deals them alike; pieces that
    fill a sequence by themselves are dealt one by one, so that no document, however
    long, makes a group large. Ties of length go by doc_id, start, checksum and copy.
    """
    groups = max(1, -(-n_docs // group_docs))
    full = F.when(F.col("length") == sequence, F.col("start")).otherwise(-1)
    key = F.pmod(F.xxhash64("doc_id", "copy", full, F.lit(seed)), F.lit(groups))
    out = f"{PIECES}, sequence_id long, offset long"

    def one(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32", "copy"], kind="stable")
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), sequence)
        return rows.drop(columns="bin_group").assign(sequence_id=(int(group[0]) << 32) + bins, offset=offsets)

    return pieces.withColumn("bin_group", key).groupBy("bin_group").applyInPandas(one, out)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, group_docs: int = GROUP_DOCS) -> DataFrame:
    """The pieces of all documents with their place in sequences of `sequence` ids.

    Null texts are empty; an empty table gives no rows; repeated rows are packed
    each; columns other than doc_id and text are ignored.
    """
    return pack(cut_documents(docs, tokenizer or vocabulary(), sequence), docs.count(), sequence, group_docs)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """The packed sequences with their ids: sequence_id, ids, doc_ids, offsets."""
    pieces = cut_documents(docs, tokenizer or vocabulary(), sequence, with_ids=True)
    held = placed.select("doc_id", "start", "ids_crc32", "sequence_id", "offset")
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "ids")))
    return (
        held.join(pieces, ["doc_id", "start", "ids_crc32"])
        .groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
