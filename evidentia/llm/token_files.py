"""Token ids in Parquet files that can be read in part.

Documents are dealt by ranges of doc_id and sorted, encoded, and written as list
columns: ids by a dictionary, doc_id and positions by deltas, in row groups and
pages of a set size with page indexes. A reader of a range of doc_id, or of
the counts alone, touches only the pages and columns that hold them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm.common import as_list, renamed, scratch, table, text_blocks
from evidentia.llm.tokenizer import encoder, vocabulary

END_ID = 1
#: Texts are encoded in blocks of about so many bytes.
AT_ONCE = 4 << 20
FILES = "doc_id long, part int, part_start long, n_tokens int, ids array<int>"


def write_options(ids: str = "dictionary", row_group: int = 32 << 20, page: int = 256 << 10, page_rows: int = 512) -> dict[str, str]:
    """Parquet settings. ids: "dictionary" or "delta"."""
    if ids not in ("dictionary", "delta"):
        raise ValueError(f"no such encoding: {ids}")
    return {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.block.size": str(row_group),
        "parquet.page.size": str(page),
        "parquet.page.row.count.limit": str(page_rows),
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#ids.list.element": str(ids == "dictionary").lower(),
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part_start", "n_tokens")},
    }


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, options: dict[str, str] | None = None) -> None:
    """Writes the ids of every document, with the end id, in ascending doc_id order.

    part is the number of a file in that order, part_start the ids in it before the
    document. A null text is empty, so it has the end id alone; a null doc_id comes
    first; rows with one doc_id are ordered by a hash of their text. A text of any
    length is encoded whole and is one row; an empty table writes files without rows;
    columns other than doc_id and text are ignored, whatever their names.
    """
    tokens = tokenizer or vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, enc = TaskContext.get().partitionId(), 0, encoder(tokens)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for i, j, *_ in text_blocks(texts, AT_ONCE):
                ids, bounds = enc.encode(texts[i:j])
                n = np.diff(bounds) + 1
                before = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i:j],
                        pa.array(np.full(j - i, part, np.int32)),
                        pa.array(before),
                        pa.array(n.astype(np.int32)),
                        as_list(np.insert(ids, bounds[1:], end_id).view("<i4"), n, pa.int32()),
                    ],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"],
                )

    (
        renamed(docs, doc_id="doc_id", text="text")
        .selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(text) tie")
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
        .mapInArrow(encode, FILES)
        .write.options(**(options or write_options()))
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The files' rows, or those of doc_id first to last, by the page indexes."""
    df = spark.read.schema(FILES).parquet(path)
    if first is not None:
        df = df.where(F.col("doc_id") >= first)
    return df if last is None else df.where(F.col("doc_id") <= last)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            values, offsets = np.asarray(ids.values).astype("<u4"), np.asarray(ids.offsets)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
            )

    rows = read_token_files(spark, path).mapInArrow(digest, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    sums = read_token_files(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("ids_in"))
    # a row for each file: the one task that adds them up reads no more
    before = sums.select("part", (F.sum("ids_in").over(Window.orderBy("part")) - F.col("ids_in")).alias("ids_before"))
    return rows.join(before, "part").select("doc_id", (F.col("ids_before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return token_digests(spark, path)
