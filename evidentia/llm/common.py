"""What the training-data operators share: tables, shared folders, word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Words are hashed so many bytes at a time; a longer word is a run of its own.
HASHED_BYTES = (1 << 18) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a temporary folder is made, in a local session (tests) alone:
    on a cluster no machine's own folder would do.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of rows that go to a Python worker at a time, and come back.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(df: DataFrame, name: str, batch: str | None = None) -> DataFrame:
    """df, written as a table in the shared folder and read back: cuts lineage
    and survives lost executors. The shuffle files behind it go once it's written. batch
    bounds what Python workers are sent at a time (such as "8m"): both sides hold a few of them.
    """
    spark = df.sparkSession
    path, wanted = scratch(spark, name), {CLEANUP: "true", **({BATCH: batch} if batch else {})}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Removes the files behind tables that written() made and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def own_name(*names: str) -> list[str]:
    """Column names that no caller's table has."""
    end = uuid.uuid4().hex[:12]
    return [f"{n}_{end}" for n in names]


def bucket_of(value: Column, n: int | Column) -> Column:
    return F.pmod(F.xxhash64(value), n if isinstance(n, Column) else F.lit(n))


def give_back() -> None:
    """Returns what Arrow and the C library hold freed to the system, as a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# --- blocks of text as bytes -------------------------------------------------


def text_blocks(
    column: pa.Array, limit: int = BLOCK_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for blocks of whole texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_MULT, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, m in enumerate((_MULT, _INVERSE)):
            p = np.full(size, m, _U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=_U)
    return _powers[0], _powers[1]


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))


def _lower_table(separators: set[int]) -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    for b in separators:
        lut[b] = 0
    return lut


#: Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased.
WORD_TABLE = _lower_table({*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})
#: Words are runs of all but space and the controls 9 to 13, A-Z lower-cased. NUL is a
#: character of a word here, so it takes a byte that UTF-8 never has.
SPACED_TABLE = _lower_table({0x20, *range(0x09, 0x0E)})
SPACED_TABLE[0] = 0xFF


def hash_words(
    raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_TABLE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each word, first word of each text and the end, byte starts, byte ends).

    Words are hashed in runs of HASHED_BYTES, so that a long text needs no table of powers of its length.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = table[raw]
    inside = low != 0
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = offsets[1:-1]
    before[cuts[cuts < n]] = False
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    h, i = np.empty(len(starts), _U), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASHED_BYTES, "right")))
        at, size = starts[i], int(ends[j - 1] - starts[i])
        up, down = powers(size + 1)
        sums = np.zeros(size + 1, _U)
        np.cumsum(_BYTE_VALUES[low[at : at + size]] * up[:size], out=sums[1:])
        a, b = starts[i:j] - at, ends[i:j] - at
        h[i:j] = mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(_U))
        i = j
    return h, np.searchsorted(starts, offsets), starts, ends


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; of all of them where there are fewer."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, _U)
    for j in range(k):
        out = out * _U(0xBF58476D1CE4E5B9) + words[j : n - k + 1 + j]
    return mix64(out + _U(k))


def as_list(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the given columns, under names of our own, so that others can't clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])
