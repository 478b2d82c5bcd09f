"""What runs leave behind: snapshots, summaries by key, splits, records, logs, reports.

Tables are written by Spark's commit protocol, so readers see a whole write or none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.text import two_decimals
from evidentia.sources.readers import upsert


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, *keys: str, tries: int = 20, before_commit=None) -> str:
    """Rows of new by key over those of the newest version under path, as a next version
    whose path is returned: what is read is never overwritten, and a failed write has no version.

    A version counts once its manifest, a file of its number that only one writer can make, names its
    folder. A writer that finds the number taken reads the newer version and merges again, so writers side
    by side lose no rows; new is written first, so that merging again doesn't make it again.
    before_commit, if given, is called ahead of each try, for tests.
    """
    own = f"{path}/data/{uuid.uuid4().hex}"
    new.write.parquet(f"{own}/new")
    more = spark.read.schema(new.schema).parquet(f"{own}/new")
    for _ in range(tries):
        n, old = _newest(spark, path)
        at = f"{own}/v{n + 1}"
        rows = more if old is None else upsert(spark.read.parquet(old), more, *keys)
        rows.write.mode("overwrite").parquet(at)
        if before_commit:
            before_commit()
        if _claimed(spark, f"{path}/manifests/{n + 1}", at):
            return at
    raise OSError(f"{tries} other versions came first under {path}")


def _claimed(spark: SparkSession, manifest: str, at: str) -> bool:
    """Whether the manifest could be made, with `at` in it: by one writer alone, and seen whole or not at all."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    p, draft = hadoop.fs.Path(manifest), hadoop.fs.Path(f"{at}.manifest")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    out = fs.create(draft, True)
    out.write(bytearray(at.encode()))
    out.close()
    try:
        # not overwritten where it's there: renamed in one step in HDFS, checked first in local folders
        spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, p, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:  # noqa: BLE001
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return _read(fs, p) == at


def _read(fs, p) -> str:
    found = fs.open(p)
    try:
        return bytes(found.readAllBytes()).decode()
    finally:
        found.close()


def _newest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
    last = max(found, key=lambda f: int(f.getName()), default=None)
    return (-1, None) if last is None else (int(last.getName()), _read(fs, last))


def newest(spark: SparkSession, path: str) -> str | None:
    """The newest whole version under path."""
    return _newest(spark, path)[1]


def snapshot(runs: DataFrame, statements: DataFrame, evidence: DataFrame) -> DataFrame:
    """(run_id, state): each run as one JSON text, statements with their evidence inside, in order."""
    own = [c for c in evidence.columns if c not in ("run_id", "stmt_id", "ord")]
    held = evidence.groupBy("run_id", "stmt_id").agg(F.array_sort(F.collect_list(F.struct("ord", *own))).alias("evidence"))
    fields = [c for c in statements.columns if c not in ("run_id", "stmt_id")]
    whole = statements.join(held, ["run_id", "stmt_id"], "left").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("stmt_id", *fields, "evidence"))).alias("statements"))
    joined = runs.join(whole, "run_id", "left")
    return joined.select("run_id", F.to_json(F.struct(*[c for c in joined.columns if c != "run_id"])).alias("state"))


def records(rows: DataFrame, text: str, label: str) -> DataFrame:
    """Statement and label of each row."""
    return rows.select(F.col(text).alias("statement"), F.col(label).alias("label"))


def write_split(rows: DataFrame, path: str, column: str = "split") -> None:
    """A folder of JSON lines for each value of the split."""
    rows.write.mode("overwrite").partitionBy(column).json(path)


def report(statements: DataFrame, evidence: DataFrame) -> DataFrame:
    """(run_id, stmt_id, block): a text for each claim with its verdict and its evidence in order."""
    line = F.concat(F.lit("  - "), F.coalesce("title", "chunk_id", "url", F.lit("Untitled source")), F.lit(" (w "), F.coalesce(two_decimals(F.col("weight")), F.lit("-")), F.lit(", rel "), F.coalesce(two_decimals(F.col("relevance")), F.lit("-")), F.lit(")"))
    held = evidence.groupBy("run_id", "stmt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    head = F.concat_ws(" | ", F.concat(F.lit("["), F.col("stmt_id").cast("string"), F.lit("] "), F.col("text")), F.upper("verdict"), two_decimals(F.col("score")))
    return statements.join(held, ["run_id", "stmt_id"], "left").select("run_id", "stmt_id", F.concat_ws("\n", head, F.array_join("lines", "\n")).alias("block"))
