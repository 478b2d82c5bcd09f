"""Whole tables: long form, renaming, unions, heads, batches, shuffles, semi-joins, jitter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_form(rows: DataFrame, id: str, languages: list[str], label: str = "label") -> DataFrame:
    """(row_id, lang, claim, label): a row for each language's claim, without blank ones."""
    claims = F.array(*[F.struct(F.lit(g).alias("lang"), F.trim(f"{g}_claim").alias("claim")) for g in languages])
    return rows.select(F.col(id).alias("row_id"), F.explode(claims).alias("x"), F.col(label).alias("label")).select("row_id", "x.lang", "x.claim", "label").where("claim <> ''")


def for_training(rows: DataFrame) -> DataFrame:
    """Records as a trainer takes them: label is called labels, ids go, and a text may have no label."""
    labelled = rows if "label" in rows.columns else rows.withColumn("label", F.lit(None).cast("int"))
    return labelled.drop("id").withColumnRenamed("label", "labels")


def stacked(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, by name; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def head(rows: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n in an order, or all."""
    return rows if n is None else rows.orderBy(*order).limit(n)


def capped(rows: DataFrame, n: int, order: list[str], *keys: str) -> DataFrame:
    """The first n of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def batched(rows: DataFrame, size: int, order: list[str], *keys: str) -> DataFrame:
    """rows with batch: places in each key's order, `size` to a batch, from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """The same order for the same seed."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key)


def known(rows: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key others have."""
    return rows.join(others.select(*keys).distinct(), list(keys), "left_semi")


def jitter(key: Column, low: float = 2.0, high: float = 5.0, seed: int = 42) -> Column:
    """A number between low and high that follows from key and seed, so that a retry waits alike."""
    return low + (high - low) * F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
