"""Ranks, windows of tokens, splits and allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_windows(tokens: Column, size: int = 512, overlap: int = 64) -> Column:
    """Arrays of `size` tokens that overlap; none of no tokens, and the last ends the text."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(n > 0, F.transform(starts, lambda s: F.slice(tokens, s + 1, size))).otherwise(F.array().cast("array<array<string>>"))


#: Hex digits of a hash that deal the rows of a label to parts.
SPLIT_DIGITS = 2


def stratified_split(rows: DataFrame, label: str, key: str, share: float, seed: int = 0, order: str | None = None, span: int = 4096) -> DataFrame:
    """rows with split: in each label the first share, by an md5 of key and seed, is "train"; or
    by order, a column of whole numbers.

    The hash's first digits deal a label to 256 parts, an order to spans of its values, and the parts'
    sizes tell where the cut falls; rows are ranked within a part only, so no task holds a whole label.
    """
    if order:
        dealt = rows.withColumn("_hash", F.col(order)).withColumn("_part", F.floor(F.col(order) / span))
    else:
        h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
        dealt = rows.withColumn("_hash", h).withColumn("_part", F.substring("_hash", 1, SPLIT_DIGITS))
    sizes = dealt.groupBy(F.col(label).alias("_label"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    own = Window.partitionBy("_label")
    sizes = sizes.select("_label", "_p", (F.sum("_n").over(own.orderBy("_p")) - F.col("_n")).alias("_before"), F.floor(F.sum("_n").over(own) * share).alias("_train"))
    inside = F.row_number().over(Window.partitionBy(label, "_part").orderBy("_hash", key))
    ranked = dealt.withColumn("_rank", inside).join(sizes, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_part") == F.col("_p")))
    return ranked.withColumn("split", F.when(F.col("_before") + F.col("_rank") <= F.col("_train"), "train").otherwise("test")).drop("_hash", "_part", "_label", "_p", "_before", "_train", "_rank")


def largest_remainder(n: int, ratios: list[float]) -> list[int]:
    """n in whole parts by ratio; what is left goes to the largest fractions, later ones first on ties."""
    exact = [n * r for r in ratios]
    out = [int(x) for x in exact]
    for i in sorted(range(len(ratios)), key=lambda i: (exact[i] - out[i], i), reverse=True)[: n - sum(out)]:
        out[i] += 1
    return out


def log_order(log: DataFrame) -> DataFrame:
    """A log in which a module comes before its steps: rows (run_id, seq, indent, is_module) with
    place. A step belongs to the next module that is one level further out; entries whose
    module never ends have no place and are left out. A run's log is one row's list.
    """
    entries = log.groupBy(F.col("run_id").alias("_run")).agg(F.collect_list(F.struct("seq", "indent", "is_module")).alias("_log"))

    def module_of(seq: Column) -> Column:
        own = F.get(F.filter("_log", lambda e: e["seq"] == seq), 0)
        return F.array_min(F.transform(F.filter("_log", lambda m: m["is_module"] & (m["indent"] == own["indent"] - 1) & (m["seq"] > seq)), lambda m: m["seq"]))

    joined = log.join(entries, F.col("run_id").eqNullSafe(F.col("_run")))
    up = F.when(F.col("indent") > 0, F.sequence(F.lit(1), F.col("indent"))).otherwise(F.array().cast("array<int>"))
    path = F.aggregate(up, F.array(F.col("seq")), lambda path, _: F.concat(F.array(module_of(F.get(path, 0))), path))
    placed = joined.withColumn("_path", path).where(~F.exists("_path", lambda x: x.isNull()))
    w = Window.partitionBy("run_id").orderBy("_path")
    return placed.withColumn("place", F.row_number().over(w)).drop("_run", "_log", "_path")


def running_sum(rows: DataFrame, value: str, at: list[str], *keys: str) -> DataFrame:
    """rows with total: the sum of value so far in each key."""
    w = Window.partitionBy(*keys).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("total", F.sum(F.coalesce(F.col(value), F.lit(0))).over(w))


def window_rows(pages: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """(doc_id, chunk_id, pages, tokens) of pages (doc_id, page, tokens): windows over a
    document's tokens in order of page, each with the pages it touches, its id the document's
    and its place in six digits. Windows of blank tokens alone are left out but keep their number."""
    held = pages.where(F.size("tokens") > 0).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "tokens"))).alias("held"))
    ends = F.aggregate("held", F.array(F.lit(0)), lambda s, p: F.concat(s, F.array(F.element_at(s, -1) + F.size(p["tokens"]))))
    whole = held.select("doc_id", F.flatten(F.col("held.tokens")).alias("all"), F.col("held.page").alias("page"), ends.alias("ends"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    # a page is touched where it begins before the window's end and ends after its start
    touched = lambda s: F.filter("page", lambda p, i: (F.get("ends", i) < s + size) & (F.get("ends", i + 1) > s))
    parts = F.transform(starts, lambda s: F.struct(F.slice("all", s + 1, size).alias("tokens"), F.array_sort(F.array_distinct(touched(s))).alias("pages")))
    cut = whole.select("doc_id", F.posexplode(parts).alias("at", "part")).where(F.exists("part.tokens", lambda t: F.trim(t) != ""))
    return cut.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.lpad(F.col("at").cast("string"), 6, "0")).alias("chunk_id"), "part.pages", "part.tokens")
