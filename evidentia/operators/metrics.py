"""Evaluation: confusion counts, accuracy, two macro averages, run-log sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame) -> DataFrame:
    return rows.where("p is not null").groupBy("t", "p").agg(F.count("*").alias("n"))


def accuracy(rows: DataFrame) -> DataFrame:
    scored = F.col("p").isNotNull()
    return rows.agg(
        F.count_if(scored).alias("scored"), F.count_if(~scored).alias("skipped"),
        F.coalesce(F.avg(F.when(scored, (F.col("t") == F.col("p")).cast("double"))), F.lit(0.0)).alias("accuracy"),
    )


def macro(rows: DataFrame, classes: list[int] | None = None) -> DataFrame:
    """Macro precision, recall and F1.

    Without classes those are all that occur and undefined values are 0; with fixed classes
    undefined values are left out of the means.
    """
    cm = confusion(rows)
    if classes is None:
        kinds = cm.select(F.col("t").alias("c")).union(cm.select("p")).distinct()
    else:
        kinds = rows.sparkSession.createDataFrame([(c,) for c in classes], "c int")
        cm = cm.where(F.col("t").isin(classes) & F.col("p").isin(classes))
    each = cm.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("truth"), F.lit(0).cast("long").alias("said"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("truth"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    per = kinds.join(each.groupBy("c").agg(F.sum("truth").alias("truth"), F.sum("said").alias("said"), F.sum("hit").alias("hit")), "c", "left").na.fill(0)
    p, r = F.try_divide(F.col("hit").cast("double"), F.col("said")), F.try_divide(F.col("hit").cast("double"), F.col("truth"))
    if classes is None:
        p, r = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
    f = F.try_divide(2 * p * r, p + r)
    f = F.coalesce(f, F.lit(0.0)) if classes is None else f
    # where rows are scored but no class has a value, the mean is 0; of no rows it's null
    mean = lambda x: F.when(F.sum("truth") > 0, F.coalesce(F.avg(x), F.lit(0.0)))
    mean = mean if classes is not None else F.avg
    return per.agg(*[mean(x).alias(n) for n, x in (("precision", p), ("recall", r), ("f1", f))])


def class_recall(rows: DataFrame) -> DataFrame:
    return rows.where("p is not null").groupBy("t").agg(F.avg((F.col("t") == F.col("p")).cast("double")).alias("recall"))


def log_sums(log: DataFrame) -> DataFrame:
    """Per run of a log (run_id, step, tokens, is_module, before, after as maps of counts): tokens, found and discarded."""
    change = F.map_values(F.map_zip_with(F.coalesce("before", F.create_map().cast("map<string,int>")), F.coalesce("after", F.create_map().cast("map<string,int>")), lambda k, x, y: F.coalesce(y, F.lit(0)) - F.coalesce(x, F.lit(0))))
    add = lambda sign: F.aggregate(change, F.lit(0), lambda s, x: s + F.greatest(F.lit(0), sign * x))
    return log.where(~F.col("is_module")).groupBy("run_id").agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.sum(add(1)).alias("found"), F.sum(add(-1)).alias("discarded"))


def label_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))


def valid_labels(rows: DataFrame, *columns: str, labels: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Rows whose labels are all among those that count."""
    for c in columns:
        rows = rows.where(F.col(c).isin(*labels))
    return rows


def tokens_by_step(log: DataFrame) -> DataFrame:
    """Per run its tokens, and those of each step in order; modules don't count."""
    at = F.struct("seq", "step", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    steps = F.transform(F.array_sort(F.collect_list(at)), lambda x: F.struct(x["step"].alias("step"), x["tokens"].alias("tokens")))
    return log.where(~F.coalesce("is_module", F.lit(False))).groupBy("run_id").agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("total"), steps.alias("by_step"))


def evidence_changes(log: DataFrame) -> DataFrame:
    """Per run of a log (run_id, is_module, before, after as maps of counts): found and discarded,
    in all and by source (maps). Steps without both counts don't count; where no step has
    them all four are null."""
    none = F.create_map().cast("map<string,int>")
    counted = ~F.coalesce("is_module", F.lit(False)) & F.col("before").isNotNull() & F.col("after").isNotNull()
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    step = F.when(counted, total(F.col("after")) - total(F.col("before")))
    change = F.when(counted, F.map_zip_with(F.col("before"), F.col("after"), lambda k, x, y: F.coalesce(y, F.lit(0)) - F.coalesce(x, F.lit(0)))).otherwise(none)
    steps = log.select("run_id", step.alias("d"), change.alias("change"))
    whole = steps.groupBy("run_id").agg(F.sum(F.when(F.col("d").isNotNull(), F.greatest("d", F.lit(0)))).alias("found"), F.sum(F.when(F.col("d").isNotNull(), F.greatest(-F.col("d"), F.lit(0)))).alias("discarded"), F.count("d").alias("n"))
    each = steps.select("run_id", F.explode("change").alias("source", "d")).groupBy("run_id", "source").agg(F.sum(F.greatest("d", F.lit(0))).alias("up"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("down"))
    pairs = lambda c: F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.struct("source", c)), lambda x: x[c] > 0)))
    by = each.groupBy("run_id").agg(pairs("up").alias("found_by_source"), pairs("down").alias("discarded_by_source"))
    empty = F.create_map().cast("map<string,bigint>")
    some = F.col("n") > 0
    return whole.join(by, "run_id", "left").select(
        "run_id", F.when(some, F.col("found")).alias("found"), F.when(some, F.col("discarded")).alias("discarded"),
        F.when(some, F.coalesce("found_by_source", empty)).alias("found_by_source"), F.when(some, F.coalesce("discarded_by_source", empty)).alias("discarded_by_source"),
    )
