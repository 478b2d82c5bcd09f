"""Evaluation of configs over labelled claims: records by (config, id), summaries by config."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.text import normalised_verdict, verdict_label
from evidentia.operators import metrics as M
from evidentia.operators.windows import stratified_split
from evidentia.plans.pipeline import State, check, run
from evidentia.sources.readers import not_done
from evidentia.sources.sinks import write_json

RECORD = "config string, id long, true_label int, predicted_label int, verdict string, error string, pipeline_seconds double"


def evaluate(spark: SparkSession, config: dict, items: DataFrame, done: DataFrame | None = None, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Records of one config over items (id, statement, label), all of them in one plan.

    Each item is a run of its own whose claim takes the place of the config's inline
    statements. Items that done has for this config are left out, failed ones too.
    A verdict that is no label leaves predicted_label null and says so in error.
    """
    check(config)
    name = config.get("name", "Unnamed_Pipeline")
    if done is not None:
        items = not_done(items, done.where(F.col("config") == name), "id")
    steps = [s for s in config["steps"] if s["type"] != "mock_statements"]
    if len(steps) == len(config["steps"]):
        raise ValueError("the config has no step mock_statements")
    claims = items.select(F.col("id").cast("int").alias("run_id"), F.lit(1).alias("stmt_id"), F.col("statement").alias("text"))
    start = time.time()
    state = run({**config, "steps": steps}, State({**(tables or {}), "statements": claims}, session=spark))
    took = time.time() - start
    judged = state.tables["statements"]
    verdict = normalised_verdict(F.col("verdict")) if "verdict" in judged.columns else F.lit(None).cast("string")
    judged = judged.select(F.col("run_id").cast("long").alias("id"), verdict.alias("verdict"))
    label = verdict_label(F.col("verdict"))
    return items.join(judged, "id", "left").select(
        F.lit(name).alias("config"), "id", F.col("label").alias("true_label"), label.alias("predicted_label"), "verdict",
        F.when(label.isNull(), F.concat(F.lit("Unexpected or missing verdict: "), F.coalesce("verdict", F.lit("None")))).alias("error"), F.lit(took).alias("pipeline_seconds"),
    )


def evaluate_all(spark: SparkSession, configs: list[dict], items: DataFrame, done: DataFrame | None = None, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The records of every config over every item, side by side."""
    out = None
    for config in configs:
        one = evaluate(spark, config, items, done, tables)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], RECORD)


def summaries(records: DataFrame) -> DataFrame:
    """Per config: n_scored, n_skipped, accuracy, macro precision, recall and F1 (over the classes
    that occur, undefined ones 0), per_class_recall and confusion as maps."""
    t, p = F.col("true_label"), F.col("predicted_label")
    counts = records.groupBy("config").agg(F.count_if(p.isNotNull()).alias("n_scored"), F.count_if(p.isNull()).alias("n_skipped"), F.coalesce(F.avg(F.when(p.isNotNull(), (t == p).cast("double"))), F.lit(0.0)).alias("accuracy"))
    cm = records.where(p.isNotNull()).groupBy("config", t.alias("t"), p.alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    sides = F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("truth"), F.lit(0).cast("long").alias("said"), hit.alias("hit")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("truth"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))
    per = cm.select("config", F.explode(sides).alias("x")).groupBy("config", "x.c").agg(F.sum("x.truth").alias("truth"), F.sum("x.said").alias("said"), F.sum("x.hit").alias("hit"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    pr, rc = share(F.col("hit"), F.col("said")), share(F.col("hit"), F.col("truth"))
    macro = per.groupBy("config").agg(F.avg(pr).alias("precision"), F.avg(rc).alias("recall"), F.avg(share(2 * pr * rc, pr + rc)).alias("f1_score"), F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.struct("c", F.when(F.col("truth") > 0, rc).alias("r"))), lambda x: x["r"].isNotNull()))).alias("per_class_recall"))
    table = cm.groupBy("config").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(":", "t", "p").alias("k"), "n")))).alias("confusion"))
    zero = {c: 0.0 for c in ("precision", "recall", "f1_score")}
    return counts.join(macro, "config", "left").join(table, "config", "left").na.fill(zero)


LABELS = (0, 1, 2)


def _stages(features: int, penalty: float):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+"), HashingTF(inputCol="words", outputCol="counts", numFeatures=features),
        IDF(inputCol="counts", outputCol="features"), LogisticRegression(labelCol="label", featuresCol="features", maxIter=20, regParam=penalty),
    ])


def text_baseline(train: DataFrame, test: DataFrame, features: int = 1 << 14) -> DataFrame:
    """id, label and prediction of test (id, text, label): logistic regression on weighted
    words, a stand-in for a fine-tuned model."""
    model = _stages(features, 0.0).fit(M.valid_labels(train, "label").na.fill("", ["text"]))
    return model.transform(test.na.fill("", ["text"])).select("id", "label", F.col("prediction").cast("int").alias("prediction"))


def validation_split(train: DataFrame, share: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows (id, text, label) with a label that counts, as (to train on, to choose by): a share of
    each label's rows, by a hash of id and seed, is for choosing."""
    split = stratified_split(M.valid_labels(train, "label", labels=LABELS), "label", "id", 1 - share, seed)
    return split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split")


def fixed_metrics(predicted: DataFrame) -> dict:
    """Metrics of rows (true_label, predicted_label): those whose true label counts are scored. Means over
    the labels leave undefined values out; where nothing is scored all are None."""
    rows = predicted.select(F.when(F.col("true_label").isin(*LABELS), F.col("true_label")).alias("t"), F.col("predicted_label").alias("p"))
    total, scored = rows.count(), rows.where("t is not null").select("t", "p")
    n = scored.count()
    out = {"n_total_in_file": total, "n_scored": n, "n_skipped": total - n}
    if not n:
        return out | {"accuracy": None, "precision": None, "recall": None, "f1_score": None, "per_class_recall": {str(c): None for c in LABELS}, "confusion_matrix": {}}
    recall = {r.t: r.recall for r in M.class_recall(scored).collect()}
    means = M.macro(scored, list(LABELS)).first()
    table: dict[str, dict[str, int]] = {}
    for r in M.confusion(scored).orderBy("t", "p").collect():
        table.setdefault(str(r.t), {})[str(r.p)] = r.n
    return out | {
        "accuracy": M.accuracy(scored).first().accuracy, "precision": means.precision, "recall": means.recall, "f1_score": means.f1,
        "per_class_recall": {str(c): recall.get(c) for c in LABELS}, "confusion_matrix": table,
    }


def baseline_run(train: DataFrame, test: DataFrame, path: str, share: float = 0.1, seed: int = 42, penalties: tuple[float, ...] = (0.0, 0.01, 0.1), features: int = 1 << 14) -> dict:
    """Trains the baseline, writes predictions and metrics under path, and returns the metrics.

    Of the penalties that with the least log loss on the validation rows, which come from train
    alone, is kept (the first with share 0). Every row of test (id, text, label) is predicted: path/predictions has
    (id, true_label, predicted_label) as JSON lines, path/metrics one JSON line of fixed_metrics() and
    of what was chosen. Raises where fewer than 10 rows of train have a label that counts.
    """
    use, choose = validation_split(train, share, seed) if share > 0 else (M.valid_labels(train, "label", labels=LABELS), None)
    use, held = use.na.fill("", ["text"]).cache(), choose is not None
    losses: dict[float, float | None] = {}
    try:
        if use.count() + (choose.count() if held else 0) < 10:
            raise ValueError("fewer than 10 rows to train on have a label that counts")
        models = {}
        for penalty in penalties if held else penalties[:1]:
            models[penalty] = _stages(features, penalty).fit(use)
            losses[penalty] = log_loss(models[penalty].transform(choose.na.fill("", ["text"]))) if held else None
    finally:
        use.unpersist()
    best = min(losses, key=lambda p: (losses[p] is None, losses[p] or 0.0))
    said = models[best].transform(test.na.fill("", ["text"])).select("id", F.col("label").alias("true_label"), F.col("prediction").cast("int").alias("predicted_label"))
    write_json(said, f"{path}/predictions")
    spark = test.sparkSession
    read = spark.read.schema(said.schema).json(f"{path}/predictions")
    metrics = fixed_metrics(read) | {"penalty": best, "validation_loss": losses[best]}
    rows = spark.createDataFrame([(json.dumps(metrics, sort_keys=True),)], "value string")
    rows.coalesce(1).write.mode("overwrite").text(f"{path}/metrics")
    return metrics


def log_loss(judged: DataFrame) -> float | None:
    """Mean of minus the logarithm of the probability of each row's own label; null of no rows."""
    from pyspark.ml.functions import vector_to_array

    p = F.get(vector_to_array("probability"), F.col("label").cast("int"))
    return judged.agg(F.avg(-F.log(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(1e-15))))).first()[0]
