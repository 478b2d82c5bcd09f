"""The text baseline: validation rows from training alone, saved predictions and metrics."""

import json

import pytest

from evidentia.plans import evaluation as V

ITEMS = "id long, text string, label int"


def lines(path):
    return [json.loads(x) for f in path.glob("*") if f.name.startswith("part") for x in f.read_text().splitlines()]


def by_hand(rows):
    scored = [(t, p) for t, p in rows if t in (0, 1, 2)]
    out, some = {"n_total_in_file": len(rows), "n_scored": len(scored), "n_skipped": len(rows) - len(scored)}, lambda xs: [x for x in xs if x is not None]
    hit = {c: sum(t == p == c for t, p in scored) for c in (0, 1, 2)}
    said, truth = ({c: sum(x[i] == c for x in scored) for c in (0, 1, 2)} for i in (1, 0))
    precision, recall = ({c: hit[c] / n[c] if n[c] else None for c in (0, 1, 2)} for n in (said, truth))
    f1 = [2 * a * b / (a + b) if a is not None and b is not None and a + b else None for a, b in zip(precision.values(), recall.values(), strict=True)]
    mean = lambda xs: sum(some(xs)) / len(some(xs)) if some(xs) else 0.0
    return out | {"accuracy": sum(hit.values()) / len(scored), "precision": mean(precision.values()), "recall": mean(recall.values()), "f1_score": mean(f1), "per_class_recall": {str(c): r for c, r in recall.items()}}


def test_run_saves_predictions_and_metrics(spark, tmp_path):
    words = {0: "good fine nice", 1: "plain so so", 2: "bad sad poor"}
    train = spark.createDataFrame([(i, words[i % 3] + f" w{i % 7}", i % 3) for i in range(90)] + [(900, "odd", 7), (901, None, None)], ITEMS)
    test = spark.createDataFrame([(1, "good nice", 0), (2, "sad poor", 2), (3, "fine", 2), (4, "so plain", None), (5, None, 9), (6, "nice fine", 0)], ITEMS)
    use, choose = V.validation_split(train)
    assert (use.count(), choose.count()) == (81, 9) and not use.join(choose, "id").count() and use.join(train, "id").count() == 81
    metrics = V.baseline_run(train, test, str(tmp_path))
    rows = lines(tmp_path / "predictions")
    assert sorted(r["id"] for r in rows) == [1, 2, 3, 4, 5, 6] and {r["id"]: r["true_label"] for r in rows}[5] == 9
    found = {r["id"]: r["predicted_label"] for r in rows}
    assert (found[1], found[2], found[3], found[4]) == (0, 2, 0, 1)
    want = by_hand([(r["true_label"], r["predicted_label"]) for r in rows])
    assert {k: pytest.approx(metrics[k]) for k in want if k != "per_class_recall"} == {k: v for k, v in want.items() if k != "per_class_recall"} and metrics["per_class_recall"] == want["per_class_recall"]
    assert metrics["confusion_matrix"] == {"0": {"0": 2}, "2": {"0": 1, "2": 1}} and metrics["validation_loss"] < 0.7
    assert lines(tmp_path / "metrics") == [metrics]
    assert V.baseline_run(train, test, str(tmp_path / "b"), share=0)["validation_loss"] is None
    assert V.baseline_run(train, test.where("id > 3 and id < 6"), str(tmp_path / "c"))["accuracy"] is None
    with pytest.raises(ValueError, match="fewer than 10"):
        V.baseline_run(train.where("id < 9"), test, str(tmp_path / "d"))
