"""Lists, maps, tables and model calls on small inputs with known answers."""

import pytest
from pyspark.sql import functions as F

from evidentia.functions import collections as C
from evidentia.operators import tables as B
from evidentia.plans import models as M


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_collections(spark):
    L, none = F.lit, F.lit(None).cast("string")
    m, n = F.create_map(L("a"), L(1), L("b"), L(2)), F.create_map(L("b"), L(3), L("c"), L(4))
    assert values(spark, C.counted(F.array(L("x"), L("y"), L("x"), none)), C.count_of(m, L("b")), C.count_of(m, L("z"))) == [{"x": 2, "y": 1}, 2, 0]
    assert values(spark, C.merged_map(m, n), C.merged_map(m, L(None).cast("map<string,int>")), C.without_keys(m, "a")) == [{"a": 1, "b": 3, "c": 4}, {"a": 1, "b": 2}, {"b": 2}]
    pair = lambda k, v: F.struct(L(k).alias("name"), v.cast("double").alias("value"))
    assert values(spark, C.best_of(F.array(pair("s", L(0.4)), pair("r", L(0.4)), pair("n", none))), C.best_of(F.array(pair("s", none)))) == ["s", None]
    assert values(spark, C.any_given(none, L("")), C.any_given(none, L("x")), C.as_texts(L("x"), False), C.as_texts(none, False), C.as_texts(F.array(L(""), L("y")), True)) == [False, True, ["x"], [], ["y"]]
    assert values(spark, C.first_valid(L("x"), L("-1"), L("8"), default=5), C.first_valid(none, default=5)) == [8, 5]
    assert C.cut_texts({"a": ["abcdef", 3], "b": "ab"}, 2) == {"a": ["ab... [truncated 4 chars]", 3], "b": "ab"}


def test_tables(spark):
    df = spark.createDataFrame([(1, "a", " b ", 0), (2, "", None, 1), (3, "c", "", 2)], "id int, en_claim string, de_claim string, label int")
    assert sorted(map(tuple, B.long_form(df, "id", ["en", "de"]).collect())) == [(1, "de", "b", 0), (1, "en", "a", 0), (3, "en", "c", 2)]
    assert B.for_training(df.select("id", "label")).columns == ["labels"] and B.for_training(df.select("en_claim")).columns == ["en_claim", "labels"]
    assert B.stacked(df, df.select("id")).count() == 6 and B.head(df, None).count() == 3 and [r.id for r in B.head(df, 2, "id").collect()] == [1, 2]
    rows = spark.createDataFrame([(i, i % 2) for i in range(10)], "id int, k int")
    assert sorted(r.id for r in B.capped(rows, 2, ["id"], "k").collect()) == [0, 1, 2, 3] and {r.id: r.batch for r in B.batched(rows, 2, ["id"], "k").collect()} == {i: i // 4 for i in range(10)}
    order = [r.id for r in B.shuffled(rows, "id").collect()]
    assert order == [r.id for r in B.shuffled(rows.repartition(3), "id").collect()] and sorted(order) == list(range(10)) != order
    assert B.known(rows, rows.where("id < 3"), "id").count() == 3
    waits = [r.x for r in rows.select(B.jitter(F.col("id")).alias("x")).collect()]
    assert all(2 <= x < 5 for x in waits) and len(set(waits)) == 10


def test_models(spark):
    def call(prompt, model, temperature, **more):
        if prompt == "fail":
            raise OSError
        return f" {model} {prompt} {temperature} {sorted(more)} "

    df = spark.createDataFrame([(1, "p"), (2, "fail"), (3, None)], "id int, t string")
    ask = M.replies(call, "m", max_tokens=5)
    assert [r.x for r in df.select("id", ask(F.col("t")).alias("x")).orderBy("id").collect()] == ["m p 0.0 ['max_tokens']", None, None]
    for bad in ({"temperature": -1}, {"max_tokens": 0}, {"context": -3}):
        with pytest.raises(ValueError):
            M.replies(call, "m", **bad)
    vectors = M.embeddings(lambda texts: [[3.0, 4.0] if t == "p" else [0.0, 0.0] for t in texts], 1)
    assert [r.x for r in df.select("id", vectors(F.col("t")).alias("x")).orderBy("id").collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    assert M.nli_places({0: "Contradiction", 1: "ENTAILMENT", 2: "neutral"}) == (1, 2, 0) and M.nli_places({0: "LABEL_0"}) == (0, 1, 2)
    p = F.array(F.lit(0.1), F.lit(0.7), F.lit(0.2))
    say = lambda c: F.when(c.contains("Is"), "A: It is.")
    none = F.lit(None).cast("string")
    assert values(spark, M.stance_scorer(p, {0: "contradiction", 1: "entailment", 2: "neutral"}), M.rewritten(F.lit("Is it?"), say), M.rewritten(F.lit("Was it?"), say), M.summarised(F.lit("Is"), none, say), M.summarised(F.lit("Is"), F.lit("x"), say)) == [[0.7, 0.2, 0.1], "It is.", "Was it", "", "A: It is."]
