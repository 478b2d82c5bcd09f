"""Every stage of the pipeline against brute force on its own input."""

import os
import sys

import pytest
from pyspark.sql import functions as F

from evidentia.llm.common import table, written

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
import corpus_pipeline  # noqa: E402
from test_filters_and_tokens import brute_contamination, check_packing  # noqa: E402
from test_near_duplicates import brute_lines, classes  # noqa: E402


def test_stages_one_by_one(spark, sf):
    docs = table(spark, sf, "documents")
    columns, have, packed = docs.columns, docs.collect(), None
    bench = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf), f"test-{name}")
        rows = [(r.doc_id, r.text) for r in have]
        if name == "packing":
            check_packing(out.collect(), dict(rows))
            packed = {r.doc_id for r in out.collect()}
            assert packed == {d for d, _ in rows}
            continue
        assert out.columns == columns
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "language_id":
            want = {d: t for d, t in rows if t and any(c.isalpha() for c in t)}
        elif name == "line_dedup":
            want = {d: t for d, t, _, n in brute_lines(rows) if not n or any(c.isalnum() for c in t)}
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "near_dedup":
            want = {d: dict(rows)[d] for d, c in classes(rows).items() if d == c}
        else:
            want = {d: t for (d, t), x in zip(rows, brute_contamination([t for _, t in rows], bench), strict=True) if not x[4]}
        assert after == want, name
        assert 0 < len(after) <= len(rows)
        docs, have = out, out.collect()
    assert packed


@pytest.mark.parametrize("n", [0, 1])
def test_odd_tables_pass_through(spark, sf, n):
    rows = [(1, None, "en"), (2, "", "en"), (3, "same text of several words here", None), (3, "same text of several words here", None), (None, "other text", "en"), (4, "!!", "de")]
    docs = spark.createDataFrame(rows if n else [], "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("n_lines", F.lit(1)).withColumn("gone_id", F.lit(2))
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), "test-odd")
    got = {r.doc_id for r in docs.collect()}
    assert got <= {3, None} and (3 in got or not n)


def test_rows_are_told_by_id_and_text(spark, sf):
    item = table(spark, sf, "benchmark").where("text is not null").orderBy(F.desc(F.length("text"))).first().text
    clean = ["a clean text that no benchmark item has in it at all", "another clean text with other words than the first of them"]
    rows = [(None, item), (None, clean[0]), (7, item), (7, clean[1]), (8, "text of the pair that is a copy here"), (None, "text of the pair that is a copy here")]
    names = ["_gone_doc_id", "score", "lang_pred", "n_lines", "n_dropped", "_found", "_key", "kept", "text_key"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    for c in names:
        docs = docs.withColumn(c, F.lit("mine"))
    stages = dict(corpus_pipeline.STAGES)
    out = {}
    for name in ("language_id", "line_dedup", "near_dedup", "decontamination"):
        got = stages[name](spark, docs, sf)
        assert got.columns == docs.columns and all(set(r[3:]) == {"mine"} for r in got.collect()), name
        out[name] = sorted(((r.doc_id or 0), r.text) for r in got.collect())
    assert out["decontamination"] == sorted(((d or 0), t) for d, t in rows if t != item)
    assert (0, rows[5][1]) not in out["near_dedup"] and (8, rows[4][1]) in out["near_dedup"] and (7, clean[1]) in out["near_dedup"]


def test_decontamination_sends_workers_small_batches(spark, sf, monkeypatch):
    sent, write = [], corpus_pipeline.written
    monkeypatch.setattr(corpus_pipeline, "written", lambda df, name, batch=None: sent.append((df.columns, batch)) or write(df, name, batch))
    docs = table(spark, sf, "documents")
    got = {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, sf).collect()}
    assert sent == [(["doc_id", "text_key"], "8m")]
    judged = corpus_pipeline.contamination(docs, table(spark, sf, "benchmark"))
    assert got == {r.doc_id for r in judged.where("not contaminated").collect()} and len(got) < docs.count()
