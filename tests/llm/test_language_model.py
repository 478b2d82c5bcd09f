"""The Pitman-Yor model: counts and base against brute force, proper probabilities, better than the base."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import common
from evidentia.llm import language_model as lm
from evidentia.llm.common import table


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def base(rows):
    count = Counter(t for _, held, text in rows if not held for t in tokens(text))
    n, v = sum(count.values()), len(count)
    for d, held, text in rows:
        t = tokens(text)
        yield d, held, len(t), sum(count[x] > 0 for x in t), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t)


def near(a, b):
    return a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))


def test_counts_and_base_equal_brute_force(spark, sf):
    got = sorted(lm.op9_language_model(spark, sf).collect())
    rows = [(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 7 == 2, r.text) for r in table(spark, sf, "documents").collect()]
    want = sorted(base(rows))
    assert len(got) == len(want) and all(near(tuple(g), w) for g, w in zip(got, want, strict=True))
    held = [g for g in got if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held) and all(math.isfinite(g.score) and g.score < 0 for g in got)


def test_probabilities_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 40)  # many chunks
    rng = np.random.default_rng(5)
    words = [f"w{int(i)}" for i in rng.zipf(1.5, 400) % 12]
    train = [(i, False, " ".join(words[8 * i : 8 * i + 8])) for i in range(50)]
    vocabulary = sorted(set(words))
    asked = [(1000 * i + j, True, f"{u} {w}") for i, u in enumerate([*vocabulary, "zzz"], 1) for j, w in enumerate([*vocabulary, "unseen"])]
    asked += [(1_000_000 + i, True, u) for i, u in enumerate([*vocabulary, "zzz"], 1)]
    asked.append((2_000_000, True, ""))
    df = spark.createDataFrame(train + asked, "doc_id long, held_out boolean, text string")
    got = {r.doc_id: r.token_scores for r in lm.score_documents(df, each=True).where("held_out").collect()}
    for i in range(1, len(vocabulary) + 2):
        after = sum(10 ** got[1000 * i + j][1] for j in range(len(vocabulary) + 1)) + 10 ** got[1_000_000 + i][1]
        assert abs(after - 1) < 1e-6
    first = sum(10 ** got[1000 * i][0] for i in range(1, len(vocabulary) + 2))
    assert abs(first + 10 ** got[2_000_000][0] - 1) < 1e-6


def test_one_result_however_the_documents_are_cut(spark, sf, monkeypatch):
    df = table(spark, sf, "documents").select("doc_id", lm.is_held_out().alias("held_out"), "text")
    some = {r.doc_id: r.score for r in lm.score_documents(df).collect()}
    monkeypatch.setattr(lm, "CHUNK_BYTES", 30_000)
    more = {r.doc_id: r.score for r in lm.score_documents(df.repartition(7)).collect()}
    a, b = sum(some.values()), sum(more.values())
    assert abs(a - b) < 0.01 * abs(a)


def test_tables_follow_their_conditional():
    rng = np.random.default_rng(1)
    for count, mass, d in ((2, 0.5, 0.8), (7, 3.0, 0.5), (60, 0.2, 0.8)):
        drawn = lm.draw_tables(np.full(20_000, count), np.full(20_000, mass), d, rng)
        weights = np.exp(lm.stirling(d)[count, 1 : count + 1] + np.log(mass) * np.arange(1, count + 1))
        assert abs(drawn.mean() - (weights * np.arange(1, count + 1)).sum() / weights.sum()) < 0.1
    many = lm.draw_tables(np.array([100_000] * 50), np.full(50, 1e-3), 0.8, rng)
    assert (many >= 1).all() and (many < 1000).all()
    # a generalised Stirling number: 3 customers at 2 tables, (1 - d) * 3
    assert math.isclose(math.exp(lm.stirling(0.8)[3, 2]), 3 * 0.2)


def test_packed_arrays_come_back():
    a, b = np.array([3, 2**60, 0], np.uint64), np.zeros(0, np.int32)
    assert [x.tolist() for x in lm.unpacked(lm.packed(a, b))] == [a.tolist(), []]


@pytest.mark.parametrize("held", [False, True])
def test_edges(spark, held):
    rows = [(1, held, None), (2, held, ""), (3, held, " \n\t "), (4, held, "Same same SAME"), (4, held, "Same same SAME"), (None, held, "é\x00b x" * 500), (5, True, "unseen words")]
    df = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string").withColumn("chunk", F.lit(1)).withColumn("data", F.lit("x"))
    got = sorted((tuple(r) for r in lm.score_documents(df).collect()), key=lambda r: (r[0] or 0, r[2]))
    want = sorted(base(rows), key=lambda r: (r[0] or 0, r[2]))
    assert len(got) == 7 and all(near(g, w) for g, w in zip(got, want, strict=True))
    assert all(math.isfinite(g[6]) for g in got)
    assert lm.score_documents(df.limit(0)).count() == 0


def test_a_long_text_leaves_a_small_table_of_powers(monkeypatch):
    one = np.ones(1, np.uint64)
    monkeypatch.setattr(common, "_powers", [one, one])
    words = ["Ab", "c" * 300_000, "é", "d" * 2_000] * 5 + [f"w{i}" for i in range(400_000)]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    found = common.hash_words(raw, np.array([0, len(raw)]), common.SPACED_TABLE)[0]
    assert len(raw) > 1 << 22 and len(common._powers[0]) <= 1 << 19
    for w, h in [*zip(words[:40], found[:40], strict=True), (words[-1], found[-1])]:
        alone = np.frombuffer(w.encode(), np.uint8)
        assert common.hash_words(alone, np.array([0, len(alone)]), common.SPACED_TABLE)[0].tolist() == [h]
