"""Operators on small inputs with known answers."""

import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.functions import vectors as V
from evidentia.operators import evidence as E
from evidentia.operators import metrics as M
from evidentia.operators import windows as W
from evidentia.plans import pipeline as P
from evidentia.sources import readers as R
from evidentia.streaming import streams as S


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(("scores", "want"), [([0.95, 0.65, 0.95], 0.85), ([0.1, 0.9], 0.3), ([], 0.0), ([None], 0.0)])
def test_penalty_mean(spark, scores, want):
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    assert df.agg(E.penalty_mean(F.col("s")).alias("x")).first().x == want


@pytest.mark.parametrize(("kinds", "want"), [(["Retracted Publication"], 0.4), (["Journal Article", "Retracted Publication"], 0.5), (["Clinical Trial Protocol"], 0.7), (["Clinical Trial, Phase I"], 0.7), (["Clinical Trial, Phase III"], 0.78), (["  randomised  Controlled Trial"], 0.8), ([], 0.4)])
def test_publication_weight(spark, kinds, want):
    df = spark.createDataFrame([(kinds,)], "k array<string>")
    assert df.select(E.publication_weight(F.col("k")).alias("x")).first().x == want


def test_replies(spark):
    v = T.verdict_of_reply(F.col("r"))
    assert tuple(one(spark, v, r="VERDICT: True\nFINALSCORE: 0.8")) == ("true", 0.8)
    assert tuple(one(spark, v, r="VERDICT: true FINALSCORE: .5")) == ("uncertain", 0.0)
    assert tuple(one(spark, v, r="VERDICT: false FINALSCORE: 1.95")) == ("false", 1.95)
    c = T.claims_of_reply(F.col("r"), F.col("t"))
    assert one(spark, c, r='```json\n["a", "b",]\n```', t="") == ["a", "b"]
    assert one(spark, c, r="no json", t="One. Two! Three? Four.") == ["One", "Two", "Three"]


def test_queries_and_stances(spark):
    q = T.clean_query(F.col("q"))
    assert one(spark, q, q='(aspirin[MeSH] and "heart attack"[tiab])') == "(aspirin[mh] AND heart attack[tiab])"
    assert one(spark, q, q="a[title]") is None and one(spark, q, q="(a[mh]") is None
    assert [one(spark, T.stance_label(F.lit(0.2), F.lit(0.1), t)) for t in (0.3, 0.0)] == ["Neutral", "Supports"]
    assert [one(spark, T.score_percent(F.lit(x))) for x in ("0.85", "85", "101", "")] == [85, 85, None, None]
    assert one(spark, T.cut_long(F.lit("abcdef"), 4)) == "abcd... [truncated 2 chars]" and one(spark, T.sanitized_name(F.lit(" a b/c "))) == "a_bc" and one(spark, T.truthy(F.lit(" Yes ")))
    assert one(spark, T.first_text(F.lit(""), F.lit(None), F.lit(" x "))) == "x" and one(spark, T.verdict_label(F.lit(" False"))) == 2


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, V.norm(a)) == 5 and one(spark, V.normalised(a)) == [0.6, 0.8] and math.isclose(one(spark, V.cosine(a, a)), 1)
    assert math.isclose(sum(one(spark, V.softmax(a))), 1) and one(spark, V.sigmoid(F.lit(0.0))) == 0.5


def test_provenance(spark):
    df = spark.createDataFrame([(1, 0, 0, "A", "q1"), (1, 0, 1, "B", "q1"), (1, 1, 0, "B", "q2"), (1, 1, 1, "C", "q2"), (1, 2, 0, "B", "Q2")], "stmt_id int, query_ord int, rank int, pubmed_id string, query string")
    assert [(r.pubmed_id, r.queries) for r in E.merge_found(df).orderBy("ord").collect()] == [("A", []), ("B", ["q2"]), ("C", [])]
    e = spark.createDataFrame([(1, 0, None, 0.5, "9", "", "u", "t"), (1, 1, 0.9, 0.7, " 9", None, None, None), (1, 2, 0.2, 0.1, None, None, None, "T ")], "stmt_id int, ord int, relevance double, weight double, pubmed_id string, doi string, url string, title string")
    assert [r.ord for r in E.dedup_evidence(e).orderBy("ord").collect()] == [1, 2] and E.min_relevance(e).count() == 1 and E.min_relevance(e, None).count() == 3
    assert [r.chosen for r in E.top_by_relevance(e, 1).orderBy("ord").collect()] == [False, True, False]


@pytest.fixture
def dealt(spark):
    """Runs f with n partitions of a shuffle, none of them joined, as on a cluster rows of equal order come in any order."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}

    def run(n, f):
        for k, v in zip(kept, (str(n), "false")):
            spark.conf.set(k, v)
        return f()

    yield run
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_evidence_of_one_place_goes_by_id_however_it_is_dealt(spark, dealt):
    """Found again by place in one run of the merge, and told by the places of another."""
    ids = [f"{i:02d}" for i in range(40)]
    finds = spark.createDataFrame([(1, 0, 0, i, "q") for i in ids], "stmt_id int, query_ord int, rank int, pubmed_id string, query string")
    more = spark.createDataFrame([(1, 1, 0, i, f"q{i}") for i in ids], finds.schema)
    merged = lambda n: spark.createDataFrame(dealt(n, lambda: E.merge_found(finds).collect()), "stmt_id int, pubmed_id string, ord int, queries array<string>")
    one, other = merged(3), merged(7)
    assert [r.pubmed_id for r in one.orderBy("ord").collect()] == [r.pubmed_id for r in other.orderBy("ord").collect()] == ids
    again = E.found_again(one, more).join(other.select("stmt_id", "ord", "pubmed_id"), ["stmt_id", "ord"])
    assert {r.pubmed_id: r.queries for r in again.collect()} == {i: [f"q{i}"] for i in ids}


@pytest.mark.parametrize(("n", "want"), [(0, 0), (512, 1), (513, 2), (960, 2), (961, 3)])
def test_token_windows(spark, n, want):
    df = spark.createDataFrame([([str(i) for i in range(n)],)], "t array<string>")
    got = df.select(W.token_windows(F.col("t")).alias("x")).first().x
    assert len(got) == want and (not n or got[-1][-1] == str(n - 1))


def test_allocation_split_and_log_order(spark):
    assert W.largest_remainder(5, [0.7, 0.3]) == [3, 2]
    rows = spark.createDataFrame([(i, i % 3) for i in range(90)], "id int, label int")
    got = {(r.label, r.split): r["count"] for r in W.stratified_split(rows, "label", "id", 0.7).groupBy("label", "split").count().collect()}
    assert got == {(k, s): n for k in range(3) for s, n in (("train", 21), ("test", 9))}
    log = spark.createDataFrame([(1, 1, 1, False), (1, 2, 1, False), (1, 3, 0, True), (1, 4, 0, False)], "run_id int, seq int, indent int, is_module boolean")
    assert [r.seq for r in W.log_order(log).orderBy("place").collect()] == [3, 1, 2, 4]


def test_metrics_equal_plain_loops(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 2), rng.choice([0, 1, 1, None])) for _ in range(200)]
    df = spark.createDataFrame(pairs, "t int, p int")
    scored = [(t, p) for t, p in pairs if p is not None]
    f = []
    for c in (0, 1, 2):
        hit, said, truth = sum(t == p == c for t, p in scored), sum(p == c for _, p in scored), sum(t == c for t, _ in scored)
        a, b = hit / said if said else 0, hit / truth if truth else 0
        f.append(2 * a * b / (a + b) if a + b else 0)
    assert math.isclose(M.macro(df).first().f1, sum(f) / 3)
    assert M.macro(df.limit(0), [0, 1, 2]).first().f1 is None
    log = spark.createDataFrame([(1, "a", 5, False, {"x": 1}, {"x": 4, "y": 1}), (1, "b", None, False, {"x": 4}, {"x": 2}), (1, "m", 9, True, {}, {"x": 9})], "run_id int, step string, tokens int, is_module boolean, before map<string,int>, after map<string,int>")
    assert tuple(M.log_sums(log).first()) == (1, 5, 4, 2)


def test_readers(spark, tmp_path):
    want = [(1, "a", 0), (7, "b", 2)]
    for text in ('[{"statement": "a", "label": 0}, {"id": 7, "text": "b", "label": 2}]', 'a\t0\n\n{"id": 7, "text": "b", "label": 2}\n'):
        assert R.items_of_text(text) == want
    with pytest.raises(ValueError):
        R.items_of_text("1\t2")
    (tmp_path / "x.txt").write_text("0\ta\nb\t2")
    assert sorted(map(tuple, R.read_items(spark, str(tmp_path / "x.txt")).collect())) == [(1, "a", 0), (2, "b", 2)]
    for text in ('{"data": [{"id": 1, "statement": "s"}]}', '{"id": 1, "statement": "s"}\n{"id": 2, "statement": "t"}', "[{'id': 1, 'statement': 's'}]"):
        assert R.records_of_text(text)[0]["statement"] == "s"
    assert one(spark, R.found_ids(F.lit(json.dumps({"esearchresult": {"idlist": ["1", "2"]}})))) == ["1", "2"] and one(spark, R.found_ids(F.lit("x"))) == []
    xml = "<PubmedArticle><MedlineCitation><PMID>5</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label='AIM'>a</AbstractText><AbstractText NlmCategory='B'>b</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"
    assert tuple(one(spark, R.article(F.lit(xml)))) == ("5", "T", "AIM: a B: b")
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert sorted(map(tuple, R.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c")]


def test_pipeline(spark):
    evidence = spark.createDataFrame([(1, "PubMed", ["Review"], 0.15, "alpha beta", "x"), (1, "RAG", [], 1.0, "none", None)], "stmt_id int, source_type string, pub_type array<string>, weight double, title string, abstract string")
    config = {"name": "c", "steps": [{"type": "mock_statements"}, {"type": "module", "settings": {"name": "all", "steps": [{"type": "weight_evidence"}, {"type": "rerank", "settings": {"min_relevance": 0.5}}]}}]}
    state = P.run(P.set_statement(config, "Alpha beta"), P.State({"evidence": evidence}))
    assert [(r.weight, r.relevance) for r in state.tables["evidence"].collect()] == [(0.55, 1.0)]
    assert [(x["step"], x["indent"]) for x in state.log] == [("mock_statements", 0), ("weight_evidence", 1), ("rerank", 1), ("all", 0)]
    with pytest.raises(ValueError):
        P.run({"steps": [{"type": "nothing"}]}, state)


def test_streams(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.write.parquet(str(tmp_path / "in"))
    for name, f in (("debounced", S.debounced), ("first_of", lambda df: S.first_of(df, "user_id"))):
        df = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
        q = f(df).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        time.sleep(0.1)
    assert spark.table("debounced").count() > 900
    assert spark.table("first_of").count() >= source.select("user_id").distinct().count()
