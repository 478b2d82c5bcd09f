"""Steps, evaluation, index, sinks and services on small inputs with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from evidentia.functions import display as D
from evidentia.functions import text as T
from evidentia.operators import evidence as E
from evidentia.operators import metrics as M
from evidentia.operators import windows as W
from evidentia.plans import evaluation as V
from evidentia.plans import pipeline as P
from evidentia.sources import index as I
from evidentia.sources import readers as R
from evidentia.sources import services as S
from evidentia.sources import sinks as K
from evidentia.streaming import streams as X


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


L = F.lit


@pytest.fixture(scope="module", autouse=True)
def nulls(spark):
    """Columns are made in a session."""
    global NONE, NUM
    NONE, NUM = F.lit(None).cast("string"), F.lit(None).cast("double")


def test_texts(spark):
    clean = [T.clean_query(L(q)) for q in ("`\"aspirin[MH]\"`", "a[mh:noexp]", "a[TIAB]", "a `b` c", "x or y and not z", "")]
    assert values(spark, *clean) == ["aspirin[mh]", None, None, "a `b` c", "x OR y AND not z", ""]
    assert values(spark, *[T.sanitized_name(c) for c in (L("a b/c"), L(" "), NONE, L("x  y.z-1_"))]) == ["a_bc", "Unnamed_Pipeline", "Unnamed_Pipeline", "x_y.z-1_"]
    assert values(spark, T.cut_long(L("abcdef"), 4), T.cut_long(L("abcd"), 4), T.clean_text(NONE, 5), T.clean_text(L(" one  two three"), 8), T.clean_text(L("abcdefgh"), 3)) == ["abcd... [truncated 2 chars]", "abcd", "", "one two...", "abc..."]
    assert values(spark, *[T.truthy(L(x)) for x in ("y", " YES", "on", "2", "no")]) == [True, True, True, False, False]
    line = lambda *a, **k: T.source_line(*a, **k)
    assert values(
        spark, line(L("PubMed"), L(0.5), NUM, NONE, NUM, NUM, NUM, L(" x\ny ")), line(L("Epistemonikos"), NUM, L(0.25), L("Refutes"), L(0.1), L(0.7), L(0.2), L("")),
        line(L("other"), NUM, NUM, NONE, NUM, L(0.5), NUM, L(""), missing=None), line(L("RAG"), NUM, NUM, NONE, NUM, NUM, NUM, None), T.chunk_line(L(0.5), L(1.0), NONE), T.chunk_line(NUM, NUM, None),
    ) == ["- PMID | w 0.50 | text: x y", "- EPIST | rel 0.25 | stance abs Refutes (S0.10 R0.70 N0.20) | text: [no content]", "- SOURCE | stance abs NA (R0.50)", "- RAG", "- RAG | score 0.50 | w 1.00 | abstract: [no abstract]", "- RAG"]
    assert values(spark, T.filled("{{x}} {a}-{b}", a=L("1"), b=NONE), T.passage(L(" T "), NONE), T.passage(NONE, L(" b ")), T.passage(L(""), L("")), T.article_url(L("5"))) == ["{x} 1-", "T\n\nNone", "b", None, "https://pubmed.ncbi.nlm.nih.gov/5/"]
    with pytest.raises(KeyError):
        T.filled("{a}", b=L("x"))
    assert values(spark, *[T.article_id(L(x)) for x in ("12", "https://pubmed.ncbi.nlm.nih.gov/34/", "https://x.org/5", "")]) == ["12", "34", None, None]
    assert values(spark, *[T.short_code(L(u)) for u in ("https://h/reels/AB/?x=1", "https://h/u/p/CD", "/reel/EF/", "https://h/reel/", "https://h/p/1/reel/2")]) == ["AB", "CD", "EF", None, "2"]
    assert values(spark, T.short_code(L("https://h/reel/a/reels/b"), ("reels", "reel"))) == ["b"]
    assert values(spark, *[T.statement_of_answer(L(a), L("Is it so??")) for a in ("A: It is.", 'Answer : "It is."', "  ", "'x'")]) == ["It is.", "It is.", "Is it so", "x"]
    assert values(spark, T.endpoint(L("http://h:1/v1/")), T.endpoint(L("http://h")), T.context_limit(L("num_ctx = 4096")), T.context_limit(L("x")), T.trimmed_lines(L(" a  \nb \t\n"))) == ["http://h:1/api/tags", "http://h/api/tags", 4096, None, "a\nb"]
    assert values(spark, T.listed(L("x")), T.listed(NONE), T.holds(F.array(L("Ab")), L("aB")), T.page_numbers(L("[1, 2]")), T.page_numbers(L("x"))) == [["x"], None, True, [1, 2], []]
    at = F.to_timestamp(L("2024-05-06 07:08:09.123456"))
    assert values(spark, T.utc_text(at), T.run_id(L("a b"), L(3), L(9), at), T.normalised_verdict(L(" True ")), T.normalised_verdict(L(""))) == ["2024-05-06T07:08:09Z", "a_b_3_9_20240506_070809_123456", "true", None]
    assert values(spark, T.reason_of_reply(L("VERDICT: true FINALSCORE: 1")), T.reason_of_reply(L("x"))) == ["VERDICT: true FINALSCORE: 1", "Unparsable output:\nx"]


def test_weights_of_every_rule_and_near_misses(spark):
    from evidentia.queries import EXPECTED

    assert len(E.WEIGHTS) == 37
    rows = spark.createDataFrame([(k, w) for k, w in EXPECTED], "kind string, want double")
    assert [(r.kind, r.got) for r in rows.select("*", E.publication_weight(F.array("kind")).alias("got")).collect()] == list(EXPECTED)


def test_display(spark):
    assert values(spark, D.title(L(""), NONE, L("7"), NONE), D.title(NONE, NONE, NONE, NONE), D.link(L(""), L("5"), NONE), D.link(NONE, NONE, NONE)) == ["Epistemonikos 7", "Untitled source", "https://pubmed.ncbi.nlm.nih.gov/5/", None]
    assert values(spark, D.score_text(NONE), D.score_text(L("x")), D.score_text(L("0.5")), D.kinds_text(F.array(L(" a "), L(""), L("b"))), D.kinds_text(F.array(L(" ")))) == ["N/A", "x", "0.50", "a, b", "Unknown"]
    assert values(spark, D.stance_text(L("Neutral"), L(1.0), NUM, NUM), D.stance_text(NONE, L(0.4), L(0.4), L(0.2)), D.stance_text(NONE, NUM, NUM, L(0.1)), D.stance_text(L(""), NUM, NUM, NUM), D.stance_class(L("Supported"))) == ["Neutral", "Supports", "Neutral", "Unknown", "stance-supports"]
    assert values(spark, D.needle(L(50)), D.pair_key(L(0), L(2)), D.pair_key(NONE.cast("int"), L(0)), D.may_analyse(L(None).cast("boolean")), D.may_analyse(L(False)), D.visible_area(L(-5.0), L(0.0), L(5.0), L(20.0), L(100.0), L(10.0))) == [0.0, "0:2", "s:e", True, False, 50.0]
    html = '<html><title> Own </title><meta content="Des" name="description"><META property="og:title" content=\'Ti\'></html>'
    assert values(spark, D.page_text(L(html)), D.page_text(L(html), 5), D.meta_content(L(html), "og:description"), D.is_reel(L("https://h/x/reel/1")), D.is_reel(L("https://h/x?u=/reel/"))) == ["Ti Des Own", "Ti De", "", True, False]
    assert values(spark, *D.log_row(L("ab"), L(1), L(True), L(0), L(0.5)), *D.log_row(L("ab"), L(0), L(False), L(0), L(1)), D.abstract_text(L(""), L(" t "), NONE, NONE)) == ["   >> AB", "0.5000s", "", "ab", "1.0000s", "-", "t"]
    rows = spark.createDataFrame([(0, "0.5"), (1, "60"), (2, None), (3, "x"), (4, "50")], "ord int, relevance string").withColumn("stmt_id", L(1))
    assert [r.ord for r in D.by_relevance(rows, "stmt_id").orderBy("place").collect()] == [1, 0, 4, 2, 3]
    assert [r.ord for r in D.by_relevance(rows, "stmt_id", rescale=False).orderBy("place").collect()] == [1, 4, 0, 2, 3]


def test_sentences_are_trimmed(spark):
    assert values(spark, T.sentences(L("0 one 0. 1 two 1.  . end")))[0] == ["0 one 0", "1 two 1", "end"]


def test_logs(spark):
    log = spark.createDataFrame([(1, 1, 2, False), (1, 2, 1, True), (1, 3, 1, False), (1, 4, 0, True), (1, 5, 0, False), (1, 6, 1, False)], "run_id int, seq int, indent int, is_module boolean")
    assert [r.seq for r in W.log_order(log).orderBy("place").collect()] == [4, 2, 1, 3, 5]
    rows = [(1, 1, "a", 5, False, {"RAG": 1}, {"RAG": 4, "x": 1}), (1, 2, "b", None, False, {"RAG": 4, "x": 1}, {"RAG": 2, "x": 1}), (1, 3, "m", 9, True, {}, {"x": 9}), (2, 1, "a", 1, False, None, None)]
    log = spark.createDataFrame(rows, "run_id int, seq int, step string, tokens int, is_module boolean, before map<string,int>, after map<string,int>")
    got = {r.run_id: tuple(r)[1:] for r in M.evidence_changes(log).collect()}
    assert got == {1: (4, 2, {"RAG": 3, "x": 1}, {"RAG": 2}), 2: (None, None, None, None)}
    tokens = {r.run_id: (r.total, [(s.step, s.tokens) for s in r.by_step]) for r in M.tokens_by_step(log).collect()}
    assert tokens == {1: (5, [("a", 5), ("b", 0)]), 2: (1, [("a", 1)])}
    m = F.create_map(L("RAG"), L(3), L("x"), L(1), L("y"), L(2))
    assert values(spark, *E.papers_and_chunks(m), *E.papers_and_chunks(L(None).cast("map<string,int>"))) == [3, 3, None, None]
    few = spark.createDataFrame([(0, 1), (1, 0)], "t int, p int")
    assert tuple(M.macro(few, [0, 1, 2]).first()) == (0.0, 0.0, 0.0)


def test_windows(spark):
    pages = spark.createDataFrame([("d", 2, ["c", "d", "e"]), ("d", 1, ["a", "b"]), ("e", 1, []), ("f", 1, [" "])], "doc_id string, page int, tokens array<string>")
    got = [tuple(r) for r in W.window_rows(pages, 3, 1).orderBy("chunk_id").collect()]
    assert got == [("d", "d:000000", [1, 2], ["a", "b", "c"]), ("d", "d:000001", [2], ["c", "d", "e"])]
    rows = spark.createDataFrame([(i, "one") for i in range(1000)], "id int, label string")
    split = W.stratified_split(rows, "label", "id", 0.317)
    assert split.columns == ["id", "label", "split"] and split.where("split = 'train'").count() == 317
    claims = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "claim_id int, claim_vec array<double>")
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (5, [0.5, 0.5]), (3, [0.5, 0.1]), (4, [0.9]), (6, None), (7, [0.2, 0.0])], "chunk_id int, chunk_vec array<double>")
    assert [(r.chunk_id, r.rank) for r in E.top_similar(claims, chunks, 2).orderBy("rank").collect()] == [(3, 1), (5, 2)]
    assert E.top_similar(claims, chunks, 0).count() == 2 and E.top_similar(claims.limit(0), chunks).count() == 0


def test_whole_run(spark):
    """From transcript to score, models given as functions; every step's own rule is stated there."""
    articles = spark.createDataFrame([("1", "Aspirin", "aspirin lowers fever quickly"), ("2", "Stones", None)], "pubmed_id string, title string, abstract string")
    kinds = spark.createDataFrame([("1", ["Meta Analysis"]), ("2", ["News"])], "pubmed_id string, pub_type array<string>")
    body = json.dumps({"esearchresult": {"idlist": ["1", "2", "3"]}})
    replies = spark.createDataFrame([("aspirin[mh]", body)], "query string, body string")
    documents = spark.createDataFrame([("d", "g.pdf", 2)], "doc_id string, source_path string, dim int")
    chunks = spark.createDataFrame([("d:0", "d", "[3]", "aspirin guideline", [1.0, 0.0]), ("d:1", "d", "x", "other", [0.0, 1.0])], "chunk_id string, doc_id string, pages_json string, text string, embedding array<double>")
    embed = lambda c: F.when(c.contains("Aspirin"), F.array(L(0.8), L(0.1))).otherwise(F.array(L(0.1), L(0.1)))
    seen = []
    config = {
        "name": "whole", "steps": [
            {"type": "mock_transcript", "settings": {"transcript_text": "Aspirin lowers fever. Stones sing!"}}, {"type": "extraction"},
            {"type": "module", "settings": {"name": "search", "debug": True, "steps": [
                {"type": "generate_query", "settings": {"reply": lambda p: F.when(p.contains("Aspirin"), '"aspirin[MeSH]"')}}, {"type": "generate_query"},
                {"type": "fetch_links", "settings": {"replies": replies, "retmax": 2}}, {"type": "abstract_evidence", "settings": {"articles": articles, "pub_types": kinds}},
            ]}},
            {"type": "weight_evidence"}, {"type": "retrieve_guideline_facts", "settings": {"documents": documents, "chunks": chunks, "embed": embed, "top_k": 1}},
            {"type": "rerank_evidence", "settings": {"min_relevance": 0.3}}, {"type": "stance_evidence", "settings": {"top_m": 1, "threshold": 0.3}}, {"type": "filter_evidence"},
            {"type": "truthness", "settings": {"reply": lambda p: F.when(p.contains("w 0.90"), "VERDICT: true FINALSCORE: 0.8").otherwise(L("?"))}}, {"type": "scoring"},
        ],
    }
    state = P.run(config, P.State(session=spark), counts=True, observer=lambda kind, x: seen.append((kind, x["step"])))
    queries = sorted((r.stmt_id, r.ord, r.query, r.origin) for r in state.tables["queries"].collect())
    assert queries == [(1, 0, "aspirin[mh]", "llm"), (1, 1, "Aspirin lowers fever", "fallback"), (2, 0, "Stones sing", "fallback")]
    evidence = {(r.stmt_id, r.pubmed_id or r.chunk_id): r for r in state.tables["evidence"].collect()}
    assert set(evidence) == {(1, "1"), (1, "d:0")} and evidence[1, "1"].weight == 0.9 and evidence[1, "1"].relevance == 1.0 and evidence[1, "1"].stance == "Supports"
    assert evidence[1, "d:0"].weight == 1.0 and evidence[1, "d:0"].score == 0.8 and evidence[1, "d:0"].pages == [3] and evidence[1, "d:0"].stance is None
    verdicts = {r.stmt_id: (r.verdict, r.score) for r in state.tables["statements"].collect()}
    assert verdicts == {1: ("true", 0.8), 2: ("uncertain", 0.0)} and state.tables["scores"].first().overall == 0.2
    log = {x["step"]: (x["evidence_total_before"], x["evidence_total_after"], x["indent"]) for x in state.log}
    assert log["fetch_links"] == (0, 2, 1) and log["search"] == (0, 2, 0) and log["rerank_evidence"][1] == 2 and ("start", "search") in seen
    assert P.log_table(state).count() == len(state.log) and P.summary(state)["steps"] == 14
    block = P.steps.evidence_block(state).where("stmt_id = 1").first().block
    assert block.startswith("PUBMED EVIDENCE:\n- PMID | w 0.90 | rel 1.00 | stance abs Supports (S1.00 R0.00 N0.00) | text: aspirin") and "No Epistemonikos evidence provided." in block
    texts = K.snapshot(state.tables["runs"], state.tables["statements"], state.tables["evidence"]).first().state
    assert json.loads(texts)["statements"][0]["evidence"][0]["pubmed_id"] == "1"
    assert "[1] Aspirin lowers fever | TRUE | 0.80\n  - Aspirin (w 0.90, rel 1.00)" in [r.block for r in K.report(state.tables["statements"], state.tables["evidence"]).orderBy("stmt_id").collect()][0]
    with pytest.raises(NotImplementedError):
        P.run({"steps": [{"type": "audio_to_transcript"}]}, P.State(session=spark))


def test_configs(spark):
    config = {"name": "c", "llm_settings": {"a": 1}, "steps": [{"type": "mock_statements", "settings": {"statements": [{"text": "old"}]}}, {"type": "truthness", "settings": {"model": "m", "x": [{"model_name": "n"}]}}]}
    assert P.set_statement(config, "new")["steps"][0]["settings"]["statements"] == [{"id": 1, "text": "new"}] and config["steps"][0]["settings"]["statements"] == [{"text": "old"}]
    assert len(P.set_statement(config, "new")["steps"]) == 2 and P.with_settings(config, b=2)["llm_settings"] == {"a": 1, "b": 2} and P.model_names(config) == ({"m"}, {"n"})
    with pytest.raises(ValueError):
        P.set_statement({"steps": []}, "x")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert [r.name for r in P.missing_models(names("a", "b", "c"), names("a", "b:latest", "c:7b")).collect()] == ["c"]
    module = type("m", (), {"B": config, "A": {"name": "a", "steps": []}, "no": {"type": "module", "name": "x", "steps": []}, "n": 3})
    assert [c["name"] for c in P.configs_of(module)] == ["a", "c"]


def test_evaluation(spark):
    items = spark.createDataFrame([(1, "up", 0), (2, "down", 2), (3, "odd", 1), (4, "done", 0)], "id long, statement string, label int")
    say = lambda p: F.when(p.contains("up"), "VERDICT: true FINALSCORE: 0.9").when(p.contains("down"), "VERDICT: true FINALSCORE: 0.7")
    configs = [{"name": n, "steps": [{"type": "mock_statements"}, {"type": "truthness", "settings": {"reply": say} if n == "a" else {}}]} for n in ("a", "b")]
    done = spark.createDataFrame([("a", 4)], "config string, id long")
    records = V.evaluate_all(spark, configs, items, done)
    got = {(r.config, r.id): (r.predicted_label, r.error is None) for r in records.collect()}
    assert got == {("a", 1): (0, True), ("a", 2): (0, True), ("a", 3): (None, False), **{("b", i): (1, True) for i in (1, 2, 3, 4)}}
    s = {r.config: r for r in V.summaries(records).collect()}
    assert (s["a"].n_scored, s["a"].n_skipped, s["a"].accuracy, s["a"].per_class_recall, s["a"].confusion) == (2, 1, 0.5, {0: 1.0, 2: 0.0}, {"0:0": 1, "2:0": 1})
    assert s["b"].accuracy == 0.25 and abs(s["b"].f1_score - 0.4 / 3) < 1e-12
    train = spark.createDataFrame([(i, "good fine nice" if i % 2 else "bad sad", i % 2) for i in range(40)] + [(99, None, 7)], "id long, text string, label int")
    assert V.text_baseline(train, train.where("label < 2")).where("label <> prediction").count() == 0


def test_index(spark):
    files = spark.createDataFrame([("a.pdf", "h1"), ("b.pdf", "h2")], "path string, file_hash string")
    docs = I.new_documents(files, "m", 2)
    one = docs.where("source_path = 'a.pdf'")
    parts = lambda d, text: d.select(F.concat("doc_id", L(":000000")).alias("chunk_id"), "doc_id", L("[1]").alias("pages_json"), L(text).alias("text"), F.array(L(1.0), L(0.0)).alias("embedding"))
    for force, text in ((False, "old"), (True, "new")):
        d, c = I.upsert_index((one, parts(one, "old")), (docs, parts(docs, "new")), force)
        assert d.count() == 2 and {r.source_path: r.text for r in I.index_rows(d, c).collect()} == {"a.pdf": text, "b.pdf": "new"}
    assert I.to_index(docs, one).count() == 1 and I.index_model(docs) == ("m", 2) and I.index_rows(docs, parts(docs, "x")).first().pages == [1]
    with pytest.raises(ValueError):
        I.index_model(docs.limit(0))
    with pytest.raises(Exception, match="another length"):
        I.index_rows(docs.withColumn("dim", L(3)), parts(docs, "x")).collect()


def test_sinks_and_readers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, v string, n string")
    K.write_json(rows, str(tmp_path / "json"))
    assert sorted(json.loads(line)["k"] for f in (tmp_path / "json").glob("*.json") for line in f.read_text().splitlines()) == [1, 2]
    for new in (rows, rows.where("k = 2").withColumn("v", L("c"))):
        at = K.upsert_table(spark, str(tmp_path / "t"), new, "k")
        K.append_log(new, str(tmp_path / "log"))
    assert sorted((r.k, r.v) for r in spark.read.parquet(at).collect()) == [(1, "a"), (2, "c")] and at.endswith("v1") and spark.read.parquet(str(tmp_path / "log")).count() == 3
    K.write_split(rows.withColumn("split", L("train")), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s" / "split=train")).count() == 2 and K.records(rows, "v", "k").columns == ["statement", "label"]
    (tmp_path / "list.json").write_text('[{"statement": "a", "label": 0}, {"id": 7, "text": "b", "label": 2}]')
    (tmp_path / "lines.txt").write_text('a\t0\n\n{"id": 7, "text": "b", "label": 2}\n')
    for name in ("list.json", "lines.txt"):
        assert sorted(map(tuple, R.read_items(spark, str(tmp_path / name)).collect())) == [(1, "a", 0), (7, "b", 2)]
    (tmp_path / "bad.txt").write_text("1\t2\n")
    with pytest.raises(Exception, match="which field"):
        R.read_items(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "x.csv").write_text('en_claim,de_claim,label\n"one, two",eins,0\n,zwei,1\n" ",drei,2\n')
    assert sorted((r.claim, r.label) for r in R.read_claims_csv(spark, str(tmp_path / "x.csv")).collect()) == [("nan", 1), ("one, two", 0)]
    with pytest.raises(ValueError):
        R.read_claims_csv(spark, str(tmp_path / "x.csv"), "fr")
    assert R.read_done(spark, str(tmp_path / "none"), "id long").count() == 0 and R.read_done(spark, at, "k int").count() == 2


def test_services(spark):
    requests = spark.createDataFrame([("t", {"b": "2", "a": "1"}), ("t", {"a": "1", "b": "2"}), ("t", {"a": "9"}), ("bad", {"a": "1"})], "tool string, params map<string,string>")
    keys = [r.key for r in S.keyed(requests).collect()]
    assert keys[0] == keys[1] != keys[2]
    cache = spark.createDataFrame([(keys[2], "old", 200, "j", 1.0), (keys[2], "newer", 200, "j", 2.0)], S.CACHE)

    def fetch(tool, params):
        if tool == "bad":
            raise OSError("down")
        return 200, "j", "fetched " + params["a"]

    answers, new = S.cached(requests, cache, fetch)
    assert sorted((r.content, r.status) for r in answers.collect()) == [("OSError: down", 502), ("fetched 1", 200), ("fetched 1", 200), ("newer", 200)]
    assert [r.content for r in new.collect()] == ["fetched 1"]


def test_one_request_at_a_time(spark, tmp_path):
    assert X.latest_wins([(0, "a"), (1, "b"), (2, "c"), (11, "d"), (40, "e")], 10) == ([(0, "a"), (10, "c"), (20, "d"), (40, "e")], None, 50)
    rows = [(1, t, k) for t, k in ((1000, "a"), (1001, "b"), (1002, "c"), (5000, "z"))] + [(2, 1003, "x")]
    df = spark.createDataFrame(rows, "user_id long, s long, key string").select("user_id", F.timestamp_seconds("s").alias("ts"), "key")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = X.one_at_a_time(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 10)
    q = stream.writeStream.format("memory").queryName("slots").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("slots").collect())) == [(1, 1000.0, "a"), (1, 1010.0, "c"), (1, 5000.0, "z"), (2, 1003.0, "x")]
