"""Models asked once, tokens in the log, runs that go on, evidence found again, stance settings."""

import json

import pytest
from pyspark.sql import functions as F

from evidentia.operators import metrics as M
from evidentia.plans import models as Q
from evidentia.plans import pipeline as P
from evidentia.plans.barrier import Barrier, calls

EVIDENCE = "run_id int, stmt_id int, ord int, source_type string, pubmed_id string, title string, abstract string, relevance double, relevance_abstract double, queries array<string>"


def asked(path):
    return sorted(line for f in path.glob("*") for line in f.read_text().splitlines())


def teller(path):
    """A model that notes each prompt in a file of its own and counts words as tokens."""

    def call(prompt, model, temperature, fail=False, **_):
        import uuid

        (path / uuid.uuid4().hex).write_text(prompt + "\n")
        if "broken" in prompt:
            raise OSError("no model")
        return " VERDICT: true FINALSCORE: 0.8 ", {"prompt": len(prompt.split()), "completion": 4, "total": len(prompt.split()) + 4}

    return call


def config(reply, more=()):
    claims = [{"id": 1, "text": "one claim"}, {"id": 2, "text": "two"}, {"id": 3, "text": "a broken one"}]
    steps = [
        {"type": "mock_statements", "settings": {"statements": claims}}, {"type": "generate_query", "settings": {"prompt_template": "query: {claim}", "reply": reply}},
        *more, {"type": "truthness", "settings": {"prompt_template": "judge: {claim_text}", "reply": reply}}, {"type": "scoring"},
    ]
    return {"name": "c", "steps": steps}


PROMPTS = sorted(f"{k}: {c}" for k in ("query", "judge") for c in ("one claim", "two", "a broken one"))


@pytest.mark.parametrize(("counts", "parts"), [(False, 1), (True, 3)])
def test_each_prompt_is_asked_once(spark, tmp_path, counts, parts):
    (tmp_path / "asked").mkdir()
    c = config(Q.counted_replies(teller(tmp_path / "asked"), "m"))
    events = []
    state = P.run(c, P.State(session=spark, barrier=Barrier("r", str(tmp_path / "runs"), parts)), counts=counts, observer=lambda kind, x: events.append((kind, x)))
    for _ in range(2):
        assert {r.stmt_id: (r.verdict, r.score) for r in state.tables["statements"].collect()} == {1: ("true", 0.8), 2: ("true", 0.8), 3: ("error", 0.0)}
        assert state.tables["queries"].count() == 3 and state.tables["scores"].count() == 1
    assert asked(tmp_path / "asked") == PROMPTS
    tokens = {r.step: r.tokens for r in P.log_table(state).collect()}
    assert tokens == {"mock_statements": 0, "generate_query": 3 + 2 + 2 * 4, "truthness": 3 + 2 + 2 * 4, "scoring": 0}
    assert M.tokens_by_step(P.log_table(state)).first().total == 26 == P.summary(state)["tokens"]
    made = calls(state).collect()
    assert len({r.call_id for r in made}) == 6 and sorted(r.prompt for r in made) == PROMPTS
    assert {r.error for r in made if "broken" in r.prompt} == {"OSError: no model"} and {r.total_tokens for r in made if r.prompt == "judge: two"} == {6}
    kinds = [k for k, _ in events]
    assert kinds[0] == "run_start" and kinds[-1] == "run_end" and kinds.count("artifact") == 2
    # the same run again, as after a stop: nothing is asked
    again = P.run(c, P.State(session=spark, barrier=Barrier("r", str(tmp_path / "runs"), parts)), counts=counts)
    assert again.tables["statements"].where("verdict = 'true'").count() == 2 and asked(tmp_path / "asked") == PROMPTS
    assert P.summary(again)["tokens"] == 26
    # other settings of the last step are asked anew, the step before is not
    c["steps"][-2]["settings"]["prompt_template"] = "again: {claim_text}"
    P.run(c, P.State(session=spark, barrier=Barrier("r", str(tmp_path / "runs"), parts)))
    assert asked(tmp_path / "asked") == sorted([*PROMPTS, "again: one claim", "again: two", "again: a broken one"])
    # another run asks everything
    P.run(c, P.State(session=spark, barrier=Barrier("other", str(tmp_path / "runs"))))
    assert len(asked(tmp_path / "asked")) == 15


def test_a_stopped_step_goes_on_by_parts(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    b = Barrier("r", str(tmp_path / "runs"), parts=4)
    reply = Q.counted_replies(teller(tmp_path / "asked"), "m")
    c = config(reply)
    P.run(c, P.State(session=spark, barrier=b))
    import shutil

    path = b.written[0]["path"]
    lost = next(p for p in range(4) if spark.read.parquet(f"{path}/part={p}").count())
    n = spark.read.parquet(f"{path}/part={lost}").count()
    shutil.rmtree(f"{path}/part={lost}")
    P.run(c, P.State(session=spark, barrier=Barrier("r", str(tmp_path / "runs"), parts=4)))
    assert len(asked(tmp_path / "asked")) == 6 + n


def test_evidence_found_again_takes_on_queries(spark):
    """As a list of articles by statement: a known id gains the query unless it has it whatever its case, a new one goes to the end."""
    reply = lambda ids: json.dumps({"esearchresult": {"idlist": ids}})
    bodies = spark.createDataFrame([("q1", reply(["a", "b"])), ("q2", reply(["b", "c"])), ("q3", reply(["c", "a", "d"])), ("Q2", reply(["b", "d"]))], "query string, body string")
    queries = lambda *qs: spark.createDataFrame([(1, s, n, q) for s in (1, 2) for n, q in enumerate(qs)], "run_id int, stmt_id int, ord int, query string")
    fetch = {"steps": [{"type": "fetch_links", "settings": {"replies": bodies}}]}
    state = P.run(fetch, P.State({"queries": queries("q1")}))
    state = P.run(fetch, state.with_table("queries", queries("q2")))
    state = P.run(fetch, state.with_table("queries", queries("q3", "Q2")))
    got = {s: [(r.ord, r.pubmed_id, r.queries) for r in state.tables["evidence"].where(F.col("stmt_id") == s).orderBy("ord").collect()] for s in (1, 2)}
    assert got[1] == got[2] == expected_finds([["q1"], ["q2"], ["q3", "Q2"]], {"q1": "ab", "q2": "bc", "q3": "cad", "Q2": "bd"})


def expected_finds(rounds, found):
    evidence = []
    for queries in rounds:
        for q in queries:
            for i in found[q]:
                known = next((e for e in evidence if e[0] == i), None)
                if known is None:
                    evidence.append((i, []))
                elif q.lower() not in {x.lower() for x in known[1]}:
                    known[1].append(q)
    return [(n, *e) for n, e in enumerate(evidence)]


def test_stance_takes_the_settings_of_configs(spark, tmp_path):
    rows = [(1, 1, n, "PubMed", str(n), None, f"text {n}", r, None, []) for n, r in enumerate((0.2, 0.9, None, 0.9, 0.5))]
    e = spark.createDataFrame(rows, EVIDENCE)
    claims = spark.createDataFrame([(1, 1, "text")], "run_id int, stmt_id int, text string")
    scorer = lambda c, p: F.struct(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.7)).alias("shares"), F.length(p).cast("long").alias("total_tokens"))
    run = lambda table, **s: P.run({"steps": [{"type": "stance_evidence", "settings": {"scorer": scorer, **s}}]}, P.State({"evidence": table, "statements": claims}, barrier=Barrier(folder=str(tmp_path))))
    state = run(e, top_m_by_relevance=2)
    assert {r.ord for r in state.tables["evidence"].where("stance = 'Refutes'").collect()} == {1, 3} and P.summary(state)["tokens"] == 12
    assert run(e, top_m_by_relevance=0).tables["evidence"].where("stance is not null").count() == 5
    bare = e.withColumns({"abstract": F.when(F.col("ord") == 0, F.col("abstract")), "text": F.lit("own text"), "title": F.when(F.col("ord") == 1, "T")})
    lengths = lambda **s: {x["tokens"] for x in run(bare, **s).log}
    assert lengths() == {len("text 0") + len("T\n\nNone") + 3 * len("own text")}
    assert lengths(evidence_fields=["abstract"]) == {len("text 0") + len("T\n\nNone")}
    assert lengths(evidence_fields=["text"]) == {len("T\n\nown text") + 4 * len("own text")}
    assert lengths(evidence_fields=["other"]) == lengths()


def test_rerank_leaves_blank_claims_alone(spark):
    e = spark.createDataFrame([(1, 1, 0, "PubMed", "1", None, "x y", 0.3, 0.4, []), (1, 2, 0, "PubMed", "2", None, "y", 0.1, 0.9, [])], EVIDENCE)
    claims = spark.createDataFrame([(1, 1, "  "), (1, 2, "y z")], "run_id int, stmt_id int, text string")
    state = P.run({"steps": [{"type": "rerank_evidence", "settings": {"min_relevance": None}}]}, P.State({"evidence": e, "statements": claims}))
    got = {r.stmt_id: (r.relevance, r.relevance_abstract) for r in state.tables["evidence"].collect()}
    assert got == {1: (0.3, 0.4), 2: (0.5, 0.5)}
