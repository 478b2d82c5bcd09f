"""The steps from transcript to verdict, over tables of many runs at once.

Models, search services and media readers are functions or tables in a step's settings.
Where one is left out a plain rule stands in, named in the step, which equals no model.
Tables: runs (run_id, transcript), statements (run_id, stmt_id, text, ...), queries
(run_id, stmt_id, ord, query, origin), evidence (see EVIDENCE).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.functions.vectors import round2
from evidentia.operators import evidence as E
from evidentia.plans.barrier import answered
from evidentia.plans.pipeline import State, lexical, scores, step
from evidentia.sources.index import index_rows
from evidentia.sources.readers import found_ids

KEYS = ["run_id", "stmt_id"]
EVIDENCE = {
    "run_id": "int", "stmt_id": "int", "ord": "int", "source_type": "string", "pubmed_id": "string", "epistemonikos_id": "string", "chunk_id": "string", "source_path": "string",
    "pages": "array<int>", "url": "string", "title": "string", "abstract": "string", "pub_type": "array<string>", "queries": "array<string>", "weight": "double", "score": "double",
    "relevance": "double", "relevance_abstract": "double", "stance": "string", "p_supports": "double", "p_refutes": "double", "p_neutral": "double",
}


def completed(df: DataFrame, columns: dict[str, str] = EVIDENCE) -> DataFrame:
    """df with every column of evidence, null where it has none."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns})


def evidence_of(state: State) -> DataFrame:
    if "evidence" in state.tables:
        return completed(state.tables["evidence"])
    return state.spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in EVIDENCE.items()))


def claims_of(state: State) -> DataFrame:
    return state.tables["statements"].select(*KEYS, F.col("text").alias("claim"))


def replied(state: State, rows: DataFrame, settings: dict, prompt: Column) -> DataFrame:
    """rows with answer, the model's reply to each prompt, asked once; null without a model."""
    if "reply" not in settings:
        return rows.withColumn("answer", F.lit(None).cast("string"))
    return answered(state, rows, settings["reply"], "text", prompt=prompt).drop("call_id", "prompt_tokens", "completion_tokens", "total_tokens", "error")


@step("extraction")
def extraction(state: State, settings: dict) -> State:
    """Claims of a transcript from a model's reply; without one, its first sentences."""
    template = settings.get("prompt_template", "{transcript}")
    runs = state.tables["runs"].where(F.trim(F.coalesce("transcript", F.lit(""))) != "")
    runs = replied(state, runs, settings, T.filled(template, transcript=F.col("transcript")))
    claims = runs.select("run_id", F.posexplode(T.claims_of_reply(F.col("answer"), F.col("transcript"))).alias("n", "text"))
    return state.with_table("statements", claims.select("run_id", (F.col("n") + 1).alias("stmt_id"), "text"))


@step("generate_query")
def generate_query(state: State, settings: dict) -> State:
    """One more query for each claim, unless it has it whatever its case: the reply made
    valid, else the claim's first words. Steps can follow each other, one for each strategy."""
    template = settings.get("prompt_template", "{claim}")
    rows = replied(state, claims_of(state), settings, T.filled(template, claim=F.col("claim")))
    rows = rows.withColumn("clean", T.clean_query(F.translate("answer", "\n", " ")))
    new = rows.select(*KEYS, F.coalesce("clean", T.fallback_query(F.col("claim"))).alias("query"), F.when(F.col("clean").isNull(), "fallback").otherwise("llm").alias("origin"))
    new = new.where((F.col("query") != "") | (F.col("origin") == "fallback"))
    old = state.tables.get("queries")
    if old is None:
        return state.with_table("queries", new.withColumn("ord", F.lit(0)))
    held = old.groupBy(*KEYS).agg(F.count("*").cast("int").alias("ord"), F.collect_set(F.lower("query")).alias("low"))
    added = new.join(held, KEYS, "left").where(~F.coalesce(F.array_contains("low", F.lower("query")), F.lit(False)))
    return state.with_table("queries", old.unionByName(added.select(*KEYS, "query", "origin", F.coalesce("ord", F.lit(0)).alias("ord"))))


@step("fetch_links")
def fetch_links(state: State, settings: dict) -> State:
    """Articles found by the queries: settings have a service (see sources.services.Service), replies, a
    table (query, body), or search, a function from the queries to one. At most retmax ids of a query count; a query
    without a reply finds nothing."""
    queries = state.tables["queries"]
    if "service" in settings:
        replies = settings["service"].search(queries, settings.get("retmax", 5), settings.get("sort", "relevance"))
    else:
        replies = settings["search"](queries) if "search" in settings else settings["replies"]
    ids = queries.join(replies.select("query", "body"), "query").select(*KEYS, F.col("ord").alias("query_ord"), "query", F.posexplode(found_ids(F.col("body"))).alias("rank", "pubmed_id"))
    ids = ids.where(F.col("rank") < settings.get("retmax", 5)).withColumn("stmt_id", F.struct(*KEYS))
    found = E.merge_found(ids)
    if "evidence" not in state.tables:
        new = found.select("stmt_id.*", "ord", "pubmed_id", "queries", *_article_columns())
        return state.with_table("evidence", completed(new))
    # evidence that is there already takes on the queries that found it; the rest comes after it
    old = evidence_of(state)
    again = E.found_again(old.withColumn("stmt_id", F.struct(*KEYS)).select("stmt_id", "ord", "pubmed_id", "queries"), ids)
    again = again.select("stmt_id.*", F.col("ord"), F.col("queries").alias("more"))
    old_rows = old.join(again, [*KEYS, "ord"], "left").withColumn("queries", F.coalesce("more", "queries")).drop("more").select(*old.columns)
    held = old.groupBy(*KEYS).agg((F.max("ord") + 1).alias("held"))
    new = found.select("stmt_id.*", "ord", "pubmed_id", "queries", *_article_columns()).join(old.select(*KEYS, "pubmed_id").where("pubmed_id is not null").distinct(), [*KEYS, "pubmed_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy("ord")) - 1
    new = new.withColumn("place", place).join(held, KEYS, "left").withColumn("ord", (F.coalesce("held", F.lit(0)) + F.col("place")).cast("int")).drop("place", "held")
    return state.with_table("evidence", old_rows.unionByName(completed(new).select(*old.columns)))


def _article_columns() -> list[Column]:
    return [T.article_url(F.col("pubmed_id")).alias("url"), F.lit("PubMed").alias("source_type"), F.lit(0.15).alias("weight")]


@step("abstract_evidence")
def abstract_evidence(state: State, settings: dict) -> State:
    """Title, abstract and types of articles by id, from a service, a request for each claim's ids,
    or from tables articles (pubmed_id, title, abstract) and pub_types (pubmed_id, pub_type);
    other sources and unknown ids stay as they are."""
    e = evidence_of(state)
    own = F.col("source_type") == "PubMed"
    e = e.withColumn("pubmed_id", F.when(own, F.coalesce(T.article_id(F.coalesce(F.nullif("url", F.lit("")), "pubmed_id")), "pubmed_id")).otherwise(F.col("pubmed_id")))
    if "service" in settings:
        ids = e.where(own).select(*KEYS, "ord", "pubmed_id")
        settings = {**settings, "articles": settings["service"].details(ids, *KEYS), "pub_types": settings["service"].types(ids, *KEYS)}
    for name, columns in (("articles", ("title", "abstract")), ("pub_types", ("pub_type",))):
        if name in settings:
            more = settings[name].dropDuplicates(["pubmed_id"]).select("pubmed_id", *[F.col(c).alias(f"new_{c}") for c in columns])
            e = E.attach_details(e, more)
            e = e.withColumns({c: F.when(own & F.col(f"new_{c}").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c)) for c in columns}).drop(*[f"new_{c}" for c in columns])
    return state.with_table("evidence", e)


@step("retrieve_guideline_facts")
def retrieve(state: State, settings: dict) -> State:
    """The passages of an index nearest to each claim, after the evidence that it has. settings
    have documents and chunks, and embed, a function from a text column to vectors."""
    rows = index_rows(settings["documents"], settings["chunks"])
    asked = answered(state, claims_of(state).where(F.trim("claim") != ""), settings["embed"], "vector", claim=F.col("claim"))
    claims = asked.select(F.concat_ws(":", *KEYS).alias("claim_id"), F.col("answer").alias("claim_vec"))
    top = E.top_similar(claims, rows.select("chunk_id", F.col("embedding").alias("chunk_vec")), settings.get("top_k", 5), settings.get("min_score", 0.25))
    at = F.split("claim_id", ":")
    old = evidence_of(state)
    held = old.groupBy(*KEYS).agg((F.max("ord") + 1).alias("held"))
    new = (
        top.join(rows.select("chunk_id", "source_path", "pages", F.col("text").alias("abstract")), "chunk_id").withColumns({"run_id": at[0].cast("int"), "stmt_id": at[1].cast("int")})
        .join(held, KEYS, "left").withColumns({
            "ord": (F.coalesce("held", F.lit(0)) + F.col("rank") - 1).cast("int"), "source_type": F.lit("RAG"), "weight": F.lit(1.0), "relevance": F.col("score"), "relevance_abstract": F.col("score"),
        })
    )
    return state.with_table("evidence", old.unionByName(completed(new).select(*old.columns)))


@step("rerank_evidence")
def rerank_evidence(state: State, settings: dict) -> State:
    """relevance of each passage by a scorer of (claim, passage), two decimals; by default the
    share of the claim's words in it. Evidence without a passage has empty_relevance unless
    it has one. What is under min_relevance goes, but not from a claim that is blank or has no
    passage at all."""
    e = evidence_of(state).join(claims_of(state), KEYS, "left")
    judged = F.trim(F.coalesce("claim", F.lit(""))) != ""
    e = e.withColumn("passage", F.when(judged, T.passage(F.col("title"), F.col("abstract"))))
    e = scores(state, e, settings, F.col("passage"), lexical)
    # a blank claim's evidence isn't judged: it keeps what it has
    e = e.withColumn("relevance_abstract", F.when(judged, round2(F.col("answer"))).otherwise(F.col("relevance_abstract"))).drop("answer")
    some = F.max(F.col("passage").isNotNull()).over(Window.partitionBy(*KEYS))
    empty = F.lit(float(settings.get("empty_relevance", 0.0)))
    bare = F.coalesce(F.trim("abstract"), F.lit("")) == ""
    e = e.withColumn("some", some).withColumn("relevance", F.when(judged, F.coalesce("relevance_abstract", F.when(bare, empty).otherwise(F.col("relevance")), empty)).otherwise(F.col("relevance")))
    least = settings.get("min_relevance", 0.7)
    kept = e if least is None else e.where(~F.col("some") | (F.coalesce("relevance", F.lit(0.0)) >= least))
    return state.with_table("evidence", kept.drop("claim", "passage", "some"))


@step("stance_evidence")
def stance_evidence(state: State, settings: dict) -> State:
    """Stance of the most relevant passages of each claim by a scorer of (claim, passage) that
    gives shares of support, neutrality and refutation. top_m_by_relevance says how many of a claim's are
    judged (all without it, or where it isn't over 0). A passage is the first of
    evidence_fields that makes one, with the title; fields that are neither abstract nor text
    don't count. By default a passage supports by the share of the claim's words in it, which is
    no model."""
    scorer = lambda c, p: F.array(lexical(c, p), 1 - lexical(c, p), F.lit(0.0))
    m = settings.get("top_m_by_relevance", settings.get("top_m"))
    m = m if isinstance(m, int) and m > 0 else 1 << 30
    e = E.top_by_relevance(evidence_of(state), m).join(claims_of(state), KEYS, "left")
    fields = [f for f in ("abstract", "text") if f in settings.get("evidence_fields", ("abstract", "text"))] or ["abstract", "text"]
    body = F.coalesce(*[T.passage(F.col("title"), F.col(f) if f in e.columns else F.lit(None).cast("string")) for f in fields])
    judged = F.col("chosen") & (F.trim(F.coalesce("claim", F.lit(""))) != "")
    e = scores(state, e, settings, F.when(judged, body), scorer, "shares").withColumnRenamed("answer", "p")
    share = lambda i: round2(F.get("p", i))
    label = T.stance_label(share(0), share(2), settings.get("threshold_decisive", settings.get("threshold", 0.0)))
    new = {"p_supports": share(0), "p_neutral": share(1), "p_refutes": share(2), "stance": F.when(F.get("p", 0).isNotNull(), label)}
    return state.with_table("evidence", e.withColumns({c: F.when(judged, x).otherwise(F.col(c)) for c, x in new.items()}).drop("p", "claim", "chosen", "rank"))


def line_of(include_text: bool = True, missing: str | None = "text: [no content]") -> Column:
    c = F.col
    return T.source_line(c("source_type"), c("weight"), c("relevance"), c("stance"), c("p_supports"), c("p_refutes"), c("p_neutral"), c("abstract") if include_text else None, missing)


@step("filter_evidence")
def filter_evidence(state: State, settings: dict) -> State:
    """Evidence without text, and what a reply that starts with yes (lower case) keeps; a null
    reply drops it. By default any word of the claim in the text is a yes."""
    e = evidence_of(state).join(claims_of(state), KEYS, "left")
    prompt = T.filled(settings.get("prompt_template", "{statement}\n{evidence}"), statement=F.col("claim"), evidence=line_of(missing=None))
    blank = F.trim(F.coalesce("abstract", F.lit(""))) == ""
    e = replied(state, e, settings, F.when(~blank, prompt))
    reply = F.col("answer") if "reply" in settings else F.when(lexical(F.col("claim"), F.col("abstract")) > 0, "yes").otherwise("no")
    return state.with_table("evidence", e.where(blank | F.coalesce(reply.startswith("yes"), F.lit(False))).drop("claim", "answer"))


BLOCKS = (("PUBMED EVIDENCE:", "PubMed"), ("EPISTEMONIKOS EVIDENCE:", "Epistemonikos"), ("RAG EVIDENCE:", "RAG"))


def evidence_block(state: State, include_text: bool = True) -> DataFrame:
    """run_id, stmt_id, block and rag: the lines of each kind of source, the most relevant last."""
    e = evidence_of(state)
    kind = F.when(F.col("source_type").isin("RAG", "Epistemonikos"), F.col("source_type")).otherwise("PubMed")
    line = F.when(kind == "RAG", T.chunk_line(F.col("score"), F.col("weight"), F.col("abstract") if include_text else None)).otherwise(line_of(include_text))
    lines = E.prompt_lines(e.withColumn("kind", kind), line, *KEYS, "kind").groupBy(*KEYS).pivot("kind", [k for _, k in BLOCKS]).agg(F.first("lines"))
    all_ = claims_of(state).join(lines, KEYS, "left")
    said = {k: F.coalesce(F.col(k), F.lit(f"No {k} evidence provided.")) for _, k in BLOCKS}
    block = F.concat_ws("\n\n", *[F.concat(F.lit(f"{head}\n"), said[k]) for head, k in BLOCKS])
    return all_.select(*KEYS, "claim", block.alias("block"), said["RAG"].alias("rag"))


@step("truthness")
def truthness(state: State, settings: dict) -> State:
    """verdict, score and rationale of each claim from a reply to a prompt with its evidence;
    a null reply is an error with score 0. Without a reply function a rule over the evidence
    decides (rule_verdict) and scores true 0.85, uncertain 0.5, false 0.15."""
    statements = state.tables["statements"].drop("verdict", "score", "rationale")
    if "reply" in settings:
        rows = evidence_block(state, settings.get("include_evidence_text", True))
        runs = state.tables.get("runs")
        rows = rows.join(runs.select("run_id", "transcript"), "run_id", "left") if runs is not None else rows.withColumn("transcript", F.lit(""))
        prompt = T.filled(settings.get("prompt_template", "{claim_text}\n{evidence_block}"), claim_text=F.col("claim"), evidence_block=F.col("block"), rag_chunks=F.col("rag"), transcript=F.col("transcript"))
        rows = replied(state, rows, settings, prompt).withColumnRenamed("answer", "reply").withColumn("v", T.verdict_of_reply(F.col("reply")))
        failed = F.col("reply").isNull()
        judged = rows.select(*KEYS, F.when(failed, "error").otherwise(F.col("v.verdict")).alias("verdict"), F.when(failed, 0.0).otherwise(F.col("v.score")).alias("score"), F.when(failed, "no reply").otherwise(T.reason_of_reply(F.col("reply"))).alias("rationale"))
    else:
        p = F.greatest("p_supports", "p_refutes")
        judged = evidence_of(state).groupBy(*KEYS).agg(E.rule_verdict(F.col("relevance"), F.col("weight"), F.col("stance"), p).alias("verdict"))
        judged = claims_of(state).select(*KEYS).join(judged, KEYS, "left").withColumn("verdict", F.coalesce("verdict", F.lit("uncertain")))
        judged = judged.withColumns({"score": F.when(F.col("verdict") == "true", 0.85).when(F.col("verdict") == "false", 0.15).otherwise(0.5), "rationale": F.lit("by rule")})
    return state.with_table("statements", statements.join(judged, KEYS, "left"))


def _media(name: str, needs: str, out: str):
    @step(name)
    def read(state: State, settings: dict) -> State:
        if "read" not in settings:
            raise NotImplementedError(f"{name} needs settings['read'], {needs}")
        return state.with_table(out, settings["read"](state))

    return read


download_reel = _media("download_reel", "a function from the state to a table (run_id, video)", "videos")
video_to_audio = _media("video_to_audio", "a function from the state to a table (run_id, audio)", "audio")
audio_to_transcript = _media("audio_to_transcript", "a function from the state to a table (run_id, transcript)", "runs")
