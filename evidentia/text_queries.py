"""Queries of text, display and evidence expressions over whole tables, with their SQL.

Texts that a model or a page would give are made from columns of the tables by rules that
both the query and its SQL state.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import collections as C
from evidentia.functions import display as D
from evidentia.functions import text as T
from evidentia.operators import evidence as E
from evidentia.operators import metrics as M
from evidentia.registry import query
from evidentia.sources import index as I
from evidentia.sources.readers import read_tables

BLANK = "[ \\t\\n\\x0B\\f\\r]+"


def _case(n, *values):
    """Column values by a whole number from 0 on."""
    out = F.when(n == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(n == i, v)
    return out


# --- replies of models -------------------------------------------------------------------


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Reasons.' || chr(10) || 'VERDICT: True' || chr(10) || 'FINALSCORE: ' || s WHEN 1 THEN 'verdict:FALSE, finalscore:  1' WHEN 2 THEN 'VERDICT: maybe FINALSCORE: ' || s WHEN 3 THEN 'VERDICT: uncertain' END AS reply, s
FROM (SELECT o_orderkey, printf('%.2f', (o_orderkey % 100) / 100.0::DOUBLE) AS s FROM orders))
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'uncertain' END AS verdict, CASE o_orderkey % 5 WHEN 0 THEN s::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
CASE WHEN o_orderkey % 5 > 1 THEN 'Unparsable output:' || chr(10) || coalesce(reply, '') ELSE reply END AS reason FROM r""")
def reply_verdicts(spark, d):
    """Verdict, score and reason of replies: two state both, in either case, two lack one, one is missing."""
    k = F.col("o_orderkey")
    s = F.format_string("%.2f", (k % 100) / 100.0)
    reply = _case(k % 5, F.concat(F.lit("Reasons.\nVERDICT: True\nFINALSCORE: "), s), F.lit("verdict:FALSE, finalscore:  1"), F.concat(F.lit("VERDICT: maybe FINALSCORE: "), s), F.lit("VERDICT: uncertain"))
    rows = read_tables(spark, d, "orders")[0].select("o_orderkey", reply.alias("reply")).withColumn("v", T.verdict_of_reply(F.col("reply")))
    return rows.select("o_orderkey", "v.verdict", "v.score", T.reason_of_reply(F.col("reply")).alias("reason"))


@query(f"""SELECT conv_id, turn, role, text, CASE WHEN turn % 3 = 0 THEN 'one of ' || conv_id || '|two' ELSE array_to_string(list_filter(list_transform(string_split_regex(text, '[.!?]{BLANK}'), lambda x: trim(x)), lambda x: x <> '')[1:3], '|') END AS claims
FROM conversations WHERE text IS NOT NULL""")
def reply_claims(spark, d):
    """Claims of replies: a fenced JSON list with a comma too many in every third turn, else none, so the first sentences of the turn."""
    c = read_tables(spark, d, "conversations")[0].where("text is not null")
    fenced = F.concat(F.lit('```json\n["one of '), F.col("conv_id").cast("string"), F.lit('", "two",]\n```'))
    reply = F.when(F.col("turn") % 3 == 0, fenced).otherwise("I can't list any.")
    return c.select("conv_id", "turn", "role", "text", F.array_join(T.claims_of_reply(reply, F.col("text")), "|").alias("claims"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'heart[tiab] AND ' || n || '[mh]' WHEN 1 THEN n || '[mh] OR (' || t || '[tiab])' WHEN 4 THEN n || ' AND ' || t WHEN 5 THEN t END AS query
FROM (SELECT p_partkey, replace(p_name, '#', ' ') AS n, p_type AS t FROM part)""")
def clean_queries(spark, d):
    """Literature queries as models write them: quoted and in backticks, with tags spelled in several ways, a tag that isn't one, a bracket that stays open, spaces, quotes around all."""
    n, t = F.regexp_replace("p_name", "#", " "), F.col("p_type")
    given = _case(
        F.col("p_partkey") % 6, F.concat(F.lit('`heart[tiab] and "'), n, F.lit('"[MeSH Terms]`')), F.concat(n, F.lit("[MeSH] or ("), t, F.lit("[tiab])")), F.concat(n, F.lit("[ti]")),
        F.concat(F.lit("("), n, F.lit("[mh]")), F.concat(F.lit("  "), n, F.lit("  And\n"), t, F.lit(" ")), F.concat(F.lit('"'), t, F.lit('"')),
    )
    return read_tables(spark, d, "part")[0].select("p_partkey", T.clean_query(given).alias("query"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderpriority WHEN 2 THEN 'Is it ' || o_orderstatus ELSE 'no ' || o_orderpriority END AS statement FROM orders""")
def question_statements(spark, d):
    """Rewritten questions: quoted after a lead, after another lead, empty (so the question itself stands), plain."""
    p = F.col("o_orderpriority")
    answer = _case(F.col("o_orderkey") % 4, F.concat(F.lit('A: "'), p, F.lit('"')), F.concat(F.lit(" Answer: "), p, F.lit(" ")), F.lit("  "), F.concat(F.lit("no "), p))
    question = F.concat(F.lit(" Is it "), F.col("o_orderstatus"), F.lit("??"))
    return read_tables(spark, d, "orders")[0].select("o_orderkey", T.statement_of_answer(answer, question).alias("statement"))


# --- prompts and passages ----------------------------------------------------------------


@query("""SELECT o_orderkey, '- RAG' || ' | score ' || printf('%.2f', (o_orderkey % 50) / 50.0::DOUBLE) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' | w ' || printf('%.2f', (o_custkey % 20) / 20.0::DOUBLE) END
|| ' | abstract: ' || CASE WHEN o_orderkey % 4 = 0 THEN '[no abstract]' ELSE 'first ' || o_orderpriority END AS line FROM orders""")
def passage_lines(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, "\n ").otherwise(F.concat(F.lit(" first\n"), F.col("o_orderpriority"), F.lit("\n")))
    line = T.chunk_line((k % 50) / 50.0, F.when(k % 3 != 0, (F.col("o_custkey") % 20) / 20.0), text)
    return read_tables(spark, d, "orders")[0].select("o_orderkey", line.alias("line"))


@query("""SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN source || chr(10) || chr(10) || rtrim(text) WHEN 1 THEN trim(text) ELSE source || chr(10) || chr(10) || 'None' END) AS digest FROM documents WHERE text IS NOT NULL AND trim(text) <> ''""")
def passages(spark, d):
    """What a scorer reads of a document: title and text, the text alone, a title without text."""
    k = F.col("doc_id") % 3
    title, body = F.when(k != 1, F.concat(F.lit(" "), F.col("source"), F.lit("  "))), F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit(" "), F.col("text")))
    rows = read_tables(spark, d, "documents")[0].where("text is not null and trim(text) <> ''")
    return rows.select("doc_id", F.md5(T.passage(title, body)).alias("digest"))


@query("""SELECT l_orderkey AS o_orderkey, string_agg(l_shipmode || ' ' || l_linenumber, chr(10) ORDER BY CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_quantity % 5 END, l_linenumber, l_shipmode) AS lines FROM
(SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1""")
def prompt_texts(spark, d):
    """An order's lines as its evidence in one text, the most relevant last, equal ones by number and text; every third has no relevance."""
    n = F.col("l_linenumber")
    rows = read_tables(spark, d, "lineitem")[0].select(F.col("l_orderkey").alias("o_orderkey"), n.alias("ord"), F.when(n % 3 != 0, (F.col("l_quantity") % 5).cast("double")).alias("relevance"), F.concat("l_returnflag", "l_linestatus").alias("kind"))
    return E.prompt_lines(rows, F.concat_ws(" ", "kind", "ord"), "o_orderkey")


@query("SELECT item_id, 'Claim {' || item_id || '}: ' || coalesce(text, '') || ' ' AS prompt FROM benchmark")
def filled_prompts(spark, d):
    rows = read_tables(spark, d, "benchmark")[0]
    return rows.select("item_id", T.filled("Claim {{{item}}}: {text} {none}", item=F.col("item_id"), text=F.col("text"), none=F.lit(None)).alias("prompt"))


@query(f"""SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(list_transform(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda x: regexp_replace(x, '{BLANK}$', '')), chr(10)), '^{BLANK}', ''), '{BLANK}$', '')) AS digest FROM documents""")
def trimmed_documents(spark, d):
    return read_tables(spark, d, "documents")[0].select("doc_id", F.md5(T.trimmed_lines(F.col("text"))).alias("digest"))


# --- ids, links and keys -----------------------------------------------------------------


@query("""SELECT page_id, CASE WHEN page_id % 4 < 2 THEN page_id::VARCHAR END AS article, CASE WHEN page_id % 4 < 2 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || page_id || '/' END AS link,
CASE WHEN page_id % 4 = 2 THEN 'c' || page_id END AS code FROM pages""")
def article_links(spark, d):
    """Ids as digits, in an article's URL, or neither; codes in the path of a reel's URL."""
    i = F.col("page_id").cast("string")
    given = _case(F.col("page_id") % 4, i, F.concat(F.lit("see https://pubmed.ncbi.nlm.nih.gov/"), i), F.concat(F.lit("https://example.org/u/reel/c"), i, F.lit("/?x=/p/1")), F.concat(F.lit("https://example.org/reels?p="), i))
    rows = read_tables(spark, d, "pages")[0].select("page_id", given.alias("g")).withColumn("article", T.article_id(F.col("g")))
    return rows.select("page_id", "article", T.article_url(F.col("article")).alias("link"), T.short_code(F.col("g")).alias("code"))


@query("""SELECT c_custkey, md5('details|{"id":"' || c_custkey || '","kind":"' || c_mktsegment || '"}') AS key, 'http://h' || c_custkey || CASE WHEN c_custkey % 3 = 2 THEN '/v1x' ELSE '' END || '/api/tags' AS url,
CASE c_custkey % 4 WHEN 0 THEN c_custkey WHEN 1 THEN 512 END::INTEGER AS ctx FROM customer""")
def service_keys(spark, d):
    """Keys of cached calls, a service's own path, and the context that a model's parameters allow."""
    c, i = F.col("c_custkey"), F.col("c_custkey").cast("string")
    url = F.concat(F.lit("http://h"), i, _case(c % 3, F.lit("/v1"), F.lit("/v1/"), F.lit("/v1x/")))
    parameters = _case(c % 4, F.concat(F.lit("stop x\nnum_ctx   "), i), F.lit("context_length: 512"), F.lit("num_ctx none"))
    key = T.cache_key(F.lit("details"), F.create_map(F.lit("kind"), F.col("c_mktsegment"), F.lit("id"), i))
    return read_tables(spark, d, "customer")[0].select("c_custkey", key.alias("key"), T.endpoint(url).alias("url"), T.context_limit(parameters).alias("ctx"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 0 THEN (l_linenumber % 3 - 1) || ':' || l_partkey % 4 ELSE 's:' || CASE WHEN l_partkey % 4 = 0 THEN 'e' ELSE (l_partkey % 4)::VARCHAR END END AS key,
CASE l_linenumber % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN 'high' ELSE printf('%.2f', l_quantity::DOUBLE) END AS score, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag || ', ' || l_linestatus ELSE 'Unknown' END AS kinds FROM lineitem""")
def shown_lines(spark, d):
    """Keys, scores and kinds as a reader is shown them; places and scores may be missing, kinds blank."""
    n, p = F.col("l_linenumber"), F.col("l_partkey") % 4
    score = _case(n % 4, F.lit(""), F.lit("high"), F.col("l_quantity").cast("string"), F.col("l_quantity").cast("string"))
    kinds = F.when(n % 2 == 0, F.array(F.col("l_returnflag"), F.lit(" "), F.concat(F.lit(" "), F.col("l_linestatus")))).otherwise(F.array(F.lit(" ")))
    key = D.pair_key(F.when(n % 3 > 0, n % 3 - 1), p)
    return read_tables(spark, d, "lineitem")[0].select("l_orderkey", "l_linenumber", key.alias("key"), D.score_text(score).alias("score"), D.kinds_text(kinds).alias("kinds"))


# --- given values ------------------------------------------------------------------------


@query("""SELECT event_id, event_id % 4 < 2 AS on, CASE WHEN event_id % 3 = 0 THEN event_id % 50 + 1 WHEN event_id % 2 = 0 THEN 7 ELSE 10 END::INTEGER AS n, event_id % 3 <> 1 AS given,
CASE WHEN event_id % 3 = 0 THEN '3,' || event_id WHEN event_id % 3 = 1 THEN '' ELSE '' END AS pages, event_type IN ('click', 'view') AS listed, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS texts FROM events""")
def given_settings(spark, d):
    """Settings as texts: yes and no, numbers of which the first that counts stands, lists of pages, one text or none."""
    i = F.col("event_id")
    on = _case(i % 4, F.lit(" Yes"), F.lit("ON"), F.lit("no"), F.lit("2"))
    n = C.first_valid(F.when(i % 3 == 0, (i % 50 + 1).cast("string")).otherwise("-4"), F.when(i % 2 == 0, F.lit("7")).otherwise("x"), default=10)
    given = C.any_given(_case(i % 3, F.lit(""), F.lit(""), F.lit("a")), _case(i % 3, F.lit("b"), F.lit(None).cast("string"), F.lit("")))
    pages = T.page_numbers(_case(i % 3, F.concat(F.lit("[3, "), i.cast("string"), F.lit("]")), F.lit("[3, x"), F.lit("")))
    listed = T.holds(F.array(F.lit("CLICK"), F.lit("View")), F.col("event_type"))
    texts = C.as_texts(F.when(i % 2 == 0, F.col("event_type")).otherwise(""), False)
    return read_tables(spark, d, "events")[0].select(
        "event_id", T.truthy(on).alias("on"), n.alias("n"), given.alias("given"), F.array_join(pages, ",").alias("pages"), listed.alias("listed"), F.array_join(texts, ",").alias("texts"),
    )


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN lang WHEN 2 THEN 'sum' WHEN 3 THEN 'bit' ELSE '' END AS shown FROM documents")
def abstract_texts(spark, d):
    """The first text of a passage's fields that isn't empty, trimmed."""
    k, none = F.col("doc_id") % 5, F.lit(None).cast("string")
    text = D.abstract_text(F.when(k == 0, F.concat(F.lit(" "), F.col("source"))).otherwise(""), F.when(k == 1, F.col("lang")), F.when(k == 2, " sum ").otherwise(none), F.when(k < 4, "bit"))
    return read_tables(spark, d, "documents")[0].select("doc_id", F.coalesce(text, F.lit("")).alias("shown"))


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality IN (0, 1) AND toxic = 0")
def valid_label_rows(spark, d):
    rows = read_tables(spark, d, "labels")[0].select("doc_id", "quality", "toxic")
    return M.valid_labels(M.valid_labels(rows, "quality", "toxic"), "toxic", labels=(0,))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 100) / 100.0::DOUBLE END AS relevance FROM orders WHERE o_orderkey % 3 > 0 AND (o_orderkey % 100) / 100.0::DOUBLE >= 0.7")
def relevant_orders(spark, d):
    """Orders as evidence of at least the least relevance; one without any counts as 0."""
    k = F.col("o_orderkey")
    return E.min_relevance(read_tables(spark, d, "orders")[0].select("o_orderkey", F.when(k % 3 > 0, (k % 100) / 100.0).alias("relevance")), 0.7)


# --- counts and indexes ------------------------------------------------------------------


@query("""SELECT o_custkey, count(*) AS total, count(*) FILTER (s IS DISTINCT FROM 'RAG') AS papers, count(*) FILTER (s = 'RAG') AS chunks, count(*) FILTER (s IS NULL) AS unknown
FROM (SELECT o_custkey, CASE o_orderkey % 4 WHEN 0 THEN 'PubMed' WHEN 1 THEN 'RAG' WHEN 2 THEN 'Epistemonikos' END AS s FROM orders) GROUP BY 1""")
def papers_and_passages(spark, d):
    """A customer's orders as evidence of several sources, counted as papers and passages; every fourth has none."""
    source = _case(F.col("o_orderkey") % 4, F.lit("PubMed"), F.lit("RAG"), F.lit("Epistemonikos"))
    by = E.counts_by_source(read_tables(spark, d, "orders")[0].select("o_custkey", source.alias("source_type")), "o_custkey")
    papers, chunks = E.papers_and_chunks(F.col("by_source"))
    return by.select("o_custkey", "total", papers.alias("papers"), chunks.alias("chunks"), C.count_of(F.col("by_source"), F.lit("Unknown")).cast("long").alias("unknown"))


@query("""SELECT vec_id, source AS source_path, CASE WHEN vec_id % 2 = 0 THEN '1,' || vec_id % 7 ELSE '' END AS pages, len(embedding)::BIGINT AS dim FROM embeddings JOIN documents ON documents.doc_id = vec_id""")
def index_passages(spark, d):
    """Vectors as passages of an index, each of the document with its id; every second has no list of pages."""
    v, docs = read_tables(spark, d, "embeddings", "documents")
    dim = F.lit(v.select(F.size("embedding")).first()[0])
    documents = docs.select("doc_id", F.col("source").alias("source_path"), dim.alias("dim"))
    pages = F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("[1, "), F.col("vec_id") % 7, F.lit("]"))).otherwise("none")
    chunks = v.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("doc_id"), pages.alias("pages_json"), F.lit("").alias("text"), "embedding")
    return I.index_rows(documents, chunks).select(F.col("chunk_id").alias("vec_id"), "source_path", F.array_join("pages", ",").alias("pages"), F.size("embedding").cast("long").alias("dim"))


OLD = "SELECT doc_id, lang AS tag FROM documents WHERE doc_id % 3 = 0"
NEW = "SELECT doc_id, source AS tag FROM documents WHERE doc_id % 2 = 0"


@query(f"""WITH o AS ({OLD}), n AS ({NEW}), kept AS (SELECT 'kept' AS way, * FROM o UNION ALL SELECT 'kept', * FROM n WHERE doc_id NOT IN (SELECT doc_id FROM o)), forced AS (SELECT 'forced' AS way, * FROM n UNION ALL SELECT 'forced', * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n))
SELECT way, 'document' AS kind, doc_id, tag FROM (SELECT * FROM kept UNION ALL SELECT * FROM forced) UNION ALL SELECT way, 'passage', doc_id, tag || x FROM (SELECT * FROM kept UNION ALL SELECT * FROM forced), (VALUES ('a'), ('b')) t(x)""")
def merged_index(spark, d):
    """An index of every third document and another of every second, merged in both ways: what is there stays, or goes with its passages."""
    (docs,) = read_tables(spark, d, "documents")

    def index(share: int, tag: str):
        own = docs.where(F.col("doc_id") % share == 0).select("doc_id", F.col(tag).alias("tag"))
        return own, own.select("doc_id", F.explode(F.array(F.concat("tag", F.lit("a")), F.concat("tag", F.lit("b")))).alias("tag"))

    def way(name: str, force: bool):
        documents, chunks = I.upsert_index(index(3, "lang"), index(2, "source"), force)
        marked = lambda df, kind: df.select(F.lit(name).alias("way"), F.lit(kind).alias("kind"), "doc_id", "tag")
        return marked(documents, "document").unionByName(marked(chunks, "passage"))

    return way("kept", False).unionByName(way("forced", True))
