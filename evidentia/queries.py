"""Queries of the library's operators over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.functions import collections as C
from evidentia.functions import display as D
from evidentia.functions import text as T
from evidentia.functions import vectors as V
from evidentia.operators import evidence as E
from evidentia.operators import metrics as M
from evidentia.operators import tables as B
from evidentia.operators import windows as W
from evidentia.operators.nearest import nearest
from evidentia.plans.evaluation import summaries
from evidentia.plans.pipeline import lexical
from evidentia.registry import QUERIES, SQL, query  # noqa: F401
from evidentia.sources.readers import not_done, read_tables

DOT = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"
TOP = f"""SELECT * FROM (SELECT a.vec_id AS claim_id, b.vec_id AS chunk_id, {DOT} AS s,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY {DOT} DESC, b.vec_id) AS rank
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 5"""


def _top(spark, d, least):
    (e,) = read_tables(spark, d, "embeddings")
    claims = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("claim_id"), F.col("embedding").alias("claim_vec"))
    return E.top_similar(claims, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("chunk_vec")), 5, least)


@query(f"SELECT claim_id, chunk_id, round(s, 6) AS score, rank FROM ({TOP}) WHERE s >= 0.25")
def top_chunks(spark, d):
    return _top(spark, d, 0.25).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT claim_id, floor(coalesce(sum(s * CASE WHEN s < 0.3 THEN 3 ELSE 1 END) / sum(CASE WHEN s < 0.3 THEN 3 ELSE 1 END), 0) * 100 + 0.5) / 100 AS truth FROM ({TOP}) WHERE s >= 0.25 GROUP BY 1")
def claim_truth(spark, d):
    return _top(spark, d, 0.25).groupBy("claim_id").agg(E.penalty_mean(F.col("score")).alias("truth"))


@query("SELECT o_custkey, floor(sum(s * w) / sum(w) * 100 + 0.5) / 100 AS overall FROM (SELECT o_custkey, (o_orderkey % 100) / 100.0::DOUBLE AS s, CASE WHEN (o_orderkey % 100) / 100.0::DOUBLE < 0.3 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM orders) GROUP BY 1")
def penalty_scores(spark, d):
    (o,) = read_tables(spark, d, "orders")
    return o.groupBy("o_custkey").agg(E.penalty_mean((F.col("o_orderkey") % 100) / 100.0).alias("overall"))


@query("""SELECT o_orderstatus, round(0.5 + 0.5 * sum(x * greatest(0.000001, abs(x))) / sum(greatest(0.000001, abs(x))), 6) AS truth, round(avg(abs(x)), 6) AS certainty
FROM (SELECT o_orderstatus, 2 * ((o_orderkey % 100) / 100.0::DOUBLE - 0.5) AS x FROM orders) GROUP BY 1""")
def certainty_scores(spark, d):
    (o,) = read_tables(spark, d, "orders")
    t, c = E.certainty((F.col("o_orderkey") % 100) / 100.0)
    return o.groupBy("o_orderstatus").agg(F.round(t, 6).alias("truth"), F.round(c, 6).alias("certainty"))


KINDS = ("Meta-Analysis", "Journal Article", "Retracted Publication", "Clinical Trial, Phase III", "Case Reports", "News")


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 WHEN 2 THEN 0.4 WHEN 3 THEN 0.78 WHEN 4 THEN 0.4 ELSE 0.15 END::DOUBLE AS weight FROM part")
def publication_weights(spark, d):
    (p,) = read_tables(spark, d, "part")
    kinds = F.array(*map(F.lit, KINDS))
    return p.select("p_partkey", E.publication_weight(F.array(kinds[(F.col("p_partkey") % 6).cast("int")])).alias("weight"))


@query("""WITH f AS (SELECT l_orderkey % 50 AS stmt_id, CAST(l_partkey AS VARCHAR) AS pubmed_id, l_linenumber AS q, l_orderkey AS r, l_shipmode AS query FROM (SELECT *, l_returnflag || l_linenumber AS l_shipmode FROM lineitem)),
one AS (SELECT stmt_id, pubmed_id, lower(query) AS low, min((q, r, query)) AS hit FROM f GROUP BY ALL),
g AS (SELECT stmt_id, pubmed_id, list_sort(list(hit)) AS l FROM one GROUP BY ALL)
SELECT stmt_id, pubmed_id, row_number() OVER (PARTITION BY stmt_id ORDER BY l[1], pubmed_id) - 1 AS ord, array_to_string(list_transform(l[2:], lambda x: x[3]), ',') AS queries FROM g""")
def merged_evidence(spark, d):
    (x,) = read_tables(spark, d, "lineitem")
    found = x.select((F.col("l_orderkey") % 50).alias("stmt_id"), F.col("l_partkey").cast("string").alias("pubmed_id"), F.col("l_linenumber").alias("query_ord"), F.col("l_orderkey").alias("rank"), F.concat("l_returnflag", "l_linenumber").alias("query"))
    q = F.col("queries")
    joined = F.when(~F.forall(q, lambda x: x.isNull()) | (F.size(q) == 0), F.array_join(q, ","))  # as in SQL, null where there are nulls alone
    return E.merge_found(found).withColumn("ord", F.col("ord").cast("long")).withColumn("queries", joined)


@query("SELECT doc_id, len(list_filter(list_transform(string_split_regex(text, '[.!?][ \\t\\n\\x0B\\f\\r]+'), lambda s: trim(s)), lambda s: s <> ''))::BIGINT AS n FROM documents")
def sentence_counts(spark, d):
    return read_tables(spark, d, "documents")[0].select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS digest, substr(sha256(source || '::' || md5(text)), 1, 32) AS key FROM documents")
def document_digests(spark, d):
    t = F.col("text")
    return read_tables(spark, d, "documents")[0].select("doc_id", F.md5(T.collapse(t)).alias("digest"), T.document_key(F.col("source"), F.md5(t)).alias("key"))


@query("""SELECT doc_id, CASE WHEN length(t) > 200 THEN regexp_replace(substr(t, 1, 200), ' [^ ]*$', '') || '...' ELSE t END AS short
FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM documents)""")
def clean_texts(spark, d):
    return read_tables(spark, d, "documents")[0].select("doc_id", T.clean_text(F.col("text"), 200).alias("short"))


@query("SELECT doc_id, n, CASE WHEN n = 0 THEN 0 WHEN n <= 512 THEN 1 ELSE 1 + ceil((n - 512) / 448.0) END::BIGINT AS windows FROM (SELECT doc_id, len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))::BIGINT AS n FROM documents)")
def window_counts(spark, d):
    words = F.filter(F.split("text", T.SPACE), lambda x: x != "")
    df = read_tables(spark, d, "documents")[0].select("doc_id", words.alias("w"))
    return df.select("doc_id", F.size("w").cast("long").alias("n"), F.size(W.token_windows(F.col("w"))).cast("long").alias("windows"))


@query("SELECT source, lang, count(*) AS n FROM documents WHERE lower(text) NOT LIKE 'abstract available from%' GROUP BY ALL")
def evidence_counts(spark, d):
    return read_tables(spark, d, "documents")[0].where(~F.lower("text").startswith("abstract available from")).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, text_key, dup FROM (SELECT doc_id, lang, md5(lower(text)) AS text_key, row_number() OVER (PARTITION BY lang, md5(lower(text)) ORDER BY doc_id) AS dup FROM documents) WHERE dup = 1")
def distinct_documents(spark, d):
    w = Window.partitionBy("lang", "text_key").orderBy("doc_id")
    return read_tables(spark, d, "documents")[0].select("doc_id", "lang", F.md5(F.lower("text")).alias("text_key")).withColumn("dup", F.row_number().over(w).cast("long")).where("dup = 1")


ROWS = "SELECT quality AS t, toxic AS p FROM labels"


def _labels(spark, d):
    return read_tables(spark, d, "labels")[0].select(F.col("quality").alias("t"), F.col("toxic").alias("p"))


@query(f"SELECT t, p, count(*) AS n FROM ({ROWS}) WHERE p IS NOT NULL GROUP BY ALL")
def confusion_matrix(spark, d):
    return M.confusion(_labels(spark, d))


@query(f"SELECT count(p) AS scored, count(*) - count(p) AS skipped, coalesce(avg(CASE WHEN p IS NOT NULL THEN (t = p)::INT END), 0)::DOUBLE AS accuracy FROM ({ROWS})")
def accuracy(spark, d):
    return M.accuracy(_labels(spark, d))


PER = f"WITH r AS ({ROWS}), k AS ({{kinds}}), s AS (SELECT c, (SELECT count(*) FROM r WHERE t = c AND p IS NOT NULL) AS truth, (SELECT count(*) FROM r WHERE p = c) AS said, (SELECT count(*) FROM r WHERE t = c AND p = c) AS hit FROM k)"


@query(PER.format(kinds="SELECT t AS c FROM r UNION SELECT p FROM r") + " SELECT round(avg(coalesce(hit / nullif(said, 0), 0)), 9) AS precision, round(avg(coalesce(hit / nullif(truth, 0), 0)), 9) AS recall, round(avg(coalesce(2.0 * hit / nullif(said + truth, 0), 0)), 9) AS f1 FROM s")
def macro_present(spark, d):
    return M.macro(_labels(spark, d)).select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(PER.format(kinds="SELECT unnest([0, 1, 2]) AS c") + " SELECT round(avg(hit / nullif(said, 0)), 9) AS precision, round(avg(hit / nullif(truth, 0)), 9) AS recall, round(avg(CASE WHEN said > 0 AND truth > 0 AND hit > 0 THEN 2.0 * hit / (said + truth) END), 9) AS f1 FROM s")
def macro_fixed(spark, d):
    return M.macro(_labels(spark, d), [0, 1, 2]).select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"SELECT t, avg((t = p)::INT)::DOUBLE AS recall FROM ({ROWS}) WHERE p IS NOT NULL GROUP BY 1")
def class_recall(spark, d):
    return M.class_recall(_labels(spark, d))


@query("SELECT doc_id, quality, CASE WHEN rn <= floor(n * 0.7) THEN 'train' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels)")
def ranked_split(spark, d):
    return W.stratified_split(read_tables(spark, d, "labels")[0], "quality", "doc_id", 0.7, order="doc_id").select("doc_id", "quality", "split")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript, count(*) AS turns FROM conversations GROUP BY 1")
def transcripts(spark, d):
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("x"))))
    return read_tables(spark, d, "conversations")[0].groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda s: s["x"]), "\n").alias("transcript"), F.count("*").alias("turns"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url LIKE '%/reel/%' OR url LIKE '%/reels/%' AS is_reel FROM pages")
def page_meta(spark, d):
    u = F.col("url")
    return read_tables(spark, d, "pages")[0].select("page_id", F.regexp_extract(u, r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), (u.contains("/reel/") | u.contains("/reels/")).alias("is_reel"))


@query("SELECT user_id, event_type, count(*) AS n, sum(CASE WHEN d > 0 THEN d ELSE 0 END)::DECIMAL(30, 4)::DOUBLE AS up FROM (SELECT user_id, event_type, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS d FROM events) GROUP BY ALL")
def step_deltas(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read_tables(spark, d, "events")[0].select("user_id", "event_type", F.round(F.col("value") - F.lag("value").over(w), 4).alias("d"))
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum(F.greatest("d", F.lit(0.0))).cast("decimal(30,4)").cast("double").alias("up"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_props(spark, d):
    return read_tables(spark, d, "events")[0].select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def not_completed(spark, d):
    c, o = read_tables(spark, d, "customer", "orders")
    return not_done(c.select("c_custkey"), o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT n_name, count(*) AS n, sum(o_totalprice)::DECIMAL(30, 2)::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def joined_totals(spark, d):
    o, c, n = read_tables(spark, d, "orders", "customer", "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"), F.sum("o_totalprice").cast("decimal(30,2)").cast("double").alias("total"))


@query("SELECT o_orderkey, o_custkey, rn FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_m(spark, d):
    e = read_tables(spark, d, "orders")[0].select(F.col("o_custkey").alias("stmt_id"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("relevance"))
    return E.top_by_relevance(e, 3).where("chosen").select(F.col("ord").alias("o_orderkey"), F.col("stmt_id").alias("o_custkey"), F.col("rank").cast("long").alias("rn"))


@query("""SELECT o_custkey % 100 AS stmt_id, CASE WHEN count(*) FILTER (s AND o_orderstatus = 'F') > 40 THEN 'false' WHEN count(*) FILTER (s AND o_orderstatus = 'O') >= 10 THEN 'true' ELSE 'uncertain' END AS verdict
FROM (SELECT *, o_totalprice > 200000 AS s FROM orders) GROUP BY 1""")
def rule_counts(spark, d):
    (o,) = read_tables(spark, d, "orders")
    relevance = F.when(F.col("o_totalprice") > 200000, 1.0).otherwise(0.0)
    stance = F.when(F.col("o_orderstatus") == "F", "Refutes").when(F.col("o_orderstatus") == "O", "Supports").otherwise("Neutral")
    verdict = E.rule_verdict(relevance, F.lit(1.0), stance, F.lit(1.0), many=10, against=40)
    return o.groupBy((F.col("o_custkey") % 100).alias("stmt_id")).agg(verdict.alias("verdict"))


@query("""SELECT event_id, CASE WHEN p IS NULL THEN NULL ELSE floor(p + 0.5)::BIGINT END AS percent, CASE WHEN floor(p + 0.5) <= 30 THEN 'low' WHEN floor(p + 0.5) <= 75 THEN 'medium' WHEN p IS NOT NULL THEN 'high' END AS band
FROM (SELECT event_id, CASE WHEN value BETWEEN 0 AND 1 THEN value * 100 WHEN value > 1 AND value <= 100 THEN value END AS p FROM events)""")
def score_bands(spark, d):
    p = T.score_percent(F.col("value"))
    return read_tables(spark, d, "events")[0].select("event_id", p.alias("percent"), T.score_band(p).alias("band"))


@query("SELECT doc_id, CASE WHEN greatest(s, r) < 0.3 THEN 'Neutral' WHEN s >= r THEN 'Supports' ELSE 'Refutes' END AS stance FROM (SELECT doc_id, (n_chars % 100) / 100.0 AS s, (doc_id % 100) / 100.0 AS r FROM documents)")
def stance_labels(spark, d):
    return read_tables(spark, d, "documents")[0].select("doc_id", T.stance_label((F.col("n_chars") % 100) / 100, (F.col("doc_id") % 100) / 100, 0.3).alias("stance"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, len(embedding)::BIGINT AS dim FROM embeddings")
def vector_norms(spark, d):
    return read_tables(spark, d, "embeddings")[0].select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").cast("long").alias("dim"))


@query("SELECT item_id, text, array_to_string(list_distinct_first[1:6], ' ') AS query FROM (SELECT item_id, text, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_first FROM (SELECT item_id, text, regexp_extract_all(text, '[A-Za-z'']+') AS l FROM benchmark))")
def fallback_queries(spark, d):
    return read_tables(spark, d, "benchmark")[0].select("item_id", "text", T.fallback_query(F.col("text")).alias("query"))


WORDS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'))"


@query(f"""SELECT conv_id, turn, coalesce(len(list_intersect(a, b)) / nullif(len(a), 0), 0)::DOUBLE AS relevance
FROM (SELECT conv_id, turn, {WORDS.format('text')} AS a, {WORDS.format('lag(text) OVER (PARTITION BY conv_id ORDER BY turn)')} AS b FROM conversations)""")
def lexical_relevance(spark, d):
    """Words of conversations' turns found in the turn before, by the offline scorer."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return read_tables(spark, d, "conversations")[0].select("conv_id", "turn", lexical(F.col("text"), F.lag("text").over(w)).alias("relevance"))


#: Kinds of publication and the weight each has by the rules, near misses last.
EXPECTED = (
    ("Meta-Analysis", 0.9), ("Meta Analysis", 0.9), ("Systematic Review", 0.85), ("Practice Guideline", 0.85), ("Randomized Controlled Trial", 0.8), ("Randomised Controlled Trial", 0.8),
    ("Clinical Trial, Phase III", 0.78), ("Controlled Clinical Trial", 0.75), ("Pragmatic Clinical Trial", 0.75), ("Adaptive Clinical Trial", 0.75), ("Equivalence Trial", 0.75),
    ("Clinical Trial, Phase II", 0.7), ("Clinical Trial, Phase IV", 0.7), ("Clinical Trial, Phase I", 0.7), ("Clinical Trial Protocol", 0.7), ("Clinical Trial", 0.7),
    ("Observational Study", 0.6), ("Clinical Study", 0.6), ("Consensus Development Conference, NIH", 0.6), ("Consensus Development Conference", 0.6), ("Guideline", 0.6),
    ("Comparative Study", 0.6), ("Multicenter Study", 0.6), ("Evaluation Studies", 0.6), ("Validation Study", 0.55), ("Journal Article", 0.5), ("Review", 0.55), ("Case Reports", 0.4),
    ("Technical Report", 0.4), ("Preprint", 0.4), ("Meeting Abstract", 0.3), ("Editorial", 0.2), ("Comment", 0.2), ("Letter", 0.2), ("News", 0.15), ("Expression of Concern", 0.05),
    ("Duplicate Publication", 0.05), ("Retraction of Publication", 0.4), ("Retracted Publication", 0.4),
    ("Phase III Study", 0.4), ("Phase I", 0.4), ("Newspaper Article", 0.4), ("Previews", 0.4), ("Guidelines", 0.4),
)


@query(f"SELECT p_partkey, [{', '.join(repr(k) for k, _ in EXPECTED)}][p_partkey % {len(EXPECTED)} + 1] AS kind, [{', '.join(str(w) for _, w in EXPECTED)}][p_partkey % {len(EXPECTED)} + 1]::DOUBLE AS weight FROM part")
def weight_rules(spark, d):
    kind = F.get(F.array(*[F.lit(k) for k, _ in EXPECTED]), (F.col("p_partkey") % len(EXPECTED)).cast("int"))
    return read_tables(spark, d, "part")[0].select("p_partkey", kind.alias("kind")).withColumn("weight", E.publication_weight(F.array("kind")))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def resume_items(spark, d):
    o, c = read_tables(spark, d, "orders", "customer")
    return not_done(o.select("o_orderkey", "o_custkey"), c.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_orderkey")


@query("SELECT doc_id, CASE WHEN rn <= floor(n * 0.7) THEN 'train' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':3'), doc_id) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels)")
def hashed_split(spark, d):
    return W.stratified_split(read_tables(spark, d, "labels")[0], "quality", "doc_id", 0.7, seed=3).select("doc_id", "split")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN 'PubMed ' || doc_id WHEN 2 THEN 'RAG ' || doc_id ELSE 'Untitled source' END AS title,
CASE WHEN s >= r AND s >= 0.5 THEN 'Supports' WHEN r >= 0.5 THEN 'Refutes' ELSE 'Neutral' END AS stance, (doc_id % 101) * 1.8::DOUBLE - 90 AS needle
FROM (SELECT *, (n_chars % 100) / 100.0::DOUBLE AS s, (doc_id % 100) / 100.0::DOUBLE AS r FROM documents)""")
def display_rows(spark, d):
    c, none = F.col("doc_id"), F.lit(None).cast("string")
    kind = lambda n, x: F.when(c % 4 == n, x)
    title = D.title(kind(0, F.col("source")), kind(1, c), none, kind(2, c))
    stance = D.stance_text(none, (F.col("n_chars") % 100) / 100.0, (c % 100) / 100.0, F.lit(0.5))
    return read_tables(spark, d, "documents")[0].select("doc_id", title.alias("title"), stance.alias("stance"), D.needle(c % 101).alias("needle"))


@query("SELECT lang, sum(n)::BIGINT AS total, string_agg(source || ':' || n, ',' ORDER BY source) AS by_source FROM (SELECT lang, coalesce(source, 'Unknown') AS source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY 1")
def source_counts(spark, d):
    e = read_tables(spark, d, "documents")[0].select("lang", F.col("source").alias("source_type"))
    pairs = F.transform(F.map_entries("by_source"), lambda x: F.concat_ws(":", x["key"], x["value"]))
    return E.counts_by_source(e, "lang").select("lang", "total", F.array_join(pairs, ",").alias("by_source"))


@query("""SELECT doc_id, doc_id || ':' || lpad(i::VARCHAR, 6, '0') AS chunk_id, least(512, n - i * 448)::BIGINT AS n
FROM (SELECT doc_id, n, unnest(range(0, CASE WHEN n = 0 THEN 0 WHEN n <= 512 THEN 1 ELSE (1 + ceil((n - 512) / 448.0))::BIGINT END)) AS i
FROM (SELECT doc_id, len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))::BIGINT AS n FROM documents))""")
def chunk_rows(spark, d):
    words = F.filter(F.split("text", T.SPACE), lambda x: x != "")
    pages = read_tables(spark, d, "documents")[0].select("doc_id", F.lit(1).alias("page"), words.alias("tokens"))
    return W.window_rows(pages).select("doc_id", "chunk_id", F.size("tokens").cast("long").alias("n"))


@query("SELECT event_id, sum(event_id % 100) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS total FROM events")
def running_totals(spark, d):
    e = read_tables(spark, d, "events")[0].withColumn("tokens", F.col("event_id") % 100)
    return W.running_sum(e, "tokens", ["ts", "event_id"], "user_id").select("event_id", "total")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def label_totals(spark, d):
    return M.label_counts(read_tables(spark, d, "documents")[0], "lang")


@query("""WITH r AS (SELECT 'c' || doc_id % 3 AS config, quality AS t, toxic AS p FROM labels), k AS (SELECT config, t AS c FROM r WHERE p IS NOT NULL UNION SELECT config, p FROM r WHERE p IS NOT NULL),
s AS (SELECT k.config, k.c, count(*) FILTER (t = c AND p IS NOT NULL) AS truth, count(*) FILTER (p = c) AS said, count(*) FILTER (t = c AND p = c) AS hit FROM k JOIN r ON r.config = k.config GROUP BY ALL),
m AS (SELECT config, round(avg(coalesce(hit / nullif(said, 0), 0)), 9) AS precision, round(avg(coalesce(hit / nullif(truth, 0), 0)), 9) AS recall, round(avg(coalesce(2.0 * hit / nullif(said + truth, 0), 0)), 9) AS f1_score FROM s GROUP BY 1)
SELECT r.config, count(p) AS n_scored, count(*) - count(p) AS n_skipped, round(avg(CASE WHEN p IS NOT NULL THEN (t = p)::INT END), 9) AS accuracy, any_value(precision) AS precision, any_value(recall) AS recall, any_value(f1_score) AS f1_score FROM r JOIN m ON m.config = r.config GROUP BY 1""")
def evaluation_summaries(spark, d):
    records = read_tables(spark, d, "labels")[0].select(F.concat(F.lit("c"), F.col("doc_id") % 3).alias("config"), F.col("quality").alias("true_label"), F.col("toxic").alias("predicted_label"))
    return summaries(records).select("config", "n_scored", "n_skipped", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1_score")])


@query("""SELECT o_orderkey, '- ' || CASE o_orderstatus WHEN 'F' THEN 'PMID' WHEN 'O' THEN 'RAG' ELSE 'SOURCE' END || ' | w ' || printf('%.2f', (o_orderkey % 100) / 100.0::DOUBLE)
|| CASE WHEN o_custkey % 3 = 0 THEN '' ELSE ' | rel ' || printf('%.2f', (o_custkey % 100) / 100.0::DOUBLE) END
|| CASE WHEN o_custkey % 2 = 0 THEN ' | stance abs Supports (S' || printf('%.2f', (o_custkey % 50) / 50.0::DOUBLE) || ')' ELSE '' END || ' | text: ' || CASE WHEN o_orderkey % 5 = 0 THEN '[no content]' ELSE o_orderpriority END AS line FROM orders""")
def source_lines(spark, d):
    k, c, none = F.col("o_orderkey"), F.col("o_custkey"), F.lit(None).cast("double")
    source = F.when(F.col("o_orderstatus") == "F", "PubMed").when(F.col("o_orderstatus") == "O", "RAG")
    line = T.source_line(
        source, (k % 100) / 100.0, F.when(c % 3 != 0, (c % 100) / 100.0), F.when(c % 2 == 0, "Supports"), F.when(c % 2 == 0, (c % 50) / 50.0), none, none,
        F.when(k % 5 == 0, " ").otherwise(F.col("o_orderpriority")),
    )
    return read_tables(spark, d, "orders")[0].select("o_orderkey", line.alias("line"))


@query("""SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '... [truncated ' || (length(text) - 1000) || ' chars]' ELSE text END AS cut,
coalesce(nullif(regexp_replace(regexp_replace(trim(substr(text, 1, 30)), '[ \\t\\n\\x0B\\f\\r]+', '_', 'g'), '[^A-Za-z0-9._-]+', '', 'g'), ''), 'Unnamed_Pipeline') AS name FROM documents""")
def cut_texts(spark, d):
    t = F.col("text")
    return read_tables(spark, d, "documents")[0].select("doc_id", T.cut_long(t).alias("cut"), T.sanitized_name(F.substring(t, 1, 30)).alias("name"))


# --- run logs, lists and whole-table forms ---------------------------------------------


@query("""SELECT user_id AS run_id, sum(CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 100 END)::BIGINT AS total,
string_agg(event_type || '=' || CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 100 END, ',' ORDER BY event_id) AS by_step FROM events WHERE event_id % 11 <> 0 GROUP BY 1""")
def step_tokens(spark, d):
    """Events as entries of their user's run log: every seventh has no tokens, every eleventh is a module."""
    i = F.col("event_id")
    log = read_tables(spark, d, "events")[0].select(F.col("user_id").alias("run_id"), i.alias("seq"), F.col("event_type").alias("step"), F.when(i % 7 != 0, i % 100).alias("tokens"), (i % 11 == 0).alias("is_module"))
    said = F.transform("by_step", lambda x: F.concat_ws("=", x["step"], x["tokens"]))
    return M.tokens_by_step(log).select("run_id", F.col("total").cast("long").alias("total"), F.array_join(said, ",").alias("by_step"))


CHANGE = "SELECT o_custkey AS run_id, o_orderpriority AS p, o_orderkey % 5 - o_orderkey % 7 AS own, o_orderkey % 3 AS rag FROM orders WHERE o_orderstatus <> 'P'"


@query(f"""WITH c AS ({CHANGE}), s AS (SELECT run_id, p AS source, own AS d FROM c UNION ALL SELECT run_id, 'RAG', rag FROM c),
b AS (SELECT run_id, source, sum(greatest(d, 0)) AS up, sum(greatest(-d, 0)) AS down FROM s GROUP BY ALL),
m AS (SELECT run_id, string_agg(source || '=' || up, ',' ORDER BY source) FILTER (up > 0) AS u, string_agg(source || '=' || down, ',' ORDER BY source) FILTER (down > 0) AS v FROM b GROUP BY 1),
t AS (SELECT run_id, sum(greatest(own + rag, 0))::BIGINT AS found, sum(greatest(-own - rag, 0))::BIGINT AS discarded FROM c GROUP BY 1),
r AS (SELECT DISTINCT o_custkey AS run_id FROM orders)
SELECT r.run_id, found, discarded, CASE WHEN found IS NOT NULL THEN coalesce(u, '') END AS found_by, CASE WHEN found IS NOT NULL THEN coalesce(v, '') END AS discarded_by FROM r LEFT JOIN t ON r.run_id = t.run_id LEFT JOIN m ON r.run_id = m.run_id""")
def found_and_discarded(spark, d):
    """Orders as steps of their customer's run, each with counts by source before and after; pending ones have none."""
    k, p, n = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus") != "P"
    kind = "map<string,int>"
    before, after = F.create_map(p, k % 7).cast(kind), F.create_map(p, k % 5, F.lit("RAG"), k % 3).cast(kind)
    log = read_tables(spark, d, "orders")[0].select(F.col("o_custkey").alias("run_id"), F.lit(False).alias("is_module"), F.when(n, before).alias("before"), F.when(n, after).alias("after"))
    said = lambda c: F.when(F.col(c).isNotNull(), F.array_join(F.transform(F.map_entries(c), lambda x: F.concat_ws("=", x["key"], x["value"])), ","))
    return M.evidence_changes(log).select("run_id", F.col("found").cast("long").alias("found"), F.col("discarded").cast("long").alias("discarded"), said("found_by_source").alias("found_by"), said("discarded_by_source").alias("discarded_by"))


@query("""SELECT stmt_id, doc_id FROM (SELECT lang AS stmt_id, doc_id, row_number() OVER (PARTITION BY lang, CASE WHEN trim(source) = '' OR doc_id % 3 > 0 THEN lower(trim(text)) ELSE lower(trim(source)) END ORDER BY n_chars DESC, doc_id) AS n
FROM documents WHERE trim(text) <> '') WHERE n = 1""")
def deduped_evidence(spark, d):
    """Documents as evidence of their language: every third has its source for an id, the others a title alone."""
    e = read_tables(spark, d, "documents")[0].where(F.trim("text") != "")
    none = F.lit(None).cast("string")
    rows = e.select(F.col("lang").alias("stmt_id"), F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("pubmed_id"), none.alias("doi"), none.alias("url"), F.col("text").alias("title"), F.col("n_chars").alias("weight"))
    return E.dedup_evidence(rows).select("stmt_id", F.col("ord").alias("doc_id"))


FINDS = "SELECT l_orderkey % 50 AS stmt_id, CAST(l_partkey AS VARCHAR) AS pubmed_id, l_linenumber AS q, l_orderkey AS r, l_returnflag || l_linenumber AS query FROM lineitem"


@query(f"""WITH f AS ({FINDS}), e AS (SELECT stmt_id, pubmed_id, min((q, r)) AS at, ['A1'] AS own FROM f WHERE q <= 2 GROUP BY ALL),
one AS (SELECT stmt_id, pubmed_id, lower(query) AS low, min((q, r, query)) AS hit FROM f WHERE q > 1 GROUP BY ALL),
g AS (SELECT stmt_id, pubmed_id, list_sort(list(hit) FILTER (low <> 'a1')) AS l FROM one GROUP BY ALL)
SELECT e.stmt_id, e.pubmed_id, array_to_string(list_concat(own, coalesce(list_transform(l, lambda x: x[3]), [])), ',') AS queries FROM e JOIN g USING (stmt_id, pubmed_id)""")
def evidence_found_again(spark, d):
    """Lines as finds of parts: what the first two queries found is there, with one query, when all but the first are asked again."""
    (x,) = read_tables(spark, d, "lineitem")
    finds = x.select((F.col("l_orderkey") % 50).alias("stmt_id"), F.col("l_partkey").cast("string").alias("pubmed_id"), F.col("l_linenumber").alias("query_ord"), F.col("l_orderkey").alias("rank"), F.concat("l_returnflag", "l_linenumber").alias("query"))
    there = E.merge_found(finds.where("query_ord <= 2")).withColumn("queries", F.array(F.lit("A1")))
    again = E.found_again(there, finds.where("query_ord > 1"))
    return again.join(there.select("stmt_id", "ord", "pubmed_id"), ["stmt_id", "ord"]).select("stmt_id", "pubmed_id", F.array_join("queries", ",").alias("queries"))


@query(f"SELECT claim_id, chunk_id, round(s, 6) AS score, rank FROM ({TOP})")
def nearest_chunks(spark, d):
    """As top_chunks, by clusters on both sides, the way of claims too many to send."""
    e = read_tables(spark, d, "embeddings")[0].select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    found = nearest(e.where("id % 100 = 0"), e, 5)
    rank = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("rank", rank.cast("long")).withColumn("score", F.round("score", 6))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN x BETWEEN 0 AND 1 THEN x * 100 ELSE x END DESC NULLS LAST, o_orderkey) AS place
FROM (SELECT *, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 0.0 WHEN 2 THEN (o_orderkey % 100) / 100.0::DOUBLE ELSE (o_orderkey % 100)::DOUBLE END AS x FROM orders)""")
def display_order(spark, d):
    """Orders as their customer's evidence, with relevance as texts: no number, none, a share or a percentage."""
    k = F.col("o_orderkey")
    text = F.when(k % 6 == 0, "n/a").when(k % 6 == 1, F.lit(None).cast("string")).when(k % 6 == 2, ((k % 100) / 100).cast("string")).otherwise((k % 100).cast("string"))
    rows = read_tables(spark, d, "orders")[0].select("o_custkey", k.alias("ord"), text.alias("relevance"))
    return D.by_relevance(rows, "o_custkey").select(F.col("ord").alias("o_orderkey"), F.col("place").cast("long").alias("place"))


@query("SELECT o_orderkey, floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) / 3)::BIGINT AS batch FROM orders")
def order_batches(spark, d):
    return B.batched(read_tables(spark, d, "orders")[0], 3, ["o_orderdate", "o_orderkey"], "o_custkey").select("o_orderkey", F.col("batch").cast("long").alias("batch"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 4")
def capped_lines(spark, d):
    rows = read_tables(spark, d, "lineitem")[0].withColumn("price", -F.col("l_extendedprice"))
    return B.capped(rows, 4, ["price", "l_orderkey", "l_linenumber"], "l_suppkey").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def head_orders(spark, d):
    rows = read_tables(spark, d, "orders")[0].select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("low"))
    return B.head(rows, 25, "low", "o_orderkey").drop("low")


@query("""SELECT row_id, lang, claim, label FROM (SELECT c_custkey AS row_id, 'en' AS lang, trim(c_name) AS claim, c_nationkey AS label FROM customer UNION ALL SELECT c_custkey, 'de', trim(CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE c_mktsegment END), c_nationkey FROM customer) WHERE claim <> ''""")
def long_claims(spark, d):
    """Customers as records in two languages, whose second claim is blank in every fourth."""
    rows = read_tables(spark, d, "customer")[0].select("c_custkey", F.col("c_name").alias("en_claim"), F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(F.col("c_mktsegment")).alias("de_claim"), F.col("c_nationkey").alias("label"))
    return B.long_form(rows, "c_custkey", ["en", "de"])


@query("SELECT s_suppkey AS id, s_name AS statement, s_nationkey AS labels, NULL::VARCHAR AS note FROM supplier UNION ALL SELECT p_partkey, p_name, NULL, p_brand FROM part")
def stacked_tables(spark, d):
    """Labelled records over records without labels, as a trainer takes them."""
    s, p = read_tables(spark, d, "supplier", "part")
    one = B.for_training(s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("statement"), F.col("s_nationkey").alias("label")))
    two = B.for_training(p.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("statement"), F.col("p_brand").alias("note")))
    return B.stacked(one, two).withColumnRenamed("key", "id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def known_customers(spark, d):
    c, o = read_tables(spark, d, "customer", "orders")
    return B.known(c.select("c_custkey", "c_name"), o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""WITH t AS (SELECT o_orderkey, list(l_shipmode ORDER BY l_linenumber) AS l FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_returnflag || l_linestatus END AS l_shipmode FROM lineitem) GROUP BY 1),
u AS (SELECT o_orderkey, unnest(l) AS k FROM t), c AS (SELECT o_orderkey, k, count(*) AS n FROM u WHERE k IS NOT NULL GROUP BY ALL)
SELECT t.o_orderkey, coalesce(string_agg(k || '=' || n, ',' ORDER BY k), '') AS counts, coalesce(sum(n) FILTER (k = 'NO'), 0)::BIGINT AS n_no, coalesce(sum(n) FILTER (k = 'XX'), 0)::BIGINT AS n_xx FROM t LEFT JOIN c ON c.o_orderkey = t.o_orderkey GROUP BY 1""")
def flag_counts(spark, d):
    """Counts of an order's flags as a map, read with a default."""
    flag = F.when(F.col("l_linenumber") % 4 != 0, F.concat("l_returnflag", "l_linestatus"))
    lists = read_tables(spark, d, "lineitem")[0].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", flag.alias("k")))), lambda x: x["k"]).alias("l"))
    rows = lists.withColumn("m", C.counted(F.col("l")))
    said = F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return rows.select("o_orderkey", said.alias("counts"), C.count_of(F.col("m"), F.lit("NO")).cast("long").alias("n_no"), C.count_of(F.col("m"), F.lit("XX")).cast("long").alias("n_xx"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'nation=' || c_nationkey WHEN c_custkey % 5 = 1 THEN 'segment=' || c_mktsegment || ',nation=0' ELSE 'nation=0,segment=' || c_mktsegment END AS merged, CASE WHEN c_custkey % 5 > 1 THEN 'segment=' || c_mktsegment WHEN c_custkey % 5 = 1 THEN 'segment=' || c_mktsegment ELSE '' END AS less FROM customer""")
def merged_settings(spark, d):
    """Two maps of a customer's settings, of which the second stands; one may be null."""
    c = F.col("c_custkey")
    nation = F.when(c % 5 == 1, F.create_map(F.lit("nation"), F.lit("9"))).otherwise(F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string")))
    second = F.when(c % 5 == 1, F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.lit("0"))).when(c % 5 > 1, F.create_map(F.lit("nation"), F.lit("0"), F.lit("segment"), F.col("c_mktsegment")))
    m = C.merged_map(nation, second)
    said = lambda x: F.array_join(F.transform(F.map_entries(x), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return read_tables(spark, d, "customer")[0].select("c_custkey", said(m).alias("merged"), said(C.without_keys(m, "nation")).alias("less"))


@query("""SELECT e.l_orderkey, e.l_linenumber, p_name AS title FROM lineitem e LEFT JOIN (SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 = 0) ON p_partkey = l_partkey""")
def attached_details(spark, d):
    e, p = read_tables(spark, d, "lineitem", "part")
    rows = e.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("pubmed_id"))
    return E.attach_details(rows, p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("pubmed_id"), F.col("p_name").alias("title"))).drop("pubmed_id")


@query("""SELECT page_id, instr(p, '/reel/') > 0 OR instr(p, '/reels/') > 0 AS is_reel, trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1, 'is')) AS title FROM (SELECT *, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS p FROM pages)""")
def page_titles(spark, d):
    """What is read of a page: whether it's a reel, and its text, which here is its own title (the pages have no meta descriptions)."""
    return read_tables(spark, d, "pages")[0].select("page_id", D.is_reel(F.col("url")).alias("is_reel"), D.page_text(F.col("html")).alias("title"))


# --- expressions over whole columns ------------------------------------------------------

SUM_OF = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"


@query(f"""SELECT a.vec_id, round({SUM_OF.format('a.embedding', 'b.embedding')} / (sqrt({SUM_OF.format('a.embedding', 'a.embedding')}) * sqrt({SUM_OF.format('b.embedding', 'b.embedding')})), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def neighbour_cosines(spark, d):
    """Cosine of each vector and the next by id."""
    (e,) = read_tables(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("""SELECT vec_id, round(exp(e[1] - m) / t, 9) AS first_share, round(exp(e[8] - m) / t, 9) AS last_share, round(1 / (1 + exp(-e[1])), 9) AS first_sigmoid
FROM (SELECT *, list_sum(list_transform(e, lambda x: exp(x - m))) AS t FROM (SELECT vec_id, e, list_max(e) AS m FROM (SELECT vec_id, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS e FROM embeddings)))""")
def softmax_shares(spark, d):
    """Softmax over the first eight numbers of each vector, and the sigmoid of the first."""
    rows = read_tables(spark, d, "embeddings")[0].select("vec_id", F.slice("embedding", 1, 8).cast("array<double>").alias("e")).withColumn("s", V.softmax(F.col("e")))
    return rows.select("vec_id", F.round(F.get("s", 0), 9).alias("first_share"), F.round(F.get("s", 7), 9).alias("last_share"), F.round(V.sigmoid(F.get("e", 0)), 9).alias("first_sigmoid"))


@query("""SELECT o_custkey, arg_max(o_orderpriority, (total, -o_orderkey)) AS best FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE floor(o_totalprice / 10000) END AS total FROM orders) WHERE total IS NOT NULL GROUP BY 1
UNION ALL SELECT o_custkey, NULL FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 4 <> 0) = 0""")
def best_priorities(spark, d):
    """The priority of a customer's dearest order by steps of price, the first of equal ones; every fourth order has no price."""
    o = read_tables(spark, d, "orders")[0]
    pair = F.struct("o_orderkey", F.struct(F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderkey") % 4 != 0, F.floor(F.col("o_totalprice") / 10000)).alias("value")).alias("x"))
    lists = o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["x"]).alias("l"))
    return lists.select("o_custkey", C.best_of(F.col("l")).alias("best"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END::INTEGER AS label, ['true', 'uncertain', 'false', ''][o_orderkey % 4 + 1] AS verdict FROM orders""")
def verdict_labels(spark, d):
    """Verdicts as replies may spell them, as labels: the fourth is blank."""
    said = F.get(F.array(F.lit(" True"), F.lit("UNCERTAIN "), F.lit("false"), F.lit("  ")), (F.col("o_orderkey") % 4).cast("int"))
    return read_tables(spark, d, "orders")[0].select("o_orderkey", T.verdict_label(said).cast("int").alias("label"), T.normalised_verdict(said).alias("verdict"))


@query("""SELECT event_id, strftime(ts::TIMESTAMP, '%Y-%m-%dT%H:%M:%SZ') AS at, event_type || '_' || event_id || '_7_' || strftime(ts::TIMESTAMP, '%Y%m%d_%H%M%S_%f') AS run FROM events""")
def event_times(spark, d):
    ts = F.col("ts").cast("timestamp")
    return read_tables(spark, d, "events")[0].select("event_id", T.utc_text(ts).alias("at"), T.run_id(F.col("event_type"), F.col("event_id"), F.lit(7), ts).alias("run"))


@query("""SELECT l_orderkey, l_linenumber, greatest(0, least(x + w, 800) - greatest(x, 0)) * greatest(0, least(y + h, 600) - greatest(y, 0)) AS area
FROM (SELECT *, (l_partkey % 1000 - 100)::DOUBLE AS x, (l_suppkey % 800 - 100)::DOUBLE AS y, l_quantity::DOUBLE * 7 AS w, l_quantity::DOUBLE * 5 AS h FROM lineitem)""")
def visible_areas(spark, d):
    """Of rectangles that lie where a line's keys say, what a window of 800 by 600 shows."""
    x, y, q = (F.col("l_partkey") % 1000 - 100).cast("double"), (F.col("l_suppkey") % 800 - 100).cast("double"), F.col("l_quantity").cast("double")
    area = D.visible_area(x, y, x + q * 7, y + q * 5, F.lit(800.0), F.lit(600.0))
    return read_tables(spark, d, "lineitem")[0].select("l_orderkey", "l_linenumber", area.alias("area"))


@query("""SELECT event_id, repeat('   ', (event_id % 3)::INTEGER) || CASE WHEN event_id % 5 = 0 THEN '>> ' || upper(event_type) ELSE event_type END AS name, printf('%.4fs', (event_id % 1000) / 8.0::DOUBLE) AS duration,
CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 4 > 0 THEN (event_id % 4)::VARCHAR ELSE '-' END AS tokens FROM events""")
def log_rows(spark, d):
    """Events as entries of a run's log, as a report shows them."""
    i = F.col("event_id")
    name, duration, tokens = D.log_row(F.col("event_type"), (i % 3).cast("int"), i % 5 == 0, i % 4, (i % 1000) / 8)
    return read_tables(spark, d, "events")[0].select("event_id", name.alias("name"), duration.alias("duration"), tokens.alias("tokens"))
