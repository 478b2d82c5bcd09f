"""Evidence: retrieval, merging, weights, filters, penalty-weighted scores, verdicts."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidentia.functions.vectors import round2
from evidentia.operators.nearest import nearest
from evidentia.plans.barrier import shared_folder

#: Publication type patterns and weights; the greatest that matches counts.
WEIGHTS = (
    (r"meta[- ]analysis", 0.90),
    (r"systematic review", 0.85),
    (r"practice guideline", 0.85),
    (r"randomi[sz]ed controlled trial", 0.80),
    (r"clinical trial,\s*phase iii", 0.78),
    (r"controlled clinical trial", 0.75),
    (r"pragmatic clinical trial", 0.75),
    (r"adaptive clinical trial", 0.75),
    (r"equivalence trial", 0.75),
    (r"clinical trial,\s*phase ii", 0.70),
    (r"clinical trial,\s*phase iv", 0.70),
    (r"clinical trial,\s*phase i", 0.60),
    (r"clinical trial protocol", 0.25),
    (r"clinical trial", 0.70),
    (r"observational stud(?:y|ies)", 0.60),
    (r"clinical stud(?:y|ies)", 0.60),
    (r"consensus development conference,\s*nih", 0.60),
    (r"consensus development conference", 0.60),
    (r"guideline", 0.60),
    (r"comparative stud(?:y|ies)", 0.60),
    (r"multicenter stud(?:y|ies)", 0.60),
    (r"evaluation stud(?:y|ies)", 0.60),
    (r"validation stud(?:y|ies)", 0.55),
    (r"journal article", 0.50),
    (r"review", 0.55),
    (r"case reports?", 0.40),
    (r"technical reports?", 0.40),
    (r"preprints?", 0.40),
    (r"meeting abstracts?", 0.30),
    (r"editorial", 0.20),
    (r"comment", 0.20),
    (r"letter", 0.20),
    (r"news", 0.15),
    (r"expression of concern", 0.05),
    (r"duplicate publication", 0.05),
    (r"retraction of publication", 0.00),
    (r"retracted publication", 0.00),
)
#: Bytes of claims' vectors that go to every task at most.
CLAIM_BYTES = 8 << 20


def publication_weight(types: Column, default: float = 0.4) -> Column:
    """The greatest weight of any type; the default where none is over 0. Patterns of one weight
    are looked for together, from the greatest weight down to the first that is found."""
    by_weight: dict[float, list[str]] = defaultdict(list)
    for pattern, w in WEIGHTS:
        by_weight[w].append(pattern)

    def one(t: Column) -> Column:
        t = F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))
        found = F.when(t.isNull(), F.lit(None).cast("double"))
        for w in sorted(by_weight, reverse=True):
            found = found.when(t.rlike(rf"\b(?:{'|'.join(by_weight[w])})\b"), w)
        return found.otherwise(0.0)

    best = F.array_max(F.transform(types, one))
    return F.when(best > 0, best).otherwise(default)


def top_similar(claims: DataFrame, chunks: DataFrame, k: int = 5, least: float = 0.25) -> DataFrame:
    """The k chunks (chunk_id, chunk_vec) most similar to each claim (claim_id, claim_vec), then those of `least` or more.

    Claims are written once, and their size read. Up to CLAIM_BYTES of vectors go to every task,
    which multiplies its chunks with them and passes on the k best of each claim; more than
    that are joined with the chunks by clusters (see nearest.py), with equal results. A chunk with
    the claim's own id doesn't count, nor do vectors that are null, hold nulls or are of another length;
    of equal scores the least chunk_id comes first.
    """
    k, spark = k if k > 0 else 5, claims.sparkSession
    claims = claims.select("claim_id", F.col("claim_vec").cast("array<double>").alias("claim_vec"))
    path = f"{shared_folder(spark)}/claims/{uuid.uuid4().hex}"
    claims.write.parquet(path)
    claims = spark.read.schema(claims.schema).parquet(path).where("claim_vec is not null")
    size = claims.agg(F.sum(F.size("claim_vec") * 8 + 16)).first()[0] or 0
    w = Window.partitionBy("claim_id").orderBy(F.desc("score"), "chunk_id")
    if size > CLAIM_BYTES:
        vectors = lambda df, i, v: df.select(F.col(i).alias("id"), F.col(v).cast("array<double>").alias("v")).where(f"{i} is not null and size(v) > 0 and not exists(v, x -> x is null)")
        found = nearest(vectors(claims, "claim_id", "claim_vec"), vectors(chunks, "chunk_id", "chunk_vec"), k, least)
    else:
        claim, chunk = claims.schema["claim_id"].dataType, chunks.schema["chunk_id"].dataType
        held = spark.sparkContext.broadcast(claims.toArrow())
        rows = chunks.select("chunk_id", F.col("chunk_vec").cast("array<double>").alias("v"))
        found = rows.mapInArrow(_best(held, k, to_arrow_type(claim), to_arrow_type(chunk)), f"claim_id {claim.simpleString()}, chunk_id {chunk.simpleString()}, score double")
    return found.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("score") >= least))


def _best(held, k: int, claim: pa.DataType, chunk_type: pa.DataType):
    """Of a task's chunks, the k best of each claim in the broadcast table."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = held.value.column(0).to_pylist(), held.value.column(1).to_pylist()
        by_size = {n: [i for i, v in enumerate(vectors) if len(v) == n and None not in v] for n in {len(v) for v in vectors} - {0}}
        asked = {n: np.array([vectors[i] for i in rows], float).reshape(len(rows), n) for n, rows in by_size.items()}
        tops: dict[int, list[tuple]] = defaultdict(list)
        for batch in batches:
            chunk, lists = batch.column(0).to_pylist(), batch.column(1)
            length = np.asarray(pc.fill_null(pc.list_value_length(lists), -1))
            for n, rows in by_size.items():
                at = np.flatnonzero(length == n)
                at = at[[lists[int(j)].values.null_count == 0 for j in at]] if lists.values.null_count else at
                if not len(at):
                    continue
                x = np.asarray(lists.take(pa.array(at)).flatten(), float).reshape(len(at), n)
                for j in range(0, len(at), 2048):
                    scores = np.einsum("cd,qd->qc", x[j : j + 2048], asked[n])  # equal vectors have equal scores
                    for q, own in zip(rows, scores, strict=True):
                        few = np.flatnonzero(own >= np.partition(own, -k - 1)[-k - 1]) if len(own) > k + 1 else range(len(own))
                        tops[q] = sorted([*tops[q], *((-own[c], chunk[at[j + c]]) for c in few if chunk[at[j + c]] != ids[q] and chunk[at[j + c]] is not None)])[:k]
        rows = [(ids[q], c, -s) for q, top in tops.items() for s, c in top]
        kinds = (claim, chunk_type, pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["claim_id", "chunk_id", "score"])

    return best


def _find() -> Column:
    """A find's place, query after query; what is null comes last in each, as in SQL."""
    return F.struct(*[c for n in ("query_ord", "rank", "query") for c in (F.col(n).isNull().alias(f"no_{n}"), F.col(n))])


def merge_found(found: DataFrame) -> DataFrame:
    """Evidence per (stmt_id, pubmed_id) of finds (stmt_id, query_ord, rank, pubmed_id, query): its
    place by first find and id, and the queries that found it again, each once whatever its case."""
    one = found.groupBy("stmt_id", "pubmed_id", F.lower("query").alias("low")).agg(F.min(_find()).alias("at"))
    first = one.groupBy("stmt_id", "pubmed_id").agg(F.sort_array(F.collect_list("at")).alias("all"))
    w = Window.partitionBy("stmt_id").orderBy("at", F.asc_nulls_last("pubmed_id"))
    return first.withColumn("at", F.col("all")[0]).select("stmt_id", "pubmed_id", (F.row_number().over(w) - 1).alias("ord"), F.transform(F.slice("all", 2, F.size("all")), lambda s: s["query"]).alias("queries"))


def found_again(evidence: DataFrame, found: DataFrame) -> DataFrame:
    """(stmt_id, ord, queries) of evidence (stmt_id, ord, pubmed_id, queries) that finds (see
    merge_found) found again: its queries, and after them those of the finds that it doesn't have
    yet, each once whatever its case, in order of query and place. Of equal ids in a statement the
    first in order counts."""
    first = evidence.where("pubmed_id is not null").groupBy("stmt_id", "pubmed_id").agg(F.min(F.struct("ord", F.coalesce("queries", F.array().cast("array<string>")).alias("queries"))).alias("own"))
    one = found.groupBy("stmt_id", "pubmed_id", F.lower("query").alias("low")).agg(F.min(_find()).alias("at"))
    more = one.groupBy("stmt_id", "pubmed_id").agg(F.transform(F.array_sort(F.collect_list("at")), lambda s: s["query"]).alias("more"))
    had = F.transform(F.col("own.queries"), F.lower)
    return first.join(more, ["stmt_id", "pubmed_id"]).select("stmt_id", F.col("own.ord").alias("ord"), F.concat("own.queries", F.filter("more", lambda q: ~F.array_contains(had, F.lower(q)))).alias("queries"))


def attach_details(evidence: DataFrame, details: DataFrame) -> DataFrame:
    """Details by pubmed_id; unknown ids change nothing."""
    return evidence.join(details, "pubmed_id", "left")


def min_relevance(evidence: DataFrame, least: float | None = 0.7) -> DataFrame:
    return evidence if least is None else evidence.where(F.coalesce("relevance", F.lit(0.0)) >= least)


def top_by_relevance(evidence: DataFrame, m: int) -> DataFrame:
    """Evidence of each statement with its rank and whether it's among the m most relevant."""
    w = Window.partitionBy(*[k for k in ("run_id", "stmt_id") if k in evidence.columns]).orderBy(F.desc(F.coalesce("relevance", F.lit(0.0))), "ord")
    return evidence.withColumn("rank", F.row_number().over(w)).withColumn("chosen", F.col("rank") <= m)


def penalty_mean(score: Column, threshold: float = 0.3, penalty: float = 3.0) -> Column:
    """Mean of scores, those under the threshold counting `penalty` times; 0 if there are none."""
    w = F.when(score.isNull(), None).when(score < threshold, penalty).otherwise(1.0)
    return round2(F.coalesce(F.try_divide(F.sum(score * w), F.sum(w)), F.lit(0.0)))


def certainty(score: Column, gamma: float = 1.0, eps: float = 1e-6) -> tuple[Column, Column]:
    """(truth, certainty): the direction of scores weighted by how far they are from a half."""
    d = 2 * (score - 0.5)
    w = F.greatest(F.lit(eps), F.pow(F.abs(d), gamma))
    return 0.5 + 0.5 * F.sum(d * w) / F.sum(w), F.avg(F.abs(d))


def rule_verdict(relevance: Column, weight: Column, stance: Column, p: Column, high_rel: float = 0.7, high_w: float = 0.6, many: int = 2, against: int = 0) -> Column:
    """A verdict by rule over one statement's evidence: strong refutations (more than `against`)
    make it false, `many` strong supports true, else it's uncertain. No model's verdict."""
    strong = (relevance >= high_rel) & (weight >= high_w) & (p >= 0.7)
    no, yes = F.count_if(strong & (stance == "Refutes")), F.count_if(strong & (stance == "Supports"))
    return F.when(no > against, "false").when(yes >= many, "true").otherwise("uncertain")


def dedup_evidence(evidence: DataFrame) -> DataFrame:
    """One row per (stmt_id, key), key the first of pubmed_id, doi, url, title; the heaviest stays."""
    key = F.coalesce(*[F.when(F.trim(c) == "", None).otherwise(F.lower(F.trim(c))) for c in ("pubmed_id", "doi", "url", "title")], F.concat(F.lit("#"), F.col("ord").cast("string")))
    w = Window.partitionBy("stmt_id", "key").orderBy(F.desc("weight"), "ord")
    return evidence.withColumn("key", key).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def counts_by_source(evidence: DataFrame, *keys: str) -> DataFrame:
    """total and by_source (a map) of each key; a missing source counts as Unknown."""
    each = evidence.groupBy(*keys, F.coalesce("source_type", F.lit("Unknown")).alias("source")).agg(F.count("*").alias("n"))
    return each.groupBy(*keys).agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("by_source"))


def papers_and_chunks(by_source: Column) -> tuple[Column, Column]:
    """(papers, chunks) of a map of counts: retrieved chunks, and all other sources; null of null."""
    others = F.aggregate(F.map_values(F.map_filter(by_source, lambda k, v: k != "RAG")), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when(by_source.isNotNull(), others), F.when(by_source.isNotNull(), F.coalesce(F.try_element_at(by_source, F.lit("RAG")), F.lit(0)).cast("long"))


def prompt_lines(evidence: DataFrame, line: Column, *keys: str) -> DataFrame:
    """The evidence of each key in one text, the most relevant last; without relevance counts as 0."""
    at = F.struct(F.coalesce("relevance", F.lit(0.0)).alias("r"), "ord", line.alias("line"))
    return evidence.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda x: x["line"]), "\n").alias("lines"))
