"""An index of passages: documents (doc_id, source_path, file_hash, added_at, embed_model,
dim) and chunks (chunk_id, doc_id, pages_json, text, embedding)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import document_key, page_numbers, utc_text


def index_rows(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id, source_path, pages, text, embedding of each chunk with a document. Raises, when
    run, on an embedding whose length isn't its document's dim."""
    rows = chunks.join(documents.select("doc_id", "source_path", "dim"), "doc_id")
    wrong = F.concat(F.lit("embedding of another length than the index has: "), F.col("chunk_id"))
    right = F.when(F.size("embedding") == F.col("dim"), F.col("embedding")).otherwise(F.raise_error(wrong).cast(chunks.schema["embedding"].dataType))
    pages = page_numbers(F.col("pages_json")) if "pages_json" in chunks.columns else F.col("pages")
    return rows.select("chunk_id", "source_path", pages.alias("pages"), "text", right.alias("embedding"))


def index_model(documents: DataFrame) -> tuple[str, int]:
    """(model, dim) of an index; raises if it's empty."""
    row = documents.select("embed_model", "dim").orderBy("doc_id").first()
    if row is None:
        raise ValueError("the index has no documents")
    return row[0], row[1]


def new_documents(files: DataFrame, model: str, dim: int, at: Column | None = None) -> DataFrame:
    """Documents of files (path, file_hash), with the key that both make."""
    at = F.current_timestamp() if at is None else at
    return files.select(
        document_key(F.col("path"), F.col("file_hash")).alias("doc_id"), F.col("path").alias("source_path"), "file_hash", utc_text(at).alias("added_at"),
        F.lit(model).alias("embed_model"), F.lit(dim).alias("dim"),
    )


def to_index(documents: DataFrame, old: DataFrame) -> DataFrame:
    """Documents that aren't in the index yet."""
    return documents.join(old.select("doc_id"), "doc_id", "left_anti")


def upsert_index(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of both. A document that is there stays with its chunks, unless
    forced: then the new one replaces both. A changed file has another key, so its old rows stay."""
    (documents, chunks), (more, parts) = old, new
    if force:
        documents, chunks = documents.join(more.select("doc_id"), "doc_id", "left_anti"), chunks.join(more.select("doc_id"), "doc_id", "left_anti")
    else:
        more, parts = to_index(more, documents), parts.join(documents.select("doc_id"), "doc_id", "left_anti")
    return documents.unionByName(more, allowMissingColumns=True), chunks.unionByName(parts, allowMissingColumns=True)
