"""Readers of claims, replies and article lists; writers that replace or add by key."""

from __future__ import annotations

import ast
import json
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITEM = "id long, statement string, label int"


def read_tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def _item(line: str) -> tuple[int | None, str, int] | None:
    line = line.strip()
    if not line:
        return None
    if line[0] == "{":
        r = json.loads(line)
        return r.get("id"), r.get("statement", r.get("text")), int(r["label"])
    a, b = line.split("\t")
    if a.isdigit() == b.isdigit():
        raise ValueError(f"which field is the label? {line!r}")
    return None, *((b, int(a)) if a.isdigit() else (a, int(b)))


def items_of_text(text: str) -> list[tuple[int, str, int]]:
    """(id, statement, label) of a dataset file: a JSON list, or lines of JSON or of two
    tab-separated fields in either order. Missing ids are numbered from 1."""
    if text.lstrip()[:1] == "[":
        found = [(r.get("id"), r.get("statement", r.get("text")), int(r["label"])) for r in json.loads(text)]
    else:
        found = [x for x in map(_item, text.splitlines()) if x]
    if any(s is None for _, s, _ in found):
        raise ValueError("an item has no statement")
    return [(i if i is not None else n, s, label) for n, (i, s, label) in enumerate(found, 1)]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Items (id, statement, label) of files with a line each: JSON objects, or two fields
    with a tab between, one of them digits, the label. Files are split over tasks; an item
    without id has its place among the items that aren't blank. Bad lines raise when run.
    """
    line = F.trim("value")
    rows = spark.read.text(path).where(line != "").withColumn("at", F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")))
    json = F.from_json(line, "id long, statement string, text string, label int")
    parts = F.split("value", "\t")
    digits = lambda i: F.trim(F.get(parts, i)).rlike(r"^\d+$")
    bad = F.concat(F.lit("which field is the label? "), F.col("value"))
    fields = F.when((F.size(parts) == 2) & (digits(0) != digits(1)), F.when(digits(0), F.struct(F.lit(None).cast("long").alias("id"), F.trim(F.get(parts, 1)).alias("statement"), F.trim(F.get(parts, 0)).cast("int").alias("label"))).otherwise(
        F.struct(F.lit(None).cast("long").alias("id"), F.trim(F.get(parts, 0)).alias("statement"), F.trim(F.get(parts, 1)).cast("int").alias("label"))
    )).otherwise(F.raise_error(bad).cast("struct<id:bigint,statement:string,label:int>"))
    item = F.when(line.startswith("{"), F.struct(json["id"].alias("id"), F.coalesce(json["statement"], json["text"]).alias("statement"), json["label"].alias("label"))).otherwise(fields)
    return _numbered(rows.select("at", item.alias("x")).select("at", "x.*"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Items of files that are one JSON list each; such a file can't be split, so a task reads it."""
    rows = spark.read.schema("id long, statement string, text string, label int").option("multiLine", True).json(path)
    rows = rows.withColumn("at", F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")))
    return _numbered(rows.select("at", "id", F.coalesce("statement", "text").alias("statement"), "label"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Missing ids are places from 1: counted in each partition, and from the partitions' sizes."""
    part, own = F.spark_partition_id(), Window.partitionBy("part").orderBy("at")
    rows = rows.withColumn("part", part)
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"), F.min("at").alias("first"))
    # a row for each partition: the one task that adds them up reads no more
    sizes = sizes.select("part", (F.sum("size").over(Window.orderBy("first")) - F.col("size")).alias("before"))
    placed = rows.withColumn("n", F.row_number().over(own)).join(sizes, "part")
    said = F.when(F.col("statement").isNull() | F.col("label").isNull(), F.raise_error(F.lit("an item has no statement or label")).cast("string")).otherwise(F.col("statement"))
    return placed.select(F.coalesce("id", F.col("before") + F.col("n")).alias("id"), said.alias("statement"), "label")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of dataset files of one kind: lists of JSON, or lines."""
    first = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value")).first()
    return read_list(spark, path) if first and first[0].startswith("[") else read_lines(spark, path)


def read_claims_csv(spark: SparkSession, path: str, lang: str = "en") -> DataFrame:
    """(row_id, lang, claim, label) of a CSV file with {lang}_claim and label, without blank claims.

    A missing claim reads nan and stays, as pandas would have it. Raises on missing columns.
    """
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    for c in (f"{lang}_claim", "label"):
        if c not in df.columns:
            raise ValueError(f"no column {c}")
    claim = F.trim(F.coalesce(f"{lang}_claim", F.lit("nan")))
    return df.select(F.monotonically_increasing_id().alias("row_id"), F.lit(lang).alias("lang"), claim.alias("claim"), F.col("label").try_cast("int").alias("label")).where("claim <> ''")


def read_done(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a checkpoint, or none where nothing is written yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def records_of_text(text: str) -> list[dict]:
    """Records of JSON, JSON lines or a Python literal, out of a "data" wrapper; they need statement and id."""
    try:
        got = json.loads(text)
    except ValueError:
        try:
            got = [json.loads(x) for x in text.splitlines() if x.strip()]
        except ValueError:
            got = ast.literal_eval(text)
    got = got["data"] if isinstance(got, dict) and "data" in got else got
    if any("statement" not in r or "id" not in r for r in got):
        raise ValueError("a record needs statement and id")
    return got


RECORD = "path string, id string, statement string, label string, record string, error string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of files in any of the encodings of records_of_text(), a row for each: (path, id,
    statement, label, record as JSON, error). A file that is in none of them, or has a record without
    statement or id, is one row with the reason as error."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = lambda x: None if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = records_of_text(content.decode("utf-8-sig"))
                    rows = [(name, text(r["id"]), text(r["statement"]), text(r.get("label")), json.dumps(r, ensure_ascii=False), None) for r in found]
                except (ValueError, SyntaxError, TypeError, KeyError, AttributeError) as e:
                    rows = [(name, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(6)], names=[c.split()[0] for c in RECORD.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(parse, RECORD)


def found_ids(body: Column) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(body, "$.esearchresult.idlist"), "array<string>"), F.array().cast("array<string>"))


Article = tuple[str, str | None, str | None]


def parsed_articles(xml: str) -> list[Article]:
    """(pubmed_id, title, abstract) of the articles in a text of XML; none of a text that isn't XML.

    A title ends at its first markup. An abstract's parts gather the text around and in their
    markup; a part's label leads it, blank parts are left out, a placeholder is no abstract.
    """
    try:
        root = ElementTree.fromstring(xml)
    except (ElementTree.ParseError, ValueError, TypeError):
        return []
    found = []
    for node in [root] if root.tag == "PubmedArticle" else root.iter("PubmedArticle"):
        key = node.find(".//MedlineCitation/PMID")
        if key is None or key.text is None:
            continue
        title = node.findtext(".//Article/ArticleTitle") or None
        parts = node.findall(".//Abstract/AbstractText") or node.findall(".//OtherAbstract/AbstractText")
        said = []
        for part in parts:
            if text := "".join(part.itertext()).strip():
                label = part.get("Label") or part.get("NlmCategory")
                said.append(f"{label}: {text}" if label else text)
        whole = " ".join(said).strip()
        placeholder = whole.lower().startswith("abstract available from")
        found.append((key.text, title.strip() if title else None, None if placeholder else whole or None))
    return found


ARTICLE = "pubmed_id string, title string, abstract string"


def articles_of(bodies: DataFrame) -> DataFrame:
    """(pubmed_id, title, abstract) of the articles in texts of XML (the first column), parsed batch by batch."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                rows = parsed_articles(text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["pubmed_id", "title", "abstract"])

    return bodies.mapInArrow(parse, ARTICLE)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """The articles of XML files of any size: a file is split at the ends of articles."""
    end = "</PubmedArticle>"
    parts = spark.read.option("lineSep", end).text(path).where(F.instr("value", "<PubmedArticle>") > 0)
    return articles_of(parts.select(F.concat(F.expr("substring(value, instr(value, '<PubmedArticle>'))"), F.lit(end)).alias("xml")))


def article(xml: Column) -> Column:
    """struct(pubmed_id, title, abstract) of the first article in XML: see parsed_articles()."""

    @F.pandas_udf(ARTICLE)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [next(iter(parsed_articles(t)), (None, None, None)) for t in texts]
            yield pd.DataFrame(rows, columns=["pubmed_id", "title", "abstract"], dtype=object)

    return parse(xml)


def read_pdfs(spark: SparkSession, path: str, pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(path, file_hash, page, text) of PDF files; pages turns a file's bytes into the texts of its
    pages, file by file in Arrow batches. A file that it fails on has one row, without page and text."""
    if pages is None:
        raise NotImplementedError("no PDF reader is installed; pass pages")

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(content: bytes) -> list[str] | None:
            try:
                return list(pages(content))
            except Exception:  # noqa: BLE001  a file that can't be read is a row that says so
                return None

        for contents in batches:
            yield contents.map(one)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path)
    texts = files.select("path", F.sha2("content", 256).alias("file_hash"), split("content").alias("texts"))
    each = texts.select("path", "file_hash", F.posexplode_outer("texts").alias("page", "text"))
    return each.withColumn("page", F.col("page") + 1)


def not_done(items: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    return items.join(done.select(*keys).distinct(), list(keys), "left_anti")


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of new, and those of old whose key isn't in it."""
    return not_done(old, new, *keys).unionByName(new, allowMissingColumns=True)


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(at))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
