"""Line dedup by a log-template tree.

Lines are parsed as a log parser does: fields that vary (tokens with a digit) become
wildcards, and a tree of fixed depth leads by token count and leading tokens to a
leaf, where a line joins the most similar template, whose differing tokens become
wildcards too, or begins a new one. A template that recurs in MIN_DOCS documents is
boilerplate: its first line (least doc_id, then line) stays, all others go. Templates of
long lines can be asked to recur from fewer documents on (long_docs).

Most leaves hold one line, so hashes alone are counted first, and the text of lines
moves only where a leaf holds several. A leaf is parsed whole, whatever its size: blocks
of tokens lead to the few templates that can be alike, so not all are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice
from operator import eq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import drop_tables, own_name, table, written

WILDCARD = "<*>"
#: Leading tokens that choose a leaf, and the least tokens of a line that can be dropped.
DEPTH, MIN_TOKENS = 4, 4
#: Share of equal tokens for a line to join a template; documents for a template to recur.
ALIKE, MIN_DOCS = 0.7, 3
#: Lines of more tokens than this are long.
LONG_TOKENS = 50
#: Templates of a leaf from which on they are found by blocks of tokens; rows given out at a time.
INDEXED, ROWS = 16, 10_000


def masked(line: Column) -> Column:
    """The line's tokens in one string with single spaces, wildcards for those with a digit."""
    tokens = F.filter(F.split(F.lower(line), r"[ \t\x0B\f\r]+"), lambda t: t != "")
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(WILDCARD)).otherwise(t))


def parsed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, tokens of each line that can be dropped."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "text_key", "line_no", masked(F.col("line")).alias("tokens")).where(F.size("tokens") >= MIN_TOKENS)


def line_hash() -> Column:
    return F.xxhash64(F.array_join("tokens", " ")).alias("line_hash")


def leaf_hash() -> Column:
    return F.xxhash64(F.size("tokens"), F.array_join(F.slice("tokens", 1, DEPTH), " ")).alias("leaf")


class Leaf:
    """The templates of one leaf, whose lines have the same number of tokens and the same DEPTH first.

    A line that differs from a template in m tokens at most equals it in one of m + 1
    blocks of tokens at least, so only templates that share a block are compared.
    """

    def __init__(self, alike: float = ALIKE):
        self.alike, self.templates, self.members = alike, [], []
        self.blocks: list[slice] = []
        self.index: dict[tuple, dict[int, None]] = {}

    def _keys(self, tokens: list[str]) -> list[tuple]:
        return [(i, *tokens[b]) for i, b in enumerate(self.blocks)]

    def _candidates(self, tokens: list[str]) -> list[int] | range:
        if len(self.templates) < INDEXED:
            return range(len(self.templates))
        if not self.blocks:
            n = len(tokens)
            count = n - math.ceil(self.alike * n) + 1
            first = DEPTH if n - DEPTH >= count else 0
            ends = [first + (n - first) * i // count for i in range(count + 1)] if n >= count > 0 else [0, 0]
            self.blocks = [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]
            for k, t in enumerate(self.templates):
                for key in self._keys(t):
                    self.index.setdefault(key, {})[k] = None
        return sorted({k for key in self._keys(tokens) for k in self.index.get(key, ())})

    def add(self, key: int, tokens: list[str]) -> None:
        best, most = -1, -1
        for k in self._candidates(tokens):
            same = sum(map(eq, self.templates[k], tokens))
            if same > most:
                best, most = k, same
        if best < 0 or most < self.alike * len(tokens):
            best = len(self.templates)
            self.templates.append(list(tokens))
            self.members.append([])
            for block in self._keys(tokens):
                self.index.setdefault(block, {})[best] = None
        elif most < len(tokens):
            t = self.templates[best]
            before = self._keys(t)
            t[:] = [x if x == y else WILDCARD for x, y in zip(t, tokens, strict=True)]
            for old, new in zip(before, self._keys(t), strict=True):
                if old != new:
                    del self.index[old][best]
                    self.index.setdefault(new, {})[best] = None
        self.members[best].append(key)

    def rows(self) -> Iterator[tuple[int, str]]:
        for t, keys in zip(self.templates, self.members, strict=True):
            name = " ".join(t)
            yield from ((key, name) for key in keys)


def templates(lines: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(leaf, line_hash, template) for different lines (leaf, line_hash, line), each leaf by itself, in order of the line."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def named() -> Iterator[tuple[int, int, str]]:
            at, leaf = None, Leaf(alike)
            for batch in batches:
                for key, line_hash, line in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if key != at:
                        yield from ((at, *r) for r in leaf.rows())
                        at, leaf = key, Leaf(alike)
                    leaf.add(line_hash, line.split(" "))
            yield from ((at, *r) for r in leaf.rows())

        rows = named()
        while some := list(islice(rows, ROWS)):
            leaf, line_hash, name = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(line_hash, pa.int64()), pa.array(name, pa.string())], names=["leaf", "line_hash", "template"])

    return lines.repartition("leaf").sortWithinPartitions("leaf", "line").select("leaf", "line_hash", "line").mapInArrow(parse, "leaf long, line_hash long, template string")


def without(lines: Column, bounds: Column) -> Column:
    """The lines between the places in bounds, one after the other."""
    gaps = F.sequence(F.lit(1), F.size(bounds) - 1)
    return F.flatten(F.transform(gaps, lambda i: F.slice(lines, F.get(bounds, i - 1) + 2, F.get(bounds, i) - F.get(bounds, i - 1) - 1)))


def dedup_lines(docs: DataFrame, alike: float = ALIKE, min_docs: int = MIN_DOCS, long_docs: int | None = None, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with text less its recurring lines, and n_lines and n_dropped at the end.

    A template recurs in min_docs documents or more; one of lines of more than
    LONG_TOKENS tokens in long_docs or more, if given. Lines end at a newline; those of
    fewer than MIN_TOKENS tokens stay. A null text stays null with 0 lines, an empty one
    has one empty line; a line of any length is parsed whole. Rows with the same doc_id and
    text count as one document and lose the same lines; a null doc_id comes first. An empty
    table gives an empty one. Columns of docs are kept, whatever their names, but its own
    n_lines and n_dropped (the names in `counts`) are replaced.

    A line is told by two 64-bit hashes, of all its tokens and of its leaf.
    """
    rows = docs.select("doc_id", "text")
    lines = written(parsed_lines(rows).select("doc_id", "text_key", "line_no", line_hash(), leaf_hash(), (F.size("tokens") > LONG_TOKENS).alias("long")).distinct(), "lines")
    # different lines, each with one document that has it, and leaves with several
    at = F.min(F.struct("doc_id", "text_key", "line_no")).alias("at")
    different = written(lines.groupBy("leaf", "line_hash").agg(at), "different-lines")
    leaves = written(different.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1").select("leaf"), "leaves")
    # the text of such a line is read from that document
    holder = different.join(leaves, "leaf").select("leaf", "line_hash", F.col("at.doc_id").alias("d"), F.col("at.text_key").alias("k"), F.col("at.line_no").alias("i"))
    wanted = holder.groupBy("d", "k").agg(F.collect_list(F.struct("i", "leaf", "line_hash")).alias("wanted"))
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    read = (
        keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
        .select(F.split("text", "\n").alias("all"), F.explode("wanted").alias("w"))
        .select("w.leaf", "w.line_hash", F.array_join(masked(F.element_at("all", F.col("w.i") + 1)), " ").alias("line")).distinct()
    )
    named = written(templates(read, alike).select("leaf", "line_hash", F.xxhash64("template").alias("named")), "templates")
    placed = lines.join(named, ["leaf", "line_hash"], "left").select("doc_id", "text_key", "line_no", "leaf", F.coalesce("named", "line_hash").alias("template"), "long")
    each = placed.groupBy("leaf", "template", "long", "doc_id", "text_key").agg(F.min("line_no").alias("line_no"))
    often = F.col("n_docs") >= (min_docs if long_docs is None else F.when(F.col("long"), min(long_docs, min_docs)).otherwise(min_docs))
    recurring = written(
        each.groupBy("leaf", "template", "long").agg(F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "text_key", "line_no")).alias("first"))
        .where(often).select("leaf", "template", "first"),
        "recurring",
    )
    drops = placed.join(recurring, ["leaf", "template"]).where(~F.struct("doc_id", "text_key", "line_no").eqNullSafe(F.col("first")))
    of, key, drop, doc, own, parts, n = own_name("of", "key", "drop", "doc", "own", "parts", "n")
    drops = written(drops.groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(of)).agg(F.array_sort(F.collect_list("line_no")).alias(drop)), "drops")
    drop_tables(lines, different, leaves, named, recurring)
    names = [c for c in docs.columns if c not in counts]
    joined = docs.select(*[F.col(f"`{c}`") for c in names], F.col("doc_id").alias(own), F.xxhash64("text").alias(key)).join(drops, F.col(own).eqNullSafe(F.col(doc)) & (F.col(key) == F.col(of)), "left")
    cut = joined.withColumn(parts, F.when(F.col(drop).isNotNull(), F.split("text", "\n")))
    # the places dropped, between the line before the first and the one after the last
    cut = cut.withColumn(n, F.coalesce(F.size(F.split("text", "\n")), F.lit(0))).withColumn(drop, F.concat(F.array(F.lit(-1)), F.col(drop), F.array(F.size(parts))))
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(without(F.col(parts), F.col(drop)), "\n"))
    return cut.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names],
        F.greatest(F.col(n), F.lit(0)).cast("long").alias(counts[0]), F.coalesce(F.size(drop) - 2, F.lit(0)).cast("long").alias(counts[1]),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that recur in three documents, or two if of over 50 tokens, less their first."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), long_docs=2)
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))
