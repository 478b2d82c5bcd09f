"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (one to three
characters, a word's edges included). A document's own most frequent n-grams are
compared with each profile: the distance sums how far each n-gram is out of place,
an absent one counting as the whole profile's length, and the nearest profile wins.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import give_back, own_name, table

#: N-grams in a profile, of a language and of a document.
PROFILE = 400
#: Labelled rows that a language's profile is fitted on, at most (about).
TRAIN_ROWS = 20_000
#: Tasks that count the training sample.
TRAIN_TASKS = 16
UNDETERMINED = "und"
#: Characters counted at a time; counts of the parts of a longer text are added.
PART = 1 << 20

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code point -> itself if a letter, else 0."""
    if not _letters:
        _letters.append(np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32))
    return _letters[0]


def _runs(sorted_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_codes):
        return sorted_codes, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], sorted_codes[1:] != sorted_codes[:-1])))
    return sorted_codes[at], np.diff(np.append(at, len(sorted_codes)))


def _add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first, n = _runs(codes)
    return first, np.add.reduceat(counts, np.cumsum(n) - n) if len(n) else counts


def gram_codes(text: str) -> np.ndarray:
    """The n-grams of a text, each as one integer: its characters in 21 bits each."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.concatenate(([0], letters()[points], [0])).astype(np.uint64)
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] != 0) | (chars[:-1] != 0)  # one edge between words
    c = chars[keep]
    shift = np.uint64(21)
    two = (c[:-1] << shift) | c[1:]
    three = (two[:-1] << shift) | c[2:]
    return np.concatenate((c[c != 0], two | np.uint64(1 << 62), three[c[1:-1] != 0] | np.uint64(1 << 63)))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of a whole text; parts of a very long one are cut between words."""
    parts, i = [], 0
    while i < len(text):
        j = min(len(text), i + PART)
        while j < len(text) and text[j].isalpha():
            j += 1
        codes = gram_codes(text[i:j])
        codes.sort()
        parts.append(_runs(codes))
        i = j
    return parts[0] if len(parts) == 1 else _add(parts or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))])


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams first; ties by code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:size]


class Profiles:
    def __init__(self, ranked: dict[str, np.ndarray], size: int = PROFILE):
        self.languages, self.size = sorted(ranked), size
        self.grams = np.unique(np.concatenate([*ranked.values(), np.zeros(0, np.uint64)]))
        self.ranks = np.full((len(self.languages), len(self.grams) + 1), -1, np.int64)
        for row, lang in enumerate(self.languages):
            self.ranks[row, np.searchsorted(self.grams, ranked[lang])] = np.arange(len(ranked[lang]))

    def nearest(self, text: str) -> tuple[str, float]:
        """(language, 1 less the distance's share of the greatest); ties by name."""
        mine = top(*gram_counts(text), self.size)
        if not len(mine) or not self.languages:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.grams, mine)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != mine)] = len(self.grams)
        ranks = self.ranks[:, at]
        out = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(mine))))
        far = out.sum(axis=1)
        best = int(np.argmin(far))
        return self.languages[best], float(1 - far[best] / (self.size * len(mine)))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def fit(docs: DataFrame, size: int = PROFILE, rows: int = TRAIN_ROWS) -> Profiles:
    """Profiles from the text and lang of labelled documents.

    docs has lang, text and key; rows with null lang or text don't count. A language
    with more than `rows` documents is fitted on a share of them, chosen by a hash of
    key, so that about `rows` remain; that bounds the cost of fitting, never
    that of predicting.
    """
    docs = docs.where("lang is not null and text is not null")
    n = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    share = F.create_map(*[F.lit(x) for lang, c in n.items() for x in (lang, min(1.0, rows / c))]) if n else None
    if share is None:
        return Profiles({}, size)
    sample = docs.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = defaultdict(list)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[lang].append(gram_counts(text))
                if len(total[lang]) >= 256:
                    total[lang] = [_add(total[lang])]
        for lang, parts in total.items():
            codes, counts = _add(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts, pa.int64())],
                names=["lang", "gram", "n"],
            )

    counts = (
        sample.select("lang", "text").repartition(TRAIN_TASKS).mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    # The most frequent of every 32nd part of the n-grams are few rows, and hold the most frequent of all.
    rank = F.row_number().over(_by("lang", "part"))
    few = counts.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(32))).where("n > 0").withColumn("r", rank).where(F.col("r") <= size)
    found: dict[str, list] = defaultdict(list)
    for r in few.select("lang", "gram", "n").collect():
        found[r[0]].append((r[1], r[2]))
    return Profiles({lang: top(np.array([g for g, _ in x], np.int64).view(np.uint64), np.array([c for _, c in x]), size) for lang, x in found.items()}, size)


def _by(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(F.desc("n"), "gram")


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score (0 to 1), or other names, after its own columns.

    A text that is null or has no letter is `und` with a score of 0; so is any text
    where no language was learned. Of equally near languages the first by name wins. A
    text of any length counts whole; an empty table gives no rows; columns of docs that
    have one of the two names are replaced, all others stay. Rows that repeat have
    a row each, with the same values.
    """
    held = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("struct<lang:string, score:double>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        profiles = held.value
        for texts in batches:
            yield pd.DataFrame([profiles.nearest(t or "") for t in texts], columns=["lang", "score"])
            give_back()

    (found,) = own_name("found")
    judged = docs.withColumn(found, nearest(F.col(f"`{text}`")))
    return judged.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names], F.col(found)["lang"].alias(names[0]), F.col(found)["score"].alias(names[1]))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~F.coalesce(held_out(), F.lit(False))).select("lang", "text", F.col("doc_id").alias("key"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; profiles from those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    profiles = fit(training_rows(docs))
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return predict(rows, profiles).drop("text")
