"""Mixing sources to target weights by a time-varying curriculum.

A source's weight is a schedule over training time 0 to 1, straight between its knots.
Its integral up to a time, scaled to the source's target, is the number of words that the
mix has asked of the source by then. A source's documents stand in one random order, again
and again for each repeat; the time at which demand reaches a copy's first word, found by
inverting the integral, is that copy's position in training. Sorting all copies by position
in ranges gives the training order. DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm.common import own_name, renamed, table, written

#: Weights of sources in order of name, repeating, and how often a document is taken at most.
WEIGHTS, REPEATS = (5, 2, 1), 3
#: Knots (time, height) of the weights in that order: the heaviest sources fade, the lightest grow.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)))
#: Hex digits of a hash that deal a source to parts, ordered each by itself.
PART_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def segments(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float]]:
    """(time, length, height, height at the end, share of the integral before) between knots."""
    if any(h < 0 for _, h in knots) or [t for t, _ in knots] != sorted(t for t, _ in knots) or knots[0][0] != 0 or knots[-1][0] != 1:
        raise ValueError("knots lead from time 0 to 1 with heights of 0 or more")
    pairs = [(t, u - t, a, b) for (t, a), (u, b) in zip(knots, knots[1:], strict=False) if u > t]
    whole = sum(d * (a + b) / 2 for _, d, a, b in pairs)
    if not whole:
        raise ValueError("a schedule is 0 throughout")
    out, before = [], 0.0
    for t, d, a, b in pairs:
        out.append((t, d, a / whole, b / whole, before))
        before += d * (a + b) / 2 / whole
    return out


def time_of(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time by which this share (0 to 1) of a schedule's integral has passed."""
    found = None
    for t, d, a, b, before in reversed(segments(knots)):
        y = F.greatest(F.lit(0.0), share - before)
        # the root of a s + (b - a) s^2 / (2 d) = y, in the form that stands b = a and a = 0
        s = F.coalesce(F.try_divide(2.0 * y, a + F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + 2.0 * (b - a) * y / d))), F.lit(0.0))
        at = F.least(F.lit(1.0), t + F.least(F.lit(d), s))
        found = at if found is None else F.when(share >= first, found).otherwise(at)  # noqa: F821
        first = before
    return found


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, their place from 0 by code points, null last.

    Sorted in ranges; a range's rows are numbered where they are, and what stands before it
    is added, so no task has more than its range, or a row for each range.
    """
    ordered = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    ordered = written(ordered, "mix-sources")
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    sizes = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = ordered.withColumn("part", part).join(sizes, "part")
    return placed.withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "before")


def targets(sources: DataFrame, repeats: int = REPEATS, budget: int | None = None) -> DataFrame:
    """sources (source, source_size, weight) with target: shares of the budget (all words) by
    weight, none over repeats times its size; the excess goes to the others by weight until
    none is above. Each round adds up the sources still open; it ends when none was capped.
    """
    cap = F.col("source_size") * repeats
    total = F.sum("source_size") if budget is None else F.lit(budget)
    free, all_words = sources.agg(F.sum("weight"), total).first()
    level, held = (all_words or 0) / (free or 1), -1
    while free:
        # capped once, a source stays capped: the level only rises
        over = cap < F.col("weight") * F.lit(level)
        n, words, free = sources.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == held or not free:
            break
        held, level = n, (all_words - (words or 0)) / free
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))))


def curriculum(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules=SCHEDULES, repeats: int = REPEATS, budget: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(plan, order): a row for each document, and the copies that the mix takes, in training order.

    plan has row (unique), doc_id, source, size (words), source_size, target, copies: an array
    of (epoch, position, words). order has row, doc_id, source, epoch, position, words, sorted
    by position in ranges, written. A source's words in the mix are its target, rounded, so
    the last copy of a source may be cut: its first words are taken. weights and schedules go
    to sources by name in turn, null (a source of its own) last. A null text has size 0, and
    what has no words is in no order. Rows that repeat are documents of their own; those
    alike in all of doc_id, source and text are told by number. An empty table gives empty
    ones; of columns that docs may have only doc_id, source and text are read, so names can't
    clash; texts of any length count whole. A source of any size is dealt to 4096 parts by hash,
    so that ranking and adding up need no more than a part, and 4096 rows for a source.
    """
    rows = renamed(docs, doc_id="doc_id", source="source", text="text")
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed))))
    rows = rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), F.xxhash64("text").alias("same"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.substring("key", 1, PART_DIGITS)), "mix-sizes")
    parts = written(rows.groupBy("source", "part").agg(F.sum("size").alias("words")), "mix-parts")
    sources = ranked(parts.groupBy("source").agg(F.sum("words").alias("source_size")))
    turn = lambda n: F.pmod(F.col("rank"), F.lit(n))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn(len(weights)) + 1).cast("int"))
    sources = written(sources.select("source", "source_size", weight.alias("weight"), turn(len(schedules)).alias("schedule")), "mix-weights")
    sources = targets(sources, repeats, budget)
    s, p = own_name("s", "p")
    own = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    before = parts.select(F.col("source").alias(s), F.col("part").alias(p), (F.sum("words").over(own) - F.col("words")).alias("before"))
    before = before.join(sources, F.col(s).eqNullSafe(F.col("source"))).drop("source")
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "same").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("inside", F.sum("size").over(inside) - F.col("size")).join(before, F.col("source").eqNullSafe(F.col(s)) & (F.col("part") == F.col(p)))
    start = (F.col("before") + F.col("inside")).alias("start")
    placed = placed.select("row", "doc_id", "source", "size", "source_size", "target", "schedule", start, F.floor(F.col("target") + 0.5).cast("long").alias("quota"))

    def copy(epoch: Column) -> Column:
        first = epoch * F.col("source_size") + F.col("start")
        share = F.try_divide(first.cast("double"), F.col("quota").cast("double"))
        position = time_of(share, schedules[0])
        for i, knots in enumerate(schedules[1:], 1):
            position = F.when(F.col("schedule") == i, time_of(share, knots)).otherwise(position)
        words = F.least(F.col("size"), F.col("quota") - first)
        return F.struct(epoch.cast("int").alias("epoch"), position.alias("position"), words.alias("words"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda e: copy(e.cast("long"))), lambda c: c["words"] > 0)
    plan = written(placed.select("row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies")), "mix-plan")
    order = plan.select("row", "doc_id", "source", F.explode("copies").alias("c")).select("row", "doc_id", "source", "c.*")
    return plan, written(order.orderBy("position", "source", "doc_id", "epoch", "row"), "mix-order")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its words in the training order, and the first and last position it is met at."""
    plan, order = curriculum(table(spark, sf_dir, "documents"))
    met = order.groupBy("row").agg(F.sum("words").alias("taken"), F.count("*").alias("copies"), F.round(F.min("position"), 9).alias("first_position"), F.round(F.max("position"), 9).alias("last_position"))
    rows = plan.drop("copies").join(met, "row", "left")
    return rows.select("doc_id", "size", "source_size", "target", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("taken", "copies")], "first_position", "last_position")


def _time_sql(share: str, knots) -> str:
    out = None
    for t, d, a, b, before in reversed(segments(knots)):
        y = f"greatest(0.0::DOUBLE, {share} - {before!r}::DOUBLE)"
        s = f"coalesce(2.0::DOUBLE * {y} / nullif({a!r}::DOUBLE + sqrt(greatest(0.0::DOUBLE, {a * a!r}::DOUBLE + {2.0 * (b - a)!r}::DOUBLE * {y} / {d!r}::DOUBLE)), 0), 0.0)"
        at = f"least(1.0::DOUBLE, {t!r}::DOUBLE + least({d!r}::DOUBLE, {s}))"
        out = at if out is None else f"CASE WHEN {share} >= {first!r}::DOUBLE THEN {out} ELSE {at} END"  # noqa: F821
        first = before
    return out


#: In closed form: sources by size over weight; the level is that of the first k capped ones
#: that leaves the next one under its cap.
OP13_SQL = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  md5(coalesce(doc_id::VARCHAR, '') || ':0') AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS rank FROM d GROUP BY source),
w AS (SELECT *, {list(WEIGHTS)}[rank % {len(WEIGHTS)} + 1]::BIGINT AS weight, rank % {len(SCHEDULES)} AS schedule, {REPEATS} * source_size AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
l AS (SELECT arg_min((total - capped)::DOUBLE / free::DOUBLE, cap::DOUBLE / weight) FILTER (cap::DOUBLE >= weight * ((total - capped)::DOUBLE / free::DOUBLE)) AS level FROM o),
t AS (SELECT o.*, least(cap::DOUBLE, weight * level) AS target, floor(least(cap::DOUBLE, weight * level) + 0.5)::BIGINT AS quota FROM o, l),
p AS (SELECT doc_id, size, source_size, target, quota, schedule, (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (e * source_size + start)::DOUBLE / nullif(quota, 0)::DOUBLE AS share, least(size, quota - e * source_size - start) AS words FROM p, (SELECT unnest(range({REPEATS})) AS e)),
f AS (SELECT *, {"CASE schedule " + " ".join(f"WHEN {i} THEN {_time_sql('share', k)}" for i, k in enumerate(SCHEDULES)) + " END"} AS position FROM c)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target, coalesce(sum(words) FILTER (words > 0), 0)::BIGINT AS taken, count(*) FILTER (words > 0) AS copies,
 round(min(position) FILTER (words > 0), 9) AS first_position, round(max(position) FILTER (words > 0), 9) AS last_position FROM f GROUP BY doc_id"""
