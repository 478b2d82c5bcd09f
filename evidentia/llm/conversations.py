"""Repair of conversations' structure by cheapest edits, over a graph of tight arcs.

A node is a place between rows and a state of the form that roles must have. Arcs are
edits: Keep, Rerole and Delete pass a row, Insert stays. Least costs to every node from the
start and from every node to the end tell the tight arcs, those on some cheapest path; a
set of nodes goes along them, at each step by the least letter that any of its nodes has.

Rows without their texts are sorted by conversation and turn in ranges, so one long
conversation spreads over tasks, and packed to pieces of PIECE rows at most. Of a
conversation in several pieces each piece first gives its least costs from state to state;
adding these up along the few pieces gives every piece the costs before and after it. Texts
are moved once, to be written out in order: rows pass by one at a time, so even a
conversation that is one task's whole input takes no more memory than its edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import drop_tables, renamed, table, written

#: Different rows of a conversation that are worked on together.
PIECE = 4096
#: Costs of edits, and of a row that stays though its text ends in the middle.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of roles' initials that make up (s?(ua)+)?: start, after s, after u, after a.
STATES = range(4)
#: Where the role that must come next leads, and that role.
NEXT, NEXT_ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: What it costs to end in a state, by inserts alone.
ENDS = [0, 2 * INSERT, INSERT, 0]
FAR = 1 << 60
LEGAL = ("su", "ua", "au")
SPACE = r"\x20\x09-\x0D"
#: Bytes of rows sent to a Python worker at a time; rows that go back at a time.
BATCH, ROWS = "8m", 8192

Row = tuple[str, bool, bool]  # initial, must go, ends in the middle


def arcs(row: Row, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of the edits that pass a row."""
    initial, forced, late = row
    found = [("D", DELETE, state)]
    if not forced:
        more = TRUNCATED if late else 0
        if (state, initial) in KEPT:
            found.append(("K", KEEP + more, KEPT[state, initial]))
        found.append(("R", REROLE + more, NEXT[state]))
    return found


def inserted(costs: list[int]) -> list[int]:
    """Least costs from the start with inserts at one place; no cheapest path has three."""
    out = list(costs)
    for _ in range(3):
        for q in STATES:
            out[NEXT[q]] = min(out[NEXT[q]], out[q] + INSERT)
    return out


def forwards(rows: list[Row], before: list[int]) -> list[list[int]]:
    """Least costs of the nodes ahead of each row, inserts there included, and those after the last row without."""
    out, costs = [], before
    for row in rows:
        costs = inserted(costs)
        out.append(costs)
        after = [FAR] * 4
        for q in STATES:
            if costs[q] < FAR:
                for _, cost, to in arcs(row, q):
                    after[to] = min(after[to], costs[q] + cost)
        costs = after
    return [*out, costs]


def backwards(rows: list[Row], after: list[int]) -> list[list[int]]:
    """Least costs to the end, from the nodes ahead of each row and those after the last."""
    out = [after]
    for row in reversed(rows):
        costs = [min(out[-1][to] + cost for _, cost, to in arcs(row, q)) for q in STATES]
        for _ in range(3):
            for q in STATES:
                costs[q] = min(costs[q], costs[NEXT[q]] + INSERT)
        out.append(costs)
    return out[::-1]


def least_edits(rows: list[Row], before: list[int], after: list[int], start: int, last: bool) -> tuple[list[str], list[str], int] | None:
    """Of a piece (letters by row, roles made by row, state at the end) from a state at its start; none where no
    cheapest path has it. before and after are least costs at the piece's ends; inserts at its end
    belong to the next piece, but to the last piece's last row.

    A role made is u or a for an insert or a rerole, = for a kept row, - for a deleted one.
    """
    ahead, behind = forwards(rows, before), backwards(rows, after)
    if last:
        ahead[-1] = inserted(ahead[-1])
    whole = min(a + b for a, b in zip(ahead[-1], behind[-1], strict=True))
    if before[start] + behind[0][start] != whole:
        return None
    letters, roles, at, nodes = [], [], 0, {start}
    own, made = "", ""
    while True:
        if at == len(rows) and not (last and all(behind[at][q] for q in nodes)):
            break
        tight: dict[str, set[int]] = {}
        for q in nodes:
            cost, to = ahead[at][q], NEXT[q]
            if cost + INSERT + behind[at][to] == whole:
                tight.setdefault("I", set()).add(to)
            for letter, more, to in arcs(rows[at], q) if at < len(rows) else ():
                if cost + more + behind[at + 1][to] == whole:
                    tight.setdefault(letter, set()).add(to)
        letter = min(tight)
        role = NEXT_ROLE[min(nodes)][0] if letter in "IR" else "=" if letter == "K" else "-"
        own, made, nodes = own + letter, made + role, tight[letter]
        if letter != "I":
            letters.append(own)
            roles.append(made)
            own, made, at = "", "", at + 1
    if own and letters:  # inserts after the last row of all
        letters[-1], roles[-1] = letters[-1] + own, roles[-1] + made
    return letters, roles, min(nodes)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that each row's crc32 says, nulls as one space."""
    rows = renamed(conversations, conv_id="conv_id", turn="turn", role="role", text="text").withColumn("turn", F.col("turn").cast("long"))
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("copy", F.explode(copies)).drop("kind", "copy")


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def different_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, copies, blank, late, forced: rows alike in all are one, with their number.

    forced: it must go, being blank or having an equal role and text in an earlier turn.
    """
    text = F.col("text")
    rows = rows.select("conv_id", "turn", "role", _key(text).alias("digest"), (~text.rlike(f"[^{SPACE}]")).alias("blank"), (~text.rlike(rf"[.!?][{SPACE}]*\z")).alias("late"))
    keys = ["conv_id", "turn", "role", "digest"]
    some = written(rows.groupBy(*keys).agg(F.count("*").alias("copies"), F.first("blank").alias("blank"), F.first("late").alias("late")), "repair-rows")
    at = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    first = some.where("not blank").groupBy("conv_id", "role", "digest").agg(F.min(at)["turn"].alias("turn")).select(*[F.col(k).alias(f"first_{k}") for k in keys])
    same = F.col("conv_id").eqNullSafe(F.col("first_conv_id"))
    for k in keys[1:]:
        same &= F.col(k).eqNullSafe(F.col(f"first_{k}"))
    return some.join(first, same, "left").withColumn("forced", F.col("first_digest").isNull()).drop(*[f"first_{k}" for k in keys])


PIECE_ROW = "struct<turn:bigint,role:string,digest:binary,copies:bigint,blank:boolean,late:boolean,forced:boolean>"


def _rows_of(packed: list[dict]) -> list[Row]:
    return [(r["role"][:1], r["forced"], r["late"]) for r in packed]


def _batches(rows: Iterator[tuple], schema: pa.Schema, packed: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of rows, of which the field at packed holds rows in turn."""
    some, size = [], 0
    for row in chain(rows, [None]):
        if some and (row is None or size >= ROWS):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], f.type) for i, f in enumerate(schema)], schema=schema)
            some, size = [], 0
        if row is not None:
            some.append(row)
            size += 1 if packed is None else len(row[packed])


def _schema(text: str, spark: SparkSession) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(text))


def pieces(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """(conv_id, at, whole, rows, costs): runs of a conversation's rows in order, `at` in order over all.

    costs are the least ones from each state to each, row by row, of pieces that may not be whole
    conversations: those at a task's ends, and of more rows than size.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, at bigint, whole boolean, rows array<{PIECE_ROW}>, costs array<bigint>"
    schema = _schema(out, rows.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs() -> Iterator[tuple[object, int, list[dict], bool]]:
            """Runs, and whether the conversation goes on after a run by size."""
            conv, at, own = None, None, []
            for batch in batches:
                names = batch.schema.names[2:]
                for c, n, *values in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                    if own and (c != conv or len(own) == size):
                        yield conv, at, own, c == conv
                        own = []
                    if not own:
                        conv, at = c, n
                    own.append(dict(zip(names, values, strict=True)))
            if own:
                yield conv, at, own, False

        def packed() -> Iterator[tuple]:
            first, cut, held = True, False, None
            for conv, at, own, goes_on in runs():
                if held:
                    yield held
                whole = not (first or cut or goes_on)
                held = (conv, at, whole, own, None if whole else costs_of(own))
                first, cut = False, goes_on
            if held:  # the last of a task may go on in the next
                yield (*held[:2], False, held[3], held[4] or costs_of(held[3]))

        yield from _batches(packed(), schema, 3)

    ordered = rows.orderBy("conv_id", "turn", "role", "digest").select("conv_id", F.monotonically_increasing_id().alias("at"), "turn", "role", "digest", "copies", "blank", "late", "forced")
    return ordered.mapInArrow(pack, out)


def costs_of(packed: list[dict]) -> list[int]:
    rows = _rows_of(packed)
    return [c for q in STATES for c in forwards(rows, [0 if p == q else FAR for p in STATES])[-1]]


def joined_costs(costs: list[list[int]]) -> list[tuple[list[int], list[int]]]:
    """(before, after) of each of a conversation's pieces in turn from their costs."""
    before = [[0, FAR, FAR, FAR]]
    for c in costs:
        before.append([min(FAR, *(before[-1][p] + c[4 * p + q] for p in STATES)) for q in STATES])
    after = [ENDS]
    for c in reversed(costs[1:]):
        after.append([min(FAR, *(c[4 * p + q] + after[-1][q] for q in STATES)) for p in STATES])
    return list(zip(before, after[::-1], strict=False))


def _by_conversation(df: DataFrame, work: Callable[[list[dict]], list[tuple]], out: str) -> DataFrame:
    """The rows of cut pieces, a conversation's in order, through work: a row for a piece, without its rows."""
    schema = _schema(out, df.sparkSession)

    def one(part: pa.Table) -> pa.Table:
        found = work(sorted(part.to_pylist(), key=lambda r: r["at"]))
        return pa.Table.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(schema)], schema=schema)

    return df.groupBy("conv_id").applyInArrow(one, out)


def edits(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """rows (see different_rows) with letters and roles, the cheapest edits by row."""
    packed = written(pieces(rows, size), "repair-pieces", BATCH)
    kind = rows.schema["conv_id"].dataType.simpleString()
    cut = packed.where("not whole")

    def bounds(own: list[dict]) -> list[tuple]:
        found = joined_costs([r["costs"] for r in own])
        return [(r["at"], *b, i == len(own) - 1) for i, (r, b) in enumerate(zip(own, found, strict=True))]

    known = _by_conversation(cut.select("conv_id", "at", "costs"), bounds, "piece bigint, before array<bigint>, after array<bigint>, last boolean")
    out = f"conv_id {kind}, at bigint, whole boolean, rows array<{PIECE_ROW}>, paths array<struct<start:int,stop:int,letters:array<string>,roles:array<string>>>"
    schema = _schema(out, rows.sparkSession)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for batch in batches:
                for conv, at, whole, own, before, after, last in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    before, after, last = (before, after, last) if before else ([0, FAR, FAR, FAR], ENDS, True)
                    lines, paths = _rows_of(own), []
                    for q in [0] if whole else STATES:
                        if path := least_edits(lines, before, after, q, last):
                            paths.append({"start": q, "stop": path[2], "letters": path[0], "roles": path[1]})
                    yield conv, at, whole, own, paths

        yield from _batches(found(), schema, 3)

    walked = written(packed.drop("costs").join(known, F.col("at") == F.col("piece"), "left").drop("piece").mapInArrow(walk, out), "repair-paths", BATCH)

    def starts(own: list[dict]) -> list[tuple]:
        state, found = 0, []
        for r in own:
            found.append((r["at"], state))
            state = next(p["stop"] for p in r["ends"] if p["start"] == state)
        return found

    ends = F.transform("paths", lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"))).alias("ends")
    begun = _by_conversation(walked.where("not whole").select("conv_id", "at", ends), starts, "piece bigint, state int")
    path = F.get(F.filter("paths", lambda p: p["start"] == F.coalesce("state", F.lit(0))), 0)
    chosen = walked.join(begun, F.col("at") == F.col("piece"), "left").select("conv_id", "rows", path.alias("path"))
    found = chosen.select("conv_id", F.explode(F.arrays_zip("rows", F.col("path.letters").alias("letters"), F.col("path.roles").alias("roles"))).alias("x")).select("conv_id", "x.rows.*", "x.letters", "x.roles")
    found = written(found, "repair-edits")
    drop_tables(packed, walked)
    return found


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class Conversation:
    """One conversation's figures, from its different rows in order and their texts."""

    def __init__(self):
        self.turns, self.first, self.last = 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.initial, self.audit, self.hash, self.lines = None, [], hashlib.sha256(), 0
        self.waiting: str | None = None  # the role of a row that stays, until its text comes
        self.after: list[str] = []  # roles inserted behind it

    def row(self, turn, role: str, copies: int, blank: bool, late: bool, forced: bool, letters: str, roles: str) -> None:
        self.line_of_waiting("")
        if turn is not None and turn != self.last:
            self.turns, self.first, self.last = self.turns + 1, turn if self.first is None else self.first, turn
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - (not forced)
            self.truncated += late and not forced
        self.illegal += self.initial is not None and self.initial + role[:1] not in LEGAL
        self.illegal += (copies - 1) * (role[:1] * 2 not in LEGAL)
        self.initial = role[:1]
        done = max(letters.find(x) for x in "DKR") + 1
        self.audit += [letters[:done], "D" * (copies - 1), letters[done:]]
        price = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
        self.cost += sum(price[x] for x in letters) + DELETE * (copies - 1) + (TRUNCATED if late and "D" not in letters else 0)
        for letter, made in zip(letters, roles, strict=True):
            name = {"u": "user", "a": "assistant", "=": role}.get(made)
            if letter == "I":
                self.line(name, "")
            elif letter != "D":
                self.waiting, self.after = name, [{"u": "user", "a": "assistant"}[x] for x in roles[done:]]
                return

    def text(self, text: str) -> None:
        """The text of the row before; of equal rows the first counts."""
        self.line_of_waiting(text)

    def line_of_waiting(self, text: str) -> None:
        if self.waiting is not None:
            self.line(self.waiting, text)
            for role in self.after:
                self.line(role, "")
            self.waiting = None

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) * bool(self.lines)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1

    def result(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, int(self.truncated), int(self.illegal), self.cost, "".join(self.audit), self.hash.hexdigest()


def repaired(conversations: DataFrame, size: int = PIECE) -> DataFrame:
    """conv_id and the figures of each conversation after damage and repair, a row for each conv_id, null ones too.

    Rows are in order of turn, null first; of equal turns by role and the text's sha256. Null
    roles and texts are one space; an empty role has no initial. Rows alike in all columns
    are copies: the first stays, if any. A conversation whose rows are all dropped has zeros, an
    empty audit and the hash of nothing. An empty table gives no rows. Texts and conversations
    may have any length; other columns are ignored, whatever their names.
    """
    rows = damaged(conversations)
    plan = edits(different_rows(rows), size)
    kind = plan.schema["conv_id"].dataType.simpleString()
    keys = ["conv_id", "turn", "role", "digest"]
    said = plan.select(*keys, F.lit(0).alias("kind"), "copies", "blank", "late", "forced", "letters", "roles", F.lit(None).cast("string").alias("text"))
    none = {"copies": "bigint", "blank": "boolean", "late": "boolean", "forced": "boolean", "letters": "string", "roles": "string"}
    texts = rows.withColumn("digest", _key(F.col("text"))).select(*keys, F.lit(1).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], "text")
    out = f"conv_id {kind}, {RESULT}"
    schema = _schema(out, conversations.sparkSession)

    def write_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            conv, at, own = None, None, None
            for batch in batches:
                for c, turn, role, digest, is_text, *values, text in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                    if own is None or c != conv:
                        if own:
                            yield conv, *own.result()
                        conv, own = c, Conversation()
                    if is_text:
                        own.text(text)
                    else:
                        own.row(turn, role, *values)
            if own:
                own.line_of_waiting("")
                yield conv, *own.result()

        yield from _batches(found(), schema)

    ordered = said.unionByName(texts).repartition("conv_id").sortWithinPartitions(*keys, "kind")
    whole = written(ordered.mapInArrow(write_out, out), "repair-result", BATCH)
    ids = renamed(conversations, id="conv_id").distinct()
    zero = {c.split()[0]: F.lit(0).cast("long") for c in RESULT.split(", ")} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return ids.join(whole, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(F.col("id").alias("conv_id"), *[F.coalesce(c, x).alias(c) for c, x in zero.items()])


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
