"""Conversation repair, ranked search and mixing against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from evidentia.llm import conversations, lexical_search, mixing
from evidentia.llm.common import table

SPACE = " \t\n\x0b\x0c\r"
COST = {"K": 0, "R": 1, "D": 2, "I": 5}


def all_scripts(rows, most=2):
    """(cost, audit, roles) of every script with at most `most` inserts at a place."""
    inserts = [[(("I" * n), p) for p in product("ua", repeat=n)] for n in range(most + 1)]
    inserts = [x for xs in inserts for x in xs]

    def of(row):
        initial, forced, late = row
        more = 5 * late
        return [("D", 2, "")] if forced else [("D", 2, ""), ("K", more, initial), ("R", 1 + more, "u"), ("R", 1 + more, "a")]

    for gaps in product(inserts, repeat=len(rows) + 1):
        for own in product(*map(of, rows)):
            audit = gaps[0][0] + "".join(o[0] + g[0] for o, g in zip(own, gaps[1:], strict=True))
            roles = "".join(gaps[0][1]) + "".join(o[2] + "".join(g[1]) for o, g in zip(own, gaps[1:], strict=True))
            if re.fullmatch("(s?(ua)+)?", roles):
                yield sum(o[1] for o in own) + 5 * audit.count("I"), audit, roles


def test_least_edits_equal_all_scripts():
    rng = random.Random(4)
    for n in (1, 2, 2, 3, 3, 3):
        for _ in range(4):
            rows = [(rng.choice("suau?"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
            cost, audit, _ = min(all_scripts(rows, 2 if n < 3 else 1))
            letters, roles, _ = conversations.least_edits(rows, [0] + [conversations.FAR] * 3, conversations.ENDS, 0, True)
            assert "".join(letters) == audit, rows
            made = "".join(r[0] if x == "=" else "" if x == "-" else x for r, xs in zip([r for r, y in zip(rows, roles, strict=True) for _ in [0]], roles, strict=True) for x in xs)
            assert re.fullmatch("(s?(ua)+)?", made)
            assert sum(COST[x] for x in audit) + 5 * sum(r[2] and "D" not in t for r, t in zip(rows, letters, strict=True)) == cost


def test_a_table_of_inserts_is_reached(monkeypatch):
    """With dear deletes and reroles the cheapest edits insert, also at the end and between pieces."""
    monkeypatch.setattr(conversations, "DELETE", 20)
    monkeypatch.setattr(conversations, "REROLE", 20)
    rows = [("u", False, False), ("u", False, True), ("a", False, False), ("u", False, False)]
    got = conversations.least_edits(rows, [0] + [conversations.FAR] * 3, conversations.ENDS, 0, True)
    assert "".join(got[0]) == "KIKKKI" and "".join(got[1]) == "=a===a" and got[2] == 3
    for cut in (1, 2, 3):
        parts = [rows[:cut], rows[cut:]]
        costs = [[c for q in range(4) for c in conversations.forwards(p, [0 if x == q else conversations.FAR for x in range(4)])[-1]] for p in parts]
        bounds = conversations.joined_costs(costs)
        first = conversations.least_edits(parts[0], *bounds[0], 0, False)
        second = conversations.least_edits(parts[1], *bounds[1], first[2], True)
        assert first[0] + second[0] == got[0] and first[1] + second[1] == got[1]


def best_script(rows):
    """(cost, audit, roles by letter): the least of each node, row by row, states told by the text of roles so far."""
    nodes = {"": (0, "", ())}

    def state(r):
        return re.sub("(ua)+", "ua", r)

    def grow(nodes):
        for _ in range(3):
            for s, (c, a, m) in list(nodes.items()):
                for x in "ua":
                    if re.fullmatch("s?(ua)*u?", s + x):
                        new = (c + 5, a + "I", (*m, x))
                        t = state(s + x)
                        nodes[t] = min(nodes.get(t, new), new)
        return nodes

    for initial, forced, late in rows:
        nodes, after = grow(nodes), {}
        for s, (c, a, m) in nodes.items():
            options = [("D", 2, "", "-")]
            if not forced:
                options += [("K", 5 * late, initial, "="), *(("R", 1 + 5 * late, x, x) for x in "ua")]
            for letter, cost, role, made in options:
                if not role and letter != "D":
                    continue
                if re.fullmatch("s?(ua)*u?", s + role):
                    new, t = (c + cost, a + letter, (*m, made)), state(s + role)
                    after[t] = min(after.get(t, new), new)
        nodes = after
    nodes = grow(nodes)
    return min(v for s, v in nodes.items() if re.fullmatch("(s?(ua)+)?", s))


def expected_repair(rows):
    groups = defaultdict(list)
    one = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        groups[conv]
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        groups[conv] += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = {t for t, _, _ in own if t is not None}
        seen, rules, faults = set(), [], Counter()
        for _, role, text in own:
            blank, dup = not text.strip(SPACE), (role, text) in seen
            seen.add((role, text))
            late = not blank and text.rstrip(SPACE)[-1] not in ".!?"
            faults["blank" if blank else "duplicate" if dup else "truncated" if late else "fine"] += 1
            rules.append((role[:1], blank or dup, late))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rules, rules[1:], strict=False))
        cost, audit, made = best_script(rules)
        left, lines = iter(own), []
        for letter, role in zip(audit, made, strict=True):
            _, r, text = (None, None, "") if letter == "I" else next(left)
            if letter != "D":
                lines.append(f"{r if role == '=' else {'u': 'user', 'a': 'assistant'}[role]}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest)
    return out


def check_repair(spark, rows, size=conversations.PIECE):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for extra in ("digest", "copies", "kind", "at", "id", "first_turn"):
        df = df.withColumn(extra, F.lit(7))
    found = conversations.repaired(df, size).collect()
    want = expected_repair(rows)
    assert len(found) == len(want)
    assert {r[0]: tuple(r)[1:] for r in found} == want


def test_repair_of_the_table_equals_plain_loops(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = expected_repair(rows)
    found = conversations.op11_conversation_repair(spark, sf).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == want and len(found) == len(want)
    assert sum("R" in v[6] for v in want.values()) and sum("D" in v[6] for v in want.values())


def test_repair_of_odd_rows_and_of_long_conversations_in_pieces(spark):
    odd = [
        (None, 1, "user", "Hi."), (None, None, "assistant", "A?"), (1, None, None, None), (1, None, "user", "x."), (1, 2, "user", "x."), (1, 2, "user", "x."), (1, 5, "assistant", "y!\n\t "), (2, 3, "", "b."),
        (2, 4, "tool", "c"), (3, 0, "system", "Only."), (4, 0, "user", "é" * 100_000 + "."), (4, 1, "assistant", ""), (5, 7, "system", "S."), (5, 8, "user", "q?"), (5, 8, "user", "other?"), (5, 9, "assistant", "r."),
    ]
    odd += [(6, 1, "user", "Same.")] * 40 + [(6, 2, "assistant", " ")] * 30 + [(6, 3, "user", "Same.")] * 5
    rng = random.Random(2)
    odd += [(10 + i % 3 // 2, t, rng.choice(["user", "assistant", "user", "assistant", "system", "xx"]), rng.choice(["yes", "yes.", f"no {t}.", f"{t}?", f"z {t}", ""])) for t in range(150) for i in range(3)]
    odd += [(i, t, rng.choice(["user", "assistant"]), f"{t}.") for i in range(100, 108) for t in range(4)]
    check_repair(spark, odd)
    for size in (1, 7):
        check_repair(spark, odd, size)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repaired(empty).count() == 0


def expected_search(docs, items, top=50):
    words = lambda t: re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rows = [(i, Counter(words(t))) for i, t in docs]
    rows = [(i, c) for i, c in rows if c]
    total, length = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(words(text))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c in rows:
            m = 100 - 50 + 50 * sum(c.values()) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


ODD = [(1, None), (2, ""), (3, " ... "), (4, "alpha Beta ÉTÉ"), (None, "alpha beta"), (6, "alpha alpha été gamma delta " * 3), (6, "alpha alpha été gamma delta " * 3), (7, "ÉTÉ x"), (-8, "alpha"), (9, "w " * 50_000 + "beta"), (10, "beta" * 9000)]
ASKED = [(1, "Alpha beta"), (1, "gamma"), (2, None), (3, "!!"), (4, "nowhere"), (None, "été Été"), (5, "beta" * 9000 + " alpha")]


def searched(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "terms": F.lit("x"), "times": F.lit(2)})
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(3))
    return sorted([tuple(r) for r in lexical_search.search(d, i, **more).collect()], key=str)


def test_search_equals_plain_loops(spark):
    assert searched(spark, ODD, ASKED) == expected_search(ODD, ASKED)
    assert searched(spark, ODD, ASKED, block_bytes=15_000) == expected_search(ODD, ASKED)
    rng = random.Random(5)
    docs = [(rng.randrange(10**6), " ".join(rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(rng.randint(0, 30)))) for _ in range(700)]
    items = [(i, " ".join(rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(6))) for i in range(9)]
    for top in (1, 50, 1000):
        assert searched(spark, docs, items, top=top) == expected_search(docs, items, top)
    assert not searched(spark, [], ASKED) and not searched(spark, ODD, [])


def test_search_in_small_windows_and_with_large_products(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "WINDOW", 64)
    s = lexical_search.Searcher([[0, 1]], lexical_search.np.array([5, 7]), 10, 40, top=2)
    docs, n = lexical_search.np.arange(64), lexical_search.np.full(64, 4)
    s.window(docs, n, lexical_search.np.array([0, 0, 1]), lexical_search.np.array([3, 60, 60]), lexical_search.np.array([1, 1, 2]))
    s.window(docs + 64, n, lexical_search.np.array([0]), lexical_search.np.array([3]), lexical_search.np.array([1]))
    one, two = 10**9 // (1000 + 20 * 100), 2 * 10**9 // (2000 + 20 * 100)
    assert sorted(s.heaps[0], reverse=True) == [(5 * one + 7 * two, -60), (5 * one, -3)]
    assert not s.scores.any() and not s.occupied.any()
    big = lexical_search.Searcher([], lexical_search.np.zeros(0), 10**12, 10**13)
    assert big.lengths(lexical_search.np.array([10**7, 1])).tolist() == [50 + 50 * 10**7 * 10**12 // 10**13, 50 + 50 * 10**12 // 10**13]


def test_equal_hashes_of_terms_are_told_apart():
    terms = lexical_search.Terms([b"one", b"two", b"six"])
    terms.hashes[:] = 7
    np = lexical_search.np
    raw = np.frombuffer(b"six ten TWO one", np.uint8)
    _, _, starts, ends = lexical_search.hash_words(raw, np.array([0, len(raw)]))
    at, term = terms.find(raw, np.full(4, 7, np.uint64), starts, ends)
    assert [(int(a), terms.words[t]) for a, t in zip(at, term, strict=True)] == [(0, b"six"), (2, b"two"), (3, b"one")]


def expected_targets(sizes, weights, budget, repeats=3):
    """Targets by hand: excess goes on to the others until none is above."""
    open_, out, left = set(sizes), {}, budget
    while open_:
        whole = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / whole > repeats * sizes[s]}
        if not over:
            return out | {s: left * weights[s] / whole for s in open_}
        for s in over:
            out[s] = repeats * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def mixed(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for extra in ("size", "row", "rank", "target", "part", "at", "copies", "weight"):
        df = df.withColumn(extra, F.lit("clash"))
    plan, order = mixing.curriculum(df, **more)
    return plan.collect(), order.collect()


@pytest.mark.parametrize("odd", [False, True])
def test_mix_meets_targets_in_order(spark, odd):
    rng = random.Random(3)
    rows = [(i, rng.choice([*"abcdefg", "a", "a", "é", "Z", None]), "w " * rng.randint(0, 60)) for i in range(900)]
    if odd:
        rows = [(1, "a", None), (None, "a", "x y\x0bz\xa0z"), (2, "b", "one"), (2, "b", "one"), (3, None, " "), (4, "c", "w " * 40_000), (5, "d", ""), (6, "e", "few words here")]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += size(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want = expected_targets(sizes, weights, sum(sizes.values()))
    plan, order = mixed(spark, rows)
    assert len(plan) == len(rows) and len({r["row"] for r in plan}) == len(rows)
    taken, by_row = Counter(), Counter()
    for r in order:
        taken[r["source"]] += r["words"]
        by_row[r["row"]] += r["words"]
    assert all(abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]] for r in plan)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in names)
    assert all(by_row[r["row"]] <= 3 * r["size"] for r in plan)
    positions = [r["position"] for r in order]
    assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)
    # what a source's schedule asks up to each copy's position is the words taken before it
    for i, s in enumerate(names):
        before = 0
        for r in sorted((r for r in order if r["source"] == s), key=lambda r: (r["position"], r["epoch"])):
            asked = integral(mixing.SCHEDULES[i % 3], r["position"]) * math.floor(want[s] + 0.5)
            assert abs(asked - before) < 1e-6 * max(1, before)
            before += r["words"]
    again = mixed(spark, rows)[1]
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["source"] or "", r["epoch"], r["position"], r["words"])
    assert sorted(map(key, order)) == sorted(map(key, again))


def integral(knots, t):
    """Share of a schedule's integral up to t, by trapezoids."""
    height = lambda x: next(a + (b - a) * (x - s) / (e - s) for (s, a), (e, b) in zip(knots, knots[1:], strict=False) if s <= x <= e)
    area = lambda end: sum((min(e, end) - s) * (height(s) + height(min(e, end))) / 2 for (s, _), (e, _) in zip(knots, knots[1:], strict=False) if s < end)
    return area(t) / area(1)


def test_mix_of_nothing_and_of_one_source(spark):
    assert mixed(spark, []) == ([], [])
    plan, order = mixed(spark, [(1, "a", " "), (2, "b", None)])
    assert len(plan) == 2 and not order
    plan, order = mixed(spark, [(1, "a", "x y"), (2, "a", "z")], budget=100)
    assert sum(r["words"] for r in order) == 9 and {r["epoch"] for r in order} == {0, 1, 2}
    with pytest.raises(ValueError):
        mixing.segments(((0, 1), (0.5, 1)))
