"""MinHash near-dedup, line dedup and components."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import common, components, line_dedup, minhash
from evidentia.llm.common import table


def word_hashes(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return common.hash_words(raw, np.array([0, len(raw)]))[0]


def sets(text, weights="set"):
    return dict(zip(*map(list, minhash.weighted_set(word_hashes(text or ""), weights=weights)), strict=True))


def jaccard(a, b):
    low = sum(min(w, b.get(k, 0)) for k, w in a.items())
    return low / (sum(a.values()) + sum(b.values()) - low) if a and b else 0.0


def classes(texts, similarity=0.8, weights="set"):
    """Brute force: class of every (doc_id, text)."""
    s = [sets(t, weights) for _, t in texts]
    keys = [tuple(word_hashes(t or "").tolist()) for _, t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, x in enumerate(s):
        for k in x:
            by.setdefault(k, []).append(i)
    pairs = {(i, j) for m in by.values() for i in m for j in m if i < j}
    for i, j in pairs:
        if keys[i] == keys[j] or jaccard(s[i], s[j]) >= similarity:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    least = {}
    for i, (d, _) in enumerate(texts):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(texts)}


@pytest.mark.parametrize("weights", ["set", "count"])
def test_signatures_agree_as_the_similarity(weights):
    rng = random.Random(2)
    for share in (0.3, 0.8, 0.95):
        words = [rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(400)]
        other = [w if rng.random() < share**0.2 else "new" + str(rng.random()) for w in words]
        a, b = (sets(" ".join(w), weights) for w in (words, other))
        sig = []
        for s in (a, b):
            e, w = np.array(sorted(s), np.uint64), np.array([s[k] for k in sorted(s)], float)
            sig.append(minhash.dart_signatures(e, w, np.array([0, len(e)]), 4000)[0])
        assert abs((sig[0] == sig[1]).mean() - jaccard(a, b)) < 0.04


def test_signatures_of_a_block_are_those_of_each_text():
    texts = ["a b", "one two three four five six", "x " * 50, "q " + " ".join(map(str, range(900)))]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    h, first, _, _ = common.hash_words(raw, offsets)
    block = minhash.dart_signatures(*minhash.weighted_sets(h, first), 130)
    for t, got in zip(texts, block, strict=True):
        e, w = minhash.weighted_set(word_hashes(t))
        assert (minhash.dart_signatures(e, w, np.array([0, len(e)]), 130)[0] == got).all() and (got != 0).all()


def test_near_duplicates_equal_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    want = classes(rows)
    got = {r.doc_id: r.class_id for r in minhash.op4_minhash(spark, sf).collect()}
    assert got == {d: c if rows[i][1] else d for i, (d, c) in enumerate(want.items())}
    assert any(d != c for d, c in got.items())


def test_a_group_joined_by_a_hub_alone(spark):
    rng = random.Random(4)
    base = [f"w{rng.random()}" for _ in range(300)]
    rows = [(500, " ".join(base))]
    for i in range(60):  # near the base, less near each other
        w = list(base)
        for at in range(i % 60, 300, 60):
            w[at] = f"n{rng.random()}"
        rows.append((i, " ".join(w)))
    rows += [(600 + i, " ".join(f"z{rng.random()}" for _ in range(80))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    assert got == classes(rows) and sum(c == 0 for c in got.values()) == 61


def test_near_duplicates_edges(spark):
    rows = [(1, None), (2, ""), (3, "!!"), (4, "Two words"), (9, "two WORDS!"), (5, "two word"), (None, "two words"), (7, "x y z " * 9000), (8, "x y z " * 9000), (8, "x y z " * 9000), (None, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit(1)).withColumn("bucket", F.lit("x")).withColumn("node", F.lit(1))
    got = sorted(((r.doc_id or -1), (r.class_id or -1), r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (9, 4, False), (5, 5, True), (-1, 4, False), (7, 7, True), (8, 7, False), (8, 7, False), (-1, -1, True)])
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(300, 380)] + [(rng.randint(600, 660), rng.randint(600, 660)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for u, v in links:
        if u is not None and u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    assert got == {x: root(x) for x in parent}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_lines(rows, min_docs=3):
    """(text, lines, dropped) of (doc_id, text) rows with different doc_ids."""
    import re

    def tokens(line):
        return [line_dedup.WILDCARD if re.search("[0-9]", t) else t for t in re.split(r"[ \t\x0b\f\r]+", line.lower()) if t]

    leaves, holders = {}, {}
    for d, text in rows:
        for n, line in enumerate(text.split("\n") if text is not None else ()):
            t = tokens(line)
            if len(t) >= line_dedup.MIN_TOKENS:
                leaves.setdefault((len(t), *t[: line_dedup.DEPTH]), set()).add(" ".join(t))
                holders.setdefault(" ".join(t), []).append((d, n))
    named = {}
    for lines in leaves.values():
        leaf = line_dedup.Leaf()
        for line in sorted(lines, key=lambda x: x.encode()):
            leaf.add(line, line.split(" "))
        named |= dict(leaf.rows())
    where = {}
    for line, at in holders.items():
        where.setdefault(named[line], []).extend(at)
    drop = set()
    for at in where.values():
        if len({d for d, _ in at}) >= min_docs:
            drop |= set(at) - {min(at)}
    for d, text in rows:
        lines = text.split("\n") if text is not None else []
        kept = [x for n, x in enumerate(lines) if (d, n) not in drop]
        yield d, (None if text is None else "\n".join(kept)), len(lines), len(lines) - len(kept)


def test_line_dedup_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect())
    want = sorted(brute_lines([(r.doc_id, r.text) for r in docs.collect()]))
    assert got == want and any(w[3] for w in want)


def test_line_dedup_edges(spark):
    rows = [
        (1, None), (2, ""), (3, "short line\nposted by user 17 at noon\nbody one of this text"), (4, "posted by user 99 at noon\nshort line"), (5, "short line\nPosted by  user 3 at noon\nposted by user 4 at noon"),
        (6, "share this page with friends today\nunique words are found here"), (7, "share this page with family today\nother words are in this"), (8, "\n\nshare this page with people today"), (9, "a b c d\n" * 3000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("x")).withColumn("drop", F.lit("y")).withColumn("leaf", F.lit(1))
    out = line_dedup.dedup_lines(df)
    got = {r.doc_id: r for r in out.collect()}
    assert {d: (d, r.text, r.n_lines, r.n_dropped) for d, r in got.items()} == {w[0]: w for w in brute_lines(rows)}
    assert got[4].text == "short line" and got[5].text == "short line" and got[6].n_dropped == 0 and got[7].text == "other words are in this" and got[8].text == "\n"
    assert got[1].n_lines == 0 and got[9].n_dropped == 0 and {"drop", "leaf"} <= set(out.columns)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def plain_leaf(lines, alike=0.7):
    """line -> template, each line compared with every template."""
    found = []
    for line in lines:
        t = line.split(" ")
        same = [sum(x == y for x, y in zip(f[0], t, strict=True)) for f in found]
        if not same or max(same) < alike * len(t):
            found.append((t, [line]))
            continue
        f = found[same.index(max(same))]
        f[0][:] = [x if x == y else line_dedup.WILDCARD for x, y in zip(f[0], t, strict=True)]
        f[1].append(line)
    return {line: " ".join(t) for t, lines in found for line in lines}


@pytest.mark.parametrize("n", [5, 6, 7, 9, 14])
def test_large_leaf_equals_plain_comparison(n):
    import random

    rng = random.Random(n)
    lines = sorted({" ".join(["a", "b", "c", "d", *rng.choices("efghijkl<", k=n - 4)]).replace("<", line_dedup.WILDCARD) for _ in range(600)})
    for alike in (0.0, 0.5, 0.7, 0.9, 1.0):
        leaf = line_dedup.Leaf(alike)
        for i, line in enumerate(lines):
            leaf.add(i, line.split(" "))
        assert {lines[i]: t for i, t in leaf.rows()} == plain_leaf(lines, alike)


def test_variants_in_a_large_leaf_are_one_template(spark):
    """4,500 different lines with the same four first tokens and count, among them three variants of each of 1,500 templates."""
    word = lambda i, k: "".join(chr(97 + (i * 7919 + k * 104729) // 26**j % 26) for j in range(5))
    rows = [(d, "\n".join(" ".join(["see", "also", "the", "page", *[word(i, k) for k in range(5)], "xyz"[d]]) for i in range(1500))) for d in range(3)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect())
    assert got == sorted(brute_lines(rows)) and [g[3] for g in got] == [0, 1500, 1500]


def test_repeated_rows_lose_the_same_lines(spark):
    rows = [(1, "this line is common here"), (1, "this line is common here"), (2, "this line is common here"), (2, "this line is common here"), (3, "this line is common here"), (None, "this line is common here")]
    got = sorted((r.doc_id or 0, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1), (2, 1), (3, 1)]


@pytest.mark.parametrize("weights", ["set", "count"])
def test_a_crowd_below_the_similarity_with_near_copies_inside(spark, weights, monkeypatch):
    """Texts that share most words meet in buckets of many; only some are links."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared, rows = [word() for _ in range(90)], []
    for _ in range(80):
        own = [word() for _ in range(35)]
        for _ in range(rng.choice((1, 1, 2, 3))):
            copy = list(own)
            for _ in range(rng.choice((0, 0, 1))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(shared + copy)))
    split = []
    cut = minhash.prefixes
    monkeypatch.setattr(minhash, "prefixes", lambda *a: split.append(cut(*a)) or split[-1])
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), weights=weights).collect()
    assert split  # the case is one of a crowd
    assert {r.doc_id: r.class_id for r in found} == classes(rows, weights=weights)


def test_long_lines_recur_from_two_documents_on(spark):
    long, other = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(51)), " ".join(f"term{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50))
    rows = [(1, f"{long}\nown words of the first"), (2, f"own words of the second\n{long}"), (3, other), (4, other), (5, f"{long} more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.dedup_lines(df, long_docs=2).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("own words of the second", 1), 3: (other, 0), 4: (other, 0), 5: (rows[4][1], 0)}
    assert not any(r.n_dropped for r in line_dedup.dedup_lines(df).collect())


def test_line_dedup_keeps_columns_of_any_name(spark):
    rows = [(i, "one line that is the same everywhere\n" + "own " * i + "and more of it") for i in range(1, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["_key", "_drop", "_doc", "_text", "leaf", "template", "long", "first", "n", "a.b"]
    for name in names:
        df = df.withColumn(name, F.lit("mine"))
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", *names, "n_lines", "n_dropped"]
    assert [(set(r[2:12]), r.n_dropped) for r in out.orderBy("doc_id").collect()] == [({"mine"}, 0), ({"mine"}, 1), ({"mine"}, 1), ({"mine"}, 1)]


def test_recall_audit_counts_exact_links(spark):
    from evidentia.llm import minhash

    rng = random.Random(8)
    rows = []
    for i in range(0, 60, 2):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(3, 60))]
        other = list(words)
        for _ in range(rng.randint(0, 4)):
            other[rng.randrange(len(other))] = "changed"
        rows += [(i, " ".join(words)), (i + 1, " ".join(other))]
    rows += [(60, None), (62, ""), (64, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def shingles(text):
        w = (text or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    want = [(a, b) for a in sets for b in sets if a % 2 == 0 and a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    classes = minhash.near_duplicates(df)
    assert minhash.audit_recall(df, classes, every=2) == (len(want), len(want)) and len(want) > 10
    apart = df.select("doc_id", F.col("doc_id").alias("class_id"))
    assert minhash.audit_recall(df, apart, every=2) == (len(want), 0)
