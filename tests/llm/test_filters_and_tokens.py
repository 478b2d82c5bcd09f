"""Token counts, packing, token files, URL filters, language ID and decontamination."""

import hashlib
import random
import re
import zlib
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import decontaminate, language_id, packing, token_counts, token_files, tokenizer, url_filter
from evidentia.llm.common import table

EDGE = [(1, None), (2, ""), (3, "   \n\t"), (4, "a"), (5, "Ünï cödé ÉÊ ©"), (6, "same text twice"), (6, "same text twice"), (7, "x " * 6000), (8, "!!! ..."), (9, "a\x1cb don't I'LL 123")]


def docs(spark, rows=EDGE, lang="en"):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("lang", F.lit(lang)).withColumn("bin_group", F.lit("clash")).withColumn("start", F.lit(1)).withColumn("n_words", F.lit(0))


def reference_ids(texts, end):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer.vocabulary())
    tok.encode_special_tokens = True
    return [[*e.ids, end] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_trie_counts_equal_a_unigram_tokenizer():
    from tokenizers import Tokenizer, models

    pieces = token_counts.zipf_pieces()
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeéthinonzß") for _ in range(rng.randint(1, 14))) for _ in range(3000)] + ["☃x", "日本語テスト"]
    vocab = [("<unk>", 0.0), *pieces.items()]
    unigram = Tokenizer(models.Unigram(vocab, 0, False))
    trie = token_counts.CountTrie(pieces)
    for w in words:
        w = token_counts.SPACE + w
        if all(c in pieces for c in w):
            assert trie.terminal(w) == len(unigram.encode(w).ids), w
        assert trie.terminal(w) == brute_count(pieces, w), w


def brute_count(pieces, word):
    low = min(pieces.values()) - 10
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        found = []
        for start in range(end):
            part = word[start:end]
            if part in pieces:
                found.append((best[start][0] + pieces[part], -best[start][1] - 1))
            elif end - start == 1:
                found.append((best[start][0] + low, -best[start][1] - len(part.encode())))
        score, n = max(found)
        best.append((score, -n))
    return best[-1][1]


def test_levels_of_the_trie_equal_each_word_by_itself(monkeypatch):
    pieces = token_counts.zipf_pieces()
    trie, rng = token_counts.CountTrie(pieces), random.Random(8)
    words = sorted({"".join(rng.choice("abcdeéthinonzß日☃𝒳") for _ in range(rng.randint(1, 40))) for _ in range(3000)})
    counts = trie.level_counts(words).tolist()
    assert counts == [trie.long_count(w) for w in words] and counts[:300] == [brute_count(pieces, w) for w in words[:300]]
    monkeypatch.setattr(token_counts, "MEMO_BYTES", 20_000)  # many fresh starts
    monkeypatch.setattr(token_counts, "AT_ONCE", 7)
    for i in range(0, 600, 60):
        trie.put(set(words[i : i + 100]))
        assert all(trie.count[w] == trie.long_count(token_counts.SPACE + w) for w in words[i : i + 100])


def test_a_very_long_token_is_whole(spark, tmp_path):
    long = "thequickbrown" * 20_000
    d = docs(spark, [(1, long), (2, "a"), (3, "x" + long + " b")])
    trie = token_counts.CountTrie(token_counts.zipf_pieces())
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(d).collect()}
    assert got[1] == (1, trie.long_count("▁" + long)) and got[3] == (2, trie.long_count("▁x" + long) + trie.terminal("▁b"))
    texts = {r.doc_id: r.text for r in d.collect()}
    check_packing(packing.pack_documents(d).collect(), texts)
    token_files.write_token_files(d, str(tmp_path / "long"))
    rows = token_files.read_token_files(spark, str(tmp_path / "long")).orderBy("doc_id").collect()
    assert [list(r.ids) for r in rows] == reference_ids(list(texts.values()), 1)


def test_a_small_memo_changes_no_ids(monkeypatch):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcÉéßœİK0.,!?-") for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(80)]
    monkeypatch.setattr(tokenizer, "MEMO_BYTES", 30_000)
    enc = tokenizer.Encoder(tokenizer.vocabulary())
    got = [ids for i in range(0, 80, 8) for ids in enc.batch(texts[i : i + 8])]
    assert got == [np.array(ids[:-1], "<u4").tobytes() for ids in reference_ids(texts, 0)]


def test_words_and_the_marks_behind_them_are_encoded_once():
    class Counted:
        def __init__(self, inner):
            self.inner, self.given = inner, []

        def encode_batch_fast(self, texts, **kw):
            self.given += [w for t in texts for w in t.split()]
            return self.inner.encode_batch_fast(texts, **kw)

    enc = tokenizer.Encoder(tokenizer.vocabulary())
    enc.tokenizer = Counted(enc.tokenizer)
    marks = ["!!", "###", ",***", "'", "\"]", "\\^_`{|}~", "", "."]
    texts = [" ".join(f"{w}{m}" for w in ("these", "THESE", "Größe", "größe")) for m in marks]
    long = "x" * (tokenizer.MEMO_CHARS + 1)
    for some in (texts[:3], texts, ["these!! 'tis don't a'b 4!! <|endoftext|>", "", f"{long}!! {long}"]):
        got = enc.batch(some)
        assert got == [np.array(ids[:-1], "<u4").tobytes() for ids in reference_ids(some, 0)]
    known = [w for w in enc.tokenizer.given if w in ("these", "größe") or not any(c.isalnum() for c in w)]
    assert sorted(known) == sorted({"these", "größe", *marks} - {""})
    assert long not in enc.memo and len(enc.bounds) == len(enc.memo) + 1 and enc.bounds[-1] == len(enc.ids)


def test_repeated_rows_are_dealt_apart(spark):
    d = docs(spark, [(5, "one and the same")] * 400).coalesce(1)
    rows = packing.pack_documents(d, group_docs=10).collect()
    assert len(rows) == 400 and len({r.sequence_id >> 32 for r in rows}) > 20
    per = {}
    for r in rows:
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in per.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))]


def test_token_files_hold_what_was_asked_for(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    d = spark.createDataFrame([(i, f"words of number {i} " * 40) for i in range(4000)], "doc_id long, text string")
    for encoding, want in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        path = str(tmp_path / encoding)
        token_files.write_token_files(d, path, options=token_files.write_options(encoding, row_group=64 << 10, page=4 << 10, page_rows=64))
        groups = 0
        for f in glob.glob(path + "/*.parquet"):
            meta = pq.ParquetFile(f).metadata
            groups += meta.num_row_groups
            for g in range(meta.num_row_groups):
                columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
                ids = next(c for n, c in columns.items() if n.startswith("ids"))
                assert want in ids.encodings and ids.has_offset_index and columns["doc_id"].has_column_index
                assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and meta.row_group(g).total_byte_size < 1 << 20
        assert groups > 1


def test_token_counts_of_documents(spark, sf, monkeypatch):
    pieces = token_counts.zipf_pieces()
    rows = {r.doc_id: r for r in token_counts.token_counts(docs(spark)).collect()}
    assert (rows[1].n_tokens, rows[2].n_tokens, rows[3].n_pretokens) == (0, 0, 0)
    assert rows[7].n_pretokens == 6000 and rows[7].n_tokens == 6000 * brute_count(pieces, "▁x")
    assert token_counts.token_counts(docs(spark, [])).count() == 0
    got = {r.doc_id: r.n_tokens for r in token_counts.op1_token_counts(spark, sf).collect()}
    known = {}
    for r in table(spark, sf, "documents").collect():
        want = 0
        for w in (r.text or "").split():
            if w not in known:
                known[w] = brute_count(pieces, "▁" + w)
            want += known[w]
        assert got[r.doc_id] == want


def check_packing(rows, texts):
    ids = {d: i for d, i in zip(texts, reference_ids(list(texts.values()), 2), strict=True)}
    per_doc, per_sequence = {}, {}
    for r in rows:
        per_doc.setdefault(r.doc_id, []).append(r)
        per_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(per_doc) == set(ids)
    for doc, pieces in per_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[doc])
            assert r.ids_crc32 == crc(ids[doc][at : at + r.length])
            at += r.length
        assert at == len(ids[doc])
    for pieces in per_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    return sum(r.length for r in rows) / (4096 * len(per_sequence))


def test_packing_holds_every_id_once(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    filled = check_packing(packing.op2_packing(spark, sf).collect(), texts)
    assert filled > 0.97
    assert packing.pack_documents(docs(spark, [])).count() == 0
    edge = packing.pack_documents(docs(spark)).collect()
    assert len([r for r in edge if r.doc_id == 6]) == 2
    check_packing([r for r in packing.pack_documents(docs(spark, EDGE[:6] + EDGE[7:])).collect()], dict(EDGE[:6] + EDGE[7:]))


def test_sequences_hold_the_ids(spark):
    d = docs(spark, EDGE[:6])
    placed = packing.pack_documents(d, sequence=64)
    out = packing.sequences(d, placed, sequence=64).collect()
    want = sorted(i for ids in reference_ids([t for _, t in EDGE[:6]], 2) for i in ids)
    assert sorted(i for r in out for i in r.ids) == want and all(len(r.ids) <= 64 for r in out)


def test_first_fit_decreasing_equals_a_plain_scan():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 500)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if b == len(room):
            room.append(100)
        want[i] = b, 100 - room[b]
        room[b] -= lengths[i]
    assert all((bins[i], offsets[i]) == want[i] for i in range(500))


def test_token_files_round_trip(spark, sf, tmp_path):
    rows = sorted(token_files.op3_token_files(spark, sf).collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    at = 0
    for r, (doc, ids) in zip(rows, sorted(zip(texts, reference_ids(list(texts.values()), 1), strict=True)), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), crc(ids))
        at += len(ids)
    for k, encoding in enumerate(("dictionary", "delta")):
        path = str(tmp_path / str(k))
        token_files.write_token_files(docs(spark), path, options=token_files.write_options(encoding))
        got = token_files.read_token_files(spark, path).orderBy("doc_id").collect()
        assert [list(r.ids) for r in got if r.doc_id != 6] == reference_ids([t for d, t in EDGE if d != 6], 1)
        assert [r.doc_id for r in token_files.read_token_files(spark, path, 4, 5).orderBy("doc_id").collect()] == [4, 5]
        plan = token_files.read_token_files(spark, path, 4, 5)._jdf.queryExecution().toString()
        assert "GreaterThanOrEqual(doc_id,4)" in plan
    with pytest.raises(ValueError):
        token_files.write_options("none")
    token_files.write_token_files(docs(spark, []), str(tmp_path / "empty"))
    assert token_files.token_digests(spark, str(tmp_path / "empty")).count() == 0


def test_url_filter_intervals(spark):
    day = lambda n: date(2024, 1, n)
    entries = spark.createDataFrame(
        [("a", "bad.org", "add", day(5)), ("a", "bad.org", "add", day(6)), ("a", "bad.org", "remove", day(10)), ("a", "bad.org", "add", day(20)),
         ("b", "x.bad.org", "add", day(7)), ("b", "once.org", "add", day(3)), ("b", "once.org", "remove", day(3)), (None, "bad.org", "add", day(1)), ("c", "1.2.3.4", "add", day(1)), ("c", "3.4", "add", day(1))],
        "list_name string, domain string, action string, day date",
    )
    rows = [
        (1, "http://bad.org/x", day(4)), (2, "http://BAD.org:80/x", day(5)), (3, "https://u@y.x.bad.org./", day(8)), (4, "http://bad.org", day(10)), (5, "http://bad.org", day(25)),
        (6, None, day(5)), (7, "not a url", day(5)), (8, "http://bad.org", None), (9, "http://once.org", day(3)), (10, "http://1.2.3.4/", day(9)), (2, "http://BAD.org:80/x", day(5)), (11, "http://notbad.org", day(6)),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, fetched date").withColumn("month", F.lit(1)).withColumn("lists", F.lit("x"))
    got = sorted((r.page_id, r.lists, r.n_matches, r.blocked) for r in url_filter.filter_urls(pages, entries).collect())
    want = [(1, "", 0, False), (2, "a", 1, True), (2, "a", 1, True), (3, "a,b", 2, True), (4, "", 0, False), (5, "a", 1, True), (6, "", 0, False), (7, "", 0, False), (8, "", 0, False), (9, "", 0, False), (10, "c", 1, True), (11, "", 0, False)]
    assert got == want
    assert url_filter.filter_urls(pages.limit(0), entries).count() == 0
    assert not any(r.blocked for r in url_filter.filter_urls(pages, entries.limit(0)).collect())


def test_language_id_on_held_out_documents(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = language_id.op6_language_id(spark, sf).collect()
    lang = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    judged = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id].lang for r in judged) / len(judged) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_edges(spark):
    train = spark.createDataFrame([("en", "the of and the", 1), ("de", "der die das und", 2), (None, "x", 3), ("en", None, 4)], "lang string, text string, key long")
    profiles = language_id.fit(train)
    got = {r.doc_id: r for r in language_id.predict(docs(spark), profiles).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 8)] == ["und"] * 4 and got[4].lang_pred in ("de", "en")
    assert {"bin_group", "start"} <= set(got[4].asDict())
    assert language_id.predict(docs(spark), language_id.fit(train.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert profiles.nearest("the and")[0] == "en" and profiles.nearest("und das")[0] == "de"


def plain_profile(texts, size):
    from collections import Counter

    n = Counter()
    for text in texts:
        s = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in " " + text.lower() + " "))
        n.update(s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1) if (k > 1 or s[i] != " ") and not (k == 3 and s[i + 1] == " "))
    code = lambda g: (0, 1 << 62, 1 << 63)[len(g) - 1] | int("".join(f"{0 if c == ' ' else ord(c):021b}" for c in g), 2)  # noqa: E731  ties go by code
    return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], code(x[0])))[:size]]


def test_predictions_equal_plain_out_of_place_distances(spark, sf):
    """The whole result, with profiles and distances by plain loops."""
    rows = table(spark, sf, "documents").select("doc_id", "lang", "text").collect()
    own, size = {}, language_id.PROFILE
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None and r.text is not None:
            own.setdefault(r.lang, []).append(r.text)
    profiles = {lang: {g: i for i, g in enumerate(plain_profile(texts, size))} for lang, texts in own.items()}
    for got in language_id.op6_language_id(spark, sf).collect():
        mine = plain_profile([next(r.text for r in rows if r.doc_id == got.doc_id) or ""], size)
        far = {lang: sum(abs(p[g] - i) if g in p else size for i, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        want = (best, 1 - far[best] / (size * len(mine))) if mine else ("und", 0.0)
        assert got.lang_pred == want[0] and abs(got.score - want[1]) < 1e-12


def test_gram_counts_equal_a_plain_count(monkeypatch):
    from collections import Counter

    text = "Ab c'est 12 zz\nÜber ab"
    padded = [c if c.isalpha() else " " for c in " " + text.lower() + " "]
    s = re.sub(" +", " ", "".join(padded))
    want = Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if (n > 1 or s[i] != " ") and not (n == 3 and s[i + 1] == " "))
    codes, counts = language_id.gram_counts(text)
    assert sorted(counts.tolist()) == sorted(want.values())
    monkeypatch.setattr(language_id, "PART", 3)
    again = language_id.gram_counts("ab cd " * 50)
    monkeypatch.setattr(language_id, "PART", 1 << 20)
    whole = language_id.gram_counts("ab cd " * 50)
    assert dict(zip(*map(list, again), strict=True)).keys() == dict(zip(*map(list, whole), strict=True)).keys()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(texts, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if w:
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    found |= windows[tuple(w[i : i + n])]
                    hit |= set(range(i, i + n))
        yield len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


FIELDS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize(("block_bytes", "join_bytes"), [(1 << 20, 1 << 30), (3000, 1 << 30), (3000, 0)])
def test_decontamination_equals_brute_force(spark, sf, block_bytes, join_bytes):
    """In one block, in several, and with the windows joined."""
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in decontaminate.contamination(d, b, block_bytes, join_bytes=join_bytes).collect()}
    rows = d.collect()
    want = dict(zip([r.doc_id for r in rows], brute_contamination([r.text for r in rows], [(r.item_id, r.text) for r in b.collect()]), strict=True))
    assert got == want and any(w[4] for w in want.values())


@pytest.mark.parametrize(("block_bytes", "join_bytes"), [(1 << 20, 1 << 30), (60, 1 << 30), (60, -1)])
def test_decontamination_edges(spark, block_bytes, join_bytes):
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice(["a", "b", "C", "the", "42", "é"]) for _ in range(n))
    items = [(1, None), (2, ""), (3, "!!"), (4, "zz"), (5, "b a the"), (5, "b a the"), (6, some(9)), (7, some(10)), (8, some(30)), (10, some(12)), (11, "b a the")]
    texts = [(i, some(rng.randint(0, 300))) for i in range(60)] + [(60, None), (61, items[8][1]), (62, items[7][1] + " " + items[8][1]), (63, items[8][1][:-3]), (64, "ZZ"), (65, "ZZ"), (65, "ZZ")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    got = sorted((r.doc_id, *(r[f] for f in FIELDS)) for r in decontaminate.contamination(docs(spark, texts), bench, block_bytes, join_bytes=join_bytes).collect())
    want = sorted((i, *w) for (i, _), w in zip(texts, brute_contamination([t for _, t in texts], [x for x in items if x[1]]), strict=True))
    assert got == want
    assert decontaminate.contamination(docs(spark, []), bench, join_bytes=join_bytes).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs(spark, texts), bench.limit(0), join_bytes=join_bytes).collect())


def test_windows_joined_with_a_filter_that_is_full(spark, monkeypatch):
    """Results don't hang on the filter: with 64 bits it lets nearly all through. One item is very long, one word too, and many items share a window."""
    from evidentia.llm import window_join

    plain = window_join.joined
    monkeypatch.setattr(window_join, "joined", lambda rows, items: plain(rows, items, filter_bits=64))
    rng = random.Random(8)
    some = lambda n: " ".join(rng.choice(["a", "b", "the", "of"]) for _ in range(n))
    shared = some(11)
    items = [*((i, f"x{i} {shared} y{i}") for i in range(40)), (50, some(3000)), (51, "w" * 100_000), (52, "of"), (None, some(20))]
    texts = [(i, some(40)) for i in range(20)] + [(i, f"{shared} q{i}") for i in range(20, 60)] + [(70, "w" * 100_000 + " end"), (None, shared), (71, some(20_000))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    read = lambda join: sorted(tuple(r[f] for f in FIELDS) + (r.doc_id or -1,) for r in decontaminate.contamination(docs(spark, texts), bench, join_bytes=join).collect())
    assert read(-1) == read(1 << 30)
