"""Services: each request sent once, under one rate, over HTTP to a server of canned replies; article XML; files of records."""

import json
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from evidentia.plans import pipeline as P
from evidentia.sources import readers as R
from evidentia.sources import services as S

ARTICLE = """<PubmedArticle><MedlineCitation><PMID>{0}</PMID><Article><ArticleTitle>Title {0} <i>in vivo</i> end</ArticleTitle><Abstract>
<AbstractText Label="AIM" NlmCategory="X">One <sup>2</sup> three.</AbstractText><AbstractText Label="EMPTY"> <b/> </AbstractText><AbstractText NlmCategory="METHODS">m<i>i</i>d</AbstractText><AbstractText>plain {0}</AbstractText>
</Abstract></Article></MedlineCitation></PubmedArticle>"""
ABSTRACT = "AIM: One 2 three. METHODS: mid plain {0}"


def wrapped(*articles):
    return f"<?xml version='1.0'?><PubmedArticleSet>{''.join(articles)}</PubmedArticleSet>"


def test_articles_gather_the_text_around_markup():
    other = ARTICLE.replace("<Abstract>", "<OtherAbstract>").replace("</Abstract>", "</OtherAbstract>")
    held = "<PubmedArticle><MedlineCitation><PMID>9</PMID><Article><ArticleTitle><b>all</b> marked</ArticleTitle><Abstract><AbstractText> Abstract available from the publisher.</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"
    bare = "<PubmedArticle><MedlineCitation><PMID>10</PMID></MedlineCitation></PubmedArticle>"
    nameless = "<PubmedArticle><MedlineCitation></MedlineCitation></PubmedArticle>"
    got = R.parsed_articles(wrapped(ARTICLE.format(1), other.format(2), held, bare, nameless))
    assert got == [("1", "Title 1", ABSTRACT.format(1)), ("2", "Title 2", ABSTRACT.format(2)), ("9", None, None), ("10", None, None)]
    assert R.parsed_articles("<broken") == [] == R.parsed_articles(None) == R.parsed_articles("")


def test_files_of_many_articles_are_split(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.xml").write_text(wrapped(*[ARTICLE.format(100 * n + i) for i in range(40)]))
    (tmp_path / "none.xml").write_text(wrapped())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = R.read_articles(spark, str(tmp_path))
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(int(r.pubmed_id) for r in rows) == [100 * n + i for n in range(3) for i in range(40)]
    assert {(r.title, r.abstract) for r in rows} == {(f"Title {r.pubmed_id}", ABSTRACT.format(r.pubmed_id)) for r in rows}
    one = spark.createDataFrame([(ARTICLE.format(7),), ("x",), (None,)], "xml string").select(R.article(F.col("xml")).alias("a")).collect()
    assert [tuple(r.a) for r in one] == [("7", "Title 7", ABSTRACT.format(7)), (None, None, None), (None, None, None)]


def test_records_in_five_encodings(spark, tmp_path):
    texts = {
        "a.json": '[{"id": 1, "statement": "é", "label": 2}]', "b.jsonl": '{"id": 2, "statement": "b"}\n\n{"id": 3, "statement": "c"}', "c.txt": "[{'id': 4, 'statement': 'd', 'label': None}]",
        "d.json": '{"data": [{"id": "5", "statement": "e"}]}', "e.json": "﻿[]", "f.txt": "no records", "g.json": '[{"id": 6}]', "h.json": '{"a": 1}', "i.json": "7",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    rows = R.read_records(spark, str(tmp_path)).collect()
    assert sorted((r.id, r.statement, r.label) for r in rows if r.error is None) == [("1", "é", "2"), ("2", "b", None), ("3", "c", None), ("4", "d", None), ("5", "e", None)]
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows if r.error) == ["f.txt", "g.json", "h.json", "i.json"]


def test_pdfs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "in" / "b.pdf").write_bytes(b"none")
    (tmp_path / "c.pdf").write_bytes(b"\xff")
    (tmp_path / "d.txt").write_bytes(b"no")
    rows = R.read_pdfs(spark, str(tmp_path), lambda b: [] if b == b"none" else b.decode().split("\f")).collect()
    import hashlib

    assert sorted((r.path[-5:], r.page, r.text) for r in rows if r.page) == [("a.pdf", 1, "one"), ("a.pdf", 2, "two")]
    assert sorted(r.path[-5:] for r in rows if r.page is None) == ["b.pdf", "c.pdf"]
    assert {r.file_hash for r in rows if r.path.endswith("a.pdf")} == {hashlib.sha256(b"one\ftwo").hexdigest()}
    with pytest.raises(NotImplementedError):
        R.read_pdfs(spark, str(tmp_path))


class Clock:
    def __init__(self):
        self.now, self.waits = 0.0, []

    def __call__(self):
        self.now += 0.001
        return self.now

    def sleep(self, s):
        self.waits.append(s)
        self.now += s


@pytest.mark.parametrize(("rate", "tasks"), [(3, 1), (10, 1), (3, 2), (10, 4), (3, 3)])
def test_no_span_is_over_the_rate(rate, tasks):
    starts = []
    for task in range(tasks):
        c = Clock()
        q = S.Quota(rate, 1.1, tasks, c, c.sleep)
        own = []
        for i in range(25):
            c.now += (i * 7919 + task * 31) % 10 / 12
            own.append(q.wait())
        starts += own
    with pytest.raises(ValueError):
        S.Quota(3, tasks=4)
    starts.sort()
    assert all(sum(t <= s < t + 1.1 for s in starts) <= rate for t in starts)


def test_waits_after_a_busy_answer():
    for busy, want, waits in ((0, 200, []), (1, 200, [2]), (2, 200, [2, 4]), (3, 429, [2, 4, 6])):
        c, left = Clock(), [busy]

        def fetch(tool, params):
            left[0] -= 1
            return (429, "t", "busy") if left[0] >= 0 else (200, "t", "ok")

        assert S.sent(fetch, "x", {}, S.Quota(100, 1.1, 1, c, c.sleep))[0] == want and c.waits == waits
    c = Clock()
    assert S.sent(lambda tool, params: 1 / 0, "x", {}, S.Quota(3, 1.1, 1, c, c.sleep)) == (502, "text/plain", "ZeroDivisionError: division by zero")


def noting(path):
    def fetch(tool, params):
        (path / uuid.uuid4().hex).write_text(json.dumps([tool, params]))
        return (500, "t", "down") if params["a"] == "bad" else (200, "t", f"{tool} {params['a']}")

    return fetch


def test_requests_are_sent_once_over_write_and_read(spark, tmp_path):
    (tmp_path / "sent").mkdir()
    n = lambda: len(list((tmp_path / "sent").glob("*")))
    rows = [("t", {"a": str(i % 5), "api_key": "mine"}) for i in range(9)] + [("t", {"a": "bad"})]
    requests = spark.createDataFrame(rows, "tool string, params map<string,string>")
    through = lambda r: S.write_through(r, str(tmp_path / "cache"), noting(tmp_path / "sent"), tasks=3, rate=10_000)
    answers = through(requests)
    for _ in range(3):
        assert sorted((r.status, r.content) for r in answers.collect()) == sorted([(200, f"t {i % 5}") for i in range(9)] + [(500, "down")])
    assert n() == 6 and all("api_key" not in json.loads(f.read_text())[1] for f in (tmp_path / "sent").glob("*"))
    # a second call sends what failed again, and what passes the cache by
    more = spark.createDataFrame([("t", {"a": "1"}), ("t", {"a": "bad"}), ("t", {"a": "2", "_nocache": "1"}), ("u", {"a": "1"})], "tool string, params map<string,string>")
    again = through(more)
    assert sorted((r.status, r.content) for r in again.collect()) == [(200, "t 1"), (200, "t 2"), (200, "u 1"), (500, "down")] and n() == 9
    assert S.cache_rows(spark, str(tmp_path / "cache")).where("status = 200 and cacheable").select("key").distinct().count() == 6
    answers, new = S.cached(requests, S.cache_rows(spark, str(tmp_path / "none")).select(*[c.split()[0] for c in S.CACHE.split(", ")]), noting(tmp_path / "sent"))
    new.write.parquet(str(tmp_path / "kept"))
    assert answers.count() == 10 and new.count() == 5 and n() == 15


REPLIES = {"q one": ["1", "2", "3"], "q two": ["3", "4"], "many": [str(i) for i in range(1000, 1250)]}


@pytest.fixture(scope="module")
def server():
    """Canned replies over HTTP; what was asked for is in .asked."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            p = {k: v[0] for k, v in parse_qs(url.query).items()}
            server.asked.append((url.path.rsplit("/", 1)[1], p))
            if url.path.endswith("esearch.fcgi"):
                start = int(p.get("retstart", 0))
                body = json.dumps({"esearchresult": {"idlist": REPLIES.get(p["term"], [])[start : start + int(p["retmax"])]}})
            elif url.path.endswith("esummary.fcgi"):
                body = json.dumps({"result": {"uids": [], **{i: {"pubtype": ["Review", "", f"Kind {i}"]} for i in p["id"].split(",") if i != "4"}}})
            else:
                body = wrapped(*[ARTICLE.format(i) for i in p["id"].split(",") if i != "2"])
            self.send_response(404 if p.get("term") == "gone" else 200)
            self.send_header("content-type", "text/plain")
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.asked = []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def base(server):
    return f"http://127.0.0.1:{server.server_port}/eutils"


def test_evidence_through_the_service(spark, server, tmp_path):
    server.asked.clear()
    service = S.Service(S.http_fetch(base(server)), str(tmp_path / "cache"), rate=1000)
    queries = spark.createDataFrame([(1, 1, 0, "q one"), (1, 1, 1, "q two"), (1, 2, 0, "q two"), (1, 3, 0, "gone"), (1, 3, 1, "")], "run_id int, stmt_id int, ord int, query string")
    config = {"steps": [{"type": "fetch_links", "settings": {"service": service, "retmax": 3}}, {"type": "abstract_evidence", "settings": {"service": service}}]}
    want = {
        (1, "1"): ("Title 1", ABSTRACT.format(1), ["Review", "Kind 1"], []), (1, "2"): (None, None, ["Review", "Kind 2"], []), (1, "3"): ("Title 3", ABSTRACT.format(3), ["Review", "Kind 3"], ["q two"]),
        (1, "4"): ("Title 4", ABSTRACT.format(4), None, []), (2, "3"): ("Title 3", ABSTRACT.format(3), ["Review", "Kind 3"], []), (2, "4"): ("Title 4", ABSTRACT.format(4), None, []),
    }
    for _ in range(2):
        state = P.run(config, P.State({"queries": queries}))
        got = {(r.stmt_id, r.pubmed_id): (r.title, r.abstract, r.pub_type, r.queries) for r in state.tables["evidence"].collect()}
        assert got == want
    asked = sorted((t, p.get("term") or p["id"]) for t, p in server.asked)
    once = [("efetch.fcgi", "1,2,3,4"), ("efetch.fcgi", "3,4"), ("esearch.fcgi", "gone"), ("esearch.fcgi", "q one"), ("esearch.fcgi", "q two"), ("esummary.fcgi", "1,2,3,4"), ("esummary.fcgi", "3,4")]
    assert asked == sorted([*once, ("esearch.fcgi", "gone")])


def test_data_source_pushes_ids_and_reads_pages(spark, server):
    spark.dataSource.register(S.service_source(S.http_fetch(base(server)), rate=1000))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    server.asked.clear()
    read = lambda **o: spark.read.format("articles").options(**o).load()
    got = read(table="details", batch=2, tasks=2).where(F.col("pubmed_id").isin("1", "2", "5")).collect()
    assert sorted(map(tuple, got)) == [(i, f"Title {i}", ABSTRACT.format(i)) for i in ("1", "5")]
    assert sorted(p["id"] for _, p in server.asked) == ["1,2", "5"]
    kinds = read(table="types", ids=json.dumps(["4", "6"])).collect()
    assert [tuple(r) for r in kinds] == [("6", ["Review", "Kind 6"])]
    assert [r.pubmed_id for r in read(table="types", ids=json.dumps(["4", "6", "7"])).where("pubmed_id = '7'").collect()] == ["7"]
    server.asked.clear()
    found = read(table="search", retmax=230, page=100, queries=json.dumps(["many", "q two"])).collect()
    assert sorted((r.query, r["rank"], r.pubmed_id) for r in found) == sorted([("many", i, str(1000 + i)) for i in range(230)] + [("q two", 0, "3"), ("q two", 1, "4")])
    assert [p.get("retstart") for _, p in server.asked if p["term"] == "many"] == [None, "100", "200"]
    with pytest.raises(Exception, match="no pubmed_id asked for"):
        read(table="details").collect()
    with pytest.raises(Exception, match="answered 404"):
        read(table="search", queries=json.dumps(["gone"])).collect()
