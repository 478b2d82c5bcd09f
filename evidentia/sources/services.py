"""Services behind a cache: requests are a table, a function fetches those not answered before.

Answers are written before anything reads them, so each request is sent once. The tasks that
send share one rate: each has its part of it.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import cache_key
from evidentia.plans.barrier import shared_folder
from evidentia.sources.readers import articles_of, latest

CACHE = "key string, content string, status int, media_type string, created_at double"
ROWS = f"{CACHE}, cacheable boolean"
#: Requests in any span of so many seconds, without and with a key of one's own;
#: parameters that callers don't set; seconds to wait after the first, second and third 429.
RATE, KEYED_RATE, SPAN = 3, 10, 1.1
OWN_PARAMETERS = ("api_key", "tool", "email", "_nocache")
WAITS = (2, 4, 6)
BUSY = (429, "text/plain", "Rate Limit Exceeded")

Fetch = Callable[[str, dict], tuple[int, str, str]]


def http_fetch(base: str, timeout: float = 30.0, common: dict[str, str] | None = None) -> Fetch:
    """A fetch of base/tool?params by GET, `common` parameters added; an error status is an answer."""

    def fetch(tool: str, params: dict) -> tuple[int, str, str]:
        url = f"{base.rstrip('/')}/{tool}?{urllib.parse.urlencode({**params, **(common or {})})}"
        try:
            with urllib.request.urlopen(url, timeout=timeout) as got:
                return got.status, got.headers.get("content-type", "application/octet-stream"), got.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, e.headers.get("content-type", "application/octet-stream"), e.read().decode("utf-8", "replace")

    return fetch


class Quota:
    """One of `tasks` equal parts of a rate: no span of `per` seconds sees more than `rate` starts over all
    tasks, which are as many as the rate at most, so that each has a start of its own."""

    def __init__(self, rate: int = RATE, per: float = SPAN, tasks: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if tasks > rate:
            raise ValueError("more tasks than starts in a span")
        self.span, self.starts = per, deque(maxlen=rate // tasks)
        self.clock, self.sleep = clock, sleep

    def wait(self) -> float:
        """Returns, and counts a start, once one is free."""
        now = self.clock()
        if len(self.starts) == self.starts.maxlen:
            free = self.starts[0] + self.span
            while now < free:
                self.sleep(free - now)
                now = self.clock()
        self.starts.append(now)
        return now


def sent(fetch: Fetch, tool: str, params: dict, quota: Quota, tries: int = 3) -> tuple[int, str, str]:
    """(status, media type, body): again after a wait on 429, `tries` times in all; a call that raises answers 502."""
    for attempt in range(tries):
        quota.wait()
        try:
            status, kind, body = fetch(tool, params)
        except Exception as e:  # noqa: BLE001  any failure of the service is an answer
            return 502, "text/plain", f"{type(e).__name__}: {e}"
        if status != 429:
            return status, kind, body
        quota.sleep(WAITS[min(attempt, len(WAITS) - 1)])
    return BUSY


def keyed(requests: DataFrame) -> DataFrame:
    """requests (tool, params as a map) with their key, and fresh: whether they pass the cache by.
    Parameters that aren't the caller's to set are dropped."""
    fresh = F.lower(F.coalesce(F.try_element_at("params", F.lit("_nocache")), F.lit(""))).isin("1", "true", "yes")
    own = F.map_filter("params", lambda k, v: ~k.isin(*OWN_PARAMETERS))
    rows = requests.withColumn("fresh", fresh).withColumn("params", own)
    return rows.withColumn("key", cache_key(F.col("tool"), F.col("params")))


def fetched(missing: DataFrame, fetch: Fetch, tasks: int = 1, rate: int = RATE, per: float = SPAN, tries: int = 3, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """CACHE rows of requests (key, tool, params), sent by `tasks` tasks, or as many as the rate, that share it.
    Sending isn't repeatable: write what this gives before reading it twice."""
    tasks = min(tasks, rate)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quota = Quota(rate, per, tasks, clock, sleep)
        for part in batches:
            rows = []
            for key, tool, params in zip(part["key"], part["tool"], part["params"], strict=True):
                status, kind, body = sent(fetch, tool, dict(params), quota, tries)
                rows.append((key, body, status, kind, time.time()))
            yield pd.DataFrame(rows, columns=["key", "content", "status", "media_type", "created_at"])

    return missing.select("key", "tool", "params").repartition(tasks).mapInPandas(call, CACHE)


def _missing(asked: DataFrame, known: DataFrame) -> DataFrame:
    return asked.where("not fresh").join(known.select("key"), "key", "left_anti").dropDuplicates(["key"])


def cached(requests: DataFrame, cache: DataFrame, fetch: Fetch, tries: int = 3, at_once: int = 1) -> tuple[DataFrame, DataFrame]:
    """(answers, new cache rows) of requests (tool, params) by a cache that is a table.

    Each key that the cache lacks is fetched once, by at_once tasks side by side under one rate, and
    written to the shared folder before this returns. Only answers of status 200 go to the
    cache; the latest of a key counts.
    """
    spark = requests.sparkSession
    asked = keyed(requests)
    known = latest(cache, "key", "created_at")
    path = f"{shared_folder(spark)}/fetched/{uuid.uuid4().hex}"
    fetched(_missing(asked, known), fetch, at_once, tries=tries).write.parquet(path)
    new = spark.read.schema(CACHE).parquet(path)
    answers = asked.drop("fresh").join(known.unionByName(new), "key", "left")
    return answers, new.where("status = 200")


def cache_rows(spark, path: str) -> DataFrame:
    """The rows of a cache folder with the batch that each came in; none where nothing is written yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    schema = f"{ROWS}, batch string"
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def write_through(requests: DataFrame, path: str, fetch: Fetch, tasks: int = 1, rate: int = RATE, per: float = SPAN, tries: int = 3, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """requests (tool, params) with key, content, status, media_type: from the cache folder at path, or sent.

    What isn't in the cache is sent once for each key and written, as a batch of its own, before
    the answers are read; batches of several writers don't meet. Answers of another status than 200 are
    written too but answer this call alone, as do those of requests with _nocache.
    """
    spark, batch = requests.sparkSession, uuid.uuid4().hex
    asked = keyed(requests)
    known = cache_rows(spark, path).where("status = 200 and cacheable")
    missing = _missing(asked, known.select("key").distinct())
    ways = [(missing, True), (asked.where("fresh").dropDuplicates(["key"]), False)]
    rows = None
    for some, keep in ways:
        one = some.select("key", "tool", "params", F.lit(keep).alias("keep"))
        rows = one if rows is None else rows.unionByName(one)
    # one write for both, by the rate that both share; a key asked both ways is sent for each
    marked = rows.withColumn("key", F.when(F.col("keep"), F.col("key")).otherwise(F.concat("key", F.lit("!"))))
    new = fetched(marked, fetch, tasks, rate, per, tries, clock, sleep)
    new.withColumn("cacheable", ~F.col("key").endswith("!")).withColumn("key", F.rtrim("key", F.lit("!"))).write.parquet(f"{path}/batch={batch}")
    own = F.col("batch") == batch
    held = cache_rows(spark, path).where(own | (F.col("status") == 200) & F.col("cacheable"))
    first = Window.partitionBy("key", "fresh").orderBy(F.desc(own), F.desc("created_at"))
    both = held.withColumn("fresh", F.explode(F.when(F.col("cacheable"), F.array(F.lit(False))).otherwise(F.array(F.lit(True)))))
    best = both.withColumn("n", F.row_number().over(first)).where("n = 1").select("key", "fresh", "content", "status", "media_type")
    return asked.join(best, ["key", "fresh"], "left").drop("fresh")


@dataclass
class Service:
    """Search, publication types and details of articles through one cache and one rate.

    fetch is a function (tool, params) -> (status, media type, body), such as http_fetch(); cache
    a folder that driver and executors share.
    """

    fetch: Fetch
    cache: str
    rate: int = RATE
    per: float = SPAN
    tasks: int = 1
    tools: dict[str, str] = field(default_factory=lambda: {"search": "esearch.fcgi", "types": "esummary.fcgi", "details": "efetch.fcgi"})
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep

    def _answers(self, rows: DataFrame, kind: str, **params) -> DataFrame:
        pairs = [x for k, v in params.items() for x in (F.lit(k), v)]
        requests = rows.withColumns({"tool": F.lit(self.tools[kind]), "params": F.create_map(*pairs)})
        return write_through(requests, self.cache, self.fetch, self.tasks, self.rate, self.per, clock=self.clock, sleep=self.sleep)

    def search(self, queries: DataFrame, retmax: int = 5, sort: str = "relevance") -> DataFrame:
        """(query, body) of queries (query), each once; body is null where the service failed."""
        some = queries.select("query").where("query <> ''").distinct()
        found = self._answers(some, "search", db=F.lit("pubmed"), term=F.col("query"), retmax=F.lit(str(retmax)), retmode=F.lit("json"), sort=F.lit(sort))
        return found.select("query", F.when(F.col("status") == 200, F.col("content")).alias("body"))

    def _of_ids(self, ids: DataFrame, keys: list[str], kind: str, mode: str) -> DataFrame:
        """A request for each key's ids, in order, as one list."""
        lists = ids.where("pubmed_id rlike '^[0-9]+$'").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "pubmed_id"))).alias("all"))
        lists = lists.select(F.array_distinct(F.transform("all", lambda x: x["pubmed_id"])).alias("ids")).distinct()
        found = self._answers(lists, kind, db=F.lit("pubmed"), id=F.array_join("ids", ","), retmode=F.lit(mode))
        return found.where("status = 200").select("ids", F.col("content").alias("body"))

    def types(self, ids: DataFrame, *keys: str) -> DataFrame:
        """(pubmed_id, pub_type) of ids (keys, ord, pubmed_id), a request for each key."""
        each = self._of_ids(ids, list(keys), "types", "json").select("body", F.explode("ids").alias("pubmed_id"))
        kinds = F.from_json(F.get_json_object("body", "$.result"), "map<string,string>")
        record = F.try_element_at(kinds, F.col("pubmed_id"))
        listed = F.filter(F.coalesce(F.from_json(F.get_json_object(record, "$.pubtype"), "array<string>"), F.array().cast("array<string>")), lambda x: x != "")
        return each.where(record.isNotNull()).select("pubmed_id", listed.alias("pub_type")).dropDuplicates(["pubmed_id"])

    def details(self, ids: DataFrame, *keys: str) -> DataFrame:
        """(pubmed_id, title, abstract) of ids (keys, ord, pubmed_id), a request for each key."""
        found = self._of_ids(ids, list(keys), "details", "xml")
        return articles_of(found.select("body")).dropDuplicates(["pubmed_id"])


def service_source(fetch: Fetch, tools: dict[str, str] | None = None, rate: int = RATE, per: float = SPAN):
    """A data source of articles, to be registered: spark.dataSource.register(service_source(fetch)).

    Format "articles"; option table: search (query, rank, pubmed_id), types (pubmed_id, pub_type) or
    details (pubmed_id, title, abstract). What is asked for comes from options queries or ids (JSON
    lists) or from filters on query or pubmed_id (= or IN), which are pushed down; a read without
    either raises. Ids go in batches (option batch, 200) and are dealt to at most `tasks`
    partitions (option, 1), which share the rate; a search reads pages of option page (100) up to retmax (5).
    For ids that are a large table Service goes over the table itself.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

    names = tools or {"search": "esearch.fcgi", "types": "esummary.fcgi", "details": "efetch.fcgi"}
    schemas = {"search": "query string, rank int, pubmed_id string", "types": "pubmed_id string, pub_type array<string>", "details": "pubmed_id string, title string, abstract string"}

    class Work(InputPartition):
        def __init__(self, items):
            self.items = items

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options, self.table = options, options.get("table", "details")
            self.column = "query" if self.table == "search" else "pubmed_id"
            given = options.get("queries" if self.table == "search" else "ids")
            self.asked = None if given is None else list(dict.fromkeys(map(str, json.loads(given))))

        def pushFilters(self, filters):
            for f in filters:
                values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
                if values is not None and tuple(f.attribute) == (self.column,):
                    self.asked = list(dict.fromkeys(v for v in map(str, values) if self.asked is None or v in self.asked))
                else:
                    yield f

        def partitions(self):
            if self.asked is None:
                raise ValueError(f"no {self.column} asked for: give an option or a filter")
            size = 1 if self.table == "search" else int(self.options.get("batch", 200))
            batches = [self.asked[i : i + size] for i in range(0, len(self.asked), size)]
            tasks = max(1, min(int(self.options.get("tasks", 1)), len(batches), rate))
            return [Work((tasks, batches[i::tasks])) for i in range(tasks)]

        def read(self, partition):
            tasks, batches = partition.items
            quota = Quota(rate, per, tasks)
            for batch in batches:
                yield from self.pages(batch[0], quota) if self.table == "search" else self.rows(batch, quota)

        def pages(self, query, quota):
            most, page, found = int(self.options.get("retmax", 5)), int(self.options.get("page", 100)), 0
            while found < most:
                size = min(page, most - found)
                params = {"db": "pubmed", "term": query, "retmax": str(size), "retmode": "json", "sort": self.options.get("sort", "relevance")}
                ids = json.loads(self.body("search", params | ({"retstart": str(found)} if found else {}), quota)).get("esearchresult", {}).get("idlist", [])
                yield from ((query, found + n, i) for n, i in enumerate(ids[:size]))
                found += len(ids)
                if len(ids) < size:
                    return

        def rows(self, ids, quota):
            from evidentia.sources.readers import parsed_articles

            body = self.body(self.table, {"db": "pubmed", "id": ",".join(ids), "retmode": "xml" if self.table == "details" else "json"}, quota)
            if self.table == "details":
                yield from (r for r in parsed_articles(body) if r[0] in ids)
                return
            result = json.loads(body).get("result", {})
            yield from ((i, [str(x) for x in result[i].get("pubtype", []) if x]) for i in ids if i in result)

        def body(self, kind, params, quota):
            status, _, body = sent(fetch, names[kind], params, quota)
            if status != 200:
                raise OSError(f"{names[kind]} answered {status}: {body[:200]}")
            return body

    class Articles(DataSource):
        @classmethod
        def name(cls):
            return "articles"

        def schema(self):
            return schemas[self.options.get("table", "details")]

        def reader(self, schema):
            return Reader(dict(self.options))

    return Articles
