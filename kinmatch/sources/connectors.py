"""Connectors: which parser reads which site, and a Python data source that fetches payloads.

Fetching is a callable (url, timeout) -> text, urllib's by default, so captured payloads or another
client can stand in for it. One request is one input partition: executors fetch, retry and yield text.
"""

from __future__ import annotations

import logging
import os
import random
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kinmatch.operators.aliases import enabled_sports
from kinmatch.operators.collect import collect_events
from kinmatch.operators.graph import saved
from kinmatch.sources import payloads

log = logging.getLogger(__name__)


def chunked(items: Sequence[str], size: int) -> list[list[str]]:
    return [list(items[k : k + size]) for k in range(0, len(items), max(1, size))]


@dataclass(frozen=True)
class Retry:
    """Exponential waits with full jitter; what a server asks to wait is honoured."""

    attempts: int = 3
    base: float = 0.5
    longest: float = 20.0

    def wait(self, attempt: int, asked: float | None, rand: Callable[[], float] = random.random) -> float:
        return asked if asked is not None else rand() * min(self.longest, self.base * 2**attempt)

    @staticmethod
    def transient(error: Exception) -> bool:
        if isinstance(error, urllib.error.HTTPError):
            return error.code in (408, 425, 429) or error.code >= 500
        return isinstance(error, (urllib.error.URLError, TimeoutError, ConnectionError))


class RateLimiter:
    """acquire() waits until so many seconds are over since the one before."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.seconds, self.clock, self.sleep = max(0.0, seconds), clock, sleep
        self.free, self.lock = 0.0, threading.Lock()

    def acquire(self) -> None:
        with self.lock:
            now = self.clock()
            at = max(now, self.free)
            self.free = at + self.seconds
        if at > now:
            self.sleep(at - now)


@dataclass(frozen=True)
class FetchOptions:
    """How a site is fetched; from_environment reads what is set there."""

    sports: tuple[str, ...] | None = None
    concurrency: int = 3
    delay: float = 0.15  # seconds between requests
    attempts: int = 3
    bulk_timeout: float = 120.0
    interval: float = 120.0
    log_level: str = "info"
    leagues_a_request: int = 20

    @classmethod
    def from_environment(cls, site: str = "", env: Mapping[str, str] = os.environ) -> FetchOptions:
        """MATCH_SPORTS, MATCH_FETCH_INTERVAL_MS, MATCH_FETCHER_LOG_LEVEL, and for a site {SITE}_CONCURRENCY, _REQUEST_DELAY_MS, _RETRY_ATTEMPTS, _BULK_TIMEOUT_MS, _LOG_LEVEL; what is no number is as if unset."""

        def number(name: str, default: float) -> float:
            try:
                return float(env.get(name, ""))
            except ValueError:
                return default

        own = site.upper()
        sports = enabled_sports(env.get("MATCH_SPORTS"))
        return cls(
            tuple(sports) if sports else None, max(1, int(number(f"{own}_CONCURRENCY", cls.concurrency))), number(f"{own}_REQUEST_DELAY_MS", cls.delay * 1000) / 1000, max(1, int(number(f"{own}_RETRY_ATTEMPTS", cls.attempts))),
            number(f"{own}_BULK_TIMEOUT_MS", cls.bulk_timeout * 1000) / 1000, number("MATCH_FETCH_INTERVAL_MS", cls.interval * 1000) / 1000, env.get(f"{own}_LOG_LEVEL") or env.get("MATCH_FETCHER_LOG_LEVEL") or cls.log_level,
        )


#: Bytes of an answer at most; a longer one is an error, not a part of it.
LONGEST = 32 << 20


def fetch_url(url: str, timeout: float = 30.0) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as r:
        body = r.read(LONGEST + 1)
    if len(body) > LONGEST:
        raise ValueError(f"more than {LONGEST} bytes from {url}")
    return body.decode("utf-8", "replace")


def fetch(url: str, get: Callable[[str, float], str] = fetch_url, retry: Retry = Retry(), timeout: float = 30.0, sleep: Callable[[float], None] = time.sleep, tries: list[int] | None = None) -> str:
    """The answer to a request; tries gets a 1 for each time it was sent."""
    for attempt in range(retry.attempts):
        if tries is not None:
            tries.append(1)
        try:
            return get(url, timeout)
        except Exception as e:
            if attempt + 1 == retry.attempts or not retry.transient(e):
                raise
            asked = getattr(e, "headers", None) and e.headers.get("Retry-After")
            sleep(retry.wait(attempt, float(asked) if asked and asked.isdigit() else None))
    raise AssertionError


def events_url(base: str, league_ids: Iterable[str], layout: str) -> str:
    """The request for the events of some leagues of the HTML site."""
    query = [("sec", "ASIAN_LAYOUT"), ("subsec", "REQUEST_GET_SCHEME_EVENTS"), *(("league_id[]", x) for x in league_ids), ("layout_schema_code", layout), ("start", ""), ("end", ""), ("selected_date_period", "null")]
    return f"{base}/getdata.php?{urllib.parse.urlencode(query)}"


def answered(url: str, get: Callable[[str, float], str], retry: Retry, timeout: float) -> tuple:
    """url, payload, error, tries, bytes of one request."""
    tries: list[int] = []
    try:
        text = fetch(url, get, retry, timeout, tries=tries)
    except Exception as e:
        return url, None, f"{type(e).__name__}: {e}", len(tries), 0
    return url, text, None, len(tries), len(text.encode())


ANSWER = "payload string, error string, tries int, bytes bigint"


def answers(requests: DataFrame, get: Callable[[str, float], str] = fetch_url, options: FetchOptions = FetchOptions(), timeout: float = 30.0) -> DataFrame:
    """requests (a column url among others) with ANSWER's columns, at most `concurrency` at a time, `delay` apart in each."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema] + [ANSWER])

    def run(frames):
        limiter, retry = RateLimiter(options.delay), Retry(options.attempts)
        for frame in frames:
            out = []
            for url in frame["url"]:
                limiter.acquire()
                out.append(answered(url, get, retry, timeout)[1:])
            for k, name in enumerate(("payload", "error", "tries", "bytes")):
                frame[name] = [row[k] for row in out]
            yield frame

    return requests.repartition(options.concurrency, "url").mapInPandas(run, schema)


def counters(answered_rows: DataFrame) -> DataFrame:
    """requests, retries, failed and bytes of all answers."""
    return answered_rows.agg(F.count("*").alias("requests"), F.coalesce(F.sum(F.greatest(F.col("tries") - 1, F.lit(0))), F.lit(0)).alias("retries"), F.count("error").alias("failed"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def quarantine(answered_rows: DataFrame, path: str) -> bool:
    """Failed requests with their errors as JSON; nothing is written if there are none."""
    failed = answered_rows.where("error is not null").select("url", "error", "tries")
    if failed.isEmpty():
        return False
    failed.write.mode("overwrite").json(path)
    return True


def events_requests(wanted: DataFrame, base: str, size: int = 20) -> DataFrame:
    """sport_no, sport, url: the requests for the events of a menu's sports, so many leagues in each."""
    chunk = wanted.select("sport_no", "sport", "layout", F.posexplode(F.col("league_ids")).alias("at", "league"))
    groups = chunk.groupBy("sport_no", "sport", "layout", F.floor(F.col("at") / size).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "league"))), lambda x: x["league"]).alias("ids"))
    leagues = F.array_join(F.transform("ids", lambda x: F.concat(F.lit("&league_id%5B%5D="), F.url_encode(x))), "")
    head, tail = events_url(base, [], "\0").split("&layout_schema_code=%00")
    return groups.select("sport_no", "sport", F.concat(F.lit(head), leagues, F.lit("&layout_schema_code="), F.url_encode("layout"), F.lit(tail)).alias("url"))


def collect_html(spark: SparkSession, base: str, menu_url: str, get: Callable[[str, float], str] = fetch_url, options: FetchOptions = FetchOptions()) -> tuple[DataFrame, DataFrame]:
    """From the menu to the events: rows to collect, and all answers for counters and quarantine."""
    enabled = list(options.sports) if options.sports else None
    asked = spark.createDataFrame([(None, None, menu_url)], "sport_no string, sport string, url string")
    menu = saved(answers(asked, get, options))
    wanted, _ = payloads.select_sports(payloads.parse_menu(menu.where("payload is not null").select(F.col("payload").alias("html"))), enabled)
    got = saved(answers(events_requests(wanted, base, options.leagues_a_request), get, options))
    pages = got.where("payload is not null").select(F.col("url").alias("capture"), F.col("sport_no").alias("asked"), "sport", F.col("payload").alias("html"))
    events = payloads.parse_events(pages)
    return payloads.html_events(events, F.col("asked"), F.col("sport")), menu.unionByName(got)


@dataclass
class _Request(InputPartition):
    url: str

    def __init__(self, url: str):
        self.url = url


class PayloadSource(DataSource):
    """format("payloads"), option urls (parted by line feeds): url, payload, error, tries and bytes of each request.

    A request that fails gives a row with its error, so that one broken answer loses no other.
    """

    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return "url string, payload string, error string, tries int, bytes bigint"

    def reader(self, schema) -> DataSourceReader:
        return _PayloadReader([u for u in self.options.get("urls", "").split("\n") if u], float(self.options.get("timeout", "30")), int(self.options.get("attempts", "3")))


class _PayloadReader(DataSourceReader):
    def __init__(self, urls: list[str], timeout: float, attempts: int):
        self.urls, self.timeout, self.attempts = urls, timeout, attempts

    def partitions(self) -> list[InputPartition]:
        return [_Request(u) for u in self.urls]

    def read(self, partition: _Request) -> Iterator[tuple]:
        yield answered(partition.url, fetch_url, Retry(self.attempts), self.timeout)


def request(spark: SparkSession, urls: list[str], timeout: float = 30.0, attempts: int = 3) -> DataFrame:
    spark.dataSource.register(PayloadSource)
    return spark.read.format("payloads").options(urls="\n".join(urls), timeout=str(timeout), attempts=str(attempts)).load()


@dataclass(frozen=True)
class Connector:
    """How a site's captured payloads become rows to collect; options as documented by its parser."""

    site: str
    parse: Callable[..., DataFrame]
    options: tuple[str, ...] = field(default=())


def _html(captured: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """captured: kind (menu or events), sport_no, payload."""
    menu = payloads.parse_menu(captured.where("kind = 'menu'").select(F.col("payload").alias("html")))
    wanted, _ = payloads.select_sports(menu, enabled)
    pages = captured.where("kind = 'events'").select(F.col("sport_no").alias("asked"), F.col("payload").alias("html"))
    # A sport may stand in a menu several times, with some of its leagues each.
    events = payloads.parse_events(pages).join(wanted.select(F.col("sport_no").alias("asked"), "sport").distinct(), "asked")
    return payloads.html_events(events, F.col("asked"), F.col("sport"))


def _tree(captured: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """captured: kind (games), sport (a key), payload."""
    rows = captured.where("kind = 'games'")
    return payloads.tree_events(rows.where(F.col("sport").isin(*enabled)) if enabled else rows, F.col("sport"))


def _records(captured: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """captured: kind (sports or matches), payload."""
    sports = payloads.discover_sports(payloads.records(captured.where("kind = 'sports'")), enabled)
    rows = payloads.records(captured.where("kind = 'matches'"))
    rows = rows.join(sports.select(F.col("id").alias("own_sport"), "sport"), F.col("sportId") == F.col("own_sport"))
    return payloads.record_events(rows, F.col("own_sport"), F.col("sport"))


CONNECTORS = {c.site: c for c in (Connector("html", _html), Connector("tree", _tree), Connector("records", _records))}


def is_supported(site: str) -> bool:
    return site in CONNECTORS


def site_events(site: str, captured: DataFrame, enabled: list[str] | None = None, dates: list[str] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """A site's collected events with their state."""
    if not is_supported(site):
        raise ValueError(f"no connector for {site!r}; there are {', '.join(CONNECTORS)}")
    return collect_events(CONNECTORS[site].parse(captured, enabled), "arrival", dates, first, last)
