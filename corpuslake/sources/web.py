"""A polite crawl of company sites, one task a domain. The transport is a plug-in.

A transport is a function of a URL that returns a Response, or raises TransportError. The
engine ships none that opens connections; `resolves` says whether a host's name exists.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.operators import html
from corpuslake.operators.frontier import FAILURE_STREAK, FRONTIER_FACTOR, OTHER, QUOTA, SEEDS, TRANSPORT, robots_rules
from corpuslake.settings import DEFAULTS

#: Seconds between two requests to one site (fixed value).
DELAY = 1.5


class TransportError(Exception):
    """A request without a response; kind is timeout, connect or other."""

    def __init__(self, kind: str):
        super().__init__(kind)
        self.kind = kind


@dataclass(frozen=True)
class Response:
    status: int
    content_type: str = ""
    text: str = ""


Transport = Callable[[str], Response]


@dataclass
class Fetcher:
    """Requests to one site: never faster than the delay, never against its robots.txt."""

    get: Transport
    resolves: Callable[[str], bool] = lambda host: True
    agent: str = DEFAULTS.user_agent
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    last: float | None = None
    rules: str | None = None
    reason: str = ""
    failure: str = ""

    def _paced(self, url: str) -> Response:
        if self.last is not None and (wait := DELAY - (self.clock() - self.last)) > 0:
            self.sleep(wait)
        self.last = self.clock()
        return self.get(url)

    def _why(self, error: TransportError, url: str) -> str:
        if error.kind == "timeout":
            return "timeout"
        return "dns_failure" if error.kind == "connect" and not self.resolves(urlsplit(url).hostname or "") else "transport_error"

    def read_robots(self, base: str) -> None:
        """Sets reason to one of the five; rules only where robots.txt was read; failure where it was not reached."""
        try:
            r = self._paced(f"{base}/robots.txt")
        except TransportError as error:
            self.reason, self.failure = "fetch_failed", self._why(error, base)
            return
        if r.status == 200:
            self.reason, self.rules = "ok", r.text
        elif r.status in (401, 403):
            self.reason = "unreadable"
        elif 400 <= r.status < 500:
            self.reason = "absent"
        else:
            self.reason = "server_error" if r.status >= 500 else "fetch_failed"

    def page(self, url: str) -> tuple[str | None, str, int | None]:
        """html or None, outcome (empty if there is html), status."""
        if self.reason == "server_error" or not robots_rules(self.rules, self.agent, [url])[0]:
            return None, "skipped_robots", None
        try:
            r = self._paced(url)
        except TransportError as error:
            return None, self._why(error, url), None
        if r.status != 200:
            return None, "http_error", r.status
        return (r.text, "", 200) if "html" in r.content_type.lower() else (None, "non_html", 200)


@dataclass
class Crawl:
    domain: str
    robots_reason: str = ""
    outcome: str = "completed"
    pages: list[tuple[str, str | None, str, int | None]] = field(default_factory=list)  #: url, html, outcome, status


def crawl_site(domain: str, fetcher: Fetcher, kind_of: Callable[[str], str], worth: Callable[[str], bool], max_pages: int = DEFAULTS.max_pages) -> Crawl:
    """Pages of a site, at most max_pages of them kept, the least (over cap, priority, order of finding) next.

    A robots.txt that cannot be reached ends the crawl, unless it timed out; so do
    FAILURE_STREAK failures of transport in a row before any page. What the budget leaves
    is budget_exhausted.
    """
    base = f"https://{domain.lower()}"
    out = Crawl(domain.lower())
    fetcher.read_robots(base)
    out.robots_reason = fetcher.reason
    queue = dict.fromkeys(f"{base}{path}" for path in SEEDS)
    if fetcher.reason == "server_error":
        out.outcome = "aborted_robots"
        out.pages = [(u, None, "skipped_robots", None) for u in queue]
        return out
    if fetcher.failure in ("dns_failure", "transport_error"):
        out.outcome = "aborted_unreachable"
        out.pages = [(base + "/", None, fetcher.failure, None)]
        return out
    seen, counts, kept, streak = set(queue), {}, 0, 0
    while queue and kept < max_pages:
        def rank(item: tuple[int, str]) -> tuple:
            share, priority = QUOTA.get(kind := kind_of(item[1]), OTHER)
            return counts.get(kind, 0) >= max(1, int(max_pages * share)), priority, item[0]

        _, url = min(enumerate(queue), key=rank)
        del queue[url]
        page, outcome, status = fetcher.page(url)
        text = html.extract(root := html.parse(page)) if page is not None else (None, "")
        if page is not None and text[0] is None:
            outcome = "thin_extraction"
        streak = streak + 1 if outcome in TRANSPORT else 0
        out.pages.append((url, page, outcome or "stored", status))
        if streak >= FAILURE_STREAK and not kept:
            out.outcome = "aborted_unreachable"
            break
        if page is None:
            continue
        if text[0] is not None:
            kept += 1
            counts[kind_of(url)] = counts.get(kind_of(url), 0) + 1
        for link in html.links(root, url):
            if link not in seen and worth(urlsplit(link).path) and len(queue) < FRONTIER_FACTOR * max_pages:
                seen.add(link)
                queue[link] = None
    out.pages += [(u, None, "budget_exhausted", None) for u in queue]
    return out


def page_kind(url: str) -> str:
    """As functions.urls.page_kind, for one URL."""
    import re

    from corpuslake.functions.urls import BLOG_SEGMENT, JOB_SEGMENT

    segments = urlsplit(url).path.lower().split("/")
    if any(re.match(JOB_SEGMENT, s) for s in segments):
        return "job_posting"
    return "blog_post" if any(re.match(BLOG_SEGMENT, s) for s in segments) else "website"


def crawl_sites(spark: SparkSession, domains: list[str], make_fetcher: Callable[[str], Fetcher], max_pages: int = DEFAULTS.max_pages) -> DataFrame:
    """domain, robots_reason, crawl_outcome, url, html, outcome, http_status of every URL met; one task a domain.

    Store the result: to compute it again is to crawl again.
    """
    import re

    from corpuslake.functions.urls import WORTH_READING

    names = ["domain", "robots_reason", "crawl_outcome", "url", "html", "outcome", "http_status"]
    kinds = [pa.string()] * 6 + [pa.int32()]
    worth = re.compile(WORTH_READING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for domain in b.column("domain").to_pylist():
                c = crawl_site(domain, make_fetcher(domain), page_kind, lambda p: bool(worth.search(p)), max_pages)
                rows = [(c.domain, c.robots_reason, c.outcome, *p) for p in c.pages]
                columns = list(zip(*rows)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=names)

    table = spark.createDataFrame([(d,) for d in domains], "domain string").repartition(max(1, len(domains)), F.col("domain"))
    return table.mapInArrow(run, ", ".join(f"{n} string" for n in names[:6]) + ", http_status int")
