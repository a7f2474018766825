from corpuslake.operators import report
from corpuslake.sources import artifact, web

PROSE = "word " * 40


class Site:
    """A site in a dictionary, and a clock that only sleeping moves."""

    def __init__(self, pages, robots=web.Response(404), error=None):
        self.pages, self.robots, self.error, self.now, self.asked = pages, robots, error, 0.0, []

    def get(self, url):
        self.asked.append((self.now, url))
        path = url.split("//", 1)[1].partition("/")[2]
        if self.error:
            raise web.TransportError(self.error)
        if path == "robots.txt":
            if isinstance(self.robots, str):
                raise web.TransportError(self.robots)
            return self.robots
        page = self.pages.get("/" + path)
        return page if isinstance(page, web.Response) else web.Response(200, "text/html", page) if page is not None else web.Response(404)

    def sleep(self, s):
        self.now += s

    def crawl(self, n=40, resolves=lambda h: True):
        f = web.Fetcher(self.get, resolves, clock=lambda: self.now, sleep=self.sleep)
        return web.crawl_site("A.com", f, web.page_kind, lambda p: "/blog" in p or "/team" in p, n)


def outcomes(c):
    return {u.removeprefix("https://a.com"): o for u, _, o, _ in c.pages}


def test_polite_crawl_with_robots_and_links():
    pages = {"/": f"<p>{PROSE}</p><a href='/blog/x'>x</a><a href='/blog/y/'>y</a><a href='/shop'>s</a>", "/team": f"<p>{PROSE}</p>", "/blog/x": f"<p>{PROSE}</p>",
             "/about": "<p>thin</p>", "/contact": web.Response(200, "application/pdf", "x")}
    site = Site(pages, web.Response(200, "text/plain", "User-agent: *\nDisallow: /blog/y"))
    c = site.crawl()
    got = outcomes(c)
    assert (c.domain, c.robots_reason, c.outcome) == ("a.com", "ok", "completed")
    assert got["/"] == got["/team"] == got["/blog/x"] == "stored" and got["/about"] == "thin_extraction" and got["/contact"] == "non_html"
    assert got["/blog/y"] == "skipped_robots" and got["/jobs"] == "http_error" and "/shop" not in got
    assert not any(u.endswith("/blog/y") for _, u in site.asked)
    times = [t for t, _ in site.asked]
    assert all(b - a >= web.DELAY for a, b in zip(times, times[1:]))


def test_budget_goes_by_cap_and_priority():
    pages = {p: f"<p>{PROSE}</p>" for p in web.SEEDS} | {f"/blog/{i}": f"<p>{PROSE}</p>" for i in range(30)}
    pages["/"] += "".join(f"<a href='/blog/{i}'>x</a>" for i in range(30))
    got = outcomes(Site(pages).crawl(10))
    kept = [u for u, o in got.items() if o == "stored"]
    assert len(kept) == 10 and sum("blog" in u for u in kept) <= 2 and sum(web.page_kind(f"https://a.com{u}") == "job_posting" for u in kept) == 3
    assert set(got.values()) == {"stored", "budget_exhausted"}


def test_aborts():
    assert (Site({}, web.Response(503)).crawl().outcome, outcomes(Site({}, web.Response(503)).crawl())["/"]) == ("aborted_robots", "skipped_robots")
    dead = Site({}, "connect")
    c = dead.crawl(resolves=lambda h: False)
    assert c.outcome == "aborted_unreachable" and c.pages[0][2] == "dns_failure" and len(dead.asked) == 1
    assert Site({}, "connect").crawl().pages[0][2] == "transport_error"
    slow = Site({"/": f"<p>{PROSE}</p>"}, "timeout")
    assert slow.crawl().outcome == "completed" and slow.crawl().robots_reason == "fetch_failed"  # a timeout alone ends nothing
    down = Site({}, error="timeout")
    c = down.crawl()
    assert c.outcome == "aborted_unreachable" and len(c.pages) == 26 and [o for _, _, o, _ in c.pages[:4]] == ["timeout"] * 3 + ["budget_exhausted"]
    assert {web.Response(401): "unreadable", web.Response(404): "absent", web.Response(302): "fetch_failed"} == {r: Site({}, r).crawl().robots_reason for r in (web.Response(401), web.Response(404), web.Response(302))}


def test_one_task_a_domain(spark):
    def fetcher(domain):
        return web.Fetcher(lambda url: web.Response(200, "text/html", "<p>" + "word " * 40 + "</p>") if url.count("/") == 3 and url.endswith("/") else web.Response(404), sleep=lambda s: None)

    got = web.crawl_sites(spark, ["a.com", "b.com"], fetcher).collect()
    assert sorted(r.domain for r in got if r.outcome == "stored") == ["a.com", "b.com"] and len(got) == 52


def test_artifact_files_of_both_forms(spark, tmp_path):
    import json

    one = {"company_name": "C", "domain": "a.com", "base_url": "b", "crawled_at": "2026-01-01T00:00:00+00:00", "documents": [], "page_outcomes": []}
    (tmp_path / "pretty.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(one | {"domain": d}) for d in ("b.com", "c.com")) + "\n")
    assert sorted(r.domain for r in artifact.read_artifacts(spark, str(tmp_path)).collect()) == ["a.com", "b.com", "c.com"]


def test_report_lines():
    rows = [{"domain": "a", "refused": None, "inserted": 1, "updated": None, "unchanged": 0, "reordered": 0, "relabelled": 0, "removed": ["u"], "held": ""}, {"domain": "b", "refused": "too old"}]
    assert report.load_lines(rows) == ["  a: 1 inserted, 0 updated, 0 unchanged, 0 reordered, 0 relabelled; 1 removed", "    u", "  b: refused, too old"]
    assert report.hit_lines([]) == ["  nothing was retrieved"] and "0.5000" in report.hit_lines([{"score": 0.5, "kind": "website", "source_url": "u", "content": "x  y"}])[0]
    lines = report.run_lines([], [{"k": 1, "recall": None, "scored": 0}], [{"state": "never_attempted", "url": "u", "outcome": None}], [{"domain": "d", "accuracy": None, "compared": 0, "mismatches": []}])
    assert lines == ["  recall@1: not measured of 0", "  missing source u: never attempted", "  d signals: not measured of 0"]
    assert report.text_lines({"text": "a b\n\nc"}) == ["a b", "", "c"] and report.document_lines([]) == ["  no document"]
