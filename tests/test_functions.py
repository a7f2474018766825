import hashlib

import pytest
from pyspark.sql import functions as F

from corpuslake.functions import dates, text, urls


def values(spark, rows, *columns, schema="s string"):
    """Rows of columns over a table of rows, in order."""
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema).repartition(2)
    return [tuple(r[1:]) if len(columns) > 1 else r[1] for r in sorted(df.select("i", *columns).collect())]


TEXTS = ["a b a", "b a a", "a b", " a\x1cb c d\n", "", None, "É é\x0b\x85x", "Ünï ﬁ"]


def test_hashes_equal_plain_ones(spark):
    got = values(spark, TEXTS, text.content_hash("s"), text.stable_hash("s"), text.word_count("s"), text.collapse("s"))
    for t, (content, stable, n, flat) in zip(TEXTS, got):
        w = (t or "").split()
        assert content == hashlib.sha256((t or "").encode()).hexdigest()[:16] and n == len(w) and flat == " ".join(w)
        assert stable == hashlib.sha256("\0".join(sorted(w)).encode()).hexdigest()[:16]
    assert got[0][1] == got[1][1] != got[2][1] and got[0][0] != got[1][0]  # a multiset, not a set


@pytest.mark.parametrize("line, want", [
    ("Meet the Team", True), ("we ship on fridays", False), ("# x", True), ("- Item One Two", False), ("| A | B", False), ("Ends Like This.", False),
    ("One", False), ("A " * 11, False), ("Wort " * 3 + "x" * 70, False), ("  ", False), ("3) Third Point", False), ("Über Uns", True), ("the Best of us", False), ("####### x Y", True),
])
def test_headings(spark, line, want):
    assert values(spark, [line], text.looks_like_heading("s")) == [want]


@pytest.mark.parametrize("reply, n, cited, signals, invalid", [
    ("a [1], b [2, 3] [S]", 5, [1, 2, 3], True, []), ("[7]", 5, [], False, ["7"]), ("[1-3]", 5, [1, 2, 3], False, []), ("[sic] [a1] []", 5, [], False, []),
    ("[4-6] [9] [9]", 5, [4, 5], False, ["6", "9"]), ("[ 2 ][s]", 2, [2], True, []), ("[0]", 3, [], False, ["0"]), ("[3-1]", 3, [], False, []),
    ("[" + "1, " * 9 + "2]", 3, [], False, []), ("[99999999999999999999]", 3, [], False, ["99999999999999999999"]), (None, 3, [], False, []),
])
def test_citations(spark, reply, n, cited, signals, invalid):
    (got,) = values(spark, [(reply, n)], text.citations("s", "n"), schema="s string, n int")
    assert (got["passages"], got["signals"], got["invalid"]) == (cited, signals, invalid)


def test_declines_and_problems(spark):
    rows = ["Insufficient evidence. No team page.", " insufficient EVIDENCE", "**Insufficient evidence.** x", "We sell it [1]. Insufficient evidence.", "We sell it.", "It is [9]", None]
    got = values(spark, rows, text.is_decline("s"), text.decline_form("s"), F.size(text.answer_problems("s", text.citations("s", F.lit(2)))))
    assert got == [(True, "starts", 0), (True, "starts", 0), (False, "wrapped_start", 2), (False, "inside", 1), (False, "absent", 1), (False, "absent", 2), (False, "absent", 1)]
    assert values(spark, ["<think>a</think> b", "x <think>open", "<think>1</think>y<think>2</think>"], text.strip_reasoning("s")) == ["b", "x", "y"]


def test_url_forms(spark):
    rows = ["https://A.com/x//?q#f", "https://a.com", "https://a.com/", "http://a.com/b c/", "/rel/", "", None, "HTTP://User@A.com:80/P/?a=/"]
    assert values(spark, rows, urls.normalise("s")) == ["https://A.com/x", "https://a.com/", "https://a.com/", "http://a.com/b c", "/rel", "/", "/", "HTTP://User@A.com:80/P"]
    assert values(spark, rows, urls.normalise_for_evaluation("s")) == ["https://a.com/x//?q#f", "https://a.com", "https://a.com", "http://a.com/b c", "/rel", "", "", "http://user@a.com:80/P/?a="]


@pytest.mark.parametrize("url, kind", [
    ("https://a.com/playbook/our-company/career-paths", "website"), ("https://a.com/design-sprints/jobs-profile", "website"), ("https://a.com/Careers/", "job_posting"),
    ("https://a.com/blog/jobs/x", "job_posting"), ("https://a.com/trabaja-con-nosotros", "job_posting"), ("https://a.com/noticias/1", "blog_post"), ("https://jobs.com/", "website"), (None, "website"),
])
def test_page_kinds(spark, url, kind):
    assert values(spark, [url], urls.page_kind("s")) == [kind]


def test_role_names(spark):
    rows = [("https://a.com/jobs/front-end_dev/", ""), ("u", "Front-End Developer | Acme"), ("u", "Engineer — Acme Inc"), ("https://a.com/", None)]
    assert values(spark, rows, urls.role_name("s", "t"), schema="s string, t string") == ["front end dev", "Front-End Developer", "Engineer", ""]


@pytest.mark.parametrize("url, want", [
    ("https://a.com/blog/2026/9/2/t", "2026-09-02"), ("https://a.com/b/2026-08-19", "2026-08-19"), ("https://a.com/2026-13-45/", None), ("https://a.com/2031-01-01/", None),
    ("https://a.com/x?d=/2026/01/02/", None), ("https://a.com/2024/02/30/", None), ("https://a.com/2026/09/021", None), (None, None),
])
def test_dates_in_urls(spark, url, want):
    assert values(spark, [url], dates.from_url("s")) == [want]


@pytest.mark.parametrize("body, want", [
    ("Posted on 2024-05-06 by x", "2024-05-06"), ("Last updated: August 3rd, 2024. More", "2024-08-03"), ("Written 19 Sept. 2023", "2023-09-19"),
    ("If you bought a plan before October 7, 2024 you may", None), ("posted long ago, in another sentence than 2024-05-06", None), ("Published 2024-02-30", None),
    ("x" * 400 + " Posted 2024-05-06", None), ("2024-01-01 stands first. Posted 2024-05-06", None), ("before 2024-01-01 Published on May 4, 2023", "2023-05-04"), (None, None),
])
def test_bylines(spark, body, want):
    assert values(spark, [body], dates.from_byline("s")) == [want]


def test_ladder_and_stored_dates(spark):
    rows = [("https://a.com/2026/01/02/", "2020-02-02", "Posted 2021-03-03"), ("u", "2020-02-02", "Posted 2021-03-03"), ("u", "", "Posted 2021-03-03"), ("u", None, "no")]
    got = values(spark, rows, dates.published("s", "d", "t"), schema="s string, d string, t string")
    assert [tuple(g) for g in got] == [("2026-01-02", "url_path"), ("2020-02-02", "metadata"), ("2021-03-03", "byline"), (None, "none")]
    stored = values(spark, ["2024-05-06T10:00", "2024-13-01", "May", None, "2024-5-6"], dates.parse_published("s").cast("string"))
    assert stored == ["2024-05-06", None, None, None, None]
