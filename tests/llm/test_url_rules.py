import itertools
import random

from pyspark.sql import functions as F

from corpuslake.llm import url_rules

URLS = {
    "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
    "https://net/": ("net", "/", "net/", "block"),
    "https://xnet/": ("xnet", "/", None, None),
    "https://a.net": ("a.net", "", None, None),
    "https://a.net?/x": ("a.net", "", None, None),
    "https://a.net#/": ("a.net", "", None, None),
    "https://example.com/de/1": ("example.com", "/de/1", "example.com/de/", "block"),
    "https://example.com/DE/1": ("example.com", "/DE/1", None, None),
    "https://myexample.com/de/": ("myexample.com", "/de/", None, None),
    "x://y.org/fr/://z.net/": ("y.org", "/fr/://z.net/", "org/fr/", "allow"),
    "a.net/en/": ("", "", None, None),
    "http://a.net:80/": ("a.net:80", "/", None, None),
    "http://É.net/\nx": ("É.net", "/\nx", "net/", "block"),
    "": ("", "", None, None),
    None: ("", "", None, None),
}


def test_given_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string, n int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = url_rules.judge(pages, labels).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path, rule, verdict = URLS[r.url]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), r
    assert url_rules.judge(pages.limit(0), labels).collect() == []


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        sub, word, key = rng.choice(["www", "m", "ads"]), rng.choice(["casino", "news", "shop"]), rng.choice(["", "?ref=1", "?id=2&x"])
        url = f"https://{sub}.site{rng.randint(0, 3)}.info/{word}/{rng.randint(0, 99)}{key}"
        rows.append((i, url))
        bad = (sub == "ads" and word == "casino") or rng.random() < 0.05
        labels.append((i, None if i % 9 == 0 else int(not bad), 0))
    labels += [(5, 1, None), (5, 1, None), (10_000, 0, 1), (None, 0, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    tokens = {r.page_id: frozenset(r.t) for r in pages.select("page_id", url_rules.host().alias("host"), url_rules.path().alias("path"), "url").select("page_id", url_rules.tokens().alias("t")).collect()}
    bad_of = {}
    for i, q, t in labels:
        if i in tokens and (q is not None or t is not None):
            bad_of[i] = bad_of.get(i, False) or q == 0 or t == 1
    tally = {}
    for i, bad in bad_of.items():
        for k in range(1, 7):
            for c in itertools.combinations(sorted(tokens[i]), k):
                n = tally.setdefault(c, [0, 0])
                n[0] += 1
                n[1] += bad
    least = max(url_rules.MIN_ROWS, url_rules.MIN_SUPPORT * len(bad_of))
    rules = [frozenset(c) for c, (n, b) in tally.items() if b >= least and b / n >= url_rules.MIN_CONFIDENCE]
    want = {i for i in tokens if any(r <= tokens[i] for r in rules)}
    got = {r.page_id for r in url_rules.judge(pages, truth).filter("verdict = 'block'").collect()}
    assert got == want and 20 < len(want) < 300


def test_shorter_rules_as_good_replace_longer_ones(spark):
    rules = spark.createDataFrame([(["a"], 0.8, 0.1), (["a", "b"], 0.8, 0.1), (["a", "c"], 0.9, 0.1), (["d", "b"], 0.8, 0.1)], "antecedent array<string>, confidence double, support double")
    assert sorted(r.antecedent for r in url_rules.pruned(rules).collect()) == [["a"], ["a", "c"], ["d", "b"]]


def test_tokens_past_the_fourth_are_mined_and_matched(spark):
    deep = "/".join(f"d{k}" for k in range(30))
    good = ["http://x.a.b.c.info/1/2/3/4/good?a&b&c&d&fine", f"http://good.info/{deep}"]
    bad = ["http://ads.a.b.c.info/1/2/3/4/good?a&b&c&d&fine", "http://x.a.b.c.info/1/2/3/4/casino?a&b&c&d&fine", "http://x.a.b.c.info/1/2/3/4/good?a&b&c&d&track", f"http://bad.info/{deep}"]
    rows = [(i, u) for i, u in enumerate([u for u in good for _ in range(100)] + [u for u in bad for _ in range(25)])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    truth = spark.createDataFrame([(i, int(u in good), 0) for i, u in rows], "doc_id long, quality int, toxic int")
    got = {r.url: r.verdict for r in url_rules.judge(pages, truth).collect()}
    assert got == {u: "allow" for u in good} | {u: "block" for u in bad}


def test_null_and_repeated_urls_and_the_key_of_labels(spark):
    pages = spark.createDataFrame([(i, None) for i in range(500)] + [(1000 + i, "http://bad.info/x/77.html") for i in range(500)] + [(5000 + i, "http://fine.info/x/78/") for i in range(400)], "page_id long, url string")
    truth = spark.createDataFrame([(77, 0, None), (78, 1, 0)], "doc_id long, quality int, toxic int")
    got = url_rules.judge(pages, truth, label_key=url_rules.numbered())
    assert {(r.url, r.verdict): r["count"] for r in got.groupBy("url", "verdict").count().collect()} == {
        (None, "allow"): 500, ("http://bad.info/x/77.html", "block"): 500, ("http://fine.info/x/78/", "allow"): 400
    }
    urls = ["http://a.b/en/12", "http://a.b/12.html?x=3", "http://a.b/x12/", "http://a.b/12/x", "http://a.b/" + "9" * 30, None]
    numbers = [r.n for r in spark.createDataFrame([(u,) for u in urls], "url string").select(url_rules.numbered().alias("n")).collect()]
    assert numbers == [12, 12, 12, None, None, None]


def test_very_long_urls_and_ties(spark):
    """A path of 100,000 characters, one of 2,000 segments, and rules of the same confidence."""
    long = ["http://long.info/" + "a" * 100_000, "http://deep.info/" + "/".join(f"s{i}" for i in range(2000))]
    rows = [u for u in long for _ in range(40)] + ["http://tie.info/x/y"] * 40 + ["http://ok.info/z"] * 60 + ["", "://", "http://"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    truth = spark.createDataFrame([(i, int(u == "http://ok.info/z"), 0) for i, u in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = {r.url: r.verdict for r in url_rules.judge(pages, truth).collect()}
    assert got == {u: "allow" if u in ("http://ok.info/z", "", "://", "http://") else "block" for u in rows}
