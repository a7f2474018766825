import datetime as dt
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.operators import answering, chunking, embedding, evaluation, frontier, loading, retrieval
from corpuslake.plans import integrity, pipeline
from corpuslake.sources import artifact, ground_truth
from corpuslake.sources.schemas import TABLES
from corpuslake.streaming import incremental

CHUNKS = "id long, document_id long, prospect_id long, kind string, chunk_index int, content string, token_count int, embedding array<float>, embedding_model string"


@pytest.fixture(scope="module")
def stored(spark):
    """Two tenants; the other one's chunk is nearer to the query."""
    e = lambda *v: [float(x) for x in v]
    rows = [
        (1, 10, 1, "website", 0, "near", 3, e(0.9, 0.1, 0), "m"), (2, 10, 1, "website", 1, "far", 3, e(0, 1, 0), "m"), (3, 20, 2, "website", 0, "foreign", 3, e(1, 0, 0), "m"),
        (4, 11, 1, "website", 0, "none", 5, None, None), (5, 11, 1, "website", 1, "zero", 5, e(0, 0, 0), "m"), (6, 11, 1, "website", 2, "twin", 3, e(0.9, 0.1, 0), "m"),
    ]
    chunks = spark.createDataFrame(rows, CHUNKS)
    docs = spark.createDataFrame([(10, 1, "https://a/x"), (11, 1, "https://a/y"), (20, 2, "https://b/x")], "id long, prospect_id long, source_url string")
    return chunks, docs


@pytest.mark.parametrize("k", [1, 3, 5, 10])
def test_foreign_chunk_is_never_returned(stored, k):
    scope = retrieval.TenantScope(*stored, 1, "m")
    hits = scope.top_chunks([1.0, 0.0, 0.0], k).collect()
    assert [h.id for h in hits] == [1, 6, 2][:k]  # ties by id; no vector and a zero vector are left out
    assert {r.id: r.source_url for r in scope.source_urls(scope.top_chunks([1.0, 0.0, 0.0], k)).collect()}.keys() == {1, 6, 2} & {h.id for h in hits}


def test_leak_gate_and_model_mix(spark, stored):
    scope = retrieval.TenantScope(*stored, 1)
    hits = spark.createDataFrame([(1,), (3,)], "id long")
    with pytest.raises(retrieval.LeakageError):
        retrieval.check_no_leakage(hits, scope.source_urls(hits))
    retrieval.check_no_leakage(hits.filter("id = 1"), scope.source_urls(hits))
    with pytest.raises(retrieval.ModelMixError):
        retrieval.TenantScope(*stored, 1, "other")
    counts = scope.counts().first()
    assert (counts.chunks, counts.embedded, counts.pending_tokens) == (5, 4, 5) and [r.id for r in scope.pending().collect()] == [4]


def test_ranked_in_blocks(spark, stored, monkeypatch):
    chunks = stored[0].withColumnRenamed("prospect_id", "tenant")
    queries = spark.createDataFrame([(i, 1 + i % 2, [1.0, 0.0, 0.0]) for i in range(6)], "query_id int, tenant long, query array<double>")
    whole = sorted(tuple(r) for r in retrieval.ranked(queries, chunks, 2).collect())
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    assert sorted(tuple(r) for r in retrieval.ranked(queries, chunks, 2).collect()) == whole and len(whole) == 3 * 2 + 3 * 1


def test_scores_equal_by_nine_digits_tie_and_go_by_id(spark):
    # 1 - 5e-11 and 1 - 3.2e-10 round to 1, 1 - 8e-10 does not; 3 and 4 are the same direction
    rows = [(5, [1.0, 0.0]), (1, [1.0, 1e-5]), (2, [1.0, 2.5e-5]), (0, [1.0, 4e-5]), (4, [1.0, 1.0]), (3, [3.0, 3.0])]
    chunks = spark.createDataFrame([(i, 1, v) for i, v in rows], "id long, tenant int, embedding array<float>").coalesce(1)
    queries = spark.createDataFrame([(7, 1, [2.0, 0.0])], "query_id int, tenant int, query array<double>")
    assert [r.id for r in retrieval.ranked(queries, chunks).orderBy("rank").collect()] == [1, 2, 5, 0, 3, 4]
    assert [r.id for r in retrieval.ranked(queries, chunks, 1).collect()] == [1]  # the tie is kept in the batch too


def test_scores_near_a_rounding_are_summed_in_order():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(50, 64)), rng.normal(size=(50, 64))
    dots = [(sum(map(float.__mul__, x, y)), sum(map(float.__mul__, x, x)), sum(map(float.__mul__, y, y))) for x, y in zip(a.tolist(), b.tolist())]
    assert np.allclose(retrieval._plain_cosine(a, b), [d / np.sqrt(n * m) for d, n, m in dots], rtol=0, atol=1e-15)
    assert retrieval._places(np.array([0.5e-9, -0.5e-9, 0.4e-9, 1.0, 2.5e-9])).tolist() == [1, -1, 0, 1e9, 3]


def test_integrity_rules(spark, stored):
    chunks, docs = stored
    integrity.check("chunks", chunks, ((docs, {"document_id": "id", "prospect_id": "prospect_id"}),), 3)
    bad = [(7, 10, 2, "page", 0, "x", 0, [1.0], None), (8, 10, 2, "website", 0, "x", 1, None, None)]
    broken = spark.createDataFrame(bad, CHUNKS)
    with pytest.raises(integrity.IntegrityError) as error:
        integrity.check("chunks", broken, ((docs, {"document_id": "id", "prospect_id": "prospect_id"}),), 3)
    for said in ("vocabulary", "token_count", "another size", "model without embedding", "natural key", "without a parent"):
        assert said in str(error.value)
    with pytest.raises(integrity.IntegrityError):
        integrity.refuse_dimension_change(chunks, 4)


def crawl(domain, at, docs, outcome="completed", robots="ok", outcomes=None, **more):
    documents = [{"url": u, "kind": "website", "title": t, "text": x, "content_hash": c, "stable_hash": s} for u, t, x, c, s in docs]
    found = outcomes if outcomes is not None else [{"url": u, "outcome": "stored", "http_status": 200, "detail": ""} for u, *_ in docs]
    return json.dumps({"company_name": "C", "domain": domain, "base_url": "b", "crawled_at": at, "robots_reason": robots, "crawl_outcome": outcome, "signals": {"people_listed": 1, "extra": 2}, "documents": documents, "page_outcomes": found, **more})


def parsed(spark, *texts):
    return artifact.parse_artifacts(spark.createDataFrame([(t,) for t in texts], "value string"), "value")


def now():
    return F.to_timestamp(F.lit("2026-01-10T00:00:00+00:00"))


def kept(tables, spark):
    return loading.Tables(*[spark.createDataFrame(t.collect(), t.schema) for t in (tables.prospects, tables.documents, tables.chunks, tables.crawl_runs, tables.crawl_page_outcomes)])


def test_load_is_idempotent_and_never_goes_back(spark):
    empty = loading.Tables(*[spark.createDataFrame([], TABLES[t]) for t in ("prospects", "documents", "chunks", "crawl_runs", "crawl_page_outcomes")])
    chunk = pipeline.chunker(chunking.word_counter())
    load = lambda tables, *texts: loading.load(tables, parsed(spark, *texts), now(), chunk)
    one = crawl("A.com", "2026-01-02T00:00:00+00:00", [("u1", "T", "one two", "c1", "s1"), ("u2", "T", "three", "c2", "s2"), ("u3", "T", "four", "c3", "s3"), ("u4", "", "five", "c4", "s4")])
    tables, report = load(empty, one)
    first = report.collect()[0]
    assert first.domain == "a.com" and first.inserted == 4
    tables = kept(tables, spark)
    again, report = load(tables, one)
    assert report.first().unchanged == 4 and report.first().updated == 0
    for name in ("documents", "chunks", "crawl_runs", "crawl_page_outcomes"):
        assert sorted(map(str, getattr(again, name).collect())) == sorted(map(str, getattr(tables, name).collect()))
    two = crawl("a.com", "2026-01-05T00:00:00+00:00", [("u1", "New", "one two", "c1", "s1"), ("u2", "T", "eerht", "cX", "s2"), ("u3", "T", "other", "cY", "sY"), ("u5", "T", "six", "c6", "s6")])
    later, report = load(tables, two)
    r = report.first()
    assert (r.inserted, r.updated, r.unchanged, r.reordered, r.relabelled, r.removed) == (1, 3, 0, 1, 1, ["u4"])
    later = kept(later, spark)
    assert {x.source_url for x in later.documents.collect()} == {"u1", "u2", "u3", "u5"} and later.crawl_runs.count() == 2
    assert integrity.violations("documents", later.documents).collect() == [] and later.chunks.count() == 4
    older, report = load(later, crawl("a.com", "2026-01-03T00:00:00+00:00", [("u9", "T", "x", "c", "s")]))
    assert "newer" in report.first().held and {x.source_url for x in older.documents.collect()} == {"u1", "u2", "u3", "u5"} and older.crawl_runs.count() == 3
    for bad in ({"outcome": "aborted_robots"}, {"docs": []}):
        text = crawl("a.com", "2026-01-06T00:00:00+00:00", bad.get("docs", [("u1", "New", "one two", "c1", "s1")]), bad.get("outcome", "completed"))
        held, report = load(later, text)
        assert report.first().held and held.documents.count() == 4


def test_an_artifact_in_parts_loads_as_one(spark):
    empty = loading.Tables(*[spark.createDataFrame([], TABLES[t]) for t in ("prospects", "documents", "chunks", "crawl_runs", "crawl_page_outcomes")])
    chunk = pipeline.chunker(chunking.word_counter())
    at = "2026-01-02T00:00:00+00:00", "2026-01-05T00:00:00+00:00"
    first = [(f"u{i}", "T" * (1 + 300 * (i % 3)), f"text {i}", f"c{i}", f"s{i}") for i in range(9)]
    second = [(u, t if u != "u3" else "New", x + "!" * (u == "u5"), c + "!" * (u == "u5"), s + "!" * (u == "u5")) for u, t, x, c, s in [*first[2:], ("u9", "T", "nine", "c9", "s9")]]
    found = []
    for size in (99, 2):
        tables = empty
        for day, docs in zip(at, (first, second)):
            pieces = [crawl(d, day, docs[i : i + size]) for d in ("a.com", "b.com") for i in range(0, len(docs), size)]
            refused = [crawl("c.com", day, docs[i : i + size], robots="") for i in range(0, len(docs), size)]
            tables, report = loading.load(tables, parsed(spark, *pieces, *refused), now(), chunk)
            report = sorted(map(str, report.collect()))
            tables = kept(tables, spark)
        found.append((report, *[sorted(map(str, getattr(tables, t).collect())) for t in ("prospects", "documents", "chunks", "crawl_runs", "crawl_page_outcomes")]))
    assert found[0] == found[1] and len(found[0][0]) == 3 and "inserted=1, updated=2, unchanged=5" in found[0][0][1] + found[0][0][0]
    with pytest.raises(Exception, match="comes twice"):  # parts of two crawls, or with two heads
        loading.load(empty, parsed(spark, crawl("a.com", at[0], first[:1]), crawl("a.com", at[1], first[1:])), now(), chunk)[0].prospects.collect()


def test_a_load_moves_texts_twice_only(spark):
    from corpuslake.queries_made import _artifacts

    docs = spark.createDataFrame([(i, f"d{i % 2}", "word " * i) for i in range(8)], "doc_id long, domain string, text string")
    made = _artifacts(spark, "", docs)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString().replace("RoundRobin", "")
    made = made.selectExpr("*", "domain as company_name", "timestamp'2026-01-09' as crawled_at_utc", "'ok' as robots_reason", "'completed' as crawl_outcome").withColumn("signals", F.lit(None).cast(TABLES["prospects"]["signals"].dataType))
    tables = loading.Tables(**{t: spark.createDataFrame([], TABLES[t]) for t in TABLES})
    tables, report = loading.load(tables, made, now(), pipeline.chunker(chunking.word_counter()))

    def moved(df):  # sides of joins whose rows have a text
        nodes, out = [df._jdf.queryExecution().sparkPlan()], 0
        while nodes:
            node = nodes.pop()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
            if "Join" in node.nodeName() and "Broadcast" not in node.nodeName():
                out += sum(not {"text", "content", "documents"}.isdisjoint(re.findall(r"(\w+)#", node.children().apply(i).output().mkString(","))) for i in range(2))
        return out

    assert moved(report) == 0 and moved(tables.documents) == 0 and moved(tables.chunks) == 2


def test_found_documents_are_sorted_without_their_texts(spark, tmp_path):
    pieces = [crawl("a.com", "2026-01-02T00:00:00+00:00", [(f"x{i}", "T", "one\u3000two \U0001f600" * i, "c", "s")]) for i in range(4)]
    found = artifact.find_documents(parsed(spark, *pieces), "x", ("domain",))
    assert [(r.url, r.words) for r in found.collect()] == [("x3", 7), ("x2", 5), ("x1", 3), ("x0", 0)] and "text" not in found.columns
    assert "text" in artifact.find_documents(parsed(spark, *pieces), "x").columns


def test_a_large_crawl_is_written_as_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(artifact, "FILE_OBJECTS", 3, raising=False)
    made = parsed(spark, *[crawl("a.com", "2026-01-02T00:00:00+00:00", [(f"x{i}", "T", f"t{i}", "c", "s")]) for i in range(8)]).coalesce(1)
    artifact.write_artifacts(made, f"{tmp_path}/a")
    assert len(list((tmp_path / "a").glob("*.json"))) == 3
    back = artifact.read_artifacts(spark, f"{tmp_path}/a")
    assert sorted(r.url for r in artifact.documents(back).collect()) == [f"x{i}" for i in range(8)]
    assert artifact.heads(back).collect()[0].n_documents == 8 and artifact.heads(back).count() == 1


def test_refused_artifacts(spark):
    old, bare, good = crawl("o.com", "2025-01-01T00:00:00+00:00", []), crawl("b.com", "2026-01-09T00:00:00+00:00", [], robots=""), crawl("g.com", "2026-01-09T00:00:00+00:00", [])
    bad = {r.domain: r.reason for r in artifact.refused(parsed(spark, old, bare, good), now()).collect()}
    assert bad == {"o.com": "too old", "b.com": "no robots_reason"}
    for text in (crawl("x.com", "2026-01-09", [], surprise=1), json.dumps({"domain": "y.com"}), crawl("z.com", "2026-01-09", [], outcomes=[{"url": "u", "outcome": "stored", "odd": 1}])):
        with pytest.raises(Exception, match="artifact refused"):
            parsed(spark, text).collect()


def test_artifacts_written_are_read_back(spark, tmp_path):
    page = "<title>T</title><p>" + "word " * 40 + "{}</p>"
    pages = spark.createDataFrame([("https://a.com/x/", page.format(1)), ("https://a.com/y", page.format(1)), ("https://b.com/", "<p>thin</p>"), ("https://b.com/z", page.format(2))], "url string, html string")
    docs, outcomes, facts, _ = pipeline.crawl_tables(pages)
    artifact.write_artifacts(pipeline.artifacts(docs, outcomes, facts, "2026-01-09T00:00:00+00:00"), f"{tmp_path}/a")
    lines = spark.read.text(f"{tmp_path}/a")
    back = artifact.parse_artifacts(lines, "value")
    got = {r.domain: (len(r.documents), sorted(o.outcome for o in r.page_outcomes), r.signals.pages_crawled) for r in back.collect()}
    assert got == {"a.com": (1, ["duplicate_content", "stored"], 1), "b.com": (1, ["stored", "thin_extraction"], 1)}
    assert artifact.find_documents(back, "x").count() == 1 and [r.url for r in artifact.documents(back).filter("domain = 'a.com'").collect()] == ["https://a.com/x"]


def test_embedding_pass_batches_and_retry(spark, stored):
    assert embedding.plan_batches([60, 50, 10, 200, 1], 3, 100) == [(0, 1), (1, 3), (3, 4), (4, 5)] and embedding.plan_batches([]) == []
    rows = spark.createDataFrame([(k, i, n) for k in "ab" for i, n in enumerate([60, 50, 10, 200, 1] * 3)], "k string, i int, n int")
    got = {}
    for r in embedding.batches(rows, ["k"], "i", "n", 3, 100).collect():
        got.setdefault((r.k, r.batch), []).append(r.i)
    assert sorted(map(tuple, (v for (k, _), v in got.items() if k == "a"))) == [tuple(range(*x)) for x in embedding.plan_batches([60, 50, 10, 200, 1] * 3, 3, 100)]
    waits, tries = [], iter([TimeoutError(), TimeoutError()])

    def flaky():
        error = next(tries, None)
        if error:
            raise error
        return [1]

    assert embedding.with_retry(flaky, sleep=waits.append, jitter=lambda: 0.5) == [1] and waits == [1.0, 2.0]
    with pytest.raises(embedding.EmbeddingFailed):
        embedding.with_retry(lambda: 1 / 0, sleep=waits.append)
    assert len(waits) == 2  # an error of the caller's is not tried again
    chunks = stored[0]
    new = embedding.embed(chunks.filter("embedding is null"), embedding.HashEmbedder(3))
    done = embedding.write_embeddings(chunks, new, 3, ["id"])
    assert done.filter("embedding is null").isEmpty() and done.filter("embedding_model = 'hash-3'").count() == 1 and done.count() == 6
    with pytest.raises(Exception, match="another size"):
        embedding.write_embeddings(chunks, new, 4, ["id"]).collect()


def test_context_budget(spark):
    hits = spark.createDataFrame([(1, 1, 90), (1, 2, 20), (1, 3, 1), (2, 1, 900), (2, 2, 0), (3, 1, 10), (3, 2, 10)], "q int, rank int, tokens int")
    got = {(r.q, r["rank"]): (r.admitted, r.number, r.over_budget) for r in answering.admit(hits, ["q"], "rank", "tokens", 100).collect()}
    assert got == {
        (1, 1): (True, 1, False), (1, 2): (False, None, False), (1, 3): (False, None, False), (2, 1): (True, 1, True), (2, 2): (False, None, False),
        (3, 1): (True, 1, False), (3, 2): (True, 2, False),
    }


def test_answer_end_to_end(spark, stored):
    embedder = embedding.HashEmbedder(3)
    chunks = stored[0].withColumn("embedding_model", F.when(F.col("embedding").isNotNull(), embedder.name))
    scope = retrieval.TenantScope(chunks, stored[1], 1, embedder.name)

    class Echo(answering.DecliningGenerator):
        def complete(self, messages, max_tokens, temperature):
            assert messages[1]["content"].rstrip().endswith("QUESTION: what?") and "people_listed = 4" in messages[1]["content"]
            return "<think>hm</think>They do [1], [S] and [9]."

    facts = spark.createDataFrame([(4, None)], "people_listed int, open_roles_seen int")
    got = answering.answer(scope, embedder, Echo(), chunking.word_counter(), "what?", signals=facts, k=2)
    assert (got.text, got.passages, got.cites_signals, got.invalid, got.declined) == ("They do [1], [S] and [9].", [1], True, ["9"], False) and len(got.problems) == 1
    assert answering.answer(scope, embedder, answering.DecliningGenerator(), chunking.word_counter(), "q").declined
    with pytest.raises(answering.AnswerUnavailable):
        answering.answer(retrieval.TenantScope(*stored, 99), embedder, Echo(), chunking.word_counter(), "q")


def test_unmeasured_is_null_and_never_zero(spark):
    expected = spark.createDataFrame([("q1", "https://A.com/x/"), ("q2", "https://a.com/y")], "q string, url string")
    retrieved = spark.createDataFrame([("q1", i + 1, u) for i, u in enumerate(["https://a.com/z", "https://a.com/z", "https://a.com/x"])], "q string, rank int, url string")
    got = {(r.q, r.k): (r.hit, r.first_hit_rank) for r in evaluation.recalls(retrieved, expected, ["q"]).collect()}
    assert got[("q1", 1)] == (False, 3) and got[("q1", 3)] == (True, 3) and got[("q2", 10)] == (False, None) and len(got) == 8
    none = spark.createDataFrame([], "role string, declined boolean")
    assert evaluation.decline_counts(none, []).first().declined is None
    truth = spark.createDataFrame([("a", "3", None), ("b", None, None)], "domain string, people_listed string, open_roles_seen string")
    computed = spark.createDataFrame([("a", 3, 9), ("b", 1, 1)], "domain string, people_listed int, open_roles_seen int")
    rows = {r.domain: (r.compared, r.accuracy) for r in evaluation.signal_accuracy(truth, computed, "domain", ("people_listed", "open_roles_seen")).collect()}
    assert rows == {"a": (1, 1.0), "b": (0, None)}


def test_frontier_matches_the_greedy_pick(spark):
    import random

    rng = random.Random(3)
    kinds = [rng.choice(["website", "job_posting", "blog_post", "odd"]) for _ in range(120)]
    counts, left, want = {}, list(range(120)), []
    quota = {"website": 18, "job_posting": 12, "blog_post": 10, "odd": 2}
    order = {"website": 0, "job_posting": 0, "blog_post": 1, "odd": 2}
    while left and len(want) < 40:
        best = min(left, key=lambda i: (counts.get(kinds[i], 0) >= quota[kinds[i]], order[kinds[i]], i))
        left.remove(best)
        counts[kinds[best]] = counts.get(kinds[best], 0) + 1
        want.append(best)
    df = spark.createDataFrame([("t", k, i) for i, k in enumerate(kinds)], "t string, kind string, i int")
    got = frontier.crawl_order(df, "t", "i").filter("outcome = 'stored'").orderBy("pick").collect()
    assert [r.i for r in got] == want
    assert frontier.robots_rules("User-agent: *\nDisallow: /x", "bot", ["https://a/x/1", "https://a/y"]) == [False, True] and frontier.robots_rules(None, "b", ["u"]) == [True]


def test_ground_truth(spark, tmp_path):
    (tmp_path / "gt").mkdir()
    (tmp_path / "c.json").write_text("{}")
    good = {"prospect": {"company_name": "C", "domain": "a.com", "corpus_artifact": "c.json", "crawled_at": "1"}, "signals": {"people_listed": 3, "open_roles_seen": "TODO"},
            "questions": [{"id": q, "question": "q", "reference": "r", "source_urls": ["https://www.a.com/x"]} for q in ground_truth.QUESTION_IDS]}
    good["questions"][0] |= {"source_urls": [], "expected_outcome": "insufficient_evidence"}
    import yaml

    (tmp_path / "gt/b.yaml").write_text(yaml.safe_dump(good))
    report = ground_truth.validate(spark, tmp_path / "gt", tmp_path, lambda p: "2")
    assert report.ok and report.pairs == 4 and [f.where for f in report.findings] == ["signals", "prospect.crawled_at"]
    bad = json.loads(json.dumps(good))
    bad["prospect"]["domain"] = "nodots"
    bad["questions"][1]["source_urls"] = ["ftp://a.com", "https://other.com/x", "TODO"]
    bad["questions"][2] = {"id": "q9"}
    bad["questions"][3]["source_urls"] = []
    (tmp_path / "gt/a.yaml").write_text(yaml.safe_dump(bad))
    (tmp_path / "gt/c.yaml").write_text("[1")
    report = ground_truth.validate(spark, tmp_path / "gt", tmp_path)
    assert len(report.errors) == 1 + 2 + 4 + 1 + 1 and report.files == 3
    (tmp_path / "gt/c.yaml").unlink()
    assert ground_truth.read_pairs(spark, tmp_path / "gt").count() == 8
    signals = {r.domain: r.people_listed for r in ground_truth.read_signals(spark, tmp_path / "gt").collect()}
    assert signals == {"a.com": "3", "nodots": "3"}
    text = ground_truth.scaffold({"company_name": "C", "domain": "a.com", "crawled_at": "1", "documents": [{"kind": "website", "url": "u"}]}, "c.json")
    (tmp_path / "gt/a.yaml").unlink()
    (tmp_path / "gt/b.yaml").write_text(text)
    report = ground_truth.validate(spark, tmp_path / "gt", tmp_path)
    assert report.ok and len(report.findings) > 8 and "#   u" in text


def test_streams(spark, tmp_path):
    rows = [(1, dt.datetime(2026, 1, 1)), (1, dt.datetime(2026, 1, 1)), (2, dt.datetime(2026, 1, 1))]
    spark.createDataFrame(rows, "prospect_id long, started_at timestamp").write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("prospect_id long, started_at timestamp").parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run reads nothing again
        incremental.write_once(incremental.stream_runs(stream()), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    spark.createDataFrame([(1, "a b", 2, None), (2, "c", 1, None)], "id long, content string, token_count int, embedding array<float>").write.parquet(f"{tmp_path}/chunks")
    chunks = spark.readStream.schema("id long, content string, token_count int, embedding array<float>").parquet(f"{tmp_path}/chunks")
    incremental.embed_stream(chunks, embedding.HashEmbedder(8), f"{tmp_path}/vectors", f"{tmp_path}/ck2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/vectors").count() == 2


def test_a_tenant_is_read_from_its_shard_alone(spark, tmp_path):
    from corpuslake.plans import tenancy

    rows = spark.range(2000).selectExpr("id", "id % 130 - 5 as prospect_id")
    tenancy.write(rows, f"{tmp_path}/t")
    one = tenancy.read(spark, f"{tmp_path}/t", rows.schema, -3)
    assert sorted(r.id for r in one.collect()) == list(range(2, 2000, 130))
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "(shard#" in plan and "PushedFilters: [IsNotNull(prospect_id), EqualTo(prospect_id,-3)]" in plan
    assert tenancy.read(spark, f"{tmp_path}/t", rows.schema).count() == 2000


def test_an_upsert_refuses_a_key_twice(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert sorted(tuple(r) for r in loading.upsert(stored, new, ["id"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(Exception, match="comes twice"):
        loading.upsert(stored, new.unionByName(new), ["id"]).collect()


def test_long_citation_ranges_lose_nothing(spark):
    from corpuslake.functions import text as T

    rows = spark.createDataFrame([("x [2-5] [1-250000] [S]",), ("[99999999999999999999-1]",)], "t string")
    got = [r.c for r in rows.select(T.citations("t", F.lit(3)).alias("c")).collect()]
    assert list(got[0].passages) == [1, 2, 3] and got[0].signals and got[0].invalid[:2] == ["4", "5"] and got[0].invalid[-1] == "100002-250000"
    assert not got[1].passages and not got[1].invalid


def test_a_cluster_needs_its_shared_folder(spark):
    from types import SimpleNamespace

    from corpuslake.plans import storage

    def session(folder, master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master, applicationId="a"))

    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="share"):
            storage.shared_dir(session(None, master))
        assert storage.shared_dir(session("hdfs://x/y/", master)) == "hdfs://x/y"
    assert storage.shared_dir(session(None, "local[8]")) == storage.shared_dir(session(None, "local[8]"))
    one = storage.stored(spark.range(3), "gone")
    assert one.count() == 3
    storage.forget(one)
    with pytest.raises(Exception):
        spark.read.parquet(one._stage).count()
