"""One query for each operator group, over whole tables, and its DuckDB twin where SQL can say it.

The driver's tables stand in for a crawl: documents.source, pages' host and
embeddings.label are tenants, and synthetic URLs are made from ids the same way in both
engines. Roster and role operators find next to nothing on these pages; their tests are
in tests/.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.functions import dates, text, urls, vectors
from corpuslake.operators import answering, chunking, dedup, embedding, evaluation, frontier, html, loading, retrieval, signals
from corpuslake.plans.storage import spread, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


#: Tables whose rows are long texts.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in TEXTS else found


#: A URL of a document: blog posts with a date, careers pages, others. The same text in both dialects.
URL_SQL = (
    "concat('https://', source, '.Example.com/', case doc_id % 4 when 0 then concat('blog/2023/', cast(1 + doc_id % 14 as {s}), '/', cast(doc_id % 31 as {s}), '/') "
    "when 1 then 'careers/' when 2 then 'About/' else '' end, cast(doc_id as {s}), case when doc_id % 3 = 0 then '/' else '?a=1#b' end)"
)
DUCK_URL = URL_SQL.replace("{s}", "varchar")
#: Python's white space, for RE2.
WS = text.WHITE


def web_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("source").alias("domain"), F.expr(URL_SQL.replace("{s}", "string")).alias("url"), F.coalesce("text", F.lit("")).alias("text"), "lang")


# ---- retrieval


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("tenant"), "embedding")
    return rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "tenant", F.col("embedding").alias("query")), rows


_RANKED = """
WITH s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score
  FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)
"""


@query(_RANKED + "SELECT query_id, id, round(score, 4) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def k1_topk_in_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, rows = _vectors(spark, sf_dir)
    return retrieval.ranked(queries, rows, 5).withColumn("score", F.round("score", 4) + 0.0)


@query(_RANKED + "SELECT query_id, id, round(score, 4) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM r")
def k2_full_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, rows = _vectors(spark, sf_dir)
    return retrieval.ranked(queries, rows).withColumn("score", F.round("score", 4) + 0.0)


@query(_RANKED + """, e AS (SELECT q.vec_id AS query_id, c.vec_id AS id FROM embeddings q JOIN embeddings c ON q.label = c.label AND c.vec_id % 7 = q.vec_id % 7 AND c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT e.query_id, CAST(min(r.rank) AS INTEGER) AS first_hit_rank, min(r.rank) <= 5 AS hit_at_5 FROM e LEFT JOIN r ON e.query_id = r.query_id AND e.id = r.id GROUP BY e.query_id""")
def w3_first_hit_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, rows = _vectors(spark, sf_dir)
    expected = queries.alias("q").join(rows.alias("c"), F.expr("q.tenant = c.tenant and c.id % 7 = q.query_id % 7 and c.id <> q.query_id"))
    found = retrieval.first_hit(retrieval.ranked(queries, rows), expected.select("query_id", "id"), ["query_id"])
    return found.withColumn("hit_at_5", retrieval.hit_within(F.col("first_hit_rank"), 5))


@query("""WITH q AS (SELECT embedding AS v, label AS t FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 4) + 0.0 AS score FROM embeddings, q WHERE label = t
ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) DESC, vec_id LIMIT 5""")
def k1_scope_top_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the five chunks of its own tenant that are nearest to vector 0."""
    rows = table(spark, sf_dir, "embeddings")
    first = rows.filter("vec_id = 0").first()
    chunks = rows.select(
        F.col("vec_id").alias("id"), F.col("vec_id").alias("document_id"), F.col("label").alias("prospect_id"), F.lit("website").alias("kind"),
        F.lit("").alias("content"), "embedding", F.lit("m").alias("embedding_model"),
    )
    scope = retrieval.TenantScope(chunks, chunks, first["label"], "m")
    return scope.top_chunks(list(first["embedding"]), 5).select("id", (F.round("score", 4) + 0.0).alias("score"))


@query("""SELECT vec_id AS id, CAST(label AS INTEGER) AS tenant, CAST(len(embedding) AS INTEGER) AS dims, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS norm FROM embeddings""")
def f17_vector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("tenant"), F.size(e).alias("dims"), F.round(vectors.norm(e), 4).alias("norm"))


# ---- text


@query(rf"""SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS content_hash,
  substr(sha256(coalesce(list_aggregate(list_sort(list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda x: x <> '')), 'string_agg', chr(0)), '')), 1, 16) AS stable_hash,
  CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda x: x <> '')) AS INTEGER) AS words FROM documents""")
def f1_f3_hashes_and_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.content_hash("text").alias("content_hash"), text.stable_hash("text").alias("stable_hash"), text.word_count("text").alias("words"))


@query(rf"""SELECT doc_id, list_aggregate(list_concat([''], list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda x: x <> '')), 'string_agg', ' ')[2:] AS collapsed,
  concat_ws(' · ', nullif(trim(source), ''), lang) AS header FROM documents""")
def f4_f5_collapse_and_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.collapse("text").alias("collapsed"), text.provenance_header("source", "lang", F.lit(None).cast("string")).alias("header"))


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
s AS (SELECT doc_id, regexp_replace(line, '^{WS}+|{WS}+$', '', 'g') AS s, list_filter(regexp_split_to_array(line, '{WS}+'), lambda x: x <> '') AS w FROM l),
h AS (SELECT doc_id, s <> '' AND (regexp_matches(s, '^#{{1,6}}{WS}+[^\t-\r\x1c-\x20\x85\xa0]') OR (NOT regexp_matches(s, '^([-*•]|\d+[.)]){WS}+') AND NOT regexp_matches(s, '^\|') AND length(s) <= 70
  AND len(w) BETWEEN 2 AND 10 AND NOT regexp_matches(s, '[.!?:;,]$') AND len(list_filter(w, lambda x: lower(x[1]) <> x[1])) >= greatest(1, len(w) // 2))) AS heading FROM s)
SELECT doc_id, count(*) AS lines, count(*) FILTER (heading) AS headings FROM h GROUP BY doc_id""")
def f6_heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(text.looks_like_heading("line")).alias("headings"))


_REPLY = "concat(text, ' [', cast(turn as {s}), '] [S] [1-3] [', cast(conv_id % 9 as {s}), ', 2] [sic] ', case when conv_id % 5 = 0 then 'Insufficient evidence. No.' else '' end)"


@query(rf"""WITH r AS (SELECT conv_id, turn, {_REPLY.replace("{s}", "varchar")} AS t FROM conversations),
b AS (SELECT conv_id, turn, unnest(regexp_extract_all(t, '\[([^\[\]]{{1,24}})\]', 1)) AS b FROM r),
p AS (SELECT conv_id, turn, trim(unnest(string_split(b, ','))) AS p FROM b),
n AS (SELECT conv_id, turn, CAST(p AS BIGINT) AS n FROM p WHERE regexp_matches(p, '^\d+$')
  UNION ALL SELECT conv_id, turn, unnest(generate_series(CAST(regexp_extract(p, '^(\d+)\s*-', 1) AS BIGINT), CAST(regexp_extract(p, '-\s*(\d+)$', 1) AS BIGINT))) FROM p WHERE regexp_matches(p, '^\d+\s*-\s*\d+$')),
g AS (SELECT conv_id, turn, coalesce(string_agg(DISTINCT CAST(n AS VARCHAR), ',' ORDER BY CAST(n AS VARCHAR)) FILTER (n BETWEEN 1 AND 5), '') AS cited, count(DISTINCT n) FILTER (n NOT BETWEEN 1 AND 5) AS invalid FROM n GROUP BY ALL)
SELECT r.conv_id, r.turn, cited, CAST(invalid AS INTEGER) AS invalid, true AS signals,
  CASE WHEN starts_with(lower(trim(t)), 'insufficient evidence') THEN 'starts' WHEN contains(lower(t), 'insufficient evidence') THEN 'inside' ELSE 'absent' END AS form,
  CAST((invalid > 0)::int + (r.conv_id % 5 = 0 AND NOT starts_with(lower(trim(t)), 'insufficient evidence'))::int AS INTEGER) AS problems
FROM r JOIN g USING (conv_id, turn) WHERE r.t IS NOT NULL""")
def f9_f12_citations_and_declines(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_REPLY.replace("{s}", "string")).alias("reply"), F.lit(5).alias("n_passages"))
    c = F.col("citations")
    return answering.checked(replies.filter("reply is not null")).select(
        "conv_id", "turn", F.array_join(F.transform(c["passages"], lambda x: x.cast("string")), ",").alias("cited"), F.size(c["invalid"]).alias("invalid"),
        c["signals"].alias("signals"), F.col("decline_form").alias("form"), F.size("problems").alias("problems"),
    )


@query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> ''))::int AS lexemes FROM documents""")
def f18_lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.lexemes("text")).alias("lexemes"))


# ---- URLs and dates


@query(r"""SELECT page_id,
  concat(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?'), coalesce(nullif(regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)', 3), '/+$', ''), ''), '/')) AS crawl_url,
  concat(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)(.*)$', 1)), regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)(.*)$', 2), '/+$', '')) AS eval_url FROM pages""")
def p1_p2_normalise_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.normalise("url").alias("crawl_url"), urls.normalise_for_evaluation("url").alias("eval_url"))


_KIND = r"""CASE WHEN len(list_filter(string_split(lower(p), '/'), lambda s: regexp_matches(s, '^(careers?|jobs?|vacantes?|empleos?|join-us|trabaja[\w-]*)$'))) > 0 THEN 'job_posting'
  WHEN len(list_filter(string_split(lower(p), '/'), lambda s: regexp_matches(s, '^(blog|news|insights|posts?|articles?|noticias|novedades)$'))) > 0 THEN 'blog_post' ELSE 'website' END"""
_WEB = rf"""w AS (SELECT doc_id, source AS domain, {DUCK_URL} AS url, coalesce(text, '') AS text, lang, regexp_extract({DUCK_URL}, '^https://[^/]*([^?#]*)', 1) AS p FROM documents),
k AS (SELECT *, {_KIND} AS kind, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS words FROM w)"""


@query(rf"""WITH {_WEB}, d AS (SELECT *, regexp_extract(p, '/(20[12]\d)[/-](\d{{1,2}})[/-](\d{{1,2}})(?:[/-]|$)', ['y', 'm', 'd']) AS r FROM k)
SELECT doc_id, kind, CAST(try_cast(concat(r.y, '-', lpad(r.m, 2, '0'), '-', lpad(r.d, 2, '0')) AS DATE) AS VARCHAR) AS url_date FROM d""")
def p3_d1_kind_and_url_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_documents(spark, sf_dir).select("doc_id", urls.page_kind("url").alias("kind"), dates.from_url("url").alias("url_date"))


_DATED = "concat('Posted on ', cast(2015 + doc_id % 20 as {s}), '-', cast(1 + doc_id % 13 as {s}), '-', cast(1 + doc_id % 31 as {s}), case when doc_id % 2 = 0 then '. ' else ' ' end, coalesce(text, ''))"


@query(rf"""WITH t AS (SELECT doc_id, {_DATED.replace("{s}", "varchar")} AS t FROM documents), r AS (SELECT doc_id, regexp_extract(t, '^Posted on (20[12]\d)-(\d{{1,2}})-(\d{{1,2}})', ['y', 'm', 'd']) AS r FROM t),
i AS (SELECT doc_id, CAST(try_cast(concat(r.y, '-', lpad(r.m, 2, '0'), '-', lpad(r.d, 2, '0')) AS DATE) AS VARCHAR) AS published FROM r)
SELECT doc_id, published, CASE WHEN published IS NULL THEN 'none' ELSE 'byline' END AS source FROM i""")
def d3_d5_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_DATED.replace("{s}", "string")).alias("text"))
    found = docs.withColumn("p", dates.published(F.lit("https://x.com/a"), F.lit(None).cast("string"), "text"))
    return found.select("doc_id", F.col("p.date").alias("published"), F.col("p.source").alias("source"))


@query(r"""SELECT event_id, CAST(try_cast(CASE WHEN regexp_matches(substr(v, 1, 10), '^\d{4}-\d{2}-\d{2}$') THEN substr(v, 1, 10) END AS DATE) AS VARCHAR) AS day
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('2024-', lpad(CAST(1 + event_id % 14 AS VARCHAR), 2, '0'), '-', lpad(CAST(event_id % 33 AS VARCHAR), 2, '0'), 'T00') ELSE event_type END AS v FROM events)""")
def d6_parse_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr("case when event_id % 3 = 0 then concat('2024-', lpad(cast(1 + event_id % 14 as string), 2, '0'), '-', lpad(cast(event_id % 33 as string), 2, '0'), 'T00') else event_type end")
    return table(spark, sf_dir, "events").select("event_id", dates.parse_published(value).cast("string").alias("day"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s*[·|»]\s*[^·|»]{1,40}$', '')) <> '' AS named,
  regexp_replace(replace(replace(regexp_extract(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1), '-', ' '), '_', ' '), '^\s+|\s+$', '', 'g') AS slug_name,
  regexp_matches(url, '(?i)\.(xml|json|rss|atom|pdf|ics|txt)$') AS is_file FROM pages""")
def p8_p9_role_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    named = text.strip(F.regexp_replace(title, r"\s*[·|»]\s*[^·|»]{1,40}$", "")) != ""
    return table(spark, sf_dir, "pages").select("page_id", named.alias("named"), urls.role_name("url", F.lit("")).alias("slug_name"), urls.is_file("url").alias("is_file"))


# ---- duplicates, changes, upserts


def _crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = web_documents(spark, sf_dir)
    hashed = docs.select("doc_id", "domain", "url", urls.page_kind("url").alias("kind"), text.content_hash("text").alias("content_hash"), text.stable_hash("text").alias("stable_hash"))
    return stored(hashed, "hashed")


_HASHED = rf"""{_WEB}, h AS (SELECT doc_id, domain, url, kind, text, lang, words, substr(sha256(text), 1, 16) AS content_hash,
  substr(sha256(coalesce(list_aggregate(list_sort(words), 'string_agg', chr(0)), '')), 1, 16) AS stable_hash FROM k)"""


@query(rf"""WITH {_HASHED}, g AS (SELECT domain, stable_hash, min(url) AS u, count(DISTINCT url) AS n, count(DISTINCT content_hash) AS c, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM h GROUP BY ALL)
SELECT h.domain, h.url, CAST(n - 1 AS INTEGER) AS duplicates, kinds <> h.kind AS contested, CASE WHEN n > 1 THEN CASE WHEN c > 1 THEN 'reordered' ELSE 'identical' END END AS reason
FROM h JOIN g ON h.domain = g.domain AND h.stable_hash = g.stable_hash AND h.url = g.u""")
def a7_w1_deduplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    survivors, _ = dedup.deduplicate(_crawled(spark, sf_dir))
    return survivors.select("domain", "url", F.size("duplicate_urls").alias("duplicates"), (F.size("kind_conflicts") > 0).alias("contested"), F.col("duplicate_reason").alias("reason"))


@query(rf"""WITH {_HASHED}, g AS (SELECT domain, stable_hash, min(url) AS u FROM h GROUP BY ALL)
SELECT DISTINCT h.domain, h.url, u AS survivor, 'duplicate_content' AS outcome FROM h JOIN g ON h.domain = g.domain AND h.stable_hash = g.stable_hash WHERE h.url <> u""")
def a7_duplicate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, outcomes = dedup.deduplicate(_crawled(spark, sf_dir))
    return outcomes.select("domain", "url", "survivor", "outcome")


@query(rf"""WITH {_HASHED}, s AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE stable_hash END AS sh, CASE WHEN doc_id % 6 = 2 THEN 'x' ELSE content_hash END AS ch,
  CASE WHEN doc_id % 6 = 3 THEN 'old' ELSE concat('T · ', kind) END AS old FROM h WHERE doc_id % 6 <> 5)
SELECT h.doc_id, CASE WHEN s.doc_id IS NULL THEN 'inserted' WHEN s.sh IS NULL THEN 'unknown' WHEN s.sh <> h.stable_hash THEN 'changed' WHEN s.old = 'old' THEN 'relabelled'
  WHEN s.ch = h.content_hash THEN 'unchanged' ELSE 'reordered' END AS change FROM h LEFT JOIN s USING (doc_id)""")
def c5_j3_change_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _crawled(spark, sf_dir).withColumns({"title": F.lit("T"), "published": F.lit(None).cast("string")})
    case = F.expr("doc_id % 6")
    head = F.concat(text.provenance_header("title", "kind", "published"), F.lit("\n\nbody"))
    stored = new.filter(case != 5).select(
        "doc_id", F.when(case == 2, "x").otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(case == 0, F.lit(None)).when(case == 1, "x").otherwise(F.col("stable_hash")).alias("stable_hash"), F.when(case == 3, "old").otherwise(head).alias("head"),
    )
    return loading.change_classes(new, stored, ["doc_id"]).select("doc_id", "change")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j5_removed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return loading.removed(table(spark, sf_dir, "orders"), returned, ["o_orderkey"]).select("o_orderkey")


@query("""WITH n AS (SELECT o_custkey AS c_custkey, max(o_totalprice) AS c_acctbal FROM orders GROUP BY 1)
SELECT c_custkey, c_name, round(coalesce(n.c_acctbal, customer.c_acctbal), 2) AS c_acctbal FROM customer LEFT JOIN n USING (c_custkey)
UNION ALL SELECT n.c_custkey, NULL, round(n.c_acctbal, 2) FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)""")
def snk3_snk4_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    best = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    incoming = best.join(stored.select("c_custkey", "c_name"), "c_custkey", "left").select("c_custkey", "c_name", "c_acctbal")
    return loading.upsert(stored, incoming, ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def snk5_snk6_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    return loading.insert_absent(stored, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def w6_w7_latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loading.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts").select("user_id", "event_id", "event_type")


# ---- crawl outcomes and frontier


@query("SELECT user_id, event_type AS outcome, count(*) AS n FROM events GROUP BY ALL")
def a5_outcome_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.tally(table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("outcome")), ["user_id"])


@query("""WITH c AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'timeout' ELSE event_type END AS outcome, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN outcome = 'timeout' THEN 0 ELSE 1 END, n DESC, f) AS r, CAST(sum(n) OVER (PARTITION BY user_id) AS BIGINT) AS total FROM c)
SELECT user_id, outcome AS cause, n, total FROM b WHERE r = 1""")
def a6_explain_empty_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    outcomes = rows.select("user_id", F.when(F.col("event_type") == "error", "timeout").otherwise(F.col("event_type")).alias("outcome"), F.col("event_id").alias("position"))
    runs = rows.select("user_id").distinct().withColumns({"robots_reason": F.lit("ok"), "crawl_outcome": F.lit("completed")})
    return frontier.explain_empty(outcomes, runs, "user_id")


@query(rf"""WITH {_WEB}, n AS (SELECT doc_id, domain, kind, row_number() OVER (PARTITION BY domain, kind ORDER BY doc_id) AS i FROM k),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY domain ORDER BY CASE kind WHEN 'website' THEN i > 18 WHEN 'job_posting' THEN i > 12 ELSE i > 10 END, kind = 'blog_post', doc_id) AS pick FROM n)
SELECT doc_id, CAST(pick AS INTEGER) AS pick, CASE WHEN pick <= 40 THEN 'stored' ELSE 'budget_exhausted' END AS outcome FROM r""")
def k3_c10_crawl_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = web_documents(spark, sf_dir).select("doc_id", "domain", urls.page_kind("url").alias("kind"))
    return frontier.crawl_order(queue, "domain", "doc_id").select("doc_id", "pick", "outcome")


@query("""SELECT event_id, CASE WHEN s IN (401, 403) THEN 'unreadable' WHEN s BETWEEN 400 AND 499 THEN 'absent' WHEN s >= 500 THEN 'server_error' WHEN s = 200 THEN 'ok' ELSE 'fetch_failed' END AS reason,
  s < 500 OR s IS NULL AS allowed FROM (SELECT event_id, [200, 301, 401, 403, 404, 503, NULL][1 + event_id % 7] AS s FROM events)""")
def src3_src4_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.get(F.array(*map(F.lit, (200, 301, 401, 403, 404, 503, None))), (F.col("event_id") % 7).cast("int"))
    found = table(spark, sf_dir, "events").select("event_id", frontier.robots_reason(status, F.lit(None).cast("string")).alias("reason"))
    return found.withColumn("allowed", frontier.robots_allows(F.col("reason"), F.lit(None).cast("boolean")))


@query("""WITH f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT user_id FROM f WHERE n <= 3 GROUP BY user_id HAVING count(*) = 3 AND bool_and(event_type IN ('error', 'view'))""")
def c10_c11_streak_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.when(F.col("event_type").isin("error", "view"), "timeout").otherwise(F.col("event_type"))
    return frontier.streak_abort(table(spark, sf_dir, "events").select("user_id", "event_id", failed.alias("outcome")), "user_id", "event_id")


@query("""SELECT user_id, sum((event_type NOT IN ('view', 'error'))::int)::bigint AS fetched, CAST(max(ts) AS TIMESTAMP) AS newest, max(ts) < TIMESTAMP '2024-01-15' AS stale FROM events GROUP BY user_id""")
def p11_src7_fetched_and_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslake.sources import artifact

    outcome = F.when(F.col("event_type") == "view", "skipped_robots").when(F.col("event_type") == "error", "budget_exhausted").otherwise("stored")
    grouped = table(spark, sf_dir, "events").groupBy("user_id").agg(artifact.pages_fetched(outcome).alias("fetched"), F.max("ts").alias("crawled_at_utc"))
    now = F.expr("timestamp_ntz'2024-02-14 00:00:00'")
    return grouped.select("user_id", "fetched", F.col("crawled_at_utc").alias("newest"), artifact.is_stale(now).alias("stale"))


# ---- signals


@query(rf"""WITH {_WEB} SELECT domain, CAST(count(*) AS INTEGER) AS pages_crawled, CAST(sum(len(words)) AS BIGINT) AS total_words, CAST(count(*) FILTER (kind = 'blog_post') AS INTEGER) AS blog_posts_seen,
  max(CAST(try_cast(concat('2023-', lpad(CAST(1 + doc_id % 14 AS VARCHAR), 2, '0'), '-', lpad(CAST(doc_id % 31 AS VARCHAR), 2, '0')) AS DATE) AS VARCHAR)) FILTER (kind = 'blog_post') AS latest_post_date,
  bool_or(kind = 'job_posting') AS has_careers_page FROM k GROUP BY domain""")
def a8_a10_corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = web_documents(spark, sf_dir).select("domain", urls.page_kind("url").alias("kind"), "text", dates.from_url("url").alias("published"))
    return signals.corpus_totals(docs)


@query(rf"""WITH {_WEB} SELECT domain, kind, string_agg(url, ' ' ORDER BY url) AS urls FROM k GROUP BY ALL""")
def a20_urls_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = web_documents(spark, sf_dir).select("domain", "url", urls.page_kind("url").alias("kind"))
    return signals.urls_by_kind(docs).withColumn("urls", F.array_join("urls", " "))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", urls.netloc("url").alias("domain"), "url", "html")
    return stored(html.parse_pages(pages), "pages-parsed")


@query()
def h1_h3_extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _pages(spark, sf_dir)
    return docs.select("page_id", "title", "reason", text.word_count("text").alias("words"), "declared", "people", F.size("links").alias("links"))


@query()
def c7_c9_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _pages(spark, sf_dir)
    docs = html.stored_documents(parsed, "domain")
    survivors, _ = dedup.deduplicate(docs)
    return signals.signals(stored(survivors, "survivors"), parsed.select("domain", "url", "links", "headings", "people"))


# ---- chunks and embedding


@query()
def c1_c4_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = web_documents(spark, sf_dir).select("doc_id", urls.page_kind("url").alias("kind"), F.lit("Title").alias("title"), F.lit(None).cast("string").alias("published"), "text")
    made = chunking.chunk_documents(docs, chunking.word_counter(), ["doc_id"])
    return made.select("doc_id", "kind", "chunk_index", "token_count", text.content_hash("content").alias("content_hash"), "chunker")



@query(rf"""WITH {_WEB} SELECT domain, count(*) AS chunks, count(*) FILTER (doc_id % 3 = 0) AS embedded, CAST(coalesce(sum(len(words)) FILTER (doc_id % 3 <> 0), 0) AS BIGINT) AS pending_tokens,
  count(*) FILTER (len(words) > 512) AS over_window FROM k GROUP BY domain""")
def a1_a2_a19_embedding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = web_documents(spark, sf_dir).select("domain", text.word_count("text").alias("token_count"), F.when(F.expr("doc_id % 3 = 0"), F.array(F.lit(1.0))).alias("embedding"))
    return embedding.report(chunks, ["domain"], 512)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 10")
def p12_k5_oldest_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.oldest(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id", 10)


# ---- context and evaluation


@query(rf"""WITH {_WEB}, r AS (SELECT domain, doc_id, CAST(len(words) AS INTEGER) AS tokens, row_number() OVER (PARTITION BY domain ORDER BY len(words) DESC, doc_id) AS rank FROM k),
s AS (SELECT *, CAST(100 + sum(tokens) OVER (PARTITION BY domain ORDER BY rank) AS BIGINT) AS running_tokens FROM r)
SELECT domain, doc_id, running_tokens, rank = 1 OR running_tokens <= 6000 AS admitted, (rank = 1 OR running_tokens <= 6000) AND running_tokens > 6000 AS over_budget FROM s""")
def w4_context_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = web_documents(spark, sf_dir).select("domain", "doc_id", text.word_count("text").alias("tokens"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("tokens"), "doc_id")))
    return answering.admit(ranked, ["domain"], "rank", "tokens", used=F.lit(100)).select("domain", "doc_id", "running_tokens", "admitted", "over_budget")


_EXPECTED = "SELECT doc_id % 50 AS question, {url} AS url FROM documents WHERE lang = 'de'"


@query(rf"""WITH d AS (SELECT doc_id, {DUCK_URL} AS url, lang, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS rank FROM documents),
n AS (SELECT doc_id % 50 AS question, rank, lang, concat(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)(.*)$', 1)), regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)(.*)$', 2), '/+$', '')) AS u FROM d),
e AS (SELECT DISTINCT question, u FROM n WHERE lang = 'de'), f AS (SELECT e.question, min(rank) AS r FROM e LEFT JOIN n USING (question, u) GROUP BY 1)
SELECT question, k, coalesce(r <= k, false) AS hit, CAST(r AS INTEGER) AS first_hit_rank FROM f, (VALUES (1), (3), (5), (10)) t(k)""")
def c19_a15_recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    docs = web_documents(spark, sf_dir).withColumn("question", F.expr("doc_id % 50"))
    retrieved = docs.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy("doc_id"))).select("question", "rank", "url")
    return evaluation.recalls(retrieved, docs.filter("lang = 'de'").select("question", "url"), ["question"])


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'missing' WHEN quality = 1 THEN 'present' ELSE 'never_attempted' END AS state,
  CASE WHEN toxic = 1 THEN 'timeout' END AS outcome FROM documents LEFT JOIN labels USING (doc_id)""")
def j6_c20_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = web_documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    crawled = docs.join(labels.filter("quality = 1 and toxic = 0"), "doc_id", "left_semi").select("domain", "url")
    outcomes = docs.join(labels.filter("toxic = 1"), "doc_id", "left_semi").select("domain", "url", F.lit("timeout").alias("outcome"))
    found = evaluation.coverage(docs.select("domain", "url"), crawled, outcomes, ["domain"])
    return found.select(F.regexp_extract("url", r"/(\d+)(?:/|\?a=1#b)$", 1).cast("long").alias("doc_id"), "state", "outcome")


@query("""SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST((quality IS NOT NULL)::int + (toxic IS NOT NULL)::int AS INTEGER) AS compared,
  CAST(coalesce((quality = (n_chars > 300)::int)::int, 0) + coalesce((toxic = 0)::int, 0) AS INTEGER) AS agreed FROM documents LEFT JOIN labels USING (doc_id)""")
def a17_j12_signal_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    truth = docs.select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    computed = docs.select("doc_id", (F.col("n_chars") > 300).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    return evaluation.signal_accuracy(truth, computed, "doc_id", ("quality", "toxic")).select("doc_id", "compared", "agreed")


@query("""SELECT role, count(*) FILTER (starts_with(lower(trim(text)), 'insufficient evidence')) AS declined, count(*) AS answered FROM conversations WHERE text IS NOT NULL GROUP BY role""")
def a16_decline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("text is not null").select("role", text.is_decline("text").alias("declined"))
    return evaluation.decline_counts(rows, ["role"])


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'insufficient_evidence' WHEN quality IS NULL OR quality = 0 THEN 'unwritten' ELSE 'scored' END AS status,
  CASE WHEN toxic = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'bait_admitted' ELSE 'empty_context' END WHEN coalesce(quality, 0) = 0 THEN NULL
    WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'admitted' WHEN doc_id % 5 = 0 THEN 'dropped_for_budget' ELSE 'not_retrieved' END AS label
FROM documents LEFT JOIN labels USING (doc_id)""")
def c17_c18_status_and_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    none = F.array().cast("array<string>")
    want = F.array(F.lit("HTTPS://a.com/x/"))
    status = evaluation.pair_status(
        F.when(F.col("toxic") == 1, "insufficient_evidence"), F.when(F.col("quality") == 1, "text").when(F.col("quality") == 0, "TODO write"), want
    )
    even = F.expr("doc_id % 2 = 0")
    admitted = F.when(even & F.expr("doc_id % 3 = 0"), F.array(F.lit("https://A.com/x"))).when(even, F.array(F.lit("https://a.com/y"))).otherwise(none)
    dropped = F.when(F.expr("doc_id % 5 = 0"), F.array(F.lit("https://a.com/x"))).otherwise(none)
    return rows.withColumn("status", status).select("doc_id", "status", evaluation.context_label(F.col("status"), want, admitted, dropped).alias("label"))



@query("""SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'our team: the people who work here, developers, engineers and designers, and their job titles' ELSE text END AS q FROM conversations""")
def f13_retrieval_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    qid = F.when(F.expr("conv_id % 3 = 0"), "q2_technical_capacity").when(F.expr("conv_id % 3 = 1"), "other")
    return rows.select("conv_id", "turn", answering.retrieval_query(F.col("text"), qid).alias("q"))


# ---- smaller operators



@query("""SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS admitted, 2 AS total FROM documents""")
def j9_sources_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = F.array(F.lit("https://A.com/x/"), F.lit("https://a.com/y"), F.lit("https://a.com/y/"))
    shown = F.array_compact(F.array(F.when(F.expr("doc_id % 2 = 0"), "https://a.com/x"), F.when(F.expr("doc_id % 3 = 0"), "HTTPS://a.com/y/"), F.lit("https://a.com/z")))
    return table(spark, sf_dir, "documents").select("doc_id", evaluation.sources_admitted(want, shown).alias("s")).select("doc_id", "s.admitted", "s.total")


@query(rf"""WITH {_HASHED}, g AS (SELECT domain, stable_hash, min(url) AS u FROM h GROUP BY ALL)
SELECT DISTINCT h.domain, u AS document, h.url FROM h JOIN g ON h.domain = g.domain AND h.stable_hash = g.stable_hash""")
def j11_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    survivors, _ = dedup.deduplicate(_crawled(spark, sf_dir))
    return signals.aliases(survivors)


@query("SELECT DISTINCT concat('m', CAST(label % 3 AS VARCHAR)) AS embedding_model FROM embeddings WHERE vec_id % 2 = 0")
def a3_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.expr("vec_id % 2 = 0"), F.concat(F.lit("m"), F.expr("cast(label % 3 as string)")))
    chunks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(1).alias("prospect_id"), model.alias("embedding_model"))
    return retrieval.TenantScope(chunks, chunks, 1).models()


_ROLES = "concat(coalesce(text, ''), case doc_id % 3 when 0 then ' | Senior Developer, CTO' when 1 then ' | data  scientist; engineers' else ' | Tech Lead' end)"


@query(rf"""SELECT doc_id, CAST(CASE doc_id % 3 WHEN 0 THEN 2 ELSE 1 END + len(regexp_extract_all(coalesce(text, ''), '(?i)(?:^|[^\p{{L}}\p{{N}}_])(developer|engineer|cto|programmer|architect|devops|sre|data\s+scientist|desarrollador|ingenier[oa]|programador|tech\s+lead)(?:$|[^\p{{L}}\p{{N}}_])')) AS INTEGER) AS mentions FROM documents""")
def a9_role_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.technical_mentions(F.expr(_ROLES)).cast("int").alias("mentions"))


@query(rf"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(concat('<think>plan ', conv_id, '</think> ', text, '<think>x</think> ', '<think>more', CAST(turn AS VARCHAR)), '<think>.*?</think>', '', 'gs'), '<think>.*$', '', 's'), '^{WS}+|{WS}+$', '', 'g') AS reply FROM conversations WHERE text IS NOT NULL""")
def f8_strip_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("text is not null")
    reply = F.expr("concat('<think>plan ', conv_id, '</think> ', text, '<think>x</think> ', '<think>more', cast(turn as string))")
    return rows.select("conv_id", "turn", text.strip_reasoning(reply).alias("reply"))


@query(r"""SELECT doc_id, concat('COMPUTED FACTS [S], counted from the company''s own pages:', chr(10), CASE WHEN quality IS NULL THEN '- none were computed for this company'
  ELSE concat('- people_listed = ', CAST(quality AS VARCHAR), ': people on that page, which is not a headcount', chr(10), '- latest_post_date = "d', CAST(toxic AS VARCHAR), '": newest date that a crawled post declares') END) AS block
FROM documents LEFT JOIN labels USING (doc_id)""")
def f15_signals_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    facts = rows.select("doc_id", F.col("quality").alias("people_listed"), F.concat(F.lit("d"), F.col("toxic").cast("string")).alias("latest_post_date"))
    return facts.select("doc_id", answering.signals_block(["people_listed", "latest_post_date"]).alias("block"))


@query(rf"""WITH {_WEB}, r AS (SELECT domain, doc_id, kind, url, list_aggregate(list_concat([''], words), 'string_agg', ' ')[2:] AS t, len(words) AS n, row_number() OVER (PARTITION BY domain ORDER BY doc_id) AS rank FROM k),
s AS (SELECT *, sum(n) OVER (PARTITION BY domain ORDER BY rank) AS used FROM r)
SELECT domain, concat('RETRIEVED PASSAGES, most similar first:', chr(10), chr(10), string_agg(concat('[', CAST(rank AS VARCHAR), '] (', kind, ') ', url, chr(10), t), chr(10) || chr(10) ORDER BY rank)) AS rendered
FROM s WHERE rank = 1 OR used <= 2000 GROUP BY domain""")
def f16_render_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    docs = web_documents(spark, sf_dir).select("domain", F.col("doc_id").alias("id"), urls.page_kind("url").alias("kind"), F.col("url").alias("source_url"), F.col("text").alias("content"), text.word_count("text").alias("tokens"))
    hits = docs.withColumn("rank", F.row_number().over(Window.partitionBy("domain").orderBy("id")))
    return answering.contexts(answering.admit(hits, ["domain"], "rank", "tokens", 2000), ["domain"]).select("domain", "rendered")


@query("""SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS embedding_model, CASE WHEN vec_id % 3 = 0 THEN 0.5 ELSE round(embedding[1], 4) + 0.0 END AS first FROM embeddings""")
def snk8_write_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.lit("old").alias("embedding_model"))
    new = chunks.filter("id % 3 = 0").select("id", F.array_repeat(F.lit(0.5).cast("float"), 64).alias("embedding"), F.lit("new").alias("embedding_model"))
    done = embedding.write_embeddings(chunks, new, 64, ["id"])
    return done.select("id", "embedding_model", (F.round(F.col("embedding")[0].cast("double"), 4) + 0.0).alias("first"))


@query("""SELECT c_custkey, n FROM (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) GROUP BY 1)
UNION ALL SELECT l_orderkey, -1 FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49)""")
def snk7_replace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("chunk"), F.lit(1).alias("prospect_id"))
    new = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("document_id")).distinct()
    new = new.select("document_id", F.lit(None).cast("long").alias("chunk"), F.lit(1).alias("prospect_id"))
    done = loading.replace_chunks(rows, rows.select(F.col("document_id").alias("id"), "prospect_id"), new, 1)
    kept = done.filter("chunk is not null").groupBy(F.col("chunk").alias("c_custkey")).agg(F.count("*").alias("n"))
    return kept.unionByName(done.filter("chunk is null").select(F.col("document_id").alias("c_custkey"), F.lit(-1).cast("long").alias("n")))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')""")
def integrity_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslake.plans import integrity

    parents = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    return integrity.orphans(table(spark, sf_dir, "lineitem"), parents, {"l_orderkey": "o_orderkey"}).select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')""")
def integrity_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslake.plans import integrity

    parents = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    return integrity.cascade(table(spark, sf_dir, "lineitem"), parents, {"l_orderkey": "o_orderkey"}).select("l_orderkey", "l_linenumber")


@query("""SELECT CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 3 = 1 THEN 0 END AS written, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS signals, doc_id FROM documents""")
def p15_p16_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.when(F.expr("doc_id % 3 = 0"), F.array(F.lit("https://a.com/x"))).when(F.expr("doc_id % 3 = 1"), F.array(F.lit("TODO https://")))
    given = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.when(F.expr("doc_id % 2 = 0"), "TODO count").otherwise("2"))
    written = F.when(evaluation.written_sources(listed).isNotNull(), 1).when(listed.isNotNull(), 0)
    return table(spark, sf_dir, "documents").select(written.alias("written"), F.size(evaluation.written_signals(given)).alias("signals"), "doc_id")
