"""Table schemas and closed vocabularies (fixed values)."""

from __future__ import annotations

from pyspark.sql import types as T

_SIMPLE = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "date": T.DateType(),
    "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType()),
}


def struct(text: str) -> T.StructType:
    """A struct type from "name type, ..." without a session."""
    return T.StructType([T.StructField(n, _SIMPLE[t]) for n, t in (x.split() for x in text.split(","))])


KIND = ("website", "job_posting", "blog_post")
ROBOTS_REASON = ("ok", "absent", "unreadable", "server_error", "fetch_failed")
CRAWL_OUTCOME = ("completed", "aborted_robots", "aborted_unreachable", "failed")
PAGE_OUTCOME = (
    "stored", "skipped_robots", "dns_failure", "timeout", "transport_error", "http_error", "non_html", "thin_extraction",
    "duplicate_content", "budget_exhausted",
)
EXTRACT_REASON = ("ok", "recovered_recall", "recovered_dom", "thin", "empty")
#: Outcomes of pages that were never requested.
NOT_FETCHED = ("skipped_robots", "budget_exhausted")

VOCABULARY = {
    ("documents", "kind"): KIND, ("chunks", "kind"): KIND, ("crawl_runs", "robots_reason"): ROBOTS_REASON,
    ("crawl_runs", "outcome"): CRAWL_OUTCOME, ("crawl_page_outcomes", "outcome"): PAGE_OUTCOME,
}

SIGNALS = struct(
    "has_team_page boolean, team_page_url string, people_listed int, technical_roles_named int, has_careers_page boolean, "
    "open_roles_seen int, technical_roles_open int, blog_posts_seen int, latest_post_date string, pages_crawled int, total_words long"
)
ARTIFACT_DOCUMENT = struct(
    "url string, kind string, title string, text string, published string, published_source string, extract_reason string, "
    "content_hash string, stable_hash string, duplicate_urls array<string>, kind_conflicts array<string>"
)
ARTIFACT_OUTCOME = struct("url string, outcome string, http_status int, detail string")
ARTIFACT = T.StructType(
    [
        *struct(
            "company_name string, domain string, base_url string, crawled_at string, robots_reason string, crawl_outcome string"
        ).fields,
        T.StructField("signals", SIGNALS),
        T.StructField("documents", T.ArrayType(ARTIFACT_DOCUMENT)),
        T.StructField("page_outcomes", T.ArrayType(ARTIFACT_OUTCOME)),
    ]
)

TABLES = {
    "prospects": T.StructType([*struct("id long, company_name string, domain string").fields, T.StructField("signals", SIGNALS)]),
    "documents": struct(
        "id long, prospect_id long, source_url string, kind string, title string, published_at date, word_count int, content_hash string, "
        "stable_hash string, duplicate_urls array<string>, fetched_at timestamp"
    ),
    "chunks": struct(
        "id long, document_id long, prospect_id long, kind string, chunk_index int, content string, token_count int, "
        "embedding array<float>, embedding_model string"
    ),
    "crawl_runs": struct(
        "id long, prospect_id long, started_at timestamp, finished_at timestamp, robots_reason string, outcome string, max_pages int, "
        "pages_fetched int, documents_stored int, user_agent string, detail string"
    ),
    "crawl_page_outcomes": struct("id long, crawl_run_id long, url string, outcome string, http_status int, detail string"),
}
#: Natural keys, unique in each table.
KEYS = {
    "prospects": ["domain"], "documents": ["prospect_id", "source_url"], "chunks": ["document_id", "chunk_index"],
    "crawl_runs": ["prospect_id", "started_at"], "crawl_page_outcomes": ["crawl_run_id", "url"],
}
#: Columns that may be null.
NULLABLE = {
    "published_at", "stable_hash", "embedding", "embedding_model", "finished_at", "detail", "http_status",
}
