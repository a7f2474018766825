"""Loading a crawl: change classes, copy-on-write upserts, removals; safe to run again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions import dates, text
from corpuslake.plans.integrity import cascade
from corpuslake.settings import DEFAULTS
from corpuslake.sources import artifact as A

#: Classes whose documents are chunked anew.
RECHUNK = ("inserted", "relabelled", "changed", "unknown")


def row_id(*keys: str) -> Column:
    """A stable id from a natural key."""
    return F.xxhash64(*keys)


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """stored with incoming rows in place of those of the same key. A new table, to be published by swap.

    An anti-join and a union: each side is shuffled once by key, or the incoming one
    broadcast where it is small. A key twice in incoming fails the write.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    once = F.when(F.col("__nth") > 1, F.raise_error(F.lit("a key comes twice in one upsert")).cast("boolean")).otherwise(True)
    checked = incoming.select(*stored.columns, nth.alias("__nth")).filter(once).drop("__nth")
    return stored.join(incoming.select(*keys), keys, "left_anti").unionByName(checked)


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of incoming whose key is not stored, each key once: what an append writes."""
    return incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The newest row of each key; ties go by the other columns, so the result is one and the same each time."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.max(F.struct(by, *[c for c in rest if c != by]))
    return rows.groupBy(*keys).agg(order.alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def newest_start(runs: DataFrame) -> DataFrame:
    """prospect_id, newest: when each tenant's latest crawl began."""
    return runs.groupBy("prospect_id").agg(F.max("started_at").alias("newest"))


def first_chunks(chunks: DataFrame, chars: Column | None = None) -> DataFrame:
    """id (of a document), head: the content of its first chunk, or so many characters of it."""
    head = F.col("content") if chars is None else F.substring("content", F.lit(1), chars)
    return chunks.filter("chunk_index = 0").select(F.col("document_id").alias("id"), head.alias("head"))


def removed(stored: DataFrame, crawled: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows that the crawl has no more."""
    return stored.join(crawled.select(*keys), keys, "left_anti")


def _lead() -> Column:
    """What a document's first chunk begins with."""
    top = text.provenance_header("title", "kind", "published")
    return F.when(top == "", "").otherwise(F.concat(top, F.lit("\n\n")))


def change_classes(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Every column of incoming, and change: inserted, unchanged, reordered, relabelled, changed, unknown.

    incoming: keys, title, kind, published, content_hash, stable_hash, and chunker if the
    stored side has it; stored: keys, content_hash, stable_hash, head (content of the first
    chunk). A document keeps its chunks if its words are the same and their header still
    is what its chunks begin with; so a changed title counts. Without a stored
    stable hash nothing is known. A chunker other than the stored one is a change too.
    """
    has_chunker = "chunker" in incoming.columns and "chunker" in stored.columns
    s = stored.select(
        *keys, F.lit(True).alias("__there"), F.col("content_hash").alias("__content"), F.col("stable_hash").alias("__stable"),
        F.col("head").alias("__head"), *[F.col("chunker").alias("__chunker")] * has_chunker,
    )
    same_head = F.coalesce(F.col("__head").startswith(_lead()), F.lit(False))
    if has_chunker:
        same_head = same_head & F.col("chunker").eqNullSafe(F.col("__chunker"))
    known = F.coalesce(F.col("__stable"), F.lit("")) != ""
    same_words = known & F.coalesce(F.col("__stable") == F.col("stable_hash"), F.lit(False))
    change = (
        F.when(F.col("__there").isNull(), "inserted").when(~known, "unknown").when(~same_words, "changed").when(~same_head, "relabelled")
        .when(F.col("__content").eqNullSafe(F.col("content_hash")), "unchanged").otherwise("reordered")
    )
    return incoming.join(s, keys, "left").select(*incoming.columns, change.alias("change"))


def load_counts(classed: DataFrame, tenant: str) -> DataFrame:
    """Per tenant: inserted, updated, unchanged, reordered, relabelled. A reordered or relabelled document is updated too."""
    n = lambda *c: F.count_if(F.col("change").isin(*c))
    return classed.groupBy(tenant).agg(
        n("inserted").alias("inserted"), n("reordered", "relabelled", "changed", "unknown").alias("updated"), n("unchanged").alias("unchanged"),
        n("reordered").alias("reordered"), n("relabelled").alias("relabelled"),
    )


@dataclass
class Tables:
    """The stored tables; a load gives new ones and changes none."""

    prospects: DataFrame
    documents: DataFrame
    chunks: DataFrame
    crawl_runs: DataFrame
    crawl_page_outcomes: DataFrame


def load(tables: Tables, artifacts: DataFrame, now: Column, chunk, max_age_hours: int = 0) -> tuple[Tables, DataFrame]:
    """Tables after loading artifacts, and a report: one row for each tenant.

    artifacts: read_artifacts(), one for each tenant, whole or in parts (sources.artifact). Stale ones, and
    those without a robots reason, are left out whole and reported as refused. Runs and outcomes are appended if
    absent. Documents are written only if no newer crawl is stored; stored documents that a
    crawl does not have go only if it completed and has some. chunk(documents) gives
    document_id, chunk_index, content, token_count, kind for changed documents.

    Tenants and documents are joined by their keys, hashes and counts. Only two joins move texts, once each:
    that of crawled texts with the keys to chunk, and that of stored chunks with the keys to keep.
    """
    bad = A.refused(artifacts, now, max_age_hours).distinct()
    good = A.heads(artifacts).join(bad.select("domain"), "domain", "left_anti").withColumn("prospect_id", row_id("domain"))
    accepted = artifacts.withColumn("prospect_id", row_id("domain"))
    prospects = upsert(tables.prospects, good.select(F.col("prospect_id").alias("id"), "company_name", "domain", "signals"), ["domain"])
    runs = good.select(
        row_id("prospect_id", "crawled_at_utc").alias("id"), "prospect_id", F.col("crawled_at_utc").alias("started_at"), F.col("crawled_at_utc").alias("finished_at"),
        "robots_reason", F.col("crawl_outcome").alias("outcome"), F.lit(DEFAULTS.max_pages).alias("max_pages"), "pages_fetched",
        F.col("n_documents").alias("documents_stored"), F.lit(DEFAULTS.user_agent).alias("user_agent"), A.derivation_note().alias("detail"),
    )
    new_runs = insert_absent(tables.crawl_runs, runs, ["prospect_id", "started_at"])
    outcomes = accepted.select("prospect_id", "crawled_at_utc", F.explode("page_outcomes").alias("o")).join(good.select("prospect_id", "crawled_at_utc"), ["prospect_id", "crawled_at_utc"], "left_semi")
    outcomes = outcomes.select(row_id("prospect_id", "crawled_at_utc").alias("crawl_run_id"), "o.*")
    outcomes = outcomes.select(row_id("crawl_run_id", "url").alias("id"), "crawl_run_id", "url", "outcome", "http_status", F.nullif("detail", F.lit("")).alias("detail"))
    new_outcomes = insert_absent(tables.crawl_page_outcomes, outcomes, ["crawl_run_id", "url"])
    crawl_runs = tables.crawl_runs.unionByName(new_runs)
    newest = newest_start(crawl_runs).withColumnRenamed("newest", "__newest")
    current = good.join(newest, "prospect_id").filter(F.col("crawled_at_utc") >= F.col("__newest")).drop("__newest")
    crawled = accepted.select("prospect_id", "crawled_at_utc", F.explode("documents").alias("d")).select("prospect_id", "crawled_at_utc", "d.*")
    crawled = crawled.select(
        row_id("prospect_id", "url").alias("id"), "prospect_id", F.col("url").alias("source_url"), "kind", F.coalesce("title", F.lit("")).alias("title"),
        "published", "text", text.word_count("text").alias("word_count"), "content_hash", F.nullif("stable_hash", F.lit("")).alias("stable_hash"),
        F.coalesce("duplicate_urls", F.array().cast("array<string>")).alias("duplicate_urls"), F.col("crawled_at_utc").alias("fetched_at"),
    )
    now_current = current.select("prospect_id", F.col("crawled_at_utc").alias("fetched_at"))
    incoming = crawled.drop("text").join(now_current, ["prospect_id", "fetched_at"], "left_semi")
    longest = F.broadcast(crawled.agg(F.coalesce(F.max(F.length(_lead())), F.lit(0)).alias("__longest")))
    heads = first_chunks(tables.chunks.crossJoin(longest), F.col("__longest"))
    stored = tables.documents.select("id", "content_hash", "stable_hash").join(heads, "id", "left")
    classed = change_classes(incoming, stored, ["id"])
    rows = classed.select(
        "id", "prospect_id", "source_url", "kind", F.substring("title", 1, 500).alias("title"), dates.parse_published("published").alias("published_at"),
        "word_count", "content_hash", "stable_hash", "duplicate_urls", "fetched_at",
    )
    whole = current.filter((F.col("crawl_outcome") == "completed") & (F.col("n_documents") > 0)).select("prospect_id")
    gone = removed(tables.documents.join(whole, "prospect_id", "left_semi"), rows, ["id"])
    documents = upsert(tables.documents, rows, ["id"]).join(gone.select("id"), "id", "left_anti")
    again = classed.filter(F.col("change").isin(*RECHUNK)).select("id", "fetched_at")
    fresh = crawled.select("id", "prospect_id", "fetched_at", "kind", "title", "published", "text").join(again, ["id", "fetched_at"], "left_semi")
    made = chunk(fresh.select(F.col("id").alias("document_id"), "prospect_id", "kind", "title", "published", "text"))
    made = made.select(
        row_id("document_id", "chunk_index").alias("id"), "document_id", "prospect_id", "kind", "chunk_index", "content", "token_count",
        F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embedding_model"),
    )
    unchanged = documents.select("id", "prospect_id").join(again.select("id"), "id", "left_anti")
    kept = cascade(tables.chunks, unchanged, {"document_id": "id", "prospect_id": "prospect_id"})
    chunks = kept.unionByName(made.select(*kept.columns))
    held = (
        F.when(F.col("__newest") > F.col("crawled_at_utc"), "a newer crawl is stored, so the documents were not written")
        .when(F.col("crawl_outcome") != "completed", "the crawl did not complete, so stored documents were kept")
        .when(F.col("n_documents") == 0, "the crawl has no documents, so none were removed").otherwise("")
    )
    counts = load_counts(classed, "prospect_id")
    left = gone.groupBy("prospect_id").agg(F.sort_array(F.collect_list("source_url")).alias("removed"))
    report = good.join(newest, "prospect_id", "left").select("prospect_id", "domain", held.alias("held"))
    report = report.join(counts, "prospect_id", "left").join(left, "prospect_id", "left").withColumn("refused", F.lit(None).cast("string"))
    refused = bad.select(F.col("domain"), F.col("reason").alias("refused"))
    report = report.unionByName(refused, allowMissingColumns=True)
    return Tables(prospects, documents, chunks, crawl_runs, tables.crawl_page_outcomes.unionByName(new_outcomes)), report


def replace_chunks(chunks: DataFrame, documents: DataFrame, new: DataFrame, tenant: int) -> DataFrame:
    """chunks with those of new's documents replaced; refuses documents that are not the tenant's."""
    affected = new.select("document_id").distinct()
    own = documents.filter(F.col("prospect_id") == tenant).select(F.col("id").alias("document_id"))
    if not affected.join(own, "document_id", "left_anti").isEmpty():
        raise ValueError("a document is not this tenant's")
    return chunks.join(affected, "document_id", "left_anti").unionByName(new.select(*chunks.columns))


def running(rows: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """rows with the running sum of a value."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(value).over(w))
