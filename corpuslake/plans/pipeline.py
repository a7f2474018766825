"""From raw pages to artifacts, and from artifacts to answers: the operators in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import urls
from corpuslake.operators import chunking, dedup, html, signals
from corpuslake.plans.storage import stored
from corpuslake.settings import DEFAULTS, Settings
from corpuslake.sources.schemas import ARTIFACT, SIGNALS


def crawl_tables(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """documents, outcomes, signals and parsed pages of raw pages (url, html); the tenant is the host.

    One Python pass over the pages, written to the shared folder.
    """
    parsed = stored(html.parse_pages(pages.select(urls.netloc("url").alias("domain"), urls.normalise("url").alias("url"), "html").dropDuplicates(["url"])), "pages-parsed")
    survivors, duplicates = dedup.deduplicate(html.stored_documents(parsed, "domain"))
    survivors = stored(survivors, "survivors")
    thin = parsed.filter("text is null").select("domain", "url", F.lit("thin_extraction").alias("outcome"), F.col("reason").alias("detail"))
    whole = survivors.select("domain", "url", F.lit("stored").alias("outcome"), F.lit("").alias("detail"))
    outcomes = whole.unionByName(duplicates.select("domain", "url", "outcome", "detail")).unionByName(thin)
    return survivors, outcomes, signals.signals(survivors, parsed), parsed


def artifacts(documents: DataFrame, outcomes: DataFrame, facts: DataFrame, crawled_at: str) -> DataFrame:
    """One artifact for each tenant. Texts of one tenant meet in one row, as the format is one object a tenant."""
    d = ARTIFACT["documents"].dataType.elementType
    doc = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in documents.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in d.fields])
    o = F.struct("url", "outcome", F.lit(200).alias("http_status"), "detail")
    named = {"technical_roles_named": "technical_role_mentions"}
    s = F.struct(*[F.col(named.get(f.name, f.name)).cast(f.dataType).alias(f.name) for f in SIGNALS.fields])
    return (
        outcomes.groupBy("domain").agg(F.sort_array(F.collect_list(o)).alias("page_outcomes"))
        .join(documents.groupBy("domain").agg(F.sort_array(F.collect_list(doc)).alias("documents")), "domain", "left")
        .join(facts.select("domain", s.alias("signals")), "domain", "left")
        .select(
            F.col("domain").alias("company_name"), "domain", F.concat(F.lit("https://"), "domain").alias("base_url"), F.lit(crawled_at).alias("crawled_at"),
            F.lit("ok").alias("robots_reason"), F.lit("completed").alias("crawl_outcome"), "signals", "documents", "page_outcomes",
        )
    )


def chunker(counter: chunking.Counter, settings: Settings = DEFAULTS):
    """The chunk step of loading.load()."""
    return lambda documents: chunking.chunk_documents(documents, counter, ["document_id", "prospect_id"], settings)
