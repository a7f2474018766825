"""Facts of a tenant, computed from its documents and never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import text, urls
from corpuslake.operators.html import MIN_ROSTER


def corpus_totals(documents: DataFrame, tenant: str = "domain") -> DataFrame:
    return documents.groupBy(tenant).agg(
        F.count("*").cast("int").alias("pages_crawled"), F.sum(text.word_count("text")).cast("long").alias("total_words"),
        F.count_if(F.col("kind") == "blog_post").cast("int").alias("blog_posts_seen"),
        F.max(F.when(F.col("kind") == "blog_post", F.col("published"))).alias("latest_post_date"),
        F.bool_or(F.col("kind") == "job_posting").alias("has_careers_page"),
    )


def aliases(documents: DataFrame, tenant: str = "domain") -> DataFrame:
    """tenant, document (url), url: every URL that served a document."""
    every = F.array_distinct(F.concat(F.array("url"), F.coalesce("duplicate_urls", F.array().cast("array<string>"))))
    return documents.select(tenant, F.col("url").alias("document"), F.explode(every).alias("url"))


def roster_pages(documents: DataFrame, pages: DataFrame, tenant: str = "domain") -> DataFrame:
    """tenant, team_page_url, roster_document, people_listed: the page that the team signals describe.

    A team path is always a candidate, an about path only with a roster on it. Most
    people win, then a team path, then the smallest URL. pages: tenant, url, people.
    """
    team, about = urls.on_team_path("url"), urls.on_about_path("url")
    named = aliases(documents, tenant).filter(team | about)
    counted = named.join(pages.select(tenant, "url", "people").groupBy(tenant, "url").agg(F.max("people").alias("people")), [tenant, "url"], "left")
    people = F.coalesce("people", F.lit(0))
    fit = counted.withColumns({"people": people, "team": team}).filter(F.col("team") | (F.col("people") >= MIN_ROSTER))
    # the least of (-people, not team, url) is the best
    order = F.struct((-F.col("people")).alias("p"), (~F.col("team")).alias("t"), F.col("url").alias("u"), F.col("document").alias("d"))
    best = fit.groupBy(tenant).agg(F.min(order).alias("b"))
    return best.select(tenant, F.col("b.u").alias("team_page_url"), F.col("b.d").alias("roster_document"), (-F.col("b.p")).cast("int").alias("people_listed"))


def role_mentions(documents: DataFrame, rosters: DataFrame, tenant: str = "domain") -> DataFrame:
    """tenant, technical_role_mentions: role words on the roster's document and on documents with a team path.

    Words that match, not titles: one title can hold two.
    """
    on_team = F.exists(F.concat(F.array("url"), F.coalesce("duplicate_urls", F.array().cast("array<string>"))), lambda u: F.lower(urls.path(u)).rlike(urls.TEAM_PATH))
    roster = rosters.select(F.col(tenant).alias("__t"), "roster_document")
    joined = documents.join(roster, (F.col(tenant) == F.col("__t")) & (F.col("url") == F.col("roster_document")), "left")
    return joined.filter(on_team | F.col("roster_document").isNotNull()).groupBy(tenant).agg(F.sum(text.technical_mentions("text")).cast("int").alias("technical_role_mentions"))


def open_roles(documents: DataFrame, pages: DataFrame, tenant: str = "domain") -> DataFrame:
    """tenant, open_roles_seen, technical_roles_open: vacancies by identity, not by page.

    A posting is itself; a listing is what it links to below its own path, or, without
    such links, its headings. One key counts once, a posting's name before a link's. Only
    names that read like a job title count, and no files. pages: tenant, url, links, headings.
    """
    jobs = documents.filter(F.col("kind") == "job_posting")
    listing = urls.is_listing("url")
    postings = jobs.filter(~listing).select(
        tenant, urls.normalise("url").alias("key"), urls.role_name("url", "title").alias("name"), F.lit(0).alias("rank")
    )
    below = F.concat(F.regexp_replace(F.lower(urls.path("url")), "/+$", ""), F.lit("/"))
    raw = pages.select(F.col(tenant).alias("__t"), F.col("url").alias("__u"), "links", "headings")
    listed = jobs.filter(listing).select(tenant, "url").join(raw, (F.col(tenant) == F.col("__t")) & (F.col("url") == F.col("__u")))
    deeper = listed.withColumn("below", below).withColumn("links", F.filter("links", lambda u: F.lower(urls.path(u)).startswith(F.col("below"))))
    linked = deeper.select(tenant, F.explode("links").alias("u")).select(tenant, urls.normalise("u").alias("key"), urls.role_name("u", F.lit("")).alias("name"), F.lit(1).alias("rank"))
    headed = deeper.filter(F.size("links") == 0).select(tenant, F.explode("headings").alias("name")).select(
        tenant, F.concat(F.lit("heading:"), F.lower("name")).alias("key"), "name", F.lit(2).alias("rank")
    )
    each = postings.unionByName(linked).unionByName(headed).groupBy(tenant, "key").agg(F.min(F.struct("rank", "name"))["name"].alias("name"))
    roles = each.filter(~urls.is_file("key") & F.col("name").rlike(text.JOB_TITLE))
    return roles.groupBy(tenant).agg(
        F.count("*").cast("int").alias("open_roles_seen"), F.count_if(F.col("name").rlike(text.TECHNICAL_ROLE)).cast("int").alias("technical_roles_open")
    )


def signals(documents: DataFrame, pages: DataFrame, tenant: str = "domain") -> DataFrame:
    """One row for each tenant with documents: all its facts.

    documents: tenant, url, kind, title, text, published, duplicate_urls; pages:
    tenant, url, links, headings, people of every fetched page.
    """
    rosters = roster_pages(documents, pages, tenant)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        corpus_totals(documents, tenant).join(rosters, tenant, "left").join(role_mentions(documents, rosters, tenant), tenant, "left")
        .join(open_roles(documents, pages, tenant), tenant, "left")
        .select(
            tenant, F.col("team_page_url").isNotNull().alias("has_team_page"), "team_page_url", zero("people_listed"), zero("technical_role_mentions"),
            "has_careers_page", zero("open_roles_seen"), zero("technical_roles_open"), "blog_posts_seen", "latest_post_date", "pages_crawled", "total_words",
        )
    )


def contested(documents: DataFrame) -> DataFrame:
    """Documents whose duplicates were classified otherwise."""
    return documents.filter(F.size("kind_conflicts") > 0)


def urls_by_kind(documents: DataFrame, tenant: str = "domain") -> DataFrame:
    return documents.groupBy(tenant, "kind").agg(F.sort_array(F.collect_list("url")).alias("urls"))


def compared(expected: Column, computed: Column) -> Column:
    """Whether a hand-checked value agrees; null where it was not checked."""
    return F.when(expected.isNotNull(), expected.eqNullSafe(computed))
