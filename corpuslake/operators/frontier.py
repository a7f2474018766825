"""The crawl's decisions as tables: which page next, why none came, what robots.txt said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.settings import DEFAULTS

#: kind: (share of the page budget at most, priority), fixed values.
QUOTA = {"website": (0.45, 0), "job_posting": (0.30, 0), "blog_post": (0.25, 1)}
OTHER = (0.05, 2)
FAILURE_STREAK, FRONTIER_FACTOR = 3, 3
#: Paths that are tried first (fixed values).
SEEDS = (
    "/ /about /about-us /nosotros /quienes-somos /company /team /our-team /equipo /people /leadership /careers /jobs /join-us "
    "/trabaja-con-nosotros /empleos /blog /news /insights /noticias /services /products /solutions /servicios /contact /contacto"
).split()
TRANSPORT = ("dns_failure", "timeout", "transport_error")


def cap(kind: Column, max_pages: int) -> Column:
    out = F.lit(max(1, int(max_pages * OTHER[0])))
    for k, (share, _) in QUOTA.items():
        out = F.when(kind == k, max(1, int(max_pages * share))).otherwise(out)
    return out


def priority(kind: Column) -> Column:
    out = F.lit(OTHER[1])
    for k, (_, p) in QUOTA.items():
        out = F.when(kind == k, p).otherwise(out)
    return out


def queue_rank(kind: Column, stored: Column, max_pages: int = DEFAULTS.max_pages) -> Column:
    """struct(over_cap, priority): lower is sooner. stored: pages of the kind so far."""
    return F.struct((stored >= cap(kind, max_pages)).cast("int").alias("over_cap"), priority(kind).alias("priority"))


def crawl_order(frontier: DataFrame, tenant: str, position: str, max_pages: int = DEFAULTS.max_pages) -> DataFrame:
    """Every column of frontier (tenant, kind, position), and pick (order of fetching) and outcome.

    Simulates picking the least (over cap, priority, position) again and again from a known
    queue in which every page is kept. A page is over its cap if as many of its kind stand
    before it, so the greedy choice is a sort. What the budget does not reach is
    budget_exhausted. A cap takes nothing from a kind while no other is waiting.
    """
    nth = F.row_number().over(Window.partitionBy(tenant, "kind").orderBy(position))
    over = (nth > cap(F.col("kind"), max_pages)).cast("int")
    out = frontier.withColumn("__over", over).withColumn("__priority", priority(F.col("kind")))
    pick = F.row_number().over(Window.partitionBy(tenant).orderBy("__over", "__priority", position))
    return out.withColumn("pick", pick).withColumn("outcome", F.when(F.col("pick") <= max_pages, "stored").otherwise("budget_exhausted")).drop("__over", "__priority")


def robots_reason(status: Column, error: Column) -> Column:
    """ok, absent, unreadable, server_error or fetch_failed of a robots.txt request."""
    return (
        F.when(error.isNotNull() | status.isNull(), "fetch_failed").when(status.isin(401, 403), "unreadable").when(status.between(400, 499), "absent")
        .when(status >= 500, "server_error").when(status == 200, "ok").otherwise("fetch_failed")
    )


def robots_allows(reason: Column, rule: Column) -> Column:
    """A server error denies all; without rules everything is allowed; else as the rule says."""
    return F.when(reason == "server_error", F.lit(False)).otherwise(F.coalesce(rule, F.lit(True)))


def robots_rules(text: str | None, agent: str, urls: list[str]) -> list[bool]:
    """Whether each URL may be fetched by a robots.txt text; a text that cannot be read allows all."""
    from urllib.robotparser import RobotFileParser

    if text is None:
        return [True] * len(urls)
    try:
        parser = RobotFileParser()
        parser.parse(text.splitlines())
        return [parser.can_fetch(agent, u) for u in urls]
    except Exception:
        return [True] * len(urls)


def transport_failure(error: Column, resolves: Column) -> Column:
    """timeout, dns_failure (only if the name does not resolve either) or transport_error of a failed request."""
    return F.when(error == "timeout", "timeout").when((error == "connect") & ~F.coalesce(resolves, F.lit(True)), "dns_failure").otherwise("transport_error")


def page_outcome(status: Column, content_type: Column) -> Column:
    """http_error, non_html, or null if the page may be read."""
    return F.when(F.coalesce(status, F.lit(0)) != 200, "http_error").when(~F.lower(F.coalesce(content_type, F.lit(""))).contains("html"), "non_html")


def crawl_start(reason: Column, failure: Column) -> Column:
    """How a crawl ends before its first page, by its robots.txt request; null if it goes on. A timeout alone ends nothing."""
    return F.when(reason == "server_error", "aborted_robots").when(failure.isin("dns_failure", "transport_error"), "aborted_unreachable")


def streak_abort(outcomes: DataFrame, tenant: str, position: str) -> DataFrame:
    """tenants whose first FAILURE_STREAK requests all failed in transport: the crawl stops there."""
    w = Window.partitionBy(tenant).orderBy(position)
    first = outcomes.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= FAILURE_STREAK)
    return first.groupBy(tenant).agg(F.count("*").alias("n"), F.bool_and(F.col("outcome").isin(*TRANSPORT)).alias("all")).filter(f"n = {FAILURE_STREAK} and `all`").select(tenant)


def tally(outcomes: DataFrame, by: list[str]) -> DataFrame:
    return outcomes.groupBy(*by, "outcome").agg(F.count("*").alias("n"))


def explain_empty(outcomes: DataFrame, runs: DataFrame, tenant: str) -> DataFrame:
    """tenant, cause, n, total: why a crawl has no documents.

    A failure of transport outranks the robots reason, as a robots.txt that a dead host does
    not serve is a symptom. Otherwise the most frequent outcome; ties go to the one met first.
    runs: tenant, robots_reason, crawl_outcome; outcomes: tenant, outcome, position.
    """
    counts = outcomes.groupBy(tenant, "outcome").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    rank = F.when(F.col("outcome") == TRANSPORT[0], 0).when(F.col("outcome") == TRANSPORT[1], 1).when(F.col("outcome") == TRANSPORT[2], 2).otherwise(3)
    order = F.struct(rank.alias("r"), F.when(rank < 3, 0).otherwise(-F.col("n")).alias("m"), "first", "outcome", "n")
    best = counts.groupBy(tenant).agg(F.min(order).alias("b"), F.sum("n").alias("total"))
    joined = runs.join(best, tenant, "left")
    transport = F.coalesce(F.col("b.r") < 3, F.lit(False))
    cause = (
        F.when(F.col("crawl_outcome") == "aborted_robots", "robots_server_error").when(transport, F.col("b.outcome"))
        .when(F.col("robots_reason") == "server_error", "robots_server_error").when(F.col("robots_reason") == "fetch_failed", "robots_fetch_failed")
        .when(F.col("b").isNull(), "nothing_attempted").otherwise(F.col("b.outcome"))
    )
    return joined.select(tenant, cause.alias("cause"), F.when(cause == F.col("b.outcome"), F.col("b.n")).alias("n"), F.coalesce("total", F.lit(0)).alias("total"))
