"""Measures of retrieval and answers. What was not measured is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import urls

CUTOFFS = (1, 3, 5, 10)
COMPARED = ("has_team_page", "people_listed", "open_roles_seen", "technical_roles_open", "latest_post_date")
SCORED, UNWRITTEN, NO_EVIDENCE = "scored", "unwritten", "insufficient_evidence"
TODO = "TODO"


def written_sources(source_urls: Column) -> Column:
    """The source list, or null unless it has entries and none is a placeholder."""
    fine = (F.size(source_urls) > 0) & F.forall(source_urls, lambda u: u.isNotNull() & ~F.coalesce(u.contains(TODO), F.lit(True)))
    return F.when(F.coalesce(fine, F.lit(False)), source_urls)


def pair_status(expected_outcome: Column, reference: Column, source_urls: Column) -> Column:
    """insufficient_evidence first, then unwritten, else scored."""
    empty = F.coalesce((F.trim(reference) == "") | reference.contains(TODO), F.lit(True))
    return (
        F.when(F.coalesce(expected_outcome, F.lit("")) == NO_EVIDENCE, NO_EVIDENCE).when(empty, UNWRITTEN)
        .when(written_sources(source_urls).isNull(), UNWRITTEN).otherwise(SCORED)
    )


def written_signals(signals: Column) -> Column:
    """A map of signals without placeholders."""
    return F.map_filter(signals, lambda _, v: ~F.coalesce(v.contains(TODO), F.lit(False)))


def recalls(retrieved: DataFrame, expected: DataFrame, keys: list[str], cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """keys, k, hit, first_hit_rank: whether an expected URL is among the first k retrieved.

    retrieved: keys, rank, url, one row for each retrieved chunk, so a page that comes twice
    takes two places; expected: keys, url. Questions with no expected URL have no rows.
    """
    want = expected.select(*keys, urls.normalise_for_evaluation("url").alias("__u")).distinct()
    got = retrieved.select(*keys, "rank", urls.normalise_for_evaluation("url").alias("__u"))
    first = got.join(want, [*keys, "__u"], "left_semi").groupBy(*keys).agg(F.min("rank").alias("first_hit_rank"))
    each = want.select(*keys).distinct().join(first, keys, "left").withColumn("k", F.explode(F.array(*map(F.lit, cutoffs))))
    return each.select(*keys, "k", F.coalesce(F.col("first_hit_rank") <= F.col("k"), F.lit(False)).alias("hit"), "first_hit_rank")


def recall_at(recalled: DataFrame, by: list[str] = ()) -> DataFrame:
    return recalled.groupBy(*by, "k").agg(F.avg(F.col("hit").cast("double")).alias("recall"), F.count("*").alias("scored"))


def coverage(expected: DataFrame, crawled: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, url, state (present, missing, never_attempted), outcome of each expected URL."""
    key = lambda df: df.withColumn("__u", urls.normalise_for_evaluation("url"))
    have = key(crawled).select(*keys, "__u").distinct().withColumn("__have", F.lit(True))
    why = key(outcomes).groupBy(*keys, "__u").agg(F.max("outcome").alias("__why"))
    joined = key(expected).join(have, [*keys, "__u"], "left").join(why, [*keys, "__u"], "left")
    state = F.when(F.col("__have"), "present").when(F.col("__why").isNotNull(), "missing").otherwise("never_attempted")
    return joined.select(*keys, "url", state.alias("state"), F.when(F.col("__have").isNull(), F.col("__why")).alias("outcome"))


def latest_outcomes(outcomes: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, outcome of the latest run that has one; outcomes: keys, crawl_run_id, outcome; runs: id, started_at. Ties go by the run's id."""
    started = runs.select(F.col("id").alias("crawl_run_id"), "started_at")
    joined = outcomes.join(started, "crawl_run_id")
    return joined.groupBy(*keys).agg(F.max_by("outcome", F.struct("started_at", "crawl_run_id")).alias("outcome"))


def crawled_urls(documents: DataFrame, keys: list[str]) -> DataFrame:
    """keys, url: the different URLs that a corpus has, in the form that sources are compared in."""
    return documents.select(*keys, urls.normalise_for_evaluation("url").alias("url")).distinct()


def signal_accuracy(truth: DataFrame, computed: DataFrame, key: str, fields: tuple[str, ...] = COMPARED) -> DataFrame:
    """key, compared, agreed, accuracy (null where nothing was checked), mismatches (names)."""
    c = computed.select(F.col(key).alias("__k"), *[F.col(f).alias("__" + f) for f in fields])
    joined = truth.join(c, F.col(key) == F.col("__k"), "left")
    checked = [F.col(f).isNotNull() for f in fields]
    agree = [F.col(f).isNotNull() & F.col(f).cast("string").eqNullSafe(F.col("__" + f).cast("string")) for f in fields]
    n = lambda conditions: sum((x.cast("int") for x in conditions), F.lit(0))
    wrong = F.array_compact(F.array(*[F.when(a & ~b, F.lit(f)) for f, a, b in zip(fields, checked, agree)]))
    out = joined.select(key, n(checked).alias("compared"), n(agree).alias("agreed"), wrong.alias("mismatches"))
    return out.withColumn("accuracy", F.try_divide(F.col("agreed"), F.col("compared")))


def decline_counts(replies: DataFrame, by: list[str]) -> DataFrame:
    """by, declined, answered: null where nothing was answered."""
    n = F.count_if(F.col("declined").isNotNull())
    return replies.groupBy(*by).agg(F.when(n > 0, F.count_if(F.coalesce("declined", F.lit(False)))).alias("declined"), F.when(n > 0, n).alias("answered"))


def sources_admitted(expected: Column, admitted: Column) -> Column:
    """struct(admitted, total): different expected sources in the context."""
    norm = lambda a: F.array_distinct(F.transform(a, urls.normalise_for_evaluation))
    return F.struct(F.size(F.array_intersect(norm(expected), norm(admitted))).alias("admitted"), F.size(norm(expected)).alias("total"))


def context_label(status: Column, expected: Column, admitted: Column, dropped: Column) -> Column:
    norm = lambda a: F.transform(a, urls.normalise_for_evaluation)
    return (
        F.when(status == NO_EVIDENCE, F.when(F.size(admitted) > 0, "bait_admitted").otherwise("empty_context"))
        .when(status != SCORED, F.lit(None)).when(F.arrays_overlap(norm(expected), norm(admitted)), "admitted")
        .when(F.arrays_overlap(norm(expected), norm(dropped)), "dropped_for_budget").otherwise("not_retrieved")
    )
