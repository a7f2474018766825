"""Crawl artifacts: one JSON object a tenant, read strictly and written whole.

A tenant of many documents may come in parts: rows of the same domain and crawl time with the same
head (all but documents and page outcomes), each with a share of the documents and outcomes. So no row
has to hold all texts of a tenant. What reads documents or outcomes needs no more than explode; heads() sums up the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.settings import DEFAULTS
from corpuslake.sources.schemas import ARTIFACT, ARTIFACT_DOCUMENT, ARTIFACT_OUTCOME, NOT_FETCHED


class ArtifactRefused(ValueError):
    """An artifact that must not be loaded."""


class ArtifactTooOld(ArtifactRefused):
    """Crawled longer ago than the limit."""


_KEYS = [f.name for f in ARTIFACT.fields]
#: What every part of an artifact has alike, and a load reads.
HEAD = ("domain", "crawled_at_utc", "company_name", "robots_reason", "crawl_outcome", "signals")


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Validated artifacts of a path, with a `file` column: files of one object, or of one a line.

    Spark drops unknown JSON keys without a word, so each text is parsed a second time
    for its key names alone; unknown keys are an error, except in signals.
    """
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    by_line = F.forall(lines, lambda x: F.json_object_keys(x).isNotNull())
    each = raw.select("file", F.explode(F.when(by_line, lines).otherwise(F.array("value"))).alias("value"))
    return parse_artifacts(each, "value")


def parse_artifacts(raw: DataFrame, column: str) -> DataFrame:
    """Artifacts from a column of JSON texts; the other columns stay."""
    rest = [c for c in raw.columns if c != column]
    text = F.col(column)
    documents = F.from_json(F.get_json_object(text, "$.documents"), "array<map<string,string>>")
    outcomes = F.from_json(F.get_json_object(text, "$.page_outcomes"), "array<map<string,string>>")

    def unknown(maps: Column, known: list[str]) -> Column:
        keys = F.flatten(F.transform(F.coalesce(maps, F.array()), F.map_keys))
        return F.array_except(keys, F.array(*map(F.lit, known)))

    extra = F.array_distinct(
        F.concat(
            F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), F.array(*map(F.lit, _KEYS))),
            unknown(documents, ARTIFACT_DOCUMENT.names), unknown(outcomes, ARTIFACT_OUTCOME.names),
        )
    )
    parsed = raw.select(*rest, F.from_json(text, ARTIFACT, {"mode": "PERMISSIVE"}).alias("a"), extra.alias("extra"))
    checked = parsed.withColumn(
        "problem",
        F.when(F.col("a.domain").isNull() | F.col("a.company_name").isNull() | F.col("a.crawled_at").isNull(), "a required field is missing")
        .when(F.size("extra") > 0, F.concat(F.lit("unknown keys: "), F.array_join("extra", ", "))),
    )
    kept = checked.withColumn("a", F.when(F.col("problem").isNull(), F.col("a")).otherwise(F.raise_error(F.concat(F.lit("artifact refused: "), F.col("problem")))))
    out = kept.select(*rest, "a.*")
    return out.withColumns({
        "domain": F.lower("domain"), "robots_reason": F.coalesce("robots_reason", F.lit("")),
        "crawl_outcome": F.coalesce("crawl_outcome", F.lit("completed")), "crawled_at_utc": F.to_timestamp("crawled_at"),
        "documents": F.coalesce("documents", F.array().cast(ARTIFACT["documents"].dataType)),
        "page_outcomes": F.coalesce("page_outcomes", F.array().cast(ARTIFACT["page_outcomes"].dataType)),
    })


def is_stale(now: Column, max_age_hours: int = 0) -> Column:
    """Whether an artifact is older than the limit; a limit of 0 means the default."""
    limit = max_age_hours or DEFAULTS.artifact_max_age_hours
    return F.col("crawled_at_utc") + F.make_dt_interval(F.lit(0), F.lit(limit)) < now


def refused(artifacts: DataFrame, now: Column, max_age_hours: int = 0) -> DataFrame:
    """domain, reason of artifacts that must not be loaded."""
    reason = F.when(is_stale(now, max_age_hours), "too old").when(F.col("robots_reason") == "", "no robots_reason")
    return artifacts.select("domain", reason.alias("reason")).filter(F.col("reason").isNotNull())


def heads(artifacts: DataFrame) -> DataFrame:
    """domain, crawled_at_utc, company_name, robots_reason, crawl_outcome, signals, n_documents, pages_fetched: one row for an artifact, in however many parts."""
    fetched = F.size(F.filter("page_outcomes.outcome", lambda o: ~o.isin(*NOT_FETCHED)))
    each = artifacts.select(*HEAD, F.size("documents.url").alias("n"), fetched.alias("f"))
    return each.groupBy(*HEAD).agg(F.sum("n").cast("int").alias("n_documents"), F.sum("f").cast("int").alias("pages_fetched"))


def documents(artifacts: DataFrame) -> DataFrame:
    return artifacts.select("domain", "crawled_at_utc", F.explode("documents").alias("d")).select("domain", "crawled_at_utc", "d.*")


def page_outcomes(artifacts: DataFrame) -> DataFrame:
    return artifacts.select("domain", "crawled_at_utc", F.explode("page_outcomes").alias("o")).select("domain", "crawled_at_utc", "o.*")


def outcomes_of(artifacts: DataFrame, outcome: str) -> DataFrame:
    """domain, crawled_at_utc, url, http_status, detail of the pages that ended so."""
    return page_outcomes(artifacts).filter(F.col("outcome") == outcome)


def pages_fetched(outcome: Column) -> Column:
    """Aggregate: pages that were requested."""
    return F.sum(F.when(~outcome.isin(*NOT_FETCHED), 1).otherwise(0))


def derivation_note() -> Column:
    """What of a crawl run was derived or configured and not measured."""
    return F.lit(
        "started_at is when the crawl ended; max_pages and user_agent are configured; pages_fetched counts outcomes other than "
        + ", ".join(NOT_FETCHED)
    )


#: Objects of a written file at most. The reader takes a file whole, so a large crawl is many files.
FILE_OBJECTS = 1024


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    artifacts.select(*[c for c in _KEYS if c in artifacts.columns]).write.mode("errorifexists").option("maxRecordsPerFile", FILE_OBJECTS).json(path)


def find_documents(artifacts: DataFrame, needle: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Documents whose URL contains a text, longest first, with their words: all columns, or those that are named.

    What is found is stored before it is sorted, as a sort reads its input twice; columns that are not asked for do not get there.
    """
    from corpuslake.functions.text import word_count
    from corpuslake.plans.storage import stored

    found = documents(artifacts).filter(F.col("url").contains(needle)).withColumn("words", word_count("text"))
    found = found if columns is None else found.select(*dict.fromkeys([*columns, "url", "words"]))
    return stored(found, "found").orderBy(F.desc("words"), "url")
