"""URL filtering by given rules and by association rules mined from labels.

Given rules are (verdict, host, path): a rule fits a host and its subdomains and paths
that start with its own; the longest that fits wins. Where none fits, mined rules
decide: Spark's FP-growth finds combinations of URL tokens that go with bad labels; those
above a support and a confidence, without a shorter rule as good, block. They match by an
inverted index from each rule's rarest token. Built-in expressions and Spark's own
FP-growth only.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import ROW, bounded, passed, passing, stored, unnamed

#: (verdict, host, path), fixed.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: A mined rule holds in at least so many labelled pages and this share of them, and is right so often.
MIN_ROWS, MIN_SUPPORT, MIN_CONFIDENCE = 20, 1e-4, 0.75
#: Mined rules are broadcast up to so many; beyond, Spark joins them as it sees fit.
BROADCAST_RULES = 50_000
BAD = "label=bad"
#: Parts into which the rows of a url are dealt.
SALTS = 16


def host(url: str = "url") -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://"""
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    plain = F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(found) == F.octet_length(found), F.lower(found)).otherwise(plain)


def path(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def given(host_column: str, path_column: str, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest given rule that fits, else null."""
    h, p = F.col(host_column), F.col(path_column)
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    chosen = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return found if chosen is None else chosen.otherwise(found)


def tokens(host_column: str = "host", path_column: str = "path", url: str = "url") -> Column:
    """Features of a URL: all its host labels, from the last, and path segments with their place, and its query keys."""
    labels = F.reverse(F.split(F.col(host_column), r"\."))
    segments = F.filter(F.split(F.col(path_column), "/"), lambda s: s != "")
    query = F.split(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"\?([^#]*)", 1), "[&;]")
    keys = F.filter(F.transform(query, lambda s: F.regexp_extract(s, "^([^=]*)", 1)), lambda s: s != "")
    return F.array_distinct(
        F.concat(
            F.transform(labels, lambda s, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), s)),
            F.transform(segments, lambda s, i: F.concat(F.lit("p"), i.cast("string"), F.lit("="), s)),
            F.transform(keys, lambda s: F.concat(F.lit("q="), s)),
        )
    )


def classes(labelled: DataFrame, min_rows: int = MIN_ROWS, min_support: float = MIN_SUPPORT) -> DataFrame:
    """token, rep: tokens often enough for a rule; those of just the same rows share a rep.

    labelled: row (an id), tokens. A rule is as right with one token of a class as with any
    others of it, so rules over reps, met by any token of the class, block the same pages;
    and a long URL met millions of times is one item, not 2^n combinations.
    """
    least = F.lit(max(min_rows, min_support * labelled.count()) - 1e-6)
    each = labelled.select("row", F.explode("tokens").alias("token"))
    where = [F.bit_xor(F.xxhash64("row", F.lit(i))).alias(f"where{i}") for i in (0, 1)]
    often = each.groupBy("token").agg(F.count("*").alias("n"), *where).filter(F.col("n") >= least)
    groups = often.groupBy("n", "where0", "where1").agg(F.min("token").alias("rep"), F.collect_list("token").alias("tokens"))
    return groups.select(F.explode("tokens").alias("token"), "rep")


def by_class(rows: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """keys and tokens of rows, one for each different keys, each token by its rep in found; others go."""
    each = rows.select(*keys, F.explode_outer("tokens").alias("token")).join(found, "token", "left")
    return each.groupBy(*keys).agg(F.collect_set("rep").alias("tokens"))


def mine(labelled: DataFrame, min_rows: int = MIN_ROWS, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame | None:
    """antecedent (array of tokens), confidence, support of rules that say bad.

    labelled: tokens (array), bad (boolean). None if there is nothing bad to mine.
    """
    rows = labelled.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"), "bad")
    n, n_bad = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    if n_bad < min_rows:
        return None
    growth = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_rows / n)), minConfidence=min_confidence)
    found = growth.fit(rows.select("items")).associationRules
    return found.filter(F.element_at("consequent", 1) == BAD).select("antecedent", "confidence", "support")


def pruned(rules: DataFrame) -> DataFrame:
    """Rules without one that has fewer of their tokens and at least their confidence."""
    parts = rules.withColumn("token", F.explode("antecedent"))
    shorter = rules.select(F.col("antecedent").alias("a"), F.col("confidence").alias("c"))
    index = shorter.withColumn("token", F.element_at(F.array_sort("a"), 1))
    worse = parts.join(index, "token").filter(
        (F.size("a") < F.size("antecedent")) & (F.size(F.array_except("a", "antecedent")) == 0) & (F.col("c") >= F.col("confidence"))
    )
    return rules.join(worse.select("antecedent").distinct(), "antecedent", "left_anti")


def matching(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The different urls (column url) of pages (url, tokens) that some rule fits.

    Each rule is filed under its rarest token; a page looks up its own tokens.
    """
    each = rules.select(F.monotonically_increasing_id().alias("id"), "antecedent", F.explode("antecedent").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("n"))
    index = each.join(often, "token").groupBy("id").agg(
        F.min(F.struct("n", "token"))["token"].alias("token"), F.first("antecedent").alias("antecedent")
    )
    looked = pages.select("url", "tokens", F.explode("tokens").alias("token")).join(bounded(index, BROADCAST_RULES), "token")
    return looked.filter(F.size(F.array_except("antecedent", "tokens")) == 0).select("url").distinct()


def numbered(url: str = "url") -> Column:
    """The number that ends a URL's path, an extension or a slash after it not counted; null if there is none."""
    found = F.regexp_extract(path(url), r"([0-9]+)(?:\.[A-Za-z0-9]+)?/?$", 1)
    return F.when(F.length(found).between(1, 18), found.cast("long"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, label_key: Column | None = None, **mining) -> DataFrame:
    """Every column of pages, and host, path, rule, verdict.

    labels: doc_id, quality, toxic; a page is bad if its document is toxic or of quality 0, and
    unlabelled if both are null. label_key: the page's document, page_id unless given. Null
    urls have empty host and path and no tokens, so they are allowed. Repeated rows are judged
    each; an empty table gives no rows, and without labels no rule is mined. Columns of the four
    names, in any case, are replaced; others pass through as they are.
    """
    names = unnamed(pages, "host", "path", "rule", "verdict")
    key = F.col("page_id") if label_key is None else label_key
    parsed = pages.select(passing(names), "url", key.alias("doc_id"), host().alias("host"), path().alias("path"))
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    truth = labels.filter("quality is not null or toxic is not null").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    seen = parsed.select("doc_id", tokens().alias("tokens")).join(truth, "doc_id")
    seen = stored(seen.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "url-labelled")
    found = stored(classes(seen, **{k: v for k, v in mining.items() if k != "min_confidence"}), "url-classes")
    mined = mine(by_class(seen, found, "row", "bad").select("tokens", "bad"), **mining)
    out = parsed.withColumn("given", given("host", "path", rules))
    if mined is None:
        blocked = F.lit(False)
    else:
        each = parsed.filter("url is not null").select("url", tokens().alias("tokens")).distinct()
        hit = matching(by_class(each, found, "url"), pruned(mined)).select("url", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        # a url may be that of a third of all pages, or null: rows are dealt by what else is in them too
        out = out.withColumn("salt", F.pmod(F.xxhash64(ROW), F.lit(SALTS)).cast("int")).join(hit.withColumn("hit", F.lit(True)), ["url", "salt"], "left")
        blocked = F.coalesce("hit", F.lit(False))
    verdict = F.coalesce(F.col("given.verdict"), F.when(blocked, "block").otherwise("allow"))
    return out.select(*passed(names), "host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict"))
