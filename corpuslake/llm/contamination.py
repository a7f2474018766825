"""Benchmark passages in documents, by a positional inverted index.

The test side's phrases (windows of its items) are each filed under their rarest terms,
by counts over the whole corpus. The index stores the training tokens' postings (row,
place) of those terms: lists as short as the corpus allows. A phrase's lists are shifted
by the terms' offsets in it and intersected by a group-by on the shifted place. The lists
are dealt out by document before they meet the phrases, so only postings are shuffled and not
the many more rows that shifting makes of them; what is left is compared word by word with the
text, so matches are exact. Proximity matches are those of which all these terms occur within a few
places of where the phrase has them. Built-in expressions only. The documents are read three times and
never shuffled, but for those with a match where these are too many to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import ROW, bounded, forget, passed, passing, stored, text_key, unnamed

WINDOW = 13
#: Rarest terms of a phrase whose postings are intersected.
ANCHORS = 3
#: Places by which the terms of a proximity match may be off in the query.
SLOP = 3
#: Terms are broadcast up to so many (some 30 MB); beyond, Spark joins them as it sees fit.
BROADCAST_TERMS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of documents with a match are broadcast up to so many (some 30 MB, with their items more); beyond, texts are shuffled.
BROADCAST_ROWS = 300_000
#: Parts into which a word's postings are dealt where the other side is too large to broadcast.
SALTS = 16
#: What separates words before A-Z are lower-cased.
_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(word: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def raw_words(text: Column) -> Column:
    """The words of a text in order, as they are written; an empty string may stand at either end."""
    return F.split(F.coalesce(text, F.lit("")), _SEPARATOR)


def n_words(raw: Column) -> Column:
    ends = (F.element_at(raw, 1) == "").cast("int") + ((F.element_at(raw, -1) == "") & (F.size(raw) > 1)).cast("int")
    return (F.size(raw) - ends).cast("long")


def words(text: Column) -> Column:
    """The lower-cased words of a text."""
    return F.filter(F.transform(raw_words(text), lowered), lambda w: w != "")


def phrases(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """phrase (array of words), items (array of item ids): each different window once."""
    w = benchmark.select(F.col("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    cut = F.when(F.size("w") <= window, F.array("w")).otherwise(
        F.expr(f"transform(sequence(1, greatest(1, size(w) - {window - 1})), i -> slice(w, i, {window}))")
    )
    return w.select("item_id", F.explode(cut).alias("phrase")).groupBy("phrase").agg(F.collect_set("item_id").alias("items"))


def tokens(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """extra columns of docs, pos (from 0), word: one row for each word."""
    raw = docs.select(*extra, raw_words(F.col("text")).alias("w")).select(
        *extra, (F.element_at("w", 1) == "").cast("int").alias("lead"), F.posexplode("w").alias("pos", "raw")
    )
    return raw.filter("raw <> ''").select(*extra, (F.col("pos") - F.col("lead")).alias("pos"), lowered(F.col("raw")).alias("word"))


def _joined(left: DataFrame, right: DataFrame, how: str, deal: str | None = None) -> DataFrame:
    """left (word, pos) and right (word) by word: right is broadcast up to a bound; beyond, frequent words are dealt out by place.

    deal: a column by which left is dealt out before a broadcast, for a later group-by on it and others.
    """
    small = bounded(right, BROADCAST_TERMS)
    if small is not right:
        if deal:
            left = left.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), deal)
        return left.join(small, "word", how)
    salted = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.pmod("pos", F.lit(SALTS))).join(salted, ["word", "salt"], how).drop("salt")


def counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """word, n: how often each of terms (word) occurs in the corpus; absent ones are left out."""
    small = bounded(terms, BROADCAST_TERMS)
    if small is not terms:
        return tokens(docs).join(small, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    return tokens(docs).groupBy("word").agg(F.count("*").alias("n")).join(terms, "word", "left_semi")


def anchors(found: DataFrame, frequency: DataFrame, number: int = ANCHORS) -> DataFrame:
    """phrase_id, offset, word, bit, mask, complete for a phrase's rarest terms among those that the corpus has.

    found: phrase_id, phrase. complete: the corpus has all of its terms, so it may occur as it is.
    A phrase of which the corpus has fewer terms than are asked for is left out.
    """
    each = found.select("phrase_id", F.posexplode("phrase").alias("offset", "word"), F.size("phrase").alias("size"))
    known = each.join(frequency, "word").groupBy("phrase_id").agg(
        F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("n", "word", "offset"))).alias("terms")
    )
    k = F.least("size", F.lit(number))
    best = known.filter(F.size("terms") >= k).select(
        "phrase_id", (F.size("terms") == F.col("size")).alias("complete"), k.alias("k"), F.posexplode(F.slice("terms", 1, number)).alias("i", "t")
    )
    return best.select(
        "phrase_id", F.col("t.offset").alias("offset"), F.col("t.word").alias("word"),
        F.expr("shiftleft(1, i)").alias("bit"), F.expr("shiftleft(1, k) - 1").alias("mask"), "complete",
    )


def _keys() -> list[Column]:
    """doc_key, row_key: two hashes of a row's id and text, together its identity, whatever the id's type."""
    return [F.xxhash64(F.lit("row"), "text", "doc_id").alias("doc_key"), text_key("doc_id", "text").alias("row_key")]


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: word, doc_key, row_key, pos of every occurrence of terms (word); those of repeated rows once."""
    return _joined(tokens(docs.select(*_keys(), "text"), ("doc_key", "row_key")), terms, "left_semi").distinct()


def exact_candidates(index: DataFrame, filed: DataFrame) -> DataFrame:
    """doc_key, row_key, phrase_id, start where all anchors of a complete phrase agree."""
    shifted = _joined(index, filed.filter("complete"), "inner", "doc_key").withColumn("start", F.col("pos") - F.col("offset")).filter("start >= 0")
    return (
        shifted.groupBy("doc_key", "row_key", "phrase_id", "start").agg(F.bit_or("bit").alias("bits"), F.max("mask").alias("mask"))
        .filter("bits = mask").select("doc_key", "row_key", "phrase_id", "start").hint("rebalance", F.col("doc_key"))
    )


def proximity(index: DataFrame, filed: DataFrame, slop: int) -> DataFrame:
    """doc_key, row_key, phrase_id of phrases all of whose anchors occur with shifts that differ by at most slop.

    A shifted place counts in the two buckets that a window of slop + 1 places can touch, so the
    intersection is a group-by of at most 2 * (slop + 1) places here too.
    """
    shifted = _joined(index, filed, "inner", "doc_key").withColumn("start", F.col("pos") - F.col("offset"))
    bucket = F.floor(F.col("start") / (slop + 1)).cast("long")
    spread = shifted.withColumn("bucket", F.explode(F.array(bucket - 1, bucket)))
    grouped = spread.groupBy("doc_key", "row_key", "phrase_id", "bucket").agg(
        F.collect_set(F.struct("start", "bit")).alias("s"), F.bit_or("bit").alias("bits"), F.max("mask").alias("mask")
    )

    def bits_from(a: Column) -> Column:
        inside = lambda b: (b["start"] >= a["start"]) & (b["start"] <= a["start"] + slop)
        return F.aggregate("s", F.lit(0), lambda bits, b: F.when(inside(b), bits.bitwiseOR(b["bit"])).otherwise(bits))

    within = F.exists("s", lambda a: bits_from(a) == F.col("mask"))
    return grouped.filter("bits = mask").filter(within).select("doc_key", "row_key", "phrase_id").distinct().hint("rebalance", F.col("doc_key"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """doc_key, row_key, start, length, items of every exact occurrence of a phrase; and with
    slop doc_key, row_key, items of the phrases near whose places all anchors occur."""
    found = stored(phrases(benchmark, window).withColumn("phrase_id", F.xxhash64("phrase")), "phrases")
    terms = stored(found.select(F.explode("phrase").alias("word")).distinct(), "phrase-terms")
    frequency = stored(counts(docs, terms), "phrase-term-counts")
    filed = stored(anchors(found.select("phrase_id", "phrase"), frequency), "phrase-anchors")
    index = stored(postings(docs, filed.select("word").distinct()), "postings")
    candidates = stored(exact_candidates(index, filed), "phrase-candidates")
    near = None
    if slop is not None:
        near = stored(proximity(index, filed, slop).join(found.select("phrase_id", "items"), "phrase_id").select("doc_key", "row_key", "items"), "phrases-near")
    forget(terms, frequency, filed, index)
    rows = docs.select(*_keys(), "text")
    some = rows.join(bounded(candidates.select("doc_key", "row_key").distinct(), BROADCAST_ROWS), ["doc_key", "row_key"], "left_semi").dropDuplicates(["doc_key", "row_key"])
    texts = some.select("doc_key", "row_key", words(F.col("text")).alias("w"))
    checked = candidates.join(found, "phrase_id").join(texts, ["doc_key", "row_key"])
    size = F.size("phrase")
    exact = checked.filter(F.slice("w", F.col("start") + 1, size) == F.col("phrase")).select("doc_key", "row_key", "start", size.alias("length"), "items")
    return exact, near


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Every column of docs, and n_words, n_hit, items (sorted strings), whole_window, contaminated; near_items with slop.

    A word inside any occurrence of a phrase is hit; a document is contaminated if hit
    words are a twentieth of its words or more. whole_window: some phrase of a full window
    occurs, however long the text around it. near_items: items with a phrase whose rarest
    terms occur within slop places of where the phrase has them; what occurs exactly is among
    them. A null or wordless text has no words and
    is not contaminated. Rows with the same doc_id and text get the same result, each;
    rows that share a doc_id but not the text are told apart. Ids may be of any type; a null
    one is a key of its own. An empty benchmark hits nothing, an empty table gives no rows.
    Columns of the new names, in any case, are replaced; others pass through as they are.
    """
    exact, near = matches(docs, benchmark, window, slop)
    found = stored(exact, "phrase-matches")
    spots = found.select("doc_key", "row_key", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
    hit = spots.groupBy("doc_key", "row_key").agg(F.count("*").alias("hit"))
    items = (
        found.select("doc_key", "row_key", "length", F.explode("items").alias("item"))
        .groupBy("doc_key", "row_key")
        .agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("listed"), F.max(F.col("length") == window).alias("whole"))
    )
    names = unnamed(docs, "n_words", "n_hit", "items", "whole_window", "contaminated", "near_items")
    counted = docs.select(passing(names), *_keys(), raw_words(F.col("text")).alias("raw")).select(ROW, "doc_key", "row_key", n_words(F.col("raw")).alias("n_words"))
    facts = hit.join(items, ["doc_key", "row_key"])
    none = F.array().cast("array<string>")
    if near is not None:
        listed = near.select("doc_key", "row_key", F.explode("items").alias("item")).groupBy("doc_key", "row_key")
        facts = facts.join(listed.agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("near")), ["doc_key", "row_key"], "full")
    out = counted.join(bounded(stored(facts, "phrase-facts"), BROADCAST_ROWS), ["doc_key", "row_key"], "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return out.select(
        *passed(names), "n_words", n_hit.alias("n_hit"), F.coalesce("listed", none).alias("items"),
        F.coalesce("whole", F.lit(False)).alias("whole_window"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        *([] if near is None else [F.coalesce("near", none).alias("near_items")]),
    )
