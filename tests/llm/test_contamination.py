import hashlib
import random
import re

from pyspark.sql import functions as F

from corpuslake.llm import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=13):
    out = []
    for doc_id, text in docs:
        w, hit, ids = plain_words(text), set(), set()
        for item_id, item in items:
            v = plain_words(item)
            for p in ([v] if len(v) <= window else [v[i : i + window] for i in range(len(v) - window + 1)]) if v else []:
                for i in range(len(w) - len(p) + 1):
                    if w[i : i + len(p)] == p:
                        hit.update(range(i, i + len(p)))
                        ids.add(str(item_id))
        out.append((doc_id if doc_id is not None else -1, len(w), len(hit), sorted(ids), 20 * len(hit) >= len(w) and len(hit) > 0))
    return sorted(out)


def cases():
    rng = random.Random(8)
    vocabulary = ["the", "of", "Élan", "é", "x1", "AB", *(f"w{i}" for i in range(12))]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".\n", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([3, 8, 13, 14, 30]))) for i in range(12)]
    items += [(20, None), (21, " ,. "), (22, items[3][1]), (23, "the " * 20), (24, "É É É É"), (25, "absent words here")]
    docs = []
    for i in range(40):
        body = [text(rng.randint(0, 60)) for _ in range(3)]
        body.insert(rng.randint(0, 3), rng.choice(items)[1] or "")
        docs.append((i, " ".join(body).upper() if i % 7 == 0 else "...".join(body)))
    docs += [(100, None), (101, ""), (102, "?!"), (103, "the " * 30_000), (5, docs[5][1]), (6, "the of"), (None, items[4][1]), (104, items[0][1])]
    return docs, items


def test_against_brute_force(spark, make_docs):
    docs, items = cases()
    benchmark = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, n_words int")
    got = contamination.contamination(make_docs(docs), benchmark)
    rows = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got.collect())
    assert rows == plain(docs, items) and {"lang", "key", "fp"} <= set(got.columns)


def test_empty_tables(spark, make_docs):
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert contamination.contamination(make_docs([(1, "a b c")]).limit(0), benchmark).collect() == []
    (row,) = contamination.contamination(make_docs([(1, "a b c")]), benchmark.limit(0)).collect()
    assert (row.n_words, row.n_hit, row["items"], row.contaminated) == (3, 0, [], False)


def test_proximity_finds_scattered_terms(spark, make_docs):
    docs = make_docs([(1, "red x green y blue"), (2, "red " + "x " * 9 + "green blue"), (3, "blue green red"), (4, "red green blue"), (5, None)])
    # the corpus lacks a word of the second item, which so cannot occur as it is
    benchmark = spark.createDataFrame([(7, "red green blue"), (8, "red green absent blue")], "item_id long, text string")

    def near(slop, item):
        found = contamination.contamination(docs, benchmark, slop=slop).select("doc_id", "near_items").collect()
        return sorted(r.doc_id for r in found if item in r.near_items)

    assert near(0, "7") == [4] and near(2, "7") == [1, 4] and near(4, "7") == [1, 3, 4]
    assert near(0, "8") == [] and near(1, "8") == [1, 4]


def test_ids_of_any_type_and_clashing_names(spark):
    rows = [("a", "x one two y", "keep", 1, "k", "w"), (None, "one two", "keep", 1, "k", "w"), ("a", None, "keep", 1, "k", "w")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, N_Words string, hit int, row_key string, __row string")
    got = contamination.contamination(docs, spark.createDataFrame([("i", "one two")], "item_id string, text string"))
    assert got.columns == ["doc_id", "text", "hit", "row_key", "__row", "n_words", "n_hit", "items", "whole_window", "contaminated"]
    assert sorted((r.doc_id or "", r.text or "", r.row_key, r.n_words, r.n_hit) for r in got.collect()) == [("", "one two", "k", 2, 2), ("a", "", "k", 0, 0), ("a", "x one two y", "k", 4, 2)]


def test_postings_are_shuffled_before_they_are_shifted(spark, make_docs):
    """One shuffle, of postings by document, below the join; shifted places are many more rows. Repeated rows have postings once."""
    docs, items = cases()
    found = contamination.phrases(spark.createDataFrame(items, "item_id long, text string")).withColumn("phrase_id", F.xxhash64("phrase"))
    terms = found.select(F.explode("phrase").alias("word")).distinct()
    table = make_docs(docs)
    filed = contamination.anchors(found, contamination.counts(table, terms)).localCheckpoint()
    index = contamination.postings(table, filed.select("word").distinct()).localCheckpoint()
    assert index.count() == contamination.postings(table.unionAll(table), filed.select("word").distinct()).count()
    for shifted in (contamination.exact_candidates(index, filed), contamination.proximity(index, filed, 3)):
        plan = shifted._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "REBALANCE" not in line]  # what is found goes to few files
        shuffles = [re.search(r"hashpartitioning\(([^)]*)\)", line)[1] for line in dealt]
        assert all("start" not in s and "bucket" not in s for s in shuffles), plan
        assert sum(s.startswith("doc_key") and "phrase_id" not in s for s in shuffles) == 1, plan
