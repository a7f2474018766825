"""Columns of the input that have an operator's own names, in either case, for all operators and stages."""

import pytest
from pyspark.sql import functions as F

from corpuslake.llm import contamination, hmm, html_text, language, near_copies, packing, quality, secrets, simhash, substrings, url_rules

NAMES = """a added after anchor at b band base base_failed base_score before candidates class clean codes component_id contaminated content copy data doc_key failed_rules
far fingerprint first fp given h hash hashes held_out hinted hit host items k kept key known l labels lang_pred lead length lines listed low mask mark mid n n_chars n_copied
n_hit n_live n_words near near_items news node offset own owner page part parts path place pos rank rare raw repository root row row_key rule s salt score sequence_id spans start
stay sums t tb text_key tile token tokens u utf8 v verdict w whole whole_window word words x y __hit __items __row __s __t __w __spans __text __clean lang source""".split()


def table_of(spark, case, *columns):
    """Two equal rows and one with nulls; columns are (name, value), the others have the value of their number."""
    mine = {c for c, _ in columns}
    others = [n for n in NAMES if n not in mine]
    one = spark.range(1).select(*[F.lit(v).alias(c) for c, v in columns], *[F.lit(i).alias(getattr(n, case)()) for i, n in enumerate(others)])
    none = one.select(*[F.lit(None).cast(t).alias(c) for c, t in one.dtypes])
    return one.unionByName(one).unionByName(none)


TEXT = "one two three four five six seven password=0123456789abcdef"
CARRYING = {
    "language": (lambda d: language.predict(d, language.train(d.withColumn("lang", F.lit("aa")), F.lit(True))), {"lang_pred", "score"}),
    "contamination": (lambda d: contamination.contamination(d, d.sparkSession.createDataFrame([(1, "two three")], "item_id long, text string"), slop=1), {"n_words", "n_hit", "items", "whole_window", "contaminated", "near_items"}),
    "quality": (lambda d: quality.ledger(quality.measure(d)), {*quality.MEASURES, "failed_rules"}),
    "secrets": (lambda d: secrets.scan(d, with_text=True), {"base", "added", "n_live", "n_copied"}),
}


@pytest.mark.parametrize("case", ["lower", "upper"])
@pytest.mark.parametrize("name", CARRYING)
def test_columns_pass_through(spark, name, case):
    call, new = CARRYING[name]
    docs = table_of(spark, case, ("doc_id", 7), ("text", TEXT), ("source", "s"), ("lang", "aa"))
    got = call(docs)
    assert got.columns == [c for c in docs.columns if c.lower() not in new] + [c for c in got.columns if c in new] and new <= set(got.columns)
    rest = [c for c in docs.columns if c.lower() not in new]
    rows = lambda d: sorted((tuple(r) for r in d.select(*rest).collect()), key=str)
    assert rows(got) == rows(docs)


@pytest.mark.parametrize("case", ["lower", "upper"])
def test_urls(spark, case):
    pages = table_of(spark, case, ("page_id", 7), ("url", "http://a.net/1"))
    labels = spark.createDataFrame([(7, 0, 1)], "doc_id long, quality int, toxic int")
    got = url_rules.judge(pages, labels, min_rows=1, min_confidence=0.1)
    assert len(got.collect()) == 3 and got.columns[-4:] == ["host", "path", "rule", "verdict"]
    assert len({c.lower() for c in got.columns}) == len(got.columns)


READING = {
    "hmm": lambda d: hmm.score(d, F.lit(False)),
    "simhash": simhash.near_duplicates,
    "near_copies": near_copies.near_copies,
    "substrings": substrings.remove_repeats,
    "html": lambda d: html_text.extract(d.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("http://a.b/c"))),
}


@pytest.mark.parametrize("case", ["lower", "upper"])
@pytest.mark.parametrize("name", READING)
def test_other_columns_are_not_read(spark, name, case):
    docs = table_of(spark, case, ("doc_id", 7), ("text", TEXT)).drop("url", "html", "page_id")
    assert len(READING[name](docs).collect()) == 3


@pytest.mark.parametrize("case", ["lower", "upper"])
def test_stages(spark, tmp_path, case):
    pipeline = pytest.importorskip("corpus_pipeline")
    public = pytest.importorskip("public_tokenizers")
    spark.createDataFrame([(1, "absent words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table_of(spark, case, ("doc_id", 7), ("text", "ab " * 30 + TEXT), ("lang", "aa"), ("source", "s"), ("n_chars", 5))
    want = {"language": 2, "near_copies": 2, "contamination": 3, "secrets": 3}
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and len(got.collect()) == want[name]
    assert len(packing.pack(docs, public.path("byte_bpe_50k.json")).collect()) >= 3
