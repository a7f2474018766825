import glob
import json
import os

import pytest

import __spark_entry__
from corpuslake import cli
from corpuslake.operators import embedding

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


def test_commands_end_to_end(spark, tmp_path):
    page = "<title>T</title><p>" + "we build boats for rivers " * 12 + "{}</p>"
    pages = [("https://a.com/about", page.format("and lakes")), ("https://a.com/team", page.format("with engineers")), ("https://b.com/x", page.format("too"))]
    spark.createDataFrame(pages, "url string, html string").write.parquet(f"{tmp_path}/pages")
    assert cli.crawl(spark, f"{tmp_path}/pages", f"{tmp_path}/artifacts", "2026-01-02T00:00:00+00:00") == 0
    home, model = f"{tmp_path}/warehouse", embedding.HashEmbedder(384)
    for n in range(2):  # a second load changes nothing
        code, report = cli.load(spark, home, f"{tmp_path}/artifacts", "2026-01-03T00:00:00+00:00")
        counts = {r.domain: (r.inserted, r.unchanged) for r in report.collect()}
        assert code == 0 and counts == ({"a.com": (2, 0), "b.com": (1, 0)} if n == 0 else {"a.com": (0, 2), "b.com": (0, 1)})
    assert cli.load(spark, home, f"{tmp_path}/artifacts", "2027-01-03T00:00:00+00:00")[0] == 1  # stale
    assert cli.ask(spark, home, "a.com", "boats") is None  # nothing embedded yet
    assert cli.embed(spark, home, "nowhere.com") == 2 and cli.embed(spark, home, "a.com", dry_run=True) == 0
    assert cli.embed(spark, home, "A.com", embedder=model) == 0 and cli.embed(spark, home, "a.com", embedder=model) == 0
    hits = cli.ask(spark, home, "a.com", "engineers", embedder=model).collect()
    assert hits[0].source_url == "https://a.com/team" and len(hits) == 2
    assert cli.answer(spark, home, "a.com", "engineers?").declined and cli.answer(spark, home, "b.com", "x") is None
    import yaml

    os.mkdir(f"{tmp_path}/gt")
    truth = {"prospect": {"company_name": "A", "domain": "a.com", "corpus_artifact": "x"}, "signals": {"people_listed": 0, "has_team_page": True},
             "questions": [{"id": "q2_technical_capacity", "question": "q", "reference": "r", "source_urls": ["https://a.com/team", "https://a.com/never"]},
                           {"id": "q1_what_and_to_whom", "question": "q", "reference": "r", "source_urls": [], "expected_outcome": "insufficient_evidence"}]}
    with open(f"{tmp_path}/gt/a.yaml", "w") as f:
        yaml.safe_dump(truth, f)
    found = cli.evaluate(spark, home, f"{tmp_path}/gt", model)
    assert {r.status for r in found["pairs"].collect()} == {"scored", "insufficient_evidence"}
    assert [r.hit for r in found["recalls"].orderBy("k").collect()][-1] and found["recalls"].count() == 4
    assert sorted(r.state for r in found["coverage"].collect()) == ["never_attempted", "present"]
    assert [(r.compared, r.agreed) for r in found["signals"].collect()] == [(2, 2)]
    assert cli.main(["validate", f"{tmp_path}/gt"]) == 1


def test_entry_runs(spark):
    if os.path.isdir(SF):
        assert __spark_entry__.entry(spark).count() == 5


REFERENCE = sorted(k for k in __spark_entry__.oracle_sql() if not k.startswith(("op", "pipeline")))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    show = lambda v: "" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    for name in REFERENCE:
        got = __spark_entry__.queries()[name](spark, SF)
        want = con.execute(__spark_entry__.oracle_sql()[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns), name
        assert sorted(tuple(map(show, r)) for r in want.fetchall()) == sorted(tuple(show(r[c]) for c in columns) for r in got.collect()), name


def test_a_part_that_cannot_be_imported_is_left_out(tmp_path):
    """An absent module deep in the llm part takes that part away and no other query."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(f"{root}/corpuslake/llm"):
        pytest.skip("the part is not there")
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 60 and out[1] == "False"


def test_the_rest_works_without_the_training_data_part(tmp_path):
    """A copy without the llm folders and the pipeline imports, lists its queries, runs one and passes tests."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True, check=True)
    names, sql = json.loads(out.stdout.splitlines()[-1])
    code = f"""
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
print(e.queries()["f19_cost"](spark, {SF!r}).count())
"""
    here = {"cwd": tmp_path / "copy", "env": os.environ | {"PYTHONPATH": str(tmp_path / "copy")}, "capture_output": True, "text": True}
    if os.path.isdir(SF):
        assert int(subprocess.run([sys.executable, "-c", code], check=True, **here).stdout.splitlines()[-1]) == 200
    subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_functions.py", "tests/test_web.py"], check=True, **here)
    assert "k1_topk_in_tenant" in names and set(sql) <= set(names) and not any(n.startswith("op") or n == "pipeline" for n in names)
