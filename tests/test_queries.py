import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from scrivane import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", plans.QUERIES)
def test_query_equals_its_twin(spark, db, name):
    got = plans.QUERIES[name](spark, DATA)
    want = db.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("left", ["nothing", "the pipeline", "operators without their libraries"])
def test_rest_works_without_the_training_data_operators(tmp_path, left):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "scrivane", tmp_path / "scrivane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if left != "nothing":
        (tmp_path / "corpus_pipeline.py").write_text("from scrivane.llm import simhash\n")
    if left.startswith("operators"):
        (tmp_path / "scrivane/llm").mkdir()
        (tmp_path / "scrivane/llm/__init__.py").touch()
        (tmp_path / "scrivane/llm/simhash.py").write_text("import a_library_that_is_not_there\n")
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries()) and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert ("a_library_that_is_not_there" in done.stderr) == left.startswith("operators")


def test_scans_are_pruned(spark):
    from scrivane import row_json

    df = row_json(spark.read.parquet(f"{DATA}/orders.parquet").where("o_custkey = 5").select("o_orderkey"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,5)" in plan and "o_totalprice" not in plan
