import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT, DATA = Path(__file__).parent.parent, "/root/testdata/sf0.001"
SAMPLE = ["m01_stress_si", "m06_trust_continuity_k7", "m27_properties", "st18_pareto", "jn12_nearest_value", "st01_friedman", "agg20_main_effects", "tw01_snapshots", "m22_crossings"]


def rows(cursor_rows):
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(str([plain(v) for v in r]) for r in cursor_rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(map(tuple, got.select(*columns).collect())) == rows(want.fetchall())


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 1


CODE = "import __spark_entry__ as e; q = e.queries(); assert 'm01_stress_si' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"


@pytest.mark.parametrize("gone", [["llm", "corpus_pipeline.py"], ["llm"]])
@pytest.mark.parametrize("left_over", [False, True])
def test_the_rest_works_without_the_corpus_operators(tmp_path, gone, left_over):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *gone))
    if left_over:
        (tmp_path / "r/pairloom/llm/__pycache__").mkdir(parents=True)
    subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "r", check=True)
