import math

import duckdb
import pandas as pd
import pytest

from shardwright.plans import catalogue, vault_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _rows(df: pd.DataFrame):
    def plain(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return None
        x = x.item() if hasattr(x, "item") else x
        return round(x, 6) if isinstance(x, float) else int(x) if isinstance(x, bool) else x

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, con, name):
    got, want = catalogue.queries()[name](spark, sf_dir).toPandas(), con.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_every_query_has_sql_or_a_reason():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"q40_text_diff"}


def test_text_diff(spark, sf_dir):
    import difflib

    rows = catalogue.queries()["q40_text_diff"](spark, sf_dir).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    import re

    for r in rows:
        new = re.sub(r"\bthe\b", "a", text[r.doc_id], flags=re.A)
        assert r["diff"] == "".join(difflib.unified_diff(text[r.doc_id].splitlines(True), new.splitlines(True), "old", "new"))


def test_entry_without_the_text_subpackage(tmp_path):
    """The entry module works with that subpackage and the pipeline gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "shardwright", tmp_path / "shardwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(catalogue.queries())), str(len(catalogue.oracle_sql()))], out.stderr
