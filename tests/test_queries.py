"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from lakemill.plans import registry  # noqa: E402
from tests.conftest import SMALL  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def table(columns, rows):
    def value(v):
        return round(v, 4) if isinstance(v, float) and not math.isnan(v) else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SMALL)
    found = table(df.columns, [tuple(r) for r in df.collect()])
    q = con.execute(registry.SQL[name])
    assert found == table([c[0] for c in q.description], q.fetchall())


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(registry.QUERIES) == set(registry.SQL)


def test_entry_imports_without_the_training_data_folders(tmp_path):
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(here, "lakemill"), tmp_path / "lakemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 80 and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
