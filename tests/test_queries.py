"""Every registered query with SQL against DuckDB on the smallest tables; the others give rows."""

import duckdb
import pandas as pd
import pytest
from conftest import DATA

from quillspark.plans.queries import REGISTRY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    rows = [tuple(None if v is None or v is pd.NA or v != v else round(v, 6) if isinstance(v, float) else int(v) if hasattr(v, "item") and not isinstance(v.item(), (float, bool)) and isinstance(v.item(), int) else v for v in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_sql(spark, duck, name):
    run, sql = REGISTRY[name]
    got, want = run(spark, f"{DATA}/sf0.001").toPandas(), duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want), "the query shows nothing"
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if not sql])
def test_rows(spark, name):
    assert REGISTRY[name][0](spark, f"{DATA}/sf0.001").count() > 0


def test_version_totals_add_in_file_order(spark, tmp_path):
    """Marks of 2, 3.5, 3.5 and 3.5 (with what 0.07 * 50 is over 3.5) add to 12 in this order and to 13 in others, as the SQL adds them."""
    (tmp_path / "lineitem.parquet").mkdir()
    first, last = pd.DataFrame({"l_orderkey": [1], "l_tax": [0.04]}), pd.DataFrame({"l_orderkey": [1] * 3 + list(range(2, 20000)), "l_tax": [0.07] * 3 + [0.01] * 19998})
    for name, rows in (("a", first), ("b", last)):
        rows.to_parquet(tmp_path / "lineitem.parquet" / f"{name}.parquet")
    query, sql = REGISTRY["version_totals"]
    duck = duckdb.connect()
    duck.execute("SET threads = 1")
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = dict(duck.execute(sql).fetchall())
    got = {r.l_orderkey: r.total_marks for r in query(spark, str(tmp_path)).collect()}
    assert got == want and want[1] == 12
