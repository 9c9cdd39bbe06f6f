"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import os
import re

import duckdb
import pytest

from inkwell.plans import note_queries, relational_queries

SF = "/root/testdata/sf0.001"
QUERIES = note_queries.QUERIES | relational_queries.QUERIES
ORACLES = note_queries.ORACLES | relational_queries.ORACLES


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_oracle(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_titles_of_texts_without_a_first_line(spark, duck, tmp_path):
    """Empty, blank and marks-only first lines, and no text."""
    texts = ["", "\n", "\nsecond line", " \n", "--\nx", "-a-", "\r\nb", None, "plain title\nx", "数据"]
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("segmented_titles", "or_bag"):
        df, want = QUERIES[name](spark, str(tmp_path)), c.sql(ORACLES[name])
        assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns), name


def test_theta_join_of_odd_rows_keeps_no_pairs(spark, tmp_path):
    """Keys of several nations and rows, null keys, nations and balances, no number; the pairs themselves are not held for DISTINCT."""
    balance = [-900.0, 9990.0, None, 50.5, 9050.5, 9050.6, float("nan"), 9050.5, -990.0, 9999.0]
    key = lambda i, n: None if i % 11 == 5 else (i * 7) % n
    supplier = [(key(i, 13), None if i % 17 == 3 else i % 4, balance[(i * 3) % 10]) for i in range(60)]
    customer = [(key(i, 19), None if i % 13 == 6 else (i // 2) % 4, balance[(i * 7 + 1) % 10]) for i in range(90)]
    c = duckdb.connect()
    for name, rows, columns in (("supplier", supplier, ("s_suppkey", "s_nationkey", "s_acctbal")), ("customer", customer, ("c_custkey", "c_nationkey", "c_acctbal"))):
        spark.createDataFrame(rows, "{} long, {} int, {} double".format(*columns)).write.parquet(str(tmp_path / f"{name}.parquet"))
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    df, want = QUERIES["sql_theta_join"](spark, str(tmp_path)), c.sql(ORACLES["sql_theta_join"])
    got = plain(df.collect(), df.columns)
    assert got == plain(want.fetchall(), want.columns) and len(got) > 100
    plan = df._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and not re.search(r"Aggregate \[s_suppkey#\d+L, c_custkey", plan.children().apply(0).toString())
