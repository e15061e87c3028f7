"""Every query of the catalogue runs; those with SQL give what DuckDB gives."""

import pytest
from longspan import catalog
from pyspark.sql import functions as F

from tests.compare import assert_same

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
#: Forests of many trees.
LARGE = {"mdl05_mdl06_spl08_forest_grid"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - LARGE))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.collect() is not None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_adjusted_p_of_repeated_p_is_one_that_the_sql_allows(spark, sf_dir, tmp_path):
    """The SQL leaves the order of equal p open; with its second window taking them in the reverse of the first, it gives Spark's rows."""
    import duckdb

    path, name = str(tmp_path / "supplier.parquet"), "win17_win18_adjusted_p"
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (s_suppkey + 1000 * k AS s_suppkey, (s_suppkey % 2)::INT AS s_nationkey) FROM '{sf_dir}/supplier.parquet', range(30) t(k)) TO '{path}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{path}'")
    ordered = SQL[name].replace("ORDER BY p)", "ORDER BY p, id)").replace("ORDER BY p DESC ROWS", "ORDER BY p DESC, id DESC ROWS")
    assert ordered.count(", id)") == 1 and ordered.count(", id DESC ROWS") == 1
    df = QUERIES[name](spark, str(tmp_path))
    each = df.where("p IS NOT NULL").groupBy("family", "p").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("q").alias("q")).collect()
    assert {r["q"] for r in each} == {1} and {r["rows"] for r in each} != {1}
    assert_same(df, con, ordered)


def test_silhouette_without_vectors_or_labels(spark, tmp_path):
    """A missing vector is in nobody's mean distance; a missing label and a label of one row have 0."""
    import duckdb

    path, name = str(tmp_path / "embeddings.parquet"), "mdl13_exact_silhouette"
    rows = [(0, [1.0, 0.2], 0), (1, [0.9, 0.1], 0), (2, None, 0), (3, [0.1, 1.0], 1), (4, [0.2, 0.7], 1), (5, [-1.0, 0.1], 2), (6, [0.5, 0.5], None), (7, None, 3), (8, [0.4, -1.0], 4), (9, None, 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    assert_same(QUERIES[name](spark, str(tmp_path)), con, SQL[name])
