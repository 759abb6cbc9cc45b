"""Queries against their SQL, on rows that the small tables lack."""

import duckdb

from siltworks import catalog


def both(spark, folder, table, name):
    """Rows of a query and of its SQL over one table of a folder."""
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = catalog.queries()[name](spark, str(folder)).collect()
    return sorted(tuple(r) for r in got), sorted(con.execute(catalog.oracle_sql()[name]).fetchall())


def test_tokens_in_single_precision(spark, tmp_path):
    rows = [(1, [0.066, -0.005]), (2, [0.5, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got, want = both(spark, tmp_path, "embeddings", "array_tokens")
    assert got == want == [(1, 256, 1 + 67 + 6 + 2, 1), (2, 256, 1 + 501 + 1 + 2, 1)]


def test_pages_of_one_url(spark, tmp_path):
    rows = [(1, "u", "<p>"), (2, "u", "<p>é</p>"), (3, "v", ""), (4, None, "<b>"), (5, "w", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got, want = both(spark, tmp_path, "pages", "source_web")
    assert got == want == [(1, "u", 3), (2, "u", 9), (3, "v", 0), (4, None, 3), (5, "w", None)]
