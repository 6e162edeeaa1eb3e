import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["signal_error", "metrics_ordered", "akima_value", "cut_segments", "replayed", "beta_pid", "clarke_grid", "day_profile", "fit_per_segment"])
def test_queries_are_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    text = lambda df: sorted("|".join("-" if v is None or v != v else f"{float(v):.5e}" if isinstance(v, (int, float)) else str(v) for v in row) for row in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False))
    assert text(got) == text(want)
