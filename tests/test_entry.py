"""Sources, the stream, and every query with SQL against DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

import sumwell as sw
from sumwell.queries import ORACLES, QUERIES
from sumwell.sources.tables import TooManyRows, fetch, fetch_one, is_select, register, table
from sumwell.streaming.running import running_regression

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_sources(spark):
    pdf = pd.DataFrame({"y": [1.0, 2.0, 4.0], "x": [0.0, 1.0, 2.0]})
    register(spark, small=pdf)
    assert table("small", spark).count() == table("select * from small", spark).count() == table(pdf, spark).count() == 3
    assert fetch_one(table("WITH a AS (SELECT 1 AS b) SELECT b FROM a", spark)) == 1 and fetch_one(table("small", spark).where("x > 9")) is None
    assert is_select("  select 1") and not is_select("selection") and not is_select("")
    with pytest.raises(TooManyRows):
        fetch(table("small", spark), 2)
    fit = sw.LinearRegression("small", "y ~ x", spark=spark, n_bootstraps=0).fit()
    assert fit.tidy_frame().count() == 2 and spark.range(1).count() == 1


def test_stream(spark, tmp_path):
    pdf = pd.DataFrame({"y": [float(k * k) for k in range(20)], "x": [float(k % 5) for k in range(20)]})
    for k in range(2):
        spark.createDataFrame(pdf.iloc[10 * k : 10 * k + 10]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("y double, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running_regression(stream, "y ~ x", lambda c, epoch: seen.append(c), str(tmp_path / "state"), availableNow=True).awaitTermination()
    ref = sw.LinearRegression(spark.createDataFrame(pdf), "y ~ x", n_bootstraps=0).fit().point_estimate
    assert len(seen) == 2 and abs(seen[-1]["y"].to_numpy() - ref).max() < 1e-9


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    order = [c for c in cols if want[c].dtype != float] or cols
    a, b = (x[cols].sort_values(order + [c for c in cols if c not in order], ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-6, atol=2e-4)
