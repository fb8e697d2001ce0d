"""Queries of the regression operators over the driver's tables, and their SQL.

Floats are rounded on both sides: the order of additions is not fixed.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumwell.functions.columns import usable
from sumwell.operators.bitmap import BitmapEventStudy, BitmapMundlak, BitPacker, cohort_time_sums, margin_moments, static_moments
from sumwell.operators.dml import PartialOut, leave_one_out_residuals
from sumwell.operators.eventstudy import EventStudy, with_cohort
from sumwell.operators.glm import LabelPoisson, LogisticRegression, MultinomialLogit, PoissonRegression
from sumwell.operators.linear import LinearRegression
from sumwell.operators.panel import DoubleDemeaning, Mundlak, with_means
from sumwell.operators.ridge import Ridge, fold_column
from sumwell.plans.compress import class_counts, label_sums, strata
from sumwell.plans.moments import centred_moments


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lines(spark, sf) -> DataFrame:
    return _read(spark, sf, "lineitem")


def _orders(spark, sf) -> DataFrame:
    """Orders with a 0/1 outcome and numeric codes."""
    o = _read(spark, sf, "orders")
    code = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", code.alias("priority"), (F.col("o_orderstatus") == "F").cast("int").alias("done"), F.month("o_orderdate").alias("month"))


def _panel(spark, sf) -> DataFrame:
    """Users by day of April-like 30-day span: y = min(events, 3), users with id % 4 = k > 0 treated from day 5 + 5 k on."""
    e = _read(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"))
    first = e.agg(F.min("day")).first()[0]
    counts = e.select("user_id", F.datediff("day", F.lit(first)).alias("t")).where("t < 30").groupBy("user_id", "t").agg(F.count("*").alias("n"))
    grid = e.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("t"))
    k = F.col("user_id") % 4
    w = F.when(k == 0, 0).otherwise((F.col("t") >= 5 + 5 * k).cast("int"))
    return grid.join(counts, ["user_id", "t"], "left").select(F.col("user_id").alias("unit_id"), F.col("t").cast("int").alias("time_id"), F.least(F.coalesce("n", F.lit(0)), F.lit(3)).cast("int").alias("Y_it"), w.cast("int").alias("W_it"))


def _frame(spark: SparkSession, pdf: pd.DataFrame, digits: int = 6) -> DataFrame:
    pdf = pdf.assign(**{c: pdf[c].round(digits) for c in pdf.columns if pdf[c].dtype == float})
    kind = ", ".join(f"`{c}` {'double' if pdf[c].dtype == float else 'long' if pdf[c].dtype.kind in 'iu' else 'string'}" for c in pdf.columns)
    return spark.createDataFrame(pdf, kind)


def _tidy(spark, model, digits: int = 6) -> DataFrame:
    return _frame(spark, model.tidy().astype({"se": float})[["term", "estimate", "se"]], digits)


def _estimates(spark, model, digits: int = 6) -> DataFrame:
    return _frame(spark, model.tidy()[["term", "estimate"]], digits)


def ols_strata(spark, sf):
    s = strata(usable(_lines(spark, sf), ["l_extendedprice", "l_quantity", "l_discount"]), ["l_quantity", "l_discount"], ["l_extendedprice"])
    return s.select("l_quantity", "l_discount", "count", F.round("sum_l_extendedprice", 2).alias("sum_l_extendedprice"), F.round(F.col("sum_l_extendedprice_sq") / 1e6, 3).alias("sum_sq_millions"))


def ols_simple(spark, sf):
    return _estimates(spark, LinearRegression(_lines(spark, sf), "l_extendedprice ~ l_quantity", n_bootstraps=0).fit(), 5)


def ols_two(spark, sf):
    return _estimates(spark, LinearRegression(_lines(spark, sf), "l_extendedprice ~ l_quantity + l_discount", n_bootstraps=0).fit(), 4)


def ols_hc1(spark, sf):
    return _tidy(spark, LinearRegression(_lines(spark, sf), "l_extendedprice ~ l_quantity", vcov="HC1").fit(), 5)


def ols_iid(spark, sf):
    return _tidy(spark, LinearRegression(_lines(spark, sf), "l_extendedprice ~ l_quantity", vcov="iid").fit(), 5)


def ols_cluster(spark, sf):
    return _tidy(spark, LinearRegression(_lines(spark, sf), "l_extendedprice ~ l_quantity", cluster="l_suppkey", vcov="CR1").fit(), 5)


def ols_multi_outcome(spark, sf):
    m = LinearRegression(_lines(spark, sf), "l_extendedprice + l_tax ~ l_quantity", n_bootstraps=0).fit()
    return _estimates(spark, m, 5)


def ols_moments(spark, sf):
    """The path for regressors that don't repeat: no group comes to the driver."""
    m = LinearRegression(_lines(spark, sf), "l_quantity ~ l_extendedprice", n_bootstraps=0, max_rows=10).fit()
    return _frame(spark, m.tidy()[["term", "estimate"]], 8)


def moments_centred(spark, sf):
    m = centred_moments(usable(_lines(spark, sf), ["l_quantity", "l_discount", "l_extendedprice"]), ["l_quantity", "l_discount"], ["l_extendedprice"])
    return _frame(spark, pd.DataFrame({"n": [m.n], "mean_q": [m.x_mean[0]], "cov_qd": [m.xx[0, 1] / m.n], "cov_qp": [m.xy[0, 0] / m.n]}), 5)


def ols_cluster_bootstrap(spark, sf):
    return _tidy(spark, LinearRegression(_lines(spark, sf), "l_extendedprice ~ l_quantity + l_discount", cluster="l_suppkey", n_bootstraps=50).fit())


def ols_row_bootstrap(spark, sf):
    return _tidy(spark, LinearRegression(_orders(spark, sf), "o_totalprice ~ priority", row_key="o_orderkey", n_bootstraps=20).fit())


def dml_strata(spark, sf):
    m = PartialOut(_orders(spark, sf), "o_totalprice", "month", ["o_orderstatus", "o_orderpriority"], n_bootstraps=0)
    m.prepare_data()
    m.compress_data()
    return m.compressed.select("o_orderstatus", "o_orderpriority", "count", F.round("s0", 3).alias("sum_x"), F.round("s1", 2).alias("sum_y"), F.round(F.col("c0_1") / 1000, 3).alias("sxy_thousands"))


def dml_one(spark, sf):
    m = PartialOut(_orders(spark, sf), "o_totalprice", "month", ["o_orderstatus", "o_orderpriority"], n_bootstraps=0).fit()
    m.fit_vcov()
    return _tidy(spark, m, 4)


def dml_two(spark, sf):
    return _estimates(spark, PartialOut(_lines(spark, sf), "l_extendedprice", ["l_quantity", "l_discount"], ["l_returnflag", "l_linestatus"], n_bootstraps=0).fit(), 4)


def dml_bootstrap(spark, sf):
    return _tidy(spark, PartialOut(_lines(spark, sf), "l_extendedprice", "l_quantity", ["l_returnflag", "l_suppkey"], n_bootstraps=50).fit())


def loo_residuals(spark, sf):
    r = leave_one_out_residuals(usable(_orders(spark, sf), ["o_totalprice", "month"], ["o_orderstatus", "o_orderpriority"]), ["o_totalprice", "month"], ["o_orderstatus", "o_orderpriority"])
    return r.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum(F.abs("loo_month")), 3).alias("abs_month"), F.round(F.sum(F.abs("loo_o_totalprice")) / 1000, 2).alias("abs_price"))


def _supplier_years(spark, sf):
    return _lines(spark, sf).select(F.col("l_suppkey"), F.year("l_shipdate").alias("year"), "l_discount", "l_extendedprice")


def panel_means(spark, sf):
    m = with_means(usable(_supplier_years(spark, sf), ["l_discount"], ["l_suppkey", "year"]), ["l_discount"], "l_suppkey", "year")
    return m.groupBy("l_suppkey", "year").agg(F.count("*").alias("n"), F.round(F.max("avg_l_discount_unit"), 8).alias("avg_unit"), F.round(F.max("avg_l_discount_time"), 8).alias("avg_time"))


def mundlak_one_way(spark, sf):
    return _estimates(spark, Mundlak(_supplier_years(spark, sf), "l_extendedprice", "l_discount", "l_suppkey", n_bootstraps=0).fit(), 2)


def mundlak_two_way(spark, sf):
    return _estimates(spark, Mundlak(_panel(spark, sf), "Y_it", "W_it", "unit_id", "time_id", n_bootstraps=0).fit())


def mundlak_bootstrap(spark, sf):
    return _tidy(spark, Mundlak(_panel(spark, sf), "Y_it", "W_it", "unit_id", "time_id", n_bootstraps=40).fit())


def double_demeaning(spark, sf):
    return _estimates(spark, DoubleDemeaning(_supplier_years(spark, sf), "l_extendedprice", "l_discount", "l_suppkey", "year", n_bootstraps=0).fit(), 3)


def double_demeaning_bootstrap(spark, sf):
    return _tidy(spark, DoubleDemeaning(_panel(spark, sf), "Y_it", "W_it", "unit_id", "time_id", n_bootstraps=40).fit())


def panel_rows(spark, sf):
    return _panel(spark, sf)


def cohorts(spark, sf):
    c = with_cohort(_panel(spark, sf), "unit_id", "time_id", "W_it")
    return c.groupBy(F.coalesce("cohort", F.lit(-1)).cast("long").alias("cohort")).agg(F.countDistinct("unit_id").alias("units"), F.count("*").alias("n"))


def _event_rows(spark, model) -> DataFrame:
    t = model.tidy()
    t[["cohort", "time"]] = t["term"].str.split(":", expand=True).astype(int)
    return _frame(spark, t[["cohort", "time", "estimate"]])


def event_study(spark, sf):
    return _event_rows(spark, EventStudy(_panel(spark, sf), "Y_it", "W_it", "unit_id", "time_id", n_bootstraps=0).fit())


def event_study_post(spark, sf):
    """Interactions from treatment on only; solved by least squares on the cells."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return _event_rows(spark, EventStudy(_panel(spark, sf), "Y_it", "W_it", "unit_id", "time_id", pre_treat_interactions=False, n_bootstraps=0).fit())


def event_study_bootstrap(spark, sf):
    return _tidy(spark, EventStudy(_panel(spark, sf), "Y_it", "W_it", "unit_id", "time_id", n_bootstraps=30).fit())


def _packed(spark, sf):
    return BitPacker().fit_transform(_panel(spark, sf))


def bitmap_words(spark, sf):
    return _packed(spark, sf).treatment_unit.select(F.col("unit_index").cast("long").alias("unit_index"), F.col("chunk").cast("long").alias("chunk"), "w_bits", "valid_mask")


def bitmap_time_words(spark, sf):
    return _packed(spark, sf).treatment_time.select(F.col("time_index").cast("long").alias("time_index"), F.col("chunk").cast("long").alias("chunk"), "w_bits", "valid_mask")


def bitmap_moments(spark, sf):
    return static_moments(_packed(spark, sf))


def panel_margin_moments(spark, sf):
    return margin_moments(_panel(spark, sf), "unit_id", "time_id", "Y_it", "W_it")


def bitmap_mundlak(spark, sf):
    return _estimates(spark, BitmapMundlak(_packed(spark, sf)).fit())


def bitmap_mundlak_bootstrap(spark, sf):
    return _tidy(spark, BitmapMundlak(_packed(spark, sf), n_bootstraps=40).fit())


def bitmap_cohort_time(spark, sf):
    c = cohort_time_sums(_packed(spark, sf))
    return c.select(F.col("cohort").cast("long").alias("cohort"), F.col("time_index").cast("long").alias("time_index"), "n_units", "sum_y")


def bitmap_event_study(spark, sf):
    return _event_rows(spark, BitmapEventStudy(_packed(spark, sf)).fit())


def logit_strata(spark, sf):
    return strata(usable(_orders(spark, sf), ["done", "priority", "month"]), ["priority", "month"], ["done"]).select("priority", "month", "count", "sum_done")


def _labelled(spark, sf):
    return _read(spark, sf, "labels").join(_read(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "quality", "toxic", (F.col("lang") == "en").cast("int").alias("en"))


def logit_one_regressor(spark, sf):
    """With one 0/1 regressor the maximum is the log-odds of the groups."""
    return _estimates(spark, LogisticRegression(_labelled(spark, sf), "quality ~ en", method="irls").fit())


def logit(spark, sf):
    m = LogisticRegression(_orders(spark, sf), "done ~ priority + month", method="irls").fit()
    m.fit_vcov("hc0")
    return _tidy(spark, m)


def logit_one_step(spark, sf):
    return _estimates(spark, LogisticRegression(_orders(spark, sf), "done ~ priority + month", row_key="o_orderkey").fit())


def poisson(spark, sf):
    m = PoissonRegression(_panel(spark, sf), "Y_it ~ W_it", method="irls").fit()
    m.fit_vcov("stratum")
    return _tidy(spark, m)


def poisson_one_regressor(spark, sf):
    """With one 0/1 regressor the maximum is the log of the groups' means."""
    return _estimates(spark, PoissonRegression(_panel(spark, sf), "Y_it ~ W_it", method="irls").fit())


def multinomial_strata(spark, sf):
    o = _orders(spark, sf)
    return class_counts(usable(o, ["priority"], ["o_orderstatus"]), ["priority"], "o_orderstatus", ["F", "O", "P"])


def multinomial(spark, sf):
    m = MultinomialLogit(_orders(spark, sf), "o_orderstatus ~ priority").fit()
    m.fit_vcov()
    return _tidy(spark, m)


def label_poisson_strata(spark, sf):
    s = label_sums(usable(_lines(spark, sf), ["l_quantity", "l_linenumber"], ["l_returnflag"]), "l_returnflag", ["l_linenumber"], "l_quantity")
    return s.select("l_returnflag", "l_linenumber", "rows", F.round("sum_y", 3).alias("sum_y"))


def label_poisson(spark, sf):
    return _estimates(spark, LabelPoisson(_lines(spark, sf), "l_quantity", "l_returnflag", ["l_linenumber"]).fit())


def ridge_one(spark, sf):
    """One penalty, intercept left out of it: the slope is s_xy / (s_xx + lambda)."""
    m = Ridge(_lines(spark, sf), "l_extendedprice ~ l_quantity", [1000.0], cv_folds=1, penalize_intercept=False).fit()
    return _estimates(spark, m, 4)


def ridge_path(spark, sf):
    m = Ridge(_lines(spark, sf), "l_extendedprice ~ l_quantity + l_discount", np.logspace(-2, 4, 7), selection="path").fit()
    return _frame(spark, m.coefficient_path())


def ridge_cv(spark, sf):
    m = Ridge(_orders(spark, sf), "o_totalprice ~ priority + month", np.logspace(-2, 4, 7), cv_folds=5, fold_key="o_orderkey").fit()
    return _frame(spark, m.cv_curve())


def ridge_folds(spark, sf):
    f = fold_column(_read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 5, "ordered")
    return f.groupBy(F.col("fold_id").cast("long").alias("fold_id")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def streaming_strata(spark, sf):
    """The compressed table of a file stream, run to its end."""
    import tempfile

    from sumwell.streaming.running import running_strata

    schema = _read(spark, sf, "orders").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/orders.parquet" if _is_folder(spark, f"{sf}/orders.parquet") else sf + "/{orders}.parquet")
    stream = stream.select(F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), "o_totalprice")
    query = running_strata(stream, "o_totalprice ~ priority").writeStream.outputMode("complete").format("memory").queryName("sumwell_stream").option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.table("sumwell_stream")
    return out.select("priority", "count", F.round("sum_o_totalprice", 2).alias("sum_o_totalprice"))


def _is_folder(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


_NAMES = """ols_strata ols_simple ols_two ols_hc1 ols_iid ols_cluster ols_multi_outcome ols_moments moments_centred ols_cluster_bootstrap ols_row_bootstrap
dml_strata dml_one dml_two dml_bootstrap loo_residuals panel_means mundlak_one_way mundlak_two_way mundlak_bootstrap double_demeaning double_demeaning_bootstrap
panel_rows cohorts event_study event_study_post event_study_bootstrap bitmap_words bitmap_time_words bitmap_moments panel_margin_moments bitmap_mundlak bitmap_mundlak_bootstrap
bitmap_cohort_time bitmap_event_study logit_strata logit_one_regressor logit logit_one_step poisson poisson_one_regressor multinomial_strata multinomial label_poisson_strata
label_poisson ridge_one ridge_path ridge_cv ridge_folds streaming_strata""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_PANEL = """
    e AS (SELECT user_id, CAST(ts AS DATE) AS day FROM events),
    c AS (SELECT user_id, date_diff('day', (SELECT min(day) FROM e), day) AS t, count(*) AS n FROM e GROUP BY ALL),
    grid AS (SELECT user_id, unnest(generate_series(0, 29)) AS t FROM (SELECT DISTINCT user_id FROM e)),
    panel AS (SELECT g.user_id AS unit_id, CAST(g.t AS INTEGER) AS time_id, CAST(least(coalesce(n, 0), 3) AS INTEGER) AS Y_it,
                     CAST(CASE WHEN g.user_id % 4 = 0 THEN 0 WHEN g.t >= 5 + 5 * (g.user_id % 4) THEN 1 ELSE 0 END AS INTEGER) AS W_it
              FROM grid g LEFT JOIN c USING (user_id, t))"""
_ORDERS = """o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
                          CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS done, month(o_orderdate) AS month FROM orders)"""
_SIMPLE = """s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
                     avg(l_quantity) AS mx, var_pop(l_quantity) * count(*) AS sxx, count(*) AS n FROM lineitem)"""


def _sandwich(meat: str, factor: str) -> str:
    """SE of intercept and slope of the simple regression, from sums u0 u0, u0 u1, u1 u1 with centred x."""
    return f"""
        v AS (SELECT ({factor}) * m11 / (sxx * sxx) AS v1, ({factor}) * (m00 / (n * n) - 2 * mx * m01 / (n * sxx) + mx * mx * m11 / (sxx * sxx)) AS v0 FROM s, ({meat}))
        SELECT 'Intercept' AS term, round(a, 5) AS estimate, round(sqrt(v0), 5) AS se FROM s, v
        UNION ALL SELECT 'l_quantity', round(b, 5), round(sqrt(v1), 5) FROM s, v"""


_CELLS = """
    coh AS (SELECT unit_id, min(CASE WHEN W_it = 1 THEN time_id END) AS cohort FROM panel GROUP BY unit_id),
    cell AS (SELECT coalesce(cohort, -1) AS cohort, time_id, avg(Y_it) AS m FROM panel JOIN coh USING (unit_id) GROUP BY ALL)"""
_DID = f"""WITH {_PANEL}, {_CELLS}
    SELECT CAST(g.cohort AS BIGINT) AS cohort, CAST(g.time_id AS BIGINT) AS time, round((g.m - r.m) - (n.m - nr.m), 6) + 0.0 AS estimate
    FROM cell g JOIN cell r ON r.cohort = g.cohort AND r.time_id = g.cohort - 1
    JOIN cell n ON n.cohort = -1 AND n.time_id = g.time_id JOIN cell nr ON nr.cohort = -1 AND nr.time_id = g.cohort - 1
    WHERE g.cohort >= 0"""
_MARGINS = f"""WITH {_PANEL},
    u AS (SELECT unit_id, CAST(sum(W_it) AS DOUBLE) AS c, CAST(sum(Y_it) AS DOUBLE) AS s, CAST(sum(W_it * Y_it) AS DOUBLE) AS wy FROM panel GROUP BY 1),
    t AS (SELECT time_id, CAST(sum(W_it) AS DOUBLE) AS d, CAST(sum(Y_it) AS DOUBLE) AS s FROM panel GROUP BY 1)
    SELECT * FROM (SELECT sum(c) AS sum_w, sum(c * c) AS sum_c2, sum(s) AS sum_y, sum(wy) AS sum_wy, sum(c * s) AS sum_cy FROM u), (SELECT sum(d * d) AS sum_d2, sum(d * s) AS sum_dy FROM t)"""


def _two_regressors(y: str, a: str, b: str, source: str, names: tuple[str, str], digits: int, more: str = "") -> str:
    return f"""
        m AS (SELECT avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb, var_pop({a}) AS saa, var_pop({b}) AS sbb, covar_pop({a}, {b}) AS sab, covar_pop({a}, {y}) AS say, covar_pop({b}, {y}) AS sby FROM {source}),
        r AS (SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ba, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS bb FROM m)
        SELECT 'Intercept' AS term, round(my - ma * ba - mb * bb, {digits}) AS estimate FROM r
        UNION ALL SELECT '{names[0]}', round(ba, {digits}) FROM r UNION ALL SELECT '{names[1]}', round(bb, {digits}) FROM r"""


def _word(rank: str, group: str, value: str) -> str:
    return f"""WITH {_PANEL}, r AS (SELECT *, dense_rank() OVER (ORDER BY unit_id) - 1 AS unit_index, time_id AS time_index FROM panel),
        b AS (SELECT {group}, {rank} // 64 AS chunk, {rank} % 64 AS p, W_it AS w FROM r)
        SELECT CAST({group} AS BIGINT) AS {group}, CAST(chunk AS BIGINT) AS chunk,
               bit_or(CASE WHEN w = 0 THEN 0 WHEN p = 63 THEN CAST(-9223372036854775808 AS BIGINT) ELSE CAST(pow(2, p) AS BIGINT) END) AS w_bits,
               bit_or(CASE WHEN p = 63 THEN CAST(-9223372036854775808 AS BIGINT) ELSE CAST(pow(2, p) AS BIGINT) END) AS valid_mask
        FROM b GROUP BY {group}, chunk"""


_MUNDLAK2 = f"""WITH {_PANEL}, f AS (SELECT Y_it AS y, W_it AS w, avg(W_it) OVER (PARTITION BY unit_id) AS wu, avg(W_it) OVER (PARTITION BY time_id) AS wt FROM panel),
    g AS (SELECT avg(y) AS my, avg(w) AS mw FROM f),
    d AS (SELECT y, wu - mw AS p, wt - mw AS q, w - wu - wt + mw AS r FROM f, g),
    b AS (SELECT sum(p * y) / sum(p * p) AS bp, sum(q * y) / sum(q * q) AS bq, sum(r * y) / sum(r * r) AS br FROM d)
    SELECT '{{0}}' AS term, round(my - mw * br - mw * (bp - br) - mw * (bq - br), 6) AS estimate FROM b, g
    UNION ALL SELECT '{{1}}', round(br, 6) FROM b UNION ALL SELECT '{{2}}', round(bp - br, 6) FROM b UNION ALL SELECT '{{3}}', round(bq - br, 6) FROM b"""



def _det(m: list[list[str]]) -> str:
    return " + ".join(f"{m[0][i]} * ({m[1][j]} * {m[2][k]} - {m[1][k]} * {m[2][j]})" for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))


def _solve3(m: list[list[str]], v: list[str]) -> list[str]:
    """Three unknowns by Cramer's rule."""
    return [f"({_det([[v[r] if c == k else m[r][c] for c in range(3)] for r in range(3)])}) / ({_det(m)})" for k in range(3)]


def _logit() -> str:
    """Newton steps for done ~ priority + month on its patterns, and errors from scores per observation."""
    z, ij = ["1.0", "priority", "month"], [(i, j) for i in range(3) for j in range(i, 3)]
    h = [[f"h{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    steps = _solve3(h, ["u0", "u1", "u2"])
    sums = ", ".join([*[f"sum((s - n * p) * {z[i]}) AS u{i}" for i in range(3)], *[f"sum(n * p * (1 - p) * {z[i]} * {z[j]}) AS h{i}{j}" for i, j in ij]])
    meat = ", ".join(f"sum((s - 2 * p * s + n * p * p) * {z[i]} * {z[j]}) AS m{i}{j}" for i, j in ij)
    m = [[f"m{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    inverse = ", ".join(f"{x} AS i{k}{c}" for c in range(3) for k, x in enumerate(_solve3(h, ["1.0" if r == c else "0.0" for r in range(3)])))
    var = [" + ".join(f"i{k}{a} * {m[a][b]} * i{k}{b}" for a in range(3) for b in range(3)) for k in range(3)]
    at = "1 / (1 + exp(-(b0 + b1 * priority + b2 * month)))"
    out = " UNION ALL ".join(f"SELECT '{t}' AS term, round(b{k}, 6) AS estimate, round(sqrt({var[k]}), 6) AS se FROM f, inv" for k, t in enumerate(("Intercept", "priority", "month")))
    return f"""WITH RECURSIVE {_ORDERS}, g AS (SELECT CAST(priority AS DOUBLE) AS priority, CAST(month AS DOUBLE) AS month, CAST(count(*) AS DOUBLE) AS n, CAST(sum(done) AS DOUBLE) AS s FROM o GROUP BY 1, 2),
        it AS (SELECT 0 AS step, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2
               UNION ALL SELECT step + 1, b0 + {steps[0]}, b1 + {steps[1]}, b2 + {steps[2]}
               FROM (SELECT step, b0, b1, b2, {sums} FROM (SELECT it.*, g.*, {at} AS p FROM it, g WHERE step < 12) GROUP BY step, b0, b1, b2)),
        f AS (SELECT b0, b1, b2, {sums}, {meat} FROM (SELECT it.*, g.*, {at} AS p FROM it, g WHERE step = 12) GROUP BY b0, b1, b2),
        inv AS (SELECT {inverse} FROM f) {out}"""


def _label_poisson() -> str:
    """Newton steps for each label's counts on the line number."""
    mu = "n * exp(b0 + b1 * x)"
    return f"""WITH RECURSIVE g AS (SELECT l_returnflag AS label, CAST(l_linenumber AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n, CAST(sum(l_quantity) AS DOUBLE) AS s FROM lineitem GROUP BY 1, 2),
        it AS (SELECT 0 AS step, label, ln(sum(s) / sum(n)) AS b0, 0.0::DOUBLE AS b1 FROM g GROUP BY label
               UNION ALL SELECT step + 1, label, b0 + (hxx * u0 - hx * ux) / (h * hxx - hx * hx), b1 + (h * ux - hx * u0) / (h * hxx - hx * hx)
               FROM (SELECT step, label, b0, b1, sum(s - m) AS u0, sum((s - m) * x) AS ux, sum(m) AS h, sum(m * x) AS hx, sum(m * x * x) AS hxx
                     FROM (SELECT step, it.label, b0, b1, x, s, {mu} AS m FROM it JOIN g ON it.label = g.label WHERE step < 12) GROUP BY step, label, b0, b1))
        SELECT label || ':Intercept' AS term, round(b0, 6) + 0.0 AS estimate FROM it WHERE step = 12 UNION ALL SELECT label || ':l_linenumber', round(b1, 6) + 0.0 FROM it WHERE step = 12"""


def _ridge_path() -> str:
    """(X'X + lambda I) b = X'y for each penalty."""
    m = [["n + lam", "q", "d"], ["q", "qq + lam", "qd"], ["d", "qd", "dd + lam"]]
    b = _solve3([[f"({x})" for x in r] for r in m], ["p", "qp", "dp"])
    return f"""WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS n, fsum(l_quantity) AS q, fsum(l_discount) AS d, fsum(l_quantity * l_quantity) AS qq, fsum(l_quantity * l_discount) AS qd, fsum(l_discount * l_discount) AS dd,
            fsum(l_extendedprice) AS p, fsum(l_quantity * l_extendedprice) AS qp, fsum(l_discount * l_extendedprice) AS dp FROM lineitem), l AS (SELECT pow(10.0, k) AS lam FROM range(-2, 5) t(k))
        SELECT round({b[0]}, 6) AS "Intercept", round({b[1]}, 6) AS l_quantity, round({b[2]}, 6) AS l_discount, round(lam, 6) AS lambda FROM s, l"""


ORACLES = {
    "ols_strata": """SELECT l_quantity, l_discount, count(*) AS count, round(sum(l_extendedprice), 2) AS sum_l_extendedprice, round(sum(l_extendedprice * l_extendedprice) / 1e6, 3) AS sum_sq_millions FROM lineitem GROUP BY 1, 2""",
    "ols_simple": f"WITH {_SIMPLE} SELECT 'Intercept' AS term, round(a, 5) AS estimate FROM s UNION ALL SELECT 'l_quantity', round(b, 5) FROM s",
    "ols_two": "WITH " + _two_regressors("l_extendedprice", "l_quantity", "l_discount", "lineitem", ("l_quantity", "l_discount"), 4),
    "ols_hc1": f"WITH {_SIMPLE}," + _sandwich("SELECT sum(e * e) AS m00, sum(e * e * z) AS m01, sum(e * e * z * z) AS m11 FROM (SELECT l_extendedprice - a - b * l_quantity AS e, l_quantity - mx AS z FROM lineitem, s)", "n / (n - 2.0)"),
    "ols_iid": f"WITH {_SIMPLE}," + _sandwich("SELECT r / (k - 2.0) * k AS m00, 0.0 AS m01, r / (k - 2.0) * x AS m11 FROM (SELECT sum(power(l_extendedprice - a - b * l_quantity, 2)) AS r, count(*) AS k, any_value(sxx) AS x FROM lineitem, s)", "1.0"),
    "ols_cluster": f"WITH {_SIMPLE}," + _sandwich("SELECT g / (g - 1.0) * (k - 1.0) / (k - 2.0) * a00 AS m00, g / (g - 1.0) * (k - 1.0) / (k - 2.0) * a01 AS m01, g / (g - 1.0) * (k - 1.0) / (k - 2.0) * a11 AS m11 FROM (SELECT count(*) AS g, sum(c) AS k, sum(u * u) AS a00, sum(u * w) AS a01, sum(w * w) AS a11 FROM (SELECT l_suppkey, count(*) AS c, sum(e) AS u, sum(e * z) AS w FROM (SELECT l_suppkey, l_extendedprice - a - b * l_quantity AS e, l_quantity - mx AS z FROM lineitem, s) GROUP BY 1))", "1.0"),
    "ols_multi_outcome": """WITH s AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_tax, l_quantity) AS c, regr_slope(l_tax, l_quantity) AS d FROM lineitem)
        SELECT 'Intercept_l_extendedprice' AS term, round(a, 5) AS estimate FROM s UNION ALL SELECT 'Intercept_l_tax', round(c, 5) FROM s UNION ALL SELECT 'l_quantity_l_extendedprice', round(b, 5) FROM s UNION ALL SELECT 'l_quantity_l_tax', round(d, 5) + 0.0 FROM s""",
    "ols_moments": "SELECT 'Intercept' AS term, round(regr_intercept(l_quantity, l_extendedprice), 8) AS estimate FROM lineitem UNION ALL SELECT 'l_extendedprice', round(regr_slope(l_quantity, l_extendedprice), 8) FROM lineitem",
    "moments_centred": "SELECT count(*) AS n, round(avg(l_quantity), 5) AS mean_q, round(covar_pop(l_quantity, l_discount), 5) AS cov_qd, round(covar_pop(l_quantity, l_extendedprice), 5) AS cov_qp FROM lineitem",
    "dml_strata": f"WITH {_ORDERS} SELECT o_orderstatus, o_orderpriority, count(*) AS count, round(CAST(sum(month) AS DOUBLE), 3) AS sum_x, round(sum(o_totalprice), 2) AS sum_y, round(covar_pop(month, o_totalprice) * count(*) / 1000, 3) AS sxy_thousands FROM o GROUP BY 1, 2 HAVING count(*) > 1",
    "dml_one": f"""WITH {_ORDERS}, g AS (SELECT count(*) AS n, var_pop(month) * count(*) AS xx, covar_pop(month, o_totalprice) * count(*) AS xy, var_pop(o_totalprice) * count(*) AS yy FROM o GROUP BY o_orderstatus, o_orderpriority HAVING count(*) > 1),
        f AS (SELECT n, power(n / (n - 1.0), 2) AS w, xx, xy, yy FROM g), b AS (SELECT sum(w * xy) / sum(w * xx) AS beta, sum(w * xx) AS q, sum(n) AS total FROM f),
        v AS (SELECT sum(w * (yy - 2 * beta * xy + beta * beta * xx) / n * w * xx) AS m FROM f, b)
        SELECT 'month' AS term, round(beta, 4) AS estimate, round(sqrt(m / (q * q) * total / (total - 1.0)), 4) AS se FROM b, v""",
    "dml_two": """WITH g AS (SELECT power(count(*) / (count(*) - 1.0), 2) * count(*) AS w, var_pop(l_quantity) AS aa, var_pop(l_discount) AS bb, covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS by_ FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 1),
        t AS (SELECT sum(w * aa) AS aa, sum(w * bb) AS bb, sum(w * ab) AS ab, sum(w * ay) AS ay, sum(w * by_) AS by_ FROM g)
        SELECT 'l_quantity' AS term, round((bb * ay - ab * by_) / (aa * bb - ab * ab), 4) AS estimate FROM t UNION ALL SELECT 'l_discount', round((aa * by_ - ab * ay) / (aa * bb - ab * ab), 4) FROM t""",
    "loo_residuals": f"""WITH {_ORDERS}, g AS (SELECT *, count(*) OVER w AS n, sum(month) OVER w AS sm, sum(o_totalprice) OVER w AS sp FROM o WINDOW w AS (PARTITION BY o_orderstatus, o_orderpriority))
        SELECT o_orderstatus, count(*) AS n, round(sum(abs(month - (sm - month) / (n - 1.0))), 3) AS abs_month, round(sum(abs(o_totalprice - (sp - o_totalprice) / (n - 1.0))) / 1000, 2) AS abs_price FROM g WHERE n > 1 GROUP BY 1""",
    "panel_means": """WITH r AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, avg(l_discount) OVER (PARTITION BY l_suppkey) AS u, avg(l_discount) OVER (PARTITION BY year(l_shipdate)) AS t FROM lineitem)
        SELECT l_suppkey, year, count(*) AS n, round(max(u), 8) AS avg_unit, round(max(t), 8) AS avg_time FROM r GROUP BY 1, 2""",
    "mundlak_one_way": "WITH f AS (SELECT l_extendedprice, l_discount, avg(l_discount) OVER (PARTITION BY l_suppkey) AS m FROM lineitem)," + _two_regressors("l_extendedprice", "l_discount", "m", "f", ("l_discount", "avg_l_discount_unit"), 2),
    "mundlak_two_way": _MUNDLAK2.format("Intercept", "W_it", "avg_W_it_unit", "avg_W_it_time"),
    "bitmap_mundlak": _MUNDLAK2.format("Intercept", "W_it", "avg_W_it_unit", "avg_W_it_time"),
    "double_demeaning": """WITH d AS (SELECT l_extendedprice AS y, l_discount - avg(l_discount) OVER (PARTITION BY l_suppkey) - avg(l_discount) OVER (PARTITION BY year(l_shipdate)) + avg(l_discount) OVER () AS x FROM lineitem)
        SELECT 'Intercept' AS term, round(regr_intercept(y, x), 3) AS estimate FROM d UNION ALL SELECT 'ddot_l_discount', round(regr_slope(y, x), 3) FROM d""",
    "panel_rows": f"WITH {_PANEL} SELECT * FROM panel",
    "cohorts": f"WITH {_PANEL}, coh AS (SELECT unit_id, min(CASE WHEN W_it = 1 THEN time_id END) AS cohort FROM panel GROUP BY 1) SELECT CAST(coalesce(cohort, -1) AS BIGINT) AS cohort, count(DISTINCT unit_id) AS units, count(*) AS n FROM panel JOIN coh USING (unit_id) GROUP BY 1",
    "event_study": _DID,
    "bitmap_event_study": _DID,
    "bitmap_words": _word("time_index", "unit_index", "unit_index"),
    "bitmap_time_words": _word("unit_index", "time_index", "time_index"),
    "bitmap_moments": _MARGINS,
    "panel_margin_moments": _MARGINS,
    "bitmap_cohort_time": f"WITH {_PANEL}, coh AS (SELECT unit_id, coalesce(min(CASE WHEN W_it = 1 THEN time_id END), -1) AS cohort FROM panel GROUP BY 1) SELECT CAST(cohort AS BIGINT) AS cohort, CAST(time_id AS BIGINT) AS time_index, count(*) AS n_units, CAST(sum(Y_it) AS DOUBLE) AS sum_y FROM panel JOIN coh USING (unit_id) GROUP BY 1, 2",
    "logit_strata": f"WITH {_ORDERS} SELECT CAST(priority AS DOUBLE) AS priority, CAST(month AS DOUBLE) AS month, count(*) AS count, CAST(sum(done) AS DOUBLE) AS sum_done FROM o GROUP BY 1, 2",
    "logit_one_regressor": """WITH g AS (SELECT CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS en, avg(quality) AS p FROM labels JOIN documents USING (doc_id) GROUP BY 1), a AS (SELECT ln(p / (1 - p)) AS z FROM g WHERE en = 0), b AS (SELECT ln(p / (1 - p)) AS z FROM g WHERE en = 1)
        SELECT 'Intercept' AS term, round(a.z, 6) AS estimate FROM a UNION ALL SELECT 'en', round(b.z - a.z, 6) FROM a, b""",
    "poisson_one_regressor": f"""WITH {_PANEL}, a AS (SELECT ln(avg(Y_it)) AS z FROM panel WHERE W_it = 0), b AS (SELECT ln(avg(Y_it)) AS z FROM panel WHERE W_it = 1)
        SELECT 'Intercept' AS term, round(a.z, 6) AS estimate FROM a UNION ALL SELECT 'W_it', round(b.z - a.z, 6) FROM a, b""",
    "poisson": f"""WITH {_PANEL}, a AS (SELECT ln(avg(Y_it)) AS z FROM panel WHERE W_it = 0), b AS (SELECT ln(avg(Y_it)) AS z FROM panel WHERE W_it = 1)
        SELECT 'Intercept' AS term, round(a.z, 6) AS estimate, 0.0::DOUBLE AS se FROM a UNION ALL SELECT 'W_it', round(b.z - a.z, 6), 0.0 FROM a, b""",  # two patterns, two terms: their scores are 0
    "logit": _logit(),
    "label_poisson": _label_poisson(),
    "ridge_path": _ridge_path(),
    "multinomial_strata": f"WITH {_ORDERS} SELECT CAST(priority AS DOUBLE) AS priority, count(*) FILTER (o_orderstatus = 'F') AS class_0, count(*) FILTER (o_orderstatus = 'O') AS class_1, count(*) FILTER (o_orderstatus = 'P') AS class_2 FROM o GROUP BY 1",
    "label_poisson_strata": "SELECT l_returnflag, CAST(l_linenumber AS DOUBLE) AS l_linenumber, count(*) AS rows, round(sum(l_quantity), 3) AS sum_y FROM lineitem GROUP BY 1, 2",
    "ridge_one": """WITH s AS (SELECT covar_pop(l_quantity, l_extendedprice) * count(*) / (var_pop(l_quantity) * count(*) + 1000.0) AS b, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem)
        SELECT 'Intercept' AS term, round(my - mx * b, 4) AS estimate FROM s UNION ALL SELECT 'l_quantity', round(b, 4) FROM s""",
    "ridge_folds": "SELECT f AS fold_id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT row_number() OVER (ORDER BY o_orderkey) % 5 AS f, o_totalprice FROM orders) GROUP BY 1",
    "streaming_strata": f"WITH {_ORDERS} SELECT CAST(priority AS DOUBLE) AS priority, count(*) AS count, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM o GROUP BY 1",
}
