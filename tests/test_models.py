"""Estimates against computations on the raw rows."""

import numpy as np
import pandas as pd
import pytest

import sumwell as sw
from sumwell.operators.dml import leave_one_out_residuals
from sumwell.functions.formula import parse


def frame(spark, pdf, parts=5):
    return spark.createDataFrame(pdf).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(1)
    n = 2000
    d = pd.DataFrame({"D": r.integers(0, 3, n), "X": r.integers(0, 2, n), "f1": r.integers(0, 5, n), "cluster": r.integers(0, 25, n), "Z": r.normal(size=n)})
    d["id"] = np.arange(n)
    d["Y"] = 1 + 2 * d.D - d.f1 + d.Z + r.normal(size=n)
    d["Y2"] = d.D - 0.5 * d.f1 + r.normal(size=n) * (1 + d.D)
    return d


def raw(d, y, x):
    m = np.column_stack([np.ones(len(d)), *[d[c] for c in x]])
    return m, d[y].to_numpy(float), np.linalg.lstsq(m, d[y].to_numpy(float), rcond=None)[0]


def hc1(m, y, b):
    e = y - m @ b
    bread = np.linalg.inv(m.T @ m)
    return bread @ (m * e[:, None] ** 2).T @ m @ bread * len(y) / (len(y) - m.shape[1])


@pytest.mark.parametrize("limit", [10**6, 3])
def test_ols_equals_raw_rows(spark, rows, limit):
    fit = sw.LinearRegression(frame(spark, rows), "Y ~ D + f1", n_bootstraps=0, max_rows=limit).fit()
    m, y, b = raw(rows, "Y", ["D", "f1"])
    np.testing.assert_allclose(fit.point_estimate, b, rtol=1e-10)
    np.testing.assert_allclose(fit.fit_vcov("HC1"), hc1(m, y, b), rtol=1e-8)
    e = y - m @ b
    np.testing.assert_allclose(fit.fit_vcov("iid"), np.linalg.inv(m.T @ m) * (e @ e) / (len(y) - 3), rtol=1e-8)
    assert (fit.moments is None) == (limit > 3)
    if limit > 3:
        assert int(fit.groups["count"].sum()) == len(rows)


@pytest.mark.parametrize("limit", [10**6, 3])
def test_cluster_robust_and_bootstrap_agree(spark, rows, limit):
    fit = sw.LinearRegression(frame(spark, rows), "Y ~ D + f1", cluster="cluster", n_bootstraps=200, max_rows=limit).fit()
    boot = fit.standard_error()
    m, y, b = raw(rows, "Y", ["D", "f1"])
    u = np.array([(m * (y - m @ b)[:, None])[rows.cluster == c].sum(0) for c in range(25)])
    bread = np.linalg.inv(m.T @ m)
    exact = bread @ u.T @ u @ bread * 25 / 24 * (len(y) - 1) / (len(y) - 3)
    np.testing.assert_allclose(fit.fit_vcov("CR1"), exact, rtol=1e-7)
    assert np.all(np.abs(boot / np.sqrt(np.diag(exact)) - 1) < 0.4)


def test_several_outcomes_are_ordered_by_term(spark, rows):
    fit = sw.LinearRegression(frame(spark, rows), "Y + Y2 ~ D", vcov="HC1").fit()
    a, b = raw(rows, "Y", ["D"]), raw(rows, "Y2", ["D"])
    np.testing.assert_allclose(fit.point_estimate, [a[2][0], b[2][0], a[2][1], b[2][1]], rtol=1e-9)
    np.testing.assert_allclose(fit.standard_error()[[1, 3]], np.sqrt(np.diag(hc1(*b))), rtol=1e-8)
    assert fit.terms() == ["Intercept_Y", "Intercept_Y2", "D_Y", "D_Y2"]


def test_row_bootstrap_matches_analytic_errors_and_repeats(spark, rows):
    one, two = (sw.LinearRegression(frame(spark, rows, k), "Y ~ D", row_key="id", n_bootstraps=60).fit() for k in (2, 7))
    np.testing.assert_allclose(one.draws, two.draws, rtol=1e-8)
    ratio = one.standard_error() / np.sqrt(np.diag(hc1(*raw(rows, "Y", ["D"]))))
    assert np.all(np.abs(ratio - 1) < 0.4)


def test_nulls_leave_and_formulas_are_checked(spark, rows):
    d = rows[["Y", "D"]].astype(float).copy()
    d.loc[:50, "Y"] = np.nan
    fit = sw.LinearRegression(frame(spark, d), "Y ~ D", n_bootstraps=0).fit()
    np.testing.assert_allclose(fit.point_estimate, raw(d.dropna(), "Y", ["D"])[2], rtol=1e-9)
    with pytest.raises(NotImplementedError):
        parse("y ~ x | f")
    for bad in ("y x", " ~ x", "y ~ x + x"):
        with pytest.raises(ValueError):
            parse(bad)
    with pytest.raises(ValueError):
        sw.LinearRegression(frame(spark, d), "Y ~ nothing", n_bootstraps=0).fit()
    with pytest.raises(ValueError):
        sw.LinearRegression(frame(spark, d), "Y ~ D", n_bootstraps=1)
    with pytest.raises(TypeError):
        sw.LinearRegression(3, "Y ~ D", spark=spark)


def test_partialling_out(spark, rows):
    fit = sw.PartialOut(frame(spark, rows), "Y", ["D", "X"], ["f1", "cluster"], n_bootstraps=60).fit()
    g = rows.groupby(["f1", "cluster"])
    n = g["Y"].transform("count")
    k = n > 1
    res = {c: ((rows[c] - g[c].transform("mean")) * n / (n - 1))[k].to_numpy() for c in ("Y", "D", "X")}
    x = np.column_stack([res["D"], res["X"]])
    b = np.linalg.lstsq(x, res["Y"], rcond=None)[0]
    np.testing.assert_allclose(fit.point_estimate, b, rtol=1e-9)
    boot = fit.standard_error()
    e = res["Y"] - x @ b
    bread = np.linalg.inv(x.T @ x)
    strata = rows[k].assign(e=e).groupby(["f1", "cluster"]).ngroup().to_numpy()
    meat = sum((e[strata == s] ** 2).mean() * x[strata == s].T @ x[strata == s] for s in np.unique(strata))
    exact = bread @ meat @ bread * len(e) / (len(e) - 2)
    np.testing.assert_allclose(fit.fit_vcov(), exact, rtol=1e-8)
    assert np.all(np.abs(boot / np.sqrt(np.diag(exact)) - 1) < 0.5)
    loo = leave_one_out_residuals(frame(spark, rows), ["Y"], ["f1", "cluster"]).toPandas().sort_values("id")
    np.testing.assert_allclose(loo["loo_Y"], res["Y"], atol=1e-9)
    assert np.isnan(sw.PartialOut(frame(spark, rows), "Y", "D", ["id"], n_bootstraps=0).fit().point_estimate).all()


@pytest.fixture(scope="module")
def panel():
    r = np.random.default_rng(2)
    i, t = np.repeat(np.arange(18), 7), np.tile(np.arange(7), 18)
    d = pd.DataFrame({"unit": i, "time": t, "cluster": i // 3})
    d["D"] = r.normal(size=126) + i / 6 + t / 5
    d["X"] = r.normal(size=126)
    d["Y"] = d.D * 1.5 - d.X + i / 4 - t / 3 + r.normal(size=126) / 4
    return d


def test_mundlak_and_double_demeaning(spark, panel):
    f = panel.assign(**{f"avg_{c}_{g}": panel.groupby(k)[c].transform("mean") for c in "DX" for g, k in (("unit", "unit"), ("time", "time"))})
    one = sw.Mundlak(frame(spark, panel), "Y", ["D"], "unit", n_bootstraps=20).fit()
    np.testing.assert_allclose(one.point_estimate.ravel(), raw(f, "Y", ["D", "avg_D_unit"])[2], rtol=1e-9)
    two = sw.Mundlak(frame(spark, panel), "Y", ["D", "X"], "unit", "time", "cluster", n_bootstraps=0, max_rows=5).fit()
    np.testing.assert_allclose(two.point_estimate.ravel(), raw(f, "Y", two.x)[2], rtol=1e-8)
    dd = sw.DoubleDemeaning(frame(spark, panel), "Y", "D", "unit", "time", n_bootstraps=30).fit()
    dot = f.D - f.avg_D_unit - f.avg_D_time + f.D.mean()
    np.testing.assert_allclose(dd.point_estimate.ravel(), raw(f.assign(dot=dot), "Y", ["dot"])[2], rtol=1e-9)
    dummies = np.column_stack([panel.D, pd.get_dummies(panel.unit).to_numpy(float), pd.get_dummies(panel.time).to_numpy(float)])
    np.testing.assert_allclose(dd.point_estimate[1, 0], np.linalg.lstsq(dummies, panel.Y, rcond=None)[0][0], rtol=1e-8)
    assert np.isfinite(one.standard_error()).all() and np.isfinite(dd.standard_error()).all()


def staggered(never=True):
    rows = []
    for u, c in enumerate([2, 2, 3, 3, None, None] if never else [2, 2, 3, 3]):
        for t in range(5):
            k = None if c is None or t < c else t - c
            rows.append((u, t, 0 if k is None else 1, u * 0.5 + t * 0.3 + (0 if k is None else (0.7, 1.1, 1.4)[k])))
    return pd.DataFrame(rows, columns=["unit", "time", "D", "Y"])


def test_event_study_finds_the_planted_effects(spark):
    fit = sw.EventStudy(frame(spark, staggered()), "Y", "D", "unit", "time", n_bootstraps=20).fit()
    np.testing.assert_allclose(fit.point_estimate["2"], [0, 0, 0.7, 1.1, 1.4], atol=1e-12)
    np.testing.assert_allclose(fit.point_estimate["3"], [0, 0, 0, 0.7, 1.1], atol=1e-12)
    assert fit.summary()["2"].loc[1, "se"] == 0 and fit.identified.filter(like="treatment").all()
    post = sw.EventStudy(frame(spark, staggered()), "Y", "D", "unit", "time", pre_treat_interactions=False, n_bootstraps=0).fit()
    np.testing.assert_allclose(post.point_estimate["3"], [0, 0, 0, 0.7, 1.1], atol=1e-12)
    with pytest.warns(UserWarning):
        none = sw.EventStudy(frame(spark, staggered(False)), "Y", "D", "unit", "time", n_bootstraps=0).fit()
    assert none.rank < none.matrix.shape[1]


def newton_raw(x, y, kind):
    b = np.zeros(x.shape[1])
    for _ in range(60):
        m = 1 / (1 + np.exp(-x @ b)) if kind == "logit" else np.exp(x @ b)
        v = m * (1 - m) if kind == "logit" else m
        b = b + np.linalg.solve((x * v[:, None]).T @ x, x.T @ (y - m))
    return b, m, v


@pytest.mark.parametrize("kind", ["logit", "poisson"])
def test_glm_equals_raw_rows(spark, kind):
    r = np.random.default_rng(3)
    d = pd.DataFrame({"x1": r.integers(0, 4, 5000), "x2": r.integers(0, 3, 5000)})
    eta = -0.7 + 0.45 * d.x1 - 0.35 * d.x2 if kind == "logit" else 0.2 + 0.18 * d.x1 - 0.25 * d.x2
    d["y"] = (r.random(5000) < 1 / (1 + np.exp(-eta))).astype(int) if kind == "logit" else r.poisson(np.exp(eta))
    d["id"] = np.arange(5000)
    model = sw.LogisticRegression if kind == "logit" else sw.PoissonRegression
    fit = model(frame(spark, d), "y ~ x1 + x2", method="irls").fit()
    x = np.column_stack([np.ones(5000), d.x1, d.x2]).astype(float)
    b, m, v = newton_raw(x, d.y.to_numpy(float), kind)
    np.testing.assert_allclose(fit.point_estimate, b, atol=1e-8)
    bread = np.linalg.inv((x * v[:, None]).T @ x)
    np.testing.assert_allclose(fit.fit_vcov(), bread, rtol=1e-6)
    hc0 = bread @ (x * ((d.y - m) ** 2).to_numpy()[:, None]).T @ x @ bread
    np.testing.assert_allclose(fit.fit_vcov("hc0"), hc0, rtol=1e-6)
    u = pd.DataFrame(x * (d.y - m).to_numpy()[:, None]).groupby([d.x1, d.x2]).sum().to_numpy()
    np.testing.assert_allclose(fit.fit_vcov("stratum"), bread @ u.T @ u @ bread, rtol=1e-6)
    one = model(frame(spark, d, 3), "y ~ x1 + x2", row_key="id").fit()
    again = model(frame(spark, d, 6), "y ~ x1 + x2", row_key="id").fit()
    np.testing.assert_allclose(one.point_estimate, again.point_estimate, rtol=1e-9)
    np.testing.assert_allclose(one.point_estimate, b, atol=0.05)
    with pytest.raises(NotImplementedError):
        model(frame(spark, d), "y ~ x1", n_bootstraps=10)
    with pytest.raises(ValueError):
        model(frame(spark, d), "y ~ x1", method="other")


def test_multinomial_and_label_poisson(spark):
    r = np.random.default_rng(4)
    d = pd.DataFrame({"x1": r.integers(0, 4, 4000), "x2": r.integers(0, 3, 4000)})
    x = np.column_stack([np.ones(4000), d.x1, d.x2])
    p = np.exp(np.column_stack([x @ [0.2, 0.35, -0.2], x @ [-0.4, -0.15, 0.3], np.zeros(4000)]))
    p /= p.sum(1, keepdims=True)
    d["y"] = [("a", "b", "c")[k] for k in (r.random(4000)[:, None] > p.cumsum(1)).sum(1)]
    fit = sw.MultinomialLogit(frame(spark, d), "y ~ x1 + x2").fit()
    b = fit.point_estimate
    q = np.exp(np.column_stack([x @ b[0], x @ b[1], np.zeros(4000)]))
    q /= q.sum(1, keepdims=True)
    for j, v in enumerate("ab"):
        np.testing.assert_allclose(x.T @ ((d.y == v) - q[:, j]), 0, atol=1e-6)
    fit.fit_vcov()
    assert fit.summary()["standard_error"].shape == (2, 3) and fit.baseline == "c"
    other = sw.MultinomialLogit(frame(spark, d), "y ~ x1 + x2", baseline="a").fit()
    np.testing.assert_allclose(other.point_estimate[1], -b[0], atol=1e-6)
    d["n"] = r.poisson(2, 4000)
    lp = sw.LabelPoisson(frame(spark, d), "n", "y", ["x1"]).fit().summary()
    one = d[d.y == "a"]
    ref, _, _ = newton_raw(np.column_stack([np.ones(len(one)), one.x1]).astype(float), one.n.to_numpy(float), "poisson")
    np.testing.assert_allclose(lp.loc["a"], ref, atol=1e-7)


@pytest.mark.parametrize("penalize", [True, False])
def test_ridge(spark, rows, penalize):
    grid = np.logspace(-2, 3, 6)
    fit = sw.Ridge(frame(spark, rows), "Y ~ D + f1", grid, cv_folds=4, fold_key="id", penalize_intercept=penalize).fit()
    m, y, _ = raw(rows, "Y", ["D", "f1"])
    pen = np.diag([float(penalize), 1, 1])
    for lam, b in zip(grid, fit.lambda_path_coefs, strict=True):
        np.testing.assert_allclose(b, np.linalg.solve(m.T @ m + lam * pen, m.T @ y), rtol=1e-8)
    assert fit.best_lambda in grid and fit.cv_scores.shape == (6,)
    np.testing.assert_allclose(fit.point_estimate, fit.lambda_path_coefs[list(grid).index(fit.best_lambda)], rtol=1e-8)
    assert sw.Ridge(frame(spark, rows), "Y ~ D", grid, selection="path").fit().best_lambda == grid[3]
    with pytest.raises(ValueError):
        sw.Ridge(frame(spark, rows), "Y + Y2 ~ D")


def test_solvers_alone():
    r = np.random.default_rng(5)
    x, y, n = np.column_stack([np.ones(30), r.normal(size=30)]), r.normal(size=30), r.integers(1, 5, 30)
    np.testing.assert_allclose(sw.wls(x, y, n), np.linalg.solve((x * n[:, None]).T @ x, (x * n[:, None]).T @ y))
    a = sw.ridge_closed_form_batch(x, y, n, [0.0, 2.0])
    np.testing.assert_allclose(a[1], sw.ridge_closed_form(x, y, n, 2.0), rtol=1e-10)
    np.testing.assert_allclose(a[0], sw.wls(x, y, n), rtol=1e-10)
