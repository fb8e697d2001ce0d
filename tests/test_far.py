"""Names that models use themselves, and tables whose compressed rows do not come to the driver."""

import numpy as np
import pandas as pd
import pytest

import sumwell as sw
from sumwell.operators import bitmap

NAMES = ["count", "rows", "cluster", "s0", "draw", "sum_y", "sum_y_sq", "class_0", "c0_0", "Count_", "b0", "w"]


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(5)
    n = 400
    d = pd.DataFrame({"x": r.integers(0, 4, n), "z": r.integers(0, 3, n), "g": r.integers(0, 30, n), "id": np.arange(n)})
    d["y"] = d["x"] * 0.5 - d["z"] + r.normal(size=n)
    d["b"] = (r.random(n) < 1 / (1 + np.exp(0.3 - 0.4 * d["x"]))).astype(int)
    d["c"] = r.poisson(np.exp(0.2 + 0.2 * d["x"] - 0.1 * d["z"]))
    d["l"] = np.where(r.random(n) < 0.3, "p", np.where(r.random(n) < 0.5, "q", "r"))
    return d


@pytest.mark.parametrize("name", NAMES)
def test_any_column_name(spark, data, name):
    plain, other = spark.createDataFrame(data), spark.createDataFrame(data.rename(columns={"x": name}))
    for make in (
        lambda d, x: sw.LinearRegression(d, f"y ~ {x} + z", vcov="HC1"),
        lambda d, x: sw.LinearRegression(d, f"y ~ {x} + z", cluster="g", vcov="CR1"),
        lambda d, x: sw.LogisticRegression(d, f"b ~ {x}", method="irls"),
        lambda d, x: sw.MultinomialLogit(d, f"l ~ {x}"),
        lambda d, x: sw.LabelPoisson(d, "c", "l", [x]),
        lambda d, x: sw.Ridge(d, f"y ~ {x}", [1.0], cv_folds=1),
        lambda d, x: sw.PartialOut(d, "y", "z", [x], n_bootstraps=3),
    ):
        a, b = make(plain, "x").fit(), make(other, name).fit()
        assert np.allclose(np.asarray(a.point_estimate, dtype=float), np.asarray(b.point_estimate, dtype=float))
        if a.vcov is not None:
            assert np.allclose(a.vcov, b.vcov)


def test_an_empty_table_has_no_errors_of_0(spark, data):
    for kind in ("HC1", "iid"):
        t = sw.LinearRegression(spark.createDataFrame(data).where("x > 99"), "y ~ x", vcov=kind).fit().tidy()
        assert t["estimate"].isna().all() and t["se"].isna().all()


@pytest.mark.parametrize("model,y", [(sw.LogisticRegression, "b"), (sw.PoissonRegression, "c")])
def test_generalised_models_where_the_patterns_are(spark, data, model, y):
    df = spark.createDataFrame(data)
    near, far = (model(df, f"{y} ~ x + z", method="irls", max_rows=k).fit() for k in (10_000, 3))
    assert far.groups is None and np.allclose(near.point_estimate, far.point_estimate, atol=1e-8)
    for kind in ("iid", "stratum", "hc0"):
        assert np.allclose(near.fit_vcov(kind), far.fit_vcov(kind), atol=1e-8)
    one = model(df, f"{y} ~ x + z", row_key="id").fit().point_estimate
    assert np.abs(one - near.point_estimate).max() < 0.2


def test_ridge_where_the_rows_are(spark, data):
    df = spark.createDataFrame(data)
    for penalize in (True, False):
        near, far = (sw.Ridge(df, "y ~ x + z", np.logspace(-2, 2, 5), cv_folds=4, fold_key="id", penalize_intercept=penalize, max_rows=k).fit() for k in (10_000, 3))
        assert far.groups is None and np.allclose(near.cv_scores, far.cv_scores, atol=1e-8) and near.best_lambda == far.best_lambda
        assert np.allclose(near.point_estimate, far.point_estimate, atol=1e-8) and np.allclose(near.lambda_path_coefs, far.lambda_path_coefs, atol=1e-8)


def test_bootstraps_where_the_rows_are(spark, data, monkeypatch):
    df = spark.createDataFrame(data)
    near = sw.PartialOut(df, "y", "x", ["g", "z"], n_bootstraps=300).fit().standard_error()
    far = sw.PartialOut(df, "y", "x", ["g", "z"], n_bootstraps=300, max_rows=5).fit().standard_error()
    assert np.allclose(near, far, rtol=0.25)
    panel = spark.createDataFrame(sw.staggered_panel(60, 6, (2, 4), (20, 20)))
    a = sw.EventStudy(panel, "Y_it", "W_it", "unit_id", "time_id", n_bootstraps=60).fit()
    b = sw.EventStudy(panel, "Y_it", "W_it", "unit_id", "time_id", n_bootstraps=60, max_rows=20).fit()
    assert all(np.allclose(np.diag(a.vcov[g]) ** 0.5, np.diag(b.vcov[g]) ** 0.5, rtol=0.5, atol=0.02) for g in a.vcov)
    packed = sw.pack_long_panel(panel)
    models = [lambda: sw.BitmapMundlak(packed, n_bootstraps=60), lambda: sw.BitmapEventStudy(packed, n_bootstraps=60)]
    near = [m().fit() for m in models]
    monkeypatch.setattr(bitmap, "MAX_PANEL_CELLS", 10)
    far = [m().fit() for m in models]
    assert np.allclose(near[0].standard_error(), far[0].standard_error(), rtol=0.5)
    assert all(np.allclose(np.diag(near[1].vcov[g]) ** 0.5, np.diag(far[1].vcov[g]) ** 0.5, rtol=0.5, atol=0.02) for g in near[1].vcov)
