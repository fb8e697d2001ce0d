"""Packed panels against the long form."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import sumwell as sw
from sumwell.operators import bitmap
from sumwell.operators.bitmap import cohort_time_sums, margin_moments, static_moments, word_text


def wide(n, t, seed=0):
    """n units over t periods with outcomes 0..3 and treatment that may stop."""
    r = np.random.default_rng(seed)
    start = r.integers(1, t + 2, n)
    d = pd.DataFrame({"unit_id": np.repeat(np.arange(n) * 7 + 3, t), "time_id": np.tile(np.arange(t), n)})
    d["W_it"] = (d.time_id.to_numpy() >= np.repeat(start, t)).astype(int)
    d["Y_it"] = r.integers(0, 4, n * t)
    return d


@pytest.mark.parametrize("n,t", [(5, 64), (70, 6), (3, 130)])
def test_words_hold_the_panel(spark, n, t):
    d = wide(n, t)
    p = sw.pack_long_panel(spark.createDataFrame(d).repartition(3))
    w = d.pivot(index="unit_id", columns="time_id", values="W_it").to_numpy()
    for r in p.treatment_unit.collect():
        part = w[r["unit_index"], 64 * r["chunk"] : 64 * r["chunk"] + 64]
        assert word_text(r["w_bits"], len(part)) == "".join(map(str, part)) and bin(r["valid_mask"] & (2**64 - 1)).count("1") == len(part)
    for r in p.treatment_time.collect():
        part = w[64 * r["chunk"] : 64 * r["chunk"] + 64, r["time_index"]]
        assert word_text(r["w_bits"], len(part)) == "".join(map(str, part))
    y = d.pivot(index="unit_id", columns="time_id", values="Y_it").to_numpy()
    for r in p.outcome_unit.collect():
        part = y[r["unit_index"], 64 * r["chunk"] : 64 * r["chunk"] + 64]
        assert word_text(r["y_bits"], len(part)) == "".join("1" if v == r["y"] else "0" for v in part)
    assert p.outcome_unit.where("y = 0").count() == 0 and p.outcome_cardinality == d.Y_it.nunique()
    assert static_moments(p).first().asDict() == margin_moments(spark.createDataFrame(d), "unit_id", "time_id", "Y_it", "W_it").first().asDict()
    sums = cohort_time_sums(p).toPandas()
    assert sums["sum_y"].sum() == d.Y_it.sum() and sums["n_units"].sum() == n * t


def test_models_equal_the_grouped_ones(spark):
    one = sw.one_shot_panel()
    packed = sw.BitmapMundlak.from_long(spark.createDataFrame(one), n_bootstraps=10).fit()
    grouped = sw.Mundlak(spark.createDataFrame(one), "Y_it", "W_it", "unit_id", "time_id", n_bootstraps=0).fit()
    np.testing.assert_allclose(packed.point_estimate, grouped.point_estimate.ravel(), atol=1e-10)
    assert np.isfinite(packed.standard_error()).all()
    many = sw.staggered_panel()
    for pre in (True, False):
        p = sw.BitmapEventStudy(sw.pack_long_panel(spark.createDataFrame(many)), n_bootstraps=10, pre_treat_interactions=pre).fit()
        g = sw.EventStudy(spark.createDataFrame(many), "Y_it", "W_it", "unit_id", "time_id", pre_treat_interactions=pre, n_bootstraps=0).fit()
        for c in ("4", "7"):
            np.testing.assert_allclose(p.point_estimate[c], g.point_estimate[c], atol=1e-10)
        assert (p.summary()["4"]["se"] >= 0).all()


@pytest.mark.parametrize("values", [4, 90])
def test_draws_equal_those_of_the_long_form(spark, monkeypatch, values):
    monkeypatch.setattr(bitmap, "ROW_UNITS", 8, raising=False)  # several rows a period
    d = wide(37, 5, 3)
    d["Y_it"] = np.random.default_rng(values).integers(0, values, len(d)) * 0.5 - 1
    packed = sw.pack_long_panel(spark.createDataFrame(d).repartition(3), max_outcome_values=200)
    static, event = (m(packed, n_bootstraps=2, seed=9).fit() for m in (sw.BitmapMundlak, sw.BitmapEventStudy))
    y, w = (d.pivot(index="unit_id", columns="time_id", values=c).to_numpy() for c in ("Y_it", "W_it"))
    rng = np.random.default_rng(9)
    for mine, cells in zip(static.draws, event.draws, strict=True):
        drawn = rng.integers(0, 37, 37)
        a, b = w[drawn].astype(float), y[drawn]
        x = np.column_stack([np.ones(b.size), a.ravel(), np.repeat(a.mean(axis=1), 5), np.tile(a.mean(axis=0), 37)])
        np.testing.assert_allclose(mine, np.linalg.lstsq(x, b.ravel(), rcond=None)[0], atol=1e-9)
        long = pd.DataFrame({"unit_id": np.repeat(np.arange(37), 5), "time_id": np.tile(np.arange(5), 37), "Y_it": b.ravel(), "W_it": a.ravel().astype(int)})
        whole = sw.BitmapEventStudy.from_long(spark.createDataFrame(long), max_outcome_values=200).fit()
        assert whole.cohorts == event.cohorts  # else a draw has fewer cells
        np.testing.assert_allclose(cells, whole.flat(whole.point_estimate), atol=1e-9)


def test_draws_hold_a_few_bytes_a_cell(spark):
    n, t = 6000, 30
    i = F.col("id")
    long = spark.range(n * t).select((i % n).alias("unit_id"), F.floor(i / n).cast("int").alias("time_id"), (F.xxhash64("id") % 4).cast("int").alias("Y_it"), ((i % n) % 3 * 20 + 5 <= F.floor(i / n)).cast("int").alias("W_it"))
    packed = sw.pack_long_panel(long)
    for model in (sw.BitmapMundlak, sw.BitmapEventStudy):
        m = model(packed, n_bootstraps=3).fit()
        tracemalloc.start()
        m.bootstrap()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40 * n * t  # Python rows take some hundred


def test_bad_panels_are_refused(spark):
    d = wide(4, 5)
    bad = {
        "twice": pd.concat([d, d.iloc[:1]]), "gap": d[d.time_id != 2], "unbalanced": d.iloc[:-1], "treatment": d.assign(W_it=d.W_it * 2),
        "values": d.assign(Y_it=np.arange(20)), "column": d.drop(columns="Y_it"), "empty": d.iloc[:0],
    }
    for name, x in bad.items():
        with pytest.raises(ValueError):
            sw.pack_long_panel(spark.createDataFrame(x, ", ".join(f"{c} long" for c in x.columns)), max_outcome_values=16)
            pytest.fail(name)
    for k in (-1, 1):
        with pytest.raises(ValueError):
            sw.BitmapMundlak.from_long(spark.createDataFrame(d), n_bootstraps=k)


def test_display(spark):
    t = sw.translation_table(sw.pack_long_panel(spark.createDataFrame(sw.demo_panel())))
    assert list(t["treatment"]) == ["01111", "00111", "00011", "00000"] and t["cohort"].tolist() == [1, 2, 3, -1]
    assert F is not None
