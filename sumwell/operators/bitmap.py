"""Dense binary panels as 64-bit words, and panel models from counts of bits.

Unit-major words hold 64 periods of a unit, time-major words 64 units of a
period; bit 0 is the first.  Outcomes are bit planes, one per value that is
not zero.  Words are BIGINT: bit 63 is the sign, and bit_count counts it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumwell.functions.columns import col, ordered_index
from sumwell.functions.solve import gram_solve, wls
from sumwell.operators.base import Estimator, covariance
from sumwell.operators.eventstudy import CellModel, effects
from sumwell.plans.moments import weighted_draws
from sumwell.sources.tables import fetch, table

CHUNK_BITS = 64
MAX_OUTCOME_VALUES = 64
#: Cells of a panel that may come to the driver for a bootstrap, a byte each with up to 64 outcome values.
MAX_PANEL_CELLS = 20_000_000
#: Units whose cells of a period come to the driver as one row.
ROW_UNITS = 4096


@dataclass
class BitmapPanel:
    """Five tables of words and the sizes of the panel."""

    units: DataFrame  # unit, unit_index
    treatment_unit: DataFrame  # unit_index, chunk, w_bits, valid_mask
    treatment_time: DataFrame  # time_index, chunk, w_bits, valid_mask
    outcome_unit: DataFrame  # unit_index, chunk, y, y_bits
    outcome_time: DataFrame  # time_index, chunk, y, y_bits
    cohort_masks: DataFrame  # cohort, chunk, mask; -1 are the never treated
    n_units: int
    n_times: int
    cohorts: dict[int, int]  # units of each cohort
    outcome_values: list[float]
    rows: DataFrame  # unit_index, time_index, y, w, cohort

    @property
    def treated_cohorts(self) -> list[int]:
        return [c for c in sorted(self.cohorts) if c >= 0]

    @property
    def all_cohorts(self) -> list[int]:
        return sorted(self.cohorts)

    @property
    def outcome_cardinality(self) -> int:
        return len(self.outcome_values)


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (position % CHUNK_BITS).cast("int"))


def _chunk(position: Column) -> Column:
    return F.floor(position / CHUNK_BITS).cast("int")


class BitPacker:
    """Checks a long panel and packs it: every unit in every period 0..T-1 once, treatment 0 or 1, few outcome values."""

    def __init__(self, unit_col: str = "unit_id", time_col: str = "time_id", outcome_col: str = "Y_it", treatment_col: str = "W_it", max_outcome_values: int = MAX_OUTCOME_VALUES, store_zero_outcome: bool = False):
        self.unit, self.time, self.y, self.w = unit_col, time_col, outcome_col, treatment_col
        self.max_values, self.store_zero = max_outcome_values, store_zero_outcome

    def check(self, df: DataFrame) -> tuple[int, int, list[float]]:
        missing = [c for c in (self.unit, self.time, self.y, self.w) if c not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {missing}")
        t, w = col(self.time), col(self.w)
        facts = df.agg(
            F.count("*").alias("n"), F.countDistinct(col(self.unit)).alias("units"), F.countDistinct(t).alias("times"), F.min(t).alias("first"), F.max(t).alias("last"),
            F.sum(F.when(t.isNull() | col(self.unit).isNull() | col(self.y).isNull() | w.isNull(), 1).otherwise(0)).alias("nulls"),
            F.sum(F.when((w == 0) | (w == 1), 0).otherwise(1)).alias("odd"),
        ).first()
        if not facts["n"]:
            raise ValueError("the panel is empty")
        if facts["nulls"]:
            raise ValueError("the panel has nulls")
        if df.groupBy(col(self.unit), t).count().where("count > 1").limit(1).count():
            raise ValueError("a unit occurs twice in a period")
        if facts["first"] != 0 or facts["last"] != facts["times"] - 1:
            raise ValueError("periods must be the whole numbers from 0 on, without gaps")
        if facts["n"] != facts["units"] * facts["times"]:
            raise ValueError("the panel is not balanced")
        if facts["odd"]:
            raise ValueError("treatment must be 0 or 1")
        values = [r[0] for r in df.select(col(self.y).cast("double")).distinct().limit(self.max_values + 1).collect()]
        if len(values) > self.max_values:
            raise ValueError(f"more than {self.max_values} outcome values")
        return facts["units"], facts["times"], sorted(values)

    def fit_transform(self, source, spark: SparkSession | None = None) -> BitmapPanel:
        df = table(source, spark)
        wanted = [c for c in (self.unit, self.time, self.y, self.w) if c in df.columns]
        df = df.select(*[col(c) for c in wanted]).persist()  # the checks and the tables below all read it
        n_units, n_times, values = self.check(df)
        units = ordered_index(df.select(col(self.unit).alias("unit")).distinct(), ["unit"], "unit_index").persist()
        first = df.where(col(self.w) == 1).groupBy(col(self.unit).alias("unit")).agg(F.min(col(self.time)).cast("int").alias("cohort"))
        units = units.join(first, "unit", "left").withColumn("cohort", F.coalesce("cohort", F.lit(-1))).persist()
        rows = df.select(col(self.unit).alias("unit"), col(self.time).cast("int").alias("time_index"), col(self.y).cast("double").alias("y"), col(self.w).cast("int").alias("w")).join(units, "unit").drop("unit").persist()
        rows.count()
        df.unpersist()
        cohorts = {r["cohort"]: r["count"] for r in units.groupBy("cohort").count().collect()}
        i, t = F.col("unit_index"), F.col("time_index")

        def treatment(by: str, at: Column) -> DataFrame:
            return rows.groupBy(by, _chunk(at).alias("chunk")).agg(F.bit_or(F.when(F.col("w") == 1, _bit(at)).otherwise(F.lit(0).cast("long"))).alias("w_bits"), F.bit_or(_bit(at)).alias("valid_mask"))

        def outcome(by: str, at: Column) -> DataFrame:
            kept = rows if self.store_zero else rows.where("y <> 0")
            return kept.groupBy(by, _chunk(at).alias("chunk"), "y").agg(F.bit_or(_bit(at)).alias("y_bits"))

        spans = units.select(_chunk(i).alias("chunk")).distinct()
        masks = units.groupBy("cohort", _chunk(i).alias("chunk")).agg(F.bit_or(_bit(i)).alias("mask"))
        every = units.select("cohort").distinct().crossJoin(spans)  # one row per cohort and word
        masks = every.join(masks, ["cohort", "chunk"], "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))
        return BitmapPanel(units.select("unit", "unit_index"), treatment("unit_index", t), treatment("time_index", i), outcome("unit_index", t), outcome("time_index", i), masks, n_units, n_times, cohorts, values, rows)


def pack_long_panel(source, spark: SparkSession | None = None, **options) -> BitmapPanel:
    return BitPacker(**options).fit_transform(source, spark)


def static_moments(panel: BitmapPanel) -> DataFrame:
    """One row: sum_w, sum_c2, sum_y, sum_wy, sum_cy, sum_d2, sum_dy, from counts of bits.

    c are a unit's treated periods, d a period's treated units.
    """
    bits = lambda c: F.bit_count(c).cast("double")
    c = panel.treatment_unit.groupBy("unit_index").agg(F.sum(bits(F.col("w_bits"))).alias("c"))
    both = panel.outcome_unit.join(panel.treatment_unit, ["unit_index", "chunk"])
    y = both.groupBy("unit_index").agg(F.sum(F.col("y") * bits(F.col("y_bits"))).alias("sy"), F.sum(F.col("y") * bits(F.col("y_bits").bitwiseAND(F.col("w_bits")))).alias("swy"))
    by_unit = c.join(y, "unit_index", "left").agg(F.sum("c").alias("sum_w"), F.sum(F.col("c") * F.col("c")).alias("sum_c2"), F.coalesce(F.sum("sy"), F.lit(0.0)).alias("sum_y"), F.coalesce(F.sum("swy"), F.lit(0.0)).alias("sum_wy"), F.coalesce(F.sum(F.col("c") * F.coalesce("sy", F.lit(0.0))), F.lit(0.0)).alias("sum_cy"))
    d = panel.treatment_time.groupBy("time_index").agg(F.sum(bits(F.col("w_bits"))).alias("d"))
    yt = panel.outcome_time.groupBy("time_index").agg(F.sum(F.col("y") * bits(F.col("y_bits"))).alias("sy"))
    by_time = d.join(yt, "time_index", "left").agg(F.sum(F.col("d") * F.col("d")).alias("sum_d2"), F.sum(F.col("d") * F.coalesce("sy", F.lit(0.0))).alias("sum_dy"))
    return by_unit.crossJoin(by_time)  # one row each


def margin_moments(rows: DataFrame, unit: str = "unit_index", time: str = "time_index", y: str = "y", w: str = "w") -> DataFrame:
    """The same moments from the long panel, by its margins."""
    x, v = col(w).cast("double"), col(y).cast("double")
    by_unit = rows.groupBy(col(unit)).agg(F.sum(x).alias("c"), F.sum(v).alias("s"), F.sum(x * v).alias("wy")).agg(F.sum("c").alias("sum_w"), F.sum(F.col("c") * F.col("c")).alias("sum_c2"), F.sum("s").alias("sum_y"), F.sum("wy").alias("sum_wy"), F.sum(F.col("c") * F.col("s")).alias("sum_cy"))
    by_time = rows.groupBy(col(time)).agg(F.sum(x).alias("d"), F.sum(v).alias("s")).agg(F.sum(F.col("d") * F.col("d")).alias("sum_d2"), F.sum(F.col("d") * F.col("s")).alias("sum_dy"))
    return by_unit.crossJoin(by_time)


def cohort_time_sums(panel: BitmapPanel) -> DataFrame:
    """cohort, time_index, n_units, sum_y, from the outcome planes and the masks of the cohorts."""
    masks = F.broadcast(panel.cohort_masks) if len(panel.cohorts) * (panel.n_units // CHUNK_BITS + 1) <= 500_000 else panel.cohort_masks
    sums = panel.outcome_time.join(masks, "chunk").groupBy("cohort", "time_index").agg(F.sum(F.col("y") * F.bit_count(F.col("y_bits").bitwiseAND(F.col("mask")))).alias("sum_y"))
    sizes = panel.cohort_masks.groupBy("cohort").agg(F.sum(F.bit_count("mask")).cast("long").alias("n_units"))
    times = panel.treatment_time.select("time_index").distinct()
    every = sizes.crossJoin(times)  # one row per cohort and period
    return every.join(sums, ["cohort", "time_index"], "left").select("cohort", "time_index", "n_units", F.coalesce("sum_y", F.lit(0.0)).alias("sum_y"))


class _Bitmap:
    """Construction from a panel or from long data; a bootstrap draws units."""

    @classmethod
    def from_long(cls, source, *, spark: SparkSession | None = None, n_bootstraps: int = 0, seed: int = 42, **packer):
        return cls(pack_long_panel(source, spark, **packer), n_bootstraps=n_bootstraps, seed=seed)

    def prepare_data(self) -> None:
        pass

    def far(self) -> bool:
        return self.panel.n_units * self.panel.n_times > MAX_PANEL_CELLS

    def panel_codes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cells as numbers (periods, units), 2 k + w for the k-th outcome value, and outcome and treatment by number; for draws on the driver."""
        p = self.panel
        n = len(p.outcome_values)
        kind, size = next((k, b) for k, b in (("tinyint", 8), ("smallint", 16), ("int", 32)) if 2 * n <= 1 << (b - 1))
        numbers = p.rows.sparkSession.createDataFrame(list(enumerate(p.outcome_values)), "k int, y double")
        cells = p.rows.join(F.broadcast(numbers), "y").select("time_index", F.floor(F.col("unit_index") / ROW_UNITS).alias("part"), F.struct("unit_index", (2 * F.col("k") + F.col("w")).cast(kind).alias("code")).alias("cell"))
        got = cells.groupBy("time_index", "part").agg(F.sort_array(F.collect_list("cell"))["code"].alias("codes")).toArrow()
        codes = np.full((p.n_times, p.n_units), -1, dtype=f"int{size}")
        for t, part, row in zip(got["time_index"].to_pylist(), got["part"].to_pylist(), got["codes"], strict=True):
            codes[t, part * ROW_UNITS : (part + 1) * ROW_UNITS] = row.values.to_numpy()
        if codes.min() < 0:
            raise ValueError("the panel is not balanced")
        return codes, np.repeat(p.outcome_values, 2), np.tile([0.0, 1.0], n)

    def unit_cohorts(self) -> np.ndarray:
        got = self.panel.rows.where("time_index = 0").select("unit_index", "cohort").toArrow()
        out = np.zeros(self.panel.n_units, dtype=int)
        out[got["unit_index"].to_numpy()] = got["cohort"].to_numpy()
        return out


class BitmapMundlak(_Bitmap, Estimator):
    """y on w, its unit mean and its time mean, from seven moments of a balanced binary panel."""

    def __init__(self, panel: BitmapPanel, n_bootstraps: int = 0, seed: int = 42):
        self.panel = panel
        Estimator.__init__(self, panel.rows, seed=seed, n_bootstraps=n_bootstraps)

    def compress_data(self) -> None:
        self.moments = {k: float(v) for k, v in static_moments(self.panel).first().asDict().items()}

    def solve(self, m: dict[str, float], n: float) -> np.ndarray:
        t = self.panel.n_times
        w, c, d = m["sum_w"], m["sum_c2"] / t, m["sum_d2"] / n
        cd = m["sum_w"] ** 2 / (n * t)
        a = np.array([[n * t, w, w, w], [w, w, c, d], [w, c, c, cd], [w, d, cd, d]])
        return gram_solve(a, np.array([m["sum_y"], m["sum_wy"], m["sum_cy"] / t, m["sum_dy"] / n]))

    def estimate(self) -> pd.Series:
        return pd.Series(self.solve(self.moments, self.panel.n_units), index=self.terms())

    def far_moments(self, block: int = 25):
        """The seven moments under hashed weights of the units, and the units drawn, by draw."""
        x, v, wt = F.col("w").cast("double"), F.col("y"), F.col("_w")
        units = self.panel.rows.groupBy("unit_index").agg(F.sum(x).alias("c"), F.sum(v).alias("s"), F.sum(x * v).alias("wy"))
        for lo in range(0, self.n_bootstraps, block):
            size = min(block, self.n_bootstraps - lo)
            draw = lambda rows: weighted_draws(rows, ["unit_index"], size, self.seed or 0, lo)  # noqa: E731, B023
            c, s = F.col("c"), F.col("s")
            a = draw(units).groupBy("_draw").agg(F.sum(wt).alias("n"), F.sum(wt * c).alias("sum_w"), F.sum(wt * c * c).alias("sum_c2"), F.sum(wt * s).alias("sum_y"), F.sum(wt * F.col("wy")).alias("sum_wy"), F.sum(wt * c * s).alias("sum_cy"))
            t = draw(self.panel.rows.select("unit_index", "time_index", "y", "w")).groupBy("_draw", "time_index").agg(F.sum(wt * x).alias("d"), F.sum(wt * v).alias("s"))
            b = t.groupBy("_draw").agg(F.sum(F.col("d") * F.col("d")).alias("sum_d2"), F.sum(F.col("d") * s).alias("sum_dy"))
            for r in a.join(b, "_draw").orderBy("_draw").collect():  # a row per draw
                m = r.asDict()
                yield {k: float(m[k]) for k in m if k.startswith("sum_")}, float(m["n"])

    def terms(self) -> list[str]:
        return ["Intercept", "W_it", "avg_W_it_unit", "avg_W_it_time"]

    def bootstrap(self) -> np.ndarray:
        """Units drawn with replacement; time means follow the draw.

        A panel of more than MAX_PANEL_CELLS cells stays where it is, and its
        units get hashed Poisson(1) weights.
        """
        if self.far():
            self.draws = np.array([self.solve(m, n) for m, n in self.far_moments()])
            return covariance(self.draws)
        codes, y, w = self.panel_codes()
        n, draws = self.panel.n_units, []
        c, sy, wy = (sum(v[row] for row in codes) for v in (w, y, w * y))
        for _ in range(self.n_bootstraps):
            m = np.bincount(self.rng.integers(0, n, n), minlength=n).astype(float)
            d, ty = (np.array([m @ v[row] for row in codes]) for v in (w, y))
            draws.append(self.solve({"sum_w": m @ c, "sum_c2": m @ (c * c), "sum_y": m @ sy, "sum_wy": m @ wy, "sum_cy": m @ (c * sy), "sum_d2": d @ d, "sum_dy": d @ ty}, n))
        self.draws = np.array(draws)
        return covariance(self.draws)


class BitmapEventStudy(_Bitmap, CellModel):
    """The event study of a balanced binary panel, from cohort-by-time sums of bits; treated from the cohort's time on."""

    def __init__(self, panel: BitmapPanel, n_bootstraps: int = 0, seed: int = 42, pre_treat_interactions: bool = True):
        self.panel, self.pre_treat = panel, pre_treat_interactions
        Estimator.__init__(self, panel.rows, seed=seed, n_bootstraps=n_bootstraps)

    def frame(self, sums: pd.DataFrame) -> pd.DataFrame:
        c = sums["cohort"].to_numpy()
        on = 0 if self.pre_treat else ((c >= 0) & (sums["time_index"].to_numpy() >= c)).astype(int)
        return pd.DataFrame({"cohort": np.where(c < 0, np.nan, c), "time": sums["time_index"].to_numpy(), "w": on, "count": sums["n_units"].to_numpy(), "sum_y": sums["sum_y"].to_numpy()})

    def compress_data(self) -> None:
        self.sums = fetch(cohort_time_sums(self.panel), self.max_rows).sort_values(["cohort", "time_index"], ignore_index=True)
        self.cells = self.frame(self.sums)

    def far_draws(self, block: int = 25):
        """Units and summed outcomes of each cell, by draw."""
        for lo in range(0, self.n_bootstraps, block):
            size = min(block, self.n_bootstraps - lo)
            drawn = weighted_draws(self.panel.rows.select("unit_index", "time_index", "cohort", "y"), ["unit_index"], size, self.seed or 0, lo)
            got = drawn.groupBy("_draw", "cohort", "time_index").agg(F.sum("_w").alias("n"), F.sum(F.col("y") * F.col("_w")).alias("s")).toPandas()  # block x cells
            for k in range(lo, lo + size):
                m = self.sums[["cohort", "time_index"]].merge(got[got["_draw"] == k], on=["cohort", "time_index"], how="left").fillna(0)
                yield m["n"].to_numpy(dtype=float), m["s"].to_numpy(dtype=float)

    def bootstrap(self) -> dict[str, np.ndarray]:
        if self.far():
            draws = []
            for count, s in self.far_draws():
                ok = count > 0
                draws.append(self.flat(effects(wls(self.matrix[ok], s[ok] / count[ok], count[ok]), self.names, self.cohorts, self.last)))
            self.draws = np.array(draws)
            return self.by_cohort(self.draws)
        codes, y, _ = self.panel_codes()
        n, draws = self.panel.n_units, []
        names = self.panel.all_cohorts
        member = np.searchsorted(names, self.unit_cohorts())
        by_name = lambda v: np.bincount(member, weights=v, minlength=len(names))
        for _ in range(self.n_bootstraps):
            m = np.bincount(self.rng.integers(0, n, n), minlength=n).astype(float)
            size, total = by_name(m), np.array([by_name(m * y[row]) for row in codes]).T
            k = self.sums["cohort"].map({c: i for i, c in enumerate(names)}).to_numpy()
            count, s = size[k], total[k, self.sums["time_index"].to_numpy()]
            ok = count > 0
            beta = wls(self.matrix[ok], s[ok] / count[ok], count[ok])
            draws.append(self.flat(effects(beta, self.names, self.cohorts, self.last)))
        self.draws = np.array(draws)
        return self.by_cohort(self.draws)


def word_text(word: int, width: int = CHUNK_BITS) -> str:
    """The bits of a word from the first on."""
    return "".join("1" if (word >> k) & 1 else "0" for k in range(width))


def translation_table(panel: BitmapPanel, limit: int = 1000) -> pd.DataFrame:
    """Unit, treatment bits and outcome digits of the first units, to look at."""
    rows = panel.rows.where(F.col("unit_index") < limit).join(panel.units, "unit_index")
    g = rows.toPandas().sort_values(["unit_index", "time_index"])
    digits = lambda s: "".join(f"{v:g}" for v in s)
    out = g.groupby(["unit_index", "unit"], sort=True).agg(cohort=("cohort", "first"), treatment=("w", digits), outcome=("y", digits)).reset_index()
    return out


def _panel_frame(y: np.ndarray, w: np.ndarray) -> pd.DataFrame:
    n, t = y.shape
    return pd.DataFrame({"unit_id": np.repeat(np.arange(1, n + 1), t), "time_id": np.tile(np.arange(t), n), "Y_it": y.ravel().astype(int), "W_it": w.ravel().astype(int)})


def demo_panel() -> pd.DataFrame:
    """Four units over five periods, the last never treated."""
    start = np.array([1, 2, 3, 5])
    w = (np.arange(5)[None, :] >= start[:, None]).astype(int)
    y = np.array([[0, 1, 1, 0, 1], [0, 0, 1, 1, 1], [1, 0, 0, 1, 0], [0, 1, 0, 0, 1]])
    return _panel_frame(y, w)


def _binary_panel(start: np.ndarray, n_times: int, lift: float, rng: np.random.Generator) -> pd.DataFrame:
    n = len(start)
    w = (np.arange(n_times)[None, :] >= start[:, None]).astype(int)
    base = rng.normal(-0.4, 0.6, n)[:, None] + np.linspace(-0.2, 0.2, n_times)[None, :]
    y = rng.random((n, n_times)) < 1 / (1 + np.exp(-(base + lift * w)))
    return _panel_frame(y, w)


def one_shot_panel(n_units: int = 120, n_times: int = 12, n_treated: int = 60, start: int = 5, lift: float = 0.8, seed: int = 0) -> pd.DataFrame:
    """Binary outcomes; the first ``n_treated`` units are treated from ``start`` on."""
    at = np.where(np.arange(n_units) < n_treated, start, n_times)
    return _binary_panel(at, n_times, lift, np.random.default_rng(seed))


def staggered_panel(n_units: int = 120, n_times: int = 12, cohorts: tuple[int, ...] = (4, 7), treated: tuple[int, ...] = (35, 45), lift: float = 0.8, seed: int = 0) -> pd.DataFrame:
    """Binary outcomes; groups of units are treated from different times on, the rest never."""
    at = np.concatenate([np.full(k, c) for c, k in zip(cohorts, treated, strict=True)] + [np.full(n_units - sum(treated), n_times)])
    return _binary_panel(at, n_times, lift, np.random.default_rng(seed))
