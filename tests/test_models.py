import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.models import absorb, counts, families, moments, ols
from panelwright.models.ols import Spec

import dense


@pytest.fixture(scope="module")
def data():
    """An unbalanced panel: 12 units, 90 days, a signal, a constant attribute."""
    rng = np.random.default_rng(7)
    days = pd.date_range("2019-01-05", periods=90)
    rows = []
    z = rng.normal(size=len(days))
    for u in range(12):
        for t, day in enumerate(days):
            if rng.random() < 0.25:
                continue
            rows.append((u, day.date(), day.dayofweek, day.year * 12 + day.month - 1, z[t], rng.normal(), float(u % 4)))
    pdf = pd.DataFrame(rows, columns=["unit", "day", "dow", "month_year", "z", "w", "attr"])
    pdf["y"] = 0.3 * pdf.z - 0.5 * pdf.w + 0.1 * pdf.unit + 0.05 * pdf.dow + rng.normal(size=len(pdf)) * (1 + 0.1 * pdf.unit)
    pdf["y2"] = pdf.y**2
    mu = np.exp(0.5 + 0.2 * pdf.w + 0.05 * pdf.unit)
    pdf["count"] = rng.negative_binomial(2.0, 2.0 / (2.0 + mu)).astype(float)
    pdf["zw"] = pdf.z * pdf.attr
    return pdf


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data)


def check(fit, pdf, y, x, **how):
    beta, se, r2 = dense.clustered_ols(pdf, y, x, **how)
    assert [fit.coef(t) for t in x] == pytest.approx(list(beta), rel=1e-8, abs=1e-10)
    assert [fit.se(t) for t in x] == pytest.approx(list(se), rel=1e-8)
    assert fit.r_squared == pytest.approx(r2, rel=1e-9)


def test_matches_dense_dummies(frame, data):
    x = ("z", "w", "zw")
    fit = ols.fit(ols.model_sample(frame, x, ["y"]), {"m": Spec("y", x)})[0]
    # months x years here: 4 months of one year
    check(fit, data, "y", x)
    assert fit.n_obs == len(data) and fit.n_units == 12
    assert fit.n_params == 1 + 3 + 6 + data.month_year.nunique() - 1 + 11


def test_two_outcomes_and_nested_controls_share_moments(frame, data):
    x = ("z", "w")
    specs = {
        "plain": Spec("y", x, (), False),
        "dow": Spec("y", x, ("dow",), False),
        "full": Spec("y2", x),
    }
    plain, dow, full = ols.fit(ols.model_sample(frame, x, ["y", "y2"]), specs)
    check(plain, data, "y", x, cats=(), unit_effects=False)
    check(dow, data, "y", x, cats=("dow",), unit_effects=False)
    check(full, data, "y2", x)


def test_partitioning_does_not_matter(frame, data, monkeypatch):
    monkeypatch.setattr(moments, "PIECE", 7)  # every matrix row is its own piece
    x = ("z", "w")
    sample = ols.model_sample(frame, x, ["y"])
    one = ols.fit(sample.coalesce(1), {"m": Spec("y", x)})[0]
    many = ols.fit(sample.repartition(7, "w"), {"m": Spec("y", x)})[0]
    check(many, data, "y", x)
    assert many.se("z") == pytest.approx(one.se("z"), rel=1e-10)


def test_strata_equal_separate_fits(frame, data):
    x = ("w",)
    sample = ols.model_sample(frame, x, ["y"], stratum="attr")
    fits = ols.fit(sample, {"m": Spec("y", x)})
    assert len(fits) == 4
    for f in fits:
        check(f, data[data.attr == float(f.stratum)], "y", x)


def test_small_strata_are_skipped(frame):
    x = ("w",)
    fits = ols.fit(ols.model_sample(frame, x, ["y"], stratum="attr"), {"m": Spec("y", x)}, min_rows=10_000)
    assert all(f.skipped and f.beta is None for f in fits)


def test_constant_attribute_is_not_identified(frame, data):
    x = ("z", "attr", "w")
    fit = ols.fit(ols.model_sample(frame, x, ["y"]), {"m": Spec("y", x)})[0]
    assert fit.coef("attr") is None and fit.se("attr") is None
    check(fit, data, "y", ("z", "w"), k=fit.n_params)


def test_missing_rows_are_dropped_per_model(spark, data, frame):
    holed = frame.withColumn("z", F.when(F.col("w") < 1.0, F.col("z")))
    x = ("z", "w")
    fit = ols.fit(ols.model_sample(holed, x, ["y"]), {"m": Spec("y", x)})[0]
    check(fit, data[data.w < 1.0], "y", x)


def test_cumulative_names_its_lags(spark, frame, data):
    renamed = frame.withColumnsRenamed({"z": "z_lag0", "w": "z_lag7"})
    x = ("z_lag0", "z_lag7")
    fit = ols.fit(ols.model_sample(renamed, x, ["y"]), {"m": Spec("y", x)})[0]
    row = families.cumulative(spark, {"m": fit}).first()
    assert row["lags_used"] == "0,7"
    assert row["cumulative_coef"] == pytest.approx(fit.coef("z_lag0") + fit.coef("z_lag7"))
    at = [fit.terms.index(t) for t in x]
    assert row["cumulative_se"] == pytest.approx(np.sqrt(fit.cov[np.ix_(at, at)].sum()))


def two_way_sample(frame):
    return frame.select(F.lit("all").alias("stratum"), F.col("unit").cast("string"), "day", "w", "z", "y")


def test_two_way_demeaning_both_ways(frame, data):
    solved = absorb.demean_two_way(two_way_sample(frame), ["w", "y"]).toPandas()
    turned = absorb.demean_by_gradients(two_way_sample(frame), ["w", "y"]).toPandas()
    pdf = data.assign(unit=data.unit.astype(str))
    z = dense.design(pdf, ["w"], ("day",))[:, :-1]
    for got in (solved, turned):
        merged = pdf.merge(got, on=["unit", "day"], suffixes=("", "_r"))
        for c in ("w", "y"):
            want = pdf[c] - z @ np.linalg.lstsq(z, pdf[c], rcond=None)[0]
            assert np.allclose(merged[f"{c}_r"], want, atol=1e-8)


def test_day_effects_absorb_a_shared_signal(frame):
    demeaned = absorb.demean_two_way(two_way_sample(frame), ["z", "w", "y"])
    length = {c: float(frame.agg(F.sum(F.col(c) * F.col(c))).first()[0]) for c in ("z", "w")}
    fit = ols.fit(demeaned, {"m": Spec("y", ("z", "w"), (), False)}, scale=length)[0]
    assert fit.coef("z") is None and fit.coef("w") is not None


@pytest.mark.parametrize("family", ["poisson", "nb2"])
def test_counts_match_dense_newton(frame, data, family):
    x = ("z", "w")
    sample = ols.model_sample(frame, x, ["count"])
    got = counts.fit_counts(sample, "count", x, ("dow",), family=family)
    beta, se, a, ll = dense.count_fit(data, "count", x, 0.0 if family == "poisson" else None, ("dow",))
    assert got.family == family
    assert [got.coef(t) for t in x] == pytest.approx(list(beta), rel=1e-5, abs=1e-7)
    assert [got.se(t) for t in x] == pytest.approx(list(se), rel=1e-3)
    assert got.dispersion == pytest.approx(a, rel=1e-4)
    assert got.loglik == pytest.approx(ll, rel=1e-8)


def test_counts_without_overdispersion_fall_back(frame):
    even = frame.withColumn("even", F.lit(3.0) + (F.col("unit") % 2))
    fit = counts.fit_counts(ols.model_sample(even, ("w",), ["even"]), "even", ("w",), ())
    assert fit.family == "poisson" and fit.dispersion == 0.0


def test_special_functions():
    import math

    x = np.array([0.01, 0.5, 1.0, 3.7, 50.0])
    assert np.allclose(counts.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10)
    h = 1e-5
    slope = [(math.lgamma(v + h * v) - math.lgamma(v - h * v)) / (2 * h * v) for v in x]
    assert np.allclose(counts.digamma(x), slope, rtol=1e-6)
    bend = (counts.digamma(x * (1 + h)) - counts.digamma(x * (1 - h))) / (2 * h * x)
    assert np.allclose(counts.trigamma(x), bend, rtol=1e-6)


def test_many_units_flush(frame, data, monkeypatch):
    monkeypatch.setattr(moments, "FLUSH_UNITS", 2)
    x = ("z", "w")
    check(ols.fit(ols.model_sample(frame, x, ["y"]), {"m": Spec("y", x)})[0], data, "y", x)


def test_count_options(frame):
    sample = ols.model_sample(frame.withColumn("shift", F.lit(1.5)), ("w", "shift"), ["count"])
    plain = counts.fit_counts(sample, "count", ("w",), ())
    moved = counts.fit_counts(sample, "count", ("w",), (), offset="shift")
    # a constant offset moves the unit intercepts only
    assert moved.coef("w") == pytest.approx(plain.coef("w"), rel=1e-7)
    robust = counts.fit_counts(sample, "count", ("w",), (), clustered=True)
    assert robust.coef("w") == pytest.approx(plain.coef("w"), rel=1e-10)
    assert robust.se("w") > 0 and robust.se("w") != pytest.approx(plain.se("w"), rel=1e-6)


def test_unit_and_day_on_features(spark, frame, data):
    """The family against explicit unit and day dummies."""
    lags = {f"z_lag{k}": F.col("w") + F.sin(F.col("w") * (k + 1)) for k in (0, 1, 2, 3, 7, 14, 21, 28)}
    rows = frame.withColumns(lags).withColumns({"share": F.col("y"), "total": F.lit(9)})
    fit = families.unit_and_day(rows)
    import numpy

    pdf = data.copy()
    names = list(lags)
    for k, n in zip((0, 1, 2, 3, 7, 14, 21, 28), names):
        pdf[n] = pdf.w + numpy.sin(pdf.w * (k + 1))
    k = 1 + 8 + 6 + pdf.month_year.nunique() - 1 + 1 + 11 + pdf.day.nunique() - 1
    check(fit, pdf, "y", names, cats=("day",), k=k)
    assert fit.n_params == k


def test_blocks_equal_the_dense_design():
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.normal(size=60), "y": rng.normal(size=60), "c": rng.integers(0, 4, 60) * 3, "d": rng.integers(5, 9, 60)})
    layout = moments.Layout(("x",), ("c", "d"), {"c": (0, 3, 6, 9), "d": (5, 6, 7, 8)}, ("y",))
    block, z = moments.Block.of(layout, pdf), layout.matrix(pdf)
    assert np.allclose(block.gram(), z.T @ z)
    group, w = rng.integers(0, 7, 60), rng.normal(size=60)
    hot = np.eye(7)[group]
    assert np.allclose(block.sums(group, 7), hot.T @ z) and np.allclose(block.sums(group, 7, w), hot.T @ (z * w[:, None]))
    v = rng.normal(size=(layout.width, 2))
    assert np.allclose(block.dot(v), z @ v) and np.allclose(block.take(group == 2).dot(v), z[group == 2] @ v)


def test_strata_of_patterns_equal_copied_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(f"u{k % 6}", float(rng.normal()), float(rng.normal()), int(rng.integers(0, 3)), "".join(rng.choice(["0", "1"], 2))) for k in range(400)]
    df = spark.createDataFrame(rows, "unit string, x double, y double, c int, stratum string").repartition(5)
    spec = {"m": ols.Spec("y", ("x",), ("c",))}
    got = ols.fit(df, spec, 1, members=lambda p: [f"s{i}" for i, b in enumerate(p) if b == "1"])
    copied = [df.where(F.substring("stratum", i + 1, 1) == "1").withColumn("stratum", F.lit(f"s{i}")) for i in range(2)]
    want = ols.fit(copied[0].unionByName(copied[1]), spec, 1)
    assert [(f.stratum, f.n_obs, f.n_units, f.n_params) for f in got] == [(f.stratum, f.n_obs, f.n_units, f.n_params) for f in want]
    for f, g in zip(got, want, strict=True):
        assert np.allclose(f.beta, g.beta) and np.allclose(f.cov, g.cov) and f.r_squared == pytest.approx(g.r_squared)


def test_families_copy_no_row(spark, monkeypatch):
    seen = []

    def counted(sample, *args, **how):
        seen.append(sample)
        return []

    monkeypatch.setattr(families.ols, "fit", counted)
    names = [f"z_lag{k}" for k in families.fv.MODEL_LAGS]
    columns = "unit int, day date, total int, share double, signal_z double, dow int, is_holiday int, a double, a_quartile string, " + ", ".join(f"{n} double" for n in names)
    import datetime

    data = [(k % 3, datetime.date(2020, 1, 1 + k // 3), 9, 0.5, 1.0, k % 7, 0, 1.0 if k % 2 else None, "Q1", *[float(k)] * len(names)) for k in range(30)]
    df = spark.createDataFrame(data, columns)
    families.leads(df)
    families.stratified(df, ["a"])
    families.with_attributes(df, ["a"])
    families.attribute_regressor(df, "a")
    assert [s.count() for s in seen] == [27, 30, 30, 15]
    assert all("Generate" not in s._jdf.queryExecution().toString() for s in seen)


def test_two_large_effects_equal_dense_dummies(spark):
    """1,100 units and 1,050 days in two parts that share neither; one column is a function of the day."""
    rng = np.random.default_rng(5)
    rows = []
    for u in range(1100):
        part = u % 2
        for d in rng.choice(525, 5, replace=False):
            day = int(d) * 2 + part
            rows.append((f"u{u}", day, float(rng.normal() + u / 300), float(day % 7), float(rng.normal() + day / 100)))
    pdf = pd.DataFrame(rows, columns=["unit", "day", "x", "w", "y"])
    df = spark.createDataFrame([("all", *r) for r in rows], "stratum string, unit string, day int, x double, w double, y double")
    got = absorb.demean_two_way(df, ["x", "w", "y"]).toPandas().sort_values(["unit", "day"])
    z = np.hstack([dense.dummies(pdf["unit"].tolist(), False), dense.dummies(pdf["day"].tolist(), False)])
    values = pdf[["x", "w", "y"]].to_numpy()
    left = values - z @ np.linalg.lstsq(z, values, rcond=1e-10)[0]
    want = pdf[["unit", "day"]].assign(x=left[:, 0], w=left[:, 1], y=left[:, 2]).sort_values(["unit", "day"])
    assert np.allclose(got[["x", "w", "y"]].to_numpy(), want[["x", "w", "y"]].to_numpy(), atol=1e-8)
    scale = {c: float((pdf[c] ** 2).sum()) for c in ("x", "w")}
    f = ols.fit(absorb.demean_two_way(df, ["x", "w", "y"]), {"m": Spec("y", ("x", "w"), (), False)}, scale=scale)[0]
    assert f.coef("w") is None and f.coef("x") == pytest.approx(left[:, 0] @ left[:, 2] / (left[:, 0] @ left[:, 0]))


def test_weak_overdispersion_is_fitted(spark):
    rng = np.random.default_rng(12)
    y = rng.poisson(2000 * rng.gamma(1 / 1.5e-5, 1.5e-5, 9000)).astype(float)
    rows = [(i % 6, float(v), float(w)) for i, (v, w) in enumerate(zip(y, rng.normal(size=9000), strict=True))]
    fit = counts.fit_counts(spark.createDataFrame(rows, "unit int, hits double, w double"), "hits", ("w",), ())
    assert (fit.family, fit.fallback) == ("nb2", False)
    # at the estimate the likelihood is flat in the dispersion, by sums without special functions
    units = {u: [(r[1], r[2]) for r in rows if r[0] == u] for u in range(6)}

    def loglik(a):
        total = 0.0
        for pairs in units.values():
            v, w = np.array(pairs).T
            eta = fit.coef("w") * w
            mu = np.exp(eta + counts._solve_intercept(v, eta, a))
            steps = np.concatenate([[0.0], np.cumsum(np.log1p(a * np.arange(v.max())))])
            total += (steps[v.astype(int)] - (v + 1 / a) * np.log1p(a * mu) + v * np.log(mu)).sum()
        return total

    h = fit.dispersion / 10
    best = fit.dispersion + h * 0.5 * (loglik(fit.dispersion + h) - loglik(fit.dispersion - h)) / (2 * loglik(fit.dispersion) - loglik(fit.dispersion + h) - loglik(fit.dispersion - h))
    assert fit.dispersion == pytest.approx(best, rel=1e-2)


def test_dispersion_terms_of_whole_and_broken_counts():
    mu = np.array([0.3, 2.0, 7.5, 40.0])
    for y in (np.array([0.0, 1.0, 9.0, 33.0]), np.array([0.0, 1.5, 9.0, 33.25])):
        for a in (0.02, 0.3, 2.0):
            ll, d1, d2 = counts._nb_alpha_terms(y, mu, a)
            up, down = (counts._nb_alpha_terms(y, mu, a * (1 + h)) for h in (1e-4, -1e-4))
            assert d1 == pytest.approx((up[0] - down[0]) / (2e-4 * a), rel=1e-5)
            assert d2 == pytest.approx((up[1] - down[1]) / (2e-4 * a), rel=1e-5)
            exact = sum(math.lgamma(v + 1 / a) - math.lgamma(1 / a) - math.lgamma(v + 1) - math.log1p(a * m) / a + v * math.log(a * m / (1 + a * m)) for v, m in zip(y, mu, strict=True))
            assert ll == pytest.approx(exact, rel=1e-9)
