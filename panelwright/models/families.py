"""Model families over a feature panel.

A feature panel has unit, day, total, hits, share, signal_z, z_lag*, calendar
columns and, where a family needs them, attributes.  Variants of a family
(thresholds, leads, quartiles, outcomes) are strata or specs of one fit, so each
family reads its sample twice, however many variants it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright import fixed_values as fv
from panelwright.functions import calendar, inference
from panelwright.models import absorb, moments, ols
from panelwright.models.ols import CONTROLS, Fit, Spec, model_sample
from panelwright.operators import events, features, panel as panels, quantiles
from panelwright.session import settle

HOLIDAY = ("is_holiday",)


def lag_names(lags: Sequence[int] = fv.MODEL_LAGS) -> tuple[str, ...]:
    return tuple(f"z_lag{k}" for k in lags)


def base_rows(df: DataFrame, min_total: int = fv.MIN_TOTAL) -> DataFrame:
    """Enough volume, known share, known unit."""
    return panels.complete_share(df, min_total).where(F.col("unit").isNotNull())


def lag_rows(df: DataFrame, min_total: int = fv.MIN_TOTAL, lags=fv.MODEL_LAGS) -> DataFrame:
    return base_rows(df, min_total).where(features.any_known(lag_names(lags)))


def spread(df: DataFrame, variants: dict[str, dict[str, Column]], keep: Sequence[str]) -> DataFrame:
    """Each row once per variant, with that variant's columns; no shuffle."""
    structs = [
        F.struct(F.lit(name).alias("stratum"), *[c.alias(n) for n, c in columns.items()])
        for name, columns in variants.items()
    ]
    exploded = df.select(*keep, F.explode(F.array(*structs)).alias("_v"))
    return exploded.select(*keep, "_v.*")


def known_bits(names: Sequence[str]) -> Column:
    """Which of the columns a row knows, as a text of ones and zeros."""
    return F.concat(*[F.when(F.col(n).isNull(), "0").otherwise("1") for n in names])


def filled(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Unknown values as 0: the strata that use a column leave such rows out."""
    return df.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names})


# -- distributed lag ---------------------------------------------------------


def distributed_lag(
    df: DataFrame, y: str = "share", lags=fv.MODEL_LAGS, min_total: int = fv.MIN_TOTAL, extra=()
) -> Fit:
    """Outcome on signal lags, weekday, month x year, holiday and unit effects."""
    x = (*extra, *lag_names(lags), *HOLIDAY)
    sample = model_sample(lag_rows(df, min_total, lags), x, [y])
    return ols.fit(sample, {"dl": Spec(y, x)})[0]


def placebo(df: DataFrame, y: str = "total", min_total: int = fv.MIN_TOTAL) -> Fit:
    """The same model on a volume outcome in hundreds."""
    scaled = df.withColumn(f"{y}_100", F.col(y).cast("double") / 100.0)
    return distributed_lag(scaled, f"{y}_100", min_total=min_total)


def impulse_response(spark: SparkSession, f: Fit, lags=fv.MODEL_LAGS) -> DataFrame:
    rows = []
    for k in lags:
        b, se = f.coef(f"z_lag{k}"), f.se(f"z_lag{k}")
        low = None if se is None else b - fv.Z95 * se
        high = None if se is None else b + fv.Z95 * se
        rows.append((k, b, se, low, high))
    return spark.createDataFrame(
        rows, "lag int, coef double, se double, ci_lo double, ci_hi double"
    )


CUMULATIVE = (
    "model string, lags_used string, cumulative_coef double, cumulative_se double, "
    "ci_low double, ci_hi double"
)


def cumulative_row(name: str, f: Fit, lags=fv.CUMULATIVE_LAGS) -> tuple:
    """Sum over the lags that are in the model (their names are in the row)."""
    total, se, used = f.sum_of([f"z_lag{k}" for k in lags])
    text = ",".join(t.removeprefix("z_lag") for t in used)
    if total is None or se is None:
        return name, text, total, se, None, None
    return name, text, total, se, total - fv.Z95 * se, total + fv.Z95 * se


def cumulative(spark: SparkSession, fits: dict[str, Fit], lags=fv.CUMULATIVE_LAGS) -> DataFrame:
    return spark.createDataFrame([cumulative_row(n, f, lags) for n, f in fits.items()], CUMULATIVE)


def scaled_cumulative(df: DataFrame, f: Fit, lags=fv.CUMULATIVE_LAGS) -> DataFrame:
    """Cumulative effect times the mean volume of all panel rows."""
    total, se, _ = f.sum_of([f"z_lag{k}" for k in lags])
    mean = F.avg("total")
    return df.agg(
        mean.alias("mean_total"),
        (mean * F.lit(total)).alias("effect"),
        (mean * F.lit(se) * fv.Z95).alias("half_width"),
    )


# -- nested models -----------------------------------------------------------


def nested_specs(y: str = "share", lags=fv.MODEL_LAGS) -> dict[str, Spec]:
    x = lag_names(lags)
    return {
        "Model 1: Signal lags only": Spec(y, x, (), False),
        "Model 2: + Day of week": Spec(y, x, ("dow",), False),
        "Model 3: + Month x Year": Spec(y, x, CONTROLS, False),
        "Model 4: + Holiday": Spec(y, (*x, *HOLIDAY), CONTROLS, False),
        "Model 5: + Unit fixed effects": Spec(y, (*x, *HOLIDAY), CONTROLS, True),
    }


def nested(df: DataFrame, min_total: int = fv.MIN_TOTAL) -> list[Fit]:
    """Five nested models as column subsets of the same cross-products."""
    specs = nested_specs()
    x = specs["Model 5: + Unit fixed effects"].x
    return ols.fit(model_sample(lag_rows(df, min_total), x, ["share"]), specs)


def with_attributes(df: DataFrame, names: Sequence[str], min_total: int = fv.MIN_TOTAL) -> list[Fit]:
    """The full model plus each attribute alone, then all together.

    An attribute that is constant within its unit is not identified next to
    unit effects and comes out as such.
    """
    base = (*lag_names(), *HOLIDAY)
    groups = {f"+ {n}": (n,) for n in names} | {"+ all attributes": tuple(names)}
    rows = lag_rows(df, min_total).withColumn("_known", known_bits(names))
    at = {n: i for i, n in enumerate(names)}
    needs = {name: tuple(at[n] for n in group) for name, group in groups.items()}
    sample = model_sample(filled(rows, names), (*base, *names), ["share"], stratum="_known")
    return ols.fit(
        sample, {n: Spec("share", (*base, *g), stratum=n) for n, g in groups.items()},
        members=lambda bits: [name for name, need in needs.items() if all(bits[i] == "1" for i in need)],
    )


def comparison(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    return spark.createDataFrame(
        [(f.model, f.n_obs, f.r_squared, f.n_params) for f in fits],
        "model string, n_obs bigint, r_squared double, n_params bigint",
    )


def term_row(label, f: Fit, term: str) -> tuple:
    b, se = f.coef(term), f.se(term)
    if b is None or se is None:
        return label, b, se, None, None
    return label, b, se, b - fv.Z95 * se, b + fv.Z95 * se


def lag7_comparison(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    return spark.createDataFrame(
        [term_row(f.model, f, "z_lag7") for f in fits],
        "model string, lag7_coef double, lag7_se double, lag7_ci_low double, lag7_ci_hi double",
    )


# -- attributes and strata ---------------------------------------------------


def interactions(
    df: DataFrame, names: Sequence[str], lags=fv.INTERACTION_LAGS, min_total: int = fv.MIN_TOTAL
) -> Fit:
    """All lags plus products of some lags with every attribute."""
    products = features.interaction_columns(lag_names(lags), list(names))
    rows = features.ensure_columns(lag_rows(df, min_total), products)
    x = (*lag_names(), *products, *HOLIDAY)
    return ols.fit(model_sample(rows, x, ["share"]), {"interactions": Spec("share", x)})[0]


def interaction_table(spark: SparkSession, f: Fit) -> DataFrame:
    rows = []
    for term in f.spec.x:
        if "_x_" not in term:
            continue
        lag, name = term.removeprefix("z_lag").split("_x_", 1)
        b, se = f.coef(term), f.se(term)
        t = b / se if b is not None and se else None
        rows.append((int(lag), name, b, se, t, inference.normal_p_value(t)))
    return spark.createDataFrame(
        rows,
        "lag int, demographic string, coefficient double, se double, t_stat double, p_value double",
    )


def stratified(
    df: DataFrame, names: Sequence[str], min_total: int = fv.MIN_TOTAL, min_rows: int = fv.MIN_ROWS
) -> list[Fit]:
    """One fit per attribute and quartile, all of them in the same two passes."""
    x = (*lag_names(), *HOLIDAY)
    # A row carries its quartiles of all attributes; it belongs to one stratum of each.
    pattern = F.concat_ws("|", *[F.coalesce(F.col(f"{n}_quartile"), F.lit("-")) for n in names])
    sample = model_sample(lag_rows(df, min_total).withColumn("_quartiles", pattern), x, ["share"], stratum="_quartiles")
    return ols.fit(
        sample, {"dl": Spec("share", x)}, min_rows,
        members=lambda p: [f"{n}|{q}" for n, q in zip(names, p.split("|")) if q != "-"],
    )


def by_quintile(df: DataFrame, min_total: int = fv.MIN_TOTAL, min_rows: int = fv.MIN_ROWS) -> list[Fit]:
    """One fit per signal quintile; edges over the sample's rows."""
    rows = panels.complete_share(df, min_total).where(F.col("signal_z").isNotNull())
    marked = quantiles.add_quintile(rows).where(F.col("unit").isNotNull())
    x = (*lag_names(), *HOLIDAY)
    sample = model_sample(
        marked.where(features.any_known(lag_names())), x, ["share"], stratum="quintile"
    )
    return ols.fit(sample, {"dl": Spec("share", x)}, min_rows)


def strata_table(spark: SparkSession, fits: Sequence[Fit], term: str = "z_lag7") -> DataFrame:
    rows = [
        (f.stratum, f.n_obs, f.r_squared, *term_row(f.stratum, f, term)[1:])
        for f in fits
        if not f.skipped
    ]
    return spark.createDataFrame(
        rows,
        "stratum string, n_obs bigint, r_squared double, lag7_coef double, lag7_se double, "
        "lag7_ci_low double, lag7_ci_hi double",
    )


def attribute_regressor(df: DataFrame, name: str, min_total: int = fv.MIN_TOTAL) -> list[Fit]:
    """An attribute with lags, as a control (the same design), and alone."""
    lags = lag_names()
    x = (name, *lags, *HOLIDAY)
    rows = lag_rows(df, min_total)
    # The model without lags keeps rows whose lags are incomplete.
    rows = filled(rows.withColumn("_known", known_bits(lags)), lags)
    sample = model_sample(rows, x, ["share"], stratum="_known")
    return ols.fit(
        sample,
        {
            "independent": Spec("share", x, stratum="with lags"),
            "control": Spec("share", (*lags, name, *HOLIDAY), stratum="with lags"),
            "alone": Spec("share", (name, *HOLIDAY), stratum="alone"),
        },
        members=lambda bits: ["alone"] if "0" in bits else ["alone", "with lags"],
    )


def top_quintile_interactions(
    df: DataFrame, names: Sequence[str], min_total: int = fv.MIN_TOTAL
) -> Fit:
    """Top signal quintile, attributes, and their products, next to all lags."""
    rows = panels.complete_share(df, min_total).where(F.col("signal_z").isNotNull())
    marked = quantiles.add_quintile(rows).where(F.col("unit").isNotNull())
    top = (F.col("quintile") == fv.QUINTILE_LABELS[-1]).cast("int")
    marked = marked.withColumn("top_quintile", top)
    products = features.interaction_columns(["top_quintile"], list(names))
    marked = marked.withColumns(products).where(features.any_known(lag_names()))
    x = (*lag_names(), "top_quintile", *names, *products, *HOLIDAY)
    return ols.fit(model_sample(marked, x, ["share"]), {"top": Spec("share", x)})[0]


def top_quintile_table(spark: SparkSession, f: Fit) -> DataFrame:
    prefix = "top_quintile_x_"
    rows = [term_row(t.removeprefix(prefix), f, t) for t in f.spec.x if t.startswith(prefix)]
    return spark.createDataFrame(
        rows,
        "demographic string, interaction_coef double, interaction_se double, "
        "ci_low double, ci_hi double",
    )


# -- thresholds --------------------------------------------------------------


def threshold_lags(
    df: DataFrame, thresholds=fv.THRESHOLDS, lags=fv.THRESHOLD_LAGS,
    min_total: int = fv.MIN_TOTAL, min_rows: int = fv.MIN_ROWS,
) -> list[Fit]:
    """Lags of a threshold flag, one stratum per threshold.

    Lags count rows of the filtered sample.
    """
    flagged = features.by_unit(features.add_threshold_flags(base_rows(df, min_total), thresholds))
    lagged = features.add_threshold_lags(flagged, thresholds, lags)
    variants = {
        str(float(t)): {
            f"high_lag{k}": F.col(f"{features.threshold_name(t)}_lag{k}") for k in lags
        }
        for t in thresholds
    }
    x = (*(f"high_lag{k}" for k in lags), *HOLIDAY)
    rows = spread(lagged, variants, ["unit", "day", "dow", "share", *HOLIDAY])
    sample = settle(model_sample(rows, x, ["share"], stratum="stratum"), "sample")
    return ols.fit(sample, {"threshold": Spec("share", x)}, min_rows)


def threshold_table(spark: SparkSession, fits: Sequence[Fit], lags=fv.THRESHOLD_LAGS) -> DataFrame:
    rows = []
    for f in fits:
        if f.skipped:
            continue
        for k in lags:
            _, b, se, low, high = term_row("", f, f"high_lag{k}")
            rows.append((float(f.stratum), k, b, se, low, high, b / se if se else None))
    return spark.createDataFrame(
        rows,
        "threshold double, lag int, coefficient double, se double, ci_low double, "
        "ci_hi double, t_stat double",
    )


def threshold_vs_continuous(
    spark: SparkSession, threshold_fits: Sequence[Fit], continuous: Fit, lag: int = 7
) -> DataFrame:
    rows = [(f"{f.stratum} sd", f.coef(f"high_lag{lag}"), f.se(f"high_lag{lag}")) for f in threshold_fits if not f.skipped]
    rows.append(("continuous", continuous.coef(f"z_lag{lag}"), continuous.se(f"z_lag{lag}")))
    return spark.createDataFrame(rows, "model string, coefficient double, se double")


# -- difference in differences ----------------------------------------------

DID_X = ("treated", "post", "treated_post")
DID_MODELS = {
    ("threshold", "share"): "Simple 2x2 DID",
    ("threshold", "share_dm"): "DID with de-meaned outcome (threshold)",
    ("quintile", "share"): "DID with quantile-based treatment",
    ("quintile", "share_dm"): "DID with de-meaned outcome + quantile treatment",
}


def did_rows(
    df: DataFrame,
    period: tuple[str, str] | None = None,
    threshold: float = fv.EVENT_THRESHOLD,
    min_total: int | None = None,
    quintile: bool = True,
    demeaned: bool = True,
) -> DataFrame:
    """Rows with both treatments, event times and the demeaned outcome."""
    if period:
        df = df.where(calendar.in_period(F.col("day"), *period))
    if demeaned:
        df = settle(features.demean(features.by_unit(df)), "demeaned")
    treated = features.above(threshold)
    if quintile:
        df = df.where(F.col("signal_z").isNotNull())
        edges = quantiles.quantile_edges(df, "signal_z", len(fv.QUINTILE_LABELS))
        label = quantiles.bucket(F.col("signal_z"), edges, fv.QUINTILE_LABELS)
        df = df.withColumn("quintile", label)
    timed = events.attach_event_time(
        df.withColumn("treated", treated), events.event_days(df, treated == 1)
    )
    if quintile:
        top = (F.col("quintile") == fv.QUINTILE_LABELS[-1]).cast("int")
        timed = events.attach_event_time(
            timed.withColumn("treated_q", top), events.event_days(df, top == 1), suffix="_q"
        )
    timed = timed.where(F.col("unit").isNotNull())
    if min_total is not None:
        timed = panels.complete_share(timed, min_total)
    return timed


def did(df: DataFrame, period=None, threshold: float = fv.EVENT_THRESHOLD, min_rows: int = fv.MIN_ROWS) -> list[Fit]:
    """Two treatments x two outcomes: two strata, two specs, one fit."""
    rows = did_rows(df, period, threshold)
    c = F.col
    variants = {
        "threshold": {
            "treated": c("treated"), "post": c("post"),
            "treated_post": c("treated") * c("post"), "_time": c("event_time"),
        },
        "quintile": {
            "treated": c("treated_q"), "post": c("post_q"),
            "treated_post": c("treated_q") * c("post_q"), "_time": c("event_time_q"),
        },
    }
    keep = ["unit", "day", "dow", "share", "share_dm", *HOLIDAY]
    windows = spread(rows.select(*keep, "treated", "post", "event_time", "treated_q", "post_q", "event_time_q"), variants, keep).where("_time is not null")
    x = (*DID_X, *HOLIDAY)
    sample = settle(model_sample(windows, x, ["share", "share_dm"], stratum="stratum"), "sample")
    return ols.fit(sample, {y: Spec(y, x) for y in ("share", "share_dm")}, min_rows)


def did_table(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    order = list(DID_MODELS)
    rows = []
    for f in sorted(fits, key=lambda f: order.index((f.stratum, f.model))):
        if f.skipped:
            continue
        name = DID_MODELS[f.stratum, f.model]
        rows.append((*term_row(name, f, "treated_post"), f.n_obs, f.r_squared))
    return spark.createDataFrame(
        rows,
        "model string, coefficient double, se double, ci_low double, ci_hi double, "
        "n_obs bigint, r_squared double",
    )


def event_study(
    df: DataFrame, period=None, threshold: float = fv.EVENT_THRESHOLD,
    reach: int = fv.EVENT_TIME_REACH, min_total: int | None = None, need_signal: bool = True,
) -> Fit:
    """Treated rows by days from the event, day -1 as reference.

    A treated day is an event itself, so offsets above 0 never occur on treated
    rows; those terms come out as not identified.
    """
    if need_signal:
        df = df.where(F.col("signal_z").isNotNull())
    rows = did_rows(df, period, threshold, min_total, quintile=False, demeaned=False)
    dummies = events.offset_dummies(reach)
    rows = rows.where(F.col("event_time").isNotNull()).withColumns(dummies)
    x = (*dummies, *HOLIDAY)
    sample = settle(model_sample(rows, x, ["share"]), "sample")
    return ols.fit(sample, {"event study": Spec("share", x)})[0]


def _offset(term: str) -> int:
    text = term.rsplit("_", 1)[1]
    return -int(text[1:]) if text.startswith("m") else int(text)


def event_study_table(spark: SparkSession, f: Fit) -> DataFrame:
    rows = [
        (*term_row(_offset(t), f, t), f.coef(t) is not None)
        for t in f.spec.x
        if t.startswith("event_time_")
    ]
    return spark.createDataFrame(
        rows,
        "event_time int, coefficient double, se double, ci_low double, ci_hi double, "
        "identified boolean",
    )


def approach_table(spark: SparkSession, lag_fit: Fit, study: Fit, lags=fv.MODEL_LAGS) -> DataFrame:
    rows = [("Distributed Lag", *term_row(k, lag_fit, f"z_lag{k}")) for k in lags]
    rows += [
        ("Threshold (DID)", *term_row(_offset(t), study, t))
        for t in study.spec.x
        if t.startswith("event_time_")
    ]
    return spark.createDataFrame(
        rows,
        "approach string, time_period int, coefficient double, se double, ci_low double, ci_hi double",
    )


# -- demeaned outcome --------------------------------------------------------


def demeaned_pair(df: DataFrame, min_total: int = fv.MIN_TOTAL) -> tuple[Fit, Fit]:
    """(baseline, demeaned): two outcomes of the same cross-products."""
    rows = features.demean(features.by_unit(panels.complete_share(df, min_total)))
    x = (*lag_names(), *HOLIDAY)
    rows = rows.where(features.any_known(lag_names()) & F.col("unit").isNotNull())
    fits = ols.fit(
        settle(model_sample(rows, x, ["share", "share_dm"]), "sample"),
        {"baseline": Spec("share", x), "demeaned": Spec("share_dm", x)},
    )
    return fits[0], fits[1]


def demeaned_table(spark: SparkSession, base: Fit, dem: Fit, lags=fv.COMPARISON_LAGS) -> DataFrame:
    rows = []
    for k in lags:
        t = f"z_lag{k}"
        b0, b1 = base.coef(t), dem.coef(t)
        if b0 is None or b1 is None:
            continue
        change = (b1 - b0) / abs(b0) * 100 if b0 != 0 else None
        rows.append((k, b0, base.se(t), b1, dem.se(t), b1 - b0, change))
    return spark.createDataFrame(
        rows,
        "lag int, baseline_coef double, baseline_se double, demeaned_coef double, "
        "demeaned_se double, difference double, pct_change double",
    )


# -- leads -------------------------------------------------------------------


def lead_rows(df: DataFrame, steps=fv.LEAD_STEPS, min_total: int = fv.MIN_TOTAL) -> DataFrame:
    rows = features.by_unit(panels.complete_share(df, min_total))
    led = features.add_leads(rows, "share", steps)
    ahead = features.any_known([f"next_{k}" for k in steps])
    return led.where(F.col("signal_z").isNotNull() & ahead & F.col("unit").isNotNull())


def leads(df: DataFrame, steps=fv.LEAD_STEPS, min_total: int = fv.MIN_TOTAL, min_rows: int = fv.MIN_ROWS) -> list[Fit]:
    """Outcome k rows ahead on today's signal: one stratum per k, own sample."""
    names = [f"next_{k}" for k in steps]
    rows = lead_rows(df, steps, min_total).withColumn("_known", known_bits(names))
    x = ("signal_z", *HOLIDAY)
    sample = settle(model_sample(filled(rows, names), x, names, stratum="_known"), "sample")
    labels = [str(k) for k in steps]
    return ols.fit(
        sample, {f"lead {k}": Spec(f"next_{k}", x, stratum=k) for k in labels}, min_rows,
        members=lambda bits: [k for k, bit in zip(labels, bits) if bit == "1"],
    )


def lead_table(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    rows = [
        (int(f.stratum), f.n_obs, f.r_squared, *term_row("", f, "signal_z")[1:])
        for f in fits
        if not f.skipped
    ]
    return spark.createDataFrame(
        rows,
        "forward_lag int, n_obs bigint, r_squared double, awareness_coef double, "
        "awareness_se double, ci_low double, ci_hi double",
    )


def backward(df: DataFrame, lags=fv.BACKWARD_LAGS, min_total: int = fv.MIN_TOTAL) -> Fit:
    """Lag model on the sample of the lead models."""
    x = (*lag_names(lags), *HOLIDAY)
    rows = lead_rows(df, min_total=min_total).where(features.any_known(lag_names(lags)))
    sample = settle(model_sample(rows, x, ["share"]), "sample")
    return ols.fit(sample, {"backward": Spec("share", x)})[0]


# -- several effects ---------------------------------------------------------


def top_days(df: DataFrame, min_rows: int = 20, limit: int | None = None) -> DataFrame:
    """Days with at least ``min_rows`` rows, the fullest first, ties by date.

    ``limit`` keeps so many of them; by default all stay.
    """
    ranked = (
        df.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_rows)
        .orderBy(F.desc("n"), "day")
    )
    return ranked if limit is None else ranked.limit(limit)


def keep_days(df: DataFrame, days: DataFrame) -> DataFrame:
    return df.join(days.select("day"), "day", "left_semi")


def unit_and_day(df: DataFrame, min_total: int = fv.MIN_TOTAL, days: DataFrame | None = None) -> Fit:
    """Unit and day effects, both absorbed; the day subset is optional.

    Weekday, month x year and holiday are functions of the day and vanish; the
    parameter count is that of the design with all dummies.
    """
    rows = lag_rows(df, min_total)
    if days is not None:
        rows = keep_days(rows, days)
    x = lag_names()
    columns = [*x, "share"]
    sample = rows.select(
        F.lit("all").alias("stratum"), F.col("unit").cast("string").alias("unit"), "day",
        *[F.col(c).cast("double").alias(c) for c in columns],
    ).dropna()
    sample = settle(sample, "two-way")
    # One row per day first: distinct calendar parts then come from few rows.
    days = sample.groupBy("day").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("share").alias("s"),
        F.sum(F.col("share") * F.col("share")).alias("ss"),
        *[F.sum(F.col(c) * F.col(c)).alias(f"sq_{c}") for c in x],
    )
    facts = days.agg(
        F.sum("n").alias("n"),
        (F.sum("ss") - F.sum("s") * F.sum("s") / F.sum("n")).alias("tss"),
        F.count("day").alias("days"),
        F.size(F.collect_set(F.weekday("day"))).alias("dows"),
        F.size(F.collect_set(F.month("day"))).alias("months"),
        F.size(F.collect_set(F.year("day"))).alias("years"),
        *[F.sum(f"sq_{c}").alias(f"sq_{c}") for c in x],
    ).first()
    n_units = sample.select("unit").distinct().count()
    demeaned = absorb.demean_two_way(sample, columns)
    absorbed = (
        facts["dows"] - 1 + facts["months"] * facts["years"] - 1 + 1
        + n_units - 1 + facts["days"] - 1
    )
    f = ols.fit(
        demeaned, {"unit and day": Spec("share", x, (), False)},
        scale={c: facts[f"sq_{c}"] for c in x}, absorbed_params=absorbed,
    )[0]
    return _of_total(f, demeaned, facts["tss"])


def _of_total(f: Fit, demeaned: DataFrame, tss: float) -> Fit:
    """R-squared relative to the outcome itself, not to what the effects leave of it."""
    if f.r_squared is not None:
        left = demeaned.agg(F.sum(F.col("share") * F.col("share"))).first()[0]
        f.r_squared = 1.0 - (1.0 - f.r_squared) * left / tss
    return f


def unit_and_week(df: DataFrame, min_total: int = fv.MIN_TOTAL) -> Fit:
    """Unit and ISO week effects next to the usual controls.

    Weeks are a control like weekdays and months.  A row adds to its levels only
    (:mod:`moments`), so hundreds of weeks cost no wider rows and no demeaned copy.
    """
    week = F.extract(F.lit("YEAROFWEEK"), F.col("day")) * 100 + F.weekofyear("day")
    x = (*lag_names(), *HOLIDAY)
    rows = lag_rows(df, min_total).withColumn("week", week)
    sample = settle(model_sample(rows, x, ["share"], (*CONTROLS, "week")), "unit-week")
    return ols.fit(sample, {"unit and week": Spec("share", x, (*CONTROLS, "week"))})[0]


def effects_table(spark: SparkSession, fits: dict[str, Fit], lags=fv.COMPARISON_LAGS) -> DataFrame:
    rows = [
        (name, k, f.coef(f"z_lag{k}"), f.se(f"z_lag{k}"), f.n_obs, f.r_squared)
        for name, f in fits.items()
        for k in lags
    ]
    return spark.createDataFrame(
        rows, "model string, lag int, coef double, se double, n_obs bigint, r_squared double"
    )


#: Attribute and quartile of the strata that the findings name, by their place among the attributes.
FINDING_STRATA = ((1, "Q1"), (0, "Q4"))


def strata_findings(
    fits: Sequence[Fit], names: Sequence[str], chosen: Sequence[tuple[int, str]] = FINDING_STRATA, term: str = "z_lag7"
) -> list[tuple[str, float, float]]:
    """Entries for the findings table: one stratum of one attribute each."""
    by = {f.stratum: f for f in fits if not f.skipped}
    out = []
    for at, quartile in chosen:
        f = by.get(f"{names[at]}|{quartile}")
        if f is not None:  # a stratum that was too small has no finding
            out.append((f"Heterogeneous: {names[at]} {quartile}", f.coef(term), f.se(term)))
    return out


def findings(spark: SparkSession, entries: Sequence[tuple[str, float, float]]) -> DataFrame:
    """(finding, coefficient, se) with interval and a significance flag."""
    df = spark.createDataFrame(list(entries), "Finding string, Coefficient double, SE double")
    b, se = F.col("Coefficient"), F.col("SE")
    return df.withColumns(
        {
            "CI_Low": inference.ci_low(b, se),
            "CI_Hi": inference.ci_high(b, se),
            "Significant": inference.significant(b, se),
        }
    )
