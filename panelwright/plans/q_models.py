"""M1-M33 estimation.

Each SQL check fits the model independently: explicit dummies for all effects and
elimination in a recursive query (see ``base.ols_sql``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright import fixed_values as fv
from panelwright.functions import calendar
from panelwright.models import counts, families as fam, ols
from panelwright.models.ols import CONTROLS, Spec
from panelwright.operators import events, features, panel as panels, quantiles
from panelwright.plans.base import (
    ATTR, ATTRS, MIN_TOTAL, SHIPF, bucket_sql, counts_sql, lag_x, ols_sql, query, ship_features,
    ship_features_attrs, ship_panel, table, tag_sum_sql,
)
from panelwright.plans.q_windows import THRESHOLD_LAGS
from panelwright.session import settle

X = [*lag_x(), "is_holiday"]
TIDY = "term:s coef:f8 se:f8 n_obs:i n_units:i n_params:i r_squared:f8"
BASE = f"total >= {MIN_TOTAL} AND share IS NOT NULL AND unit IS NOT NULL"


def fit_sql(x, columns="*, share AS y", where=BASE, source="f", before=SHIPF, tag="o", smp="smp", stratum="'all'", **how):
    """CTEs for one sample and its fit."""
    return (
        f"{before}{',' if before else ''} {smp} AS (SELECT {stratum} AS stratum, {columns} FROM {source} WHERE {where}), "
        + ols_sql(x, sample=smp, tag=tag, **how)
    )


def ci(b="coef", se="se", names=("ci_low", "ci_hi")):
    return f"{b} - 1.96 * {se} AS {names[0]}, {b} + 1.96 * {se} AS {names[1]}"


DL = fit_sql(X)


def dl(spark, sf, **how):
    return fam.distributed_lag(ship_features(spark, sf), min_total=MIN_TOTAL, **how)


@query("M1_unit_effects_ols", TIDY, f"WITH RECURSIVE {fit_sql(['z_lag0', 'is_holiday'])} SELECT * FROM o_est")
def m1(spark, sf):
    x = ("z_lag0", "is_holiday")
    rows = fam.base_rows(ship_features(spark, sf), MIN_TOTAL)
    return ols.tidy(spark, ols.fit(ols.model_sample(rows, x, ["share"]), {"m": Spec("share", x)}))


@query("M2_distributed_lag", TIDY, f"WITH RECURSIVE {DL} SELECT * FROM o_est")
def m2(spark, sf):
    return ols.tidy(spark, [dl(spark, sf)])


@query(
    "M3_placebo_outcome", TIDY,
    f"WITH RECURSIVE {fit_sql(X, '*, total / 100.0::DOUBLE AS y')} SELECT * FROM o_est",
)
def m3(spark, sf):
    return ols.tidy(spark, [fam.placebo(ship_features(spark, sf), min_total=MIN_TOTAL)])


_USED = (0, 1, 2, 3, 7)


@query(
    "M4_cumulative_effect", "model:s lags_used:s cumulative_coef:f8 cumulative_se:f8 ci_low:f8 ci_hi:f8",
    f"WITH RECURSIVE {DL}, c AS ({tag_sum_sql('o', _USED)}) SELECT 'baseline' AS model, '0,1,2,3,7' AS lags_used, b AS cumulative_coef, se AS cumulative_se, {ci('b')} FROM c",
)
def m4(spark, sf):
    return fam.cumulative(spark, {"baseline": dl(spark, sf)})


@query(
    "M5_scaled_cumulative", "mean_total:f8 effect:f8 half_width:f8",
    f"WITH RECURSIVE {DL}, c AS ({tag_sum_sql('o', _USED)}) SELECT m AS mean_total, b * m AS effect, 1.96 * se * m AS half_width FROM c, (SELECT avg(total) AS m FROM ship) q",
)
def m5(spark, sf):
    f = ship_features(spark, sf)
    return fam.scaled_cumulative(f, fam.distributed_lag(f, min_total=MIN_TOTAL))


LAG_OF = "CAST(substr(term, 6) AS INTEGER)"


@query(
    "M6_impulse_response", "lag:i coef:f8 se:f8 ci_lo:f8 ci_hi:f8",
    f"WITH RECURSIVE {DL} SELECT {LAG_OF} AS lag, coef, se, {ci(names=('ci_lo', 'ci_hi'))} FROM o_est WHERE term LIKE 'z_lag%'",
)
def m6(spark, sf):
    return fam.impulse_response(spark, dl(spark, sf)).orderBy("lag")


NAMES = list(fam.nested_specs())
_NEST = [
    ("n1", lag_x(), (), False), ("n2", lag_x(), ("dow",), False), ("n3", lag_x(), CONTROLS, False),
    ("n4", X, CONTROLS, False), ("n5", X, CONTROLS, True),
]
NESTED = f"{SHIPF}, smp AS (SELECT 'all' AS stratum, *, share AS y FROM f WHERE {BASE}), " + ", ".join(
    ols_sql(x, cats=cats, fe=fe, tag=tag) for tag, x, cats, fe in _NEST
)


@query(
    "M7_nested_models", "model:s term:s coef:f8 se:f8",
    f"WITH RECURSIVE {NESTED} " + " UNION ALL ".join(f"SELECT '{n}' AS model, term, coef, se FROM {t[0]}_est" for n, t in zip(NAMES, _NEST)),
)
def m7(spark, sf):
    return ols.tidy(spark, fam.nested(ship_features(spark, sf), MIN_TOTAL))


FA = f"{SHIPF},{ATTR}, fa AS (SELECT f.*, {', '.join('a.' + a for a in ATTRS)} FROM f LEFT JOIN attr a ON f.unit = a.unit)"


@query(
    "M8_add_attributes", "model:s term:s coef:f8 se:f8 identified:i n_obs:i n_params:i",
    f"""WITH RECURSIVE {FA}, {fit_sql(X, before='', source='fa')},
        v AS (SELECT unnest(['+ pct_automobile', '+ pct_building', '+ pct_furniture', '+ pct_machinery', '+ all attributes']) AS model, unnest([1, 1, 1, 1, 4]) AS extra)
        SELECT model, term, coef, se * sqrt((n_obs - n_params)::DOUBLE / (n_obs - n_params - extra)) AS se, 1 AS identified, n_obs, n_params + extra AS n_params FROM o_est, v
        UNION ALL SELECT '+ ' || a, a, NULL, NULL, 0, n, k + 1 FROM o_f, (SELECT unnest({list(ATTRS)}) AS a) q
        UNION ALL SELECT '+ all attributes', a, NULL, NULL, 0, n, k + 4 FROM o_f, (SELECT unnest({list(ATTRS)}) AS a) q""",
)
def m8(spark, sf):
    fits = fam.with_attributes(ship_features_attrs(spark, sf), ATTRS, MIN_TOTAL)
    return ols.tidy(spark, fits).withColumn("identified", F.col("identified").cast("int"))


@query(
    "M9_model_comparison", "model:s n_obs:i r_squared:f8 n_params:i",
    f"WITH RECURSIVE {NESTED} " + " UNION ALL ".join(f"SELECT DISTINCT '{n}' AS model, n_obs, r_squared, n_params FROM {t[0]}_est" for n, t in zip(NAMES, _NEST)),
)
def m9(spark, sf):
    return fam.comparison(spark, fam.nested(ship_features(spark, sf), MIN_TOTAL))


@query(
    "M9_lag7_comparison", "model:s lag7_coef:f8 lag7_se:f8 lag7_ci_low:f8 lag7_ci_hi:f8",
    f"WITH RECURSIVE {NESTED} " + " UNION ALL ".join(
        f"SELECT '{n}' AS model, coef AS lag7_coef, se AS lag7_se, {ci(names=('lag7_ci_low', 'lag7_ci_hi'))} FROM {t[0]}_est WHERE term = 'z_lag7'"
        for n, t in zip(NAMES, _NEST)
    ),
)
def m9b(spark, sf):
    return fam.lag7_comparison(spark, fam.nested(ship_features(spark, sf), MIN_TOTAL))


_INT = [f"z_lag{k}_x_{a}" for k in fv.INTERACTION_LAGS for a in ATTRS]
INTER = fit_sql(
    [*lag_x(), *_INT, "is_holiday"], before=FA, source="fa",
    columns="*, share AS y, " + ", ".join(f"z_lag{k} * {a} AS z_lag{k}_x_{a}" for k in fv.INTERACTION_LAGS for a in ATTRS),
)


@query(
    "M10_interactions", "lag:i demographic:s coefficient:f8 se:f8 t_stat:f5 p_value:f5",
    f"""WITH RECURSIVE {INTER} SELECT *, CASE WHEN abs(t_stat) > 6 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80),
          lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * pow(abs(t_stat) / sqrt(2), 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))) END AS p_value
        FROM (SELECT CAST(regexp_extract(term, 'lag([0-9]+)_x_', 1) AS INTEGER) AS lag, regexp_extract(term, '_x_(.+)$', 1) AS demographic,
          coef AS coefficient, se, coef / se AS t_stat FROM o_est WHERE term LIKE '%\\_x\\_%' ESCAPE '\\') q""",
)
def m10(spark, sf):
    f = fam.interactions(ship_features_attrs(spark, sf), ATTRS, min_total=MIN_TOTAL)
    return fam.interaction_table(spark, f).orderBy("demographic", "lag")


STRATA = f"""{FA}, st AS ({' UNION ALL '.join(f"SELECT *, '{a}|' || {bucket_sql(a, 'fa', fv.QUARTILE_LABELS)} AS sk, share AS y FROM fa WHERE {BASE}" for a in ATTRS)})"""
STRAT_OUT = "stratum:s n_obs:i r_squared:f8 lag7_coef:f8 lag7_se:f8 lag7_ci_low:f8 lag7_ci_hi:f8"
LAG7 = f"SELECT stratum, n_obs, r_squared, coef AS lag7_coef, se AS lag7_se, {ci(names=('lag7_ci_low', 'lag7_ci_hi'))} FROM o_est WHERE term = 'z_lag7' AND n_obs >= 100"


@query(
    "M11_stratified_by_quartile", STRAT_OUT,
    f"WITH RECURSIVE {fit_sql(X, columns='*', before=STRATA, source='st', where='true', stratum='sk')} {LAG7}",
)
def m11(spark, sf):
    return fam.strata_table(spark, fam.stratified(ship_features_attrs(spark, sf), ATTRS, MIN_TOTAL))


@query(
    "M12_attribute_regressor", "model:s term:s coef:f8 se:f8 identified:i",
    f"""WITH RECURSIVE {fit_sql(X, where=BASE + ' AND z_lag28 IS NOT NULL')}, {ols_sql(['is_holiday'], sample='alone', tag='a').join([
        "alone AS (SELECT 'all' AS stratum, *, share AS y FROM f WHERE " + BASE + " AND coalesce(" + ', '.join(lag_x()) + ") IS NOT NULL), ", ""])}
        SELECT m AS model, term, coef, se * sqrt((n_obs - n_params)::DOUBLE / (n_obs - n_params - 1)) AS se, 1 AS identified FROM o_est, (SELECT unnest(['independent', 'control']) AS m) q
        UNION ALL SELECT 'alone', term, coef, se * sqrt((n_obs - n_params)::DOUBLE / (n_obs - n_params - 1)), 1 FROM a_est
        UNION ALL SELECT unnest(['independent', 'control', 'alone']), 'pct_building', NULL, NULL, 0""",
)
def m12(spark, sf):
    fits = fam.attribute_regressor(ship_features_attrs(spark, sf), "pct_building", MIN_TOTAL)
    return ols.tidy(spark, fits).withColumn("identified", F.col("identified").cast("int"))


_HX = [*(f"high_lag{k}" for k in fv.THRESHOLD_LAGS), "is_holiday"]
THRESH = fit_sql(
    _HX, columns="*", before=f"{SHIPF}, {THRESHOLD_LAGS}, ts AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS sk, unit, share AS y, dow, month_year, is_holiday, "
        + ", ".join(f"{features.threshold_name(t)}_lag{k} AS high_lag{k}" for k in fv.THRESHOLD_LAGS) + " FROM tl"
        for t in fv.THRESHOLDS
    ) + ")", source="ts", where="true", stratum="sk",
)


@query(
    "M13_threshold_lags", "threshold:f2 lag:i coefficient:f8 se:f8 ci_low:f8 ci_hi:f8 t_stat:f5",
    f"WITH RECURSIVE {THRESH} SELECT CAST(stratum AS DOUBLE) AS threshold, CAST(substr(term, 9) AS INTEGER) AS lag, coef AS coefficient, se, {ci()}, coef / se AS t_stat FROM o_est WHERE term LIKE 'high_lag%'",
)
def m13(spark, sf):
    return fam.threshold_table(spark, fam.threshold_lags(ship_features(spark, sf), min_total=MIN_TOTAL))


@query(
    "M14_threshold_vs_continuous", "model:s coefficient:f8 se:f8",
    f"""WITH RECURSIVE {THRESH}, smc AS (SELECT 'all' AS stratum, *, share AS y FROM f WHERE {BASE}), {ols_sql(X, sample='smc', tag='c')}
        SELECT stratum || ' sd' AS model, coef AS coefficient, se FROM o_est WHERE term = 'high_lag7'
        UNION ALL SELECT 'continuous', coef, se FROM c_est WHERE term = 'z_lag7'""",
)
def m14(spark, sf):
    f = ship_features(spark, sf)
    return fam.threshold_vs_continuous(
        spark, fam.threshold_lags(f, min_total=MIN_TOTAL), fam.distributed_lag(f, min_total=MIN_TOTAL)
    )


# -- difference in differences ----------------------------------------------

PERIOD = ("1996-01-01", "2000-12-31")


def event_time_sql(name: str, source: str, flag: str) -> str:
    return f"""
{name}_e AS (SELECT DISTINCT day AS event_day FROM {source} WHERE {flag} = 1),
{name} AS (SELECT d.day, date_diff('day', max(event_day), d.day) AS event_time FROM (SELECT DISTINCT day FROM {source}) d
  JOIN {name}_e ON abs(date_diff('day', event_day, d.day)) <= 14 GROUP BY 1)"""


DID_BASE = f"""{SHIPF},
  dp AS (SELECT *, share - avg(share) OVER (PARTITION BY unit, dow) AS share_dm FROM f WHERE day BETWEEN DATE '{PERIOD[0]}' AND DATE '{PERIOD[1]}'),
  dz AS (SELECT *, CASE WHEN signal_z > 1.5 THEN 1 ELSE 0 END AS t1, {bucket_sql('signal_z', 'dq', fv.QUINTILE_LABELS)} AS quintile FROM dp, (SELECT 1) one WHERE signal_z IS NOT NULL)""".replace(
    "FROM dq WHERE true", "FROM dp WHERE signal_z IS NOT NULL"
) + ", dt AS (SELECT *, CASE WHEN quintile = '80-100' THEN 1 ELSE 0 END AS t2 FROM dz)," + event_time_sql("e1", "dt", "t1") + "," + event_time_sql("e2", "dt", "t2")

DID_ROWS = DID_BASE + ", dd AS (" + " UNION ALL ".join(
    f"""SELECT '{name}' AS sk, dt.*, e.event_time, {t} AS treated, CASE WHEN e.event_time >= 0 THEN 1 ELSE 0 END AS post,
          {t} * CASE WHEN e.event_time >= 0 THEN 1 ELSE 0 END AS treated_post FROM dt JOIN {e} e ON dt.day = e.day WHERE unit IS NOT NULL"""
    for name, t, e in (("threshold", "t1", "e1"), ("quintile", "t2", "e2"))
) + ")"
_DX = [*fam.DID_X, "is_holiday"]
DID = (
    DID_ROWS + ", sd AS (SELECT sk AS stratum, *, share AS y FROM dd), " + ols_sql(_DX, sample="sd", tag="o")
    + ", sm AS (SELECT sk AS stratum, *, share_dm AS y FROM dd), " + ols_sql(_DX, sample="sm", tag="d")
)
DID_OUT = "model:s coefficient:f8 se:f8 ci_low:f8 ci_hi:f8 n_obs:i r_squared:f8"


def did_sql(*keys):
    parts = [
        f"SELECT '{fam.DID_MODELS[k]}' AS model, coef AS coefficient, se, {ci()}, n_obs, r_squared FROM {'o' if k[1] == 'share' else 'd'}_est WHERE stratum = '{k[0]}' AND term = 'treated_post'"
        for k in keys
    ]
    return f"WITH RECURSIVE {DID} " + " UNION ALL ".join(parts)


def did_fits(spark, sf, *keys):
    fits = fam.did(ship_features(spark, sf), PERIOD)
    return fam.did_table(spark, [f for f in fits if (f.stratum, f.model) in keys])


@query("M15_did", DID_OUT, did_sql(("threshold", "share")))
def m15(spark, sf):
    return did_fits(spark, sf, ("threshold", "share"))


STUDY_X = [*(events.offset_name(t) for t in range(-14, 15) if t != -1), "is_holiday"]
STUDY_ROWS = DID_BASE + ", es AS (SELECT dt.*, e1.event_time, " + ", ".join(
    f"CASE WHEN t1 = 1 AND event_time = {t} THEN 1 ELSE 0 END AS {events.offset_name(t)}" for t in range(-14, 15) if t != -1
) + " FROM dt JOIN e1 ON dt.day = e1.day WHERE unit IS NOT NULL)"
STUDY = STUDY_ROWS + ", se AS (SELECT 'all' AS stratum, *, share AS y FROM es), " + ols_sql(STUDY_X, sample="se", tag="o")
ALL_OFFSETS = "SELECT unnest(range(-14, 15)) AS t"
OFFSET_NAME = "CASE WHEN t < 0 THEN 'event_time_m' || -t ELSE 'event_time_' || t END"


@query(
    "M16_event_study", "event_time:i coefficient:f8 se:f8 ci_low:f8 ci_hi:f8 identified:i",
    f"WITH RECURSIVE {STUDY} SELECT t AS event_time, coef AS coefficient, se, {ci()}, CASE WHEN coef IS NULL THEN 0 ELSE 1 END AS identified FROM ({ALL_OFFSETS}) q LEFT JOIN o_est ON term = {OFFSET_NAME} WHERE t <> -1",
)
def m16(spark, sf):
    f = fam.event_study(ship_features(spark, sf), PERIOD)
    return fam.event_study_table(spark, f).withColumn("identified", F.col("identified").cast("int")).orderBy("event_time")


@query("M17_did_demeaned", DID_OUT, did_sql(("threshold", "share_dm")))
def m17(spark, sf):
    return did_fits(spark, sf, ("threshold", "share_dm"))


@query("M18_did_top_quintile", DID_OUT, did_sql(("quintile", "share")))
def m18(spark, sf):
    return did_fits(spark, sf, ("quintile", "share"))


@query("M19_did_demeaned_top_quintile", DID_OUT, did_sql(("quintile", "share_dm")))
def m19(spark, sf):
    return did_fits(spark, sf, ("quintile", "share_dm"))


IN_PERIOD = f"day BETWEEN DATE '{PERIOD[0]}' AND DATE '{PERIOD[1]}'"


@query(
    "M20_approach_comparison", "approach:s time_period:i coefficient:f8 se:f8 ci_low:f8 ci_hi:f8",
    f"""WITH RECURSIVE {SHIPF}, dt AS (SELECT *, CASE WHEN signal_z > 1.5 THEN 1 ELSE 0 END AS t1 FROM f WHERE {IN_PERIOD}), {event_time_sql('e1', 'dt', 't1')},
        es AS (SELECT dt.*, e1.event_time, {", ".join(f"CASE WHEN t1 = 1 AND event_time = {t} THEN 1 ELSE 0 END AS {events.offset_name(t)}" for t in range(-14, 15) if t != -1)}
               FROM dt JOIN e1 ON dt.day = e1.day WHERE {BASE}),
        se AS (SELECT 'all' AS stratum, *, share AS y FROM es), {ols_sql(STUDY_X, sample='se', tag='o')},
        sl AS (SELECT 'all' AS stratum, *, share AS y FROM f WHERE {BASE} AND {IN_PERIOD}), {ols_sql(X, sample='sl', tag='l')}
        SELECT 'Distributed Lag' AS approach, {LAG_OF} AS time_period, coef AS coefficient, se, {ci()} FROM l_est WHERE term LIKE 'z_lag%'
        UNION ALL SELECT 'Threshold (DID)', t, coef, se, {ci()} FROM ({ALL_OFFSETS}) q LEFT JOIN o_est ON term = {OFFSET_NAME} WHERE t <> -1""",
)
def m20(spark, sf):
    f = ship_features(spark, sf)
    inside = f.where(calendar.in_period(F.col("day"), *PERIOD))
    return fam.approach_table(
        spark,
        fam.distributed_lag(inside, min_total=MIN_TOTAL),
        fam.event_study(f, PERIOD, min_total=MIN_TOTAL, need_signal=False),
    )


# -- demeaned outcome, other outcomes and effects ----------------------------

PAIR = (
    f"{SHIPF}, dm AS (SELECT *, share - avg(share) OVER (PARTITION BY unit, dow) AS share_dm FROM f WHERE total >= {MIN_TOTAL} AND share IS NOT NULL), "
    f"s0 AS (SELECT 'all' AS stratum, *, share AS y FROM dm), {ols_sql(X, sample='s0', tag='o')}, "
    f"s1 AS (SELECT 'all' AS stratum, *, share_dm AS y FROM dm), {ols_sql(X, sample='s1', tag='d')}"
)


@query(
    "M21_demeaned_vs_baseline", "lag:i baseline_coef:f8 baseline_se:f8 demeaned_coef:f8 demeaned_se:f8 difference:f8 pct_change:f3",
    f"""WITH RECURSIVE {PAIR} SELECT CAST(substr(o.term, 6) AS INTEGER) AS lag, o.coef AS baseline_coef, o.se AS baseline_se, d.coef AS demeaned_coef, d.se AS demeaned_se,
          d.coef - o.coef AS difference, (d.coef - o.coef) / abs(o.coef) * 100 AS pct_change FROM o_est o JOIN d_est d ON o.term = d.term
        WHERE o.term IN ('z_lag0', 'z_lag1', 'z_lag7', 'z_lag14')""",
)
def m21(spark, sf):
    return fam.demeaned_table(spark, *fam.demeaned_pair(ship_features(spark, sf), MIN_TOTAL))


@query(
    "M21_demeaned_cumulative", "model:s cumulative_coef:f8 cumulative_se:f8 ci_low:f8 ci_hi:f8",
    f"WITH RECURSIVE {PAIR}, c0 AS ({tag_sum_sql('o', _USED)}), c1 AS ({tag_sum_sql('d', _USED)}) " + " UNION ALL ".join(
        f"SELECT '{n}' AS model, b AS cumulative_coef, se AS cumulative_se, {ci('b')} FROM {c}" for n, c in (("baseline", "c0"), ("demeaned", "c1"))
    ),
)
def m21b(spark, sf):
    base, dem = fam.demeaned_pair(ship_features(spark, sf), MIN_TOTAL)
    return fam.cumulative(spark, {"baseline": base, "demeaned": dem})


COUNT_X = ("log_signal_roll3", *fam.lag_names(), "is_holiday")


def count_sample(spark, sf):
    rows = fam.lag_rows(ship_features(spark, sf), MIN_TOTAL)
    return settle(ols.model_sample(rows, COUNT_X, ["hits", "share"]), "counts")


def count_table(spark, f, terms=COUNT_X):
    family = f"{f.family} (fallback)" if f.fallback else f.family
    rows = [(family, t, f.coef(t), f.se(t), f.dispersion, f.loglik, f.n_obs) for t in terms]
    return spark.createDataFrame(
        rows, "family string, term string, coef double, se double, dispersion double, loglik double, n_obs bigint"
    )


COUNTS = fit_sql(COUNT_X, columns="*, hits AS y", tag="h", smp="sh") + "," + counts_sql("h")
COUNT_OUT = "family:s term:s coef:f6 se:f6 dispersion:f6 loglik:f2 n_obs:i"


@query("M22_negative_binomial", COUNT_OUT, f"WITH RECURSIVE {COUNTS} SELECT * FROM h_count")
def m22(spark, sf):
    return count_table(spark, counts.fit_counts(count_sample(spark, sf), "hits", COUNT_X))


@query(
    "M22_overdispersed_volume", COUNT_OUT,
    f"""WITH RECURSIVE {SHIPF},
        vol AS (SELECT CAST(l_shipdate AS DATE) AS vday, CAST(s_nationkey AS BIGINT) AS vunit, sum(l_quantity) AS volume FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
        {fit_sql(COUNT_X, columns="*, volume AS y", source="f JOIN vol ON vday = day AND vunit = unit", tag="h", smp="sh", before="")}, {counts_sql("h")} SELECT * FROM h_count""",
)
def m22b(spark, sf):
    # Shipped quantities vary more than their mean, so the dispersion is estimated.
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    volume = lines.groupBy(F.col("s_nationkey").cast("bigint").alias("unit"), F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("volume"))
    rows = fam.lag_rows(ship_features(spark, sf), MIN_TOTAL).join(volume, ["unit", "day"])
    sample = settle(ols.model_sample(rows, COUNT_X, ["volume"]), "counts")
    return count_table(spark, counts.fit_counts(sample, "volume", COUNT_X))


@query("M23_poisson", COUNT_OUT, f"WITH RECURSIVE {COUNTS} SELECT * FROM h_poisson")
def m23(spark, sf):
    return count_table(spark, counts.fit_counts(count_sample(spark, sf), "hits", COUNT_X, family="poisson"))


@query(
    "M24_ols_with_log_signal", TIDY,
    f"WITH RECURSIVE {fit_sql(['log_signal_roll3', *X])} SELECT * FROM o_est",
)
def m24(spark, sf):
    f = fam.distributed_lag(ship_features(spark, sf), min_total=MIN_TOTAL, extra=("log_signal_roll3",))
    return ols.tidy(spark, [f])


def two_way_sql(tag, smp, where):
    """Unit dummies, day effects swept out; holidays vanish but count."""
    body = ols_sql(lag_x(), sample=smp, tag=tag, absorb="day", cats=("dow", "month_year"), extra_params="1")
    return f"{smp} AS (SELECT 'all' AS stratum, *, share AS y FROM f WHERE {where}), {body}"


@query(
    "M25_unit_and_day_effects", "term:s coef:f7 se:f7 n_obs:i n_params:i r_squared:f7",
    f"WITH RECURSIVE {SHIPF}, {two_way_sql('o', 'smp', BASE)} SELECT * FROM o_est",
)
def m25(spark, sf):
    return ols.tidy(spark, [fam.unit_and_day(ship_features(spark, sf), MIN_TOTAL)])


TOP_DAYS = f"day IN (SELECT day FROM (SELECT day, count(*) AS n FROM f WHERE {BASE} AND coalesce({', '.join(lag_x())}) IS NOT NULL GROUP BY 1) t WHERE n >= 5)"


@query(
    "M25_unit_and_day_effects_top_days", "term:s coef:f7 se:f7 n_obs:i n_params:i r_squared:f7",
    f"WITH RECURSIVE {SHIPF}, {two_way_sql('o', 'smp', BASE + ' AND ' + TOP_DAYS)} SELECT * FROM o_est",
)
def m25b(spark, sf):
    f = ship_features(spark, sf)
    days = fam.top_days(fam.lag_rows(f, MIN_TOTAL), 5)
    return ols.tidy(spark, [fam.unit_and_day(f, MIN_TOTAL, days)])


WEEK = fit_sql(X, columns="*, share AS y, isoyear(day) * 100 + weekofyear(day) AS week", absorb="week", tag="w", smp="sw")


@query("M26_unit_and_week_effects", TIDY, f"WITH RECURSIVE {WEEK} SELECT * FROM w_est")
def m26(spark, sf):
    return ols.tidy(spark, [fam.unit_and_week(ship_features(spark, sf), MIN_TOTAL)])


@query(
    "M27_effects_comparison", "model:s lag:i coef:f7 se:f7 n_obs:i r_squared:f7",
    f"""WITH RECURSIVE {DL}, {WEEK.removeprefix(SHIPF + ',')}, {two_way_sql('d', 'sdd', BASE)}
        """ + " UNION ALL ".join(
        f"SELECT '{n}' AS model, {LAG_OF} AS lag, coef, se, n_obs, r_squared FROM {t}_est WHERE term IN ('z_lag0', 'z_lag1', 'z_lag7', 'z_lag14')"
        for n, t in (("One-way FE (unit only)", "o"), ("Two-way FE (unit + week)", "w"), ("Two-way FE (unit + day)", "d"))
    ),
)
def m27(spark, sf):
    f = ship_features(spark, sf)
    return fam.effects_table(
        spark,
        {
            "One-way FE (unit only)": fam.distributed_lag(f, min_total=MIN_TOTAL),
            "Two-way FE (unit + week)": fam.unit_and_week(f, MIN_TOTAL),
            "Two-way FE (unit + day)": fam.unit_and_day(f, MIN_TOTAL),
        },
    )


@query(
    "M27_count_comparison", "model:s lag7_coef:f6 lag7_se:f6 n_obs:i r_squared:f7",
    f"""WITH RECURSIVE {COUNTS}, {fit_sql(["log_signal_roll3", *X], before="")}, {two_way_sql('d', 'sdd', BASE)}
        SELECT 'OLS (share)' AS model, coef AS lag7_coef, se AS lag7_se, n_obs, r_squared FROM o_est WHERE term = 'z_lag7'
        UNION ALL SELECT 'Two-way FE (share)', coef, se, n_obs, r_squared FROM d_est WHERE term = 'z_lag7'
        UNION ALL SELECT 'Negative Binomial (count)', coef, se, n_obs, NULL FROM h_count WHERE term = 'z_lag7'""",
)
def m27b(spark, sf):
    f = ship_features(spark, sf)
    linear = fam.distributed_lag(f, min_total=MIN_TOTAL, extra=("log_signal_roll3",))
    both = fam.unit_and_day(f, MIN_TOTAL)
    nb = counts.fit_counts(count_sample(spark, sf), "hits", COUNT_X)
    rows = [
        ("OLS (share)", linear.coef("z_lag7"), linear.se("z_lag7"), linear.n_obs, linear.r_squared),
        ("Two-way FE (share)", both.coef("z_lag7"), both.se("z_lag7"), both.n_obs, both.r_squared),
        ("Negative Binomial (count)", nb.coef("z_lag7"), nb.se("z_lag7"), nb.n_obs, None),
    ]
    return spark.createDataFrame(
        rows, "model string, lag7_coef double, lag7_se double, n_obs bigint, r_squared double"
    )


QROWS = f"{SHIPF}, zq AS (SELECT * FROM f WHERE total >= {MIN_TOTAL} AND share IS NOT NULL AND signal_z IS NOT NULL), q AS (SELECT *, {bucket_sql('signal_z', 'zq', fv.QUINTILE_LABELS)} AS quintile FROM zq)"


@query(
    "M28_fits_by_quintile", STRAT_OUT,
    f"WITH RECURSIVE {fit_sql(X, before=QROWS, source='q', where='unit IS NOT NULL', stratum='quintile')} {LAG7}",
)
def m28(spark, sf):
    return fam.strata_table(spark, fam.by_quintile(ship_features(spark, sf), MIN_TOTAL))


_TX = [f"top_quintile_x_{a}" for a in ATTRS]
TOPQ = fit_sql(
    [*lag_x(), "top_quintile", *_TX, "is_holiday"], extra_params="4",
    before=f"{QROWS},{ATTR}, qa AS (SELECT q.*, {', '.join('a.' + a for a in ATTRS)}, CASE WHEN quintile = '80-100' THEN 1 ELSE 0 END AS top_quintile FROM q LEFT JOIN attr a ON q.unit = a.unit WHERE q.unit IS NOT NULL)",
    source="qa", where="true", columns="*, share AS y, " + ", ".join(f"top_quintile * {a} AS top_quintile_x_{a}" for a in ATTRS),
)


@query(
    "M29_top_quintile_interactions", "demographic:s interaction_coef:f8 interaction_se:f8 ci_low:f8 ci_hi:f8",
    f"WITH RECURSIVE {TOPQ} SELECT replace(term, 'top_quintile_x_', '') AS demographic, coef AS interaction_coef, se AS interaction_se, {ci()} FROM o_est WHERE term LIKE 'top_quintile_x_%'",
)
def m29(spark, sf):
    f = fam.top_quintile_interactions(ship_features_attrs(spark, sf), ATTRS, MIN_TOTAL)
    return fam.top_quintile_table(spark, f)


LEADS = f"""{SHIPF}, ld0 AS (SELECT *, {', '.join(f'lead(share, {k}) OVER w AS next_{k}' for k in fv.LEAD_STEPS)} FROM f
    WHERE total >= {MIN_TOTAL} AND share IS NOT NULL WINDOW w AS (PARTITION BY unit ORDER BY day)),
  ld AS (SELECT * FROM ld0 WHERE unit IS NOT NULL AND signal_z IS NOT NULL AND coalesce({', '.join(f'next_{k}' for k in fv.LEAD_STEPS)}) IS NOT NULL)"""


@query(
    "M30_lead_regressions", "forward_lag:i n_obs:i r_squared:f8 awareness_coef:f8 awareness_se:f8 ci_low:f8 ci_hi:f8",
    f"WITH RECURSIVE {LEADS}, sl AS ({' UNION ALL '.join(f'SELECT {k} AS k, unit, signal_z, is_holiday, dow, month_year, next_{k} AS y FROM ld' for k in fv.LEAD_STEPS)}), "
    + fit_sql(["signal_z", "is_holiday"], before="", source="sl", where="true", columns="*", stratum="CAST(k AS VARCHAR)")
    + f" SELECT CAST(stratum AS INTEGER) AS forward_lag, n_obs, r_squared, coef AS awareness_coef, se AS awareness_se, {ci()} FROM o_est WHERE term = 'signal_z'",
)
def m30(spark, sf):
    return fam.lead_table(spark, fam.leads(ship_features(spark, sf), min_total=MIN_TOTAL)).orderBy("forward_lag")


_BX = [*lag_x(fv.BACKWARD_LAGS), "is_holiday"]


@query(
    "M31_backward_lags", TIDY,
    f"WITH RECURSIVE {fit_sql(_BX, before=LEADS, source='ld', where='true')} SELECT * FROM o_est",
)
def m31(spark, sf):
    return ols.tidy(spark, [fam.backward(ship_features(spark, sf), min_total=MIN_TOTAL)])


FINDINGS_OUT = "Finding:s Coefficient:f8 SE:f8 CI_Low:f8 CI_Hi:f8 Significant:s"


@query(
    "M32_key_findings", FINDINGS_OUT,
    f"""WITH RECURSIVE {DID}, {STRATA.removeprefix(SHIPF).lstrip().removeprefix(",")}, {fit_sql(X, columns='*', before='', source='st', where='true', stratum='sk', tag='h', smp='sh')},
        sl AS (SELECT 'all' AS stratum, *, share AS y FROM f WHERE {BASE}), {ols_sql(X, sample='sl', tag='l')}, c AS ({tag_sum_sql('l', _USED)}),
        r AS (SELECT 'Main Effect: Lag 7' AS Finding, coef AS Coefficient, se AS SE FROM l_est WHERE term = 'z_lag7'
              UNION ALL SELECT 'Cumulative Effect (0-7 days)', b, se FROM c
              UNION ALL SELECT 'Heterogeneous: {ATTRS[1]} Q1', coef, se FROM h_est WHERE term = 'z_lag7' AND stratum = '{ATTRS[1]}|Q1'
              UNION ALL SELECT 'Heterogeneous: {ATTRS[0]} Q4', coef, se FROM h_est WHERE term = 'z_lag7' AND stratum = '{ATTRS[0]}|Q4'
              UNION ALL SELECT 'DID: Simple 2x2', coef, se FROM o_est WHERE stratum = 'threshold' AND term = 'treated_post')
        SELECT *, {ci('Coefficient', 'SE', ('CI_Low', 'CI_Hi'))}, CASE WHEN abs(Coefficient / SE) > 1.96 THEN 'Yes' ELSE 'No' END AS Significant FROM r""",
)
def m32(spark, sf):
    f = ship_features(spark, sf)
    main = fam.distributed_lag(f, min_total=MIN_TOTAL)
    total, se, _ = main.sum_of([f"z_lag{k}" for k in fv.CUMULATIVE_LAGS])
    simple = next(d for d in fam.did(f, PERIOD) if (d.stratum, d.model) == ("threshold", "share"))
    return fam.findings(
        spark,
        [
            ("Main Effect: Lag 7", main.coef("z_lag7"), main.se("z_lag7")),
            ("Cumulative Effect (0-7 days)", total, se),
            *fam.strata_findings(fam.stratified(ship_features_attrs(spark, sf), ATTRS, MIN_TOTAL), ATTRS),
            ("DID: Simple 2x2", simple.coef("treated_post"), simple.se("treated_post")),
        ],
    )


@query(
    "M33_minimum_sample", "stratum:s n_obs:i skipped:i",
    f"""WITH {SHIPF} SELECT CAST(total AS VARCHAR) AS stratum, count(*) AS n_obs, CASE WHEN count(*) < 100 THEN 1 ELSE 0 END AS skipped FROM f
        WHERE {BASE} AND {' AND '.join(c + ' IS NOT NULL' for c in X)} GROUP BY total""",
)
def m33(spark, sf):
    # One stratum per volume: the rare ones are too small to be fitted.
    rows = fam.base_rows(ship_features(spark, sf), MIN_TOTAL)
    sample = settle(ols.model_sample(rows, X, ["share"], stratum="total"), "by-volume")
    fits = ols.fit(sample, {"dl": Spec("share", tuple(X))}, count_first=True)
    return spark.createDataFrame(
        [(f.stratum, f.n_obs, int(f.skipped)) for f in fits], "stratum string, n_obs bigint, skipped int"
    )
