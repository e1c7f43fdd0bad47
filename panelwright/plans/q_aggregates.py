"""A1-A28 aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright import fixed_values as fv
from panelwright.functions import calendar
from panelwright.operators import (
    attributes, events, features, grid, panel as panels, profile, quantiles, signal as signals,
)
from panelwright.plans import raw
from panelwright.plans.base import (
    ATTR, ATTRS, EV, EVF, EVSIG, MIN_TOTAL, ORD, SHIP, SHIPF, bucket_sql, event_features,
    event_panel, event_signal, features_sql, lags_sql, nation_attributes, order_signal, query,
    ship_features, ship_panel, table,
)
from panelwright.plans.q_sources import SHIPJ, ship_signal
from panelwright.session import settle

PANEL = "day:d unit:i total:i hits:i share:f9"


@query("A1_unit_day_panel", PANEL, f"WITH {SHIP} SELECT * FROM ship")
def a1(spark, sf):
    return ship_panel(spark, sf)


@query(
    "A1_panel_from_log", PANEL,
    f"""WITH {raw.TYPED} SELECT CAST(ts AS DATE) AS day, unit, count(*) AS total,
          sum(CASE WHEN code IN ('EDP', 'OD') THEN 1 ELSE 0 END) AS hits,
          sum(CASE WHEN code IN ('EDP', 'OD') THEN 1 ELSE 0 END)::DOUBLE / count(*) AS share
        FROM kept GROUP BY 1, 2""",
)
def a1b(spark, sf):
    return panels.panel_from_log(raw.raw_log(spark, sf))


@query(
    "A2_daily_totals", "day:d n:f2",
    "SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS n FROM lineitem GROUP BY 1",
)
def a2(spark, sf):
    return signals.daily_totals(table(spark, sf, "lineitem"), F.to_date("l_shipdate"), "l_quantity")


@query("A3_zscore", "day:d signal_total:f2 signal_z:f8", f"WITH {ORD} SELECT * FROM sig")
def a3(spark, sf):
    return order_signal(spark, sf)


_UNIT = ", ".join(
    f"sum({c}) AS {c}_sum, avg({c}) AS {c}_mean, median({c}) AS {c}_median, stddev_samp({c}) AS {c}_std"
    for c in ("total", "hits")
)


@query(
    "A4_unit_summary",
    "unit:i total_sum:i total_mean:f7 total_median:f6 total_std:f7 hits_sum:i hits_mean:f7 hits_median:f6 "
    "hits_std:f7 share_mean:f8 share_median:f8 share_std:f8 day_min:d day_max:d n_days:i share_overall:f9",
    f"""WITH {EV} SELECT unit, {_UNIT}, avg(share) AS share_mean, median(share) AS share_median, stddev_samp(share) AS share_std,
          min(day) AS day_min, max(day) AS day_max, count(day) AS n_days, sum(hits)::DOUBLE / sum(total) AS share_overall
        FROM ev WHERE unit IS NOT NULL GROUP BY 1""",
)
def a4(spark, sf):
    return panels.unit_summary(event_panel(spark, sf))


DAYS = "d AS (SELECT day, sum(total) AS total, sum(hits) AS hits, count(DISTINCT unit) AS n_units, sum(hits)::DOUBLE / sum(total) AS share, year(day) AS year, month(day) AS month FROM {} GROUP BY 1)"


@query(
    "A5_day_summary", "day:d total:i hits:i n_units:i share:f9 year:i month:i",
    f"WITH {EV}, {DAYS.format('ev')} SELECT * FROM d",
)
def a5(spark, sf):
    return panels.day_summary(event_panel(spark, sf))


@query(
    "A6_year_summary",
    "year:i total_sum:i total_mean:f7 total_median:f6 hits_sum:i hits_mean:f7 hits_median:f6 share_mean:f8 share_median:f8 n_days:i share_overall:f9",
    f"""WITH {SHIP}, {DAYS.format('ship')} SELECT year, sum(total) AS total_sum, avg(total) AS total_mean, median(total) AS total_median,
          sum(hits) AS hits_sum, avg(hits) AS hits_mean, median(hits) AS hits_median, avg(share) AS share_mean, median(share) AS share_median,
          count(day) AS n_days, sum(hits)::DOUBLE / sum(total) AS share_overall FROM d GROUP BY 1""",
)
def a6(spark, sf):
    return panels.year_summary(panels.day_summary(ship_panel(spark, sf)))


@query(
    "A7_overall_summary",
    "n_rows:i total_sum:i hits_sum:i share_overall:f9 total_mean:f7 hits_mean:f7 share_mean:f8 total_median:f6 hits_median:f6 share_median:f8",
    f"""WITH {SHIP} SELECT count(*) AS n_rows, sum(total) AS total_sum, sum(hits) AS hits_sum, sum(hits)::DOUBLE / sum(total) AS share_overall,
          avg(total) AS total_mean, avg(hits) AS hits_mean, avg(share) AS share_mean, median(total) AS total_median, median(hits) AS hits_median,
          median(share) AS share_median FROM ship""",
)
def a7(spark, sf):
    panel = settle(ship_panel(spark, sf), "panel")
    names = ("total", "hits", "share")
    medians = (
        quantiles.exact_quantiles(panel, names, [0.5])
        .agg(*[F.max(F.when(F.col("variable") == n, F.col("quantile"))).alias(f"{n}_median") for n in names])
    )
    overall = panels.overall_summary(panel)
    return overall.withColumns({f"{n}_median": medians.select(f"{n}_median").scalar() for n in names})


@query(
    "A8_level_summary", "level:s group:s total:i hits:i share:f9 total_mean:f7 hits_mean:f7 share_mean:f8",
    f"""WITH {SHIP}, {DAYS.format('ship')}
        SELECT 'overall' AS level, 'all' AS "group", sum(total) AS total, sum(hits) AS hits, sum(hits)::DOUBLE / sum(total) AS share,
          avg(total) AS total_mean, avg(hits) AS hits_mean, avg(share) AS share_mean FROM ship
        UNION ALL SELECT 'year', CAST(year AS VARCHAR), sum(total), sum(hits), sum(hits)::DOUBLE / sum(total), avg(total), avg(hits), avg(share) FROM d GROUP BY year""",
)
def a8(spark, sf):
    return panels.level_summary(ship_panel(spark, sf))


PROFILED = ["share", "hits", "total", "log_hits_roll3", *[f"z_lag{k}" for k in fv.MODEL_LAGS], "dow", "month", "year", "is_holiday"]
_KINDS = {
    c: "outcome" if c in PROFILED[:4] else "independent" if c.startswith("z_lag") else "control"
    for c in PROFILED
}


@query(
    "A9_column_profile",
    "variable:s variable_type:s n:i n_missing:i pct_missing:f7 mean:f7 std:f7 min:f7 p25:f7 median:f7 p75:f7 max:f7",
    f"WITH {SHIPF}, s AS (SELECT * FROM f WHERE total >= {MIN_TOTAL} AND share IS NOT NULL) " + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, '{_KINDS[c]}' AS variable_type, count({c}) AS n, count(*) - count({c}) AS n_missing, "
        f"(count(*) - count({c})) / count(*) * 100 AS pct_missing, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, "
        f"quantile_cont({c}::DOUBLE, 0.25) AS p25, median({c}::DOUBLE) AS median, quantile_cont({c}::DOUBLE, 0.75) AS p75, max({c})::DOUBLE AS max FROM s"
        for c in PROFILED
    ),
)
def a9(spark, sf):
    sample = panels.complete_share(ship_features(spark, sf), MIN_TOTAL)
    return profile.describe(sample, PROFILED, _KINDS)


@query(
    "A10_category_profile", "variable:s n:i n_unique:i most_common:s most_common_count:i",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, sum(n) AS n, count(*) AS n_unique, first({c} ORDER BY n DESC, {c}) AS most_common, max(n) AS most_common_count
            FROM (SELECT {c}, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 1) q"""
        for c in ("o_orderstatus", "o_orderpriority")
    ),
)
def a10(spark, sf):
    return profile.describe_categories(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


BUCKET = bucket_sql("signal_z", "z", fv.QUINTILE_LABELS)
QUINT = f"{SHIPF}, z AS (SELECT * FROM f WHERE total >= {MIN_TOTAL} AND share IS NOT NULL AND signal_z IS NOT NULL), q AS (SELECT *, {BUCKET} AS quintile FROM z)"


def quintile_rows(spark, sf):
    rows = panels.complete_share(ship_features(spark, sf), MIN_TOTAL).where("signal_z is not null")
    return quantiles.add_quintile(rows)


_STATS = ["share", "hits", "total", "signal_z"]


@query(
    "A11_quintile_stats", "quintile:s n:i " + " ".join(f"{c}_mean:f6 {c}_std:f6" for c in _STATS),
    f"WITH {QUINT} SELECT quintile, count(share) AS n, " + ", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in _STATS) + " FROM q GROUP BY 1",
)
def a11(spark, sf):
    return profile.grouped_stats(quintile_rows(spark, sf), "quintile", _STATS)


PROFILE_SQL = f"""{SHIPF}, ed AS (SELECT DISTINCT day AS event_day FROM f WHERE signal_z > 1.5),
  x AS (SELECT date_diff('day', event_day, day) AS k, log_hits_roll3 AS y, share FROM f JOIN ed ON abs(date_diff('day', event_day, day)) <= 20),
  pr AS (SELECT k AS days_from_event, avg(y) AS log_hits_mean, stddev_samp(y) AS log_hits_std, count(y) AS n_obs, avg(share) AS share_mean,
     stddev_samp(share) AS share_std FROM x GROUP BY 1)"""


def _profile(spark, sf):
    f = ship_features(spark, sf)
    return events.event_profile(f, events.event_days(f, F.col("signal_z") > fv.EVENT_THRESHOLD))


@query(
    "A12_event_profile",
    "days_from_event:i log_hits_mean:f8 log_hits_std:f8 n_obs:i share_mean:f8 share_std:f8 log_hits_se:f9 log_hits_ci_low:f8 log_hits_ci_hi:f8",
    f"""WITH {PROFILE_SQL} SELECT *, log_hits_std / sqrt(n_obs) AS log_hits_se, log_hits_mean - 1.96 * log_hits_std / sqrt(n_obs) AS log_hits_ci_low,
          log_hits_mean + 1.96 * log_hits_std / sqrt(n_obs) AS log_hits_ci_hi FROM pr""",
)
def a12(spark, sf):
    return _profile(spark, sf)


@query(
    "A13_pre_event_mean", "pre_mean:f8",
    f"WITH {PROFILE_SQL} SELECT avg(log_hits_mean) AS pre_mean FROM pr WHERE days_from_event < 0",
)
def a13(spark, sf):
    return events.pre_event_mean(_profile(spark, sf))


_THRESHOLDS = (0.5, 1.0, 1.5, 2.0, 3.0)
THRESHOLD_SQL = f"""WITH {SHIPJ}, d AS (SELECT DISTINCT day, signal_z FROM j WHERE signal_z IS NOT NULL), t AS (SELECT unnest([0.5, 1.0, 1.5, 2.0, 3.0])::DOUBLE AS threshold)
  SELECT threshold, count(CASE WHEN signal_z > threshold THEN 1 END) AS n_days, count(CASE WHEN signal_z > threshold THEN 1 END) / count(*) * 100 AS pct_days,
    avg(CASE WHEN signal_z > threshold THEN signal_z END) AS mean_z, max(CASE WHEN signal_z > threshold THEN signal_z END) AS max_z,
    CASE WHEN max(signal_z) > threshold THEN first(day ORDER BY signal_z DESC, day) END AS top_day,
    CASE WHEN max(signal_z) > threshold THEN max(signal_z) END AS top_z FROM d, t GROUP BY 1"""


@query(
    "A14_threshold_table", "threshold:f2 n_days:i pct_days:f7 mean_z:f8 max_z:f8 top_day:d top_z:f8",
    THRESHOLD_SQL,
)
def a14(spark, sf):
    return events.threshold_table(events.signal_days(ship_signal(spark, sf)), _THRESHOLDS)


@query(
    "A15_weekday_means", "unit:i dow:i share_mean:f9",
    f"""WITH {EV} SELECT CAST(NULL AS BIGINT) AS unit, isodow(day) - 1 AS dow, avg(share) AS share_mean FROM ev GROUP BY 2
        UNION ALL SELECT unit, isodow(day) - 1, avg(share) FROM ev WHERE unit IS NOT NULL GROUP BY 1, 2""",
)
def a15(spark, sf):
    rows = event_panel(spark, sf).withColumn("dow", calendar.day_of_week(F.col("day")))
    overall = rows.groupBy("dow").agg(F.avg("share").alias("share_mean")).withColumn("unit", F.lit(None).cast("bigint"))
    by_unit = rows.where("unit is not null").groupBy("unit", "dow").agg(F.avg("share").alias("share_mean"))
    return overall.unionByName(by_unit)


@query(
    "A16_frequency", "quintile:s n:i",
    f"WITH {QUINT} SELECT quintile, count(*) AS n FROM q GROUP BY 1",
)
def a16(spark, sf):
    return quintile_rows(spark, sf).groupBy("quintile").agg(F.count(F.lit(1)).alias("n"))


@query(
    "A17_distinct_count", "n_units:i n_days:i",
    f"WITH {EV} SELECT count(DISTINCT unit) AS n_units, count(DISTINCT day) AS n_days FROM ev",
)
def a17(spark, sf):
    return event_panel(spark, sf).agg(
        F.countDistinct("unit").alias("n_units"), F.countDistinct("day").alias("n_days")
    )


@query(
    "A18_date_range", "first_day:d last_day:d",
    "SELECT min(CAST(l_shipdate AS DATE)) AS first_day, max(CAST(l_shipdate AS DATE)) AS last_day FROM lineitem",
)
def a18(spark, sf):
    day = F.to_date("l_shipdate")
    return table(spark, sf, "lineitem").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


@query(
    "A19_short_summary", "variable:s mean:f8 std:f8 min:f8 max:f8 n:i",
    f"WITH {SHIPF}, s AS (SELECT * FROM f WHERE total >= {MIN_TOTAL} AND share IS NOT NULL) " + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, count({c}) AS n FROM s"
        for c in ("share", "hits", "total", "signal_z")
    ),
)
def a19(spark, sf):
    rows = panels.complete_share(ship_signal(spark, sf), MIN_TOTAL)
    return profile.short_summary(rows, ["share", "hits", "total", "signal_z"])


@query(
    "A20_panel_facts", "n_rows:i day_min:d day_max:d n_units:i rows_with_attributes:i n_interactions:i",
    f"""WITH {SHIP},{ATTR} SELECT count(*) AS n_rows, min(day) AS day_min, max(day) AS day_max, count(DISTINCT p.unit) AS n_units,
          count(a.unit) AS rows_with_attributes, 32 AS n_interactions FROM ship p LEFT JOIN attr a ON p.unit = a.unit""",
)
def a20(spark, sf):
    joined = attributes.join_attributes(
        features.add_lags(ship_signal(spark, sf), fv.MODEL_LAGS), nation_attributes(spark, sf).drop("cd_code")
    )
    lags = [f"z_lag{k}" for k in fv.MODEL_LAGS]
    return panels.panel_facts(features.add_interactions(joined, lags, ATTRS))


@query(
    "A21_completeness", "variable:s n_known:i n_rows:i",
    f"WITH {SHIPF} " + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count({c}) AS n_known, count(*) AS n_rows FROM f" for c in ("signal_z", "z_lag7", "z_lag28", "share")
    ),
)
def a21(spark, sf):
    rows = features.add_lags(ship_signal(spark, sf), fv.MODEL_LAGS)
    return grid.completeness(rows, ["signal_z", "z_lag7", "z_lag28", "share"])


@query(
    "A22_parse_grid",
    "unit:i total_population:f4 pct_white:f8 pct_black:f8 pct_hispanic:f8 pct_asian:f8 total_households:f4 "
    "pct_owner_occupied:f8 pct_renter_occupied:f8 median_income:f4 pct_college:f8 pct_poverty:f8 cd_code:i cd_number:i",
    f"""WITH {ATTR} SELECT (n_regionkey + 1) * 100 + n_nationkey + 1 AS unit, total_population, pct_automobile AS pct_white,
          pct_building AS pct_black, pct_furniture AS pct_hispanic, pct_machinery AS pct_asian, total_population AS total_households,
          pct_building AS pct_owner_occupied, pct_automobile AS pct_renter_occupied, total_population AS median_income,
          pct_furniture AS pct_college, pct_machinery AS pct_poverty, (n_regionkey + 1) * 100 + n_nationkey + 1 AS cd_code, n_nationkey + 1 AS cd_number
        FROM nation JOIN attr ON unit = n_nationkey""",
)
def a22(spark, sf):
    return grid.parse_grid(raw.grid(spark, sf))


@query(
    "A23_histogram", "bin:i n:i",
    f"""WITH {ORD}, e AS (SELECT min(signal_z) AS lo, max(signal_z) AS hi FROM sig)
        SELECT least(CAST(floor((signal_z - lo) / ((hi - lo) / 100)) AS INTEGER), 99) AS bin, count(*) AS n FROM sig, e GROUP BY 1""",
)
def a23(spark, sf):
    return profile.histogram(order_signal(spark, sf), "signal_z")


@query(
    "A24_box_stats", "quintile:s n:i mean:f8 q1:f8 median:f8 q3:f8 whisker_low:f8 whisker_high:f8",
    f"""WITH {QUINT}, b AS (SELECT quintile, quantile_cont(share, 0.25) AS q1, median(share) AS median, quantile_cont(share, 0.75) AS q3 FROM q GROUP BY 1)
        SELECT q.quintile, count(share) AS n, avg(share) AS mean, q1, b.median, q3, min(CASE WHEN share >= q1 - 1.5 * (q3 - q1) THEN share END) AS whisker_low,
          max(CASE WHEN share <= q3 + 1.5 * (q3 - q1) THEN share END) AS whisker_high FROM q JOIN b ON q.quintile = b.quintile GROUP BY ALL""",
)
def a24(spark, sf):
    return profile.box_stats(quintile_rows(spark, sf), "quintile", "share")


@query(
    "A24_box_stats_many_groups", "part:i n:i mean:f8 q1:f8 median:f8 q3:f8 whisker_low:f8 whisker_high:f8",
    """WITH q AS (SELECT l_orderkey % 5000 AS part, l_extendedprice AS v FROM lineitem),
          b AS (SELECT part, quantile_cont(v, 0.25) AS q1, median(v) AS median, quantile_cont(v, 0.75) AS q3 FROM q GROUP BY 1)
        SELECT q.part, count(v) AS n, avg(v) AS mean, q1, b.median, q3, min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END) AS whisker_low,
          max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_high FROM q JOIN b ON q.part = b.part GROUP BY ALL""",
)
def a24b(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 5000).alias("part"), "l_extendedprice")
    return profile.box_stats(rows, "part", "l_extendedprice")


@query(
    "A25_mean_by_quintile", "quintile:s share_mean:f9",
    f"WITH {QUINT} SELECT quintile, avg(share) AS share_mean FROM q GROUP BY 1",
)
def a25(spark, sf):
    return quintile_rows(spark, sf).groupBy("quintile").agg(F.avg("share").alias("share_mean"))


@query(
    "A26_sample_rows", PANEL,
    f"""WITH {SHIP} SELECT * FROM ship
        WHERE ('0x' || substr(md5('42/' || coalesce(CAST(day AS VARCHAR), '-') || '/' || coalesce(CAST(unit AS VARCHAR), '-')), 1, 8))::BIGINT < {2**31}""",
)
def a26(spark, sf):
    return profile.sample_rows(ship_panel(spark, sf), 0.5, ("day", "unit"))


@query(
    "A26_sample_n", PANEL,
    f"""WITH {SHIP} SELECT * FROM ship
        ORDER BY ('0x' || substr(md5('42/' || coalesce(CAST(day AS VARCHAR), '-') || '/' || coalesce(CAST(unit AS VARCHAR), '-')), 1, 15))::BIGINT LIMIT 3000""",
)
def a26b(spark, sf):
    return profile.sample_n(settle(ship_panel(spark, sf), "panel"), 3000, ("day", "unit"))


@query(
    "A27_exact_quantiles", "variable:s prob:f4 quantile:f6",
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, {p}::DOUBLE AS prob, quantile_cont({c}, {p}) AS quantile FROM lineitem"
        for c in ("l_extendedprice", "l_quantity", "l_tax") for p in (0.01, 0.25, 0.5, 0.75, 0.99)
    ),
)
def a27(spark, sf):
    return quantiles.exact_quantiles(
        table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity", "l_tax"], [0.01, 0.25, 0.5, 0.75, 0.99]
    )


@query(
    "A27_bracketed_quantiles", "variable:s prob:f4 quantile:f6",
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, {p}::DOUBLE AS prob, quantile_cont({c}, {p}) AS quantile FROM lineitem"
        for c in ("l_extendedprice", "l_quantity") for p in (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    ),
)
def a27b(spark, sf):
    # The way of columns with many distinct values, taken at any size here.
    return quantiles.exact_quantiles(
        table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"],
        [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0], max_distinct=0,
    )


@query(
    "A28_null_counts", "variable:s n_known:i n_rows:i",
    "SELECT 'user_unit' AS variable, count(CASE WHEN user_id % 26 <> 25 THEN 1 END) AS n_known, count(*) AS n_rows FROM events UNION ALL SELECT 'value', count(value), count(*) FROM events",
)
def a28(spark, sf):
    rest = F.col("user_id") % 26
    rows = table(spark, sf, "events").select(F.when(rest != 25, rest).alias("user_unit"), "value")
    return grid.completeness(rows, ["user_unit", "value"])
