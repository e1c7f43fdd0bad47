"""W1-W12 window functions, K1-K5 orders and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright import fixed_values as fv
from panelwright.functions import calendar
from panelwright.models import families
from panelwright.operators import (
    attributes, events, features, grid, panel as panels, profile, quantiles, signal as signals,
)
from panelwright.plans import raw
from panelwright.plans.base import (
    ATTR, ATTRS, EV, EVF, EVSIG, MIN_TOTAL, ORD, SHIP, SHIPF, bucket_sql, event_features,
    event_panel, event_signal, nation_attributes, order_signal, query, ship_features, ship_panel,
    table,
)
from panelwright.plans.q_aggregates import PROFILE_SQL, QUINT, THRESHOLD_SQL, _profile, quintile_rows
from panelwright.plans.q_sources import SHIPJ, ship_signal

_LAGS = " ".join(f"z_lag{k}:f8" for k in fv.FEATURE_LAGS)


@query(
    "W1_signal_lags",
    f"day:d unit:i total:i hits:i share:f9 signal_total:f6 signal_z:f8 {_LAGS} dow:i month:i year:i is_holiday:i",
    f"WITH {EVF} SELECT * FROM f",
)
def w1(spark, sf):
    return event_features(spark, sf)


@query(
    "W1_signal_lags_wide_panel", "day:d unit:i " + " ".join(f"z_lag{k}:f8" for k in fv.MODEL_LAGS),
    f"WITH {SHIPF} SELECT * FROM f",
)
def w1b(spark, sf):
    return features.add_lags(ship_signal(spark, sf), fv.MODEL_LAGS)


@query(
    "W1_calendar_lags", "day:d unit:i c_lag1:f8 c_lag7:f8",
    f"""WITH {SHIPJ} SELECT j.day, j.unit, a.signal_z AS c_lag1, b.signal_z AS c_lag7 FROM j
        LEFT JOIN j a ON a.unit = j.unit AND a.day = j.day - 1 LEFT JOIN j b ON b.unit = j.unit AND b.day = j.day - 7""",
)
def w1c(spark, sf):
    return features.add_lags(ship_signal(spark, sf), (1, 7), prefix="c_lag", calendar_days=True)


_TL = [(t, k) for t in fv.THRESHOLDS for k in fv.THRESHOLD_LAGS]


def _tname(t):
    return features.threshold_name(t)


THRESHOLD_LAGS = f"""b AS (SELECT *, {', '.join(f'CASE WHEN signal_z > {t} THEN 1 ELSE 0 END AS {_tname(t)}' for t in fv.THRESHOLDS)}
       FROM f WHERE total >= {MIN_TOTAL} AND share IS NOT NULL AND unit IS NOT NULL),
  tl AS (SELECT *, {', '.join(f'{_tname(t)} AS {_tname(t)}_lag0' if k == 0 else f'lag({_tname(t)}, {k}) OVER w AS {_tname(t)}_lag{k}' for t, k in _TL)}
       FROM b WINDOW w AS (PARTITION BY unit ORDER BY day))"""


@query(
    "W2_threshold_lags", "day:d unit:i " + " ".join(f"{_tname(t)}_lag{k}:i" for t, k in _TL),
    f"WITH {SHIPF}, {THRESHOLD_LAGS} SELECT * FROM tl",
)
def w2(spark, sf):
    flagged = features.add_threshold_flags(ship_signal(spark, sf))
    return features.add_threshold_lags(families.base_rows(flagged, MIN_TOTAL))


@query(
    "W3_outcome_leads", "day:d unit:i " + " ".join(f"next_{k}:f9" for k in fv.LEAD_STEPS),
    f"WITH {EV} SELECT day, unit, " + ", ".join(
        f"CASE WHEN unit IS NOT NULL THEN lead(share, {k}) OVER (PARTITION BY unit ORDER BY day) END AS next_{k}" for k in fv.LEAD_STEPS
    ) + " FROM ev WHERE total >= 5",
)
def w3(spark, sf):
    return features.add_leads(panels.complete_share(event_panel(spark, sf)))


@query(
    "W4_rolling_means", "day:d unit:i hits_roll3:f8 log_hits_roll3:f8 signal_roll3:f8 log_signal_roll3:f8",
    f"WITH {EVF} SELECT * FROM f",
)
def w4(spark, sf):
    return features.add_rolling(signals.attach_signal(event_panel(spark, sf), event_signal(spark, sf)))


@query(
    "W5_demean", "day:d unit:i share_dm:f9",
    f"WITH {SHIP} SELECT day, unit, share - avg(share) OVER (PARTITION BY unit, isodow(day)) AS share_dm FROM ship",
)
def w5(spark, sf):
    rows = ship_panel(spark, sf).withColumn("dow", calendar.day_of_week(F.col("day")))
    return features.demean(rows)


@query(
    "W6_signal_quintile", "day:d unit:i quintile:s",
    f"WITH {QUINT} SELECT day, unit, quintile FROM q",
)
def w6(spark, sf):
    return quintile_rows(spark, sf)


JOINED = f"{SHIP},{ATTR}, pa AS (SELECT p.*, {', '.join('a.' + a for a in ATTRS)} FROM ship p LEFT JOIN attr a ON p.unit = a.unit)"


@query(
    "W6_attribute_quartiles", "day:d unit:i " + " ".join(f"{a}_quartile:s" for a in ATTRS),
    f"WITH {JOINED} SELECT day, unit, " + ", ".join(f"{bucket_sql(a, 'pa', fv.QUARTILE_LABELS)} AS {a}_quartile" for a in ATTRS) + " FROM pa",
)
def w6b(spark, sf):
    joined = attributes.join_attributes(ship_panel(spark, sf), nation_attributes(spark, sf).drop("cd_code"))
    return quantiles.add_quartiles(joined, ATTRS)


DAYS_SQL = f"WITH {SHIPJ}, d AS (SELECT DISTINCT day, signal_z FROM j WHERE signal_z IS NOT NULL)"


@query(
    "W7_percentile_of_day", "event_day:d percentile:f7",
    DAYS_SQL + ", c AS (SELECT day AS event_day, signal_z, cume_dist() OVER (ORDER BY signal_z) * 100 AS percentile FROM d) SELECT * FROM c WHERE signal_z > 0",
)
def w7(spark, sf):
    return events.event_list(events.signal_days(ship_signal(spark, sf)), 0.0)


@query(
    "W8_ordinal", "year:i ordinal:i total_sum:i",
    f"WITH {SHIP}, y AS (SELECT year(day) AS year, sum(total) AS total_sum FROM ship GROUP BY 1) SELECT year, total_sum, row_number() OVER (ORDER BY total_sum DESC, year) AS ordinal FROM y",
)
def w8(spark, sf):
    years = panels.year_summary(panels.day_summary(ship_panel(spark, sf)))
    return profile.number_rows(years, F.desc("total_sum"), "year")


_N = len(raw.GRID_ROWS)
SECTION = f"""g AS (SELECT n_nationkey * {raw.SECTION_ROWS} + o AS row_no, (n_regionkey + 1) * 100 + n_nationkey + 1 AS unit, o
  FROM nation, (SELECT unnest(range(0, {_N + 4})) AS o) r)"""


@query("W9_carry_down", "row_no:i unit:i unit_row:i", f"WITH {SECTION} SELECT row_no, unit, row_no - o AS unit_row FROM g")
def w9(spark, sf):
    marked = raw.grid(spark, sf).withColumn("header", grid.header_code(F.col("c0")))
    return grid.carry_down(marked, "header", "unit", block=64)


@query(
    "W10_first_match", "unit:i variable:s value:f6",
    f"""WITH {ATTR}, u AS (SELECT (n_regionkey + 1) * 100 + n_nationkey + 1 AS code, attr.* FROM nation JOIN attr ON attr.unit = n_nationkey)
        SELECT code AS unit, variable, value FROM (
          SELECT code, 'total_population' AS variable, total_population::DOUBLE AS value FROM u
          UNION ALL SELECT code, 'pct_white', pct_automobile FROM u UNION ALL SELECT code, 'pct_black', pct_building FROM u
          UNION ALL SELECT code, 'pct_hispanic', pct_furniture FROM u UNION ALL SELECT code, 'pct_asian', pct_machinery FROM u
          UNION ALL SELECT code, 'total_households', total_population FROM u UNION ALL SELECT code, 'pct_owner_occupied', pct_building FROM u
          UNION ALL SELECT code, 'pct_renter_occupied', pct_automobile FROM u) q""",
)
def w10(spark, sf):
    return grid.first_match(grid.match_variables(grid.sections(raw.grid(spark, sf))))


@query(
    "W11_section_offset", "row_no:i unit:i section_row:i",
    f"WITH {SECTION} SELECT row_no, unit, o AS section_row FROM g WHERE o >= 4 AND o < 10",
)
def w11(spark, sf):
    return grid.sections(raw.grid(spark, sf), skip=4, cap=6)


@query(
    "W12_event_list", "event_day:d signal_z:f8 above_threshold:f8 percentile:f7",
    DAYS_SQL + ", c AS (SELECT day AS event_day, signal_z, signal_z - 1.5 AS above_threshold, cume_dist() OVER (ORDER BY signal_z) * 100 AS percentile FROM d) SELECT * FROM c WHERE signal_z > 1.5",
)
def w12(spark, sf):
    return events.event_list(events.signal_days(ship_signal(spark, sf))).orderBy(F.desc("signal_z"), "event_day")


@query("K1_ordered_panel", "day:d unit:i total:i hits:i share:f9", f"WITH {EV} SELECT * FROM ev ORDER BY day, unit")
def k1(spark, sf):
    return event_panel(spark, sf).orderBy("day", "unit")


@query(
    "K2_top_days", "day:d n:i",
    f"WITH {SHIP} SELECT day, count(*) AS n FROM ship GROUP BY 1 HAVING count(*) >= 10 ORDER BY n DESC, day LIMIT 500",
)
def k2(spark, sf):
    return families.top_days(ship_panel(spark, sf), 10, 500)


@query(
    "K3_top_event_day", "threshold:f2 top_day:d top_z:f8",
    THRESHOLD_SQL,
)
def k3(spark, sf):
    return events.threshold_table(
        events.signal_days(ship_signal(spark, sf)), (0.5, 1.0, 1.5, 2.0, 3.0)
    )


@query(
    "K4_first_events", "event_day:d",
    f"WITH {SHIPJ} SELECT DISTINCT day AS event_day FROM j WHERE signal_z > 1.5 ORDER BY 1 LIMIT 10",
)
def k4(spark, sf):
    rows = ship_signal(spark, sf)
    return events.first_events(events.event_days(rows, F.col("signal_z") > fv.EVENT_THRESHOLD))


@query(
    "K5_ordered_profile", "days_from_event:i log_hits_mean:f8",
    f"WITH {PROFILE_SQL} SELECT * FROM pr ORDER BY 1",
)
def k5(spark, sf):
    return _profile(spark, sf).orderBy("days_from_event")
