"""J1-J13 joins, U1-U5 set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright import fixed_values as fv
from panelwright.functions import calendar
from panelwright.models import families, ols
from panelwright.operators import attributes, events, features, panel as panels, signal as signals
from panelwright.plans.base import (
    ATTR, ATTRS, EV, EVF, EVSIG, MIN_TOTAL, ORD, SHIP, SHIPF, event_features, event_panel,
    event_series, event_signal, holiday_sql, lag_x, nation_attributes, ols_sql, order_series,
    order_signal, query, series_sql, ship_features, ship_panel, table,
)
from panelwright.plans.q_sources import EVENT_TIME, SHIPJ, ship_signal, ship_timed


@query(
    "J1_combine_daily", "day:d signal_total:f2",
    """SELECT day, sum(n) AS signal_total FROM (
         SELECT CAST(o_orderdate AS DATE) AS day, o_totalprice AS n FROM orders
         UNION ALL SELECT CAST(ts AS DATE), 1.0::DOUBLE FROM events WHERE event_type = 'click') q GROUP BY 1""",
)
def j1(spark, sf):
    return signals.combine_daily(order_series(spark, sf), event_series(spark, sf, "click"))


@query(
    "J2_attach_signal", "day:d unit:i total:i signal_total:f2 signal_z:f8",
    f"WITH {SHIPJ} SELECT * FROM j",
)
def j2(spark, sf):
    return ship_signal(spark, sf)


@query(
    "J3_join_attributes", "day:d unit:i total:i total_population:i pct_automobile:f8 total_attr:i",
    f"WITH {SHIP},{ATTR} SELECT p.*, a.total_population, a.pct_automobile, a.total_population AS total_attr FROM ship p LEFT JOIN attr a ON p.unit = a.unit",
)
def j3(spark, sf):
    attrs = nation_attributes(spark, sf).withColumn("total", F.col("total_population"))
    return attributes.join_attributes(ship_panel(spark, sf), attrs)


@query(
    "J4_match_full_code", "day:d unit:i total:i attr_unit:i total_population:i",
    f"""WITH {SHIP},{ATTR}, p AS (SELECT (n_regionkey + 1) * 100 + unit AS unit, day, total FROM ship JOIN nation ON unit = n_nationkey)
        SELECT p.*, p.unit AS attr_unit, total_population FROM p LEFT JOIN attr a ON p.unit % 100 = a.unit""",
)
def j4(spark, sf):
    # Panel and attributes share the full code.
    codes = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("unit"), ((F.col("n_regionkey") + 1) * 100 + F.col("n_nationkey")).alias("code")
    )
    panel = ship_panel(spark, sf).join(codes, "unit").withColumn("unit", F.col("code")).drop("code")
    return attributes.match_attributes(panel, nation_attributes(spark, sf))


@query(
    "J4_match_short_number", "day:d unit:i total:i attr_unit:i total_population:i",
    f"""WITH {SHIP},{ATTR}, p AS (SELECT 900 + unit AS unit, day, total FROM ship)
        SELECT p.*, a.unit AS attr_unit, total_population FROM p
        LEFT JOIN attr a ON CASE WHEN p.unit % 100 <> 0 THEN p.unit % 100 ELSE p.unit END = a.unit""",
)
def j4b(spark, sf):
    # No full code matches (area 9 does not exist): fall back to the number.
    panel = ship_panel(spark, sf).withColumn("unit", F.col("unit") + 900)
    attrs = nation_attributes(spark, sf).withColumn("cd_number", F.col("unit"))
    return attributes.match_attributes(panel, attrs)


DEMEAN = "avg(share) OVER (PARTITION BY unit, isodow(day))"


@query(
    "J5_group_mean", "day:d unit:i share_mean:f9",
    f"WITH {EV} SELECT day, unit, CASE WHEN unit IS NOT NULL THEN {DEMEAN} END AS share_mean FROM ev",
)
def j5(spark, sf):
    rows = event_panel(spark, sf).withColumn("dow", calendar.day_of_week(F.col("day")))
    return features.demean(rows, keep_mean=True)


@query(
    "J6_first_row_per_unit", "day:d unit:i first_total:i first_share:f9",
    f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY day) AS k FROM ev WHERE unit IS NOT NULL)
        SELECT e.day, e.unit, r.total AS first_total, r.share AS first_share FROM ev e LEFT JOIN r ON e.unit = r.unit AND r.k = 1""",
)
def j6(spark, sf):
    panel = event_panel(spark, sf)
    other = panel.select(
        "unit", "day", F.col("total").alias("first_total"), F.col("share").alias("first_share")
    )
    return attributes.attach_first_row(panel, other)


@query(
    "J7_event_windows", "unit:i day:d event_day:d days_from_event:i",
    f"""WITH {EV},{EVSIG}, j AS (SELECT p.*, signal_z FROM ev p LEFT JOIN evsig s ON p.day = s.day),
        ed AS (SELECT DISTINCT day AS event_day FROM j WHERE signal_z > 1.0)
        SELECT unit, day, event_day, date_diff('day', event_day, day) AS days_from_event
        FROM j JOIN ed ON abs(date_diff('day', event_day, day)) <= 20""",
)
def j7(spark, sf):
    rows = signals.attach_signal(event_panel(spark, sf), event_signal(spark, sf))
    return events.attach_windows(rows, events.event_days(rows, F.col("signal_z") > 1.0))


@query(
    "J8_event_time", "day:d unit:i treated:i event_time:i post:i",
    f"WITH {SHIPJ}, {EVENT_TIME} SELECT *, CASE WHEN event_time >= 0 THEN 1 ELSE 0 END AS post FROM jt",
)
def j8(spark, sf):
    return ship_timed(spark, sf)


@query(
    "J9_keep_days", "day:d unit:i total:i",
    f"WITH {SHIP} SELECT * FROM ship WHERE day IN (SELECT day FROM (SELECT day, count(*) AS n FROM ship GROUP BY 1) q WHERE n >= 10 ORDER BY n DESC, day LIMIT 500)",
)
def j9(spark, sf):
    panel = ship_panel(spark, sf)
    return families.keep_days(panel, families.top_days(panel, 10, 500))


@query(
    "J10_holiday_membership", "day:d is_holiday:i",
    f"SELECT day, {holiday_sql('day')} AS is_holiday FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) q",
)
def j10(spark, sf):
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    span = days.agg(F.min("day").cast("string"), F.max("day").cast("string")).first()
    holidays = calendar.holiday_dates(spark, *span).withColumn("hit", F.lit(1))
    return days.join(holidays, "day", "left").withColumn("is_holiday", F.coalesce("hit", F.lit(0)))


@query(
    "J11_key_overlap", "key:i found_in:s",
    """SELECT coalesce(l.k, r.k) AS key, CASE WHEN r.k IS NULL THEN 'left_only' WHEN l.k IS NULL THEN 'right_only' ELSE 'common' END AS found_in
       FROM (SELECT DISTINCT o_custkey AS k FROM orders) l FULL JOIN (SELECT DISTINCT c_custkey + 100 AS k FROM customer) r ON l.k = r.k""",
)
def j11(spark, sf):
    left = table(spark, sf, "orders").select(F.col("o_custkey").alias("unit"))
    right = table(spark, sf, "customer").select((F.col("c_custkey") + 100).alias("unit"))
    return attributes.key_overlap(left, right)


OLS_X = [*lag_x(), "is_holiday"]
DL = f"{SHIPF}, smp AS (SELECT 'all' AS stratum, *, share AS y FROM f WHERE total >= {MIN_TOTAL}), {ols_sql(OLS_X)}"


@query(
    "J12_coefs_with_errors", "term:s coef:f8 se:f8",
    f"WITH RECURSIVE {DL} SELECT * FROM o_est",
)
def j12(spark, sf):
    f = families.distributed_lag(ship_features(spark, sf), min_total=MIN_TOTAL)
    return ols.tidy(spark, [f])


@query(
    "J13_treated_rows", "day:d unit:i share:f9",
    f"WITH {SHIPJ} SELECT * FROM j WHERE signal_z > 1.5",
)
def j13(spark, sf):
    return ship_signal(spark, sf).where(features.above(fv.EVENT_THRESHOLD) == 1)


@query(
    "U1_union_windows", "day:d event_day:d days_from_event:i",
    f"""WITH {EV},{EVSIG}, ed AS (SELECT DISTINCT p.day AS event_day FROM ev p JOIN evsig s ON p.day = s.day WHERE signal_z > 0.5),
        r AS (SELECT unnest(range(-20, 21)) AS o)
        SELECT event_day + CAST(o AS INTEGER) AS day, event_day, o AS days_from_event FROM ed, r""",
)
def u1(spark, sf):
    rows = signals.attach_signal(event_panel(spark, sf), event_signal(spark, sf))
    return events.expand_windows(events.event_days(rows, F.col("signal_z") > 0.5), 20)


@query(
    "U2_union_results", "level:s group:s total:i hits:i share:f9 total_mean:f7 hits_mean:f7 share_mean:f8",
    f"""WITH {EV}, d AS (SELECT day, sum(total) AS total, sum(hits) AS hits, sum(hits)::DOUBLE / sum(total) AS share FROM ev GROUP BY 1)
        SELECT 'overall' AS level, 'all' AS "group", sum(total) AS total, sum(hits) AS hits, sum(hits)::DOUBLE / sum(total) AS share,
          avg(total) AS total_mean, avg(hits) AS hits_mean, avg(share) AS share_mean FROM ev
        UNION ALL SELECT 'year', CAST(year(day) AS VARCHAR), sum(total), sum(hits), sum(hits)::DOUBLE / sum(total), avg(total), avg(hits), avg(share) FROM d GROUP BY year(day)""",
)
def u2(spark, sf):
    return panels.level_summary(event_panel(spark, sf))


@query(
    "U3_common_keys", "key:i",
    "SELECT DISTINCT l_suppkey AS key FROM lineitem INTERSECT SELECT s_suppkey * 2 FROM supplier",
)
def u3(spark, sf):
    left = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("unit"))
    right = table(spark, sf, "supplier").select((F.col("s_suppkey") * 2).alias("unit"))
    return attributes.common_keys(left, right)


@query(
    "U4_missing_keys", "key:i side:s",
    """(SELECT k AS key, 'left' AS side FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem EXCEPT SELECT s_suppkey * 2 FROM supplier) a)
       UNION ALL (SELECT k, 'right' FROM (SELECT s_suppkey * 2 AS k FROM supplier EXCEPT SELECT l_suppkey FROM lineitem) b)""",
)
def u4(spark, sf):
    left = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("unit"))
    right = table(spark, sf, "supplier").select((F.col("s_suppkey") * 2).alias("unit"))
    return attributes.missing_keys(left, right).withColumn("side", F.lit("left")).unionByName(
        attributes.missing_keys(right, left).withColumn("side", F.lit("right"))
    )


@query(
    "U5_distinct_days", "day:d signal_z:f8",
    f"WITH {SHIPJ} SELECT DISTINCT day, signal_z FROM j WHERE signal_z IS NOT NULL",
)
def u5(spark, sf):
    return events.signal_days(ship_signal(spark, sf))
