"""S1-S8 sources and sinks, P1-P32 projections and filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelwright import fixed_values as fv
from panelwright.functions import calendar, clean, inference
from panelwright.models import families
from panelwright.operators import (
    attributes, events, features, grid, panel as panels, quantiles, signal as signals,
)
from panelwright.plans import raw
from panelwright.plans.base import (
    ATTR,
    EV, EVF, EVSIG, MIN_TOTAL, ORD, SHIP, SHIPF, event_features, event_panel, event_series,
    holiday_sql, order_signal, query, series_sql, ship_features, ship_panel, table,
)
from panelwright.session import scratch_path
from panelwright.sources import files

PANEL = "day:d unit:i total:i hits:i share:f9"


def _csv(df, tag, delimiter=","):
    path = scratch_path(df.sparkSession, tag)
    files.save_result(df, path, delimiter)
    return path


@query(
    "S1_read_log", "code:s n:i n_unit:i",
    f"WITH {raw.RAW} SELECT final_call_type AS code, count(*) AS n, count(communitydistrict) AS n_unit FROM raw GROUP BY 1",
)
def s1(spark, sf):
    log = files.read_log(spark, _csv(raw.raw_log(spark, sf), "log"))
    return log.groupBy(F.col("final_call_type").alias("code")).agg(
        F.count(F.lit(1)).alias("n"), F.count("communitydistrict").alias("n_unit")
    )


@query(
    "S1_read_log_dialects", "code:s n:i n_unit:i",
    f"WITH {raw.RAW} SELECT final_call_type AS code, count(*) AS n, count(communitydistrict) AS n_unit FROM raw GROUP BY 1",
)
def s1b(spark, sf):
    # Two files that differ in delimiter and in the order of their columns.
    rows = raw.raw_log(spark, sf)
    one = _csv(rows.where("event_id % 3 = 0"), "log")
    names = [c for c in reversed(rows.columns)]
    two = _csv(rows.where("event_id % 3 <> 0").select(*[F.col(c).alias(f" {c.upper()}") for c in names]), "log", ";")
    return files.read_log(spark, [one, two]).groupBy(F.col("final_call_type").alias("code")).agg(
        F.count(F.lit(1)).alias("n"), F.count("communitydistrict").alias("n_unit")
    )


@query(
    "S2_prune_columns", "unit:s n:i",
    f"WITH {raw.RAW} SELECT communitydistrict AS unit, count(*) AS n FROM raw GROUP BY 1",
)
def s2(spark, sf):
    log = files.read_log(spark, _csv(raw.raw_log(spark, sf), "log"), ["communitydistrict"])
    return log.groupBy(F.col("communitydistrict").alias("unit")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "S3_read_signal", "day:d n:f6",
    "SELECT CAST(o_orderdate AS DATE) AS day, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE o_orderkey % 10 END) AS DOUBLE) AS n FROM orders GROUP BY 1",
)
def s3(spark, sf):
    text = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias(" Created_At "),
        F.when(F.col("o_orderpriority") == "1-URGENT", "many")
        .otherwise((F.col("o_orderkey") % 10).cast("string"))
        .alias("Tweets"),
    )
    return signals.daily_totals(files.read_signal(spark, _csv(text, "signal")))


_CELLS = " UNION ALL ".join(
    f"SELECT {4 + i} AS o, {chr(39)}{label.replace(chr(39), chr(39) * 2)}{chr(39)} AS c0, "
    + ", ".join(f"{chr(39) + value + chr(39) if cell == c else 'NULL'} AS {c}" for c in ("c7", "c8"))
    for i, (label, cell, value) in enumerate(raw.GRID_ROWS)
)
_VALUE = "CASE {} " + " ".join(f"WHEN '{v}' THEN {v}::DOUBLE" for v in sorted({r[2] for r in raw.GRID_ROWS})) + " END"


@query(
    "S4_read_grid", "row_no:i c0:s c7:f6 c8:f6",
    f"""WITH {ATTR}, lay AS ({_CELLS}
          UNION ALL SELECT 0, NULL, NULL, NULL UNION ALL SELECT 1, NULL, NULL, NULL UNION ALL SELECT 2, NULL, NULL, NULL UNION ALL SELECT 3, 'Number', NULL, NULL)
        SELECT n_nationkey * {raw.SECTION_ROWS} + o AS row_no,
          CASE o WHEN 0 THEN (['Manhattan', 'Bronx', 'Brooklyn', 'Queens', 'Staten Island'])[n_regionkey + 1] || ' Community District ' || (n_nationkey + 1)
                 ELSE c0 END AS c0,
          {_VALUE.format('c7')} AS c7, {_VALUE.format('c8')} AS c8
        FROM nation JOIN attr ON attr.unit = n_nationkey, lay""",
)
def s4(spark, sf):
    path = scratch_path(spark, "grid")
    raw.grid(spark, sf).write.csv(path)
    cells = files.read_grid(spark, path)
    return cells.withColumns({c: clean.to_number(F.col(c)) for c in ("c7", "c8")})


@query("S5_load_table", PANEL, f"WITH {EV} SELECT * FROM ev")
def s5(spark, sf):
    path = scratch_path(spark, "panel")
    files.save_table(event_panel(spark, sf), path)
    return files.load_table(spark, path)


@query("S6_save_table", PANEL, f"WITH {SHIP} SELECT * FROM ship")
def s6(spark, sf):
    path = scratch_path(spark, "panel")
    panel = ship_panel(spark, sf).withColumn("year", F.year("day"))
    files.save_table(panel, path, ["year"])
    return files.load_table(spark, path)


@query(
    "S7_save_result", "unit:s total_sum:i share_overall:f9",
    f"WITH {EV} SELECT unit, sum(total) AS total_sum, sum(hits)::DOUBLE / sum(total) AS share_overall FROM ev WHERE unit IS NOT NULL GROUP BY 1",
)
def s7(spark, sf):
    path = _csv(panels.unit_summary(event_panel(spark, sf)), "units")
    return spark.read.option("header", True).csv(path)


@query(
    "S8_load_result", "day:d total:i hits:i n_units:i share:f9",
    f"WITH {EV} SELECT day, sum(total) AS total, sum(hits) AS hits, count(DISTINCT unit) AS n_units, sum(hits)::DOUBLE / sum(total) AS share FROM ev GROUP BY 1",
)
def s8(spark, sf):
    days = panels.day_summary(event_panel(spark, sf))
    return files.load_result(spark, _csv(days, "days"), days.schema)


@query(
    "P1_parse_timestamp", "event_id:i at:s",
    f"WITH {raw.TYPED} SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM typed",
)
def p1(spark, sf):
    return raw.raw_log(spark, sf).select(
        "event_id",
        F.date_format(clean.parse_timestamp(F.col("incident_datetime")), "yyyy-MM-dd HH:mm:ss").alias("at"),
    )


@query(
    "P2_to_number", "event_id:i unit:i disposition_no:i number:f6",
    f"WITH {raw.TYPED} SELECT t.event_id, unit, disposition_no, try_cast(r.communitydistrict AS DOUBLE) AS number FROM typed t JOIN raw r ON t.event_id = r.event_id",
)
def p2(spark, sf):
    return raw.raw_log(spark, sf).select(
        "event_id",
        clean.to_int(F.col("communitydistrict")).alias("unit"),
        clean.to_int(F.col("incident_disposition_code")).alias("disposition_no"),
        clean.to_number(F.col("communitydistrict")).alias("number"),
    )


def stored_features(spark, sf):
    """Features of a stored panel: lags, leads, rolling means and demeaning."""
    name = f"panel_{uuid.uuid4().hex}"
    panel = ship_panel(spark, sf).join(order_signal(spark, sf), "day", "left")
    files.save_by_unit(panel, name, scratch_path(spark, "by-unit"))
    wide = features.with_features(files.load_by_unit(spark, name), (0, 7))
    return features.demean(features.add_leads(wide, "share", (1,)))


@query(
    "S6_stored_by_unit", "unit:i day:d z_lag7:f8 hits_roll3:f8 next_1:f9 share_dm:f8",
    f"""WITH {SHIPF} SELECT unit, day, z_lag7, hits_roll3, lead(share) OVER (PARTITION BY unit ORDER BY day) AS next_1,
          share - avg(share) OVER (PARTITION BY unit, dow) AS share_dm FROM f""",
)
def s6b(spark, sf):
    return stored_features(spark, sf)


@query(
    "P3_parse_day", "event_id:i day:d",
    f"WITH {raw.TYPED} SELECT event_id, CAST(ts AS DATE) AS day FROM typed",
)
def p3(spark, sf):
    return raw.raw_log(spark, sf).select(
        "event_id", clean.parse_day(F.col("incident_datetime")).alias("day")
    )


# A text date in one of four layouts, or none; each file of the signal has its own.
LAYOUTS = ("yyyyMMdd", "yyyy/MM/dd", "MMM d, yyyy", "yyyy-MM-dd")
LAYOUT_OF = "CASE WHEN o_orderkey % 11 = 0 THEN 'unparsed' WHEN o_orderkey % 4 = 0 THEN 'yyyyMMdd' WHEN o_orderkey % 4 = 1 THEN 'yyyy/M/d' WHEN o_orderkey % 4 = 2 THEN 'MMM d, yyyy' ELSE 'standard' END"


def dated_orders(spark, sf):
    kind = F.col("o_orderkey") % 4
    text = F.when(F.col("o_orderkey") % 11 == 0, "sometime")
    for i, layout in enumerate(LAYOUTS):
        text = text.when(kind == i, F.date_format("o_orderdate", layout))
    return table(spark, sf, "orders").select("o_orderkey", text.alias("date"))


@query(
    "P3_day_layouts", "o_orderkey:i day:d",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
)
def p3b(spark, sf):
    rows = dated_orders(spark, sf)
    return rows.select("o_orderkey", clean.parse_day_as(F.col("date"), clean.day_layouts(rows, "date")).alias("day"))


@query(
    "P3_layout_counts", "layout:s n:i",
    f"SELECT {LAYOUT_OF} AS layout, count(*) AS n FROM orders GROUP BY 1",
)
def p3c(spark, sf):
    rows = dated_orders(spark, sf).withColumn("count", F.lit(1))
    one, two = rows.where("o_orderkey % 2 = 0").select("date", "count"), rows.where("o_orderkey % 2 = 1").select("count", "date")
    return files.signal_report(spark, [_csv(one, "signal"), _csv(two, "signal", "|")])


@query(
    "S3_read_signal_dialects", "day:d n:f6",
    "SELECT CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS DOUBLE) AS n FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1",
)
def s3b(spark, sf):
    rows = dated_orders(spark, sf).withColumn("count", F.lit(1))
    one, two = rows.where("o_orderkey % 2 = 0").select("date", "count"), rows.where("o_orderkey % 2 = 1").select("count", "date")
    return signals.daily_totals(files.read_signal(spark, [_csv(one, "signal"), _csv(two, "signal", ";")]))


@query(
    "P4_tidy_text", "event_id:i code:s disposition:s special:s",
    f"WITH {raw.TYPED} SELECT event_id, code, disposition, special FROM typed",
)
def p4(spark, sf):
    return panels_typed(spark, sf).select("event_id", "code", "disposition", "special")


def panels_typed(spark, sf):
    log = raw.raw_log(spark, sf)
    return log.select(
        "event_id",
        clean.tidy_code(F.col("final_call_type")).alias("code"),
        clean.tidy_code(F.col("incident_disposition_code")).alias("disposition"),
        clean.tidy_flag(F.col("special_event_indicator")).alias("special"),
    )


@query(
    "P5_in_set", "event_id:i hit:i",
    f"WITH {raw.TYPED} SELECT event_id, CASE WHEN code IN ('EDP', 'OD') THEN 1 ELSE 0 END AS hit FROM typed",
)
def p5(spark, sf):
    return panels_typed(spark, sf).select(
        "event_id", clean.in_set(F.col("code"), fv.HIT_CODES).alias("hit")
    )


@query(
    "P6_drop_excluded", "at:s unit:i code:s",
    f"WITH {raw.TYPED} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, unit, code FROM kept",
)
def p6(spark, sf):
    kept = panels.drop_excluded(panels.type_log(raw.raw_log(spark, sf)))
    return kept.withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query(
    "P7_truncate_day", "day:d n:i",
    "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY 1",
)
def p7(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "P8_ratio", "o_orderkey:i share:f9",
    """SELECT o_orderkey, CASE WHEN count(l_orderkey) > 0 THEN
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::DOUBLE / count(l_orderkey) END AS share
       FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
)
def p8(spark, sf):
    # Lines are folded per order before the join.
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("l_returnflag") == "R").cast("int")).alias("r")
    )
    joined = table(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    return joined.withColumn("share", clean.ratio(F.col("r"), F.coalesce("n", F.lit(0))))


@query(
    "P9_resolve_columns", "day:d n:f6",
    "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1",
)
def p9(spark, sf):
    # No column with a known name: the first one is the date, each row counts 1.
    named = table(spark, sf, "orders").select(F.col("o_orderdate").alias("stamp"), "o_orderstatus")
    return signals.daily_totals(files.signal_rows(named))


@query(
    "P10_log1p", "day:d unit:i v:f9",
    f"WITH {EV} SELECT day, unit, ln(1 + hits) AS v FROM ev",
)
def p10(spark, sf):
    return event_panel(spark, sf).withColumn("v", F.log1p("hits"))


@query(
    "P11_calendar_parts", "day:d dow:i month:i year:i",
    "SELECT DISTINCT CAST(l_shipdate AS DATE) AS day, isodow(l_shipdate) - 1 AS dow, month(l_shipdate) AS month, year(l_shipdate) AS year FROM lineitem",
)
def p11(spark, sf):
    return calendar.with_calendar(_ship_days(spark, sf))


def _ship_days(spark, sf):
    return table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()


@query(
    "P12_iso_week", "day:d week:s",
    "SELECT DISTINCT CAST(l_shipdate AS DATE) AS day, isoyear(l_shipdate) || '_' || lpad(CAST(weekofyear(l_shipdate) AS VARCHAR), 2, '0') AS week FROM lineitem",
)
def p12(spark, sf):
    return _ship_days(spark, sf).withColumn("week", calendar.iso_week_key(F.col("day")))


@query(
    "P13_day_key", "key:s n:i",
    "SELECT strftime(l_shipdate, '%Y-%m-%d') AS key, count(*) AS n FROM lineitem GROUP BY 1",
)
def p13(spark, sf):
    key = calendar.day_key(F.col("l_shipdate"))
    return table(spark, sf, "lineitem").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "P14_holiday_flag", "day:d is_holiday:i",
    f"SELECT day, {holiday_sql('day')} AS is_holiday FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem) q",
)
def p14(spark, sf):
    return _ship_days(spark, sf).withColumn("is_holiday", calendar.is_federal_holiday("day"))


@query(
    "P15_period_code", "day:d period:i",
    "SELECT DISTINCT CAST(l_shipdate AS DATE) AS day, CASE WHEN l_shipdate >= '1998-03-01' AND l_shipdate < '1998-07-01' THEN 1 WHEN l_shipdate >= '1998-07-01' THEN 2 ELSE 0 END AS period FROM lineitem",
)
def p15(spark, sf):
    periods = (("1998-03-01", "1998-06-30", 1), ("1998-07-01", None, 2))
    return _ship_days(spark, sf).withColumn("period", calendar.period_code(F.col("day"), periods))


@query(
    "P16_rescale", "day:d unit:i total_100:f9",
    f"WITH {SHIP} SELECT day, unit, total / 100.0::DOUBLE AS total_100 FROM ship",
)
def p16(spark, sf):
    return ship_panel(spark, sf).withColumn("total_100", F.col("total").cast("double") / 100.0)


@query(
    "P17_period_filter", PANEL,
    f"WITH {SHIP} SELECT * FROM ship WHERE day BETWEEN DATE '1997-01-01' AND DATE '2000-12-31'",
)
def p17(spark, sf):
    # The range is put on the day column; Catalyst moves it below the join to the scan.
    return ship_panel(spark, sf).where(calendar.in_period(F.col("day"), "1997-01-01", "2000-12-31"))


@query("P18_min_total", PANEL, f"WITH {EV} SELECT * FROM ev WHERE total >= 5 AND share IS NOT NULL")
def p18(spark, sf):
    return panels.complete_share(event_panel(spark, sf))


@query(
    "P19_any_known", "day:d unit:i z_lag0:f9 z_lag28:f9",
    f"WITH {SHIPF} SELECT * FROM f WHERE coalesce(z_lag0, z_lag1, z_lag2, z_lag3, z_lag7, z_lag14, z_lag21, z_lag28) IS NOT NULL",
)
def p19(spark, sf):
    lagged = features.add_lags(
        signals.attach_signal(ship_panel(spark, sf), order_signal(spark, sf)), fv.MODEL_LAGS
    )
    return lagged.where(features.any_known(families.lag_names()))


@query(
    "P20_complete_cases", "day:d unit:i share:f9 z_lag28:f9",
    f"WITH {SHIPF} SELECT * FROM f WHERE share IS NOT NULL AND unit IS NOT NULL AND z_lag0 IS NOT NULL AND z_lag1 IS NOT NULL AND z_lag2 IS NOT NULL AND z_lag3 IS NOT NULL AND z_lag7 IS NOT NULL AND z_lag14 IS NOT NULL AND z_lag21 IS NOT NULL AND z_lag28 IS NOT NULL",
)
def p20(spark, sf):
    lagged = features.add_lags(
        signals.attach_signal(ship_panel(spark, sf), order_signal(spark, sf)), fv.MODEL_LAGS
    )
    return lagged.dropna(subset=["share", "unit", *families.lag_names()])


@query(
    "P21_threshold_flag", "day:d unit:i high_1_0sd:i high_1_5sd:i high_2_0sd:i",
    f"WITH {SHIP},{ORD} SELECT p.day, unit, CASE WHEN signal_z > 1.0 THEN 1 ELSE 0 END AS high_1_0sd, CASE WHEN signal_z > 1.5 THEN 1 ELSE 0 END AS high_1_5sd, CASE WHEN signal_z > 2.0 THEN 1 ELSE 0 END AS high_2_0sd FROM ship p LEFT JOIN sig s ON p.day = s.day",
)
def p21(spark, sf):
    return features.add_threshold_flags(
        signals.attach_signal(ship_panel(spark, sf), order_signal(spark, sf))
    )


@query(
    "P22_interactions", "day:d unit:i z_lag0_x_total:f8 z_lag7_x_total:f8 z_lag0_x_hits:f8 z_lag7_x_hits:f8",
    f"WITH {EVF} SELECT day, unit, z_lag0 * total AS z_lag0_x_total, z_lag7 * total AS z_lag7_x_total, z_lag0 * hits AS z_lag0_x_hits, z_lag7 * hits AS z_lag7_x_hits FROM f",
)
def p22(spark, sf):
    return features.add_interactions(
        event_features(spark, sf), ["z_lag0", "z_lag7"], ["total", "hits"]
    )


@query(
    "P23_unit_codes", "nation:s code:i number:i area:i unknown:i",
    "SELECT n_name AS nation, (n_regionkey + 1) * 100 + n_nationkey AS code, CASE WHEN n_nationkey = 0 THEN (n_regionkey + 1) * 100 ELSE n_nationkey END AS number, n_regionkey + 1 AS area, 0 AS unknown FROM nation",
)
def p23(spark, sf):
    n = table(spark, sf, "nation")
    area = attributes.area_code(
        raw._pick(F.col("n_regionkey"), *[F.lit(a.upper()) for a in raw.AREAS])
    )
    code = attributes.compose_code(area, F.col("n_nationkey"))
    return n.select(
        F.col("n_name").alias("nation"), code.alias("code"),
        attributes.short_number(code).alias("number"), area.alias("area"),
        attributes.area_code(F.col("n_name")).alias("unknown"),
    )


@query(
    "P24_regex_extract", "row_no:i unit:i lag:i attribute:s",
    f"""SELECT n_nationkey * {raw.SECTION_ROWS} AS row_no, (n_regionkey + 1) * 100 + n_nationkey + 1 AS unit,
          n_nationkey AS lag, 'pct_' || lower(n_name) AS attribute FROM nation""",
)
def p24(spark, sf):
    found = grid.header_code(F.col("c0"))
    rows = raw.grid(spark, sf).withColumn("unit", found).where(F.col("unit").isNotNull())
    names = table(spark, sf, "nation").select(
        (F.col("n_nationkey") * raw.SECTION_ROWS).alias("row_no"),
        F.concat(F.lit("z_lag"), F.col("n_nationkey"), F.lit("_x_pct_"), F.lower("n_name")).alias("term"),
    )
    lag, attribute = features.split_interaction(F.col("term"))
    return rows.join(names, "row_no").select(
        "row_no", "unit", lag.alias("lag"), attribute.alias("attribute")
    )


@query(
    "P25_contains", "p_partkey:i has_red:i has_steel:i",
    "SELECT p_partkey, CASE WHEN p_name ILIKE '%RED%' THEN 1 ELSE 0 END AS has_red, CASE WHEN p_type ILIKE '%steel%' THEN 1 ELSE 0 END AS has_steel FROM part",
)
def p25(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        grid.label_contains(F.col("p_name"), "RED").cast("int").alias("has_red"),
        grid.label_contains(F.col("p_type"), "steel").cast("int").alias("has_steel"),
    )


EVENT_TIME = """
ed AS (SELECT DISTINCT day AS event_day FROM j WHERE signal_z > 1.5),
et AS (SELECT d.day, max(event_day) AS event_day FROM (SELECT DISTINCT day FROM j) d
       JOIN ed ON abs(date_diff('day', event_day, d.day)) <= 14 GROUP BY 1),
jt AS (SELECT j.*, date_diff('day', et.event_day, j.day) AS event_time,
         CASE WHEN signal_z > 1.5 THEN 1 ELSE 0 END AS treated
       FROM j LEFT JOIN et ON j.day = et.day)"""
SHIPJ = f"{SHIP},{ORD}, j AS (SELECT p.*, s.signal_total, s.signal_z FROM ship p LEFT JOIN sig s ON p.day = s.day)"


def ship_signal(spark, sf):
    return signals.attach_signal(ship_panel(spark, sf), order_signal(spark, sf))


def ship_timed(spark, sf):
    rows = ship_signal(spark, sf).withColumn("treated", features.above(fv.EVENT_THRESHOLD))
    return events.attach_event_time(rows, events.event_days(rows, F.col("treated") == 1))


@query(
    "P26_offset_dummies", "offset:s n:i",
    f"""WITH {SHIPJ}, {EVENT_TIME}, t AS (SELECT unnest(range(-14, 15)) AS t)
        SELECT CASE WHEN t < 0 THEN 'event_time_m' || -t ELSE 'event_time_' || t END AS "offset",
          coalesce(sum(CASE WHEN event_time = t AND treated = 1 THEN 1 ELSE 0 END), 0) AS n
        FROM jt, t WHERE t <> -1 GROUP BY t""",
)
def p26(spark, sf):
    dummies = events.offset_dummies()
    counts = ship_timed(spark, sf).agg(*[F.sum(c).alias(n) for n, c in dummies.items()])
    return counts.unpivot([], list(dummies), "offset", "n")


@query(
    "P27_rest_and_exposure", "day:d unit:i rest:i log_exposure:f9",
    f"WITH {EV} SELECT day, unit, total - hits AS rest, ln(1 + total - hits) AS log_exposure FROM ev",
)
def p27(spark, sf):
    return event_panel(spark, sf).withColumn("rest", F.col("total") - F.col("hits")).withColumn(
        "log_exposure", F.log1p("rest")
    )


_COEF = f"WITH {EV}, c AS (SELECT unit, avg(share) AS b, CASE WHEN unit % 5 = 0 THEN 0.0 ELSE stddev_samp(share) / sqrt(count(share)) END AS se FROM ev WHERE unit IS NOT NULL GROUP BY 1)"


def _unit_coefs(spark, sf):
    se = F.when(F.col("unit") % 5 == 0, 0.0).otherwise(
        F.stddev_samp("share") / F.sqrt(F.count("share"))
    )
    return event_panel(spark, sf).where("unit is not null").groupBy("unit").agg(
        F.avg("share").alias("b"), se.alias("se")
    )


@query(
    "P28_intervals", "unit:i b:f9 ci_low:f9 ci_hi:f9 t:f6 sig:s",
    _COEF + " SELECT unit, b, b - 1.96 * se AS ci_low, b + 1.96 * se AS ci_hi, CASE WHEN se > 0 THEN b / se END AS t, CASE WHEN se > 0 AND abs(b / se) > 1.96 THEN 'Yes' ELSE 'No' END AS sig FROM c",
)
def p28(spark, sf):
    b, se = F.col("b"), F.col("se")
    return _unit_coefs(spark, sf).select(
        "unit", "b", inference.ci_low(b, se).alias("ci_low"), inference.ci_high(b, se).alias("ci_hi"),
        inference.t_stat(b, se).alias("t"), inference.significant(b, se).alias("sig"),
    )


@query(
    "P29_usable_se", "unit:i se:f9",
    _COEF + " SELECT unit, CASE WHEN se > 0 THEN se END AS se FROM c",
)
def p29(spark, sf):
    return _unit_coefs(spark, sf).withColumn("se", inference.usable_se(F.col("se")))


@query(
    "P30_trim_tails", "o_orderkey:i o_totalprice:f2",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN (SELECT quantile_cont(o_totalprice, 0.01) FROM orders) AND (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)",
)
def p30(spark, sf):
    return quantiles.trim_tails(table(spark, sf, "orders"), "o_totalprice")


@query(
    "P31_rescale_report", "year:i millions:f9 pct:f7",
    f"WITH {SHIP} SELECT year(day) AS year, sum(total) / 1e6 AS millions, sum(hits)::DOUBLE / sum(total) * 100 AS pct FROM ship GROUP BY 1",
)
def p31(spark, sf):
    years = panels.year_summary(panels.day_summary(ship_panel(spark, sf)))
    return years.select(
        "year", (F.col("total_sum") / 1e6).alias("millions"), (F.col("share_overall") * 100).alias("pct")
    )


@query(
    "P32_ensure_columns", "day:d unit:i share:f9 log_hits:f9",
    f"WITH {EV} SELECT day, unit, share, ln(1 + hits) AS log_hits FROM ev",
)
def p32(spark, sf):
    # share exists and stays as it is, log_hits is added
    return features.ensure_columns(
        event_panel(spark, sf), {"share": F.lit(-1.0), "log_hits": F.log1p("hits")}
    )
