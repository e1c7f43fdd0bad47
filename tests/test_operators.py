"""Edge cases, one small literal frame each."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelwright import fixed_values as fv
from panelwright.functions import calendar, clean, inference
from panelwright.operators import attributes, events, features, grid, panel, profile, quantiles, signal
from panelwright.session import scratch_path, settle, shared_dir
from panelwright.sources import files

D = dt.date


def column(df, name, order):
    return [r[name] for r in df.orderBy(order).collect()]


def test_timestamp_layouts(spark):
    texts = ["2020-01-02 03:04:05", "2020-01-02T03:04:05", "1/2/2020 3:04:05", "01/02/2020 03:04:05 PM", "junk", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = column(df.withColumn("ts", clean.parse_timestamp(F.col("t"))), "ts", "i")
    am, pm = dt.datetime(2020, 1, 2, 3, 4, 5), dt.datetime(2020, 1, 2, 15, 4, 5)
    assert got == [am, am, am, pm, None, None]


def test_times_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        texts = ["2020-03-08 02:30:00", "3/8/2020 2:30:00 AM", "2020-11-01T01:30:00", "2020-13-01 00:00:00"]
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        got = column(df.withColumn("ts", clean.parse_timestamp(F.col("t")).cast("string")), "ts", "i")
        assert got == ["2020-03-08 02:30:00", "2020-03-08 02:30:00", "2020-11-01 01:30:00", None]
        dates = spark.createDataFrame([(0, "3/8/2020"), (1, "2020-03-08"), (2, "x")], "i int, t string")
        assert column(dates.withColumn("d", clean.parse_day(F.col("t"))), "d", "i") == [D(2020, 3, 8)] * 2 + [None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_integer_casts(spark):
    texts = ["87", " 87 ", "87.0", "3.6", "1e2", "x", "1d", "NaN", "99999999999", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = column(df.withColumn("n", clean.to_int(F.col("t"))), "n", "i")
    assert got == [87, 87, 87, 4, 100, None, None, None, None, None]


LOG = {
    "incident_datetime": "2020-01-02 03:04:05", "communitydistrict": "101", "final_call_type": "EDP",
    "incident_disposition_code": "93", "special_event_indicator": "N", "standby_indicator": None,
    "transfer_indicator": "",
}


def log(spark, **changes):
    rows = [LOG | {k: v} for k, values in changes.items() for v in values]
    schema = ", ".join(f"{c} string" for c in fv.LOG_COLUMNS)
    return spark.createDataFrame([tuple(r[c] for c in fv.LOG_COLUMNS) for r in rows], schema)


@pytest.mark.parametrize("flag", ["special_event_indicator", "standby_indicator", "transfer_indicator"])
def test_exclusion_flags(spark, flag):
    raw = log(spark, **{flag: ["y", " YES ", "true", "1", "N", "", None]})
    assert panel.panel_from_log(raw).first()["total"] == 3


def test_excluded_dispositions(spark):
    raw = log(spark, incident_disposition_code=["cancel", "NOTSNT", "DUP", "87", "87.0", "93", None])
    assert panel.panel_from_log(raw).first()["total"] == 2


def test_unparsed_time_is_dropped_and_unknown_code_is_no_hit(spark):
    raw = log(spark, incident_datetime=["junk", "2020-01-02 00:00:00"], final_call_type=[None, " edp "])
    row = panel.panel_from_log(raw).first()
    # second time row and the hit row are EDP, the NULL code is not a hit
    assert (row["total"], row["hits"], row["day"]) == (3, 2, D(2020, 1, 2))


def small_panel(spark):
    """Unit 1 on days 1, 2, 5; no unit on days 1 and 2."""
    rows = [
        (D(2020, 1, 1), 1, 10, 1, 0.1), (D(2020, 1, 2), 1, 10, 2, 0.2), (D(2020, 1, 5), 1, 10, 6, 0.6),
        (D(2020, 1, 1), None, 4, 1, 0.25), (D(2020, 1, 2), None, 4, 3, 0.75),
    ]
    return spark.createDataFrame(rows, "day date, unit int, total bigint, hits bigint, share double")


def test_unknown_unit(spark):
    p = small_panel(spark).withColumn("signal_z", F.dayofmonth("day").cast("double")).withColumn("signal_total", F.lit(1.0))
    f = features.add_rolling(features.add_lags(p, (0, 1)))
    unknown = f.where("unit is null").orderBy("day").collect()
    assert [r["z_lag0"] for r in unknown] == [1.0, 2.0]
    assert [r["z_lag1"] for r in unknown] == [None, None]
    assert [r["hits_roll3"] for r in unknown] == [None, None]
    assert panel.unit_summary(p).count() == 1
    days = {r["day"]: r for r in panel.day_summary(p).collect()}
    assert days[D(2020, 1, 1)]["total"] == 14 and days[D(2020, 1, 1)]["n_units"] == 1


def test_lags_count_observed_rows(spark):
    p = small_panel(spark).withColumn("signal_z", F.dayofmonth("day").cast("double"))
    rows = features.add_lags(p, (1,)).where("unit = 1")
    assert column(rows, "z_lag1", "day") == [None, 1.0, 2.0]
    rows = features.add_lags(p, (1,), calendar_days=True).where("unit = 1")
    assert column(rows, "z_lag1", "day") == [None, 1.0, None]


def test_rolling_ends(spark):
    p = small_panel(spark).withColumn("signal_total", F.lit(1.0))
    rows = features.add_rolling(p).where("unit = 1")
    assert column(rows, "hits_roll3", "day") == pytest.approx([1.5, 3.0, 4.0])


def test_population_and_sample_deviation(spark):
    days = spark.createDataFrame([(D(2020, 1, i), float(v)) for i, v in ((1, 1), (2, 2), (3, 6))], "day date, signal_total double")
    z = column(signal.zscore(days), "signal_z", "day")
    sd = math.sqrt(((1 - 3) ** 2 + (2 - 3) ** 2 + (6 - 3) ** 2) / 3)
    assert z == pytest.approx([-2 / sd, -1 / sd, 3 / sd])


def test_two_series(spark):
    a = spark.createDataFrame([(D(2020, 1, 1), 2.0), (D(2020, 1, 2), None)], "day date, n double")
    b = spark.createDataFrame([(D(2020, 1, 3), 4.0), (D(2020, 1, 1), 1.0)], "day date, n double")
    assert column(signal.combine_daily(a, b), "signal_total", "day") == [3.0, 0.0, 4.0]


def test_overlapping_events(spark):
    first = D(2020, 1, 1)
    ev = spark.createDataFrame([(first + dt.timedelta(k),) for k in (10, 12, 30)], "event_day date")
    times = {(r["day"] - first).days: r["event_time"] for r in events.event_time(ev).collect()}
    assert times[10] == -2 and times[12] == 0 and times[30] == 0
    assert times[15] == 3 and times[16] == -14 and times[44] == 14 and 45 not in times and -5 not in times
    assert all(-14 <= t <= 14 for t in times.values())


def test_windows_repeat_rows(spark):
    p = small_panel(spark)
    ev = spark.createDataFrame([(D(2020, 1, 2),), (D(2020, 1, 4),)], "event_day date")
    assert events.attach_windows(p, ev, 1).count() == 2 + 2 + 1


def test_profile_pools_like_rows(spark):
    p = small_panel(spark).withColumn("log_hits_roll3", F.log1p("hits"))
    ev = spark.createDataFrame([(D(2020, 1, 2),), (D(2020, 1, 1),)], "event_day date")
    got = {r["days_from_event"]: r for r in events.event_profile(p, ev).collect()}
    rows = events.attach_windows(p, ev).groupBy("days_from_event").agg(
        F.avg("log_hits_roll3").alias("m"), F.stddev_samp("log_hits_roll3").alias("s"), F.count("share").alias("n")
    )
    for r in rows.collect():
        g = got[r["days_from_event"]]
        assert g["n_obs"] == r["n"] and g["log_hits_mean"] == pytest.approx(r["m"])
        assert g["log_hits_std"] == (pytest.approx(r["s"]) if r["s"] is not None else None)


def test_unknown_signal_is_not_high(spark):
    df = spark.createDataFrame([(1, None), (2, 1.5), (3, 1.6)], "i int, signal_z double")
    assert column(df.withColumn("f", features.above(1.5)), "f", "i") == [0, 0, 1]


def test_quantile_ties(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 1, 1, 2, 3)], "v double")
    edges = quantiles.quantile_edges(df, "v", 4)
    with pytest.raises(ValueError, match="not unique"):
        quantiles.bucket(F.col("v"), edges, fv.QUARTILE_LABELS)
    merged = df.withColumn("b", quantiles.bucket(F.col("v"), edges, fv.QUARTILE_LABELS, merge=True))
    assert column(merged, "b", "v") == ["1", "1", "1", "1", "2", "2"]


def test_quantile_buckets(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5)], "v double")
    edges = quantiles.quantile_edges(df, "v", 4)
    got = df.withColumn("b", quantiles.bucket(F.col("v"), edges, fv.QUARTILE_LABELS))
    assert column(got, "b", "v") == ["Q1", "Q1", "Q2", "Q3", "Q4"]


@pytest.mark.parametrize("bins,gather", [(2, 1), (7, 3), (1024, 4096)])
def test_selected_quantiles_are_exact(spark, monkeypatch, bins, gather):
    import random

    monkeypatch.setattr(quantiles.select_quantiles, "__defaults__", (bins, gather))
    rng = random.Random(3)
    data = [(rng.choice([rng.gauss(0, 1), 0.5, -2.0, 1e300, -1e-300, 0.0]), float(i % 3) if i % 5 else None) for i in range(401)]
    df = spark.createDataFrame(data, "a double, b double")
    probs = [0.0, 0.01, 0.3, 0.5, 0.77, 1.0]
    exact = {(r[0], r[1]): r[2] for r in quantiles.exact_quantiles(df, ["a", "b"], probs).collect()}
    far = {(r[0], r[1]): r[2] for r in quantiles.exact_quantiles(df, ["a", "b"], probs, max_distinct=0).collect()}
    assert far == pytest.approx(exact)
    tiny = spark.createDataFrame([(1.0,), (5.0,)], "a double")
    assert quantiles.exact_quantiles(tiny, ["a"], [0.3], max_distinct=0).first()["quantile"] == pytest.approx(2.2)
    none = spark.createDataFrame([(None,)], "a double")
    assert quantiles.exact_quantiles(none, ["a"], [0.3], max_distinct=0).count() == 0


def test_rows_of_a_key_are_bounded_in_every_pass(spark, monkeypatch):
    seen = []
    fold = quantiles.fold

    def counted(values, by, slot):
        out = fold(values, by, slot)
        seen.append(out.groupBy(*by).count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(quantiles, "fold", counted)
    df = spark.range(60_000).select(F.lit("k").alias("k"), (F.col("id") / 7 + 1000).alias("value"))
    got = quantiles.select_quantiles(df, ["k"], [0.5], bins=50, gather=20).first()
    assert got["quantile"] == pytest.approx(59_999 / 14 + 1000)
    assert len(seen) >= 3 and max(seen) <= 50
    plan = quantiles.select_quantiles(df, ["k"], [0.5])._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_box_stats_of_many_groups_of_any_type(spark):
    import numpy as np

    rows = spark.range(60_000).select((F.col("id") % 5003).cast("int").alias("n"), (F.pmod(F.hash("id"), F.lit(1000)) / 3).alias("q1"))
    stats = profile.box_stats(rows.withColumnRenamed("n", "key"), "key", "q1").collect()
    by = {}
    for r in rows.collect():
        by.setdefault(r[0], []).append(r[1])
    assert len(stats) == 5003
    for r in stats[::50]:
        assert (r["q1"], r["median"], r["q3"]) == pytest.approx(tuple(np.percentile(by[r["key"]], [25, 50, 75])))
    mixed = spark.createDataFrame([("a", 1.0), ("A", 3.0), ("a", 2.0), (None, 9.0), ("x.y", None), ("x.y", 4.0)], "g string, v double")
    assert {(r["g"], r["median"], r["n"]) for r in profile.box_stats(mixed, "g", "v").collect()} == {("a", 1.5, 2), ("A", 3.0, 1), ("x.y", 4.0, 1)}


def holidays(spark, first, last):
    return column(calendar.holiday_dates(spark, first, last), "day", "day")


def test_observed_holidays(spark):
    assert D(1994, 12, 26) in holidays(spark, "1994-12-01", "1994-12-31")
    assert holidays(spark, "2010-12-20", "2011-01-10") == [D(2010, 12, 24), D(2010, 12, 31)]
    assert holidays(spark, "2021-06-01", "2021-07-10") == [D(2021, 6, 18), D(2021, 7, 5)]
    assert holidays(spark, "2020-06-01", "2020-07-10") == [D(2020, 7, 3)]
    assert len(holidays(spark, "2023-01-01", "2023-12-31")) == 11
    assert D(1985, 1, 21) not in holidays(spark, "1985-01-01", "1985-02-01")


def test_calendar_parts(spark):
    row = calendar.calendar_table(spark, "2020-12-28", "2020-12-28").withColumn("w", calendar.iso_week_key(F.col("day"))).first()
    assert (row["dow"], row["month"], row["year"], row["period"], row["w"]) == (0, 12, 2020, 2, "2020_53")
    row = calendar.calendar_table(spark, "2021-01-03", "2021-01-03").withColumn("w", calendar.iso_week_key(F.col("day"))).first()
    assert row["w"] == "2020_53"


def test_periods(spark):
    days = calendar.calendar_table(spark, "2020-02-28", "2020-07-02").groupBy("period").count()
    assert {r["period"]: r["count"] for r in days.collect()} == {0: 2, 1: 122, 2: 2}


def sheet(spark):
    def row(i, c0, c7=None, c8=None, c1=None):
        return (i, c0, c1, None, None, None, None, None, c7, c8, None, None)

    rows = [
        row(0, "Title"), row(1, "BRONX community district 3"), row(4, "Total Population", "9"),
        row(5, "Total Population", "100", "1"), row(6, "total population in homes", "7"),
        row(7, "White Nonhispanic", "1", "12.5"), row(8, "Asian and Pacific", c1="Islander Nonhispanic", c8="3.5"),
        row(9, "Median age", "35"), row(10, "Household income", "50000"), row(11, "Below poverty", "1", "101"),
        row(12, "Poverty rate", "1", "11"),
        row(400, "Owner occupied", "1", "50"),
        row(500, "Staten Island Community District 2"), row(504, "Hispanic Origin", "1", "8"),
    ]
    schema = "row_no bigint, " + ", ".join(f"c{i} string" for i in range(11))
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("legacy, income", [(False, 50000.0), (True, 35.0)])
def test_sheet(spark, legacy, income):
    got = {r["unit"]: r for r in grid.parse_grid(sheet(spark), legacy=legacy).collect()}
    assert set(got) == {203, 502}
    bronx = got[203]
    assert bronx["total_population"] == 100.0  # row 4 is above the section's data, row 6 comes later
    assert (bronx["pct_white"], bronx["pct_asian"], bronx["pct_poverty"]) == (12.5, 3.5, 11.0)
    assert bronx["median_income"] == income and bronx["cd_number"] == 3
    assert bronx["pct_owner_occupied"] == 50.0  # a section ends at the next header, however long
    capped = {r["unit"]: r for r in grid.parse_grid(sheet(spark), legacy=legacy, cap=300).collect()}
    assert capped[203]["pct_owner_occupied"] is None and capped[203]["pct_white"] == 12.5
    assert got[502]["pct_hispanic"] == 8.0 and got[502]["total_population"] is None


@pytest.mark.parametrize("block", [1, 3, 10_000])
def test_carry_down_over_blocks(spark, block):
    df = spark.createDataFrame([(i, 7 if i == 2 else 9 if i == 8 else None) for i in range(12)], "row_no bigint, v int")
    got = column(grid.carry_down(df, "v", "unit", block=block), "unit", "row_no")
    assert got == [None, None] + [7] * 6 + [9] * 4


def test_unit_codes(spark):
    df = spark.createDataFrame([("staten ISLAND", 3), ("Nowhere", 4)], "a string, n int")
    codes = column(df.withColumn("c", attributes.compose_code(attributes.area_code(F.col("a")), F.col("n"))), "c", "n")
    assert codes == [503, 4]
    df = spark.createDataFrame([(503,), (500,), (7,)], "c int").withColumn("s", attributes.short_number(F.col("c")))
    assert column(df, "s", "c") == [7, 500, 3]


def test_attribute_keys(spark):
    p = small_panel(spark)
    attrs = spark.createDataFrame([(1, 501, 1, 4.0), (2, 502, 2, 5.0)], "unit int, cd_code int, cd_number int, total double")
    by_number = attributes.match_attributes(p, attrs)
    assert by_number.where("attr_unit is not null").count() == 3
    assert by_number.count() == 5 and "total_attr" in by_number.columns
    by_code = attributes.match_attributes(p.withColumn("unit", F.col("unit") + 500), attrs)
    assert {r["attr_unit"] for r in by_code.collect()} == {501, None}


def test_overlap(spark):
    left = spark.createDataFrame([(1,), (2,), (2,), (None,)], "unit int")
    right = spark.createDataFrame([(2,), (3,)], "unit int")
    got = {r["key"]: r["found_in"] for r in attributes.key_overlap(left, right).collect()}
    assert got == {1: "left_only", 2: "common", 3: "right_only"}


def test_demeaned_values_average_to_zero(spark):
    p = small_panel(spark).withColumn("dow", F.lit(0))
    d = features.demean(p)
    assert d.where("unit = 1").agg(F.avg("share_dm")).first()[0] == pytest.approx(0.0)
    assert d.where("unit is null and share_dm is not null").count() == 0


def test_csv_drops_bad_rows_and_keeps_text(spark):
    path = scratch_path(spark, "csv")
    text = "Date , Count\n2020-01-01,3\n2020-01-01,x\n2020-01-02,4,9,9\n2020-01-03,\n"
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.text(path)
    got = {r["day"]: r["n"] for r in signal.daily_totals(files.read_signal(spark, path)).collect()}
    assert got == {D(2020, 1, 1): 3.0, D(2020, 1, 3): 0.0}


def test_signal_names():
    assert files.resolve_signal_columns(["x", "day", "tweets"]) == ("day", "tweets")
    assert files.resolve_signal_columns(["stamp", "text"]) == ("stamp", None)


def test_intervals(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, 1.0, 0.0), (3, 1.0, float("nan")), (4, 1.0, 1.0)], "i int, b double, se double")
    b, se = F.col("b"), F.col("se")
    got = df.select("i", inference.t_stat(b, se).alias("t"), inference.significant(b, se).alias("s")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(2.0, "Yes"), (None, "No"), (None, "No"), (1.0, "No")]
    assert inference.normal_p_value(1.959963985) == pytest.approx(0.05, abs=1e-9)


def test_threshold_without_events_keeps_its_row(spark):
    days = spark.createDataFrame([(D(2020, 1, 1), 0.5), (D(2020, 1, 2), 1.2)], "day date, signal_z double")
    got = {r["threshold"]: r for r in events.threshold_table(days).collect()}
    assert got[2.0]["n_days"] == 0 and got[2.0]["top_day"] is None
    assert got[1.0]["top_day"] == D(2020, 1, 2) and got[1.0]["pct_days"] == 50.0


def test_settled_table_is_a_scan_with_a_size(spark):
    df = settle(spark.range(10).toDF("x"), "t", files=1)
    plan = df._jdf.queryExecution().optimizedPlan()
    assert int(str(plan.stats().sizeInBytes())) < 100_000
    assert df.inputFiles()[0].removeprefix("file://").startswith(shared_dir(spark).removeprefix("file:"))


def test_histogram_covers_all_rows(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    rows = profile.histogram(df, "v", 10).collect()
    assert sum(r["n"] for r in rows) == 101 and {r["bin"] for r in rows} == set(range(10))


def test_profile_keeps_the_spread_of_large_values(spark):
    rows = [(D(2020, 1, 1), 1e9 + k % 2, 0.5) for k in range(1000)] + [(D(2020, 1, 2), 3.0, None)]
    panel = spark.createDataFrame(rows, "day date, log_hits_roll3 double, share double")
    days = spark.createDataFrame([(D(2020, 1, 1),), (D(2020, 1, 2),)], "event_day date")
    got = {r["days_from_event"]: r for r in events.event_profile(panel, days, 1).collect()}
    assert got[-1]["log_hits_std"] == pytest.approx(0.5002502, rel=1e-6) and got[-1]["n_obs"] == 1000
    assert got[0]["n_obs"] == 1001 and got[1]["share_mean"] is None


def test_sample_of_exactly_n_rows(spark):
    import hashlib

    df = spark.range(5000).repartition(7)
    drawn = sorted(range(5000), key=lambda k: hashlib.md5(f"42/{k}".encode()).hexdigest()[:15])
    for n in (0, 1, 37, 2500, 5000, 9000):
        assert sorted(r["id"] for r in profile.sample_n(df, n, ["id"]).collect()) == sorted(drawn[:n])
    same = spark.createDataFrame([(None,)] * 50 + [(k,) for k in range(3)], "id int")
    assert profile.sample_n(same, 20, ["id"]).count() == 20


def test_files_of_different_order_and_delimiter(spark, tmp_path):
    from panelwright.sources import files

    (tmp_path / "a one.csv").write_text("date,count\n2020-01-02,3\n20200103,4\n")
    (tmp_path / "b.csv").write_text('﻿Count ; "Date"\n5;"Jan 2, 2020"\n6;soon\n7;03/01/2020\n1;25/01/2020\n')
    (tmp_path / "c.csv").write_text("day\n2020/01/02\n")
    (tmp_path / "d.csv").write_text("")
    got = {r["day"]: r["n"] for r in signal.daily_totals(files.read_signal(spark, str(tmp_path))).collect()}
    assert got == {D(2020, 1, 2): 9.0, D(2020, 1, 3): 11.0, D(2020, 1, 25): 1.0}
    report = {r["layout"]: r["n"] for r in files.signal_report(spark, str(tmp_path)).collect()}
    assert report == {"standard": 1, "yyyyMMdd": 1, "MMM d, yyyy": 1, "unparsed": 1, "d/M/yyyy": 2, "yyyy/M/d": 1}
    with pytest.raises(ValueError, match="no column"):
        files.read_log(spark, str(tmp_path / "b.csv"), ["count", "place"])
    assert files.dialect_of(["a|b;c|d", "1|2;3|4"]).delimiter == "|"
    assert files.dialect_of(["only"]).names == ("only",)
