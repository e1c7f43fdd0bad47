import os
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from panelwright import session
from panelwright.functions import calendar
from panelwright.operators import grid, profile


def fake(master):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda *_: None),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None),
    )


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://https://host"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(RuntimeError):
        session.shared_dir(fake(master))


def test_local_sessions_use_a_temporary_folder_and_set_nothing(spark):
    assert os.path.isdir(session.shared_dir(fake("local[4]"))) and os.path.isdir(session.shared_dir(fake("local")))
    before = spark.sparkContext.getCheckpointDir()
    session.settle(spark.range(3)).count()
    assert spark.sparkContext.getCheckpointDir() == before


def test_settled_tables_are_removed(spark):
    session.release(spark)
    paths = [session.settle(spark.range(n), "gone").inputFiles()[0] for n in (3, 4)]
    assert session.release(spark) == 2
    assert not any(os.path.exists(p.removeprefix("file://")) for p in paths)


def test_release_can_keep_the_latest(spark):
    outer, first, last = (session.settle(spark.range(n), "t") for n in (2, 3, 4))
    since, place = session.settled() - 2, first.inputFiles()[0]
    assert session.release(spark, since, keep=1) == 1 and session.settled() == since + 1
    assert outer.count() == 2 and last.count() == 4
    assert not Path(place.removeprefix("file://")).exists()


def sheet(spark, n):
    rows = [(0, "Bronx Community District 1"), *[(k, f"row {k}") for k in range(1, n)], (n, "Queens Community District 2"), (n + 4, "last")]
    return spark.createDataFrame([(r, c, *[None] * 10) for r, c in rows], "row_no bigint, " + ", ".join(f"c{i} string" for i in range(11)))


def test_long_sections_are_kept_whole(spark):
    rows = grid.sections(sheet(spark, 405))
    assert rows.where("unit = 201").count() == 401 and rows.where("unit = 402").count() == 1
    assert grid.sections(sheet(spark, 405), cap=300).where("unit = 201").count() == 300


def test_holidays_of_any_year(spark):
    days = {str(r.day) for r in calendar.holiday_dates(spark, "1985-01-01", "2035-12-31").collect()}
    assert {"1985-07-04", "2035-12-25", "2035-07-04"} <= days


def test_sampling_does_not_depend_on_order(spark):
    df = spark.range(2000)
    a = {r.id for r in profile.sample_rows(df, 0.25, ("id",)).collect()}
    b = {r.id for r in profile.sample_rows(df.orderBy(F.desc("id")).repartition(7), 0.25, ("id",)).collect()}
    assert a == b and 400 < len(a) < 600
    assert a != {r.id for r in profile.sample_rows(df, 0.25, ("id",), seed=1).collect()}


def test_scope_removes_only_what_was_settled_inside(spark):
    outer = session.settle(spark.range(3), "outer")
    with session.scope(spark):
        inner = session.settle(spark.range(4), "inner")
        assert inner.count() == 4
        place = inner.inputFiles()[0]
    assert outer.count() == 3
    assert not Path(place.removeprefix("file://")).exists()


def test_features_of_a_stored_panel_shuffle_nothing(spark, sf):
    from panelwright.plans import q_sources

    plan = q_sources.stored_features(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan
