"""Registered queries against their SQL: operators at the smallest scale, some
models where every stratum has enough rows (``check.py`` runs all of them)."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from check import TABLES, canonical
from panelwright.plans import catalog

CHECKS = driver.oracle_sql()
MODELS = [
    "J12_coefs_with_errors", "M7_nested_models", "M13_threshold_lags", "M15_did",
    "M25_unit_and_day_effects", "M26_unit_and_week_effects",
]
OPERATORS = [n for n in catalog() if not n.startswith("M") and n not in MODELS]


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", OPERATORS + MODELS)
def test_query(spark, sf, name):
    if name in MODELS:
        sf = sf.replace("sf0.001", "sf0.01")
    con = connect(sf)
    df = driver.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name not in CHECKS:
        assert rows
        return
    cur = con.execute(CHECKS[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(df.columns, rows) == canonical(names, cur.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_names_follow_the_inventory():
    prefixes = {n.split("_")[0] for n in driver.queries()}
    wanted = (
        [f"S{i}" for i in range(1, 9)] + [f"P{i}" for i in range(1, 33)] + [f"J{i}" for i in range(1, 14)]
        + [f"A{i}" for i in range(1, 29)] + [f"W{i}" for i in range(1, 13)] + [f"K{i}" for i in range(1, 6)]
        + [f"U{i}" for i in range(1, 6)] + [f"M{i}" for i in range(1, 34)]
    )
    assert set(wanted) <= prefixes
