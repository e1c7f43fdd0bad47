"""Messy text versions of the driver tables, in Spark and in SQL.

The tables are typed; cleaning operators need strings in several layouts.  Both
sides derive the same strings from every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelwright.plans.base import ATTRS, nation_attributes, table

AREAS = ("Manhattan", "Bronx", "Brooklyn", "Queens", "Staten Island")
SECTION_ROWS = 40


def _pick(key, *choices):
    """Choice number ``key`` of a list of columns."""
    out = F.when(key == 0, choices[0])
    for i, c in enumerate(choices[1:], 1):
        out = out.when(key == i, c)
    return out


def _pick_sql(key: str, *choices: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} = {i} THEN {c}" for i, c in enumerate(choices)) + " END"


def raw_log(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    ts = F.col("ts")
    unit = F.col("user_id") % 25
    text = unit.cast("string")
    none = F.lit(None).cast("string")
    flags = [F.lit("y"), F.lit(" YES "), F.lit("N"), F.lit(""), none, F.lit("true"), F.lit("0")]
    return table(spark, sf_dir, "events").select(
        "event_id",
        _pick(
            e % 5,
            F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
            F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
            F.date_format(ts, "M/d/yyyy H:m:s"),
            F.date_format(ts, "MM/dd/yyyy hh:mm:ss a"),
            F.lit("not a time"),
        ).alias("incident_datetime"),
        _pick(
            e % 6, text, F.concat(F.lit(" "), text, F.lit(" ")), F.concat(text, F.lit(".0")),
            F.concat(text, F.lit(".6")), F.lit("x"), none,
        ).alias("communitydistrict"),
        F.when(F.col("event_type") == "error", " edp ")
        .when(F.col("event_type") == "view", "OD")
        .when(F.col("event_type") == "click", "sick")
        .when(F.col("event_type") == "purchase", "Inj")
        .alias("final_call_type"),
        _pick(
            e % 8, F.lit("cancel"), F.lit("87"), F.lit("87.0"), none, F.lit("DUP "),
            F.lit("93"), F.lit("82"), F.lit("1e2"),
        ).alias("incident_disposition_code"),
        _pick(F.floor(e / 3) % 7, *flags).alias("special_event_indicator"),
        _pick(F.floor(e / 5) % 7, *flags).alias("standby_indicator"),
        _pick(F.floor(e / 7) % 7, *flags).alias("transfer_indicator"),
    )


_FLAGS = ["'y'", "' YES '", "'N'", "''", "NULL", "'true'", "'0'"]
RAW = f"""
raw AS (
  SELECT event_id,
    {_pick_sql('event_id % 5', "strftime(ts, '%Y-%m-%d %H:%M:%S')", "strftime(ts, '%Y-%m-%dT%H:%M:%S')",
               "strftime(ts, '%-m/%-d/%Y %-H:%-M:%-S')", "strftime(ts, '%m/%d/%Y %I:%M:%S %p')",
               "'not a time'")} AS incident_datetime,
    {_pick_sql('event_id % 6', "CAST(user_id % 25 AS VARCHAR)", "' ' || (user_id % 25) || ' '",
               "(user_id % 25) || '.0'", "(user_id % 25) || '.6'", "'x'", "NULL")} AS communitydistrict,
    CASE event_type WHEN 'error' THEN ' edp ' WHEN 'view' THEN 'OD' WHEN 'click' THEN 'sick'
                    WHEN 'purchase' THEN 'Inj' END AS final_call_type,
    {_pick_sql('event_id % 8', "'cancel'", "'87'", "'87.0'", "NULL", "'DUP '", "'93'", "'82'", "'1e2'")}
      AS incident_disposition_code,
    {_pick_sql('(event_id // 3) % 7', *_FLAGS)} AS special_event_indicator,
    {_pick_sql('(event_id // 5) % 7', *_FLAGS)} AS standby_indicator,
    {_pick_sql('(event_id // 7) % 7', *_FLAGS)} AS transfer_indicator
  FROM events)"""

# What the strings stand for, told from the picks that made them and never by
# reading the strings again: which layout is no time, which unit rounds up, which
# flags say yes, which dispositions void the event.
_SAYS = ["'Y'", "'YES'", "'N'", "NULL", "NULL", "'TRUE'", "'0'"]
_PICKED = {"special": "(event_id // 3) % 7", "standby": "(event_id // 5) % 7", "transfer": "(event_id // 7) % 7"}
TYPED = RAW + f""",
typed AS (
  SELECT event_id,
    CASE WHEN event_id % 5 < 4 THEN date_trunc('second', ts) END AS ts,
    CASE WHEN event_id % 6 < 3 THEN user_id % 25 WHEN event_id % 6 = 3 THEN user_id % 25 + 1 END AS unit,
    {_pick_sql("list_position(['error', 'view', 'click', 'purchase'], event_type) - 1", "'EDP'", "'OD'", "'SICK'", "'INJ'")} AS code,
    {_pick_sql('event_id % 8', "'CANCEL'", "'87'", "'87.0'", "NULL", "'DUP'", "'93'", "'82'", "'1E2'")} AS disposition,
    {_pick_sql('event_id % 8', "NULL", "87", "87", "NULL", "NULL", "93", "82", "100")} AS disposition_no,
    {", ".join(f"{_pick_sql(key, *_SAYS)} AS {name}" for name, key in _PICKED.items())}
  FROM events),
kept AS (
  SELECT * FROM typed
  WHERE event_id % 5 < 4 AND event_id % 8 IN (3, 5, 6, 7)
    AND {" AND ".join(f"{key} IN (2, 3, 4, 6)" for key in _PICKED.values())})"""


# -- sectioned sheet: one section per nation ---------------------------------

# (label, cell, value column); the last row repeats a label of the first.
GRID_ROWS = (
    ("Total Population", "c7", "total_population"),
    ("White Nonhispanic", "c8", ATTRS[0]),
    ("Black Nonhispanic", "c8", ATTRS[1]),
    ("Hispanic Origin (of any race)", "c8", ATTRS[2]),
    ("Asian and Pacific Islander Nonhispanic", "c8", ATTRS[3]),
    ("Total Households", "c7", "total_population"),
    ("Owner occupied units", "c8", ATTRS[1]),
    ("Renter occupied units", "c8", ATTRS[0]),
    ("Median age", "c7", ATTRS[0]),
    ("Median household INCOME", "c7", "total_population"),
    ("Bachelor's degree or higher", "c8", ATTRS[2]),
    ("Below poverty level", "c8", ATTRS[3]),
    ("Total population in households", "c7", ATTRS[0]),
)


def grid(spark, sf_dir) -> DataFrame:
    """Sheet rows ``row_no, c0 .. c10`` out of nation and customer."""
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("area")
    )
    facts = nations.join(nation_attributes(spark, sf_dir).drop("cd_code"), "unit")
    name = F.concat(
        _pick(F.col("area"), *[F.lit(a) for a in AREAS]),
        F.lit(" Community District "), (F.col("unit") + 1).cast("string"),
    )
    none = F.lit(None).cast("string")

    def row(offset, label, cell=None, value=None):
        cells = {f"c{i}": none for i in range(11)} | {"c0": label}
        if cell:
            cells[cell] = F.col(value).cast("double").cast("string")
        return F.struct(
            F.lit(offset).alias("offset"), *[c.alias(n) for n, c in cells.items()]
        )

    rows = [row(0, name), row(1, none), row(2, none), row(3, F.lit("Number"))]
    rows += [row(4 + i, F.lit(l), c, v) for i, (l, c, v) in enumerate(GRID_ROWS)]
    out = facts.select("unit", F.explode(F.array(*rows)).alias("r"))
    return out.select(
        (F.col("unit").cast("bigint") * SECTION_ROWS + F.col("r.offset")).alias("row_no"),
        *[F.col(f"r.c{i}").alias(f"c{i}") for i in range(11)],
    )
