"""Query registry: a Spark callable, its output columns and its check in SQL.

Output columns are declared once (``"day:d unit:i share:f8"``); both sides are
projected through that declaration, so names and types agree.  Kinds: ``i``
bigint, ``s`` string, ``d`` date as ISO text, ``fN`` double rounded to N digits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright import fixed_values as fv
from panelwright.operators import features, panel as panels, signal as signals
from panelwright.session import settle

MIN_TOTAL = 2  # volume filter for the shipment panel


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _columns(outputs: str) -> list[tuple[str, str]]:
    return [tuple(part.rsplit(":", 1)) for part in outputs.split()]


def _spark_column(name: str, kind: str):
    c = F.col(name)
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "s":
        return c.cast("string").alias(name)
    if kind == "d":
        return F.date_format(c, "yyyy-MM-dd").alias(name)
    return (F.round(c.cast("double"), int(kind[1:])) + F.lit(0.0)).alias(name)


def _sql_column(name: str, kind: str) -> str:
    q = f'"{name}"'
    if kind == "i":
        return f"CAST({q} AS BIGINT) AS {q}"
    if kind == "s":
        return f"CAST({q} AS VARCHAR) AS {q}"
    if kind == "d":
        return f"strftime(CAST({q} AS DATE), '%Y-%m-%d') AS {q}"
    return f"round(CAST({q} AS DOUBLE), {int(kind[1:])}) + 0.0 AS {q}"


def query(name: str, outputs: str, sql: str | None = None):
    columns = _columns(outputs)

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*[_spark_column(n, k) for n, k in columns])

        check = None
        if sql is not None:
            shown = ", ".join(_sql_column(n, k) for n, k in columns)
            check = f"SELECT {shown} FROM (\n{sql.strip().rstrip(';')}\n) AS answer"
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(run, check)
        return fn

    return register


# -- roles of the driver tables ---------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_unit():
    """25 units; every 26th user has no unit."""
    rest = F.col("user_id") % 26
    return F.when(rest != 25, rest)


def event_panel(spark, sf_dir) -> DataFrame:
    return panels.build_panel(
        table(spark, sf_dir, "events"), event_unit(), F.to_date("ts"),
        F.coalesce(F.col("event_type") == "error", F.lit(False)),
    )


def event_series(spark, sf_dir, kind: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return signals.daily_totals(rows, F.to_date("ts"), F.lit(1))


def event_signal(spark, sf_dir) -> DataFrame:
    return signals.build_signal(event_series(spark, sf_dir, "view"))


def event_features(spark, sf_dir) -> DataFrame:
    return features.feature_panel(event_panel(spark, sf_dir), event_signal(spark, sf_dir))


def ship_panel(spark, sf_dir) -> DataFrame:
    """lineitem by supplier nation and ship date; a hit is a returned line."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    return panels.build_panel(
        lines, F.col("s_nationkey"), F.to_date("l_shipdate"),
        F.coalesce(F.col("l_returnflag") == "R", F.lit(False)),
    )


def order_series(spark, sf_dir) -> DataFrame:
    return signals.daily_totals(
        table(spark, sf_dir, "orders"), F.to_date("o_orderdate"), F.col("o_totalprice")
    )


def order_signal(spark, sf_dir) -> DataFrame:
    return signals.build_signal(order_series(spark, sf_dir))


def ship_features(spark, sf_dir, lags=fv.MODEL_LAGS) -> DataFrame:
    """Settled: model families read it several times."""
    return settle(
        features.feature_panel(ship_panel(spark, sf_dir), order_signal(spark, sf_dir), lags),
        "features",
    )


ATTRS = ("pct_automobile", "pct_building", "pct_furniture", "pct_machinery")


def nation_attributes(spark, sf_dir) -> DataFrame:
    """Customers by nation as static unit attributes.

    An attribute is a mean balance index that weighs one market segment up.
    """
    seg, balance = F.col("c_mktsegment"), F.abs("c_acctbal")
    return (
        table(spark, sf_dir, "customer")
        .groupBy(F.col("c_nationkey").alias("unit"))
        .agg(
            F.count(F.lit(1)).alias("total_population"),
            *[
                (
                    F.avg(
                        balance
                        + F.when(seg == name.removeprefix("pct_").upper(), 1000.0).otherwise(0.0)
                    ) / 110
                ).alias(name)
                for name in ATTRS
            ],
        )
        .join(
            table(spark, sf_dir, "nation").select(
                F.col("n_nationkey").alias("unit"),
                ((F.col("n_regionkey") + 1) * 100 + F.col("n_nationkey")).alias("cd_code"),
            ),
            "unit",
        )
    )


def ship_features_attrs(spark, sf_dir) -> DataFrame:
    from panelwright.operators import attributes, quantiles

    joined = attributes.join_attributes(
        features.feature_panel(
            ship_panel(spark, sf_dir), order_signal(spark, sf_dir), fv.MODEL_LAGS
        ),
        nation_attributes(spark, sf_dir).drop("cd_code"),
    )
    return quantiles.add_quartiles(settle(joined, "features"), ATTRS)


# -- the same roles in SQL ---------------------------------------------------

EV = """
ev AS (
  SELECT CAST(ts AS DATE) AS day,
         CASE WHEN user_id % 26 <> 25 THEN user_id % 26 END AS unit,
         count(*) AS total,
         CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS hits,
         sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::DOUBLE / count(*) AS share
  FROM events GROUP BY 1, 2)"""


def series_sql(name: str, source: str, day: str, n: str = "1") -> str:
    """Daily totals, with their z-score, of a source (table and filter)."""
    return f"""
{name}_t AS (SELECT CAST({day} AS DATE) AS day, CAST(sum({n}) AS DOUBLE) AS signal_total
             FROM {source} GROUP BY 1),
{name} AS (SELECT day, signal_total,
             (signal_total - avg(signal_total) OVER ()) / stddev_pop(signal_total) OVER () AS signal_z
           FROM {name}_t)"""


EVSIG = series_sql("evsig", "events WHERE event_type = 'view'", "ts")
ORD = series_sql("sig", "orders", "o_orderdate", "o_totalprice")

SHIP = """
ship AS (
  SELECT CAST(l_shipdate AS DATE) AS day, CAST(s_nationkey AS BIGINT) AS unit, count(*) AS total,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS hits,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::DOUBLE / count(*) AS share
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def holiday_sql(d: str) -> str:
    def date(e, m, k):
        return f"(month({e}) = {m} AND day({e}) = {k})"

    def fixed(m, k):
        wd = f"isodow({d})"
        return (
            f"(({wd} <= 5 AND {date(d, m, k)}) OR ({wd} = 5 AND {date(f'({d} + 1)', m, k)})"
            f" OR ({wd} = 1 AND {date(f'({d} - 1)', m, k)}))"
        )

    def nth(m, wd, a, b):
        return f"(month({d}) = {m} AND isodow({d}) = {wd} AND day({d}) BETWEEN {a} AND {b})"

    rules = [
        fixed(1, 1), f"({nth(1, 1, 15, 21)} AND year({d}) >= 1986)", nth(2, 1, 15, 21),
        nth(5, 1, 25, 31), f"({fixed(6, 19)} AND year({d}) >= 2021)", fixed(7, 4),
        nth(9, 1, 1, 7), nth(10, 1, 8, 14), fixed(11, 11), nth(11, 4, 22, 28), fixed(12, 25),
    ]
    return "CASE WHEN " + " OR ".join(rules) + " THEN 1 ELSE 0 END"


def calendar_sql(d: str = "day") -> str:
    return (
        f"isodow({d}) - 1 AS dow, month({d}) AS month, year({d}) AS year, "
        f"{holiday_sql(d)} AS is_holiday, year({d}) * 12 + month({d}) - 1 AS month_year"
    )


def lags_sql(lags, value="signal_z", prefix="z_lag") -> str:
    return ", ".join(
        f"{value} AS {prefix}{k}" if k == 0
        else f"CASE WHEN unit IS NOT NULL THEN lag({value}, {k}) OVER w END AS {prefix}{k}"
        for k in lags
    )


def features_sql(name: str, panel: str, sig: str, lags=fv.MODEL_LAGS) -> str:
    """Feature panel of a panel and a signal."""
    roll = "avg({}) OVER (PARTITION BY unit ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
    return f"""
{name}_j AS (SELECT p.*, s.signal_total, s.signal_z FROM {panel} p LEFT JOIN {sig} s ON p.day = s.day),
{name} AS (
  SELECT *, {calendar_sql()}, {lags_sql(lags)},
    CASE WHEN unit IS NOT NULL THEN {roll.format('hits')} END AS hits_roll3,
    CASE WHEN unit IS NOT NULL THEN {roll.format('signal_total')} END AS signal_roll3,
    CASE WHEN unit IS NOT NULL THEN ln(1 + {roll.format('hits')}) END AS log_hits_roll3,
    CASE WHEN unit IS NOT NULL THEN ln(1 + {roll.format('signal_total')}) END AS log_signal_roll3
  FROM {name}_j WINDOW w AS (PARTITION BY unit ORDER BY day))"""


SHIPF = SHIP + "," + ORD + "," + features_sql("f", "ship", "sig")
EVF = EV + "," + EVSIG + "," + features_sql("f", "ev", "evsig", fv.FEATURE_LAGS)

ATTR = """
attr AS (
  SELECT CAST(c_nationkey AS BIGINT) AS unit, count(*) AS total_population, """ + ", ".join(
    f"avg(abs(c_acctbal) + CASE WHEN c_mktsegment = '{a.removeprefix('pct_').upper()}' THEN 1000.0::DOUBLE ELSE 0 END) / 110 AS {a}"
    for a in ATTRS
) + """
  FROM customer GROUP BY 1)"""


def bucket_sql(value: str, source: str, labels, where: str = "true") -> str:
    """CASE ladder over quantile edges of all rows of a source."""
    q = len(labels)
    edge = "(SELECT quantile_cont(CAST({v} AS DOUBLE), {p}::DOUBLE) FROM {s} WHERE {w})"
    cases = "".join(
        f" WHEN {value} <= "
        + edge.format(v=value.split(".")[-1], p=(i + 1) / q, s=source, w=where)
        + f" THEN '{label}'"
        for i, label in enumerate(labels[:-1])
    )
    return f"CASE WHEN {value} IS NULL THEN NULL{cases} ELSE '{labels[-1]}' END"


def ols_sql(
    x, sample: str = "smp", cats=("dow", "month_year"), fe: bool = True, y: str = "y",
    tag: str = "o", absorb: str | None = None, extra_params: str = "0",
) -> str:
    """CTEs that fit a least-squares model per stratum on CTE ``sample``.

    Effects are explicit dummies here (the Spark side sweeps unit means out) and
    the cross-product matrix is inverted by elimination in a recursive CTE; a
    pivot that vanishes leaves its column out.  Result: ``<tag>_est`` (stratum,
    term, coef, se, n_obs, n_units, n_params, r_squared) and ``<tag>_iu`` (the
    influence of each unit on each coefficient).  With ``absorb`` the effects of
    that column are swept out of the cross-products instead of being dummies.
    """
    t = tag
    known = " AND ".join(f"{c} IS NOT NULL" for c in [*x, *cats, y, "unit"])
    cols = ", ".join(dict.fromkeys([*x, *cats]))
    group = f", {absorb} AS grp" if absorb else ""
    k = [f"1 + {len(x)} + {extra_params}"]
    for c in cats:
        k.append(
            f"count(DISTINCT {c} % 12) * count(DISTINCT {c} // 12) - 1"
            if c == "month_year" else f"count(DISTINCT {c}) - 1"
        )
    if fe:
        k.append("count(DISTINCT unit) - 1")
    if absorb:
        k.append("count(DISTINCT grp) - 1")
    first = "'unit=' || unit" if fe else "'1'"
    parts = [f"SELECT stratum, rid, unit, 0 AS kind, {first} AS term, 1.0::DOUBLE AS v FROM {t}_s"]
    for c in cats:
        parts.append(
            f"SELECT s.stratum, rid, unit, 0, '{c}=' || {c}, 1.0::DOUBLE FROM {t}_s s JOIN "
            f"(SELECT stratum, min({c}) AS m FROM {t}_s GROUP BY 1) q ON s.stratum = q.stratum WHERE {c} <> m"
        )
    for i, c in enumerate(x):
        parts.append(
            f"SELECT stratum, rid, unit, {i + 1}, '{c}', CAST({c} AS DOUBLE) FROM {t}_s WHERE {c} <> 0"
        )
    long = "\n  UNION ALL ".join(parts)
    gram = f"SELECT a.stratum, a.i, b.i AS j, sum(a.v * b.v) AS g FROM {t}_l a JOIN {t}_l b ON a.rid = b.rid GROUP BY ALL"
    cross = f"SELECT l.stratum, l.i, sum(l.v * s.y) AS c FROM {t}_l l JOIN {t}_s s ON l.rid = s.rid GROUP BY ALL"
    resid = (
        f"SELECT s.rid, s.stratum, s.unit, any_value(s.y) - sum(l.v * b.b) AS e"
        f"{', any_value(s.grp) AS grp' if absorb else ''} FROM {t}_s s JOIN {t}_l l ON l.rid = s.rid "
        f"JOIN {t}_b b ON b.stratum = l.stratum AND b.i = l.i GROUP BY ALL"
    )
    score = f"SELECT l.stratum, l.unit, l.i, sum(l.v * e.e) AS sc FROM {t}_l l JOIN {t}_e e ON e.rid = l.rid GROUP BY ALL"
    sums = ""
    if absorb:
        sums = f"""
{t}_n AS MATERIALIZED (SELECT stratum, grp, count(*) AS n, sum(y) AS y FROM {t}_s GROUP BY ALL),
{t}_gs AS MATERIALIZED (SELECT l.stratum, s.grp, l.i, sum(l.v) AS v FROM {t}_l l JOIN {t}_s s ON l.rid = s.rid GROUP BY ALL),"""
        gram = f"""SELECT stratum, i, j, sum(g) AS g FROM ({gram} UNION ALL
    SELECT a.stratum, a.i, b.i, -sum(a.v * b.v / n.n) FROM {t}_gs a JOIN {t}_gs b ON a.stratum = b.stratum AND a.grp = b.grp
    JOIN {t}_n n ON n.stratum = a.stratum AND n.grp = a.grp GROUP BY ALL) q GROUP BY ALL"""
        cross = f"""SELECT stratum, i, sum(c) AS c FROM ({cross} UNION ALL
    SELECT a.stratum, a.i, -sum(a.v * n.y / n.n) FROM {t}_gs a JOIN {t}_n n ON n.stratum = a.stratum AND n.grp = a.grp GROUP BY ALL) q GROUP BY ALL"""
        resid = f"SELECT rid, stratum, unit, grp, e - avg(e) OVER (PARTITION BY stratum, grp) AS e FROM ({resid}) q"
        score = f"""SELECT stratum, unit, i, sum(sc) AS sc FROM ({score} UNION ALL
    SELECT a.stratum, u.unit, a.i, -sum(a.v / n.n * u.e) FROM {t}_gs a JOIN {t}_n n ON n.stratum = a.stratum AND n.grp = a.grp
    JOIN (SELECT stratum, grp, unit, sum(e) AS e FROM {t}_e GROUP BY ALL) u ON u.stratum = a.stratum AND u.grp = a.grp GROUP BY ALL) q GROUP BY ALL"""
    return f"""
{t}_s AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, stratum, unit{group}, {cols}, CAST({y} AS DOUBLE) AS y
  FROM {sample} WHERE stratum IS NOT NULL AND {known}),
{t}_f AS (SELECT stratum, count(*) AS n, count(DISTINCT unit) AS g, {' + '.join(k)} AS k,
            sum((y - my) * (y - my)) AS tss
          FROM (SELECT *, avg(y) OVER (PARTITION BY stratum) AS my FROM {t}_s) GROUP BY 1),
{t}_l0 AS MATERIALIZED ({long}),
{t}_ti AS MATERIALIZED (SELECT stratum, kind, term, row_number() OVER (PARTITION BY stratum ORDER BY kind, term) AS i
           FROM (SELECT DISTINCT stratum, kind, term FROM {t}_l0)),
{t}_l AS MATERIALIZED (SELECT l.stratum, l.rid, l.unit, ti.i, l.v FROM {t}_l0 l JOIN {t}_ti ti
          ON l.stratum = ti.stratum AND l.term = ti.term),{sums}
{t}_g AS ({gram}),
{t}_m0 AS MATERIALIZED (
  SELECT stratum, list(r ORDER BY i) AS m FROM (
    SELECT a.stratum, a.i,
      list_concat(list(coalesce(g.g, 0.0::DOUBLE) ORDER BY b.i),
                  list(CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY b.i)) AS r
    FROM {t}_ti a JOIN {t}_ti b ON a.stratum = b.stratum
    LEFT JOIN {t}_g g ON g.stratum = a.stratum AND g.i = a.i AND g.j = b.i GROUP BY a.stratum, a.i)
  GROUP BY stratum),
{t}_ge(stratum, k, m) USING KEY (stratum) AS (
  SELECT stratum, 0, m FROM {t}_m0
  UNION
  SELECT stratum, k + 1,
    CASE WHEN m[k + 1][k + 1] < 1e-7
      THEN list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: 0.0::DOUBLE) ELSE r END)
      ELSE list_transform(m, lambda r, i: CASE
        WHEN i = k + 1 THEN list_transform(r, lambda v: v / m[k + 1][k + 1])
        WHEN r[k + 1] = 0 THEN r
        ELSE list_transform(m[k + 1], lambda v, j: r[j] - r[k + 1] * v / m[k + 1][k + 1]) END)
    END
  FROM {t}_ge WHERE k < len(m)),
{t}_inv AS MATERIALIZED (
  SELECT e.stratum, a.i, b.i AS j, e.m[a.i][len(e.m) + b.i] AS v
  FROM {t}_ge e JOIN {t}_ti a ON a.stratum = e.stratum JOIN {t}_ti b ON b.stratum = e.stratum),
{t}_xy AS ({cross}),
{t}_b AS MATERIALIZED (SELECT v.stratum, v.i, sum(v.v * x.c) AS b FROM {t}_inv v JOIN {t}_xy x
          ON x.stratum = v.stratum AND x.i = v.j GROUP BY ALL),
{t}_e AS MATERIALIZED ({resid}),
{t}_sc AS ({score}),
{t}_iu AS MATERIALIZED (
  SELECT ti.stratum, ti.term, sc.unit, sum(v.v * sc.sc) AS u
  FROM {t}_ti ti JOIN {t}_inv v ON v.stratum = ti.stratum AND v.i = ti.i
  JOIN {t}_sc sc ON sc.stratum = v.stratum AND sc.i = v.j WHERE ti.kind > 0 GROUP BY ALL),
{t}_v AS (SELECT stratum, term, sum(u * u) AS v FROM {t}_iu GROUP BY ALL),
{t}_ssr AS (SELECT stratum, sum(e * e) AS ssr FROM {t}_e GROUP BY 1),
{t}_fac AS (SELECT *, g::DOUBLE / (g - 1) * (n - 1)::DOUBLE / (n - k) AS factor FROM {t}_f),
{t}_est AS MATERIALIZED (
  SELECT ti.stratum, ti.term, CASE WHEN d.v > 0 THEN b.b END AS coef,
    CASE WHEN d.v > 0 AND f.n > f.k THEN sqrt(vv.v * f.factor) END AS se,
    f.n AS n_obs, f.g AS n_units, f.k AS n_params, 1 - s.ssr / f.tss AS r_squared
  FROM {t}_ti ti JOIN {t}_b b ON b.stratum = ti.stratum AND b.i = ti.i
  JOIN {t}_inv d ON d.stratum = ti.stratum AND d.i = ti.i AND d.j = ti.i
  JOIN {t}_v vv ON vv.stratum = ti.stratum AND vv.term = ti.term
  JOIN {t}_fac f ON f.stratum = ti.stratum JOIN {t}_ssr s ON s.stratum = ti.stratum WHERE ti.kind > 0)"""


def _eliminated(m: str, n: str) -> str:
    """Gauss-Jordan elimination of the first ``n`` columns; a vanishing pivot leaves its column out."""
    return f"""list_reduce(range(1, {n} + 1), lambda m, k:
    CASE WHEN abs(m[k][k]) < 1e-7
      THEN list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: 0.0::DOUBLE) ELSE r END)
      ELSE list_transform(m, lambda r, i: CASE
        WHEN i = k THEN list_transform(r, lambda v: v / m[k][k])
        WHEN r[k] = 0 THEN r
        ELSE list_transform(m[k], lambda v, j: r[j] - r[k] * v / m[k][k]) END) END, {m})"""


def _count_rows(o: str, state: str) -> str:
    """CTEs ``w`` (one row per observation at the state's a and b), ``gr``, ``ve`` and ``sc``.

    Sums of digammas of counts are written out, so no special function is needed.
    """
    return f"""
    e AS (SELECT s.rid, any_value(s.y) AS y, any_value(st.a) AS a, CASE WHEN any_value(st.b) IS NULL THEN ln(any_value(s.y) + 0.5) ELSE sum(l.v * st.b[l.i]) END AS eta
          FROM {o}_s s JOIN {o}_l l ON l.rid = s.rid, {state} st GROUP BY s.rid),
    w0 AS (SELECT *, exp(eta) AS mu, CASE WHEN a > 0 THEN 1 / a END AS t FROM e),
    w1 AS (SELECT *, mu * (1 + a * y) / ((1 + a * mu) * (1 + a * mu)) AS h, (y - mu) / (1 + a * mu) AS s, mu * (y - mu) / ((1 + a * mu) * (1 + a * mu)) AS k,
            coalesce(list_sum(list_transform(range(CAST(y AS BIGINT)), lambda q: 1 / (t + q))), 0) - ln(1 + a * mu) + (mu - y) / (t + mu) AS d1,
            -coalesce(list_sum(list_transform(range(CAST(y AS BIGINT)), lambda q: 1 / ((t + q) * (t + q)))), 0) + 1 / t - 2 / (t + mu) + (y + t) / ((t + mu) * (t + mu)) AS d2,
            CASE WHEN a > 0 THEN coalesce(list_sum(list_transform(range(CAST(y AS BIGINT)), lambda q: ln(t + q))), 0) - lgamma(y + 1) - t * ln(1 + a * mu) + y * (ln(mu) - ln(t + mu))
                 ELSE y * ln(mu) - mu - lgamma(y + 1) END AS ll FROM w0),
    w AS (SELECT *, -t * t * d1 AS l1, t * t * t * t * d2 + 2 * t * t * t * d1 AS l2 FROM w1),
    gr AS (SELECT p.i, p.j, sum(p.v * w.h) AS v FROM {o}_pr p JOIN w ON w.rid = p.rid GROUP BY ALL),
    ve AS (SELECT l.i, sum(l.v * w.s) AS g, sum(l.v * (w.h * w.eta + w.s)) AS z, sum(l.v * w.k) AS c FROM {o}_l l JOIN w ON w.rid = l.rid GROUP BY ALL),
    sc AS (SELECT sum(ll) AS ll, sum(l1) AS l1, sum(l2) AS l2, count(*) AS n, any_value(a) AS a, sum((y - mu) * (y - mu) - mu) / sum(mu * mu) AS moment FROM w)"""


def counts_sql(tag: str, rounds: int = 8) -> str:
    """CTEs that fit Poisson and NB2 by Newton steps on the design of ``ols_sql(tag=tag)``.

    Results (family, term, coef, se, dispersion, loglik, n_obs): ``<tag>_poisson``
    and ``<tag>_count``, which is NB2 where the Poisson fit leaves overdispersion.
    Every effect is a dummy; errors come from the inverted information.
    """
    o = tag
    square = f"SELECT a.i, list(coalesce(gr.v, 0.0::DOUBLE) ORDER BY b.i) AS r FROM {o}_ti a CROSS JOIN {o}_ti b LEFT JOIN gr ON gr.i = a.i AND gr.j = b.i GROUP BY a.i"
    unit = f"list(CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY b.i)"
    inverse = f"SELECT {_eliminated('m', 'n')} AS m, n FROM (SELECT list(r ORDER BY i) AS m, count(*) AS n FROM full_)"
    return f"""
{o}_pr AS MATERIALIZED (SELECT a.rid, a.i, b.i AS j, a.v * b.v AS v FROM {o}_l a JOIN {o}_l b ON a.rid = b.rid),
{o}_po(it, a, b) AS (
  SELECT 0, 0.0::DOUBLE, NULL::DOUBLE[]
  UNION ALL
  SELECT * FROM (WITH st0 AS (SELECT * FROM {o}_po WHERE it < {rounds}), {_count_rows(o, 'st0')},
    sq AS ({square}),
    so AS (SELECT {_eliminated('m', 'len(m)')} AS m FROM (SELECT list(list_append(sq.r, ve.z) ORDER BY sq.i) AS m FROM sq JOIN ve ON ve.i = sq.i))
    SELECT st0.it + 1, 0.0::DOUBLE, list_transform(so.m, lambda r: r[-1]) FROM so, st0)),
{o}_p1 AS MATERIALIZED (SELECT * FROM {o}_po WHERE it = {rounds}),
{o}_poisson AS MATERIALIZED (
  SELECT * FROM (WITH {_count_rows(o, o + '_p1')}, sq AS ({square}),
    id AS (SELECT a.i, {unit} AS r FROM {o}_ti a CROSS JOIN {o}_ti b GROUP BY a.i),
    full_ AS (SELECT sq.i, list_concat(sq.r, id.r) AS r FROM sq JOIN id ON id.i = sq.i),
    iv AS ({inverse})
    SELECT 'poisson' AS family, ti.term, st.b[ti.i] AS coef, sqrt(iv.m[ti.i][iv.n + ti.i]) AS se, 0.0::DOUBLE AS dispersion, sc.ll AS loglik, sc.n AS n_obs, sc.moment
    FROM {o}_ti ti, {o}_p1 st, sc, iv WHERE ti.kind > 0)),
{o}_nb(it, a, b) AS (
  SELECT 0, (SELECT any_value(moment) FROM {o}_poisson), b FROM {o}_p1 WHERE (SELECT any_value(moment) FROM {o}_poisson) > 1e-6
  UNION ALL
  SELECT * FROM (WITH st0 AS (SELECT * FROM {o}_nb WHERE it < {rounds}), {_count_rows(o, 'st0')},
    sq AS ({square}),
    rows_ AS (SELECT sq.i, list_concat(sq.r, [ve.c * sc.a, ve.g]) AS r FROM sq JOIN ve ON ve.i = sq.i, sc
      UNION ALL SELECT (SELECT max(i) + 1 FROM {o}_ti), list_concat((SELECT list(c * sc.a ORDER BY i) FROM ve), [greatest(-sc.l2 * sc.a * sc.a - sc.l1 * sc.a, 1e-8), sc.l1 * sc.a]) FROM sc),
    so AS (SELECT {_eliminated('m', 'len(m)')} AS m FROM (SELECT list(r ORDER BY i) AS m FROM rows_))
    SELECT st0.it + 1, st0.a * exp(greatest(-2, least(2, so.m[-1][-1]))), list_transform(st0.b, lambda v, i: v + so.m[i][-1]) FROM so, st0)),
{o}_n1 AS MATERIALIZED (SELECT * FROM {o}_nb WHERE it = {rounds}),
{o}_count AS MATERIALIZED (
  SELECT * FROM (WITH {_count_rows(o, o + '_n1')}, sq AS ({square}),
    rows_ AS (SELECT sq.i, list_append(sq.r, ve.c) AS r FROM sq JOIN ve ON ve.i = sq.i
      UNION ALL SELECT (SELECT max(i) + 1 FROM {o}_ti), list_append((SELECT list(c ORDER BY i) FROM ve), -sc.l2) FROM sc),
    id AS (SELECT a.i, {unit} AS r FROM rows_ a CROSS JOIN rows_ b GROUP BY a.i),
    full_ AS (SELECT rows_.i, list_concat(rows_.r, id.r) AS r FROM rows_ JOIN id ON id.i = rows_.i),
    iv AS ({inverse})
    SELECT 'nb2' AS family, ti.term, st.b[ti.i] AS coef, sqrt(iv.m[ti.i][iv.n + ti.i]) AS se, st.a AS dispersion, sc.ll AS loglik, sc.n AS n_obs, sc.moment
    FROM {o}_ti ti, {o}_n1 st, sc, iv WHERE ti.kind > 0)
  UNION ALL SELECT * FROM {o}_poisson WHERE coalesce(moment, 0) <= 1e-6)"""


def lag_x(lags=fv.MODEL_LAGS) -> list[str]:
    return [f"z_lag{k}" for k in lags]


def tag_sum_sql(tag: str, lags) -> str:
    """(stratum, b, se) of the sum of lag coefficients, out of ``ols_sql``."""
    names = ", ".join(f"'z_lag{k}'" for k in lags)
    return f"""
  SELECT e.stratum, e.b, sqrt(u.v * f.factor) AS se FROM
   (SELECT stratum, sum(coef) AS b FROM {tag}_est WHERE term IN ({names}) GROUP BY 1) e
   JOIN (SELECT stratum, sum(t * t) AS v FROM (SELECT stratum, unit, sum(u) AS t FROM {tag}_iu
         WHERE term IN ({names}) GROUP BY 1, 2) GROUP BY 1) u ON u.stratum = e.stratum
   JOIN {tag}_fac f ON f.stratum = e.stratum"""
