"""Detectors: baselines, control charts, change points, outliers, runs of alerts."""

from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import detect, features
from ..sources.adapters import EV_SQL, WIDE_SQL, ev_series, ev_wide
from .base import query, r6
from .feature_queries import PORTS, RATIOS_SQL, TOTALS_SQL

S = W.Series()
O = BY_TS = "PARTITION BY entity ORDER BY ts, event_id"  # noqa: E741

Z_SQL = f"""zz AS (SELECT *, (value - CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END) / (coalesce(CASE WHEN count(value) OVER w >= 3 THEN stddev_samp(value) OVER w END, 1) + 1e-9) AS z
  FROM ev WINDOW w AS ({O} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), zf AS (SELECT *, coalesce(abs(z) > 2, false) AS f FROM zz)"""


@query(f"WITH {EV_SQL}, {Z_SQL} SELECT entity, event_id, round(z, 6) AS z, coalesce(abs(z) > 3, false) AS z_flag FROM zz")
def zscore_rolling(spark, d):
    return detect.rolling_z(ev_series(spark, d), S, "value").select("entity", "event_id", r6(F.col("z")).alias("z"), "z_flag")


@query(
    f"""WITH {EV_SQL}, z AS (SELECT *, CASE WHEN count(value) OVER w >= 20 THEN (value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-9) END AS z FROM ev WINDOW w AS ({O} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    r AS (SELECT *, coalesce(z > 1, false) AS raw FROM z) SELECT entity, event_id, round(z, 6) AS z, raw AS z_raw, sum(raw::INT) OVER ({O} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 AS z_held FROM r"""
)
def one_sided_z(spark, d):
    """A threshold of 1 in place of 3, so that the flag holds for three rows somewhere."""
    df = detect.one_sided_z(ev_series(spark, d), S, "value", threshold=1.0)
    return df.select("entity", "event_id", r6(F.col("z")).alias("z"), "z_raw", "z_held")


@query(f"WITH {EV_SQL}, f AS (SELECT *, value > 60 AS f FROM ev) SELECT entity, event_id, " + ", ".join(f"sum(f::INT) OVER ({O} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {n} AS held_{n}" for n in (1, 2, 3, 5, 8)) + " FROM f")
def deadband(spark, d):
    return detect.deadband_sweep(ev_series(spark, d), S, F.col("value") > 60).select("entity", "event_id", *(f"held_{n}" for n in (1, 2, 3, 5, 8)))


ISLANDS_SQL = """isl AS (SELECT entity, us, f, sum((f AND NOT b)::BIGINT) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, coalesce(lag(f) OVER (PARTITION BY entity ORDER BY ts, event_id), false) AS b FROM zf))"""


@query(f"WITH {EV_SQL}, {Z_SQL}, {ISLANDS_SQL} SELECT entity, run::BIGINT AS run, min(us) AS start_us, max(us) AS end_us, count(*) AS rows, (max(us) - min(us)) / 1e6 AS seconds FROM isl WHERE f GROUP BY entity, run")
def alert_islands(spark, d):
    df = detect.rolling_z(ev_series(spark, d), S, "value", threshold=2.0)
    return detect.runs(df, S, F.col("z_flag"))


@query(
    f"WITH {EV_SQL}, {Z_SQL}, {ISLANDS_SQL}, runs AS (SELECT entity, run, (max(us) - min(us)) / 1e6 AS seconds, count(*) AS n FROM isl WHERE f GROUP BY entity, run), span AS (SELECT entity, (max(us) - min(us)) / 3.6e9 AS hours FROM ev GROUP BY entity) "
    "SELECT entity, count(*) AS n_runs, min(n) AS shortest, max(n) AS longest, round(avg(seconds), 4) AS mean_seconds, round(count(*) / max(hours), 6) AS per_hour FROM runs JOIN span USING (entity) GROUP BY entity"
)
def run_statistics(spark, d):
    ev = ev_series(spark, d)
    runs = detect.runs(detect.rolling_z(ev, S, "value", threshold=2.0), S, F.col("z_flag"))
    span = ev.groupBy("entity").agg(((F.max("us") - F.min("us")) / 3.6e9).alias("hours"))
    return (
        runs.join(span, "entity")
        .groupBy("entity")
        .agg(F.count(F.lit(1)).alias("n_runs"), F.min("rows").alias("shortest"), F.max("rows").alias("longest"), r6(F.avg("seconds"), 4).alias("mean_seconds"), r6(F.count(F.lit(1)) / F.max("hours")).alias("per_hour"))
    )


CP_SQL = f"""cp AS (SELECT entity, event_id, us, ts, abs(s - l) / (abs(l) + 1e-9) > 0.3 AS f FROM (SELECT *, CASE WHEN count(value) OVER a >= 3 THEN avg(value) OVER a END AS s, CASE WHEN count(value) OVER b >= 15 THEN avg(value) OVER b END AS l
  FROM ev WINDOW a AS ({O} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), b AS ({O} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)))"""


@query(
    f"""WITH {EV_SQL}, {Z_SQL}, {CP_SQL}, e AS (SELECT *, f AND NOT coalesce(lag(f) OVER ({O}), false) AS onset FROM zf), c AS (SELECT *, coalesce(f, false) AND NOT coalesce(lag(f) OVER ({O}), false) AS onset FROM cp)
    SELECT entity, event_id, us, 'zscore' AS type, round(z, 2) AS z, CASE WHEN abs(z) > 5 THEN 'high' ELSE 'medium' END AS severity FROM e WHERE onset
    UNION ALL SELECT entity, event_id, us, 'changepoint', 0, 'medium' FROM c WHERE onset"""
)
def change_onsets(spark, d):
    return detect.onsets(ev_series(spark, d), S, "value", threshold=2.0).withColumn("z", r6(F.col("z"), 2))


_RZ = f"""rz AS (SELECT *, CASE WHEN count(value) OVER w >= 72 THEN (value - quantile_cont(value, 0.5) OVER w) / (1.4826 * greatest(mad(value) OVER w, 1e-9)) END AS rz, CASE WHEN count(value) OVER w >= 72 THEN quantile_cont(value, 0.95) OVER w END AS p95
  FROM ev WINDOW w AS ({O} ROWS BETWEEN 287 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {EV_SQL}, {_RZ} SELECT entity, event_id, round(rz, 5) AS robust_z, coalesce(rz > 4, false) AS rz_high, coalesce(rz < -4, false) AS rz_low, coalesce(value > p95, false) AS p95_flag FROM rz")
def robust_z(spark, d):
    df = detect.robust_z(ev_series(spark, d), S, "value")
    return df.select("entity", "event_id", r6(F.col("robust_z"), 5).alias("robust_z"), "rz_high", "rz_low", "p95_flag")


def _flag_sql() -> str:
    stats, flags = [], []
    for m, way in detect.DIRECTIONS.items():
        stats.append(
            f"CASE WHEN count({m}) OVER h >= 6 THEN avg({m}) OVER h END AS {m}_m, coalesce(CASE WHEN count({m}) OVER h >= 6 THEN stddev_samp({m}) OVER h END, 0) AS {m}_s, "
            f"CASE WHEN count({m}) OVER dd >= 72 THEN quantile_cont({m}, 0.5) OVER dd END AS {m}_q, CASE WHEN count({m}) OVER dd >= 72 THEN mad({m}) OVER dd END AS {m}_d, CASE WHEN count({m}) OVER dd >= 72 THEN quantile_cont({m}, 0.95) OVER dd END AS {m}_p"
        )
        z, rz = f"(({m} - {m}_m) / greatest({m}_s, 1e-9))", f"(({m} - {m}_q) / (1.4826 * greatest({m}_d, 1e-9)))"
        flags += [(f"{m}__flag_z_high", f"{z} > 3"), (f"{m}__flag_rz_high", f"{rz} > 4"), (f"{m}__flag_p95", f"{m} > {m}_p")]
        if way == "both":
            flags += [(f"{m}__flag_z_low", f"{z} < -3"), (f"{m}__flag_rz_low", f"{rz} < -4")]
    return (
        f"WITH {WIDE_SQL}, {TOTALS_SQL}, {RATIOS_SQL}, st AS (SELECT *, {', '.join(stats)} FROM feat WINDOW h AS (PARTITION BY port ORDER BY us ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), dd AS (PARTITION BY port ORDER BY us ROWS BETWEEN 287 PRECEDING AND CURRENT ROW)) "
        "SELECT port, us, " + ", ".join(f"coalesce({c}, false)::INT AS {n}" for n, c in flags) + " FROM st"
    )


FLAGS_SQL = _flag_sql()


def flag_table(spark, d):
    return detect.direction_flags(features.feature_table(ev_wide(spark, d), PORTS))


@query(FLAGS_SQL)
def direction_flags(spark, d):
    df = flag_table(spark, d)
    return df.select("port", "us", *(c for c in df.columns if "__flag_" in c))


#: The baseline is of the first 2016 normal rows; here the very high ones aren't.
_BASE = f"bs AS (SELECT entity, avg(value) AS mu, coalesce(stddev_samp(value), 0) AS sigma FROM (SELECT *, row_number() OVER ({O}) AS rn FROM ev WHERE value < 250) WHERE rn <= 2016 GROUP BY entity)"


def _baseline(ev):
    return detect.baseline_stats(ev, S, ["value"], 2016, F.col("value") < 250)


@query(f"WITH {EV_SQL}, {_BASE} SELECT entity, event_id, round(mu + 3 * sigma, 6) AS ucl, round(greatest(mu - 3 * sigma, 0), 6) AS lcl, value > mu + 3 * sigma AS shewhart FROM ev JOIN bs USING (entity)")
def shewhart(spark, d):
    ev = ev_series(spark, d)
    df = detect.spc_charts(ev, S, "value", _baseline(ev))
    return df.select("entity", "event_id", r6(F.col("ucl")).alias("ucl"), r6(F.col("lcl")).alias("lcl"), "shewhart")


_SPC = f"""{_BASE}, num AS (SELECT entity, event_id, value, mu, sigma, row_number() OVER ({O}) AS rn FROM ev JOIN bs USING (entity)),
rec AS (SELECT entity, event_id, rn, value, mu, sigma, value AS y, greatest(0, value - mu - 0.5 * greatest(sigma, 1e-12)) AS c FROM num WHERE rn = 1 UNION ALL
  SELECT n.entity, n.event_id, n.rn, n.value, n.mu, n.sigma, 0.25 * n.value + 0.75 * r.y, greatest(0, r.c + n.value - n.mu - 0.5 * greatest(n.sigma, 1e-12)) FROM rec r JOIN num n ON n.entity = r.entity AND n.rn = r.rn + 1),
spc AS (SELECT *, value > mu + 3 * sigma AS shewhart, y > mu + 3 * sigma * sqrt(0.25 / 1.75) AS ewma_flag, c > 5 * greatest(sigma, 1e-12) AS cusum_flag FROM rec)"""


def _spc(spark, d):
    ev = ev_series(spark, d)
    return detect.spc_charts(ev, S, "value", _baseline(ev))


@query(f"WITH RECURSIVE {EV_SQL}, {_SPC} SELECT entity, event_id, round(y + 1e-9, 5) AS ewma, ewma_flag, round(c, 4) AS cusum, cusum_flag, shewhart OR ewma_flag OR cusum_flag AS any_spc FROM spc")
def ewma_cusum_chart(spark, d):
    return _spc(spark, d).select("entity", "event_id", r6(F.col("ewma") + 1e-9, 5).alias("ewma"), "ewma_flag", r6(F.col("cusum"), 4).alias("cusum"), "cusum_flag", "any_spc")


@query(f"WITH RECURSIVE {EV_SQL}, {_SPC} SELECT entity, count(*) AS n, sum(shewhart::INT)::BIGINT AS n_shewhart, sum(ewma_flag::INT)::BIGINT AS n_ewma, sum(cusum_flag::INT)::BIGINT AS n_cusum, round(avg((shewhart OR ewma_flag OR cusum_flag)::INT), 6) AS violation_rate FROM spc GROUP BY entity")
def spc_summary(spark, d):
    n = lambda c: F.sum(F.col(c).cast("long"))
    return _spc(spark, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), n("shewhart").alias("n_shewhart"), n("ewma_flag").alias("n_ewma"), n("cusum_flag").alias("n_cusum"), r6(F.avg(F.col("any_spc").cast("int"))).alias("violation_rate"))


@query(
    f"""WITH {EV_SQL}, {_BASE}, b AS (SELECT entity, event_id, ts, value, mu, sigma, value - lag(value) OVER ({O}) AS st FROM ev JOIN bs USING (entity)),
    r AS (SELECT *, sum((value > mu)::INT) OVER w9 AS u9, sum((value < mu)::INT) OVER w9 AS d9, sum((st > 0)::INT) OVER w6 AS u6, sum((st < 0)::INT) OVER w6 AS d6, sum((value > mu + 2 * sigma)::INT) OVER w3 AS h3, sum((value < mu - 2 * sigma)::INT) OVER w3 AS l3
    FROM b WINDOW w9 AS ({O} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW), w6 AS ({O} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), w3 AS ({O} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT entity, event_id, abs(value - mu) > 3 * sigma AS rule1, u9 >= 9 OR d9 >= 9 AS rule2, coalesce(u6 >= 6, false) OR coalesce(d6 >= 6, false) AS rule3, h3 >= 2 OR l3 >= 2 AS rule4 FROM r"""
)
def we_rules(spark, d):
    ev = ev_series(spark, d)
    df = ev.join(_baseline(ev), "entity")
    return detect.western_electric(df, S, F.col("value"), F.col("value_mu"), F.col("value_sigma")).select("entity", "event_id", "rule1", "rule2", "rule3", "rule4")


@query(
    f"""WITH {EV_SQL}, m AS (SELECT *, CASE WHEN count(value) OVER a >= 3 THEN avg(value) OVER a END AS s, CASE WHEN count(value) OVER b >= 15 THEN avg(value) OVER b END AS l, avg(value) OVER a AS s1, avg(value) OVER b AS l1
    FROM ev WINDOW a AS ({O} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), b AS ({O} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
    SELECT entity, event_id, round(abs(s - l) / (abs(l) + 1e-9), 6) AS divergence, coalesce(abs(s - l) / (abs(l) + 1e-9) > 0.3, false) AS change_flag, round(100 * abs(s1 - l1) / (abs(l1) + 1e-9), 4) AS percent FROM m"""
)
def ma_divergence(spark, d):
    df = detect.ma_divergence(ev_series(spark, d), S, "value")
    a, b = W.roll_mean(F.col("value"), S, 6, 1), W.roll_mean(F.col("value"), S, 30, 1)
    return df.select("entity", "event_id", r6(F.col("divergence")).alias("divergence"), "change_flag", r6(100 * F.abs(a - b) / (F.abs(b) + 1e-9), 4).alias("percent"))


@query(
    f"""WITH {EV_SQL}, n AS (SELECT *, row_number() OVER ({O}) AS rn, count(*) OVER (PARTITION BY entity) AS n FROM ev), l AS (SELECT entity, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM n WHERE rn <= greatest(floor(n * 0.2), 10) GROUP BY entity)
    SELECT entity, event_id, round(lo, 6) AS limit_low, round(hi, 6) AS limit_high, value > hi OR value < lo AS threshold_flag FROM ev JOIN l USING (entity)"""
)
def threshold_from_start(spark, d):
    df = detect.threshold_from_start(ev_series(spark, d), S, "value")
    return df.select("entity", "event_id", r6(F.col("limit_low")).alias("limit_low"), r6(F.col("limit_high")).alias("limit_high"), "threshold_flag")


_LIM = "lim AS (SELECT entity, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS m, stddev_samp(value) AS s FROM ev GROUP BY entity)"


@query(
    f"""WITH {EV_SQL}, {_LIM}, f AS (SELECT entity, value > q3 + 1.5 * (q3 - q1) OR value < q1 - 1.5 * (q3 - q1) AS i, abs(value - m) > 3 * s AS t FROM ev JOIN lim USING (entity))
    SELECT entity, sum(i::INT)::BIGINT AS n_iqr, sum(t::INT)::BIGINT AS n_3s, sum((i AND t)::INT)::BIGINT AS n_both, sum((i AND NOT t)::INT)::BIGINT AS only_iqr, sum((t AND NOT i)::INT)::BIGINT AS only_3s FROM f GROUP BY entity"""
)
def iqr_vs_3sigma(spark, d):
    ev = ev_series(spark, d)
    df = ev.join(detect.outlier_limits(ev, "value", ("entity",)), "entity")
    i, t = (F.col("value") > F.col("iqr_high")) | (F.col("value") < F.col("iqr_low")), (F.col("value") > F.col("sd_high")) | (F.col("value") < F.col("sd_low"))
    n = lambda c: F.sum(c.cast("long"))
    return df.groupBy("entity").agg(n(i).alias("n_iqr"), n(t).alias("n_3s"), n(i & t).alias("n_both"), n(i & ~t).alias("only_iqr"), n(t & ~i).alias("only_3s"))


@query(f"WITH {EV_SQL}, {_LIM}, f AS (SELECT *, value > q3 + 1.5 * (q3 - q1) AND value > m + 3 * s AS o FROM ev JOIN lim USING (entity)) SELECT entity, event_id, o AS outlier, round(CASE WHEN o THEN m + 3 * s ELSE value END, 6) AS capped FROM f")
def cap_extremes(spark, d):
    return detect.cap_extremes(ev_series(spark, d), "value", ("entity",)).select("entity", "event_id", "outlier", r6(F.col("capped")).alias("capped"))


@query(
    f"""WITH {WIDE_SQL}, t AS (SELECT port, us, INOCTETS + OUTOCTETS AS x, OUTOCTETS / (INOCTETS + OUTOCTETS + 1e-9) AS tx FROM wide), f AS (SELECT *, coalesce(abs((x - CASE WHEN count(x) OVER w >= 3 THEN avg(x) OVER w END) / (coalesce(CASE WHEN count(x) OVER w >= 3 THEN stddev_samp(x) OVER w END, 1) + 1e-9)) > 2, false) AS z,
    coalesce(abs(CASE WHEN count(x) OVER a >= 3 THEN avg(x) OVER a END - CASE WHEN count(x) OVER b >= 15 THEN avg(x) OVER b END) / (abs(CASE WHEN count(x) OVER b >= 15 THEN avg(x) OVER b END) + 1e-9) > 0.3, false) AS c,
    sum((tx > 0.6)::INT) OVER (PARTITION BY port ORDER BY us ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 AS held
    FROM t WINDOW w AS (PARTITION BY port ORDER BY us ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), a AS (PARTITION BY port ORDER BY us ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), b AS (PARTITION BY port ORDER BY us ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
    SELECT port, us, round(tx, 6) AS tx_ratio, tx > 0.6 AS asymmetric, held, c AS change_flag, z OR c OR tx > 0.6 AS combined FROM f"""
)
def asymmetry_combined(spark, d):
    df = ev_wide(spark, d).select("port", "us", (F.col("INOCTETS") + F.col("OUTOCTETS")).alias("x"), "OUTOCTETS", "INOCTETS")
    df = detect.ma_divergence(detect.rolling_z(df, PORTS, "x", threshold=2.0), PORTS, "x").withColumn("tx", F.col("OUTOCTETS") / (F.col("x") + 1e-9))
    wide = F.col("tx") > 0.6
    return df.select("port", "us", r6(F.col("tx")).alias("tx_ratio"), wide.alias("asymmetric"), W.deadband(wide, PORTS, 3).alias("held"), "change_flag", detect.combined(F.col("z_flag"), F.col("change_flag"), wide).alias("combined"))


@query(f"WITH {EV_SQL}, {_LIM}, {Z_SQL} SELECT zz.entity, event_id, round((value - m) / (s + 1e-9), 6) AS global_z, round(z, 6) AS rolling_z, abs((value - m) / (s + 1e-9)) > 3 AS global_flag, coalesce(abs(z) > 3, false) AS rolling_flag FROM zz JOIN lim ON zz.entity = lim.entity")
def global_vs_rolling_z(spark, d):
    ev = ev_series(spark, d)
    stats = ev.groupBy("entity").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    df = detect.rolling_z(ev, S, "value").join(stats, "entity")
    g = (F.col("value") - F.col("m")) / (F.col("s") + 1e-9)
    return df.select("entity", "event_id", r6(g).alias("global_z"), r6(F.col("z")).alias("rolling_z"), (F.abs(g) > 3).alias("global_flag"), F.col("z_flag").alias("rolling_flag"))


@query(
    f"""WITH {EV_SQL}, {Z_SQL}, c AS (SELECT entity, event_id, us, value, CASE WHEN count(value) OVER a >= 3 THEN avg(value) OVER a END AS s, CASE WHEN count(value) OVER b >= 15 THEN avg(value) OVER b END AS l FROM ev WINDOW a AS ({O} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), b AS ({O} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
    SELECT entity, event_id, us, 'zscore' AS type, CASE WHEN abs(z) > 4 THEN 'high' ELSE 'medium' END AS severity, round(z, 2) AS z_score FROM zz WHERE abs(z) > 3
    UNION ALL SELECT entity, event_id, us, 'changepoint', 'medium', NULL FROM c WHERE abs(s - l) / (abs(l) + 1e-9) > 0.3"""
)
def event_list(spark, d):
    ev = ev_series(spark, d)
    z = detect.rolling_z(ev, S, "value").where("z_flag").select("entity", "event_id", "us", F.lit("zscore").alias("type"), F.when(F.abs("z") > 4, "high").otherwise("medium").alias("severity"), r6(F.col("z"), 2).alias("z_score"))
    c = detect.ma_divergence(ev, S, "value").where("change_flag").select("entity", "event_id", "us", F.lit("changepoint").alias("type"), F.lit("medium").alias("severity"), F.lit(None).cast("double").alias("z_score"))
    return z.unionByName(c)
