"""Isolation forest and what surrounds it."""

from pyspark.sql import functions as F

from ..operators import features, iforest
from ..sources.adapters import EV_SQL, WIDE_SQL, ev_series, ev_wide
from ..sources.scratch import written
from .base import query, r6
from .feature_queries import PORTS, RATIOS_SQL, TOTALS_SQL
from .join_queries import labelled_telemetry


@query(f"WITH {EV_SQL}, q AS (SELECT entity, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM ev GROUP BY entity) SELECT event_id, round((value - m) / CASE WHEN b > a THEN b - a ELSE 1 END, 6) AS value_scaled FROM ev JOIN q USING (entity)")
def robust_scale(spark, d):
    return iforest.robust_scale(ev_series(spark, d), ["value"], ["entity"]).select("event_id", r6(F.col("value_scaled")).alias("value_scaled"))


#: Hourly rows stand for the five-minute ones, so that six of them make the window. Fixed values.
MODEL_FEATURES = ["traffic_total", "ucast_total", "avg_packet_size", "error_rate", "discard_rate", "broadcast_ratio", "multicast_ratio", "unknown_total"]


def _windows(spark, d):
    return iforest.window_features(features.traffic_ratios(features.traffic_totals(ev_wide(spark, d))), PORTS, MODEL_FEATURES, 6 * 3600, 6)


def _scored(spark, d):
    df, names = _windows(spark, d)
    return _scored_of(spark, _written(spark, df.select("port", "us", *names)), names)


def _scored_of(spark, df, names):
    """Scaling, the trees' samples and the scores all read the written windows."""
    scaled = iforest.robust_scale(df, names, [])
    scaled = _written(spark, scaled.select("port", "us", F.array(*(F.col(f"{n}_scaled") for n in names)).alias("x")))
    return iforest.score(scaled, F.col("x"), iforest.fit(scaled, F.col("x"), ["port", "us"])).select("port", "us", "score")


def _written(spark, df):
    return written(df, "windows")


_WF = ", ".join(
    f"CASE WHEN count({c}) OVER w >= 3 THEN {f}({c}) OVER w ELSE 0 END AS {c}_{n}" for c in ("traffic_total", "error_rate") for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min"))
)


@query(
    f"WITH {WIDE_SQL}, {TOTALS_SQL}, {RATIOS_SQL}, f AS (SELECT port, us, traffic_total - lag(traffic_total, 6) OVER (PARTITION BY port ORDER BY us) AS sl, CASE WHEN count(traffic_total) OVER w >= 3 THEN quantile_cont(traffic_total, 0.95) OVER w ELSE 0 END AS p95, {_WF} FROM feat WINDOW w AS (PARTITION BY port ORDER BY us RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW)) "
    "SELECT port, us, round(coalesce(sl, 0), 4) AS traffic_total_slope, round(p95, 4) AS traffic_total_p95, round(traffic_total_mean, 4) AS traffic_total_mean, round(coalesce(traffic_total_std, 0), 4) AS traffic_total_std, round(traffic_total_max, 4) AS traffic_total_max, round(error_rate_mean, 5) AS error_rate_mean, round(coalesce(error_rate_std, 0), 5) AS error_rate_std, round(error_rate_min, 5) AS error_rate_min FROM f"
)
def window_features(spark, d):
    df, _ = _windows(spark, d)
    digits = {"traffic_total_slope": 4, "traffic_total_p95": 4, "traffic_total_mean": 4, "traffic_total_std": 4, "traffic_total_max": 4, "error_rate_mean": 5, "error_rate_std": 5, "error_rate_min": 5}
    return df.select("port", "us", *(r6(F.col(c), n).alias(c) for c, n in digits.items()))


@query()
def iforest_scores(spark, d):
    return _scored(spark, d).select("port", "us", r6(F.col("score")).alias("score"))


@query()
def iforest_flags(spark, d):
    """Scores above their 96.5 % quantile."""
    return iforest.flagged(_scored(spark, d)).select("port", "us", "anomaly")


@query()
def iforest_label_summary(spark, d):
    """Scores and the share of anomalies of each event label that the catalog gives a window's time and port."""
    scored = iforest.flagged(_scored(spark, d)).join(labelled_telemetry(spark, d), ["port", "us"])
    out = iforest.label_summary(scored, "event_type")
    return out.select(F.col("event_type").alias("event_label"), r6(F.col("avg_score")).alias("avg_score"), r6(F.col("p95_score")).alias("p95_score"), r6(F.col("anomaly_rate")).alias("anomaly_rate"), "rows")


@query()
def iforest_contribution(spark, d):
    """Which window features are furthest from their medians in the windows that the forest marks."""
    df, names = _windows(spark, d)
    df = _written(spark, df.select("port", "us", *names))
    marked = iforest.flagged(_scored_of(spark, df, names)).select("port", "us", "anomaly")
    out = iforest.contributions(df.join(marked, ["port", "us"]), names, F.col("anomaly"))
    return out.select("feature", r6(F.col("contribution"), 5).alias("contribution"))


@query()
def iforest_top_windows(spark, d):
    """The 15 windows with the highest scores."""
    return _scored(spark, d).orderBy(F.col("score").desc(), "port", "us").limit(15).select("port", "us", r6(F.col("score")).alias("score"))


_COUNTERS = ["INOCTETS", "OUTOCTETS", "INUCASTPKTS", "OUTUCASTPKTS", "INERRORS", "INDISCARDS", "INBROADCASTPKTS"]


@query(
    f"WITH {WIDE_SQL}, "
    + "m AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in _COUNTERS) + " FROM wide), "
    + "a AS (SELECT port, " + ", ".join(f"abs({c} - m_{c}) AS {c}" for c in _COUNTERS) + " FROM wide, m), "
    + "d AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS d_{c}" for c in _COUNTERS) + " FROM a), "
    + "c AS (SELECT " + ", ".join(f"avg({c} / CASE WHEN d_{c} > 0 THEN d_{c} ELSE 1 END) AS {c}" for c in _COUNTERS) + " FROM a, d WHERE port = 0) "
    + f"SELECT feature, round(contribution, 5) AS contribution FROM (UNPIVOT c ON {', '.join(_COUNTERS)} INTO NAME feature VALUE contribution)"
)
def feature_contribution(spark, d):
    df = iforest.contributions(ev_wide(spark, d).select("port", *(F.col(c).cast("double").alias(c) for c in _COUNTERS)), _COUNTERS, F.col("port") == 0)
    return df.select("feature", r6(F.col("contribution"), 5).alias("contribution"))
