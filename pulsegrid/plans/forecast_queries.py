"""Forecasts."""

from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import forecast
from ..operators.quantiles import with_quantiles
from ..sources.adapters import EV_SQL, ev_series
from .base import query, r6

H = W.Series(order=("us",))
HOUR = 3_600_000_000
HOURLY_SQL = f"""hr AS (SELECT entity, us - us % {HOUR} AS us, sum(value) AS x FROM ev GROUP BY ALL), h AS (SELECT *, (isodow(make_timestamp(us)) - 1) || '-' || hour(make_timestamp(us)) AS slot FROM hr),
f AS (SELECT *, avg(x) OVER (PARTITION BY entity, slot ORDER BY us ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS seasonal, CASE WHEN count(x) OVER p >= 3 THEN avg(x) OVER p END AS moving, avg(x) OVER (PARTITION BY entity ORDER BY us ROWS UNBOUNDED PRECEDING) AS expanding
  FROM h WINDOW p AS (PARTITION BY entity ORDER BY us ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)), y AS (SELECT *, coalesce(seasonal, moving, expanding) AS y_hat FROM f)"""
BAND_SQL = """r AS (SELECT *, abs(x - y_hat) AS res FROM y), c AS (SELECT entity, quantile_cont(res, 0.95) AS al, quantile_cont(x, 0.995) * 1.15 AS capacity FROM r GROUP BY entity),
b AS (SELECT r.*, capacity, coalesce(CASE WHEN count(res) OVER q >= 6 THEN quantile_cont(res, 0.95) OVER q END, al) AS band FROM r JOIN c USING (entity) WINDOW q AS (PARTITION BY entity ORDER BY us ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, x < greatest(y_hat - band, 0) OR x > y_hat + band AS out_of_band, lead(y_hat, 6) OVER (PARTITION BY entity ORDER BY us) AS ahead FROM b)"""


def _hourly(spark, d):
    df = ev_series(spark, d).groupBy("entity", (F.floor(F.col("us") / HOUR) * HOUR).alias("us")).agg(F.sum("value").alias("x"))
    t = F.timestamp_micros("us")
    return df.withColumn("slot", F.concat_ws("-", F.weekday(t), F.hour(t)))


def hourly_forecast(spark, d):
    df = forecast.forecast_band(forecast.seasonal_forecast(_hourly(spark, d), H, "x", "slot"), H, "x")
    return forecast.capacity_warning(df, H)


@query(f"WITH {EV_SQL}, {HOURLY_SQL} SELECT entity, us, round(x, 4) AS x, round(seasonal, 4) AS seasonal, round(y_hat, 4) AS y_hat FROM y")
def seasonalhourly_forecast(spark, d):
    df = forecast.seasonal_forecast(_hourly(spark, d), H, "x", "slot")
    return df.select("entity", "us", *(r6(F.col(c), 4).alias(c) for c in ("x", "seasonal", "y_hat")))


@query(f"WITH {EV_SQL}, {HOURLY_SQL}, {BAND_SQL} SELECT entity, us, round(band + 1e-9, 4) AS band, round(greatest(y_hat - band, 0) + 1e-9, 4) AS y_lower, round(y_hat + band + 1e-9, 4) AS y_upper, out_of_band FROM o")
def forecast_band(spark, d):
    return hourly_forecast(spark, d).select("entity", "us", *(r6(F.col(c) + 1e-9, 4).alias(c) for c in ("band", "y_lower", "y_upper")), "out_of_band")


@query(f"WITH {EV_SQL}, {HOURLY_SQL}, {BAND_SQL} SELECT entity, us, round(capacity, 4) AS capacity, round(ahead, 4) AS forecast_ahead, coalesce(ahead > 0.8 * capacity, false) AS early_warning FROM o")
def capacity_warning(spark, d):
    return hourly_forecast(spark, d).select("entity", "us", r6(F.col("capacity"), 4).alias("capacity"), r6(F.col("forecast_ahead"), 4).alias("forecast_ahead"), "early_warning")


@query(f"WITH {EV_SQL}, {HOURLY_SQL}, {BAND_SQL} SELECT entity, count(*) AS n, sum(out_of_band::INT)::BIGINT AS anomalies, sum(coalesce(ahead > 0.8 * capacity, false)::INT)::BIGINT AS warnings, round(avg(out_of_band::INT), 6) AS positive_rate, round(quantile_cont(res, 0.9), 4) AS p90_residual FROM o GROUP BY entity")
def forecast_summary(spark, d):
    n = lambda c: F.sum(F.col(c).cast("long"))
    df = hourly_forecast(spark, d)
    summary = df.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), n("out_of_band").alias("anomalies"), n("early_warning").alias("warnings"), r6(F.avg(F.col("out_of_band").cast("int"))).alias("positive_rate"))
    return with_quantiles(summary, df, ["entity"], {"p90_residual": ("residual", 0.9)}).withColumn("p90_residual", r6(F.col("p90_residual"), 4))


@query(
    f"""WITH {EV_SQL}, s AS (SELECT entity, event_id, value, CASE WHEN count(value) OVER w > 1 THEN (last_value(value) OVER w - first_value(value) OVER w) / (count(value) OVER w - 1) ELSE 0 END AS slope, CASE WHEN count(value) OVER v >= 3 THEN avg(value) OVER v END AS m
    FROM ev WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), v AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), l AS (SELECT entity, quantile_cont(m, 0.9) AS lim FROM s GROUP BY entity)
    SELECT entity, event_id, round(greatest(value + slope, 0), 4) AS next, round(greatest(greatest(value + slope, 0), greatest(value + 6 * slope, 0)), 4) AS peak, greatest(greatest(value + slope, 0), greatest(value + 6 * slope, 0)) > lim AS breach FROM s JOIN l USING (entity)"""
)
def slope_extrapolate(spark, d):
    df = forecast.forecast_breach(ev_series(spark, d), W.Series(), "value")
    return df.select("entity", "event_id", r6(F.get("ahead", F.lit(0)), 4).alias("next"), r6(F.col("peak"), 4).alias("peak"), "breach")
