"""Seasonal forecast with a residual band, capacity warnings and short-range extrapolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scans import expanding_mean
from ..functions.windows import Series, own_rows, roll_mean, shifted_mean, shifted_quantile, slope_ahead, with_row_halo
from ..sources.scratch import written
from .quantiles import quantile_table

HORIZON = 6


def seasonal_forecast(df: DataFrame, s: Series, x: str, slot: str, seasons: int = 4) -> DataFrame:
    """y_hat: mean of the slot's last `seasons` values, else of the last 12 rows (3 at least), else of all rows so far."""
    df = written(df, "series")  # the stretches are counted more than once
    same = Window.partitionBy(*s.by, slot).orderBy(*s.order).rowsBetween(-seasons, -1)
    cut, stretch = with_row_halo(expanding_mean(df.withColumn("seasonal", F.avg(x).over(same)), s, x, "_all"), s, 13)
    return own_rows(cut.withColumn("y_hat", F.coalesce("seasonal", shifted_mean(F.col(x), stretch, 12, 3), "_all"))).drop("_all")


def forecast_band(df: DataFrame, s: Series, x: str) -> DataFrame:
    """The band is the 95 % quantile of the last 24 residuals (6 at least), or that of the whole series."""
    df = written(df.withColumn("residual", F.abs(F.col(x) - F.col("y_hat"))), "residuals")
    whole = quantile_table(df, list(s.by), {"_all": ("residual", 0.95), "capacity": (x, 0.995)}).withColumn("capacity", F.col("capacity") * 1.15)
    cut, stretch = with_row_halo(df, s, 25)
    df = own_rows(cut.withColumn("band", shifted_quantile(F.col("residual"), stretch, 24, 0.95, 6)))
    df = df.join(whole, list(s.by)).withColumn("band", F.coalesce("band", "_all"))
    df = df.withColumn("y_lower", F.greatest(F.col("y_hat") - F.col("band"), F.lit(0.0))).withColumn("y_upper", F.col("y_hat") + F.col("band"))
    return df.withColumn("out_of_band", (F.col(x) < F.col("y_lower")) | (F.col(x) > F.col("y_upper"))).drop("_all")


def capacity_warning(df: DataFrame, s: Series, mode: str = "reference") -> DataFrame:
    """Whether the forecast of six rows ahead is above 80 % of capacity.

    Reference mode takes y_hat of that later row, which looks at rows in between (batch only); "intended" repeats the
    forecast known now.
    """
    if mode == "reference":
        df = written(df, "bands")
        cut, stretch = with_row_halo(df, s, 1, ahead=HORIZON)
        df = own_rows(cut.withColumn("forecast_ahead", F.lead("y_hat", HORIZON).over(stretch.window)))
    else:
        df = df.withColumn("forecast_ahead", F.col("y_hat"))
    return df.withColumn("early_warning", F.coalesce(F.col("forecast_ahead") > 0.8 * F.col("capacity"), F.lit(False)))


def forecast_breach(df: DataFrame, s: Series, x: str) -> DataFrame:
    """Six extrapolated values, and whether any is above the 90 % quantile of the rolling mean of 20."""
    cut, stretch = with_row_halo(df, s, 20)
    df = written(own_rows(cut.withColumns({"ahead": slope_ahead(F.col(x), stretch), "_mean": roll_mean(F.col(x), stretch, 20, 3)})), "slopes")
    limit = quantile_table(df, list(s.by), {"limit": ("_mean", 0.9)})
    out = df.join(limit, list(s.by)).drop("_mean")
    return out.withColumn("peak", F.array_max("ahead")).withColumn("breach", F.exists("ahead", lambda v: v > F.col("limit")))
