"""Feature chains over telemetry: totals, ratios, rolling statistics and the single-port variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EPSILON, plus_one_div, safe_div
from ..functions.scans import counter_rate
from ..functions.windows import Series, order_statistics, own_rows, roll_mean, roll_std, with_row_halo

#: Statistics of the multi-port chain: an hour is 12 rows, a day 288, and a quarter of a day has to be there.
HOUR, DAY, DAY_LEAST = 12, 288, 72
ROLLED = ("traffic_total", "error_rate", "discard_rate", "broadcast_total", "avg_packet_size")


def traffic_totals(df: DataFrame) -> DataFrame:
    """Sums of both directions for each kind of counter."""
    both = {
        "traffic_total": ("INOCTETS", "OUTOCTETS"),
        "ucast_total": ("INUCASTPKTS", "OUTUCASTPKTS"),
        "errors_total": ("INERRORS", "OUTERRORS"),
        "discards_total": ("INDISCARDS", "OUTDISCARDS"),
        "broadcast_total": ("INBROADCASTPKTS", "OUTBROADCASTPKTS"),
        "multicast_total": ("INMULTICASTPKTS", "OUTMULTICASTPKTS"),
    }
    return df.withColumns({name: F.col(a) + F.col(b) for name, (a, b) in both.items()})


def traffic_ratios(df: DataFrame) -> DataFrame:
    """Rates by unicast packets, packet size, the copy of unknown protocols, and asymmetry in [-1, 1]."""
    ucast = F.col("ucast_total")
    ratio = {new: safe_div(F.col(old), ucast) for new, old in (("error_rate", "errors_total"), ("discard_rate", "discards_total"), ("bcast_rate", "broadcast_total"), ("multicast_ratio", "multicast_total"))}
    both = F.col("INOCTETS") + F.col("OUTOCTETS")
    return df.withColumns(
        ratio
        | {
            "broadcast_ratio": safe_div(F.col("broadcast_total"), ucast),
            "unknown_total": F.col("INUNKNOWNPROTOS"),
            "avg_packet_size": safe_div(F.col("traffic_total"), ucast),
            "in_out_asymmetry": safe_div(F.col("INOCTETS") - F.col("OUTOCTETS"), both),
        }
    )


def rolling_features(df: DataFrame, s: Series, metrics=ROLLED) -> DataFrame:
    """Five statistics of each metric: mean and deviation of an hour, median, MAD and P95 of a day. One shuffle, one sort of each frame."""
    cut, stretch = with_row_halo(df, s, DAY)
    hourly, daily = {}, {}
    for m in metrics:
        hourly |= {f"{m}__mean_1h": roll_mean(F.col(m), stretch, HOUR, 6), f"{m}__std_1h": roll_std(F.col(m), stretch, HOUR, 6)}
        daily |= {f"{m}__median_1d": (m, DAY, DAY_LEAST, 0.5), f"{m}__mad_1d": (m, DAY, DAY_LEAST, "mad"), f"{m}__p95_1d": (m, DAY, DAY_LEAST, 0.95)}
    return order_statistics(cut.withColumns(hourly), stretch, daily)


def feature_table(df: DataFrame, s: Series) -> DataFrame:
    return rolling_features(traffic_ratios(traffic_totals(df)), s)


def counter_rates(df: DataFrame, s: Series, counters: dict[str, str]) -> DataFrame:
    """Per-second rates (new name -> counter), as the single-port chain reads its columns."""
    for new, old in counters.items():
        df = counter_rate(df.withColumn("_x", F.col(old).cast("double")), s, "_x", new).drop("_x")
    return df


def composites(rx: Column, tx: Column, errors: Column, packets: Column) -> dict[str, Column]:
    """traffic_total, error_rate and tx_ratio of the single-port chain."""
    total = rx + tx
    return {"traffic_total": total, "error_rate": plus_one_div(errors, packets), "tx_ratio": tx / (total + EPSILON)}


def lags(df: DataFrame, x: str, s: Series, steps=(1, 3, 6, 12), differences=()) -> DataFrame:
    """Add <x>_lag_<n>, the value n rows before, and <x>_diff_<n>, the rise since then."""
    cut, stretch = with_row_halo(df, s, max(*steps, *differences, 1) + 1)
    back = lambda n: F.lag(x, n).over(stretch.window)
    return own_rows(cut.withColumns({f"{x}_lag_{n}": back(n) for n in steps} | {f"{x}_diff_{n}": F.col(x) - back(n) for n in differences}))


class FeatureRegistry:
    """Named columns that a user adds to the chain; export() appends them and leaves out rows with a null."""

    def __init__(self) -> None:
        self.columns: dict[str, Column] = {}

    def add(self, name: str, column: Column) -> None:
        if name in self.columns:
            raise ValueError(f"there is a feature {name!r} already")
        self.columns[name] = column

    def export(self, df: DataFrame, base: list[str]) -> DataFrame:
        return df.withColumns(self.columns).select(*base, *self.columns).dropna()
