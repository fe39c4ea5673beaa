"""Data quality, distributions, correlation, resampling, aggregates, sorts and sets."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import explore, features
from ..operators.quantiles import with_quantiles
from ..sources.adapters import EV_SQL, WIDE_SQL, ev_series, ev_wide, read
from .base import query, r6
from .feature_queries import PORTS, RATIOS_SQL, TOTALS_SQL

S = W.Series()
O = "PARTITION BY entity ORDER BY ts, event_id"  # noqa: E741


@query(
    f"""WITH {EV_SQL}, st AS (SELECT *, us - lag(us) OVER ({O}) AS st FROM ev), u AS (SELECT entity, quantile_cont(st, 0.5) AS usual FROM st WHERE st IS NOT NULL GROUP BY entity)
    SELECT entity, count(*) AS rows, count(*) FILTER (value IS NULL) AS nulls, count(*) FILTER (st = 0) AS duplicate_times, count(*) FILTER (value < 0) AS negatives, count(*) FILTER (value = 0) AS zeros, count(*) FILTER (st <> usual) AS irregular,
    floor((max(us) - min(us)) / max(usual) + 1)::BIGINT AS expected FROM st LEFT JOIN u USING (entity) GROUP BY entity"""
)
def dq_report(spark, d):
    return explore.quality_report(ev_series(spark, d), S, "value")


_SHAPE = """sh AS (SELECT entity, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3,
  stddev_pop(value) AS sp FROM ev GROUP BY entity), mo AS (SELECT entity, avg(((value - mean) / sp) ** 3) AS skew, avg(((value - mean) / sp) ** 4) - 3 AS kurtosis FROM ev JOIN sh USING (entity) GROUP BY entity)"""


@query(
    f"WITH {EV_SQL}, {_SHAPE} SELECT sh.entity, n, round(mean, 6) AS mean, round(std, 6) AS std, lo AS min, hi AS max, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(skew, 5) AS skew, round(kurtosis, 5) AS kurtosis, round(std / mean, 6) AS cv, "
    "CASE WHEN abs(skew) > 1.5 THEN 'strong' WHEN abs(skew) > 0.5 THEN 'moderate' ELSE 'symmetric' END AS skew_verdict, CASE WHEN std / mean > 0.4 THEN 'volatile' WHEN std / mean > 0.15 THEN 'moderate' ELSE 'steady' END AS cv_verdict FROM sh JOIN mo USING (entity)"
)
def moments_shape(spark, d):
    df = explore.diagnosis(explore.shape(ev_series(spark, d), "value", "entity"))
    digits = {c: 6 for c in ("mean", "std", "q1", "median", "q3", "cv")} | {"skew": 5, "kurtosis": 5}
    return df.select(*(r6(F.col(c), digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns))


_ACF = f"lagged AS (SELECT entity, value AS x, {', '.join(f'lag(value, {k}) OVER ({O}) AS l{k}' for k in range(1, 61))} FROM ev), wide AS (SELECT entity, count(x) AS n, {', '.join(f'corr(x, l{k}) AS r{k}' for k in range(1, 61))} FROM lagged GROUP BY entity), acf AS (SELECT * FROM (SELECT entity, n, unnest(range(0, 61))::INT AS lag, unnest([1.0, {', '.join(f'r{k}' for k in range(1, 61))}]) AS r FROM wide) WHERE lag <= n // 3)"


@query(f"WITH {EV_SQL}, {_ACF} SELECT entity, lag, round(r, 6) AS r, round(1.96 / sqrt(n), 6) AS band FROM acf")
def acf(spark, d):
    df = explore.autocorrelation(ev_series(spark, d), S, "value")
    return df.select("entity", "lag", r6(F.col("r")).alias("r"), r6(F.col("band")).alias("band"))


@query(f"WITH {EV_SQL}, {_ACF} SELECT entity, max(lag) AS longest, 4 * max(lag) AS longest_times_4 FROM acf WHERE lag > 0 AND abs(r) > 1.96 / sqrt(n) GROUP BY entity")
def window_suggestion(spark, d):
    return explore.window_suggestion(explore.autocorrelation(ev_series(spark, d), S, "value"), "entity")


@query(f"WITH {EV_SQL}, {_ACF}, k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY abs(r) DESC, lag) AS rn FROM acf WHERE lag > 0) SELECT entity, lag, rn::INT AS rank FROM k WHERE rn <= 10")
def top_lags(spark, d):
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.abs("r").desc(), "lag"))
    df = explore.autocorrelation(ev_series(spark, d), S, "value").where("lag > 0").withColumn("rank", rank)
    return df.where("rank <= 10").select("entity", "lag", "rank")


def _resample_sql(m: int) -> str:
    w = m * 60_000_000
    return f"""b{m} AS (SELECT entity, us - us % {w} AS bucket, avg(value) AS mean, count(*) AS n FROM ev GROUP BY ALL), s{m} AS (SELECT entity, unnest(range(min(bucket), max(bucket) + 1, {w})) AS bucket FROM b{m} GROUP BY entity),
    o{m} AS (SELECT {m} AS minutes, entity, bucket, round(mean, 6) AS mean, coalesce(n, 0) AS rows FROM s{m} LEFT JOIN b{m} USING (entity, bucket))"""


@query(f"WITH {EV_SQL}, {', '.join(_resample_sql(m) for m in (15, 30, 60))} SELECT * FROM o15 UNION ALL SELECT * FROM o30 UNION ALL SELECT * FROM o60")
def resample_multi(spark, d):
    ev, out = ev_series(spark, d), None
    for m in (15, 30, 60):
        df = explore.resample_mean(ev, S, "value", m).select(F.lit(m).alias("minutes"), "entity", "bucket", r6(F.col("mean")).alias("mean"), "rows")
        out = df if out is None else out.unionByName(df)
    return out


@query(f"WITH {EV_SQL}, {', '.join(_resample_sql(m) for m in (15, 60))}, u AS (SELECT * FROM o15 UNION ALL SELECT * FROM o60) SELECT minutes, entity, count(mean) AS buckets, round(max(mean), 6) AS peak, round(stddev_samp(mean) / avg(mean), 6) AS cv, round(sum(rows) / count(mean), 6) AS compression FROM u GROUP BY minutes, entity")
def resolution_summary(spark, d):
    ev, out = ev_series(spark, d), None
    for m in (15, 60):
        df = explore.resample_mean(ev, S, "value", m).withColumn("minutes", F.lit(m)).withColumn("mean", r6(F.col("mean")))
        out = df if out is None else out.unionByName(df)
    return out.groupBy("minutes", "entity").agg(F.count("mean").alias("buckets"), F.max("mean").alias("peak"), r6(F.stddev_samp("mean") / F.avg("mean")).alias("cv"), r6(F.sum("rows") / F.count("mean")).alias("compression"))


@query(
    "WITH c AS (SELECT least(greatest(floor(value / 12.5) + 1, 1), 40)::INT AS bin, count(*) AS n FROM events GROUP BY 1), s AS (SELECT avg(value) AS m, stddev_samp(value) AS d, count(*) AS total FROM events) "
    "SELECT g.bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / (total * 12.5), 8) AS density, round(exp(-0.5 * (((g.bin - 0.5) * 12.5 - m) / d) ** 2) / (d * sqrt(2 * pi())), 8) AS normal_pdf FROM (SELECT unnest(range(1, 41))::INT AS bin) g LEFT JOIN c USING (bin), s"
)
def histogram_density(spark, d):
    ev = read(spark, d, "events")
    stats = ev.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("d"), F.count(F.lit(1)).alias("total"))  # one row
    df = explore.histogram(ev, "value", 0.0, 500.0, 40).crossJoin(F.broadcast(stats))
    mid = (F.col("bin") - 0.5) * 12.5
    pdf = F.exp(-0.5 * F.pow((mid - F.col("m")) / F.col("d"), 2)) / (F.col("d") * F.sqrt(2 * F.pi()))
    return df.select("bin", "n", r6(F.col("n") / (F.col("total") * 12.5), 8).alias("density"), r6(pdf, 8).alias("normal_pdf"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r_price, round(corr(l_discount, l_tax), 6) AS r_tax, round(avg(l_quantity), 6) AS mean_quantity, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, count(DISTINCT l_suppkey) AS suppliers, round(sum((l_discount > 0.05)::INT) / count(*), 6) AS discount_share FROM lineitem GROUP BY ALL")
def grouped_statistics(spark, d):
    df = read(spark, d, "lineitem")
    by = ["l_returnflag", "l_linestatus"]
    summary = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), r6(F.corr("l_quantity", "l_extendedprice")).alias("r_price"), r6(F.corr("l_discount", "l_tax")).alias("r_tax"), r6(F.avg("l_quantity")).alias("mean_quantity"),
        F.count_distinct("l_suppkey").alias("suppliers"), r6(F.sum((F.col("l_discount") > 0.05).cast("int")) / F.count(F.lit(1))).alias("discount_share"),
    )
    return with_quantiles(summary, df, by, {"p90": ("l_extendedprice", 0.9)}).withColumn("p90", r6(F.col("p90"), 4))


_SEGMENT = "CASE WHEN rn < 50 THEN 'base' WHEN rn >= 60 AND rn < 80 THEN 'A' WHEN rn >= 100 AND rn < 120 THEN 'B' WHEN rn >= 140 AND rn < 160 THEN 'C' END"


@query(
    f"""WITH {WIDE_SQL}, {TOTALS_SQL}, {RATIOS_SQL}, num AS (SELECT port, traffic_total, error_rate, OUTOCTETS / (INOCTETS + OUTOCTETS + 1e-9) AS tx_ratio, row_number() OVER (PARTITION BY port ORDER BY us) - 1 AS rn FROM feat),
    g AS (SELECT port, {_SEGMENT} AS segment, count(*) AS rows, avg(traffic_total) AS t, avg(error_rate) AS e, avg(tx_ratio) AS x FROM num WHERE {_SEGMENT} IS NOT NULL GROUP BY ALL),
    l AS (SELECT port, segment, rows, 'traffic_total' AS metric, t AS mean, 0 AS eps FROM g UNION ALL SELECT port, segment, rows, 'error_rate', e, 1e-9 FROM g UNION ALL SELECT port, segment, rows, 'tx_ratio', x, 0 FROM g)
    SELECT l.port, l.segment, l.metric, l.rows, round(l.mean, 5) AS mean, round(l.mean / nullif(b.mean + b.eps, 0), 5) AS multiplier FROM l LEFT JOIN l b ON b.segment = 'base' AND b.port = l.port AND b.metric = l.metric WHERE l.segment <> 'base'"""
)
def segment_multipliers(spark, d):
    """Three ranges of each port's rows against its first fifty, over three metrics."""
    df = features.traffic_ratios(features.traffic_totals(ev_wide(spark, d)))
    df = df.withColumn("tx_ratio", F.col("OUTOCTETS") / (F.col("INOCTETS") + F.col("OUTOCTETS") + 1e-9))
    out = explore.segment_multipliers(df, PORTS, {"traffic_total": 0.0, "error_rate": 1e-9, "tx_ratio": 0.0}, {"A": (60, 80), "B": (100, 120), "C": (140, 160)}, (0, 50))
    return out.select("port", "segment", "metric", "rows", r6(F.col("mean"), 5).alias("mean"), r6(F.col("multiplier"), 5).alias("multiplier"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_summary(spark, d):
    return read(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, count(DISTINCT event_type) AS n_types, max_by(value, event_id) AS last_value, min(value) AS lo, max(value) AS hi FROM events GROUP BY user_id")
def distinct_join(spark, d):
    types = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    return read(spark, d, "events").groupBy("user_id").agg(types.alias("types"), F.count_distinct("event_type").alias("n_types"), F.max_by("value", "event_id").alias("last_value"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("SELECT t.k AS event_type, coalesce(n, 0) AS n FROM (VALUES ('click'), ('view'), ('purchase'), ('none')) t(k) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) c ON t.k = c.event_type")
def fixed_categories(spark, d):
    counts = read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(k,) for k in ("click", "view", "purchase", "none")], "event_type string")
    return every.join(counts, "event_type", "left").fillna(0, ["n"])


@query("WITH m AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, min_by(event_type, (-n, event_type)) AS label FROM m GROUP BY user_id".replace("min_by(event_type, (-n, event_type))", "arg_min(event_type, row(-n, event_type))"))
def mode_label(spark, d):
    from ..operators.joins import majority_label

    return majority_label(read(spark, d, "events"), "user_id", "event_type").withColumnRenamed("event_type", "label")


@query("SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id ORDER BY total DESC, user_id LIMIT 15")
def top_groups(spark, d):
    df = read(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return df.orderBy(F.col("total").desc(), "user_id").limit(15)


@query("WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), b AS (SELECT DISTINCT user_id FROM events WHERE value > 300) SELECT 'both' AS side, user_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_errors', user_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def set_operations(spark, d):
    ev = read(spark, d, "events")
    a, b = ev.where("event_type = 'error'").select("user_id").distinct(), ev.where("value > 300").select("user_id").distinct()
    side = lambda x, n: x.select(F.lit(n).alias("side"), "user_id")
    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "only_errors"))


@query("WITH a AS (SELECT user_id, list(DISTINCT event_type) AS types FROM events GROUP BY 1) SELECT user_id, list_has_all(types, ['click', 'view']) AS reads, list_has_any(types, ['purchase', 'none']) AS buys, len(list_filter(['error', 'signup'], lambda t: NOT list_contains(types, t)))::INT AS missing FROM a")
def array_membership(spark, d):
    df = read(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    lit = lambda *x: F.array(*map(F.lit, x))
    return df.select("user_id", (F.size(F.array_except(lit("click", "view"), "types")) == 0).alias("reads"), F.arrays_overlap("types", lit("purchase", "none")).alias("buys"), F.size(F.array_except(lit("error", "signup"), "types")).alias("missing"))


@query("WITH p AS (SELECT *, (props::JSON->>'$.k')::BIGINT AS k FROM events) SELECT event_type, coalesce(k, -1) AS k, count(*) AS n FROM p GROUP BY ALL")
def json_fields(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return read(spark, d, "events").groupBy("event_type", F.coalesce(k, F.lit(-1)).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {EV_SQL}, r AS (SELECT entity, value, user_id, lag(value) OVER ({O}) AS l1, lag(value, 3) OVER ({O}) AS l3, CASE WHEN count(value) OVER a >= 15 THEN avg(value) OVER a END AS m, row_number() OVER ({O}) AS rn FROM ev WINDOW a AS ({O} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
    d AS (SELECT *, abs(value - m) / (abs(m) + 1e-9) AS dv, value > 150 AS f FROM r), h AS (SELECT *, sum(f::INT) OVER (PARTITION BY entity ORDER BY rn ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) >= 2 AS held FROM d),
    t AS (SELECT entity, (max(us) - min(us)) / 3.6e9 AS hours FROM ev GROUP BY entity),
    s AS (SELECT h.entity, corr(value, l1) AS acf1, corr(value, l3) AS lag3, corr(value, user_id) AS c, avg((m IS NULL)::INT) AS warm, avg(f::INT) AS share, sum(f::INT) / max(hours) AS ph, 150 / quantile_cont(value, 0.95) AS thr, 1 - sum(held::INT) / greatest(sum(f::INT), 1) AS db, max(dv) / quantile_cont(dv, 0.9) AS dvr FROM h JOIN t ON h.entity = t.entity GROUP BY h.entity)
    SELECT entity, round(acf1, 5) AS acf1, round(share, 6) AS alert_share, round(ph, 5) AS alerts_per_hour, CASE WHEN acf1 > 0.7 THEN 'strong' WHEN acf1 > 0.4 THEN 'moderate' ELSE 'weak' END AS acf_verdict, CASE WHEN abs(lag3) > 0.7 THEN 'strong' WHEN abs(lag3) > 0.35 THEN 'moderate' ELSE 'weak' END AS lag_verdict,
    CASE WHEN abs(c) > 0.97 THEN 'redundant' ELSE 'distinct' END AS correlation_verdict, CASE WHEN warm > 0.3 THEN 'too long' ELSE 'fine' END AS warm_up_verdict, CASE WHEN share > 0.12 THEN 'too many' WHEN share > 0.005 THEN 'fine' ELSE 'too few' END AS alert_share_verdict,
    CASE WHEN ph > 5 THEN 'too many' WHEN ph > 0.1 THEN 'fine' ELSE 'too few' END AS alerts_per_hour_verdict, CASE WHEN thr > 1.5 THEN 'high' WHEN thr > 0.8 THEN 'fine' ELSE 'low' END AS threshold_verdict, CASE WHEN db > 0.9 THEN 'too strict' WHEN db > 0.1 THEN 'fine' ELSE 'no effect' END AS deadband_verdict, CASE WHEN dvr > 1.5 THEN 'change' ELSE 'none' END AS divergence_verdict FROM s"""
)
def verdict_report(spark, d):
    """All verdicts over one table of summary numbers of a threshold of 150."""
    cut, s = W.with_row_halo(ev_series(spark, d), S, 31)
    x, flag = F.col("value"), F.col("value") > 150
    m = W.roll_mean(x, s, 30, 15)
    df = W.own_rows(cut.withColumns({"l1": F.lag(x).over(s.window), "l3": F.lag(x, 3).over(s.window), "m": m, "held": W.deadband(flag, s, 2)}))
    df = df.withColumn("dv", F.abs(x - F.col("m")) / (F.abs("m") + 1e-9))
    n = F.sum(flag.cast("int"))
    numbers = df.groupBy("entity").agg(
        F.corr("value", "l1").alias("acf1"), F.abs(F.corr("value", "l3")).alias("lag3"), F.abs(F.corr("value", "user_id")).alias("c"), F.avg(F.col("m").isNull().cast("int")).alias("warm"), F.avg(flag.cast("int")).alias("alert_share"), (n / ((F.max("us") - F.min("us")) / 3.6e9)).alias("alerts_per_hour"),
        F.max("dv").alias("_most"), (1 - F.sum(F.col("held").cast("int")) / F.greatest(n, F.lit(1))).alias("db"),
    )
    numbers = with_quantiles(numbers, df, ["entity"], {"_p95": ("value", 0.95), "_p90": ("dv", 0.9)}).withColumns({"thr": 150 / F.col("_p95"), "dvr": F.col("_most") / F.col("_p90")})
    names = {"acf_verdict": "acf1", "lag_verdict": "lag3", "correlation_verdict": "c", "warm_up_verdict": "warm", "alert_share_verdict": "alert_share", "alerts_per_hour_verdict": "alerts_per_hour", "threshold_verdict": "thr", "deadband_verdict": "db", "divergence_verdict": "dvr"}
    out = explore.verdicts(numbers, names)
    return out.select("entity", r6(F.col("acf1"), 5).alias("acf1"), r6(F.col("alert_share")).alias("alert_share"), r6(F.col("alerts_per_hour"), 5).alias("alerts_per_hour"), *names)
