"""Sources: telemetry and catalog CSV, round-robin-database text, exposition text, the stream of a table's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTERS = ("INERRORS", "OUTERRORS", "INDISCARDS", "OUTDISCARDS", "INUNKNOWNPROTOS", "INUCASTPKTS", "OUTUCASTPKTS", "INNUCASTPKTS", "OUTNUCASTPKTS", "INBROADCASTPKTS", "OUTBROADCASTPKTS", "INMULTICASTPKTS", "OUTMULTICASTPKTS")

TELEMETRY = T.StructType(
    [T.StructField("timestamp", T.TimestampType()), *(T.StructField(c, T.StringType()) for c in ("device_id", "port_id", "port_role")), *(T.StructField(c, T.DoubleType()) for c in ("INOCTETS", "OUTOCTETS"))]
    + [T.StructField(c, T.LongType()) for c in COUNTERS]
    + [T.StructField(c, T.StringType()) for c in ("event_label", "event_id")]
)


def telemetry_csv(spark: SparkSession, path: str, schema: T.StructType = TELEMETRY) -> DataFrame:
    """Telemetry with a declared schema. Rows aren't sorted here: order is made where it is looked at."""
    return spark.read.schema(schema).csv(path, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss")


def catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """The event catalog. Its start times have minutes only and its end times seconds."""
    raw = spark.read.schema("event_id string, event_type string, port_id string, start_time string, periods_5min int, description string, end_time string").csv(path, header=True)
    time = lambda c: F.coalesce(F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd HH:mm")))
    return raw.withColumn("start_time", time("start_time")).withColumn("end_time", time("end_time"))


def rrd_fetch(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Lines `time: v v v` as epoch, name, value; nan is null and rows that don't fit are left out.

    names: the header's columns. Without them they are read from the file: its first line without a colon.
    """
    lines = spark.read.text(path)
    if names is None:
        head = lines.where("value not like '%:%' and trim(value) != ''").limit(1).collect()
        names = head[0]["value"].split() if head else []
    parts = F.split(F.trim(F.split_part("value", F.lit(":"), F.lit(2))), r"\s+")
    rows = lines.where(F.col("value").rlike(r"^\s*\d+:")).select(F.trim(F.split_part("value", F.lit(":"), F.lit(1))).try_cast("long").alias("epoch"), parts.alias("parts"))
    rows = rows.where((F.size("parts") == len(names)) & F.forall("parts", lambda p: p.rlike(r"(?i)^-?nan$") | p.try_cast("double").isNotNull()))
    labels = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    pairs = F.arrays_zip(labels.alias("name"), F.col("parts").alias("part"))
    long = rows.select("epoch", F.explode(pairs).alias("p"))
    value = F.when(~F.col("p.part").rlike(r"(?i)^-?nan$"), F.col("p.part").try_cast("double"))
    return long.select("epoch", F.col("p.name").alias("name"), value.alias("value"))


def consolidate(df: DataFrame, seconds: int, how: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """AVERAGE, MIN, MAX or LAST (of one time's values the largest) of each name and step, between start and end (epochs, both inside)."""
    functions = {"AVERAGE": F.avg("value"), "MIN": F.min("value"), "MAX": F.max("value"), "LAST": F.max_by("value", F.struct("epoch", "value"))}
    if how not in functions:
        raise ValueError(f"{how!r} is no consolidation; there are {sorted(functions)}")
    if start is not None:
        df = df.where(F.col("epoch") >= start)
    if end is not None:
        df = df.where(F.col("epoch") <= end)
    return df.where("value is not null").groupBy("name", (F.floor(F.col("epoch") / seconds) * seconds).alias("step")).agg(functions[how].alias("value"))


def rrd_info(spark: SparkSession, path: str) -> DataFrame:
    """Lines `key = value` as key, value; quotes around a value go."""
    parts = F.split("value", " = ", 2)
    return spark.read.text(path).where(F.contains("value", F.lit(" = "))).select(F.trim(F.get(parts, F.lit(0))).alias("key"), F.regexp_replace(F.trim(F.get(parts, F.lit(1))), '^"|"$', "").alias("value"))


def exposition(spark: SparkSession, path: str) -> DataFrame:
    """Exposition text as metric, labels (map), value; comments go."""
    line = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+(\S+)"
    text = spark.read.text(path).where("value not like '#%' and trim(value) != ''")
    pairs = F.regexp_extract_all(F.regexp_extract("value", line, 2), F.lit(r'([A-Za-z_][A-Za-z0-9_]*)="([^"]*)"'), F.lit(0))
    entry = lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), F.regexp_replace(F.substring_index(p, "=", -1), '"', "").alias("v"))
    return text.select(F.regexp_extract("value", line, 1).alias("metric"), F.map_from_entries(F.transform(pairs, entry)).alias("labels"), F.regexp_extract("value", line, 3).try_cast("double").alias("value")).where("metric != ''")


def file_stream(spark: SparkSession, sf_dir: str, name: str, **options: str) -> DataFrame:
    """A table's Parquet files as a stream, whether the table is a file or a folder."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    stream = spark.readStream.schema(schema).options(**options)
    return stream.parquet(path) if folder else stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
