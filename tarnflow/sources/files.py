"""File sources and sinks for counts, hub distributions, forecasts and metric stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COUNTS = "ZSID string, ZSName string, Hoehe double, EKoord double, NKoord double, MessungDatZeit string, AnzFahrzeuge double"

FORECASTS = "series_id string, idx bigint, y double, y_hat double"


def scan_counts(spark: SparkSession, template: str, year: int | str = 2026, schema: str = COUNTS) -> DataFrame:
    """Yearly CSV of counts; the time is parsed, NaN becomes null."""
    df = spark.read.schema(schema).option("header", True).csv(template.format(year=year))
    return df.withColumn("t", F.to_timestamp_ntz("MessungDatZeit")).withColumn("AnzFahrzeuge", F.nanvl("AnzFahrzeuge", F.lit(None).cast("double")))


def scan_wide(spark: SparkSession, path: str, time: str = "t") -> DataFrame:
    """Wide CSV, one column a hub, as long rows (series_id, t, y); missing values are 0."""
    df = spark.read.option("header", True).csv(path)
    hubs = [c for c in df.columns if c != time]
    return df.unpivot(time, hubs, "series_id", "y").select("series_id", F.to_timestamp_ntz(time).alias("t"), F.coalesce(F.expr("try_cast(y AS double)"), F.lit(0.0)).alias("y"))


def scan_forecasts(spark: SparkSession, glob: str, schema: str = FORECASTS) -> DataFrame:
    """Forecast files with the model read off each name (forecast_<model>.csv); rows with a null are dropped."""
    df = spark.read.schema(schema).option("header", True).csv(glob)
    return df.na.drop("any").withColumn("model", F.regexp_extract(F.col("_metadata.file_path"), r"forecast_(.*?)\.csv", 1))


def scan_folders(spark: SparkSession, glob: str) -> DataFrame:
    """Text files under folders named <pair>_<hub>_<month>: (pair, hub, value)."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return spark.read.text(glob).select(F.split_part(name, F.lit("_"), F.lit(1)).alias("pair"), F.split_part(name, F.lit("_"), F.lit(2)).alias("hub"), "value")


def scan_metric_store(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON of series -> model -> metric -> value as long rows: one object a file, or one a line."""
    raw = spark.read.text(path, wholetext=not lines).select(F.from_json("value", "map<string,map<string,map<string,double>>>").alias("m"))
    a = raw.select(F.explode("m").alias("series", "m"))
    return a.select("series", F.explode("m").alias("model", "m")).select("series", "model", F.explode("m").alias("metric", "value"))


def write_metric_store(scores: DataFrame, path: str) -> None:
    """(series, model, metric, value) as one JSON object a line: {series: {model: {metric: value}}}."""
    entries = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    a = scores.groupBy("series", "model").agg(entries("metric", "value").alias("m"))
    b = a.groupBy("series").agg(entries("model", "m").alias("m"))
    b.select(F.to_json(F.create_map("series", "m")).alias("value")).write.mode("overwrite").text(path)


def write_forecasts(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("model").parquet(path)


def not_yet_written(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks whose output isn't there yet."""
    return tasks.join(done.select(keys).distinct(), keys, "left_anti")


def scan_latin1(spark: SparkSession, path: str, schema: str, dates: tuple[str, ...] = ()) -> DataFrame:
    """CSV in ISO 8859-1, with date columns parsed."""
    df = spark.read.schema(schema).option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return df.withColumns({c: F.to_date(c) for c in dates})


def window_slice(df: DataFrame, start: str, hours: int, series: str = "series_id", time: str = "t") -> DataFrame:
    """The first `hours` rows of each series from a time on, with the time as text."""
    w = Window.partitionBy(series).orderBy(time)
    out = df.where(F.col(time) >= F.lit(start).cast("timestamp_ntz")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= hours).drop("rn")
    return out.withColumn(time, F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"))


def write_scores(per_origin: DataFrame, summary: DataFrame, path: str, label: str) -> None:
    """Scores of each origin and their summary, in folders of their own for each label; writing a label again replaces it."""
    for name, df in (("per_origin", per_origin), ("summary", summary)):
        df.withColumn("label", F.lit(label)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("label").parquet(f"{path}/{name}")


def write_ranking(rows: DataFrame, path: str) -> None:
    """Rows of some pairs of a leaderboard, each pair in a folder of its own, so that partial results survive and a pair can be done again."""
    rows.withColumn("pair", F.col("series_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pair").parquet(path)


def write_metrics_csv(scores: DataFrame, path: str, places: int = 2) -> None:
    """Metrics as CSV, rounded."""
    scores.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in scores.dtypes)).write.mode("overwrite").option("header", True).csv(path)


def write_hub_distribution(counts: DataFrame, hubs: list, path: str) -> None:
    """Counts (t, hub, n) as wide CSV, a column for each hub; a hub without a count is empty."""
    counts.groupBy("t").pivot("hub", hubs).agg(F.sum("n")).orderBy("t").write.mode("overwrite").option("header", True).csv(path)
