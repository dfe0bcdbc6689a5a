"""Readers of raw files. Bad rows never fail a job: they become nulls, are dropped, or are returned apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.clean import drop_empty_columns, to_number


def _stamp(c):
    return F.try_to_timestamp(c).cast("timestamp_ntz")


def logger_table(spark: SparkSession, path: str, columns: Sequence[str], time: str = "TIMESTAMP") -> DataFrame:
    """A logger's table: name, unit and process lines fall out as their first field is no time; NAN is null."""
    schema = ", ".join(f"`{c}` string" for c in [time, *columns])
    raw = spark.read.csv(path, schema=schema, mode="PERMISSIVE")
    return raw.select(_stamp(time).alias("time"), *[to_number(F.col(c)).alias(c) for c in columns]).where("time IS NOT NULL")


def add_milliseconds(df: DataFrame, time: str, ms: str) -> DataFrame:
    """A time to the second plus a column of milliseconds, null as 0."""
    return df.withColumn(time, F.col(time) + F.make_dt_interval(secs=F.coalesce(F.col(ms), F.lit(0)) / 1000)).drop(ms)


def wide_csv(spark: SparkSession, path: str, time: str, exclude: Sequence[str] = ("wind.*", ".*time")) -> DataFrame:
    """A table with a header: names cleaned, excluded patterns dropped, true and false as 1 and 0, empty columns dropped."""
    import re

    raw = spark.read.csv(path, header=True)
    names = {c: re.sub(r"\W+", "_", c.strip()).strip("_") for c in raw.columns}
    keep = [c for c in raw.columns if c != time and not any(re.fullmatch(p, names[c], re.I) for p in exclude)]
    value = lambda c: F.when(F.lower(F.trim(c)).isin("true", "false"), (F.lower(F.trim(c)) == "true").cast("double")).otherwise(to_number(F.trim(c)))
    rows = raw.select(_stamp(F.col(f"`{time}`")).alias("time"), *[value(F.col(f"`{c}`")).alias(names[c]) for c in keep]).where("time IS NOT NULL")
    return drop_empty_columns(rows, ["time"])


def local_csv(spark: SparkSession, path: str, columns: Sequence[str], zone: str) -> DataFrame:
    """A table with a header and local times, which become UTC."""
    raw = spark.read.csv(path, header=True)
    time = F.to_utc_timestamp(F.try_to_timestamp(F.col("timestamp")), zone).cast("timestamp_ntz")
    return raw.select(time.alias("time"), *[to_number(F.col(c)).alias(c) for c in columns]).where("time IS NOT NULL")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed ones are skipped."""
    raw = spark.read.schema(f"{schema}, _corrupt string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    return raw.where("_corrupt IS NULL").drop("_corrupt")


def tier_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines `<time>: Tier change <from> <to>`, and the lines that are neither that nor blank."""
    pattern = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d): Tier change (\d+) (\d+)\s*$"
    raw = spark.read.text(path).where(F.trim("value") != "")
    part = lambda i: F.regexp_extract("value", pattern, i)
    good = raw.where(F.col("value").rlike(pattern)).select(_stamp(part(1)).alias("time"), F.lit("tier_change").alias("event_type"), part(2).cast("int").alias("before"), part(3).cast("int").alias("after"))
    return good.where("time IS NOT NULL"), raw.where(~F.col("value").rlike(pattern)).select("value")


def outlets_wide(long: DataFrame, outlets: Sequence[int]) -> DataFrame:
    """time, outlet, watts, name, seq in rows -> a column of watts per outlet; of repeated rows the last counts."""
    last = long.groupBy("time", "outlet").agg(F.max_by("watts", "seq").alias("watts"))
    wide = last.groupBy("time").pivot("outlet", list(outlets)).agg(F.first("watts"))
    return wide.select("time", *[F.col(str(o)).alias(f"outlet{o}_watts") for o in outlets])


def outlet_names(long: DataFrame) -> DataFrame:
    """The most frequent label of each outlet, the least of several."""
    n = long.groupBy("outlet", "name").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("outlet").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("name"))


def dated_files(files: DataFrame, start: str, pattern: str = r"_(\d{8}_\d{4})\.") -> DataFrame:
    """path -> path, time from its name, not before `start`; names without a date are left out."""
    stamp = F.try_to_timestamp(F.regexp_extract("path", pattern, 1), F.lit("yyyyMMdd_HHmm")).cast("timestamp_ntz")
    return files.withColumn("time", stamp).where(F.col("time") >= F.lit(start).cast("timestamp_ntz"))


def prefer_nested(files: DataFrame) -> DataFrame:
    """Of files with one name, those in a folder; flat ones stay only where there is no nested one."""
    f = files.withColumns({"name": F.regexp_extract("path", r"([^/]+)$", 1), "nested": F.col("path").contains("/")})
    return f.withColumn("any", F.max("nested").over(Window.partitionBy("name"))).where(F.col("nested") | ~F.col("any")).drop("any")


def readable(files: DataFrame, signatures: Sequence[str | bytes]) -> DataFrame:
    """path, length, head (first 8 bytes) -> with `reason`: null if the file can be read."""
    known = F.col("head").isin(*[F.lit(s.encode() if isinstance(s, str) else s) for s in signatures])
    return files.withColumn("reason", F.when(F.coalesce(F.col("length"), F.lit(0)) == 0, "empty").when(~F.coalesce(known, F.lit(False)), "unknown signature"))


def assemble_profile(df: DataFrame, low: str, high: str, step: float = 10.0, sentinel: float = -900.0) -> DataFrame:
    """Two arrays of gates per row as one, in dB, exploded to gate and range; values at or below the sentinel are null."""
    from ..functions.exprs import decibel

    keys = [c for c in df.columns if c not in (low, high)]
    return df.select(*keys, F.posexplode(F.concat(low, high)).alias("gate", "raw")).select(*keys, "gate", (F.col("gate") * step).alias("range_m"), decibel(F.when(F.col("raw") > sentinel, F.col("raw"))).alias("db"))


def nearest_cell(grid: DataFrame, lat: float, lon: float) -> DataFrame:
    """The cell whose latitude and whose longitude (0 to 360) are each nearest, the lower of two."""
    near = grid.agg(F.min_by("lat", F.struct(F.abs(F.col("lat") - lat), "lat")).alias("a"), F.min_by("lon", F.struct(F.abs(F.col("lon") - lon % 360), "lon")).alias("o"))
    return grid.join(F.broadcast(near), (F.col("lat") == F.col("a")) & (F.col("lon") == F.col("o"))).drop("a", "o")


def annotations(spark: SparkSession, path: str, kits: Sequence[str]) -> DataFrame:
    """Operators' notes: time_utc, action, kit, note; only known kits, on or off and times that parse."""
    raw = spark.read.csv(path, header=True, schema="time_utc string, action string, kit string, note string")
    ok = raw.withColumn("time", _stamp("time_utc")).where(F.col("time").isNotNull() & F.lower("action").isin("on", "off") & F.col("kit").isin(*kits))
    return ok.select("time", F.lower("action").alias("action"), "kit", "note")


def manifest(files: DataFrame, group: str, most: int) -> DataFrame:
    """Per group: number and bytes of all files, the first `most` paths, and a digest of all paths and sizes.

    The digest is the sum of the entries' hashes, so that no group has to be gathered to be digested.
    """
    w = Window.partitionBy(group).orderBy("path")
    listed = files.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).groupBy(group).agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("listed"))
    entry = F.conv(F.substring(F.sha2(F.concat_ws("|", "path", F.col("size").cast("string")), 256), 1, 8), 16, 10).cast("long")
    return files.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.sum(entry).alias("digest")).join(listed, group)


def camera_index(files: DataFrame) -> DataFrame:
    """path -> camera, time, name of files `<camera>/<day>/<camera>_<stamp>.jpg` whose folder agrees with the name."""
    p = r"^([^/]+)/(\d{8})/([^/_]+)_(\d{8})_(\d{4})\.jpg$"
    x = lambda i: F.regexp_extract("path", p, i)
    ok = files.where(F.col("path").rlike(p)).where((x(1) == x(3)) & (x(2) == x(4)))
    time = F.try_to_timestamp(F.concat_ws("_", x(4), x(5)), F.lit("yyyyMMdd_HHmm")).cast("timestamp_ntz")
    return ok.select(x(3).alias("camera"), time.alias("time"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name")).where("time IS NOT NULL")
