"""Incremental jobs as streams, run with `availableNow`: each may be repeated and goes on where its checkpoint is.

A job's output and checkpoint lie below the folder that it is given (`at`); without one they lie in a new folder of the
shared scratch space, which suits a query that runs once over a whole table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators.blocks import before
from ..operators.series import islands
from ..sources.scratch import folder, table


def source(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def run_to_table(stream: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """Append what a stream has now to a Parquet table and return the table."""
    spark = stream.sparkSession
    at = at or folder(spark, name)
    stream.writeStream.format("parquet").option("path", f"{at}/table").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/table")


def run_to_snapshot(stream: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """Write the whole result of an aggregation at each batch, under the batch's number, and return the newest; an empty table before the first.

    A batch that breaks off is written again before it counts as done, so the newest finished snapshot is always whole; older ones
    than the last two are deleted.
    """
    spark = stream.sparkSession
    at = at or folder(spark, name)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/table/batch={batch}")
        _forget(spark, f"{at}/table", batch - 1)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    done = [b for b in _batches(spark, f"{at}/table") if _finished(spark, f"{at}/table/batch={b}")]
    return spark.read.schema(stream.schema).parquet(f"{at}/table/batch={done[-1]}") if done else spark.createDataFrame([], stream.schema)


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _batches(spark: SparkSession, path: str) -> list[int]:
    fs, at = _path(spark, path)
    return sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(at) if "=" in x.getPath().getName()) if fs.exists(at) else []


def _finished(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def _forget(spark: SparkSession, path: str, before: int) -> None:
    """Delete the batches' folders with lower numbers than `before`."""
    for b in _batches(spark, path):
        if b < before:
            fs, at = _path(spark, f"{path}/batch={b}")
            fs.delete(at, True)


def repaired(spark: SparkSession, path: str, key: str, time: str, order: str) -> tuple[DataFrame, str]:
    """The table below `path` with strictly increasing times in each series, and the folder that holds it.

    If no two rows of a series share a time, the table stays as it is. Otherwise it is rebuilt beside the old one, which stays:
    of rows that share a time the one of least `order`, sorted by series and time inside each file.
    """
    rows = spark.read.parquet(path)
    steps = before(rows, key, time, [order]).where(F.unix_micros(F.col(time).cast("timestamp")) <= F.col("_before._t"))
    if steps.isEmpty():
        return rows, path
    at = f"{path}-rebuilt"
    w = Window.partitionBy(key, time).orderBy(order)
    first = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    first.repartitionByRange(key, time).sortWithinPartitions(key, time).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at), at


def frontier_append(stream: DataFrame, time: str, keys: list[str], lateness: str = "2 days") -> DataFrame:
    """Rows not seen before, later than the frontier less the lateness; repeats inside it are dropped by the state."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def window_counts(stream: DataFrame, time: str, keys: list[str], width: str, slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, lateness).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def held_back(files: DataFrame, modified: str, now: str, grace_s: int) -> DataFrame:
    """Files that are settled and earlier than the first that isn't: the frontier never passes a file still being written."""
    settled = F.col(modified) <= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(grace_s))
    first = files.agg(F.min(F.when(~settled, F.col("time"))).alias("_first"))
    return files.crossJoin(F.broadcast(first)).where(settled & (F.col("_first").isNull() | (F.col("time") < F.col("_first")))).drop("_first")


def align_schema(df: DataFrame, store: Mapping[str, str], policy: str = "drop", allowed: tuple[str, ...] = ()) -> DataFrame:
    """`df` in the columns of the store: missing ones null; extras are dropped, refused, or added if allowed."""
    extra = [c for c in df.columns if c not in store]
    if policy == "fail" and extra:
        raise ValueError(f"columns that the store doesn't have: {extra}")
    grown = [c for c in extra if c in allowed] if policy == "expand" else []
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in store.items()], *grown)


def retain(rows: DataFrame, key: list[str], issue: str, seq: str, days: int) -> DataFrame:
    """An archive after an append: the last row of a key stays, issues older than `days` before the newest go."""
    newest = rows.agg(F.max(issue).alias("_z"))
    last = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(seq)))).where("_rn = 1").drop("_rn")
    return last.crossJoin(F.broadcast(newest)).where(F.col(issue) >= F.col("_z") - F.make_dt_interval(F.lit(days))).drop("_z")


def upsert_log(rows: DataFrame, key: str, seq: str, keep: int) -> DataFrame:
    """A decision log: the last record of an id replaces earlier ones, the newest `keep` stay."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), seq).alias("r")).select("r.*")
    return last.orderBy(F.desc(seq)).limit(keep)


ALERTS = "id long, ts timestamp, kind string, nth long"
OPEN = "id long, `on` boolean, first long, sent long, last long, now long"


def alert_step(state: DataFrame, rows: DataFrame, hold_us: int, repeat_us: int) -> tuple[DataFrame, DataFrame]:
    """Notices and the new state of one batch: `rows` (id, ts, on) after `state` (see OPEN).

    A run of a condition gives `alert` once it has held, again after each repeat, and `recovery` at its end if it gave
    one. Notices have the time at which they fall due, so that a condition which holds needs no further row: whatever is
    due by the newest event of all ids (`now`) is sent. Rows that aren't later than the last of their id are late and left
    out. All is windows over the ids' rows, which spill, so an id may have any number of rows.
    """
    told = rows.select("id", micros("ts").alias("t"), F.coalesce("on", F.lit(False)).alias("on")).where("id IS NOT NULL AND t IS NOT NULL")
    now = told.agg(F.max("t").alias("a")).crossJoin(state.agg(F.max("now").alias("b"))).select(F.greatest("a", "b").alias("now")).first()["now"]  # a number
    new = told.join(state.select("id", "last"), "id", "left").where("last IS NULL OR t > last").groupBy("id", "t").agg(F.bool_or("on").alias("on"))
    none = F.lit(None).cast("long")
    both = state.select("id", F.col("last").alias("t"), "on", "first", "sent").union(new.select("id", "t", "on", none, none))
    runs = islands(both.withColumn("time", F.timestamp_micros("t")), "id", "time", "on").groupBy("id", "run", "on").agg(F.coalesce(F.min("first"), F.min("t")).alias("first"), F.coalesce(F.max("sent"), F.lit(0)).alias("sent"), F.max("t").alias("last"))
    ended = runs.withColumn("end", F.lead("first").over(Window.partitionBy("id").orderBy("run"))).withColumn("now", F.lit(now).cast("long"))
    # an end is itself no time of the condition
    until = F.coalesce(F.col("end") - 1, F.col("now"))
    n = F.when(F.col("on") & (until >= F.col("first") + hold_us), F.floor((until - F.col("first") - hold_us) / repeat_us) + 1).otherwise(0)
    due = table(ended.withColumn("n", F.greatest(n, F.col("sent"))), "due")  # notices and state are both taken from it
    alerts = due.where("on AND n > sent").select("id", "first", F.explode(F.sequence("sent", F.col("n") - 1)).alias("nth")).select("id", F.timestamp_micros(F.col("first") + hold_us + F.col("nth") * repeat_us).alias("ts"), F.lit("alert").alias("kind"), "nth")
    over = due.where("on AND end IS NOT NULL AND n > 0").select("id", F.timestamp_micros("end").alias("ts"), F.lit("recovery").alias("kind"), F.col("n").cast("long").alias("nth"))
    left = due.where("end IS NULL").select("id", "on", "first", F.col("n").cast("long").alias("sent"), "last", "now")
    return alerts.union(over), left


def alert_states(stream: DataFrame, at: str | None = None, hold_s: int = 3600, repeat_s: int = 43200) -> DataFrame:
    """The notices of a stream of id, ts, on (see alert_step), as a table of id, ts, kind, nth.

    Each batch reads the state that the one before wrote, a row an id, and writes notices and state under its own number,
    so that a repeated batch does no harm.
    """
    spark = stream.sparkSession
    at = at or folder(spark, "alerts")

    def step(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        state = session.read.schema(OPEN).parquet(f"{at}/state/batch={batch - 1}") if batch else session.createDataFrame([], OPEN)
        notices, left = alert_step(state, rows, hold_s * 1_000_000, repeat_s * 1_000_000)
        left.write.mode("overwrite").parquet(f"{at}/state/batch={batch}")
        notices.write.mode("overwrite").parquet(f"{at}/notices/batch={batch}")
        _forget(session, f"{at}/state", batch - 1)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not _batches(spark, f"{at}/notices"):
        return spark.createDataFrame([], ALERTS)
    return spark.read.schema(f"{ALERTS}, batch int").parquet(f"{at}/notices").drop("batch")
