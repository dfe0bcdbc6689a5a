"""Publishing only what has changed: a stream's rows are held against the inputs that their key was last seen with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators.blocks import before, filled
from ..sources.scratch import folder, table
from .store import Store
from .streams import _batches


def _differs(new: Column, old: Column, numeric: bool, tolerance: float) -> Column:
    same = F.abs(new - old) <= tolerance if numeric else new == old
    return new.isNotNull() & ~F.coalesce(same, F.lit(False))


def changed_rows(rows: DataFrame, key: str, time: str, inputs: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """`rows` with reasons: of each row the inputs whose value isn't that of the row before in its key, which a null doesn't change; rows without reasons are left out.

    Numbers that differ by `tolerance` at most are alike. A key's first row has all its inputs for reasons.
    """
    kinds = dict(rows.dtypes)
    known = rows
    for c in inputs:  # the last value that isn't null, up to each row
        known = filled(known, key, time, c, f"_now_{c}")
    seen = before(known, key, time, [f"_now_{c}" for c in inputs])
    why = [F.when(_differs(F.col(f"_now_{c}"), F.col("_before").getField(f"_now_{c}"), kinds[c] in ("double", "float", "int", "bigint"), tolerance), F.lit(c)) for c in inputs]
    return seen.withColumn("reasons", F.array_compact(F.array(*why))).where(F.size("reasons") > 0).drop("_before", *[f"_now_{c}" for c in inputs])


def publish_changes(stream: DataFrame, key: str, time: str, inputs: Sequence[str], at: str | None = None, tolerance: float = 1e-6, buckets: int = 16) -> DataFrame:
    """key, time, inputs and reasons of what a stream publishes (see changed_rows).

    The last inputs of each key lie in a merge store, of which a batch reads and rewrites the buckets of its own keys. A batch writes what it
    publishes under its number, then its keys' last inputs, which count the batch as done: a batch that comes again before is
    written over, one that comes again after is passed over. Rows that aren't later than the last of their key are late and left out.
    """
    spark = stream.sparkSession
    at = at or folder(spark, "published")
    names = [key, time, *inputs]
    store = Store(spark, f"{at}/state", [key], time, buckets)

    def step(rows: DataFrame, batch: int) -> None:
        if batch <= store.last_batch():
            return
        own = rows.select(*names).where(F.col(key).isNotNull() & F.col(time).isNotNull())
        last = store.read_of(own.select(key))
        new = own.withColumn("_old", F.lit(False))
        if last is not None:
            ended = last.select(key, F.col(time).alias("_last"))
            late = new.join(ended, key, "left").where(F.col("_last").isNull() | (micros(time) > micros("_last"))).drop("_last")
            new = late.unionByName(last.select(*names).withColumn("_old", F.lit(True)))
        both = table(new, "batch")
        changed_rows(both, key, time, inputs, tolerance).where("NOT _old").select(*names, "reasons").write.mode("overwrite").parquet(f"{at}/published/batch={batch}")
        known = both
        for c in inputs:
            known = filled(known, key, time, c, f"_now_{c}")
        store.merge(known.where("NOT _old").select(key, time, *[F.col(f"_now_{c}").alias(c) for c in inputs]), batch)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    shape = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in names) + ", reasons array<string>"
    if not _batches(spark, f"{at}/published"):
        return spark.createDataFrame([], shape)
    return spark.read.schema(f"{shape}, batch int").parquet(f"{at}/published").drop("batch")
