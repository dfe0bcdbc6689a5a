"""A keyed table that streams merge into: buckets of a hash of the key, rewritten only where a batch touches them.

Below the store's folder lie `data/v=<version>/bucket=<number>/`, and one manifest a version, `manifest/<version>.json`, with the
schema, each writer's last batch and for each bucket the version that holds it. A manifest is written last, under a name of its own, so that
a reader sees a batch whole or not at all: what a job wrote before it broke off is in no manifest, and the next
attempt writes over it. A batch that a manifest has already counts as done, so replays change nothing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import folder
from .streams import align_schema


class Store:
    """Rows with one row a key: of rows with equal keys the one of the greatest `order` stays, a later batch's of equal ones."""

    def __init__(self, spark: SparkSession, at: str, keys: Sequence[str], order: str, buckets: int = 16, policy: str = "drop", allowed: Sequence[str] = ()):
        """`policy` for columns that a batch has and the store doesn't: drop, fail, or expand by those in `allowed`. `buckets` and `keys` stay what they were first."""
        self.spark, self.at, self.keys, self.order, self.buckets, self.policy, self.allowed = spark, at.rstrip("/"), list(keys), order, buckets, policy, tuple(allowed)

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _manifest(self) -> dict:
        """The newest manifest, by its number; an empty one before the first batch."""
        fs, at = self._fs(f"{self.at}/manifest")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        versions = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))
        if not versions:
            return {"version": 0, "batches": {}, "schema": None, "buckets": {}}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.at}/manifest/{versions[-1]}.json").collect()))

    def _commit(self, manifest: dict) -> None:
        """The manifest becomes visible by a rename; one that is there already makes it fail, so two writers can't both win."""
        name = f"{self.at}/manifest/{manifest['version']}.json"
        fs, tmp = self._fs(f"{self.at}/manifest/.{manifest['version']}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(tmp, self._fs(name)[1]):
            raise RuntimeError(f"{name} is there already: another writer came first")

    def _paths(self, manifest: dict, only: Sequence[int] | None = None) -> list[str]:
        return [f"{self.at}/data/v={v}/bucket={b}" for b, v in manifest["buckets"].items() if only is None or int(b) in only]

    def read(self) -> DataFrame | None:
        """The store's rows as of its newest manifest; None before the first batch."""
        m = self._manifest()
        return None if m["schema"] is None else self._rows(m)

    def read_of(self, keys: DataFrame) -> DataFrame | None:
        """The store's rows with the keys of `keys`, read from their buckets only; None before the first batch."""
        m = self._manifest()
        if m["schema"] is None:
            return None
        touched = sorted(r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect())  # `buckets` numbers at most
        return self._rows(m, touched).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def last_batch(self, writer: str = "") -> int:
        """The number of a writer's last merged batch, -1 before the first."""
        return self._manifest()["batches"].get(writer, -1)

    def _rows(self, manifest: dict, only: Sequence[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = self._paths(manifest, only)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, rows: DataFrame, batch: int, writer: str = "") -> list[int]:
        """Merge a writer's batch and return the buckets that it rewrote; none if the batch was merged before or is empty. Each writer counts its batches from 0."""
        m = self._manifest()
        if batch <= m["batches"].get(writer, -1):
            return []
        new = self._aligned(rows, m).withColumn("_bucket", self._bucket())
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # `buckets` numbers at most
        schema = new.drop("_bucket").schema
        version = m["version"] + 1
        if touched:
            old = self._rows(m | {"schema": json.loads(schema.json())}, touched).withColumns({"_bucket": self._bucket(), "_rev": F.lit(0)})
            both = old.unionByName(new.withColumn("_rev", F.lit(1)))
            w = Window.partitionBy("_bucket", *self.keys).orderBy(F.desc(self.order), F.desc("_rev"), *[F.desc(c) for c, t in new.dtypes if t not in ("map",) and not t.startswith("map") and c not in (*self.keys, self.order, "_bucket")])
            kept = both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_rev")
            kept.withColumnRenamed("_bucket", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.at}/data/v={version}")
        self._commit({"version": version, "batches": m["batches"] | {writer: batch}, "schema": json.loads(schema.json()), "buckets": m["buckets"] | {str(b): version for b in touched}})
        return touched

    def _aligned(self, rows: DataFrame, manifest: dict) -> DataFrame:
        if manifest["schema"] is None:
            return rows
        store = {f.name: f.dataType.simpleString() for f in StructType.fromJson(manifest["schema"])}
        return align_schema(rows, store, self.policy, self.allowed)

    def prune(self, keep: Column) -> None:
        """Keep the rows for which `keep` holds, as a version of its own; buckets that lose nothing aren't written."""
        m = self._manifest()
        rows = self.read()
        if rows is None:
            return
        marked = rows.withColumns({"bucket": self._bucket(), "_keep": F.coalesce(keep, F.lit(False))})
        loses = sorted(r[0] for r in marked.where("NOT _keep").select("bucket").distinct().collect())
        if loses:
            version = m["version"] + 1
            stay = marked.where(F.col("_keep") & F.col("bucket").isin(loses)).drop("_keep")
            left = {b: v for b, v in m["buckets"].items() if int(b) not in loses}
            full = sorted(r[0] for r in stay.select("bucket").distinct().collect())
            stay.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.at}/data/v={version}")
            self._commit(m | {"version": version, "buckets": left | {str(b): version for b in full}})

    def follow(self, stream: DataFrame, checkpoint: str, writer: str = "") -> DataFrame:
        """Merge what a stream has now, batch by batch, and return the store."""
        stream.writeStream.foreachBatch(lambda rows, batch: self.merge(rows, batch, writer) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        found = self.read()
        return self.spark.createDataFrame([], stream.schema) if found is None else found


def followed(stream: DataFrame, keys: Sequence[str], order: str, at: str | None = None, **told) -> Store:
    """A store below `at`, or in a new scratch folder, that has merged what the stream has now."""
    spark = stream.sparkSession
    at = at or folder(spark, "store")
    store = Store(spark, f"{at}/store", keys, order, **told)
    store.follow(stream, f"{at}/checkpoint")
    return store
