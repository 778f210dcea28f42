"""Tables by key with upserts, deletions and compaction, as files in buckets of the key.

A change writes its rows into the buckets of its keys, with its version; a deletion is a row that says so. A reader takes the
last version of each key, bucket by bucket. Compaction writes the merged rows of touched buckets anew. What counts is said by the
last list of files (``lists``), which is put in place at once: a change that fails or is repeated leaves files that no list names.
One writer at a time: a second one with the same version is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import names, put, storage

VERSION, GONE, BUCKET = "__version", "__gone", "__bucket"


class Keyed:
    """A table at ``path`` with rows of ``schema``, one for each ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.columns = spark.createDataFrame([], schema).schema
        self.stored = spark.createDataFrame([], schema).select("*", F.lit(0).cast("long").alias(VERSION), F.lit(False).alias(GONE)).schema

    def state(self) -> dict:
        """{version, files: {bucket: [folder, ...]}}; the first folder of a bucket may be a compacted one."""
        known = [n for n, _ in names(f"{self.path}/lists") if n.endswith(".json") and not n.startswith(".")]
        if not known:
            return {"version": 0, "files": {}}
        disk, at = storage(self.path)
        with disk.open_input_file(f"{at}/lists/{known[-1]}") as source:
            return json.loads(source.read())

    def _commit(self, state: dict) -> None:
        name = f"{state['version']:012d}.json"
        if any(n == name for n, _ in names(f"{self.path}/lists")):
            raise RuntimeError(f"another writer has made version {state['version']}")
        put(f"{self.path}/lists", name, json.dumps(state).encode())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Write rows by bucket; the folder of each bucket that has some."""
        folder = f"data/{uuid.uuid4().hex}"
        n = min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        rows.withColumn(BUCKET, self._bucket()).repartition(n, BUCKET).sortWithinPartitions(BUCKET, self.key).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        return {n.split("=")[1]: f"{folder}/{n}" for n, is_folder in names(f"{self.path}/{folder}") if is_folder and n.startswith(BUCKET)}

    def _changed(self, rows: DataFrame) -> int:
        state = self.state()
        version = state["version"] + 1
        for bucket, folder in self._write(rows.withColumn(VERSION, F.lit(version).cast("long"))).items():
            state["files"].setdefault(bucket, []).append(folder)
        self._commit({"version": version, "files": state["files"]})
        return version

    def upsert(self, rows: DataFrame) -> int:
        """Rows replace those of their keys; of several rows of a key in one change the greatest counts. The new version."""
        some = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.columns])
        rest = [f.name for f in self.columns if f.name != self.key]
        once = some.groupBy(self.key).agg(F.max(F.struct(*rest)).alias("__r")).select(self.key, "__r.*").select(*self.columns.names)
        return self._changed(once.withColumn(GONE, F.lit(False)))

    def delete(self, keys: DataFrame) -> int:
        """The rows of these keys go; unknown ones change nothing that can be read."""
        none = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != self.key else F.col(f.name) for f in self.columns]
        return self._changed(keys.select(self.key).distinct().select(*none, F.lit(True).alias(GONE)))

    def _read(self, files: dict[str, list[str]]) -> DataFrame:
        folders = [f"{self.path}/{f}" for some in files.values() for f in some]
        if not folders:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*folders)

    def _merged(self, files: dict[str, list[str]]) -> DataFrame:
        """The last version of each key, deletions too."""
        rest = [c for c in self.stored.names if c != self.key]
        return self._read(files).groupBy(self.key).agg(F.max_by(F.struct(*rest), VERSION).alias("__r")).select(self.key, "__r.*")

    def read(self) -> DataFrame:
        return self._merged(self.state()["files"]).filter(~F.col(GONE)).select(*self.columns.names)

    def get(self, keys: list) -> DataFrame:
        """The rows of some keys, from their buckets alone."""
        kind = self.columns[self.key].dataType
        wanted = self.spark.createDataFrame([(k,) for k in keys], f"{self.key} {kind.simpleString()}")
        own = {str(r["b"]) for r in wanted.select(self._bucket().alias("b")).distinct().collect()}
        files = {b: f for b, f in self.state()["files"].items() if b in own}
        return self._merged(files).filter(F.col(self.key).isin(keys) & ~F.col(GONE)).select(*self.columns.names)

    def compact(self, most: int = 1) -> int:
        """Write the buckets of more than ``most`` folders anew, without what is overwritten or deleted. The new version."""
        state = self.state()
        heavy = {b: f for b, f in state["files"].items() if len(f) > most}
        if not heavy:
            return state["version"]
        written = self._write(self._merged(heavy).filter(~F.col(GONE)).select(*self.stored.names))
        files = {b: f for b, f in state["files"].items() if b not in heavy} | {b: [f] for b, f in written.items()}
        self._commit({"version": state["version"] + 1, "files": files})
        return state["version"] + 1


def settings_store(spark: SparkSession, path: str, buckets: int = 8) -> Keyed:
    """A store of settings: a JSON value for each key."""
    return Keyed(spark, path, "key", "key string, value string", buckets)


def settings(store: Keyed, defaults: DataFrame) -> DataFrame:
    """(key, value): what is stored over the defaults; a stored value that isn't JSON, or is null, counts as none."""
    kept = store.read().filter(F.try_parse_json("value").isNotNull() & (F.trim("value") != "null"))
    stored = kept.select(F.col("key").alias("__k"), F.col("value").alias("__v"))
    joined = defaults.join(stored, F.col("key") == F.col("__k"), "full")
    return joined.select(F.coalesce("key", "__k").alias("key"), F.coalesce("__v", "value").alias("value"))
