"""A table of the last row of each key, in hash buckets, of which a merge rewrites those it touches alone."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .state import hadoop_path


class KeyedTable(NamedTuple):
    """The table under root: rows of schema, one for each value of keys, the one of the largest order.

    A bucket is a folder of Parquet files under data/<version>; a manifest names the
    folder of each bucket, and the table is what the last manifest names. Manifests are
    put in place by a rename, so a reader sees a merge as a whole or not at all, and a
    merge that dies leaves files that nothing names. Merging the same rows again
    gives the same table. There is one writer; a second one's rename fails.

    buckets is settled by the first merge; a bucket should hold some hundred megabytes.
    """

    root: str
    schema: StructType
    keys: tuple[str, ...]
    order: str
    buckets: int = 64

    def manifests(self, spark: SparkSession) -> list[int]:
        """The numbers of the versions, oldest first."""
        fs, path = hadoop_path(spark, f"{self.root}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, spark: SparkSession, version: int) -> dict:
        """The number of buckets of a version, and of each bucket that has rows its folder."""
        lines = spark.read.text(f"{self.root}/manifest/{version:010d}.json", wholetext=True).first()
        return json.loads(lines[0])

    def latest(self, spark: SparkSession) -> tuple[int, dict]:
        have = self.manifests(spark)
        return (have[-1], self.manifest(spark, have[-1])) if have else (0, {"buckets": self.buckets, "folders": {}})

    def _read(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        empty = not folders
        return spark.createDataFrame([], self.schema) if empty else spark.read.schema(self.schema).parquet(*(f"{self.root}/{f}" for f in folders))

    def read(self, spark: SparkSession) -> DataFrame:
        """The table as the last complete merge left it; empty before the first."""
        return self._read(spark, list(self.latest(spark)[1]["folders"].values()))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The table's rows of the keys that wanted has, read from their buckets alone."""
        spark = wanted.sparkSession
        _, now = self.latest(spark)
        keyed = wanted.select(*self.keys).distinct()
        touched = self._touched(keyed, now["buckets"])
        rows = self._read(spark, [f for b, f in now["folders"].items() if int(b) in touched])
        return rows.join(keyed, list(self.keys), "left_semi").select(self.schema.fieldNames())

    def _touched(self, rows: DataFrame, buckets: int) -> set[int]:
        """The buckets of rows; at most as many as there are."""
        return {r[0] for r in rows.select(self._bucket(buckets).alias("b")).distinct().collect()}

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in self.keys)), F.lit(buckets)).cast("int")

    def merge(self, rows: DataFrame) -> int:
        """Puts in rows, whose columns are those of schema; of equal orders the new row counts. The new version's number.

        Each key's rows are reduced in their tasks before they meet, so that one key with most of
        the rows is no task of its own.
        """
        spark = rows.sparkSession
        version, now = self.latest(spark)
        rows = rows.select(self.schema.fieldNames())
        touched = self._touched(rows, now["buckets"])
        if not touched:
            return version
        old = self._read(spark, [f for b, f in now["folders"].items() if int(b) in touched])
        both = old.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
        place = F.struct(F.col(self.order).isNotNull(), F.col(self.order), F.col("_new"))
        last = both.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys))).agg(F.max_by(F.struct(*self.schema.fieldNames()), place).alias("r")).select("r.*")
        folder = f"data/{version + 1:010d}"
        dealt = last.withColumn("_bucket", self._bucket(now["buckets"])).repartition(len(touched), "_bucket")
        dealt.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        folders = now["folders"] | {str(b): f"{folder}/_bucket={b}" for b in touched}
        self._publish(spark, version + 1, {"buckets": now["buckets"], "folders": folders})
        return version + 1

    def _publish(self, spark: SparkSession, version: int, manifest: dict) -> None:
        fs, path = hadoop_path(spark, f"{self.root}/manifest/{version:010d}.json")
        draft = hadoop_path(spark, f"{self.root}/manifest/_{version:010d}")[1]
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if fs.exists(path) or not fs.rename(draft, path):
            raise RuntimeError(f"version {version} of {self.root} has another writer")

    def forget(self, spark: SparkSession, keep: int = 3) -> None:
        """Drops the versions before the last `keep`, and the folders that no version left names."""
        have = self.manifests(spark)
        kept, gone = have[-keep:], have[:-keep]
        named = {f for v in kept for f in self.manifest(spark, v)["folders"].values()}
        for v in gone:
            for f in set(self.manifest(spark, v)["folders"].values()) - named:
                fs, path = hadoop_path(spark, f"{self.root}/{f}")
                fs.delete(path, True)
            fs, path = hadoop_path(spark, f"{self.root}/manifest/{v:010d}.json")
            fs.delete(path, False)
