"""The keyed upsert as a stream: each micro-batch replaces the stored rows of its keys, and rewrites only their buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import upsert

#: Buckets of keys; a batch rewrites those that it touches.
BUCKETS = 256


def _stored(spark: SparkSession, path: str, below: int | None = None) -> dict[int, list[int]]:
    """The complete versions of each bucket, rising, or those below a number."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    if not fs.exists(at):
        return out
    versions = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName()[:1] == "v" and fs.exists(jvm.Path(s.getPath(), "_SUCCESS")))
    for v in (v for v in versions if below is None or v < below):
        for s in fs.listStatus(jvm.Path(f"{path}/v{v}")):
            if s.getPath().getName().startswith("bucket="):
                out.setdefault(int(s.getPath().getName()[7:]), []).append(v)
    return out


def _read(spark: SparkSession, path: str, versions: dict[int, int], schema) -> DataFrame:
    paths = [f"{path}/v{v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current(spark: SparkSession, path: str, schema) -> DataFrame:
    """All stored rows: of each bucket its last complete version."""
    return _read(spark, path, {b: vs[-1] for b, vs in _stored(spark, path).items()}, schema)


def upsert_into(path: str, keys: list[str], order: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch. A batch writes new versions of the buckets that its keys fall into, named by its number.

    A batch that is run again after a failure reads the versions before its own, so its effect is the same; versions
    that even such a batch can't need any more are deleted.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        of = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        rows = batch.persist()
        try:
            touched = [r[0] for r in rows.select(of.alias("b")).distinct().collect()]  # at most the number of buckets
            stored = _stored(spark, path, number)
            old = _read(spark, path, {b: stored[b][-1] for b in touched if b in stored}, batch.schema)
            upsert(old, rows, keys, order).withColumn("bucket", of).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{number}")
        finally:
            rows.unpersist()
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        fs = jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for b in touched:
            for v in stored.get(b, [])[:-1]:
                fs.delete(jvm.Path(f"{path}/v{v}/bucket={b}"), True)

    return step
