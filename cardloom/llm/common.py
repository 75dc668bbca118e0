"""What the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import deploy

#: Bytes in an Arrow batch: a worker holds a few batches, whose rows may be of any length.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: While a step is written: its shuffle files go when it has been.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, and bound Arrow batches unless the session does so itself."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(4 << 20))
    deploy.ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder where all executors can read: below spark.checkpoint.dir.

    Where that is unset, a master on this machine gets a folder of its own in /tmp; any other master is refused, as its
    executors would write to disks that the others can't see. The session's settings are left alone.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "/tmp/cardloom"
    return f"{at.rstrip('/')}/cardloom-{sc.applicationId}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings for what is run within."""
    were = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in were.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Saved:
    """A frame written as Parquet to the shared folder: cuts lineage, survives executors, can be dropped.

    Its shuffle files go when it has been written. What nobody drops goes with release(), or when the driver's JVM ends.
    """

    alive: set[Saved] = set()

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        with settings(self.spark, _WRITING):
            df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        Saved.alive.add(self)
        self._fs().deleteOnExit(self._at())

    def _at(self):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)

    def _fs(self):
        return self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self) -> None:
        """Delete the files; call it only when nothing lazy reads them any more."""
        Saved.alive.discard(self)
        fs = self._fs()
        fs.delete(self._at(), True)
        fs.cancelDeleteOnExit(self._at())


@contextmanager
def scratch(*keep: Saved) -> Iterator[list[Saved]]:
    """Drops what was saved within, but for what is in the list that it gives."""
    before, kept = set(Saved.alive), list(keep)
    try:
        yield kept
    finally:
        for s in Saved.alive - before - set(kept):
            s.drop()


def release() -> None:
    """Drop all that is left: call it when the results of this package's operators have been used."""
    for s in list(Saved.alive):
        s.drop()


def give_back() -> None:
    """Return to the system what a finished task has freed: a worker outlives its tasks, and would keep the most it ever had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def per_partition(df: DataFrame, schema: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """mapInArrow of a generator that gives columns, a dict of name to list or array, in the order of schema."""
    ship(df.sparkSession)

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for cols in run(batches):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols.values()], names=list(cols))
        finally:
            give_back()

    return df.mapInArrow(arrow, schema)


def per_batch(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict | Iterable[dict]]]) -> DataFrame:
    """mapInArrow with state for a task: make() runs once a task and returns what turns a batch into columns.

    The columns, a dict of name to list or array, come in the order of schema. A generator gives several batches,
    so that a batch's output need not be in memory at once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                yield from [out] if isinstance(out, dict) else out

    return per_partition(df, schema, run)


def fresh(name: str, taken: Iterable[str]) -> str:
    """name, with as many underscores as keep it apart from columns that are there."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def frequent(counts: DataFrame, word: str, number: str, most: int, longest: int) -> DataFrame:
    """Those rows of counts, whose words have so many bytes at most, that lie above some number; ``most`` of them at most."""
    level = F.floor(F.log2(number) * 8).alias("level")  # some hundred levels at most
    short = counts.filter(F.octet_length(word) <= longest)
    sizes = sorted(((r.level, r.n) for r in short.groupBy(level).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, total = None, 0
    for at, n in sizes:
        total += n
        if total > most:
            break
        least = at
    return short.limit(0) if least is None else short.filter(level >= least)


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text; null counts as empty."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def words_of(text: bytes) -> list[bytes]:
    """Words are runs of bytes other than space and 09 to 0D, which is how bytes.split() cuts."""
    return text.split()
