"""Binary vector packs: magic, JSON header, ids of one width, 16-bit vectors, little-endian."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fixed value: the first eight bytes of a pack.
MAGIC = b"BSPK\0\0\0\1"


def encode(ids: list[str], vectors: np.ndarray, embedder: str) -> bytes:
    """A pack's bytes; ids are padded with NULs to the longest."""
    if len(ids) != len(vectors):
        raise ValueError(f"ids and vectors differ in number: {len(ids)}, {len(vectors)}")
    names = [i.encode() for i in ids]
    width = max(map(len, names), default=1)
    stored = np.asarray(vectors, "<f2").reshape(len(ids), -1)
    header = json.dumps({"count": len(ids), "dim": stored.shape[1], "dtype": "float16", "embedder": embedder, "id_bytes": width}, separators=(",", ":")).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *(n.ljust(width, b"\0") for n in names), stored.tobytes()])


def decode(raw: bytes) -> tuple[dict, list[str], np.ndarray]:
    """Header, ids and vectors as 32-bit floats; other files are refused."""
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError("not a vector pack")
    at = len(MAGIC) + 4
    (size,) = struct.unpack_from("<I", raw, len(MAGIC))
    header = json.loads(raw[at : at + size])
    at += size
    n, width = header["count"], header["id_bytes"]
    ids = [raw[at + i * width : at + (i + 1) * width].rstrip(b"\0").decode() for i in range(n)]
    vectors = np.frombuffer(raw, "<f2", n * header["dim"], at + n * width).reshape(n, header["dim"])
    return header, ids, vectors.astype(np.float32)


def read(spark: SparkSession, path: str) -> DataFrame:
    """embedder, id, embedding of all packs at path, wherever Spark can read it; a pack is one task's."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                header, ids, vectors = decode(raw.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([header["embedder"]] * len(ids)), pa.array(ids), pa.array(list(vectors), pa.list_(pa.float32()))], names=["embedder", "id", "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "embedder string, id string, embedding array<float>")


def write(index: DataFrame, embedder: str, path: str, most: int = 1_000_000) -> int:
    """Write index(id, embedding), ordered by id, as one pack for a device, through Spark's file system.

    A pack is held in memory whole, so an index of more than ``most`` rows is refused.
    """
    if (n := index.count()) > most:
        raise ValueError(f"{n} rows are too many for one pack")
    rows = index.select("id", "embedding").orderBy("id").collect()
    raw = encode([r[0] for r in rows], np.array([r[1] for r in rows], np.float32).reshape(len(rows), -1), embedder)
    sc = index.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()
    return len(raw)
