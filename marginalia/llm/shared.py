"""Shared folder, materialised tables and batch helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once in a Python worker; longer texts come alone.
CHUNK_BYTES = 2 << 20
#: Rows with texts that are sent to a Python worker at once.
BATCH_ROWS = 1000
#: Rows of a few numbers that may be broadcast: some tens of MB.
BROADCAST_ROWS = 2_000_000

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local run (as in tests) gets a folder of its own, and a cluster an error: its machines wouldn't see each other's."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = _own_dirs.get(sc.applicationId)
        if not root:
            root = _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="marginalia-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/marginalia/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and lost executors cost no more than their tasks."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _written[path] = df.sparkSession
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


#: Paths of tables that haven't been deleted yet, and the tables that read them.
_written: dict[str, SparkSession] = {}
_paths: dict[int, tuple[DataFrame, str]] = {}


def release(*tables: DataFrame) -> None:
    """Deletes tables made by materialise which nothing reads any more."""
    for table in tables:
        _, path = _paths.pop(id(table))
        remove(_written.pop(path), path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove_written() -> None:
    for path, spark in _written.items():
        try:
            remove(spark, path)
        except Exception:  # the JVM may have ended; the folder's owner clears it
            return


atexit.register(_remove_written)


def small(stored: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it has at most BROADCAST_ROWS rows; others are joined by shuffle. For rows of a few numbers."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: What a compressed text begins with; no UTF-8 text does.
_ZIPPED = b"\xff"


def zipped(texts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text) with compressed texts, which take less room in shuffles; without a shuffle. text is binary, null where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, write_checksum=False, write_dict_id=False)
        for batch in chunks(batches, "text"):
            out = [None if x is None else _ZIPPED + press.compress(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(out, pa.binary())], [id_col, "text"])

    return text_rows(texts.select(id_col, "text")).mapInArrow(run, f"{id_col} long, text binary")


def unzipped(text: bytes | None) -> bytes | None:
    return zstandard.decompress(text[1:]) if text and text[:1] == _ZIPPED else text


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the given folder; times without zone, as stored."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def as_bytes(text: str = "text") -> F.Column:
    """A text column as its UTF-8 bytes, so that Python workers get it without decoding."""
    return F.col(text).cast("binary")


def text_rows(docs: DataFrame) -> DataFrame:
    """docs as they are; rows with texts then travel to Python workers in batches of at most BATCH_ROWS, a setting of the session, which bounds the memory of both sides."""
    spark, key = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    return docs


def chunks(batches: Iterator[pa.RecordBatch], size: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose column `size` holds about `limit` bytes; a longer value is a slice of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = np.asarray(pc.binary_length(batch.column(size)).fill_null(0)).astype(np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    trim()


def trim() -> None:
    """Gives a worker's freed memory back to the system: workers live on and are used by other operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return
