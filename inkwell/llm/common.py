"""Pieces shared by the training-data operators: the shared folder, materialised tables, batch slicing."""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.session import bounded_batches, own_dir

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset on a local master."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not named:
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = own_dir(spark.sparkContext.master)
        named = _OWN_DIRS[app]
    return f"{named.rstrip('/')}/inkwell-{app}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _sweep(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the context may be gone already at exit
        pass


_SWEPT: set[str] = set()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage of ``df`` with a Parquet table in the shared folder; any executor can read it again."""
    spark = df.sparkSession
    base = shared_dir(spark)
    if base not in _SWEPT:
        _SWEPT.add(base)
        atexit.register(_sweep, spark, base)
    path = f"{base}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._inkwell_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    if path := getattr(df, "_inkwell_path", None):
        remove(df.sparkSession, path)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte array and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes (one row at least)."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + c) for all pairs."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    bounded_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def empty_text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))
