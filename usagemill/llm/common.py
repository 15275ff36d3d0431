"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text handled at once inside a Python task; a longer single text is handled alone.
CHUNK_BYTES = 2 << 20

_SEPARATE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the folder set for checkpoints; on one machine, one of our own where neither is set."""
    base, set_ = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getCheckpointDir()
    if base is None:
        if set_ is None and not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = set_ or f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    if set_ is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below the application's own, which ``clear_scratch`` removes."""
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Checkpoints that ``cut`` made, by application.
_CUTS: dict[str, list[str]] = {}


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that the application's operators wrote to the shared folder; their results must have been written or collected before."""
    remove(spark, _scratch(spark))
    for path in _CUTS.pop(spark.sparkContext.applicationId, []):
        remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: it ends the lineage, outlives lost executors, and goes with ``clear_scratch``."""
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint()
    at = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if at.isDefined():
        _CUTS.setdefault(spark.sparkContext.applicationId, []).append(at.get())
    return out


def fixed_words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, with A-Z lower-cased."""
    return text.translate(_SEPARATE).split()


def chunks(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch of about CHUNK_BYTES, each with its texts as UTF-8 (null: empty)."""
    column = batch.column(batch.schema.get_field_index(text))
    at = 0
    sizes = np.cumsum(np.asarray(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64))
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + CHUNK_BYTES, side="right")))
        part = column.slice(at, to - at)
        yield batch.slice(at, to - at), [x or b"" for x in part.cast(pa.binary()).to_pylist()]
        at = to


class WordIds(dict):
    """Numbers for words, given on first sight; start anew once it holds more than the bound."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def positional(df: DataFrame, *named: str) -> tuple[DataFrame, list[str], list[str]]:
    """The table with columns ``_c0``, ``_c1``..., so that no further column can clash; the names of those asked for, and all."""
    names = [f"_c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), [names[df.columns.index(n)] for n in named], names
