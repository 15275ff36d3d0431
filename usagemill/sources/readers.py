"""Readers of documents and events, batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.calendar import in_months

#: The longest time that error documents are asked for, in ms.
MAX_ERROR_RANGE = 2_629_746_000


#: Rows that are dealt out to the cores at most, where they come from fewer files than there are cores.
MAX_SPREAD_ROWS = 20_000_000
#: Rows of one part at most, so that parts do not grow with the table.
PART_ROWS = 250_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """A small table of few files, dealt out to all cores by a key.

    One task reads a Parquet row group, however many splits its file has, so all
    that follows without a shuffle would run on as few cores as there are row
    groups. Tables of many files or rows have enough of them and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or (rows := df.count()) > MAX_SPREAD_ROWS:  # of Parquet the count is in the footers
        return df
    return df.repartition(max(cores, -(-rows // PART_ROWS)), key)


def _read(spark: SparkSession, path: str, schema: StructType, fmt: str) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def read_usage(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Usage documents, JSON or Parquet, without inference."""
    return _read(spark, path, schemas.USAGE, fmt)


def read_usage_stream(spark: SparkSession, path: str, fmt: str = "json", max_files: int = 1000) -> DataFrame:
    """Usage documents as they arrive, so many files a batch at most."""
    return spark.readStream.schema(schemas.USAGE).format(fmt).option("maxFilesPerTrigger", max_files).load(path)


def read_app_events(spark: SparkSession, path: str, after: tuple[int, str] | None = None, fmt: str = "json") -> DataFrame:
    """App events after a (time, guid) cursor."""
    df = _read(spark, path, schemas.APP_EVENT, fmt)
    if after is None:
        return df
    at, guid = F.col("metadata.created_at"), F.col("metadata.guid")
    return df.where((at > after[0]) | ((at == after[0]) & (guid > after[1])))


def read_service_events(spark: SparkSession, path: str, services: list[str] | None = None, fmt: str = "json") -> DataFrame:
    """Events of managed service instances, of the services asked for."""
    df = _read(spark, path, schemas.SERVICE_EVENT, fmt).where("entity.service_instance_type = 'managed_service_instance'")
    return df if services is None else df.where(F.col("entity.service_guid").isin(*services))


def read_span_events(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _read(spark, path, schemas.SPAN_EVENT, fmt)


def read_range(df: DataFrame, key: str, value: str, ts: str, t0: int, t1: int, desc: bool = True, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of a key's documents between two times, in order of time."""
    out = in_months(df, t0, t1).where((F.col(key) == value) & F.col(ts).between(t0, t1)).orderBy(F.col(ts).desc() if desc else F.col(ts).asc()).offset(offset)
    return out if limit is None else out.limit(limit)


def read_errors(df: DataFrame, ts: str, t0: int, t1: int) -> DataFrame:
    """Error documents of at most a month, the newest first."""
    if not 0 <= t1 - t0 <= MAX_ERROR_RANGE:
        raise ValueError(f"the range must lie between 0 and {MAX_ERROR_RANGE} ms")
    return in_months(df, t0, t1).where(F.col(ts).between(t0, t1)).orderBy(F.col(ts).desc())
