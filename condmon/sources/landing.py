"""Raw text files to all-string tables with lineage."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import content_id

CORRUPT = "corrupt_record"


def read_raw_csv(spark: SparkSession, path: str, names: list[str], header: bool = True) -> DataFrame:
    """SRC1, SRC2: every field as text by position, malformed rows kept in ``corrupt_record``, file name and time beside them."""
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))] + [T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    raw = reader.option("enforceSchema", True).option("encoding", "UTF-8").csv(path)
    meta = raw.select("*", F.col("_metadata.file_name").alias("source_filename"), F.col("_metadata.file_modification_time").alias("source_modified_at"))
    return meta.toDF(*names, CORRUPT, "source_filename", "source_modified_at")


def batch_id(source_sha256: str | Column, dataset_version: str) -> Column:
    return content_id("batch", F.lit(source_sha256) if isinstance(source_sha256, str) else source_sha256, dataset_version)


def with_lineage(raw: DataFrame, table: str, key: str, source_sha256: str, dataset_version: str, ingested_at: Column | None = None) -> DataFrame:
    """ID1: content-derived record id (from the corrupt text where the key is missing), file hash, batch and version."""
    text = F.coalesce(F.col(key), F.sha2(F.col(CORRUPT), 256)) if CORRUPT in raw.columns else F.col(key)
    return raw.withColumns(
        {
            "record_id": content_id(table, source_sha256, text),
            "source_sha256": F.lit(source_sha256),
            "ingested_at": F.current_timestamp() if ingested_at is None else ingested_at,
            "ingestion_batch_id": batch_id(source_sha256, dataset_version),
            "dataset_version": F.lit(dataset_version),
        }
    )


def read_log(spark: SparkSession, path: str, names: list[str], key: str, source_sha256: str, dataset_version: str) -> DataFrame:
    """SRC3."""
    return with_lineage(read_raw_csv(spark, path, names), "log", key, source_sha256, dataset_version)


def read_events(spark: SparkSession, path: str, names: list[str], key: str, source_sha256: str, dataset_version: str, document_sha256: str) -> DataFrame:
    """SRC4: as ``read_log`` with the hash of the document that the events come from."""
    out = with_lineage(read_raw_csv(spark, path, names), "events", key, source_sha256, dataset_version)
    return out.withColumn("document_sha256", F.lit(document_sha256))


def _digests(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Paths and sizes to names, sizes and SHA-256, each file streamed through its store's own reader, a block at a time."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    for batch in batches:
        for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            # Spark's paths are not percent-encoded.
            local = path.startswith("file:")
            store, inside = (LocalFileSystem(), f"/{path.removeprefix('file:').lstrip('/')}") if local else FileSystem.from_uri(quote(path, safe=":/@?=&"))
            digest, seen = hashlib.sha256(), 0
            with store.open_input_stream(inside) as stream:
                while part := stream.read(block):
                    digest.update(part)
                    seen += len(part)
            if seen != size:
                raise OSError(f"{path} was listed with {size} bytes and has {seen}")
            yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]]), pa.array([seen], pa.int64()), pa.array([digest.hexdigest()])], names=["name", "size", "sha256"])


def file_identities(spark: SparkSession, path: str, block: int = 8 << 20) -> DataFrame:
    """Name, size and SHA-256 of files of any size. Spark lists them and deals them out one by one; the task that has a file streams it in blocks.

    The store must be one that pyarrow opens (local, HDFS, S3, GCS, Azure). Spark lists no empty files, so those count as missing.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    n = max(1, listed.count())
    return listed.repartition(n).mapInArrow(partial(_digests, block=block), "name string, size long, sha256 string")


def reconcile_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """SRC5: manifest (name, size, sha256) against what is there: ok, missing, unlisted, wrong_size or wrong_hash."""
    f, m = found.alias("f"), manifest.alias("m")
    joined = f.join(m, F.col("f.name") == F.col("m.name"), "full")
    status = (
        F.when(F.col("f.name").isNull(), "missing")
        .when(F.col("m.name").isNull(), "unlisted")
        .when(F.col("f.size") != F.col("m.size"), "wrong_size")
        .when(F.lower("f.sha256") != F.lower("m.sha256"), "wrong_hash")
        .otherwise("ok")
    )
    return joined.select(F.coalesce("f.name", "m.name").alias("name"), status.alias("status"))


def read_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    """SRC6: a path if it holds a slash, else a catalog table."""
    return spark.read.parquet(name_or_path) if "/" in name_or_path else spark.table(name_or_path)
