"""Blob tables from files and databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oakmill.operators.rows import indexed

IMAGE_MARKS = {"png": "89504E47", "jpeg": "FFD8FF", "gif": "474946", "bmp": "424D", "tiff": "49492A00", "tiff_be": "4D4D002A", "webp": "52494646"}
DOCUMENTS = {"pdf": "pdf", "doc": "doc", "docx": "docx"}


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; without a schema its types are inferred by one more pass."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, tasks: int = 8, **properties: str) -> DataFrame:
    """A table of a database (MySQL, PostgreSQL, SQLite, ...; its driver must be on the class path), read in parallel by
    ranges of ``key`` if bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", tasks)
    return reader.load()


def image_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """``blob_id, path, created_at`` of image files below a folder (local, ``s3a://``, ...), told by their first bytes.

    Ids count from 1 in the order of paths. Contents are read to tell the kind and not kept.
    """
    files = _files(spark, folder)
    head = F.hex(F.substring("content", 1, 4))
    marked = files.where(_any(head.startswith(mark) for mark in IMAGE_MARKS.values()))
    return _numbered(marked.select("path", F.col("modificationTime").alias("created_at")))


def document_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """``blob_id, path, created_at, doc_type`` of pdf, doc and docx files below a folder, told by their names."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    files = _files(spark, folder).drop("content").withColumn("doc_type", kind).where(F.col("doc_type").isin(*DOCUMENTS))
    return _numbered(files.select("path", F.col("modificationTime").alias("created_at"), "doc_type"))


def _any(conditions):
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def _numbered(files: DataFrame) -> DataFrame:
    ordered = files.repartitionByRange("path").sortWithinPartitions("path")
    return indexed(ordered).select((F.col("__index") + 1).alias("blob_id"), *files.columns)


def embedding_table(vectors: DataFrame, keys: list[str], column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """``(id, embedding)`` and the mapping ``(id, keys)`` for a table that has an embedding for each blob; ids count from 0
    in the order of the keys."""
    numbered = indexed(vectors.select(*keys, column).repartitionByRange(*keys).sortWithinPartitions(*keys), "id")
    return numbered.select("id", F.col(column).cast(T.ArrayType(T.FloatType())).alias("embedding")), numbered.select("id", *keys)


def vector_ids(spark: SparkSession, path: str) -> DataFrame:
    """Vector ids (column ``id``) from a CSV file with a header and one column."""
    data = csv_table(spark, path)
    if len(data.columns) != 1:
        raise ValueError(f"{path} must have one column")
    return data.toDF("id").select(F.col("id").cast("long"))
