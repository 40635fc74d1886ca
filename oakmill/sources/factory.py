"""An engine from a configuration: a module, a namespace or a dict.

Names: ``inference_engines`` (a list of dicts with ``service``, ``input_columns``, ``output_columns`` and, where wanted,
``copy_map``), ``blob_table_name``, ``blobs_keys_columns`` and ``blobs_csv_file`` or ``blobs_parquet`` or
``blobs`` (a DataFrame), ``tables`` (output tables), ``embeddings`` (a DataFrame with the blob keys and ``embedding``),
``index`` (options of the proxy index) and ``vector_id_csv``.
"""

from __future__ import annotations

from types import ModuleType, SimpleNamespace

from pyspark.sql import SparkSession

from oakmill.operators.vectors import ProxyIndex
from oakmill.session import Engine
from oakmill.sources import files


def from_config(spark: SparkSession, config, verbose: bool = False, folder: str | None = None) -> Engine:
    if isinstance(config, dict):
        config = SimpleNamespace(**config)
    if not isinstance(config, (ModuleType, SimpleNamespace)):
        raise TypeError("a configuration is a module, a namespace or a dict")
    get = lambda name, default=None: getattr(config, name, default)
    engine = Engine(spark, folder)
    blobs = get("blobs")
    if blobs is None and get("blobs_csv_file"):
        blobs = files.csv_table(spark, config.blobs_csv_file)
    if blobs is None and get("blobs_parquet"):
        blobs = spark.read.parquet(config.blobs_parquet)
    if blobs is not None:
        engine.register_blob_table(config.blob_table_name, blobs, list(config.blobs_keys_columns))
    if get("tables"):
        engine.create_output_tables(config.tables)
    for bound in get("inference_engines", []):
        engine.register_inference_service(bound["service"])
        engine.bind_inference_service(bound["service"].name, (bound["input_columns"], bound["output_columns"]), bound.get("copy_map"), verbose)
    if get("embeddings") is not None:
        vectors, mapping = files.embedding_table(config.embeddings, list(config.blobs_keys_columns))
        only = files.vector_ids(spark, config.vector_id_csv) if get("vector_id_csv") else None
        engine.use_index(ProxyIndex(vectors, **get("index", {})), config.blob_table_name, mapping, only)
    return engine
