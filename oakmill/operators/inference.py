"""The inference operator: runs services over inputs that they haven't seen, in parallel, and keeps what they give."""

from __future__ import annotations

import os
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oakmill.catalog import Bound, Catalog, split_column


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder. Only a local session without one gets a
    folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + os.path.join(tempfile.gettempdir(), f"oakmill-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it: local folders and object stores alike."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete_folder(spark: SparkSession, path: str) -> None:
    files, where = file_system(spark, path)
    files.delete(where, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    files, where = file_system(spark, path)
    return files.exists(where)


TASK_ROWS = 1_000_000


class Store:
    """Outputs and seen keys of services as Parquet files. Every run of a service adds a folder; nothing is changed
    in place, so a run that fails leaves nothing behind that is read."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
        self.runs: dict[tuple[str, str], list[str]] = {}

    def add(self, service: str, **parts: DataFrame) -> None:
        """Writes all parts of a run (``out``, ``seen``) and only then makes them known: a run counts whole or not at all."""
        run = uuid.uuid4().hex
        paths = {what: f"{self.folder}/{service}/{what}/{run}" for what in parts}
        for what, df in parts.items():
            df.write.parquet(paths[what])
        for what, path in paths.items():
            self.runs.setdefault((service, what), []).append(path)

    def scratch(self, df: DataFrame, what: str) -> DataFrame:
        """Written once and read again: what follows doesn't run a service twice. ``clear_scratch`` deletes it."""
        path = f"{self.folder}/scratch/{what}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear_scratch(self) -> None:
        """Deletes what queries so far have written in between; DataFrames that they gave can't be read any more."""
        delete_folder(self.spark, f"{self.folder}/scratch")

    def all(self, service: str, what: str, schema: T.StructType) -> DataFrame:
        paths = self.runs.get((service, what), [])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def forget(self, service: str) -> None:
        for key in [k for k in self.runs if k[0] == service]:
            del self.runs[key]


def output_schema(catalog: Catalog, bound: Bound) -> T.StructType:
    fields = []
    for c in bound.binding.written:
        table, column = split_column(c)
        fields.append(T.StructField(c.replace(".", "__", 1), catalog.table(table).schema[column].dataType))
    return T.StructType(fields)


class Inference:
    """Runs bound services. ``rows_sent`` counts rows given to each service so far, ``calls`` calls of its model (a task
    that is repeated counts again)."""

    def __init__(self, spark: SparkSession, catalog: Catalog, store: Store | None = None):
        self.spark, self.catalog = spark, catalog
        self.store = store or Store(spark)
        self.rows_sent: dict[str, int] = {}
        self.counters: dict = {}

    def _keys(self, bound: Bound) -> list[int]:
        """Positions of the inputs that are primary keys, which name an input; of all, if there are none."""
        inputs = bound.binding.inputs
        keys = []
        for k, c in enumerate(inputs):
            table, column = split_column(c)
            if column in self.catalog.table(table).primary_key:
                keys.append(k)
        covered = all(
            f"{t}.{k}" in inputs or any(f"{t}.{k}" in self.catalog.ancestors(i) for i in inputs)
            for t in bound.binding.input_tables for k in self.catalog.table(t).primary_key
        )
        return keys if keys and covered else list(range(len(inputs)))

    def infer(self, name: str, inputs: DataFrame, return_results: bool = False) -> DataFrame | None:
        """Runs a service over ``inputs`` (columns named as the binding's inputs, or by position) as far as it hasn't
        seen them. Keys are kept also where there was no output, so those aren't asked again.

        With ``return_results``: the inputs with all outputs for them, old and new.
        """
        bound = self.catalog.bound[name]
        binding = bound.binding
        named = [f"i{k}" for k in range(len(binding.inputs))]
        inputs = inputs.select(*[inputs[f"`{c}`"] for c in inputs.columns]).toDF(*named).dropDuplicates()
        keys = [f"i{k}" for k in self._keys(bound)]
        key_schema = T.StructType([inputs.schema[k] for k in keys])
        seen = self.store.all(name, "seen", key_schema)
        if (name, "seen") in self.store.runs:
            same = None
            for k in keys:
                one = inputs[k].eqNullSafe(seen[k])
                same = one if same is None else same & one
            new = inputs.join(seen, same, "left_anti")
        else:
            new = inputs
        if len(keys) < len(named):
            new = new.dropDuplicates(keys)
        new = self.store.scratch(new, "inputs")
        n = new.count()
        self.rows_sent[name] = self.rows_sent.get(name, 0) + n
        if bound.verbose:
            print(f"{name}: {n} rows")
        if n:
            self.store.add(name, out=self._run(bound, new, n), seen=new.select(*keys))
        if not return_results:
            return None
        outputs = self.outputs(name)
        pairs = [(k, b) for k, a in enumerate(binding.inputs) for b in binding.written if a in self.catalog.ancestors(b) or (a, b) in binding.copy_map]
        if not pairs:
            raise ValueError(f"{name}: no output column refers to an input")
        condition = None
        for k, b in pairs:
            one = inputs[f"i{k}"] == outputs[f"`{b}`"]
            condition = one if condition is None else condition & one
        return inputs.join(outputs, condition).select(*[F.col(f"i{k}").alias(c) for k, c in enumerate(binding.inputs)], *[F.col(f"`{c}`") for c in binding.written if c not in binding.inputs])

    def _run(self, bound: Bound, new: DataFrame, n: int) -> DataFrame:
        binding, service = bound.binding, bound.service
        schema = output_schema(self.catalog, bound)
        given = [c for c in binding.outputs if c not in binding.copied]
        sources = {b: f"i{binding.inputs.index(a)}" for a, b in binding.copy_map}
        if hasattr(service, "infer_frame"):
            out = service.infer_frame(new)
            at = {c: f"o{k}" for k, c in enumerate(given)}
            return out.select(*[F.col(sources.get(c) or at[c]).cast(f.dataType).alias(f.name) for c, f in zip(binding.written, schema)])
        size = max(1, service.preferred_batch_size)
        positions = {c: k for k, c in enumerate(given)}
        columns = [(f.name, sources.get(c), positions.get(c)) for c, f in zip(binding.written, schema)]
        n_given = len(given)
        tasks = self.spark.sparkContext.defaultParallelism
        parts = max(1, min(max(tasks * 4, n // TASK_ROWS), -(-n // size)))
        if limit := getattr(service, "per_minute", None):
            parts = min(parts, tasks, max(1, int(limit // 60)))  # under a limit more tasks would only wait
        service = service.for_tasks(parts)
        counter = self.counters.setdefault(service.name, self.spark.sparkContext.accumulator(0))

        def call(batches):
            for batch in batches:
                for a in range(0, len(batch), size):
                    rows = batch.iloc[a : a + size].reset_index(drop=True)
                    together, lengths = service.infer_flat(rows)
                    counter.add(service.calls(len(rows)))
                    if not sum(lengths):
                        continue
                    if together.shape[1] != n_given:
                        raise ValueError(f"{service.name}: answers need {n_given} columns")
                    source = rows.loc[rows.index.repeat(lengths)].reset_index(drop=True)
                    yield pd.DataFrame({name: source[copied] if copied else together[k] for name, copied, k in columns})

        return new.repartition(parts).mapInPandas(call, schema)

    @property
    def calls(self) -> dict[str, int]:
        return {name: counter.value for name, counter in self.counters.items()}

    def outputs(self, name: str) -> DataFrame:
        """All outputs of a service so far, columns named table.column."""
        bound = self.catalog.bound[name]
        df = self.store.all(name, "out", output_schema(self.catalog, bound))
        return df.toDF(*bound.binding.written)

    def table(self, name: str) -> DataFrame:
        """What a table holds now: stored rows, or what the services that fill it have given.

        Columns made by several services are put together by the table's primary key.
        """
        table = self.catalog.table(name)
        if table.data is not None:
            return table.data
        makers = self.catalog.makers(name)
        parts = []
        for maker in makers:
            own = [c for c in self.catalog.bound[maker].binding.written if split_column(c)[0] == name]
            df = self.outputs(maker)
            part = df.select(*[F.col(f"`{c}`").alias(split_column(c)[1]) for c in own])
            several = len(self.catalog.bound[maker].binding.output_tables) > 1
            parts.append(part.dropDuplicates() if several else part)
        if not parts:
            return self.spark.createDataFrame([], table.schema)
        out = parts[0]
        for part in parts[1:]:
            keys = [k for k in table.primary_key if k in out.columns and k in part.columns]
            if not keys:
                raise ValueError(f"{name} is filled by services that share no key")
            out = out.join(part, keys, "full")
        have = set(out.columns)
        return out.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema])
