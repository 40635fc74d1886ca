"""The engine: takes SQL over stored and inferred columns and gives DataFrames."""

from __future__ import annotations

import threading
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oakmill.catalog import Binding, Catalog, CatalogError, Table, split_column
from oakmill.functions import udf
from oakmill.operators.inference import Inference, Store
from oakmill.operators.vectors import ProxyIndex
from oakmill.plans import combinations, directives, kinds
from oakmill.plans.directives import Directives, QueryError
from oakmill.plans.kinds import Kind
from oakmill.plans.lineage import Analysis, Clause, analyse

_VIEWS = threading.RLock()
_EQUAL = (T.IntegralType, T.DecimalType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType)  # 0.0 and -0.0 are equal, but not the same


@dataclass
class IndexedTable:
    """A proxy index over a blob table; ``mapping`` has the blob keys of each vector id (column ``id``)."""

    index: ProxyIndex
    table: str
    mapping: DataFrame


class Engine:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.catalog = Catalog()
        self.inference = Inference(spark, self.catalog, Store(spark, folder))
        self.udfs: dict[str, udf.UserFunction] = {}
        self.index: IndexedTable | None = None

    # -- declarations

    def register_blob_table(self, name: str, data: DataFrame, keys: list[str], foreign_keys: dict[str, str] | None = None) -> None:
        """A stored table whose rows name blobs; several of its columns may be keys of other tables."""
        self._register(name, data, keys, foreign_keys, True)

    def register_table(self, name: str, data: DataFrame, keys: list[str] = (), foreign_keys: dict[str, str] | None = None) -> None:
        """Another stored table."""
        self._register(name, data, keys, foreign_keys, False)

    def _register(self, name, data, keys, foreign_keys, blob) -> None:
        data = data.toDF(*[c.lower() for c in data.columns])
        refers = {k.lower(): v.lower() for k, v in (foreign_keys or {}).items()}
        self.catalog.add_table(Table(name.lower(), data.schema, tuple(k.lower() for k in keys), refers, data, blob))

    def create_output_tables(self, declared: dict[str, list[dict]]) -> None:
        self.catalog.add_output_tables(declared)

    def register_output_table(self, name: str, schema: str, keys: list[str], foreign_keys: dict[str, str]) -> None:
        """A table that services fill, from a DDL schema."""
        kind = T._parse_datatype_string(schema)
        refers = {k.lower(): v.lower() for k, v in foreign_keys.items()}
        self.catalog.add_table(Table(name.lower(), kind, tuple(k.lower() for k in keys), refers))

    def register_inference_service(self, service) -> None:
        self.catalog.add_service(service)

    def bind_inference_service(self, name: str, binding: Binding | tuple, copy_map: dict[str, str] | None = None, verbose: bool = False) -> None:
        """Binds input to output columns. ``copy_map``: input columns that are copied to output columns."""
        if not isinstance(binding, Binding):
            binding = Binding(tuple(binding[0]), tuple(binding[1]))
        if copy_map:
            binding = Binding(binding.inputs, binding.outputs, tuple(copy_map.items()))
        self.catalog.bind(name, binding, verbose)

    def register_user_defined_function(self, name: str, function, returns: str) -> None:
        self.udfs[name.lower()] = udf.register(self.spark, name, function, returns)

    def use_index(self, index: ProxyIndex, table: str, mapping: DataFrame, only: DataFrame | None = None) -> None:
        """A proxy index for a blob table. ``only`` (column ``id``) restricts it to some vectors."""
        if only is not None:
            mapping = mapping.join(only.select("id").distinct(), "id", "left_semi")
            index.vectors = index.vectors.join(only.select("id").distinct(), "id", "left_semi")
        keys = self.catalog.table(table).primary_key
        if missing := [k for k in keys if k not in mapping.columns]:
            raise CatalogError(f"the mapping lacks {missing}")
        self.index = IndexedTable(index, table.lower(), mapping)

    @property
    def rows_sent(self) -> dict[str, int]:
        return dict(self.inference.rows_sent)

    @property
    def calls(self) -> dict[str, int]:
        """Calls of each service's model so far (one for a whole batch, where it takes batches)."""
        return self.inference.calls

    def clear_scratch(self) -> None:
        """Deletes what queries have written in between. Do it when their results have been used; what services gave stays."""
        self.inference.store.clear_scratch()

    # -- queries

    def execute(self, query: str, seed: int = 1234) -> DataFrame:
        """Runs a query, services first as far as it needs them, and gives its rows as a DataFrame."""
        from oakmill.operators import approx

        self.catalog.check()
        sql, given = directives.strip(query)
        kind = kinds.classify(sql, given, set(self.udfs))
        if kind == Kind.OTHER:
            raise QueryError("only SELECT is supported; tables are changed through the engine's functions")
        if kind == Kind.APPROX_SELECT:
            kinds.check_approx_select(given)
        kinds.check_udf_query(sql, kind, set(self.udfs))
        if kind == Kind.APPROX_JOIN:
            return approx.join_aggregate(self, sql, given, seed)
        if kind == Kind.APPROX_AGGREGATE:
            return approx.aggregate(self, sql, given, seed)
        if kind == Kind.APPROX_SELECT:
            return approx.select(self, sql, given, seed)
        if kind == Kind.LIMIT:
            return approx.limit(self, sql)
        return self.exact(sql)

    def kind(self, query: str) -> Kind:
        sql, given = directives.strip(query)
        return kinds.classify(sql, given, set(self.udfs))

    def prepared(self, sql: str) -> tuple[str, list[int]]:
        """The text for Spark: row functions as lateral views, aliases in WHERE replaced."""
        text, places = udf.rewrite(sql, self.udfs)
        columns = set()
        for t in self.catalog.tables.values():
            if directives.has_word(text, t.name):
                columns |= set(t.columns)
        return directives.inline_aliases(text, columns), places

    def exact(self, sql: str, blobs: dict[str, DataFrame] | None = None) -> DataFrame:
        """Runs all services that the query needs and the query."""
        text, places = self.prepared(sql)
        analysis = self.analysis(text)
        self.fill(analysis, blobs)
        out = self.run(text, blobs)
        return drop_null_results(out, places)

    def analysis(self, text: str) -> Analysis:
        empty = {name: self._empty(name) for name in self.catalog.tables}
        with self.views(empty):
            found = analyse(self.spark, text, self.catalog)
        if found.counts_rows:
            for name in found.needed:
                found.needed[name] = set(self.catalog.table(name).columns)
        return found

    def _empty(self, name: str) -> DataFrame:
        table = self.catalog.table(name)
        return table.data if table.data is not None else self.spark.createDataFrame([], table.schema)

    @contextmanager
    def views(self, tables: dict[str, DataFrame]):
        """Temporary views for tables while a query is analysed; a DataFrame keeps what it was made from.

        Views of the user's own with such names are put back afterwards, and queries of other threads wait meanwhile.
        """
        with _VIEWS:
            held = {name: own for name in tables if (own := self._own_view(name)) is not None}
            for name, df in tables.items():
                df.createOrReplaceTempView(name)
            try:
                yield
            finally:
                for name in tables:
                    if name in held:
                        held[name].createOrReplaceTempView(name)
                    else:
                        self.spark.catalog.dropTempView(name)

    def _own_view(self, name: str) -> DataFrame | None:
        try:
            known = self.spark.catalog.getTable(name)
        except AnalysisException:
            return None
        return self.spark.table(name) if known.isTemporary else None

    def run(self, text: str, blobs: dict[str, DataFrame] | None = None, tables: set[str] | None = None) -> DataFrame:
        """Spark's answer over stored tables (some of them replaced by ``blobs``) and what services have given."""
        current = {name: self.inference.table(name) for name in self.catalog.tables if directives.has_word(text, name)} | (blobs or {})
        columns = {t: {f.name.lower(): isinstance(f.dataType, _EQUAL) for f in df.schema} for t, df in current.items()}
        with self.views(current):
            if found := combinations.combined(text, columns, set(self.udfs)):
                text, made = found
                parts = 4 * self.spark.sparkContext.defaultParallelism  # a combination may stand for many pairs: not all in one task
                with self.views({c.view: self.spark.sql(c.sql).repartition(parts) for c in made}):
                    return self.spark.sql(text)
            return self.spark.sql(text)

    # -- services

    def services_of(self, analysis: Analysis) -> list[str]:
        return self.ordered(self.catalog.closure(analysis.needed), analysis)

    def fill(self, analysis: Analysis, blobs: dict[str, DataFrame] | None = None) -> None:
        ran: set[str] = set()
        for name in self.services_of(analysis):
            self.inference.infer(name, self.input_of(name, analysis, blobs, ran))
            ran.add(name)

    def ordered(self, services: list[str], analysis: Analysis) -> list[str]:
        """Services in topological order; with a proxy index, those that read blobs only and decide a condition by
        themselves go first, cheap and selective ones before others."""
        if self.index is None or len(services) < 2:
            return services
        rank: dict[str, tuple] = {}
        for name in services:
            bound = self.catalog.bound[name]
            if not all(self.catalog.table(t).blob for t in bound.binding.input_tables):
                continue
            own = {c for c in bound.binding.outputs}
            clauses = [c for c in analysis.clauses if c.columns <= own and c.columns]
            if not clauses:
                continue
            cost = 1.0 if bound.service.cost is None else float(bound.service.cost)
            passed = self._selectivity(name, clauses)
            rank[name] = (0, cost) if cost * passed == 0 else (1, cost * passed)
        first = sorted(rank, key=lambda n: rank[n])
        return first + [n for n in services if n not in rank]

    def _selectivity(self, name: str, clauses: list[Clause]) -> float:
        """Share of vectors that conditions on one service's output are expected to keep, from representatives."""
        from oakmill.operators.approx import representative_keys

        keys = representative_keys(self)
        blobs = {self.index.table: self.catalog.table(self.index.table).data.join(keys.drop("id"), list(self.catalog.table(self.index.table).primary_key), "left_semi")}
        self.inference.infer(name, self.frame_of(list(self.catalog.bound[name].binding.input_tables), blobs).select(*[F.col(f"`{c}`") for c in self.catalog.bound[name].binding.inputs]))
        out = self.inference.outputs(name)
        for c in clauses:
            out = out.where(c.sql)
        (table,) = self.catalog.bound[name].binding.output_tables[:1]
        pairs = self.catalog.link(self.index.table, table)
        hits = out.select(*[F.col(f"`{table}.{b}`").alias(a) for a, b in pairs]).distinct()
        scored = keys.join(hits.withColumn("score", F.lit(1.0)), [a for a, _ in pairs], "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
        return float(self.index.index.propagate(scored, binary=True).agg(F.avg("score")).first()[0] or 0.0)

    def frame_of(self, tables: list[str], blobs: dict[str, DataFrame] | None = None) -> DataFrame:
        """Tables joined along keys, columns named table.column. Tables without a link are an error."""
        frames = {}
        for t in tables:
            df = (blobs or {}).get(t)
            df = self.inference.table(t) if df is None else df
            frames[t] = df.select(*[F.col(f"`{c}`").alias(f"{t}.{c}") for c in self.catalog.table(t).columns])
        done, out = [tables[0]], frames[tables[0]]
        rest = list(tables[1:])
        while rest:
            for t in rest:
                pairs = [(f"{d}.{x}", f"{t}.{y}") for d in done for x, y in self.catalog.link(d, t)]
                if pairs:
                    condition = None
                    for x, y in pairs:
                        one = out[f"`{x}`"] == frames[t][f"`{y}`"]
                        condition = one if condition is None else condition & one
                    out = out.join(frames[t], condition)
                    done.append(t)
                    rest.remove(t)
                    break
            else:
                raise CatalogError(f"no key joins {rest} to {done}")
        return out

    def input_of(self, name: str, analysis: Analysis, blobs: dict[str, DataFrame] | None = None, ran: set[str] = frozenset()) -> DataFrame:
        """The distinct inputs of a service: its input tables joined, and rows dropped early by all clauses whose
        columns are there already and that no row of the result needs otherwise."""
        binding = self.catalog.bound[name].binding
        tables = list(binding.input_tables)
        conditions = []
        extra = list(blobs or {})
        for clause in analysis.clauses:
            placed = self._placed(clause, name, tables, analysis, ran)
            if placed is not None:
                sql, used = placed
                tables += [t for t in used if t not in tables]
                conditions.append(sql)
        for t in extra:
            if t not in tables and any(self.catalog.link(t, x) for x in tables):
                tables.append(t)
        df = self.frame_of(tables, blobs)
        for sql in conditions:
            df = df.where(sql)
        return df.select(*[F.col(f"`{c}`") for c in binding.inputs])

    def depends(self, table: str) -> set[str]:
        """Services that a table's rows come from."""
        return set(self.catalog.closure({table: set(self.catalog.table(table).columns)})) if self.catalog.makers(table) else set()

    def _placed(self, clause: Clause, name: str, tables: list[str], analysis: Analysis, ran: set[str]) -> tuple[str, list[str]] | None:
        """The clause over columns at hand for a service's input, or None if it can't be applied there.

        It can where every table of the query that rests on the service is in the query once, and the clause holds
        for that table's rows: each column is its own, or of a table joined to it by their keys.
        """
        resting = [t for t in analysis.occurs if name in self.depends(t)]
        if not clause.columns or not resting:
            return None
        for t in resting:
            if analysis.occurs[t] != 1:
                return None
            for c in clause.columns:
                other = split_column(c)[0]
                if other == t:
                    continue
                pairs = self.catalog.link(other, t)
                if analysis.occurs.get(other) != 1 or not pairs or not all(analysis.same(f"{other}.{x}", f"{t}.{y}") for x, y in pairs):
                    return None
        sql, used = clause.sql, []
        for c in sorted(clause.columns, key=len, reverse=True):
            for up in self.catalog.ancestors(c):
                table = split_column(up)[0]
                stored = self.catalog.table(table).data is not None
                makers = self.catalog.makers(table)
                filled = not stored and bool(makers) and set(makers) <= ran
                if (stored or filled) and name not in self.depends(table) and (table in tables or any(self.catalog.link(table, x) for x in tables)):
                    sql = sql.replace(f"`{c}`", f"`{up}`")
                    used.append(table)
                    break
            else:
                return None
        return sql, used


def drop_null_results(df: DataFrame, places: list[int]) -> DataFrame:
    """Rows where a scalar user function gave null are dropped."""
    for k in places:
        if 0 <= k < len(df.columns) and df.columns.count(df.columns[k]) == 1:
            df = df.where(F.col(f"`{df.columns[k]}`").isNotNull())
    return df


__all__ = ["Binding", "Directives", "Engine", "IndexedTable"]
