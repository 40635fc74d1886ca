"""What the engine knows of tables, keys, services and their bindings. Plain metadata; no Spark job runs here."""

from __future__ import annotations

import graphlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TYPES = {
    "int": T.LongType(), "integer": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "object": T.StringType(), "bool": T.BooleanType(),
    int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType(), object: T.StringType(),
}


class CatalogError(ValueError):
    """A declaration that the catalog can't accept."""


def spark_type(kind) -> T.DataType:
    """The Spark type of a declared one; anything but int, float, str, object and bool is refused."""
    found = TYPES.get(kind.strip().lower() if isinstance(kind, str) else kind)
    if found is None:
        raise CatalogError(f"no column type for {kind!r}")
    return found


def split_column(name: str) -> tuple[str, str]:
    table, _, column = name.lower().partition(".")
    if not column:
        raise CatalogError(f"{name!r} isn't table.column")
    return table, column


@dataclass
class Table:
    """A table: stored (``data``) or inferred (only a schema). Foreign keys name their parent's column."""

    name: str
    schema: T.StructType
    primary_key: tuple[str, ...]
    foreign_keys: dict[str, str] = field(default_factory=dict)  # column: "table.column"
    data: DataFrame | None = None
    blob: bool = False

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.schema]


@dataclass(frozen=True)
class Binding:
    """Input and output columns of a service ("table.column", in the order of its arguments and results) and
    the inputs that are copied to outputs as they are."""

    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    copy_map: tuple[tuple[str, str], ...] = ()

    @property
    def copied(self) -> frozenset[str]:
        return frozenset(output for _, output in self.copy_map)

    @property
    def written(self) -> tuple[str, ...]:
        """All columns that a run fills: what the service returns and what is copied."""
        return tuple(dict.fromkeys((*self.outputs, *(b for _, b in self.copy_map))))

    @property
    def input_tables(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(split_column(c)[0] for c in self.inputs))

    @property
    def output_tables(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(split_column(c)[0] for c in self.written))


@dataclass
class Bound:
    service: object
    binding: Binding
    verbose: bool = False

    @property
    def name(self) -> str:
        return self.service.name


class Catalog:
    def __init__(self):
        self.tables: dict[str, Table] = {}
        self.services: dict[str, object] = {}
        self.bound: dict[str, Bound] = {}

    # -- tables

    def add_table(self, table: Table) -> None:
        """Adds a table; one that is there already must have the same columns and is kept."""
        table.name = table.name.lower()
        if table.name.startswith("__"):
            raise CatalogError("names that start with __ are the engine's own")
        missing = [c for c in (*table.primary_key, *table.foreign_keys) if c not in table.columns]
        if missing:
            raise CatalogError(f"{table.name} has no columns {missing}")
        if known := self.tables.get(table.name):
            if known.columns != table.columns:
                raise CatalogError(f"{table.name} is known with other columns")
            return
        if table.blob and not table.primary_key:
            raise CatalogError(f"blob table {table.name} needs keys")
        self.tables[table.name] = table
        try:
            self._check_tables()
        except Exception:
            del self.tables[table.name]
            raise

    def add_output_tables(self, declared: dict[str, list[dict]]) -> None:
        """Output tables from ``{table: [{name, dtype, is_primary_key, refers_to}]}``; known ones are skipped."""
        for name, columns in declared.items():
            if name.lower() in self.tables:
                continue
            schema = T.StructType([T.StructField(c["name"].lower(), spark_type(c["dtype"])) for c in columns])
            refers = {}
            for c in columns:
                if target := c.get("refers_to"):
                    refers[c["name"].lower()] = ".".join(target).lower() if isinstance(target, (tuple, list)) else target.lower()
            keys = tuple(c["name"].lower() for c in columns if c.get("is_primary_key"))
            self.add_table(Table(name, schema, keys, refers))

    def table(self, name: str) -> Table:
        try:
            return self.tables[name.lower()]
        except KeyError:
            raise CatalogError(f"no table {name!r}") from None

    def has_column(self, name: str) -> bool:
        table, column = split_column(name)
        return table in self.tables and column in self.tables[table].columns

    @property
    def blob_tables(self) -> list[str]:
        return [t.name for t in self.tables.values() if t.blob]

    def _check_tables(self) -> None:
        graph = {t.name: {split_column(p)[0] for p in t.foreign_keys.values()} for t in self.tables.values()}
        try:
            list(graphlib.TopologicalSorter({k: v - {k} for k, v in graph.items()}).static_order())
        except graphlib.CycleError as e:
            raise CatalogError(f"foreign keys go round in a circle: {e.args[1]}") from None
        for t in self.tables.values():
            for column, parent in t.foreign_keys.items():
                if split_column(parent)[0] in self.tables and not self.has_column(parent):
                    raise CatalogError(f"{t.name}.{column} refers to unknown {parent}")

    def check(self) -> None:
        """What must hold before queries: there are blob tables, and services' columns exist."""
        if not self.blob_tables:
            raise CatalogError("no blob table is registered")
        self._check_tables()
        for b in self.bound.values():
            self._check_binding(b)

    # -- lineage of keys

    def root(self, column: str) -> str:
        """The column at the end of the chain of foreign keys."""
        seen = set()
        while column not in seen:
            seen.add(column)
            table, name = split_column(column)
            parent = self.tables[table].foreign_keys.get(name) if table in self.tables else None
            if parent is None:
                return column
            column = parent.lower()
        raise CatalogError(f"foreign keys of {column} go round in a circle")

    def ancestors(self, column: str) -> list[str]:
        out = [column]
        while True:
            table, name = split_column(out[-1])
            parent = self.tables[table].foreign_keys.get(name) if table in self.tables else None
            if parent is None or parent.lower() in out:
                return out
            out.append(parent.lower())

    def link(self, left: str, right: str) -> list[tuple[str, str]]:
        """Pairs of columns that join two tables: those with a common origin along foreign keys, else, as
        keys often keep their names, equal names that are a key in one of them."""
        a, b = self.table(left), self.table(right)
        pairs = []
        for x in a.columns:
            for y in b.columns:
                up, down = self.ancestors(f"{a.name}.{x}"), self.ancestors(f"{b.name}.{y}")
                related = f"{b.name}.{y}" in up or f"{a.name}.{x}" in down or (len(up) > 1 and len(down) > 1 and up[-1] == down[-1])
                if related:
                    pairs.append((x, y))
        if not pairs:
            keys = {*a.primary_key, *a.foreign_keys} & {*b.primary_key, *b.foreign_keys}
            pairs = [(x, x) for x in a.columns if x in keys]
        return pairs

    # -- services

    def add_service(self, service) -> None:
        self.services[service.name] = service

    def bind(self, name: str, binding: Binding, verbose: bool = False) -> None:
        """Binds a registered service; on any error the catalog is as before."""
        if name not in self.services:
            raise CatalogError(f"service {name!r} isn't registered")
        lower = lambda cs: tuple(c.lower() for c in cs)
        binding = Binding(lower(binding.inputs), lower(binding.outputs), tuple((a.lower(), b.lower()) for a, b in binding.copy_map))
        before = self.bound.get(name)
        self.bound[name] = Bound(self.services[name], binding, verbose)
        try:
            self._check_binding(self.bound[name])
            self.order()
        except Exception:
            if before is None:
                del self.bound[name]
            else:
                self.bound[name] = before
            raise

    def owners(self) -> dict[str, str]:
        """The service that makes each output column; copied ones have no owner."""
        out: dict[str, str] = {}
        for b in self.bound.values():
            for c in b.binding.outputs:
                if c in b.binding.copied:
                    continue
                if out.setdefault(c, b.name) != b.name:
                    raise CatalogError(f"{c} is an output of both {out[c]} and {b.name}")
        return out

    def _check_binding(self, b: Bound) -> None:
        binding = b.binding
        if not binding.inputs or not binding.outputs:
            raise CatalogError(f"{b.name} needs input and output columns")
        for c in (*binding.inputs, *binding.outputs, *(x for pair in binding.copy_map for x in pair)):
            if not self.has_column(c):
                raise CatalogError(f"{b.name}: no column {c}")
        if outside := [a for a, _ in binding.copy_map if a not in binding.inputs]:
            raise CatalogError(f"{b.name}: copies {outside}, which aren't inputs")
        self.owners()
        keys = {f"{t}.{k}" for t in binding.input_tables for k in self.table(t).primary_key}
        for name in binding.output_tables:
            table = self.table(name)
            if table.blob:
                raise CatalogError(f"{b.name} writes to blob table {name}")
            reached = {x for c in table.columns for x in self.ancestors(f"{name}.{c}")[1:]}
            roots = {self.root(x) for x in reached}
            for k in keys:
                if k not in reached and self.root(k) not in roots:
                    raise CatalogError(f"{b.name}: key {k} isn't referred to by output table {name}")
            for k in table.primary_key:
                if k in table.foreign_keys and not {self.root(f"{name}.{k}")} & {self.root(x) for x in keys}:
                    raise CatalogError(f"{b.name}: key {name}.{k} refers to no key of the inputs")

    def order(self) -> list[str]:
        """Bound services such that each comes after those whose outputs it reads."""
        makers: dict[str, set[str]] = {}
        for b in self.bound.values():
            for t in b.binding.output_tables:
                makers.setdefault(t, set()).add(b.name)
        graph = {b.name: set().union(*(makers.get(t, set()) for t in b.binding.input_tables)) for b in self.bound.values()}
        try:
            return list(graphlib.TopologicalSorter(graph).static_order())
        except graphlib.CycleError as e:
            raise CatalogError(f"services need each other's outputs: {e.args[1]}") from None

    def makers(self, table: str) -> list[str]:
        """Services that fill a table."""
        return [b.name for b in self.bound.values() if table in b.binding.output_tables]

    def closure(self, needed: dict[str, set[str]]) -> list[str]:
        """Services for columns by table, with all that these depend on, in order. A table of which only
        keys are asked for (or rows counted) needs all services that fill it, as they make its rows."""
        owners, wanted = self.owners(), set()

        def want(table: str, columns: set[str] | None) -> None:
            made = {owners[f"{table}.{c}"] for c in columns or () if f"{table}.{c}" in owners}
            for name in made or set(self.makers(table)):
                if name not in wanted:
                    wanted.add(name)
                    by: dict[str, set[str]] = {}
                    for c in self.bound[name].binding.inputs:
                        by.setdefault(split_column(c)[0], set()).add(split_column(c)[1])
                    for t, cs in by.items():
                        want(t, cs)

        for t, cs in needed.items():
            want(t, cs)
        return [name for name in self.order() if name in wanted]

    def blob_roots(self, services: list[str], tables: list[str]) -> list[str]:
        """Blob tables that services (by their inputs, all the way up) and a query's tables rest on."""
        found: dict[str, None] = {}

        def up(table: str) -> None:
            t = self.table(table)
            if t.blob:
                found[t.name] = None
            for parent in t.foreign_keys.values():
                up(split_column(parent)[0])
            for name in self.makers(table):
                for i in self.bound[name].binding.input_tables:
                    if i != table:
                        up(i)

        for name in services:
            for t in self.bound[name].binding.input_tables:
                up(t)
        for t in tables:
            if t in self.tables:
                up(t)
        return list(found)
