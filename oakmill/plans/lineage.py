"""Which stored and inferred columns a query needs, read off Catalyst's analysed plan.

This is the only module that looks into Spark's plans (through Py4J). Names, aliases, stars, subqueries, CTEs
and set operations are resolved by Spark's own analyser; leaves are found by the temporary views that stand
for the catalog's tables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import SparkSession

from oakmill.catalog import Catalog, split_column

MAX_CLAUSES = 64
_SUBQUERIES = {"ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"}


@dataclass(frozen=True)
class Atom:
    """A condition without AND, OR: SQL with columns as `table.column`, and those columns."""

    sql: str
    columns: frozenset[str]

    def negated(self) -> "Atom":
        return Atom(self.sql[5:-1] if self.sql.startswith("(NOT ") else f"(NOT {self.sql})", self.columns)


@dataclass(frozen=True)
class Clause:
    """Atoms of which one must hold."""

    atoms: tuple[Atom, ...]

    @property
    def columns(self) -> frozenset[str]:
        return frozenset().union(*(a.columns for a in self.atoms))

    @property
    def sql(self) -> str:
        return "(" + " OR ".join(a.sql for a in self.atoms) + ")"


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _unique(items) -> list:
    return list(dict.fromkeys(items))


def cnf(tree) -> list[tuple] | None:
    """Conjunctive normal form of ("and"|"or"|"not", ...) over leaves with ``negated()``: clauses, each a tuple of
    leaves; None if there would be too many."""
    op = tree[0] if isinstance(tree, tuple) and tree and tree[0] in ("and", "or", "not") else None
    if op is None:
        return [(tree,)]
    if op == "not":
        inner = tree[1]
        kind = inner[0] if isinstance(inner, tuple) and inner and inner[0] in ("and", "or", "not") else None
        if kind == "not":
            return cnf(inner[1])
        if kind:
            return cnf(("or" if kind == "and" else "and", *(("not", x) for x in inner[1:])))
        return [(inner.negated(),)]
    parts = [cnf(x) for x in tree[1:]]
    if any(p is None for p in parts):
        return None
    if op == "and":
        return _unique(c for p in parts for c in p)
    size = 1
    for p in parts:
        size *= len(p)
    if size > MAX_CLAUSES:
        return None
    return _unique(tuple(_unique(a for c in combo for a in c)) for combo in product(*parts))


@dataclass
class Analysis:
    """Needed columns by table, how often each table occurs, what counts rows, pushable clauses and equalities."""

    needed: dict[str, set[str]] = field(default_factory=dict)
    occurs: dict[str, int] = field(default_factory=dict)
    clauses: list[Clause] = field(default_factory=list)
    equal: dict[str, set[str]] = field(default_factory=dict)
    counts_rows: bool = False

    def same(self, a: str, b: str) -> bool:
        return a == b or b in self.equal.get(a, ())


def analyse(spark: SparkSession, sql: str, catalog: Catalog) -> Analysis:
    """Analyses a SELECT whose tables are temporary views named as in the catalog."""
    found = Analysis()
    ids: dict[int, str] = {}
    top = spark.sql(sql)._jdf.queryExecution().analyzed()
    used: set[int] = set()
    conditions: list = []
    links: list = []  # of outer joins: rows of the other side matter only for rows that stay
    equalities: list[tuple[str, str]] = []
    closed: set[int] = set()  # columns of tables whose rows mustn't be dropped early

    def refs(e) -> set[int]:
        return {a.exprId().id() for a in _iterate(e.references().toSeq())}

    def expression(e) -> None:
        used.update(refs(e))
        stack = [e]
        while stack:
            x = stack.pop()
            if _kind(x) in _SUBQUERIES:
                node(x.plan(), False)
                for a in _seq(x.plan().output()):
                    used.add(a.exprId().id())
                for o in _seq(x.outerAttrs()):
                    used.update(refs(o))
            elif _kind(x) == "InSubquery":
                stack.append(x.query())
            if x.prettyName() == "count" and "count(1)" in x.sql().lower():
                found.counts_rows = True
            stack.extend(_seq(x.children()))

    def node(p, open_: bool) -> None:
        kind = _kind(p)
        if kind == "View":
            name = p.desc().identifier().table().lower()
            if name in catalog.tables:
                found.occurs[name] = found.occurs.get(name, 0) + 1
                found.needed.setdefault(name, set())
                for a in _seq(p.output()):
                    ids[a.exprId().id()] = f"{name}.{a.name().lower()}"
                    if not open_:
                        closed.add(a.exprId().id())
                return
        for e in _seq(p.expressions()):
            expression(e)
        children = _seq(p.children())
        if kind == "Filter" and open_:
            conditions.append(p.condition())
        if kind == "Join":
            how = p.joinType().toString().lower().replace("outer", "")
            sides = {"inner": (True, True), "cross": (True, True), "left": (True, False), "right": (False, True), "leftsemi": (True, False), "leftanti": (True, False)}
            sides = sides.get(how, (False, False))
            if how in ("inner", "cross") and open_ and p.condition().isDefined():
                conditions.append(p.condition().get())
            if how in ("left", "right") and open_ and p.condition().isDefined():
                links.append(p.condition().get())
            for child, ok in zip(children, sides):
                node(child, open_ and ok)
            return
        # (a condition above an aggregate that is about stored columns drops whole groups, as these are its keys)
        through = kind in ("Filter", "Project", "SubqueryAlias", "Aggregate", "Sort", "Distinct", "View")
        for child in children:
            node(child, open_ and through)

    node(top, True)
    for a in _seq(top.output()):
        used.add(a.exprId().id())
    for i in used:
        if i in ids:
            table, column = split_column(ids[i])
            found.needed[table].add(column)
    for condition in links + conditions:
        for conjunct in _conjuncts(condition):
            if _kind(conjunct) == "EqualTo":
                sides = [conjunct.left(), conjunct.right()]
                plain = [ids.get(s.exprId().id()) for s in sides if _kind(s) == "AttributeReference"]
                if len(plain) == 2 and all(plain):
                    equalities.append((plain[0], plain[1]))
                    continue
            if condition in links or refs(conjunct) & closed:
                continue
            tree = _tree(conjunct, ids)
            clauses = cnf(tree) if tree is not None else None
            if tree is not None and clauses is None:
                clauses = [(_whole(conjunct, ids),)]
            for c in clauses or ():
                found.clauses.append(Clause(c))
    _close(found.equal, equalities)
    found.clauses = _unique(found.clauses)
    return found


def _iterate(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _conjuncts(e) -> list:
    return _conjuncts(e.left()) + _conjuncts(e.right()) if _kind(e) == "And" else [e]


def _attributes(e) -> list:
    return [e] if _kind(e) == "AttributeReference" else [a for c in _seq(e.children()) for a in _attributes(c)]


def _plain(e) -> bool:
    """No subquery, and the same result whenever it is evaluated, without Python."""
    if _kind(e) in _SUBQUERIES | {"InSubquery", "PythonUDF", "OuterReference"} or not e.deterministic():
        return False
    return all(_plain(c) for c in _seq(e.children()))


def _whole(e, ids: dict[int, str]) -> Atom:
    text, columns = e.sql(), set()
    for shown, name in sorted({(a.sql(), ids[a.exprId().id()]) for a in _attributes(e)}, key=lambda x: -len(x[0])):
        text = re.sub(rf"(?<![\w.`]){re.escape(shown)}(?![\w.`])", lambda _, n=name: f"`{n}`", text)
        columns.add(name)
    return Atom(text, frozenset(columns))


def _tree(e, ids: dict[int, str]):
    """A tree of and, or, not over atoms; None if a part can't be evaluated early."""
    if not _plain(e) or not all(a.exprId().id() in ids for a in _attributes(e)):
        return None
    kind = _kind(e)
    if kind in ("And", "Or"):
        return (kind.lower(), _tree(e.left(), ids), _tree(e.right(), ids))
    if kind == "Not":
        return ("not", _tree(e.child(), ids))
    return _whole(e, ids)


def _close(equal: dict[str, set[str]], pairs: list[tuple[str, str]]) -> None:
    for a, b in pairs:
        group = {a, b} | equal.get(a, set()) | equal.get(b, set())
        for x in group:
            equal[x] = group


def where_clauses(spark: SparkSession, condition: str, root: dict[str, str] | None = None) -> list[list[str]] | None:
    """CNF of a condition's text, each clause the sorted SQL of its atoms; columns in ``root`` are renamed."""

    class Leaf(str):
        def negated(self):
            return Leaf(f"NOT {self}")

    def tree(e):
        kind = _kind(e)
        if kind in ("And", "Or"):
            return (kind.lower(), tree(e.left()), tree(e.right()))
        if kind == "Not":
            return ("not", tree(e.child()))
        text = e.sql()
        for a, b in (root or {}).items():
            text = re.sub(rf"(?<![\w.]){re.escape(a)}(?![\w.])", b, text)
        return Leaf(text)

    parser = spark._jsparkSession.sessionState().sqlParser()
    clauses = cnf(tree(parser.parseExpression(condition)))
    return clauses and [sorted(map(str, c)) for c in clauses]
