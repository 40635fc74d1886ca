"""What kind of query a text is, and which combinations are refused."""

from __future__ import annotations

import re
from enum import Enum

from oakmill.plans.directives import Directives, QueryError, Select, alias_of, calls, has_word, select_parts, tokens


class Kind(Enum):
    APPROX_JOIN = "approximate aggregate over a join"
    APPROX_AGGREGATE = "approximate aggregate"
    APPROX_SELECT = "approximate selection"
    LIMIT = "limit"
    SELECT = "select"
    OTHER = "not a select"


AGGREGATES = {"avg", "sum", "count"}
ALL_AGGREGATES = AGGREGATES | {"min", "max", "stddev", "variance", "collect_list", "collect_set", "approx_count_distinct", "first", "last"}


def has_outer_limit(sql: str) -> bool:
    depth = 0
    for t in tokens(sql):
        depth += (t == "(") - (t == ")")
        if depth == 0 and t.lower() == "limit":
            return True
    return False


def classify(sql: str, given: Directives, udfs: set[str]) -> Kind:
    """Kinds in the order in which they are tried; ``sql`` is without directives."""
    words = [t.lower() for t in tokens(sql) if not t.isspace()]
    if not words or words[0] not in ("select", "with", "(", "values", "from"):
        if given.any:
            raise QueryError("accuracy directives need a SELECT")
        return Kind.OTHER
    if given.error_target is not None and given.confidence is not None:
        return Kind.APPROX_JOIN if has_word(sql, "join") and calls(sql, udfs) else Kind.APPROX_AGGREGATE
    if given.recall_target is not None or given.precision_target is not None:
        return Kind.APPROX_SELECT
    if given.error_target is not None:
        raise QueryError("ERROR_TARGET needs CONFIDENCE")
    if given.confidence is not None:
        raise QueryError("CONFIDENCE needs ERROR_TARGET or RECALL_TARGET")
    return Kind.LIMIT if has_outer_limit(sql) else Kind.SELECT


def aggregate_items(sql: str) -> tuple[Select, list[tuple[str, str, str]]]:
    """The parts of an approximate aggregate and (function, argument, name) of each item; others are refused."""
    s = select_parts(sql)
    if s is None:
        raise QueryError("approximate aggregates need one plain SELECT")
    if re.match(r"(?i)group\b", s.rest):
        raise QueryError("approximate aggregates with GROUP BY aren't supported")
    if s.rest or s.distinct:
        raise QueryError("approximate aggregates take no DISTINCT, ORDER BY, HAVING or LIMIT")
    found = []
    for k, item in enumerate(s.items):
        expression, alias = alias_of(item)
        match = re.fullmatch(r"(?is)(\w+)\s*\((.*)\)", expression)
        name = match and match.group(1).lower()
        balanced = match and _balanced(match.group(2))
        if not match or name not in AGGREGATES or not balanced:
            raise QueryError(f"only AVG, COUNT and SUM can be approximated, one for each item: {item}")
        argument = match.group(2).strip()
        if re.match(r"(?i)distinct\b", argument):
            raise QueryError("COUNT(DISTINCT ...) can't be approximated by sampling")
        if argument == "*" and name != "count":
            raise QueryError(f"{name.upper()}(*) isn't defined")
        if calls(argument, ALL_AGGREGATES):
            raise QueryError("aggregates can't be nested")
        found.append((name, argument, alias or f"{name}_{k}"))
    return s, found


def _balanced(text: str) -> bool:
    depth = 0
    for t in tokens(text):
        depth += (t == "(") - (t == ")")
        if depth < 0:
            return False
    return depth == 0


def check_approx_select(given: Directives) -> None:
    if given.precision_target is not None:
        raise QueryError("PRECISION_TARGET isn't supported")
    if given.confidence is None:
        raise QueryError("RECALL_TARGET needs CONFIDENCE")
    if given.budget is not None:
        raise QueryError("BUDGET can't be given with RECALL_TARGET")


def check_udf_query(sql: str, kind: Kind, udfs: set[str]) -> None:
    """User functions: not one inside another, no aggregates except over a sampled join, neither with
    RECALL_TARGET nor LIMIT nor nested queries."""
    found = calls(sql, udfs)
    if not found:
        return
    if any(depth for _, depth in found):
        raise QueryError("user functions can't be nested")
    if kind == Kind.APPROX_AGGREGATE or (kind != Kind.APPROX_JOIN and calls(sql, ALL_AGGREGATES)):
        raise QueryError("user functions can't be used with aggregates")
    if kind in (Kind.APPROX_SELECT, Kind.LIMIT):
        raise QueryError("user functions can't be used with RECALL_TARGET or LIMIT")
    if sum(t.lower() == "select" for t in tokens(sql)) > 1:
        raise QueryError("user functions can't be used with nested queries")
