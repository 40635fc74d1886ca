"""User functions over columns: scalar ones and ones that give several columns or any number of rows.

A user function takes a pandas frame with its arguments as columns and gives one of: a frame (a row for each
row; or, if its index is labelled, any number of rows for each labelled row), a list of scalars, of lists (one row's
columns), or of frames (any number of rows for each row), a Series or an array. It may be a coroutine function. All become Arrow-batched pandas UDFs: scalar ones of the declared type, the
others of ``array<struct<...>>``, which SQL reads through ``LATERAL VIEW inline``.
"""

from __future__ import annotations

import asyncio
import inspect
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oakmill.plans.directives import QueryError, alias_of, calls, put_together, select_parts, tokens


@dataclass(frozen=True)
class UserFunction:
    name: str
    schema: T.StructType | None  # of several columns, or of rows
    kind: T.DataType | None  # of a scalar

    @property
    def is_rows(self) -> bool:
        return self.schema is not None


def _called(function, args: pd.DataFrame):
    out = function(args)
    if inspect.isawaitable(out):
        out = asyncio.run(_awaited(out))
    return out


async def _awaited(x):
    return await x


def _rows(out, n: int, names: list[str]) -> list[list[dict]]:
    """Rows for each input row, whatever form the function gave; rows with a null are left out."""
    if isinstance(out, pd.DataFrame) and not isinstance(out.index, pd.RangeIndex) and len(out):
        order = np.argsort(out.index.to_numpy(), kind="stable")  # labels say which input a row belongs to
        flat, lengths = out.iloc[order], np.bincount(out.index.to_numpy()[order], minlength=n)
    elif isinstance(out, pd.DataFrame):
        flat, lengths = out, np.ones(len(out), np.int64)
    elif isinstance(out, (list, pd.Series, np.ndarray)):
        out = list(out)
        if any(isinstance(x, pd.DataFrame) for x in out):
            lengths = np.array([len(x) for x in out], np.int64)
            full = [x.set_axis(range(x.shape[1]), axis=1) for x in out if len(x)]
            flat = pd.concat(full) if full else pd.DataFrame(columns=names)
        else:
            flat, lengths = pd.DataFrame([x if isinstance(x, (list, tuple, np.ndarray)) else [x] for x in out]), np.ones(len(out), np.int64)
    else:
        raise TypeError(f"a user function can't give {type(out).__name__}")
    if len(lengths) != n:
        raise ValueError(f"a user function gave {len(lengths)} results for {n} rows")
    if len(flat) and flat.shape[1] != len(names):
        raise ValueError(f"a user function gave {flat.shape[1]} columns for {len(names)}")
    if not len(flat):
        return [[] for _ in range(n)]
    flat = flat.set_axis(names, axis=1)
    whole = flat.notna().all(axis=1).to_numpy()
    kept = np.bincount(np.repeat(np.arange(n), lengths)[whole], minlength=n)
    records = flat[whole].to_dict("records")
    ends = np.cumsum(kept).tolist()
    return [records[e - k : e] for e, k in zip(ends, kept.tolist())]


def _scalars(out, n: int) -> pd.Series:
    if isinstance(out, pd.DataFrame):
        if out.shape[1] != 1:
            raise ValueError("a scalar function gave several columns")
        out = out.iloc[:, 0]
    if not isinstance(out, (list, pd.Series, np.ndarray)):
        raise TypeError(f"a user function can't give {type(out).__name__}")
    values = pd.Series(list(out))
    if len(values) != n:
        raise ValueError(f"a user function gave {len(values)} results for {n} rows")
    return values.map(lambda v: v.iloc[0, 0] if isinstance(v, pd.DataFrame) else v[0] if isinstance(v, (list, tuple)) else v)


def register(spark: SparkSession, name: str, function, returns: str) -> UserFunction:
    """Registers a function under a name (case doesn't matter). ``returns``: a type (``int``) for a scalar, columns
    (``a int, b string``) for several columns or rows."""
    name = name.lower()
    try:
        kind = T._parse_datatype_string(returns)
    except Exception as e:
        raise QueryError(f"{name}: no type {returns!r}") from e
    if isinstance(kind, T.StructType) and " " in returns.strip():
        rows = T.ArrayType(kind)
        names = kind.names

        @F.pandas_udf(rows)
        def wrapped(*args: pd.Series) -> pd.Series:
            frame = pd.concat(args, axis=1).set_axis(range(len(args)), axis=1) if args else pd.DataFrame()
            return pd.Series(_rows(_called(function, frame), len(frame), names))

        spark.udf.register(name, wrapped)
        return UserFunction(name, kind, None)
    if isinstance(kind, T.StructType):
        kind = kind[0].dataType

    @F.pandas_udf(kind)
    def scalar(*args: pd.Series) -> pd.Series:
        frame = pd.concat(args, axis=1).set_axis(range(len(args)), axis=1) if args else pd.DataFrame()
        return _scalars(_called(function, frame), len(frame))

    spark.udf.register(name, scalar)
    return UserFunction(name, None, kind)


def _give_argument(text: str, names: set[str]) -> str:
    """Pandas UDFs need an argument to know how many rows there are: ``f()`` becomes ``f(1)``."""
    parts = tokens(text)
    out = []
    for i, p in enumerate(parts):
        out.append(p)
        if p == "(" and i and parts[i - 1].lower() in names:
            rest = [q for q in parts[i + 1 :] if not q.isspace()]
            if rest and rest[0] == ")":
                out.append("1")
    return "".join(out)


def rewrite(sql: str, functions: dict[str, UserFunction]) -> tuple[str, list[int]]:
    """Row functions in the select list become lateral views, whose names also WHERE can use:
    ``f(x) AS (a, b)``, or without names ``f__0, f__1``. Also given: places of select items that are scalar user
    functions, whose nulls drop a row (-1: unknown, a star stands before)."""
    names = set(functions)
    if not calls(sql, names):
        return sql, []
    sql = _give_argument(sql, names)
    s = select_parts(sql)
    if s is None:
        return sql, []
    items, views, places, starred = [], [], [], False
    for k, item in enumerate(s.items):
        expression, alias = alias_of(item)
        starred = starred or expression.endswith("*")
        word = tokens(expression)[0].lower() if tokens(expression) else ""
        is_call = word in names and expression.rstrip().endswith(")") and calls(expression, names)[:1] == [(word, 0)] and len(calls(expression, names)) == 1
        if is_call and functions[word].is_rows:
            width = len(functions[word].schema)
            if alias and alias.startswith("("):
                given = [a.strip() for a in alias.strip("()").split(",")]
                if len(given) != width:
                    raise QueryError(f"{word} gives {width} columns, not {len(given)}")
            elif width == 1 and alias:
                given = [alias]
            else:
                given = [f"{alias or word}__{i}" for i in range(width)]
            views.append(f"LATERAL VIEW inline({expression}) __rows{k} AS {', '.join(given)}")
            items.extend(given)
            continue
        if any(functions[f].is_rows for f, _ in calls(item, names)):
            raise QueryError(f"a function of several columns must stand alone: {item}")
        if alias and alias.startswith("("):
            raise QueryError(f"{expression} gives one column")
        if is_call:
            places.append(-1 if starred else len(items))
        items.append(item)
    for text in (s.where or "",):
        if any(functions[f].is_rows for f, _ in calls(text, names)):
            raise QueryError("a function in a condition must give one column")
    if views:
        s.source = f"{s.source} {' '.join(views)}"
    return put_together(s, items), places
