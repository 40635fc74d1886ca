"""Accuracy directives at the end of a query, and light rewriting of SQL text on tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

TOKEN = re.compile(
    r"""\s+|--[^\n]*|/\*.*?\*/|'(?:[^'\\]|''|\\.)*'|"(?:[^"\\]|\\.)*"|`(?:[^`]|``)*`|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+|\w+|<=>|<>|!=|>=|<=|\|\||==|.""",
    re.DOTALL,
)
NAMES = ("error_target", "recall_target", "precision_target", "confidence", "budget")
CLAUSES = {"where", "group", "having", "order", "limit", "offset", "union", "intersect", "except", "window", "lateral", "cluster", "distribute", "sort", "qualify"}


class QueryError(ValueError):
    """A query that the engine doesn't accept."""


@dataclass(frozen=True)
class Directives:
    """Targets as fractions; ``confidence`` in percent and ``budget`` as written."""

    error_target: float | None = None
    recall_target: float | None = None
    precision_target: float | None = None
    confidence: float | None = None
    budget: float | None = None

    @property
    def any(self) -> bool:
        return any(getattr(self, n) is not None for n in NAMES)


def tokens(sql: str) -> list[str]:
    return TOKEN.findall(sql)


def _is_blank(token: str) -> bool:
    return token.isspace() or token.startswith(("--", "/*"))


def strip(sql: str) -> tuple[str, Directives]:
    """The query without directives and closing semicolon, and the directives. One given twice, or inside a
    subquery, is an error."""
    found: dict[str, float] = {}
    out: list[str] = []
    parts, depth, i = tokens(sql), 0, 0
    while i < len(parts):
        word = parts[i].lower()
        depth += (word == "(") - (word == ")")
        following = [k for k in range(i + 1, len(parts)) if not _is_blank(parts[k])][:2]
        if word in NAMES and following and re.fullmatch(r"\d+(\.\d+)?|\.\d+", parts[following[0]]):
            if depth:
                raise QueryError(f"{word.upper()} can't be used in a subquery")
            if word in found:
                raise QueryError(f"{word.upper()} is given twice")
            value = float(parts[following[0]])
            percent = len(following) > 1 and parts[following[1]] == "%"
            found[word] = value / 100 if word.endswith("target") else value
            i = following[1 if percent else 0] + 1
            continue
        out.append(parts[i])
        i += 1
    text = "".join(out).strip()
    while text.endswith(";"):
        text = text[:-1].rstrip()
    return text, Directives(**found)


@dataclass
class Select:
    """Where the outermost SELECT's parts are, as text: list, FROM clause, WHERE condition, what follows."""

    distinct: bool
    items: list[str]
    source: str
    where: str | None
    rest: str
    prefix: str = ""


def _split_commas(parts: list[str]) -> list[str]:
    out, depth = [""], 0
    for p in parts:
        depth += (p in "([{" and len(p) == 1) - (p in ")]}" and len(p) == 1)
        if p == "," and depth == 0:
            out.append("")
        else:
            out[-1] += p
    return [x.strip() for x in out if x.strip()]


def select_parts(sql: str) -> Select | None:
    """The parts of a plain SELECT (with or without WITH before it); None for other statements and set operations."""
    parts, depth = tokens(sql), 0
    marks: dict[str, int] = {}
    for i, p in enumerate(parts):
        depth += (p == "(") - (p == ")")
        word = p.lower()
        if depth:
            continue
        if word in ("union", "intersect", "except", "minus") and "select" in marks:
            return None
        if word == "select" and "select" not in marks:
            marks["select"] = i
        elif word == "from" and "select" in marks and "from" not in marks:
            marks["from"] = i
        elif word == "where" and "from" in marks and "where" not in marks and "rest" not in marks:
            marks["where"] = i
        elif word in CLAUSES - {"where", "lateral"} and "from" in marks and "rest" not in marks:
            marks["rest"] = i
    if "select" not in marks or "from" not in marks:
        return None
    rest = marks.get("rest", len(parts))
    stop = marks.get("where", rest)
    chosen = parts[marks["select"] + 1 : marks["from"]]
    words = [p for p in chosen if not _is_blank(p)]
    distinct = bool(words) and words[0].lower() == "distinct"
    if distinct:
        chosen = chosen[next(k for k, p in enumerate(chosen) if p.lower() == "distinct") + 1 :]
    return Select(
        distinct,
        _split_commas(chosen),
        "".join(parts[marks["from"] + 1 : stop]).strip(),
        "".join(parts[marks["where"] + 1 : rest]).strip() if "where" in marks else None,
        "".join(parts[rest:]).strip(),
        "".join(parts[: marks["select"]]).strip(),
    )


def put_together(s: Select, items: list[str] | None = None, where: str | None | bool = False) -> str:
    where = s.where if where is False else where
    return " ".join(
        x
        for x in (s.prefix, "SELECT", "DISTINCT" if s.distinct else "", ", ".join(items or s.items), "FROM", s.source, f"WHERE {where}" if where else "", s.rest)
        if x
    )


def alias_of(item: str) -> tuple[str, str | None]:
    """The expression of a select item and its alias after AS, if it has one."""
    parts, depth = tokens(item), 0
    for i, p in enumerate(parts):
        depth += (p == "(") - (p == ")")
        if depth == 0 and p.lower() == "as":
            return "".join(parts[:i]).strip(), "".join(parts[i + 1 :]).strip().strip("`")
    return item.strip(), None


def substitute(text: str, names: dict[str, str]) -> str:
    """Identifiers that stand alone (no qualifier, no call) replaced by expressions."""
    parts = tokens(text)
    out = []
    for i, p in enumerate(parts):
        before = next((q for q in reversed(parts[:i]) if not _is_blank(q)), "")
        after = next((q for q in parts[i + 1 :] if not _is_blank(q)), "")
        key = p.strip("`").lower()
        out.append(f"({names[key]})" if key in names and before != "." and after not in (".", "(") and p[0] not in "'\"" else p)
    return "".join(out)


def inline_aliases(sql: str, columns: set[str]) -> str:
    """A WHERE condition may use aliases of the select list: each is replaced by its expression. Names of columns
    come first. An alias given twice is an error."""
    s = select_parts(sql)
    if s is None:
        return sql
    aliases: dict[str, str] = {}
    for item in s.items:
        expression, alias = alias_of(item)
        if alias and not alias.startswith("("):
            if alias.lower() in aliases:
                raise QueryError(f"alias {alias} is given twice")
            aliases[alias.lower()] = expression
    usable = {k: v for k, v in aliases.items() if k not in columns}
    if s.where and usable:
        return put_together(s, where=substitute(s.where, usable))
    return sql


def calls(text: str, names: set[str]) -> list[tuple[str, int]]:
    """Calls of the named functions in a text, with the depth of calls of these functions around each."""
    parts, found, stack = tokens(text), [], []
    for i, p in enumerate(parts):
        after = next((q for q in parts[i + 1 :] if not _is_blank(q)), "")
        if p == "(":
            before = next((q for q in reversed(parts[:i]) if not _is_blank(q)), "")
            stack.append(before.lower() in names)
        elif p == ")" and stack:
            stack.pop()
        elif p.lower() in names and after == "(":
            found.append((p.lower(), sum(stack)))
    return found


def has_word(sql: str, *words: str) -> bool:
    return any(t.lower() in words for t in tokens(sql))
