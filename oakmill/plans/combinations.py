"""Conditions with user functions over columns of several tables, decided once for each combination of different values.

Over a join without keys such a condition would be called for every pair of rows. Instead the different values of its
columns are combined, those combinations stay for which it holds, and the tables are joined to them by equality (nulls too):
the same rows, as a user function gives the same for the same arguments, and never more calls.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from oakmill.plans.directives import Select, calls, put_together, select_parts, tokens

_WORDS = {"and", "or", "not", "is", "null", "true", "false", "between", "in", "like", "ilike", "case", "when", "then", "else", "end", "distinct", "from"}
_EQUALS = {"=", "==", "<=>"}
_OTHER_JOINS = {"left", "right", "full", "semi", "anti", "natural", "using"}


@dataclass
class Combinations:
    """The combinations for which a condition holds: their view, the SQL that makes it, and its columns by alias and column."""

    view: str
    sql: str
    names: dict[tuple[str, str], str]


def _code(text: str) -> list[str]:
    return [" " if p.startswith(("--", "/*")) else p for p in tokens(text)]


def conjuncts(text: str) -> list[str]:
    """The parts of a condition's text that AND joins."""
    out, depth, cases, betweens = [""], 0, 0, 0
    for p in _code(text):
        word = p.lower()
        depth += (p == "(") - (p == ")")
        if depth == 0:
            cases += (word == "case") - (word == "end")
            if not cases and word == "or":
                return [text.strip()]
            betweens += not cases and word == "between"
            if not cases and word == "and":
                if not betweens:
                    out.append("")
                    continue
                betweens -= 1
        out[-1] += p
    return [x.strip() for x in out if x.strip()]


def inner_joins(source: str) -> tuple[dict[str, str], list[str], str] | None:
    """Tables by alias, conditions of ON and lateral views of a FROM clause; None if there is more than inner joins of
    named tables."""
    parts = _code(source)
    found: dict[str, list[str]] = {"table": [], "condition": []}
    kind, now, depth, tail = "table", "", 0, ""
    for i, p in enumerate(parts):
        word = p.lower()
        depth += (p == "(") - (p == ")")
        if depth == 0:
            after = next((q for q in parts[i + 1 :] if not q.isspace()), "")
            if word == "lateral":
                tail = "".join(parts[i:])
                break
            if word in _OTHER_JOINS and (after != "(" or word == "using"):
                return None
            if word in ("join", ",", "on"):
                found[kind].append(now)
                kind, now = "condition" if word == "on" else "table", ""
                continue
            if word in ("cross", "inner"):
                continue
        now += p
    found[kind].append(now)
    tables: dict[str, str] = {}
    for text in found["table"]:
        words = [p.strip("`").lower() for p in tokens(text) if not p.isspace()]
        words = words[:1] + words[2:] if words[1:2] == ["as"] else words
        if not 1 <= len(words) <= 2 or not all(re.fullmatch(r"\w+", w) for w in words) or words[-1] in tables:
            return None
        tables[words[-1]] = words[0]
    return tables, found["condition"], tail


def _columns(condition: str, known: dict[str, set[str]], functions: set[str]) -> dict[str, list[str]] | None:
    """Columns of a condition by alias; None if there is anything in it but columns, literals and user functions."""
    parts = [p for p in _code(condition) if not p.isspace()]
    found: dict[str, list[str]] = {}
    for i, p in enumerate(parts):
        before, after = parts[i - 1] if i else "", parts[i + 1] if i + 1 < len(parts) else ""
        word = p.strip("`").lower()
        if not re.fullmatch(r"\w+", word) or p[0].isdigit() or p[0] in "'\"" or before == ".":
            continue
        if after == ".":
            owners, column = [word] if word in known else [], parts[i + 2].strip("`").lower() if i + 2 < len(parts) else ""
        else:
            if word in functions and after == "(" or word in _WORDS:
                continue
            owners, column = [a for a, own in known.items() if word in own], word
        if len(owners) != 1 or column not in known[owners[0]] or after == "(":
            return None
        own = found.setdefault(owners[0], [])
        if column not in own:
            own.append(column)
    return found


def _groups(plain: dict[str, dict[str, list[str]]], aliases) -> dict[str, str]:
    """Aliases that equalities join have the same value."""
    group = {a: a for a in aliases}
    for c, own in plain.items():
        words = {p.lower() for p in _code(c)}
        if len(own) > 1 and words & _EQUALS and "or" not in words:
            joined = {group[a] for a in own}
            group = {a: min(joined) if g in joined else g for a, g in group.items()}
    return group


def combined(sql: str, columns: dict[str, dict[str, bool]], functions: set[str]) -> tuple[str, list[Combinations]] | None:
    """The query over combinations, and these; None if it has no such condition. ``columns``: those of each table, and
    whether equality tells all their values apart."""
    s: Select | None = select_parts(sql) if calls(sql, functions) else None
    joined = inner_joins(s.source) if s and not s.prefix else None
    if joined is None:
        return None
    tables, conditions, tail = joined
    if len(tables) < 2 or not set(tables.values()) <= set(columns):
        return None
    known = {a: set(columns[t]) for a, t in tables.items()}
    conditions = [c for text in [*conditions, s.where or ""] for c in conjuncts(text)]
    plain: dict[str, dict[str, list[str]]] = {}
    for c in conditions:
        if not calls(c, functions):
            own = _columns(c, known, set())
            if own is not None:
                plain[c] = own
            elif _EQUALS & set(_code(c)):
                return None  # may join tables in a way that isn't understood here
    group = _groups(plain, tables)
    rest, found = [], []
    for c in conditions:
        own = _columns(c, known, functions) if calls(c, functions) else None
        apart = own and len(own) > 1 and len({group[a] for a in own}) == len(own)
        if not apart or not all(columns[tables[a]][x] for a, xs in own.items() for x in xs):
            rest.append(c)
            continue
        view = f"__combined{len(found)}"
        names = {pair: f"{view}_{j}" for j, pair in enumerate((a, x) for a, xs in own.items() for x in xs)}
        values = []
        for a, xs in own.items():
            others = [b for b in tables if group[b] == group[a]]
            own_conditions = [f"({x})" for x, by in plain.items() if by and set(by) <= set(others)]
            where = f" WHERE {' AND '.join(own_conditions)}" if own_conditions else ""
            values.append(f"(SELECT DISTINCT {', '.join(f'{a}.`{x}`' for x in xs)} FROM {' CROSS JOIN '.join(f'{tables[b]} {b}' for b in others)}{where}) {a}")
        shown = ", ".join(f"{a}.`{x}` AS {n}" for (a, x), n in names.items())
        found.append(Combinations(view, f"SELECT {shown} FROM {' CROSS JOIN '.join(values)} WHERE {c}", names))
    if not found:
        return None
    rest += [f"{a}.`{x}` <=> {n}" for f in found for (a, x), n in f.names.items()]
    s.source = " CROSS JOIN ".join([*[f.view for f in found], *[f"{t} {a}" for a, t in tables.items()]]) + f" {tail}".rstrip()
    added = ", ".join(n for f in found for n in f.names.values())
    s.items = [f"* EXCEPT ({added})" if i == "*" else i for i in s.items]
    return put_together(s, where=" AND ".join(f"({c})" for c in rest)), found
