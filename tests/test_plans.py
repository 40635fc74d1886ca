"""Directives, kinds of queries, conjunctive normal form, statistics."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oakmill.functions import stats
from oakmill.functions.stats import Moments
from oakmill.plans import combinations, directives, kinds
from oakmill.plans.directives import QueryError
from oakmill.plans.kinds import Kind
from oakmill.plans.lineage import cnf, where_clauses


def kind(sql, udfs=()):
    text, given_ = directives.strip(sql)
    return kinds.classify(text, given_, set(udfs))


def test_directives():
    text, d = directives.strip("SELECT avg(x) FROM t WHERE y = 'CONFIDENCE 5' ERROR_TARGET 10% CONFIDENCE 95%;")
    assert text == "SELECT avg(x) FROM t WHERE y = 'CONFIDENCE 5'"
    assert (d.error_target, d.confidence, d.recall_target) == (0.1, 95, None)
    assert directives.strip("SELECT confidence FROM t")[1].confidence is None
    with pytest.raises(QueryError):
        directives.strip("SELECT avg(x) FROM t ERROR_TARGET 10% ERROR_TARGET 5% CONFIDENCE 95%")
    with pytest.raises(QueryError):
        directives.strip("SELECT * FROM (SELECT avg(x) FROM t ERROR_TARGET 10% CONFIDENCE 95%)")


def test_kinds():
    assert kind("SELECT AVG(x) FROM t ERROR_TARGET 10% CONFIDENCE 95%") == Kind.APPROX_AGGREGATE
    assert kind("SELECT COUNT(*) FROM a CROSS JOIN b WHERE f(a.x, b.y) = TRUE ERROR_TARGET 10% CONFIDENCE 95%", ["f"]) == Kind.APPROX_JOIN
    assert kind("SELECT COUNT(*) FROM a JOIN b ON a.x = b.x ERROR_TARGET 10% CONFIDENCE 95%", ["f"]) == Kind.APPROX_AGGREGATE
    assert kind("SELECT x FROM t RECALL_TARGET 90% CONFIDENCE 95%") == Kind.APPROX_SELECT
    assert kind("SELECT x FROM t LIMIT 3") == Kind.LIMIT
    assert kind("SELECT x FROM (SELECT x FROM t LIMIT 3)") == Kind.SELECT
    assert kind("SELECT AVG(x) FROM a JOIN b ON a.x = b.x") == Kind.SELECT
    assert kind("CREATE TABLE t (x int)") == Kind.OTHER
    for bad in ("SELECT AVG(x) FROM t ERROR_TARGET 10%", "SELECT AVG(x) FROM t CONFIDENCE 95%", "DELETE FROM t ERROR_TARGET 1% CONFIDENCE 95%"):
        with pytest.raises(QueryError):
            kind(bad)


@pytest.mark.parametrize("bad", ["SELECT MAX(x) FROM t", "SELECT AVG(x) FROM t GROUP BY y", "SELECT x FROM t", "SELECT AVG(x) + 1 FROM t", "SELECT COUNT(DISTINCT x) FROM t", "SELECT AVG(x) FROM t ORDER BY 1", "SELECT SUM(*) FROM t", "SELECT SUM(x), y FROM t"])
def test_aggregates_that_cant_be_approximated(bad):
    with pytest.raises(QueryError):
        kinds.aggregate_items(bad)


def test_aggregate_items():
    _, items = kinds.aggregate_items("SELECT AVG(x + (y * 2)) AS m, COUNT(*), sum(if(a, 1, 0)) FROM t WHERE z > 1")
    assert items == [("avg", "x + (y * 2)", "m"), ("count", "*", "count_1"), ("sum", "if(a, 1, 0)", "sum_2")]


def test_approx_select_rules():
    for bad in ("SELECT x FROM t PRECISION_TARGET 90% CONFIDENCE 95%", "SELECT x FROM t RECALL_TARGET 90%", "SELECT x FROM t RECALL_TARGET 90% CONFIDENCE 95% BUDGET 100"):
        with pytest.raises(QueryError):
            kinds.check_approx_select(directives.strip(bad)[1])


@pytest.mark.parametrize("bad", ["SELECT f(g(x)) FROM t", "SELECT AVG(f(x)) FROM t", "SELECT AVG(f(x)) FROM t ERROR_TARGET 1% CONFIDENCE 95%", "SELECT f(x) FROM t LIMIT 3", "SELECT f(x) FROM t RECALL_TARGET 90% CONFIDENCE 95%", "SELECT f(x) FROM t WHERE y IN (SELECT y FROM u)"])
def test_user_functions_that_are_refused(bad):
    text, d = directives.strip(bad)
    with pytest.raises(QueryError):
        kinds.check_udf_query(text, kinds.classify(text, d, {"f", "g"}), {"f", "g"})


def test_aliases_in_where():
    got = directives.inline_aliases("SELECT a.x AS big, y FROM a WHERE big > 3 AND a.big < 2 AND f(big) = 'big'", {"y"})
    assert got == "SELECT a.x AS big, y FROM a WHERE (a.x) > 3 AND a.big < 2 AND f((a.x)) = 'big'"
    with pytest.raises(QueryError):
        directives.inline_aliases("SELECT x AS a, y AS a FROM t", set())


GOLDEN = [
    ("x_min > 600 OR frame > 700 AND frame < 1000 OR x_max = 1", ["b.frame > 700 | x_max = 1 | x_min > 600", "b.frame < 1000 | x_max = 1 | x_min > 600"]),
    ("(y_min < 300 OR y_max > 700) AND (frame >= 500 AND frame <= 600) OR x_min = 100", ["x_min = 100 | y_max > 700 | y_min < 300", "b.frame >= 500 | x_min = 100", "b.frame <= 600 | x_min = 100"]),
    ("(x_min < 200 OR y_max > 800) AND frame < 400 OR NOT (x_max = 900)", ["NOT x_max = 900 | x_min < 200 | y_max > 800", "NOT x_max = 900 | b.frame < 400"]),
    ("(frame >= 100 AND frame <= 300) OR (x_min < 100 AND y_min > 600) AND NOT (x_max = y_max)", None),
]


@pytest.mark.parametrize("condition,want", GOLDEN)
def test_normal_form(spark, condition, want):
    got = [" | ".join(sorted(a.replace("(", "").replace(")", "") for a in c)) for c in where_clauses(spark, condition, {"frame": "b.frame"})]
    if want is None:
        assert len(got) == 6
    else:
        assert sorted(got) == sorted(want)


class Leaf(str):
    def negated(self):
        return Leaf(self[1:]) if self.startswith("!") else Leaf(f"!{self}")


trees = st.recursive(st.sampled_from("abcd").map(Leaf), lambda t: st.tuples(st.just("not"), t) | st.tuples(st.sampled_from(["and", "or"]), t, t), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(trees, st.lists(st.booleans(), min_size=4, max_size=4))
def test_normal_form_means_the_same(tree, values):
    world = dict(zip("abcd", values))

    def value(t):
        if isinstance(t, Leaf):
            return not world[t[1:]] if t.startswith("!") else world[t]
        return not value(t[1]) if t[0] == "not" else all(map(value, t[1:])) if t[0] == "and" else any(map(value, t[1:]))

    clauses = cnf(tree)
    if clauses is not None:
        assert all(any(value(a) for a in c) for c in clauses) == value(tree)


# -- statistics


def test_quantiles():
    assert abs(stats.chi2_ppf(0.025, 999) - 913.3010) < 1e-3
    assert abs(stats.chi2_ppf(0.95, 1) - 3.841459) < 1e-5 and abs(stats.chi2_ppf(0.05, 10) - 3.940299) < 1e-5
    assert abs(stats.normal_ppf(0.975) - 1.959964) < 1e-5


@settings(max_examples=200, deadline=None)
@given(st.floats(-1 / math.e + 1e-9, 1e6))
def test_lambert_w(z):
    w = stats.lambert_w(z)
    assert abs(w * math.exp(w) - z) < 1e-6 * (1 + abs(z)) and w >= -1


def test_bennett():
    m = Moments(1000, 1000 * 5, 1000 * 26, 9)  # mean 5, variance 1
    t = stats.bennett(m, 0.05)
    v = stats.std_upper(m, 0.05) ** 2
    u = 9 * t / v
    assert abs(1000 * v / 81 * ((1 + u) * math.log(1 + u) - u) - math.log(2 / 0.05)) < 1e-6
    assert stats.bennett(Moments(10, 50, 250, 5), 0.05) == 0 and stats.bennett(Moments(0, 0, 0, 0), 0.05) == 0


def test_required_samples():
    assert stats.required(Moments(1000, 0, 1000, 5), 0.1, 0.05) is None
    assert stats.required(Moments(1000, 5000, 25000, 5), 0.1, 0.05) == 0
    few, many = (stats.required(Moments(1000, 5000, 26000, 9), e, 0.05) for e in (0.1, 0.01))
    assert 0 < few < many and stats.required(Moments(1000, 5000, 26000, 9), 0.1, 0.05, 0.5) > few
    e = stats.mean_error(0.1)
    assert (1 + e) ** 2 <= 1.1 + 1e-9 and (1 - e) ** 2 >= 0.9 - 1e-9


def test_bennett_covers():
    rng = np.random.default_rng(0)
    hits = 0
    for _ in range(200):
        x = rng.exponential(3, 500)
        m = Moments(500, x.sum(), (x * x).sum(), x.max())
        hits += abs(x.mean() - 3) <= stats.bennett(m, 0.05)
    assert hits >= 195


def test_conditions_over_combinations():
    assert combinations.conjuncts("a = 1 AND b BETWEEN 1 AND 2 AND CASE WHEN x AND y THEN 1 END = 1 AND (p AND q)") == ["a = 1", "b BETWEEN 1 AND 2", "CASE WHEN x AND y THEN 1 END = 1", "(p AND q)"]
    assert combinations.conjuncts("a = 1 AND b OR c") == ["a = 1 AND b OR c"]
    tables = {"t": {"a": True, "k": True, "x": False}, "u": {"b": True, "k": True}, "v": {"c": True, "k": True}}
    made = lambda text: combinations.combined(text, tables, {"f"})
    text, (found,) = made("SELECT * FROM t JOIN u AS w ON f(a, w.b) = TRUE AND t.x < w.b WHERE t.k = 3")
    assert text == "SELECT * EXCEPT (__combined0_0, __combined0_1) FROM __combined0 CROSS JOIN t t CROSS JOIN u w WHERE (t.x < w.b) AND (t.k = 3) AND (t.`a` <=> __combined0_0) AND (w.`b` <=> __combined0_1)"
    assert found.sql == "SELECT t.`a` AS __combined0_0, w.`b` AS __combined0_1 FROM (SELECT DISTINCT t.`a` FROM t t WHERE (t.k = 3)) t CROSS JOIN (SELECT DISTINCT w.`b` FROM u w) w WHERE f(a, w.b) = TRUE"
    _, (found,) = made("SELECT 1 AS one FROM t, u, v WHERE t.k = u.k AND f(a, c)")  # values only of rows that are joined
    assert "SELECT DISTINCT t.`a` FROM t t CROSS JOIN u u WHERE (t.k = u.k)" in found.sql
    for kept in (
        "SELECT a FROM t WHERE f(a, k)",
        "SELECT a FROM t JOIN u ON t.k = u.k WHERE f(a, b)",
        "SELECT a FROM t JOIN u ON upper(t.k) = upper(u.k) WHERE f(a, b)",
        "SELECT a FROM t LEFT JOIN u ON f(a, b)",
        "SELECT a FROM t, u WHERE f(a, b) > rand()",
        "SELECT a FROM t, u WHERE f(x, b)",
        "SELECT a FROM t, u WHERE f(t.k, 1) AND t.a = u.b",
        "SELECT a FROM t JOIN u USING (k) WHERE f(a, b)",
    ):
        assert made(kept) is None
