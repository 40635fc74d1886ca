"""Operators on vectors, pages and conversations."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from oakmill.llm import quotes, topk, warc

# -- exact top-k


def best_by_force(rows, is_query, k):
    rows = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    rows = list({(i, tuple(v)) for i, v in rows})
    out = set()
    for i, v in rows:
        if is_query(i):
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i and len(w) == len(v))
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize("blocks", [(8192, 1024), (16, 4)])
def test_top_k_is_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[1])
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(150)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (3, rows[3][1])]  # ties and a repeated row
    rows += [(300, None), (310, []), (320, [1.0] * 7 + [None]), (330, [float("nan")] * 8), (340, [float("inf")] * 8), (None, [0.5] * 8)]
    rows += [(350, [1.0, 2.0]), (360, [2.0, 1.0]), (370, [1e6] * 8), (380, [-1e6] * 8)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, hash string, d string")
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=4).collect()
    assert {tuple(r) for r in got} == best_by_force(rows, lambda i: i % 10 == 0, 4)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, F.col("vec_id") % 10 == 0).count() == 0


def clusters(n=20, each=50):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(n, 4)) * 1000
    return np.concatenate([c + rng.normal(size=(each, 4)) * 5 for c in centres]).astype(np.int64)


def test_bounds_leave_candidates_out():
    """Where vectors lie in clusters most of them are never evaluated, nor is anything below a score known before."""
    vectors = clusters()
    pivots = topk._farthest_first(vectors.astype(float), 20)
    table = topk._distances(vectors.astype(float), pivots)
    evaluated = []
    for q in range(0, 1000, 50):
        ((score, at, n),) = topk.search_block(vectors[q : q + 1], table[q : q + 1], vectors, table, lambda _: np.arange(1000) == q, 5)
        want = sorted((-int(vectors[q] @ v), k) for k, v in enumerate(vectors) if k != q)[:5]
        assert [(-s, a) for s, a in zip(score.tolist(), at.tolist())] == want
        evaluated.append(n)
        ((again, _, fewer),) = topk.search_block(vectors[q : q + 1], table[q : q + 1], vectors, table, lambda _: np.arange(1000) == q, 5, least=[float(score[-1])])
        assert fewer <= n and set(again.tolist()) >= set(score.tolist())
    assert sum(evaluated) < 0.5 * 20 * 1000


def test_cells_are_left_out_and_never_wrongly():
    vectors = clusters().astype(float)
    pivots = topk._farthest_first(vectors, 20)
    table = topk._distances(vectors, pivots)
    cell, norms = table.argmin(1), (vectors**2).sum(1)
    own = [np.flatnonzero(cell == c) for c in range(len(pivots))]
    low, high = (np.array([f(table[k], axis=0) for k in own]) for f in (np.min, np.max))
    most, skipped = np.array([norms[k].max() for k in own]), 0
    for q in range(0, 1000, 50):
        bound = topk.cell_bounds(table[q], norms[q], low, high, most)
        assert all(bound[c] >= (vectors[k] @ vectors[q]).max() for c, k in enumerate(own))
        skipped += (bound < sorted(vectors @ vectors[q])[-6]).sum()
    assert skipped > 0.2 * 20 * len(own)


def test_top_k_of_long_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=5000).tolist()) for i in range(30)] + [(40, rng.normal(size=20_000).tolist()), (50, rng.normal(size=20_000).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=3).collect()
    assert {tuple(r) for r in got} == best_by_force(rows, lambda i: i % 10 == 0, 3)


# -- WARC


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://h/{k}", f"<p>page {k}</p>" * (k % 5), "x", 1) for k in range(700)]
    rows += [(800, None, None, None, None), (801, "u", "", "x", 1), (5, "http://h/5", "", "x", 1), (None, "u", "h", "x", 1), (802, "long", "é" * 300_000, "x", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, node int")


def test_intact_replicas(pages):
    recs = warc.records(pages)
    got = warc.audit(recs, recs)
    assert got.count() == 703 and {r["status"] for r in got.select("status").distinct().collect()} == {"intact"}


def test_damage_is_found(spark, pages):
    recs = warc.records(pages)
    cut = F.when(F.col("page_id") == 300, F.lit(b"gone")).otherwise(F.col("record"))
    other = recs.where("page_id NOT IN (258, 699)").select("page_id", cut.alias("record")).unionByName(recs.where("page_id = 1").select(F.lit(9999).cast("long").alias("page_id"), "record"))
    got = {r["page_id"]: r["status"] for r in warc.audit(recs, other).collect() if r["status"] != "intact"}
    assert got[258] == "missing" and got[699] == "missing" and got[300] == "altered" and got[9999] == "extra"
    assert {p for p, s in got.items() if s == "moved"} <= set(range(259, 512)) and got[259] == "moved"


def test_only_differing_branches_are_read(spark, pages):
    recs = warc.records(pages).where("page_id < 700 AND page_id <> 5")
    other = recs.select("page_id", F.when(F.col("page_id") == 77, F.lit(b"x")).otherwise(F.col("record")).alias("record"))
    last = warc.levels(warc.leaves(recs.where("page_id >= 256")))
    assert warc.differing(last, last).count() == 0
    bad = warc.differing(warc.levels(warc.leaves(recs)), warc.levels(warc.leaves(other)))
    assert min(r["page_id"] for r in bad.collect()) == 77 and max(r["page_id"] for r in bad.collect()) < 256


def test_any_ids(spark):
    """Negative, mixed and extreme ids end in one root, and damage is found among them."""
    ids = [-(1 << 63), -(1 << 63) + 1, -300, -3, -1, 0, 5, 255, 256, 2**53 + 1, 2**53 + 3, (1 << 63) - 1]
    pages = spark.createDataFrame([(i, f"u{i}", f"h{i}") for i in ids], "page_id long, url string, html string")
    recs = warc.records(pages)
    assert {(r["page_id"], r["file_id"]) for r in warc.leaves(recs).collect()} == {(i, i // warc.PER_FILE) for i in ids}
    assert len(warc.levels(warc.leaves(recs))) <= 17
    other = recs.where("page_id <> 5").select("page_id", F.when(F.col("page_id") == -3, F.lit(b"x")).otherwise(F.col("record")).alias("record"))
    got = {r["page_id"]: r["status"] for r in warc.audit(recs, other).collect()}
    assert set(got) == set(ids) and got[-3] == "altered" and got[5] == "missing" and got[-300] == got[(1 << 63) - 1] == got[-(1 << 63)] == "intact"


def test_empty_replicas(pages):
    recs = warc.records(pages)
    nothing = recs.where("false")
    assert warc.audit(nothing, nothing).count() == 0
    assert {r["status"] for r in warc.audit(recs, nothing).collect()} == {"missing"}
    assert {r["status"] for r in warc.audit(nothing, recs).collect()} == {"extra"}


def test_files_round_trip(spark, pages, tmp_path):
    recs = warc.records(pages)
    files = warc.write_warc(recs, str(tmp_path / "out")).collect()
    assert sorted(f["file_id"] for f in files) == [0, 1, 2, 3]
    back = warc.read_warc(spark, str(tmp_path / "out"))
    leaf = {(r["page_id"], r["sha256"]): (r["file_id"], r["offset"], r["length"]) for r in warc.leaves(recs).collect()}
    rows = back.collect()
    assert len(rows) == len(leaf)
    for r in rows:
        file_id, offset, length = leaf[r["page_id"], r["sha256"]]
        assert r["path"].endswith(f"/{file_id}.warc") and (r["offset"], r["length"]) == (offset, length)


# -- quotations

TALK = [
    (1, 0, "user", "Where is the key?\nI looked everywhere."),
    (1, 1, "assistant", "> Where is the key?\nIn the drawer.\nAs always."),
    (1, 2, "user", "On Monday Ann wrote:\n>> Where is the key?\n> In the drawer.\n\nThanks!"),
    (1, 3, "user", "> I LOOKED  everywhere\n> Where is the key\nSame here."),
    (1, 4, "user", "> never said by anyone\nnew"),
    (1, 5, "user", "No quote: 3 > 2"),
    (2, 0, "user", "In the drawer."),
    (2, 1, "user", " > > > In the drawer!\nhm"),
    (3, 7, None, None),
    (3, 8, "user", ""),
    (3, 9, "user", ">"),
    (4, 300, "user", "line a"),
    (4, 900, "user", "> line a\nb"),
    (4, 901, "user", "> b\nc"),
    (4, 902, "user", "> c\nd"),
    (4, 903, "user", "> d"),
    (5, 0, "user", "x\n" * 20_000 + "last words"),
    (5, 1, "user", "> last words\n" + "> x\n" * 20_000),
]


def test_replies(spark):
    df = spark.createDataFrame([(*r, "z", 1) for r in TALK], "conv_id long, turn long, role string, text string, h string, rank int")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.linked(df).collect()}
    assert len(got) == len(TALK)
    assert [got[1, t]["reply_to"] for t in range(6)] == [None, 0, 1, 0, None, None]
    assert [got[1, t]["depth"] for t in range(6)] == [0, 1, 2, 1, 0, 0]
    assert [got[1, t]["position"] for t in range(6)] == [0, 1, 2, 3, 4, 5]
    assert got[1, 2]["text"] == "Thanks!" and got[1, 2]["max_level"] == 2 and got[1, 2]["n_linked"] == 2
    assert got[1, 3]["text"] == "Same here." and got[1, 5]["text"] == "No quote: 3 > 2"
    assert got[2, 1]["reply_to"] is None and got[2, 1]["n_linked"] == 1 and got[2, 1]["max_level"] == 3
    assert got[4, 903]["depth"] == 4 and got[4, 903]["thread_root"] == 300
    assert got[5, 1]["reply_to"] == 0


def test_replies_are_those_of_sql(spark):
    rows = [r for r in TALK if r[0] != 5]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    frame = df.toPandas()
    con.register("conversations", frame)
    want = set(con.execute(quotes.SQL).fetchall())
    got = {tuple(r) for r in quotes.linked(df).collect()}
    norm = lambda rows: {tuple("" if x is None else str(int(x)) if isinstance(x, float) else str(x) for x in r) for r in rows}
    assert norm(got) == norm(want)


def test_many_replies_to_one_message(spark):
    df = spark.range(2000).selectExpr("7L AS conv_id", "id AS turn", "'user' AS role", "CASE WHEN id = 0 THEN 'first words' ELSE concat('> first words\n', 'mine ', id) END AS text")
    got = quotes.linked(df)
    assert got.where("turn > 0 AND reply_to = 0 AND depth = 1 AND thread_root = 0").count() == 1999


def test_replies_of_awkward_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotes.linked(empty).count() == 0
    rows = [(None, 0, "user", "a"), (None, 1, "user", "> a"), (1, None, "user", "> b"), (1, 0, "user", "b"), (1, 1, "user", "> b"), (1, 1, "user", "> b"), (1, 1, "user", "other")]
    got = quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    assert all(r["reply_to"] is None for r in got if r["conv_id"] is None or r["turn"] is None)
    assert [r["reply_to"] for r in got if r["turn"] == 1 and r["conv_id"] == 1] == [0, 0, 0]
    assert sorted(r["position"] for r in got if r["conv_id"] == 1) == [0, 1, 2, 3, 4]


def test_one_conversation_with_a_line_that_all_have(spark):
    df = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "CASE WHEN id % 2 = 0 THEN 'me too' ELSE '> me too' END AS text")
    got = quotes.linked(df)
    assert got.where("reply_to = turn - 1 AND turn % 2 = 1").count() == 1500
