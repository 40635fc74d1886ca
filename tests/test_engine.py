"""The engine: catalog rules, staged inference, cache, services, user functions, approximate queries."""

import io
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oakmill import queries
from oakmill.catalog import CatalogError
from oakmill.cli import repl
from oakmill.operators.services import ANY, FrameService, FunctionService, HTTPService, Service, put_in, take_from
from oakmill.operators.vectors import ProxyIndex, VectorStore, farthest_points
from oakmill.plans.directives import QueryError
from oakmill.session import Engine
from oakmill.sources import factory, files
from oakmill.streaming.increments import infer_stream


@pytest.fixture
def video(spark):
    """Frames, objects in them (0 to 3), and a colour for each object: two services in a chain."""
    e = Engine(spark)
    e.register_blob_table("frames", spark.range(100).withColumnRenamed("id", "frame"), ["frame"])
    e.register_output_table("objects", "frame long, object_id int, x double", ["frame", "object_id"], {"frame": "frames.frame"})
    e.register_output_table("colors", "frame long, object_id int, color string", ["frame", "object_id"], {"frame": "objects.frame", "object_id": "objects.object_id"})

    def objects(rows):
        return [pd.DataFrame({"o": range(f % 4), "x": [10.0 * f + k for k in range(f % 4)]}) for f in rows.iloc[:, 0]]

    def colors(rows):
        return pd.DataFrame({"c": np.where((rows.iloc[:, 0] + rows.iloc[:, 1]) % 2 == 0, "red", "blue")})

    e.register_inference_service(FunctionService("detector", objects, preferred_batch_size=7))
    e.bind_inference_service("detector", (["frames.frame"], ["objects.object_id", "objects.x"]), {"frames.frame": "objects.frame"})
    e.register_inference_service(FunctionService("painter", colors))
    e.bind_inference_service("painter", (["objects.frame", "objects.object_id"], ["colors.color"]), {"objects.frame": "colors.frame", "objects.object_id": "colors.object_id"})
    return e


def test_conditions_run_before_services(video):
    video.execute("SELECT * FROM objects WHERE frame < 20").collect()
    assert video.rows_sent == {"detector": 20}
    got = video.execute("SELECT o.frame, c.color FROM objects o JOIN colors c ON o.frame = c.frame AND o.object_id = c.object_id WHERE o.x > 100 AND c.frame < 30 AND c.color = 'red'").collect()
    assert video.rows_sent["detector"] == 30
    assert video.rows_sent["painter"] == sum(f % 4 for f in range(30)) - sum(1 for f in range(30) for k in range(f % 4) if 10 * f + k <= 100)
    assert {(r["frame"], r["color"]) for r in got} == {(f, "red") for f in range(30) for k in range(f % 4) if 10 * f + k > 100 and (f + k) % 2 == 0}


def test_cache(video):
    for most, sent in ((30, 30), (40, 40), (40, 40), (10, 40)):
        video.execute(f"SELECT frame FROM objects WHERE frame < {most}").collect()
        assert video.rows_sent["detector"] == sent


def test_conditions_that_must_not_be_pushed(video):
    n = video.execute("SELECT COUNT(*) AS n FROM frames f CROSS JOIN objects o WHERE f.frame < 2").first()["n"]
    assert n == 2 * sum(f % 4 for f in range(100))
    rows = video.execute("SELECT f.frame FROM frames f LEFT JOIN objects o ON f.frame = o.frame WHERE o.x IS NULL").count()
    assert rows == 25
    assert video.execute("SELECT a.frame FROM objects a JOIN objects b ON a.frame = b.frame WHERE a.x < 15 AND b.object_id = 2").count() == 0
    best = video.execute("SELECT frame, r FROM (SELECT frame, rank() OVER (ORDER BY x DESC) AS r FROM objects) t WHERE frame < 5 AND r = 1").count()
    assert best == 0


def test_empty_inputs(video):
    assert video.execute("SELECT * FROM objects WHERE frame < 0").count() == 0
    assert video.rows_sent["detector"] == 0


def test_lineage(video):
    need = lambda sql: sum(map(len, video.analysis(sql).needed.values()))
    assert need("SELECT * FROM objects") == 3
    assert need("SELECT object_id FROM objects WHERE frame > 100") == 2
    assert need("SELECT a.x FROM objects a JOIN colors b ON a.frame = b.frame WHERE a.object_id IN (SELECT object_id FROM colors)") == 5 - 0
    assert need("SELECT COUNT(*) FROM objects") == 3
    assert video.services_of(video.analysis("SELECT color FROM colors")) == ["detector", "painter"]
    assert video.services_of(video.analysis("SELECT frame FROM frames")) == []


def test_catalog_rules(spark):
    e = Engine(spark)
    with pytest.raises(CatalogError):
        e.execute("SELECT 1 FROM nothing")
    e.register_blob_table("b", spark.createDataFrame([(1, "t")], "id long, text string"), ["id"])
    e.register_output_table("o", "id long, y int, z int", ["id"], {"id": "b.id"})
    s, t = FunctionService("s", len), FunctionService("t", len)
    for service in (s, t):
        e.register_inference_service(service)
    for inputs, outputs in ((["b.id"], ["o.none"]), (["b.none"], ["o.y"]), ([], ["o.y"]), (["b.id"], [])):
        with pytest.raises(CatalogError):
            e.bind_inference_service("s", (inputs, outputs))
        assert not e.catalog.bound
    with pytest.raises(CatalogError):
        e.bind_inference_service("unknown", (["b.id"], ["o.y"]))
    e.bind_inference_service("s", (["b.id"], ["o.y"]), {"b.id": "o.id"})
    with pytest.raises(CatalogError):  # a column has one owner
        e.bind_inference_service("t", (["b.id"], ["o.y"]), {"b.id": "o.id"})
    with pytest.raises(CatalogError):  # round in a circle
        e.bind_inference_service("t", (["o.id", "o.y"], ["o.z"]), {"o.id": "o.id"})
    assert set(e.catalog.bound) == {"s"}
    with pytest.raises(CatalogError):  # no link to the inputs' key
        e.register_output_table("p", "k long, v int", ["k"], {})
        e.bind_inference_service("t", (["b.id"], ["p.v"]), {"b.id": "p.k"})
    with pytest.raises(CatalogError):
        e.create_output_tables({"q": [{"name": "x", "dtype": "decimal"}]})
    with pytest.raises(QueryError):
        e.execute("INSERT INTO b VALUES (1, 'x')")
    with pytest.raises(CatalogError):
        e.frame_of(["b", "p"])


def test_results_for_inputs(video, spark):
    found = video.inference.infer("detector", spark.createDataFrame([(1,), (2,), (3,), (4,)], "frame long"), return_results=True)
    assert found.count() == 1 + 2 + 3
    assert video.inference.infer("detector", spark.createDataFrame([(3,), (5,)], "frame long"), return_results=True).count() == 3 + 1
    assert video.rows_sent["detector"] == 5


def test_bad_answers(spark):
    for answer in (lambda rows: [], lambda rows: pd.DataFrame({"a": [1] * len(rows), "b": 2})):
        e = Engine(spark)
        e.register_blob_table("b", spark.range(3).withColumnRenamed("id", "k"), ["k"])
        e.register_output_table("o", "k long, y int", ["k"], {"k": "b.k"})
        e.register_inference_service(FunctionService("s", answer))
        e.bind_inference_service("s", (["b.k"], ["o.y"]), {"b.k": "o.k"})
        with pytest.raises(Exception):
            e.execute("SELECT y FROM o").collect()
        assert ("s", "seen") not in e.inference.store.runs


# -- services


class Lengths(Service):
    def infer_one(self, row):
        return pd.DataFrame({"n": [len(row.iloc[1])]}) if row.iloc[1] else pd.DataFrame({"n": []})


def test_row_service(spark):
    e = Engine(spark)
    e.register_blob_table("b", spark.createDataFrame([(1, "abc"), (2, "")], "k long, t string"), ["k"])
    e.register_output_table("o", "k long, n int", ["k"], {"k": "b.k"})
    e.register_inference_service(Lengths("s"))
    e.bind_inference_service("s", (["b.k", "b.t"], ["o.n"]), {"b.k": "o.k"})
    assert [tuple(r) for r in e.execute("SELECT k, n FROM o").collect()] == [(1, 3)]
    e.execute("SELECT n FROM o").collect()
    assert e.rows_sent == {"s": 2}


def test_json_paths():
    assert put_in(None, ("a", 1, "b"), [5]) == {"a": [None, {"b": 5}]}
    assert put_in({"m": [{"role": "user"}]}, ("m", 0, "content"), ["hi"]) == {"m": [{"role": "user", "content": "hi"}]}
    assert put_in(None, ("items", ANY, "v"), [1, 2]) == {"items": [{"v": 1}, {"v": 2}]}
    data = {"r": [{"x": 1}, {"x": 2}, {}], "s": "t"}
    assert take_from(data, ("r", ANY, "x")) == [1, 2] and take_from(data, ("s",)) == ["t"] and take_from(data, ("no", 1)) == []


def test_http_service():
    posted = []

    def transport(url, headers, body):
        posted.append((url, headers, body))
        return {"labels": [{"name": "cat", "p": 0.5}, {"name": "dog", "p": 0.25}], "model": "m"}

    s = HTTPService("h", "http://x/y", [("messages", 0, "content")], [("labels", ANY, "name"), ("labels", ANY, "p"), ("model",)], headers={"k": "v"}, defaults=[(("model",), "m")], transport=transport, wrap=("<", ">"), input_types=[str], output_types=[str, float, str])
    (out,) = s.infer_batch(pd.DataFrame({"t": ["hi"]}))
    assert out.values.tolist() == [["cat", 0.5, "m"], ["dog", 0.25, "m"]]
    assert posted == [("http://x/y", {"k": "v"}, {"model": "m", "messages": [{"content": "<hi>"}]})]
    with pytest.raises(TypeError):
        s.infer_batch(pd.DataFrame({"t": [3]}))
    with pytest.raises(ValueError):
        HTTPService("h", "u", [("a", ANY, ANY)], [("b",)])
    b = HTTPService("b", "u", [("xs",)], [("y",)], batch=True, transport=lambda u, h, body: [{"y": x + 1} for x in body["xs"]])
    assert [f.iloc[0, 0] for f in b.infer_batch(pd.DataFrame({"x": [1, 2]}))] == [2, 3]
    pairs = HTTPService("p", "http://x/match__join", [("a",)], [("same",)], batch=True, transport=lambda u, h, body: {"same": [x > 1 for x in body["a"]]})
    assert [bool(f.iloc[0, 0]) for f in pairs.infer_batch(pd.DataFrame({"x": [1, 2]}))] == [False, True]
    short = HTTPService("b", "u", [("xs",)], [("y",)], batch=True, transport=lambda u, h, body: [])
    with pytest.raises(ValueError):
        short.infer_batch(pd.DataFrame({"x": [1]}))


# -- user functions


def test_user_functions(video):
    video.register_user_defined_function("Wide", lambda a: [[int(v), -int(v)] for v in a[0]], "p long, q long")
    video.register_user_defined_function("odd_only", lambda a: [v if v % 2 else None for v in a[0]], "double")
    assert video.execute("SELECT frame, WIDE(frame) AS (a, b) FROM frames WHERE frame = 3 AND b < 0").collect()[0][:] == (3, 3, -3)
    assert video.execute("SELECT odd_only(frame) AS o FROM frames WHERE frame < 10").count() == 5
    assert video.execute("SELECT wide(frame) FROM frames WHERE frame < 3").columns == ["wide__0", "wide__1"]
    for bad in ("SELECT wide(frame) AS (a, b, c) FROM frames", "SELECT frame FROM frames WHERE wide(frame) = 1", "SELECT odd_only(frame) AS (a, b) FROM frames", "SELECT wide(frame) + 1 FROM frames"):
        with pytest.raises(QueryError):
            video.execute(bad)
    video.register_user_defined_function("wrong", lambda a: "text", "int")
    video.register_user_defined_function("short", lambda a: [1], "int")
    for name in ("wrong", "short"):
        with pytest.raises(Exception):
            video.execute(f"SELECT {name}(frame) AS x FROM frames").collect()


def test_functions_over_pairs_are_called_for_different_values(spark):
    """The rows are those of all pairs, repeated rows and nulls too; calls are for combinations of different values."""
    e = Engine(spark)
    e.register_blob_table("left_rows", spark.range(600).selectExpr("id AS l", "CASE WHEN id % 4 > 0 THEN CAST(id % 4 AS INT) END AS x"), ["l"])
    e.register_blob_table("right_rows", spark.range(500).selectExpr("id AS r", "CASE WHEN id % 5 > 0 THEN CAST(id % 5 AS INT) END AS y"), ["r"])
    seen = spark.sparkContext.accumulator(0)

    def near(a):
        seen.add(len(a))
        return (a[0].fillna(0) - a[1].fillna(0)).abs() <= 1

    e.register_user_defined_function("near", near, "boolean")
    df = e.execute("SELECT * FROM left_rows a JOIN right_rows b ON near(a.x, b.y) = TRUE AND a.l < b.r")
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()  # a few combinations, but not one task
    got = df.toPandas()
    assert seen.value <= 20 * 2 and list(got.columns) == ["l", "x", "r", "y"]
    want = {(i, j) for i in range(600) for j in range(i + 1, 500) if abs(i % 4 - j % 5) <= 1}
    assert len(got) == len(want) and set(zip(got.l, got.r)) == want
    assert (got.x.fillna(0) == got.l % 4).all() and (got.y.fillna(0) == got.r % 5).all()


def test_conditions_reach_the_scan(spark, sf):
    e = Engine(spark)
    e.register_blob_table("documents", spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id"])
    e.register_user_defined_function("plus", lambda a: a[0] + 1, "long")
    plan = e.execute("SELECT doc_id FROM documents WHERE plus(n_chars) > 100 AND lang = 'en'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "text" not in plan.split("ReadSchema")[1]


# -- approximate queries


@pytest.fixture(scope="module")
def gaussian(spark):
    rng = np.random.default_rng(3)
    data = spark.createDataFrame(pd.DataFrame({"id": range(20_000), "id2": range(100, 20_100), "g": rng.normal(100, 100, 20_000)})).repartition(4).cache()

    def engine():
        e = Engine(spark)
        e.register_blob_table("blobs", data.select("id", "id2"), ["id", "id2"])
        e.register_output_table("values", "id long, id2 long, g double", ["id", "id2"], {"id": "blobs.id", "id2": "blobs.id2"})
        e.register_inference_service(FrameService("s", data, ["id", "id2"], ["g"]))
        e.bind_inference_service("s", (["blobs.id", "blobs.id2"], ["values.g"]), {"blobs.id": "values.id", "blobs.id2": "values.id2"})
        return e

    truth = data.agg(F.sum("g"), F.avg("g"), F.sum(F.when(F.col("g") > 0, 1))).first()
    return engine, truth


def test_estimates_keep_their_errors(gaussian):
    engine, truth = gaussian
    misses = 0
    for seed in range(8):
        e = engine()
        row = e.execute("SELECT SUM(g) AS s, AVG(g) AS m FROM values ERROR_TARGET 10% CONFIDENCE 95%", seed=seed).first()
        misses += abs(row["s"] - truth[0]) > 0.1 * truth[0] or abs(row["m"] - truth[1]) > 0.1 * truth[1]
        assert not row["exact"] and e.rows_sent["s"] == row["n_sampled"] < 20_000
        assert row["s_lower"] <= row["s"] <= row["s_upper"]
        n = e.execute("SELECT COUNT(*) AS n FROM values WHERE g > 0 ERROR_TARGET 10% CONFIDENCE 95%", seed=seed).first()["n"]
        misses += abs(n - truth[2]) > 0.1 * truth[2]
    assert misses <= 1


def test_estimates_dont_depend_on_partitions(gaussian):
    engine, _ = gaussian
    text = "SELECT SUM(g) AS s FROM values ERROR_TARGET 10% CONFIDENCE 95%"
    a, b = engine(), engine()
    b.catalog.table("blobs").data = b.catalog.table("blobs").data.repartition(13)
    assert abs(a.execute(text).first()["s"] - b.execute(text).first()["s"]) < 1e-3


def test_exact_where_sampling_doesnt_pay(gaussian):
    engine, truth = gaussian
    row = engine().execute("SELECT SUM(g) AS s FROM values ERROR_TARGET 0.1% CONFIDENCE 95%").first()
    assert row["exact"] and abs(row["s"] - truth[0]) < 1e-3
    row = engine().execute("SELECT COUNT(*) AS n FROM values ERROR_TARGET 5% CONFIDENCE 95%").first()
    assert abs(row["n"] - 20_000) < 1e-6  # nothing varies
    with pytest.raises(QueryError):
        engine().execute("SELECT SUM(g) AS s FROM values WHERE g > 1e9 ERROR_TARGET 5% CONFIDENCE 95%")


def test_exact_where_no_service_is_needed(spark):
    """Over stored columns a sample saves no call, however many rows there are."""
    e = Engine(spark)
    e.register_blob_table("blobs", spark.range(5000).selectExpr("id", "CAST(id % 100 AS DOUBLE) AS x"), ["id"])
    row = e.execute("SELECT SUM(x) AS total, AVG(x) AS mean, COUNT(*) AS n FROM blobs WHERE x < 50 ERROR_TARGET 5% CONFIDENCE 95%").first()
    assert row["exact"] and (row["total"], row["mean"], row["n"]) == (61_250, 24.5, 2500) and row["n_sampled"] == row["n_population"] == 2500


def test_join_estimates(spark, sf):
    exact = duckdb.sql(f"SELECT count(*) FROM '{sf}/../sf0.01/customer.parquet', '{sf}/../sf0.01/supplier.parquet' WHERE c_nationkey = s_nationkey").fetchall()[0][0]
    misses = 0
    for seed in range(4):
        e = queries.pairs_engine(spark, f"{sf}/../sf0.01")
        row = e.execute("SELECT COUNT(*) AS n FROM customer c JOIN supplier s ON same(c.c_nationkey, s.s_nationkey) = TRUE ERROR_TARGET 10% CONFIDENCE 95%", seed=seed).first()
        misses += abs(row["n"] - exact) > 0.1 * exact
    assert misses <= 1
    small = queries.pairs_engine(spark, sf)
    row = small.execute("SELECT COUNT(*) AS n FROM customer c CROSS JOIN supplier s WHERE same(c.c_nationkey, s.s_nationkey) = TRUE ERROR_TARGET 10% CONFIDENCE 95%").first()
    assert row["exact"]


def test_recall_and_limit(spark, sf):
    truth = {r["vec_id"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("label = 3").collect()}
    misses = 0
    for seed in range(3):
        e = queries.vectors_engine(spark, sf)
        got = {r["vec_id"] for r in e.execute("SELECT vec_id FROM vec_labels WHERE label = 3 RECALL_TARGET 80% CONFIDENCE 95%", seed=seed).collect()}
        assert got <= truth
        misses += len(got) < 0.8 * len(truth)
    assert misses <= 1
    e = queries.vectors_engine(spark, sf)
    got = [r["vec_id"] for r in e.execute("SELECT vec_id, label FROM vec_labels WHERE label = 3 LIMIT 5").collect()]
    assert len(set(got)) == 5 and set(got) <= truth and e.rows_sent["vec_labeler"] < 500
    assert {r["vec_id"] for r in e.execute("SELECT vec_id FROM vec_labels WHERE label = 3 LIMIT 10000").collect()} == truth
    assert e.execute("SELECT vec_id FROM vec_labels WHERE label = 77 LIMIT 3").count() == 0
    with pytest.raises(QueryError):
        queries.documents_engine(spark, sf).execute("SELECT doc_id FROM doc_labels RECALL_TARGET 90% CONFIDENCE 95%")


# -- vectors


def test_representatives():
    rng = np.random.default_rng(1)
    ids, m = np.arange(100, 400), rng.random((300, 16)).astype(np.float32)
    reps = farthest_points(ids, m, 40, 0.75, 7)
    assert len(reps) == 40 and (np.diff(reps) > 0).all()
    assert set(reps) <= set(farthest_points(ids, m, 60, 0.75, 7, reps))
    assert len(farthest_points(ids[:5], m[:5], 40, 0.75, 7)) == 5


def test_index_refresh_and_propagation(spark):
    rng = np.random.default_rng(1)
    frame = lambda a, b: spark.createDataFrame([(k, rng.random(8).astype(float).tolist()) for k in range(a, b)], "id long, embedding array<float>")
    index = ProxyIndex(frame(0, 200), buckets=20, k=3)
    reps = set(index.representatives().tolist())
    near = {r["id"]: r["nearest"] for r in index.nearest().collect()}
    assert all(near[r][0]["other"] == r and near[r][0]["distance"] < 1e-6 for r in reps)
    scores = spark.createDataFrame([(int(r), float(r % 2)) for r in reps], "id long, score double")
    got = {r["id"]: r["score"] for r in index.propagate(scores).collect()}
    for k, n in near.items():
        d = [np.sqrt(x["distance"]) + 1e-8 for x in n]
        want = sum((sum(d) - x) / (2 * sum(d)) * (y["other"] % 2) for x, y in zip(d, n))
        assert abs(got[k] - (k % 2 if k in reps else want)) < 1e-5
    assert set(r["score"] for r in index.propagate(scores, binary=True).collect()) <= {0.0, 1.0}
    index.refresh(frame(200, 300))
    assert reps <= set(index.representatives().tolist()) and index.nearest().count() == 300
    assert index.nearest_of(frame(300, 310)).count() == 10


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path))
    data = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 2.0], "b"), (3, [3.0, 3.0], "a")], "id long, embedding array<float>, kind string")
    for metric, first in (("l2", 1), ("cosine", 1), ("dot", 3)):
        store.create_index(metric, data, metric)
        assert store.query_by_embedding(metric, [[1.0, 0.1]], 1).first()["id"] == first
    assert store.query_by_embedding("l2", [[1.0, 0.1]], 5, where="kind = 'b'").first()["id"] == 2
    store.save_index("cosine")
    store.insert_data("cosine", data.where("id = 1").withColumn("embedding", F.array(F.lit(9.0), F.lit(9.0)).cast("array<float>")), upsert=True)
    assert store.data["cosine"].count() == 3
    store.load_index("cosine")
    ids = spark.createDataFrame([(1,), (9,)], "id long")
    assert [r["embedding"] for r in store.get_embeddings_by_id("cosine", ids).collect()] == [[1.0, 0.0]]
    assert store.execute("l2", ids, 1).count() == 3
    store.delete_index("cosine")
    with pytest.raises(ValueError):
        store.create_index("l2", data)
    with pytest.raises(ValueError):
        store.create_index("x", data, "hamming")


# -- sources, configuration, prompt, stream


def test_file_blobs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"x")
    (tmp_path / "sub" / "b.jpg").write_bytes(bytes.fromhex("FFD8FFE0") + b"x")
    (tmp_path / "c.png").write_bytes(b"no image")
    (tmp_path / "d.PDF").write_bytes(b"%PDF")
    (tmp_path / "sub" / "e.docx").write_bytes(b"PK")
    images = files.image_blobs(spark, str(tmp_path)).orderBy("blob_id").collect()
    assert [(r["blob_id"], os.path.basename(r["path"])) for r in images] == [(1, "a.png"), (2, "b.jpg")]
    documents = files.document_blobs(spark, str(tmp_path)).collect()
    assert {(os.path.basename(r["path"]), r["doc_type"]) for r in documents} == {("d.PDF", "pdf"), ("e.docx", "docx")}


def test_configuration_and_prompt(spark, tmp_path):
    (tmp_path / "reviews.csv").write_text("review_id,review\n1,good\n2,bad\n3,good good\n")
    (tmp_path / "ids.csv").write_text("vector\n0\n2\n")
    service = FunctionService("mood", lambda rows: pd.DataFrame({"label": np.where(rows.iloc[:, 1].str.contains("good"), "up", "down")}))
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in (1, 2, 3)], "review_id int, embedding array<double>")
    config = {
        "blobs_csv_file": str(tmp_path / "reviews.csv"), "blob_table_name": "reviews", "blobs_keys_columns": ["review_id"],
        "tables": {"sentiment": [{"name": "review_id", "dtype": "int", "is_primary_key": True, "refers_to": ("reviews", "review_id")}, {"name": "label", "dtype": "str"}]},
        "inference_engines": [{"service": service, "input_columns": ["reviews.review_id", "reviews.review"], "output_columns": ["sentiment.label"], "copy_map": {"reviews.review_id": "sentiment.review_id"}}],
        "embeddings": vectors, "index": {"buckets": 2}, "vector_id_csv": str(tmp_path / "ids.csv"),
    }
    engine = factory.from_config(spark, config)
    assert {r["id"] for r in engine.index.mapping.collect()} == {0, 2}
    out = io.StringIO()
    repl(engine, io.StringIO("SELECT label, COUNT(*) AS n\nFROM sentiment GROUP BY label ORDER BY label;\nSELECT nothing FROM nowhere;\nexit\nSELECT 1;\n"), out)
    shown = out.getvalue()
    assert "down 1" in " ".join(shown.split()) and "up 2" in " ".join(shown.split()) and "AnalysisException" in shown
    assert len(engine.execute("SELECT review_id FROM sentiment WHERE label = 'up' LIMIT 1").collect()) == 1


def test_stream_of_blobs(spark, video, tmp_path):
    spark.range(30).withColumnRenamed("id", "frame").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("frame long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        infer_stream(video, "detector", stream, str(tmp_path / "checkpoint")).awaitTermination()
    assert video.rows_sent["detector"] == 30


# -- the registered queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_is_its_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    got, columns = df.collect(), df.columns
    if name not in queries.SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for t in "customer supplier orders lineitem documents labels embeddings events conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    want = found.fetchall()
    assert sorted(columns) == sorted(names)
    show = lambda v: "" if v is None else str(v) if isinstance(v, (bool, str)) else repr(round(float(v), 6))
    rows = lambda data, order: sorted(tuple(show(r[order.index(c)]) for c in sorted(order)) for r in data)
    assert rows(got, columns) == rows(want, names)
