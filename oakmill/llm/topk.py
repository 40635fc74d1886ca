"""Exact top-k by inner product, with a table of distances to pivots.

``q . x = (|q|^2 + |x|^2 - d(q, x)^2) / 2``, and for any pivot p the triangle inequality gives
``d(q, x) >= |d(q, p) - d(x, p)|``. The greatest of these bounds over many pivots bounds the score from above.
Distances of all vectors to the pivots are computed once, before vectors and queries meet. Then candidates of
a query are evaluated in the order of their bounds until the k-th best score so far is better than the next
bound: what is left can't enter the result, so it is exact.

Vectors belong to the cell of their nearest pivot, and a cell's vectors are dealt to blocks of bounded size by hash.
First every query is compared with its own block alone: the k-th best score there is one that the result can't fall
below. Then the distances of a cell to the pivots, as ranges, bound the scores of all its vectors at once; a query goes
on only to cells whose bound reaches its score, and takes that score with it. Pairs of blocks that no query asks
for are never made; in the others each query takes at most k rows. A window with a limit on its rank merges those.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oakmill.llm.common import table, written

PIVOTS = 32
VECTOR_BLOCK, QUERY_BLOCK = 8192, 8192
STEP = 64
EXACT = float(1 << 53)


def _farthest_first(vectors: np.ndarray, n: int) -> np.ndarray:
    """Pivots far from each other: each is the vector farthest from those before it."""
    chosen = [0]
    nearest = ((vectors - vectors[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(vectors)):
        k = int(nearest.argmax())
        if nearest[k] == 0:
            break
        chosen.append(k)
        nearest = np.minimum(nearest, ((vectors - vectors[k]) ** 2).sum(1))
    return vectors[chosen]


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(vectors), len(pivots)))
    for k, pivot in enumerate(pivots):
        out[:, k] = np.sqrt(((vectors - pivot) ** 2).sum(1))
    return out


def search_block(queries, query_table, vectors, vector_table, same, k: int, least=None):
    """For each query the k best (score, position of the vector), and how many vectors were evaluated; ``same(q)`` masks
    what is excluded. ``least``: scores that each query has k times already, so nothing below is needed.

    Integer vectors as int64. Products are exact: floats only where all fit 53 bits.
    """
    norms, query_norms = (vectors.astype(float) ** 2).sum(1), (queries.astype(float) ** 2).sum(1)
    fits = max(norms.max(initial=0), query_norms.max(initial=0)) < EXACT
    left = queries.astype(float) if fits else queries
    right = vectors.astype(float) if fits else vectors
    out = []
    for q in range(len(queries)):
        bound = np.abs(vector_table - query_table[q]).max(1) if vector_table.shape[1] else np.zeros(len(vectors))
        slack = 1e-9 * (norms + query_norms[q]) + 1e-6
        upper = (query_norms[q] + norms - bound**2) / 2 + slack
        usable = np.flatnonzero(~same(q))
        upper = upper[usable]
        best_score, best_at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        step, done = STEP, 0
        head = np.zeros(0, np.int64)
        while done < len(usable):
            if done + step > len(head):
                size = min(len(usable), max(4 * (done + step), 256))
                head = np.argpartition(-upper, size - 1)[:size] if size < len(usable) else np.arange(len(usable))
                head = head[np.argsort(-upper[head], kind="stable")]
            bar = -np.inf if least is None else least[q]
            if len(best_score) == k:
                bar = max(bar, best_score[-1])
            if upper[head[done]] < bar:
                break
            part = usable[head[done : done + step]]
            done += len(part)
            score = (right[part] @ left[q]).astype(np.int64)
            best_score, best_at = np.r_[best_score, score], np.r_[best_at, part]
            order = np.lexsort((best_at, -best_score))[:k]
            best_score, best_at = best_score[order], best_at[order]
            step *= 2
        out.append((best_score, best_at, done))
    return out


def cell_bounds(distance: np.ndarray, norm: float, low: np.ndarray, high: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The greatest score that any vector of each cell can have with a query: ``distance`` of the query to the pivots and its
    squared norm; for each cell the least and greatest distance to each pivot and the greatest squared norm."""
    gap = np.maximum(np.maximum(low - distance, distance - high), 0).max(1) if low.shape[1] else np.zeros(len(low))
    return (norm + most - gap**2) / 2 + 1e-9 * (norm + most) + 1e-6


def top_k(vectors: DataFrame, queries, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k greatest inner products of each query with the other vectors.

    Components are turned into ``floor(scale * x)`` first. ``queries`` is a condition on ``vec_id`` that picks
    the query rows. A null vector, an empty one, or one with a null or non-finite component takes no part, nor
    does a row without an id. Vectors of another length than the query's aren't its candidates, nor are rows of
    its own id. Rows equal in id and vector count once; queries that share an id but not the vector are ranked
    each by itself. Ties go to the smaller id. Fewer than k candidates: all of them. Components of up to 2^52
    in all (scaled, summed squares) are multiplied as floats, larger ones as 64-bit integers.
    """
    spark = vectors.sparkSession
    x = F.col("v")
    clean = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
        .select("vec_id", F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"))
        .withColumn("dim", F.size("v"))
        .withColumn("hash", F.xxhash64("vec_id", "v"))
        .withColumn("is_query", queries)
    )
    clean = written(clean, "vectors")
    dims = clean.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim")
    total, main = clean.count(), dims.first()
    # Pivots: far points among a bounded sample of the commonest length; others have no bounds, only more work.
    sample = clean.where(F.col("dim") == (main["dim"] if main else 0)).orderBy("hash", "vec_id").limit(16 * PIVOTS)
    rows = [r["v"] for r in sample.select("v").collect()]
    pivots = _farthest_first(np.array(rows, float), PIVOTS) if rows else np.zeros((0, 0))

    def measure(batches):
        for batch in batches:
            lists = batch.column("v").to_pylist()
            table = _table(lists, pivots)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("vec_id", "dim", "hash", "is_query")]
                + [pa.array([np.array(v, "<i8").tobytes() for v in lists], pa.binary()), pa.array([d.tobytes() for d in table], pa.binary())]
                + [pa.array([int(d.argmin()) if len(d) else 0 for d in table], pa.int32())],
                names=["vec_id", "dim", "hash", "is_query", "v", "d", "cell"],
            )

    measured = clean.mapInArrow(measure, "vec_id long, dim int, hash long, is_query boolean, v binary, d binary, cell int")
    measured = written(measured, "pivot-table")
    # Blocks: so many for each cell (of the commonest length; cells number at most PIVOTS) as its vectors need.
    sizes = {r["cell"]: r["n"] for r in measured.where(F.col("dim") == (main["dim"] if main else 0)).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = F.array(*[F.lit(max(1, -(-sizes.get(c, 0) // VECTOR_BLOCK))) for c in range(max(1, len(pivots)))])
    parts = F.when(F.col("dim") == (main["dim"] if main else 0), F.element_at(blocks, F.col("cell") + 1)).otherwise(max(1, -(-total // VECTOR_BLOCK)))
    measured = measured.withColumn("parts", parts).withColumn("b", F.pmod(F.xxhash64("hash", F.lit(1)), F.col("parts")).cast("int"))
    as_rows = lambda frame, kind, column: np.frombuffer(b"".join(frame[column]), kind).reshape(len(frame), -1)

    def near(block: pd.DataFrame) -> pd.DataFrame:
        """Of each block: the range of distances to the pivots, the greatest norm, and each query's k-th score here."""
        block = block.drop_duplicates(["vec_id", "v"]).sort_values("vec_id", kind="stable")
        vectors, table, ids = as_rows(block, "<i8", "v"), as_rows(block, "<f8", "d"), block["vec_id"].to_numpy()
        at = np.flatnonzero(block["is_query"].fillna(False).to_numpy(bool))
        found = search_block(vectors[at], table[at], vectors, table, lambda q: ids == ids[at[q]], k)
        n, own = len(at), block.iloc[at]
        same = lambda c: [block[c].iloc[0]] * (n + 1)
        head = lambda x: [x, *[None] * n]
        return pd.DataFrame(
            {
                **{c: same(c) for c in ("dim", "cell")},
                **{c: pd.array([None, *own[c]], dtype="Int64") for c in ("vec_id", "hash")},
                **{c: [None, *own[c]] for c in ("v", "d")},
                "least": [None, *(float(f[0][-1]) if len(f[0]) == k else None for f in found)],
                "low": head(table.min(0).tobytes()),
                "high": head(table.max(0).tobytes()),
                "most": head(float((vectors.astype(float) ** 2).sum(1).max())),
                "parts": same("parts"),
            }
        )

    schema = "dim int, cell int, vec_id long, hash long, v binary, d binary, least double, low binary, high binary, most double, parts int"
    started = written(measured.select("vec_id", "hash", "v", "d", "is_query", "dim", "cell", "b", "parts").groupBy("dim", "cell", "b").applyInPandas(near, schema), "started")

    def widest(ranges: pd.DataFrame) -> pd.DataFrame:
        low, high = as_rows(ranges, "<f8", "low").min(0), as_rows(ranges, "<f8", "high").max(0)
        return pd.DataFrame({"low": [low.tobytes()], "high": [high.tobytes()], "most": [ranges["most"].max()], "parts": ranges["parts"].iloc[:1]})

    ranges = started.where("vec_id IS NULL").groupBy("dim", "cell").applyInPandas(
        lambda key, pdf: widest(pdf).assign(dim=key[0], cell=key[1])[["dim", "cell", "low", "high", "most", "parts"]], "dim int, cell int, low binary, high binary, most double, parts int"
    )
    cells = written(ranges.groupBy("dim").agg(F.collect_list(F.struct("cell", "low", "high", "most", "parts")).alias("cells")), "cells")  # at most PIVOTS to a length

    def reach(batches):
        """Each query once for every block of the cells that its score leaves open."""
        through = ("vec_id", "hash", "v", "d", "least", "dim", "qb")
        for batch in batches:
            rows: list[int] = []
            at: list[tuple[int, int]] = []
            for i, (v, d, least, cells) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("v", "d", "least", "cells")))):
                vector = np.frombuffer(v, "<i8").astype(float)
                low, high = (np.array([np.frombuffer(c[x], "<f8") for c in cells]).reshape(len(cells), -1) for x in ("low", "high"))
                bound = cell_bounds(np.frombuffer(d, "<f8"), float(vector @ vector), low, high, np.array([c["most"] for c in cells]))
                open_ = np.flatnonzero(bound >= (-np.inf if least is None else least)).tolist()
                here = [(cells[c]["cell"], part) for c in open_ for part in range(cells[c]["parts"])]
                rows += [i] * len(here)
                at += here
            kept = batch.select(list(through)).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([x[j] for x in at], pa.int32()) for j in (0, 1))], names=[*through, "cell", "b"])

    asking = started.where("vec_id IS NOT NULL").drop("low", "high", "most", "parts", "cell")
    n_queries = asking.groupBy("dim").agg(F.count(F.lit(1)).alias("n_queries"))
    asking = asking.join(cells, "dim").join(n_queries, "dim")
    asking = asking.withColumn("qb", F.pmod(F.xxhash64("hash", F.lit(2)), F.ceil(F.col("n_queries") / QUERY_BLOCK)).cast("int"))
    schema = "vec_id long, hash long, v binary, d binary, least double, dim int, qb int, cell int, b int"
    asked = written(asking.select("vec_id", "hash", "v", "d", "least", "dim", "qb", "cells").mapInArrow(reach, schema), "asked")
    wanted = asked.select("dim", "cell", "b", F.col("qb").alias("by")).distinct()
    data = measured.select("vec_id", "v", "d", "dim", "cell", "b").join(wanted, ["dim", "cell", "b"]).select("vec_id", "v", "d", "dim", "cell", "b", F.col("by").alias("qb"))

    def meet(of_query: pd.DataFrame, of_data: pd.DataFrame) -> pd.DataFrame:
        of_query = of_query.drop_duplicates(["vec_id", "v"])
        of_data = of_data.drop_duplicates(["vec_id", "v"]).sort_values("vec_id", kind="stable")
        if not len(of_query) or not len(of_data):
            return pd.DataFrame({"query_id": [], "hash": [], "vec_id": [], "score": []}).astype("int64")
        ids = of_data["vec_id"].to_numpy()
        own = of_query["vec_id"].to_numpy()
        found = search_block(
            as_rows(of_query, "<i8", "v"), as_rows(of_query, "<f8", "d"), as_rows(of_data, "<i8", "v"), as_rows(of_data, "<f8", "d"),
            lambda q: ids == own[q], k, of_query["least"].fillna(-np.inf).to_numpy(float),
        )
        n = [len(f[0]) for f in found]
        return pd.DataFrame(
            {
                "query_id": np.repeat(own, n),
                "hash": np.repeat(of_query["hash"].to_numpy(), n),
                "vec_id": ids[np.concatenate([f[1] for f in found]).astype(np.int64)],
                "score": np.concatenate([f[0] for f in found]),
            }
        )

    keys = ["dim", "cell", "b", "qb"]
    met = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(meet, "query_id long, hash long, vec_id long, score long")
    best = Window.partitionBy("query_id", "hash").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _table(lists: list, pivots: np.ndarray) -> list[np.ndarray]:
    """Distances to the pivots; none for a vector of another length."""
    fit = [k for k, v in enumerate(lists) if len(v) == pivots.shape[1]]
    out = [np.zeros(0)] * len(lists)
    if fit:
        for k, row in zip(fit, _distances(np.array([lists[k] for k in fit], float), pivots)):
            out[k] = row.astype("<f8")
    return out


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other vectors for each vector whose id is divisible by 50; see ``top_k`` for nulls, ties, repeated
    rows and vectors of other lengths. An empty table gives no rows."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
