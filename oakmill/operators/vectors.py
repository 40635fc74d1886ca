"""Vector stores, representatives of an embedding table, and scores propagated from them.

Distances to representatives are computed by numpy between blocks of bounded size. Chosen representatives number some
thousands at most (``buckets``, a parameter); given ones may be any share of the vectors and stay distributed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oakmill.operators.inference import delete_folder, folder_exists
from oakmill.operators.rows import indexed

METRICS = ("l2", "cosine", "dot")
CHUNK = 1000  # of the vectors farthest from representatives, so many go to the driver at once
BLOCK = 4096
BROADCAST_ROWS = 1_000_000
DEALT, CELLS = 16_384, 2_000_000  # vectors of a block, distances computed at once
SAMPLE, MOST_CELLS, ROUNDS = 20_000, 4096, 10


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, known to have that many rows, for a join: broadcast as long as it is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0), np.float32)


def scores(metric: str, vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distances (less is nearer): squared Euclidean, one minus the cosine, or minus the inner product."""
    if metric == "cosine":
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
        return 1 - unit(vectors) @ unit(others).T
    dots = vectors @ others.T
    if metric == "dot":
        return -dots
    return np.maximum((vectors**2).sum(1)[:, None] - 2 * dots + (others**2).sum(1)[None], 0)


def nearest(vectors: DataFrame, others: DataFrame, n: int, k: int, metric: str = "l2") -> DataFrame:
    """``id, nearest`` (array of (distance, other), near to far, ties by id) of each row of ``vectors`` (id, embedding)
    among ``others`` (id, embedding), of which there are about ``n``, however many.

    Both are dealt to blocks of about ``DEALT`` rows; each pair of blocks is one group, which goes through its distances a
    few rows at a time and gives k for each of its vectors.
    """
    row = lambda df: df.select(F.col("id").cast("long"), F.col("embedding").cast("array<float>"))
    deal = lambda parts: F.pmod(F.xxhash64("id", F.lit(2)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    blocks, parts = max(1, -(-vectors.count() // DEALT)), max(1, -(-n // DEALT))
    asked = row(vectors).select("id", "embedding", deal(blocks).alias("b"), every(parts).alias("p"))
    held = row(others).select("id", "embedding", every(blocks).alias("b"), deal(parts).alias("p"))

    def meet(x: pa.Table, o: pa.Table) -> pa.Table:
        o = o.sort_by("id")
        ids, own, m, out = o.column("id").to_numpy(), x.column("id"), _matrix(x.column("embedding")).astype(np.float64), []
        columns = _columns(_matrix(o.column("embedding")))
        rows = max(1, CELLS // max(1, len(ids)))
        for a in range(0, len(m) if len(ids) else 0, rows):
            out += _nearest_rows(m[a : a + rows], ids, columns, k, metric)
        found = pa.array(out, pa.list_(pa.struct([("distance", pa.float64()), ("other", pa.int64())])))
        return pa.table({"id": own if out else pa.array([], pa.int64()), "nearest": found})

    kind = "id long, nearest array<struct<distance: double, other: long>>"
    met = asked.groupBy("b", "p").cogroup(held.groupBy("b", "p")).applyInArrow(meet, kind)
    return met.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("nearest"))), 1, k).alias("nearest"))


def _nearest_rows(m: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int, metric: str) -> list[list[dict]]:
    """The k nearest of some vectors, ties by id. Squared distances by products tell who may be among them; those are
    computed dimension by dimension, so that equal vectors have equal distances."""
    d = scores(metric, m, columns.T)
    k = min(k, len(ids))
    last = np.partition(d, k - 1, axis=1)[:, k - 1] if k < len(ids) else np.full(len(m), np.inf)
    if metric == "l2":
        last = last + 1e-12 * ((m**2).sum(1) + (columns**2).sum(0).max())
    out = []
    for v, row, most in zip(m, d, last):
        at = np.flatnonzero(row <= most)
        exact = euclidean(columns[:, at], v) ** 2 if metric == "l2" else row[at]
        best = np.lexsort((ids[at], exact))[:k]
        out.append([{"distance": float(exact[j]), "other": int(ids[at[j]])} for j in best])
    return out


def k_means(sample: np.ndarray, cells: int, metric: str, seed: int = 1234) -> np.ndarray:
    """Centres of cells, by Lloyd's rounds over a bounded sample."""
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = sample[rng.choice(len(sample), size=min(cells, len(sample)), replace=False)].astype(np.float64)
    for _ in range(ROUNDS):
        own = scores(metric, sample.astype(np.float64), centres).argmin(1)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, sample)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, metric: str, k: int = 10, recall: float = 0.95, queries: int = 200) -> int:
    """How many cells have to be searched to find this share of the nearest, measured by brute force on the sample."""
    own = scores(metric, sample.astype(np.float64), centres).argmin(1)
    asked = sample[: min(queries, len(sample))].astype(np.float64)
    rank = scores(metric, asked, centres).argsort(1, kind="stable").argsort(1)
    d = scores(metric, asked, sample.astype(np.float64))
    d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = d.argsort(1, kind="stable")[:, : min(k, len(sample) - 1)]
    ranks = np.take_along_axis(rank, own[near], 1)
    return int(np.quantile(ranks, recall)) + 1 if ranks.size else 1


@dataclass
class Cells:
    """An inverted file: the centres of cells, and to how many of the nearest cells a query goes."""

    centres: np.ndarray
    probes: int


class VectorStore:
    """Named indexes of vectors (id, embedding, further columns). Flat ones are searched exactly; an inverted file ("ivf")
    has its cells fitted on at most ``SAMPLE`` vectors, holds every vector, and searches the ``probes`` cells nearest to
    a query: all of them give exact results; by default so many that 0.95 of the nearest are found on the sample."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder
        self.data: dict[str, DataFrame] = {}
        self.metric: dict[str, str] = {}
        self.cells: dict[str, Cells] = {}

    def create_index(self, name: str, vectors: DataFrame | None = None, metric: str = "l2", replace: bool = False, kind: str = "flat", cells: int | None = None, probes: int | None = None) -> None:
        if metric not in METRICS:
            raise ValueError(f"no metric {metric!r}")
        if name in self.metric and not replace:
            raise ValueError(f"index {name} exists")
        if kind not in ("flat", "ivf"):
            raise ValueError(f"no kind of index {kind!r}")
        self.cells.pop(name, None)
        if kind == "ivf":
            if vectors is None:
                raise ValueError("an inverted file is fitted on vectors")
            n = vectors.count()
            sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()
            matrix = _matrix(sample.column(0))
            centres = k_means(matrix, cells or max(1, min(MOST_CELLS, int(n**0.5))), metric)
            self.cells[name] = Cells(centres, probes or probes_for(matrix, centres, metric))
        self.metric[name] = metric
        self.data[name] = vectors if vectors is not None else self.spark.createDataFrame([], "id long, embedding array<float>")

    def delete_index(self, name: str) -> None:
        del self.metric[name], self.data[name]
        self.cells.pop(name, None)
        if self.folder:
            delete_folder(self.spark, f"{self.folder}/{name}")

    def save_index(self, name: str) -> str:
        path = f"{self.folder}/{name}/{self.metric[name]}"
        self.data[name].write.mode("errorifexists").parquet(path)
        if name in self.cells:
            own = self.cells[name]
            rows = pd.DataFrame({"cell": range(len(own.centres)), "probes": own.probes, "centre": own.centres.tolist()})
            self.spark.createDataFrame(rows).write.parquet(f"{self.folder}/{name}/cells")
        return path

    def load_index(self, name: str) -> None:
        (metric,) = [m for m in METRICS if folder_exists(self.spark, f"{self.folder}/{name}/{m}")]
        self.create_index(name, self.spark.read.parquet(f"{self.folder}/{name}/{metric}"), metric, replace=True)
        if folder_exists(self.spark, f"{self.folder}/{name}/cells"):
            rows = self.spark.read.parquet(f"{self.folder}/{name}/cells").orderBy("cell").toPandas()
            self.cells[name] = Cells(np.array(rows["centre"].tolist()), int(rows["probes"].iloc[0]))

    def insert_data(self, name: str, vectors: DataFrame, upsert: bool = False) -> None:
        old = self.data[name]
        if upsert:
            old = old.join(vectors.select("id"), "id", "left_anti")
        self.data[name] = old.unionByName(vectors, allowMissingColumns=True)

    def get_embeddings_by_id(self, name: str, ids: DataFrame) -> DataFrame:
        return self.data[name].join(ids.select("id").distinct(), "id", "left_semi").select("id", "embedding")

    def query_by_embedding(self, name: str, query: list[list[float]], k: int = 5, where: str | None = None) -> DataFrame:
        """``query, rank, id, distance`` for given vectors; ``where`` filters rows first."""
        rows = self.data[name].where(where) if where else self.data[name]
        matrix, metric = np.array(query, np.float32), self.metric[name]

        def best(batches):
            held = [(np.zeros(0), np.zeros(0, np.int64)) for _ in matrix]
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, d = batch.column(0).to_numpy(), scores(metric, matrix, _matrix(batch.column(1)))
                for q in range(len(matrix)):
                    ds, own = np.r_[held[q][0], d[q]], np.r_[held[q][1], ids]
                    at = np.lexsort((own, ds))[:k]
                    held[q] = ds[at], own[at]
            n = [len(h[0]) for h in held]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(n)), n)), pa.array(np.concatenate([h[1] for h in held])), pa.array(np.concatenate([h[0] for h in held]).astype(float))],
                names=["query", "id", "distance"],
            )

        found = rows.select(F.col("id").cast("long"), "embedding").mapInArrow(best, "query long, id long, distance double")
        w = Window.partitionBy("query").orderBy("distance", "id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "id", "distance")

    def search(self, name: str, queries: DataFrame, k: int = 5, where: str | None = None) -> DataFrame:
        """``query, rank, id, distance`` for many vectors (``id, embedding``), however many: vectors and queries are dealt
        to blocks, and each pair of blocks is one group of bounded size that gives k rows for each of its queries."""
        rows = (self.data[name].where(where) if where else self.data[name]).select(F.col("id").cast("long"), "embedding")
        queries, metric = queries.select(F.col("id").cast("long"), "embedding"), self.metric[name]
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        if name in self.cells:
            own = self.cells[name]
            data, asked = _celled(rows, own.centres, 1, metric), _celled(queries, own.centres, own.probes, metric)
        else:
            data, asked = rows.withColumn("cell", F.lit(0)), queries.withColumn("cell", F.lit(0))
        # Blocks of each cell (a bounded number of cells): so many that none of its groups gets large.
        held = [{r["cell"]: r["n"] for r in df.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()} for df in (data, asked)]
        cells = len(self.cells[name].centres) if name in self.cells else 1
        parts = [F.element_at(F.array(*[F.lit(max(1, -(-n.get(c, 0) // BLOCK))) for c in range(cells)]), F.col("cell") + 1) for n in held]
        deal = lambda n: F.pmod(F.xxhash64("id", F.lit(1)), n).cast("int")
        data = data.select("id", "embedding", "cell", deal(parts[0]).alias("b"), every(parts[1]).alias("qb"))
        asked = asked.select("id", "embedding", "cell", deal(parts[1]).alias("qb"), every(parts[0]).alias("b"))

        def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(x):
                return pd.DataFrame({"query": [], "id": [], "distance": []}).astype({"query": "int64", "id": "int64", "distance": "float64"})
            x = x.sort_values("id", kind="stable")
            stack = lambda f: np.stack([np.asarray(v, np.float32) for v in f["embedding"]])
            d = scores(metric, stack(q), stack(x))
            at = np.argsort(d, axis=1, kind="stable")[:, :k]
            n = at.shape[1]
            return pd.DataFrame({"query": np.repeat(q["id"].to_numpy(), n), "id": x["id"].to_numpy()[at.ravel()], "distance": np.take_along_axis(d, at, 1).ravel().astype(float)})

        met = asked.groupBy("cell", "b", "qb").cogroup(data.groupBy("cell", "b", "qb")).applyInPandas(meet, "query long, id long, distance double")
        w = Window.partitionBy("query").orderBy("distance", "id")
        return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "id", "distance")

    def execute(self, name: str, representatives: DataFrame, k: int = 5) -> DataFrame:
        """The k nearest of some vectors of the index (``id``) for all of it."""
        reps = self.get_embeddings_by_id(name, representatives)
        return nearest(self.data[name], reps, reps.count(), k, self.metric[name])


def _celled(vectors: DataFrame, centres: np.ndarray, k: int, metric: str) -> DataFrame:
    """``id, embedding, cell``: each vector once for each of its ``k`` nearest cells."""

    def run(batches):
        for batch in batches:
            m = _matrix(batch.column(1))
            if len(m):
                d = scores(metric, m.astype(np.float64), centres)
                at = np.argsort(d, axis=1, kind="stable")[:, :k]
                kept = batch.take(pa.array(np.repeat(np.arange(len(m)), at.shape[1])))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(at.ravel().astype(np.int32))], names=["id", "embedding", "cell"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("id", "embedding").mapInArrow(run, f"id long, embedding {kind}, cell int")


def euclidean(columns: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Distances of vectors (a column each) to one, summed up dimension by dimension: equal vectors have equal ones."""
    total = np.zeros(columns.shape[1])
    for x, c in zip(columns, centre):
        total += (x - c) ** 2
    return np.sqrt(total)


def _least(columns: np.ndarray, centres: np.ndarray) -> np.ndarray:
    least = np.full(columns.shape[1], np.inf)
    for c in centres:
        np.minimum(least, euclidean(columns, c), out=least)
    return least


def _columns(matrix: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(matrix.T, np.float64)


def _random_places(n: int, buckets: int, share: float, seed: int, chosen: int) -> np.ndarray:
    """Places, in the order of ids, of the vectors that represent at random."""
    some = max(0 if chosen else 1, int((1 - share) * buckets))
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.choice(n, size=min(n, buckets, some), replace=False) if n else np.zeros(0, np.int64)


def farthest_points(ids: np.ndarray, matrix: np.ndarray, buckets: int, share: float, seed: int, old: np.ndarray | None = None) -> np.ndarray:
    """Ids of representatives: some at random, then again and again the vector farthest from all so far (the least
    Euclidean distance to them is greatest; ties: first). Earlier ones stay. Sorted, each once."""
    n, columns = min(buckets, len(ids)), _columns(matrix)
    chosen = [int(i) for i in np.flatnonzero(np.isin(ids, old))] if old is not None else []
    start = _random_places(len(ids), buckets, share, seed, len(chosen))
    chosen += [int(i) for i in start if int(i) not in set(chosen)]
    least = _least(columns, columns[:, chosen].T)
    target = max(n, len(chosen))
    while len(chosen) < target:
        i = int(least.argmax())
        if least[i] <= 0:
            break
        chosen.append(i)
        least = np.minimum(least, euclidean(columns, columns[:, i]))
    return np.sort(ids[chosen])


def farthest(vectors: DataFrame, centres: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and distances of the ``n`` rows of ``vectors`` (id, embedding) farthest from all centres, ties by id."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.append_column("least", pa.array(_least(_columns(_matrix(batch.column(1))), centres)))
            held = pa.table(batch) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            at = np.lexsort((held.column("id").to_numpy(), -held.column("least").to_numpy()))[:n]
            held = held.take(pa.array(at)).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    far = vectors.mapInArrow(run, "id long, embedding array<float>, least double")
    found = far.orderBy(F.desc("least"), "id").limit(n).toArrow()
    return found.column("id").to_numpy(), _matrix(found.column("embedding")), found.column("least").to_numpy()


@dataclass
class ProxyIndex:
    """Representatives of an embedding table and every vector's nearest ones.

    They are chosen as ``farthest_points`` does from all vectors at once, at every size: the driver gets the ``CHUNK``
    farthest ones and chooses among them as long as none of the others can be farther (their distances only fall), then
    asks again. Tasks go through their vectors batch by batch.
    """

    vectors: DataFrame  # id, embedding
    buckets: int = 1000
    share: float = 0.75
    seed: int = 1234
    k: int = 5
    first: tuple[int, ...] = ()  # ids that represent in any case, before others are chosen
    _reps: DataFrame | None = None
    _count: int = 0
    _nearest: DataFrame | None = None

    def representatives(self) -> np.ndarray:
        return np.sort(self.held()[0].select("id").toArrow().column(0).to_numpy())

    def held(self) -> tuple[DataFrame, int]:
        """``id, embedding`` of the representatives, and how many there are."""
        if self._reps is None:
            self._choose(np.array(self.first, np.int64) if self.first else None)
        return self._reps, self._count

    def _choose(self, old: np.ndarray | None) -> None:
        rows = self.vectors.select(F.col("id").cast("long"), F.col("embedding").cast("array<float>")).persist()
        n = rows.count()
        ids, matrix = self._of(rows, np.unique(old)) if old is not None else (np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
        places = _random_places(n, self.buckets, self.share, self.seed, len(ids))
        if len(places):
            more, drawn = self._of(rows, np.setdiff1d(self._at(rows, places), ids))
            ids, matrix = np.r_[ids, more], np.concatenate([matrix, drawn]) if len(ids) else drawn
        target, over = max(min(self.buckets, n), len(ids)), False
        while len(ids) < target and not over:
            near, vectors, least = farthest(rows, matrix.astype(np.float64), CHUNK)
            bound = (-least[-1], near[-1]) if len(near) == CHUNK else (0.0, 0)  # what isn't here comes after this
            order = np.argsort(near, kind="stable")
            near, vectors, least = near[order], vectors[order], least[order]
            columns, chosen = _columns(vectors), []
            while len(ids) + len(chosen) < target:
                i = int(least.argmax())
                over = least[i] <= 0
                if over or (-least[i], near[i]) > bound:
                    break
                chosen.append(i)
                least = np.minimum(least, euclidean(columns, columns[:, i]))
            over = over and bound[0] >= 0
            ids, matrix = np.r_[ids, near[chosen]], np.concatenate([matrix, vectors[chosen]])
        rows.unpersist()
        self._hold(self.vectors.sparkSession.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "embedding": pa.array(list(matrix), pa.list_(pa.float32()))})))

    def _of(self, rows: DataFrame, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and vectors of some rows."""
        wanted = rows.sparkSession.createDataFrame(pd.DataFrame({"id": ids.astype(np.int64)}))
        data = rows.join(bounded(wanted, len(ids)), "id", "left_semi").toArrow()
        return data.column(0).to_numpy(), _matrix(data.column(1))

    def _at(self, rows: DataFrame, places: np.ndarray) -> np.ndarray:
        """Ids at some places in the order of ids."""
        spark = rows.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = rows.select("id").repartitionByRange(parts, "id").sortWithinPartitions("id").persist()
        wanted = spark.createDataFrame(pd.DataFrame({"place": places.astype(np.int64)}))
        found = indexed(ordered, "place").join(bounded(wanted, len(places)), "place", "left_semi").select("id").toArrow().column(0).to_numpy()
        ordered.unpersist()
        return found

    def _hold(self, reps: DataFrame) -> None:
        reps = reps.persist()
        self._count = reps.count()
        if self._reps is not None:
            self._reps.unpersist()
        self._reps = reps
        self._forget()

    def _forget(self) -> None:
        if self._nearest is not None:
            self._nearest.unpersist()
        self._nearest = None

    def set_representatives(self, ids: list[int] | DataFrame) -> None:
        """These vectors (ids, or a DataFrame with a column ``id``) represent all others from here on."""
        wanted = ids.select("id") if isinstance(ids, DataFrame) else self.vectors.sparkSession.createDataFrame(pd.DataFrame({"id": np.array(ids, np.int64)}))
        own = self.vectors.select(F.col("id").cast("long"), F.col("embedding").cast("array<float>"))
        self._hold(own.join(wanted.distinct(), "id", "left_semi"))

    def nearest(self) -> DataFrame:
        if self._nearest is None:
            self._nearest = nearest(self.vectors, *self.held(), self.k).persist()
        return self._nearest

    def nearest_of(self, new: DataFrame) -> DataFrame:
        """Nearest representatives of vectors that came later; the representatives stay."""
        return nearest(new, *self.held(), self.k)

    def refresh(self, new: DataFrame) -> None:
        """Adds vectors and chooses again; representatives so far stay."""
        old = self.representatives()
        self.vectors = self.vectors.unionByName(new.select(*self.vectors.columns))
        self._choose(old)

    def propagate(self, rep_scores: DataFrame, binary: bool = False) -> DataFrame:
        """``id, score`` of every vector from ``id, score`` of representatives (none: 0).

        The nearest representatives are weighed by distance: weight (D - d) over the sum of those, D being the sum of
        their distances d. Binary: inverse distances vote for score or no score. A representative has its own.
        """
        own = rep_scores.select(F.col("id").alias("other"), F.col("score").cast("double").alias("own"))
        near = self.nearest().select("id", F.explode("nearest").alias("n")).select("id", "n.other", (F.sqrt("n.distance") + 1e-8).alias("d"))
        joined = near.join(bounded(own, self.held()[1]), "other", "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
        sums = joined.groupBy("id").agg(
            F.sum("d").alias("D"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("own") * F.col("d")).alias("sd"),
            F.sum("own").alias("s"),
            F.sum(F.when(F.col("own") != 0, 1 / F.col("d")).otherwise(0.0)).alias("yes"),
            F.sum(F.when(F.col("own") == 0, 1 / F.col("d")).otherwise(0.0)).alias("no"),
            F.max(F.when(F.col("other") == F.col("id"), F.col("own"))).alias("itself"),
        )
        if binary:
            score = F.when(F.col("itself").isNotNull(), (F.col("itself") != 0).cast("double")).otherwise((F.col("yes") > F.col("no")).cast("double"))
        else:
            # sum s (D - d) / sum (D - d); the divisor is (n - 1) D
            spread = F.when(F.col("n") > 1, (F.col("D") * F.col("s") - F.col("sd")) / ((F.col("n") - 1) * F.col("D"))).otherwise(F.col("s"))
            score = F.coalesce("itself", spread)
        return sums.select("id", score.alias("score"))
