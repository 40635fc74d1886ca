"""Best-fit packing of token pieces into sequences of fixed capacity, planned on a histogram.

Only the length of a piece matters to where it may go, and there are no more lengths than the capacity.
So the driver plans over a histogram with one count for each length: pieces above a third of the capacity
go at most two to a sequence and are matched greedily, the longest with the longest that still fits;
shorter ones, from long to short, go where they leave the smallest gap. All pieces of a length that meet
the same kind of gap are planned at once, as one *run*: the plan has at most some tens of runs for each
length whatever the number of documents (see ``plan``). Pieces are then numbered within their length (per
written part, with offsets from the parts' counts, so a length that half of all pieces have is no hot
group), and number and plan give each its sequence and offset.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oakmill.llm.bpe import Encoder, Vocabulary, text_groups
from oakmill.llm.common import table, tidy, whole_text, written

CAPACITY = 2048
END = 0
GROUP_BYTES = 1_000_000


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, first number, count per sequence, first sequence, offset), sorted by the first two.

    Pieces of a length are numbered from 0; number r of a run is in sequence
    ``first sequence + (r - first number) // count`` at ``offset + (r - first number) % count * length``.
    A group of equal sequences meets a length once at most and sixty-odd different lengths fit one
    sequence, so runs are bounded by the capacity, not by the number of pieces.
    """
    left = {length: n for length, n in histogram.items() if n}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError("a piece is longer than a sequence")
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: groups of sequences (first, how many)
    order: list[int] = []
    sequences = 0

    def put(length: int, n: int, each: int, first: int, offset: int) -> None:
        runs.append((length, used[length], each, first, offset))
        used[length] += n
        left[length] -= n

    def keep(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                insort(order, gap)
            gaps.setdefault(gap, []).append((first, n))

    large = sorted(length for length in left if 3 * length > capacity)
    for length in reversed(large):
        while left[length]:
            k = bisect_left(large, capacity - length + 1) - 1
            while k >= 0 and left[large[k]] < (2 if large[k] == length else 1):
                k -= 1
            if k < 0:
                n = left[length]
                put(length, n, 1, sequences, 0)
                keep(capacity - length, sequences, n)
            elif (other := large[k]) == length:
                n = left[length] // 2
                put(length, 2 * n, 2, sequences, 0)
                keep(capacity - 2 * length, sequences, n)
            else:
                n = min(left[length], left[other])
                put(length, n, 1, sequences, 0)
                put(other, n, 1, sequences, length)
                keep(capacity - length - other, sequences, n)
            sequences += n
    for length in sorted((x for x in left if left[x]), reverse=True):
        while left[length]:
            at = bisect_left(order, length)
            if at == len(order):
                gap, n = capacity, -(-left[length] // (capacity // length))
                first = sequences
                sequences += n
            else:
                gap = order[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            each = gap // length
            full = min(n, left[length] // each)
            if full:
                put(length, full * each, each, first, capacity - gap)
                keep(gap - each * length, first, full)
            if full < n:
                rest = left[length]
                if rest:
                    put(length, rest, rest, first + full, capacity - gap)
                    keep(gap - rest * length, first + full, 1)
                keep(gap, first + full + bool(rest), n - full - bool(rest))
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pieces(
    docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, with_ids: bool = False, chunks: int | None = None
) -> DataFrame:
    """The pieces of each document: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    A document is the ids of its whole text (null: the empty text) and the end id. Only one longer than
    the capacity is cut: its first piece has what is left over by full pieces. ``chunks`` bounds the encoder's
    table and the texts encoded at once: fewer take less memory of a worker and more time, ids are the same.
    """

    def run(batches):
        coder = Encoder(Vocabulary.listed(vocabulary), pattern, chunks)
        most = GROUP_BYTES if chunks is None else min(GROUP_BYTES, 10 * chunks)
        for batch in batches:
            for a, b, texts in text_groups(batch.column(1), most):
                ids, counts = coder.encode(texts)
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, END).astype("<u4")
                counts = counts + 1
                starts = np.cumsum(counts) - counts
                n = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                short = counts - (n - 1) * capacity
                start = np.where(piece > 0, short[doc] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, short[doc])
                raw, at = memoryview(ids.tobytes()), starts[doc] + start
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at.tolist(), (at + length).tolist())]
                columns = {
                    "doc_id": batch.column(0).slice(a, b - a).take(pa.array(doc)),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
                if with_ids:
                    edges = pa.array(np.r_[at, at[-1:] + length[-1:]].astype(np.int32))
                    columns["ids"] = pa.ListArray.from_arrays(edges, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(tidy(run), schema)


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (any rows with a ``length``) with ``sequence_id`` and ``offset``.

    Rows of equal length are interchangeable, repeated ones too; each row gets a place of its own.
    An empty table gives an empty result.
    """
    spark = parts.sparkSession
    held = written(parts.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    held = held.withColumn("_part", F.shiftright("_row", 33))
    by_part = held.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    totals = by_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()  # one row a length at most
    runs = spark.sparkContext.broadcast(plan({r["length"]: r["n"] for r in totals}, capacity))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_part").orderBy("_row")
    numbered = held.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, ["length", "_part"])
    numbered = numbered.select(*parts.columns, (F.col("_rank") + F.col("_before")).alias("_rank"))

    columns = parts.columns

    def place(batches):
        table_ = runs.value
        keys = (table_[:, 0] << 44) | table_[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            run = table_[np.searchsorted(keys, (length << 44) | rank, side="right") - 1] if len(rank) else table_[:0]
            nth, each = rank - run[:, 1], np.maximum(run[:, 2], 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns]
                + [pa.array(run[:, 3] + nth // each, pa.int64()), pa.array(run[:, 4] + nth % each * length, pa.int64())],
                names=[*columns, "sequence_id", "offset"],
            )

    schema = T.StructType([*parts.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInArrow(tidy(place), schema)


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, chunks: int | None = None) -> DataFrame:
    """Each piece of each document with its sequence and offset there. ``chunks``: as for ``pieces``."""
    return packed(pieces(docs, vocabulary, pattern, capacity, chunks=chunks), capacity)


def sequences(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves: ``sequence_id, ids``. A group is one sequence: at most ``capacity`` ids."""
    placed = packed(pieces(docs, vocabulary, pattern, capacity, with_ids=True), capacity)
    in_order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(in_order, lambda x: x["ids"])).alias("ids"))


def public_pack(docs: DataFrame, chunks: int | None = None) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, chunks=chunks)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return public_pack(table(spark, sf_dir, "documents"))
