"""Near duplicates: consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

1. Document frequencies, exact for each shingle (five words, lower case). Texts are written in chunks; the
   different shingles of a chunk go, sorted and packed, to slices of the range of hashes, which add up the
   chunks' counts and send each chunk the sums in the order of its shingles. A shingle's weight is its count in
   the text times ``1 + log(T / df) / log(T)``, T being the sum of all frequencies: from 2 for a shingle found
   nowhere else to 1 for one found everywhere, so common passages weigh less but a copy stays a copy however
   many there are of it.
2. Signatures. Improved consistent weighted sampling draws ``ROWS * BANDS`` samples of each text; a sample
   of two texts is equal with the probability of their weighted Jaccard similarity. Texts of equal words
   are one class from here on, represented by the least id.
3. Buckets. Equal bands put classes into a bucket. Pairs are not emitted all with all: in each round some
   members of each bucket become hubs (one, then eight times more each round), every member of another
   component is paired with the hubs, and a hub that has met all others leaves its bucket. Buckets whose
   members are all of one component are done, so a family of copies ends after a round or two, and no pair
   that could join two components is left out.
4. Verification. Pairs go whose total weights rule the threshold out, or bitmaps of their shingles, by a bound that
   holds always; for all others the weighted Jaccard similarity is computed from the whole texts. Links are merged
   by ``components``.

No key is hot: buckets, hubs, roots and classes that hold more than a thousandth of the rows are salted or broadcast
(fewer than a thousand of them; 16,000 buckets), see ``join_groups`` and ``join_split``.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oakmill.llm.bpe import groups_of
from oakmill.llm.common import discard, join_groups, join_split, partitions, release, table, tidy, whole_text, written
from oakmill.llm.components import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
CHUNK_CHARS, SLICE_CHARS = 2_000_000, 12_000_000
ID_BITS = 22
_U = np.uint64


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """All texts' different shingles, hashed, in a row (sorted within a text), their counts, each text's start (with one
    more at the end), and the words of each, parted by a blank. A text without words has no shingle; one of fewer
    words than a shingle has one of them all. No table of words is kept, whatever the texts hold."""
    words = [" ".join(t.lower().split()).encode("utf-8", "replace") for t in texts]
    split = [w.split(b" ") if w else [] for w in words]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    total = int(sizes.sum())
    found = np.fromiter(chain.from_iterable(map(xxhash.xxh64_intdigest, own) for own in split), _U, total)
    begins = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        rolled = np.zeros(total, _U)
        for step in range(WORDS):
            part = found[step:]
            rolled[: len(part)] = rolled[: len(part)] * _U(0x9E3779B97F4A7C15) + part
        for k in np.flatnonzero((sizes > 0) & (sizes < WORDS)).tolist():
            h = int(sizes[k])
            for w in found[begins[k] : begins[k] + sizes[k]].tolist():
                h = (h * 0x9E3779B97F4A7C15 + w) & 0xFFFFFFFFFFFFFFFF
            rolled[begins[k]] = h
        rolled ^= rolled >> _U(31)
        rolled *= _U(0xBF58476D1CE4E5B9)
        rolled ^= rolled >> _U(29)
    n = np.where(sizes >= WORDS, sizes - WORDS + 1, np.minimum(sizes, 1))
    starts = np.r_[0, np.cumsum(n)]
    keep = np.repeat(begins - starts[:-1], n) + np.arange(starts[-1])
    hashes = rolled[keep]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[starts[:-1][n > 0]] = True
    first = np.flatnonzero(new)
    counts = np.diff(np.r_[first, len(hashes)])
    return hashes[first], counts, np.searchsorted(first, starts), words


def _numbers(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the greatest needs, compressed; the first byte tells how many."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w))
    return bytes([width]) + zlib.compress(x.astype(f"<u{width}").tobytes(), 1)


def _counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


def _squeezed(parts: list[bytes]) -> tuple[bytes, bytes]:
    """Lengths, and all parts compressed together."""
    return np.array([len(x) for x in parts], "<i8").tobytes(), pa.compress(b"".join(parts), "zstd", asbytes=True)


def _texts(lengths: bytes, data: bytes) -> list[str]:
    ends = np.cumsum(np.frombuffer(lengths, "<i8")).tolist()
    whole = pa.decompress(data, ends[-1], "zstd", asbytes=True)
    return [whole[a:b].decode() for a, b in zip([0, *ends], ends)]


def _packed(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted hashes as differences: six low bytes of each, and the two high ones (mostly 0) compressed."""
    steps = np.diff(hashes, prepend=_U(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return steps[:, :6].tobytes(), zlib.compress(steps[:, 6:].tobytes(), 1)


def _unpacked(low: bytes, high: bytes) -> np.ndarray:
    steps = np.empty((len(low) // 6, 8), np.uint8)
    steps[:, :6] = np.frombuffer(low, np.uint8).reshape(-1, 6)
    steps[:, 6:] = np.frombuffer(zlib.decompress(high), np.uint8).reshape(-1, 2)
    return np.cumsum(steps.view("<u8").reshape(-1), dtype=_U)


def chunks(texts: DataFrame) -> DataFrame:
    """``chunk, chars, ids, fps, sizes, texts``: rows of ``texts`` (``doc_id, fp, text``) in groups, each one row with its
    texts compressed, so that no reader gets a part of a group."""

    def run(batches):
        chunk = (TaskContext.get().partitionId() << 32) - 1
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in groups_of(texts, CHUNK_CHARS):
                chunk += 1
                lists = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(c).slice(a, b - a)) for c in (0, 1)]
                sizes, data = _squeezed([t.encode() for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.array([sum(map(len, texts[a:b]))], pa.int64()), *lists, pa.array([sizes], pa.binary()), pa.array([data], pa.binary())],
                    names=["chunk", "chars", "ids", "fps", "sizes", "texts"],
                )

    schema = "chunk long, chars long, ids array<long>, fps array<long>, sizes binary, texts binary"
    return texts.select("doc_id", "fp", "text").mapInArrow(tidy(run), schema)


def frequencies(grouped: DataFrame, slice_bits: int) -> DataFrame:
    """``chunk, slice, n, df``: for the different shingles of each chunk that fall in a slice, in order of their
    hashes, the number of texts that have them; ``n`` is the chunk's part of all frequencies."""

    def count(batches):
        for batch in batches:
            for k, chunk in enumerate(batch.column(0).to_pylist()):
                found, n = np.unique(shingles(_texts(batch.column(1)[k].as_py(), batch.column(2)[k].as_py()))[0], return_counts=True)
                cuts = np.searchsorted(found >> _U(64 - slice_bits), np.arange((1 << slice_bits) + 1, dtype=_U))
                full = np.flatnonzero(np.diff(cuts)).tolist()
                packed = [_packed(found[cuts[i] : cuts[i + 1]] & _U((1 << (64 - slice_bits)) - 1)) for i in full]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int32()),
                        pa.array([chunk] * len(full), pa.int64()),
                        pa.array([x for x, _ in packed], pa.binary()),
                        pa.array([x for _, x in packed], pa.binary()),
                        pa.array([_numbers(n[cuts[i] : cuts[i + 1]]) for i in full], pa.binary()),
                    ],
                    names=["slice", "chunk", "low", "high", "counts"],
                )

    def add(part: pa.Table) -> pa.Table:
        packed = [_unpacked(*x) for x in zip(part.column("low").to_pylist(), part.column("high").to_pylist())]
        hashes = np.concatenate(packed)
        counts = np.concatenate(list(map(_counts, part.column("counts").to_pylist())))
        ends = np.cumsum([len(x) for x in packed])
        order = np.argsort(hashes, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        sums = np.empty(len(order), np.int64)
        sums[order] = np.add.reduceat(counts[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        out = pa.table(
            {
                "chunk": part.column("chunk"),
                "slice": part.column("slice"),
                "n": pa.array([int(x.sum()) for x in np.split(counts, ends[:-1])], pa.int64()),
                "df": pa.array(list(map(_numbers, np.split(sums, ends[:-1]))), pa.binary()),
            }
        )
        release()
        return out

    sent = grouped.select("chunk", "sizes", "texts").mapInArrow(tidy(count), "slice int, chunk long, low binary, high binary, counts binary")
    return sent.groupBy("slice").applyInArrow(add, "chunk long, slice int, n long, df binary")


def _bits(hashes: np.ndarray) -> bytes:
    """A bit for each shingle at the low bits of its hash, four to eight times as many bits as shingles."""
    size = 64 << max(0, int(np.ceil(np.log2(max(1, len(hashes)) / 16))))
    held = np.zeros(size, bool)
    held[(hashes & _U(size - 1)).astype(np.int64)] = True
    return np.packbits(held, bitorder="little").tobytes()


def _folded(bits: int, size: int, to: int) -> int:
    while size > to:
        size //= 2
        bits = (bits >> size) | (bits & ((1 << size) - 1))
    return bits


def most_alike(a: tuple, b: tuple) -> float:
    """The greatest weighted Jaccard similarity that two texts can have, each given as (bits, total weight, least
    weight): a bit that only one text has stands for at least one shingle that the other lacks."""
    size = 8 * min(len(a[0]), len(b[0]))
    x, y = (_folded(int.from_bytes(t[0], "little"), 8 * len(t[0]), size) for t in (a, b))
    shared = min(a[1] - (x & ~y).bit_count() * a[2], b[1] - (y & ~x).bit_count() * b[2])
    return shared / (a[1] + b[1] - shared)


def shingle_weights(df: np.ndarray, total: float) -> np.ndarray:
    """Weights of shingles found in ``df`` texts each, ``total`` being the sum of all shingles' frequencies."""
    total = max(2.0, float(total))
    return (1 + np.log(total / np.maximum(df, 1)) / np.log(total)).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling; random numbers come from tables indexed by hashes."""

    SIZE_LOG2 = 15

    def __init__(self, samples: int, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        n = 1 << self.SIZE_LOG2
        self.r = rng.gamma(2.0, 1.0, n).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32)
        self.beta = rng.random(n).astype(np.float32)
        self.odd = rng.integers(0, 2**63, samples, dtype=np.uint64) * _U(2) + _U(1)

    def draw(self, hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row for each text: its samples as 32-bit numbers, 0 for a text without shingles."""
        full = np.flatnonzero(np.diff(starts))
        out = np.zeros((len(starts) - 1, len(self.odd)), np.uint32)
        if not len(full):
            return out
        at, log_w = starts[full], np.log(weights)
        place = np.arange(len(hashes), dtype=np.int64)
        with np.errstate(over="ignore"):
            for k, odd in enumerate(self.odd):
                i = ((hashes * odd) >> _U(64 - self.SIZE_LOG2)).astype(np.int64)
                r, beta = self.r[i], self.beta[i]
                step = np.floor(log_w / r + beta)
                log_a = self.log_c[i] - r * (step - beta) - r
                bits = log_a.view(np.int32)
                bits ^= (bits >> 31) & np.int32(0x7FFFFFFF)  # integers in the order of the floats
                won = np.minimum.reduceat((bits.astype(np.int64) << 32) | place, at) & 0xFFFFFFFF
                mixed = (hashes[won] ^ (step[won].astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15))) * odd
                out[full, k] = (mixed >> _U(32)).astype(np.uint32)
        return out


def signatures(grouped: DataFrame, found: DataFrame, total: float) -> DataFrame:
    """``doc_id, fp, words`` (digest of the words), ``total`` (weight), ``least`` (weight of a shingle), ``bits`` (a bit
    set for each shingle's hash), ``sig`` and ``df`` (packed frequencies of its different shingles, in order) of each
    text of ``chunks``; ``found`` has their ``frequencies``."""

    def run(own: pa.Table, sums: pa.Table) -> pa.Table:
        sampler, columns = Sampler(SAMPLES), [[] for _ in range(8)]
        for k in range(own.num_rows):
            texts = _texts(own.column("sizes")[k].as_py(), own.column("texts")[k].as_py())
            hashes, counts, starts, words = shingles(texts)
            parts = [_counts(x) for _, x in sorted(zip(sums.column("slice").to_pylist(), sums.column("df").to_pylist()))]
            df = np.concatenate([np.zeros(0, np.int64), *parts])[np.unique(hashes, return_inverse=True)[1]]
            w = counts.astype(np.float32) * shingle_weights(df, total)
            weights = np.r_[0.0, np.cumsum(w, dtype=np.float64)][starts]
            columns[0] += own.column("ids")[k].as_py()
            columns[1] += own.column("fps")[k].as_py()
            columns[2] += [hashlib.md5(w).digest() if w else t.encode("utf-8", "replace") for w, t in zip(words, texts)]
            columns[3] += np.diff(weights).tolist()
            columns[4] += [x.tobytes() for x in sampler.draw(hashes, w, starts)]
            ranges = list(zip(starts[:-1].tolist(), starts[1:].tolist()))
            columns[5] += [_numbers(df[a:b]) for a, b in ranges]
            columns[6] += [float(w[a:b].min()) if b > a else 0.0 for a, b in ranges]
            columns[7] += [_bits(hashes[a:b]) for a, b in ranges]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.binary(), pa.binary(), pa.float64(), pa.binary()]
        out = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "fp", "words", "total", "sig", "df", "least", "bits"])
        release()
        return out

    own = grouped.select("chunk", "ids", "fps", "sizes", "texts").groupBy("chunk")
    schema = "doc_id long, fp long, words binary, total double, sig binary, df binary, least double, bits binary"
    return own.cogroup(found.select("chunk", "slice", "df").groupBy("chunk")).applyInArrow(run, schema)


def _with_id_bit(spark: SparkSession, ids: DataFrame, column: str):
    """A filter that holds for all of ``ids`` and few others: a bitmap of fixed size, by hash."""
    at = F.pmod(F.xxhash64(column), F.lit(1 << ID_BITS)).cast("int")
    bits = np.zeros(1 << ID_BITS, bool)
    bits[ids.select(at.alias("at")).distinct().toArrow().column(0).to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits).tobytes())

    @F.pandas_udf("boolean")
    def may_be(index: pd.Series) -> pd.Series:
        held = np.frombuffer(shared.value, np.uint8)
        i = index.to_numpy()
        return pd.Series((held[i >> 3] >> (7 - (i & 7)).astype(np.uint8)) & 1 == 1)

    return lambda doc: may_be(F.pmod(F.xxhash64(doc), F.lit(1 << ID_BITS)).cast("int"))


def _possible(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Pairs that can reach the similarity by what bitmaps of their shingles tell. None is left out that does."""

    def run(batches):
        for batch in batches:
            sides = [list(zip(*(batch.column(f"{n}_{c}").to_pylist() for c in ("bits", "total", "least")))) for n in ("hub", "doc")]
            keep = pa.array([most_alike(a, b) >= similarity - 1e-6 for a, b in zip(*sides)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in names], names=names)

    names = pairs.columns
    side = lambda name: reps.select(F.col("doc").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("bits", "total", "least")])
    both = join_split(pairs.join(side("doc"), "doc"), side("hub"), "hub", "doc", pairs)
    both = both.select(*names, *[f"{n}_{c}" for n in ("hub", "doc") for c in ("bits", "total", "least")])
    return both.mapInArrow(tidy(run), pairs.schema)


def _verified(pairs: DataFrame, texts: DataFrame, total: float, similarity: float) -> DataFrame:
    """``u, v``: the roots of pairs (``hub, doc, hub_root, root``) whose weighted Jaccard similarity, from their whole
    texts, reaches the threshold. A hub of many pairs is dealt to several groups."""

    def run(batches):
        known: dict[int, tuple] = {}

        def vector(doc: int, text: str, df: bytes):
            got = known.get(doc)
            if got is None:
                hashes, counts, _, _ = shingles([text])
                w = counts * shingle_weights(_counts(df), total).astype(np.float64)
                got = hashes, w, w.sum()
            return got

        for batch in batches:
            hubs, docs, hub_texts, doc_texts, hub_dfs, doc_dfs = (c.to_pylist() for c in batch.columns[2:])
            keep = np.zeros(len(hubs), bool)
            for k in range(len(hubs)):
                if hubs[k] not in known:
                    known.clear()
                    known[hubs[k]] = vector(hubs[k], hub_texts[k], hub_dfs[k])
                h1, w1, s1 = known[hubs[k]]
                h2, w2, s2 = vector(docs[k], doc_texts[k], doc_dfs[k])
                _, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
                shared = np.minimum(w1[i], w2[j]).sum()
                keep[k] = shared >= similarity * (s1 + s2 - shared) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in (0, 1)], names=["u", "v"])

    side = lambda name: texts.select(F.col("doc_id").alias(name), F.col("text").alias(f"{name}_text"), F.col("df").alias(f"{name}_df"))
    both = join_split(pairs.join(side("doc"), "doc"), side("hub"), "hub", "doc", pairs)
    both = both.select("hub_root", "root", "hub", "doc", "hub_text", "doc_text", "hub_df", "doc_df")
    return both.mapInArrow(tidy(run), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, class_texts, kept`` of each row of ``docs``.

    A class is a connected component of links of at least ``similarity``; its id is its least doc_id,
    and that row is ``kept``. ``class_texts`` is the number of different word sequences in it. A null text
    counts as the empty one; texts without words are alike only if identical. A repeated row is in the
    class of its twin. Rows with a null id are left out. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).where("doc_id IS NOT NULL")
    texts = texts.withColumn("fp", F.xxhash64("text"))
    grouped = written(chunks(texts), "chunks")
    chars = grouped.agg(F.sum("chars")).first()[0] or 0
    slice_bits = int(np.ceil(np.log2(max(partitions(spark), chars / SLICE_CHARS, 2))))
    found = written(frequencies(grouped, slice_bits), "frequencies")
    total = float(found.agg(F.sum("n")).first()[0] or 0)
    signed = written(signatures(grouped, found, total), "signatures")
    discard(grouped, found)
    rows = signed.count()
    classes = written(
        signed.groupBy("words").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("total", "least", "sig", "bits")]),
        "word-classes",
    )
    reps = classes.where("total > 0")
    bands = [F.xxhash64(F.lit(b), F.substring("sig", 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)]
    entries = reps.select("doc", "total", F.explode(F.array(*bands)).alias("key"))
    sized = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    n = max(1, rows)
    members = written(join_groups(entries, sized, ["key"], "size", n).where("size IS NOT NULL").withColumn("hot", F.col("size") > n // 1000).select("key", "doc", "total", "hot"), "members")
    may_be = _with_id_bit(spark, members.select("doc"), "doc")
    counted = signed.where(may_be("doc_id")).select("doc_id", "fp", "df").dropDuplicates(["doc_id", "fp"])
    candidates = written(texts.where(may_be("doc_id")).join(members.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]).join(counted, ["doc_id", "fp"]), "candidates")
    roots = members.select(F.col("doc").alias("node"), F.col("doc").alias("root")).distinct()
    open_ = members.select("key", "doc", "total", "hot", F.col("doc").alias("root"))
    round_ = 0
    while True:
        slots = 8**round_
        slot = F.pmod(F.xxhash64("doc", F.lit(round_)), F.lit(slots)) if round_ else F.lit(0)
        hubs = open_.groupBy("key", slot.alias("slot")).agg(F.min(F.struct("doc", "root", "total", "hot")).alias("h")).select("key", "h.*")
        hubs = written(hubs.select("key", F.col("doc").alias("hub"), F.col("root").alias("hub_root"), F.col("total").alias("hub_total"), "hot"), "hubs")
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc", F.lit(-1)), F.lit(64)).cast("int")).otherwise(0)
        all_salts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0))))
        first = F.col("hub") < F.col("doc")
        pairs = (
            open_.withColumn("salt", salt)
            .join(hubs.select("key", "hub", "hub_root", "hub_total", all_salts.alias("salt")), ["key", "salt"])
            .where("root <> hub_root")
            .where(F.least("total", "hub_total") / F.greatest("total", "hub_total") >= similarity - 1e-6)
            .select(
                F.when(first, F.col("hub")).otherwise(F.col("doc")).alias("hub"),
                F.when(first, F.col("doc")).otherwise(F.col("hub")).alias("doc"),
                F.when(first, F.col("hub_root")).otherwise(F.col("root")).alias("hub_root"),
                F.when(first, F.col("root")).otherwise(F.col("hub_root")).alias("root"),
            )
            .distinct()
        )
        pairs = written(pairs, "pairs")
        close = written(_possible(pairs, reps, similarity), "close")
        links = written(_verified(close, candidates, total, similarity), "links")
        merged = components(links)
        sized_roots = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
        merged = merged.select(F.col("node").alias("root"), F.col("root").alias("new")).join(sized_roots, "root")
        roots, old_roots = written(join_groups(roots, merged, ["root"], "size", n).select("node", F.coalesce("new", "root").alias("root")), "roots"), roots
        left = open_.drop("root").join(hubs.select("key", F.col("hub").alias("doc")), ["key", "doc"], "left_anti")
        left = left.join(roots.select(F.col("node").alias("doc"), "root"), "doc")
        spread = left.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("size")).where("a <> b").select("key", "size")
        open_, old_open = written(join_groups(left, spread, ["key"], "size", n).where("size IS NOT NULL").select("key", "doc", "total", "hot", "root"), "open"), open_
        discard(hubs, pairs, close, links, *[x for x in (old_roots, old_open) if hasattr(x, "_folder")])
        if open_.isEmpty():
            break
        round_ += 1
    named = classes.select("words", "doc", "n").join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left")
    named = named.select("words", "n", F.coalesce("root", "doc").alias("class_id"))
    sizes = named.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_texts"))
    named = join_groups(named, sizes, ["class_id"], "class_texts", n)
    out = join_groups(signed.select("doc_id", "words"), named, ["words"], "n", n)
    return out.select("doc_id", "class_id", "class_texts", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
