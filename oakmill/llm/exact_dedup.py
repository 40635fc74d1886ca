"""Exact dedup: counting quotient filters find what may repeat, bytes decide.

1. One pass over the texts writes (id, 64-bit fingerprint, sha256) to the shared folder.
2. Each partition of fingerprints builds counting quotient filters, one per range of fingerprints;
   those of one range are merged by their sorted remainders. What comes out with a count above one may
   be a repeated text.
3. Those fingerprints set bits in a bitmap of fixed size (the only thing that is broadcast). A second
   pass routes the texts whose bit is set to byte verification: they are grouped by fingerprint *and
   text*, so equal means equal bytes. Grouping combines on the map side: of a group of copies, however
   large, each task sends one text.
4. The groups go back to the rows by (fingerprint, sha256). Groups of more than a thousandth of all
   rows (so under a thousand of them) are broadcast; the others are joined by key, where no key has
   more rows than that.

A full bitmap (at some billions of repeated texts) only sends more texts to step 3; results don't change.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oakmill.llm.common import partitions, table, tidy, whole_text, written
from oakmill.llm.cqf import CountingQuotientFilter

BITMAP_BITS = 26
SHARD_ROWS = 4_000_000
FLUSH_ROWS = 2_000_000
HOT_SHARE = 1000


def _filters(shard_bits: int):
    def build(batches):
        held, n = [], 0

        def flush():
            prints = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            shards = (prints >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(prints), np.int64)
            cuts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(prints) else []
            for a, b in zip(cuts, [*cuts[1:], len(prints)]):
                yield pa.RecordBatch.from_pydict(
                    {"shard": [int(shards[a])], "filter": [CountingQuotientFilter.of(prints[a:b]).to_bytes()]}
                )

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += batch.num_rows
            if n >= FLUSH_ROWS:
                yield from flush()
                held, n = [], 0
        yield from flush()

    return build


def repeated_bits(prints: DataFrame, rows: int, bits: int = BITMAP_BITS) -> bytes:
    """A bitmap over the high ``bits`` bits of fingerprints: set where a fingerprint counts above one."""
    shard_bits = min(bits - 3, int(np.ceil(np.log2(max(partitions(prints.sparkSession), rows / SHARD_ROWS, 1)))))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        merged = CountingQuotientFilter.merged([CountingQuotientFilter.from_bytes(x) for x in pdf["filter"]])
        values, counts = merged.items()
        share = np.zeros(1 << (bits - shard_bits), dtype=bool)
        share[((values[counts > 1] >> np.uint64(64 - bits)) & np.uint64(len(share) - 1)).astype(np.int64)] = True
        return pd.DataFrame({"shard": pdf["shard"][:1], "bits": [np.packbits(share).tobytes()]})

    shards = (
        prints.select("fp")
        .mapInArrow(tidy(_filters(shard_bits)), "shard long, filter binary")
        .groupBy("shard")
        .applyInPandas(merge, "shard long, bits binary")
    )
    step = 1 << (bits - shard_bits - 3)
    whole = bytearray(step << shard_bits)
    for shard, share in shards.toLocalIterator():
        whole[shard * step : (shard + 1) * step] = share
    return bytes(whole)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, ``keep_id`` (largest id among rows of equal text),
    ``group_size``, ``kept`` and ``text_sha256``.

    A null text counts as the empty one. Texts are compared byte for byte, without any change. Rows
    that repeat an id along with its text count each in ``group_size`` and are all marked alike; a row
    without an id is kept only where its whole group has none. An empty table gives an empty result.
    Further columns of ``docs`` are ignored, whatever their names.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    base = base.withColumn("fp", F.xxhash64("text"))
    keyed = written(base.select("doc_id", "fp", F.sha2("text", 256).alias("text_sha256")), "exact-keys")
    rows = keyed.count()
    bitmap = spark.sparkContext.broadcast(repeated_bits(keyed, rows))

    @F.pandas_udf("boolean")
    def may_repeat(fp: pd.Series) -> pd.Series:
        bits = np.frombuffer(bitmap.value, dtype=np.uint8)
        at = (fp.to_numpy().view(np.uint64) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
        return pd.Series((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

    groups = written(
        base.where(may_repeat("fp"))
        .groupBy("fp", "text")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
        .where("group_size > 1")
        .select("fp", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"),
        "exact-groups",
    )
    limit = max(1, rows // HOT_SHARE)
    hot, cold = groups.where(F.col("group_size") > limit), groups.where(F.col("group_size") <= limit)
    keys = ["fp", "text_sha256"]
    of_hot = keyed.join(F.broadcast(hot), keys)
    others = keyed.join(F.broadcast(hot), keys, "left_anti").join(cold, keys, "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return (
        of_hot.unionByName(others)
        .select(
            "doc_id",
            keep.alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            F.col("doc_id").eqNullSafe(keep).alias("kept"),
            "text_sha256",
        )
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, CAST(count(*) OVER same AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""
