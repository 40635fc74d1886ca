"""Row numbers without collecting rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def indexed(df: DataFrame, name: str = "__index") -> DataFrame:
    """``df`` (written or otherwise fixed in its partitions) with consecutive numbers from 0: each partition counts
    its own rows and starts where the ones before it end. Only a count for each partition is broadcast."""
    at = df.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    counts = at.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    joined = at.withColumn("__part", part).join(F.broadcast(starts), "__part")
    number = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], number.alias(name))


def hash_order(keys: list[str], seed: int):
    """Sort keys of a fixed pseudo-random order of rows, the same however they are partitioned: by the MD5 of the seed and
    the keys as text, as any SQL engine can compute it, then by the keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(f"`{k}`").cast("string") for k in keys])
    return [F.md5(text.cast("binary")), *[F.col(f"`{k}`") for k in keys]]


def uniform(*parts):
    """A number from 0 to below 1 for each row, from the MD5 of some values as text: the same in every run and engine."""
    text = F.concat_ws(":", *[(F.lit(str(p)) if isinstance(p, (int, str)) else p.cast("string")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def first_by_hash(df: DataFrame, keys: list[str], seed: int, k: int, n: int) -> DataFrame:
    """The first ``k`` of ``n`` rows in ``hash_order``, without a sort of all of them or of the sample.

    Hashes are uniform, so all rows with a hash some deviations below the k/n quantile belong to it and none above; only
    the few between are sorted (their number grows with the root of k).
    """
    if k >= n:
        return df
    order = hash_order(keys, seed)
    low, high = _edges(k, n)
    at = df.withColumn("__order", order[0])
    surely = at.where(F.col("__order") < low)
    between = at.where((F.col("__order") >= low) & (F.col("__order") < high))
    inside, near = (x.count() for x in (surely, between))
    if not inside <= k <= inside + near:  # as good as never, and for keys that repeat
        return df.orderBy(*order).limit(k)
    rest = between.orderBy("__order", *order[1:]).limit(k - inside)
    return surely.unionByName(rest).drop("__order")


def _edges(k: int, n: int) -> tuple[str, str]:
    """Two MD5 texts between which the hash of the k-th of n rows lies but for a chance of one in a billion."""
    spread = 6 * (k * (1 - k / n)) ** 0.5 + 6
    text = lambda share: f"{int(max(0.0, min(1.0, share)) * (16**12 - 1)):012x}"
    high = (k + spread) / n
    return text((k - spread) / n), text(high) if high < 1 else "g"
