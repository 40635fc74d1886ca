"""Quotation linking: who replies to whom, read off quoted passages. DataFrame functions only.

A line's quote level is the number of ``>`` marks before it; a passage is one quoted line. Passages are
normalised (lower case, letters and digits only, single blanks) and hashed, and each is linked to the latest earlier
message of its conversation that has the passage as a line of its own. A message replies to the one that most of its
first-level passages come from (the later one on a tie). Chains of replies are followed by pointer doubling.

Linking is an as-of join by (conversation, hash). It runs in blocks of turns: the latest turn within a block by a
window, the latest of earlier blocks from one row for each block, so neither a line that everybody writes nor one
huge conversation makes a hot group. Joins by conversation, by line or by the message that is replied to broadcast
the keys with more than a thousandth of all rows (fewer than a thousand of them) and shuffle the rest. Positions come from a range sort of all messages with the parts' counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oakmill.llm.common import join_groups, partitions, table, whole_text, written

MARKS = r"^((?:[ \t]*>)+)[ \t]?"
ATTRIBUTION = r"^(on .+ wrote|am .+ schrieb.*|le .+ a écrit|el .+ escribió) ?:$"
BLOCK = 256


def _level(line):
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), r"[^>]", ""))


def _normal(line):
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def without_quotes(text):
    """Column: the text without quoted lines and without a line that only says who is quoted next; blank lines at
    the ends go too if anything was removed."""
    lines = F.split(text, "\n", -1)
    nexts = F.concat(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), F.array(F.lit("")))
    pairs = F.arrays_zip(lines.alias("line"), nexts.alias("next"))
    kept = F.filter(pairs, lambda p: (_level(p["line"]) == 0) & ~(F.lower(F.trim(p["line"])).rlike(ATTRIBUTION) & (_level(p["next"]) > 0)))
    joined = F.array_join(F.transform(kept, lambda p: p["line"]), "\n")
    return F.when(F.size(kept) == F.size(lines), text).otherwise(F.regexp_replace(joined, r"^\s+|\s+$", ""))


def _joined(rows: DataFrame, side: DataFrame, keys: list[str], total: int, semi: bool = False) -> DataFrame:
    """``rows`` joined (left or semi) to ``side`` (unique keys), no key being hot however many rows have it."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    out = join_groups(rows, side.join(sizes, keys), keys, "__n", total)
    return (out.where("__n IS NOT NULL") if semi else out).drop("__n")


def linked(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` (without quotes), ``reply_to, thread_root, depth, position, n_quoted, n_linked,
    max_level`` of every message.

    ``reply_to`` is null where nothing quoted is found in the conversation before; ``thread_root`` is the turn at the
    end of the chain of replies (its own, if it replies to none) and ``depth`` the chain's length. ``position``
    counts from 0 within the conversation, threads by their root, messages of a thread by turn: replies come after
    what they reply to. ``n_quoted`` and ``n_linked`` count different quoted lines and those found.
    A null text counts as the empty one. A null conv_id is a conversation of its own and links to nothing, nor does
    a null turn. Messages that share conversation and turn are one message to links, and each a row of the result,
    in any order. Further columns of ``messages`` are ignored.
    """
    spark = messages.sparkSession
    base = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), whole_text().alias("raw"))
    quoting = base.where(F.col("raw").rlike(r"(?m)^[ \t]*>"))
    quoted = quoting.select("conv_id", "turn", F.explode(F.split("raw", "\n", -1)).alias("line")).withColumn("level", _level("line"))
    quoted = quoted.where("level > 0").withColumn("h", F.xxhash64(_normal(F.regexp_replace("line", MARKS, ""))))
    quoted = quoted.where(_normal(F.regexp_replace("line", MARKS, "")) != "")
    quoted = written(quoted.groupBy("conv_id", "turn", "h").agg(F.min("level").alias("level"), F.max("level").alias("deepest")), "quoted")
    total = max(1, base.count())
    own = _joined(base, quoted.select("conv_id").distinct(), ["conv_id"], total, semi=True).select("conv_id", "turn", F.explode(F.split("raw", "\n", -1)).alias("line"))
    own = own.where((_level("line") == 0) & F.col("turn").isNotNull()).select("conv_id", "turn", F.xxhash64(_normal("line")).alias("h"))
    own = written(own.distinct(), "own-lines")
    own = _joined(own, quoted.select("conv_id", "h").distinct(), ["conv_id", "h"], max(1, own.count()), semi=True)
    block = F.floor(F.col("turn") / BLOCK)
    both = written(
        own.withColumn("own", F.lit(True)).unionByName(quoted.select("conv_id", "turn", "h").withColumn("own", F.lit(False))).withColumn("block", block),
        "passages",
    )
    by_block = both.where("own").groupBy("conv_id", "h", "block").agg(F.max("turn").alias("last"))
    blocks = both.select("conv_id", "h", "block").distinct().join(by_block, ["conv_id", "h", "block"], "left")
    before = Window.partitionBy("conv_id", "h").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "h", "block", F.max("last").over(before).alias("earlier"))
    within = Window.partitionBy("conv_id", "h", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("here", F.max(F.when(F.col("own"), F.col("turn"))).over(within)).where("NOT own")
    found = found.join(blocks, ["conv_id", "h", "block"], "left").select("conv_id", "turn", "h", F.coalesce("here", "earlier").alias("source"))
    found = written(found.join(quoted, ["conv_id", "turn", "h"]), "sources")
    counts = found.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n_quoted"), F.count("source").alias("n_linked"), F.max("deepest").alias("max_level")
    )
    votes = found.where("level = 1 AND source IS NOT NULL").groupBy("conv_id", "turn", "source").agg(F.count(F.lit(1)).alias("n"))
    parents = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("n", "source"))["source"].alias("reply_to"))
    links = written(parents.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("root"), F.lit(1).alias("depth")), "replies")
    while True:
        on = links.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = _joined(links, on, ["conv_id", "root"], total)
        if step.where("next IS NOT NULL").isEmpty():
            break
        links = written(
            step.select("conv_id", "turn", "reply_to", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")),
            "replies",
        )
    info = counts.join(links, ["conv_id", "turn"], "left")
    marked = base.withColumn("text", without_quotes(F.col("raw"))).drop("raw").join(info, ["conv_id", "turn"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    marked = marked.select(
        "conv_id", "turn", "role", "text", "reply_to", F.coalesce("root", "turn").alias("thread_root"), *map(zero, ("depth", "n_quoted", "n_linked", "max_level"))
    )
    marked = marked.repartitionByRange(partitions(spark), "conv_id", "thread_root", "turn").sortWithinPartitions("conv_id", "thread_root", "turn")
    marked = written(marked.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    per_part = marked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    offsets = per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # a row for each part
    ranked = marked.withColumn("part", part).join(F.broadcast(offsets), "part")
    ranked = ranked.withColumn("rank", F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "base", "at")
    first = ranked.groupBy("conv_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    ranked = ranked.withColumn("key", F.coalesce("conv_id", F.lit(-1))).withColumn("none", F.col("conv_id").isNull())
    first = first.select(F.coalesce("conv_id", F.lit(-1)).alias("key"), F.col("conv_id").isNull().alias("none"), "first", "n")
    out = join_groups(ranked, first, ["key", "none"], "n", marked.count())
    return out.select(
        "conv_id", "turn", "role", "text", "reply_to", "thread_root", "depth", (F.col("rank") - F.col("first")).alias("position"), "n_quoted", "n_linked", "max_level"
    )


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``linked`` over all conversations: null texts count as empty, a null conversation or turn links to nothing, repeated
    messages are a row each, an empty table gives no rows, other columns are ignored."""
    return linked(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS raw FROM conversations
), lines AS (
  SELECT conv_id, turn, role, raw, unnest(string_split(raw, chr(10))) AS line,
         generate_subscripts(string_split(raw, chr(10)), 1) AS i
  FROM base
), leveled AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)[ \t]?', 1), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(lower(regexp_replace(line, '^((?:[ \t]*>)+)[ \t]?', '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm
  FROM lines
), seen AS (
  SELECT *, coalesce(lead(level) OVER (PARTITION BY conv_id, turn ORDER BY i), 0) AS next_level FROM leveled
), cleaned AS (
  SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY i) FILTER (keep) AS kept, count(*) FILTER (keep) = count(*) AS whole
  FROM (SELECT *, level = 0 AND NOT (regexp_matches(lower(trim(line)), '^(on .+ wrote|am .+ schrieb.*|le .+ a écrit|el .+ escribió) ?:$') AND next_level > 0) AS keep FROM seen)
  GROUP BY ALL
), q AS (
  SELECT conv_id, turn, norm, min(level) AS level, max(level) AS deepest FROM leveled WHERE level > 0 AND norm <> '' GROUP BY ALL
), o AS (
  SELECT DISTINCT conv_id, turn, norm FROM leveled WHERE level = 0
), f AS (
  SELECT q.*, (SELECT max(o.turn) FROM o WHERE o.conv_id = q.conv_id AND o.norm = q.norm AND o.turn < q.turn) AS source FROM q
), counts AS (
  SELECT conv_id, turn, count(*) AS n_quoted, count(source) AS n_linked, max(deepest) AS max_level FROM f GROUP BY ALL
), votes AS (
  SELECT conv_id, turn, source, count(*) AS n FROM f WHERE level = 1 AND source IS NOT NULL GROUP BY ALL
), parents AS (
  SELECT conv_id, turn, source AS reply_to FROM votes
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, source DESC) = 1
), chain AS (
  SELECT conv_id, turn, reply_to AS root, 1 AS depth FROM parents
  UNION ALL
  SELECT c.conv_id, c.turn, p.reply_to, c.depth + 1 FROM chain c JOIN parents p ON p.conv_id = c.conv_id AND p.turn = c.root
), roots AS (
  SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM chain GROUP BY ALL
), joined AS (
  SELECT b.conv_id, b.turn, b.role, CASE WHEN c.whole THEN b.raw ELSE trim(coalesce(c.kept, ''), ' ' || chr(10) || chr(9) || chr(13)) END AS text,
         p.reply_to, coalesce(r.root, b.turn) AS thread_root, coalesce(r.depth, 0) AS depth,
         coalesce(n.n_quoted, 0) AS n_quoted, coalesce(n.n_linked, 0) AS n_linked, coalesce(n.max_level, 0) AS max_level
  FROM base b JOIN cleaned c USING (conv_id, turn) LEFT JOIN parents p USING (conv_id, turn)
  LEFT JOIN roots r USING (conv_id, turn) LEFT JOIN counts n USING (conv_id, turn)
)
SELECT conv_id, turn, role, text, reply_to, thread_root, CAST(depth AS BIGINT) AS depth,
       row_number() OVER (PARTITION BY conv_id ORDER BY thread_root, turn) - 1 AS position,
       CAST(n_quoted AS BIGINT) AS n_quoted, CAST(n_linked AS BIGINT) AS n_linked, CAST(max_level AS BIGINT) AS max_level
FROM joined
"""
