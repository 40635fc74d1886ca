"""Substring dedup by hashing units of text.

A text is tiled into units: a stretch without a line feed or sentence mark and the marks that end it
(``unit="line"`` or ``"paragraph"``: by line feeds or empty lines only). Units are normalised (lower case, single
blanks) and hashed to 128 bits; digests are grouped over all documents and the occurrence that ranks first (least
doc_id, then place) stays. Of the others, those that follow each other in a document form a run.

A passage need not begin and end with a unit. So a run is compared, word by word, with the text around the first
occurrence of its longest unit, and grows into the unit before and the one after as far as both agree. Grown runs of
at least ``min_words`` words are removed (0: every repeat is); shorter coincidences stay. Spans keep their offsets in
the original text.

Only digests and places are shuffled, and words (as hashes) of the units beside runs that can get long enough; texts
are not. A unit that makes up more than a thousandth of all units is broadcast (fewer than a thousand are), so no
digest is a hot key, however many documents have it.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oakmill.llm.common import discard, join_groups, join_split, table, tidy, whole_text, written

UNITS = {
    "sentence": r"[^\n.!?]*[\n.!?]+|[^\n.!?]+",
    "line": r"[^\n]*\n|[^\n]+",
    "paragraph": r"(?:[^\n]|\n(?!\n))*\n\n+|(?:[^\n]|\n(?!\n))+\n?",
}
#: What counts as a passage that repeats: 50 words.
MIN_WORDS = 50
FLUSH_UNITS = 100_000
PLACE_BITS = 24
_WORD = re.compile(r"\S+")


def tagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a number of its own for each row (``__row``), written once, so that passes over it agree."""
    return written(docs.withColumn("__row", F.monotonically_increasing_id()), "texts")


def _texts(base: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return base.select(F.col("__row"), F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))


def _tiles(pattern: re.Pattern, text: str):
    """Start, end and lower-case words of every unit that has a word."""
    at = 0
    for part in pattern.findall(text):
        words = part.lower().split()
        if words:
            yield at, at + len(part), words
        at += len(part)


def units(base: DataFrame, unit: str = "sentence", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, place, start, end, words, before, after`` (words of the units beside it), ``hi, lo`` of every unit
    of ``tagged`` texts that has a word. A null text counts as the empty one, which has no units."""
    pattern = re.compile(UNITS[unit])

    def run(batches):
        columns: list[list] = [[] for _ in range(9)]
        rows, ids, places, starts, ends, sizes, befores, afters, digests = columns

        def flush():
            longs = [np.array(c, np.int64) for c in (rows, *columns[2:8])]
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(longs[0]), pa.array(ids, pa.int64()), *(pa.array(x.astype(np.int32)) for x in longs[1:]), pa.array(both[:, 0]), pa.array(both[:, 1])],
                names=["row", "doc_id", "place", "start", "end", "words", "before", "after", "hi", "lo"],
            )
            for c in columns:
                c.clear()

        for batch in batches:
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                first = len(rows)
                last = 0
                for place, (a, b, words) in enumerate(_tiles(pattern, text)):
                    rows.append(row)
                    ids.append(doc)
                    places.append(place)
                    starts.append(a)
                    ends.append(b)
                    sizes.append(len(words))
                    befores.append(last)
                    digests.append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "replace")))
                    last = len(words)
                if len(rows) > first:
                    afters += [*sizes[first + 1 :], 0]
                if len(rows) >= FLUSH_UNITS:
                    yield from flush()
        if rows:
            yield from flush()

    schema = "row long, doc_id long, place int, start int, end int, words int, before int, after int, hi long, lo long"
    return _texts(base, id_col, text_col).mapInArrow(tidy(run), schema)


def _words_of(base: DataFrame, wanted: DataFrame, unit: str, id_col: str, text_col: str) -> DataFrame:
    """``key`` (row, place), ``hashes, starts, ends`` (of each word) of the ``wanted`` units and a few others: a bitmap of
    fixed size tells which. Full, it only lets more units through."""
    spark = base.sparkSession
    at = F.pmod(F.crc32(F.concat_ws(":", "key.row", "key.place").cast("binary")), F.lit(1 << PLACE_BITS)).cast("int")
    held = np.zeros(1 << PLACE_BITS, bool)
    held[wanted.select(at.alias("at")).distinct().toArrow().column(0).to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(held).tobytes())
    pattern = re.compile(UNITS[unit])

    def run(batches):
        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8)).tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for row, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                for place, (a, b, words) in enumerate(_tiles(pattern, text)):
                    if bits[zlib.crc32(b"%d:%d" % (row, place)) & ((1 << PLACE_BITS) - 1)]:
                        spans = [m.span() for m in _WORD.finditer(text, a, b)]
                        hashes = [xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) for w in words]
                        parts = (row, place, np.array(hashes, "<u8").tobytes(), np.array([x for x, _ in spans], "<i4").tobytes(), np.array([x for _, x in spans], "<i4").tobytes())
                        for column, x in zip(out, parts):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), *[pa.binary()] * 3))], names=["row", "place", "hashes", "starts", "ends"])

    found = _texts(base, id_col, text_col).mapInArrow(tidy(run), "row long, place int, hashes binary, starts binary, ends binary")
    return found.select(F.struct("row", "place").alias("key"), "hashes", "starts", "ends")


def _agree(a: bytes | None, b: bytes | None, at_end: bool) -> int:
    """How many words two units have in common at their ends, or at their starts."""
    if not a or not b:
        return 0
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    n = min(len(x), len(y))
    x, y = (x[len(x) - n :][::-1], y[len(y) - n :][::-1]) if at_end else (x[:n], y[:n])
    other = np.flatnonzero(x != y)
    return int(other[0]) if len(other) else n


def _grown(base: DataFrame, runs: DataFrame, unit: str, id_col: str, text_col: str) -> DataFrame:
    """``runs`` with ``left`` and ``right``, the words by which they grow, and ``grown_start, grown_end``."""
    sides = [
        ("own_left", "row", F.col("head") - 1),
        ("kept_left", "first_row", F.col("kept_head") - 1),
        ("own_right", "row", F.col("tail") + 1),
        ("kept_right", "first_row", F.col("kept_tail") + 1),
    ]
    each = F.array(*[F.struct(F.lit(name).alias("side"), F.struct(F.col(row).alias("row"), place.cast("int").alias("place")).alias("key")) for name, row, place in sides])
    wanted = runs.select(F.col("row").alias("of_row"), F.col("head").alias("of_head"), F.explode(each).alias("w")).select("of_row", "of_head", "w.side", "w.key")
    wanted = written(wanted.where("key.place >= 0"), "beside")
    names = [name for name, _, _ in sides]
    found = join_split(wanted, _words_of(base, wanted, unit, id_col, text_col), "key", "of_row", wanted)
    one = lambda name: F.first(F.when(F.col("side") == name, F.struct("hashes", "starts", "ends")), ignorenulls=True).alias(name)
    beside = found.groupBy("of_row", "of_head").agg(*map(one, names))

    def grow(batches):
        for batch in batches:
            rows = []
            for own_left, kept_left, own_right, kept_right in zip(*(batch.column(c).to_pylist() for c in names)):
                hashes = lambda x: x and x["hashes"]
                left, right = _agree(hashes(own_left), hashes(kept_left), True), _agree(hashes(own_right), hashes(kept_right), False)
                start = int(np.frombuffer(own_left["starts"], "<i4")[-left]) if left else None
                end = int(np.frombuffer(own_right["ends"], "<i4")[right - 1]) if right else None
                rows.append((left, right, start, end))
            new = [pa.array([r[i] for r in rows], pa.int32()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("of_row"), batch.column("of_head"), *new], names=["of_row", "of_head", "left", "right", "grown_start", "grown_end"])

    grown = beside.mapInArrow(tidy(grow), "of_row long, of_head int, left int, right int, grown_start int, grown_end int")
    return runs.join(grown, (F.col("row") == F.col("of_row")) & (F.col("head") == F.col("of_head")), "left")


def spans_of(base: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans of ``repeated_spans`` for ``tagged`` documents, with the ``row`` that each is in."""
    all_units = written(units(base, unit, id_col, text_col), "units")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "place")
    groups = all_units.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first")).where("n > 1")
    groups = groups.select("hi", "lo", "n", F.col("first.row").alias("first_row"), F.col("first.place").alias("first_place"), F.col("first.doc_id").alias("kept"))
    groups = written(groups, "repeated-units")
    later = join_groups(all_units, groups, ["hi", "lo"], "n", max(1, all_units.count())).where(
        "n IS NOT NULL AND NOT (row = first_row AND place = first_place)"
    )
    in_row = Window.partitionBy("row").orderBy("place")
    later = later.withColumn("run", F.col("place") - F.row_number().over(in_row))
    runs = (
        later.groupBy("row", "doc_id", "run")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.count(F.lit(1)).alias("n_units"),
            F.sum("words").alias("n_words"),
            F.min(F.struct("place", "before")).alias("head"),
            F.max(F.struct("place", "after")).alias("tail"),
            F.max(F.struct("words", (-F.col("place")).alias("back"), "first_row", "first_place", "kept")).alias("long"),
        )
        .where(F.col("n_words") + F.col("head.before") + F.col("tail.after") >= min_words)
    )
    shift = F.col("long.first_place") + F.col("long.back")  # from a place in the row to the one that it repeats
    runs = runs.select(
        "row", "doc_id", "start", "end", "n_units", "n_words", F.col("head.place").alias("head"), F.col("tail.place").alias("tail"),
        F.col("long.first_row").alias("first_row"), (shift + F.col("head.place")).alias("kept_head"), (shift + F.col("tail.place")).alias("kept_tail"), F.col("long.kept").alias("kept"),
    )
    runs = written(runs, "runs")
    discard(all_units, groups)
    words = F.col("n_words") + F.coalesce("left", F.lit(0)) + F.coalesce("right", F.lit(0))
    return (
        _grown(base, runs, unit, id_col, text_col)
        .where(words >= min_words)
        .select(
            "row",
            "doc_id",
            F.coalesce("grown_start", "start").cast("long").alias("start"),
            F.coalesce("grown_end", "end").cast("long").alias("end"),
            "n_units",
            words.cast("long").alias("n_words"),
            F.col("kept").alias("kept_doc_id"),
        )
    )


def repeated_spans(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each span to remove: ``doc_id, start, end`` (characters of the original text), ``n_units`` (whole ones),
    ``n_words`` and ``kept_doc_id``, the document where the span's longest unit stays. Spans that grow towards each
    other may overlap.

    Rows without an id rank last. A repeated row is a document of its own: its twin's text is repeated in it,
    under the same doc_id. Documents without such a span (empty and null texts among them) have no row.
    Further columns of ``docs`` are ignored.
    """
    return spans_of(tagged(docs.select("doc_id", "text")), unit, min_words).drop("row")


def without_repeats(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated spans of each row cut out of ``text`` (and ``n_chars``, if there, put right).

    All rows stay, also those whose text becomes empty. Spans belong to rows, so ids may repeat or be null: of a
    repeated row the first keeps its text. Other columns, whatever their names, are kept as they are.
    """
    base = tagged(docs)
    spans = spans_of(base, unit, min_words)
    cuts = spans.groupBy(F.col("row").alias("__row")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cuts"))
    columns = docs.columns
    counted = "n_chars" in columns

    def run(batches):
        for batch in batches:
            texts, all_cuts = batch.column("text").to_pylist(), batch.column("__cuts").to_pylist()
            for k, own in enumerate(all_cuts):
                if own and texts[k]:
                    parts, at = [], 0
                    for cut in own:
                        parts.append(texts[k][at : max(at, cut["start"])])
                        at = max(at, cut["end"])
                    texts[k] = "".join([*parts, texts[k][at:]])
            out = {c: batch.column(c) for c in columns} | {"text": pa.array(texts, pa.string())}
            if counted:
                lengths = pa.array([None if n is None else n if not c else len(t or "") for n, c, t in zip(batch.column("n_chars").to_pylist(), all_cuts, texts)])
                out["n_chars"] = lengths.cast(batch.column("n_chars").type)
            yield pa.RecordBatch.from_pydict(out)

    return base.join(cuts, "__row", "left").select(*columns, "__cuts").mapInArrow(tidy(run), docs.schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated spans of all documents: null and empty texts have none, of equal texts the least doc_id keeps its own,
    other columns are ignored, an empty table gives no rows."""
    return repeated_spans(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH parts AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^\n.!?]*[\n.!?]+|[^\n.!?]+')) AS part,
         generate_subscripts(regexp_extract_all(text, '[^\n.!?]*[\n.!?]+|[^\n.!?]+'), 1) AS i
  FROM documents WHERE text <> ''
), tiled AS (
  SELECT doc_id, i, part, trim(regexp_replace(lower(part), '\s+', ' ', 'g')) AS norm,
         sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS stop, length(part) AS size
  FROM parts
), units AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place, string_split(norm, ' ') AS w, len(string_split(norm, ' ')) AS words,
         regexp_extract_all(part, '\s*\S+') AS tokens
  FROM tiled WHERE norm <> ''
), ranked AS (
  SELECT doc_id, place, stop, size, words, row_number() OVER same AS nth, first_value(doc_id) OVER same AS first_doc, first_value(place) OVER same AS first_place
  FROM units WINDOW same AS (PARTITION BY norm ORDER BY doc_id, place)
), later AS (
  SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM ranked WHERE nth > 1
), runs AS (
  SELECT doc_id, min(stop - size) AS start, max(stop) AS stop, count(*) AS n_units, sum(words) AS n_words, min(place) AS head, max(place) AS tail,
         max({{'words': words, 'back': -place, 'doc': first_doc, 'place': first_place}}) AS long
  FROM later GROUP BY doc_id, run
), beside AS (
  SELECT r.*, ol.w AS olw, ol.tokens AS olt, ol.stop - ol.size AS ol_start, rw.w AS orw, rw.tokens AS ort, rw.stop - rw.size AS or_start,
         coalesce(len(list_filter(range(1, least(len(ol.w), len(kl.w)) + 1), lambda n: ol.w[len(ol.w) - n + 1:] = kl.w[len(kl.w) - n + 1:])), 0) AS l,
         coalesce(len(list_filter(range(1, least(len(rw.w), len(kr.w)) + 1), lambda n: rw.w[:n] = kr.w[:n])), 0) AS r
  FROM runs r
  LEFT JOIN units ol ON ol.doc_id = r.doc_id AND ol.place = r.head - 1
  LEFT JOIN units kl ON kl.doc_id = long.doc AND kl.place = long.place + long.back + r.head - 1
  LEFT JOIN units rw ON rw.doc_id = r.doc_id AND rw.place = r.tail + 1
  LEFT JOIN units kr ON kr.doc_id = long.doc AND kr.place = long.place + long.back + r.tail + 1
)
SELECT doc_id,
       CAST(CASE WHEN l = 0 THEN start ELSE ol_start + coalesce(list_sum([length(t) FOR t IN olt[:len(olt) - l]]), 0)
            + length(olt[len(olt) - l + 1]) - length(regexp_replace(olt[len(olt) - l + 1], '^\s+', '')) END AS BIGINT) AS start,
       CAST(CASE WHEN r = 0 THEN stop ELSE or_start + list_sum([length(t) FOR t IN ort[:r]]) END AS BIGINT) AS "end",
       n_units, CAST(n_words + l + r AS BIGINT) AS n_words, long.doc AS kept_doc_id
FROM beside WHERE n_words + l + r >= {MIN_WORDS}
"""
