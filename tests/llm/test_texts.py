"""Operators on texts: awkward rows, libraries and brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers as P
from oakmill.llm import bpe, common, exact_dedup, near_dedup, packing, substring_dedup, token_counts, toxicity
from oakmill.llm.components import components
from oakmill.llm.cqf import CountingQuotientFilter

EXTRA = "fp string, kept string, row string, words string, length string, hash string, n string, size string, root string, held_out string, _row string"
LONG = "x" * 3000 + " " + "many different words " * 4000


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, columns with clashing names."""
    texts = [None, "", "   ", "\n\n", LONG, LONG, "Alpha beta. Gamma delta!\nline", "Alpha beta. Gamma delta!\nline", " edge ", "a  b\t\nc", "é漢字 😀 it's <|endoftext|> <s> 12"]
    rows = [(k, t, *["z"] * 11) for k, t in enumerate(texts)] + [(6, texts[6], *["z"] * 11), (20, None, *[None] * 11), (None, "nobody", *[None] * 11)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="module")
def nothing(awkward):
    return awkward.where("false")


def texts_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


# -- byte-level BPE


def tiktoken_encoding():
    import tiktoken

    ranks = bpe.Vocabulary.ranked(P.path("byte_bpe_50k.tiktoken")).tokens
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab  \n\t é漢😀'sl19.,!\x1c\x85 theing"), max_size=60), max_size=6))
def test_bpe_is_the_librarys(texts):
    coder = bpe.Encoder(bpe.Vocabulary.ranked(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    for _ in range(2):  # the second time from the table
        ids, counts = coder.encode(texts)
        assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == tiktoken_encoding().encode_ordinary(texts[0]) if texts else len(ids) == 0
        assert ids.tolist() == [i for t in texts for i in tiktoken_encoding().encode_ordinary(t)]


def test_bpe_with_full_tables(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_CHUNKS", 3)
    coder = bpe.Encoder(bpe.Vocabulary.ranked(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    for text in ["one two three four five", "", " five four", "three six\nseven", "one two", "  x"] * 3:
        assert coder.encode([text])[0].tolist() == tiktoken_encoding().encode_ordinary(text)


def test_bpe_digests(awkward, nothing):
    got = {(r["doc_id"], r["ids_sha256"], r["decoded_sha256"], r["n_tokens"]) for r in bpe.digests(awkward, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for doc, text in texts_of(awkward).items():
        ids = tiktoken_encoding().encode_ordinary(text)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert (doc, digest, hashlib.sha256(text.encode()).hexdigest(), len(ids)) in got
    assert bpe.digests(nothing, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_bpe_round_trip(awkward):
    path = P.path("byte_bpe_50k.tiktoken")
    back = bpe.decoded(bpe.encoded(awkward, path, P.PATTERN), path).collect()
    assert len(back) == awkward.count()
    want = texts_of(awkward)
    assert all(bytes(r["bytes"]).decode() == want[r["doc_id"]] for r in back)


def test_merge_list_vocabulary_is_the_librarys():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    coder = bpe.Encoder(bpe.Vocabulary.listed(P.path("byte_bpe_50k.json")), P.PATTERN)
    texts = ["", "a<|endoftext|>b", "<|endoftext|>", "it's  two\n\nlines", "x" * 700, "émile 漢字"]
    ids, counts = coder.encode(texts)
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_new_chunks_are_split_together():
    """A few calls of the pattern for many new chunks, none where it would not part them; the ids are the library's."""
    from tokenizers import Tokenizer

    class Asked:
        n = 0

        def findall(self, text):
            self.n += 1
            return pattern.findall(text)

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    coder = bpe.Encoder(bpe.Vocabulary.listed(P.path("byte_bpe_50k.json")), P.PATTERN)
    pattern, coder.pattern = coder.pattern, Asked()
    text = "first" + "".join(f"{gap}{word}{k}{end}" for k in range(60) for gap, word, end in ((" ", "thé", "."), ("\n", "it's", "!?"), (" ", "漢", "")))
    ids, counts = coder.encode([text, text[:50]])
    assert ids.tolist() == [i for t in (text, text[:50]) for i in own.encode(t, add_special_tokens=False).ids] and len(counts) == 2
    assert coder.pattern.n < 10
    whole = bpe.Encoder(coder.vocab, "(?s:.+)")
    pieces, upto = whole._split([" a", "\nb", " c"], True)
    assert pieces == [" a", "\nb", " c"] and upto.tolist() == [1, 2, 3]


# -- token counts


def test_prefix_counts_are_the_librarys():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    counter = token_counts.PrefixCounter.of(P.path("piece_bpe_32k.model"))
    for text in ["", " ", "  two  blanks ", "The theory of everything, therefore.", "é漢\n\t<s> hi </s>▁x", "aaaaaaaaaa bbbb"]:
        counts = counter.prefixes(text)
        assert counts == [len(model.encode(text[:i])) for i in range(len(text) + 1)]


def test_words_that_begin_alike_are_walked_once(monkeypatch):
    """The letters looked at are those of the different beginnings, and the counts are the library's."""
    import sentencepiece

    class Asked(dict):
        n = 0

        def get(self, *args):
            self.n += 1
            return dict.get(self, *args)

    path = P.path("piece_bpe_32k.model")
    model, counter = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.PrefixCounter(path)
    counter.ends = Asked(counter.ends)
    monkeypatch.setattr(token_counts, "TABLE_PAIRS", 20)  # and pairs are forgotten amid words
    words = ["the" + x + y for x in ("ory", "é漢", "oretically", "👍th") for y in ("", "s", "sé", "😀", "ising", "is", "X9")]
    n, _ = counter.counts([" ".join(words)])
    assert n.tolist() == [len(model.encode(" ".join(words)))]
    marked = {token_counts.MARK + w for w in words}
    assert counter.ends.n == len({w[:i] for w in marked for i in range(1, len(w) + 1)}) < sum(map(len, marked)) / 2


def test_token_counts(spark, awkward, nothing):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    path = P.path("piece_bpe_32k.model")
    rows = token_counts.token_counts(awkward, path, limit=5).collect()
    want = texts_of(awkward)
    assert len(rows) == awkward.count()
    for r in rows:
        n = len(model.encode(want[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(want[r["doc_id"]].encode()), n, n > 5)
    assert token_counts.token_counts(nothing, path).count() == 0


@pytest.mark.parametrize("letters", [200, 3])
def test_cuts_are_those_of_all_prefixes(monkeypatch, letters):
    """How far a text goes within a limit, from stored prefixes of words and from the library's count of each prefix."""
    import sentencepiece

    monkeypatch.setattr(token_counts, "WORD_LETTERS", letters)
    monkeypatch.setattr(token_counts, "TABLE_WORDS", 5)
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    counter = token_counts.PrefixCounter(P.path("piece_bpe_32k.model"))
    texts = ["", " ", "word", "Unbelievable  theories about   tokenisation ", " two  blanks ▁ mark", "é漢字 long " + "x" * 30, "a b c d e f g"]
    for limit in range(8):
        n, within = counter.counts(texts, limit)
        for text, count, chars in zip(texts, n.tolist(), within.tolist()):
            each = [len(model.encode(text[:i])) for i in range(len(text) + 1)]
            assert count == each[-1]
            assert chars == (len(text) if count <= limit else max(i for i, c in enumerate(each) if c <= limit))


def test_budgets_from_prefixes(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    text = "Unbelievable theories about tokenisation"
    held = token_counts.prefix_table(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), P.path("piece_bpe_32k.model"))
    row = held.where("doc_id = 1").select(token_counts.longest_within(4).alias("n"), token_counts.tokens_at(6).alias("six")).first()
    assert row["n"] == max(i for i in range(len(text) + 1) if len(model.encode(text[:i])) <= 4)
    assert row["six"] == len(model.encode(text[:6]))
    assert held.where("doc_id = 2").first()["counts"] == [0]


# -- substring dedup


def tiles_by_force(text):
    """Units as (start, end, words), found letter by letter: a unit ends with the last of its marks."""
    out, at = [], 0
    for k, letter in enumerate(text):
        if letter in ".!?\n" and (k + 1 == len(text) or text[k + 1] not in ".!?\n") or k + 1 == len(text):
            if words := text[at : k + 1].lower().split():
                out.append((at, k + 1, words))
            at = k + 1
    return out


def word_places(text, a, b):
    places, k = [], a
    while k < b:
        if text[k].isspace():
            k += 1
            continue
        end = k
        while end < b and not text[end].isspace():
            end += 1
        places.append((k, end))
        k = end
    return places


def spans_by_force(rows, least):
    """(doc, start, end, units, words, kept document) of every repeated passage, read document by document."""
    tiles = {d: tiles_by_force(t or "") for d, t in rows}
    text = {d: t or "" for d, t in rows}
    first: dict = {}
    for d in sorted(tiles):
        for place, (_, _, words) in enumerate(tiles[d]):
            first.setdefault(tuple(words), (d, place))
    out = set()
    for d, own in tiles.items():
        k = 0
        while k < len(own):
            if first[tuple(own[k][2])] == (d, k):
                k += 1
                continue
            head = k
            while k < len(own) and first[tuple(own[k][2])] != (d, k):
                k += 1
            tail = k - 1
            anchor = max(range(head, tail + 1), key=lambda i: (len(own[i][2]), -i))
            kept, at = first[tuple(own[anchor][2])]
            there = tiles[kept]
            start, end, words = own[head][0], own[tail][1], sum(len(own[i][2]) for i in range(head, tail + 1))
            i, j = head - 1, at - (anchor - head) - 1
            if i >= 0 and 0 <= j < len(there):
                a, b, n = own[i][2], there[j][2], 0
                while n < min(len(a), len(b)) and a[-1 - n] == b[-1 - n]:
                    n += 1
                if n:
                    start, words = word_places(text[d], *own[i][:2])[-n][0], words + n
            i, j = tail + 1, at + (tail - anchor) + 1
            if i < len(own) and 0 <= j < len(there):
                a, b, n = own[i][2], there[j][2], 0
                while n < min(len(a), len(b)) and a[n] == b[n]:
                    n += 1
                if n:
                    end, words = word_places(text[d], *own[i][:2])[n - 1][1], words + n
            if words >= least:
                out.add((d, start, end, tail - head + 1, words, kept))
    return out


def test_spans_are_those_of_brute_force(spark):
    rng = np.random.default_rng(1)
    pool = [" ".join(rng.choice(list("abcdefgh"), 4)) + rng.choice([". ", "!\n", "? "]) for _ in range(40)]
    rows = [(k, "".join(rng.choice(pool, 8)) + f"own {k}.") for k in range(60)] + [(61, None), (62, "")]
    for k in range(70, 100):  # passages whose ends fall inside sentences
        passage = f"e f  g h. {pool[k % 3]}{pool[5]} h g"
        rows.append((k, f"{' '.join(rng.choice(list('abxy'), 3))} {passage} {' '.join(rng.choice(list('abxy'), 3))}. {rng.choice(pool)}"))
    for least in (0, 6, 15):
        got = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), min_words=least).collect()
        assert {tuple(r) for r in got} == spans_by_force(rows, least)


def test_planted_passages_go_whole(spark):
    """A passage of over 50 words that begins and ends inside sentences goes but for its first occurrence; the rest stays."""
    rng = np.random.default_rng(2)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    def prose(n):
        return " ".join(w + ("." if rng.random() < 0.12 else "") for w in word(n))

    rows, own = [], {}
    for p in range(8):
        passage = " ".join(w + ("." if k in (11, 24, 31, 43) else "") for k, w in enumerate(word(56)))
        for copy in range(4):
            before, after = f"{prose(60)} mid{p}x{copy}", f"goes{p}x{copy} on {prose(60)}"
            rows.append((10 * p + copy, f"{before} {passage} {after}"))
            own[10 * p + copy] = f"{before} {passage} {after}" if copy == 0 else f"{before}  {after}"
    boiler = "All rights reserved. Licensed under the terms of the licence."
    rows += [(200 + k, f"{prose(80)}\n{boiler}") for k in range(20)]
    own |= dict(rows[-20:])
    got = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == own


def test_spans_of_awkward_rows(spark, awkward, nothing):
    spans = substring_dedup.repeated_spans(awkward, min_words=3)
    docs = {r["doc_id"] for r in spans.collect()}
    assert docs == {5, 6, 7}  # the later of equal texts; 6 through its repeated row
    base = awkward.withColumn("n_chars", F.length("text")).withColumn("__cuts", F.lit("x")).drop("__cuts")
    cut = substring_dedup.without_repeats(base, min_words=3)
    assert cut.columns == base.columns and cut.count() == base.count()
    rows = [(r["doc_id"], r["text"], r["n_chars"]) for r in cut.collect()]
    assert (5, "", 0) in rows and sorted(len(t) for d, t, _ in rows if d == 6) == [0, 29]  # of a repeated row one keeps its text
    assert substring_dedup.repeated_spans(nothing).count() == 0 and substring_dedup.without_repeats(nothing).count() == 0


@pytest.mark.parametrize("unit", list(substring_dedup.UNITS))
def test_units_tile_the_text(spark, unit):
    import re

    for text in ["a. b\n\nc d\n", "\n\n x", "one\ntwo\n\n\nthree", "...", ""]:
        assert "".join(re.findall(substring_dedup.UNITS[unit], text)) == text


# -- packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 40), min_size=1, max_size=60))
def test_plan_gives_gapless_sequences(histogram):
    runs = packing.plan(histogram, 100)
    placed = []
    for length, n in histogram.items():
        own = [r for r in runs.tolist() if r[0] == length]
        for k in range(n):
            _, first, each, sequence, offset = [r for r in own if r[1] <= k][-1]
            placed.append((sequence + (k - first) // each, offset + (k - first) % each * length, length))
    end: dict = {}
    for sequence, offset, length in sorted(placed):
        assert end.get(sequence, 0) == offset
        end[sequence] = offset + length
        assert end[sequence] <= 100
    bins = []
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [b for b in bins if b >= length]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - length)
        else:
            bins.append(100 - length)
    assert len(end) <= len(bins) * 1.05 + 1


def test_pieces_and_sequences(spark, awkward, nothing):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    path = P.path("byte_bpe_50k.json")
    rows = packing.pack_documents(awkward, path, P.PATTERN, 64).collect()
    want = texts_of(awkward)
    found: dict = {}
    for r in rows:
        ids = [*own.encode(want[r["doc_id"]], add_special_tokens=False).ids, 0][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        assert r["length"] == 64 or r["piece"] == 0
        found.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in found.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    whole = packing.sequences(awkward.where("doc_id <> 4 AND doc_id <> 5"), path, P.PATTERN, 64).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(len(own.encode(t or "", add_special_tokens=False).ids) + 1 for (d, t) in [(r[0], r[1]) for r in awkward.where("doc_id <> 4 AND doc_id <> 5").select("doc_id", "text").collect()])
    assert packing.pack_documents(nothing, path, P.PATTERN).count() == 0


# -- toxicity


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scores = toxicity.scored(docs, toxicity.train(docs, labels))
    rows = scores.where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    flagged, bad = rows[rows.predicted == 1], rows[rows.toxic == 1]
    assert (flagged.toxic == 1).mean() > 0.95 and (bad.predicted == 1).mean() > 0.8
    assert ((rows.predicted == 1) == (rows.score >= toxicity.THRESHOLD)).all()


def test_toxicity_never_sees_labels_of_held_out_rows(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(50) if zlib.crc32(str(k).encode()) % 3 == 1], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).terms.beginnings == {}


def test_clauses_weigh_by_channel():
    reader = toxicity.Reader(toxicity.Terms.seeded())
    rows = reader.features(["you idiot", "an idiot", "not an idiot", "they said you idiot", "all is well. kind words", "", "not. an idiot", "idiots like you, idiot you", "kill you", "kill time"])
    aimed, plain, negated, reported, none, empty, parted, after, threat, idle = rows
    assert aimed[0] > 0 and plain[1] > 0 and negated[2] > 0 and reported[3] > 0
    assert not none.any() and not empty.any() and parted[1] > 0 and parted[2] == 0
    assert after[0] == aimed[0] and threat[0] > 0 and threat[1] == 0 and idle[0] == 0 and 0 < idle[1] < threat[0]


def test_the_machine_is_the_product_of_its_parts():
    parts = (toxicity.INSULTS, toxicity.THREATS, toxicity.TARGETS, toxicity.NEGATIONS, toxicity.REPORTS)
    step, states = toxicity.compose(*parts)
    assert len(states) == 32
    rng = np.random.default_rng(3)
    for _ in range(50):
        at, apart = 0, [0] * len(parts)
        for x in rng.integers(0, toxicity.END + 1, 30).tolist():
            at, apart = step[at, x], [m.step[s][x] for m, s in zip(parts, apart)]
            assert states[at] == tuple(apart)


def features_by_force(terms, text):
    """Channel features by the grammar's rules, clause by clause, without machines, tries, arrays or tables."""
    import regex

    def meaning(word):
        own = terms.whole.get(word)
        weights = [w for start, w in terms.beginnings.items() if word.startswith(start)] + ([own[1]] if own and own[0] == toxicity.INSULT else [])
        return (toxicity.INSULT, max(weights)) if weights else own

    chunks = text.replace("\n", " | ").split()
    clauses, here = [], []
    for place, chunk in enumerate(chunks):
        here += [(place, w, *hit) for w in regex.findall(r"[\p{L}\p{M}]+", chunk.lower()) if (hit := meaning(w))]
        if chunk[-1] in ".!?;:,|()\"«»“”…":
            clauses.append(here)
            here = []
    sums, matched, terms_seen = {"aimed": 0.0, "plain": 0.0, "negated": 0.0, "reported": 0.0}, 0, set()
    for clause in [*clauses, here]:
        held = Counter()
        negated = reported = aimed = hit = False
        last = None
        for place, word, symbol, weight in clause:
            if last is not None and place - last > 5:
                negated = False
            last = place
            if symbol in (toxicity.INSULT, toxicity.THREAT):
                hit = True
                held["negated" if negated else "reported" if reported else "open", symbol] += weight
                if symbol == toxicity.INSULT:
                    terms_seen.add(word)
            negated = negated or symbol == toxicity.NEGATION
            reported = reported or symbol == toxicity.REPORT
            aimed = aimed or symbol == toxicity.TARGET
        if hit:
            matched += 1
            for name in ("negated", "reported"):
                sums[name] += min(8.0, held[name, toxicity.INSULT] + 0.2 * held[name, toxicity.THREAT])
            sums["aimed" if aimed else "plain"] += min(8.0, held["open", toxicity.INSULT] + (1 if aimed else 0.2) * held["open", toxicity.THREAT])
    if not matched:
        return [0.0] * 7
    values = [*sums.values(), matched, len(terms_seen), 1000 * sum(sums.values()) / len(chunks)]
    return np.log1p(values)


def test_features_are_those_of_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = [r["text"] or "" for r in docs.collect()]
    pool = "you idiot idiots kill not never said they the a trash , . ; hurt wrote".split()
    rng = np.random.default_rng(4)
    texts += [" ".join(rng.choice(pool, 30)) for _ in range(100)] + ["", "  \n ", "you\nidiot"]
    for terms in (toxicity.Terms.seeded(), toxicity.train(docs, labels).terms):
        got = toxicity.Reader(terms).features(texts)
        assert np.allclose(got, [features_by_force(terms, t) for t in texts])


def test_toxicity_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None), (6, 0), (6, 1)], "doc_id long, toxic int")
    model = toxicity.train(awkward, labels)
    rows = toxicity.scored(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.scored(nothing, model).count() == 0
    kept = toxicity.without_toxic(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == sum(r["predicted"] == 0 for r in rows)


# -- exact and near duplicates


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 40), max_size=60), max_size=4))
def test_quotient_filters_lose_nothing(parts):
    filters = [CountingQuotientFilter.of(np.array(p, np.uint64)) for p in parts]
    filters = [CountingQuotientFilter.from_bytes(f.to_bytes()) for f in filters]
    values, counts = CountingQuotientFilter.merged(filters).items()
    want: dict = {}
    for x in (x for p in parts for x in p):
        want[x] = want.get(x, 0) + 1
    assert dict(zip(values.tolist(), counts.tolist())) == want and values.tolist() == sorted(want)


def test_exact_duplicates(spark, awkward, nothing):
    rows = exact_dedup.exact_duplicates(awkward).collect()
    data = [(r["doc_id"], r["text"] or "") for r in awkward.select("doc_id", "text").collect()]
    assert len(rows) == len(data)
    text = {hashlib.sha256(t.encode()).hexdigest(): t for _, t in data}
    for r in rows:
        same = [d for d, t in data if t == text[r["text_sha256"]]]
        assert r["keep_id"] == max((d for d in same if d is not None), default=None)
        assert r["group_size"] == len(same) and r["kept"] == (r["doc_id"] == r["keep_id"])
    assert exact_dedup.exact_duplicates(nothing).count() == 0


def test_one_text_in_a_third_of_all_rows(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same' ELSE concat('text ', id) END AS text")
    got = exact_dedup.exact_duplicates(docs)
    assert got.where("kept").count() == 4001 and got.where("group_size = 2000 AND keep_id = 5997").count() == 2000


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40) if k != 20] + [(100, 101), (101, 100), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).distinct().collect()))
    assert got == {k: 0 if k <= 20 else 21 for k in range(41)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def near_links(texts, similarity=0.8):
    """Pairs of texts at least so alike, from the definition: tuples of words, exact frequencies, no hashing and none of the
    operator's code."""
    own = []
    for t in texts:
        w = t.lower().split()
        own.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    df = Counter(s for c in own for s in c)
    total = max(2.0, float(sum(df.values())))
    weight = {s: np.float64(np.float32(1 + np.log(total / n) / np.log(total))) for s, n in df.items()}
    weighted = [{s: n * weight[s] for s, n in c.items()} for c in own]
    sums = [sum(w.values()) for w in weighted]
    having: dict = {}
    links = set()
    for k, w in enumerate(weighted):
        shared: Counter = Counter()
        for s, x in w.items():
            for j in having.get(s, ()):
                shared[j] += min(x, weighted[j][s])
            having.setdefault(s, []).append(k)
        links |= {(j, k) for j, x in shared.items() if x >= similarity * (sums[j] + sums[k] - x) - 1e-9}
    return links


def near_by_force(rows):
    texts = [t or "" for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first: dict = {}
    same = {(first.setdefault(t, k), k) for k, t in enumerate(texts)}
    for j, k in near_links(texts) | same:
        x, y = find(j), find(k)
        root[max(x, y)] = min(x, y)
    least: dict = {}
    for k, (d, _) in enumerate(rows):
        least[find(k)] = min(d, least.get(find(k), d))
    return {(d, least[find(k)]) for k, (d, _) in enumerate(rows)}


def test_near_links_of_a_table_are_found(spark):
    """Recall and precision of links over a whole table, by a brute force of its own."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    rows = [(r[0], r[1] or "") for r in docs.collect()]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    links = near_links([t for _, t in rows])
    found = sum(got[rows[j][0]] == got[rows[k][0]] for j, k in links)
    assert len(links) > 20 and found >= 0.99 * len(links)
    want: dict = {}
    for d, c in near_by_force(rows):
        want.setdefault(c, set()).add(d)
    whole = {d: c for c, ds in want.items() for d in ds}
    mine: dict = {}
    for d, c in got.items():
        mine.setdefault(c, set()).add(whole[d])
    assert all(len(c) == 1 for c in mine.values())  # no class joins what the definition parts


def test_near_duplicates_are_those_of_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for family in range(12):
        base = [f"w{rng.integers(0, 3000)}" for _ in range(int(rng.integers(20, 300)))]
        for _ in range(int(rng.integers(1, 14))):
            text = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 25))):
                text[rng.integers(0, len(text))] = f"edit{rng.integers(0, 10**6)}"
            rows.append((len(rows) * 7 % 1009, " ".join(text)))
    rows += [(2000, None), (2001, ""), (2002, "  "), (2003, "two words"), (2004, "Two  Words"), (2005, rows[0][1]), (2005, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["class_id"]) for r in got} == near_by_force(rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=200), st.lists(st.integers(0, 300), min_size=1, max_size=200), st.integers(0, 9))
def test_bitmaps_never_rule_out_what_is_alike(a, b, seed):
    """The bound is at least the weighted Jaccard similarity, for texts of any two sizes."""
    rng = np.random.default_rng(seed)
    hashes, weight = rng.integers(0, 2**63, 301).astype(np.uint64), rng.uniform(1, 2, 301)
    x, y = Counter(a), Counter(b)
    shared = sum(min(x[k], y[k]) * weight[k] for k in x.keys() & y.keys())
    sums = [sum(n * weight[k] for k, n in c.items()) for c in (x, y)]
    sides = [(near_dedup._bits(hashes[sorted(c)]), s, min(n * weight[k] for k, n in c.items())) for c, s in zip((x, y), sums)]
    assert near_dedup.most_alike(*sides) >= shared / (sum(sums) - shared) - 1e-9


def test_bitmaps_rule_out_what_is_not_alike():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 900).astype(np.uint64)
    side = lambda own: (near_dedup._bits(own), 2.0 * len(own), 2.0)
    assert near_dedup.most_alike(side(h[:500]), side(h[:500])) == 1
    assert near_dedup.most_alike(side(h[:500]), side(h[200:700])) < 0.6 and near_dedup.most_alike(side(h[:450]), side(h[450:])) < 0.3


def test_a_split_join_is_a_join(spark):
    rows = spark.range(5000).selectExpr("id AS doc", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 50 END AS hub")
    side = spark.range(60).selectExpr("id AS hub", "concat('text ', id) AS words")
    got = common.join_split(rows, side, "hub", "doc", rows, share=10, least=1)
    assert sorted(map(tuple, got.select("doc", "hub", "words").collect())) == [(d, h, f"text {h}") for d in range(5000) for h in [7 if d % 3 == 0 else d % 50]]


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(0)
    h = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    a, b = rng.uniform(0.5, 3, 300).astype(np.float32), rng.uniform(0.5, 3, 300).astype(np.float32)
    sampler = near_dedup.Sampler(3000)
    x = sampler.draw(h, a, np.array([0, 300]))[0]
    y = sampler.draw(h, b, np.array([0, 300]))[0]
    assert abs((x == y).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_near_duplicates_of_awkward_rows(spark, awkward, nothing):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(awkward).collect()}
    assert got[5] == 4 and got[7] == 6 and got[1] == 0 and got[20] == 0 and got[2] == 2 and None not in got
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_near_duplicates_count_each_shingle(spark):
    common, own = " ".join(f"c{k}" for k in range(100)), " ".join(f"o{k}" for k in range(100))
    near = [(1, f"{own} {common} x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11 x12 x13 x14"), (2, f"{own} {common} y1 y2 y3 y4 y5 y6 y7 y8 y9 y10 y11 y12 y13 y14")]
    rows = near + [(k, f"{common} " + " ".join(f"r{k}_{i}" for i in range(300))) for k in range(10, 210)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.xxhash64("text"))
    grouped = near_dedup.chunks(docs)
    found = near_dedup.frequencies(grouped, 3)
    total = float(found.agg(F.sum("n")).first()[0])
    signed = near_dedup.signatures(grouped, found, total).collect()
    hashes = {d: near_dedup.shingles([t])[0] for d, t in rows}
    exact = Counter(h for own in hashes.values() for h in own.tolist())
    assert total == sum(exact.values())
    assert {r["doc_id"]: near_dedup._counts(r["df"]).tolist() for r in signed} == {d: [exact[h] for h in own.tolist()] for d, own in hashes.items()}
    a, b = (dict(zip(hashes[d].tolist(), near_dedup.shingle_weights(np.array([exact[h] for h in hashes[d].tolist()]), total).astype(float))) for d in (1, 2))
    shared = sum(a[h] for h in a.keys() & b.keys())
    alike = shared / (sum(a.values()) + sum(b.values()) - shared)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs, similarity=alike - 1e-4).collect()}
    assert got[2] == 1
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs, similarity=alike + 1e-4).collect()}
    assert got[2] == 2
