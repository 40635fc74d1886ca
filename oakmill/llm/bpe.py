"""Byte-level BPE encoding and decoding in padded numpy matrices.

Pre-tokens that are not in a worker's table yet are put together by length, one row each in a padded
matrix of token ids. Each round finds every row's leftmost pair of least rank (ranks of pairs are kept
in a second matrix and looked up in an open-addressing hash table), merges it, shifts the rest of the
row to the left, and looks up only the two pairs that are new. Rows without a pair left are written out
and the matrix is compacted to the others.

Texts are cut into chunks first: a single blank or line feed between two characters that are no white
space always starts a pre-token, so what lies between two such places can be encoded by itself and its
ids kept in the worker's table (bounded; emptied when full). New chunks go through the
pattern together. A text with other white space goes through the pre-token pattern as a whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oakmill.llm.common import table, tidy, whole_text

NO_PAIR = np.int32(2**31 - 1)
BUCKETS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, 512)
MATRIX_CELLS = 1_000_000
TABLE_CHUNKS = 400_000
TABLE_IDS = 4_000_000
GROUP_CHARS = 4_000_000


class PairTable:
    """(left id, right id) -> (rank, id of the merged token), by open addressing in numpy arrays."""

    def __init__(self, left, right, rank, merged):
        keys = (np.asarray(left, np.int64) << 32) | np.asarray(right, np.int64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, 4 * len(keys))))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NO_PAIR, np.int32)
        self.merged = np.zeros(size, np.int32)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.keys[at] < 0
            slots, first = np.unique(at[free], return_index=True)  # one key for a slot; the others go on
            won = todo[free][first]
            self.keys[slots], self.rank[slots], self.merged[slots] = keys[won], np.asarray(rank)[won], np.asarray(merged)[won]
            left_over = self.keys[at] != keys[todo]
            todo, at = todo[left_over], (at[left_over] + 1) & (size - 1)

    def _home(self, keys):
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left, right):
        """Slots of the pairs; -1 where a pair doesn't merge."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._home(keys)
        found = self.keys[at]
        todo = np.flatnonzero((found != keys) & (found >= 0))
        slot = np.where(found == keys, at, -1)
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            slot[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (found >= 0)]
        return slot

    def ranks(self, left, right):
        slot = self.find(left, right)
        return np.where(slot >= 0, self.rank[slot], NO_PAIR)


class Vocabulary:
    """Tokens, their bytes, the pairs that merge, and whether a whole pre-token is looked up first."""

    def __init__(self, tokens: dict[bytes, int], pairs: PairTable, whole_first: bool, special: dict[str, int]):
        self.tokens, self.pairs, self.whole_first, self.special = tokens, pairs, whole_first, special
        self.byte_id = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        size = max([*tokens.values(), *special.values()]) + 1
        parts = [b""] * size
        for token, i in [*tokens.items(), *((k.encode(), v) for k, v in special.items())]:
            parts[i] = token
        self.length = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    @classmethod
    @functools.lru_cache(maxsize=2)
    def ranked(cls, path: str) -> "Vocabulary":
        """From a file of base64 tokens and ranks: any pair whose joint bytes are a token merges."""
        with open(path, "rb") as lines:
            tokens = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        rows = [
            (tokens[t[:i]], tokens[t[i:]], r, r)
            for t, r in tokens.items()
            for i in range(1, len(t))
            if t[:i] in tokens and t[i:] in tokens
        ]
        return cls(tokens, PairTable(*map(list, zip(*rows))), True, {})

    @classmethod
    @functools.lru_cache(maxsize=2)
    def listed(cls, path: str) -> "Vocabulary":
        """From a tokenizers file: only the pairs that its merge list has, special strings kept whole."""
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        visible = _visible_bytes()
        special = {x["content"]: x["id"] for x in data["added_tokens"]}
        as_bytes = lambda s: bytes(visible[c] for c in s)
        vocab = data["model"]["vocab"]
        tokens = {as_bytes(t): i for t, i in vocab.items() if t not in special}
        rows = []
        for rank, merge in enumerate(data["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            rows.append((vocab[a], vocab[b], rank, vocab[a + b]))
        return cls(tokens, PairTable(*map(list, zip(*rows))), bool(data["model"].get("ignore_merges")), special)

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of consecutive lists of ids, gathered from the table of tokens, and each list's length."""
        lengths = self.length[ids]
        edge = np.r_[0, np.cumsum(lengths)]
        places = np.repeat(self.start[ids] - edge[:-1], lengths) + np.arange(edge[-1])
        ends = np.r_[0, np.cumsum(counts)]
        return self.bytes[places], np.diff(edge[ends])


def _visible_bytes() -> dict[str, int]:
    """The usual one-character stand-ins of bytes in vocabulary files."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in keep}, 0
    for b in range(256):
        if b not in keep:
            out[chr(256 + n)] = b
            n += 1
    return out


def merge_all(pieces: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all pieces in one array, and where each piece's ids start and how many they are."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # pieces, counts, their ids in a row
    if vocab.whole_first:
        direct = np.fromiter(map(vocab.tokens.get, pieces, repeat(-1)), np.int32, len(pieces))
    else:
        direct = np.full(len(pieces), -1, np.int32)
        one = np.flatnonzero(lengths == 1)
        direct[one] = [vocab.byte_id[pieces[k][0]] for k in one.tolist()]
    at = np.flatnonzero(direct >= 0)
    done.append((at, np.ones(len(at), np.int64), direct[at]))
    bucket = np.searchsorted(BUCKETS, lengths)
    bucket[direct >= 0] = -1
    for k in np.flatnonzero(bucket == len(BUCKETS)).tolist():
        ids = _merge_long(pieces[k], vocab)
        done.append((np.array([k]), np.array([len(ids)]), ids))
    for i, width in enumerate(BUCKETS):
        members = np.flatnonzero(bucket == i)
        step = max(1, MATRIX_CELLS // width)
        for a in range(0, len(members), step):
            part = members[a : a + step]
            joined = np.frombuffer(b"".join([pieces[k] for k in part.tolist()]), np.uint8)
            _merge_matrix(part, lengths[part], joined, width, vocab, done)
    who, counts, flat = (np.concatenate([d[i] for d in done]) for i in range(3))
    starts, sizes = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    starts[who], sizes[who] = np.cumsum(counts) - counts, counts
    return flat.astype(np.int32), starts, sizes


def _merge_matrix(who, lengths, joined, width, vocab, done) -> None:
    n = len(who)
    inside = np.arange(width)[None, :] < lengths[:, None]
    ids = np.zeros((n, width), np.int32)
    ids[inside] = vocab.byte_id[joined]
    columns = np.arange(width)
    rank = vocab.pairs.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
    rank[columns[None, 1:] >= lengths[:, None]] = NO_PAIR
    while len(who):
        at = rank.argmin(axis=1)  # the leftmost of the least
        rows = np.arange(len(who))
        ready = rank[rows, at] == NO_PAIR
        if ready.any():
            kept = ids[ready]
            done.append((who[ready], lengths[ready], kept[np.arange(kept.shape[1])[None, :] < lengths[ready][:, None]]))
            go = ~ready
            who, ids, rank, lengths, at = who[go], ids[go], rank[go], lengths[go], at[go]
            if not len(who):
                break
            most = int(lengths.max())
            ids, rank = ids[:, :most], rank[:, : most - 1]
            rows = np.arange(len(who))
        slot = vocab.pairs.find(ids[rows, at], ids[rows, at + 1])
        ids[rows, at] = vocab.pairs.merged[slot]
        w = ids.shape[1]
        take = np.arange(w - 1)[None, :]
        source = take + (take > at[:, None])
        ids = np.take_along_axis(ids, source, axis=1)
        lengths = lengths - 1
        if w == 2:
            rank = np.full((len(who), 1), NO_PAIR, np.int32)
            ids = np.concatenate([ids, np.zeros((len(who), 1), ids.dtype)], axis=1)
            continue
        take = np.arange(w - 2)[None, :]
        rank = np.take_along_axis(rank, take + (take >= at[:, None]), axis=1)
        right = at + 1 < lengths  # the pair that the new token starts
        if right.any():
            r = rows[right]
            rank[r, at[right]] = vocab.pairs.ranks(ids[r, at[right]], ids[r, at[right] + 1])
        last = ~right & (at < w - 2)
        rank[rows[last], at[last]] = NO_PAIR
        left = at > 0  # the pair that it ends
        if left.any():
            r = rows[left]
            rank[r, at[left] - 1] = vocab.pairs.ranks(ids[r, at[left] - 1], ids[r, at[left]])


def _merge_long(piece: bytes, vocab: Vocabulary) -> np.ndarray:
    """One very long pre-token: the same merges from a heap over a linked list, n log n steps."""
    ids = vocab.byte_id[np.frombuffer(piece, np.uint8)]
    ranks = vocab.pairs.ranks(ids[:-1], ids[1:])
    ids, n = ids.tolist(), len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r != NO_PAIR]
    heapq.heapify(heap)
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def pair(a: int, b: int) -> tuple[int, int]:
        if (a, b) not in known:
            slot = int(vocab.pairs.find(np.array([a]), np.array([b]))[0])
            known[a, b] = (int(vocab.pairs.rank[slot]), int(vocab.pairs.merged[slot])) if slot >= 0 else (-1, -1)
        return known[a, b]

    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = pair(a, b)[1], -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for x in (before[i], i):
            y = after[x] if x >= 0 else n
            if y < n and (r := pair(ids[x], ids[y])[0]) >= 0:
                heapq.heappush(heap, (r, x, ids[x], ids[y]))
    return np.array([x for x in ids if x >= 0], np.int32)


class Encoder:
    """Encodes many texts; keeps the ids of chunks seen in a bounded table, of ``most`` chunks if that is given."""

    def __init__(self, vocab: Vocabulary, pattern: str, most: int | None = None):
        self.vocab, self.pattern, self.most = vocab, regex.compile(pattern), most
        self.cut = regex.compile("(" + "|".join(map(regex.escape, vocab.special)) + ")") if vocab.special else None
        self.after_blank, self.other = {}, {}
        self.flat, self.n_flat, self.known = np.zeros(0, np.int32), 0, np.zeros((2, 0), np.int64)
        self._age()

    def _age(self) -> None:
        """Starts new tables; the full ones stay behind them, so chunks in use are copied, not encoded again."""
        self.old = self.after_blank, self.other, self.known, self.flat
        self.after_blank: dict[str, int] = {}
        self.other: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.n_flat = 0
        self.known = np.zeros((2, 0), np.int64)

    def _add(self, blank: bool, keys: list[str], texts: list[str]) -> None:
        """Adds the ids of texts to a table: from the older table, or encoded in one go."""
        before, known, flat = self.old[not blank], *self.old[2:]
        codes = np.fromiter(map(before.get, keys, repeat(-1)), np.int64, len(keys))
        aged = np.flatnonzero(codes >= 0)
        at, sizes = known[0][codes[aged]], known[1][codes[aged]]
        self._put(blank, [keys[k] for k in aged.tolist()], _slices(flat, at, sizes), np.r_[0, np.cumsum(sizes)])
        new = np.flatnonzero(codes < 0).tolist()
        flat_pieces, upto = self._split(list(map(texts.__getitem__, new)), blank)
        names = dict(zip(dict.fromkeys(flat_pieces), range(len(flat_pieces))))
        ids, starts, sizes = merge_all([p.encode("utf-8", "replace") for p in names], self.vocab)
        which = np.fromiter(map(names.__getitem__, flat_pieces), np.int64, len(flat_pieces))
        ends = np.r_[0, np.cumsum(sizes[which])][np.r_[0, upto]]
        self._put(blank, [keys[k] for k in new], _slices(ids, starts[which], sizes[which]), ends)

    def _split(self, texts: list[str], blank: bool) -> tuple[list[str], np.ndarray]:
        """Pre-tokens of all texts in a row, and how many there are up to each text's end. Texts that begin with the blank
        or line feed before them go through the pattern as one, if it parts them where they meet."""
        if blank and texts:
            pieces = self.pattern.findall("".join(texts))
            at = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            upto = np.searchsorted(at, ends)
            if len(at) and at[-1] == ends[-1] and (at[upto] == ends).all():
                return pieces, upto + 1
        split = [self.pattern.findall(t) for t in texts]
        return [p for own in split for p in own], np.cumsum([len(own) for own in split], dtype=np.int64)

    def _put(self, blank: bool, keys: list[str], flat: np.ndarray, ends: np.ndarray) -> None:
        while self.n_flat + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.n_flat : self.n_flat + len(flat)] = flat
        first = self.known.shape[1]
        self.known = np.concatenate([self.known, [self.n_flat + ends[:-1], np.diff(ends)]], axis=1)
        self.n_flat += len(flat)
        (self.after_blank if blank else self.other).update(zip(keys, range(first, first + len(keys))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has. Special strings are ids of their own."""
        if not self.cut or not any(s in t for t in texts for s in self.vocab.special):
            return self._encode(texts)
        parts, of = [], []
        for k, text in enumerate(texts):
            own = [p for p in self.cut.split(text) if p]
            parts += own
            of += [k] * len(own)
        plain = [p for p in parts if p not in self.vocab.special]
        ids, counts = self._encode(plain)
        pieces, out, totals = iter(np.split(ids, np.cumsum(counts)[:-1])), [], np.zeros(len(texts), np.int64)
        for k, p in zip(of, parts):
            out.append(np.array([self.vocab.special[p]], np.int32) if p in self.vocab.special else next(pieces))
            totals[k] += len(out[-1])
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), totals

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        most = TABLE_CHUNKS if self.most is None else self.most
        if self.known.shape[1] > most or self.n_flat > min(TABLE_IDS, 10 * most):
            self._age()
        chunks: list[str] = []
        firsts, sizes = [], []
        for text in texts:
            own = text.replace("\n", " \n").split(" ")
            firsts.append(own[0])
            sizes.append(len(own))
            chunks += own
        sizes = np.array(sizes, np.int64)
        heads = np.cumsum(sizes) - sizes
        find = self.after_blank.get
        codes = np.fromiter(map(find, chunks, repeat(-1)), np.int64, len(chunks))
        codes[heads] = [self.other.get(x, -1) for x in firsts]
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            self._learn(chunks, codes, heads, sizes, missing)
        odd = codes < 0
        if (empty := self.other.get("", -1)) >= 0:
            odd[heads[(codes[heads] == empty) & (sizes > 1)]] = True  # a blank at the start
        if odd.any():
            whole = set((np.searchsorted(heads, np.flatnonzero(odd), side="right") - 1).tolist())
            return self._mixed(texts, whole, codes, heads, sizes)
        return self._gather(codes, heads, sizes)

    def _learn(self, chunks, codes, heads, sizes, missing) -> None:
        """Adds missing chunks to the tables and puts their codes in; those with white space at an end stay at -1."""
        find = self.after_blank.get
        of = np.searchsorted(heads, missing, side="right") - 1
        is_head = heads[of] == missing
        inner = list(map(chunks.__getitem__, missing[~is_head].tolist()))
        found = dict.fromkeys(inner)  # in the order of the texts, as they lie in memory
        new = [c for c in found if c and c == c.strip()]
        new_texts = [" " + c for c in new]
        lines = [c for c in found if c[:1] == "\n" and not _edged(c[1:])]
        self._add(True, new + lines, new_texts + lines)
        starting = missing[is_head].tolist()
        alone = {chunks[at] for at, k in zip(starting, of[is_head].tolist()) if sizes[k] == 1}
        new = [c for c in set(map(chunks.__getitem__, starting)) if not _edged(c) or (not c and c in alone)]
        self._add(False, new, new)
        codes[missing[~is_head]] = np.fromiter(map(find, inner, repeat(-1)), np.int64, len(inner))
        codes[missing[is_head]] = [self.other.get(chunks[at], -1) for at in starting]

    def _gather(self, codes, heads, sizes):
        starts, counts = self.known[0][codes], self.known[1][codes]
        edge = np.r_[0, np.cumsum(counts)]
        return _slices(self.flat, starts, counts), np.diff(edge[np.r_[heads, len(codes)]])

    def _mixed(self, texts, whole, codes, heads, sizes):
        """Texts with unusual white space go through the pattern as a whole, pre-token by pre-token."""
        split = {k: self.pattern.findall(texts[k]) for k in whole}
        names = {p: i for i, p in enumerate(dict.fromkeys(p for s in split.values() for p in s))}
        ids, starts, counts = merge_all([p.encode("utf-8", "replace") for p in names], self.vocab)
        out, totals = [], np.zeros(len(texts), np.int64)
        for k in range(len(texts)):
            if k in whole:
                own = np.fromiter(map(names.__getitem__, split[k]), np.int64, len(split[k]))
                got = _slices(ids, starts[own], counts[own])
            else:
                part = codes[heads[k] : heads[k] + sizes[k]]
                got = _slices(self.flat, self.known[0][part], self.known[1][part])
            out.append(got)
            totals[k] = len(got)
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), totals


def _edged(chunk: str) -> bool:
    """Nothing, or white space (in the widest sense) at an end."""
    return not chunk or chunk[0].isspace() or chunk[-1].isspace()


def _slices(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[start : start + count] of each, one after the other."""
    before = np.cumsum(counts) - counts
    return flat[np.repeat(starts - before, counts) + np.arange(counts.sum())]


def groups_of(texts: list[str], most: int = GROUP_CHARS):
    """Slices of consecutive texts with about ``most`` characters together, to bound memory."""
    start = chars = 0
    for k, text in enumerate(texts):
        if chars and chars + len(text) > most:
            yield start, k
            start, chars = k, 0
        chars += len(text)
    if start < len(texts):
        yield start, len(texts)


def text_groups(column: pa.Array, most: int):
    """Start, end and texts of consecutive slices of a column without nulls, of at most ``most`` bytes together or one text.
    Only one slice's texts are Python strings at a time."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, stop, column.slice(start, stop - start).to_pylist()
        start = stop


def encoded(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (array of int) of each whole text, without special tokens.

    A null text counts as the empty one, which has no ids. Rows stand for themselves: repeated ids
    give repeated rows. Further columns are ignored.
    """

    def run(batches):
        coder = Encoder(Vocabulary.ranked(vocabulary), pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups_of(texts):
                ids, counts = coder.encode(texts[a:b])
                offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["doc_id", "ids"])

    return _named(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decoded(encoded_docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id``, ``bytes`` of lists of ids: each token's bytes, one after the other. Null: no bytes."""

    def run(batches):
        vocab = Vocabulary.ranked(vocabulary)
        for batch in batches:
            lists = batch.column(1).to_pylist()
            for doc, ids in zip(batch.column(0).to_pylist(), lists):
                ids = np.array(ids or [], np.int64)
                data, _ = vocab.decoded(ids, np.array([len(ids)]))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array([doc], pa.int64()), "bytes": pa.array([data.tobytes()], pa.binary())}
                )

    return encoded_docs.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, bytes binary")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text and returns ``n_tokens`` and the digests of ids and decoded bytes,
    in one pass over the texts. Nulls and repeated rows: as ``encoded``."""

    def run(batches):
        vocab = Vocabulary.ranked(vocabulary)
        coder = Encoder(vocab, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups_of(texts):
                ids, counts = coder.encode(texts[a:b])
                data, sizes = vocab.decoded(ids, counts)
                raw, back = memoryview(ids.astype("<u4").tobytes()), memoryview(data.tobytes())
                at = np.r_[0, np.cumsum(counts)].tolist()
                to = np.r_[0, np.cumsum(sizes)].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(counts, pa.int64()),
                        pa.array([hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(at, at[1:])], pa.string()),
                        pa.array([hashlib.sha256(back[x:y]).hexdigest() for x, y in zip(to, to[1:])], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _named(docs, id_col, text_col).mapInArrow(tidy(run), schema)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
