"""Exact token counts of every prefix, by prefix dynamic programming over a sentencepiece BPE model.

A sequence of pieces is the model's encoding of what it spells exactly if each piece encodes as itself and
each two neighbours encode as themselves. So the encoding of a prefix ends in the one piece that ends there
and goes with the last piece of the prefix before it, and its count is that prefix's count plus one:
one walk over a text gives the last piece and the count at *every* prefix, from which truncation and
budget questions are read off without encoding again. Characters without a piece count their bytes and
part what is around them.

Pieces have a word mark at their start only, so words are independent; a worker keeps the counts at every prefix of the
words seen, in a table bounded in words and in letters (longer words are walked each time). New words are walked in sorted
order, each from where it parts from the one before. A text's count is the sum
of its words' last counts; where a text has to be cut to keep a limit is read off the counts before the word that
crosses it and the stored prefixes of that word.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oakmill.llm.bpe import groups_of
from oakmill.llm.common import table, tidy, whole_text

MARK = "▁"
TABLE_WORDS, TABLE_LETTERS, WORD_LETTERS = 600_000, 12_000_000, 200
TABLE_PAIRS = 1_500_000
LIMIT = 4096


class PrefixCounter:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = (model.is_byte, model.is_control, model.is_unknown, model.is_unused)
        self.score = {
            model.id_to_piece(i): model.get_score(i)
            for i in range(model.get_piece_size())
            if not any(kind(i) for kind in kinds)
        }
        self.ends: dict[str, int] = {}  # the greatest length of a piece by its last three characters
        for piece in self.score:
            if len(piece) > 2:
                self.ends[piece[-3:]] = max(len(piece), self.ends.get(piece[-3:], 0))
        if any(MARK in piece.lstrip(MARK) for piece in self.score):
            raise ValueError("pieces of this model cross words")
        if model.encode("a", out_type=str) != [MARK + "a"] or model.encode(" a ", out_type=str) != [MARK, MARK + "a", MARK]:
            raise ValueError("this model changes white space")
        self._forget()
        self._clear()

    def _forget(self) -> None:
        """By a piece (None: no piece before), which pieces go after it and which don't, as far as asked; "": itself."""
        self.after: dict[str | None, dict] = {}
        self.pairs = 0

    def _clear(self) -> None:
        """The table: a number for each word, the count of each whole word by number, and those at its prefixes."""
        self.words: dict[str, int] = {}
        self.whole = np.zeros(0, np.int64)
        self.at: list[bytes] = []
        self.letters = 0

    @classmethod
    @functools.lru_cache(maxsize=1)
    def of(cls, path: str) -> "PrefixCounter":
        return cls(path)

    def _merged(self, text: str) -> list[str]:
        """Plain BPE of a short string: the leftmost pair of the best score merges, again and again."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _state(self, last: str | None) -> dict:
        return self.after.setdefault(last, {"": last})

    def _goes_after(self, state: dict, piece: str) -> bool:
        """Whether a piece encodes as itself, also behind the one that the state stands for."""
        if self.pairs > TABLE_PAIRS:
            self._forget()  # states in use go on with what they hold
        last = state[""]
        ok = state[piece] = self._merged(piece) == [piece] if last is None else self._merged(last + piece) == [last, piece]
        self.pairs += 1
        return ok

    def walk(self, marked: str) -> list[int]:
        """Token count at each prefix of a string that has word marks for blanks; index 0: no character."""
        return next(self.walks([marked]))

    def walks(self, words: Iterable[str]) -> Iterator[list[int]]:
        """``walk`` of each word. What a word begins with as the one before it did is not walked again, so sorted ones take least."""
        pieces, longest = self.score, self.ends.get
        before, counts, states, begins = "", [0], [self._state(None)], [0]
        for marked in words:
            same = 0
            for a, b in zip(before, marked):
                if a != b:
                    break
                same += 1
            del counts[same + 1 :], states[same + 1 :]
            while begins[-1] > same:
                begins.pop()
            begin = begins[-1]
            for i in range(same + 1, len(marked) + 1):
                j = i - longest(marked[i - 3 : i], 2)
                for j in range(j if j > begin else begin, i):
                    piece, state = marked[j:i], states[j]
                    ok = state.get(piece)
                    if ok is None and piece in pieces:
                        ok = self._goes_after(state, piece)
                    if ok:
                        counts.append(counts[j] + 1)
                        states.append(self.after.get(piece) or self._state(piece))
                        break
                else:
                    if marked[i - 1] in pieces:
                        raise AssertionError("no encoding ends here")
                    counts.append(counts[i - 1] + len(marked[i - 1].encode("utf-8", "replace")))
                    states.append(self._state(None))
                    begin = i
                    begins.append(i)
            before = marked
            yield counts.copy()

    def prefixes(self, text: str) -> list[int]:
        """Token count of ``text[:i]`` for each i from 0 to its length."""
        counts, total = [0], 0
        for word in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK)) if text else ():
            own = self.walk(word)
            counts += [total + c for c in own[1:]]
            total += own[-1]
        return [0, *counts[2:]]  # the mark before the text is no prefix of it

    def counts(self, texts: list[str], limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Token count of each text, and how many characters of it, at most, encode to ``limit`` tokens."""
        if len(self.words) > TABLE_WORDS or self.letters > TABLE_LETTERS:
            self._clear()
        words: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            own = text.split(" ")
            if "" in own or MARK in text:  # runs of blanks belong to the word after them
                own = [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))] if text else []
            words += own
            sizes[k] = len(own)
        place = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(place < 0).tolist()
        long: dict[str, list[int]] = {}
        new = []
        unknown = sorted(set(map(words.__getitem__, missing)))
        for word, own in zip(unknown, self.walks(MARK + word for word in unknown)):
            if len(word) > WORD_LETTERS:
                long[word] = own
            else:
                self.words[word] = len(self.at)
                self.at.append(array("H", own).tobytes())
                self.letters += len(word)
                new.append(own[-1])
        self.whole = np.concatenate([self.whole, np.array(new, np.int64)])
        place[missing] = [self.words.get(words[k], -1) for k in missing]
        found = self.whole[place] if len(self.whole) else np.zeros(len(words), np.int64)
        for k in missing if long else ():
            if words[k] in long:
                found[k] = long[words[k]][-1]
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(len(texts), np.int64)
        full = sizes > 0
        out[full] = np.add.reduceat(found, starts[full]) if full.any() else 0
        within = np.fromiter(map(len, texts), np.int64, len(texts))
        for k in np.flatnonzero(out > limit).tolist() if limit is not None else ():
            a, b = int(starts[k]), int(starts[k] + sizes[k])
            before = np.cumsum(found[a:b]) - found[a:b]
            last = int(np.searchsorted(before, limit, side="right")) - 1
            word = words[a + last]
            own = long.get(word) or array("H", self.at[self.words[word]]).tolist()
            fits = max(i for i, c in enumerate(own) if before[last] + c <= limit)
            first = sum(len(w) + 1 for w in words[a : a + last]) - 1  # the mark before the text is no character
            within[k] = max(0, first + fits)
        return out, within


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each whole text, and ``limit_chars``: how many of its characters, at
    most, encode to ``limit`` tokens (all of them, if the text isn't over the limit).

    A null text counts as the empty one: no bytes, no tokens. Rows stand for themselves. Other columns of
    ``docs`` are ignored.
    """

    def run(batches):
        counter = PrefixCounter.of(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups_of(texts):
                n, within = counter.counts(texts[a:b], limit)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.array(n),
                        pa.array(n > limit),
                        pa.array(within),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"],
                )

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    named = named.withColumn("n_bytes", F.octet_length("text").cast("long"))
    return named.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")


def prefix_table(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, counts``: the token count of every prefix of the text, from no character to all.

    Held as a column it answers later questions; see ``longest_within`` and ``tokens_at``.
    """

    def run(batches):
        counter = PrefixCounter.of(model)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array([doc], pa.int64()), "counts": pa.array([counter.prefixes(text)], pa.list_(pa.int32()))}
                )

    named = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return named.mapInArrow(tidy(run), "doc_id long, counts array<int>")


def longest_within(budget):
    """Column over ``prefix_table``: the most characters that encode to at most ``budget`` tokens."""
    return F.array_max(F.transform("counts", lambda c, i: F.when(c <= budget, i).otherwise(0)))


def tokens_at(chars):
    """Column over ``prefix_table``: the token count of the first ``chars`` characters."""
    return F.try_element_at("counts", F.lit(chars) + 1)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token_counts`` of all documents: a null text is the empty one, repeated rows stand for themselves, other columns are
    ignored, an empty table gives no rows."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
