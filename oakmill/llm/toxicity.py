"""Toxicity by a weighted finite-state pattern grammar over clauses.

Three layers of finite-state machines:

* a *term transducer*, a trie over the letters of a word, turns words into symbols: insult and threat
  (with a weight), target, negation, reported speech. Short seed lists in four languages give the
  closed-class symbols; insult terms, whole words or word beginnings, and all their weights are learned
  from labelled texts as smoothed log-odds.
* a *clause machine*, the product (``compose``) of an insult, a threat, a target, a negation and a reported-speech
  transducer, reads the symbols of one clause. At an insult or threat its state says whether the weight is negated,
  reported or open; at the clause's end its state says whether the clause matched (an insult or a threat) and whether
  what is open is aimed at a target, named before or after it, or plain. A threat without a target counts a
  fifth. Clause marks reset the machine, a long gap resets negation.
* a *document score*: each clause's weight saturates by channel, the channels are summed over clauses, and
  a logistic model fitted to the same labelled texts (cross-fitted: terms of one half score the other)
  weighs the channels.

Only the fit sees labels, of at most ``TOXIC_TEXTS`` + ``CLEAN_TEXTS`` texts picked by hash; near copies
among them support a term once. Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oakmill.llm.bpe import groups_of
from oakmill.llm.common import table, tidy, whole_text

TOXIC_TEXTS, CLEAN_TEXTS, TERMS = 1500, 4500, 6000
THRESHOLD = 0.7
GAP = 5
TABLE_CHUNKS = 300_000
WORD = regex.compile(r"[\p{L}\p{M}]+")
CLAUSE_END = frozenset(".!?;:,|()\"«»“”…")
INSULT, THREAT, TARGET, NEGATION, REPORT, FAR, END = range(7)
CHANNELS = ("aimed", "plain", "negated", "reported")

SEEDS = {
    THREAT: "kill hurt destroy beat strangle shoot stab tuer frapper détruire étrangler töten umbringen schlagen zerstören matar golpear destruir",
    TARGET: "you your yours he him she they them these those people toi vous ils elles eux du dich euch ihr sie tú usted ustedes ellos ellas",
    NEGATION: "not no never nobody without isn aren wasn don doesn didn ne pas jamais sans aucun nicht kein keine nie ohne nunca jamás sin ningún",
    REPORT: "said says wrote writes quoted quote called claims claimed reported dit écrit cité appelle sagte schrieb zitierte nannte dijo escribió citó llamó",
}
INSULT_SEEDS = """idiot moron stupid imbecile scum fool dumb loser jerk clown pathetic worthless disgusting trash garbage filth vermin
    imbécile crétin abruti ordure minable dummkopf trottel abschaum versager idiota imbécil estúpido basura inútil""".split()
SEED_WEIGHT = {INSULT: 2.0, THREAT: 1.0}


@dataclass(frozen=True)
class Machine:
    """A finite-state machine over symbols: ``step[state][symbol]`` is the next state."""

    step: tuple[tuple[int, ...], ...]


def _switch(on: int, off: tuple[int, ...]) -> Machine:
    """Two states: ``on`` switches to 1, symbols in ``off`` to 0, others stay."""
    row = lambda s: tuple(1 if x == on else 0 if x in off else s for x in range(END + 1))
    return Machine((row(0), row(1)))


INSULTS, THREATS, TARGETS, REPORTS = (_switch(x, (END,)) for x in (INSULT, THREAT, TARGET, REPORT))
NEGATIONS = _switch(NEGATION, (FAR, END))
IDLE_THREAT = 0.2


def compose(*machines: Machine) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """The product machine: its steps as a matrix [state, symbol], and each state's parts."""
    states = list(product(*(range(len(m.step)) for m in machines)))
    number = {s: i for i, s in enumerate(states)}
    step = [[number[tuple(m.step[s][x] for m, s in zip(machines, state))] for x in range(END + 1)] for state in states]
    return np.array(step), states


STEP, STATES = compose(INSULTS, THREATS, TARGETS, NEGATIONS, REPORTS)
#: By state: where a weight goes that is read there, and what the clause is at its end.
OPEN = CHANNELS.index("plain")
CHANNEL = [2 if negated else 3 if reported else OPEN for _, _, _, negated, reported in STATES]
MATCHED = [bool(insult or threat) for insult, threat, *_ in STATES]
AIMED = [bool(state[2]) for state in STATES]
_STEP = STEP.tolist()


class Terms:
    """The term transducer: a trie whose nodes hold the weight of a word beginning and the symbol of a whole word."""

    def __init__(self, whole: dict[str, tuple[int, float]], beginnings: dict[str, float]):
        self.whole, self.beginnings = whole, beginnings
        self.steps: list[dict[str, int]] = [{}]
        self.begun, self.ended = [0.0], [None]
        for start, weight in beginnings.items():
            self.begun[self._node(start)] = weight
        for word, hit in whole.items():
            self.ended[self._node(word)] = hit

    def _node(self, text: str) -> int:
        at = 0
        for letter in text:
            if letter not in self.steps[at]:
                self.steps[at][letter] = len(self.steps)
                self.steps.append({})
                self.begun.append(0.0)
                self.ended.append(None)
            at = self.steps[at][letter]
        return at

    def of(self, word: str) -> tuple[int, float] | None:
        """The symbol and weight of a word, in one walk: the heaviest insult it is or begins with, else its symbol."""
        at, weight, found = 0, 0.0, None
        for letter in word:
            at = self.steps[at].get(letter)
            if at is None:
                break
            weight = max(weight, self.begun[at])
        else:
            found = self.ended[at]
        if found and found[0] == INSULT:
            weight = max(weight, found[1])
        return (INSULT, weight) if weight else found

    @classmethod
    def seeded(cls) -> "Terms":
        whole = {w: (symbol, SEED_WEIGHT.get(symbol, 0.0)) for symbol, words in SEEDS.items() for w in words.split()}
        return cls(whole | {w: (INSULT, SEED_WEIGHT[INSULT]) for w in INSULT_SEEDS}, {})


class Reader:
    """Turns texts into channel features; what a chunk of text means is kept in a bounded table."""

    def __init__(self, terms: Terms):
        self.terms = terms
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.kinds: list[tuple[tuple[tuple[int, float, str], ...], bool]] = [((), False), ((), True)]
        self.ends = [False, True]

    def _code(self, chunk: str) -> int:
        symbols = tuple((*hit, w) for w in WORD.findall(chunk.lower()) if (hit := self.terms.of(w)))
        end = chunk[-1] in CLAUSE_END
        if not symbols:
            return int(end)
        self.kinds.append((symbols, end))
        self.ends.append(end)
        return len(self.kinds) - 1

    def features(self, texts: list[str]) -> np.ndarray:
        """A row for each text: log1p of each channel's clause weights, of matched clauses, of different
        terms, and of matched weight per thousand words."""
        if len(self.codes) > TABLE_CHUNKS:
            self._clear()
        chunks: list[str] = []
        sizes = []
        for text in texts:
            own = text.replace("\n", " | ").split()
            chunks += own
            sizes.append(len(own))
        codes = np.fromiter(map(self.codes.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(codes < 0).tolist()
        for chunk in set(map(chunks.__getitem__, missing)):
            self.codes[chunk] = self._code(chunk)
        codes[missing] = [self.codes[chunks[k]] for k in missing]
        ends = np.array(self.ends)[codes] if len(codes) else np.zeros(0, bool)
        clause = np.cumsum(ends) - ends
        starts = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        hits = np.flatnonzero(codes > 1)
        where = np.searchsorted(hits, starts)
        out = np.zeros((len(texts), len(CHANNELS) + 3))
        for k in range(len(texts)):
            own = hits[where[k] : where[k + 1]]
            if len(own):
                out[k] = self._read(own.tolist(), codes[own].tolist(), clause[own].tolist(), sizes[k])
        return out

    def _read(self, places, codes, clauses, size) -> list[float]:
        kinds = self.kinds
        if not any(s[0] <= THREAT for c in codes for s in kinds[c][0]):
            return [0.0] * (len(CHANNELS) + 3)
        total, matched, terms = [0.0] * len(CHANNELS), 0, set()
        state, now, before = 0, clauses[0], places[0]
        insults, threats = [0.0] * len(CHANNELS), [0.0] * len(CHANNELS)

        def close() -> None:
            nonlocal matched, insults, threats
            if MATCHED[state]:
                matched += 1
                sums = [i + IDLE_THREAT * t for i, t in zip(insults, threats)]
                if AIMED[state]:
                    sums[0], sums[OPEN] = insults[OPEN] + threats[OPEN], 0.0
                for i, w in enumerate(sums):
                    total[i] += min(w, 8.0)
                insults, threats = [0.0] * len(CHANNELS), [0.0] * len(CHANNELS)

        for place, code, clause in zip(places, codes, clauses):
            if clause != now:
                close()
                state, now = _STEP[state][END], clause
            elif place - before > GAP:
                state = _STEP[state][FAR]
            before = place
            for symbol, weight, word in kinds[code][0]:
                if symbol == INSULT:
                    insults[CHANNEL[state]] += weight
                    terms.add(word)
                elif symbol == THREAT:
                    threats[CHANNEL[state]] += weight
                state = _STEP[state][symbol]
        close()
        values = [*total, matched, len(terms), 1000 * sum(total) / size]
        return [float(np.log1p(v)) for v in values]


@dataclass
class Model:
    terms: Terms
    weights: np.ndarray
    bias: float

    def score(self, reader: Reader, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(reader.features(texts) @ self.weights + self.bias, -30, 30)))


def _families(texts: list[str]) -> np.ndarray:
    """A number for each text, shared by near copies: equal least hashes of five-word shingles, under any of
    three hash functions, put texts together."""
    root = list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    seen: dict[tuple[int, int], int] = {}
    for k, text in enumerate(texts):
        w = text.lower().split()
        h = np.array([zlib.crc32(" ".join(w[i : i + 5]).encode("utf-8", "replace")) for i in range(max(1, len(w) - 4))], np.uint64)
        for salt, odd in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
            least = int(((h * np.uint64(odd)) & np.uint64(0xFFFFFFFF)).min())
            root[find(k)] = find(seen.setdefault((salt, least), k))
    return np.array([find(k) for k in range(len(texts))])


def _learn_terms(texts: list[str], toxic: np.ndarray, family: np.ndarray) -> Terms:
    """Terms whose odds in toxic texts are clearly above those in clean ones. A term counts once for each family;
    families are read one after the other, so that only counts are held."""
    members: dict[int, list[int]] = {}
    for k, f in enumerate(family.tolist()):
        members.setdefault(f, []).append(k)

    def of_families(label: int):
        for own in members.values():
            if mine := [k for k in own if toxic[k] == label]:
                yield {w for k in mine for w in WORD.findall(texts[k].lower())}

    with_term: tuple[Counter, Counter] = (Counter(), Counter())
    totals = [0, 0]
    for words in of_families(1):
        totals[1] += 1
        with_term[0].update({w[:n] for w in words for n in range(4, len(w) + 1)})
        with_term[1].update(words)
    least = max(3, 0.003 * totals[1])
    kept = [{t: n for t, n in terms.items() if n >= least} for terms in with_term]
    del with_term
    clean: list[Counter] = [Counter(), Counter()]
    for words in of_families(0):
        totals[0] += 1
        begins = {w[:n] for w in words for n in range(4, len(w) + 1)}
        clean[0].update(begins & kept[0].keys())
        clean[1].update(words & kept[1].keys())
    scored = []
    for i in (0, 1):
        for term, p in kept[i].items():
            odds = np.log((p + 0.3) / (totals[1] + 0.6)) - np.log((clean[i][term] + 0.3) / (totals[0] + 0.6))
            spread = np.sqrt(1 / (p + 0.3) + 1 / (clean[i][term] + 0.3))
            if odds > 1.8 and odds > 1.6 * spread:
                scored.append((p * odds, i, term, float(min(6.0, odds))))
    scored = sorted(scored, reverse=True)[:TERMS]
    seeds = Terms.seeded()
    whole = dict(seeds.whole) | {term: (INSULT, w) for _, i, term, w in scored if i == 1}
    return Terms(whole, {term: w for _, i, term, w in scored if i == 0})


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Terms and channel weights from labelled texts. With one class only, seeds and default weights stay."""
    y = np.array(toxic, np.int64)
    default = np.array([1.5, 1.0, 0.2, 0.2, 0.3, 0.5, 0.3])
    if len(set(y.tolist())) < 2:
        return Model(Terms.seeded(), default, -3.0)
    family = _families(texts)
    half = np.array([zlib.crc32(b"%d" % f) & 1 for f in family])
    x = np.zeros((len(texts), len(default)))
    for side in (0, 1):
        use, test = np.flatnonzero(half != side), np.flatnonzero(half == side)
        if len(use) and len(test):
            reader = Reader(_learn_terms([texts[k] for k in use], y[use], family[use]))
            held = [texts[k] for k in test]
            x[test] = np.concatenate([reader.features(held[a:b]) for a, b in groups_of(held, 500_000)])
    design = np.c_[x, np.ones(len(x))]
    share = 1 / np.bincount(family)[family]  # near copies count as one together
    prior = np.r_[default, -3.0]

    def loss(beta) -> float:
        z = np.clip(design @ beta, -30, 30)
        return float((share * (np.logaddexp(0, z) - y * z)).sum() + 0.25 * ((beta - prior) ** 2).sum())

    beta = prior
    for _ in range(50):  # damped Newton steps of a logistic fit that leans to the default weights
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (share * (p - y)) + 0.5 * (beta - prior)
        curve = (design * (share * p * (1 - p))[:, None]).T @ design + 0.5 * np.eye(len(beta))
        move, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-4 and loss(beta - size * move) > loss(beta):
            size /= 2
        beta = beta - size * move
        if np.abs(size * move).max() < 1e-6:
            break
    return Model(_learn_terms(texts, y, family), beta[:-1], float(beta[-1]))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on labelled rows outside the held-out third: at most ``TOXIC_TEXTS`` and ``CLEAN_TEXTS`` of them,
    least hashes of the id first. A row with a null id or label is not used; of several labels of an id
    the largest counts, of several texts the least."""
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    pick = None
    for y, most in ((1, TOXIC_TEXTS), (0, CLEAN_TEXTS)):
        part = marked.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        pick = part if pick is None else pick.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = texts.join(F.broadcast(pick), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def one(batches):
        data = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit([r[1] for r in data], [r[2] for r in data]))]})

    made = rows.repartition(1).mapInArrow(tidy(one), "model binary").collect()  # a bounded sample, in one task
    return pickle.loads(made[0]["model"]) if made else fit([], [])


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``, from its text only.

    A null or empty text has the score of a text without matches. Rows stand for themselves, repeated
    or not; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        reader = Reader(shared.value.terms)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups_of(texts):
                score = shared.value.score(reader, texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.array(score, pa.float64()),
                        pa.array((score >= threshold).astype(np.int32)),
                    ],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), held_out().alias("held_out"))
    return named.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score is below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = Reader(shared.value.terms)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keep = np.zeros(len(texts), bool)
            for a, b in groups_of(texts):
                keep[a:b] = shared.value.score(own, texts[a:b]) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(tidy(run), docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents with a model fitted to the labels outside the held-out third. A null or empty text has the score
    of a text without matches; a repeated row has its twin's score; other columns than doc_id and text are ignored."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
