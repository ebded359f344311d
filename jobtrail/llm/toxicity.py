"""Toxicity by a weighted finite-state pattern grammar.

Words become classes (insult, threat, target, negation, reported speech, clause end, other), and small transducers
read the classes of a clause in order. Three of them say whether a target, a negation or a verb of reported speech
stood a few words before; one waits a few words after an insult or a threat for its target, and then gives the match.
Their composition is one automaton, built as its states are met. A clause is as its plainest match: the probability,
learned from labelled texts, that a text with such a clause is toxic, is the weight of that kind of match. The kinds
that a text holds are combined as independent causes (noisy or), each once, since the weights are those of texts.

The insults are learned: whole words and word beginnings that occur in toxic labelled texts and hardly in others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import slices, texts_of

# Labelled training rows used at most; beyond it those of smallest hash.
TRAINING_ROWS = 200_000
# Word beginnings tried, in letters.
SHORTEST, LONGEST = 4, 8
# A sign of toxicity occurs in this share of the toxic training texts at least, and hardly in others.
SUPPORT, LEAST_TEXTS, PRECISION = 0.02, 6, 0.97
TOXIC = 0.7
# Words that a target, a negation and a verb of reported speech reach ahead; words that a match waits for its target.
NEAR, NEGATED, REPORTED = 5, 4, 6

# Function words of the grammar, in the languages of the corpus.
THREATS = "kill hurt destroy beat shoot stab burn töten umbringen verletzen schlagen tuer frapper brûler détruire matar golpear quemar destruir"
TARGETS = "you your he she they him her them du dich dir ihr euch er sie tu te toi vous il elle ils usted ustedes tú él ella ellos"
NEGATIONS = "not no never neither nor nicht kein keine nie ne pas jamais aucun nunca jamás ningún ninguna"
REPORTS = "said says saying wrote writes quoted called calls sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó"

TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
INSULT, THREAT, TARGET, NEGATION, REPORT, END, OTHER = b"ihtnre."
FIXED = {
    **{w: THREAT for w in THREATS.split()},
    **{w: TARGET for w in TARGETS.split()},
    **{w: NEGATION for w in NEGATIONS.split()},
    **{w: REPORT for w in REPORTS.split()},
    **{c: END for c in ".!?;\n"},
}


# A kind of match: the sum of what it holds.
PARTS = {INSULT: 1, THREAT: 2, TARGET: 4, NEGATION: 8, REPORT: 16}


@dataclass(frozen=True)
class Scope:
    """A transducer that gives its mark for the next ``width`` words after a word of its class; its state counts them down."""

    symbol: int
    width: int

    def step(self, state: int, c: int) -> tuple[int, int]:
        given = PARTS[self.symbol] if state else 0
        return (self.width if c == self.symbol else max(state - 1, 0)), given


SCOPES = (Scope(TARGET, NEAR), Scope(NEGATION, NEGATED), Scope(REPORT, REPORTED))


def _match(state: tuple[int, int], c: int, marks: int) -> tuple[tuple[int, int], int]:
    """The transducer of matches: (kind that waits for a target, words it still waits) -> the same, and the kind given.

    A threat without a target is no match.
    """
    kind, wait = state
    given = 0
    if kind:
        if c == TARGET:
            kind |= PARTS[TARGET]
        if c in (INSULT, THREAT, TARGET, END) or wait == 1:
            given = kind if kind & PARTS[INSULT] or kind & PARTS[TARGET] else 0
            kind = 0
        wait -= 1
    if c in (INSULT, THREAT):
        kind, wait = PARTS[c] | marks, NEAR
    return ((kind, wait) if kind else (0, 0)), given


class Machine(dict):
    """The composition of the scopes with the transducer of matches: (state, class) -> (state, kind given or 0)."""

    START = ((0,) * len(SCOPES), (0, 0))

    def __missing__(self, at):
        (scopes, match), c = at
        steps = [s.step(state, c) for s, state in zip(SCOPES, scopes)]
        after, given = _match(match, c, sum(mark for _, mark in steps))
        self[at] = value = ((tuple(state for state, _ in steps), after), given)
        return value


MACHINE = Machine()


def matches(clause: bytes) -> set[int]:
    """The kinds of matches in one clause."""
    state, found = Machine.START, set()
    for c in clause + bytes([END]):
        state, kind = MACHINE[state, c]
        found.add(kind)
    return found - {0}


def clauses(classes: bytes) -> Counter[int]:
    """How many clauses of each kind there are; a clause is of the kind of its plainest match.

    Matches neither negated nor reported come first, then those with a target, then insults.
    """
    found: Counter[int] = Counter()
    if INSULT not in classes and THREAT not in classes:
        return found
    for clause in classes.split(bytes([END])):
        if (INSULT in clause or THREAT in clause) and (kinds := matches(clause)):
            found[max(kinds, key=lambda k: (not k & 24, k & 4, k & 1, -k))] += 1
    return found


@dataclass
class Model:
    """words and beginnings: the learned insults; kinds: probability by kind of clause; base: without any clause."""

    words: frozenset[str] = frozenset()
    beginnings: frozenset[str] = frozenset()
    kinds: dict[int, float] = field(default_factory=dict)
    base: float = 0.0

    def probability(self, kind: int) -> float:
        # A kind never seen falls back to the kind without target, negation and report, then to an even chance.
        return self.kinds.get(kind, self.kinds.get(kind & 3, 0.5))

    def score(self, kinds: dict[int, int]) -> float:
        clean = 1 - self.base
        for kind in kinds:
            clean *= 1 - self.probability(kind)
        return 1 - clean


class Classes(dict):
    """The class of each word, kept for those met so far up to a bound."""

    KEPT = 300_000

    def __init__(self, model: Model):
        super().__init__(FIXED)
        self.model = model

    def __missing__(self, word: str) -> int:
        learned = word in self.model.words or any(word[:k] in self.model.beginnings for k in range(SHORTEST, min(LONGEST, len(word)) + 1))
        value = INSULT if learned else OTHER
        if len(self) < self.KEPT and len(word) < 64:
            self[word] = value
        return value

    def of(self, text: str) -> bytes:
        return bytes(map(self.__getitem__, TOKEN.findall(text.lower())))


def _signs(text: str) -> set[str]:
    """The words of a text, marked with =, and their beginnings."""
    words = set(TOKEN.findall(text.lower()))
    return {"=" + w for w in words if w[0].isalpha()} | {w[:k] for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the labelled documents of the training folds.

    About TRAINING_ROWS labels at most: beyond that, those whose hash is small enough. The labels are broadcast, so
    the texts are not shuffled. A document labelled twice counts as toxic if one label says so.
    """
    folds = labels.where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    known = folds.groupBy("doc_id").agg(F.max("toxic").cast("bigint").alias("toxic"))
    share = min(1.0, TRAINING_ROWS / max(1, folds.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    return texts.join(F.broadcast(known), "doc_id").select("text", "toxic")


def learn(training: DataFrame) -> Model:
    """Fit the insults and the probabilities of the kinds of clauses, counted by texts. Without toxic texts nothing is an insult."""

    def counted(wanted: frozenset[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n: Counter[str] = Counter()
            for batch in batches:
                for part in slices(batch, "text"):
                    for t in texts_of(part):
                        n.update(_signs(t) if wanted is None else wanted.intersection(_signs(t)))
                        n[""] += 1  # the number of texts
            yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), pa.int64())], names=["sign", "n"])

        return run

    def counts(label: int, wanted: frozenset[str] | None = None) -> DataFrame:
        texts = training.where(F.col("toxic") == label)
        return texts.mapInArrow(counted(wanted), "sign string, n bigint").groupBy("sign").agg(F.sum("n").alias("n"))

    found = counts(1)
    toxic = found.where("sign = ''").collect()
    if not toxic:
        return Model()
    # A text has so many signs on average that few can be in a fiftieth of the texts: a short list.
    n1 = {r.sign: r.n for r in found.where(F.col("n") >= max(LEAST_TEXTS, SUPPORT * toxic[0].n)).collect() if r.sign}
    n0 = {r.sign: r.n for r in counts(0, frozenset(n1)).collect()}
    good = [(n - 20 * n0.get(s, 0), len(s), s) for s, n in n1.items() if n >= PRECISION * (n + n0.get(s, 0))]
    model = _lexicon([s for *_, s in sorted(good, reverse=True)])

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(model)
        n: Counter[tuple[int, int]] = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for t, y in zip(texts_of(part), part.column("toxic").to_pylist()):
                    n.update((k, y) for k in clauses(classes.of(t)) or [-1])
        columns = [pa.array(v, pa.int64()) for v in ([k for k, _ in n], [y for _, y in n], list(n.values()))]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "toxic", "n"])

    cells = training.mapInArrow(kinds, "kind bigint, toxic bigint, n bigint").groupBy("kind", "toxic").agg(F.sum("n").alias("n"))
    of = Counter({(r.kind, r.toxic): r.n for r in cells.collect()})  # 18 kinds and none
    model.kinds = {k: (of[k, 1] + 1) / (of[k, 1] + of[k, 0] + 2) for k in {k for k, _ in of}}
    model.base = model.kinds.pop(-1, 0.0)
    return model


def _lexicon(signs: list[str]) -> Model:
    """Signs, best first, without those that a better one already covers or only shortens."""
    kept: list[str] = []
    for sign in signs:
        bare = sign.removeprefix("=")
        if not any(bare.startswith(k) if k[0] != "=" else k[1:].startswith(bare) for k in kept) and not any(k.startswith(bare) for k in kept if k[0] != "="):
            kept.append(sign)
    return Model(frozenset(k[1:] for k in kept if k[0] == "="), frozenset(k for k in kept if k[0] != "="))


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, n_clauses) per row: the score, 0 to 1, and how many clauses matched. Null texts are empty ones.

    Rows are independent: repeated rows give repeated results, an empty table none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(model)
        for batch in batches:
            for part in slices(batch, "_text"):
                found = [clauses(classes.of(t)) for t in texts_of(part, "_text")]
                scores = pa.array([model.score(f) for f in found], pa.float64())
                matched = pa.array([sum(f.values()) for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), scores, matched], names=[key, "score", "n_clauses"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, score double, n_clauses bigint")


def keep_clean(docs: DataFrame, model: Model, threshold: float = TOXIC) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns; null texts are kept if empty ones are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(model)
        for batch in batches:
            for part in slices(batch, "text"):
                keep = [model.score(clauses(classes.of(t))) < threshold for t in texts_of(part)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
