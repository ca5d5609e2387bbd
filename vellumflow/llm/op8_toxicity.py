"""Toxicity by a weighted finite-state pattern grammar.

Letters are read by a stem transducer, words to classes: insult, harm, intent, target, negation, reported speech, other. Over
the classes of a clause runs the composition of five small weighted transducers. Insult: a word of abuse emits its weight, and
more right after another one. Threat: a word of harm emits half its weight, or three times that after words of intent, and more
where it is aimed at a target ("will ... hurt ... you"). Target: who is meant, near abuse or harm, adds weight. Negation: takes
from what follows it. Reported speech: lowers what it introduces. A document is scored by the weights of its clauses (the
heaviest, their sum, and the share of clauses with any), put through a logistic link. A clause ends at marks and line ends, but at exclamation marks only from its third word on, as shouted words have one each.

Seed stems of each class are fixed. Further insult stems are learned: prefixes that mark toxic rows among the labelled ones,
each as long as possible without losing rows, of ``LEAST_STEM`` letters at least, and counted against the other rows. About ``SAMPLE`` labelled rows of each label,
drawn by a hash over all of them, are used for fitting (a documented bound); stems of both labels are counted and chosen by rows
and odds in Spark, so what reaches the driver is bounded by the sample. Labels, language, source and identifier never enter a
score.

Defined cases
- null text is empty; an empty text, or one without words, gets the score of no matched clause.
- no labelled rows, or one label only: seed stems and fixed weights are used.
- rows of labels with null in doc_id or toxic are left out; repeated rows are repeated; ties go by stem.
- extra columns are kept by ``toxicity``; its own, score and predicted, take the place of columns of the same name.
- an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from ..sources.tables import read_table
from .alike import as_struct

SAMPLE, FOLDS, CUT = 6000, 3, 0.7
#: Learned stems: letters at most, rows at least, odds against other rows at least.
STEM, STEM_ROWS, STEM_ODDS = 12, 5, 20.0
#: Letters of a learned stem, or a whole word of one fewer: shorter ones begin too many words that no sample holds.
LEAST_STEM = 4
REMEMBERED = 500_000
CLASSES = 7
OTHER, INSULT, HARM, INTENT, TARGET, NEGATION, REPORT = range(CLASSES)

# Fixed seed stems; a stem that ends in a blank is a whole word.
SEEDS = {
    INSULT: "idiot moron stupid dumb loser scum trash pathetic worthless disgusting clown imbecile dummkopf trottel abschaum connard abruti imbécile estúpid imbécil basura ",
    HARM: "kill hurt destroy beat burn punish murder töten vernichten tuer frapper détruire matar destruir golpear ",
    INTENT: "will shall gonna going i'll we'll you'll must should deserve hope werde werden wirst sollst vais allons vas doit voy vamos vas debes ",
    TARGET: "you your yours yourself they them he him she her people du dich dir ihr euch tu toi te vous ils elles tú ti usted ustedes ellos ",
    NEGATION: (
        "not never no none nobody cannot without isn't aren't wasn't weren't don't doesn't didn't won't wouldn't can't couldn't shouldn't mustn't haven't hasn't hadn't "
        "nicht nie niemals kein keine keinen keiner nichts ohne ne n'est pas jamais aucun aucune sans rien nunca ningún ninguna jamás nadie sin tampoco "
    ),
    REPORT: "said says wrote quoted reported claimed called according sagte schrieb zitierte dit écrit selon dijo escribió según ",
}
PREFIX_SEEDS = (INSULT, HARM)  # their seeds also stand for longer words

_TOKENS = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[.!?;:\n]+")
#: Words that a clause needs for an exclamation mark to end it.
SHOUTED = 3
FEATURES = ("most", "total", "share")


def _lower(text: str) -> str:
    return text.lower().replace("’", "'")


# --- transducers ----------------------------------------------------------------------------------------------------------

_HARM = (INSULT, HARM)


@dataclass(frozen=True)
class Transducer:
    """Deterministic and weighted: (state, class) -> (state, gain, factor, addend). Missing arcs stay and change nothing.

    A word of weight w gives factor * (gain * w + addend).
    """

    arcs: dict[tuple[int, int], tuple[int, float, float, float]]

    def arc(self, state: int, symbol: int) -> tuple[int, float, float, float]:
        return self.arcs.get((state, symbol), (state, 0.0, 1.0, 0.0))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Run both over the same classes: states are pairs, gains and addends add, factors multiply. Only states that can be reached."""
    number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
    while todo:
        s, t = todo.pop()
        for symbol in range(CLASSES):
            (s2, g1, f1, w1), (t2, g2, f2, w2) = a.arc(s, symbol), b.arc(t, symbol)
            if (s2, t2) not in number:
                number[s2, t2] = len(number)
                todo.append((s2, t2))
            arcs[number[s, t], symbol] = (number[s2, t2], g1 + g2, f1 * f2, w1 + w2)
    return Transducer(arcs)


def _span(opens: int, closes: tuple[int, ...], reach: int, factor: float, addend: float) -> Transducer:
    """After ``opens``, for ``reach`` words, a word of ``closes`` gets the factor and the addend."""
    arcs: dict[tuple[int, int], tuple[int, float, float, float]] = {(s, opens): (reach, 0.0, 1.0, 0.0) for s in range(reach + 1)}
    for s in range(1, reach + 1):
        for symbol in range(CLASSES):
            if symbol != opens:
                hit = symbol in closes
                arcs[s, symbol] = (s - 1, 0.0, factor if hit else 1.0, addend if hit else 0.0)
    return Transducer(arcs)


def _insult() -> Transducer:
    """Abuse emits its weight, and 0.2 more in a row; who is meant right after it ("idiot you") adds 0.3."""
    arcs = {(s, symbol): (0, 0.0, 1.0, 0.0) for s in (0, 1) for symbol in range(CLASSES)}
    arcs |= {(0, INSULT): (1, 1.0, 1.0, 0.0), (1, INSULT): (1, 1.0, 1.0, 0.2), (1, TARGET): (0, 0.0, 1.0, 0.3)}
    return Transducer(arcs)


def _threat(reach: int = 3) -> Transducer:
    """Harm emits half its weight, or with words of intent up to ``reach`` words before it one and a half; a target up to as many words after it adds 0.3, or 0.7 where it was intended."""
    arcs: dict[tuple[int, int], tuple[int, float, float, float]] = {}
    meant, loose, aimed = 0, reach, 2 * reach  # states of intent, of harm without it and of harm with it, counting down from there
    states = range(3 * reach + 1)
    for s in states:
        waits = meant < s <= loose
        for symbol in range(CLASSES):
            down = s - 1 if s not in (0, loose + 1, aimed + 1) else 0
            arcs[s, symbol] = (down, 0.0, 1.0, 0.0)
        arcs[s, INTENT] = (loose, 0.0, 1.0, 0.0)
        arcs[s, HARM] = (3 * reach if waits else aimed, 1.5 if waits else 0.5, 1.0, 0.0)
        if s > loose:
            arcs[s, TARGET] = (0, 0.0, 1.0, 0.7 if s > aimed else 0.3)
    return Transducer(arcs)


INSULTS, THREATS = _insult(), _threat()
TARGETS = _span(TARGET, _HARM, 4, 1.0, 0.5)
NEGATIONS = _span(NEGATION, _HARM, 3, 0.4, 0.0)
REPORTS = _span(REPORT, _HARM, 12, 0.6, 0.0)
GRAMMAR = functools.reduce(compose, (INSULTS, THREATS, TARGETS, NEGATIONS, REPORTS))


def clause_weight(symbols: list[int], weights: list[float]) -> float:
    """Weight of one clause: its words by weight, read through the grammar."""
    state, total = 0, 0.0
    for symbol, weight in zip(symbols, weights, strict=True):
        state, gain, factor, addend = GRAMMAR.arc(state, symbol)
        total += factor * (gain * weight + addend)
    return total


class Stems:
    """Letters to classes: a trie whose states may accept; a word is what the longest accepted stem of it is."""

    def __init__(self, stems: dict[str, tuple[int, float]]):
        self.arcs: list[dict[str, int]] = [{}]
        self.accepts: list[tuple[int, float] | None] = [None]
        for stem, value in stems.items():
            at = 0
            for letter in stem:
                if letter not in self.arcs[at]:
                    self.arcs[at][letter] = len(self.arcs)
                    self.arcs.append({})
                    self.accepts.append(None)
                at = self.arcs[at][letter]
            self.accepts[at] = value

    def read(self, word: str) -> tuple[int, float] | None:
        """Class and weight of a word, whose end is a blank."""
        at, found = 0, None
        for letter in word + " ":
            at = self.arcs[at].get(letter, -1)
            if at < 0:
                break
            found = self.accepts[at] or found
        return found


# --- lexicon and features -------------------------------------------------------------------------------------------------


@dataclass
class Model:
    stems: dict[str, tuple[int, float]] = field(default_factory=dict)
    link: tuple[float, ...] = (-3.0, 2.0, 1.0, 1.0)


def seed_stems() -> dict[str, tuple[int, float]]:
    out: dict[str, tuple[int, float]] = {}
    for kind, words in SEEDS.items():
        for w in words.split():
            out[w if kind in PREFIX_SEEDS else w + " "] = (kind, 1.0 if kind in _HARM else 0.0)
    return out


class Reader:
    """Reads texts into clause features with a lexicon, remembering words."""

    def __init__(self, stems: dict[str, tuple[int, float]]):
        self.stems, self.known = Stems(stems), {}

    def features(self, text: str) -> tuple[float, float, float]:
        """The heaviest clause, the log of the sum of weights, and the share of clauses with weight."""
        words = _TOKENS.findall(_lower(text))
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.stems.read(w)
        found = list(map(known.__getitem__, words))
        if not any(x is not None and x[0] in _HARM for x in found):
            return 0.0, 0.0, 0.0
        most = total = 0.0
        clauses = heavy = 0
        symbols: list[int] = []
        weights: list[float] = []
        for w, x in [*zip(words, found, strict=True), (".", None)]:
            if w[0] in ".!?;:\n":
                if symbols and (len(symbols) >= SHOUTED or w.strip("!")):
                    clauses += 1
                    if any(s in _HARM for s in symbols):
                        value = max(0.0, clause_weight(symbols, weights))
                        heavy += value > 0
                        most, total = max(most, value), total + value
                    symbols, weights = [], []
            else:
                symbols.append(x[0] if x else OTHER)
                weights.append(x[1] if x else 0.0)
        return most, math.log1p(total), heavy / max(1, clauses)


def score(model: Model, features: tuple[float, ...]) -> float:
    z = model.link[0] + sum(w * x for w, x in zip(model.link[1:], features, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


# --- learning -------------------------------------------------------------------------------------------------------------


def _stems_of(text: str) -> set[str]:
    words = {w for w in _TOKENS.findall(_lower(text)) if w[0].isalnum()}
    return {(w + " ")[:n] for w in words for n in range(LEAST_STEM, min(len(w) + 1, STEM) + 1)}


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, marks, others): in how many toxic rows and in how many others of this task each stem is."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts[toxic].update(_stems_of(text))
    keys = list(counts[0] | counts[1])
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([counts[k][s] for s in keys], pa.int64()) for k in (1, 0))], ["stem", "marks", "others"])


def choose_stems(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, tuple[int, float]]:
    """Insult stems from (toxic rows, clean rows) of each candidate.

    Of prefixes of each other with equally many toxic rows the longest is as good and the most specific. Among the rest the
    ones with more toxic rows come first, and no stem is taken below one already taken.
    """
    def odds(s: str) -> float:
        t, c = counts[s]
        return (t / toxic) / ((c + 0.5) / clean)

    fit = sorted(s for s, (t, _) in counts.items() if t >= STEM_ROWS and odds(s) >= STEM_ODDS)
    longer: dict[str, int] = {}
    for s in fit:
        for n in range(LEAST_STEM, len(s)):
            if s[:n] in counts:
                longer[s[:n]] = max(longer.get(s[:n], 0), counts[s][0])
    closed = [s for s in fit if longer.get(s, 0) < counts[s][0]]
    taken: dict[str, tuple[int, float]] = {}
    for s in sorted(closed, key=lambda s: (-counts[s][0], -len(s), s)):
        if not any(s[:n] in taken for n in range(1, len(s))):
            taken[s] = (INSULT, min(3.0, math.log(odds(s)) / 2))
    # A shorter stem taken later makes those below it needless.
    return {s: v for s, v in taken.items() if not any(s[:n] in taken for n in range(1, len(s)))}


def fit_link(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge."""
    a = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = np.diag([1e-6, *[0.05] * x.shape[1]])
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def _features(sent):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for batch in batches:
            rows = [reader.features(t) for t in batch.column("text").to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(c, pa.float64()) for c in columns)], ["toxic", *FEATURES])

    return read


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """Model from documents (doc_id, text) and labels (doc_id, toxic)."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    share = known.groupBy("toxic").agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count(F.lit(1))).alias("share"))
    draw = F.xxhash64(F.lit("toxic"), "doc_id") / 2.0**64 + 0.5
    picked = materialize(known.join(materialize(share, "toxic-share"), "toxic").where(draw < F.col("share")).select("doc_id", "toxic"), "toxic-picked")
    rows = materialize(docs.select("doc_id", "text").join(picked, "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text")), "toxic-sample")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    model = Model(seed_stems())
    if len(sizes) < 2:
        return model
    counted = rows.mapInArrow(_count_stems, "stem string, marks long, others long").groupBy("stem").agg(F.sum("marks").alias("marks"), F.sum("others").alias("others"))
    odds = (F.col("marks") / sizes[1]) / ((F.col("others") + 0.5) / sizes[0])
    fit = counted.where((F.col("marks") >= STEM_ROWS) & (odds >= STEM_ODDS)).toArrow()  # stems of about ``sample`` toxic rows
    counts = dict(zip(fit["stem"].to_pylist(), zip(fit["marks"].to_pylist(), fit["others"].to_pylist(), strict=True), strict=True))
    model.stems |= choose_stems(counts, sizes[1], sizes[0])
    # The link needs a few numbers and a label of each sampled row.
    seen = rows.mapInArrow(_features(spark.sparkContext.broadcast(model.stems)), f"toxic int, {', '.join(f'{c} double' for c in FEATURES)}").toArrow()
    x = np.column_stack([seen[c].to_numpy() for c in FEATURES])
    # Sampling changed the balance of the labels; the constant undoes that.
    link = fit_link(x, seen["toxic"].to_numpy().astype(float))
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    shift = math.log(shares[1] / shares[0]) - math.log(sizes[1] / sizes[0])
    model.link = (link[0] + shift, *link[1:])
    return model


def _score(sent):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        reader = Reader(model.stems)
        for batch in batches:
            values = [score(model, reader.features(t)) for t in batch.column("text").to_pylist()]
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(values, pa.float64())], [*rest, "score"])

    return read


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` but ``text``, score and predicted, then score and predicted."""
    rest = [c for c in docs.columns if c not in ("text", "score", "predicted")]
    rows = docs.select(as_struct(rest, "row"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = f"row {rows.schema['row'].dataType.simpleString()}, score double"
    found = rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), kinds)
    return found.select(*(F.col("row")[c].alias(c) for c in rest), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 1, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, read_table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
