"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on each text. Votes are counted by pattern over all rows, and
expectation-maximisation over the patterns estimates how each labeller votes on good and on bad texts and how common
good ones are, which gives each pattern a posterior. Posteriors are the targets of a linear scorer over hashed words,
word shapes and repetitions, trained on a bounded, documented sample (the TRAIN_ROWS distinct rows with the smallest
hashes of identifier and text) and applied to the whole text of every row. No human label is read. The driver gets the
sample's hashed features, N_WEIGHTS + 2 numbers a row at most, and never a text.

Defined results: a null or blank text has no votes but bad and score 0; if all labellers abstain the posterior is the
share of good texts; equal texts are scored alike, whatever their identifiers; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.common import trimmed

#: Rows that the scorer is trained on, at most, and its number of hashed weights.
TRAIN_ROWS, N_WEIGHTS = 4_000, 1 << 14
BAD, ABSTAIN, GOOD = 0, 1, 2
_REPEAT_WEIGHT, _BIAS = N_WEIGHTS, N_WEIGHTS + 1
#: Words whose weights a worker keeps.
_CACHE_WORDS = 300_000
_RUN = re.compile(r"([^\w\s])\1")


def _band(value: float, good_to: float, bad_from: float) -> int:
    """Good up to one bound, bad from another, abstaining between."""
    return GOOD if value <= good_to else BAD if value >= bad_from else ABSTAIN


@dataclass
class Facts:
    """What the labellers look at: one pass over a text's words."""

    text: str
    words: list[str]
    repeats: int
    top_share: float

    @staticmethod
    def of(text: str) -> Facts:
        words = text.split()
        top = max(Counter(words).values()) / len(words) if words else 1.0
        return Facts(text, words, sum(map(eq, words, words[1:])), top)


def by_symbols(f: Facts) -> int:
    odd = sum(map(f.text.count, "#$%&*!|~^<>{}=\\"))
    return ABSTAIN if len(f.text) < 20 else _band(odd / len(f.text), 0.02, 0.06)


def by_repeated_words(f: Facts) -> int:
    return ABSTAIN if len(f.words) < 8 else _band(f.repeats / len(f.words), 0.05, 0.2)


def by_repeated_sentences(f: Facts) -> int:
    sentences = [s for s in map(str.strip, f.text.split(".")) if s]
    return ABSTAIN if len(sentences) < 6 else _band(1 - len(set(sentences)) / len(sentences), 0.2, 0.5)


def by_capitals(f: Facts) -> int:
    letters = len(f.text) - f.text.count(" ")
    return ABSTAIN if letters < 20 else _band(sum(map(str.isupper, f.text)) / letters, 0.15, 0.4)


def by_word_length(f: Facts) -> int:
    mean = sum(map(len, f.words)) / len(f.words) if f.words else 0.0
    return BAD if mean < 1.5 or mean > 20 else ABSTAIN


def by_punctuation_runs(f: Facts) -> int:
    return ABSTAIN if len(f.words) < 4 else _band(len(_RUN.findall(f.text)) / len(f.words), 0.03, 0.15)


def by_top_word(f: Facts) -> int:
    return ABSTAIN if len(f.words) < 12 else _band(f.top_share, 0.15, 0.3)


LABELLERS = (by_symbols, by_repeated_words, by_repeated_sentences, by_capitals, by_word_length, by_punctuation_runs, by_top_word)


def votes_of(text: str | None) -> str:
    """A digit a labeller: 0 bad, 1 abstains, 2 good."""
    if not text or not text.strip():
        return str(BAD) * len(LABELLERS)
    facts = Facts.of(text)
    return "".join(str(labeller(facts)) for labeller in LABELLERS)


def fit_labellers(patterns: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of good by pattern, and P(vote | class) by labeller: [labeller, class, vote]. An abstention says nothing.

    Labellers look for different defects, so their votes aren't independent given that a text is bad. Bad is therefore a
    mixture with a part for each labeller, which starts from the texts that this labeller calls bad.
    """
    n_labellers = len(LABELLERS)
    if not patterns:
        return {}, np.zeros((n_labellers, 2, 3))
    keys = sorted(patterns)
    votes = np.array([[int(c) for c in key] for key in keys])
    n = np.array([patterns[key] for key in keys], dtype=float)
    accused = (votes == BAD).astype(float)
    any_bad = accused.any(axis=1, keepdims=True)
    parts = np.where(any_bad, 0.98 * accused / np.maximum(accused.sum(axis=1, keepdims=True), 1), 0.02 / n_labellers)
    member = np.concatenate([np.where(any_bad, 0.02, 0.98), parts], axis=1).T  # [good or part of bad, pattern]
    chosen = np.eye(3)[votes]  # [pattern, labeller, vote]
    said = chosen.copy()
    said[:, :, ABSTAIN] = 0
    prior = np.full((n_labellers + 1, n_labellers, 3), 0.5)
    prior[0, :, GOOD] = 2.0
    prior[np.arange(1, n_labellers + 1), np.arange(n_labellers), BAD] = 2.0
    for _ in range(rounds):
        held = member * n
        table = np.einsum("cp,plv->clv", held, said) + prior
        table /= table.sum(axis=2, keepdims=True)
        share = (held.sum(axis=1) + 1) / (n.sum() + n_labellers + 1)
        log = np.log(share)[:, None] + np.einsum("clv,plv->cp", np.log(table), said)
        new = np.exp(log - log.max(axis=0))
        new /= new.sum(axis=0)
        done = np.abs(new - member).max() < 1e-9
        member = new
        if done:
            break
    classes = np.stack([1 - member[0], member[0]]) * n
    accuracies = np.einsum("cp,plv->lcv", classes, chosen)
    accuracies /= np.maximum(accuracies.sum(axis=2, keepdims=True), 1e-12)
    return dict(zip(keys, member[0].tolist(), strict=True)), accuracies


def word_slots(word: str) -> tuple[int, int]:
    """Hashed slots of a word and of its shape: the kinds of its characters, runs of a kind once."""
    kinds = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in word]
    shape = "".join(k for k, before in zip(kinds, ["", *kinds], strict=False) if k != before)
    return zlib.crc32(word.encode()) % N_WEIGHTS, zlib.crc32(b"shape " + shape.encode()) % N_WEIGHTS


def features(text: str) -> dict[int, float]:
    words = text.split()
    if not words:
        return {_BIAS: 1.0}
    tally: Counter[int] = Counter()
    for word, n in Counter(words).items():
        for slot in word_slots(word):
            tally[slot] += n
    found = {slot: n / len(words) for slot, n in tally.items()}
    found[_REPEAT_WEIGHT] = sum(map(eq, words, words[1:])) / len(words)
    found[_BIAS] = 1.0
    return found


def train_scorer(rows: list[dict[int, float]], targets: list[float], rounds: int = 300, rate: float = 4.0, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on features and soft targets, by full gradient steps scaled by each weight's past gradients."""
    weights = np.zeros(N_WEIGHTS + 2)
    if not rows:
        return weights
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    slot = np.array([s for r in rows for s in r])
    value = np.array([v for r in rows for v in r.values()])
    target, past = np.array(targets), np.full(len(weights), 1e-8)
    for _ in range(rounds):
        margin = np.bincount(row, weights=value * weights[slot], minlength=len(rows))
        error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - target) / len(rows)
        gradient = np.bincount(slot, weights=value * error[row], minlength=len(weights)) + decay * weights
        past += gradient**2
        weights -= rate * 0.1 * gradient / np.sqrt(past)
    return weights


class WordScorer:
    """Scores texts; keeps the summed weights of words it has met, starting anew when there are too many."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights
        self.known: dict[str, float] = {}

    def _learn(self, word: str) -> float:
        if len(self.known) >= _CACHE_WORDS:
            self.known.clear()
        first, second = word_slots(word)
        self.known[word] = value = float(self.weights[first] + self.weights[second])
        return value

    def score(self, text: str | None) -> float:
        words = (text or "").split()
        if not words:
            return 0.0
        get, learn = self.known.get, self._learn
        total = 0.0
        for word in words:
            value = get(word)
            total += learn(word) if value is None else value
        margin = (total + self.weights[_REPEAT_WEIGHT] * sum(map(eq, words, words[1:]))) / len(words) + self.weights[_BIAS]
        return float(1 / (1 + np.exp(-np.clip(margin, -40, 40))))


@dataclass
class QualityModel:
    posteriors: dict[str, float]
    accuracies: np.ndarray
    weights: np.ndarray


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([votes_of(t.as_py()) for t in batch.column(0)], pa.string())], names=["votes"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes and features of texts, beside their keys."""
    for batch in batches:
        texts = [t.as_py() or "" for t in batch.column(2)]
        rows = [features(t) for t in texts]
        columns = [pa.array([votes_of(t) for t in texts], pa.string()), pa.array([list(r) for r in rows], pa.list_(pa.int32())), pa.array([list(r.values()) for r in rows], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["key", "body", "votes", "slots", "weights"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """The model of docs: vote patterns of all rows (3 to the number of labellers at most), then the scorer on the sample."""
    text = docs[f"`{text_col}`"].alias("text")
    patterns = docs.select(text).mapInArrow(trimmed(_votes), "votes string").groupBy("votes").count().collect()
    posteriors, accuracies = fit_labellers({r["votes"]: r["count"] for r in patterns})
    keyed = docs.select(F.xxhash64(docs[f"`{id_col}`"].cast("string")).alias("key"), F.xxhash64(docs[f"`{text_col}`"]).alias("body"), text)
    last = keyed.select("key", "body").distinct().orderBy("key", "body").limit(train_rows).agg(F.max(F.struct("key", "body"))).first()[0]
    if last is None:
        return QualityModel(posteriors, accuracies, train_scorer([], []))
    chosen = keyed.where((F.col("key") < last.key) | (F.col("key") == last.key) & (F.col("body") <= last.body))
    held = chosen.mapInArrow(trimmed(_sampled), "key long, body long, votes string, slots array<int>, weights array<double>")
    sample = held.groupBy("key", "body").agg(F.first(F.struct("votes", "slots", "weights")).alias("row")).orderBy("key", "body").collect()
    weights = train_scorer([dict(zip(r.row.slots, r.row.weights, strict=True)) for r in sample], [posteriors[r.row.votes] for r in sample])
    return QualityModel(posteriors, accuracies, weights)


def classify(docs: DataFrame, model: QualityModel, text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """docs with votes, posterior (of the votes), score (of the scorer) and keep."""
    added = ("votes", "posterior", "score", "keep")
    rest = [c for c in docs.columns if c.lower() not in added]
    source = docs.select(*[docs[f"`{c}`"] for c in rest], docs[f"`{text_col}`"].alias("__quality_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, posteriors = WordScorer(shared.value.weights), shared.value.posteriors
        for batch in batches:
            texts = batch.column(len(rest))
            votes = [votes_of(t.as_py()) for t in texts]
            scores = [scorer.score(t.as_py()) for t in texts]
            columns = [pa.array(votes, pa.string()), pa.array([posteriors.get(v) for v in votes], pa.float64()), pa.array(scores, pa.float64()), pa.array([s >= least_score for s in scores], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *columns], names=[*batch.schema.names[: len(rest)], *added])

    schema = source.select(*[f"`{c}`" for c in rest]).schema.add("votes", "string").add("posterior", "double").add("score", "double").add("keep", "boolean")
    return source.mapInArrow(trimmed(classified), schema)
