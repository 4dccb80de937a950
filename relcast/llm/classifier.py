"""Quality classifier: ordinal regression on graded ratings.

A cumulative-link (proportional odds) model: P(grade <= j) = sigmoid(threshold[j] - score), with one weight for each hashed
feature of the text, shared by all grades, and ordered thresholds. The features are the words that occur, their beginnings, and buckets of
the shares that the quality rules measure. Expected grade and tail probabilities follow for each document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, give_back, per_text, texts
from .rules import FEATURES, RULES, byte_classes, measure

STRIP = b".,;:!?\"'()[]{}#*$%&|<>-_"
BUCKETS = 12
SHAPES = (len(RULES) + 1) * BUCKETS


@dataclass(frozen=True)
class ClassifierParams:
    bits: int = 18  # words and their beginnings are hashed to 2^bits weights
    prefixes: tuple[int, ...] = (4, 5)  # bytes of a beginning
    train_docs: int = 8000  # the model is fitted on about so many labelled documents, chosen by a hash of their id
    rounds: int = 300
    rate: float = 0.1
    l2: float = 1e-4
    least_docs: int = 4  # a feature counts from so many training documents on,
    least_strength: float = 4.0  # and if its documents' grades are so many standard errors away from the rest
    tail: int = 2  # the tail probability is P(grade >= tail)
    select_at: float = 0.7  # documents below it are rejected
    seed: int = 7


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ordered, one fewer than grades
    params: ClassifierParams


def shape_features(raw: bytes, classes: np.ndarray) -> list[int]:
    """A bucket for each rule's share, and one for the length."""
    made = dict(zip(FEATURES, measure(raw, classes), strict=True))
    out = []
    for k, (over, under) in enumerate(RULES.values()):
        share = made[over] / made[under] if made[under] else 0.0
        out.append(k * BUCKETS + (0 if share == 0 else 1 + min(BUCKETS - 2, int(share * 40) if share < 0.2 else 8 + int(share * 4))))
    return [*out, len(RULES) * BUCKETS + min(BUCKETS - 1, made["n_words"].bit_length())]


class Features:
    """Features of texts, as places in the weights; a worker keeps the places of words it has met."""

    def __init__(self, params: ClassifierParams):
        self.classes, self.size, self.prefixes, self.met = byte_classes(), 1 << params.bits, params.prefixes, {}

    def __call__(self, raw: bytes | None) -> np.ndarray:
        raw = raw or b""
        words = set(raw.lower().split())
        if new := words.difference(self.met):
            if len(self.met) > 60_000:
                self.met.clear()
                new = words
            self.met.update((w, self.places(w.strip(STRIP))) for w in new)
        return np.array([*shape_features(raw, self.classes), *set(chain.from_iterable(map(self.met.__getitem__, words)))], np.int32)

    def places(self, word: bytes) -> tuple[int, ...]:
        """Of the word and of its beginnings, in bytes."""
        room = self.size - SHAPES
        starts = [zlib.crc32(word[:n], n) for n in self.prefixes if len(word) > n]
        return tuple(SHAPES + code % room for code in (zlib.crc32(word), *starts))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, levels: int, params: ClassifierParams) -> OrdinalModel:
    """Maximum likelihood by Adam with weight decay, full batches, so that reruns agree. ``grades`` are 0 to levels - 1."""
    size = 1 << params.bits
    flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    docs_of = np.bincount(flat, minlength=size)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=levels))[:-1] / max(1, len(grades)), 1e-3, 1 - 1e-3)
    edges = np.concatenate([[0.0], share, [1.0]])
    pull = (np.diff(edges * (1 - edges)) / np.maximum(np.diff(edges), 1e-9))[grades]  # of each document on the score, as if no feature counted
    strength = np.abs(np.bincount(flat, pull[owner], size)) / np.sqrt(np.maximum(docs_of, 1) * max(float(pull.var()), 1e-9))
    used = (docs_of >= params.least_docs) & (strength >= params.least_strength)
    flat, owner = flat[used[flat]], owner[used[flat]]
    places, compact = np.unique(flat, return_inverse=True)
    compact = compact.astype(np.int32)
    w = np.zeros(len(places))
    cuts = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(levels - 1))
    state = np.concatenate([w, cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    first, second = np.zeros_like(state), np.zeros_like(state)
    at = np.arange(len(rows))
    for t in range(1, params.rounds + 1 if rows else 1):
        w, cuts = state[: len(places)], state[len(places)] + np.concatenate([[0.0], np.cumsum(np.exp(state[len(places) + 1 :]))])
        score = np.bincount(owner, w[compact], len(rows))
        below = np.concatenate([np.zeros((len(rows), 1)), sigmoid(cuts[None, :] - score[:, None]), np.ones((len(rows), 1))], 1)
        slope = below * (1 - below)
        chance = np.maximum(below[at, grades + 1] - below[at, grades], 1e-9)
        on_score = (slope[at, grades + 1] - slope[at, grades]) / chance  # of the loss
        on_cuts = np.zeros((len(rows), levels + 1))
        on_cuts[at, grades + 1] -= slope[at, grades + 1] / chance
        on_cuts[at, grades] += slope[at, grades] / chance
        on_cuts = on_cuts[:, 1:-1].sum(0) / len(rows)
        by_gap = np.cumsum(on_cuts[::-1])[::-1]
        grad = np.concatenate([np.bincount(compact, on_score[owner], len(places)) / len(rows) + params.l2 * w, by_gap[:1], by_gap[1:] * np.exp(state[len(places) + 1 :])])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        state = state - params.rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[places] = state[: len(places)]
    return OrdinalModel(weights, state[len(places)] + np.concatenate([[0.0], np.cumsum(np.exp(state[len(places) + 1 :]))]), params)


def grade(quality: Column, toxic: Column) -> Column:
    """0 for bad text, 1 for good but toxic text, 2 for good text; null if unrated."""
    return F.when(quality == 0, 0).when((quality == 1) & (F.coalesce(toxic, F.lit(0)) == 1), 1).when(quality == 1, 2)


def fit_classifier(docs: DataFrame, rated: DataFrame, levels: int = 3, params: ClassifierParams = ClassifierParams(), id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on a sample of ``rated`` (id, grade) of about ``train_docs`` documents; whole texts are read on executors.

    The sample is bounded, so it is broadcast and its features go to the driver, of rows with one id those of one row.
    Without a rated document every weight is 0 and every document is selected.
    """
    known = rated.select("id", "grade").dropna().groupBy("id").agg(F.min("grade").alias("grade"))
    total = known.count()
    chance = F.pmod(F.xxhash64(F.lit(params.seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(chance < min(1.0, params.train_docs / max(1, total)))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(params)
        for batch in batches(frames, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grade"), pa.array([features(t).tobytes() for t in texts(batch, "text")], pa.binary())], ["id", "grade", "places"])
        del features
        give_back()

    made = found.mapInArrow(run, f"id {found.schema['id'].dataType.simpleString()}, grade int, places binary")
    rows = made.groupBy("id").agg(F.min(F.struct("grade", "places")).alias("row")).select("id", "row.*").collect()
    rows.sort(key=lambda r: (r["id"], bytes(r["places"])))
    if not rows:
        return OrdinalModel(np.zeros(1 << params.bits, np.float32), np.arange(levels - 1) - 10.0, params)
    return fit_ordinal([np.frombuffer(r["places"], np.int32) for r in rows], np.array([r["grade"] for r in rows]), levels, params)


def _probabilities(model: OrdinalModel) -> Callable[[list], tuple[np.ndarray, np.ndarray]]:
    features = Features(model.params)

    def work(batch: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        score = np.array([float(model.weights[features(t)].sum()) for t in batch])
        above = 1 - sigmoid(model.thresholds[None, :] - score[:, None])  # P(grade > j)
        return above.sum(1), above[:, model.params.tail - 1]

    return work


def grade_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, expected_grade, tail_prob and selected.

    A null or empty text is graded by its shape alone, like a text without words. Repeated rows and null ids stay; other
    columns are left out; a long text is read whole; an empty table gives an empty result. One pass without exchange.
    """

    def make() -> Callable[[list], dict[str, pa.Array]]:
        grades = _probabilities(model)

        def work(batch: list[bytes | None]) -> dict[str, pa.Array]:
            mean, tail = grades(batch)
            return {"expected_grade": pa.array(mean), "tail_prob": pa.array(tail), "selected": pa.array(tail >= model.params.select_at)}

        return work

    return per_text(docs, [id_col], text_col, "expected_grade double, tail_prob double, selected boolean", make)


def select_documents(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier selects, with all columns; one pass without exchange."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # by place, so that equal names do no harm
    plain, at = docs.toDF(*names), names[docs.columns.index(text_col)]

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades = _probabilities(model)
        for batch in batches(frames, at):
            yield batch.filter(pa.array(grades(texts(batch, at))[1] >= model.params.select_at))
        del grades
        give_back()

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
