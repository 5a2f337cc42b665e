"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams, so a misspelling nobody has seen
still shares most of its vectors with the word meant.  Windows of a few words
are the bags that are averaged: one insult in a long text would drown in an
average over all of it.  The score of a text is that of its worst window.
Labels belong to texts, so training starts from the window whose words speak
most for the label and then, twice, takes the windows that the model itself
finds worst: of toxic texts as positives, of clean ones as hard negatives.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arenaflow.llm.frames import texts_of, with_columns

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    """``rows_per_label`` bounds the sample of labelled rows that training sees, at every size of input."""

    rows_per_label: int = 3000
    window: int = 8
    step: int = 4
    shortest: int = 3
    longest: int = 5
    buckets: int = 1 << 17
    width: int = 16
    epochs: int = 3
    rounds: int = 3
    rate: float = 0.3
    batch: int = 512
    seed: int = 42


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, settings: Settings) -> np.ndarray:
    """Buckets of the n-grams of a word between its marks, and of the whole word."""
    data = f"<{word}>"
    found = [zlib.crc32(data.encode())]
    for size in range(settings.shortest, settings.longest + 1):
        found.extend(zlib.crc32(data[at:at + size].encode()) for at in range(len(data) - size + 1))
    return np.array(found, dtype=np.uint32) % np.uint32(settings.buckets)


class Model:
    """Bucket scores (difference of the two classes' logits) and the line that turns a window's mean into a score."""

    def __init__(self, settings: Settings, scores: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.settings, self.scores, self.bias = settings, scores, bias
        self.slope, self.shift = slope, shift
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sums, self.sizes = np.zeros(1 << 16), np.zeros(1 << 16)

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > 600_000:
            self.forget()
        for word in words:
            place = len(self.known)
            if place == len(self.sums):
                self.sums, self.sizes = np.append(self.sums, self.sums * 0), np.append(self.sizes, self.sizes * 0)
            bag = grams(word, self.settings)
            self.sums[place], self.sizes[place] = self.scores[bag].sum(), len(bag)
            self.known[word] = place

    def windows(self, words: list[str]) -> np.ndarray:
        """Logit of every window; a text shorter than one is a window itself."""
        fresh = set(words).difference(self.known)
        if fresh:
            if len(self.known) + len(fresh) > 600_000:
                fresh = set(words)
            self._learn(fresh)
        places = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        starts = window_starts(len(words), self.settings)
        ends = np.minimum(starts + self.settings.window, len(words))
        sums = np.concatenate([[0.0], np.cumsum(self.sums[places] * ~repeated(places, self.settings))])
        sizes = np.concatenate([[0.0], np.cumsum(self.sizes[places])])
        return (sums[ends] - sums[starts]) / (sizes[ends] - sizes[starts]) + self.bias

    def worst(self, text: str) -> float:
        words = words_of(text)
        return float(self.windows(words).max()) if words else -np.inf

    def score(self, text: str) -> float:
        worst = self.worst(text)
        if worst == -np.inf:
            return 0.0
        value = self.slope * worst + self.shift
        return float(1 / (1 + np.exp(-np.clip(value, -500, 500))))


def repeated(places: np.ndarray, settings: Settings) -> np.ndarray:
    """Words that occurred less than a window before: a word said many times in a row counts once."""
    order = np.argsort(places, kind="stable")
    again = np.zeros(len(places), bool)
    again[order[1:]] = (places[order[1:]] == places[order[:-1]]) & (order[1:] - order[:-1] < settings.window)
    return again


def window_starts(count: int, settings: Settings) -> np.ndarray:
    """Windows overlap; the last one ends with the text."""
    last = max(0, count - settings.window)
    return np.unique(np.append(np.arange(0, last + 1, settings.step), last))


def _embed(bags: list[tuple[np.ndarray, int]], labels: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Joint descent on n-gram vectors and class vectors; rates shrink with what each weight has moved."""
    draw = np.random.default_rng(settings.seed)
    vectors = draw.uniform(-1, 1, (settings.buckets, settings.width)).astype(np.float32) / settings.width
    classes = np.zeros((2, settings.width), np.float32)
    classes[1, 0], classes[0, 0] = 0.1, -0.1
    bias = np.zeros(2, np.float32)
    moved_vectors = np.full(settings.buckets, 1e-6, np.float32)
    moved_classes, moved_bias = np.full_like(classes, 1e-6), np.full_like(bias, 1e-6)
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    for _ in range(settings.epochs):
        order = draw.permutation(len(bags))
        for start in range(0, len(order), settings.batch):
            chosen = order[start:start + settings.batch]
            sizes = np.array([len(bags[item][0]) for item in chosen])
            whole = np.array([bags[item][1] for item in chosen])
            flat = np.concatenate([bags[item][0] for item in chosen])
            mean = np.add.reduceat(vectors[flat], np.cumsum(sizes) - sizes) / whole[:, None]
            logits = mean @ classes.T + bias
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(chosen)), labels[chosen]] -= 1
            chance *= (weight[chosen] / len(chosen))[:, None]
            to_mean = (chance @ classes / whole[:, None]).astype(np.float32)
            to_classes, to_bias = chance.T @ mean, chance.sum(axis=0)
            by_bucket = np.argsort(flat, kind="stable")
            owner = np.repeat(np.arange(len(chosen)), sizes)[by_bucket]
            sorted_flat = flat[by_bucket]
            firsts = np.flatnonzero(np.append(True, sorted_flat[1:] != sorted_flat[:-1]))
            step = np.add.reduceat(to_mean[owner], firsts)
            rows = sorted_flat[firsts]
            moved_vectors[rows] += (step ** 2).mean(axis=1)
            vectors[rows] -= settings.rate * step / np.sqrt(moved_vectors[rows])[:, None]
            moved_classes += to_classes ** 2
            classes -= settings.rate * to_classes / np.sqrt(moved_classes)
            moved_bias += to_bias ** 2
            bias -= settings.rate * to_bias / np.sqrt(moved_bias)
    return vectors @ (classes[1] - classes[0]), float(bias[1] - bias[0])


def _bag(words: list[str], cache: dict[str, np.ndarray], settings: Settings) -> tuple[np.ndarray, int]:
    """N-grams of the distinct words of a window, and how many there are with the repeated words."""
    for word in words:
        if word not in cache:
            cache[word] = grams(word, settings)
    return np.concatenate([cache[word] for word in dict.fromkeys(words)]), sum(len(cache[word]) for word in words)


def _line(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit on the texts' worst windows, by Newton's method."""
    spread = values.std() or 1.0
    scaled = np.stack([(values - values.mean()) / spread, np.ones(len(values))], axis=1)
    fitted = np.array([1.0, 0.0])
    for _ in range(30):
        chance = 1 / (1 + np.exp(-scaled @ fitted))
        bend = (scaled * (chance * (1 - chance))[:, None]).T @ scaled + 1e-3 * np.eye(2)
        fitted -= np.linalg.solve(bend, scaled.T @ (chance - labels) + 1e-3 * fitted)
    slope = max(fitted[0], 1e-3) / spread
    return slope, fitted[1] - slope * values.mean()


def train(texts: list[str], labels: list[int], settings: Settings = Settings()) -> Model:
    """Fit on texts with labels 0 and 1.  Without both labels the score is the share of label 1."""
    split = [(words_of(text), label) for text, label in zip(texts, labels)]
    split = [(words, label) for words, label in split if words]
    truth = np.array([label for _, label in split], dtype=np.int64)
    if not len(truth) or truth.min() == truth.max():
        share = np.clip(np.mean(truth) if len(truth) else 0.0, 0.01, 0.99)
        return Model(settings, np.zeros(settings.buckets), 0.0, 0.0, float(np.log(share / (1 - share))))
    model = _fit(split, settings)
    worst = np.zeros(len(truth))
    for fold in (0, 1):
        others, own = split[1 - fold::2], range(fold, len(split), 2)
        half = _fit(others, settings) if len({label for _, label in others}) == 2 else model
        worst[own] = [half.windows(split[row][0]).max() for row in own]
    model.slope, model.shift = _line(worst, truth.astype(float))
    model.forget()
    return model


def _fit(split: list[tuple[list[str], int]], settings: Settings) -> Model:
    """The window model alone; ``train`` sets its line by texts that the model had not seen."""
    truth = np.array([label for _, label in split])
    seen = (Counter(), Counter())
    for words, label in split:
        seen[label].update(set(words))
    totals = np.bincount(truth, minlength=2)
    odds = {word: np.log((seen[1][word] + 0.5) / (totals[1] + 1)) - np.log((seen[0][word] + 0.5) / (totals[0] + 1))
            for word in seen[1]}
    lowest = min(odds.values())
    draw = np.random.default_rng(settings.seed)
    cache: dict[str, np.ndarray] = {}
    bags: list[np.ndarray] = []
    kinds: list[int] = []
    model = None
    for turn in range(settings.rounds):
        positives = []
        for words, label in split:
            starts = window_starts(len(words), settings)
            if model is None:
                value = np.array([odds.get(word, lowest) for word in words])
                strength = np.array([value[start:start + settings.window].max() for start in starts])
            else:
                strength = model.windows(words)
            ranked = np.argsort(-strength)
            if label:
                positives.append(_bag(words[starts[ranked[0]]:][:settings.window], cache, settings))
                continue
            chosen = {int(at) for at in ranked[:2]} | {int(draw.integers(len(starts)))}
            bags.extend(_bag(words[starts[at]:][:settings.window], cache, settings) for at in sorted(chosen))
        kinds = [0] * len(bags) + [1] * len(positives)
        model = Model(settings, *_embed(bags + positives, np.array(kinds), settings))
    return model


def sample(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """At most ``rows_per_label`` labelled texts of each label, chosen by a hash; the bound holds at every size.

    Rows whose crc32(doc_id) modulo 5 is zero are held out, and rows without a
    label, an id or a text are left aside.
    """
    wanted = labels.where("toxic IN (0, 1)").select("doc_id", "toxic").distinct().where(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    order = F.xxhash64("doc_id", F.lit(settings.seed))
    chosen = wanted.where("toxic = 1").orderBy(order, "doc_id").limit(settings.rows_per_label).unionAll(
        wanted.where("toxic = 0").orderBy(order, "doc_id").limit(settings.rows_per_label))
    # Two limits bound the chosen ids, so they may be broadcast.
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL")
    bounded = found.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(2 * settings.rows_per_label)
    return bounded.select("text", "toxic")


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Train on the bounded sample in one task; the driver sees the finished weights only."""
    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"text": [], "toxic": []}), *batches])
        model = train(rows["text"].tolist(), [int(label) for label in rows["toxic"]], settings)
        yield pd.DataFrame({"scores": [model.scores.astype(np.float32).tobytes()], "bias": [float(model.bias)],
                            "slope": [float(model.slope)], "shift": [float(model.shift)]})

    made = sample(documents, labels, settings).mapInPandas(
        learn, "scores binary, bias double, slope double, shift double").collect()
    if not made:  # without a row there is no task
        return train([], [], settings)
    fitted = made[0]
    return Model(settings, np.frombuffer(fitted.scores, np.float32), fitted.bias, fitted.slope, fitted.shift)


def with_score(frame: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append ``score`` (0 to 1) and ``predicted``; a text without words, or null, scores 0.

    Columns of these names are replaced, all rows and other columns stay.
    """
    sent = frame.sparkSession.sparkContext.broadcast(
        (model.settings, model.scores.astype(np.float32), model.bias, model.slope, model.shift))

    def start():
        fitted = Model(*sent.value)
        return lambda batch: [[fitted.score(value) for value in texts_of(batch, text)]]

    scored = with_columns(frame, [T.StructField("score", T.DoubleType())], start, text)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score_documents(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Train on the labelled rows that are not held out and score every document."""
    model = fit(documents, labels, settings)
    return with_score(documents.select("doc_id", "text"), model).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        "score", "predicted")
