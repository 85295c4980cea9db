"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txsieve.llm.common import crc_mod, labelled, slices, table, text_bytes

WIDTH = 1 << 18
#: Rows of each class that a model is fitted on at most.
PER_CLASS = 1500
THRESHOLD = 0.3
_LETTERS = np.isin(np.arange(256), list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256)))


class _Shapes(dict):
    """Numbers of word shapes: letter case, what surrounds the letters, and how long the word is."""

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        core = text.strip("!?.,;:#*$%&|<>()[]{}\"'-_=+/\\~^@`0123456789")
        case = 0 if not core else 1 if core.islower() else 2 if core.isupper() and len(core) > 1 else 3 if core[0].isupper() else 4
        tail = text[len(text.rstrip("!?.,;:#*$%&|<>-_=+/\\~^@`")) :]
        head = text[: len(text) - len(text.lstrip("#*$%&|<>-_=+/\\~^@`("))]
        marks = hash_text(tail[:1] * min(len(tail), 3) + "\0" + head[:1]) % 61
        shape = (case * 61 + marks) * 4 + min(3, len(core) // 4)
        if len(self) < 200_000:
            self[word] = shape
        return shape


def hash_text(text: str) -> int:
    value = 2166136261
    for byte in text.encode():
        value = ((value ^ byte) * 16777619) & 0xFFFFFFFF
    return value


def _spread(codes: np.ndarray, salt: int) -> np.ndarray:
    mixed = (codes.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - WIDTH.bit_length() + 1)).astype(np.int64)


def features(texts: list[bytes], shapes: _Shapes) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each text's indicators, by text.

    The n-grams are of one to three word shapes, where a word that equals the one before has a shape of its own. They are the same
    for every language and for words that training never saw. A text without words has no indicators.
    """
    owners, found = [], []
    for row, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        shape = np.fromiter(map(shapes.__getitem__, words), np.int64, len(words))
        again = np.fromiter(map(bytes.__eq__, words[1:], words[:-1]), bool, len(words) - 1)
        shape[1:][again] = 5000
        grams = [np.unique(shape)]
        if len(words) > 1:
            grams.append(np.unique(shape[:-1] * 8192 + shape[1:]) + (1 << 30))
        if len(words) > 2:
            grams.append(np.unique((shape[:-2] * 8192 + shape[1:-1]) * 8192 + shape[2:]) + (1 << 50))
        codes = np.unique(_spread(np.concatenate(grams), 7))
        owners.append(np.full(len(codes), row))
        found.append(codes)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(found)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shapes = _Shapes()
    for batch in slices(batches):
        owner, code = features(batch.column("text").to_pylist(), shapes)
        split = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        codes = [code[split[i] : split[i + 1]].tolist() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(codes, pa.list_(pa.int32()))], ["label", "codes"])


class QualityModel:
    """Weights of the indicators (naive Bayes ratio times linear weight), their ratios, and a sigmoid over the margin."""

    def __init__(self, weights: np.ndarray, ratios: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.ratios, self.bias, self.slope, self.shift = weights, ratios, bias, slope, shift

    def margins(self, owner: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
        length = np.sqrt(np.bincount(owner, self.ratios[code] ** 2, n))
        return np.bincount(owner, self.weights[code], n) / np.where(length > 0, length, 1) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def fit(rows: list[tuple[int, np.ndarray]], epochs: int = 20, cost: float = 1.0, smoothing: float = 1.0, seed: int = 11) -> QualityModel:
    """Naive Bayes support vectors by dual coordinate descent.

    Indicators are scaled by the log ratio of their smoothed class counts, rows by their length. Each step solves one row's dual variable
    in closed form. The rarer class costs more, so that both weigh alike. The sigmoid is fitted to the sample's margins. Without both
    classes every score is 0.5.
    """
    labels = np.array([label for label, _ in rows], np.int64)
    if not len(rows) or labels.min() == labels.max():
        return QualityModel(np.zeros(WIDTH), np.ones(WIDTH), 0.0, 0.0, 0.0)
    counts = [np.full(WIDTH, smoothing), np.full(WIDTH, smoothing)]
    for label, codes in rows:
        counts[label][codes] += 1
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = [ratios[codes] for _, codes in rows]
    lengths = [math.sqrt(float(v @ v)) or 1.0 for v in values]
    values = [v / size for v, size in zip(values, lengths, strict=True)]
    sign = np.where(labels == 1, 1.0, -1.0)
    most = np.where(labels == 1, cost, cost) * len(rows) / (2.0 * np.bincount(labels, minlength=2)[labels])
    dual, weights, bias = np.zeros(len(rows)), np.zeros(WIDTH), 0.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            codes, value = rows[i][1], values[i]
            gradient = sign[i] * (float(weights[codes] @ value) + bias) - 1
            new = min(max(dual[i] - gradient / (float(value @ value) + 1), 0.0), most[i])
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                weights[codes] += step * value
                bias += step
                dual[i] = new
    margin = np.array([float(weights[c] @ v) + bias for (_, c), v in zip(rows, values, strict=True)])
    slope, shift = 2.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        gap = (p - labels) * most / cost
        slope, shift = slope - 2 * float((gap * margin).mean()) - 0.001 * slope, shift - 2 * float(gap.mean())
    return QualityModel(weights * ratios, ratios, bias, slope, shift)


def train(documents: DataFrame, labels: DataFrame, allowed: Column, per_class: int = PER_CLASS) -> QualityModel:
    """A model from at most ``per_class`` labelled rows of each class; their indicators are found on the executors."""
    sample = labelled(documents, labels, "quality", allowed, per_class, 7)
    rows = sample.select("doc_id", "text", "label").orderBy("doc_id", "text").select("text", "label")
    found = rows.mapInArrow(_feature_rows, "label int, codes array<int>").toArrow()
    codes = found.column("codes").to_pylist()
    pairs = sorted(zip(found.column("label").to_pylist(), codes, strict=True))
    return fit([(label, np.array(c, np.int64)) for label, c in pairs])


SCORE_SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _score_rows(model: QualityModel, threshold: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = _Shapes()
        for batch in slices(batches):
            owner, code = features(batch.column("text").to_pylist(), shapes)
            scores = model.scores(model.margins(owner, code, batch.num_rows)).round(12)
            predicted = pa.array((scores >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores), predicted], [*batch.schema.names[:-1], "score", "predicted"])

    return score


def score_documents(documents: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text. Null and empty texts score by the bias alone."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 5) == 0).alias("held_out"), text_bytes())
    return rows.mapInArrow(_score_rows(model, threshold), SCORE_SCHEMA)


def learned(documents: DataFrame, labels: DataFrame) -> QualityModel:
    return train(documents, labels, crc_mod("doc_id", 5) != 0)


def _keep_rows(model: QualityModel, threshold: float, column: str):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = _Shapes()
        for batch in slices(batches, column):
            texts = [(t or "").encode() for t in batch.column(column).to_pylist()]
            owner, code = features(texts, shapes)
            yield batch.filter(pa.array(model.scores(model.margins(owner, code, batch.num_rows)).round(12) >= threshold))

    return keep


def keep_good(documents: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score ``threshold`` or more."""
    return documents.mapInArrow(_keep_rows(model, threshold, "text"), documents.schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(documents, learned(documents, table(spark, sf_dir, "labels").select("doc_id", "quality")))
