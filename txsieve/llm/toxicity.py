"""Toxicity scores: a bidirectional gated recurrent network with attention pooling over all windows of a text, in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txsieve.llm.common import LOWER, crc_mod, labelled, slices, table, text_bytes

#: Rows of each class, and bytes of a row's text, that a model is fitted on at most.
PER_CLASS = 700
TRAIN_BYTES = 8192
WINDOW, STRIDE = 32, 16
THRESHOLD = 0.7
WORD, CHAR, HIDDEN, ATTEND = 8, 12, 8, 8
GRAMS = (3, 5, 7, 9)  # bytes
OWN_SHARE = 0.01
REMEMBERED = 400_000
_STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words without the ASCII punctuation around them; words of nothing else stay as they are."""
    return [w.strip(_STRIP) or w for w in text.translate(LOWER).split()]


def char_grams(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of every run of ``GRAMS`` bytes of each word between its bounds; of short words the word itself."""
    data = np.frombuffer(b"".join(b"\x01%b\x02" % w for w in words), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words)), np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
    codes, owners = [], []
    for n in GRAMS:
        size = max(0, len(data) - n + 1)
        code = np.full(size, n, np.uint32)
        for i in range(n):
            code = code * np.uint32(0x01000193) + data[i : i + size]
        whole = owner[:size] == owner[n - 1 :]
        codes.append((code ^ (code >> np.uint32(15)))[whole])
        owners.append(owner[:size][whole])
    codes, owners = np.concatenate(codes), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return codes[order], owners[order]


def windows(length: int) -> list[int]:
    """Where the windows of so many words begin: every ``STRIDE`` words until one reaches the end; one for no words."""
    return list(range(0, max(1, length - WINDOW + STRIDE), STRIDE))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _summed(rows: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The sum of the rows for each of ``size`` places."""
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    if len(at):
        order = np.argsort(at, kind="stable")
        begins = np.flatnonzero(np.diff(at[order], prepend=-1))
        out[at[order[begins]]] = np.add.reduceat(rows[order], begins, axis=0)
    return out


class ToxicityModel:
    """Weights by name, and the words and character runs that have an embedding (number 0 is any other word)."""

    def __init__(self, words: dict[bytes, int], grams: np.ndarray, seed: int = 5):
        draw = np.random.default_rng(seed)
        normal = lambda *shape, scale=0.3: draw.normal(0, scale, shape).astype(np.float32)
        self.words, self.grams = words, grams
        self.p = {"word": normal(len(words) + 1, WORD, scale=0.1), "char": normal(len(grams), CHAR, scale=0.1)}
        self.p["word"][0] = 0
        for side in ("f", "b"):
            self.p["in_" + side] = normal(WORD + CHAR, 3 * HIDDEN)
            self.p["bias_" + side] = np.zeros(3 * HIDDEN, np.float32)
            self.p["state_" + side] = normal(HIDDEN, 3 * HIDDEN)
        self.p |= {"attend": normal(2 * HIDDEN, ATTEND), "attend_bias": np.zeros(ATTEND, np.float32), "query": normal(ATTEND)}
        self.p |= {"out": normal(2 * HIDDEN), "out_bias": np.full(1, -1.0, np.float32)}

    def inputs(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(input of each word, its number, its known character runs, their words, 1 / root of their number)."""
        number = np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words))
        code, owner = char_grams(words)
        at = np.minimum(np.searchsorted(self.grams, code), max(len(self.grams) - 1, 0))
        has = self.grams[at] == code if len(self.grams) else np.zeros(len(code), bool)
        code, owner = at[has], owner[has]
        share = (1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(words)), 1))).astype(np.float32)
        chars = np.zeros((len(words), CHAR), np.float32)
        if len(owner):
            begins = np.flatnonzero(np.diff(owner, prepend=-1))
            chars[owner[begins]] = np.add.reduceat(self.p["char"][code], begins, axis=0)
        return np.concatenate([self.p["word"][number], chars * share[:, None]], axis=1), number, code, owner, share

    def gates(self, inputs: np.ndarray) -> np.ndarray:
        """What each word adds to the gates of both directions."""
        return np.concatenate([inputs @ self.p["in_" + s] + self.p["bias_" + s] for s in "fb"], axis=1)

    def _side(self, side: str, gates: np.ndarray, ids: np.ndarray, live: np.ndarray, keep: bool):
        state, h, kept = self.p["state_" + side], np.zeros((len(ids), HIDDEN), np.float32), []
        out = np.empty((ids.shape[1], len(ids), HIDDEN), np.float32)
        lead = 0 if side == "f" else 3 * HIDDEN
        for t in range(ids.shape[1]) if side == "f" else range(ids.shape[1] - 1, -1, -1):
            g = gates[ids[:, t], lead : lead + 3 * HIDDEN]
            u = h @ state
            zr = _sigmoid(g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            if keep:
                kept.append((t, h, z, r, n, u[:, 2 * HIDDEN :]))
            h = (n + z * (h - n)) * live[:, t, None]
            out[t] = h
        return out, kept

    def forward(self, gates: np.ndarray, ids: np.ndarray, live: np.ndarray, keep: bool = False):
        """The logit of each window: ids of words and which places are words, both windows x places."""
        (f, kept_f), (b, kept_b) = (self._side(s, gates, ids, live, keep) for s in "fb")
        h = np.concatenate([f, b], axis=2)
        a = np.tanh(h @ self.p["attend"] + self.p["attend_bias"])
        e = np.where(live.T, a @ self.p["query"], -30.0)
        e = np.exp(e - e.max(0))
        weight = (e / e.sum(0)).astype(np.float32) * live.T
        pooled = np.einsum("tn,tnh->nh", weight, h)
        logit = pooled @ self.p["out"] + self.p["out_bias"][0]
        return logit, (h, a, weight, pooled, kept_f, kept_b) if keep else None

    def gradients(self, distinct, gates: np.ndarray, ids: np.ndarray, live: np.ndarray, wanted: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss of the windows, by backpropagation through attention, both directions and inputs."""
        inputs, number, code, owner, share = distinct
        logit, (h, a, weight, pooled, kept_f, kept_b) = self.forward(gates, ids, live, keep=True)
        d_logit = ((_sigmoid(logit) - wanted) * weights).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["out"], grads["out_bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * self.p["out"]
        d_h = weight[:, :, None] * d_pooled
        d_weight = np.einsum("nh,tnh->tn", d_pooled, h)
        d_e = weight * (d_weight - (weight * d_weight).sum(0))
        grads["query"] = np.einsum("tn,tna->a", d_e, a)
        d_a = d_e[:, :, None] * self.p["query"] * (1 - a * a)
        grads["attend"] = np.einsum("tnh,tna->ha", h, d_a)
        grads["attend_bias"] = d_a.sum((0, 1))
        d_h = d_h + d_a @ self.p["attend"].T
        d_gates = np.zeros_like(gates)
        place = ids.T.ravel()
        for side, kept, lead in (("f", kept_f, 0), ("b", kept_b, HIDDEN)):
            state, back = self.p["state_" + side], np.zeros((len(ids), HIDDEN), np.float32)
            d_all = np.empty((ids.shape[1], len(ids), 3 * HIDDEN), np.float32)
            for t, before, z, r, n, u in reversed(kept):
                d = (d_h[t, :, lead : lead + HIDDEN] + back) * live[:, t, None]
                d_n = d * (1 - z) * (1 - n * n)
                d_z = d * (before - n) * z * (1 - z)
                d_r = d_n * u * r * (1 - r)
                d_g = np.concatenate([d_z, d_r, d_n], axis=1)
                d_u = np.concatenate([d_z, d_r, d_n * r], axis=1)
                grads["state_" + side] += before.T @ d_u
                back = d * z + d_u @ state.T
                d_all[t] = d_g
            d_gates[:, 3 * lead : 3 * lead + 3 * HIDDEN] = _summed(d_all.reshape(-1, 3 * HIDDEN), place, len(gates))
        d_inputs = np.zeros_like(inputs)
        for side, lead in (("f", 0), ("b", 3 * HIDDEN)):
            part = d_gates[:, lead : lead + 3 * HIDDEN]
            grads["in_" + side], grads["bias_" + side] = inputs.T @ part, part.sum(0)
            d_inputs += part @ self.p["in_" + side].T
        grads["word"] = _summed(d_inputs[:, :WORD], number, len(grads["word"]))
        grads["word"][0] = 0
        grads["char"] = _summed((d_inputs[:, WORD:] * share[:, None])[owner], code, len(grads["char"]))
        return grads


class _Slice:
    """The windows of several texts, over the numbers of their words."""

    def __init__(self, texts: Sequence[Sequence[int]]):
        begins = [windows(len(t)) for t in texts]
        self.owner = np.repeat(np.arange(len(texts)), [len(b) for b in begins])
        flat = np.fromiter((i for t in texts for i in t), np.int64, sum(map(len, texts)))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.fromiter((i for b in begins for i in b), np.int64, len(self.owner))
        place = start[:, None] + np.arange(WINDOW)
        self.live = place < sizes[self.owner][:, None]
        at = (np.cumsum(sizes) - sizes)[self.owner][:, None] + place
        self.ids = np.where(self.live, flat[np.minimum(at, max(len(flat) - 1, 0))] if len(flat) else 0, 0)


def _largest(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The place of the largest value of each owner; owners come in order."""
    order = np.lexsort((values, owner))
    return order[np.flatnonzero(np.diff(owner[order], append=owner[-1] + 1))]


def fit(
    texts: Sequence[bytes], labels: Sequence[int], warm: int = 2, epochs: int = 10, batch: int = 64, rate: float = 0.01, decay: float = 0.3, seed: int = 5
) -> ToxicityModel | None:
    """A model of the sample, or None without both classes.

    A text is toxic if any of its windows is, so after ``warm`` passes over all windows each pass finds every text's most toxic window and learns
    from that. Both classes weigh alike. Words and character runs in ``OWN_SHARE`` of the texts have embeddings; the words' are hidden at random, so that their
    characters count too.
    """
    labels = np.array(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return None
    split = [words_of(t) for t in texts]
    seen = Counter(w for words in split for w in set(words))
    least = max(2, round(OWN_SHARE * len(split)))
    own = {w: i + 1 for i, w in enumerate(sorted(w for w, n in seen.items() if n >= least))}
    every = list(seen)
    code, owner = char_grams(every)
    of = np.split(code, np.searchsorted(owner, np.arange(1, len(every))))
    place = {w: i for i, w in enumerate(every)}
    runs: Counter[int] = Counter()
    for words in split:
        runs.update(np.unique(np.concatenate([of[place[w]] for w in set(words)])).tolist() if words else [])
    model = ToxicityModel(own, np.array(sorted(c for c, n in runs.items() if n >= least), np.uint32), seed)
    number: dict[bytes, int] = {}
    numbered = [[number.setdefault(w, len(number)) for w in words] for words in split]
    vocabulary = list(number) or [b""]
    sample = _Slice(numbered)
    balance = len(labels) / (2 * np.bincount(labels.astype(int), minlength=2))
    cost = balance[labels.astype(int)].astype(np.float32)
    draw = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step = 0
    known = model.words
    for epoch in range(warm + epochs):
        if epoch < warm:
            per_text = np.bincount(sample.owner, minlength=len(labels))
            chosen, weight = np.arange(len(sample.owner)), (1 / per_text)[sample.owner]
        else:
            gates = model.gates(model.inputs(vocabulary)[0])
            logits = np.concatenate([model.forward(gates, sample.ids[i : i + 4096], sample.live[i : i + 4096])[0] for i in range(0, len(sample.ids), 4096)])
            chosen = _largest(logits, sample.owner)
            weight = np.ones(len(chosen))
        order = draw.permutation(len(chosen))
        size = batch * (8 if epoch < warm else 1)
        for i in range(0, len(order), size):
            rows = chosen[order[i : i + size]]
            used, ids = np.unique(sample.ids[rows], return_inverse=True)
            model.words = known if epoch < warm or draw.random() < 0.7 else {}
            distinct = model.inputs([vocabulary[j] for j in used])
            model.words = known
            owner = sample.owner[rows]
            share = (weight[order[i : i + size]] * cost[owner]).astype(np.float32)
            grads = model.gradients(distinct, model.gates(distinct[0]), ids.reshape(len(rows), WINDOW), sample.live[rows], labels[owner], share / share.sum())
            step += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                model.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) + rate * decay * model.p[k]
        rate *= 0.9
    return model


def train(documents: DataFrame, labels: DataFrame, allowed: Column, per_class: int = PER_CLASS, most_bytes: int = TRAIN_BYTES) -> ToxicityModel | None:
    """A model from at most ``per_class`` labelled documents of each class, drawn from those of at most ``most_bytes`` of text."""
    sample = labelled(documents, labels, "toxic", allowed, per_class, 2, most_bytes)
    found = sample.select("text", "label").toArrow()
    pairs = sorted(zip(found.column("text").to_pylist(), found.column("label").to_pylist(), strict=True))
    return fit([t for t, _ in pairs], [y for _, y in pairs])


class Scorer:
    """Scores texts with a model; what each distinct word adds to the gates is worked out once in a task."""

    def __init__(self, model: ToxicityModel | None):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.gates = np.zeros((0, 6 * HIDDEN), np.float32)

    def __call__(self, texts: Sequence[bytes]) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), 0.5)
        if len(self.number) > REMEMBERED:
            self._forget()
        number, before = self.number, len(self.number)
        add = number.setdefault
        numbered = [[add(w, len(number)) for w in words_of(t)] for t in texts]
        if len(number) > before or not len(self.gates):
            fresh = list(number)[before:] if number else [b""]
            self.gates = np.concatenate([self.gates, self.model.gates(self.model.inputs(fresh)[0])])
        windows_ = _Slice(numbered)
        logits = [
            self.model.forward(self.gates, windows_.ids[i : i + 2048], windows_.live[i : i + 2048])[0] for i in range(0, len(windows_.ids), 2048)
        ]
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, windows_.owner, np.concatenate(logits) if logits else np.zeros(0))
        return _sigmoid(best).astype(np.float64).round(6)


SCORE_SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _score_rows(model: ToxicityModel | None, threshold: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for batch in slices(batches):
            scores = score(batch.column("text").to_pylist())
            predicted = pa.array((scores >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores), predicted], [*batch.schema.names[:-1], "score", "predicted"])

    return rows


def score_documents(documents: DataFrame, model: ToxicityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): the score of a text's most toxic window, over all of its overlapping windows.

    Null and empty texts score as one window without words. Without a model every score is 0.5.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 3) == 1).alias("held_out"), text_bytes())
    return rows.mapInArrow(_score_rows(model, threshold), SCORE_SCHEMA)


def learned(documents: DataFrame, labels: DataFrame) -> ToxicityModel | None:
    return train(documents, labels, crc_mod("doc_id", 3) != 1)


def _keep_rows(model: ToxicityModel | None, threshold: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for batch in slices(batches):
            scores = score([(t or "").encode() for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(scores < threshold))

    return rows


def keep_clean(documents: DataFrame, model: ToxicityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score below ``threshold``."""
    return documents.mapInArrow(_keep_rows(model, threshold), documents.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(documents, learned(documents, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
