"""Language ID by a byte convolutional network, trained and run in numpy.

Filters of widths 2, 3 and 4 slide over the bytes of a fixed-length window;
each filter keeps its largest value, and a softmax layer reads the maxima. As
the input is one byte of 256 in each place, a filter is a table of weights for
each of its places, and two neighbouring places are looked up as one pair. A
text is cut into windows that cover it whole; their probabilities are averaged
by the bytes they hold.

Training takes ``SAMPLE`` labelled documents at most, those of the lowest
seeded hash, and ``PER_DOC`` windows of ``WINDOW`` characters of each; one task
trains on them. Prediction reads whole texts.

Defined results: a null text, or one without a letter (Unicode category L), is ``und`` with score 0;
an empty table, or one without labelled rows, gives ``und`` with score 0 for
every row; ties go to the first language by name.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, read_table

SEED = 90_001
SAMPLE = 2400
PER_DOC = 4
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
STEPS = 500
BATCH = 128
#: Windows that are in work at once.
BLOCK = 512


def letters(text: str) -> bool:
    """Whether a text has a character of Unicode category L."""
    return any(map(str.isalpha, text))


class ByteCNN:
    def __init__(self, langs: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.langs = langs
        n = FILTERS * len(WIDTHS)
        self.mask = np.zeros((max(WIDTHS), 1, n), np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.table = (rng.normal(0, 0.3, (max(WIDTHS), 256, n)).astype(np.float32)) * self.mask
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)
        self.pairs: tuple[np.ndarray, np.ndarray] | None = None

    def fuse(self) -> None:
        """The tables of two neighbouring places as one table of byte pairs."""
        t, n = self.table, self.table.shape[2]
        both = lambda a, b: (t[a][:, None, :] + t[b][None, :, :]).reshape(65536, n)
        self.pairs = (both(0, 1), both(2, 3))

    def maps(self, x: np.ndarray) -> np.ndarray:
        """x: windows with three more bytes at their end. Values before pooling."""
        size = x.shape[1] - 3
        if self.pairs is not None:
            pair = x[:, :-1].astype(np.intp) * 256 + x[:, 1:]
            v = np.take(self.pairs[0], pair[:, :size], axis=0)
            v += np.take(self.pairs[1], pair[:, 2 : size + 2], axis=0)
            return v
        return sum(self.table[k][x[:, k : size + k]] for k in range(len(self.table)))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.maps(x).max(axis=1) + self.bias, 0)
        return _softmax(pooled @ self.out + self.out_bias)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        share = np.bincount(y, minlength=len(self.langs)) / len(y)
        weight = 1 / np.maximum(share, 1e-9)[y] / len(self.langs)
        params = [self.table, self.bias, self.out, self.out_bias]
        m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, STEPS + 1):
            rows = rng.integers(0, len(x), BATCH)
            xb, yb = x[rows], y[rows]
            values = self.maps(xb)
            at = values.argmax(axis=1)
            pooled = np.take_along_axis(values, at[:, None, :], axis=1)[:, 0] + self.bias
            active = np.maximum(pooled, 0)
            p = _softmax(active @ self.out + self.out_bias)
            p[np.arange(BATCH), yb] -= 1
            p *= (weight[rows] / BATCH)[:, None].astype(np.float32)
            back = (p @ self.out.T) * (pooled > 0)
            grads = [np.zeros_like(self.table), back.sum(axis=0), active.T @ p, p.sum(axis=0)]
            f = np.arange(back.shape[1])[None, :]
            for k in range(len(self.table)):
                np.add.at(grads[0][k], (np.take_along_axis(xb, at + k, axis=1), f), back)
            grads[0] *= self.mask
            rate = 0.02 * (1 - step / (STEPS + 1))
            for q, g, a, b in zip(params, grads, m, s, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows(raw: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, three bytes longer than their step, and the bytes in each."""
    n = max(1, -(-len(raw) // window))
    flat = np.zeros(n * window + 3, np.uint8)
    flat[: len(raw)] = np.frombuffer(raw, np.uint8)
    held = np.full(n, window)
    held[-1] = max(1, len(raw) - (n - 1) * window)
    return np.lib.stride_tricks.sliding_window_view(flat, window + 3)[::window], held


def learnable() -> Column:
    """Documents that are not held out: crc32 of the id as text, modulo 4, is not 2."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2


def train(docs: DataFrame, *, sample: int = SAMPLE, seed: int = SEED) -> ByteCNN | None:
    """A model from ``sample`` labelled rows at most (columns doc_id, text, lang)."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable())
    rows = bounded_sample(labelled.select("doc_id", "text", "lang"), F.xxhash64(F.lit(seed), F.col("doc_id")), sample)
    places = F.transform(
        F.sequence(F.lit(1), F.lit(PER_DOC)),
        lambda k: F.substring(
            "text", (F.pmod(F.xxhash64(F.lit(seed), k, F.col("doc_id")), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1).cast("int"), F.lit(WINDOW)
        ),
    )
    parts = rows.select("lang", F.explode(F.array_distinct(places)).alias("part"))
    #: The sample is bounded, so one task learns from it; the driver gets the weights alone.
    learned = parts.coalesce(1).mapInPandas(lambda batches: _learn(batches, seed), "model binary").collect()
    return pickle.loads(learned[0]["model"]) if learned else None


def _learn(batches: Iterator[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    got = sorted((t, lang) for batch in batches for lang, t in zip(batch["lang"], batch["part"], strict=True) if letters(t))
    if got:
        langs = sorted({lang for _, lang in got})
        model = ByteCNN(langs, seed)
        x = np.stack([windows(t.encode("utf-8", "surrogatepass"))[0][0] for t, _ in got])
        model.fit(x, np.array([langs.index(lang) for _, lang in got]), seed)
        yield pd.DataFrame({"model": [pickle.dumps(model)]})


def predict_texts(model: ByteCNN | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    total = np.zeros((len(texts), len(model.langs) if model else 0))
    held = np.zeros(len(texts))
    todo: list[tuple[np.ndarray, np.ndarray, int]] = []

    def run() -> None:
        if not todo:
            return
        x = np.concatenate([t[0] for t in todo])
        w = np.concatenate([t[1] for t in todo])
        who = np.repeat([t[2] for t in todo], [len(t[1]) for t in todo])
        p = model.probabilities(x) * w[:, None]
        np.add.at(total, who, p)
        np.add.at(held, who, w)
        todo.clear()

    pending = 0
    for i, text in enumerate(texts):
        if model is None or not isinstance(text, str) or not letters(text):
            continue
        x, w = windows(text.encode("utf-8", "surrogatepass"))
        for s in range(0, len(x), BLOCK):
            todo.append((x[s : s + BLOCK], w[s : s + BLOCK], i))
            pending += len(w[s : s + BLOCK])
            if pending >= BLOCK:
                run()
                pending = 0
    run()
    for i in np.flatnonzero(held):
        k = int(total[i].argmax())
        lang[i], score[i] = model.langs[k], float(min(1.0, total[i, k] / held[i]))
    return lang, score


def has_letter(text: Column) -> Column:
    """Whether a text has a language for a model to tell; false for null."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """``docs`` plus lang_pred and score, from the text alone."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if model is not None:
            model.fuse()
        for part in parts:
            names, scores = predict_texts(model, list(part))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    docs = docs.drop("lang_pred", "score")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), predict(F.col("text")).alias("found")).select("row.*", "found.lang_pred", "found.score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "lang_pred", "score")
