"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte n-grams, hashed into ``BUCKETS``; a linear layer and a softmax give the
probability of each language. Embeddings and layer are trained together by stochastic gradient descent in numpy on
stretches of a bounded sample of labelled texts: ``SAMPLE`` documents of at most ``LONGEST`` characters, the smallest by a
hash of their id and then of the row (equal rows once). A part of the sample stays out of the training and calibrates the result: a temperature that makes the
probabilities fit, and the score below which a prediction is rejected, so that of the accepted ones at most ``ERRORS``
are wrong.

Once trained, embedding and layer multiply into one table of bucket by language, so a prediction is a mean over the whole
text of rows of that table. The model is a few hundred kilobytes whatever the corpus and travels with the tasks.

A text that is null or has no letter is ``und`` with score 0, and rejected; so is every text if nothing could be learnt.
A null label, or a doc_id that a caller holds out, is not learnt from; a null doc_id counts as the empty text there.
Repeated rows are predicted alike. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgrid.llm.common import small_slices

GRAMS, BUCKETS, WIDTH = (2, 3, 4), 1 << 15, 16
SAMPLE, LONGEST, STRETCH, STRETCHES, EPOCHS, BATCH, RATE, LEAST_STEPS, SEED = 4000, 20_000, 240, 6, 4, 64, 0.5, 1200, 5
#: Share of the sample that calibrates, and of the accepted predictions that may be wrong there.
CALIBRATION, ERRORS, FOLDS = 0.2, 0.01, 5
UNKNOWN = "und"
_LETTERLESS = bytes.maketrans(bytes(b for b in range(128) if not chr(b).isalpha()), b" " * sum(not chr(b).isalpha() for b in range(128)))
_SPACES = re.compile(rb" {2,}")


@dataclass
class Model:
    """``table`` holds the logits of each bucket, by language."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


def normal(text: str) -> bytes:
    """Lower case, letters only, one space between words."""
    return b" " + _SPACES.sub(b" ", text.lower().encode().translate(_LETTERLESS)).strip(b" ") + b" "


def buckets_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, text by text, and where each text begins; every text has one at least."""
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = np.frombuffer(b"".join(texts) + b"\0" * max(GRAMS), np.uint8).astype(np.uint32)
    n = len(joined) - max(GRAMS)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(n)
    value = np.zeros(n, np.uint32)
    shift = 32 - int(BUCKETS).bit_length() + 1
    found = np.empty((n, len(GRAMS)), np.uint16 if BUCKETS <= 1 << 16 else np.uint32)
    inside = np.empty((n, len(GRAMS)), bool)
    for size in range(1, max(GRAMS) + 1):
        value |= joined[size - 1 : size - 1 + n] << np.uint32(8 * (size - 1))
        if size in GRAMS:
            g = GRAMS.index(size)
            mixed = (value ^ np.uint32(size * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x85EBCA77)
            found[:, g] = mixed >> np.uint32(shift)
            inside[:, g] = at + size <= ends
    counts = np.add.reduceat(inside.sum(axis=1), np.cumsum(sizes) - sizes) if n else np.zeros(0, np.int64)
    return found[inside], np.cumsum(counts) - counts


def logits(model: Model, texts: list[bytes]) -> np.ndarray:
    found, begins = buckets_of(texts)
    sizes = np.diff(np.append(begins, len(found)))
    out = np.empty((len(texts), len(model.languages)))
    for j in range(out.shape[1]):
        out[:, j] = np.add.reduceat(model.table[:, j][found], begins, dtype=np.float64) / sizes
    return out + model.bias


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def stretches(text: bytes, rng: np.random.Generator) -> list[bytes]:
    """Some stretches of a text, so that short texts are learnt as well."""
    if len(text) <= STRETCH:
        return [text]
    starts = rng.integers(0, len(text) - STRETCH + 1, STRETCHES)
    return [text[s : s + int(rng.integers(40, STRETCH + 1))] for s in starts]


def train(rows: list[tuple[str, str]], seed: int = SEED) -> Model:
    """From (text, language) pairs in a fixed order."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in rows})
    label = {lang: i for i, lang in enumerate(languages)}
    c = len(languages)
    texts, y = [normal(t) for t, _ in rows], np.array([label[lang] for _, lang in rows])
    held = rng.random(len(rows)) < CALIBRATION
    learn = np.flatnonzero(~held) if (~held).any() else np.arange(len(rows))
    embedding = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, c), np.float32), np.zeros(c, np.float32)
    pieces = [(s, y[i]) for i in learn for s in stretches(texts[i], rng)]
    batches = [(*buckets_of([s for s, _ in part]), np.array([k for _, k in part])) for part in _dealt(pieces, rng)]
    epochs = max(EPOCHS, -(-LEAST_STEPS // len(batches)))
    steps, step = epochs * len(batches), 0
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            found, begins, want = batches[b]
            sizes = np.diff(np.append(begins, len(found))).astype(np.float32)
            mean = np.add.reduceat(embedding[found], begins, axis=0) / sizes[:, None]
            error = softmax(mean @ layer + bias)
            error[np.arange(len(want)), want] -= 1.0
            rate = RATE * (1 - step / steps)
            pull = error @ layer.T  # the gradient of each mean
            layer -= (rate / len(want)) * (mean.T @ error)
            bias -= rate * error.mean(axis=0)
            shares = np.repeat(pull / sizes[:, None], sizes.astype(int), axis=0)
            for d in range(WIDTH):
                embedding[:, d] -= rate * np.bincount(found, weights=shares[:, d], minlength=BUCKETS)
            step += 1
    model = Model(languages, (embedding @ layer).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    check = np.flatnonzero(held) if held.any() else learn
    short = [(s, y[i]) for i in check for s in (texts[i], *stretches(texts[i], rng)[:1])]
    return calibrated(model, logits(model, [s for s, _ in short]), np.array([k for _, k in short]))


def _dealt(pieces: list, rng: np.random.Generator) -> Iterator[list]:
    order = rng.permutation(len(pieces))
    for at in range(0, len(order), BATCH):
        yield [pieces[i] for i in order[at : at + BATCH]]


def calibrated(model: Model, found: np.ndarray, want: np.ndarray) -> Model:
    """Sets the temperature of least log loss, and the score that keeps wrong ones among the accepted below ERRORS."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(5.0), 60))
    loss = [-np.log(softmax(found / t)[np.arange(len(want)), want] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(found / model.temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == want
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= ERRORS)
    model.reject_below = float(score[order[fine[-1]]]) if len(fine) else 1.0
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Trains on the driver; ``sample`` and LONGEST bound what it gets. Rows of fold 0 are not used."""
    fit = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 0) & F.col("text").rlike(r"\p{L}") & (F.length("text") <= LONGEST))
    # Ordered by a hash of the id, then by one of the row, so that no id that repeats can stand for very many rows.
    place = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(SEED)).alias("o"), F.xxhash64("text", "lang", F.lit(SEED)).alias("p")
    # First where the sample ends, from hashes alone; then the texts up to there, equal ones once.
    last = fit.select(*place).distinct().orderBy("o", "p").limit(sample).agg(F.max(F.struct("o", "p")).alias("last")).first()["last"]
    if last is None:
        return None
    upto = (F.col("o") < last.o) | (F.col("o") == last.o) & (F.col("p") <= last.p)
    chosen = fit.select(*place, "text", "lang").where(upto).dropDuplicates(["o", "p"]).collect()
    rows = [(r.text, r.lang) for r in sorted(chosen, key=lambda r: (r.o, r.p))]
    return train(rows)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text", 2 << 20):
            texts = batch.column(1).to_pylist()
            names, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            rows = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
            if rows:
                p = softmax(logits(model, [normal(texts[i]) for i in rows]) / model.temperature)
                for i, k, s in zip(rows, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                    names[i], scores[i], rejected[i] = model.languages[k], s, s < model.reject_below
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    found = predict(docs, learn(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rejected")
