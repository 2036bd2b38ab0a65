"""Toxicity: a linear classifier on words, regularised by counterfactuals.

A labelled text that names a group (a religion, a gender, an origin, ...) is paired with the text in which each such
name is swapped for another of its kind. The loss is the logistic loss, a ridge penalty, and the squared change of the
score between a text and its swapped twin, so that naming a group moves the score little by itself.

Words are kept as features if their frequency in toxic and other training texts differs significantly; names of groups
are always features. The classifier is fitted in one task on at most about sample_rows labelled rows, taken by a hash
of doc_id; that is its documented bound. Scoring reads every whole text, in tasks that hold the weights only.

Defined cases: null and empty texts get the score of the intercept. Labels that are null are not used; without labels
of both classes every score is the smoothed share of toxic rows. Repeated rows are each scored. Columns other than
doc_id and text, doc_id and toxic are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incognita.llm import session
from incognita.llm import text_arrays as ta

# Names of groups that stand for one another.
IDENTITY = (
    "christian muslim jewish hindu buddhist sikh atheist catholic protestant",
    "christians muslims jews hindus buddhists sikhs atheists catholics protestants",
    "man woman", "men women", "boy girl", "boys girls", "male female transgender nonbinary",
    "gay lesbian straight bisexual queer heterosexual homosexual",
    "black white asian hispanic latino african european arab indigenous",
    "american mexican chinese indian german french spanish british russian japanese turkish polish",
    "old young elderly", "disabled deaf blind autistic", "immigrant refugee native foreigner", "immigrants refugees natives foreigners",
)


def _word_hashes(words: list[str]) -> np.ndarray:
    data, offsets = ta.buffers(pa.array(words))
    return ta.Words(data, offsets, ta.ALNUM_LOWER).hashes()


_SWAPS = {int(a): int(b) for group in IDENTITY for h in [_word_hashes(group.split())] for a, b in zip(h, np.roll(h, -1))}


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct word hashes of each text, with its label."""
    for batch, data, offsets in ta.pieces(batches, "text"):
        words = ta.Words(data, offsets, ta.ALNUM_LOWER)
        hashes = words.hashes()
        own = [np.unique(hashes[a:b]).tobytes() for a, b in zip(words.first[:-1], words.first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(own, pa.binary())], ["toxic", "words"])


def select_words(rows: list[np.ndarray], y: np.ndarray, least_rows: int, least_z: float) -> np.ndarray:
    """Sorted hashes of words whose share of toxic rows differs from that of all rows by least_z standard errors."""
    every = np.concatenate(rows) if rows else np.empty(0, ta.U64)
    toxic = np.concatenate([r for r, t in zip(rows, y) if t] or [np.empty(0, ta.U64)])
    keys, n = np.unique(every, return_counts=True)
    found, hits = np.unique(toxic, return_counts=True)
    k = np.zeros(len(keys))
    k[np.searchsorted(keys, found)] = hits
    share = y.mean()
    z = (k - n * share) / np.sqrt(n * share * (1 - share))
    return keys[(n >= least_rows) & (np.abs(z) >= least_z)]


def fit(rows: list[np.ndarray], y: np.ndarray, words: np.ndarray, ridge: float, counterfactual: float, steps: int = 500) -> tuple[np.ndarray, float]:
    """Weights of words and the intercept, by accelerated gradient steps with a safe step length."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows)
    at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
    hit = words[at] == flat
    row, column = row[hit], at[hit]
    # The difference that swapping makes: minus the name, plus the one it is swapped for.
    swapped = [(r, np.searchsorted(words, ta.U64(h)), np.searchsorted(words, ta.U64(_SWAPS[h]))) for r, h in zip(row.tolist(), words[column].tolist()) if h in _SWAPS]
    d_row = np.array([r for r, _, _ in swapped for _ in "ab"], dtype=np.int64)
    d_column = np.array([c for _, a, b in swapped for c in (a, b)], dtype=np.int64)
    d_value = np.tile([-1.0, 1.0], len(swapped))
    n, m = len(rows), len(words)
    # Both classes weigh the same, however rare one is.
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        score = b + np.bincount(row, w[column], minlength=n)
        off = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) * share
        g = np.bincount(column, off[row], minlength=m) / n + ridge * w
        if len(d_row):
            change = np.bincount(d_row, d_value * w[d_column], minlength=n)
            g += 2 * counterfactual * np.bincount(d_column, d_value * change[d_row], minlength=m) / n
        return g, off.mean()

    # Each weight has a step of its own, from how often its word occurs and is swapped.
    often = np.bincount(column, share[row], minlength=m) + 8 * counterfactual * np.bincount(d_column, minlength=m)
    widest = max(1, np.bincount(row, minlength=1).max(initial=1) + 1)
    step = 1 / (0.25 * np.minimum(widest, 40) * often / n + ridge)
    w, b = np.zeros(m), 0.0
    last_w, last_b = w.copy(), b
    for t in range(steps):
        push = t / (t + 3)
        v, c = w + push * (w - last_w), b + push * (b - last_b)
        g, g0 = gradient(v, c)
        last_w, last_b = w, b
        w, b = v - step * g, c - 0.1 * g0
    return w, b


def _fitted(least_rows: int, least_z: float, ridge: float, counterfactual: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["words", "toxic"], kind="stable")
        rows = [np.frombuffer(x, ta.U64) for x in frame["words"]]
        y = frame["toxic"].to_numpy(np.float64)
        if 0 < y.sum() < len(y):
            words = np.union1d(select_words(rows, y, least_rows, least_z), np.array(sorted(_SWAPS), ta.U64))
            weights, intercept = fit(rows, y, words, ridge, counterfactual)
        else:
            share = (y.sum() + 0.5) / (len(y) + 1)
            words, weights, intercept = np.empty(0, ta.U64), np.empty(0), float(np.log(share / (1 - share)))
        return pd.DataFrame({"words": [words.tobytes()], "weights": [weights.tobytes()], "intercept": [intercept]})

    return run


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, least_rows: int = 5, least_z: float = 5.0, ridge: float = 5e-5, counterfactual: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Word hashes, weights and intercept from the labelled rows of docs (doc_id, text); labels has doc_id and toxic."""
    session.prepare(docs.sparkSession)
    labels = session.columns(labels, "doc_id", "toxic").filter("toxic is not null and doc_id is not null")
    n = labels.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / max(n, 1)))
    some = labels.filter(part).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    # At most about sample_rows rows of two numbers.
    texts = session.columns(docs, "doc_id", "text").join(F.broadcast(some), "doc_id").select("toxic", "text")
    sample = texts.mapInArrow(_featured, "toxic int, words binary").withColumn("all", F.lit(0))
    model = sample.groupBy("all").applyInPandas(_fitted(least_rows, least_z, ridge, counterfactual), "words binary, weights binary, intercept double").first()
    if model is None:
        return np.empty(0, ta.U64), np.empty(0), 0.0
    return np.frombuffer(bytes(model.words), ta.U64), np.frombuffer(bytes(model.weights), np.float64), model.intercept


def _scored(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, intercept = shared.value
        for batch, data, offsets in ta.pieces(batches, "text"):
            words = ta.Words(data, offsets, ta.ALNUM_LOWER)
            hashes = words.hashes()
            sums = np.full(batch.num_rows, float(intercept))
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[at] == hashes
                both = np.unique(words.text[hit].astype(np.int64) * len(keys) + at[hit])
                sums += np.bincount(both // len(keys), weights[both % len(keys)], minlength=batch.num_rows)
            found = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """docs, which has text and no score, with score from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scored(shared), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    """The rows whose labels are for measuring only."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
