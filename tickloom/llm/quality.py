"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates.

A text is a bag of n-grams over two views of its words: the words themselves in lower case (one and two words), and
their shapes (one to three): letters, capitals and digits reduced to one character each, other characters as they are,
and whether the word repeats the one before.  All are hashed into ``DIMENSIONS`` places; the value of a place is its
share of the n-grams.  A score is the logistic function of a sparse dot product.

The fit reads a bounded sample (``MOST_LABELLED`` labelled rows, in the order of a hash of their ids) and runs in one
task; scoring is one pass over all texts.  The model is a vector of fixed size.

Defined cases: an empty or missing text has no n-grams, its score comes from the intercept; a missing id is never held
out and has no label; where labels repeat an id, the smallest counts; where documents repeat a labelled id, the text that
sorts first is learnt from, so that the bound holds for rows, too; all rows are scored; without labels every score is 0.5; texts are read
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import CACHE_WORDS, begin, in_small_batches, remembered, store, values_of, whole_text

BITS = 18
DIMENSIONS = 1 << BITS
MOST_LABELLED = 8000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.3, 1.0, 1e-3, 1e-6
#: Values are shares times this, so that they and the intercept move at a like pace.
SCALE = 30.0

_LOWER, _UPPER, _DIGITS = re.compile("[a-zß-ÿ]+"), re.compile("[A-ZÀ-Þ]+"), re.compile("[0-9]+")
_SHAPE = np.uint64(0xFFFFF)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shape(word: str) -> str:
    word = _UPPER.sub(lambda m: "A" if len(m[0]) == 1 else "AA", word)
    return _DIGITS.sub("0", _LOWER.sub("a", word))[:8]


class WordCodes(dict):
    """44 bits of a hash of the word in lower case, 20 bits of a hash of its shape; bounded."""

    def __missing__(self, word: str) -> int:
        value = (xxhash.xxh64_intdigest(word.lower()) & ~0xFFFFF) | (xxhash.xxh64_intdigest(shape(word)) >> 44)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value
        return value


CODES = WordCodes()
remembered("quality", CODES.clear)


def places(text: str) -> np.ndarray:
    """Place of every n-gram of a text, repeated as often as it occurs."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64)
    code = np.fromiter(map(CODES.__getitem__, words), np.uint64, len(words))
    word, form = code & ~_SHAPE, (code & _SHAPE) + np.uint64(1)
    form[1:] += (word[1:] == word[:-1]).astype(np.uint64) << np.uint64(21)
    two = form[:-1] * _A + form[1:]
    three = two[:-1] * _A + form[2:]
    h = np.concatenate([word, (word[:-1] * _A + word[1:]) * _B, form * _B, (two + np.uint64(3)) * _B, (three + np.uint64(7)) * _B])
    return (((h ^ (h >> np.uint64(29))) * _B) >> np.uint64(64 - BITS)).astype(np.int64)


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and their values; the last place is the intercept."""
    at, n = np.unique(places(text), return_counts=True)
    return np.append(at, DIMENSIONS), np.append(n * (SCALE / max(1, n.sum())), 1.0)


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 0) -> np.ndarray:
    """Weights by per-coordinate FTRL-proximal updates over shuffled rows."""
    z, n, w = (np.zeros(DIMENSIONS + 1) for _ in range(3))
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            now = w[at]
            g = (logistic(now @ x) - labels[i]) * x
            seen = n[at]
            total = seen + g * g
            z[at] += g - (np.sqrt(total) - np.sqrt(seen)) / ALPHA * now
            n[at] = total
            zz = z[at]
            w[at] = np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(total)) / ALPHA + L2))
    return w


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@in_small_batches
def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights learnt from at most ``most`` labelled rows that are not held out."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("doc")).agg(F.min(label).cast("int").alias("label"))
    sample = store(known.orderBy(F.xxhash64("doc"), "doc").limit(most), "labelled")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("quality")
        for batch in batches:
            rows = [sparse(t) for t in values_of(batch.column(2))]
            yield pa.RecordBatch.from_pydict({
                "doc": batch.column(0), "label": batch.column(1), "at": pa.array([a.astype("<i4").tobytes() for a, _ in rows], pa.binary()),
                "x": pa.array([x.astype("<f4").tobytes() for _, x in rows], pa.binary())})

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc", "at"])
        rows = [(np.frombuffer(a, "<i4"), np.frombuffer(x, "<f4")) for a, x in zip(pdf["at"], pdf["x"], strict=True)]
        return pd.DataFrame({"weights": [train(rows, pdf["label"].to_numpy()).astype("<f4").tobytes()]})

    # the sample holds ``most`` ids, whatever the size of the corpus; copies of an id fall together before the shuffle
    texts = docs.select(F.col(id_col).alias("doc"), whole_text(text_col).alias("text")).join(F.broadcast(sample), "doc")
    texts = texts.groupBy("doc", "label").agg(F.min("text").alias("text"))
    kind = texts.schema["doc"].dataType.simpleString()
    ready = store(texts.mapInArrow(featured, f"doc {kind}, label int, at binary, x binary"), "features")
    model = ready.withColumn("fit", F.lit(0)).groupBy("fit").applyInPandas(learn, "weights binary").first()
    return np.frombuffer(model[0], "<f4") if model else np.zeros(DIMENSIONS + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, held_out, score (likelihood of label 1) and predicted (1 from 0.5 on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("quality")
        for batch in batches:
            totals = []
            for text in values_of(batch.column(2)):
                at = places(text)
                # the dot product with shares as values is the mean weight of the n-grams
                totals.append(float(weights[at].sum(dtype=np.float64)) * SCALE / max(1, len(at)) + float(weights[DIMENSIONS]))
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "held_out": batch.column(1), "score": pa.array(logistic(np.array(totals, float)), pa.float64())})

    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), whole_text(text_col).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
