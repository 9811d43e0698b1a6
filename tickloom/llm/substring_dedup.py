"""Repeated passages by seed and extend.

A passage is repeated when at least ``window`` consecutive words of it also start elsewhere.  Every window owns an
anchor: the smallest hash among its runs of ``seed`` words.  Equal windows own equal anchors, so only windows whose
anchor occurs at two or more places can be repeated (the seeds).  From its seeds a text is extended both ways: each
window around a seed is compared, by the hash of all its words, with the windows around the same seed elsewhere, and
those that stay alone drop out.  What is left of consecutive windows joins into maximal repeats.

The seeds travel as a bitmap of at most ``MOST_BITS`` bits: its false hits only add windows to the comparison, which is
exact.  (Where the seeds of a corpus outgrow the bitmap, more windows are compared, up to all of them.)  Windows are
counted with partial sums, so a passage in a third of all documents is one row per task.  A window that stays alone
needs no second look-up, since its count carries its place.

Defined cases: a missing text has no words; a missing id stays missing; rows that repeat an id or a text are documents
of their own, so their passages repeat; texts shorter than a window stay whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import hashed, runs, store, values_of, whole_text

WINDOW = 35
SEED = 8
#: 2 MB at least 8 KB; at the largest, a driver and every worker hold 16 MB.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
SLICE_BITS = 1 << 20



def owned(words: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all seed runs, and for every window the place of the smallest one inside it."""
    h = runs(words, seed)
    span = window - seed + 1
    if len(h) < span:
        return h, np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, span)
    return h, view.argmin(axis=1) + np.arange(len(view))


def seed_bitmap(docs: DataFrame, text_col: str, window: int, seed: int) -> np.ndarray:
    """Bits of the anchors that occur at two places or more; the place of a bit is the end of its hash."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for text in values_of(batch.column(0)):
                h, place = owned(hashed(text.encode().split()), window, seed)
                if len(place):
                    found.append(h[place[np.flatnonzero(np.diff(place, prepend=-1))]])
            value, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": pa.array(value.view(np.int64)), "n": pa.array(n, pa.int64())})

    def slice_of(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(SLICE_BITS // 8, np.uint8)
        at = pdf["place"].to_numpy() % SLICE_BITS
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "bits": [bits.tobytes()]})

    counted = docs.select(whole_text(text_col).alias("text")).mapInArrow(anchors, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    seeds = store(counted.filter("n > 1").select("h"), "seeds")
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * seeds.count()).bit_length()))
    places = seeds.select(F.col("h").bitwiseAND(F.lit(size - 1)).alias("place")).distinct().withColumn("part", F.expr(f"place div {SLICE_BITS}"))
    bits = np.zeros(max(size, SLICE_BITS) // 8, np.uint8)
    for row in places.groupBy("part").applyInPandas(slice_of, "part long, bits binary").collect():  # MOST_BITS at most
        bits[row.part * SLICE_BITS // 8 :][: SLICE_BITS // 8] = np.frombuffer(row.bits, np.uint8)
    return bits[: size // 8]


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_words, words_sha256, and for texts with seeds the packed words, the starts
    of their windows around seeds, and which of these (``alone``) start nowhere else."""
    bitmap = docs.sparkSession.sparkContext.broadcast(seed_bitmap(docs, text_col, window, seed))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, pack = bitmap.value, zstandard.ZstdCompressor(level=3).compress
        mask = np.uint64(len(bits) * 8 - 1)
        for batch in batches:
            sizes, shas, packed, starts, hashes = [], [], [], [], []
            for text in values_of(batch.column(1)):
                words = text.encode().split()
                values = hashed(words)
                h, place = owned(values, window, seed)
                at = (h & mask).astype(np.int64)
                seeded = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
                near = np.flatnonzero(seeded[place])
                line = b" ".join(words)
                sizes.append(len(words))
                shas.append(hashlib.sha256(line).hexdigest())
                packed.append(pack(line) if len(near) else None)
                starts.append(near.astype(np.int32))
                hashes.append(runs(values, window)[near].view(np.int64))
            yield pa.RecordBatch.from_pydict({
                id_col: batch.column(0), "n_words": pa.array(sizes, pa.int64()), "words_sha256": pa.array(shas, pa.string()), "words": pa.array(packed, pa.binary()),
                "starts": pa.array(starts, pa.list_(pa.int32())), "hashes": pa.array(hashes, pa.list_(pa.int64()))})

    rows = docs.select(F.col(id_col), whole_text(text_col).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    seeded = store(
        rows.mapInArrow(extend, f"`{id_col}` {kind}, n_words long, words_sha256 string, words binary, starts array<int>, hashes array<long>")
        .withColumn("row", F.monotonically_increasing_id()),
        "seeded",
    )
    windows = seeded.select("row", F.explode(F.arrays_zip("hashes", "starts")).alias("w")).select("row", "w.hashes", "w.starts")
    # a count of one carries its own place, so nothing is looked up again
    single = windows.groupBy("hashes").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.min("starts").alias("start")).filter("n = 1")
    alone = single.groupBy("row").agg(F.collect_list("start").alias("alone"))
    return seeded.drop("hashes").join(alone, "row", "left")


def covered(n_words: int, starts: np.ndarray, alone: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a repeated window."""
    first = np.setdiff1d(starts, alone, assume_unique=True)
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + window, -1)
    return np.cumsum(edge[:-1]) > 0


def digests(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            removed, shas = [], []
            for n, sha, words, starts, alone in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                gone = covered(n, np.array(starts, np.int64), np.array(alone or [], np.int64), window) if words is not None else np.zeros(0, bool)
                removed.append(int(gone.sum()))
                if removed[-1]:
                    sha = hashlib.sha256(b" ".join(w for w, g in zip(unpack(words).split(b" "), gone.tolist(), strict=True) if not g)).hexdigest()
                shas.append(sha)
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "n_words": batch.column(1), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string())})

    found = repeats(docs, window, seed, id_col, text_col).select(id_col, "n_words", "words_sha256", "words", "starts", "alone")
    kind = found.schema[0].dataType.simpleString()
    return found.mapInArrow(cut, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string")


def passages(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per maximal repeat: the id, first word, end (exclusive), and its text."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            at, firsts, ends, texts = [], [], [], []
            for i, (n, words, starts, alone) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)):
                gone = covered(n, np.array(starts, np.int64), np.array(alone or [], np.int64), window)
                edge = np.diff(np.concatenate([[0], gone, [0]]))
                line = unpack(words).split(b" ")
                for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                    at.append(i), firsts.append(a), ends.append(b), texts.append(b" ".join(line[a:b]).decode())
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0).take(pa.array(at, pa.int64())), "first": pa.array(firsts, pa.int64()), "end": pa.array(ends, pa.int64()), "passage": pa.array(texts, pa.string())})

    found = repeats(docs, window, seed, id_col, text_col).filter("words IS NOT NULL").select(id_col, "n_words", "words", "starts", "alone")
    kind = found.schema[0].dataType.simpleString()
    return found.mapInArrow(spans, f"`{id_col}` {kind}, first long, end long, passage string")
