"""Exact duplicates by counting quotient filters.

Every partition counts the 64-bit fingerprints of its texts in quotient filters, one per range of
fingerprints.  The filters of a range merge without loss, because each is a sorted list of quotient,
remainder and count.  Only texts whose merged count is above one are looked at again, byte by byte;
all others are unique by their fingerprint alone.

Texts are equal when they are identical after lower-casing A-Z.

Defined cases: a missing text is an empty text; a missing id ranks below every other; of rows that repeat
one id and text, the row stored last stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import begin, in_small_batches, store, whole_text

#: Fingerprints that one merged filter holds on average.
RANGE_SIZE = 1 << 16


@dataclass(frozen=True)
class CountingQuotientFilter:
    """Exact counts of fingerprints of ``bits`` bits.

    The high ``quotient_bits`` of a fingerprint choose a run; the rest, its remainder, is stored in the run in
    ascending order.  ``occupied`` has a bit per quotient with a run, ``run_ends`` a bit per slot that ends one.
    """

    bits: int
    quotient_bits: int
    occupied: np.ndarray
    run_ends: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(values: np.ndarray, bits: int, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """Filter of fingerprints (uint64 below 2**bits); equal ones add up."""
        values, place = np.unique(values, return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(values)).astype(np.uint64)
        q = min(bits, max(1, int(len(values)).bit_length()))
        quotients = values >> np.uint64(bits - q)
        occupied = np.zeros(1 << q, bool)
        occupied[quotients.astype(np.int64)] = True
        ends = np.ones(len(values), bool)
        ends[:-1] = quotients[1:] != quotients[:-1]
        return CountingQuotientFilter(bits, q, occupied, ends, values & np.uint64((1 << (bits - q)) - 1), total)

    def values(self) -> np.ndarray:
        """The fingerprints in ascending order."""
        runs = np.cumsum(np.concatenate([[False], self.run_ends[:-1]])) if len(self.run_ends) else np.zeros(0, np.int64)
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)[runs.astype(np.int64)]
        return (quotients << np.uint64(self.bits - self.quotient_bits)) | self.remainders

    @staticmethod
    def merge(filters: Iterable[CountingQuotientFilter]) -> CountingQuotientFilter:
        """One filter with the counts of all; nothing is lost."""
        filters = list(filters)
        return CountingQuotientFilter.of(
            np.concatenate([f.values() for f in filters]), filters[0].bits, np.concatenate([f.counts for f in filters])
        )

    def above(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        many = self.counts > count
        return self.values()[many], self.counts[many]

    def pack(self) -> bytes:
        """Bit vectors for runs, remainders in as few bytes as they need, and counts only where above one."""
        width = (self.bits - self.quotient_bits + 7) // 8
        many = self.counts > 1
        head = np.array([self.bits, self.quotient_bits, len(self.remainders), many.sum()], "<u4").tobytes()
        slots = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        flags = [np.packbits(x).tobytes() for x in (self.occupied, self.run_ends, many)]
        return b"".join([head, *flags, slots, self.counts[many].astype("<u8").tobytes()])

    @staticmethod
    def unpack(data: bytes) -> CountingQuotientFilter:
        bits, q, n, n_many = (int(x) for x in np.frombuffer(data, "<u4", 4))
        at = 16

        def vector(size: int) -> np.ndarray:
            nonlocal at
            used = (size + 7) // 8
            out = np.unpackbits(np.frombuffer(data, np.uint8, used, at), count=size).astype(bool)
            at += used
            return out

        occupied, ends, many = vector(1 << q), vector(n), vector(n)
        width = (bits - q + 7) // 8
        slots = np.zeros((n, 8), np.uint8)
        slots[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        counts = np.ones(n, np.uint64)
        counts[many] = np.frombuffer(data, "<u8", n_many, at + n * width)
        return CountingQuotientFilter(bits, q, occupied, ends, slots.view("<u8").ravel(), counts)


@F.pandas_udf(T.BinaryType())
def folded(text: pd.Series) -> pd.Series:
    """UTF-8 bytes with A-Z in lower case; all other bytes as they are."""
    begin("exact dedup")
    return pd.Series([x.encode().lower() for x in text], dtype=object)


def repeated_fingerprints(prints: DataFrame, column: str = "fp") -> DataFrame:
    """Fingerprints found more than once with their counts: filters per partition, merged per range."""
    ranges = max(0, (max(1, prints.count()) // RANGE_SIZE).bit_length())
    bits = 64 - ranges

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        values = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        group = (values >> np.uint64(bits)).astype(np.int64) if ranges else np.zeros(len(values), np.int64)
        cuts = np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else group
        for lo, hi in zip(cuts, [*cuts[1:], len(values)]):
            rest = values[lo:hi] & np.uint64((1 << bits) - 1)
            yield pa.RecordBatch.from_pydict({"part": pa.array([group[lo]], pa.int64()), "filter": pa.array([CountingQuotientFilter.of(rest, bits).pack()], pa.binary())})

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        values, counts = CountingQuotientFilter.merge(map(CountingQuotientFilter.unpack, pdf["filter"])).above(1)
        full = values | np.uint64(int(pdf["part"].iloc[0]) << bits if ranges else 0)
        return pd.DataFrame({column: full.view(np.int64), "copies": counts.astype(np.int64)})

    filters = prints.select(column).mapInArrow(build, "part long, filter binary")
    return filters.groupBy("part").applyInPandas(combine, f"{column} long, copies long")


@in_small_batches
def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, key_bits: int = 256) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, keep_id, group_size, kept, text_sha256, and ``row_col`` if given.

    Of equal texts the row with the largest id stays; ``row_col`` tells rows with equal ids apart.  ``key_bits`` is the digest that names a text between
    jobs; the byte comparison proves that no digest names two texts, and takes a wider one if it ever did.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    texts = docs.select(F.col(id_col).alias("doc"), row.alias("row"), folded(whole_text(text_col)).alias("norm"))
    named = texts.select("doc", "row", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("sha"), F.sha2("norm", key_bits).alias("key"), "norm")
    prints = store(named.select("doc", "row", "fp", "sha", "key"), "prints")
    again = store(repeated_fingerprints(prints), "repeated")

    # byte verification: grouping compares whole texts, and copies fall together before the shuffle
    routed = named.join(again, "fp", "left_semi").groupBy("fp", "key", "norm").agg(F.count(F.lit(1)).alias("n"))
    verified = store(routed.groupBy("fp", "key").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n")), "verified")
    if key_bits < 512 and not verified.filter("texts > 1").isEmpty():
        return decide(docs, id_col, text_col, row_col, 512)

    last = prints.join(again, "fp", "left_semi").groupBy("fp", "key").agg(F.max(F.struct("doc", "row")).alias("last"))
    groups = store(last.join(verified, ["fp", "key"]).select("fp", "key", "n", "last"), "groups")
    return prints.join(groups, ["fp", "key"], "left").select(
        F.col("doc").alias(id_col),
        F.when(F.col("n").isNull(), F.col("doc")).otherwise(F.col("last.doc")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("last.row"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )
