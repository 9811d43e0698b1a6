"""What the corpus operators share: stored intermediate tables, word splitting, bounded caches, the memory of Python workers."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.series import shared_folder

#: Words that one worker remembers (about 30 MB).
CACHE_WORDS = 150_000
ODD = 0x9E3779B97F4A7C15
#: Bytes of one Arrow batch on its way to a Python worker.  Executor and worker each hold a few at a time, and the worker what it makes of one.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def work_folder(spark, kind: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/llm/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def ship(spark) -> None:
    """Send this package to Python workers that would not find it by themselves (once per session)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    sc = spark.sparkContext
    if root not in map(os.path.abspath, filter(None, places)) and sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        with tempfile.TemporaryDirectory() as folder:
            sc.addPyFile(shutil.make_archive(f"{folder}/tickloom", "zip", root, "tickloom"))


_shipped: set[str] = set()


def store(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write once to the shared folder and read back: lineage ends here, lost executors cost nothing."""
    path = work_folder(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts and sets travel in batches of ``BATCH_BYTES`` meanwhile, however long they are; a setting of the session's own holds."""
    if spark.conf.get(_BATCH, None) is not None:
        yield
        return
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH)


def in_small_batches(f: Callable) -> Callable:
    """The tables that ``f`` stores of its first argument are made in small batches."""

    @wraps(f)
    def run(docs: DataFrame, *args, **named):
        with small_batches(docs.sparkSession):
            return f(docs, *args, **named)

    return run


_forget: dict[str, Callable[[], None]] = {}
_begun: list[str] = []


def remembered(operator: str, forget: Callable[[], None]) -> None:
    """``forget`` empties what a worker remembers from task to task of an operator."""
    _forget[operator] = forget


def begin(operator: str) -> None:
    """Called where a task begins: what the worker remembers for other operators goes, since it lives on through all stages of a job."""
    if _begun != [operator]:
        _begun[:] = [operator]
        for other, forget in _forget.items():
            if other != operator:
                forget()
        give_back()


def give_back() -> None:
    """Freed memory goes back to the system; the allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if os.name == "posix" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def whole_text(name: str = "text") -> Column:
    """The text, where a missing one is empty."""
    return F.coalesce(F.col(name), F.lit(""))


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value
        return value


#: One cache for each worker process.
WORDS = WordHashes()
remembered("near dedup", WORDS.clear)


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def values_of(column: pa.Array) -> Iterator:
    """The column's values one by one, so that a batch is not held twice."""
    return (x.as_py() for x in column)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    return h * np.uint64(0xD6E8FEB86659FD93)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((ODD, pow(ODD, -1, 1 << 64))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers[0], _powers[1]


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, in time that does not depend on ``n``."""
    if len(words) < n:
        return words[:0]
    up, down = power_tables(len(words) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    return mixed((total[n:] - total[:-n]) * down[: len(words) - n + 1])
