"""Token ids in Arrow files of equal-length sequences.

One file per range of document ids, in ascending order.  A file is an Arrow IPC file whose rows are sequences of
``length`` ids (a fixed-size list) with a mask of the same length; record batches hold ``BATCH_ROWS`` rows each, the
last may hold fewer.  The ids of a range follow one another without gaps; only the last row of a file is filled up,
with mask 0.  Ids take two bytes where the vocabulary allows, else four.  Batches are uncompressed and mapped into
memory, so row i of a file, or any stretch of ids, is read in place.

A table of documents (id, file, first id inside the file, number of ids) goes with the files, since an end id may
also occur inside a text.  It is one row per document and, like the files, is written by the tasks of the id ranges.  A
task attempt writes files under names of its own and the table records the attempt whose rows were committed, so a
repeated or speculative attempt neither meets nor replaces a file; what it leaves behind is never read.

Byte-level BPE encodes every pre-token by itself, so a worker gives each distinct one to the tokenizer once and remembers
its ids, within a bound.  Those that begin with a space are given in a row, as one text.

Defined cases: a missing text is an empty text and gives its end id alone; missing ids come first; rows with equal ids
follow one another in the order of the first ``ORDERED_BY`` characters of their texts, then of a hash of them, and may fill
several files; long texts take memory in proportion to their length only once; an
empty table gives an empty corpus; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import give_back, in_small_batches, store, whole_text, work_folder
from tickloom.llm.pretokens import PreTokens

LENGTH = 2048
BATCH_ROWS = 256
#: Characters whose new pre-tokens are given to the tokenizer at once, and half the pre-tokens that one worker remembers.
ENCODED_AT_ONCE = 1_000_000
CACHE_PARTS = 250_000
#: Characters by which texts of one id are ordered; the range bounds hold no longer ones.
ORDERED_BY = 64


@dataclass(frozen=True)
class TokenCorpus:
    folder: str
    length: int
    id_col: str
    documents: DataFrame  # id_col, shard, attempt, first, n_tokens


class Encoder:
    """Ids of texts by the tokenizers library, each distinct pre-token encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        self.pre = PreTokens(path)
        self.vocabulary_size = self.pre.library.get_vocab_size()
        plain = self.pre.library.get_vocab(with_added_tokens=False)
        #: by id: the token begins with a space
        self.begins = np.zeros(1 + max([*plain.values(), *self.pre.library.get_vocab().values()], default=0), bool)
        self.begins[[i for token, i in plain.items() if token.startswith("Ġ")]] = True
        self.side_by_side = not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in self.pre.spec["added_tokens"])
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # what was known when it last was full

    def learn(self, parts: list[bytes]) -> None:
        """From now on these are known; they were not before."""
        if len(self.known) + len(parts) > CACHE_PARTS:
            self.older, self.known = self.known, {}
        again = {p: self.older[p] for p in parts if p in self.older}
        self.known.update(again)
        spaced, others = [], []
        for part in (p.decode() for p in parts if p not in again):
            (spaced if part[0] == " " and len(part) > 1 and not part[1].isspace() else others).append(part)
        for at in range(0, len(spaced), 10_000):
            self.known.update(self.in_a_row(spaced[at : at + 10_000]))
        for at in range(0, len(others), 10_000):
            self.known.update(self.apart(others[at : at + 10_000]))

    def apart(self, parts: list[str]) -> Iterable[tuple[bytes, bytes]]:
        found = self.pre.library.encode_batch_fast(parts, add_special_tokens=False)
        return zip(map(str.encode, parts), [pack(f"<{len(e)}I", *e.ids) for e in found], strict=True)

    def in_a_row(self, parts: list[str]) -> Iterable[tuple[bytes, bytes]]:
        """Pre-tokens that begin with their only space: the library cuts their row at every space, and a token with one begins each."""
        if not self.side_by_side:
            return self.apart(parts)
        (row,) = self.pre.library.encode_batch_fast(["".join(parts)], add_special_tokens=False)
        ids = np.array(row.ids, "<u4")
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(parts) or starts[0]:
            return self.apart(parts)
        data, places = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
        return zip(map(str.encode, parts), [data[a:b] for a, b in pairwise(places)], strict=True)

    def encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, as 32-bit integers."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size + len(texts[at]) <= ENCODED_AT_ONCE):
                group.append(texts[at])
                size += len(texts[at])
                at += 1
            parts, counts = self.pre.cut_all(group)
            coded = parts.dictionary_encode()
            _, places, data = coded.dictionary.buffers()
            bounds, data = np.frombuffer(places, np.int64)[: len(coded.dictionary) + 1].tolist(), data.to_pybytes() if data else b""
            distinct = [data[a:b] for a, b in pairwise(bounds)]
            found = [*map(self.known.get, distinct)]
            if None in found:
                self.learn([p for p, ids in zip(distinct, found, strict=True) if ids is None])
                found = [ids or self.known[p] for p, ids in zip(distinct, found, strict=True)]
            ids, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
            codes = coded.indices.to_numpy()
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[codes])])
            row = ids[np.repeat((np.cumsum(sizes) - sizes)[codes] - ends[:-1], sizes[codes]) + np.arange(ends[-1])]
            for a, b in pairwise(ends[np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])].tolist()):
                yield row[a:b]


@lru_cache(2)
def encoder_of(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    return Encoder(path)


class SequenceWriter:
    """Packs a stream of ids into equal-length rows of one file."""

    def __init__(self, sink, length: int, dtype: np.dtype):
        self.length, self.dtype = length, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))], {"length": str(length)})
        self.file = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.size = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.dtype))
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= BATCH_ROWS * self.length:
            self.flush(final=False)

    def flush(self, final: bool) -> None:
        ids = np.concatenate([*self.waiting, np.zeros(0, self.dtype)])
        step = BATCH_ROWS * self.length
        full = len(ids) // step * step
        for at in range(0, full, step):
            self.batch(ids[at : at + step], step)
        rest = ids[full:]
        if final and len(rest):
            padded = -(-len(rest) // self.length) * self.length
            self.batch(np.concatenate([rest, np.zeros(padded - len(rest), self.dtype)]), len(rest))
            rest = rest[:0]
        self.waiting, self.size = [rest], len(rest)

    def batch(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(ids), mask)]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        self.flush(final=True)
        self.file.close()


class SequenceFile:
    """Random access to one file; arrays are views of the mapped file where it is local."""

    def __init__(self, folder: str, shard: int, attempt: int | None = None):
        system, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        if attempt is None:  # finished files of one shard hold the same rows
            names = (f.base_name for f in system.get_file_info(fs.FileSelector(base)))
            path = f"{base}/{min(n for n in names if n.startswith(name_of(shard, '')))}"
        else:
            path = f"{base}/{name_of(shard, attempt)}"
        source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.length = int(self.file.schema.metadata[b"length"])

    @lru_cache(4)  # noqa: B019  (batches are views; files are few and short-lived)
    def batch(self, i: int) -> pa.RecordBatch:
        return self.file.get_batch(i)

    def ids(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from place ``first`` of the file on."""
        step, out = BATCH_ROWS * self.length, []
        while count:
            i, at = divmod(first, step)
            n = min(count, step - at)
            out.append(self.batch(i).column(0).values.to_numpy()[at : at + n])
            first, count = first + n, count - n
        return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.uint16), *out])

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one row."""
        i, at = divmod(row, BATCH_ROWS)
        ids, mask = (self.batch(i).column(k).values for k in (0, 1))
        place = slice(at * self.length, (at + 1) * self.length)
        return ids.to_numpy()[place], mask[place.start : place.stop].to_numpy(zero_copy_only=False)


def name_of(shard: int, attempt: int | str) -> str:
    return f"ids-{shard:06d}-{attempt}" + (".arrow" if attempt != "" else "")


@in_small_batches
def write(docs: DataFrame, vocabulary: str, end_id: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> TokenCorpus:
    """Encode every text, append ``end_id``, and write files in ascending id order to a shared folder."""
    folder = folder or work_folder(docs.sparkSession, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        dtype = np.dtype(np.uint16 if max(encoder.vocabulary_size, end_id + 1) <= 1 << 16 else np.uint32)
        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        system, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(base)
        # the name of a finished file is given in one step
        own = f"{base}/.{name_of(shard, attempt)}"
        writer = None
        with system.open_output_stream(own) as sink:
            writer = SequenceWriter(sink, length, dtype)
            for batch in batches:
                firsts, sizes = [], []
                for ids in encoder.encoded(batch.column(1).to_pylist()):
                    firsts.append(writer.total)
                    sizes.append(len(ids) + 1)
                    writer.add(np.append(ids, np.uint32(end_id)))
                yield pa.RecordBatch.from_pydict({
                    id_col: batch.column(0), "shard": pa.array([shard] * len(sizes), pa.int64()), "attempt": pa.array([attempt] * len(sizes), pa.int64()), "first": pa.array(firsts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})
            writer.close()
        system.move(own, f"{base}/{name_of(shard, attempt)}")
        give_back()

    text = whole_text(text_col)
    rows = docs.select(F.col(id_col), text.alias("text"), F.substring(text, 1, ORDERED_BY).alias("begin"), F.xxhash64(text).alias("digest"), F.monotonically_increasing_id().alias("place"))
    # a range may end inside the rows of one id, also inside copies of one text
    order = [id_col, "begin", "digest", "place"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(id_col, "text")
    kind = rows.schema[0].dataType.simpleString()
    return TokenCorpus(folder, length, id_col, store(ordered.mapInArrow(run, f"`{id_col}` {kind}, shard long, attempt long, first long, n_tokens long"), "token-documents"))


def read_digests(corpus: TokenCorpus) -> DataFrame:
    """One row per document, read back from the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    folder, id_col = corpus.folder, corpus.id_col

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            crcs = np.zeros(len(pdf), np.int64)
            for (shard, attempt), rows in pdf.groupby(["shard", "attempt"]).indices.items():
                file = SequenceFile(folder, int(shard), int(attempt))
                for i in rows:
                    crcs[i] = zlib.crc32(file.ids(int(pdf["first"].iat[i]), int(pdf["n_tokens"].iat[i])).astype("<u4").tobytes())
            yield pdf.assign(ids_crc32=crcs)

    # one row per file, not per document
    sizes = corpus.documents.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = store(sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before")), "token-offsets")
    kind = corpus.documents.schema[0].dataType.simpleString()
    read = corpus.documents.mapInPandas(run, f"`{id_col}` {kind}, shard long, attempt long, first long, n_tokens long, ids_crc32 long")
    return read.join(offsets, "shard").select(id_col, (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
