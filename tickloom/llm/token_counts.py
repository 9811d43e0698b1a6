"""Token counts of every prefix of a text.

Byte-level BPE: a text is cut into pre-tokens, each encoded by itself, so the count of a prefix is the count up to
its last pre-token plus an entry of that pre-token's own table, where the count of a prefix is one more than the
count before its last token.  Budgets and cuts are answered from these tables without encoding again.  A piece
model has one table per part in the same way.

Defined cases: a missing text is an empty text and has no tokens; a missing id stays missing; every row is counted by
itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.bpe import Bounded, PrefixTable, ranked_pairs
from tickloom.llm.common import whole_text
from tickloom.llm.piece_codec import codec_of
from tickloom.llm.pretokens import PreTokens

SPACE = re.compile(r"\s")
#: Pre-tokens that one worker remembers.
CACHE_PARTS = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible, else one from U+0100 on, in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(0x100 + hidden.index(b)) for b in range(256)]


class ByteCounter:
    """Prefix token counts for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        self.pre = PreTokens(path)
        model = self.pre.spec["model"]
        merges = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.symbols = {b: s for b, s in enumerate(byte_symbols())}
        self.table = PrefixTable(model["vocab"], ranked_pairs(merges))
        self.sizes = Bounded(lambda part: self.prefixes(part)[-1], CACHE_PARTS)

    def prefixes(self, part: str) -> list[int]:
        """Tokens of the first i characters of one pre-token; entry 0 is 0."""
        data = part.encode()
        counts = self.table.counts("".join(map(self.symbols.__getitem__, data)))
        return [0, *(counts[i] for i in accumulate(len(c.encode()) for c in part))]

    def count(self, text: str) -> int:
        return sum(1 if added else sum(map(self.sizes.__getitem__, self.pre.cut(part))) for part, added in self.pre.segments(text))

    def marks(self, text: str) -> tuple[list[int], list[int]]:
        """Starts of all pre-tokens (and the text's end), and the tokens before each."""
        starts, counts = [0], [0]
        for part, added in self.pre.segments(text):
            for piece in [part] if added else self.pre.cut(part):
                starts.append(starts[-1] + len(piece))
                counts.append(counts[-1] + (1 if added else self.sizes[piece]))
        return starts, counts

    def at(self, text: str, size: int, marks: tuple[list[int], list[int]] | None = None) -> int:
        """Tokens of the first ``size`` characters, exactly as if they were encoded alone."""
        starts, counts = marks or self.marks(text)
        i = max(0, bisect_right(starts, size) - 3)
        # what the cut changes: white space looks one character ahead, apostrophes join what follows, and the head of
        # an added token joins what stands before it
        while i and (SPACE.match(text[starts[i]]) or text[starts[i]] == "'"):
            i -= 1
        return counts[i] + self.count(text[starts[i] : size])

    def fitting(self, text: str, budget: int) -> tuple[int, int]:
        """Characters of the longest prefix with at most ``budget`` tokens, and its tokens."""
        marks = self.marks(text)
        starts, counts = marks
        if counts[-1] <= budget:
            return len(text), counts[-1]
        first = bisect_right(counts, budget) - 1
        # counts grow from mark to mark by at most the last pre-token, so only its neighbours can still fit
        last = min(len(starts) - 1, first + 2)
        for size in range(starts[last], starts[max(0, first - 1)] - 1, -1):
            n = self.at(text, size, marks)
            if n <= budget:
                return size, n
        return 0, 0


class PieceCounter:
    """Prefix token counts for a SentencePiece model file."""

    def __init__(self, path: str):
        self.codec = codec_of(path)

    def count(self, text: str) -> int:
        known = self.codec.parts
        return sum(known[p].count(" ") + 1 for p in self.codec.split(text))

    def at(self, text: str, size: int, marks: None = None) -> int:
        return self.count(text[:size])

    def fitting(self, text: str, budget: int) -> tuple[int, int]:
        """Characters of the longest prefix with at most ``budget`` tokens, and its tokens."""
        best, start, before = (0, 0), -1, 0  # the normalised text has one mark more in front
        for part in self.codec.split(text):
            counts = self.codec.table.counts(part)
            best = max([best, *((start + i, before + n) for i, n in enumerate(counts) if before + n <= budget and start + i > 0)])
            start, before = start + len(part), before + counts[-1]
            if before > budget:
                break
        return best


@cache
def counter_of(path: str) -> ByteCounter | PieceCounter:
    """One counter for each worker process and vocabulary file."""
    return PieceCounter(path) if path.endswith(".model") else ByteCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary)
        for batch in batches:
            n = [*map(counter.count, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "n_bytes": batch.column(1), "n_tokens": pa.array(n, pa.int64())})

    text = whole_text(text_col)
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def truncated(docs: DataFrame, vocabulary: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, the longest prefix with at most ``budget`` tokens, and its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            cuts = [counter.fitting(t, budget) for t in texts]
            yield pa.RecordBatch.from_pydict({
                id_col: batch.column(0), text_col: pa.array([t[:size] for t, (size, _) in zip(texts, cuts, strict=True)], pa.string()),
                "n_tokens": pa.array([n for _, n in cuts], pa.int64())})

    rows = docs.select(F.col(id_col), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, `{text_col}` string, n_tokens long")
