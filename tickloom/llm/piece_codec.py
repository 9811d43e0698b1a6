"""SentencePiece encoding and decoding from a prefix table.

The text is normalised as the model asks (white space becomes the mark U+2581, with one in front), and cut before every
mark that follows another character and around line ends: no piece of the vocabulary crosses such a place, which the
constructor verifies.
Each part is encoded from its table of last tokens and remembered by the worker, within a bound; what comes often stays known.  Characters outside
the vocabulary become their bytes.  Decoding joins pieces and byte runs back to text.

Defined cases: a missing text is an empty text, which has the end id only; a missing id stays missing; every row is
encoded by itself; texts of any length are cut into parts before they are encoded; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.bpe import Bounded, PrefixTable, scored_pieces
from tickloom.llm.common import begin, remembered, values_of, whole_text

MARK = "▁"
#: Parts that one worker remembers: beside what the other stages of a pipeline hold, and where it has an executor to itself (about 200 MB).
CACHE_PARTS = 300_000
MORE_PARTS = 800_000


class PieceCodec:
    """Encoder and decoder for a merge-type model file with byte fallback."""

    def __init__(self, path: str, most: int = CACHE_PARTS):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {library.id_to_piece(i): i for i in range(library.vocab_size())}
        special = {i for i in pieces.values() if library.is_control(i) or library.is_unknown(i) or library.is_byte(i)}
        self.normal = {p: i for p, i in pieces.items() if i not in special and not library.is_unused(i)}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.normal):
            raise ValueError("a piece goes on after a white-space mark, or over a line end")
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall
        self.bytes = [pieces[f"<0x{b:02X}>"] for b in range(256)]
        self.end = library.eos_id()
        self.text_of = {i: p for p, i in self.normal.items()}
        self.decimal_of = {p: str(i) for p, i in self.normal.items()}
        self.piece_of = {d: p for p, d in self.decimal_of.items()}
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.silent = {i for i in special if library.is_control(i)}
        self.unknown = library.unk_id()
        self.normalised = library.normalize
        self.table = PrefixTable(self.normal, scored_pieces({p: library.get_score(i) for p, i in self.normal.items()}))
        self.parts = Bounded(self.decimals, most)

    def decimals(self, part: str) -> str:
        """Ids of a part as decimals joined by one space; the ids are decoded and must give the part back."""
        tokens = self.table.tokens(part)
        try:
            ids = [*map(self.decimal_of.__getitem__, tokens)]
            back = "".join(map(self.piece_of.__getitem__, ids))
        except KeyError:  # bytes of characters outside the vocabulary
            numbers = self.numbers(tokens)
            ids, back = [*map(str, numbers)], self.joined(numbers).replace(" ", MARK)
        if back != part:
            raise ValueError(f"{part!r} does not survive its ids")
        return " ".join(ids)

    def numbers(self, tokens: list[str]) -> list[int]:
        ids: list[int] = []
        for token in tokens:
            number = self.normal.get(token)
            ids += [number] if number is not None else [self.bytes[b] for b in token.encode()]
        return ids

    def ids_of(self, part: str) -> list[int]:
        return self.numbers(self.table.tokens(part))

    def split(self, text: str) -> list[str]:
        """Parts of the normalised text that are encoded on their own."""
        return self.cut(self.normalised(text)) if text else []

    def encode(self, text: str) -> list[int]:
        """Ids with the end id."""
        return [i for part in self.split(text) for i in self.ids_of(part)] + [self.end]

    def joined(self, ids: list[int]) -> str:
        """Text of ids, marks as spaces; a run of bytes is read as UTF-8, a byte that is none as U+FFFD."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            out.append(each_byte(run))
            run.clear()
            if i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.text_of[i].replace(MARK, " "))
        return "".join([*out, each_byte(run)])

    def decode(self, ids: list[int]) -> str:
        """The space that stands in front of every text goes."""
        return self.joined(ids).removeprefix(" ")

    def digest(self, text: str) -> tuple[int, str, str]:
        """n_tokens, ids_sha256, decoded_sha256."""
        parts = self.split(text)
        ids = " ".join([*map(self.parts.__getitem__, parts), str(self.end)])
        # every part was decoded when it was encoded; joined, they are the decoded text
        back = "".join(parts).replace(MARK, " ").removeprefix(" ")
        return ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def each_byte(run: bytearray) -> str:
    """UTF-8 text of a run of bytes; every byte that belongs to no character gives one U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError as e:
        return run[: e.start].decode() + "�" + each_byte(run[e.start + 1 :])


@cache
def codec_of(model: str, most: int = CACHE_PARTS) -> PieceCodec:
    """One codec for each worker process and model file."""
    return PieceCodec(model, most)


remembered("pieces", codec_of.cache_clear)


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", most: int = CACHE_PARTS) -> DataFrame:
    """One row per row of ``docs``: the id, n_tokens (end id included), ids_sha256, decoded_sha256.  A worker remembers up to ``most`` parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("pieces")
        codec = codec_of(model, most)
        for batch in batches:
            n, ids, back = zip(*map(codec.digest, values_of(batch.column(1))), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(back, pa.string())})

    rows = docs.select(F.col(id_col), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and its ids (array<int>, end id included)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("pieces")
        codec = codec_of(model)
        for batch in batches:
            ids = [codec.encode(t) for t in values_of(batch.column(1))]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))})

    rows = docs.select(F.col(id_col), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>")
