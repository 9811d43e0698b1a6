"""Pre-tokens of byte-level BPE, cut exactly as the tokenizers library cuts them."""

from __future__ import annotations

import json
import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

# Letters, numbers and white space below U+0250.  There they are the same in every Unicode version.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\\t-\\r \x85\xa0"
#: Byte-level pre-tokens: contractions, letters, numbers, other characters (each with a space before), white space.
PRE_TOKEN = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
#: Texts with any other character (but for these marks, which are neither) are cut by the library itself.
OTHER = re.compile("[^\x00-ɏ‘’“”–—…€]")
#: Kinds of the characters below U+0250; the last entry stands for the marks.
SPACE, LETTER, NUMBER, REST = range(4)
KINDS = np.array([next((k for k, p in enumerate((SPACES, LETTERS, NUMBERS)) if re.match(f"[{p}]", chr(c))), REST) for c in range(0x250)] + [REST], np.uint8)


def starts_of(row: str, first: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where ``PRE_TOKEN`` cuts each stretch of the row.  Stretches begin at ``first``; those that are ``whole`` are not cut."""
    c = np.frombuffer(row.encode("utf-32-le"), "<u4")
    kind = KINDS[np.minimum(c, len(KINDS) - 1)]
    gap, start = kind == SPACE, np.ones(len(c), bool)
    # a space goes with what follows it
    start[1:] = (kind[1:] != kind[:-1]) & ((c[:-1] != 0x20) | gap[1:])
    # the last of white space stands alone, or goes with what follows it
    lead = gap[:-1] & ~gap[1:]
    lead[first[1:] - 1] = False
    start[:-1] |= lead
    start[first] = True
    at = np.flatnonzero((c == 0x27) & start)
    left = np.append(first, len(c))[np.searchsorted(first, at, "right")] - at
    after = np.append(c, [0, 0])
    one, two = after[at + 1], after[at + 2]
    short = (left > 1) & np.isin(one, [*map(ord, "stmd")])
    long = (left > 2) & (((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l"))))
    start[at[short | long] + 1] = False
    ends = np.concatenate([at[short] + 2, at[long] + 3])
    start[ends[ends < len(c)]] = True
    start[np.repeat(whole, np.diff(first, append=len(c)))] = False
    start[first] = True
    return np.flatnonzero(start)


class PreTokens:
    """Cuts texts for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path) as file:
            self.spec = json.load(file)
        kind = self.spec["pre_tokenizer"]
        if self.spec["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"]:
            raise ValueError("not a plain byte-level file")
        names = sorted((t["content"] for t in self.spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text without added tokens."""
        if not OTHER.search(text):
            return PRE_TOKEN.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """Stretches of text, and whether each is an added token."""
        parts = self.added.split(text) if self.added else [text]
        return [(p, i % 2 == 1) for i, p in enumerate(parts) if p]

    def cut_all(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Pre-tokens and added tokens of all texts, in order and in UTF-8, and how many each text has."""
        stretches: list[str] = []
        owner: list[int] = []
        whole: list[bool] = []
        for k, text in enumerate(texts):
            for stretch, added in self.segments(text):
                ready = added or OTHER.search(stretch) is not None
                pieces = self.cut(stretch) if ready and not added else [stretch]
                stretches += pieces
                owner += [k] * len(pieces)
                whole += [ready] * len(pieces)
        row = "".join(stretches)
        first = np.fromiter(accumulate(map(len, stretches), initial=0), np.int64, len(stretches) + 1)
        starts = starts_of(row, first[:-1], np.array(whole, bool))
        counts = np.bincount(np.array(owner, np.int64), np.diff(np.searchsorted(starts, first)), len(texts)).astype(np.int64)
        data, places = row.encode(), np.append(starts, len(row))
        if len(data) > len(row):
            c = np.frombuffer(row.encode("utf-32-le"), "<u4")
            sizes = 1 + (c >= 0x80) + (c >= 0x800).astype(np.int64) + (c >= 0x10000)
            places = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])[places]
        return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data)]), counts
