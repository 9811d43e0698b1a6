"""Byte-pair encoding by prefixes.

The encoding of a prefix extends the encoding of a shorter prefix by one token, and that last token is unique: it is
the one token ending there that is compatible with the last token before it, which means that merging the two side
by side leaves them as they are.  A table with the last token of every prefix therefore holds the encoding of all
prefixes.  An automaton over the vocabulary lists the tokens that end at each place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from heapq import merge

import ahocorasick

#: Entries of a bounded cache before it starts anew.
CACHE_PAIRS = 250_000
Rank = Callable[[str, str], "float | None"]


class Follows(dict):
    """Whether a token may follow each left neighbour; the answers of all tokens of a table are bounded together."""

    __slots__ = ("table", "token")

    def __init__(self, table: PrefixTable, token: str):
        super().__init__()
        self.table, self.token = table, token

    def __missing__(self, left: str) -> bool:
        self.table.make_room()
        self[left] = answer = self.table.fits((left, self.token))
        return answer


class PrefixTable:
    """Exact encoder over symbols (characters) with a vocabulary and a merge order.

    ``rank(left, right)`` is the order in which two neighbours merge (lower first), None when they never do.
    Symbols outside the vocabulary stand for themselves and have the number -1.
    """

    def __init__(self, vocabulary: dict[str, int], rank: Rank):
        self.vocabulary, self.rank = vocabulary, rank
        self.automaton = ahocorasick.Automaton()
        # steps back from a token's last symbol to its first, the token, and what it may follow
        self.entries = {piece: (len(piece) - 1, piece, Follows(self, piece)) for piece in vocabulary if piece}
        for piece, entry in self.entries.items():
            self.automaton.add_word(piece, entry)
        self.automaton.make_automaton()
        self.answers, self.strange = 0, {}
        self.symbols = {piece for piece in vocabulary if len(piece) == 1}

    def merged(self, text: str) -> list[str]:
        """Merges replayed from single symbols; used on single tokens and pairs only."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def make_room(self) -> None:
        """Counts one more answer; all are forgotten when there are too many."""
        if self.answers >= CACHE_PAIRS:
            for _, _, follows in self.entries.values():
                follows.clear()
            self.strange.clear()
            self.answers = 0
        self.answers += 1

    def stranger(self, symbol: str) -> tuple[int, str, Follows]:
        """The entry of a symbol outside the vocabulary."""
        if symbol not in self.strange:
            self.make_room()
            self.strange[symbol] = (0, symbol, Follows(self, symbol))
        return self.strange[symbol]

    def fits(self, pair: tuple[str, str]) -> bool:
        """True if two tokens side by side stay two tokens; the left one is empty at the start of a text."""
        left, right = pair
        return self.merged(left + right) == ([left, right] if left else [right])

    def last_tokens(self, text: str) -> list[str]:
        """For every prefix (entry i: the first i symbols) its last token; entry 0 is empty."""
        last, done = [""], -1
        add, ends = last.append, self.automaton.iter(text)
        if not self.symbols.issuperset(text):
            # a symbol outside the vocabulary is also a token that ends there
            ends = merge(ends, ((i, self.stranger(c)) for i, c in enumerate(text) if c not in self.symbols), key=lambda x: x[0])
        for end, (back, token, follows) in ends:
            if end != done and follows[last[end - back]]:
                add(token)
                done = end
        return last

    def tokens(self, text: str) -> list[str]:
        """The encoding, recovered backwards from the last token of the whole text."""
        last, out, i = self.last_tokens(text), [], len(text)
        while i:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def counts(self, text: str) -> list[int]:
        """Tokens of every prefix: one more than those of the prefix before its last token.

        A symbol outside the vocabulary counts as its bytes.
        """
        out = [0]
        for i, token in enumerate(self.last_tokens(text)[1:], 1):
            out.append(out[i - len(token)] + (1 if token in self.vocabulary else len(token.encode())))
        return out


def ranked_pairs(merges: Iterable[tuple[str, str]]) -> Rank:
    """Merge order given as a list of pairs."""
    order = {pair: i for i, pair in enumerate(merges)}
    return lambda a, b: order.get((a, b))


def scored_pieces(scores: dict[str, float]) -> Rank:
    """Merge order by the score of the piece that two neighbours make, highest first."""
    order = {piece: -score for piece, score in scores.items()}
    return lambda a, b: order.get(a + b)


class Bounded(dict):
    """Results of ``make`` by text.  When half of those allowed, or half the characters, are there, they become the older half, which is
    asked before ``make`` and goes when the next half is full: what comes often stays.
    """

    def __init__(self, make: Callable, most: int, most_chars: int = 50_000_000):
        super().__init__()
        self.make, self.most, self.most_chars, self.chars, self.older = make, most, most_chars, 0, {}

    def __missing__(self, key: str):
        value = self.older[key] if key in self.older else self.make(key)
        self.chars += len(key)
        if 2 * len(self) >= self.most or 2 * self.chars > self.most_chars:
            self.older = dict(self)
            self.clear()
            self.chars = len(key)
        self[key] = value
        return value
