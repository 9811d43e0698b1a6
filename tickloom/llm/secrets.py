"""Secret scan behind a trigram inverted index.

From every rule's pattern a Boolean query over trigrams is derived: what any match must contain.  The documents
of a segment (one Arrow batch, at most 64 MB of text) are indexed by the trigrams that occur in these queries: a
sorted list of document numbers per trigram.  A query intersects and unites these lists; only the documents it
leaves are verified with the pattern itself.  A rule without a mandatory trigram scans every document.  The index
lives beside its documents, so a search moves no text and no postings between machines.

Defined cases: a missing text is empty and has no findings; a missing id stays missing; every row is scanned by
itself, also when ids or texts repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import whole_text

#: Alternatives beyond which the strings of a pattern part are no longer listed.
MOST_STRINGS = 64
MOST_CHARACTERS = 4
#: Bytes of text whose trigrams are looked up at once.
SLICE = 1 << 22


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


#: The kinds of secret, in the order in which equal starts are listed.  A run of hexadecimal digits is
#: matched from its start to its end in any case, so its least length can be part of the pattern.
RULES = (
    Rule(
        "assign",
        "(" + "|".join(map(any_case, ("password", "passwd", "secret", "token", "api"))) + any_case("_?key")
        + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        8, 2,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]{32,}", 32),
)

#: A query is a set of clauses, one of which must hold; a clause is a set of trigrams, all of which must occur.
Query = frozenset[frozenset[str]]
ANYTHING: Query = frozenset([frozenset()])


def simplified(query: Query) -> Query:
    """Without clauses that a shorter clause already covers."""
    return frozenset(c for c in query if not any(o < c for o in query))


def both(a: Query, b: Query) -> Query:
    return simplified(frozenset(x | y for x, y in product(a, b)))


def either(*queries: Query) -> Query:
    return simplified(frozenset().union(*queries))


def of_strings(strings: set[str]) -> Query:
    return simplified(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def characters(members: Sequence) -> set[str] | None:
    """Lower-case characters of a set such as ``[Aa_]``; None where they are many or not listed."""
    found: set[str] = set()
    for kind, arg in members:
        if kind is op.LITERAL:
            found.add(chr(arg).lower())
        elif kind is op.RANGE and arg[1] - arg[0] < MOST_CHARACTERS:
            found.update(chr(c).lower() for c in range(arg[0], arg[1] + 1))
        else:
            return None
    return found if len(found) <= MOST_CHARACTERS else None


def spelled(kind, arg) -> set[str] | None:
    """Every string that one part of a pattern can match; None where there are too many."""
    if kind is op.LITERAL:
        return {chr(arg).lower()}
    if kind is op.IN:
        return characters(arg)
    if kind is op.AT:
        return {""}
    if kind is op.SUBPATTERN:
        return spelled_row(arg[-1])
    if kind is op.BRANCH:
        options = [spelled_row(row) for row in arg[1]]
        return None if None in options else set().union(*options)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] <= 2:
        once = spelled_row(arg[2])
        return None if once is None else {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(once, repeat=n)}
    return None


def spelled_row(parts: Sequence) -> set[str] | None:
    row = {""}
    for part in parts:
        some = spelled(*part)
        if some is None or len(row) * len(some) > MOST_STRINGS:
            return None
        row = {a + b for a in row for b in some}
    return row


def needed(parts: Sequence) -> Query:
    """What every match of a row of parts contains."""
    query, run = ANYTHING, {""}
    for kind, arg in parts:
        some = spelled(kind, arg)
        if some is not None and len(run) * len(some) <= MOST_STRINGS:
            run = {a + b for a in run for b in some}
            continue
        # the strings known so far end here, and a new run begins
        query, run = both(query, of_strings(run)), some or {""}
        if some is None and kind is op.SUBPATTERN:
            query = both(query, needed(arg[-1]))
        elif some is None and kind is op.BRANCH:
            query = both(query, either(*map(needed, arg[1])))
        elif some is None and kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0]:
            query = both(query, needed(arg[2]))
    return both(query, of_strings(run))


def trigram_query(rule: Rule) -> Query:
    """Boolean trigram query of a rule, over lower-case text; ``ANYTHING`` if no trigram is mandatory."""
    return needed(_parser.parse(rule.pattern, re.ASCII))


class SegmentIndex:
    """Postings of the given trigrams over a list of documents."""

    def __init__(self, texts: Sequence[str], trigrams: set[str]):
        self.size = len(texts)
        names = sorted(trigrams)
        number = np.full(1 << 24, -1, np.int16)
        for i, t in enumerate(names):
            number[int.from_bytes(t.encode(), "big")] = i
        folded = [t.encode().lower() for t in texts]
        starts = np.cumsum([0, *(len(t) + 1 for t in folded)])
        # a byte that no UTF-8 text holds keeps trigrams inside their document
        data = np.frombuffer(b"\xff".join([*folded, b""]), np.uint8)
        pairs = [np.zeros(0, np.int64)]
        for at in range(0, max(0, len(data) - 2), SLICE):
            part = data[at : at + SLICE + 2].astype(np.uint32)
            found = number[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
            where = np.flatnonzero(found >= 0)
            document = np.searchsorted(starts, where + at, "right") - 1
            pairs.append(np.unique((found[where].astype(np.int64) << 32) | document))
        pairs = np.unique(np.concatenate(pairs))
        cuts = np.searchsorted(pairs >> 32, np.arange(len(names) + 1))
        self.postings = {t: pairs[cuts[i] : cuts[i + 1]] & 0xFFFFFFFF for i, t in enumerate(names)}

    def search(self, query: Query) -> np.ndarray:
        """Numbers of the documents that a query leaves."""
        hits = np.zeros(0, np.int64)
        for clause in query:
            rows = np.arange(self.size)
            for lists in sorted((self.postings[t] for t in clause), key=len):
                rows = np.intersect1d(rows, lists, assume_unique=True)
            hits = np.union1d(hits, rows)
        return hits


def spans_of(texts: Sequence[str], rules: Sequence[Rule]) -> list[list[tuple[int, int, int]]]:
    """For each text its findings (start, rule number, end) in order; ends are exclusive, in code points."""
    queries = [trigram_query(r) for r in rules]
    index = SegmentIndex(texts, {t for q in queries for clause in q for t in clause})
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        match = rule.compiled().finditer
        for i in index.search(query):
            out[i] += [(m.start(), k, m.end()) for m in match(texts[i]) if len(m[rule.group]) >= rule.least]
    for found in out:
        found.sort()
    return out


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_<kind> of each rule, base_sha256 and spans (kind:start:end, comma-joined)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = spans_of(batch.column(1).to_pylist(), rules)
            text = [",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in x) for x in found]
            counts = {f"n_{r.kind}": pa.array([sum(k == j for _, k, _ in x) for x in found], pa.int64()) for j, r in enumerate(rules)}
            digest = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in text], pa.string())
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), **counts, "base_sha256": digest, "spans": pa.array(text, pa.string())})

    rows = docs.select(F.col(id_col), whole_text(text_col).alias("text"))
    counts = "".join(f"n_{r.kind} long, " for r in rules)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, {counts}base_sha256 string, spans string")


def findings(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per finding: the id, kind, start, end and the matching text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [(i, rules[k].kind, a, b, texts[i][a:b]) for i, x in enumerate(spans_of(texts, rules)) for a, k, b in x]
            places, kinds, starts, ends, parts = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_pydict({
                id_col: batch.column(0).take(pa.array(places, pa.int64())), "kind": pa.array(kinds, pa.string()), "start": pa.array(starts, pa.int64()),
                "end": pa.array(ends, pa.int64()), "match": pa.array(parts, pa.string())})

    rows = docs.select(F.col(id_col), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, kind string, start long, end long, match string")
