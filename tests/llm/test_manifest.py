"""The Merkle manifest against a plain tree."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from samples import SMALL

from tickloom.llm import manifest

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, pos string, total string, path string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def plain(rows):
    def leaf(r, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in groups}
    top, out = levels([trees[g][-1][0] for g in order]), []
    for at, g in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            sides = []
            for tree, p in ((trees[g], i), (top, at)):
                for level in tree[:-1]:
                    first = p // 8 * 8
                    sides.append(("".join(level[first:p]), "".join(level[p + 1 : first + 8])))
                    p //= 8
            node = own
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                node = leaf(r, r[1].translate({c: c + 32 for c in range(65, 91)}))
            for left, right in sides:
                node = sha(left + node + right)
            root = top[-1][0]
            out.append((r[0], own, trees[g][-1][0], root, sha("".join(x + y for x, y in sides)), node, node == root))
    return sorted(out, key=repr)


def audited(docs):
    return sorted(map(tuple, manifest.audit(docs).select(*COLUMNS).collect()), key=repr)


ODD = [
    (None, "A", None, "s", 1), (None, "A", None, "s", 1), (None, "b", "en", None, None), (5, "X", "en", "s", 1), (5, "X", "en", "s", 1), (5, None, "en", "s", 1),
    (-7, "é", "", "s", 1), (6, "", "", "s", 1), (2**62, "z", "", "s", 1), (-(2**63), "z", "", "s", 1), (2**63 - 1, "Z" * 30_000, "", "s", 1),
    *[(i, f"Text {i}", "fr", "s", i) for i in range(600)], *[(3, "Text 3", "fr", "s", 3)] * 20, (10**6 + 1, "one", "de", "x", 3),
]


@pytest.mark.parametrize("bits", [10, 2])
def test_any_rows_equal_a_plain_tree(spark, monkeypatch, bits):
    monkeypatch.setattr(manifest, "RADIX_BITS", bits)
    many = [(i * 37, f"T{i}", f"l{i % 70}", "s", i) for i in range(140)]  # more groups than one run holds
    rows = (ODD if bits == 10 else []) + many
    got = audited(spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA))
    assert got == plain(rows)


def test_the_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert audited(docs) == plain(list(map(tuple, docs.select("doc_id", "text", "lang", "source", "n_chars").collect())))


def test_no_row_one_row_and_eight_rows(spark):
    for n in (0, 1, 8, 9):
        rows = [(i, f"T{i}", "en", "s", i) for i in range(n)]
        assert audited(spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)) == plain(rows) if n else not audited(spark.createDataFrame([], SCHEMA))
