"""Whitening against plain integer arithmetic and numpy."""

import math

import numpy as np
import pytest
from samples import SMALL

from tickloom.llm import whitening

CLASHING = {"d": 1, "x": "x", "n": 2, "component": 3, "id": "i"}


def plain(rows):
    """(n, S, V) of the distinct vectors, and the usable rows (id, x)."""
    used = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in used})
    n, d = len(fit), len(fit[0])
    total = [sum(x[k] for x in fit) for k in range(d)]
    v = [[sum((n * x[i] - total[i]) * (n * x[j] - total[j]) for x in fit) / n**3 for j in range(d)] for i in range(d)]
    return n, total, np.array(v), used


def check(got, rows):
    n, total, v, used = plain(rows)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    c = min(4, len(total))
    assert sorted(((r.vec_id, r.component) for r in got), key=repr) == sorted(((i, k + 1) for i, _ in used for k in range(c)), key=repr)
    by = {(r.vec_id, r.component): r for r in got}
    sign = [None] * c
    for i, x in used:
        for k in range(c):
            r = by[i, k + 1]
            deviation = sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True))
            assert r.n == n and r.deviation == (deviation if deviation < 1 << 63 else None)
            want = sum((a - s / n) * e for a, s, e in zip(x, total, vectors[:, k], strict=True)) / math.sqrt(values[k])
            if sign[k] is None and abs(want) > 1e-3:
                sign[k] = math.copysign(1, want * r.whitened)
            assert abs(r.whitened - (sign[k] or 1) * want) < 1e-6 * max(1, abs(want))
            assert r.explained == pytest.approx(values[k] / v.trace(), rel=1e-9) and r.identity_error < 1e-4


def frame(spark, rows, kind="float"):
    extra = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *map(str, CLASHING.values())) for r in rows], f"vec_id long, embedding array<{kind}>, {extra}")


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    check(whitening.whiten(table).collect(), table.select("vec_id", "embedding").collect())


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e12])
def test_sums_are_exact_for_large_entries_copies_and_unusable_rows(spark, scale):
    rng = np.random.default_rng(5)
    rows = [(i, (scale * rng.normal(size=6) * [9, 7, 5, 3, 2, 1] + scale * 40).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]
    rows += [(2000, None), (2001, [1.0, None, 0, 0, 0, 0.0]), (2002, [math.nan] * 6), (2003, [math.inf, 0, 0, 0, 0, 0.0]), (2004, [-0.0] * 6)]
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows]
    got = whitening.whiten(frame(spark, rows, "double")).collect()
    check(got, rows)


def test_few_rows_short_vectors_other_lengths_and_none(spark):
    assert whitening.whiten(frame(spark, [])).count() == whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(frame(spark, [(1, [0.5, 1.0]), (None, [0.5, 1.0]), (1, [0.5, 1.0])])).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    mixed = whitening.whiten(frame(spark, [(1, [0.5]), (2, [1.5]), (3, [2.0]), (4, [1.0, 2.0]), (5, [])])).collect()
    assert sorted((r.vec_id, r.deviation is None) for r in mixed) == [(1, False), (2, False), (3, False), (4, True)]
    huge = whitening.whiten(frame(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])], "double")).collect()
    assert len(huge) == 6


def test_totals_do_not_overflow():
    big = np.full((3, 2), np.iinfo(np.int64).max)
    assert whitening.exact_sums(big) == [3 * (2**63 - 1)] * 2 and whitening.square_sums(big) == [3 * (2**63 - 1) ** 2] * 2
    for v in (0, 1, -1, 2**190, -(2**190), 12345678901234567890123):
        assert sum(x << (whitening.LIMB * k) for k, x in enumerate(whitening.limbs(v))) == v
