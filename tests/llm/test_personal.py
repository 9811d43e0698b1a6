"""Personal data: base spans against plain patterns, what the trees add, and the forms of input."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from samples import SMALL, frame, odd, odd_docs, prose  # noqa: F401

from tickloom.llm import personal

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def good(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    return kind == "email" or (12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15)


def base(text):
    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if good(k, m.group()))


def check(got, rows):
    want = []
    for i, t in rows:
        spans = base(t)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        want.append((i, *[sum(s[3] == k for s in spans) for k in PLAIN], hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=repr) == sorted(want, key=repr)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for r in got:
        all_spans = set(filter(None, r.spans.split(",")))
        assert any({f"{k}:{a}:{b}" for a, _, b, k in base(t)} <= all_spans and len(all_spans) == r.n_added + len(base(t)) for t in texts[r.doc_id])
        starts = [int(s.split(":")[1]) for s in filter(None, r.spans.split(","))]
        assert starts == sorted(starts)


def card(rng):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(body + d for d in "0123456789" if luhn(body + d))


def corpus(n, seed=1):
    """Documents with one item each, valid or not."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        item = [
            f"{rng.choice('abc')}{i}@mail{i % 9}.example.com", ".".join(str(rng.randint(0, 255)) for _ in range(4)), card(rng),
            f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", str(rng.randint(10**15, 10**16 - 1)), ".".join(str(rng.randint(256, 900)) for _ in range(4)),
            f"+{rng.randint(1, 99)} {rng.randint(10, 99)}",
        ][i % 7]
        rows.append((i, " ".join([*prose(i, 8), item, *prose(i + 1, 8)])))
    return rows


def test_base_spans_equal_plain_patterns(spark, odd):
    rng = random.Random(3)
    fuzz = ["".join(rng.choice("ab1290@@..  -+()_%é😀x") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    words = ["a@b.c", "_x@y.z.", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5", "4111111111111111", "4111 1111 1111-1111", "+1 (222) 555-1234", "+4", ".", "-", " ", "@", "é", "\n"]
    fuzz += ["".join(rng.choice(words) for _ in range(rng.randint(1, 8))) for _ in range(1500)]
    rows = odd + list(enumerate(fuzz, 100_000)) + [(1, "mark  a@b.c  1.2.3.4"), (None, "x a@b.c"), (None, None)]
    check(personal.scan(frame(spark, rows)).collect(), rows)


def test_neighbouring_items_are_added_and_nothing_else(spark):
    rng, rows = random.Random(9), corpus(700)
    number, phone = card(rng), "+1 (269) 555-3296"
    glued = [(9000, f"so {phone} {number} end"), (9001, f"{number} {card(rng)}"), (9002, f"{phone} 27.65.93.188 end"), (9003, " ".join(prose(1, 30)))]
    got = personal.scan(frame(spark, rows + glued)).collect()
    check(got, rows + glued)
    spans = {r.doc_id: r.spans for r in got}
    assert spans[9000] == f"phone:3:20,card:21:37" and spans[9001] == "card:0:16,card:17:33" and spans[9002] == "phone:0:17,ip:18:30" and spans[9003] == ""
    assert sum(r.n_added for r in got if r.doc_id < 9000) == 0


def test_trees_are_right_on_examples_held_out(spark):
    _, spans = personal.judged(frame(spark, corpus(1400, seed=2)), "doc_id", "text")
    model, assembler, least = personal.learnt(spans)
    held = model.transform(assembler.transform(spans.filter("held AND label IS NOT NULL"))).select("kind", "label", personal.vector_to_array("probability")[1].alias("score")).collect()
    assert len(held) > 100 and {r.label for r in held} == {0, 1} and set(least) == {0, 1, 2, 3}
    assert sum((r.score >= 0.5) == r.label for r in held) / len(held) > 0.97
    above = [r.label for r in held if r.score >= least[r.kind]]
    assert sum(above) / len(above) >= personal.PRECISION


def test_the_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check(personal.scan(docs).collect(), list(map(tuple, docs.select("doc_id", "text").collect())))


def test_one_label_no_label_and_no_row(spark):
    for rows in ([], [(1, None)], [(1, "a@b.c"), (1, "d@e.f")], [(1, "12 34"), (2, "no number")]):
        check(personal.scan(frame(spark, rows)).collect(), rows)


@pytest.mark.parametrize("unit", ["1", "a", "@", ".", "1.", "a.", "a@", "+1", "+", "1 ", "- ", "1-", "(", "(at) ", "a@b.c ", "+1 (222) 555-1234 "])
def test_long_runs_take_linear_time(spark, unit):
    rows = [(1, unit * (200_000 // len(unit)))]
    start = time.time()
    n = personal.found(frame(spark, rows, clash=False), "doc_id", "text").select(F.size("parts")).collect()
    assert len(n) == 1 and time.time() - start < 30


def test_no_python_runs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = personal.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
