"""Operators that relate documents to each other, against brute force on small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from samples import SMALL, frame, odd, odd_docs, prose  # noqa: F401
from tokenizers import Tokenizer

from tickloom.llm import decontamination, exact_dedup, near_dedup, quality, sharding, substring_dedup, token_files
from tickloom.llm.components import components
from tickloom.llm.exact_dedup import CountingQuotientFilter
from tickloom.llm.pretokens import PreTokens

JSON = public_tokenizers.path("byte_bpe_50k.json")


def fold(text):
    return (text or "").encode().lower()


def ordered(rows):
    return sorted(rows, key=repr)


# exact copies


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 20, n).astype(np.uint64) for n in (0, 1, 5, 400, 1000)]
    merged = CountingQuotientFilter.merge([CountingQuotientFilter.unpack(CountingQuotientFilter.of(p, 20).pack()) for p in parts])
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (merged.values() == values).all() and (merged.counts == counts).all()
    again = CountingQuotientFilter.unpack(merged.pack())
    assert (again.values() == values).all() and (again.counts == counts).all()
    assert (merged.above(1)[0] == values[counts > 1]).all()


def test_exact_copies(spark, odd, odd_docs):
    got = exact_dedup.decide(odd_docs).collect()
    by = defaultdict(list)
    for i, t in odd:
        by[fold(t)].append(i)
    assert len(got) == len(odd)
    for r in got:
        same = next(ids for text, ids in by.items() if hashlib.sha256(text).hexdigest() == r.text_sha256 and r.doc_id in ids)
        assert r.group_size == len(same) and r.keep_id == max((i for i in same if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(by)
    assert exact_dedup.decide(frame(spark, [])).count() == 0


# token files


def test_token_files_read_back(spark, odd, odd_docs):
    corpus = token_files.write(odd_docs, JSON, end_id=2, length=64)
    got = token_files.read_digests(corpus).collect()
    library, start, want = Tokenizer.from_file(JSON), 0, []
    for i, text in sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert ordered(tuple(r) for r in got) == ordered(want)


def test_sequences_and_masks_are_equally_long(spark):
    corpus = token_files.write(frame(spark, [(i, " ".join(prose(i, 50))) for i in range(20)]), JSON, end_id=2, length=32)
    total = 0
    for shard, size in corpus.documents.groupBy("shard").sum("n_tokens").collect():
        file = token_files.SequenceFile(corpus.folder, shard)
        rows = -(-size // 32)
        masks = []
        for row in range(rows):
            ids, mask = file.sequence(row)
            assert len(ids) == len(mask) == 32 and not ids[~mask].any()
            masks.append(mask)
        assert sum(m.sum() for m in masks) == size and all(m.all() for m in masks[:-1])
        total += size
    assert total == corpus.documents.groupBy().sum("n_tokens").first()[0]
    none = token_files.write(frame(spark, []), JSON, end_id=2)
    assert token_files.read_digests(none).count() == 0


def test_one_id_may_fill_several_files_and_a_second_run_replaces_none(spark):
    rows = [(None if i % 2 else 7, " ".join(prose(i % 40, 12))) for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    try:
        corpus = token_files.write(frame(spark, rows).repartition(4), JSON, end_id=2, length=64)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    first = ordered(tuple(r) for r in token_files.read_digests(corpus).collect())
    assert corpus.documents.select("shard").distinct().count() > 2
    token_files.write(frame(spark, rows[:50]), JSON, end_id=2, length=64, folder=corpus.folder)
    assert ordered(tuple(r) for r in token_files.read_digests(corpus).collect()) == first
    library, at = Tokenizer.from_file(JSON), 0
    want = Counter((i, zlib.crc32(np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, t in rows)
    assert Counter((r[0], r[3]) for r in first) == want
    for i, start, n, _ in sorted(first, key=lambda r: r[1]):
        assert start == at
        at += n


def test_ids_do_not_depend_on_how_texts_are_grouped(monkeypatch):
    texts = [" ".join(prose(i, 200)) for i in range(8)] + ["", "<|endoftext|> é"]
    encoder, library = token_files.Encoder(JSON), Tokenizer.from_file(JSON)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encoded(texts)] == want
    monkeypatch.setattr(token_files, "ENCODED_AT_ONCE", 10)
    monkeypatch.setattr(token_files, "CACHE_PARTS", 5)
    assert [x.tolist() for x in encoder.encoded(texts)] == want


def test_texts_cut_together_are_cut_as_one_by_one():
    rng, pre, library = random.Random(5), PreTokens(JSON), Tokenizer.from_file(JSON)
    bits = [" ", "  ", "\n", "\t", "\x85", "\xa0", "\x1c", "'", "'s", "'re", "'ll", "'S", "r", "e", "s", "Zq", "é", "ɏ", "1", "23", "²", ".", "!?", "’", "—", "<|endoftext|>", "<|endof", "日本", "\u3000", "ſ", "word"]
    texts = ["", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(4000)), ""]
    parts, counts = pre.cut_all(texts)
    want = [[p for stretch, added in pre.segments(t) for p in ([stretch] if added else pre.cut(stretch))] for t in texts]
    assert counts.tolist() == [*map(len, want)]
    assert [p.decode() for p in parts.to_pylist()] == [p for w in want for p in w]
    assert [x.tolist() for x in token_files.Encoder(JSON).encoded(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_pre_token_is_looked_up_once_for_many_texts():
    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    encoder, texts = token_files.Encoder(JSON), [" one two three" * 50] * 20
    encoder.known = Counted(encoder.known)
    assert sum(map(len, encoder.encoded(texts))) == 3000
    assert Counted.asked <= 6  # three pre-tokens: asked for, and asked for again when learnt


# quality


def test_quality_learns_only_from_its_part(spark):
    docs, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        docs.append((i, " ".join(prose(i, 40)) if good else " | ".join(w + "%%%" for w in prose(i, 40))))
        labels.append((i, int(good)))
    docs += [(None, None), (5000, ""), (7, docs[7][1])]
    table = spark.createDataFrame([*labels, (None, 1), (401, None), (3, 1)], "doc_id long, quality int")
    weights = quality.fit(frame(spark, docs), table)
    got = quality.score(frame(spark, docs), weights).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    known = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert len(held) > 80 and np.mean([r.predicted == known[r.doc_id] for r in held]) > 0.95
    # labels of the other part change nothing
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in labels], "doc_id long, quality int")
    assert np.array_equal(quality.fit(frame(spark, docs), flipped), quality.fit(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int")))
    untrained = quality.fit(frame(spark, docs), table.limit(0))
    assert {r.score for r in quality.score(frame(spark, docs[:3]), untrained).collect()} == {0.5}


def test_no_more_rows_are_learnt_than_the_bound(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    texts = {i: [" ".join(prose(i * 9 + k, 30)) for k in range(20)] for i in ids}
    docs = [(i, texts[i][k % 20]) for i in ids for k in range(1500)]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    got = quality.fit(frame(spark, docs), labels, most=2)
    assert np.array_equal(got, quality.fit(frame(spark, [(i, min(texts[i])) for i in ids]), labels, most=2)) and got.any()


def test_weights_equal_a_loop_over_single_coordinates():
    rows = [quality.sparse(" ".join(prose(i, 30, 60)) if i % 2 else "### " + " | ".join(prose(i, 30, 60))) for i in range(60)]
    labels = np.array([i % 2 for i in range(60)])
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return (np.sign(z[i]) * quality.L1 - z[i]) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    order = np.random.default_rng(0)
    for _ in range(quality.EPOCHS):
        for r in order.permutation(len(rows)):
            x = dict(zip(*(v.tolist() for v in rows[r]), strict=True))
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - labels[r]) * v
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    got = quality.train(rows, labels)
    assert set(np.flatnonzero(got)) <= set(z) and len(z) > 100
    assert np.allclose([got[i] for i in z], [weight(i) for i in z], rtol=1e-9, atol=1e-12)


def test_quality_on_held_out_rows_of_the_tables(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    known = dict(labels.select("doc_id", "quality").collect())
    got = [r for r in quality.score(docs, quality.fit(docs, labels)).collect() if r.held_out and r.doc_id in known]
    assert np.mean([r.predicted == known[r.doc_id] for r in got]) >= 0.9


# repeated passages


def plain_removed(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("window", [12, 35])
def test_repeated_passages(spark, odd, window):
    line = prose(50, window + 7)
    loop = prose(51, 3) * 30
    more = [(200 + i, " ".join(prose(300 + i, 20) + line[i % 3 :] + prose(400 + i, 15))) for i in range(12)] + [(300, " ".join(loop)), (301, " ".join(line[:window])), (302, " ".join(line[: window - 1]))]
    rows = odd + more
    got = substring_dedup.digests(frame(spark, rows), window=window).collect()
    assert ordered((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == ordered((i, *x) for (i, _), x in zip(rows, plain_removed([t for _, t in rows], window), strict=True))


def test_maximal_repeats_and_a_full_bitmap(spark, monkeypatch):
    line = prose(60, 50)
    rows = [(1, " ".join(prose(61, 9) + line)), (2, " ".join(line[5:] + prose(62, 9))), (3, None)]
    want = [(1, 14, 59, " ".join(line[5:])), (2, 0, 45, " ".join(line[5:]))]
    assert ordered(tuple(r) for r in substring_dedup.passages(frame(spark, rows)).collect()) == want
    monkeypatch.setattr(substring_dedup, "seed_bitmap", lambda *a: np.full(8, 255, np.uint8))
    assert ordered(tuple(r) for r in substring_dedup.passages(frame(spark, rows)).collect()) == want
    assert substring_dedup.digests(frame(spark, [])).count() == 0


# shards


def test_tree_packs_like_a_list():
    rng = np.random.default_rng(2)
    items = [(int(i), int(s)) for i, s in enumerate(rng.integers(1, 60, 300))]
    bins, want = [], {}
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        fit = min(((room, i) for i, room in enumerate(bins) if room >= size), default=None)
        if fit is None:
            bins.append(100)
            fit = (100, len(bins) - 1)
        bins[fit[1]] -= size
        want[name] = fit[1]
    assert sharding.pack(items, 100) == want
    assert sharding.pack([], 5) == {} and sharding.pack_into([], 8) == {}
    assert sharding.pack([("a", 9), ("b", 2)], 5) == {"a": 0, "b": 1}


def test_shards_are_near_equal_and_keep_groups(spark, odd):
    rows = odd[:14] + [(1000 + i, " ".join(prose(i % 300, 20 + i % 40))) for i in range(900)]
    got = sharding.assign(frame(spark, rows), 8).collect()
    assert ordered((r.doc_id, r.size, r.text_crc32) for r in got) == ordered((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[r.size, r.text_crc32].add(r.shard)
    assert set(sizes) == set(range(8)) and max(sizes.values()) < 1.1 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    assert sharding.assign(frame(spark, []), 8).count() == 0


def test_a_group_larger_than_a_shard_is_dealt_out(spark):
    rows = [(i, "the same long text") for i in range(600)] + [(1000 + i, f"text {i}") for i in range(100)]
    sizes = Counter()
    for r in sharding.assign(frame(spark, rows), 8).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) < 1.5 * min(sizes.values())


@pytest.mark.parametrize("doc", [None, 7])
def test_a_large_group_without_ids_or_with_one_id_is_dealt_out(spark, doc):
    rows = [(doc, " ".join(["the same long text"] * 27)) for _ in range(800)] + [(doc, " ".join(prose(i, 12))) for i in range(200)]
    sizes, slots = Counter(), defaultdict(list)
    for r in sharding.assign(frame(spark, rows).repartition(3), 8).collect():
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(sizes) == 8 and max(sizes.values()) < 1.05 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# benchmark items


BENCH = [
    (1, "A farmer in Madrid sold 14 apples and 12.5 kg of pears to each of his 3 neighbours before noon on that day"),
    (2, "which of the following rivers flows through the largest number of countries on its way to the sea"),
    (3, "too short for templates"), (4, None), (5, "Name the six noble gases in order please"), (6, "Name the six noble gases in order please"),
]


def leaks(spark, texts):
    docs = frame(spark, list(enumerate(texts)))
    bench = spark.createDataFrame([(*b, "x", "y") for b in BENCH], "item_id long, text string, doc string, h string")
    return {(r.doc_id, r.item_id) for r in decontamination.pairs(docs, bench).collect()}


def test_leaks(spark):
    around = " ".join(prose(70, 30))
    texts = [
        f"{around} {BENCH[0][1]} {around}",
        BENCH[0][1].upper(),
        BENCH[0][1].lower().replace(" and", ",\n and"),
        # other numbers and another name, the same question
        "A farmer in Lisbon sold 20 apples and 7 kg of pears to each of his 9 neighbours before noon on that day",
        f"{around} Which of the following rivers flows through the largest number of countries on its way to the sea?",
        # only a few words of it
        "A farmer in Madrid sold 14 apples and went home", around, None, "", BENCH[4][1], BENCH[2][1], "  ",
        "long text " * 3000,
    ]
    assert leaks(spark, texts) == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 2), (9, 5), (10, 3)}


def test_inconsistent_slots_are_no_leak(spark):
    global BENCH
    kept, BENCH = BENCH, [(1, "from 5 add 5 then take 5 away and from 5 add 5 again so that 5 stays in the end with 5 left over")]
    try:
        assert leaks(spark, [BENCH[0][1], BENCH[0][1].replace("5", "8"), "from 5 add 6 then take 7 away and from 8 add 9 again so that 1 stays in the end with 2 left over"]) == {(0, 1), (1, 1)}
    finally:
        BENCH = kept


def found_in(spark, item, texts):
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    return {r.doc_id for r in decontamination.pairs(frame(spark, list(enumerate(texts))), bench).collect()}


@pytest.mark.parametrize("price", ["$50 in", "$12 days", "£5 m", "€ 7 percent", "$3.50 g"])
def test_a_price_before_a_unit_shifts_no_value(spark, price):
    item = "we packed 12 pens on monday and 12 pens on tuesday so how many of these 12 pens were left for the others"
    text = f"The club raised {price} one day. {item}"
    row = spark.createDataFrame([(text,)], "text string").select(decontamination.words(F.col("text")).alias("w")).first()
    assert [w.strip(decontamination.MARKS) for w in row.w if w.startswith(decontamination.PLACE) and w.strip(decontamination.MARKS)[0] in "$£€1"][-3:] == ["12"] * 3
    assert found_in(spark, item, [text, text.replace("12", "15")]) >= {0}


def test_names_that_begin_sentences_may_differ(spark):
    item = "Maria buys 12 apples at the market. Maria gives 4 apples to her neighbour. Maria then eats 2 of them. How many apples does Maria have left now?"
    other = item.replace("Maria", "Laura").replace("12", "15")
    quoted = '"' + other.replace(". ", '."\n"') + '"'
    mixed = item.replace("Maria gives", "Paula gives").replace("Maria then", "Greta then").replace("does Maria", "does Erika").replace("12", "15")
    assert found_in(spark, item, [item, other, quoted, f"Suppose that {other}", mixed]) == {0, 1, 2, 3}


def test_items_of_values_are_found_word_for_word(spark):
    item = "What is 12 + 15 * 3 - 48 / 6 + 7 ?"
    assert found_in(spark, item, [f"Now: {item} Think.", item.replace("15", "16"), "what is 12 and 15"]) == {0}
    long = "Add 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13 and 14"
    assert found_in(spark, long, [f"so {long} now", long.replace("7", "70")]) == {0}


def test_items_of_one_to_four_words_are_found_word_for_word(spark):
    for item in ("What is two plus", "Photosynthesis?", "12 + 15", "Red Green"):
        assert found_in(spark, item, [f"Well, {item} and so on", "nothing of it", item.split()[0][:-2]]) == {0}
    assert found_in(spark, "?!", ["?!", "a"]) == set()


@pytest.mark.parametrize("unit", ["Maria ", "Ab, ", "1.", "1.1 ", "x", "é", "É", "$1 ", "km ", ". "])
def test_long_runs_do_not_overflow(spark, unit):
    item = "which of the following rivers flows through the largest number of countries"
    assert found_in(spark, item, [unit * 200_000, f"{unit * 1000}. {item} {unit * 1000}"]) == {1}


def test_leaks_on_the_tables_and_with_a_shuffled_benchmark(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    folded = lambda t: " ".join((t or "").lower().split())
    want = {(d, i) for d, t in docs.select("doc_id", "text").collect() for i, q in bench.select("item_id", "text").collect() if folded(q) in folded(t)}
    assert {(r.doc_id, r.item_id) for r in decontamination.pairs(docs, bench).collect()} == want
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", 0)
    assert {(r.doc_id, r.item_id) for r in decontamination.pairs(docs, bench).collect()} == want
    assert decontamination.pairs(docs.limit(0), bench).count() == decontamination.pairs(docs, bench.limit(0)).count() == 0


def test_decontamination_runs_no_python(spark):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontamination.pairs(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# near copies


def plain_components(rows, percent):
    def shingles(text):
        words = fold(text).split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(top(k), []).append(i)
    name = {k: min((i for i in ids if i is not None), default=None) for k, ids in least.items()}
    return [(i, len(sets[k]), name[top(k)], i == name[top(k)]) for k, (i, _) in enumerate(rows)]


def near_family(seed, n, edits, first):
    """Copies of one text, each with some words changed, so that only some pairs reach the threshold."""
    rng = np.random.default_rng(seed)
    base, rows = prose(seed, 150), []
    for i in range(n):
        words = list(base)
        for at in rng.integers(0, 150, rng.integers(0, edits)):
            words[at] = f"w{rng.integers(10**6)}"
        rows.append((first + i, " ".join(words)))
    return rows


@pytest.mark.parametrize("percent", [85, 80])
def test_near_copies_equal_brute_force(spark, odd, percent):
    rows = odd + near_family(81, 90, 12, 1000) + near_family(82, 40, 6, 2000) + near_family(83, 3, 3, 3000)
    got = near_dedup.groups(frame(spark, rows), percent).collect()
    assert ordered((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == ordered(plain_components(rows, percent))


@pytest.mark.parametrize("edits", [4, 10, 16])
def test_crowded_buckets_are_searched_around_pivots(spark, monkeypatch, edits):
    monkeypatch.setattr(near_dedup, "SALTS", 3)
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    rows = near_family(84, 120, edits, 1)
    # families whose members share edits but are too far from the first text
    for k, (_, text) in enumerate(near_family(84, 9, 16, 0)):
        words = text.split()
        for i in range(6):
            rows.append((1000 + 10 * k + i, " ".join(words[:70] + [f"v{i}"] + words[71:])))
    got = near_dedup.groups(frame(spark, rows)).collect()
    assert ordered((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == ordered(plain_components(rows, 85))
    assert near_dedup.groups(frame(spark, [])).count() == 0


def test_few_pairs_are_made_of_copies_just_below_the_threshold(spark, monkeypatch):
    rng = np.random.default_rng(86)
    base, rows = prose(86, 150), []
    for i in range(300):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(2, 6)), replace=False):
            words[at] = "other"
        rows.append((i, " ".join(words)))
    made = {}
    monkeypatch.setattr(near_dedup, "store", lambda df, kind="table", write=near_dedup.store: made.setdefault(kind, write(df, kind)))
    got = near_dedup.groups(frame(spark, rows), 85).collect()
    assert ordered((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == ordered(plain_components(rows, 85))
    assert made["left-over"].count() < 3 * len(rows)


def test_many_rows_without_an_id_or_with_the_same(spark):
    rows = [(None if i % 2 else 7, t) for i, (_, t) in enumerate(near_family(85, 60, 5, 0) + [(0, " ".join(prose(500 + k, 30))) for k in range(2500)])]
    got = near_dedup.groups(frame(spark, rows, clash=False)).collect()
    assert len(got) == len(rows)
    want = Counter((i, n, c) for i, n, c, _ in plain_components(rows[:60], 85))
    assert not want - Counter((r.doc_id, r.n_shingles, r.component_id) for r in got)


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(3)
    for j in (0.0, 0.5, 0.85, 1.0):
        errors = []
        for _ in range(30):
            pool = np.unique(rng.integers(0, 1 << 63, 2000).astype(np.uint64))
            both = int(j * 1000)
            half = (1000 - both) // 2
            a, b = pool[: both + half], np.concatenate([pool[:both], pool[both + half : both + 2 * half]])
            true = both / (both + 2 * half)
            errors.append(near_dedup.estimated(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([len(a)]), np.array([len(b)]))[0] - true)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    assert (near_dedup.merged(near_dedup.registers(a), near_dedup.registers(b)) == near_dedup.registers(np.union1d(a, b))).all()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (205, 204)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 120), 100), 204: 204, 205: 204}
