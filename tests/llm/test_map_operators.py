"""Operators that look at one document at a time, against plain Python or the public libraries."""

import hashlib
import random
import re

import public_tokenizers
import sentencepiece
from samples import frame, odd, odd_docs, prose  # noqa: F401
from tokenizers import Tokenizer

from tickloom.llm import bpe, piece_codec, secrets, token_counts
from tickloom.llm.bpe import Bounded, PrefixTable, ranked_pairs

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_spans(text):
    rules = (
        ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
    )
    return [x for _, _, x in sorted((m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, g, least) in enumerate(rules) for m in p.finditer(text) if len(m[g]) >= least)]


def random_secrets(n):
    rng = random.Random(7)
    bits = ["Password", "passwd", "SECRET", "token", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abcdefgh", "x1+/", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "\n", "ſecret", "toKen"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_secrets_equal_the_patterns_on_whole_texts(spark, odd):
    rows = odd + [(100 + i, t) for i, t in enumerate(random_secrets(1500))]
    got = secrets.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), ",".join(plain_spans(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.spans) for r in got) == want
    for r in got:
        kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(kinds.count, ("assign", "access", "hex")))
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()


def test_findings_carry_the_text(spark):
    got = secrets.findings(frame(spark, [(1, "é token=abcdefgh1"), (2, None)])).collect()
    assert [(r.doc_id, r.kind, r.start, r.end, r.match) for r in got] == [(1, "assign", 2, 17, "token=abcdefgh1")]


def test_trigram_queries_hold_for_every_match_and_prune():
    queries = {r.kind: secrets.trigram_query(r) for r in secrets.RULES}
    assert queries["hex"] == secrets.ANYTHING
    assert queries["access"] == {frozenset({"aki", "kia"})}
    for rule in secrets.RULES:
        for text in random_secrets(3000):
            if any(rule.compiled().finditer(text)):
                assert any(all(t in text.lower() for t in clause) for clause in queries[rule.kind])
    index = secrets.SegmentIndex(["", "to", "tok", "xtokenx", "tok en"], {"tok", "oke", "ken"})
    assert index.search(frozenset({frozenset({"tok", "oke", "ken"})})).tolist() == [3]
    optional = secrets.trigram_query(secrets.Rule("x", "ab(cd)?ef(gh|ij)k+", 1))
    assert optional == secrets.simplified({frozenset({"abc", "bcd", "cde", "def", "efg", "fgh", "ghk"}), frozenset({"abe", "bef", "efg", "fgh", "ghk"}),
                                           frozenset({"abc", "bcd", "cde", "def", "efi", "fij", "ijk"}), frozenset({"abe", "bef", "efi", "fij", "ijk"})}) or all(len(c) for c in optional)


def test_pieces_equal_the_library(spark, odd, odd_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_codec.digests(odd_docs, MODEL).collect()}
    want = set()
    for i, text in odd:
        ids = library.encode(text or "", add_eos=True)
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == want
    assert [r.ids for r in piece_codec.encoded(frame(spark, [(1, "a b")]), MODEL).collect()] == [library.encode("a b", add_eos=True)]


def test_what_comes_often_stays_known():
    made = []
    known = Bounded(lambda key: made.append(key) or key.upper(), 10)
    for i in range(60):
        assert known["often"] == "OFTEN" and known[f"once{i}"] == f"ONCE{i}"
        assert len(known) + len(known.older) <= 10
    assert made.count("often") == 1


def test_pieces_do_not_depend_on_what_is_remembered(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 20)
    library, small = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_codec.PieceCodec(MODEL, 6)
    for text in [" ".join(prose(i, 30)) for i in range(20)] + ["", " é 日本 \x00\n\n𝒳 ▁a  b ", "naïve 日日 本 " * 9]:
        ids = library.encode(text, add_eos=True)
        assert small.encode(text) == ids and small.decode(ids) == library.decode(ids)
        assert small.digest(text) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_pieces_of_random_strings_equal_the_library():
    library, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_codec.PieceCodec(MODEL)
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice("ab \n▁é中😀<>0x́\t\x0b​") for _ in range(rng.randint(0, 30)))
        ids = library.encode(text, add_eos=True)
        assert codec.encode(text) == ids and codec.decode(ids) == library.decode(ids)


def test_counts_equal_the_library(spark, odd, odd_docs):
    library = Tokenizer.from_file(JSON)
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd_docs, JSON).collect()}
    want = set()
    for i, text in odd:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.add((i, len((text or "").encode()), n, n > 512))
    assert got == want


def test_every_prefix_count_and_budget_is_exact(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b ", " ", "\n", "'s", "'", "é", "中", "12", ".", " \xa0", "<|endoftext|>", "the "]) for _ in range(rng.randint(0, 14))) for _ in range(150)]
    byte, piece = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for counter, size in ((token_counts.ByteCounter(JSON), lambda t: len(byte.encode(t, add_special_tokens=False).ids)), (token_counts.PieceCounter(MODEL), lambda t: len(piece.encode(t)))):
        for text in texts:
            assert [counter.at(text, i) for i in range(len(text) + 1)] == [size(text[:i]) for i in range(len(text) + 1)]
            for budget in (0, 1, 3, 6):
                best = max(i for i in range(len(text) + 1) if size(text[:i]) <= budget)
                assert counter.fitting(text, budget) == (best, size(text[:best]))
    cut = token_counts.truncated(frame(spark, [(1, "a b c d e f"), (2, None)]), JSON, 3).collect()
    assert [(r.doc_id, r.text, r.n_tokens) for r in cut] == [(1, "a b c", 3), (2, "", 0)]


def test_prefix_table_equals_replayed_merges():
    rng = random.Random(5)
    for _ in range(40):
        merges, known = [], list("abc")
        while len(merges) < 12:
            pair = (rng.choice(known), rng.choice(known))
            if pair not in merges and len(pair[0] + pair[1]) < 7:
                merges.append(pair)
                known.append(pair[0] + pair[1])
        table = PrefixTable({p: i for i, p in enumerate(dict.fromkeys(known))}, ranked_pairs(merges))
        for _ in range(40):
            text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 20)))
            assert table.tokens(text) == table.merged(text)
            assert table.counts(text) == [len(table.merged(text[:i])) for i in range(len(text) + 1)]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert secrets.scan(none).count() == piece_codec.digests(none, MODEL).count() == token_counts.count_tokens(none, JSON).count() == 0


def test_a_long_text_is_read_whole(spark):
    text = " ".join(prose(9, 60_000, 5000)) + " secret=zzzzzzzzzz"
    assert secrets.scan(frame(spark, [(1, text)])).first().spans == f"assign:{len(text) - 17}:{len(text)}"
