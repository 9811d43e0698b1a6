"""Named queries of the corpus operators over the given tables, with their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import decontamination, exact_dedup, manifest, near_dedup, personal, piece_codec, quality, secrets, sharding, substring_dedup, token_counts, token_files, whitening
from tickloom.llm.common import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_secret_scan",
    r"""
    WITH t AS (
        SELECT doc_id, coalesce(text, '') AS text,
               '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)' AS assign
        FROM documents),
    kinds AS (
        SELECT doc_id, 0 AS k, 'assign' AS kind, regexp_extract_all(text, assign) AS m, string_split_regex(text, assign) AS gaps,
               regexp_extract_all(text, assign, 2) AS body, 8 AS least FROM t
        UNION ALL SELECT doc_id, 1, 'access', regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+'),
               regexp_extract_all(text, 'AKIA[A-Z0-9]+'), 16 FROM t
        UNION ALL SELECT doc_id, 2, 'hex', regexp_extract_all(text, '[0-9a-f]+'), string_split_regex(text, '[0-9a-f]+'),
               regexp_extract_all(text, '[0-9a-f]+'), 32 FROM t),
    each AS (SELECT doc_id, k, kind, least, unnest(m) AS m, unnest(gaps[:len(m)]) AS gap, unnest(body) AS body, generate_subscripts(m, 1) AS i FROM kinds WHERE len(m) > 0),
    placed AS (
        SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS BIGINT) AS stop FROM each),
    kept AS (SELECT doc_id, k, kind, stop - length(m) AS start, stop FROM placed WHERE length(body) >= least),
    joined AS (
        SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
               string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans
        FROM kept GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents LEFT JOIN joined USING (doc_id)
    """,
)
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query(
    "op2_exact_dedup",
    """
    WITH n AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
        FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
           sha256(norm) AS text_sha256
    FROM n WINDOW g AS (PARTITION BY norm)
    """,
)
def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


@query("op5_sentencepiece")
def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), most=piece_codec.MORE_PARTS)


@query("op6_token_counts")
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_token_output")
def token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_digests(corpus)


@query("op8_sharding")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 8)


@query("op4_quality")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query(
    "op7_substring_dedup",
    r"""
    WITH w AS (
        SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
    starts AS (SELECT r, words, unnest(range(1, len(words) - 33)) AS s FROM w WHERE len(words) >= 35),
    windows AS (SELECT r, s, md5(array_to_string(words[s:s + 34], ' ')) AS h FROM starts),
    again AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1),
    gone AS (SELECT r, list_distinct(flatten(list(range(s, s + 35)))) AS places FROM again GROUP BY r),
    kept AS (
        SELECT doc_id, words, coalesce(len(places), 0) AS n_removed,
               CASE WHEN places IS NULL THEN words ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(places, x[2])), lambda x: x[1]) END AS rest
        FROM w LEFT JOIN gone USING (r))
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept
    """,
)
def substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


@query(
    "op10_near_dedup",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
        FROM documents),
    s AS (
        SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
               ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingles FROM w),
    sizes AS (SELECT doc_id, len(shingles) AS n FROM s),
    e AS (SELECT doc_id, unnest(shingles) AS g FROM s),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
    edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
    SELECT a AS doc_id, any_value(n) AS n_shingles, min(b) AS component_id, a = min(b) AS kept FROM reach JOIN sizes ON a = doc_id GROUP BY a
    """,
)
def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"))


@query("op9_decontamination")
def contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_whitening")
def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query(
    "op12_merkle_manifest",
    r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, coalesce('=' || lang, '') AS g, text, row_number() OVER () AS nr,
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small,
               coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
               || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
               list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                   lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
        FROM documents),
    leaves AS (
        SELECT doc_id, g, nr, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
               CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || coalesce(strlen(small) || ':' || small, '-')) END AS tampered
        FROM d),
    placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, nr) - 1 AS pos FROM leaves),
    nodes(level, g, pos, digest, total) AS (
        SELECT 0, g, pos, leaf, count(*) OVER (PARTITION BY g) FROM placed
        UNION ALL
        SELECT DISTINCT level + 1, g, pos // 8, sha256(string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
               (total + 7) // 8 FROM nodes WHERE total > 1),
    subroots AS (SELECT g, digest AS subroot, level AS top, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS total FROM nodes WHERE total = 1),
    tops(level, pos, digest, total) AS (
        SELECT 0, pos, subroot, total FROM subroots
        UNION ALL
        SELECT DISTINCT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
               (total + 7) // 8 FROM tops WHERE total > 1),
    root AS (SELECT digest AS root FROM tops WHERE total = 1),
    sides AS (
        SELECT p.nr, n.level, coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos < p.pos // CAST(pow(8, n.level) AS BIGINT)), '') AS l,
               coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos > p.pos // CAST(pow(8, n.level) AS BIGINT)), '') AS r
        FROM placed p JOIN nodes n ON n.g = p.g AND n.total > 1 AND n.pos // 8 = p.pos // CAST(pow(8, n.level + 1) AS BIGINT) GROUP BY ALL
        UNION ALL
        SELECT p.nr, 100 + n.level, coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos < s.pos // CAST(pow(8, n.level) AS BIGINT)), ''),
               coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos > s.pos // CAST(pow(8, n.level) AS BIGINT)), '')
        FROM placed p JOIN subroots s USING (g) JOIN tops n ON n.total > 1 AND n.pos // 8 = s.pos // CAST(pow(8, n.level + 1) AS BIGINT) GROUP BY ALL),
    paths AS (SELECT nr, list(l || '|' || r ORDER BY level) AS path, string_agg(l || r, '' ORDER BY level) AS siblings FROM sides GROUP BY nr),
    folded AS (
        SELECT nr, siblings, list_reduce(list_prepend(coalesce(tampered, leaf), coalesce(path, [])), lambda acc, p: sha256(split_part(p, '|', 1) || acc || split_part(p, '|', 2))) AS folded_root
        FROM placed LEFT JOIN paths USING (nr))
    SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
    FROM placed JOIN folded USING (nr) JOIN subroots USING (g), root
    """,
)
def merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit(table(spark, sf_dir, "documents")).drop("path")


@query("op13_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.scan(table(spark, sf_dir, "documents"))
