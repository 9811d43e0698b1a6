"""The pipeline's stages, each against a plain version on its own input."""

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from samples import SMALL, frame, odd, prose  # noqa: F401
from test_table_operators import fold, plain_components

from tickloom.llm import common, decontamination, exact_dedup, near_dedup, piece_codec, quality
from tickloom.llm.common import store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_on_the_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = store(stage(spark, docs, SMALL), "stage")
        if name == "sentencepiece":
            assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in before)
            break
        assert out.columns == COLUMNS
        stays = {r.doc_id for r in out.collect()}
        ids = {r.doc_id for r in before}
        if name == "quality classifier":
            weights = quality.fit(docs, labels)
            want = {r.doc_id for r in quality.score(docs, weights).collect() if r.predicted}
        elif name == "exact dedup":
            last = {}
            for r in before:
                last[fold(r.text)] = max(r.doc_id, last.get(fold(r.text), r.doc_id))
            want = set(last.values())
        elif name == "near dedup":
            want = {i for i, _, _, kept in plain_components([(r.doc_id, r.text) for r in before], corpus_pipeline.SIMILAR) if kept}
        else:
            want = ids - {r.doc_id for r in decontamination.pairs(docs, bench).collect()}
        assert stays == want and {tuple(r) for r in out.collect()} <= {tuple(r) for r in before}
        docs = out


def test_missing_and_repeated_ids_lose_nothing(spark, odd, tmp_path):
    rows = frame(spark, odd)
    for stage, left in ((corpus_pipeline.once, len({fold(t) for _, t in odd})),):
        out = stage(spark, rows, SMALL)
        assert out.columns == rows.columns and out.count() == left
    assert corpus_pipeline.uncontaminated(spark, rows, SMALL).count() == len(odd)
    assert corpus_pipeline.unlike(spark, rows.limit(0), SMALL).count() == 0


def test_one_row_stays_of_near_copies_with_missing_or_repeated_ids(spark):
    words = prose(5, 80)
    group = [" ".join([*words, end]) for end in ("one", "two", "three")]
    rows = frame(spark, [(None, t) for t in group] + [(7, " ".join(reversed(t.split()))) for t in group] + [(7, "short"), (None, None)])
    left = sorted((r.doc_id is None, (r.text or "").split()[:1]) for r in corpus_pipeline.unlike(spark, rows, SMALL).collect())
    assert [none for none, _ in left] == [False, False, True, True]


def test_texts_and_sets_travel_in_small_batches(spark):
    """A batch of 10,000 rows took tens of MB for each task, in the executor and in its worker."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([batch.nbytes], pa.int64())})

    @common.in_small_batches
    def largest(docs):
        return store(docs.mapInArrow(sizes, "bytes long"), "sizes").agg(F.max("bytes")).first()[0]

    texts = spark.range(0, 4000, 1, 1).select(F.expr("repeat('some words ', 500)").alias("text"))
    assert 0 < largest(texts) < 1.1 * common.BATCH_BYTES
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    assert spark.conf.get(setting, None) is None
    spark.conf.set(setting, "100000")  # a setting of the user's own holds, and stays
    try:
        assert largest(texts) < 110_000 and spark.conf.get(setting) == "100000"
    finally:
        spark.conf.unset(setting)


def test_stages_store_their_tables_in_small_batches(spark, odd, monkeypatch):
    seen = []

    def noted(df, kind="table"):
        seen.append(df.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None))
        return store(df, kind)

    for module in (corpus_pipeline, exact_dedup, near_dedup, quality):
        monkeypatch.setattr(module, "store", noted)
    rows = common.store(frame(spark, odd), "rows")
    for stage in (corpus_pipeline.of_good_quality, corpus_pipeline.once, corpus_pipeline.unlike):
        stage(spark, rows, SMALL)
    assert len(seen) > 15 and set(seen) == {str(common.BATCH_BYTES)}


def test_a_worker_remembers_for_one_operator_only(spark):
    """Workers live on through the stages; what they remember for other operators is forgotten."""
    rows = spark.range(0, 64, 1, 64).select(F.col("id").alias("doc_id"), F.expr("concat('a few words of text ', id, ' and more')").alias("text"))

    def remembers(batches):
        for batch in batches:
            for _ in batch.column(0):
                sizes = [len(quality.CODES), len(common.WORDS), piece_codec.codec_of.cache_info().currsize]
                yield pa.RecordBatch.from_pydict({"n": pa.array([sum(map(bool, sizes))], pa.int64())})

    quality.score(rows, np.zeros(quality.DIMENSIONS + 1, np.float32)).collect()
    near_dedup.sketched(rows, "doc_id", "text", None).collect()
    piece_codec.digests(rows, public_tokenizers.path("piece_bpe_32k.model")).collect()
    near_dedup.sketched(rows, "doc_id", "text", None).collect()
    assert rows.select("doc_id").mapInArrow(remembers, "n long").agg(F.max("n")).first()[0] == 1
