"""Corpus preparation from raw documents to token counts, as a row of stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder
and gives the reread table to the next stage.  All stages but the last keep the columns of ``documents``.

1. quality          documents that the classifier, fitted on the labels, rejects go
2. exact dedup      of equal texts (A-Z in any case) the document with the largest id stays
3. near dedup       of every group linked by a similarity of 0.8 or more on five-word shingles, the smallest id stays
4. decontamination  documents that hold a benchmark item, word for word or with other numbers and names, go
5. encoding         one row per document: doc_id, n_tokens, ids_sha256, decoded_sha256

Rows are told apart by their place in their file, so missing and repeated ids do no harm.  Where several near-duplicates
carry the smallest id of their group, or none has an id, the first of these rows stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontamination, exact_dedup, near_dedup, piece_codec, quality
from tickloom.llm.common import in_small_batches, ship, store

SIMILAR = 80


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with ``_row``, the place of each row in its file, since ids may be missing or repeat."""
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("_row")
    try:
        return docs.select("*", place)
    except AnalysisException:  # not a table of files yet
        return store(docs, "documents").select("*", place)


@in_small_batches
def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose place is not in ``gone`` (_row); only places that go are joined."""
    return docs.join(store(gone.select("_row").distinct(), "gone"), "_row", "left_anti").drop("_row")


def of_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs)
    weights = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(rows, quality.score(rows, weights, id_col="_row").filter("predicted = 0"))


def once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs)
    return without(rows, exact_dedup.decide(rows, row_col="_row").filter("NOT kept"))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs)
    return without(rows, near_dedup.groups(rows, SIMILAR, row_col="_row").filter("NOT kept"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs)
    return without(rows, decontamination.pairs(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", of_good_quality),
    ("exact dedup", once),
    ("near dedup", unlike),
    ("decontamination", uncontaminated),
    ("sentencepiece", encoded),
]

#: The first stage is a fitted model, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
