"""A corpus pipeline: five operators in a row, each on all that the one before has kept.

Every stage takes and returns the columns of documents, further ones included, whatever their names; the last returns
the packed pieces. Edge cases, stage by stage:

* toxicity: null and empty texts score as texts without any feature and stay; with no labels nothing goes; rows without
  doc_id are judged and never train; repeated rows are judged alike.
* near copies: null and empty texts have no copies and stay; of equal or near texts that of the smallest doc_id stays;
  rows that repeat doc_id and text are one document; a row without doc_id goes if another has its text.
* decontamination: null and empty texts and items match nothing; an empty benchmark drops nothing.
* personal data: null texts stay null, n_chars follows the masked text; repeated rows are masked alike.
* packing: null texts count as empty and take one place each (the end id).

Empty tables pass through all of them to an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm.common import discard, materialize, table

#: No SQL: classifiers and tokens are in it. tests/llm/test_pipeline.py states which planted rows go and which stay.
ORACLE_SQL = None


#: Texts of an Arrow batch. A worker holds its batch, and its JVM the buffers of it: 10 000 texts are 33 MB in each of them, and again in what is returned.
BATCH = 1024


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH`` rows, for the rest of the session: what a stage returns is computed after its call."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, BATCH)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from quernstone.llm.toxicity import keep_clean

    small_batches(spark)
    return keep_clean(spark, docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from quernstone.llm.near_dup import keep_first

    small_batches(spark)
    return keep_first(spark, docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from quernstone.llm.decontamination import drop_leaks

    small_batches(spark)
    return drop_leaks(spark, docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from quernstone.llm.pii import redact

    small_batches(spark)
    return redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quernstone.llm.packing import PackParams, pack

    return pack(spark, docs, PackParams(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-copies", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("personal-data", mask_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(spark, stage(spark, docs, sf_dir), name)
        discard(spark, before)  # the result of the stage before; the table itself was never ours
    return STAGES[-1][1](spark, docs, sf_dir)
