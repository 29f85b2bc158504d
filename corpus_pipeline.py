"""A corpus pipeline over ``documents``: quality classifier, near-duplicates,
benchmark decontamination, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir).  All but the last return the columns
of ``documents``; the last returns the encoded documents.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxomatch.llm import byte_bpe, minhash, pii, quality_model, tiling
from taxomatch.llm.common import table, written

#: Texts that go to Python at once.  Rows hold a few kB, some far more; Spark's
#: default of 10,000 rows a batch takes several buffers of 64 MB in each task.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000,
         "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}

#: Near-duplicates of the pipeline: five-word shingles, similarity 0.8 or more.
NEAR = minhash.Rule(words=5, num=80, den=100)


def small_batches(stage):
    """A stage whose session sends bounded batches to Python (a smaller setting stays)."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, most in BATCH.items():
            now = int(spark.conf.get(key).rstrip("bB"))
            if not 0 < now <= most:
                spark.conf.set(key, str(most))
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


@small_batches
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.one_of_each(docs, NEAR)


@small_batches
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return tiling.without_leaks(docs, table(spark, sf_dir, "benchmark"))


@small_batches
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become ``<KIND>``; ``n_chars`` is that of the new text."""
    out = pii.find_pii(docs, spans="_pii", redact=True)
    if "n_chars" in docs.columns:
        changed = F.size("_pii") > 0
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])


@small_batches
def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document with its token ids and the digest of the decoded bytes."""
    return byte_bpe.encode(docs.select("doc_id", "text"),
                           public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
                           ).select("doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("byte-level BPE", bpe_stage),
]

#: A trained classifier and similarity links are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what each keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
