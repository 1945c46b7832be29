"""Documents to packed training sequences: language ID, near duplicates, benchmark passages, secrets, packing.

Each stage is a function of (spark, docs, sf_dir) that works on all rows that the stage before has kept. All but the last
return the columns of documents, and more if docs has more; these may have any names. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontam, langid, ngram_join, packing, secrets
from orrery.llm.shared import new_path, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those that language ID rejects go. It learns from the labelled rows of docs.

    Null, empty and letterless texts go; equal texts stay or go together; without labelled rows no language is known.
    """
    learned = langid.language_dictionaries(docs.where(~langid.held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"))
    return langid.kept(docs, learned)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id, null ones last.

    Null, empty and wordless texts have no duplicates and stay; of rows that repeat with their doc_id one stays.
    """
    return ngram_join.representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts have none and stay; equal texts stay or go together."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark. Null and empty texts, and those without secrets, stay as they are."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens. A null or empty text is a piece with the end id alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secret_scan), ("packing", pack)]

#: No SQL: compression, lexing and BPE cannot be expressed. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again by the next. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
