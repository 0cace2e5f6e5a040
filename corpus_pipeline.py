"""From raw documents to token ids: language ID, exact dedup, near dedup, mixing, encoding.

Every stage reads all rows that the one before has kept, as a written table, and its decisions take effect on the rows
it hands on. A stage takes (spark, docs, sf_dir); all but the last return the columns of `documents`. Empty tables
give empty results, and extra columns, of any name, pass all stages but the last, which does not read them. Stages set the
session's Arrow batches to `session.BATCHES`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.bpe import encode
from panelcast.llm.exact_dedup import first_copies
from panelcast.llm.langid import accepted, fitted
from panelcast.llm.mixing import mixture
from panelcast.llm.ngram_join import one_of_each
from panelcast.session import cut_lineage, release_shuffles, small_batches


def _begin(spark: SparkSession) -> None:
    release_shuffles(spark)  # of the stages before
    small_batches(spark)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in one of the languages that the labelled rows teach. A row with a null text or one without a letter goes, and one
    whose words are far from anything in the sample; texts that several languages share stay. Where no row has a language, all stay."""
    _begin(spark)
    return accepted(docs, fitted(docs, F.lit(True)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts up to white space, the one with the smallest doc_id; null counts as empty. A null doc_id goes last, repeated rows
    leave one."""
    _begin(spark)
    return first_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links of 5-word shingles connect, the one with the smallest doc_id. Texts without words are linked with nothing; rows of one
    doc_id stay or go together."""
    _begin(spark)
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them: not at all, once or twice. Null is a source like others; a text without words is not
    taken; rows of one doc_id are taken alike."""
    _begin(spark)
    return mixture(docs, F.array("source"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token ids of every row; none for a null or empty text. Repeated rows and null ids have a row each."""
    _begin(spark)
    ids = encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("bpe", bpe)]

# Components by links and the flow cannot be put in SQL that ends on whole tables; tests/llm/test_pipeline.py has the plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
