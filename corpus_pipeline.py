"""Corpus pipeline: quality, near duplicates, repeated passages, mixing, tokens.

Each stage takes the session, the documents that the stage before it left and
the folder of the input tables. All but the last return the columns of
documents, others that came with them included, whatever their names. Ids and
texts may be null, texts empty or very long, rows repeated; of an empty table
each stage makes an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithospark.llm import bpe, mixing, near_dedup, quality, substring_dedup
from lithospark.llm.common import column, remove_folder, table
from lithospark.session import new_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Columns that stages read by name; others stand aside while a stage runs.
READ = ("doc_id", "text", "source", "n_chars")


#: Rows that Spark hands a Python worker at once. With ten times as many, Spark's usual number, an executor's buffers on
#: both sides come to hundreds of MB of texts.
BATCH_ROWS = 1000


def _with_columns_of_docs(stage: Stage) -> Stage:
    """``stage`` with other columns renamed meanwhile, so that none clashes with one that an operator adds, and with small batches."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        names = {c: c if c in READ else f"__column_{k}" for k, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[column(c).alias(name) for c, name in names.items()]), sf_dir)
        return out.select(*[column(name).alias(c) for c, name in names.items()])

    return run


@_with_columns_of_docs
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps, copies alike; those without a word go."""
    return quality.judge(docs).where("kept")


@_with_columns_of_docs
def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of the least id, null last, then of a hash of the text.

    Documents without a word are no duplicates and stay.
    """
    return near_dedup.drop_near_duplicates(docs)


@_with_columns_of_docs
def distinct_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that occur earlier; ``n_chars``, if there, follows a changed text.

    Every row stays, if with an empty text.
    """
    cut = substring_dedup.drop_repeated_passages(docs)
    if "n_chars" not in docs.columns:
        return cut
    n_chars = F.when(F.size("removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars)


@_with_columns_of_docs
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources with weights 5, 2, 1: a document as often as it is taken, one at a source's cut shortened.

    A null source is a source, the last; documents without a word are in no mix.
    """
    return mixing.materialise(mixing.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token count and ids, and the digests of these and of what they decode to; a null text has none."""
    return bpe.encode_decode(docs).drop("decoded")


STAGES = [
    ("quality classifier", good_documents),
    ("MinHash near-dedup", distinct_documents),
    ("substring dedup", distinct_passages),
    ("mixing sources to target weights", mixed_sources),
    ("BPE encoding and decoding", tokens),
]

#: Learned models and tokens have no SQL form; each stage is tested by itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents, each but the last written to the shared folder and read again.

    What a stage has read goes once the next one's documents are written; the
    last stage's input stays for whoever reads the result.
    """
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove_folder(spark, f"{folder}/{k - 1}")
    return docs
