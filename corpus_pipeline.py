"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm._shared import durable, read_table
from lectern.llm.exact_dedup import drop_exact_copies
from lectern.llm.near_dedup import drop_near_copies
from lectern.llm.packing import pack_documents
from lectern.llm.pii import sanitise
from lectern.llm.quality_pu import keep_good
from lectern.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects go.

    Null and empty texts have a score like any other; an empty table, and columns of any other name, pass.
    """
    return keep_good(docs, read_table(spark, sf_dir, "labels"), threshold=0.3)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays; null counts as empty, so of all such rows one stays."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8 or more) the one with the smallest id stays.

    Null and empty texts, and rows without an id, are linked with nothing and stay.
    """
    return drop_near_copies(docs, words=5, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced; no document goes, and a null text stays null."""
    clean = sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a training sequence; a null or empty text is its end token alone."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("PII", personal_data),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each keeps is written to the shared folder, and goes when the next is written."""
    docs = read_table(spark, sf_dir, "documents")
    done: tuple[DataFrame, ...] = ()
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"), after=done)
        done = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the tokenizer and the plan are beyond SQL; tests/llm holds them against brute force.
ORACLE_SQL = None
