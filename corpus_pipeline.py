"""A corpus in five stages: toxic documents go, near copies go, secrets are masked, sources are mixed, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet into the shared folder and
reads it again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, mixing, packing, secrets, toxicity
from tidemark.llm.common import keep, table

SHARE, EPOCHS = 0.9, mixing.EPOCHS
"""Of the tokens that reach the mixing stage so many are wanted, each at most twice: with one epoch nearly every leaf is taken whole, whatever its weight."""


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated trees predict to be toxic go. Null and empty texts stay."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the Jaccard join the document with the smallest id stays; rows that repeat it with the same text go too.

    Rows with a null id stay unless they are copies of a row with one.
    """
    return jaccard.first_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays. ``n_chars`` follows the text where it did before."""
    scanned = keep(secrets.scan(docs, owner=F.expr(secrets.GROUP)), "secrets")
    masked = secrets.redact(docs, scanned)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf of the tree of domains, languages and sources gives the prefix that its budget buys."""
    return mixing.taken(mixing.marked(docs, F.expr(mixing.DOMAIN), mixing.WEIGHTS, SHARE, EPOCHS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("secret_scans", without_secrets),
    ("source_mixing", mixed),
    ("packing", packed),
]

#: The trees of the first stage and the tokenizer of the last cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
