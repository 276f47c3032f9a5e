"""From raw documents to packed training sequences in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which ``run`` writes as Parquet in the shared folder
and reads again as the next stage's documents.  Every stage works on all rows
its predecessor kept.  All but the last return the columns of ``documents``.

1. quality: documents whose tail probability (well written and not toxic) is below 0.5 go;
2. exact dedup: of equal texts the largest doc_id stays;
3. near dedup: of each near-duplicate class the smallest doc_id stays;
4. mixing: documents are taken towards the weights of the domain-language-source tree, each at most once; a document
   costs its estimated tokens and the end token that packing gives it;
5. packing: what is left is packed into sequences of 2,048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flipwise.llm import mixing
from flipwise.llm.common import row_of, stored, table
from flipwise.llm.exact_dedup import exact_dedup
from flipwise.llm.near_dedup import near_dedup
from flipwise.llm.packing import pack
from flipwise.llm.quality_model import good_documents

#: Share of the tokens that reach the mixing stage which its budget takes.
MIXED_FRACTION = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the ordinal classifier, fitted on the labels, keeps; texts without words go, null ids and repeated rows count each."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the largest id; null counts as empty."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class, that with the smallest id; texts without words are near no other."""
    return near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the budgets take, each at most once; a null language or source is a node of its own."""
    rows = docs.select(row_of(docs).alias("row"), "doc_id", "text", "lang", "source")
    taken = mixing.mix(rows, mixing.document_levels(), mixing.WEIGHTS, fraction=MIXED_FRACTION, max_epochs=1, seed=mixing.SEED,
                       tokens=mixing.text_tokens() + F.lit(1))
    return taken.select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2,048 tokens; null texts are one end token."""
    return pack(docs, capacity=2048, end_id=0)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

#: SQL cannot express the trained classifier, the near-duplicate search or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces that the stages make of ``documents``; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
