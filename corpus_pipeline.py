"""A training corpus out of documents: toxic documents, exact copies and near copies go, sources are
mixed to their weights, and the texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs. Stages but the last keep the columns of documents, whatever others there
are and whatever their names. An empty table stays empty through all stages; texts are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rxncurate.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from rxncurate.llm.common import stored


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on these documents' labels, does not reject. Null and
    empty texts get the intercept's score; rows of null id are scored like others; repeated rows go or
    stay together; without labels nothing is rejected."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of largest id. Null and empty texts are equal; rows of one id and text
    are ties and stay; a null id stays only where no equal text has an id."""
    return exact_dedup.drop_exact_duplicates(docs)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their 5-word shingles, the smallest id. Texts
    without words and rows of null id link with nothing and stay; rows of one id stay or go together."""
    return jaccard_join.drop_near_duplicates(docs, n=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Null sources are one source; texts without
    words have size 0 and are not taken; rows of one id may be taken a different number of times."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of the mix; null text is empty."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", clean), ("exact_dedup", distinct), ("jaccard_join", apart), ("source_mixing", mixed), ("bpe", encoded)]

#: The stages hold a trained model and hash joins that SQL cannot express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
