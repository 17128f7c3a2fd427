"""Clean a corpus and pack it: toxic documents, exact copies and near copies go, repeated passages are cut, the rest is packed."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenurelens.llm import exact_dedup, jaccard_join, packing, suffix_dedup, toxicity
from tenurelens.llm.tables import read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, learned from ``labels``, doesn't find toxic."""
    return toxicity.without_toxic(docs, toxicity.learned(docs, read(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.without_copies(docs, keep_texts=False)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of five-word shingles of 0.8 or more, the one with the smallest id."""
    return jaccard_join.one_of_each(docs, width=5, percent=80)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of any 200-byte string that occurs twice."""
    return suffix_dedup.clean_documents(docs, length=200)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences of 2048."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard_join", drop_near_copies), ("suffix_array_dedup", cut_passages), ("best_fit_packing", pack)]
#: SQL expresses neither the classifier nor the tokenizer; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
