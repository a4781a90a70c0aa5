"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, shared passages are cut out of
all documents but one, sources are mixed to their weights, and texts become token ids.

STAGES holds (name, function) pairs; each function takes (spark, docs, sf_dir), works on every row of docs, and returns a
DataFrame: all but the last with the columns of docs. Rows with a null id are scored, mixed and encoded like others but
take no part in the two deduplications. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import jaccard_join, mixing, passages, pieces, toxicity
from tesserae.llm.common import fresh, settled, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut; the network learns from the labelled ones."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_rows(docs, net)
    return scored.filter(F.col(scored.columns[-1]) < toxicity.CUT).select(*docs.columns)  # the score is the last column


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-equal documents, the one with the smallest id, once; if rows of that id differ in their text, each text once."""
    (head,) = fresh(docs, "head")
    heads = settled(spark, lambda: jaccard_join.join(docs).filter("doc_id = component_id").select(F.col("doc_id").alias(head)).distinct(), "heads")
    kept = docs.join(heads, F.col("doc_id") == F.col(head), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def cut_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one of a smaller id has; those of which nothing is left go."""
    ranges = settled(spark, lambda: passages.find(docs), "ranges")
    cut = passages.without(docs, ranges)
    gone = (F.col("text") == "") & (F.coalesce(F.col("n_chars"), F.lit(0)) > 0)
    return cut.filter(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once at least, those of small sources up to twice."""
    return mixing.mix(docs, evenness=mixing.EVENNESS).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", keep_one_of_group), ("substring_dedup", cut_shared_passages), ("mixing", mix_sources), ("sentencepiece", encode)]

#: The stages can't be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
