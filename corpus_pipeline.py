"""A corpus pipeline: toxic documents go, copies go, near copies go, scarce domains repeat, what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it and reads it back as the next one's docs.

Null texts count as empty: they are not toxic, are equal to each other (the smallest doc_id stays), link with nothing, stay once in the mix and
encode to no token. Ties go to the smaller doc_id; columns beyond those of documents travel along, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from shelfspark.llm.common import table, written
from shelfspark.llm.queries import PATTERN, RANKS, domains


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose sentences make them toxic go; learnt from the labels outside the held-out fold."""
    model = toxicity.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts alike in 0.8 of their five-word shingles the smallest doc_id stays."""
    return ngram_join.drop_near_duplicates(docs, n=5, percent=80)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays once; documents of scarce domains repeat until domains weigh as the roots of their shares."""
    model = mixing.learn(docs, domains(docs, table(spark, sf_dir, "labels")))
    return mixing.mix_rows(docs, mixing.fit_rates(docs, model))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each row's token ids and of the text decoded from them."""
    return bpe.round_trip(docs, RANKS, PATTERN)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_domains), ("bpe", encode)]

#: No SQL states a fitted model, so the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
