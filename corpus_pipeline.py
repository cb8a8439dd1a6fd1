"""The corpus pipeline: five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, with_row_key, without_rows, written
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.langid import identify, learn_languages
from tessera.llm.packing import packed
from tessera.llm.simhash import near_text_clusters
from tessera.llm.toxicity import learn_lexicon, score_toxicity


#: Of a text at about 85 % in another language than it declares this share is met; mixed texts stay.
FOREIGN = 0.7


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told and which aren't all, or nearly all, in another one than they declare; the source stands for the host."""
    keyed, key = with_row_key(docs)
    source = F.col("source")
    told = identify(keyed, learn_languages(docs), key, "text", F.col("lang"), source, source, F.lit(""))
    return without_rows(keyed, told.where(~F.col("accepted") | (F.col("foreign") >= FOREIGN)).select(key), key)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon doesn't mark as toxic; it is learned from the labels that aren't held out."""
    keyed, key = with_row_key(docs)
    scored = score_toxicity(keyed, learn_lexicon(docs, table(spark, sf_dir, "labels")), key)
    return without_rows(keyed, scored.where("predicted = 1").select(key), key)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five words, similarity of about 0.8 or more).

    Rows without an id stay only where their group has none.
    """
    keyed, key = with_row_key(docs)
    found = near_text_clusters(keyed, carry=[key])
    return without_rows(keyed, found.where("NOT (doc_id <=> component_id)").select(key), key)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of each document in bins; see tessera.llm.packing."""
    return packed(docs)


STAGES = [("language_id", language_id), ("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("packing", packing)]

#: Language, toxicity and fingerprints have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
