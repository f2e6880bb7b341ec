"""A corpus pipeline: language ID, near duplicates, decontamination, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as
the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.llm.common import discard, kept, table
from stepwise.llm.decontaminate import drop_leaks
from stepwise.llm.langid import has_language, identify, learn
from stepwise.llm.mixing import mix
from stepwise.llm.ngram_join import similar_groups
from stepwise.llm.queries import held_out, mix_levels
from stepwise.llm.sharding import assign_shards

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a text in a known language; the model learns from their labels."""
    predicted = identify(docs.select(*COLUMNS), learn(docs.where(~held_out())), keep_rows=True)
    return has_language(predicted).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (5 words, 0.8): that with the smallest id.

    Rows of one id are told apart by their texts; of rows with one id and text the one whose columns sort
    first stays.  A document without an id stays if no other one is like it; of several the one with the
    smallest hash of its text.
    """
    groups = similar_groups(docs, words=5, similarity=(80, 100))
    chosen = groups.where("leads").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("_rows"))
    chosen = chosen.select(F.col("doc_id").alias("_of"), "text_hash", "_rows")
    rows = docs.select(*COLUMNS)
    rows = rows.join(chosen, rows["doc_id"].eqNullSafe(chosen["_of"]) & (F.xxhash64("text") == chosen["text_hash"]))
    # texts are shuffled again only where rows repeat
    again = rows.where("_rows > 1").groupBy("_of", "text_hash").agg(F.min(F.struct(*COLUMNS)).alias("one")).select("one.*")
    return rows.where("_rows = 1").select(*COLUMNS).unionByName(again)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark within the error budget."""
    return drop_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Choose three quarters of the tokens by the weights of domain, language and source, each document once."""
    levels, weights = mix_levels()
    return mix(docs.select(*COLUMNS), levels, weights, budget=(3, 4), max_epochs=1, seed=7).select(*COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the documents into 40 shards of nearly equal bytes."""
    return assign_shards(docs, 40, carry=["text", "lang", "source", "n_chars"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
    ("sharding", sharding),
]

#: SQL cannot cut texts into longest phrases of a sample; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``.

    What each returns is written to the shared folder and read again; it is deleted when the next stage
    has been written.
    """
    docs, spent = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, folder = kept(stage(spark, docs, sf_dir), "pipeline")
        if spent:
            discard(spark, spent)
        spent = folder
    return docs
