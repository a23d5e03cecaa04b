"""A training corpus from raw documents: language ID, near-dedup, decontamination, mixing, sharding.

Each stage reads all that the one before kept; run() writes every stage as Parquet in the shared folder and rereads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadscape.llm import decontam, langid, mixing, sharding, simhash
from loadscape.llm.arrow import free, named
from loadscape.llm.queries import VOCABULARY, held_out
from loadscape.llm.scratch import Scratch

#: A text goes if unknown text explains it better than every learned language by so many nats. Two or three stray names
#: or keys in a short text stay below that; a hundred letters of another language or script do not.
REJECT = 40.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; a language that was not given is filled in.

    Null and empty texts, texts without a letter, and texts that unknown text explains better by REJECT go, whatever
    ``lang`` says of them. Repeated rows fare alike, an empty table stays empty, further columns go along; without a
    labelled row no language is learned and nothing stays.
    """
    lang, score, evidence = free(docs, "_lang", "_score", "_evidence")
    model = langid.fit(docs, VOCABULARY, ~held_out(F.col("doc_id")))
    known = langid.predict(docs, model, lang_out=lang, score_out=score, evidence_out=evidence).where((F.col(lang) != langid.UNKNOWN) & (F.col(evidence) > -REJECT))
    return known.select(*[F.coalesce("lang", lang).alias("lang") if c == "lang" else named(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id.

    Null and empty texts are alike and leave one row; of rows that repeat an id and are alike one stays; a null id stays
    where its group has no other. An empty table stays empty, further columns go along.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay, repeated rows fare alike, null items are not looked for; an empty table
    stays empty, further columns go along.
    """
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks.

    A null text has no words and a null source is a source; a source without a word gives no rows; null ids share one
    coin, repeated rows fare alike. An empty table stays empty, further columns go along.
    """
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with its shard, 0 to 15, decided by the id: copies and null ids go together.

    An empty table stays empty, further columns go along, one called shard is replaced.
    """
    return sharding.assign_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", shards),
]
#: Language models, fingerprints and BM25 search are not SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        after = scratch.table(stage(spark, docs, sf_dir))
        if i:
            scratch.drop(docs)
        docs = after
    return docs
