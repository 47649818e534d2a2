"""Documents to packed training sequences. Each stage is written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm.common import small_batches, stored
from feedlens.llm.language import identify_languages
from feedlens.llm.mixing import mix_documents
from feedlens.llm.near_text import near_duplicates
from feedlens.llm.packing import pack_documents
from feedlens.llm.registry import TOKENIZER, language_model


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; the predicted language replaces a missing one.

    Texts that are null, have no letter or fit two languages equally well go. Learned from the
    documents themselves, as the query of language identification does. Repeated rows and null ids are
    judged like any other; other columns stay, whatever their names; an empty table gives no rows.
    """
    # names of our own, so that no column of the documents can clash with an answer
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    name = dict(zip(docs.columns, plain.columns, strict=True))
    others = [c for c in plain.columns if c != name["doc_id"]]
    found = identify_languages(plain, language_model(docs), id_col=name["doc_id"], text_col=name["text"], keep=others)
    clear = found.where(~F.col("rejected")).withColumn(name["lang"], F.coalesce(name["lang"], "lang_pred"))
    return clear.select(*[F.col(c).alias(given) for given, c in name.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; repeated rows once."""
    judged = near_duplicates(docs).where("kept").select("doc_id").distinct()
    kept = docs.dropDuplicates(["doc_id"]).where(F.col("doc_id").isNotNull()).join(judged, "doc_id", "left_semi")
    return kept.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shuffled within output shards."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Compression and token packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns what the last one returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with small_batches(spark):
            docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
