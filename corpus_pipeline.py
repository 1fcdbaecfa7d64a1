"""The corpus pipeline: language, toxicity, near-duplicates, benchmark leaks, tokens.

Each stage is a function of the session, the documents that the stage before kept, and the table folder.  ``run``
writes every stage's rows as Parquet in the shared scratch folder and reads them again.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metroframe.llm import bpe, decontaminate, langid, minhash, toxicity
from metroframe.llm.common import checked_join, read
from metroframe.session import materialize, tune

#: Posterior below which a language is not certain enough.
LEAST_LANGUAGE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; those without letters, null texts and uncertain ones go."""
    judged = langid.predict(docs, langid.fit(docs), keep=docs.columns, out=("_lang_pred", "_lang_score"))
    return judged.where((F.col("_lang_pred") != "und") & (F.col("_lang_score") >= LEAST_LANGUAGE)).select(*docs.columns)


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; learned from the labelled ones among them; all, where a class has none."""
    labels = read(spark, sf_dir, "labels").where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = checked_join(docs.select("doc_id", "text"), labels, ["doc_id"], "inner")
    if known.where("text is not null and cast(toxic as int) in (0, 1)").selectExpr("cast(toxic as int) AS y").distinct().count() < 2:
        return docs
    return toxicity.score(docs, toxicity.fit(known), keep=docs.columns, out="_toxic").where("_toxic < 0.5").select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the lowest id; repeated rows of an id count as copies.

    Rows with a null id cannot be named as copies and stay.
    """
    groups = minhash.near_duplicates(docs)
    copies = materialize(groups.where("not kept and doc_id is not null").select("doc_id").distinct())
    left = checked_join(docs, copies, ["doc_id"], "left_anti")
    again = materialize(groups.where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return left
    return checked_join(left, again, ["doc_id"], "left_anti").unionByName(checked_join(left, again, ["doc_id"], "left_semi").dropDuplicates(["doc_id"]))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document, encoded and decoded again."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language), ("toxicity", harmless), ("minhash", distinct), ("decontamination", uncontaminated), ("byte_bpe", tokens)]

#: Byte-level BPE cannot be written in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(tune(spark), sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
