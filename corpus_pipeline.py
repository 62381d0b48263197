"""A training-data pipeline over the table `documents`, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept:

1. language: documents whose text has no letter, or whose language can't be told, go; `lang` of the others is
   what the text says.
2. near_duplicates: one document of each class of near SimHash fingerprints stays, that of the smallest id.
3. substrings: windows of 20 words that start earlier in the corpus are taken out of the texts.
4. mixture: sources are mixed to their target weights; a document comes as often as it is taken.
5. tokens: texts become the ids of the subword model.

All stages but the last return the columns of what they are given, whatever else those are called; without rows they return none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import langid, mixing, pieces_bpe, simhash, substring_fm
from foliospark.llm.common import cut

#: A language is told if its score is as high at least.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose language is told, `lang` put right. Null and letterless texts go; the ids play no part; repeated rows stay."""
    model = langid.fit(langid.training_rows(docs, F.lit(True)))
    found = langid.identify(docs, model, docs.columns).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return found.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(f"carried.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, that of the smallest id, null ids last: fingerprints of two-word shingles within ten bits, of five-word shingles within fourteen. Null, empty and blank texts are one class."""
    return simhash.keep_one(docs, wide=True)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without windows that start earlier, n_chars put right. Texts that lose nothing stay as they are, those that lose all go, as do texts without words."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    left = substring_fm.dedupe(docs, carry=others, verbatim=True).where("n_removed < n_words")
    return left.select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), F.length("kept").cast("long").alias("n_chars"), *[F.col(f"carried.`{c}`").alias(c) for c in others]).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, each row as often as its source's target takes it, up to three times. A null source is one of its own."""
    mixed = mixing.mix(docs, carry=docs.columns).where("times > 0")
    return mixed.select("carried", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("carried.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row; null text is empty."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        coded = pieces_bpe.encode(docs, f.read(), chunks=400_000)
    return coded.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixture", mixture), ("tokens", tokens)]

#: Language identification, SimHash and the subword model can't be said in SQL: tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a table that the next reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
