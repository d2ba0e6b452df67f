"""A corpus pipeline of five stages over ``documents``; each is written and read again.

The language stage drops documents without a letter or unlike every learned language and sets
``lang``; the line stage removes repeated lines; the near-duplicate stage leaves one document of
each group; the mixing stage repeats or leaves out documents to meet the sources' targets; the last
encodes and decodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.language import UNKNOWN, identify_language, learn_profiles
from tideline.llm.lines import dedup_lines
from tideline.llm.mixing import mix
from tideline.llm.near import near_duplicates
from tideline.llm.pieces import encode_documents
from tideline.llm.queries import PIECE_MODEL
from tideline.storage import drop_path, materialize, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts of fewer letters are too short to tell noise from a language and are dropped at score 0 only.
SHORT = 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text is null, has no letter or is unlike every learned language, and sets
    ``lang`` to the prediction. Profiles are learned from the rows with a language. Short texts of
    learned languages stay, and so do repeated rows and rows without an id; without any language to
    learn from nothing can be told and nothing stays. An empty table stays empty. Other columns than
    those of documents are left out, here and in the later stages."""
    profiles = learn_profiles(docs)
    letters = F.char_length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    found = identify_language(docs.select(*COLUMNS), profiles, keep=["doc_id", "text", "source", "n_chars"])
    return found.where((F.col("lang_pred") != UNKNOWN) & ((F.col("score") > profiles.margin) | ((F.col("score") > 0) & (letters < SHORT)))).withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that a document with a smaller id has and counts ``n_chars`` anew; every row stays.
    Rows with equal ids are one document, a null id is the largest one, null texts become empty."""
    done = dedup_lines(docs.select(*COLUMNS))
    return done.withColumns({"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("bigint")}).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the document with the smallest id of every group of near-duplicates (five-word shingles,
    similarity 0.8). Rows with equal ids are one document and stay or go together; rows without an id and
    texts without words are like nothing and stay."""
    gone = materialize(near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "pipeline-near")
    near = F.broadcast(gone) if gone.count() <= 200_000 else gone
    return docs.select(*COLUMNS).join(near, "doc_id", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out rows so that the sources meet their targets. Rows with equal ids, or without
    one, are all taken as often as the one of them that is taken most; rows of no words are not taken."""
    copies = materialize(mix(docs).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies")), "pipeline-mix")
    copies = copies.withColumnRenamed("doc_id", "id")
    taken = docs.select(*COLUMNS).join(copies, F.col("doc_id").eqNullSafe(F.col("id")))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``lang``, ``source`` and the digests of ids and decoded text, a row for every row; null
    texts have no ids."""
    return encode_documents(docs, PIECE_MODEL, keep=["doc_id", "lang", "source"])


STAGES = [("language ID", language), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("mixing", mixing), ("SentencePiece", sentencepiece)]

#: Dependent rounding and the profiles cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage's input and what it stored on the way are deleted once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}"))
        if before:
            drop_path(spark, before)
        before = docs.stored_at
    return STAGES[-1][1](spark, docs, sf_dir)
