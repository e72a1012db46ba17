"""A corpus pipeline of five stages: language, quality, near duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. run()
writes each stage's rows to the shared folder and reads them again as the next one's docs, so that a lost executor
repeats at most one stage's tasks.

In every stage null and empty texts are as texts without a word, rows with a null id are decided by their text, rows that
repeat are decided alike, columns of any name pass through as they are, and an empty table stays empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm import near_copies, op02_bpe, op03_language, op05_quality, op09_decontaminate
from pixelframe.llm.common import drop_scratch, materialize, table
from pixelframe.llm.queries import QUALITY

#: Best and second-best language must be so far apart: 0.5 is a tie.
LEAST_LANGUAGE_SCORE = 0.505


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (so also null texts) and those whose two best languages are as good as tied."""
    profiles, pred, score = op03_language.learn(docs), _free(docs, "lang_pred"), _free(docs, "score")
    found = op03_language.identify(docs, profiles, keep=tuple(c for c in docs.columns if c != "doc_id"), pred_col=pred, score_col=score)
    sure = (F.col(pred) != "und") & ((F.col(score) >= LEAST_LANGUAGE_SCORE) | F.lit(len(profiles.languages) < 2))
    return found.where(sure).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score below the threshold of op5."""
    model, score = op05_quality.learn(docs, table(spark, sf_dir, "labels")), _free(docs, "score")
    found = op05_quality.score_texts(docs, model, keep=tuple(c for c in docs.columns if c != "doc_id"), score_col=score)
    return found.where(F.col(score) >= QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group: five-word shingles, a Jaccard similarity of 0.8 or more.

    SimHash keys propose, MinHash bands propose what lies beyond their reach, and whole sets of shingles decide."""
    return near_copies.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item."""
    return op09_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    import public_tokenizers

    return op02_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("encoding", encoding)]

#: SQL can express neither the learned models nor the fingerprints; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        drop_scratch(before)  # of the input tables, which have none, nothing is dropped
    return STAGES[-1][1](spark, docs, sf_dir)
