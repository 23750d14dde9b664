"""A pipeline for a training corpus: quality, language, lines, near duplicates, packing.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents, further ones included. For
all stages: an empty table gives no rows; a null doc_id is an id like another, and stays null; a null text counts as
empty; a null lang or source is a value like another; texts of any length that a row can hold are taken whole. Verdicts
are by doc_id and text, so rows that share a doc_id, or have none, are judged each by its text.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pennant.llm import language, lines, minhash, packing, quality
from pennant.llm.common import id_in, small, written

#: A language is trusted from this calibrated probability on; with four languages a mere guess has 0.25.
LEAST_SCORE = 0.34
#: Rows of document ids that are broadcast at most.
ID_ROWS = 200_000


def _without(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id and text are always judged with a false kept in judged (doc_id, text_hash, kept)."""
    rejected = judged.groupBy("doc_id", "text_hash").agg(F.bool_or("kept").alias("kept")).where(~F.col("kept"))
    gone = small(written(rejected.select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_h")), "rejected"), ID_ROWS)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_doc_id"]) & (F.xxhash64(docs["text"]) == gone["_h"]), "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the host-level rules, their hosts held against the corpus; those without 50 words go.

    Repeated rows are judged alike and stay or go together.
    """
    return _without(docs, quality.host_rules(docs, host="source"))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with some confidence; those without a letter go.

    Repeated rows are judged alike and stay or go together. If no row has a lang nothing is learned, and all go.
    """
    found = language.identify(docs)
    return _without(docs, found.select("doc_id", "text_hash", ((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).alias("kept")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that resemble earlier ones; those of which nothing is left go.

    Earlier is by (doc_id, text, line), a null doc_id first. Rows with equal doc_id and text come out alike. n_chars is
    counted again where lines went.
    """
    done = lines.rewrite_lines(docs)
    done = done.withColumn("n_chars", F.when(F.size("_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.where((F.size("_removed") == 0) | F.col("text").rlike(lines.WORD)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id.

    Here the verdict is by doc_id and text, so that different texts stay if they have no doc_id or share one. Of rows with
    equal doc_id and text the one whose other columns come first stays. Documents without words stay.
    """
    row = ["_doc_id", "_h"]
    judged = written(minhash.first_rows(docs).toDF(*row, "kept"), "judged")
    marked = docs.withColumns({"_doc_id": id_in(), "_h": minhash.text_hash()})
    rest = marked.join(small(judged.where("not kept").select(*row).distinct(), ID_ROWS), row, "left_anti")
    repeated = written(judged.where("kept").groupBy(*row).agg(F.count("*").alias("n")).where("n > 1").select(*row), "repeated")
    if repeated.isEmpty():
        return rest.select(docs.columns)
    few = small(repeated, ID_ROWS)
    one = rest.join(few, row, "left_semi").groupBy(row).agg(F.min(F.struct(*docs.columns)).alias("first")).select("first.*")
    return rest.join(few, row, "left_anti").select(docs.columns).unionByName(one)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 1024; repeated rows are packed each, an empty text as its end alone."""
    place = public_tokenizers.path
    encoder = partial(packing.byte_bpe, place("byte_bpe_50k.json"), place("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack(docs, encoder, end_id=0, window=1024)


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: The trained model of the language stage cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
