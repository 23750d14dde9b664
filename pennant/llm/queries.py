"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pennant.llm import audit, forest, language, licenses, lines, minhash, packing, pages, pieces, pii, quality, sharding, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors by their groups of near duplicates."""
    return forest.near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by their own measures and their hosts' verdicts."""
    judged = quality.host_rules(_table(spark, sf_dir, "documents"), host="source")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by their groups of near duplicates."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that resemble earlier ones."""
    return lines.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of all documents."""
    return language.identify(_table(spark, sf_dir, "documents")).drop("text_hash")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with a merge-type model and decoded again, as digests."""
    done = pieces.encode_pieces(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    dealt = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), shards=40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _byte_bpe():
    import public_tokenizers as public

    return packing.byte_bpe(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    packed = packing.pack(_table(spark, sf_dir, "documents"), _byte_bpe, end_id=0, window=1024, keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases in all documents."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    found = pages.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "path")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.digest(pii.find(_table(spark, sf_dir, "documents")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on sixteen whitened components."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), wanted=16)


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all orders, counted for each source of the documents."""
    return audit.interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_forest": op1_forest,
    "op2_quality": op2_quality,
    "op3_minhash": op3_minhash,
    "op4_lines": op4_lines,
    "op5_language": op5_language,
    "op6_pieces": op6_pieces,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_licenses": op9_licenses,
    "op10_pages": op10_pages,
    "op11_pii": op11_pii,
    "op12_whitening": op12_whitening,
    "op13_audit": op13_audit,
}
ORACLE_SQL: dict[str, str] = {
    "op2_quality": quality.ORACLE,
    "op4_lines": lines.ORACLE,
    "op9_licenses": licenses.oracle(),
    "op11_pii": pii.oracle(),
    "op13_audit": audit.ORACLE,
}
