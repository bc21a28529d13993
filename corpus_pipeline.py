"""A corpus from raw documents to packed sequences: each stage is one operator, written as Parquet before the next.

Rules: every stage takes null texts, ids and languages as its operator states, and keeps all columns of its input
but the last, which returns the packed pieces. Rows without doc_id pass the stages that compare documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.llm import exact_dedup, language_id, packing, secret_scan, set_join
from voltlake.llm.common import staged

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A document goes if no language holds this share of it.
LEAST_SHARE = 0.3
#: Least places in the bitmap of the ids that go, for each of them.
ID_BITS = 16


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, those no single language leads and those that fit no learned language."""
    return language_id.keep_identified(docs, language_id.train(docs), LEAST_SHARE)


def _less(docs: DataFrame, gone: DataFrame, same: Column) -> DataFrame:
    """`docs` less the rows that match a row of `gone` by `same`; a match has `gone._id` as its doc_id.

    A bitmap of hashed ids, two to four bytes for each row of `gone`, is all that every task gets. Rows whose bit isn't set stay
    as they are; only the others, matches and one in ID_BITS of the rest at most, are shuffled with their texts.
    """
    size = max(1 << 15, 1 << (ID_BITS * gone.count()).bit_length())
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(size))
    number, at = (lambda c: F.bitmap_bucket_number(place(c))), (lambda c: F.bitmap_bit_position(place(c)))
    bits = gone.groupBy(number("_id").alias("_bucket")).agg(F.bitmap_construct_agg(at("_id")).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (at("doc_id") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at("doc_id") % 8).cast("int")) > 0, F.lit(False))
    rows = docs.join(F.broadcast(bits), number("doc_id") == F.col("_bucket"), "left")
    perhaps = rows.where(is_set).select(docs.columns)
    return rows.where(~is_set).select(docs.columns).unionByName(perhaps.join(gone, same, "left_anti"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` less the ids of `gone`. An id that several rows bear goes with all of them."""
    gone = staged(gone.select(F.col("doc_id").alias("_id")).distinct(), "gone")
    return _less(docs, gone, F.col("doc_id") == F.col("_id"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id stays. Rows go by id and text: another text that
    bears the id of a copy stays."""
    gone = exact_dedup.exact_duplicates(docs).where("NOT kept").select("doc_id", "text_sha256").distinct()
    gone = staged(gone.withColumnsRenamed({"doc_id": "_id", "text_sha256": "_sha"}), "gone")
    text = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    same = (F.col("doc_id") == F.col("_id")) & (F.sha2(text.cast("binary"), 256) == F.col("_sha"))
    return _less(docs, gone, same)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by sets of five-word shingles at a similarity of 0.8 or more, the smallest doc_id stays."""
    joined = set_join.linked_components(docs, num=4, den=5, width=5)
    return _without(docs, joined.where(F.col("doc_id") != F.col("component_id")))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets inside texts; no document goes."""
    return secret_scan.redact(docs, secret_scan.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the remaining documents into sequences of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scan", remove_secrets),
    ("packing", pack),
]
#: SQL can express neither the fitted models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
