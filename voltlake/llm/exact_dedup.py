"""Exact dedup over a persistent digest index.

The index is a table bucketed and sorted by digest, one row per distinct text ever seen. A batch is reduced to
one row per digest, anti-joined with the index by sort-merge (the index is not shuffled) and appended.

Rules: texts are equal when their bytes agree after lower-casing A-Z. Null counts as empty. Of equal texts of one
batch the row with the largest doc_id stays; a text already in the index keeps the id stored there, so adding a
batch twice adds nothing and decides the same. Rows without doc_id take part; if all rows of a text lack one, they
all stay. Repeated rows with the id that stays all count as kept. An empty batch gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder
from .common import documents_of, prepare, slots, staged


def _digests(batches):
    for b in batches:
        # bytes.lower() changes A-Z alone.
        out = [hashlib.sha256(t.lower()).digest() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "digest"])


def text_digests(docs: DataFrame) -> DataFrame:
    """doc_id and SHA-256 of the normalised text, per row."""
    return documents_of(docs).mapInArrow(_digests, "doc_id bigint, digest binary")


class DigestIndex:
    """Digest index at `path`. The bucket count is fixed when the index is made; give the same one when reopening."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = prepare(spark), path, buckets
        self.table = f"digest_index_{hashlib.sha256(path.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, doc_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, groups: DataFrame) -> None:
        """Add the digests of `groups` (digest, doc_id) that the index lacks."""
        fresh = groups.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")
        fresh = staged(fresh.select("digest", "doc_id"), "fresh-digests")  # read before the table changes
        (
            fresh.repartition(self.buckets, "digest")
            .write.format("parquet")
            .mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)

    def add(self, docs: DataFrame) -> DataFrame:
        """Decide a batch and append its new texts. One row per row: doc_id, keep_id, group_size, kept, text_sha256.

        `group_size` counts the rows of the batch with that text.
        """
        hashed = staged(text_digests(docs), "digests")
        groups = staged(
            hashed.groupBy("digest").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups"
        )
        self.append(groups)
        kept = self.rows().select("digest", F.col("doc_id").alias("keep_id"))
        decided = staged(groups.hint("merge").join(kept, "digest").select("digest", "keep_id", "group_size"), "digest-decisions")
        # Both sides are shuffled here, so that adaptive execution can split a text that holds a third of the rows.
        return hashed.join(decided.hint("merge"), "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """`DigestIndex.add` on a new, empty index."""
    spark = docs.sparkSession
    return DigestIndex(spark, new_folder(spark, "digest-index"), slots(spark)).add(docs)
