"""Operator 6: exact dedup against a persistent digest index. DataFrame operations only.

Texts are equal when identical after A-Z are in lower case; null counts as empty. The index is a Parquet table,
bucketed and sorted by digest, one row for each digest. New rows are reduced to one row for each digest in two
steps that keep partial sums (first by digest and doc_id, so that thousands of copies do not meet in one task),
joined against the index by a sort-merge anti-join that needs no shuffle of the index, and appended.

Of equal texts the row with the largest doc_id stays; a digest that the index knew already keeps the row it had.
Defined cases: rows that share doc_id and text are all reported, and one of them stays. A null doc_id is smaller
than all others. Empty and null texts are equal to each other. Other columns are carried by `keep` as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import ascii_lower, new_path, read, text_of


def digest_of(text_col: str = "text"):
    return F.unhex(F.sha2(ascii_lower(text_of(text_col)), 256))


COLUMNS = "digest BINARY, keep_id BIGINT, group_size BIGINT, n_keep BIGINT"


class DigestIndex:
    """digest binary, keep_id long, group_size long, n_keep long, bucketed and sorted by digest under `path`."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Appends the digests of docs that the index has not."""
        groups = (
            docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(text_col).alias("digest"))
            .groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
            .groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.max_by("n", F.coalesce("doc_id", F.lit(-(2**63)))).alias("n_keep"))
        )
        known = self.spark.table(self.table).select("digest").hint("merge")
        fresh = groups.repartition(self.buckets, "digest").join(known, "digest", "left_anti")
        fresh.select("digest", "keep_id", "group_size", "n_keep").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def close(self) -> None:
        """Takes the table out of the catalog; its files stay under `path`, where rows() and a later index find them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def rows(self) -> DataFrame:
        """The index without its bucketing: a join with it shuffles both sides, and can split skewed partitions."""
        return self.spark.read.schema(COLUMNS).parquet(self.path)


def decisions(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs."""
    rows = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(text_col).alias("digest"))
        .groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    )
    return (
        rows.join(index.rows(), "digest")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    )


def keep(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns, whatever their names."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), digest_of(text_col).alias("digest"))
    held = rows.join(index.rows().select("digest", F.col("keep_id").alias("keep"), "n_keep"), "digest").filter(F.col("id").eqNullSafe(F.col("keep")))
    more = held.filter("n_keep > 1").dropDuplicates(["digest"])
    return held.filter("n_keep = 1").unionByName(more).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    index = DigestIndex(spark, new_path(spark, "op6-index"))
    index.add(docs)
    index.close()
    return decisions(docs, index)


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
