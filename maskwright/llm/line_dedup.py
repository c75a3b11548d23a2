"""Operator 1: line dedup.

Each text is split at line feeds. The key of a line is the line without white space at both ends, A-Z in lower
case. Keys of at least `min_chars` code points that at least `min_docs` documents hold lose all their lines,
except in the largest doc_id that holds them.

Lines are exploded with a 128-bit hash of the key, reduced to one row for each key and document and counted. The
counting keeps a partial sum in each task, so that a line which a third of all documents hold does not meet in
one. Keys over the threshold then join the positions of their lines (a join of two shuffled sides, whose skewed
partitions are split), and each text is reassembled once from the positions that stay.

Defined cases: a null text is one empty line. Rows that share a doc_id count as one document for a key. A null
doc_id is one document, smaller than all others. Other columns are not carried, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import SPACES, ascii_lower, read, text_of, written


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (what stays), n_lines, n_dropped: one row for each row of docs."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    split = F.split("text", "\n", -1)
    lines = (
        base.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(split).alias("pos", "line"))
        .select("doc_id", "version", "pos", F.btrim("line", F.lit(SPACES)).alias("line"))
        .filter(F.length("line") >= min_chars)
        .select("doc_id", "version", "pos", F.unhex(F.md5(ascii_lower(F.col("line")))).alias("key"))
    )
    common = written(
        lines.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
        .filter(F.col("docs") >= min_docs).select("key", "last"),
        "common-lines",
    )
    dropped = (
        lines.join(common, "key").filter(~F.col("doc_id").eqNullSafe(F.col("last")))
        .groupBy("doc_id", "version").agg(F.collect_set("pos").alias("gone"))
    )
    d = dropped.select(F.col("doc_id").alias("d_id"), F.col("version").alias("d_version"), "gone")
    joined = base.join(d, base.doc_id.eqNullSafe(d.d_id) & (F.xxhash64(base.text) == d.d_version), "left")
    n = F.size(split)
    stay = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone")), lambda p: F.element_at(split, p + 1))
    return joined.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")).alias("text"),
        n.cast("long").alias("n_lines"),
        F.size(F.coalesce("gone", F.array().cast("array<int>"))).cast("long").alias("n_dropped"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(read(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.doc_id, l.pos, l.line, c.k IS NOT NULL AND l.doc_id <> c.last AS gone FROM keyed l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
