"""From raw documents to encoded training data: quality, exact copies, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, whatever their
names. Defined cases, in every stage: an empty table gives an empty table; nulls may be in any column.

* quality: a null or empty text stays, and so does a language with too few trusted texts; repeated rows are judged alike.
* exact: null and empty texts are one text; of equal texts the largest doc_id stays (null is the smallest), once.
* near: texts whose five-word shingles have a Jaccard similarity of 0.8 or more are linked, and of what links connect the
  smallest doc_id stays (null is the largest). Rows that share a doc_id are one. A text without words is linked with nothing.
* mix: null sources are a source; a document without words is emitted as its source's rate says; repeated rows share a draw.
* encode: a null or empty text has no ids; every row of docs gives a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import exact_dedup, mixing, ngram_join, quality, sentence_pieces
from maskwright.llm.common import new_path, read, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, new_path(spark, "pipeline-index"))
    index.add(docs)
    index.close()
    return exact_dedup.keep(docs, index)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_join(docs, words=5, percent=80)
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__stay")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["__stay"]), "left_semi")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_pieces.sentence_pieces(docs, sentence_pieces.default_model(), verify=True)


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("mix", mix_stage), ("encode", encode_stage)]

#: SQL can't express the quality model, the components or the vocabulary's merges; the tests hold brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
