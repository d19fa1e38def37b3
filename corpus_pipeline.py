"""The corpus pipeline: quality rules, near duplicates, personal data, source mix, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
``run`` writes each stage's result as Parquet in the shared folder and hands the reread table on.
All but the last stage return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import jaccard_join, line_rules, mixing, packing, pii
from panelforge.llm.common import materialize, table, words


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without their failing lines. Documents that lose no line
    stay as they are. Null, empty and blank texts are rejected; repeated rows are judged one by one."""
    out = line_rules.clean_lines(docs, prefix="_r_").filter("_r_kept")
    changed = F.col("_r_lost_chars") > 0
    new = {"text": F.when(changed, F.col("_r_clean_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("_r_clean_text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns(new).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component. Of rows that share that id, one of each
    word sequence stays: texts that differ are no copies of each other because of an id. Rows without
    an id can't be told apart and stay. Texts are shuffled once, by id; word sequences are compared
    where an id has several rows only."""
    keep = jaccard_join.near_duplicates(docs).filter("doc_id = component_id").groupBy(F.col("doc_id").alias("_keep")).agg(F.count("*").alias("_rows"))
    same = F.md5(F.array_join(words(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), " ").cast("binary"))
    out = docs.join(keep, F.col("doc_id") == F.col("_keep")).withColumn("_same", F.when(F.col("_rows") > 1, same))
    out = out.dropDuplicates(["_keep", "_same"]).select(*docs.columns)
    return out.unionByName(docs.filter("doc_id is null"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities replaced; null texts and texts without entities stay as they are."""
    out = pii.surrogates(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_pii_n") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; repeated rows and rows without an id are units too."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; a null or empty text is its end mark alone."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", deduplicate), ("pii", private), ("mixing", mix), ("packing", pack)]

#: The mix and the packing's program can't be put in SQL. Tests hold near duplicates against brute
#: force, the other stages against less: see the README.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = materialize(f(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
