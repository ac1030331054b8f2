"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read
again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rastermill.llm import decontaminate, lines, packing, quality, simhash
from rastermill.llm.queries import tokenizer_path
from rastermill.sources.shared import drop_since, save, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur over documents stay in one of them; n_chars is counted anew.

    A document that has no text left after that is gone.
    """
    given = {c: f"_given_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}  # the operator's counts have these names
    kept = lines.dedup_lines(docs.withColumnsRenamed(given)).where((F.col("n_dropped") == 0) | (F.length(F.btrim("text", F.lit(lines.BLANKS))) > 0))
    kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*[F.col(given.get(c, c)).alias(c) for c in docs.columns])


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the largest id, of each group of near-duplicates.

    Line dedup keeps a recurring line in the largest id that holds it, so the largest of a group is the one that
    has such lines. Rows of one id are one document: the longest text stays. Rows without an id stay.
    """
    members = save(simhash.near_duplicates(docs, words=5).select("doc_id", "component_id").distinct(), "members")
    last = save(members.groupBy("component_id").agg(F.max("doc_id").alias("_last")).where("component_id <> _last").withColumnRenamed("component_id", "_group"), "groups")
    others = save(members.join(last, F.col("component_id") == F.col("_group")).where("doc_id <> _last").select(F.col("doc_id").alias("_copy")), "copies")
    kept = docs.join(others, docs["doc_id"] == others["_copy"], "left_anti")
    again = save(docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1 and doc_id is not null").select(F.col("doc_id").alias("_again")), "repeated-ids")
    if again.isEmpty():
        return kept
    repeated = kept["doc_id"] == again["_again"]
    rank = next(r for k in range(len(docs.columns) + 1) if (r := f"_rank{k}") not in docs.columns)
    longest = Window.partitionBy("doc_id").orderBy(F.desc(F.length("text")), *[F.desc(c) for c in docs.columns if c != "doc_id"])
    one = kept.join(again, repeated, "left_semi").withColumn(rank, F.row_number().over(longest)).where(F.col(rank) == 1).drop(rank)
    return kept.join(again, repeated, "left_anti").unionByName(one)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", good_quality), ("line_dedup", distinct_lines), ("near_dedup", distinct_documents), ("decontamination", decontaminated), ("packing", packed)]

#: SQL can't express the classifier, the fingerprints, the alignment or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = written(spark)
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_since(spark, mark, keep=docs)  # what the stage wrote on its way, and the stage before it
    return docs
