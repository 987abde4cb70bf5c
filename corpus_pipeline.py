"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet before the next
one reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.llm import line_dedup, minhash, mixing, packing, toxicity
from strataspark.llm.common import SPACE, stored
from strataspark.llm.labelled import crc_mod


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3, by a model of the labels that op10 learns from.

    Null and blank texts stay; rows are judged one by one, so repeated rows and rows with a null id are judged alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, keep=crc_mod("doc_id", 4) != 2)
    return toxicity.without_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier; those that lose all their words go, null and blank ones stay.

    Rows with a null id stay as they are; repeated rows count as one document and stay repeated.
    """
    d = line_dedup.dedup_lines(docs, min_exact=line_dedup.MIN_EXACT)
    worded = lambda c: F.coalesce(c.rlike(f"[^{SPACE}]"), F.lit(False))
    own = {"text": F.col("text"), "n_chars": F.char_length("text").cast("bigint")}
    return d.where(worded(F.col("text")) | ~worded(F.col("row.text"))).select(*(own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, from 0.80 on five-word shingles, the document with the smallest id.

    Texts without words, null ones included, are copies of nothing; rows with a null id stay. Of rows with equal ids and
    texts one stays; an id with different texts stays with all of them if any of them would.
    """
    # 2 x 16 bundles of 3 miss a link at exactly 0.80 twice in 100,000, 2 x 12 four times in 10,000
    found = minhash.minhash_components(docs, threshold=80, m=16).where("doc_id is not null").groupBy("doc_id")
    found = stored(found.agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")))
    gone, repeated = found.where("not kept").select("doc_id"), found.where("kept and n > 1").select("doc_id")
    rest = docs.join(gone, "doc_id", "left_anti")
    if repeated.isEmpty():
        return rest.select(*docs.columns)
    once = rest.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled towards the target weights of sources, languages and topics, with mixing.BUDGET of the tokens at least.

    Null sources and languages are a value of their own; rows with equal ids are decided alike.
    """
    return mixing.mixed(docs, budget=mixing.BUDGET).where("sampled").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens; null and empty texts are an end id each, repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("minhash_near_dedup", drop_near_copies), ("mixing", sample_mixture), ("packing", pack)]

#: Models, edit distances and tokens are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
