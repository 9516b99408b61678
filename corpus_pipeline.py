"""A corpus pipeline of five stages: each reads what its predecessor kept.

Every stage but the last returns the columns of ``documents``; the last returns them with the
number of the copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intronaut.llm.decontaminate import contaminated_rows
from intronaut.llm.mixing import emitted
from intronaut.llm.near_dedup import near_duplicates
from intronaut.llm.substring_dedup import remove_repeats_with
from intronaut.llm.toxicity import score_with, train
from intronaut.scratch import materialize

#: A document goes if its toxicity score reaches this.
TOXIC = 0.5
#: Words of a window whose repeats are removed, and of a window that marks contamination; share of words hit that is too much.
REPEAT_WORDS, ITEM_WORDS, ITEM_SHARE = 35, 13, 20


def unused(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` doesn't have yet: ``name``, with underscores where it is taken."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below ``TOXIC`` stay; the model is learned from ``labels`` and these documents.

    Null and empty texts are scored like any other; a null id has no label. Repeated rows get the same score.
    Without any label every score is 0 and all rows stay.
    """
    model, score = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), unused("toxicity_score", docs)
    return score_with(docs, model, score).where(F.col(score) < TOXIC).select(*docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, the smallest doc_id (null last); five-word shingles at Jaccard 0.8.

    Rows are judged by their texts under a key of their own, so rows that repeat a doc_id or have none are
    documents like any other. Texts without words link with nothing and stay.
    """
    # written, so that a row has the same key wherever it is read
    key, by = unused("row_key", docs), F.col("doc_id").cast("long")
    keyed = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), width=5, percent=80)
    ids = keyed.select(F.col(key).alias("key"), by.alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("without"), "id", "key"))
    kept = found.select(F.col("doc_id").alias("key"), "component_id").join(ids, "key").groupBy("component_id").agg(first.alias("first")).select(F.col("first.key").alias("kept"))
    return keyed.join(kept, keyed[key] == kept["kept"], "left_semi").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go, as the operator defines it; rows with repeats get their kept words joined by one space.

    ``n_chars`` of those rows is the length of the new text. Null and empty texts stay as they are, and so does a row
    whose words all go, with an empty text.
    """
    found = remove_repeats_with(docs, REPEAT_WORDS)
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    columns = [F.when(changed, new[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns]
    return found.select(*columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is contaminated by ``benchmark`` go, whatever their doc_id; null and empty texts stay.

    Rows are known by 128 bits of a hash of doc_id and text: repeated rows are judged alike.
    """
    text, content = F.col("text").cast("string"), (F.col("doc_id").cast("long"), F.col("text").cast("string"))
    key = F.struct(F.xxhash64(*content).alias("a"), F.xxhash64(F.lit(1), *content).alias("b"))
    rows = docs.select(key.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = contaminated_rows(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ITEM_WORDS, ITEM_SHARE)
    # written, so that the join is between two exchanges and Spark may split the copies of a row
    bad = materialize(found.where("contaminated").select(F.col("row").alias(unused("bad", docs))).distinct(), "contaminated")
    return docs.join(bad, key == F.col(unused("bad", docs)), "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each copy of a document that it takes.

    Null sources are one source, null and empty texts have size 0 and go in at their source's rate, repeated rows each by themselves.
    """
    return emitted(docs, unused("copy", docs))


STAGES = [("toxicity", toxicity), ("minhash_dedup", minhash_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("mixing", mixing)]
#: Training a model can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
