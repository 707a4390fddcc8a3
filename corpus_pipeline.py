"""Corpus pipeline: language ID, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs.
All but the last return the columns of docs, whatever further columns there are and whatever their names.  Defined
results: documents that language ID rejects are those without a letter (null and empty texts among them), and those kept
without a label take the predicted one; mixing repeats and leaves out rows; packing returns op8's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import langid, mixing, packing, setsketch
from nearfield.llm.common import durable


def whole_row(docs: DataFrame) -> F.Column:
    """All columns of a row as one, so that no name of a stage's own can clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model gives a language; the model learns from those that aren't held out.

    A document without a `lang` takes the predicted one; a label that is there stays.  Without a labelled document to
    learn from there is no model, and documents with a letter stay as they are.
    """
    model = langid.trained(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    named = langid.identify(docs.select(whole_row(docs), "text"), model).where("lang_pred <> 'und'")
    lang = F.coalesce(F.col("doc.lang"), F.col("lang_pred"))
    return named.select(F.col("doc").withField("lang", lang).alias("doc")).select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (five-word shingles, similarity 0.8), that with the smallest id.

    Groups are of rows: different texts under one id are apart, and repeated rows are copies.  A row without an id stays
    only if its group has none with one; equal ids go by place in the table.
    """
    rows = durable(docs.select(whole_row(docs), F.monotonically_increasing_id().alias("row")), "rows")
    found = setsketch.near_duplicates(rows.select(F.col("row").alias("doc_id"), "doc.text"), k=5, least=80)
    found = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")).join(rows.select("row", F.col("doc.doc_id").alias("id")), "row")
    found = durable(found, "groups")
    first = F.min(F.struct(F.col("id").isNull(), "id", "row"))
    best = found.groupBy("group").agg(first["row"].alias("best"), F.count("*").alias("n")).where("n > 1")
    gone = durable(found.join(best, "group").where("row <> best").select("row"), "gone")
    return rows.join(gone, "row", "left_anti").select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it; the one that a source takes in part counts from a half up."""
    found = mixing.mixed(docs, F.col("doc_id"), mixing.words(F.col("text")), F.col("source"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    found = found.select("doc", times.alias("times")).where("times > 0")
    return found.select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 2,048 tokens."""
    return packing.packed(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]
#: Language ID and tokenizing are not expressible in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
