"""From documents to training sequences: language, repeated lines, near-duplicates, packing.

Every stage takes the documents its predecessor kept and returns documents with the same columns, but
for the last one, which returns the pieces of documents in sequences. Cases:

- ``language``: documents rejected by language identification go (null texts, no letter, narrow margin).
- ``lines``: later matches of lines go; a document that loses its last line with words goes. ``n_chars`` follows the text.
- ``near_duplicates``: of each group the document with the smallest id stays (null ids last, then the first as read);
  empty texts are in no group.
- ``packing``: every document is packed, an empty one as its end token.

A column that has the name of an operator's own output passes through the first and third stage unchanged;
``lines_removed`` is replaced in the second.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm import langid, line_dedup, minhash, packing
from gridlens.llm.order import Numbered
from gridlens.llm.units import BATCH_ROWS
from gridlens.session import materialize


def _bounded(spark: SparkSession) -> None:
    """Rows travel to Python in batches of bounded size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    training = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs.select("text", F.struct(*docs.columns).alias("document")), training)
    return found.where("accepted").select("document.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    found = line_dedup.dedup_lines(docs)
    emptied = (F.size(line_dedup.REMOVED) > 0) & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    found = found.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    table = Numbered(docs)
    numbered = table.select(document=F.struct(*docs.columns))
    groups = minhash.near_duplicates(table.select(text=F.col("text")), id="row")
    ids = numbered.select("row", F.col("document.doc_id").alias("id"))
    place = F.struct(F.col("id").isNull(), F.col("id"), F.col("row").alias("row"))
    first = groups.join(ids, "row").groupBy("component_id").agg(F.min(place).alias("first"))
    stay = materialize(first.select(F.col("first.row").alias("row")), "near-duplicates")
    return numbered.join(stay, "row", "left_semi").select("document.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("packing", pack),
]
#: Compression and merges by rank have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
