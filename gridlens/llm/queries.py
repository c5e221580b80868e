"""The registered queries of this package, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm import ann, bpe, exact_dedup, importance, langid, line_dedup, merkle, minhash, packing, sharding, sketch, url_filter, warc
from gridlens.llm.units import BATCH_ROWS
from gridlens.session import materialize, scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table, with rows set to travel to Python in batches of bounded size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of all other vectors for every vector whose id is divisible by 20."""
    return ann.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Minimax shards of documents; equal texts stay together."""
    return sharding.shard_rows(table(spark, folder, "documents"), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: Host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_filter.judge(table(spark, folder, "pages"), url_filter.rules_table(spark, URL_RULES))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the lines that match an earlier one."""
    found = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"), count="n_lines")
    return found.select("doc_id", "n_lines", "lines_removed", "text")


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(encoded, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicates of documents by 3-word shingles at 0.85."""
    return minhash.near_duplicates(table(spark, folder, "documents"), words=3, share=(85, 100))


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return sketch.edited_fingerprints(table(spark, folder, "documents"))


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    dictionaries = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as archives, read back and resolved."""
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), path)
    read = warc.read_archives(spark, path).select(
        "record_id", "id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    found = warc.resolve(materialize(read, "warc-records"), ["payload_bytes", "payload_digest"])
    return found.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("original_id").cast("long").alias("refers_to"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    packed = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The row of equal texts that stays, for every document."""
    return exact_dedup.dedup(spark.read.parquet(f"{folder}/documents.parquet"))


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest of all documents, and what their proofs say once a fifth of them is tampered with."""
    tampered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    evidence = merkle.leaf(*[F.col(c) for c in merkle.FIELDS[:-1]], tampered)
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaves = merkle.leaves(spark.read.parquet(f"{folder}/documents.parquet"), F.when(chosen, evidence))
    found = merkle.manifest(leaves).withColumn("verified", F.col("folded_root") == F.col("root"))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_importance(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the documents with 20 words or more, drawn towards the benchmark."""
    docs, target = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
    return importance.resample(docs, target, percent=10)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_neighbours, op2_shards, op3_url_filter, op4_line_dedup, op5_byte_bpe, op6_minhash, op7_fingerprints, op8_language, op9_warc, op10_packing, op11_exact_dedup, op12_merkle, op13_importance)}
