"""Row numbers do not depend on how many executors there are when a table is scanned."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridlens import session
from gridlens.llm import line_dedup, order, sketch, warc
from gridlens.session import materialize

PARALLELISM = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture
def shifting(spark, monkeypatch):
    """Default parallelism changes with every table that is written, as when executors join in between."""
    held = spark.conf.get(PARALLELISM, None)
    write = session.materialize
    count = [1]

    def changing(df, name):
        found = write(df, name)
        count[0] = {1: 4, 4: 2, 2: 1}[count[0]]
        spark.conf.set(PARALLELISM, count[0])
        return found

    for module in (line_dedup, sketch, warc, order, corpus_pipeline):
        monkeypatch.setattr(module, "materialize", changing)
    spark.conf.set(PARALLELISM, 1)
    yield
    spark.conf.unset(PARALLELISM) if held is None else spark.conf.set(PARALLELISM, held)


@pytest.fixture(scope="module")
def table(spark):
    lines = [f"line {k} of words that stand in many texts and differ by {k * 7919}" for k in range(50)]
    rows = [(n, "\n".join(lines[(n * k) % 50] for k in range(1, 5)) + f"\nown {n} " + "filler " * 300, f"u{n}", "_metadata") for n in range(400)]
    return materialize(spark.createDataFrame(rows, "doc_id long, text string, url string, _file string").coalesce(1), "one-file")


def test_numbers_are_those_of_the_files(spark, table):
    numbered = order.Numbered(table)
    spark.conf.set(PARALLELISM, 1)
    one = {r["doc_id"]: r["row"] for r in numbered.select(doc_id=F.col("doc_id")).collect()}
    spark.conf.set(PARALLELISM, 4)
    scan = numbered.select(doc_id=F.col("doc_id"))
    four = {r["doc_id"]: r["row"] for r in scan.collect()}
    spark.conf.unset(PARALLELISM)
    assert one == four and len(set(one.values())) == 400
    other = order.Numbered(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, _metadata string"))
    assert other.select(doc_id=F.col("doc_id")).select("row").distinct().count() == 2


def test_lines_and_revisits_survive_new_executors(spark, table, shifting):
    found = {r["doc_id"]: r["lines_removed"] for r in line_dedup.dedup_lines(table).collect()}
    seen, expected = set(), {}
    for n in range(400):
        keys = [(n * k) % 50 for k in range(1, 5)]
        expected[n] = [at for at, k in enumerate(keys) if k in seen or k in keys[:at]]
        seen |= set(keys)
    assert found == expected
    pages = table.select(F.col("doc_id").alias("page_id"), "url", F.when(F.col("doc_id") % 4 == 0, F.lit("same " * 40)).otherwise(F.col("text")).alias("html"))
    path = session.scratch_path(spark, "warc")
    warc.write_archives(pages, path)
    rows = warc.resolve(warc.read_archives(spark, path), ["digest"]).collect()
    again = [r for r in rows if r["record_type"] == "revisit"]
    assert len(rows) == 400 and len(again) == 99 and {r["original_id"] for r in again} == {"0"}


def test_edits_survive_new_executors(table, shifting):
    rows = {r["doc_id"]: r for r in sketch.edited_fingerprints(table).collect()}
    assert len(rows) == 400 and all(r["next_doc_id"] == (n - 1 if n else 399) for n, r in rows.items())


def test_one_of_each_group_stays(spark, table, shifting):
    docs = materialize(table.unionByName(table.withColumn("doc_id", F.col("doc_id") + 1000)).coalesce(1), "doubled")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert {r["doc_id"] for r in kept} <= set(range(400)) and len(kept) == len({r["text"] for r in kept})


