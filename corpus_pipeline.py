"""Corpus pipeline: five stages, each over all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes as Parquet in the shared folder and rereads as the next stage's docs.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import decontamination, langid, neardup, packing, substrings
from siftwork.llm.langid import fresh
from siftwork.llm.queries import tokenizer_file
from siftwork.session import mark, release, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts, texts without a letter, and texts that no learned language explains better than chance.

    The model learns from the labelled rows of ``docs``. Where no row with a
    letter has a label, no language is learned and the letter alone decides.
    """
    model = langid.fit(docs)
    return langid.recognised(docs, model) if model.languages else langid.lettered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: one with the smallest id.

    Where ids are null or repeat, rows are told apart by a number; each group
    keeps its least (id, number), a null id counting as the largest.
    """
    row, cls = fresh(docs.columns, "_row"), fresh(docs.columns, "_cls")
    ids = docs.groupBy("doc_id").count()
    if ids.filter("count > 1 or doc_id is null").isEmpty():
        classes = neardup.near_duplicates(docs.select("doc_id", "text"), shingle_words=5).filter("kept").select(F.col("doc_id").alias(cls))
        return docs.join(classes, docs["doc_id"] == F.col(cls), "left_semi")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    known = rows.select(F.col(row).alias("row"), "doc_id", "text")
    classes = neardup.near_duplicates(known, id_col="row", shingle_words=5).select("component_id", F.col("doc_id").alias("row"))
    classes = stored(classes.join(known.select("row", "doc_id"), "row"), "numbered-classes")
    least = classes.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))["row"].alias("least"))
    gone = classes.join(least, "component_id").filter("row <> least").select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts what an earlier document holds already; documents of which nothing is left go. Rows with a null id stay as they are."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")])
    cut = substrings.without_repeats(docs.select("doc_id", "text", others.alias("row")), keep_spacing=True).filter("n_removed < n_words or n_words = 0")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, each judged by its own text."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their tokens, in sequences of 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), 0, with_ids=True)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: The stages train a model, search components and run a tokenizer: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's intermediate tables are deleted when its output is written, and that when the next one's is."""
    docs, begin = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, since=begin, keep=1)
    return docs
