"""Corpus pipeline: language, exact copies, near copies, source mix, tokens.

Each stage is a function of (spark, docs, sf_dir); all but the last return the columns
of ``docs``. A null or empty text has no letter and goes at the first stage; an empty
table passes through every stage; columns beside those of documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popgraph.llm import bpe, exact_dedup, language, mixing, simhash
from popgraph.llm.common import free, with_group
from popgraph.llm.queries import table, vocabulary
from popgraph.plans.stage import new_path, passing, small_enough, stage

#: Dropped rows whose ids are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 100_000
#: Rows of a batch that goes to Python while the pipeline runs.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def _folded() -> Column:
    """SHA-256 of the text with A-Z lower-cased, as exact groups have it."""
    folded = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.unhex(F.sha2(folded, 256))


def _rows(docs: DataFrame, mark: Column) -> DataFrame:
    """The rows as they are, in one struct, and what tells them apart, id and ``mark``: no name of theirs can clash."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), mark.alias("mark"))


def _same(rows: DataFrame) -> Column:
    return rows["id"].eqNullSafe(F.col("_id")) & (rows["mark"] == F.col("_of"))


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows (see ``_rows``) that are not in ``dropped`` (_id, _of)."""
    ids = stage(dropped.distinct(), "pipeline-dropped")
    small = F.broadcast(ids) if small_enough(ids, BROADCAST_IDS) else ids
    return rows.join(small, _same(rows), "left_anti")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which a language is recognised.

    Null texts, those without a letter and, if no row is labelled, all texts go. Repeated
    rows stay. An empty table stays empty; columns of any name are carried along.
    """
    told, score = free("_lang_pred", docs.columns), free("_score", docs.columns)
    known = language.identify(docs, language.fit(docs), pred_col=told, score_col=score)
    return known.where(F.col(told) != "und").drop(told, score)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of rows that repeat it, one.

    Null texts equal empty ones; null ids are smallest. A row is dropped by its id and
    text, so that rows of one id and other texts stay. Of rows that repeat the id and the
    text, the one whose other columns sort first as JSON stays. An empty table stays
    empty; columns of any name are carried along.
    """
    groups = stage(exact_dedup.exact_groups(docs), "pipeline-exact")
    groups = groups.select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_of"), "kept")
    kept = _without(_rows(docs, _folded()), groups.where("not kept").drop("kept"))
    again = groups.where("kept").groupBy("_id", "_of").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = stage(again.drop("n"), "pipeline-again")
    if again.isEmpty():
        return kept.select("row.*")
    once = kept.join(again, _same(kept), "left_semi").groupBy("id", "mark").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.join(again, _same(kept), "left_anti").select("row.*").unionByName(once.select("row.*"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each SimHash component; of unlike texts that have this id, one.

    Texts without a word form one component. Rows are dropped by id and text; rows that
    repeat both stay together (the stage before leaves none). Null ids are largest; of
    components of null ids alone one text stays. An empty table stays empty; columns of
    any name are carried along.
    """
    mark = F.xxhash64("text")  # tells apart the texts of one id
    groups = stage(simhash.near_groups(docs, mark=mark), "pipeline-near")
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    of_least = with_group(groups.where(least), ["component"], "mark", {"first": ("min", "mark")})
    dropped = groups.where(~least).select("doc_id", "mark").unionByName(of_least.where("mark <> first").select("doc_id", "mark"))
    return _without(_rows(docs, mark), dropped.toDF("_id", "_of")).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: whole texts once a round and the drawn words of the rest; n_chars follows the text.

    Null sources are a source; texts without a word, null ones too, are taken zero times. Repeated
    ids are drawn in the order of the rows' hashes. An empty table stays empty; columns of
    any name are carried along.
    """
    rows = mixing.mixed_rows(docs)
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in rows.columns else rows


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids (little-endian, 32 bits) and SHA-256 of the ids and of what they decode to.

    A null text is empty and has no ids; repeated rows give rows of their own; an empty
    table gives none; other columns are not looked at.
    """
    coded = bpe.encode(docs, vocabulary(), decode=True)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language", known_language),
    ("exact_dedup", without_copies),
    ("simhash", without_near_copies),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: SQL has neither the classifier, XXH64 nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again.

    Meanwhile batches to and from Python hold few rows: executors keep the memory of the
    largest batch, and rows here are whole documents.
    """
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(BATCH_ROWS))
    try:
        docs = table(spark, sf_dir, "documents")
        for name, step in STAGES:
            path = new_path(spark, f"pipeline-{name}")
            step(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(passing(spark, path))
        return docs
    finally:
        spark.conf.set(BATCH, before)
