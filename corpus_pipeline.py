"""The corpus pipeline: documents pass the stages in order, each on all that the one before kept.

Toxic documents go; of each group of near-duplicates the row of the least doc_id stays; documents
that overlap a benchmark item go; secrets are blotted out of the text (and n_chars follows); what is
left is packed into windows of 4096 tokens, each source in proportion to its share. Every stage's
table is written before the next reads it.

Edge cases, in every stage but the last with the columns of its input, whatever their names: null and empty
texts are no secrets' and no item's, score as a text without words does and link with nothing, so they stay;
rows are told apart by doc_id and text, so rows that share an id (or have none) are judged by their own text,
and of equal rows that link one stays; of tied copies the least doc_id stays, a null one after all others;
texts are read whole; an empty table gives an empty one. Packing gives each row its pieces, whatever its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontamination, jaccard_join, packing, secrets, toxicity
from tallyloom.llm._shared import Workspace, ready
from tallyloom.llm.queries import tokenizer_path

#: Below this size, as written, the list of removed rows is broadcast.
BROADCAST = 32 << 20


def _aside(docs: DataFrame) -> DataFrame:
    """(row, text): all columns but the text in one, so that no operator's result meets a column of its name."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")


def _whole(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of documents again, some of them changed."""
    back = lambda c: changed.get(c, F.col("text") if c == "text" else F.col(f"row.`{c}`"))
    return rows.select(*[back(c).alias(c) for c in columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier scores one half or more."""
    ready(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels.where(~toxicity.held_out()))
    return _whole(toxicity.score(_aside(docs), model).where("predicted = 0"), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts: that of the least doc_id (null after all others); of rows that repeat it, one.

    A row is told by its doc_id and text, as ids may be null or repeated.
    """
    work = Workspace(spark, "near_duplicates")
    found = jaccard_join.linked(spark, docs.select("doc_id", "text")).where("first is not null")
    found = work.write(found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "first"), "found")
    gone = work.write(found.where("not first").select("_id", "_key").distinct(), "gone")
    if work.size("gone") <= BROADCAST:
        gone = F.broadcast(gone)
    own = docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"))
    same = lambda t: own[0].eqNullSafe(t["_id"]) & (own[1] == t["_key"])
    kept = docs.join(gone, same(gone), "left_anti")
    twice = work.write(found.where("first").groupBy("_id", "_key").count().where("count > 1").select("_id", "_key"), "twice")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, same(twice), "left_anti").unionByName(once)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that overlap a benchmark item."""
    return decontamination.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their text replaced by its kind in brackets."""
    ready(spark)
    found = secrets.find(_aside(docs), redacted=True)
    n_chars = F.when(F.col("redacted") != F.col("text"), F.length("redacted").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    return _whole(found, docs.columns, text=F.col("redacted"), **({"n_chars": n_chars} if n_chars is not None else {}))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in windows of 4096 tokens, with their ids."""
    return packing.pack(spark, docs.select("doc_id", "text", "source"), tokenizer_path(), end_id=2, size=4096)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]
#: SQL expresses neither the classifier nor the tokenizer: tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return docs
